"""Normalisation of business names and addresses as Column expressions."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The words that matching ignores.
LEGAL_FORMS = "llc inc incorporated corp corporation co company ltd limited pvt private llp lp pc plc pllc sarl sas sasu eurl sci sa".split()
STOPWORDS = "and the of".split()
NOISE = LEGAL_FORMS + STOPWORDS

#: Letters whose decomposition is not a base letter and marks.
SPELLED = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ł": "l", "Æ": "AE", "Œ": "OE", "Ø": "O", "Đ": "D", "Ł": "L"}


def _latin() -> tuple[str, str]:
    """Accented Latin letters and their base letters, from Unicode's decompositions."""
    pairs = [(chr(c), unicodedata.normalize("NFKD", chr(c))[0]) for c in range(0xC0, 0x250)]
    pairs = [(a, b) for a, b in pairs if a not in SPELLED and b.isascii() and a != b]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


#: Signs of the Indic scripts and their letters. Fixed values.
SIGNS = {"VIRAMA": "", "NUKTA": "", "ANUSVARA": "n", "CANDRABINDU": "n", "VISARGA": "h"}


def _indic() -> dict[str, str]:
    """Letters, vowel signs and digits of the Indic scripts in Latin letters, by their Unicode names.

    Every sign is spelled alone: consonants without their inherent vowel, long vowels and retroflexes as plain ones."""
    out = {}
    for c in range(0x900, 0xD80):
        found = re.fullmatch(r"\w+ (LETTER|VOWEL SIGN|DIGIT|SIGN) (?:SHORT |CANDRA |VOCALIC )?([A-Z]+)", unicodedata.name(chr(c), ""))
        if not found:
            continue
        kind, word = found.groups()
        if kind == "DIGIT":
            out[chr(c)] = str(unicodedata.digit(chr(c)))
        elif kind == "SIGN":
            if word in SIGNS:
                out[chr(c)] = SIGNS[word]
        elif len(word) <= 4:
            plain = re.sub(r"(.)\1+", r"\1", word.lower())
            out[chr(c)] = plain[:-1] if len(plain) > 1 and plain[0] not in "aeiou" and plain.endswith("a") else plain
    return out


def _tables() -> tuple[str, str, dict[str, str]]:
    """What translate takes, and letters that more than one letter spells; signs without a letter come last and go."""
    pairs, spelled, first = list(zip(*_latin())), dict(SPELLED), {}
    for sign, plain in _indic().items():
        if len(plain) <= 1:
            pairs.append((sign, plain))
        elif first.setdefault(plain, sign) != sign:
            pairs.append((sign, first[plain]))
        else:
            spelled[sign] = plain
    pairs.sort(key=lambda p: p[1] == "")
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs), spelled


_FROM, _TO, _SPELLED = _tables()


def to_ascii(x: Column) -> Column:
    """Latin letters without marks, Indic letters spelled in Latin ones; other scripts stay (clean drops them)."""
    x = F.translate(x, _FROM, _TO)
    for a, b in _SPELLED.items():
        x = F.replace(x, F.lit(a), F.lit(b))
    return x


def clean(x: Column) -> Column:
    """ASCII, lower case, dots deleted, every other run outside a-z and 0-9 one space; null: empty."""
    plain = F.replace(F.lower(to_ascii(F.coalesce(x, F.lit("")))), F.lit("."), F.lit(""))
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def _words(x: Column) -> Column:
    return F.filter(F.split(x, " "), lambda w: (w != "") & ~w.isin(NOISE))


def name_key(name: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(_words(clean(name)))), " ")


def strip_zeros(x: Column) -> Column:
    return F.when(x == "", "").otherwise(F.coalesce(F.nullif(F.regexp_replace(x, "^0+", ""), F.lit("")), F.lit("0")))


def house_no(addr: Column) -> Column:
    """The first digit run without leading zeros; '' where there is none."""
    return strip_zeros(F.regexp_extract(F.coalesce(addr, F.lit("")), r"(\d+)", 1))


def name_tokens(name: Column) -> Column:
    """Domains unwrapped, number tags dropped, clean, without legal forms and stop words; order and repeats kept."""
    x = F.lower(to_ascii(F.coalesce(name, F.lit(""))))
    x = F.regexp_replace(x, r"(?:www\.)?([a-z0-9-]+)\.(?:com|co\.in|in|net|org|fr|us|biz|info)\b", "$1")
    return _words(clean(F.regexp_replace(x, r"#\s*\d+", " ")))


def nums(addr: Column) -> Column:
    """All different digit runs without leading zeros, in order of first occurrence."""
    return F.array_distinct(F.transform(F.regexp_extract_all(F.coalesce(addr, F.lit("")), F.lit(r"(\d+)"), 1), strip_zeros))


def addr_parts(addr: Column) -> Column:
    return F.filter(F.transform(F.split(F.coalesce(addr, F.lit("")), ","), clean), lambda p: p != "")


def is_nonlatin(x: Column) -> Column:
    return F.coalesce(x, F.lit("")).rlike(r"[\p{L}&&[^\u0000-ɏ]]")


def normalize(df: DataFrame) -> DataFrame:
    """The normalised table: one row for each of df's, all columns derived natively. Nulls are empty texts."""
    addr = F.coalesce("business_address", F.lit(""))
    base = df.select("entity_id", "country", (F.trim(addr) == "").alias("empty_addr"), F.array_join(name_tokens(F.col("business_name")), " ").alias("name_tok"), clean(addr).alias("addr"), addr_parts(addr).alias("parts"), nums(addr).alias("nums"), is_nonlatin(F.concat_ws(" ", "business_name", "business_address")).alias("nonlatin"))
    tok = F.filter(F.split("name_tok", " "), lambda w: w != "")
    return base.select("*", F.array_join(F.array_sort(F.array_distinct(tok)), " ").alias("name_key"), F.replace("name_tok", F.lit(" "), F.lit("")).alias("name_ns"), F.coalesce(F.get("nums", F.lit(0)), F.lit("")).alias("hn"))


#: Raw legal tokens and their canonical forms. Fixed values.
LEGAL_CANON = {"incorporated": "inc", "corporation": "corp", "company": "co", "limited": "ltd", "private": "pvt"}


def legal_form(name: Column) -> Column:
    """Sorted different canonical legal tokens of the raw name."""
    canon = F.create_map(*[F.lit(v) for w in LEGAL_FORMS for v in (w, LEGAL_CANON.get(w, w))])
    return F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.split(clean(name), " "), lambda w: canon[w]), lambda w: w.isNotNull()))), " ")


#: Small words and signs that tell raw names apart. Fixed values.
SMALL = ["&", "and", "the", "of", "+", "-", "'s"]


def raw_name(name: Column) -> Column:
    """Lower case without marks, white space collapsed; legal forms, stop words and signs stay."""
    return F.trim(F.regexp_replace(F.lower(to_ascii(F.coalesce(name, F.lit("")))), r"\s+", " "))


def small_words(raw: Column) -> Column:
    """The different small words of a raw name; & and + count wherever they stand."""
    return F.array_intersect(F.split(F.regexp_replace(raw, "([&+])", " $1 "), " "), F.array(*map(F.lit, SMALL)))


def learn_token_map(pairs: DataFrame, min_count: int = 3, min_share: float = 0.6) -> DataFrame:
    """tok, target from true pairs of token lists (rec, s1): the target that stands at a token's place often and mostly.

    Only pairs of equally many tokens tell places apart.
    """
    met = pairs.where(F.size("rec") == F.size("s1")).select(F.explode(F.arrays_zip("rec", "s1")).alias("z")).groupBy(F.col("z.rec").alias("tok"), F.col("z.s1").alias("target")).agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("tok"))
    return met.withColumn("share", share).where((F.col("n") >= min_count) & (F.col("share") >= min_share)).select("tok", "target")


def mapped_names(df: DataFrame, token_map: DataFrame) -> DataFrame:
    """entity_id, mapped: raw names (entity_id, business_name) with a learned token map (tok, target) applied.

    Tokens look up their targets in a join, so the map may be of any size."""
    words = df.select("entity_id", F.posexplode(F.split(clean(F.col("business_name")), " ")).alias("pos", "tok")).where("tok <> ''")
    found = words.join(token_map.select("tok", "target"), "tok", "left").select("entity_id", "pos", F.coalesce("target", "tok").alias("w")).where(~F.col("w").isin(NOISE))
    joined = found.groupBy("entity_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda x: x["w"]), " ").alias("mapped"))
    return df.select("entity_id").join(joined, "entity_id", "left").select("entity_id", F.coalesce("mapped", F.lit("")).alias("mapped"))
