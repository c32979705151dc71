"""Language identification by compression: the language whose zstandard dictionary makes a text smallest."""

from __future__ import annotations

import re

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm.base import held_out, slices, table

#: Bytes of each language's raw-content dictionary, and of each piece of text that is compressed alone.
DICTIONARY_BYTES, PIECE_BYTES = 64_000, 2048
#: Training rows a language, at most about so many; code points of each that are looked at, and of the segments they are cut into.
ROWS_A_LANGUAGE, EXCERPT_CHARS, SEGMENT = 800, 2000, 400
#: A margin under this share of the second size is narrow; the text is then rejected.
NARROW = 0.002

_NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str | None) -> str:
    """The text's runs of letters, lower-cased, with one space between; markup, digits and repeated marks fall away."""
    return _NO_LETTERS.sub(" ", (text or "").lower()).strip()


def fit_dictionaries(docs: DataFrame, usable: Column, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", rows: int = ROWS_A_LANGUAGE, size: int = DICTIONARY_BYTES) -> list[tuple[str, bytes]]:
    """(language, dictionary) by falling number of training rows.

    The sample: from each language the rows whose id's hash falls under rows / (the language's rows), so about `rows` of
    them, independent of order and partitioning; of a long text a middle excerpt of EXCERPT_CHARS. What comes to the driver
    is at most (number of languages) * rows * EXCERPT_CHARS. Labelled texts quote other languages: dictionaries of one half
    of the sample judge the other half's segments, and the final dictionaries hold those that pass.
    """
    known = docs.where(usable & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = [tuple(r) for r in known.groupBy(lang_col).count().collect()]
    if not counts:
        return []
    share = F.create_map(*[x for lang, n in counts for x in (F.lit(lang), F.lit(min(1.0, rows / n)))])
    point = F.pmod(F.xxhash64(F.col(id_col), F.lit(3)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    at = F.greatest(F.lit(1), (F.length(text_col) - EXCERPT_CHARS) / 2).cast("int")
    picked = known.where(point < share[F.col(lang_col)]).select(lang_col, point.alias("p"), id_col, F.substring(F.col(text_col), at, F.lit(EXCERPT_CHARS)))
    got: dict[str, list[list[str]]] = {lang: [] for lang, _ in counts}
    for lang, *_, text in sorted(picked.collect(), key=lambda r: (r[0], r[1], str(r[2]), r[3])):
        plain = letters(text)
        got[lang].append([plain[i : i + SEGMENT] for i in range(0, len(plain), SEGMENT)])
    order = [lang for lang, _ in sorted(counts, key=lambda x: (-x[1], x[0]))]
    # A language of little text is judged by all of it, one of none is never predicted.
    first = [(lang, d) for lang in order if len(d := _joined(got[lang][::2], size)) >= 8 or len(d := _joined(got[lang], size)) >= 8]
    judge, out = Compressors(first), []
    for lang, coarse in first:
        clean = [[s for s in segments if judge.identify(s)[0] == lang] for segments in got[lang][1::2]]
        fine = _joined(clean, size)
        out.append((lang, fine if len(fine) >= size // 2 else (fine + b" " + coarse)[:size]))
    return out


def _joined(texts: list[list[str]], size: int) -> bytes:
    """The texts' first segments, then their second ones and so on, each different one once, up to size bytes."""
    seen: dict[str, None] = {}
    for k in range(max(map(len, texts), default=0)):
        for t in texts:
            if k < len(t):
                seen.setdefault(t[k])
    return " ".join(seen).encode()[:size]


class Compressors:
    """Compressed size of a text under each language's dictionary."""

    def __init__(self, dictionaries: list[tuple[str, bytes]]):
        how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=3, min_match=3, strategy=2, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.langs, self.press = [lang for lang, _ in dictionaries], []
        for _, content in dictionaries:
            d = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(compression_params=how)
            self.press.append(zstandard.ZstdCompressor(dict_data=d, compression_params=how))

    def sizes(self, text: str) -> list[int]:
        raw = f" {text} ".encode()
        pieces = [raw[at : at + PIECE_BYTES] for at in range(0, len(raw), PIECE_BYTES)]
        return [sum(len(p.compress(x)) for x in pieces) for p in self.press]

    def identify(self, text: str | None) -> tuple[str, float, float]:
        """(language or und, score, margin as a share of the second size). Ties go to the language with more training rows."""
        plain = letters(text)
        if not plain or not self.langs:
            return "und", 0.0, 0.0
        sizes = self.sizes(plain)
        best = min(range(len(sizes)), key=lambda i: (sizes[i], i))
        second = min((s for i, s in enumerate(sizes) if i != best), default=2 * sizes[best])
        return self.langs[best], 1 - 0.5 * 2.0 ** (-(second - sizes[best]) / 4), (second - sizes[best]) / second


def identify_languages(docs: DataFrame, dictionaries: list[tuple[str, bytes]], narrow: float = NARROW, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score", accept_col: str = "accepted") -> DataFrame:
    """Every row of docs with its language, a score from 0 to 1 and whether the margin is wide enough to accept it.

    Whole texts are read, in pieces of bounded size. und, score 0, rejected: null texts and texts without a letter, or
    every text where no dictionary could be fitted. Rows are independent: repeats get equal answers, empty tables none.
    Columns of docs named like one of the three results, in any case, give way to it.
    """
    from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

    names = [c for c in docs.columns if c.lower() not in {x.lower() for x in (lang_col, score_col, accept_col)}]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("_text_to_identify"))
    schema = StructType([*[docs.schema[c] for c in names], StructField(lang_col, StringType()), StructField(score_col, DoubleType()), StructField(accept_col, BooleanType())])

    def run(batches):
        model = Compressors(dictionaries)
        for batch in slices(batches):
            found = [model.identify(t) for t in batch.columns[-1].to_pylist()]
            more = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array([f[0] != "und" and f[2] >= narrow for f in found], pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *more], [*names, lang_col, score_col, accept_col])

    return rows.mapInArrow(run, schema)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_dictionaries(docs, ~held_out())
    found = identify_languages(docs.select("doc_id", "text", held_out().alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score", "accepted")
