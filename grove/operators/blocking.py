"""Regions without labels, exact keys, and TF-IDF retrieval: the candidate pairs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grove.operators.store import written

# The states' names and their postal codes.
US_STATES = {
    "alabama": "al", "alaska": "ak", "arizona": "az", "arkansas": "ar", "california": "ca", "colorado": "co", "connecticut": "ct", "delaware": "de", "florida": "fl", "georgia": "ga",
    "hawaii": "hi", "idaho": "id", "illinois": "il", "indiana": "in", "iowa": "ia", "kansas": "ks", "kentucky": "ky", "louisiana": "la", "maine": "me", "maryland": "md", "massachusetts": "ma",
    "michigan": "mi", "minnesota": "mn", "mississippi": "ms", "missouri": "mo", "montana": "mt", "nebraska": "ne", "nevada": "nv", "new hampshire": "nh", "new jersey": "nj",
    "new mexico": "nm", "new york": "ny", "north carolina": "nc", "north dakota": "nd", "ohio": "oh", "oklahoma": "ok", "oregon": "or", "pennsylvania": "pa",
    "rhode island": "ri", "south carolina": "sc", "south dakota": "sd", "tennessee": "tn", "texas": "tx", "utah": "ut", "vermont": "vt", "virginia": "va", "washington": "wa",
    "west virginia": "wv", "wisconsin": "wi", "wyoming": "wy", "district of columbia": "dc",
}
# Thresholds and address words without meaning.
MIN_COUNT, MIN_PURITY, EXPAND_COUNT, EXPAND_PURITY = 5, 0.98, 20, 0.95
ADDR_STOP = "door no unit flat plot suite apt block floor house hno shop office room building bldg near opp".split()
LOST_KEEP, LOST_MOST_DF = 5, 2000
CAP, MIN_NAME, W_NAME, W_ADDR, MAX_DF, MIN_S1_FOR_PRUNING, FLOOR = 20, 4, 0.6, 0.4, 0.05, 1000, 1e-6


def _top(df: DataFrame, by: list[str], order: list, n: int = 1) -> DataFrame:
    return df.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_rn") <= n).drop("_rn")


def aliases_from(pairs: DataFrame, min_count: int, min_purity: float) -> DataFrame:
    """country, part, state: parts that name one state often and purely enough. pairs: country, part, state."""
    n = pairs.groupBy("country", "part", "state").agg(F.count(F.lit(1)).alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy("country", "part"))
    return n.withColumn("share", share).where((F.col("n") >= min_count) & (F.col("share") >= min_purity)).select("country", "part", "state")


def s1_state(s1: DataFrame) -> DataFrame:
    """entity_id, state: the digit-free component that is most frequent in its country; ties to the later position."""
    parts = s1.select("entity_id", "country", F.posexplode("parts").alias("pos", "part")).where(~F.col("part").rlike("[0-9]"))
    freq = parts.join(parts.groupBy("country", "part").agg(F.count(F.lit(1)).alias("freq")), ["country", "part"])
    best = _top(freq, ["entity_id"], [F.desc("freq"), F.desc("pos")]).select("entity_id", F.col("part").alias("state"))
    return s1.select("entity_id").join(best, "entity_id", "left")


def us_states(spark: SparkSession) -> DataFrame:
    """country, part, state: the states' full names and their codes."""
    return spark.createDataFrame([("US", name, code) for name, code in US_STATES.items()], "country string, part string, state string")


def learn_aliases(s1: DataFrame, recs: DataFrame, min_count: int = MIN_COUNT, min_purity: float = MIN_PURITY, expand_count: int = EXPAND_COUNT, expand_purity: float = EXPAND_PURITY, codes: DataFrame | None = None) -> DataFrame:
    """country, part, state from the reference entities' states, then from records that name just one of these.

    codes: country, part, state rows that replace learned ones; the states' full names and codes if not given.
    """
    codes = us_states(s1.sparkSession) if codes is None else codes
    own = s1.select("entity_id", "country", F.explode("parts").alias("part")).join(s1_state(s1).where("state is not null"), "entity_id")
    first = aliases_from(own.select("country", "part", "state"), min_count, min_purity)
    parts = recs.select("entity_id", "country", F.explode("parts").alias("part"))
    known = parts.join(first, ["country", "part"], "left")
    sure = known.groupBy("entity_id").agg(F.collect_set("state").alias("s")).where(F.size("s") == 1).select("entity_id", F.col("s")[0].alias("vote"))
    votes = known.where("state is null").join(sure, "entity_id").select("country", "part", F.col("vote").alias("state"))
    out = first.unionByName(aliases_from(votes, expand_count, expand_purity).join(first, ["country", "part"], "left_anti"))
    return out.join(codes, ["country", "part"], "left_anti").unionByName(codes)


def infer_state(df: DataFrame, aliases: DataFrame) -> DataFrame:
    """entity_id, state by majority of the parts that are aliases; ties to the smaller state; null without any."""
    votes = df.select("entity_id", "country", F.explode("parts").alias("part")).join(aliases, ["country", "part"]).groupBy("entity_id", "state").agg(F.count(F.lit(1)).alias("n"))
    best = _top(votes, ["entity_id"], [F.desc("n"), "state"]).select("entity_id", "state")
    return df.select("entity_id").join(best, "entity_id", "left")


def with_keys(df: DataFrame, min_name: int = MIN_NAME) -> DataFrame:
    """entity_id, kind, key: the exact blocking keys of a normalised table, those that are defined.

    The street word is the first run of three letters or more, also inside a token of letters and digits. A name without
    words still makes a key with its house number."""
    sep = lambda *x: F.concat_ws("|", *x)
    streets = F.filter(F.regexp_extract_all("addr", F.lit("([a-z]{3,})"), 1), lambda w: ~w.isin(ADDR_STOP))
    street, first = F.get(streets, F.lit(0)), F.get(F.split("name_tok", " "), F.lit(0))
    kinds = {
        "v0": F.when(F.col("hn") != "", sep("country", "name_key", "hn")),
        "ns": F.when(F.length("name_ns") >= min_name, sep("country", "name_ns")),
        "hn_street": F.when((F.col("hn") != "") & street.isNotNull(), sep("country", "hn", street)),
        "name1_hn": F.when(F.col("hn") != "", sep("country", first, "hn")),
        "namekey": F.when(F.col("name_key") != "", sep("country", "name_key")),
    }
    each = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("key")) for k, v in kinds.items()])
    return df.select("entity_id", F.explode(each).alias("k")).select("entity_id", "k.kind", "k.key").where("key is not null")


def _capped(s1: DataFrame, cap: int) -> DataFrame:
    """s1, kind, key of the keys that at most cap entities have; popular keys are counted before their rows could meet."""
    ours = with_keys(s1)
    small = ours.groupBy("kind", "key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= cap)
    return ours.join(small.select("kind", "key"), ["kind", "key"], "left_semi").select(F.col("entity_id").alias("s1"), "kind", "key")


def key_candidates(s1: DataFrame, recs: DataFrame, cap: int = CAP) -> DataFrame:
    """s1, rec: pairs that share a key which at most cap reference entities have."""
    return _capped(s1, cap).join(with_keys(recs).withColumnRenamed("entity_id", "rec"), ["kind", "key"]).select("s1", "rec").distinct()


def key_sizes(s1: DataFrame, recs: DataFrame, cap: int = CAP) -> DataFrame:
    """kind, pairs, entities, records that each kind of key brings together."""
    return _capped(s1, cap).join(with_keys(recs).withColumnRenamed("entity_id", "rec"), ["kind", "key"]).groupBy("kind").agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("s1").alias("entities"), F.countDistinct("rec").alias("records"))


def rule_matches(s1: DataFrame, recs: DataFrame) -> DataFrame:
    """s1, rec: equal country, name key and house number, where these are unique among the reference entities."""
    keyed = lambda d: d.where("name_key <> '' and hn <> ''").select("entity_id", "country", "name_key", "hn")
    lone = keyed(s1).groupBy("country", "name_key", "hn").agg(F.min("entity_id").alias("s1"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    return lone.join(keyed(recs).withColumnRenamed("entity_id", "rec"), ["country", "name_key", "hn"]).select("s1", "rec")


def char_terms(text):
    """All 3-grams of the words, padded by one space on each side."""
    grams = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w) - 2)), lambda i: F.substr(w, i, F.lit(3)))
    return F.flatten(F.transform(F.filter(F.split(text, " "), lambda w: w != ""), lambda w: grams(F.concat(F.lit(" "), w, F.lit(" ")))))


def word_terms(text):
    """Words of two characters and more, and the pairs of neighbouring ones."""
    words = F.filter(F.split(text, " "), lambda w: F.length(w) >= 2)
    pairs = F.when(F.size(words) >= 2, F.zip_with(F.slice(words, 1, F.size(words) - 1), F.slice(words, 2, F.size(words) - 1), lambda a, b: F.concat(a, F.lit(" "), b))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, pairs)


def postings(df: DataFrame, view: str, part: list[str]) -> DataFrame:
    terms = char_terms(F.col("name_tok")) if view == "name" else word_terms(F.col("addr"))
    return df.select("entity_id", *part, F.explode(terms).alias("term")).groupBy("entity_id", *part, "term").agg((1 + F.log(F.count(F.lit(1)))).alias("tf"))


def text_classes(df: DataFrame, part: list[str], texts: list[str]) -> tuple[DataFrame, DataFrame]:
    """entity_id, kind of all entities; and one table that stands for df: entity_id (the kind), many, *part, *texts.

    Entities of equal rows are of one kind, so that copies are weighed and met once; many: how many a kind has."""
    own = written(df.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct(*part, *texts))).alias("rows")))
    kinds = written(own.groupBy("rows").agg(F.count(F.lit(1)).alias("many")).withColumn("kind", F.monotonically_increasing_id()))
    members = own.join(kinds.select("rows", "kind"), "rows").select("entity_id", "kind")
    return members, kinds.select(F.col("kind").alias("entity_id"), "many", F.inline("rows"))


def alike(weights: DataFrame, by: list[str]) -> DataFrame:
    """entity_id, kind: the smallest entity that has the same rows of by."""
    own = weights.groupBy("entity_id").agg(F.array_sort(F.collect_list(F.struct(*by))).alias("rows"))
    return own.join(own.groupBy("rows").agg(F.min("entity_id").alias("kind")), "rows").select("entity_id", "kind")


def _counted(df: DataFrame):
    """How many entities df's rows stand for."""
    return F.sum("many") if "many" in df.columns else F.count(F.lit(1))


def tfidf(s1: DataFrame, recs: DataFrame, view: str, part: list[str], max_df: float | None = None, min_s1: int = MIN_S1_FOR_PRUNING) -> tuple[DataFrame, DataFrame]:
    """Unit-length weights (entity_id, *part, term, w) of both sides, with a vocabulary of the reference entities of each part.

    max_df drops terms that more than this share of a part's reference entities have, in parts of min_s1 and more.
    s1 may be kinds of entities, with their number in many.
    """
    ours = postings(s1, view, [*part, *[c for c in s1.columns if c == "many"]])
    n = s1.groupBy(*part).agg(_counted(s1).alias("n"))
    df = ours.groupBy(*part, "term").agg(_counted(ours).alias("df")).join(n, part)
    if max_df is not None:
        df = df.where((F.col("n") < min_s1) | (F.col("df") <= max_df * F.col("n")))
    idf = df.select(*part, "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    unit = lambda p: p.join(idf, [*part, "term"]).withColumn("w", F.col("tf") * F.col("idf")).withColumn("w", F.col("w") / F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy("entity_id")))).select("entity_id", *part, "term", "w")
    return unit(ours), unit(postings(recs, view, part))


def cosines(ours: DataFrame, theirs: DataFrame, part: list[str]) -> DataFrame:
    """s1, rec, cos for all pairs that share a term in a part."""
    a, b = ours.withColumnRenamed("entity_id", "s1").withColumnRenamed("w", "wa"), theirs.withColumnRenamed("entity_id", "rec").withColumnRenamed("w", "wb")
    return a.join(b, [*part, "term"]).groupBy("s1", "rec").agg(F.sum(F.col("wa") * F.col("wb")).alias("cos")).where(F.col("cos") > FLOOR)


def top_cosines(s1: DataFrame, recs: DataFrame, view: str, part: list[str], k: int) -> DataFrame:
    """s1, rec, cos (six digits): each record's k best entities of its part under one view; ties to the smaller s1.

    Equal texts are summed and ranked once, under numbers; only a text's best, ties with the last of them included, get
    ids back, the k smallest of each.
    """
    text = ["name_tok" if view == "name" else "addr"]
    (named, a), (members, b) = text_classes(s1, part, text), text_classes(recs, part, text)
    ours, theirs = tfidf(a, b, view, part)
    short = lambda w, i, x: w.select(F.xxhash64(*part, "term").alias("t"), F.col("entity_id").alias(i), F.col("w").alias(x))
    met = short(ours, "i", "wa").join(short(theirs, "j", "wb"), "t")
    c = met.groupBy("i", "j").agg(F.sum(F.col("wa") * F.col("wb")).alias("raw")).where(F.col("raw") > FLOOR).select("i", "j", F.round("raw", 6).alias("cos"))
    best = c.withColumn("_r", F.rank().over(Window.partitionBy("j").orderBy(F.desc("cos")))).where(F.col("_r") <= k).drop("_r")
    few = _top(named, ["kind"], ["entity_id"], k).select(F.col("kind").alias("i"), F.col("entity_id").alias("s1"))
    top = _top(best.join(few, "i"), ["j"], [F.desc("cos"), "s1"], k)
    return top.join(members.select(F.col("kind").alias("j"), F.col("entity_id").alias("rec")), "j").select("s1", "rec", "cos")


def both_views(df: DataFrame, part: list[str]) -> DataFrame:
    """Postings of the name and of the address view."""
    return postings(df, "name", part).withColumn("view", F.lit("name")).unionByName(postings(df, "addr", part).withColumn("view", F.lit("addr")))


def vocabulary(ours: DataFrame, s1: DataFrame, part: list[str], max_df: float = MAX_DF, min_s1: int = MIN_S1_FOR_PRUNING, most: int | None = None) -> DataFrame:
    """*part, view, term, idf, kept of the reference entities' postings; kept: not in more than max_df of a part's entities
    (in parts of min_s1 and more) or, where it is given, not in more than `most` of them. Both may be of kinds with many."""
    n = s1.groupBy(*part).agg(_counted(s1).alias("n"))
    known = ours.groupBy(*part, "view", "term").agg(_counted(ours).alias("df")).join(n, part)
    kept = (F.col("n") < min_s1) | (F.col("df") <= max_df * F.col("n")) if most is None else F.col("df") <= most
    return known.select(*part, "view", "term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"), kept.alias("kept"))


def unit_weights(p: DataFrame, idf: DataFrame, part: list[str]) -> DataFrame:
    """entity_id, *part, view, term, tf, w, cut of postings under a vocabulary."""
    raw = p.join(idf, [*part, "view", "term"]).withColumn("x", F.col("tf") * F.col("idf")).withColumn("y", F.when(F.col("kept"), F.col("x")))
    over = Window.partitionBy("entity_id", *part, "view")
    return raw.select("entity_id", *part, "view", "term", "tf", (F.col("x") / F.sqrt(F.sum(F.col("x") * F.col("x")).over(over))).alias("w"), (F.col("y") / F.sqrt(F.sum(F.col("y") * F.col("y")).over(over))).alias("cut"))


def weighted(s1: DataFrame, recs: DataFrame, part: list[str], max_df: float = MAX_DF, min_s1: int = MIN_S1_FOR_PRUNING) -> tuple[DataFrame, DataFrame]:
    """entity_id, *part, view, term, tf, w, cut of both sides, over the name and the address view.

    w: unit-length weights over a part's whole vocabulary; cut: those over its vocabulary without the terms that more than
    max_df of its reference entities have (in parts of min_s1 and more), null for these terms. s1 may be kinds with many.
    """
    ours = both_views(s1, [*part, *[c for c in s1.columns if c == "many"]])
    idf = vocabulary(ours, s1, part, max_df, min_s1)
    return unit_weights(ours, idf, part), unit_weights(both_views(recs, part), idf, part)


def _summed(met: DataFrame, keys: list[str]) -> DataFrame:
    """cos_name, cos_addr, cos_comb by keys, from rows of view and product."""
    by = lambda v: F.coalesce(F.sum(F.when(F.col("view") == v, F.col("product"))), F.lit(0.0))
    return met.groupBy(*keys).agg(by("name").alias("cos_name"), by("addr").alias("cos_addr")).withColumn("cos_comb", W_NAME * F.col("cos_name") + W_ADDR * F.col("cos_addr"))


def pair_cosines(pairs: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """s1, rec, cos_name, cos_addr, cos_comb of just these pairs (s1, rec), over the whole vocabulary; pairs without a common
    term get zeros. ours, theirs: weighted postings; a pair's terms alone are looked up, never all pairs."""
    pairs = pairs.select("s1", "rec").distinct()
    part = [c for c in ours.columns if c not in ("entity_id", "view", "term", "tf", "w", "cut")]
    a = ours.select(F.col("entity_id").alias("s1"), *part, "view", "term", F.col("w").alias("wa"))
    b = theirs.select(F.col("entity_id").alias("rec"), *part, "view", "term", F.col("w").alias("wb"))
    met = pairs.join(a, "s1").join(b, ["rec", *part, "view", "term"]).select("s1", "rec", "view", (F.col("wa") * F.col("wb")).alias("product"))
    zeros = pairs.select("s1", "rec", F.lit("name").alias("view"), F.lit(0.0).alias("product"))
    return _summed(met.unionByName(zeros), ["s1", "rec"])


def retrieve(s1: DataFrame, recs: DataFrame, part: list[str], k_name: int = 10, k_comb: int = 20, k_addr: int = 10, keep: int | None = 5) -> DataFrame:
    """s1, rec, cos_name, cos_addr, cos_comb: the union of the best under three views, scored in full, keep of each record.

    Retrieval meets pairs over vocabularies without the most frequent terms, in one join and one sum for both views; only
    the chosen pairs are scored over the whole vocabulary. Entities of equal terms are weighed, met and scored once, as one
    kind. Ranks go by nine digits, ties to the smaller s1.
    """
    (named, a), (members, b) = (text_classes(x, part, ["name_tok", "addr"]) for x in (s1, recs))
    ours, theirs = (written(x) for x in weighted(a, b, part))
    whole = lambda w, names: _one_each(w, written(alike(w, [*part, "view", "term", "tf"])), names)
    (ours, named), (theirs, members) = whole(ours, named), whole(theirs, members)
    return nearest_pairs(ours, theirs, part, k_name, k_comb, k_addr, keep, named, members)


def _one_each(weights: DataFrame, kinds: DataFrame, names: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """The weights of kinds' smallest entities; entity_id, kind of names (entity_id and its earlier kind) under kinds."""
    lone = weights.join(kinds.where("entity_id = kind").select("entity_id"), "entity_id", "left_semi")
    return lone, kinds if names is None else names.join(kinds.select(F.col("entity_id").alias("kind"), F.col("kind").alias("_k")), "kind").select("entity_id", F.col("_k").alias("kind"))


def nearest_pairs(ours: DataFrame, theirs: DataFrame, part: list[str], k_name: int = 10, k_comb: int = 20, k_addr: int = 10, keep: int | None = 5, named: DataFrame | None = None, members: DataFrame | None = None) -> DataFrame:
    """retrieve over weights that are written already. named, members: entity_id, kind, if the weights are those of kinds of
    reference entities and of records.

    Those that agree in the terms that retrieval uses meet once; of each such group the smallest s1 stand for the rest, as
    many as could be chosen."""
    depth = {"cos_name": k_name, "cos_comb": k_comb, "cos_addr": k_addr}
    used = [*part, "view", "term", "tf"]
    sides = [(w := x.where("cut is not null"), written(alike(w, used))) for x in (ours, theirs)]
    (a, our_groups), (b, their_groups) = ((_one_each(w, g)[0], g) for w, g in sides)
    a = a.select(F.col("entity_id").alias("i"), *part, "view", "term", F.col("cut").alias("wa"))
    b = b.select(F.col("entity_id").alias("j"), *part, "view", "term", F.col("cut").alias("wb"))
    rough = _summed(a.join(b, [*part, "view", "term"]).select("i", "j", "view", (F.col("wa") * F.col("wb")).alias("product")), ["i", "j"])
    order = lambda v: F.desc(F.round(v, 9))
    near = rough.select("i", "j", *depth, *[F.rank().over(Window.partitionBy("j").orderBy(order(v))).alias(f"r_{v}") for v in depth])
    near = near.where(" or ".join(f"(r_{v} <= {k} and round({v}, 9) >= round({FLOOR}D, 9))" for v, k in depth.items())).select("i", "j", *depth)
    units = our_groups.select(F.col("entity_id").alias("unit"), F.col("kind").alias("i"))
    units = units.withColumn("s1", F.col("unit")) if named is None else units.join(named.select(F.col("kind").alias("unit"), F.col("entity_id").alias("s1")), "unit")
    met = near.join(_top(units, ["i"], ["s1"], max(depth.values())), "i")
    ranked = met.select("j", "s1", "unit", *depth, *[F.row_number().over(Window.partitionBy("j").orderBy(order(v), "s1")).alias(f"r_{v}") for v in depth])
    chosen = written(ranked.where(" or ".join(f"(r_{v} <= {k} and {v} > {FLOOR})" for v, k in depth.items())).select("j", "s1", "unit"))
    of = their_groups.select(F.col("entity_id").alias("rec"), F.col("kind").alias("j"))
    full = pair_cosines(chosen.select("j", F.col("unit").alias("s1")).distinct().join(of, "j"), ours, theirs).withColumnRenamed("s1", "unit")
    full = chosen.join(of, "j").join(full, ["unit", "rec"]).select("s1", "rec", "cos_name", "cos_addr", "cos_comb")
    full = full if keep is None else _top(full, ["rec"], [F.desc(F.round("cos_comb", 9)), "s1"], keep)
    return full if members is None else full.withColumnRenamed("rec", "kind").join(members.withColumnRenamed("entity_id", "rec"), "kind").select("s1", "rec", "cos_name", "cos_addr", "cos_comb")


def country_candidates(s1: DataFrame, recs: DataFrame, states: DataFrame, k: int = LOST_KEEP, most: int = LOST_MOST_DF) -> DataFrame:
    """s1, rec, cos_name, cos_addr, cos_comb: for records without a state, the k entities of their country with the nearest names.

    states: entity_id, state of the records. Terms of more than `most` entities take no part in the search, so that a
    record meets a bounded number of entities a term; the chosen pairs are scored over the whole vocabulary of both views.
    Ranks go by nine digits, ties to the smaller s1. Records of a country without entities find none.
    """
    part = ["country"]
    lost = recs.join(states.where("state is not null"), "entity_id", "left_anti")
    ours = both_views(s1, part)
    idf = vocabulary(ours, s1, part, most=most)
    ours, theirs = written(unit_weights(ours, idf, part)), written(unit_weights(both_views(lost, part), idf, part))
    names = lambda d, ids, w: d.where("view = 'name' and cut is not null").select(F.col("entity_id").alias(ids), *part, "term", F.col("cut").alias(w))
    met = names(ours, "s1", "wa").join(names(theirs, "rec", "wb"), [*part, "term"]).groupBy("s1", "rec").agg(F.sum(F.col("wa") * F.col("wb")).alias("cos"))
    chosen = _top(met.where(F.col("cos") > FLOOR), ["rec"], [F.desc(F.round("cos", 9)), "s1"], k)
    return pair_cosines(chosen, ours, theirs)
