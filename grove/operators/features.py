"""Features of candidate pairs, as joins and windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grove.functions import similarity as sim
from grove.functions.text import small_words

NAME = ["name_ratio", "name_tset", "name_partial", "name_jw", "ns_ratio", "addr_tset", "addr_partial", "hn_lev"]
COMP = ["rev_is_best_cos", "rev_margin_cos", "rev_rel_cos", "rev_rel_name", "ctx_rel_cos", "ctx_gap_cos", "ctx_rel_name", "ctx_rel_addr", "ctx_is_best_cos"]
DIFF = ["n_tok_extra", "n_tok_miss", "hn_delta", "hn_absdelta", "hn_substr"]
GEN = ["n_extra_generic", "n_extra_rare", "n_miss_generic", "n_miss_rare", "core_eq", "core_tset"]
CONTEXT = ["rank_fz", "rev_rank_fz", "gap_fz", "n_cand_rec", "n_cand_s1", "margin_fz"]
#: The normalised columns that a pair's own features are made of.
TEXTS = ["name_tok", "name_ns", "name_key", "addr", "hn", "nums", "nonlatin", "empty_addr"]
GENERIC_SHARE = 0.001
#: Reference names from which on a word is a real one, and words of a pair that are aligned. Fixed values.
REAL_DF, ALIGNED = 2, 4


def clip(x: Column, lo: float, hi: float) -> Column:
    return F.when(x.isNotNull(), F.greatest(F.least(x, F.lit(hi)), F.lit(lo)))


def sides(pairs: DataFrame, s1: DataFrame, recs: DataFrame, columns: list[str]) -> DataFrame:
    """pairs with the columns of both sides, suffixed _1 and _2."""
    a = s1.select(F.col("entity_id").alias("s1"), *[F.col(c).alias(f"{c}_1") for c in columns])
    b = recs.select(F.col("entity_id").alias("rec"), *[F.col(c).alias(f"{c}_2") for c in columns])
    return pairs.join(a, "s1").join(b, "rec")


def pair_features(pairs: DataFrame, s1: DataFrame, recs: DataFrame) -> DataFrame:
    """s1, rec and the pair's own features, with the ranks of its score among the record's and the entity's candidates."""
    return context_windows(pair_scores(pairs, s1, recs))


def pair_scores(pairs: DataFrame, s1: DataFrame, recs: DataFrame) -> DataFrame:
    """pairs with the similarities of their texts and fz, the score of name and address. But for src3, texts alone decide."""
    d = sides(pairs, s1, recs, TEXTS)
    both = lambda f, c: f(F.col(f"{c}_1"), F.col(f"{c}_2"))
    shared, union = F.size(F.array_intersect("nums_1", "nums_2")), F.size(F.array_union("nums_1", "nums_2"))
    d = d.select(
        "s1", "rec", *[c for c in pairs.columns if c not in ("s1", "rec")],
        both(sim.ratio, "name_tok").alias("name_ratio"), both(sim.token_set, "name_tok").alias("name_tset"), both(sim.partial_ratio, "name_tok").alias("name_partial"),
        both(sim.jaro_winkler, "name_tok").alias("name_jw"), both(sim.ratio, "name_ns").alias("ns_ratio"), both(sim.token_set, "addr").alias("addr_tset"), both(sim.partial_ratio, "addr").alias("addr_partial"),
        F.levenshtein("hn_1", "hn_2").cast("double").alias("hn_lev"), *[(F.col(f"{c}_1") == F.col(f"{c}_2")).cast("double").alias(n) for c, n in (("name_key", "namekey_eq"), ("name_ns", "ns_eq"), ("hn", "hn_eq"))],
        (F.col("hn_2") == "").cast("double").alias("hn_missing_rec"), (F.col("hn_1") == "").cast("double").alias("hn_missing_s1"), (F.startswith("hn_1", "hn_2") | F.startswith("hn_2", "hn_1")).cast("double").alias("hn_prefix"),
        shared.cast("double").alias("nums_shared"), F.try_divide(shared, union).alias("nums_jac"), F.size(F.array_except("nums_2", "nums_1")).cast("double").alias("nums_extra_rec"), F.size(F.array_except("nums_1", "nums_2")).cast("double").alias("nums_missing_rec"),
        F.startswith("rec", F.lit("S3")).cast("double").alias("src3"), F.col("nonlatin_2").cast("double").alias("nonlatin"), F.col("empty_addr_2").cast("double").alias("empty_addr"),
        F.length("name_tok_2").cast("double").alias("len_name_rec"), F.length("name_tok_1").cast("double").alias("len_name_s1"),
    )
    return d.withColumn("fz", (0.6 * F.col("name_tset") + 0.4 * F.col("addr_tset")).cast("float").cast("double"))


def context_windows(d: DataFrame) -> DataFrame:
    """Ranks, gaps and counts of fz among a record's and an entity's candidates; ties by s1, then rec."""
    return context_by_entity(context_by_record(d)).select(*d.columns, *CONTEXT)


def context_by_record(d: DataFrame) -> DataFrame:
    rec = Window.partitionBy("rec")
    d = d.withColumn("rank_fz", F.row_number().over(rec.orderBy(F.desc("fz"), "s1"))).withColumn("gap_fz", F.max("fz").over(rec) - F.col("fz")).withColumn("n_cand_rec", F.count(F.lit(1)).over(rec))
    second = F.max(F.when(F.col("rank_fz") == 2, F.col("fz"))).over(rec)
    return d.withColumn("margin_fz", F.coalesce(F.col("fz") - second, F.lit(100.0)))


def context_by_entity(d: DataFrame) -> DataFrame:
    s1 = Window.partitionBy("s1")
    return d.withColumn("rev_rank_fz", F.row_number().over(s1.orderBy(F.desc("fz"), "rec"))).withColumn("n_cand_s1", F.count(F.lit(1)).over(s1))


def competition_features(pairs: DataFrame) -> DataFrame:
    """pairs (s1, rec, cos_name, cos_addr, cos_comb) with how each compares to its rivals; missing cosines count as 0."""
    return competition_by_entity(competition_by_record(pairs)).select(*pairs.columns, *COMP)


def _cosine(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit(0.0))


def _least(x: Column) -> Column:
    return F.greatest(x, F.lit(1e-6))


def competition_by_record(pairs: DataFrame) -> DataFrame:
    rec = Window.partitionBy("rec")
    d = pairs.withColumn("_c", _cosine("cos_comb")).withColumn("_rn", F.row_number().over(rec.orderBy(F.desc("_c"), "s1")))
    best = F.max("_c").over(rec)
    second = F.coalesce(F.max(F.when(F.col("_rn") == 2, F.col("_c"))).over(rec), F.lit(0.0))
    out = {
        "rev_is_best_cos": (F.col("_c") >= best).cast("int"), "rev_margin_cos": F.when(F.col("_c") >= best, F.col("_c") - second).otherwise(F.col("_c") - best),
        "rev_rel_cos": F.col("_c") / _least(best), "rev_rel_name": _cosine("cos_name") / _least(F.max(_cosine("cos_name")).over(rec)),
    }
    return d.select(*pairs.columns, *[v.alias(k) for k, v in out.items()])


def competition_by_entity(pairs: DataFrame) -> DataFrame:
    s1, c = Window.partitionBy("s1"), _cosine("cos_comb")
    top = F.max(c).over(s1)
    of_best = lambda x: _cosine(x) / _least(F.max(_cosine(x)).over(s1))
    out = {"ctx_rel_cos": c / _least(top), "ctx_gap_cos": top - c, "ctx_rel_name": of_best("cos_name"), "ctx_rel_addr": of_best("cos_addr"), "ctx_is_best_cos": (c >= top).cast("int")}
    return pairs.select(*pairs.columns, *[v.alias(k) for k, v in out.items()])


def maxima(pairs: DataFrame) -> DataFrame:
    """s1, s_best, s_best_n, s_best_a: the highest cosines of each entity's pairs; missing ones count as 0."""
    top = lambda c, name: F.max(F.coalesce(F.col(c), F.lit(0.0))).alias(name)
    return pairs.groupBy("s1").agg(top("cos_comb", "s_best"), top("cos_name", "s_best_n"), top("cos_addr", "s_best_a"))


def competition_against(pairs: DataFrame, best: DataFrame) -> DataFrame:
    """competition_features with the entities' maxima taken from best (s1, s_best, s_best_n, s_best_a), which may cover more
    pairs than these; an entity that is not in it competes with nobody (0)."""
    z = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    floor = lambda c: F.greatest(z(c), F.lit(1e-6))
    d = competition_features(pairs).join(best, "s1", "left")
    out = {"ctx_rel_cos": z("cos_comb") / floor("s_best"), "ctx_gap_cos": z("s_best") - z("cos_comb"), "ctx_rel_name": z("cos_name") / floor("s_best_n"), "ctx_rel_addr": z("cos_addr") / floor("s_best_a"), "ctx_is_best_cos": (z("cos_comb") >= z("s_best")).cast("int")}
    return d.withColumns(out).select(*pairs.columns, *COMP)


def key_masked(featured: DataFrame) -> DataFrame:
    """featured with the record-side competition blank where only keys found the pair (cos_comb is null)."""
    return featured.withColumns({c: F.when(F.col("cos_comb").isNotNull(), F.col(c)) for c in COMP if c.startswith("rev_")})


def mapped_features(pairs: DataFrame, s1: DataFrame, mapped: DataFrame, recs: DataFrame) -> DataFrame:
    """tr_ratio, tr_tset, tr_partial, tr_jw: the entity's name against the record's with the learned token map applied
    (entity_id, mapped); null but for records in other scripts."""
    b = recs.select("entity_id", "nonlatin").join(mapped, "entity_id").select("entity_id", F.when(F.col("nonlatin"), F.col("mapped")).alias("tr"))
    d = sides(pairs, s1.select("entity_id", F.col("name_tok").alias("tr")), b, ["tr"])
    known = F.col("tr_2").isNotNull()
    score = lambda f: F.when(known, f(F.col("tr_1"), F.coalesce("tr_2", F.lit(""))))
    return d.select(*pairs.columns, score(sim.ratio).alias("tr_ratio"), score(sim.token_set).alias("tr_tset"), score(sim.partial_ratio).alias("tr_partial"), score(sim.jaro_winkler).alias("tr_jw"))


def diff_features(pairs: DataFrame, s1: DataFrame, recs: DataFrame) -> DataFrame:
    """Token and house-number differences; numbers of more than nine digits count with their first nine."""
    d = sides(pairs, s1, recs, ["name_tok", "hn"])
    a, b = F.split("name_tok_1", " "), F.split("name_tok_2", " ")
    number = lambda c: F.expr(f"try_cast(substr({c}, 1, 9) as bigint)")
    delta = number("hn_2") - number("hn_1")
    sub = F.when((F.col("hn_1") != "") & (F.col("hn_2") != ""), (F.contains("hn_1", "hn_2") | F.contains("hn_2", "hn_1")).cast("int"))
    return d.select(*pairs.columns, F.size(F.array_except(b, a)).alias("n_tok_extra"), F.size(F.array_except(a, b)).alias("n_tok_miss"), clip(delta, -10000, 10000).cast("long").alias("hn_delta"), clip(F.abs(delta), 0, 10000).cast("long").alias("hn_absdelta"), sub.alias("hn_substr"))


def generic_tokens(s1: DataFrame, share: float = GENERIC_SHARE) -> DataFrame:
    """country, tok: tokens in at least this share of a country's reference names."""
    n = s1.groupBy("country").agg(F.count(F.lit(1)).alias("n"))
    toks = s1.select("country", F.explode(F.array_distinct(F.filter(F.split("name_tok", " "), lambda w: w != ""))).alias("tok"))
    return toks.groupBy("country", "tok").agg(F.count(F.lit(1)).alias("df")).join(n, "country").where(F.col("df") >= share * F.col("n")).select("country", "tok")


def generic_features(pairs: DataFrame, s1: DataFrame, recs: DataFrame, generic: DataFrame) -> DataFrame:
    """How many extra and missing tokens are generic words of the entity's country and how many are not; whether the rare ones agree.

    Generic words are found by (country, word) once for each name and country, never as a vocabulary on every pair. A record
    is judged with its entity's country. pairs: s1, rec, once each."""
    toks = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    d = sides(pairs, s1, recs, ["name_tok", "country"]).withColumn("a", toks("name_tok_1")).withColumn("b", toks("name_tok_2"))
    names = d.select(F.col("country_1").alias("country"), F.explode(F.array("name_tok_1", "name_tok_2")).alias("name")).distinct()
    words = names.select("country", "name", F.explode(toks("name")).alias("tok")).join(generic, ["country", "tok"]).groupBy("country", "name").agg(F.collect_set("tok").alias("g"))
    side = lambda n: words.select(F.col("country").alias("country_1"), F.col("name").alias(f"name_tok_{n}"), F.col("g").alias(f"g{n}"))
    none = F.array().cast("array<string>")
    d = d.join(side(1), ["country_1", "name_tok_1"], "left").join(side(2), ["country_1", "name_tok_2"], "left").withColumn("g", F.array_union(F.coalesce("g1", none), F.coalesce("g2", none)))
    extra, miss = F.array_except("b", "a"), F.array_except("a", "b")
    count = lambda x, generic: F.size(F.array_intersect(x, "g") if generic else F.array_except(x, "g"))
    core = lambda c: F.array_sort(F.array_except(c, "g"))
    return d.select(*pairs.columns, count(extra, True).alias("n_extra_generic"), count(extra, False).alias("n_extra_rare"), count(miss, True).alias("n_miss_generic"), count(miss, False).alias("n_miss_rare"), (core("a") == core("b")).cast("int").alias("core_eq"), sim.token_set(F.array_join(core("a"), " "), F.array_join(core("b"), " ")).alias("core_tset"))


def legal_features(pairs: DataFrame, forms1: DataFrame, forms2: DataFrame) -> DataFrame:
    """lf_equal, lf_diff, lf_one_side from (entity_id, legal) of both sides."""
    d = sides(pairs, forms1, forms2, ["legal"])
    a, b = F.col("legal_1") != "", F.col("legal_2") != ""
    same = F.col("legal_1") == F.col("legal_2")
    return d.select(*pairs.columns, (a & b & same).cast("int").alias("lf_equal"), (a & b & ~same).cast("int").alias("lf_diff"), (a != b).cast("int").alias("lf_one_side"))


def raw_features(pairs: DataFrame, raw1: DataFrame, raw2: DataFrame) -> DataFrame:
    """How raw names differ, from (entity_id, raw) of both sides."""
    d = sides(pairs, raw1, raw2, ["raw"])
    a, b = small_words(F.col("raw_1")), small_words(F.col("raw_2"))
    return d.select(*pairs.columns, sim.ratio("raw_1", "raw_2").alias("raw_ratio"), sim.token_sort("raw_1", "raw_2").alias("raw_tsort"), (F.col("raw_1") == F.col("raw_2")).cast("int").alias("raw_eq"), (F.size(F.array_except(a, b)) + F.size(F.array_except(b, a))).alias("raw_small_diff"))


def canonical_features(pairs: DataFrame, canon1: DataFrame, canon2: DataFrame) -> DataFrame:
    """ca_tset, ca_sort, ca_jacc of canonical addresses, from (entity_id, canon) of both sides; empty ones have no words."""
    d = sides(pairs, canon1, canon2, ["canon"])
    words = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    a, b = words("canon_1"), words("canon_2")
    jaccard = F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1))
    return d.select(*pairs.columns, sim.token_set("canon_1", "canon_2").alias("ca_tset"), sim.token_sort("canon_1", "canon_2").alias("ca_sort"), jaccard.alias("ca_jacc"))


def token_df(s1: DataFrame) -> DataFrame:
    """country, tok, df: in how many of a country's reference names a token stands."""
    return s1.select("country", F.explode(F.array_distinct(F.filter(F.split("name_tok", " "), lambda w: w != ""))).alias("tok")).groupBy("country", "tok").agg(F.count(F.lit(1)).alias("df"))


def vocab_features(pairs: DataFrame, s1: DataFrame, recs: DataFrame, df: DataFrame, generic: DataFrame) -> DataFrame:
    """Whether a record's extra words are words of the entity's country or seen nowhere, and how well missing ones explain them.

    pairs: s1, rec, once each. Of each pair the first ALIGNED extra and missing words count. tok_align: the best similarity
    of an extra with a missing word; vocab_align: the worst such best among real words. -1: nothing to align;
    vocab_align 0: a real word was added and none is missing.
    """
    toks = lambda c: F.array_distinct(F.filter(F.split(c, " "), lambda w: w != ""))
    d = sides(pairs.select("s1", "rec"), s1, recs, ["name_tok"]).join(s1.select(F.col("entity_id").alias("s1"), "country"), "s1")
    a, b = toks("name_tok_1"), toks("name_tok_2")
    d = d.select("s1", "rec", "country", F.slice(F.array_except(b, a), 1, ALIGNED).alias("extra"), F.slice(F.array_except(a, b), 1, ALIGNED).alias("miss"))
    each = d.select("s1", "rec", "country", "miss", F.explode("extra").alias("tok")).join(df, ["country", "tok"], "left").join(generic.withColumn("g", F.lit(True)), ["country", "tok"], "left")
    n = F.coalesce("df", F.lit(0))
    each = each.withColumn("voc", F.isnull("g") & (n >= REAL_DF)).withColumn("unseen", n < REAL_DF)
    best = each.select("s1", "rec", "tok", "voc", "unseen", F.explode_outer("miss").alias("m")).withColumn("r", F.when(F.col("m").isNotNull(), sim.ratio(F.col("tok"), F.col("m")))).groupBy("s1", "rec", "tok", "voc", "unseen").agg(F.max("r").alias("r"))
    per = best.groupBy("s1", "rec").agg(F.sum(F.col("voc").cast("int")).alias("n_extra_vocab"), F.sum(F.col("unseen").cast("int")).alias("n_extra_unseen"), F.max("r").alias("tok_align"), F.min(F.when(F.col("voc"), F.col("r"))).alias("vocab_align"))
    out = pairs.join(per, ["s1", "rec"], "left")
    real = F.when((F.col("n_extra_vocab") > 0) & F.isnull("vocab_align"), F.lit(0.0)).otherwise(F.coalesce("vocab_align", F.lit(-1.0)))
    return out.select(*pairs.columns, F.coalesce("n_extra_vocab", F.lit(0)).alias("n_extra_vocab"), F.coalesce("n_extra_unseen", F.lit(0)).alias("n_extra_unseen"), F.coalesce("tok_align", F.lit(-1.0)).alias("tok_align"), real.alias("vocab_align"))
