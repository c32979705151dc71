"""The registered queries over the driver's tables, with their SQL.

Entities, scores and truth are derived from the tables by the recipes below, stated once for each engine.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from grove.functions import address, similarity
from grove.functions.text import NOISE, learn_token_map, legal_form, normalize, raw_name
from grove.operators import blocking, collective, decisions, features
from grove.plans import resolve as plan
from grove.sources import records


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def ents(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part")
    pick = lambda *x: F.element_at(F.array(*map(F.lit, x)), (F.col("p_partkey") % len(x) + 1).cast("int"))
    letter = F.element_at(F.array(*map(F.lit, "ABCDE")), (F.floor(F.col("p_partkey") / 7) % 5 + 1).cast("int"))
    return p.select(
        F.concat(pick("S1-", "S2-", "S3-"), F.col("p_partkey").cast("string")).alias("entity_id"), F.concat("p_name", F.lit(" "), pick("Inc.", "LLC", "", "", "")).alias("business_name"),
        F.concat(F.col("p_size").cast("string"), F.lit(" "), "p_name", F.lit(" St, "), "p_type", F.lit(", state "), letter).alias("business_address"), F.when(F.col("p_size") <= 25, "US").otherwise("India").alias("country"),
    )


def sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    e = normalize(ents(spark, d))
    return e.where(F.col("entity_id").startswith("S1-")), e.where(~F.col("entity_id").startswith("S1-"))


def scored(spark: SparkSession, d: str) -> DataFrame:
    rec = F.concat(F.when(F.col("l_orderkey") % 2 == 1, "S3-").otherwise("S2-"), F.col("l_orderkey").cast("string"))
    return table(spark, d, "lineitem").groupBy(F.concat(F.lit("S1-"), F.col("l_partkey").cast("string")).alias("s1"), rec.alias("rec")).agg((F.avg("l_quantity") / 51).alias("p"), F.avg("l_discount").alias("x"), F.avg("l_tax").alias("y"))


def truth(spark: SparkSession, d: str) -> DataFrame:
    rec = F.concat(F.when(F.col("l_orderkey") % 2 == 1, "S3-").otherwise("S2-"), F.col("l_orderkey").cast("string"))
    return table(spark, d, "lineitem").where("l_orderkey % 3 <> 0").groupBy(rec.alias("rec")).agg(F.min("l_partkey").alias("k")).select(F.concat(F.lit("S1-"), F.col("k").cast("string")).alias("s1"), "rec")


def all_s1(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.concat(F.lit("S1-"), F.col("p_partkey").cast("string")).alias("s1"))


ENTS = """ents AS (SELECT ['S1-','S2-','S3-'][CAST(p_partkey % 3 + 1 AS INT)] || p_partkey AS entity_id, p_name || ' ' || ['Inc.','LLC','','',''][CAST(p_partkey % 5 + 1 AS INT)] AS business_name,
  p_size || ' ' || p_name || ' St, ' || p_type || ', state ' || ['A','B','C','D','E'][CAST((p_partkey // 7) % 5 + 1 AS INT)] AS business_address, CASE WHEN p_size <= 25 THEN 'US' ELSE 'India' END AS country FROM part)"""
LISTED = str(NOISE)
CLEAN = "trim(regexp_replace(replace(lower({}), '.', ''), '[^a-z0-9]+', ' ', 'g'))"
NORM = f"""{ENTS},
n0 AS (SELECT *, list_transform(regexp_extract_all(business_address, '[0-9]+'), lambda x: coalesce(nullif(ltrim(x, '0'), ''), '0')) AS ns, list_filter(string_split({CLEAN.format('business_name')}, ' '), lambda w: w <> '' AND NOT list_contains({LISTED}, w)) AS toks, {CLEAN.format('business_address')} AS addr,
  list_filter(list_transform(string_split(business_address, ','), lambda p: {CLEAN.format('p')}), lambda p: p <> '') AS parts, regexp_extract(business_address, '([0-9]+)', 1) AS hn0 FROM ents),
norm AS (SELECT entity_id, country, array_to_string(list_filter(ns, lambda x, i: list_position(ns, x) = i), ';') AS nums, regexp_matches(business_name || ' ' || business_address, '[^\\x00-\\x{{24F}}]') AS nonlatin, trim(business_address) = '' AS empty_addr, array_to_string(toks, ' ') AS name_tok, addr, parts, array_to_string(list_sort(list_distinct(toks)), ' ') AS name_key, array_to_string(toks, '') AS name_ns,
  CASE WHEN hn0 = '' THEN '' ELSE coalesce(nullif(ltrim(hn0, '0'), ''), '0') END AS hn FROM n0),
s1n AS (SELECT * FROM norm WHERE starts_with(entity_id, 'S1-')), recn AS (SELECT * FROM norm WHERE NOT starts_with(entity_id, 'S1-'))"""
KEYS = f"""keys AS (SELECT entity_id, unnest(['v0','ns','hn_street','name1_hn','namekey']) AS kind, unnest([CASE WHEN hn <> '' THEN country||'|'||name_key||'|'||hn END, CASE WHEN len(name_ns) >= 4 THEN country||'|'||name_ns END,
  CASE WHEN hn <> '' AND street IS NOT NULL THEN country||'|'||hn||'|'||street END, CASE WHEN hn <> '' THEN country||'|'||string_split(name_tok,' ')[1]||'|'||hn END, CASE WHEN name_key <> '' THEN country||'|'||name_key END]) AS key
  FROM (SELECT *, list_filter(regexp_extract_all(addr, '[a-z]{{3,}}'), lambda w: NOT list_contains({blocking.ADDR_STOP}, w))[1] AS street FROM norm)),
k AS (SELECT * FROM keys WHERE key IS NOT NULL)"""
SCORED = """scored AS (SELECT 'S1-'||l_partkey AS s1, CASE WHEN l_orderkey % 2 = 1 THEN 'S3-' ELSE 'S2-' END||l_orderkey AS rec, avg(l_quantity)/51 AS p, avg(l_discount) AS x, avg(l_tax) AS y FROM lineitem GROUP BY ALL),
truth AS (SELECT 'S1-'||min(l_partkey) AS s1, CASE WHEN l_orderkey % 2 = 1 THEN 'S3-' ELSE 'S2-' END||l_orderkey AS rec FROM lineitem WHERE l_orderkey % 3 <> 0 GROUP BY l_orderkey),
ids AS (SELECT 'S1-'||p_partkey AS s1 FROM part)"""
EXCL = "excl AS (SELECT s1, rec, p FROM scored QUALIFY row_number() OVER (PARTITION BY rec ORDER BY p DESC, s1) = 1)"
FDEC = f"""{EXCL}, f1 AS (SELECT *, row_number() OVER o AS k, sum(p) OVER (PARTITION BY s1 ORDER BY p DESC, rec ROWS UNBOUNDED PRECEDING) AS pk, sum(p) OVER (PARTITION BY s1) AS e FROM excl WHERE p >= 0.05 WINDOW o AS (PARTITION BY s1 ORDER BY p DESC, rec)),
f2 AS (SELECT *, round(1.25*pk/(k+0.25*(e+0.15)), 9) AS ef, exp(sum(ln(1-least(p,1-1e-9))) OVER (PARTITION BY s1)) AS ef0 FROM f1),
f3 AS (SELECT *, max(ef) OVER (PARTITION BY s1) AS best FROM f2), fdec AS (SELECT s1, rec, p FROM (SELECT *, min(CASE WHEN ef = best THEN k END) OVER (PARTITION BY s1) AS stop FROM f3) WHERE best > ef0 AND k <= stop)"""
PER = """per AS (SELECT i.s1, coalesce(t.n,0) AS n_true, coalesce(q.n,0) AS n_pred, coalesce(h.n,0) AS tp FROM ids i LEFT JOIN (SELECT s1,count(*) n FROM truth GROUP BY 1) t USING (s1) LEFT JOIN (SELECT s1,count(*) n FROM excl GROUP BY 1) q USING (s1)
  LEFT JOIN (SELECT s1,count(*) n FROM excl JOIN truth USING (s1,rec) GROUP BY 1) h USING (s1)), perf AS (SELECT *, CASE WHEN n_true=0 THEN CASE WHEN n_pred=0 THEN 1.0 ELSE 0.0 END ELSE 1.25*tp/(n_pred+0.25*n_true) END::DOUBLE AS f05 FROM per)"""
GRID = [round(0.05 * i, 2) for i in range(1, 20)]


def _rounded(df: DataFrame, *cols: str, n: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, n) for c in cols})


def norm_fields(s, d):
    return normalize(ents(s, d)).select("entity_id", "name_tok", "name_key", "name_ns", "addr", "hn", F.array_join("parts", ";").alias("parts"), F.array_join("nums", ";").alias("nums"), "nonlatin", "empty_addr")


def rule_matches(s, d):
    return blocking.rule_matches(*sides(s, d))


def key_candidates(s, d):
    return blocking.key_candidates(*sides(s, d))


def aliases(s, d):
    a, _ = sides(s, d)
    parts = a.select("entity_id", "country", F.explode("parts").alias("part")).join(blocking.s1_state(a), "entity_id")
    return blocking.aliases_from(parts.select("country", "part", "state"), 2, 0.6)


def s1_state(s, d):
    return blocking.s1_state(sides(s, d)[0])


def infer_state(s, d):
    return blocking.infer_state(sides(s, d)[1], aliases(s, d))


def tfidf_name_topk(s, d):
    return blocking.top_cosines(*sides(s, d), "name", ["country"], 3)


def tfidf_candidates(s, d):
    return _rounded(blocking.retrieve(*sides(s, d), ["country"]), "cos_name", "cos_addr", "cos_comb")


def pair_features(s, d):
    a, b = sides(s, d)
    return features.pair_features(blocking.key_candidates(a, b), a, b)


def competition_features(s, d):
    c = scored(s, d).select("s1", "rec", F.col("x").alias("cos_name"), F.col("y").alias("cos_addr"), F.round("p", 6).alias("cos_comb"))
    return _rounded(features.competition_features(c), "cos_name", "cos_addr", *[c for c in features.COMP if "best" not in c])


def diff_features(s, d):
    a, b = sides(s, d)
    return features.diff_features(blocking.key_candidates(a, b), a, b)


def generic_features(s, d):
    a, b = sides(s, d)
    return features.generic_features(blocking.key_candidates(a, b), a, b, features.generic_tokens(a, 0.05)).drop("core_tset")


def string_distances(s, d):
    n = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return n.select("s_suppkey", F.levenshtein("s_name", "n_name").cast("long").alias("lev"), F.round(similarity.jaro_winkler("s_name", "n_name"), 6).alias("jw"))


def string_ratios(s, d):
    n = table(s, d, "supplier").join(table(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return n.select("s_suppkey", *[f("s_name", "n_name").alias(k) for k, f in (("ratio", similarity.ratio), ("partial", similarity.partial_ratio), ("token_set", similarity.token_set), ("token_sort", similarity.token_sort))])


def twin_components(s, d):
    return collective.components(collective.twin_edges(sides(s, d)[1]))


def collective_features(s, d):
    p1 = scored(s, d).select("s1", "rec", F.round("p", 6).alias("p1"))
    orders = table(s, d, "orders").select(F.concat(F.when(F.col("o_orderkey") % 2 == 1, "S3-").otherwise("S2-"), F.col("o_orderkey").cast("string")).alias("entity_id"), F.concat(F.lit("C"), (F.col("o_orderkey") % 1000).cast("string")).alias("comp"))
    return _rounded(collective.collective(p1, orders), "p1_sum_rec", "p1_margin_rec", "best_other_p1_s1", "twins_best_p1_same")


def exclusive(s, d):
    return decisions.exclusive(scored(s, d).select("s1", "rec", "p"))


def expected_f_decode(s, d):
    return decisions.decode(scored(s, d).select("s1", "rec", "p"))


def threshold_decode(s, d):
    return exclusive(s, d).where("p >= 0.7")


def eval_per_entity(s, d):
    return decisions.per_entity(exclusive(s, d), truth(s, d), all_s1(s, d))


def eval_summary(s, d):
    return _rounded(decisions.summary(eval_per_entity(s, d)), "f05", "precision", "recall", "singleton_share", "singleton_accuracy", "exact_share", "f1")


def candidate_metrics(s, d):
    n = table(s, d, "orders").count()
    return _rounded(decisions.candidate_metrics(scored(s, d), truth(s, d), all_s1(s, d), n), "recall", "oracle_f05", "cand_per_s1", "reduction")


def threshold_curve(s, d):
    return _rounded(decisions.threshold_curve(s, exclusive(s, d), truth(s, d), all_s1(s, d), GRID), "f05")


def id_lists(s, d):
    return records.id_lists(all_s1(s, d), truth(s, d))


def truth_explode(s, d):
    return records.truth_pairs(id_lists(s, d), keep_singletons=True)


def source_stats(s, d):
    e = ents(s, d)
    src = lambda n: e.where(F.col("entity_id").startswith(f"S{n}-"))
    return records.Dataset.from_frames(src(1), src(2), src(3)).stats()


def validation_issues(s, d):
    e = ents(s, d)
    lists, candidates = records.result_tables(all_s1(s, d), truth(s, d), truth(s, d))
    return records.validate(lists.where("source1_entity_id <> 'S1-3'"), candidates, e.where(F.col("entity_id").startswith("S1-")), e.where(~F.col("entity_id").startswith("S1-")))


def vote_patterns(s, d):
    mask = sum(F.when(F.col(c) > v, F.lit(1 << i)).otherwise(F.lit(0)) for i, (c, v) in enumerate((("l_quantity", 25), ("l_discount", 0.05), ("l_tax", 0.04))))
    n = table(s, d, "lineitem").select(mask.alias("mask"), (F.col("l_returnflag") == "R").cast("int").alias("hit")).groupBy("mask").agg(F.count(F.lit(1)).alias("n"), F.sum("hit").alias("tp"))
    prior = n.agg((F.sum("tp") / F.sum("n")).alias("prior"))
    return n.crossJoin(F.broadcast(prior)).select("mask", "n", "tp", F.bit_count("mask").alias("votes"), F.round((F.col("tp") + 10 * F.col("prior")) / (F.col("n") + 10), 6).alias("rate"))


def null_safe_join(s, d):
    part = table(s, d, "part").select(F.nullif("p_brand", F.lit("Brand#1")).alias("brand"), "p_size")
    n = part.groupBy("brand").agg(F.count(F.lit(1)).alias("n"))
    m = part.where("p_size > 25").groupBy(F.col("brand").alias("b")).agg(F.count(F.lit(1)).alias("large"))
    return n.join(m, F.col("brand").eqNullSafe(F.col("b"))).select("brand", "n", "large")


def semi_anti(s, d):
    c, o = table(s, d, "customer"), table(s, d, "orders").where("o_totalprice > 300000")
    with_, without = (c.join(o, c.c_custkey == o.o_custkey, how) for how in ("left_semi", "left_anti"))
    return with_.select("c_custkey", F.lit("large").alias("kind")).unionByName(without.select("c_custkey", F.lit("small").alias("kind")))


def top_per_group(s, d):
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return table(s, d, "orders").withColumn("rank", F.row_number().over(w)).where("rank <= 2").select("o_custkey", "rank", "o_orderkey", "o_totalprice")


def page(s, d):
    return table(s, d, "customer").where(F.lower("c_mktsegment").contains("build")).orderBy("c_name", "c_custkey").offset(20).limit(15).select("c_custkey", "c_name")


def resolve(s, d):
    e = ents(s, d)
    s1, recs = e.where(F.col("entity_id").startswith("S1-")), e.where(~F.col("entity_id").startswith("S1-"))
    known = blocking.rule_matches(normalize(s1), normalize(recs))
    return plan.resolve(s1, recs, known, min_count=2, expand_count=5)


def _named(s, d, **cols):
    e = ents(s, d).select("entity_id", *[f(F.col("business_name")).alias(c) for c, f in cols.items()])
    return e.where(F.col("entity_id").startswith("S1-")), e.where(~F.col("entity_id").startswith("S1-"))


def country_of(s, d):
    return table(s, d, "part").select(F.concat(F.lit("S1-"), F.col("p_partkey").cast("string")).alias("s1"), F.when(F.col("p_size") <= 25, "US").otherwise("India").alias("country"))


def legal_features(s, d):
    return features.legal_features(key_candidates(s, d), *_named(s, d, legal=legal_form))


def raw_features(s, d):
    return features.raw_features(key_candidates(s, d), *_named(s, d, raw=raw_name)).select("s1", "rec", "raw_eq", "raw_small_diff")


def vocab_counts(s, d):
    a, b = sides(s, d)
    return features.vocab_features(blocking.key_candidates(a, b), a, b, features.token_df(a), features.generic_tokens(a, 0.05)).select("s1", "rec", "n_extra_vocab", "n_extra_unseen")


def group_gains(s, d):
    a, b = sides(s, d)
    f = features.pair_features(blocking.key_candidates(a, b), a, b).select("s1", "rec", (F.col("fz") / 100).alias("p1"), "name_tset", "addr_tset")
    return collective.group_gains(f, b)


def token_map(s, d):
    words = F.split("p_name", " ")
    return learn_token_map(table(s, d, "part").select(words.alias("rec"), F.when(F.col("p_partkey") % 5 < 4, F.transform(words, F.upper)).otherwise(F.split("p_type", " ")).alias("s1")))


def key_sizes(s, d):
    return blocking.key_sizes(*sides(s, d))


def entity_outcomes(s, d):
    return decisions.outcomes(eval_per_entity(s, d)).select("s1", "n_pred", "n_true", "tp", "outcome")


def country_thresholds(s, d):
    return decisions.by_country(exclusive(s, d), country_of(s, d), {"US": 0.6, "India": 0.75})


def odds_rescaled(s, d):
    return _rounded(decisions.rescaled(exclusive(s, d), 0.5), "p")


def best_threshold(s, d):
    return _rounded(decisions.best_threshold(s, exclusive(s, d), truth(s, d), all_s1(s, d)), "f05")


def source_slices(s, d):
    of = scored(s, d).select("rec", F.substring("rec", 1, 2).alias("slice")).distinct()
    return _rounded(decisions.record_slices(exclusive(s, d), truth(s, d), of), "precision", "recall")


def canonical_addresses(s, d):
    return address.canonical_addresses(normalize(ents(s, d)))


def canonical_features(s, d):
    a, b = sides(s, d)
    return features.canonical_features(blocking.key_candidates(a, b), address.canonical_addresses(a), address.canonical_addresses(b))


def raw_similarities(s, d):
    return features.raw_features(key_candidates(s, d), *_named(s, d, raw=raw_name))


def vocab_alignment(s, d):
    a, b = sides(s, d)
    return features.vocab_features(blocking.key_candidates(a, b), a, b, features.token_df(a), features.generic_tokens(a))


def generic_core(s, d):
    a, b = sides(s, d)
    return features.generic_features(blocking.key_candidates(a, b), a, b, features.generic_tokens(a))


def slice_metrics(s, d):
    return _rounded(decisions.slices(exclusive(s, d), truth(s, d), all_s1(s, d), country_of(s, d)), "f05", "recall")


_ALL = [best_threshold, source_slices, canonical_addresses, canonical_features, raw_similarities, vocab_alignment, generic_core, legal_features, raw_features, vocab_counts, group_gains, token_map, key_sizes, entity_outcomes, country_thresholds, odds_rescaled, slice_metrics, norm_fields, rule_matches, key_candidates, aliases, s1_state, infer_state, tfidf_name_topk, tfidf_candidates, pair_features, competition_features, diff_features, generic_features, string_distances, string_ratios, twin_components, collective_features, exclusive, expected_f_decode, threshold_decode, eval_per_entity, eval_summary, candidate_metrics, threshold_curve, id_lists, truth_explode, source_stats, validation_issues, vote_patterns, null_safe_join, semi_anti, top_per_group, page, resolve]
QUERIES = {f.__name__: f for f in _ALL}

_KC = f"WITH {NORM}, {KEYS}, kc AS (SELECT DISTINCT a.entity_id AS s1, b.entity_id AS rec FROM (SELECT *, count(*) OVER (PARTITION BY kind, key) AS n FROM k WHERE starts_with(entity_id,'S1-')) a JOIN k b USING (kind, key) WHERE a.n <= {blocking.CAP} AND NOT starts_with(b.entity_id,'S1-'))"
_STATE = """st AS (SELECT entity_id, country, part AS state FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY freq DESC, pos DESC) AS rn FROM (SELECT *, count(*) OVER (PARTITION BY country, part) AS freq FROM
  (SELECT entity_id, country, unnest(parts) AS part, unnest(range(len(parts))) AS pos FROM s1n) WHERE NOT regexp_matches(part,'[0-9]'))) WHERE rn = 1),
an AS (SELECT p.country, p.part, st.state, count(*) AS n FROM (SELECT entity_id, country, unnest(parts) AS part FROM s1n) p LEFT JOIN st ON st.entity_id = p.entity_id GROUP BY 1, 2, 3),
al AS (SELECT country, part, state FROM (SELECT *, n / sum(n) OVER (PARTITION BY country, part) AS share FROM an) WHERE n >= 2 AND share >= 0.6)"""
_CANON = "CASE w WHEN 'incorporated' THEN 'inc' WHEN 'corporation' THEN 'corp' WHEN 'company' THEN 'co' WHEN 'limited' THEN 'ltd' WHEN 'private' THEN 'pvt' ELSE w END"
_TOKS = "list_distinct(list_filter(string_split({}.name_tok,' '), lambda w: w <> ''))"
_SMALL = """list_distinct(list_filter(string_split(regexp_replace({}, '([&+])', ' \\1 ', 'g'), ' '), lambda w: list_contains(['&','and','the','of','+','-',chr(39)||'s'], w)))"""
_CURVE = """g AS (SELECT unnest({}::DOUBLE[]) AS t), b AS (SELECT i.s1, g.t, coalesce(x.n,0) AS n_true FROM ids i CROSS JOIN g LEFT JOIN (SELECT s1,count(*) n FROM truth GROUP BY 1) x USING (s1)),
q AS (SELECT e.s1, g.t, count(*) AS n_pred, count(h.rec) AS tp FROM excl e JOIN g ON g.t <= e.p LEFT JOIN truth h ON h.s1 = e.s1 AND h.rec = e.rec GROUP BY ALL),
curve AS (SELECT t, avg(CASE WHEN n_true=0 THEN CASE WHEN coalesce(n_pred,0)=0 THEN 1.0 ELSE 0.0 END ELSE 1.25*coalesce(tp,0)/(coalesce(n_pred,0)+0.25*n_true) END) AS f FROM b LEFT JOIN q USING (s1, t) GROUP BY t)"""
_MAP = lambda words: "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in address.flat(words).items()) + "}"
_LISTS = """lists AS (SELECT i.s1, t.rec FROM ids i LEFT JOIN truth t USING (s1)), e1 AS (SELECT entity_id FROM ents WHERE starts_with(entity_id,'S1-')), er AS (SELECT entity_id FROM ents WHERE NOT starts_with(entity_id,'S1-')),
tabs AS (SELECT 'matching_results' AS label, * FROM lists WHERE s1 <> 'S1-3' UNION ALL SELECT 'candidate_pairs', * FROM lists), labels AS (SELECT DISTINCT label FROM tabs)"""
_WEIGHTS = """w AS (SELECT entity_id, country, ' '||unnest(list_filter(string_split(name_tok,' '), lambda x: x <> ''))||' ' AS w FROM norm), ws AS (SELECT entity_id, country, list_filter(string_split(addr,' '), lambda x: len(x) >= 2) AS ws FROM norm),
g AS (SELECT entity_id, country, 'name' AS view, substr(w, CAST(unnest(range(1, greatest(2, len(w)-1))) AS BIGINT), 3) AS term FROM w UNION ALL SELECT entity_id, country, 'addr', unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i]||' '||ws[i+1]))) FROM ws),
tf AS (SELECT entity_id, country, view, term, 1+ln(count(*)) AS tf FROM g GROUP BY ALL), df AS (SELECT country, view, term, count(*) AS df FROM tf WHERE starts_with(entity_id,'S1-') GROUP BY ALL), nn AS (SELECT country, count(*) AS n FROM s1n GROUP BY 1),
x AS (SELECT entity_id, country, view, term, tf*(ln((1+n)/(1+df))+1) AS x, CASE WHEN n < 1000 OR df <= 0.05*n THEN tf*(ln((1+n)/(1+df))+1) END AS y FROM tf JOIN df USING (country, view, term) JOIN nn USING (country)),
v AS (SELECT entity_id, country, view, term, x/sqrt(sum(x*x) OVER o) AS w, y/sqrt(sum(y*y) OVER o) AS cut FROM x WINDOW o AS (PARTITION BY entity_id, view)),
a AS (SELECT entity_id AS s1, country, view, term, w AS wa, cut AS ca FROM v WHERE starts_with(entity_id,'S1-')), b AS (SELECT entity_id AS rec, country, view, term, w AS wb, cut AS cb FROM v WHERE NOT starts_with(entity_id,'S1-'))"""
_COS = "coalesce(sum({0}) FILTER (view='name'), 0) AS cos_name, coalesce(sum({0}) FILTER (view='addr'), 0) AS cos_addr"
_COUNTRY = "ctry AS (SELECT 'S1-'||p_partkey AS s1, CASE WHEN p_size <= 25 THEN 'US' ELSE 'India' END AS country FROM part)"
SQL = {
    "best_threshold": f"WITH {SCORED}, {EXCL}, {_CURVE.format(decisions.FINE_GRID)} SELECT t, round(f,6) AS f05 FROM curve ORDER BY round(f,9) DESC, t LIMIT 1",
    "source_slices": f"""WITH {SCORED}, {EXCL}, s AS (SELECT DISTINCT substr(rec,1,2) AS slice FROM scored), t AS (SELECT substr(rec,1,2) AS slice, count(*) AS n_true FROM truth WHERE rec IN (SELECT rec FROM scored) GROUP BY 1), q AS (SELECT substr(rec,1,2) AS slice, count(*) AS n_pred FROM excl GROUP BY 1),
h AS (SELECT substr(rec,1,2) AS slice, count(*) AS tp FROM excl JOIN truth USING (s1, rec) GROUP BY 1) SELECT slice, coalesce(n_true,0) AS n_true, coalesce(n_pred,0) AS n_pred, coalesce(tp,0) AS tp, round(coalesce(tp/nullif(n_pred,0),0),6) AS precision, round(coalesce(tp/nullif(n_true,0),0),6) AS recall FROM s LEFT JOIN t USING (slice) LEFT JOIN q USING (slice) LEFT JOIN h USING (slice)""",
    "canonical_addresses": f"""WITH {NORM}, c AS (SELECT entity_id, country, list_transform(parts, lambda p: coalesce({_MAP(address.STATES)}[country||'|'||p], p)) AS parts FROM norm),
k AS (SELECT entity_id, list_transform(flatten(list_transform(parts, lambda p: string_split(p, ' '))), lambda w: coalesce({_MAP(address.STREET)}[country||'|'||w], w)) AS words FROM c) SELECT entity_id, array_to_string(list_filter(words, lambda w: w <> ''), ' ') AS canon FROM k""",
    "tfidf_candidates": f"""WITH {NORM}, {_WEIGHTS}, rough AS (SELECT s1, rec, {_COS.format('ca*cb')} FROM a JOIN b USING (country, view, term) WHERE ca IS NOT NULL AND cb IS NOT NULL GROUP BY s1, rec),
r AS (SELECT *, 0.6*cos_name+0.4*cos_addr AS cos_comb FROM rough), k AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY round(cos_name,9) DESC, s1) AS rn, row_number() OVER (PARTITION BY rec ORDER BY round(cos_comb,9) DESC, s1) AS rc, row_number() OVER (PARTITION BY rec ORDER BY round(cos_addr,9) DESC, s1) AS ra FROM r),
chosen AS (SELECT s1, rec FROM k WHERE (rn <= 10 AND cos_name > 1e-6) OR (rc <= 20 AND cos_comb > 1e-6) OR (ra <= 10 AND cos_addr > 1e-6)),
f AS (SELECT s1, rec, {_COS.format('wa*wb')} FROM chosen JOIN a USING (s1) JOIN b USING (rec, country, view, term) GROUP BY s1, rec), e AS (SELECT *, 0.6*cos_name+0.4*cos_addr AS cos_comb FROM f)
SELECT s1, rec, round(cos_name,6) AS cos_name, round(cos_addr,6) AS cos_addr, round(cos_comb,6) AS cos_comb FROM e QUALIFY row_number() OVER (PARTITION BY rec ORDER BY round(cos_comb,9) DESC, s1) <= 5""",
    "collective_features": f"""WITH {SCORED}, c AS (SELECT s1, rec, round(p,6) AS p1 FROM scored), d AS (SELECT *, row_number() OVER (PARTITION BY rec ORDER BY p1 DESC, s1) AS p1_rank_rec, sum(p1) OVER (PARTITION BY rec) AS p1_sum_rec, row_number() OVER (PARTITION BY s1 ORDER BY p1 DESC, rec) AS rank_among_claimants FROM c),
e AS (SELECT *, CASE WHEN p1_rank_rec=1 AND p1>=0.5 THEN 1 ELSE 0 END AS claim, max(CASE WHEN p1_rank_rec=2 THEN p1 END) OVER (PARTITION BY rec) AS second, max(p1) OVER (PARTITION BY s1) AS top, max(CASE WHEN rank_among_claimants=2 THEN p1 END) OVER (PARTITION BY s1) AS runner FROM d),
comp AS (SELECT CASE WHEN o_orderkey%2=1 THEN 'S3-' ELSE 'S2-' END||o_orderkey AS rec, 'C'||(o_orderkey%1000) AS comp FROM orders), best AS (SELECT comp, rec AS twin, s1 AS twin_s1, p1 AS twin_p1 FROM d JOIN comp USING (rec) WHERE p1_rank_rec=1),
t AS (SELECT c.s1, c.rec, count(*) AS n_twins, CAST(sum(CASE WHEN twin_s1=c.s1 THEN 1 ELSE 0 END) AS BIGINT) AS twins_agree, max(CASE WHEN twin_s1=c.s1 THEN twin_p1 END) AS tb FROM c JOIN comp USING (rec) JOIN best USING (comp) WHERE twin <> c.rec GROUP BY ALL)
SELECT s1, rec, p1, p1_rank_rec, round(p1_sum_rec,6) AS p1_sum_rec, round(coalesce(p1-second,p1),6) AS p1_margin_rec, rank_among_claimants, CAST(sum(claim) OVER (PARTITION BY s1) AS BIGINT)-claim AS claims_s1, round(CASE WHEN rank_among_claimants=1 THEN coalesce(runner,0.0) ELSE top END,6) AS best_other_p1_s1,
 coalesce(n_twins,0) AS n_twins, coalesce(twins_agree,0) AS twins_agree, round(coalesce(tb,0.0),6) AS twins_best_p1_same FROM e LEFT JOIN t USING (s1, rec)""",
    "validation_issues": f"""WITH {ENTS}, {SCORED}, {_LISTS}, i AS (SELECT label||': missing reference entities' AS issue, count(*) AS n FROM labels, e1 WHERE NOT EXISTS (SELECT 1 FROM tabs t WHERE t.label = labels.label AND t.s1 = e1.entity_id) GROUP BY label
UNION ALL SELECT label||': unknown reference entities', count(DISTINCT s1) FROM tabs WHERE s1 NOT IN (SELECT entity_id FROM e1) GROUP BY label
UNION ALL SELECT label||': lists with ids that are not Source-2/3 records', count(DISTINCT s1) FROM tabs WHERE rec NOT IN (SELECT entity_id FROM er) GROUP BY label) SELECT * FROM i""",
    "legal_features": f"""{_KC}, lf AS (SELECT entity_id, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split({CLEAN.format('business_name')}, ' '), lambda w: list_contains({LISTED}, w) AND w NOT IN ('and','the','of')), lambda w: {_CANON}))), ' ') AS f FROM ents)
SELECT s1, rec, CASE WHEN a.f <> '' AND a.f = b.f THEN 1 ELSE 0 END AS lf_equal, CASE WHEN a.f <> '' AND b.f <> '' AND a.f <> b.f THEN 1 ELSE 0 END AS lf_diff, CASE WHEN (a.f = '') <> (b.f = '') THEN 1 ELSE 0 END AS lf_one_side FROM kc JOIN lf a ON a.entity_id = s1 JOIN lf b ON b.entity_id = rec""",
    "raw_features": f"""{_KC}, rn AS (SELECT entity_id, trim(regexp_replace(lower(business_name), '\\s+', ' ', 'g')) AS r FROM ents), j AS (SELECT s1, rec, a.r AS ra, b.r AS rb, {_SMALL.format('a.r')} AS sa, {_SMALL.format('b.r')} AS sb FROM kc JOIN rn a ON a.entity_id = s1 JOIN rn b ON b.entity_id = rec)
SELECT s1, rec, CASE WHEN ra = rb THEN 1 ELSE 0 END AS raw_eq, len(list_filter(sa, lambda w: NOT list_contains(sb, w))) + len(list_filter(sb, lambda w: NOT list_contains(sa, w))) AS raw_small_diff FROM j""",
    "vocab_counts": f"""{_KC}, df AS (SELECT country, tok, count(*) AS df FROM (SELECT DISTINCT entity_id, country, unnest(string_split(name_tok,' ')) AS tok FROM s1n) WHERE tok <> '' GROUP BY ALL), nn AS (SELECT country, count(*) AS n FROM s1n GROUP BY 1),
j AS (SELECT s1, rec, a.country, {_TOKS.format('a')} AS ta, string_split(b.name_tok,' ') AS tb FROM kc JOIN norm a ON a.entity_id = s1 JOIN norm b ON b.entity_id = rec),
o AS (SELECT s1, rec, country, list_filter(tb, lambda w: w <> '' AND NOT list_contains(ta, w)) AS x FROM j), x AS (SELECT s1, rec, country, unnest(list_filter(x, lambda w, i: list_position(x, w) = i)[1:4]) AS tok FROM o),
c AS (SELECT s1, rec, CAST(sum(CASE WHEN coalesce(df,0) >= 2 AND NOT df >= 0.05*n THEN 1 ELSE 0 END) AS BIGINT) AS v, CAST(sum(CASE WHEN coalesce(df,0) < 2 THEN 1 ELSE 0 END) AS BIGINT) AS u FROM x JOIN nn USING (country) LEFT JOIN df USING (country, tok) GROUP BY ALL)
SELECT s1, rec, coalesce(v, 0) AS n_extra_vocab, coalesce(u, 0) AS n_extra_unseen FROM kc LEFT JOIN c USING (s1, rec)""",
    "token_map": """WITH t AS (SELECT string_split(p_name,' ') AS r, CASE WHEN p_partkey % 5 < 4 THEN list_transform(string_split(p_name,' '), lambda w: upper(w)) ELSE string_split(p_type,' ') END AS s FROM part), z AS (SELECT unnest(r) AS tok, unnest(s) AS target FROM t WHERE len(r) = len(s)), c AS (SELECT tok, target, count(*) AS n FROM z GROUP BY ALL)
SELECT tok, target FROM c QUALIFY n >= 3 AND n / sum(n) OVER (PARTITION BY tok) >= 0.6""",
    "key_sizes": f"WITH {NORM}, {KEYS} SELECT kind, count(*) AS pairs, count(DISTINCT a.entity_id) AS entities, count(DISTINCT b.entity_id) AS records FROM (SELECT *, count(*) OVER (PARTITION BY kind, key) AS n FROM k WHERE starts_with(entity_id,'S1-')) a JOIN k b USING (kind, key) WHERE a.n <= {blocking.CAP} AND NOT starts_with(b.entity_id,'S1-') GROUP BY kind",
    "entity_outcomes": f"WITH {SCORED}, {EXCL}, {PER} SELECT s1, n_pred, n_true, tp, CASE WHEN n_true = 0 AND n_pred = 0 THEN 'correct_singleton' WHEN n_true = 0 THEN 'false_merge' WHEN tp = n_true AND n_pred = n_true THEN 'exact' WHEN tp < n_pred THEN 'has_false_match' ELSE 'missed_match' END AS outcome FROM perf",
    "country_thresholds": f"WITH {SCORED}, {EXCL}, {_COUNTRY} SELECT s1, rec, p FROM excl JOIN ctry USING (s1) WHERE p >= CASE WHEN country = 'US' THEN 0.6 ELSE 0.75 END",
    "odds_rescaled": f"WITH {SCORED}, {EXCL} SELECT s1, rec, round(0.5*p/(0.5*p+1-p), 6) AS p FROM excl",
    "slice_metrics": f"WITH {SCORED}, {EXCL}, {PER}, {_COUNTRY} SELECT country, count(*) AS n_s1, round(avg(f05),6) AS f05, round(coalesce(sum(tp)/sum(n_true),0),6) AS recall FROM perf JOIN ctry USING (s1) GROUP BY 1",
    "norm_fields": f"WITH {NORM} SELECT entity_id, name_tok, name_key, name_ns, addr, hn, array_to_string(parts, ';') AS parts, nums, nonlatin, empty_addr FROM norm",
    "rule_matches": f"WITH {NORM} SELECT a.entity_id AS s1, b.entity_id AS rec FROM (SELECT *, count(*) OVER (PARTITION BY country, name_key, hn) AS n FROM s1n WHERE name_key <> '' AND hn <> '') a JOIN recn b USING (country, name_key, hn) WHERE n = 1",
    "key_candidates": f"{_KC} SELECT * FROM kc",
    "aliases": f"WITH {NORM}, {_STATE} SELECT * FROM al",
    "s1_state": f"WITH {NORM}, {_STATE} SELECT s1n.entity_id, st.state FROM s1n LEFT JOIN st USING (entity_id)",
    "infer_state": f"WITH {NORM}, {_STATE}, v AS (SELECT entity_id, state, count(*) AS n FROM (SELECT entity_id, country, unnest(parts) AS part FROM recn) JOIN al USING (country, part) GROUP BY ALL), b AS (SELECT entity_id, state FROM v QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, state) = 1) SELECT recn.entity_id, b.state FROM recn LEFT JOIN b USING (entity_id)",
    "tfidf_name_topk": f"""WITH {NORM}, w AS (SELECT entity_id, country, ' '||unnest(list_filter(string_split(name_tok,' '), lambda x: x <> ''))||' ' AS w FROM norm), g AS (SELECT entity_id, country, substr(w, CAST(unnest(range(1, greatest(2, len(w)-1))) AS BIGINT), 3) AS term FROM w),
tf AS (SELECT entity_id, country, term, 1+ln(count(*)) AS tf FROM g GROUP BY ALL), df AS (SELECT country, term, count(*) AS df FROM tf WHERE starts_with(entity_id,'S1-') GROUP BY ALL), nn AS (SELECT country, count(*) AS n FROM s1n GROUP BY 1),
u AS (SELECT entity_id, country, term, tf*(ln((1+n)/(1+df))+1) AS w FROM tf JOIN df USING (country, term) JOIN nn USING (country)), v AS (SELECT *, w/sqrt(sum(w*w) OVER (PARTITION BY entity_id)) AS x FROM u),
c AS (SELECT a.entity_id AS s1, b.entity_id AS rec, sum(a.x*b.x) AS raw FROM v a JOIN v b USING (country, term) WHERE starts_with(a.entity_id,'S1-') AND NOT starts_with(b.entity_id,'S1-') GROUP BY ALL), r AS (SELECT s1, rec, round(raw,6) AS cos FROM c WHERE raw > 1e-6)
SELECT s1, rec, cos FROM r QUALIFY row_number() OVER (PARTITION BY rec ORDER BY cos DESC, s1) <= 3""",
    "competition_features": f"""WITH {SCORED}, c AS (SELECT s1, rec, x, y, round(p,6) AS c FROM scored), m AS (SELECT *, max(c) OVER r AS b, max(x) OVER r AS bx, max(c) OVER s AS t, max(x) OVER s AS tx, max(y) OVER s AS ty, row_number() OVER (PARTITION BY rec ORDER BY c DESC, s1) AS rn FROM c WINDOW r AS (PARTITION BY rec), s AS (PARTITION BY s1)),
q AS (SELECT *, coalesce(max(CASE WHEN rn = 2 THEN c END) OVER (PARTITION BY rec), 0) AS sec FROM m)
SELECT s1, rec, round(x,6) AS cos_name, round(y,6) AS cos_addr, c AS cos_comb, CASE WHEN c >= b THEN 1 ELSE 0 END AS rev_is_best_cos, round(CASE WHEN c >= b THEN c-sec ELSE c-b END,6) AS rev_margin_cos, round(c/greatest(b,1e-6),6) AS rev_rel_cos, round(x/greatest(bx,1e-6),6) AS rev_rel_name,
 round(c/greatest(t,1e-6),6) AS ctx_rel_cos, round(t-c,6) AS ctx_gap_cos, round(x/greatest(tx,1e-6),6) AS ctx_rel_name, round(y/greatest(ty,1e-6),6) AS ctx_rel_addr, CASE WHEN c >= t THEN 1 ELSE 0 END AS ctx_is_best_cos FROM q""",
    "diff_features": f"""{_KC}, j AS (SELECT s1, rec, string_split(a.name_tok,' ') AS ta, string_split(b.name_tok,' ') AS tb, a.hn AS ha, b.hn AS hb, try_cast(substr(b.hn,1,9) AS BIGINT)-try_cast(substr(a.hn,1,9) AS BIGINT) AS dl FROM kc JOIN norm a ON a.entity_id = s1 JOIN norm b ON b.entity_id = rec)
SELECT s1, rec, len(list_distinct(list_filter(tb, lambda w: NOT list_contains(ta, w)))) AS n_tok_extra, len(list_distinct(list_filter(ta, lambda w: NOT list_contains(tb, w)))) AS n_tok_miss, CASE WHEN dl IS NOT NULL THEN greatest(least(dl,10000),-10000) END AS hn_delta, CASE WHEN dl IS NOT NULL THEN least(abs(dl),10000) END AS hn_absdelta,
 CASE WHEN ha <> '' AND hb <> '' THEN CASE WHEN contains(ha,hb) OR contains(hb,ha) THEN 1 ELSE 0 END END AS hn_substr FROM j""",
    "generic_features": f"""{_KC}, tk AS (SELECT DISTINCT entity_id, country, unnest(string_split(name_tok,' ')) AS tok FROM s1n), nn AS (SELECT country, count(*) AS n FROM s1n GROUP BY 1), gg AS (SELECT country, list(tok) AS g FROM (SELECT country, tok, count(*) AS df FROM tk WHERE tok <> '' GROUP BY ALL) JOIN nn USING (country) WHERE df >= 0.05*n GROUP BY 1),
j AS (SELECT s1, rec, list_distinct(list_filter(string_split(a.name_tok,' '), lambda w: w <> '')) AS ta, list_distinct(list_filter(string_split(b.name_tok,' '), lambda w: w <> '')) AS tb, coalesce(g, []) AS g FROM kc JOIN norm a ON a.entity_id = s1 JOIN norm b ON b.entity_id = rec LEFT JOIN gg ON gg.country = a.country)
SELECT s1, rec, len(list_filter(tb, lambda w: NOT list_contains(ta,w) AND list_contains(g,w))) AS n_extra_generic, len(list_filter(tb, lambda w: NOT list_contains(ta,w) AND NOT list_contains(g,w))) AS n_extra_rare, len(list_filter(ta, lambda w: NOT list_contains(tb,w) AND list_contains(g,w))) AS n_miss_generic,
 len(list_filter(ta, lambda w: NOT list_contains(tb,w) AND NOT list_contains(g,w))) AS n_miss_rare, CASE WHEN list_sort(list_filter(ta, lambda w: NOT list_contains(g,w))) = list_sort(list_filter(tb, lambda w: NOT list_contains(g,w))) THEN 1 ELSE 0 END AS core_eq FROM j""",
    "string_distances": "SELECT s_suppkey, levenshtein(s_name, n_name) AS lev, round(jaro_winkler_similarity(s_name, n_name), 6) AS jw FROM supplier JOIN nation ON s_nationkey = n_nationkey",
    "twin_components": f"""WITH RECURSIVE {NORM}, t AS (SELECT entity_id, unnest([CASE WHEN hn <> '' THEN country||'|A|'||name_key||'|'||hn END, CASE WHEN addr <> '' THEN country||'|B|'||name_ns||'|'||addr END]) AS key FROM recn), e AS (SELECT * FROM t WHERE key IS NOT NULL QUALIFY count(*) OVER (PARTITION BY key) BETWEEN 2 AND 12),
r(entity_id, reach) AS (SELECT entity_id, entity_id FROM e UNION SELECT b.entity_id, r.reach FROM r JOIN e a ON a.entity_id = r.entity_id JOIN e b ON b.key = a.key) SELECT entity_id, min(reach) AS comp FROM r GROUP BY 1""",
    "exclusive": f"WITH {SCORED}, {EXCL} SELECT * FROM excl",
    "expected_f_decode": f"WITH {SCORED}, {FDEC} SELECT * FROM fdec",
    "threshold_decode": f"WITH {SCORED}, {EXCL} SELECT * FROM excl WHERE p >= 0.7",
    "eval_per_entity": f"WITH {SCORED}, {EXCL}, {PER} SELECT * FROM perf",
    "eval_summary": f"""WITH {SCORED}, {EXCL}, {PER} SELECT round(avg(f05),6) AS f05, round(avg(CASE WHEN n_true=0 THEN f05 ELSE 2.0*tp/(n_pred+n_true) END),6) AS f1, round(sum(tp)/sum(n_pred),6) AS precision, round(sum(tp)/sum(n_true),6) AS recall, count(*) AS n_s1, CAST(sum(n_true) AS BIGINT) AS n_true, CAST(sum(n_pred) AS BIGINT) AS n_pred, round(avg(CASE WHEN n_true=0 THEN 1.0 ELSE 0.0 END),6) AS singleton_share,
 round(avg(CASE WHEN n_true=0 THEN f05 END),6) AS singleton_accuracy, round(avg(CASE WHEN tp=n_true AND tp=n_pred THEN 1.0 ELSE 0.0 END),6) AS exact_share FROM perf""",
    "candidate_metrics": f"WITH {SCORED}, {PER.replace('excl', 'scored')} SELECT round(sum(tp)/sum(n_true),6) AS recall, round(avg(CASE WHEN n_true=0 THEN 1.0 ELSE 1.25*tp/(tp+0.25*n_true) END),6) AS oracle_f05, round(avg(n_pred),6) AS cand_per_s1, round(1-sum(n_pred)/(count(*)*(SELECT count(*)::DOUBLE FROM orders)),6) AS reduction FROM per",
    "threshold_curve": f"WITH {SCORED}, {EXCL}, {_CURVE.format(GRID)} SELECT t, round(f,6) AS f05 FROM curve",
    "id_lists": f"WITH {SCORED} SELECT i.s1 AS source1_entity_id, coalesce(string_agg(t.rec, ',' ORDER BY t.rec),'') AS matched_entity_ids FROM ids i LEFT JOIN truth t USING (s1) GROUP BY 1",
    "truth_explode": f"WITH {SCORED} SELECT i.s1, t.rec FROM ids i LEFT JOIN truth t USING (s1)",
    "source_stats": f"WITH {ENTS} SELECT country, count(*) FILTER (starts_with(entity_id,'S1-')) AS s1, count(*) FILTER (starts_with(entity_id,'S2-')) AS s2, count(*) FILTER (starts_with(entity_id,'S3-')) AS s3 FROM ents GROUP BY 1",
    "vote_patterns": "WITH m AS (SELECT CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END + CASE WHEN l_discount > 0.05 THEN 2 ELSE 0 END + CASE WHEN l_tax > 0.04 THEN 4 ELSE 0 END AS mask, l_returnflag = 'R' AS hit FROM lineitem), n AS (SELECT mask, count(*) AS n, count(*) FILTER (hit) AS tp FROM m GROUP BY 1) SELECT mask, n, tp, bit_count(mask) AS votes, round((tp+10*(SELECT sum(tp)/sum(n) FROM n))/(n+10),6) AS rate FROM n",
    "null_safe_join": "WITH p AS (SELECT nullif(p_brand,'Brand#1') AS brand, p_size FROM part) SELECT a.brand, a.n, b.large FROM (SELECT brand, count(*) AS n FROM p GROUP BY 1) a JOIN (SELECT brand, count(*) AS large FROM p WHERE p_size > 25 GROUP BY 1) b ON a.brand IS NOT DISTINCT FROM b.brand",
    "semi_anti": "SELECT c_custkey, CASE WHEN EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000) THEN 'large' ELSE 'small' END AS kind FROM customer",
    "top_per_group": "SELECT o_custkey, row_number() OVER w AS rank, o_orderkey, o_totalprice FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) QUALIFY rank <= 2",
    "page": "SELECT c_custkey, c_name FROM customer WHERE contains(lower(c_mktsegment), 'build') ORDER BY c_name, c_custkey LIMIT 15 OFFSET 20",
}
