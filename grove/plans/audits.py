"""Registered queries of the audits, of folds, token maps and entity views, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from grove.functions.text import NOISE, mapped_names as apply_map, normalize
from grove.operators import audit, blocking
from grove.plans import queries as q
from grove.plans import serving, training

DIALS = [(0.0, 0.05), (0.15, 0.05), (0.3, 0.2), (1.0, 0.5)]


def _regions(s, d):
    e = normalize(q.ents(s, d)).where(F.startswith("entity_id", F.lit("S1-")))
    return e.select("entity_id", "country").join(q.s1_state(s, d), "entity_id")


def fold_assignment(s, d):
    return training.fold_of(_regions(s, d), 3)


def region_sample(s, d):
    return audit.sample_regions(_regions(s, d))


def mapped_names(s, d):
    words = s.createDataFrame([("goldenrod", "golden"), ("steel", "stahl"), ("the", "of"), ("dark", "inc")], "tok string, target string")
    return apply_map(q.ents(s, d), words)


def country_candidates(s, d):
    a, b = q.sides(s, d)
    known = q.aliases(s, d).where("state <> 'state a'")
    return q._rounded(blocking.country_candidates(a, b, blocking.infer_state(b, known)), "cos_name", "cos_addr", "cos_comb")


def key_recall(s, d):
    a, b = q.sides(s, d)
    return q._rounded(audit.key_recall(a, b, q.rule_matches(s, d)), "recall")


def key_overlap(s, d):
    a, b = q.sides(s, d)
    return audit.key_overlap(a, b)


def state_report(s, d):
    e = q.ents(s, d).select(F.col("entity_id").alias("s1"), "country")
    return audit.state_report(q.infer_state(s, d), q.s1_state(s, d), q.rule_matches(s, d), e)


def twin_propagation(s, d):
    return audit.propagation(q.twin_components(s, d), q.rule_matches(s, d))


def decode_grid(s, d):
    return q._rounded(audit.decode_grid(q.exclusive(s, d), q.truth(s, d), q.all_s1(s, d), DIALS), "f05")


def _traits(s, d):
    """Features of scored pairs, made up from the tables."""
    n = F.substring_index("rec", "-", -1).cast("bigint")
    is_ = lambda k: (n % k == 0).cast("double")
    return q.scored(s, d).where("p >= 0.1").select("s1", "rec", F.round(F.col("x") * 1000, 6).alias("name_tset"), F.round(F.col("y") * 1250, 6).alias("addr_tset"), is_(5).alias("namekey_eq"), is_(4).alias("hn_eq"), is_(13).alias("hn_missing_rec"), F.lit(0.0).alias("hn_missing_s1"), is_(7).alias("empty_addr"), is_(11).alias("nonlatin"))


def error_audit(s, d):
    pred, true, ids, traits = q.threshold_decode(s, d), q.truth(s, d), q.all_s1(s, d), _traits(s, d)
    n = lambda c: F.substring_index(c, "-", -1).cast("bigint")
    s1_states = ids.select(F.col("s1").alias("entity_id"), (n("s1") % 3).cast("string").alias("state"))
    rec_states = true.select(F.col("rec").alias("entity_id"), F.when(n("rec") % 9 != 1, (n("rec") % 3).cast("string")).alias("state"))
    candidates = q.scored(s, d).where("p >= 0.05")
    errors = audit.false_matches(pred, true, traits).unionByName(audit.missed_matches(pred, true, candidates, traits, s1_states, rec_states))
    return q._rounded(audit.gains(errors, pred, true, ids), "gain")


def entity_view(s, d):
    pairs = q.scored(s, d).select("s1", "rec", F.col("x").alias("p1"), F.when(F.col("p") >= 0.3, F.col("p")).alias("p"))
    return serving.entity_view(pairs, q.threshold_decode(s, d), q.truth(s, d), "S1-10")


def denser_world(s, d):
    return audit.doubled(q.scored(s, d).select("s1", "rec", "p"), q.truth(s, d)).groupBy("s1").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("rec").alias("records"))


def vote_report(s, d):
    votes = q.table(s, d, "lineitem").select((F.col("l_quantity") > 25).alias("a"), (F.col("l_discount") > 0.05).alias("b"), (F.col("l_tax") > 0.04).alias("c"), (F.col("l_returnflag") == "R").alias("hit"))
    return q._rounded(audit.vote_report(audit.without_patterns(votes, ["a", "b", "c"], ["--+"]), ["a", "b", "c"]), "rate", "bound")


_ALL = [fold_assignment, region_sample, mapped_names, country_candidates, key_recall, key_overlap, state_report, twin_propagation, decode_grid, error_audit, entity_view, denser_world, vote_report]
QUERIES = {f.__name__: f for f in _ALL}

_SCORED = q.SQL["exclusive"].removesuffix(" SELECT * FROM excl")
_DECODE = """SELECT {c}::DOUBLE AS c, {floor}::DOUBLE AS floor, s1, rec FROM (SELECT *, min(CASE WHEN ef = best THEN k END) OVER (PARTITION BY s1) AS stop FROM (SELECT *, max(ef) OVER (PARTITION BY s1) AS best FROM
 (SELECT *, round(1.25*pk/(k+0.25*(e+{c})), 9) AS ef, exp(sum(ln(1-least(p,1-1e-9))) OVER (PARTITION BY s1)) AS ef0 FROM (SELECT *, row_number() OVER (PARTITION BY s1 ORDER BY p DESC, rec) AS k,
 sum(p) OVER (PARTITION BY s1 ORDER BY p DESC, rec ROWS UNBOUNDED PRECEDING) AS pk, sum(p) OVER (PARTITION BY s1) AS e FROM excl WHERE p >= {floor})))) WHERE best > ef0 AND k <= stop"""
_MACRO = "CASE WHEN n_true = 0 THEN CASE WHEN {p} = 0 THEN 1.0 ELSE 0.0 END ELSE 1.25*{t}/({p}+0.25*n_true) END"
_NO = "CAST(split_part({}, '-', 2) AS BIGINT)"
_LOST = q.SQL["infer_state"].replace("JOIN al USING", "JOIN (SELECT * FROM al WHERE state <> 'state a') al USING")
_RARE = q._WEIGHTS.replace("n < 1000 OR df <= 0.05*n", f"df <= {blocking.LOST_MOST_DF}")
_DIFFER = "hn_eq < 0.5 AND hn_missing_rec < 0.5"
SQL = {
    "fold_assignment": f"""WITH {q.ENTS}, e AS (SELECT entity_id, country FROM ents), r AS (SELECT s.entity_id, e.country, s.state FROM ({q.SQL['s1_state']}) s JOIN e USING (entity_id)),
f AS (SELECT country, state, (row_number() OVER (ORDER BY md5('42|'||country||'|'||state), country, state) - 1) % 3 AS fold FROM (SELECT DISTINCT country, state FROM r WHERE state IS NOT NULL))
SELECT r.entity_id AS s1, CAST(coalesce(f.fold, CAST('0x'||substr(md5('42|'||entity_id), 1, 8) AS BIGINT) % 3) AS INT) AS fold FROM r LEFT JOIN f USING (country, state)""",
    "region_sample": f"""WITH {q.ENTS}, e AS (SELECT entity_id, country FROM ents), r AS (SELECT country, state, count(*) AS n FROM ({q.SQL['s1_state']}) s JOIN e USING (entity_id) WHERE state IS NOT NULL GROUP BY ALL),
w AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY country ORDER BY md5('42|'||country||'|'||state), state ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, sum(n) OVER (PARTITION BY country) AS total FROM r)
SELECT country, state, n FROM w WHERE before < 0.15*total""",
    "mapped_names": f"""WITH {q.ENTS}, w AS (SELECT entity_id, list_transform(string_split({q.CLEAN.format('business_name')}, ' '), lambda t: CASE t WHEN 'goldenrod' THEN 'golden' WHEN 'steel' THEN 'stahl' WHEN 'the' THEN 'of' WHEN 'dark' THEN 'inc' ELSE t END) AS w FROM ents)
SELECT entity_id, array_to_string(list_filter(w, lambda t: t <> '' AND NOT list_contains({NOISE}, t)), ' ') AS mapped FROM w""",
    "country_candidates": f"""WITH {q.NORM}, {_RARE}, lost AS (SELECT entity_id AS rec FROM ({_LOST}) WHERE state IS NULL),
c AS (SELECT s1, rec, sum(ca*cb) AS cos FROM a JOIN (SELECT * FROM b SEMI JOIN lost USING (rec)) b USING (country, view, term) WHERE view = 'name' AND ca IS NOT NULL AND cb IS NOT NULL GROUP BY s1, rec),
chosen AS (SELECT s1, rec FROM c WHERE cos > 1e-6 QUALIFY row_number() OVER (PARTITION BY rec ORDER BY round(cos, 9) DESC, s1) <= {blocking.LOST_KEEP}),
f AS (SELECT s1, rec, {q._COS.format('wa*wb')} FROM chosen JOIN a USING (s1) JOIN b USING (rec, country, view, term) GROUP BY s1, rec) SELECT s1, rec, round(cos_name, 6) AS cos_name, round(cos_addr, 6) AS cos_addr, round(0.6*cos_name+0.4*cos_addr, 6) AS cos_comb FROM f""",
    "key_recall": f"""WITH {q.NORM}, {q.KEYS}, t AS (SELECT DISTINCT s1, rec FROM ({q.SQL['rule_matches']})), a AS (SELECT entity_id, kind, key FROM (SELECT *, count(*) OVER (PARTITION BY kind, key) AS n FROM k WHERE starts_with(entity_id, 'S1-')) WHERE n <= 20),
m AS (SELECT DISTINCT a.kind, a.entity_id AS s1, b.entity_id AS rec FROM a JOIN k b USING (kind, key) WHERE NOT starts_with(b.entity_id, 'S1-')), every AS (SELECT * FROM m UNION ALL SELECT DISTINCT 'any', s1, rec FROM m)
SELECT kind, count(*) AS pairs, count(t.s1) AS hits, round(count(t.s1)/(SELECT count(*) FROM t), 6) AS recall FROM every LEFT JOIN t USING (s1, rec) GROUP BY kind""",
    "key_overlap": f"""WITH {q.NORM}, {q.KEYS}, b AS (SELECT DISTINCT kind, key, 1 AS hit FROM k WHERE NOT starts_with(entity_id, 'S1-')) SELECT kind, count(*) AS entities, count(hit) AS hits FROM k LEFT JOIN b USING (kind, key) WHERE starts_with(entity_id, 'S1-') GROUP BY kind""",
    "state_report": f"""WITH {q.ENTS} SELECT country, count(*) AS n, count(r.state) AS covered, count(*) FILTER (r.state = o.state) AS "right" FROM ({q.SQL['rule_matches']}) t JOIN ents e ON e.entity_id = t.s1
LEFT JOIN ({q.SQL['infer_state']}) r ON r.entity_id = t.rec LEFT JOIN ({q.SQL['s1_state']}) o ON o.entity_id = t.s1 GROUP BY country""",
    "twin_propagation": f"""WITH own AS (SELECT comp, s1, count(*) AS n FROM ({q.SQL['twin_components']}) c JOIN ({q.SQL['rule_matches']}) t ON t.rec = c.entity_id GROUP BY ALL), per AS (SELECT comp, sum(n) AS n, count(*) AS owners, sum(n*(n-1)) AS good FROM own GROUP BY comp HAVING sum(n) >= 2)
SELECT count(*) AS components, count(*) FILTER (owners = 1) AS pure, CAST(coalesce(sum(n*(n-1)), 0) AS BIGINT) AS pairs, CAST(coalesce(sum(good), 0) AS BIGINT) AS "right" FROM per""",
    "decode_grid": f"""{_SCORED}, kept AS ({' UNION ALL '.join(_DECODE.format(c=c, floor=f) for c, f in DIALS)}), g(c, floor) AS (VALUES {', '.join(f'({c}::DOUBLE, {f}::DOUBLE)' for c, f in DIALS)}), nt AS (SELECT s1, count(*) AS n_true FROM truth GROUP BY 1),
got AS (SELECT k.c, k.floor, k.s1, count(*) AS n_pred, count(t.rec) AS tp FROM kept k LEFT JOIN truth t USING (s1, rec) GROUP BY ALL),
every AS (SELECT i.s1, g.c, g.floor, coalesce(n_true, 0) AS n_true, coalesce(n_pred, 0) AS n_pred, coalesce(tp, 0) AS tp FROM ids i CROSS JOIN g LEFT JOIN nt USING (s1) LEFT JOIN got ON got.s1 = i.s1 AND got.c = g.c AND got.floor = g.floor)
SELECT c, floor, round(avg({_MACRO.format(p='n_pred', t='tp')}), 6) AS f05 FROM every GROUP BY ALL""",
    "error_audit": f"""{_SCORED}, pred AS (SELECT s1, rec FROM excl WHERE p >= 0.7), f AS (SELECT s1, rec, round(x*1000, 6) AS name_tset, round(y*1250, 6) AS addr_tset, {', '.join(f"CASE WHEN {_NO.format('rec')} % {k} = 0 THEN 1 ELSE 0 END AS {n}" for k, n in ((5, 'namekey_eq'), (4, 'hn_eq'), (13, 'hn_missing_rec'), (7, 'empty_addr'), (11, 'nonlatin')))} FROM scored WHERE p >= 0.1),
wrong AS (SELECT p.s1, p.rec, 'false: '||CASE WHEN p.rec IN (SELECT rec FROM truth) THEN 'record of another entity' WHEN p.s1 NOT IN (SELECT s1 FROM truth) THEN 'entity without records' WHEN namekey_eq > 0.5 THEN 'same name key' WHEN name_tset >= 90 AND {_DIFFER} THEN 'similar name, other house number'
 WHEN name_tset < 70 AND addr_tset >= 85 THEN 'other name, same address' WHEN name_tset >= 90 THEN 'similar name' ELSE 'other' END AS category FROM pred p ANTI JOIN truth USING (s1, rec) LEFT JOIN f USING (s1, rec)),
lost AS (SELECT t.s1, t.rec, CASE WHEN c.s1 IS NOT NULL THEN 'missed, candidate: '||CASE WHEN f.s1 IS NULL THEN 'pruned by the first stage' WHEN empty_addr > 0.5 THEN 'empty address' WHEN nonlatin > 0.5 THEN 'other script' WHEN name_tset < 50 THEN 'renamed' WHEN {_DIFFER} THEN 'house numbers differ' ELSE 'low score' END
 ELSE 'missed, no candidate: '||CASE WHEN {_NO.format('t.rec')} % 9 = 1 THEN 'no region' WHEN {_NO.format('t.rec')} % 3 <> {_NO.format('t.s1')} % 3 THEN 'another region' ELSE 'same region, not retrieved' END END AS category
 FROM truth t ANTI JOIN pred USING (s1, rec) LEFT JOIN (SELECT s1, rec FROM scored WHERE p >= 0.05) c ON c.s1 = t.s1 AND c.rec = t.rec LEFT JOIN f ON f.s1 = t.s1 AND f.rec = t.rec),
errors AS (SELECT * FROM wrong UNION ALL SELECT * FROM lost), np AS (SELECT s1, count(*) AS n_pred FROM pred GROUP BY 1), nt AS (SELECT s1, count(*) AS n_true FROM truth GROUP BY 1), hit AS (SELECT s1, count(*) AS tp FROM pred JOIN truth USING (s1, rec) GROUP BY 1),
per AS (SELECT s1, coalesce(n_pred, 0) AS n_pred, coalesce(n_true, 0) AS n_true, coalesce(tp, 0) AS tp FROM ids LEFT JOIN np USING (s1) LEFT JOIN nt USING (s1) LEFT JOIN hit USING (s1)), n AS (SELECT category, s1, count(*) AS x FROM errors GROUP BY ALL),
z AS (SELECT category, x, n_true, n_pred, tp, CASE WHEN starts_with(category, 'false') THEN n_pred - x ELSE n_pred + x END AS p2, CASE WHEN starts_with(category, 'false') THEN tp ELSE tp + x END AS t2 FROM n JOIN per USING (s1))
SELECT category, CAST(sum(x) AS BIGINT) AS pairs, round(sum({_MACRO.format(p='p2', t='t2')} - {_MACRO.format(p='n_pred', t='tp')})/(SELECT count(*) FROM ids), 6) AS gain FROM z GROUP BY category""",
    "entity_view": f"""{_SCORED}, m AS (SELECT s1, rec FROM excl WHERE p >= 0.7), own AS (SELECT rec, x AS p1, CASE WHEN p >= 0.3 THEN p END AS p FROM scored WHERE s1 = 'S1-10'), real AS (SELECT rec, true AS "true" FROM truth WHERE s1 = 'S1-10'), here AS (SELECT * FROM own FULL JOIN real USING (rec)),
held AS (SELECT rec, bool_or(s1 = 'S1-10') AS matched, min(s1) FILTER (s1 <> 'S1-10') AS went_to FROM m GROUP BY rec) SELECT 'S1-10' AS s1, rec, p1, p, coalesce(matched, false) AS matched, coalesce("true", false) AS "true", went_to FROM here LEFT JOIN held USING (rec)""",
    "denser_world": f"""{_SCORED}, w AS (SELECT s1, rec FROM scored UNION ALL SELECT s1, rec||'#2' FROM scored WHERE rec NOT IN (SELECT rec FROM truth)) SELECT s1, count(*) AS n, count(DISTINCT rec) AS records FROM w GROUP BY s1""",
    "vote_report": """WITH m AS (SELECT CASE WHEN l_quantity > 25 THEN '+' ELSE '-' END||CASE WHEN l_discount > 0.05 THEN '+' ELSE '-' END||CASE WHEN l_tax > 0.04 THEN '+' ELSE '-' END AS pattern, l_returnflag = 'R' AS hit FROM lineitem),
n AS (SELECT pattern, count(*) AS n, count(*) FILTER (hit) AS tp FROM m WHERE pattern <> '--+' GROUP BY 1) SELECT pattern, n, tp, round((tp+10*(SELECT sum(tp)/sum(n) FROM n))/(n+10), 6) AS rate, round(n+2*sqrt(n)+3, 6) AS bound FROM n""",
}
