"""The grammar's composed transducers against their definition and against one another."""

import random

from pyspark.sql import functions as F

from grove.llm import toxicity as T


def by_definition(kinds):
    """What each part says, from the places of the classes alone."""
    at = lambda *own: [i for i, k in enumerate(kinds) if k in own]
    near = lambda i, places, reach: any(0 < i - p <= reach for p in places)
    out = []
    for i, k in enumerate(kinds):
        if k in (T.INSULT, T.THREAT):
            aimed = near(i, at(T.TARGET, T.LEADING), T.REACH) or any(0 < p - i <= T.REACH for p in at(T.TARGET))
            out.append((k, (int(near(i, at(T.NEGATION), T.REACH)), int(near(i, at(T.REPORT), 2 * T.REACH)), int(aimed))))
    return out


def test_composition_equals_its_parts():
    rng, g = random.Random(1), T.Grammar()
    names = {k: ws.split() for k, ws in T.LEXICON.items()} | {T.OTHER: ["grass", "moon"]}
    first, parts = T.parts()
    ahead, rest = T.composed()
    assert len(rest.table) <= 5 * 5 * 9 and len(ahead.table) == 5
    for _ in range(3000):
        kinds = [rng.choice([0, 0, 0, 1, 2, 3, 4, 5, 6]) for _ in range(rng.randint(0, 25))]
        symbols = first.run(kinds[::-1])[::-1]
        assert symbols == ahead.run(kinds[::-1])[::-1]
        one_by_one = symbols
        for part in parts:
            one_by_one = part.run(one_by_one)
        assert one_by_one == rest.run(symbols)
        words = [rng.choice(names[k]) for k in kinds]
        assert g.clause(words) == by_definition(kinds)


def test_languages_and_contractions():
    g = T.Grammar()
    for text in ("You don't look like an idiot.", "you didn’t call an idiot", "tu n'es pas un idiot", "ni un imbécil"):
        assert g.score(text) < 0.5, text
    for text in ("l'idiot, c'est toi", "du idiot", "you're an idiot", "T'es un connard", "YOU MORON", "i will kill you"):
        assert g.score(text) >= 0.5, text
    assert g.patterns("les idiots du village") == [(T.INSULT, (0, 0, 0))] and g.patterns("du idiot") == [(T.INSULT, (0, 0, 1))]
    assert T.tokens("l'idiot qu'il aime; don't we're s'il") == ["l'", "idiot", "qu'", "il", "aime", "don't", "we're", "s'", "il"]


def test_labels_that_differ_and_repeated_ids(spark):
    """An id with two labels is toxic, whatever the order; rows of one id with different texts are rows of their own."""
    docs = spark.createDataFrame([(i, f"plain words number {i} {'blarg' if i % 2 else 'moss'}") for i in range(40)] + [(1, "another blarg"), (None, "blarg"), (2, None)], "doc_id long, text string")
    rows = [(i, i % 2) for i in range(40)] + [(1, 0), (3, 0), (5, None), (None, 1)]
    learned = [sorted(T.fit_grammar(docs, spark.createDataFrame(r, "doc_id long, toxic int"), F.lit(True)).prefixes + tuple(T.fit_grammar(docs, spark.createDataFrame(r, "doc_id long, toxic int"), F.lit(True)).words)) for r in (rows, rows[::-1])]
    assert learned[0] == learned[1] and any("blarg" in w for w in learned[0])


def test_bounded_sample(spark):
    """Rows and characters of the sample stay near their bounds where one id holds most rows and texts are long."""
    docs = spark.createDataFrame([(1, f"t{i} " * 50) for i in range(400)] + [(i, "x " * 100) for i in range(2, 50)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, toxic int")
    scratch = T.Scratch(spark)
    assert T._sampled(docs, labels, F.lit(True), 50, 10**9, scratch).count() <= 150
    assert T._sampled(docs, labels, F.lit(True), 10**6, 20_000, scratch).agg(F.sum(F.length("text"))).first()[0] <= 40_000
    scratch.end()


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "you idiot", 5.0)], "doc_id long, text string, Score double")
    got = T.score_toxicity(docs, T.Grammar())
    assert got.columns == ["doc_id", "text", "score"] and got.first()["score"] > 0.5
