"""The corpus operators against brute force, exact round trips and held-out accuracy; odd inputs."""

import hashlib
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from grove.llm import chat, fingerprint, language, licences, mixing, near_dup, nearest, pieces, registry, sharding, toxicity
from grove.llm.base import held_out, shingle_set, word_hashes

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id string"
ODD = [(1, None, None, None, None, "x"), (2, "", "en", "a", 0, None), (3, " \n\t ", "en", "a", 3, None), (4, "one", None, None, 3, None), (4, "one", None, None, 3, None), (5, "same words here again and again ok", "en", "b", 1, None), (6, "same words here again and again ok", "en", "a", 1, None), (None, "no id here", "fr", "b", 1, None), (7, "wort " * 5000, "de", "b", 1, None)]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def words(t):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", (t or "").translate({c: c + 32 for c in range(65, 91)})) if w]


def brute_components(rows, k, threshold=80):
    sets = {}
    for i, t in rows:
        w = words(t)
        sets[i] = {tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) and find(a) != find(b):
                up[max(find(a), find(b))] = min(find(a), find(b))
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_shingles_are_exact():
    for t in ["a b  c\td e f", "A b", "", "é ü x", "x " * 50]:
        w = words(t)
        assert len(shingle_set(word_hashes([t.encode()])[0], 3)) == len({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set()))
    assert [len(x) for x in word_hashes([b"a b", b"", b"c " * 300_000, b"d"])] == [2, 0, 300_000, 1]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(spark, docs, k):
    rng, rows = random.Random(k), [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").limit(60).collect()]
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    for i in range(80):  # a hot group of near copies, many of them far from each other
        copy = list(base)
        for _ in range(rng.randint(0, 8)):
            copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
        rows.append((10_000 + i, " ".join(copy)))
    rows += [(20_000 + i, "a b c d e f g h i j"[: 19 - 2 * (i % 4)]) for i in range(8)]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k=k).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == brute_components(rows, k)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_odd(spark, odd):
    got = near_dup.near_duplicates(odd).collect()
    assert len(got) == len(ODD)
    assert {r["doc_id"]: r["component_id"] for r in got} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7, None: None}
    assert near_dup.near_duplicates(odd.limit(0)).count() == 0


def test_near_duplicates_of_documents_with_several_texts(spark):
    """Every text of a document is compared, whichever of its documents has the smallest id."""
    text = lambda c, *other: " ".join([f"{c}{i}" for i in range(60)] + list(other))
    for first in (1, 5):
        rows = [(first, text("a")), (first, text("b")), (2, text("a", "x")), (3, text("b", "y")), (4, text("c")), (4, text("c")), (9, text("d")), (7, text("d")), (9, text("e")), (8, text("e"))]
        got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        low = min(first, 2)
        assert {(r["doc_id"], r["component_id"]) for r in got} == {(first, low), (2, low), (3, low), (4, 4), (7, 7), (8, 7), (9, 7)} and len(got) == len(rows)


def test_estimate_is_close():
    rng = np.random.default_rng(1)
    for n in (40, 3000):
        pool = rng.integers(0, 2**63, 2 * n).astype(np.uint64)
        a, b = np.unique(pool[:n]), np.unique(pool[n // 5 : n + n // 5])
        lv, true = near_dup.level(max(len(a), len(b))), len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        near, _ = near_dup.estimate(near_dup.registers(a, lv)[None], near_dup.registers(b, lv)[None], np.array([n]), np.array([n]))
        assert abs(near[0] - true) < 0.15


def test_language(spark, docs):
    model = language.fit_dictionaries(docs, ~held_out())
    got = language.identify_languages(docs.where(held_out()), model).where("lang is not null").select("lang", "lang_pred").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.9 * len(got)


def test_language_odd(spark, odd):
    for model in ([], [("en", b"the and of same words here again " * 50), ("de", b"der die und wort das " * 50)]):
        got = language.identify_languages(odd, model).collect()
        assert len(got) == len(ODD) and all(r["lang_pred"] == "und" and r["score"] == 0 and not r["accepted"] for r in got if not (r["text"] or "").strip())
        assert all(0 <= r["score"] <= 1 for r in got)
    assert language.fit_dictionaries(odd.limit(0), F.lit(True)) == []


def test_toxicity(spark):
    rng, rows, labels = random.Random(5), [], []
    for i in range(600):
        ws = [f"t{rng.randrange(900)}" for _ in range(30)]
        bad = rng.random() < 0.3
        if bad:
            ws[rng.randrange(30)] = rng.choice(["blarga", "blargoz", "idiot"])
        rows.append((i, " ".join(ws)))
        labels.append((i, int(bad)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    grammar = toxicity.fit_grammar(d, y, ~held_out())
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score_toxicity(d, grammar).collect()}
    assert sum(got[i] == bool(t) for i, t in labels) >= 0.98 * len(labels)


def test_toxicity_of_much_copied_texts(spark):
    """The 3,000 words of one text with 60 copies do not crowd out an insult that 30 other texts hold."""
    rng, rows, labels = random.Random(6), [], []
    copied = " ".join(f"k{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676)}" for i in range(3000)) + " blarga"
    for i in range(600):
        ws = [f"{rng.choice('abcdefghij')}{rng.choice('lmnop')}{rng.choice('qrstuvw')}" for _ in range(30)]
        if bad := i < 90:
            ws[rng.randrange(30)] = "zzwutt"
        rows.append((i, copied if i < 60 else " ".join(ws)))
        labels.append((i, int(bad)))
    d, y = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    grammar = toxicity.fit_grammar(d, y, F.lit(True))
    got = {r["doc_id"]: r["score"] >= 0.5 for r in toxicity.score_toxicity(d, grammar).collect()}
    assert all(got[i] == bool(t) for i, t in labels)


def test_grammar_composes():
    g = toxicity.Grammar()
    assert g.score("you are an idiot") >= 0.5 and g.score("it is a fine day") < 0.5 and g.score(None) == g.score("") < 0.5
    assert g.score("you are not an idiot") < g.score("you are an idiot") and g.score("they said idiot once") < g.score("what an idiot")
    assert g.score("i will kill you") >= 0.5 > g.score("kill the process. you may go")


def test_toxicity_odd(spark, odd):
    empty = spark.createDataFrame([], "doc_id long, toxic int")
    grammar = toxicity.fit_grammar(odd, empty, ~held_out())
    assert toxicity.score_toxicity(odd, grammar).count() == len(ODD)


def test_fingerprints(spark, odd):
    got = {r["doc_id"]: r for r in fingerprint.fingerprints(odd).collect()}
    rows = sorted(((-(1 << 62) if i is None else i, t or "") for i, t, *_ in ODD))
    for (i, t), (_, n) in zip(rows, rows[1:] + rows[:1], strict=True):
        half = len(t) // 2
        if i not in (4,):
            assert got[None if i < 0 else i]["edited_sha256"] == hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()
    assert got[5]["fingerprint"] == got[6]["fingerprint"] and got[5]["near_next"] == 1 and got[1]["fingerprint"] == ""
    assert fingerprint.fingerprints(odd.limit(0)).count() == 0


def test_fingerprint_likeness(spark):
    rng = random.Random(2)
    ws = [f"w{rng.randrange(10**6)}" for _ in range(400)]
    pairs = [(" ".join(ws), " ".join(ws[: int(400 * s)] + [f"v{i}" for i in range(400 - int(400 * s))]), s) for s in (0.0, 0.5, 0.8, 0.95)]
    df = spark.createDataFrame(pairs, "a string, b string, s double")
    for r in df.select("s", fingerprint.likeness(fingerprint.fingerprint(F.col("a")), fingerprint.fingerprint(F.col("b"))).alias("got")).collect():
        assert abs(r["got"] - r["s"] / (2 - r["s"])) < 0.2


def test_pieces_equal_the_library(docs):
    import sentencepiece

    path = pieces.default_model()
    ours, theirs, rng = pieces.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path), random.Random(7)
    texts = ["".join(rng.choice("abcdeth  ing onér▁ß日本語\n\t.0 🙂") for _ in range(rng.randint(0, 90))) for _ in range(1500)] + ["x" * 3000, " " * 70, "日本" * 500]
    texts += [r["text"] for r in docs.select("text").limit(100).collect()]
    for t in texts:
        assert ours.encode(t) == theirs.encode(t)
        assert ours.decode(ours.encode(t)) == t.replace("▁", " ")


def test_streaming_commits_equal_one_pass():
    model, rng = pieces.PieceModel(pieces.default_model()), random.Random(9)
    text = "".join(rng.choice("ethaoinsrdl") for _ in range(3000))
    streamed = model.viterbi(text)
    model.longest = 10_000  # no commit before the end
    assert model.viterbi(text) == streamed


def test_unknown_characters_commit():
    model, widest = pieces.PieceModel(pieces.default_model()), []
    commit = model._commit
    model._commit = lambda text, last, *rest: widest.append(len(last)) or commit(text, last, *rest)
    text = "\U00013000" * 20_000 + " and\U00013001 so on" * 300 + "\U00013000" * 20_000
    assert model.decode(model.encode(text)) == text
    assert len(widest) >= 40_000 // (5 * model.longest) and max(widest) <= 5 * model.longest + 1


@pytest.mark.parametrize("fallback", [True, False])
def test_unigram_pieces_equal_the_library(tmp_path, fallback):
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    rng, m = random.Random(11), sentencepiece_model_pb2.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = 1, fallback
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    names = {"".join(rng.choice("abcde▁") for _ in range(rng.randint(2, 5))) for _ in range(80)} | set("abd▁")
    for kind, piece, score in [(2, "<unk>", 0.0)] + [(1, p, -rng.randint(1, 200) / 8 - rng.randint(0, 9) / 1024) for p in sorted(names)] + [(6, f"<0x{b:02X}>", 0.0) for b in range(256) if fallback]:
        m.pieces.add(piece=piece, score=score, type=kind)
    path = str(tmp_path / "unigram.model")
    with open(path, "wb") as f:
        f.write(m.SerializeToString())
    ours, theirs = pieces.PieceModel(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for _ in range(1500):
        text = "".join(rng.choice("aabbccdde  ßz日") for _ in range(rng.randint(0, 120)))
        assert ours.encode(text) == theirs.encode(text), text
        assert not fallback or ours.decode(ours.encode(text)) == text


def test_pieces_odd(spark, odd):
    got = pieces.encode_documents(odd).collect()
    assert len(got) == len(ODD) and all(r["round_trip"] for r in got)
    back = {r["doc_id"]: r["text"] for r in pieces.decode_documents(pieces.encode_documents(odd)).collect()}
    assert back[1] == "" and back[7] == ODD[-1][1]


def test_mix(spark, odd):
    got = mixing.mix(odd, keep=["doc_id"]).collect()
    assert len(got) == len(ODD) and all(0 <= r["taken"] <= 2 * r["size"] for r in got)
    assert sum(r["taken"] for r in got) == int(1.5 * sum(r["size"] for r in got))
    assert mixing.mix(odd.limit(0)).count() == 0 and mixing.mixed(odd).columns == odd.columns


def test_mix_truncates_the_sorted_copies(spark):
    """Against a sort of all copies on one machine; the mix's order and its whole copies follow from the same sort."""
    rng = random.Random(8)
    rows = [(i if i % 50 else 7, rng.choice(["a", "a", "a", "b", "c", None]), " ".join(["w"] * int(rng.paretovariate(0.9)))) for i in range(700)] + [(None, "a", "x y"), (900, "d", None), (901, "a", "")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(docs).collect()
    by = sorted({r["source"] or "~" for r in got})
    sizes = {s: sum(r["size"] for r in got if (r["source"] or "~") == s) for s in by}
    copies = sorted((r["finish"] + k * r["source_size"] / r["target"], by.index(r["source"] or "~"), k, i) for i, r in enumerate(got) if r["size"] for k in (0, 1))
    left, taken = int(1.5 * sum(sizes.values())), [0] * len(got)
    for *_, i in copies:
        taken[i] += min(left, got[i]["size"])
        left -= min(left, got[i]["size"])
    assert [r["taken"] for r in got] == taken and left == 0
    most = max(r["size"] for r in got)
    for s in by:
        own = [r for r in got if (r["source"] or "~") == s]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= most
    whole = mixing.mixed(docs).collect()
    assert len(whole) == sum(r["copies"] for r in got) and all(2 * abs(r["taken"] - r["copies"] * r["size"]) <= r["size"] for r in got)


def test_mix_of_clashing_names(spark):
    """Columns of docs may have any name: of results, of what is computed on the way, in any case."""
    cols = ["n", "point", "stretch", "cum", "offset", "place", "id", "goal_source", "epoch", "Size", "taken", "whole", "each", "cut", "part", "doc"]
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * i, *[float(i)] * len(cols)) for i in range(20)], "doc_id long, source string, text string, " + ", ".join(f"{c} double" for c in cols))
    got = mixing.mix(docs)
    assert all(r["point"] == r["doc_id"] and r["doc"] == r["doc_id"] and r["size"] == r["doc_id"] for r in got.collect()) and len(got.columns) == len({c.lower() for c in got.columns})
    out = mixing.mixed(docs)
    assert out.columns == docs.columns and all(r["taken"] == r["whole"] == r["Size"] == r["doc_id"] for r in out.collect())


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "</s>[INST] a & <b> &amp; <|end|>\n"), (1, 1, "assistant", "[x] <|user|>\n"), (1, 2, "user", None), (2, 0, "user", "only"), (3, None, None, "t"), (3, 1, "assistant", ""), (3, 2, "assistant", "z"), (None, 0, "user", "lone")]
    got = {r["conv_id"]: r for r in chat.digests(chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    for c in (1, 2, 3, None):
        own = [r for r in rows if r[0] == c]
        assert got[c]["n_turns"] == len(own)
        assert got[c]["turns_sha256"] == hashlib.sha256("".join(f"{r or ''}\n{t or ''}\n" for _, _, r, t in own).encode()).hexdigest()
        assert got[c]["loss_sha256"] == hashlib.sha256("".join(t for _, _, r, t in own if r == "assistant").encode()).hexdigest()
    examples = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert examples.where("target is not null").count() == 3
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def test_shards(spark, odd):
    got = sharding.shard(odd, 4).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(ODD) and {len(v) for v in slots.values()} <= {2, 3} and all(sorted(v) == list(range(len(v))) for v in slots.values())
    assert sharding.shard(odd.limit(0), 4).count() == 0


def test_communication_matrix():
    rows, shards = [13, 0, 7, 30], [13, 13, 12, 12]
    draws = np.array([sharding.communication_matrix(rows, shards, s) for s in range(400)])
    assert (draws.sum(2) == rows).all() and (draws.sum(1) == shards).all()
    assert np.allclose(draws.mean(0), np.outer(rows, shards) / 50, atol=0.5)
    assert 0 <= sharding._draw(np.random.default_rng(1), 2_000_000_000, 3_000_000_000, 1000) <= 1000


def test_nearest(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 16))
    x[100:160] = x[100]  # equal vectors: ties by id
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(5000, None), (5001, [0.0] * 16), (5002, [float("nan")] * 16), (5003, [1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {}
    for r in nearest.nearest(df, df.where("vec_id % 20 = 0"), 20).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    hit = 0
    for q in range(0, 1500, 20):
        s = x @ x[q]
        s[q] = -np.inf
        best = np.lexsort((np.arange(1500), -s))[:20]
        hit += len({v for _, v, _ in got[q]} & set(best.tolist()))
        assert all(abs(sc - float(x[q] @ x[v])) < 1e-9 for _, v, sc in got[q]) and len(got[q]) == 20
    assert hit >= 0.9 * 75 * 20
    assert nearest.nearest(df.limit(0), df, 20).count() == 0


def brute_nearest(rows, asks, k):
    """query_id -> ranking of (vec_id, score) over the distinct (id, vector) rows."""
    rows, out = sorted({(i, tuple(v)) for i, v in rows}), {}
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    for own in sorted({i for i, _ in asks}):
        qs = np.array(sorted({tuple(v) for i, v in asks if i == own}))
        score = (x @ qs.T).max(1)
        score[ids == own] = -np.inf
        best, seen = [], set()
        for at in np.lexsort((ids, -np.round(score, 9))):
            if score[at] > -np.inf and (len(qs) == 1 or ids[at] not in seen):
                seen.add(ids[at])
                best.append((int(ids[at]), round(float(score[at]), 9)))
        out[own] = best[:k]
    return out


def test_nearest_of_repeated_rows(spark):
    """Repeated rows are one, an id with several vectors has one ranking, copies under a query's own id hide no other row."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(60, 8)).round(2)
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(7, x[7].tolist())] * 25 + [(9, x[3].tolist())] * 30 + [(100 + i, x[9].tolist()) for i in range(40)]
    asks = [r for r in rows if r[0] in (7, 9, 20)]
    name = "vec_id long, embedding array<double>"
    got = {}
    for r in nearest.nearest(spark.createDataFrame(rows, name), spark.createDataFrame(asks, name), 10).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], round(r["score"], 9)))
    assert got == brute_nearest(rows, asks, 10)


@pytest.mark.parametrize("kind", ["clusters", "uneven"])
def test_nearest_searches_full_blocks(kind):
    """Blocks of 32,768 rows, where few rows are scored exactly: recall of the quantiser, not of brute force."""
    rng = np.random.default_rng(5)
    n = nearest.BLOCK_ROWS
    x = rng.normal(size=(30, 32))[rng.integers(0, 30, n)] + 0.1 * rng.normal(size=(n, 32)) if kind == "clusters" else rng.normal(size=(n, 32)) * rng.lognormal(0, 0.5, size=(n, 1))
    index, ids = nearest.Index(x[:4000]), np.arange(n)
    found = nearest.Search(index, x[:100], 20)
    found.show(ids, x, *index.encode(x), ids[:100])
    hit = 0
    for i in range(100):
        score = x @ x[i]
        score[i] = -np.inf
        hit += len(set(found.near[i].tolist()) & set(np.argsort(-score)[:20].tolist()))
    assert hit >= 0.97 * 2000 and found.exact < 0.2 * 100 * n


def test_nearest_in_several_passes(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(800, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    whole = sorted(tuple(r) for r in nearest.nearest(df, df, 5).collect())
    monkeypatch.setattr(nearest, "PASS_BYTES", 8 * 8 * 300)
    assert sorted(tuple(r) for r in nearest.nearest(df, df, 5).collect()) == whole and len(whole) == 4000


def test_licences():
    mit = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. x"
    assert licences.licences(licences.identifiers(mit)) == ["MIT"]
    assert licences.licences(licences.identifiers("Hi.\nReleased under the MIT License.\nLicensed under CC BY-NC 4.0. Bye")) == ["CC-BY-NC-4.0", "MIT"]
    assert licences.licences(["bsd.permit", "bsd.source", "bsd.binary", "bsd.endorse"]) == ["BSD-3-Clause"]
    assert licences.licences(["bsd.source", "bsd.permit", "bsd.binary"]) == [] and licences.identifiers(None) == []


WRAPPED = {
    "MIT": """MIT License

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.
""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.
""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
""",
}
WRAPPED["BSD-3-Clause"] = WRAPPED["BSD-2-Clause"] + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""


@pytest.mark.parametrize("name", sorted(WRAPPED))
def test_wrapped_licences(name):
    text = WRAPPED[name]
    for prefix in ("", "# ", " * ", "// "):
        for end in ("\n", "\r\n"):
            own = end.join(prefix + line for line in text.split("\n"))
            assert licences.licences(licences.identifiers("Notes follow" + end + own + end + "and end")) == [name]
    # A blank line or a full stop ends a sentence, and a known sentence inside a longer one is none.
    assert licences.identifiers("Released under\n\nthe MIT License\nReleased under. the MIT License\nReleased under the MIT License today") == []


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_oracle(spark, name):
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    rows = lambda f: sorted(tuple("" if v is None or v != v else str(v) for v in r) for r in f[sorted(f.columns)].itertuples(index=False, name=None))
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(con.sql(registry.SQL[name]).df())


def test_pipeline(spark, docs, tmp_path):
    now = docs
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, now, SF).write.parquet(f"file://{tmp_path}/{k}")
        before, now = now, spark.read.parquet(f"file://{tmp_path}/{k}")
        if k < 4:
            assert now.columns == docs.columns
        if k == 2:
            parts = brute_components([(r["doc_id"], r["text"]) for r in before.collect()], 5)
            assert {r["doc_id"] for r in now.collect()} == {i for i, (_, c) in parts.items() if i == c}
    assert now.where("not round_trip").count() == 0 and now.count() == before.count()
