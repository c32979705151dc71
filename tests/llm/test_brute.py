"""Operators without SQL against the plainest program that gives their rows."""

import random
from math import comb

import numpy as np
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from grove.llm import fingerprint, language, licences, sharding
from grove.llm.base import held_out

SF = "/root/testdata/sf0.001"


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def chained(*values):
    """Spark's xxhash64 over strings, longs (ints over 32 bits are given as (value, 8)) and ints."""
    seed = 42
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(8, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(4, "little", signed=True)
        seed = xxhash.xxh64_intdigest(raw, seed)
    return signed(seed)


def plain_fingerprint(text, k=5):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", text or "") if w]
    if not words:
        return ""
    hashes = {chained(*words[i : i + k]) for i in range(len(words) - k + 1)} or {chained(" ".join(words))}
    least = {}
    for h in hashes:
        b = (h >> 57) + 64
        least[b] = min(least.get(b, h), h)
    out = []
    for i in range(128):
        tries = [i] + [chained((i, 8), t) % 128 for t in range(fingerprint.PROBES)]
        found = next((least[b] for b in tries if b in least), None)
        if found is None:
            found = min((chained((i, 8), (b, 8), -1), x) for b, x in least.items())[1]
        out.append(f"{found % 256:02x}")
    return "".join(out)


def test_fingerprints_by_definition(spark):
    rng = random.Random(3)
    texts = ["", None, "one", "a b c d e", "ä ö  ü\tß x y z"] + [" ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(n)) for n in (6, 9, 30, 200, 2000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, text string").select("i", fingerprint.fingerprint(F.col("text")).alias("f")).collect()
    assert {r["i"]: r["f"] for r in rows} == {i: plain_fingerprint(t) for i, t in enumerate(texts)}


@pytest.mark.parametrize("chars", [60, 400, 8_000_000])
def test_next_of_hot_keys(spark, monkeypatch, chars):
    """Ids at both ends of the range, one id on a third of the rows, one row many times, nulls: each text's next is as by a sort."""
    monkeypatch.setattr(fingerprint, "GROUP_CHARS", chars)
    rng = random.Random(chars)
    rows = [(rng.choice([-(2**63), 2**63 - 1, 5, 5, 5, 17, 1000 + rng.randrange(50), None]), " ".join(rng.choice("xyz") * rng.randint(1, 9) for _ in range(rng.randint(0, 4)))) for _ in range(150)] + [(5, "same words")] * 60 + [(6, None)]
    got = fingerprint.fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    order = sorted(((-(2**63) if i is None else i, signed(xxhash.xxh64_intdigest((t or "").encode(), 42)) >> 32, t or "", i) for i, t in rows), key=lambda r: (r[0], r[1], r[2]))
    import hashlib

    want = []
    for (_, _, t, i), (_, _, n, _) in zip(order, order[1:] + order[:1], strict=True):
        half = len(t) // 2
        want.append((i, len(t), hashlib.sha256((t[: len(t) - half] + n[:half]).encode()).hexdigest()))
    name = lambda r: tuple(str(x) for x in r)
    # Null ids and the smallest id share a place in the order; what follows them is compared without ids.
    assert sorted(name(w[1:]) for w in want) == sorted(name((r["n_chars"], r["edited_sha256"])) for r in got)
    assert sorted(name(w) for w in want if w[0] not in (None, -(2**63))) == sorted(name((r["doc_id"], r["n_chars"], r["edited_sha256"])) for r in got if r["doc_id"] not in (None, -(2**63)))


def test_languages_by_definition(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit_dictionaries(docs, ~held_out())
    how = zstandard.ZstdCompressionParameters(window_log=17, hash_log=16, chain_log=16, search_log=3, min_match=3, strategy=2, write_content_size=0, write_checksum=0, write_dict_id=0)

    def plain(text):
        kept = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
        if not kept:
            return "und"
        raw = f" {' '.join(kept)} ".encode()
        sizes = []
        for _, content in model:
            press = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how)
            sizes.append(sum(len(press.compress(raw[at : at + 2048])) for at in range(0, len(raw), 2048)))
        return model[sizes.index(min(sizes))][0]

    got = language.identify_languages(docs.select("doc_id", "text"), model).collect()
    assert all(r["lang_pred"] == plain(r["text"]) for r in got[:150]) and len(got) == docs.count()


def test_languages_of_clashing_names_and_little_text(spark):
    docs = spark.createDataFrame([(1, "der die das", "x", 1.0, True, "de"), (2, "the of and", "y", 2.0, False, "en")], "doc_id long, text string, lang_pred string, Score double, accepted boolean, lang string")
    model = language.fit_dictionaries(docs, F.lit(True))
    assert {lang for lang, _ in model} == {"de", "en"}
    got = language.identify_languages(docs, model)
    assert got.columns == ["doc_id", "text", "lang", "lang_pred", "score", "accepted"] and [r["lang_pred"] for r in got.orderBy("doc_id").collect()] == ["de", "en"]
    assert got.where("accepted or score >= 0").count() == 2


def test_the_law_is_exact():
    for good, bad, n in ((5, 7, 4), (50, 70, 33), (300, 20, 100), (1, 5, 3), (40, 3, 42)):
        for k in range(max(0, n - bad), min(n, good) + 1):
            true = comb(good, k) * comb(bad, n - k) / comb(good + bad, n)
            assert abs(sharding._law(k, good, bad, n) - true) < 1e-12
    # Two partitions of two rows, two shards of two: of the six ways one keeps both rows in place, four move one.
    draws = [sharding.communication_matrix([2, 2], [2, 2], s)[0][0] for s in range(6000)]
    assert np.allclose(np.bincount(draws, minlength=3) / 6000, [1 / 6, 4 / 6, 1 / 6], atol=0.02)
    rng = np.random.default_rng(2)
    large = [sharding._draw(rng, 2_000_000_000, 46_000_000_000, 200_000) for _ in range(400)]
    assert abs(np.mean(large) - 200_000 / 24) < 20 and 80 < np.std(large) < 100


def test_shards_of_hot_rows_and_clashing_names(spark):
    rows = [(7, "same", 1, 2, 3)] * 900 + [(i, "x", 1, 2, 3) for i in range(600)] + [(7, f"text {i}", 1, 2, 3) for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, part int, Shard int, bounds int")
    got = sharding.shard(docs, 7).collect()
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert len(got) == len(rows) and sorted(map(len, slots.values())) == [257, 257, 257, 257, 257, 257, 258]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and all(r["part"] == 1 and r["bounds"] == 3 for r in got)
    same = [sum(r["text"] == "same" for r in got if r["shard"] == s) for s in range(7)]
    assert min(same) > 90 and max(same) < 170


def test_licence_rules_are_ordered():
    both = ["bsd.permit", "bsd.source", "bsd.binary", "bsd.endorse", "bsd.permit", "bsd.source", "bsd.binary"]
    assert licences.licences(both) == ["BSD-2-Clause", "BSD-3-Clause"] and licences.licences(both[:4]) == ["BSD-3-Clause"]
    assert licences.licences(["gpl2.free", "gpl.hope"]) == ["GPL-2.0-or-later"] and licences.licences(["gpl.hope"]) == []
    notice = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    assert licences.licences(licences.identifiers(notice)) == ["MPL-2.0"]
    assert {name for name, _ in licences.RULES} >= {"MIT", "ISC", "Zlib", "CC0-1.0", "AGPL-3.0-or-later", "Unlicense"}
