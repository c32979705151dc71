"""Toxicity by a weighted finite-state grammar over clauses.

A lexicon maps a clause's tokens to classes (insult, threat, target, negation, reported speech, ...). Six sequential
transducers then rewrite the clause, each with a state table of its own: insult and threat mark hostile symbols, two target
transducers mark those with a target shortly before or (reading from the right) behind them, negation and reported speech
mark those in their reach. Composition makes one table of all that read from the left, with only the states that can be
reached, merged where they cannot be told apart; the marks of a hostile symbol name the pattern whose weight it carries. A
document's score is the logistic of the summed weights of its matched clauses; a word outside the lexicons never counts.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm.base import Scratch, held_out, slices, table

#: Input classes. TARGET counts on both sides of a hostile word, LEADING (a German pronoun that is a French article) only before it.
OTHER, INSULT, THREAT, TARGET, LEADING, NEGATION, REPORT = range(7)
CLASSES = 7
#: The grammar's own lexicons; learning adds hostile words and stems of the corpus's languages.
LEXICON = {
    INSULT: "idiot idiots moron morons imbecile scum trash loser losers pathetic worthless disgusting stupid clown dumbass bastard crétin abruti connard imbécile dummkopf abschaum vollidiot versager imbécil estúpido escoria",
    THREAT: "kill destroy hurt punish stab strangle tuer détruire frapper töten umbringen vernichten matar destruir",
    TARGET: "you your yours he she they him her them u tu vous toi t' ihr euch dich sie usted ustedes ellos vosotros",
    LEADING: "du",
    NEGATION: "not never no cannot cant dont doesnt didnt isnt wont nobody neither nor without pas jamais ne n' sans aucun kein keine keinen nicht nie niemals ohne nunca jamás ni sin ningún",
    REPORT: "said says called calls wrote quoted allegedly reportedly dit écrit sagte nannte schrieb dijo llamó escribió",
}
#: Rows and characters that the fit samples, at most about so many; lengths of learned stems; least toxic rows and least
#: precision of a learned entry.
FIT_ROWS, FIT_CHARS, STEMS, LEAST_ROWS, LEAST_PRECISION = 20_000, 200_000_000, (3, 4, 5, 6, 7), 3, 0.9
#: A candidate that adds no row is learned too if it stands in this share of the toxic texts, copies counted once.
COMMON = 0.01
#: Tokens after which an open negation, report or target lapses.
REACH = 4
#: Log odds of a document without matches, and the weights of a pattern before any evidence: (negated, reported, aimed at a target).
BIAS = -4.0
PRIOR = {(n, r, t): 6.0 + (1.0 if t else 0.0) - (4.0 if n else 0.0) - (2.0 if r else 0.0) for n in (0, 1) for r in (0, 1) for t in (0, 1)}
#: A threat counts only when it is aimed at someone.
THREAT_WEIGHT = {k: (PRIOR[k] - 2.0 if k[2] else 0.0) for k in PRIOR}
#: Rows that a learned pattern weight is worth against its prior.
PRIOR_ROWS = 20

#: A symbol is class | marks: hostile by insult or threat, negated, reported, aimed.
BY_INSULT, BY_THREAT, NEGATED, REPORTED, AIMED = 8, 16, 32, 64, 128
HOSTILE = BY_INSULT | BY_THREAT

_CLAUSE = re.compile(r"[.!?;:\n]+")
#: Words; French elisions (l'idiot, t'es) come apart.
_TOKEN = re.compile(r"(?:[ldjnstmc]|qu)'(?=[^\W\d_]{2})|[^\W\d_]+(?:'[^\W\d_]+)?")


def lowered(text: str | None) -> str:
    return (text or "").lower().replace("’", "'")


def tokens(text: str | None) -> list[str]:
    return _TOKEN.findall(lowered(text))


class Transducer:
    """A sequential transducer: from state and symbol to the next state and one symbol. It starts in state 0."""

    def __init__(self, step, alphabet):
        """step(state, symbol) gives (next state, symbol); states are any hashable values, 0 the first."""
        self.alphabet, number, todo, table = sorted(alphabet), {0: 0}, [0], []
        while todo:
            state, row = todo.pop(0), {}
            for a in self.alphabet:
                to, out = step(state, a)
                if to not in number:
                    number[to] = len(number)
                    todo.append(to)
                row[a] = (number[to], out)
            table.append(row)
        self.table = table

    def outputs(self) -> set[int]:
        return {out for row in self.table for _, out in row.values()}

    def then(self, other: Transducer) -> Transducer:
        """The composition: other reads what this one writes."""

        def step(state, a):
            s, t = state or (0, 0)
            s, mid = self.table[s][a]
            t, out = other.table[t][mid]
            return ((s, t) if s or t else 0), out

        return Transducer(step, self.alphabet)

    def minimal(self) -> Transducer:
        """The same mapping with states merged that no input tells apart, by partition refinement."""
        kind = [0] * len(self.table)
        while True:
            names, then = {}, []
            for row, k in zip(self.table, kind, strict=True):
                then.append(names.setdefault((k, tuple((kind[row[a][0]], row[a][1]) for a in self.alphabet)), len(names)))
            if len(names) == len(set(kind)):
                break
            kind = then
        of = {k: row for row, k in zip(reversed(self.table), reversed(kind), strict=True)}
        first = kind[0]
        # The first state keeps the name 0.
        swap = lambda k: 0 if k == first else k + 1
        back = {swap(k): k for k in of}
        return Transducer(lambda s, a: (swap(kind[of[back[s]][a][0]]), of[back[s]][a][1]), self.alphabet)

    def run(self, symbols: list[int]) -> list[int]:
        state, out, table = 0, [], self.table
        for a in symbols:
            state, b = table[state][a]
            out.append(b)
        return out


def _hostile(own: int, mark: int, alphabet) -> Transducer:
    """Marks the symbols of a hostile class."""
    return Transducer(lambda s, a: (0, a | mark if a & 7 == own else a), alphabet)


def _within(opens: set[int], reach: int, mark: int, alphabet) -> Transducer:
    """Marks hostile symbols at most `reach` tokens behind one of the opening classes; the state counts what is left."""

    def step(left, a):
        if a & 7 in opens:
            return reach, a
        return max(0, left - 1), (a | mark if left and a & HOSTILE else a)

    return Transducer(step, alphabet)


@lru_cache(1)
def parts() -> tuple[Transducer, list[Transducer]]:
    """The transducer that reads from the right (targets ahead), and those that then read from the left, in order.

    A hostile mark comes first, so that the later ones need not know the classes."""
    classes = set(range(CLASSES))
    ahead = _hostile(INSULT, BY_INSULT, classes)
    ahead = ahead.then(_hostile(THREAT, BY_THREAT, ahead.outputs()))
    ahead = ahead.then(_within({TARGET}, REACH, AIMED, ahead.outputs()))
    rest, alphabet = [], ahead.outputs()
    for opens, reach, mark in (({TARGET, LEADING}, REACH, AIMED), ({NEGATION}, REACH, NEGATED), ({REPORT}, 2 * REACH, REPORTED)):
        rest.append(_within(opens, reach, mark, alphabet))
        alphabet = alphabet | rest[-1].outputs()
    return ahead, rest


@lru_cache(1)
def composed() -> tuple[Transducer, Transducer]:
    """The composition of all parts: one table that reads from the right, one that reads its output from the left."""
    ahead, (one, *more) = parts()
    for t in more:
        one = one.then(t)
    return ahead.minimal(), one.minimal()


class Grammar:
    """The lexicon, the composed transducers and the weights. stems: learned entries that count as insults: prefixes, or
    whole words with a leading '='."""

    def __init__(self, stems: list[str] = (), weights: dict | None = None):
        words = {w: kind for kind, ws in LEXICON.items() for w in ws.split()}
        words.update({s[1:]: INSULT for s in stems if s[0] == "="})
        prefixes = sorted({s for s in stems if s[0] != "="}, key=lambda s: (len(s), s))
        self.weights = {INSULT: dict(PRIOR), THREAT: dict(THREAT_WEIGHT)}
        self.weights[INSULT].update(weights or {})
        self.words, self.prefixes = words, tuple(prefixes)
        any_ = [re.escape(w) + r"(?![^\W\d_])" for w, k in words.items() if k in (INSULT, THREAT)] + [re.escape(p) for p in prefixes]
        self.hostile = re.compile(r"(?<![^\W\d_])(?:" + "|".join(any_) + ")")
        self.ahead, self.rest = composed()

    def kind(self, word: str) -> int:
        if (k := self.words.get(word)) is not None:
            return k
        if word.endswith("n't"):
            return NEGATION
        return INSULT if self.prefixes and word.startswith(self.prefixes) else OTHER

    def clause(self, words: list[str]) -> list[tuple[int, tuple[int, int, int]]]:
        """The patterns that the automaton emits over one clause: (insult or threat, (negated, reported, aimed))."""
        symbols = self.rest.run(self.ahead.run([self.kind(w) for w in reversed(words)])[::-1])
        return [(INSULT if s & BY_INSULT else THREAT, (int(s & NEGATED > 0), int(s & REPORTED > 0), int(s & AIMED > 0))) for s in symbols if s & HOSTILE]

    def patterns(self, text: str | None) -> list[tuple[int, tuple[int, int, int]]]:
        """The whole text's patterns; clauses without a hostile token are left at the first look."""
        low = lowered(text)
        if not self.hostile.search(low):
            return []
        return [p for clause in _CLAUSE.split(low) if self.hostile.search(clause) for p in self.clause(_TOKEN.findall(clause))]

    def score(self, text: str | None) -> float:
        total = BIAS + sum(self.weights[k][p] for k, p in self.patterns(text))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, total))))


def _entries(text: str | None) -> tuple[set[str], set[str]]:
    """The words of a text, and the entries that could name them: whole words and stems."""
    words = set(tokens(text))
    return words, {"=" + w for w in words} | {w[:k] for w in words for k in STEMS if len(w) > k}


def _sampled(docs: DataFrame, labels: DataFrame, usable: Column, rows: int, chars: int, scratch: Scratch) -> DataFrame:
    """id, text, toxic: a written sample of labelled texts of about `rows` ids and `chars` characters at most."""
    kept = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & usable).groupBy(F.col("doc_id").cast("long").alias("id")).agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    n = kept.count()
    point = lambda *c: F.pmod(F.xxhash64(*c, F.lit(5)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    # About `rows` ids of two numbers each, whatever the corpus holds, so the texts need not travel to meet them.
    ids = F.broadcast(kept.where(point("id") < rows / max(n, 1)))
    own = docs.where(usable & F.col("text").isNotNull()).select(F.col("doc_id").cast("long").alias("id"), "text").join(ids, "id")
    out = scratch.keep(own, "labelled")
    held, long_ = out.agg(F.count(F.lit(1)), F.sum(F.length("text"))).first()
    share = min(1.0, 2 * rows / max(held, 1), chars / max(long_ or 0, 1))
    # Ids that stand on many rows, or very long texts, are thinned by the row's own hash.
    return out if share == 1.0 else out.where(point("id", F.xxhash64("text")) < share)


def fit_grammar(docs: DataFrame, labels: DataFrame, usable: Column, rows: int = FIT_ROWS, chars: int = FIT_CHARS) -> Grammar:
    """Learns hostile words and stems, and the pattern weights, from a bounded sample of labelled rows.

    The sample: about `rows` of the labelled ids, picked by the id's hash, and about `chars` characters at most; it never
    grows with the corpus. An id with several labels is toxic if one says so; null labels, ids and texts take no part, and
    without labelled rows the grammar's own lexicons stand alone. A word or stem is a candidate if LEAST_ROWS toxic rows
    hold it with LEAST_PRECISION; from the candidates those are taken, one by one, that explain most of the toxic rows not
    explained so far, so that the chance words of a much-copied toxic document, which its real insult explains already, add
    nothing; then those that many different toxic texts hold. Every candidate is weighed, and the sample bounds their number.
    """
    scratch = Scratch(docs.sparkSession)
    sample = _sampled(docs, labels, usable, rows, chars, scratch)

    def features(batches):
        for batch in slices(batches, 50):
            stems, n, toxic = [], [], []
            for _, text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                found = _entries(text)[1]
                toxic += [label] * len(found)
                stems += found
            yield pa.RecordBatch.from_arrays([pa.array(stems, pa.string()), pa.array(toxic, pa.int32())], ["stem", "toxic"])

    counts = sample.mapInArrow(features, "stem string, toxic int").groupBy("stem").agg(F.sum("toxic").alias("pos"), F.count(F.lit(1)).alias("n"))
    base = {r["stem"]: (r["pos"], r["n"]) for r in counts.where((F.col("pos") >= LEAST_ROWS) & (F.col("pos") >= LEAST_PRECISION * F.col("n"))).collect()}
    names = sorted(base)
    number = {s: i for i, s in enumerate(names)}

    def only(batches):
        for batch in slices(batches, 200):
            found, least = [], []
            for _, text, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                words, entries = _entries(text)
                found.append(sorted(number[e] for e in entries if e in number))
                least.append(min((zlib.crc32(w.encode()) for w in words), default=0))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), pa.array(least, pa.int64())], ["stems", "least"])

    # Toxic rows only, as numbers of candidates; copies come once, with their number. The sample's characters bound both.
    found = sample.where("toxic = 1").mapInArrow(only, "stems array<int>, least long").groupBy("stems", "least").agg(F.count(F.lit(1)).alias("copies"))
    held = sorted((frozenset(r["stems"]), r["least"], r["copies"]) for r in found.collect()) if names else []
    chosen = _chosen(held, names, base)
    plain = Grammar(chosen)

    def alone(batches):
        for batch in slices(batches, 200):
            out = []
            for _, text, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if len(kinds := set(plain.patterns(text))) == 1 and (one := kinds.pop())[0] == INSULT:
                    out.append((*one[1], label))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.int32()) for i in range(4)], ["n", "r", "t", "toxic"])

    seen = sample.mapInArrow(alone, "n int, r int, t int, toxic int").groupBy("n", "r", "t", "toxic").count().collect()
    evidence = Counter({((r["n"], r["r"], r["t"]), r["toxic"]): r["count"] for r in seen})
    scratch.end()
    weights = {}
    for p, prior in PRIOR.items():
        share = 1 / (1 + math.exp(-(prior + BIAS)))
        pos, neg = evidence[p, 1] + PRIOR_ROWS * share, evidence[p, 0] + PRIOR_ROWS * (1 - share)
        weights[p] = math.log(pos / neg) - BIAS
    return Grammar(chosen, weights)


def _chosen(held: list[tuple], names: list[str], base: dict[str, tuple[int, int]]) -> list[str]:
    """The learned entries from (candidates' numbers, the text's mark, copies) of the toxic rows."""
    rest, chosen, gain = [(s, n) for s, _, n in held], [], Counter()
    total = max(sum(n for _, n in rest), 1)
    for s, n in rest:
        for x in s:
            gain[x] += n
    while rest:
        # Of stems that explain equally much the whole word comes first, then the longer stem.
        top = max(gain, key=lambda x: (gain[x] * base[names[x]][0] / base[names[x]][1], names[x][0] == "=", len(names[x]), names[x]), default=None)
        if top is None or gain[top] < max(LEAST_ROWS / 2, 0.002 * total):
            break
        chosen.append(names[top])
        for s, n in rest:
            if top in s:
                for x in s:
                    gain[x] -= n
        rest = [(s, n) for s, n in rest if top not in s]
    apart: dict[int, set] = {}
    for s, group, _ in held:
        for x in s:
            apart.setdefault(x, set()).add(group)
    least = max(2 * LEAST_ROWS, COMMON * len({h[1] for h in held}))
    own = [w for k in (INSULT, THREAT) for w in LEXICON[k].split()]
    for x in sorted(apart, key=lambda x: (-len(apart[x]), -len(names[x]), names[x])):
        known, word = [c.lstrip("=") for c in chosen] + own, names[x].lstrip("=")
        if len(apart[x]) >= least and base[names[x]][0] >= 0.995 * base[names[x]][1] and not any(word.startswith(c) or c.startswith(word) for c in known):
            chosen.append(names[x])
    return chosen


def score_toxicity(docs: DataFrame, grammar: Grammar, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """Every row of docs with a score from 0 to 1 over its whole text; null and empty texts get that of no match.

    Rows are independent: repeats get equal scores, an empty table none. A column of docs named like score_col, in any
    case, gives way to the score.
    """
    from pyspark.sql.types import DoubleType, StructField, StructType

    names = [c for c in docs.columns if c.lower() != score_col.lower()]
    rows = docs.select(*[F.col(f"`{c}`") for c in names], F.col(f"`{text_col}`").alias("_text_to_score"))
    stems, weights = ["=" + w for w, k in grammar.words.items() if k == INSULT] + list(grammar.prefixes), grammar.weights[INSULT]

    def run(batches):
        own = Grammar(stems, weights)
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([own.score(t) for t in batch.columns[-1].to_pylist()], pa.float64())], [*names, score_col])

    return rows.mapInArrow(run, StructType([*[docs.schema[c] for c in names], StructField(score_col, DoubleType())]))


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    grammar = fit_grammar(docs, table(spark, sf_dir, "labels"), ~held_out())
    scored = score_toxicity(docs.select("doc_id", "text", held_out().alias("held_out")), grammar)
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
