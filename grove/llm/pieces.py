"""SentencePiece encoding and decoding by a streaming Viterbi pass.

A BPE model's encoding of a text is the one path through the lattice of its pieces on which every two neighbouring pieces
encode to themselves; every prefix of the text has exactly one such path, found from the paths of shorter prefixes. So
the pass keeps, for the last longest-piece positions only, the surviving path's last piece, and commits ids as soon as all
surviving backpointer paths run through one boundary. Unigram models weigh the same lattice by their pieces' scores.
"""

from __future__ import annotations

import math
import re
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grove.llm.base import slices, table

SPACE = "▁"
#: Segments that a worker remembers, and the longest that is remembered.
REMEMBERED, LONGEST = 400_000, 64
#: A character outside the vocabulary scores a unigram path this much less than the worst piece (fixed value).
UNKNOWN_PENALTY = 10.0
_NORMAL, _UNKNOWN, _BYTE = 1, 2, 6
START, ALONE = 1 << 19, 1 << 19 | 1


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class _Memo(dict):
    """Packed ids of segments. When half of the room is taken, what was not asked for since the time before goes."""

    def __init__(self, make):
        self.make, self.older = make, {}

    def __missing__(self, segment: str) -> bytes:
        found = self.older.get(segment)
        if found is None:
            found = array("i", self.make(segment)).tobytes()
        if len(segment) <= LONGEST:
            if len(self) >= REMEMBERED // 2:
                self.older = dict(self)
                self.clear()
            self[segment] = found
        return found


class PieceModel:
    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2

        m = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            m.ParseFromString(f.read())
        if m.normalizer_spec.precompiled_charsmap or m.normalizer_spec.remove_extra_whitespaces:
            raise ValueError("only models with identity normalisation are supported")
        self.bpe, self.dummy = m.trainer_spec.model_type == 2, m.normalizer_spec.add_dummy_prefix
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type == _NORMAL}
        self.score = {p.piece: p.score for p in m.pieces if p.type == _NORMAL}
        self.byte = {int(p.piece[3:5], 16): i for i, p in enumerate(m.pieces) if p.type == _BYTE}
        self.unknown = next(i for i, p in enumerate(m.pieces) if p.type == _UNKNOWN)
        self.longest = max(map(len, self.ids))
        self.outside = min(self.score.values()) - UNKNOWN_PENALTY
        raw = [p.piece.replace(SPACE, " ").encode() if p.type == _NORMAL else b"" for p in m.pieces]
        for b, i in self.byte.items():
            raw[i] = bytes([b])
        self.raw = pa.array(raw, pa.binary())
        # Where no piece has the space mark behind another character, every path passes the place before a run of marks;
        # so it does between a letter and a mark that no piece has side by side.
        # Without byte pieces a run of unknown characters is one id, which no cut may split.
        self.cuts = bool(self.byte) and not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        inside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        letters = "a-zA-ZÀ-ÖØ-öø-ÿ"
        ends = "".join(c for c in "!\"#$%&()*+,./:;<=>?@[]^_`{|}~0123456789" if not any(re.match(f"[{letters}]", x) and x[1] == c for x in inside))
        word = f"{SPACE}*+[{letters}]++(?=[{re.escape(ends)}])|" if ends else ""
        self.segment = re.compile(f"{word}{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.pairs: dict[int, bool] = {}
        self.spines: dict[str, tuple | None] = {}
        self.names, self.length, self.points = [p.piece for p in m.pieces], [len(p.piece) for p in m.pieces], [p.score for p in m.pieces]
        self.automaton = ahocorasick.Automaton()
        for name, i in self.ids.items():
            self.automaton.add_word(name, i)
        self.automaton.make_automaton()
        self.memo = _Memo(self.viterbi)

    def _spines(self, piece: str) -> tuple[list, list] | None:
        """For a piece that encodes to itself: the pieces at its left and at its right edge while it is merged from
        characters, each with the score of the merge that ends it. None for pieces that merging never makes."""
        if piece not in self.spines:
            parts, score = list(piece), self.score
            left, right = [], []
            while len(parts) > 1:
                best, at = None, -1
                for i in range(len(parts) - 1):
                    s = score.get(parts[i] + parts[i + 1])
                    if s is not None and (best is None or s > best):
                        best, at = s, i
                if best is None:
                    break
                if at == 0:
                    left.append((parts[0], best))
                if at == len(parts) - 2:
                    right.append((parts[-1], best))
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            ends = [(piece, -math.inf)]
            self.spines[piece] = (left + ends, right + ends) if len(parts) == 1 else None
        return self.spines[piece]

    def _joins(self, before: int, piece: int) -> bool:
        """Whether a path that ends with `before` goes on with the piece; remembered."""
        name = self.names[piece]
        ok = self._spines(name) is not None and (before in (START, ALONE) or self._follows(self.names[before], name))
        if len(self.pairs) > 400_000:
            self.pairs.clear()
        self.pairs[before << 20 | piece] = ok
        return ok

    def _follows(self, a: str, b: str) -> bool:
        """Whether a and b encode to themselves side by side: no merge across their border comes before those that make them.

        Of equal scores the merge further left comes first: those inside a before the border's, the border's before those inside b.
        """
        xs, ys, i, j = self.spines[a][1], self.spines[b][0], 0, 0
        while True:
            (x, px), (y, py) = xs[i], ys[j]
            across = self.score.get(x + y)
            if across is not None and across > px and across >= py:
                return False
            if px == py == -math.inf:
                return True
            if px >= py:
                i += 1
            else:
                j += 1

    def viterbi(self, text: str) -> list[int]:
        """ids of a stretch that every path starts and ends with. Memory: the window and what is not committed yet.

        The automaton names the pieces that end at each place, the longest first.
        """
        bpe, pairs, length, far = self.bpe, self.pairs, self.length, 4 * self.longest
        # By place behind `done`: the surviving path's last piece (START, ALONE: a character outside the vocabulary), its
        # start and, of unigram models, its score.
        last, back, cost = [START], [0], [0.0]
        out: list[int] = []
        done, at, check = 0, 0, far
        for end, piece in self.automaton.iter(text):
            end += 1
            if end == at and bpe:
                continue
            if at >= check and end > at:
                done, check = self._commit(text, last, back, cost, done, out), at + far
            while at < end - 1:
                at, done, check = self._alone(text, last, back, cost, at, done, check, out)
            start = end - length[piece]
            if start < done:
                continue
            before = last[start - done]
            if bpe:
                if (ok := pairs.get(before << 20 | piece)) is None:
                    ok = self._joins(before, piece)
                if ok:
                    last.append(piece)
                    back.append(start)
                    at = end
            else:
                total = cost[start - done] + self.points[piece]
                if at < end:
                    # The place may be reached past a single unknown character too.
                    alone = -math.inf if text[at] in self.ids else cost[-1] + self.outside
                    ends_alone = alone > total
                    last.append(ALONE if ends_alone else piece), back.append(at if ends_alone else start), cost.append(max(alone, total))
                    at = end
                elif total > cost[-1] or total == cost[-1] and last[-1] == ALONE:
                    last[-1], back[-1], cost[-1] = piece, start, total
        while at < len(text):
            at, done, check = self._alone(text, last, back, cost, at, done, check, out)
        self._path(text, last, back, done, at, out)
        return out

    def _alone(self, text: str, last: list, back: list, cost: list, at: int, done: int, check: int, out: list[int]) -> tuple[int, int, int]:
        """Takes the character behind `at`, at which no piece ends, by itself; commits as the pass does. The new at, done, check."""
        if at >= check:
            done, check = self._commit(text, last, back, cost, done, out), at + 4 * self.longest
        last.append(ALONE), back.append(at)
        if not self.bpe:
            cost.append(cost[-1] + self.outside)
        return at + 1, done, check

    def _path(self, text: str, last: list, back: list, done: int, at: int, out: list[int]) -> None:
        """Appends the ids of the path from done to at."""
        path = []
        while at > done:
            start, piece = back[at - done], last[at - done]
            if piece != ALONE:
                path.append(piece)
            elif self.byte:
                path.extend(self.byte[b] for b in reversed(text[start:at].encode()))
            elif path[-1:] != [self.unknown]:
                path.append(self.unknown)
            at = start
        if path[-1:] == out[-1:] == [self.unknown]:
            path.pop()
        path.reverse()
        out += path

    def _commit(self, text: str, last: list, back: list, cost: list, done: int, out: list[int]) -> int:
        """Emits and forgets what all surviving paths share; the boundary that they share, done if there is none further on."""
        end = done + len(last) - 1
        heads = set(range(max(done, end - self.longest + 1), end + 1))
        while len(heads) > 1:
            top = max(heads)
            heads.remove(top)
            heads.add(back[top - done])
        (meet,) = heads
        self._path(text, last, back, done, meet, out)
        for places in (last, back, cost):
            del places[: meet - done]
        return meet

    def prepared(self, text: str) -> str:
        return (SPACE if self.dummy else "") + text.replace(" ", SPACE) if text else ""

    def packed(self, text: str | None) -> bytes:
        """The ids as consecutive 32-bit integers."""
        ready = self.prepared(text or "")
        parts = self.segment.findall(ready) if self.cuts else [ready] if ready else []
        return b"".join(map(self.memo.__getitem__, parts))

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.packed(text), np.int32).tolist()

    def decode(self, ids) -> str:
        taken = self.raw.take(pa.array(ids, pa.int32()))
        _, ends, held = taken.buffers()
        text = held.slice(0, np.frombuffer(ends, np.int32)[len(taken)]).to_pybytes().decode("utf-8", "replace") if len(taken) and held else ""
        return text[1:] if self.dummy and text[:1] == " " else text


_LOADED: dict[str, PieceModel] = {}


def load(path: str) -> PieceModel:
    """The worker's own copy of the model."""
    if path not in _LOADED:
        _LOADED[path] = PieceModel(path)
    return _LOADED[path]


def encode_documents(docs: DataFrame, model: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_ids, ids, round_trip for every row: the whole text's ids and whether decoding them gives it back.

    model: path of a SentencePiece model, present on every machine. Null and empty texts have no ids. A text that itself
    holds the space mark decodes to spaces there, and round_trip says so. Repeated rows get equal ids; empty tables none.
    Other columns of docs are not read.
    """
    path = model or default_model()

    def run(batches):
        pieces = load(path)
        for batch in slices(batches):
            part = batch.column(1).to_pylist()
            found = [np.frombuffer(pieces.packed(t), np.int32) for t in part]
            n = np.array([len(f) for f in found], np.int64)
            ids = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.concatenate(found), pa.int32()))
            same = [pieces.decode(f) == (t or "") for f, t in zip(found, part, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), ids, pa.array(same, pa.bool_())], ["doc_id", "n_ids", "ids", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n_ids long, ids array<int>, round_trip boolean")


def decode_documents(encoded: DataFrame, model: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids. Null ids give the empty text, nulls among them nothing; unknown numbers raise."""
    path = model or default_model()

    def run(batches):
        pieces = load(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([pieces.decode(i or []) for i in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, text string")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))
