"""Byte-level BPE encoding and decoding by a table of ranks.

Vectorised pre-tokenisation. Code points are mapped to classes by one lookup, classes
and their next neighbours to symbols, and the boundaries of the pattern's matches are
the outputs of a small automaton over the symbols. Its transition functions compose
associatively: the closure of the symbols' functions under composition is a small
monoid, so a batch of texts is scanned in blocks (prefix compositions within a block,
then over the blocks' totals, then joined), each step one table lookup over all blocks.
No regular expression runs. The slices feed pair merging, cached per pre-token; the
offsets of the slices are returned with the ids.

Pattern of the pre-tokens: one of 's 't 're 've 'm 'll 'd where a match starts at the
apostrophe; letters, numbers or other marks, each with one space in front if there is
one; white space up to its last character before a non-space; white space.

Defined cases: null is the empty text, with no ids; texts of any length are encoded
whole (long pre-tokens by a heap of pairs); equal texts have equal ids; an empty table
gives an empty table; input columns named like a result column give way to it.
"""

from __future__ import annotations

import base64
import heapq
import sys
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalkit.llm.common import per_worker, spans, with_columns

#: Classes of code points.
LETTER, NUMBER, SPACE, OTHER_SPACE, APOSTROPHE, MARK = range(6)
#: Symbols: a class with what follows it. JOIN: a space before a non-space; LAST: another
#: white-space character before a non-space; RUN: white space before white space or the end.
S_LETTER, S_NUMBER, S_MARK, S_SHORT, S_LONG, S_RUN, S_JOIN, S_LAST = range(8)
N_SYMBOLS = 8
#: States: what came before.
START, IN_LETTERS, IN_NUMBERS, IN_MARKS, JOINED, IN_RUN, TWO_LEFT, ONE_LEFT = range(8)
N_STATES = 8
BLOCK = 256
#: White space of the pattern (fixed values).
WHITE_SPACE = [*range(0x09, 0x0E), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B),
               0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Pre-tokens whose ids a worker keeps, and the longest (code points) that it keeps.
KEPT, KEPT_CHARS = 300_000, 48
#: Up to this many bytes pairs are searched in order; beyond it a heap holds them.
SHORT_PIECE = 96


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after ``symbol`` and whether a pre-token starts at it."""
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return START, False
    if symbol in (S_SHORT, S_LONG):
        if state in (IN_MARKS, JOINED):
            return IN_MARKS, False
        return (ONE_LEFT if symbol == S_SHORT else TWO_LEFT), True
    if symbol == S_RUN:
        return IN_RUN, state != IN_RUN
    if symbol == S_JOIN:
        return JOINED, True
    if symbol == S_LAST:
        return START, True
    inside = {S_LETTER: IN_LETTERS, S_NUMBER: IN_NUMBERS, S_MARK: IN_MARKS}[symbol]
    return inside, state not in (inside, JOINED)


class Boundaries:
    """Starts of the pre-tokens of a batch of texts."""

    def __init__(self):
        chars = np.full(sys.maxunicode + 1, MARK, np.uint8)
        for c in range(sys.maxunicode + 1):
            k = unicodedata.category(chr(c))[0]
            if k == "L":
                chars[c] = LETTER
            elif k == "N":
                chars[c] = NUMBER
        chars[WHITE_SPACE] = OTHER_SPACE
        chars[0x20], chars[0x27] = SPACE, APOSTROPHE
        self.classes = chars
        # symbols N_SYMBOLS.. are the same symbols at the start of a text: they forget the state
        base = [tuple(step(q, s)[0] for q in range(N_STATES)) for s in range(N_SYMBOLS)]
        maps = base + [(f[START],) * N_STATES for f in base]
        elements = {tuple(range(N_STATES)): 0}
        todo = list(elements)
        while todo:  # closure of the symbols' functions under composition
            f = todo.pop()
            for g in maps:
                h = tuple(g[x] for x in f)
                if h not in elements:
                    elements[h] = len(elements)
                    todo.append(h)
        fs = list(elements)
        self.n = len(fs)
        self.of_symbol = np.array([elements[f] for f in maps], np.uint16)
        self.compose = np.array([elements[tuple(g[x] for x in f)] for f in fs for g in fs], np.uint16)
        self.from_start = np.array([f[START] for f in fs], np.uint8)
        self.starts = np.array([[step(q, s)[1] for s in range(N_SYMBOLS)] for q in range(N_STATES)]).ravel()

    def _exclusive(self, f: np.ndarray) -> np.ndarray:
        """For each element the composition of all before it (an associative scan in blocks)."""
        n = len(f)
        rows = -(-n // BLOCK)
        x = np.zeros(rows * BLOCK, np.uint16)
        x[:n] = f
        x = np.ascontiguousarray(x.reshape(rows, BLOCK).T)
        before = np.empty((BLOCK, rows), np.uint16)
        acc = np.zeros(rows, np.uint16)
        for j in range(BLOCK):
            before[j] = acc
            acc = self.compose[acc.astype(np.int32) * self.n + x[j]]
        if rows > 1:
            carry = self._exclusive(acc) if rows > BLOCK else self._sequential(acc)
            before = self.compose[carry.astype(np.int32) * self.n + before]
        return before.T.ravel()[:n]

    def _sequential(self, f: np.ndarray) -> np.ndarray:
        out, acc = np.empty(len(f), np.uint16), 0
        for i, g in enumerate(f.tolist()):
            out[i] = acc
            acc = int(self.compose[acc * self.n + g])
        return out

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Positions of all starts in the texts put end to end, and where each text starts."""
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        begins = ends - lengths
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        n = len(points)
        if not n:
            return np.empty(0, np.int64), begins
        c = self.classes[points]
        last = np.zeros(n, bool)
        last[ends[lengths > 0] - 1] = True
        white = (c == SPACE) | (c == OTHER_SPACE)
        before_mark = np.zeros(n, bool)  # a non-space of the same text follows
        before_mark[:-1] = ~white[1:]
        before_mark &= ~last
        symbol = np.array([S_LETTER, S_NUMBER, S_RUN, S_RUN, S_MARK, S_MARK], np.uint8)[c]
        symbol[(c == SPACE) & before_mark] = S_JOIN
        symbol[(c == OTHER_SPACE) & before_mark] = S_LAST
        at = np.flatnonzero(c == APOSTROPHE)
        if len(at):
            text_end = ends[np.searchsorted(ends, at, "right")]
            p1 = points[np.minimum(at + 1, n - 1)] * (at + 1 < text_end)
            p2 = points[np.minimum(at + 2, n - 1)] * (at + 2 < text_end)
            short = np.isin(p1, [ord(x) for x in "stmd"])
            long = ((p2 == ord("e")) & ((p1 == ord("r")) | (p1 == ord("v")))) | ((p1 == ord("l")) & (p2 == ord("l")))
            symbol[at[short]], symbol[at[long]] = S_SHORT, S_LONG
        f = symbol.copy()
        f[begins[lengths > 0]] += N_SYMBOLS
        state = self.from_start[self._exclusive(self.of_symbol[f])]
        state[begins[lengths > 0]] = START
        return np.flatnonzero(self.starts[state * N_SYMBOLS + symbol]), begins


class ByteBpe:
    """Encoder and decoder over a file of ranks (base64 token, rank)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        self.boundaries = per_worker(("boundaries",), Boundaries)
        self.known: dict[str, bytes] = {}  # packed ids

    def merge(self, piece: bytes) -> list[int]:
        """Ids of one pre-token: the pair of lowest rank merges first, leftmost on ties."""
        ranks = self.ranks
        if piece in ranks:
            return [ranks[piece]]
        if len(piece) > SHORT_PIECE:
            return self._merge_long(piece)
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pairs = [ranks.get(a + b, sys.maxsize) for a, b in zip(parts, parts[1:])]
        while pairs:
            low = min(pairs)
            if low == sys.maxsize:
                break
            i = pairs.index(low)
            parts[i:i + 2] = [parts[i] + parts[i + 1]]
            del pairs[i]
            if i:
                pairs[i - 1] = ranks.get(parts[i - 1] + parts[i], sys.maxsize)
            if i < len(pairs):
                pairs[i] = ranks.get(parts[i] + parts[i + 1], sys.maxsize)
        return [ranks[p] for p in parts]

    def _merge_long(self, piece: bytes) -> list[int]:
        ranks, n = self.ranks, len(piece)
        end = list(range(1, n + 1))  # end of the part that starts at i; 0: merged away
        prev = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i:i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or not end[j] or end[j] != stop:
                continue  # one of the two parts has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                prev[stop] = i
                if (r := ranks.get(piece[i:end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (p := prev[i]) >= 0 and (r := ranks.get(piece[p:stop])) is not None:
                heapq.heappush(heap, (r, p, stop))
        out, i = [], 0
        while i < n:
            out.append(ranks[piece[i:end[i]]])
            i = end[i]
        return out

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of each text and the code point at which each of its pre-tokens starts."""
        starts, begins = self.boundaries(texts)
        cut = np.searchsorted(starts, begins)
        ids, offsets = [], []
        for k, text in enumerate(texts):
            own = starts[cut[k]:cut[k + 1] if k + 1 < len(cut) else None] - begins[k]
            at = own.tolist()
            pieces = [text[a:b] for a, b in zip(at, at[1:] + [len(text)])]
            known, out = self.known, []
            for p in pieces:
                got = known.get(p)
                if got is None:
                    got = np.array(self.merge(p.encode()), "<i4").tobytes()
                    if len(p) <= KEPT_CHARS:
                        if len(known) >= KEPT:
                            known.clear()
                        known[p] = got
                out.append(got)
            ids.append(np.frombuffer(b"".join(out), "<i4"))
            offsets.append(own)
        return ids, offsets

    def decode(self, ids: np.ndarray | list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids))


def lists(parts: list, kind: np.dtype, arrow: pa.DataType) -> pa.ListArray:
    """A list array of sequences of numbers."""
    ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
    flat = np.concatenate([np.asarray(p, kind) for p in parts]) if parts else np.empty(0, kind)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, arrow))


def round_trip(path: str):
    """A column function over texts: struct of ids, offsets of the pre-tokens (code points),
    and the bytes that the ids decode to."""
    @F.arrow_udf("struct<ids:array<int>,offsets:array<int>,decoded:binary>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = per_worker(("byte-bpe", path), lambda: ByteBpe(path))
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            for start, stop in spans([len(t) for t in texts]):
                ids, offsets = bpe.encode(texts[start:stop])
                yield pa.StructArray.from_arrays(
                    [lists(ids, np.int32, pa.int32()), lists(offsets, np.int32, pa.int32()),
                     pa.array([bpe.decode(x) for x in ids], pa.binary())], ["ids", "offsets", "decoded"])
    return run


def encode_documents(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` with ids, offsets and decoded."""
    out = with_columns(docs, {"_llm_bpe": round_trip(path)(F.col(text))})
    names = {n: F.col(f"_llm_bpe.{n}") for n in ("ids", "offsets", "decoded")}
    return with_columns(out, names).drop("_llm_bpe")
