"""Encoding and decoding with a piece model whose pieces come from pair merges.

Merge-type prefix table. The pair merges leave every prefix of a text with one last token,
whatever follows: the token that ends there and stands beside the last token of the prefix
before it. So a left-to-right pass stores, for each prefix, its last token: an automaton
over the vocabulary gives the tokens that end at a character, longest first, and the first
one that is compatible with the token before it is the one. The ids are then read
backwards, from the last token of the whole text to the last token of what is left.

Two tokens are compatible if merging their joined characters yields just these two. The
merges inside each proceed in an order of their own (worked out once per token), so the
test walks both orders together and looks whether a pair across the border would ever be
the best one. Answers are kept in a bounded table. A vocabulary string that its own merges
do not reach is never a last token.

No piece of the vocabulary may hold a space mark after another character (checked when it
is loaded), so prefixes start anew at every run of space marks, and the ids of frequent
words are kept in a bounded table. A character outside the vocabulary is never merged; it
becomes the ids of its UTF-8 bytes.

Defined cases: a null or empty text has the begin and end ids alone and decodes to the
empty text; texts of any length are processed whole; a space mark in a text counts as the
space it stands for, as the library has it; strings of control pieces are ordinary text;
equal texts have equal ids; an empty table gives an empty table; input columns named like
a result column give way to it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalkit.llm.common import per_worker, with_columns

MARK = "▁"
#: Words whose ids a worker keeps, the longest that it keeps, and pairs of tokens it keeps.
KEPT, KEPT_CHARS, KEPT_PAIRS = 200_000, 48, 400_000


class Merges:
    """The pair merges of a vocabulary: which pair goes first, and what it does to the ends."""

    def __init__(self, scores: dict[str, float]):
        self.scores = scores
        self.orders: dict[str, tuple[list, list] | None] = {}

    def parts(self, text: str) -> list[str]:
        """What the merges make of ``text``: the pair of the highest score first, leftmost on ties."""
        return self._run(text)[0]

    def _run(self, text: str) -> tuple[list[str], list, list]:
        parts, left, right = list(text), [], []
        scores = self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                s = scores.get(parts[i] + parts[i + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
            left.append((best, parts[0]))
            right.append((best, parts[-1]))
        return parts, left, right

    def order(self, token: str) -> tuple[list, list] | None:
        """The merges inside a token, in their order, as (score, first part after it) and as
        (score, last part after it); None if they do not end in the token."""
        if token not in self.orders:
            parts, left, right = self._run(token)
            self.orders[token] = (left, right) if len(parts) == 1 else None
        return self.orders[token]

    def compatible(self, first: str, second: str) -> bool:
        """Whether the merges of the joined tokens leave the border between them alone."""
        ends, starts = self.order(first)[1], self.order(second)[0]
        a, b, i, j = first[-1], second[0], 0, 0
        while True:
            across = self.scores.get(a + b)
            s = ends[i][0] if i < len(ends) else None
            t = starts[j][0] if j < len(starts) else None
            if s is None and t is None:
                return across is None
            # of equal scores the leftmost pair goes first: inside the first token, across, inside the second
            if s is not None and (t is None or s >= t):
                if across is not None and across > s:
                    return False
                a, i = ends[i][1], i + 1
            else:
                if across is not None and across >= t:
                    return False
                b, j = starts[j][1], j + 1


class PieceBpe:
    """Encoder and decoder over a model file."""

    def __init__(self, path: str):
        import ahocorasick
        import sentencepiece
        model = self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        bytes_of = {model.id_to_piece(i): i for i in range(n) if model.is_byte(i)}
        if len(bytes_of) != 256:
            raise ValueError("the vocabulary has no byte pieces")
        self.byte_ids = [np.array([bytes_of[f"<0x{b:02X}>"]], "<u4").tobytes() for b in range(256)]
        special = lambda i: model.is_byte(i) or model.is_control(i) or model.is_unknown(i)
        ids = {model.id_to_piece(i): i for i in range(n) if not special(i)}
        if any(MARK in p.lstrip(MARK) for p in ids) or model.normalize("A  ﬁ\t") != f"{MARK}A{MARK}{MARK}ﬁ\t":
            raise ValueError("pieces across spaces and normalised texts are not supported")
        self.begin, self.end = (np.array([i], "<u4").tobytes() for i in (model.bos_id(), model.eos_id()))
        self.merges = Merges({p: model.get_score(i) for p, i in ids.items() if len(p) > 1})
        # characters that occur in pieces only are symbols of the merges, too
        self.tokens = [*ids, *sorted({c for p in ids for c in p} - ids.keys())]
        self.token_ids = [np.array([ids[t]], "<u4").tobytes() if t in ids else self._as_bytes(t) for t in self.tokens]
        self.lengths = [len(t) for t in self.tokens]
        self.automaton = ahocorasick.Automaton()
        for k, t in enumerate(self.tokens):
            self.automaton.add_word(t, (k, len(t)))
        self.automaton.make_automaton()
        alphabet = {t for t in self.tokens if len(t) == 1}
        # a character outside the vocabulary never merges, so words may be cut at line feeds
        alone = "" if "\n" in alphabet else "\n"
        self.words = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + ("|\n" if alone else ""))
        self.pairs: dict[int, bool] = {}
        self.known = _Words(self)

    def _as_bytes(self, char: str) -> bytes:
        return b"".join(self.byte_ids[b] for b in char.encode())

    def _beside(self, before: int, token: int, key: int) -> bool:
        """Whether a token may follow another as the last one of a longer prefix (kept)."""
        if len(self.pairs) >= KEPT_PAIRS:
            self.pairs.clear()
        text, order = self.tokens[token], self.merges.order
        found = order(text) is not None and self.merges.compatible(self.tokens[before], text)
        self.pairs[key] = found
        return found

    def last_tokens(self, word: str) -> list[int]:
        """The last token of every prefix of ``word`` (-1: a character outside the vocabulary)."""
        last = [-1] * (len(word) + 1)
        pairs, n, order = self.pairs, len(self.tokens), self.merges.order
        for at, (token, length) in self.automaton.iter(word):
            at += 1
            if last[at] >= 0:
                continue
            before = last[at - length] if at > length else -1
            if before >= 0:
                key = before * n + token
                found = pairs.get(key)
                if found is None:
                    found = self._beside(before, token, key)
            else:
                found = length == 1 or order(self.tokens[token]) is not None
            if found:
                last[at] = token
        return last

    def encode_word(self, word: str) -> bytes:
        last, out, at = self.last_tokens(word), [], len(word)
        ids, lengths = self.token_ids, self.lengths
        while at:
            token = last[at]
            if token >= 0:
                out.append(ids[token])
                at -= lengths[token]
            else:
                at -= 1
                out.append(self._as_bytes(word[at]))
        out.reverse()
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """The ids of a text with begin and end ids, as little-endian unsigned 32-bit integers."""
        if not text:
            return self.begin + self.end
        words = self.words.findall(MARK + text.replace(" ", MARK))
        return b"".join([self.begin, *map(self.known.__getitem__, words), self.end])

    def decode(self, ids: list[bytes]) -> list[str]:
        return self.model.decode([np.frombuffer(b, "<u4").tolist() for b in ids], num_threads=1) if ids else []


class _Words(dict):
    """Ids of words; a full table starts anew, long words are not kept."""

    def __init__(self, coder: PieceBpe):
        super().__init__()
        self.coder = coder

    def __missing__(self, word: str) -> bytes:
        ids = self.coder.encode_word(word)
        if len(word) <= KEPT_CHARS:
            if len(self) >= KEPT:
                self.clear()
            self[word] = ids
        return ids


def round_trip(path: str):
    """A column function over texts: struct of the ids (packed) and the text they decode to."""
    @F.arrow_udf("struct<packed:binary,decoded:string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        coder = per_worker(("piece-bpe", path), lambda: PieceBpe(path))
        for texts in batches:
            packed = [coder.encode(t or "") for t in texts.to_pylist()]
            yield pa.StructArray.from_arrays([pa.array(packed, pa.binary()), pa.array(coder.decode(packed), pa.string())],
                                             ["packed", "decoded"])
    return run


def unpack():
    """A column function: the ids of a packed column as an array of integers."""
    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for packed in batches:
            parts = [np.frombuffer(b, "<u4") for b in packed.to_pylist()]
            ends = np.cumsum([0, *map(len, parts)]).astype(np.int32)
            flat = np.concatenate(parts).astype(np.int32) if parts else np.empty(0, np.int32)
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.int32()))
    return run


def n_ids(packed: Column) -> Column:
    return (F.octet_length(packed) / 4).cast("long")


def encode_documents(docs: DataFrame, path: str, text: str = "text", arrays: bool = True) -> DataFrame:
    """``docs`` with packed (ids as little-endian unsigned 32-bit integers, begin and end ids
    included), decoded and, unless ``arrays`` is off, ids (the same as an array)."""
    out = with_columns(docs, {"_llm_pieces": round_trip(path)(F.col(text))})
    out = with_columns(out, {n: F.col(f"_llm_pieces.{n}") for n in ("packed", "decoded")}).drop("_llm_pieces")
    return with_columns(out, {"ids": unpack()(F.col("packed"))}) if arrays else out
