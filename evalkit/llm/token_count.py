"""Token counts of a piece vocabulary, without encoding whole texts.

Whole-token shortcut. No piece of the vocabulary holds a space mark after another
character (checked when the vocabulary is loaded), so merges never cross the start of
a run of spaces: a text is a sequence of pre-tokens, each a run of spaces and the
characters up to the next space, and its count is the sum of theirs. Which vocabulary
strings encode alone as one token is proved once, by encoding each of them; these
pre-tokens are counted by lookup. Only the rest goes through the merges, once per
distinct pre-token while a bounded table of counts holds it.

Defined cases: a null or empty text has 0 tokens and 0 bytes; the space mark itself
counts as the space it stands for, as the library has it; texts of any length are
processed whole; equal texts have equal counts; an empty table gives an empty table;
input columns named like a result column give way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalkit.llm.common import per_worker, with_columns

TOKEN_LIMIT = 4096
MARK = "▁"
#: Distinct pre-tokens whose counts a worker keeps, and the longest that it keeps.
KEPT, KEPT_CHARS = 400_000, 48


def separable(pieces: list[str]) -> bool:
    """Whether no piece holds the space mark after another character."""
    return all(MARK not in p.lstrip(MARK) for p in pieces)


class PieceCounter:
    """Counts tokens of texts under a piece model."""

    def __init__(self, path: str):
        import sentencepiece
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        pieces = [self.model.id_to_piece(i) for i in range(self.model.get_piece_size())]
        if not separable(pieces):
            raise ValueError("a piece spans a space: pre-tokens of this vocabulary are not independent")
        words = [p[1:] for p in pieces if p.startswith(MARK) and len(p) > 1 and MARK not in p[1:]]
        self.single = {w: 1 for w, n in zip(words, self._merge(words)) if n == 1}
        self.known = dict(self.single)
        self.spaces: dict[int, int] = {}

    def _merge(self, parts: list[str]) -> list[int]:
        return [len(ids) for ids in self.model.encode(parts, num_threads=1)]

    def _space_run(self, n: int) -> int:
        """Tokens of n space marks on their own (a line feed never merges and is one token)."""
        if n not in self.spaces:
            self.spaces[n] = self._merge([" " * (n - 1) + "\n"])[0] - 1
        return self.spaces[n]

    def __call__(self, texts: list[str]) -> list[int]:
        split = [self.pretokens(t) for t in texts]
        known = self.known
        new = list({p for parts, _ in split for p in parts if p not in known})
        counted = dict(zip(new, self._merge(new)))
        if len(known) + len(new) > KEPT:
            known = self.known = dict(self.single)
            counted.update(self._recount(split, known, counted))
        short = {p: n for p, n in counted.items() if len(p) <= KEPT_CHARS}
        known.update(short)
        if len(short) == len(counted):
            return [sum(map(known.__getitem__, parts)) + extra for parts, extra in split]
        every = {**known, **counted}
        return [sum(map(every.__getitem__, parts)) + extra for parts, extra in split]

    def _recount(self, split, known, counted) -> dict[str, int]:
        new = list({p for parts, _ in split for p in parts if p not in known and p not in counted})
        return dict(zip(new, self._merge(new)))

    def pretokens(self, text: str) -> tuple[list[str], int]:
        """The pre-tokens of ``text`` (the first space of each left off: the library puts
        one in front of every text) and the tokens of spaces that end it."""
        if not text:
            return [], 0
        parts = text.replace(MARK, " ").split(" ")
        if "" not in parts:
            return parts, 0
        out, run = [], 0
        for p in parts:
            if p:
                out.append(" " * run + p)
                run = 0
            else:
                run += 1
        return out, self._space_run(run) if run else 0


def count_tokens(path: str):
    """A column function: the number of tokens of a text column."""
    @F.arrow_udf("long")
    def counts(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        counter = per_worker(("pieces", path), lambda: PieceCounter(path))
        for texts in batches:
            yield pa.array(counter([t or "" for t in texts.to_pylist()]), pa.int64())
    return counts


def token_counts(docs: DataFrame, path: str, text: str = "text", limit: int = TOKEN_LIMIT) -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit."""
    counted = with_columns(docs, {"n_tokens": F.coalesce(count_tokens(path)(F.col(text)), F.lit(0).cast("long"))})
    return with_columns(counted, {"n_bytes": F.coalesce(F.octet_length(text), F.lit(0)).cast("long"),
                                  "n_tokens": F.col("n_tokens"), "over_limit": F.col("n_tokens") > limit})
