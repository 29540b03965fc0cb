"""Quality rules by distribution divergence.

One pass over the texts gives each document its base counts, a histogram of character
classes and one of common words. The histograms of the documents that pass the base
rules are summed per language into references (over the whole corpus; one row per
language), and a document is kept if both its histograms lie within a Jensen-Shannon
distance of its language's references. A document without a language is held against
the nearest reference. Guards: a histogram of too few items is not judged, nor is a
document whose language has too few documents for a reference (its distances are null).

Base rules: at least 50 words, and at most half of them inside three-word windows that
the text holds twice or more.

Defined cases: null is the empty text (no words: fails the base rules); texts are
processed whole; repeated rows get equal results; without any reference only the base
rules decide; an empty table gives an empty table; input columns named like a result
column give way to it.
"""

from __future__ import annotations

import itertools
import sys
import unicodedata
from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalkit.llm.common import materialize, per_worker, with_columns
from evalkit.llm.common_words import COMMON_WORDS

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: Largest Jensen-Shannon distances (base 2, 0 to 1) of a kept document.
MAX_CHAR_DISTANCE = 0.28
#: The word histogram of n words may lie NOISE / sqrt(n) further away: sampling alone does that.
MAX_WORD_DISTANCE, NOISE = 0.20, 1.5
#: Characters and words below which the histogram is not judged.
MIN_CHARS, MIN_WORDS_JUDGED = 200, 50
#: Languages whose references are sent to the tasks at once (the most frequent ones, for documents
#: of these languages; more are joined, and nearest ones are looked for block by block), and
#: documents a language needs for a reference.
BLOCK_LANGUAGES, MIN_DOCS = 1000, 20
SYMBOLS = b"#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
CHAR_CLASSES = ("lower", "upper", "letter", "mark", "digit", "space", "line", "stop", "symbol", "other")
#: Distinct words whose bin a worker keeps.
KEPT = 200_000


def char_class_table() -> np.ndarray:
    """The class of each code point."""
    name = {n: i for i, n in enumerate(CHAR_CLASSES)}
    by_category = {"Ll": "lower", "Lu": "upper", "Lt": "upper", "Lm": "letter", "Lo": "letter",
                   "Mn": "mark", "Mc": "mark", "Nd": "digit", "Zs": "space"}
    table = np.full(sys.maxunicode + 1, name["other"], np.uint8)
    for c in range(sys.maxunicode + 1):
        if k := by_category.get(unicodedata.category(chr(c))):
            table[c] = name[k]
    for chars, k in ((".,;:!?'\"()-", "stop"), (SYMBOLS.decode(), "symbol"), ("\t", "space"), ("\n\r", "line")):
        for c in chars:
            table[ord(c)] = name[k]
    return table


def repeated_words(ids: np.ndarray) -> int:
    """Words inside three-word windows that occur twice or more, the first included."""
    n = len(ids) - 2
    if n < 2:
        return 0
    k = int(ids.max()) + 1
    if k < 2_000_000:
        windows = (ids[:-2] * k + ids[1:-1]) * k + ids[2:]
    else:
        pairs = np.unique(ids[:-2] * k + ids[1:-1], return_inverse=True)[1]
        windows = pairs * k + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    if not same.any():
        return 0
    hit = np.zeros(n, bool)
    hit[order[1:][same]] = hit[order[:-1][same]] = True
    covered = np.zeros(n + 2, bool)
    for shift in range(3):
        covered[shift:shift + n] |= hit
    return int(covered.sum())


def repeated_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


class Features:
    """Base counts and histograms of texts."""

    def __init__(self, common: Sequence[str]):
        self.bins = {w: i for i, w in enumerate(common)}
        self.n_bins = len(common) + 1  # the last: any other word
        self.classes = per_worker(("char-classes",), char_class_table)
        self.known: dict[bytes, int] = {}
        self.symbols = np.zeros(256, bool)
        self.symbols[list(SYMBOLS)] = True
        self.inside = np.zeros(256, bool)  # bytes that start a code point of a word
        self.inside[[b for b in range(256) if not 0x80 <= b < 0xC0 and b not in b" \t\n\v\f\r"]] = True

    def bin_of(self, word: bytes) -> int:
        k = self.known.get(word)
        if k is None:
            k = self.bins.get(word.decode("utf-8", "replace").lower().strip(".,;:!?'\"()-"), self.n_bins - 1)
            if len(self.known) >= KEPT:
                self.known.clear()
            self.known[word] = k
        return k

    def __call__(self, text: str) -> tuple[list[int], np.ndarray, np.ndarray]:
        raw = text.encode("utf-8", "replace")
        words = raw.split()  # bytes split at space, \t \n \v \f \r only
        points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        chars = np.bincount(self.classes[points], minlength=len(CHAR_CLASSES))
        buf = np.frombuffer(raw, np.uint8)
        first: dict[bytes, int] = {}
        ids = np.array([first.setdefault(w, len(first)) for w in words], np.int64)
        bins = np.array([self.bin_of(w) for w in first], np.int64)
        common = np.bincount(bins[ids], minlength=self.n_bins) if words else np.zeros(self.n_bins, np.int64)
        return [len(words), int(self.inside[buf].sum()), int(self.symbols[buf].sum()), repeated_lines(raw),
                repeated_words(ids)], chars, common


def text_features(common: Sequence[str]):
    """A column function over texts: struct of the base counts, chars and words histograms."""
    fields = ", ".join(f"{n}:bigint" for n in BASE)

    @F.arrow_udf(f"struct<{fields}, chars:array<int>, words:array<int>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        features = per_worker(("quality", tuple(common)), lambda: Features(common))
        for texts in batches:
            rows = [features(t or "") for t in texts.to_pylist()]
            base = np.array([r[0] for r in rows], np.int64).reshape(-1, len(BASE))
            cols = [pa.array(base[:, i]) for i in range(len(BASE))]
            cols += [pa.array([r[k].astype(np.int32) for r in rows], pa.list_(pa.int32())) for k in (1, 2)]
            yield pa.StructArray.from_arrays(cols, [*BASE, "chars", "words"])
    return run


def histogram_sum(col: str, n: int) -> Column:
    return F.array(*[F.sum(F.col(col)[i].cast("long")) for i in range(n)])


def distances(hists: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distances (base 2) of each histogram to each reference."""
    out = np.empty((len(hists), len(refs)))
    for j, r in enumerate(refs):
        out[:, j] = own_distances(hists, np.broadcast_to(r, hists.shape))
    return out


def own_distances(hists: np.ndarray, refs: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2) of each histogram to the reference of its row."""
    p = hists / np.maximum(hists.sum(1, keepdims=True), 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        q = refs / refs.sum(1, keepdims=True)
        m = (p + q) / 2
        kl = lambda a: np.where(a > 0, a * np.log2(a / m), 0).sum(1)
        return np.sqrt(np.clip((kl(p) + kl(q)) / 2, 0, 1))


def references(features: DataFrame, lang: str, n_bins: int) -> DataFrame:
    """Summed histograms per language over the documents that pass the base rules: lang, n, c, w."""
    return (features.filter(~F.col("base_failed") & F.col(lang).isNotNull()).groupBy(F.col(lang).alias("lang"))
            .agg(F.count(F.lit(1)).alias("n"), histogram_sum("_llm_chars", len(CHAR_CLASSES)).alias("c"),
                 histogram_sum("_llm_words", n_bins).alias("w"))
            .filter(F.col("n") >= MIN_DOCS))


def matrix(col: pa.ListArray) -> np.ndarray:
    return np.asarray(col.flatten(), float).reshape(len(col), -1)


DISTANCES = "struct<char_distance:double, word_distance:double>"


def distance_structs(both: list[np.ndarray], judged: np.ndarray) -> pa.StructArray:
    return pa.StructArray.from_arrays([pa.array(d, mask=~judged) for d in both], ["char_distance", "word_distance"])


def divergence(refs: Mapping[str, tuple[list[int], list[int]]]):
    """A column function (lang, chars, words) -> struct of both distances, to the reference
    of the language or, without a language, the nearest; null for a language not in ``refs``."""
    names = sorted(refs)
    tables = [np.array([refs[n][k] for n in names], float) for k in (0, 1)]

    @F.arrow_udf(DISTANCES)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        at = {n: i for i, n in enumerate(names)}
        for langs, chars, words in batches:
            hists = [matrix(c) for c in (chars, words)]
            own = np.array([at.get(x, -1) for x in langs.to_pylist()], np.int64)
            no_lang = langs.is_null().to_numpy(zero_copy_only=False)
            if no_lang.any():
                own[no_lang] = sum(distances(h[no_lang], t) for h, t in zip(hists, tables)).argmin(1)
            yield distance_structs([own_distances(h, t[own]) for h, t in zip(hists, tables)], own >= 0)
    return run


def joined_divergence():
    """A column function (chars, words, c, w) -> struct of both distances to the references
    c and w beside the histograms, null without them."""
    @F.arrow_udf(DISTANCES)
    def run(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for chars, words, c, w in batches:
            keep = c.is_valid()
            judged = keep.to_numpy(zero_copy_only=False)
            both = [np.zeros(len(judged)) for _ in range(2)]
            if judged.any():
                for out, hists, refs in zip(both, (chars, words), (c, w)):
                    out[judged] = own_distances(matrix(hists.filter(keep)), matrix(refs.filter(keep)))
            yield distance_structs(both, judged)
    return run


def nearest_divergence(refs: Sequence):
    """A column function (chars, words) -> struct of the sum of both distances to the nearest of
    the references (rows with c and w), and both."""
    tables = [np.array([r[k] for r in refs], float) for k in ("c", "w")]

    @F.arrow_udf("struct<total:double, char_distance:double, word_distance:double>")
    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for chars, words in batches:
            both = [distances(matrix(c), t) for c, t in zip((chars, words), tables)]
            total = both[0] + both[1]
            best = total.argmin(1)
            at = np.arange(len(best))
            yield pa.StructArray.from_arrays([pa.array(x[at, best]) for x in (total, *both)], ["total", "char_distance", "word_distance"])
    return run


def with_distances(out: DataFrame, n_bins: int, block: int) -> DataFrame:
    """``out`` with the struct _llm_d of both distances."""
    refs = materialize(references(out, "_llm_lang", n_bins), "quality-references")
    order = [F.desc("n"), "lang"]
    top = refs.orderBy(*order).limit(block).collect()
    if not top:
        return out.withColumn("_llm_d", F.lit(None).cast(DISTANCES))
    known = {r["lang"]: (r["c"], r["w"]) for r in top}
    direct = divergence(known)("_llm_lang", "_llm_chars", "_llm_words")
    if len(top) < block:
        return out.withColumn("_llm_d", direct)
    # a language past the most frequent ones has at most 1 / block of the judged
    # documents, so no key of this join is hot
    held, nameless = F.col("_llm_lang").isin(list(known)), F.col("_llm_lang").isNull()
    rest = refs.filter(~F.col("lang").isin(list(known))).select(F.col("lang").alias("_llm_ref"), F.col("c").alias("_llm_c"),
                                                               F.col("w").alias("_llm_w"))
    others = (out.filter(~held & ~nameless).join(rest, F.col("_llm_lang") == F.col("_llm_ref"), "left")
              .withColumn("_llm_d", joined_divergence()("_llm_chars", "_llm_words", "_llm_c", "_llm_w"))
              .drop("_llm_ref", "_llm_c", "_llm_w"))
    # a document without a language against all references, a block of them at a time
    nearest, rows = None, refs.orderBy(*order).toLocalIterator()
    while part := list(itertools.islice(rows, block)):
        found = nearest_divergence(part)("_llm_chars", "_llm_words")
        nearest = found if nearest is None else F.least(nearest, found)
    near = F.struct(nearest["char_distance"].alias("char_distance"), nearest["word_distance"].alias("word_distance"))
    return (out.filter(held).withColumn("_llm_d", direct).unionByName(others)
            .unionByName(out.filter(nameless).withColumn("_llm_d", near)))


def judge(docs: DataFrame, text: str = "text", lang: str = "lang",
          common_words: Mapping[str, Sequence[str]] = COMMON_WORDS, keep_text: bool = True,
          block_languages: int = BLOCK_LANGUAGES) -> DataFrame:
    """``docs`` with the base counts, base_failed, both distances and kept. The texts are
    read once: what the second step needs is written with the documents' columns, all of
    them or (``keep_text=False``) all but the text."""
    common = sorted({w for ws in common_words.values() for w in ws})
    out = with_columns(docs, {"_llm_f": text_features(common)(F.col(text)), "_llm_lang": F.col(lang)})
    out = with_columns(out, {**{n: F.col(f"_llm_f.{n}") for n in BASE}, "_llm_chars": F.col("_llm_f.chars"),
                             "_llm_words": F.col("_llm_f.words")}).drop("_llm_f")
    failed = ((F.col("n_words") < MIN_WORDS)
              | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT))
    out = with_columns(out, {"base_failed": failed})
    out = materialize(out if keep_text else out.drop(text), "quality-features")
    out = with_distances(out, len(common) + 1, block_languages)
    out = with_columns(out, {n: F.col(f"_llm_d.{n}") for n in ("char_distance", "word_distance")})
    n_chars = F.aggregate("_llm_chars", F.lit(0).cast("long"), lambda a, x: a + x)
    allowed = MAX_WORD_DISTANCE + NOISE / F.sqrt(F.greatest(F.col("n_words"), F.lit(1)))
    no_reference = F.col("char_distance").isNull()
    near = no_reference | (((n_chars < MIN_CHARS) | (F.col("char_distance") <= MAX_CHAR_DISTANCE))
                           & ((F.col("n_words") < MIN_WORDS_JUDGED) | (F.col("word_distance") <= allowed)))
    return with_columns(out, {"kept": ~F.col("base_failed") & near}).drop("_llm_d", "_llm_lang", "_llm_chars", "_llm_words")
