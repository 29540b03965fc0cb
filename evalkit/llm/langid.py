"""Language identification by averaged hashed subword embeddings.

Training: a sample of labelled documents, bounded per language and in all, is drawn by a
hash of the id; tasks turn their whole texts into bags of n-grams, which is what reaches the
driver. Every language that is a label is learned. Every character n-gram of a word (with its edges) is hashed to a row of an embedding table;
a text is the mean of its rows; a linear softmax over it is trained by stochastic
gradient descent in numpy. On held-back samples the softmax temperature is fitted, and
the score below which a prediction is rejected is set so that right predictions are
hardly ever lost.

Prediction: as mean and layer are linear, embedding and layer fold into one table of
logits per bucket, which is what workers receive. Whole texts are scored.

Defined cases: null and texts without a letter are ``und`` with score 0 and rejected;
documents without a language are not learned from; without any labelled document every
text is ``und``; repeated rows get equal results; an empty table gives an empty table;
input columns named like a result column give way to it.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evalkit.llm.common import materialize, per_worker, small_enough, spans, with_columns

UNKNOWN = "und"
#: Labelled documents drawn per language and in all (about; at least one of each language).
SAMPLE, SAMPLE_ALL = 1500, 6000
#: Characters at a text's start that also make bags, to calibrate the scores of short texts.
PIECES = (200, 40)
BUCKETS, DIM, ORDERS = 1 << 15, 16, (1, 2, 3)
EPOCHS, RATE, BATCH = 6, 0.5, 32
#: Share of right predictions on held-back samples that rejection may cost at most, and
#: the score from which nothing is rejected whatever that share.
LOST, SURE = 0.002, 0.5


def letter_table() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def ngrams(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all texts, the text of each, and the letters per text.

    An n-gram lies inside a word or takes in the edge before or after it."""
    letters = per_worker(("letters",), letter_table)
    joined = "\n".join(texts).lower() if len(texts) > 1 else (texts[0].lower() if texts else "")
    points = np.frombuffer(("\n" + joined + "\n").encode("utf-32-le", "replace"), np.uint32)
    # lower-casing may change lengths, so owners are counted on what it gives
    sizes = np.array([len(t.lower()) + 1 for t in texts], np.int64)
    owner = np.concatenate([[0], np.repeat(np.arange(len(texts)), sizes)])[:len(points)]
    good = letters[points]
    c = np.where(good, points, 0).astype(np.uint64)
    found, owners = [], []
    for order in ORDERS:
        n = len(c) - order + 1
        if n <= 0:
            continue
        h = np.full(n, order, np.uint64)
        ok = good[order // 2:order // 2 + n].copy() if order < 3 else np.ones(n, bool)
        for i in range(order):
            h = (h ^ c[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
            if order >= 3 and 0 < i < order - 1:
                ok &= good[i:i + n]
        if order == 2:
            ok = good[:n] | good[1:]
        found.append((h[ok] >> np.uint64(40)).astype(np.int64) % BUCKETS)
        owners.append(owner[order // 2:order // 2 + n][ok])
    empty = np.empty(0, np.int64)
    n_letters = np.bincount(owner[good], minlength=len(texts)) if len(texts) else empty
    return (np.concatenate(found) if found else empty), (np.concatenate(owners) if owners else empty), n_letters


@dataclass
class Model:
    languages: list[str]
    logits: np.ndarray  # per bucket and language, the bias included
    temperature: float = 1.0
    reject_below: float = 0.0

    def scores(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Calibrated probabilities per text and whether it has a letter."""
        buckets, owner, n_letters = ngrams(texts)
        k = len(self.languages)
        total = np.stack([np.bincount(owner, self.logits[buckets, j], len(texts)) for j in range(k)], 1)
        count = np.maximum(np.bincount(owner, minlength=len(texts)), 1)
        return softmax(total / count[:, None] / self.temperature), n_letters > 0


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


#: Distinct buckets of a text and their shares of its n-grams.
Bag = tuple[np.ndarray, np.ndarray]


def bag(text: str) -> Bag:
    b, n = np.unique(ngrams([text])[0], return_counts=True)
    return b.astype(np.int32), (n / max(n.sum(), 1)).astype(np.float32)


def bags_of(text: str) -> list[Bag]:
    """The bags of a whole text and of its first characters."""
    return [bag(text), *[bag(text[:n]) for n in PIECES]]


def fit(texts: Sequence[str], labels: Sequence[str], seed: int = 7) -> Model:
    """Train on texts, calibrate on every fifth of them."""
    return fit_bags([bags_of(t) for t in texts], labels, seed)


def fit_bags(bags: Sequence[Sequence[Bag]], labels: Sequence[str], seed: int = 7) -> Model:
    """Train on the bags of texts (the whole, then its pieces), calibrate on every fifth."""
    languages = sorted(set(labels))
    if not languages:
        return Model([], np.zeros((BUCKETS, 0)))
    rng = np.random.default_rng(seed)
    y = np.searchsorted(languages, labels)
    held = np.arange(len(y)) % 5 == 4
    train = np.flatnonzero(~held)
    emb = rng.normal(0, 0.1, (BUCKETS, DIM))
    layer, bias = np.zeros((DIM, len(languages))), np.zeros(len(languages))
    for epoch in range(EPOCHS):
        rate = RATE * (1 - epoch / EPOCHS)
        for start in range(0, len(train), BATCH):
            if start == 0:
                rng.shuffle(train)
            at = train[start:start + BATCH]
            x = np.stack([w @ emb[b] for b, w in (bags[i][0] for i in at)])
            g = softmax(x @ layer + bias)
            g[np.arange(len(at)), y[at]] -= 1
            back = g @ layer.T
            layer -= rate * (x.T @ g) / len(at) * 8
            bias -= rate * g.mean(0)
            for i, d in zip(at, back):
                b, w = bags[i][0]
                emb[b] -= rate * 8 * w[:, None] * d
    model = Model(languages, emb @ layer + bias)
    kept = [(b, y[i]) for i in np.flatnonzero(held) for b in bags[i]]
    return calibrate(model, [b for b, _ in kept], np.array([k for _, k in kept], np.int64))


def calibrate(model: Model, bags: Sequence[Bag], y: np.ndarray) -> Model:
    """Fit the temperature to the held-back samples, whole and as short pieces, and set
    the rejection score."""
    has = np.array([len(b) > 0 for b, _ in bags], bool)
    if not has.any():
        return model
    logit, y = np.stack([w @ model.logits[b] for b, w in bags])[has], y[has]
    tries = 2.0 ** np.arange(-6, 4, 0.25)
    loss = [-np.log(np.maximum(softmax(logit / t)[np.arange(len(y)), y], 1e-300)).mean() for t in tries]
    model.temperature = float(tries[int(np.argmin(loss))])
    p = softmax(logit / model.temperature)
    right = p.max(1)[p.argmax(1) == y]
    if len(right):
        model.reject_below = float(min(SURE, np.quantile(right, LOST)))
    return model


def held_out(doc_id: Column) -> Column:
    """Documents never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2


def packed_bags():
    """A column function over texts: their bags, as bytes of buckets and of shares."""
    @F.arrow_udf("array<struct<b:binary,w:binary>>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([[{"b": b.tobytes(), "w": w.tobytes()} for b, w in bags_of(t)] for t in texts.to_pylist()],
                           pa.list_(pa.struct([("b", pa.binary()), ("w", pa.binary())])))
    return run


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
          sample: int = SAMPLE, sample_all: int = SAMPLE_ALL) -> Model:
    """A model of the labelled, not held-out documents. The bags of at most about ``sample``
    documents per language and ``sample_all`` in all (but one of each language) come to the
    driver, a bag being bounded by the buckets; the model itself has a column per language."""
    known = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id))).select(
        F.col(doc_id).cast("string").alias("i"), F.col(lang).alias("l"), F.col(text).alias("t"))
    counts = materialize(known.groupBy(F.col("l").alias("k")).agg(F.count(F.lit(1)).alias("n"),
                                                                  F.min(F.xxhash64(F.lit("langid"), "i")).alias("first")), "langid-labels")
    languages = counts.count()
    if not languages:
        return fit_bags([], [])
    each = max(1, min(sample, sample_all // languages))
    rates = F.broadcast(counts) if small_enough(counts, F.octet_length("k") + 64) else counts
    parts = 1 << 30
    place = F.xxhash64(F.lit("langid"), "i")
    drawn = known.join(rates, F.col("l") == F.col("k")).filter(
        (F.pmod(place, F.lit(parts)) < F.lit(each) / F.col("n") * parts) | (place == F.col("first")))
    # rows that repeat an id are one document here
    drawn = drawn.groupBy("i", "l").agg(F.min("t").alias("t"))
    rows = drawn.select("i", "l", packed_bags()("t").alias("bags")).toArrow()
    ids, labels = rows.column("i").to_pylist(), rows.column("l").to_pylist()
    bags = [[(np.frombuffer(x["b"], np.int32), np.frombuffer(x["w"], np.float32)) for x in own]
            for own in rows.column("bags").to_pylist()]
    order = sorted(range(len(ids)), key=lambda k: (zlib.crc32(str(ids[k]).encode()), str(ids[k]), labels[k], len(bags[k][0][0])))
    return fit_bags([bags[k] for k in order], [labels[k] for k in order])


def predictor(model: Model):
    """A column function over texts: struct of lang_pred, score and rejected."""
    shared = {"languages": model.languages, "logits": model.logits.astype(np.float32),
              "temperature": model.temperature, "reject_below": model.reject_below}

    @F.arrow_udf("struct<lang_pred:string, score:double, rejected:boolean>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        m = Model(**shared)
        for batch in batches:
            texts = [t or "" for t in batch.to_pylist()]
            names, scores, out = [], [], []
            for start, stop in spans([len(t) for t in texts]):
                part = texts[start:stop]
                if m.languages:
                    p, has = m.scores(part)
                    best, top = p.argmax(1), p.max(1)
                else:
                    has = best = top = np.zeros(len(part), int)
                for h, b, s in zip(has, best, top):
                    names.append(m.languages[b] if h else UNKNOWN)
                    scores.append(float(s) if h else 0.0)
                    out.append(not h or s < m.reject_below)
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64()),
                                              pa.array(out, pa.bool_())], ["lang_pred", "score", "rejected"])
    return run


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected."""
    out = with_columns(docs, {"_llm_l": predictor(model)(F.col(text))})
    return with_columns(out, {n: F.col(f"_llm_l.{n}") for n in ("lang_pred", "score", "rejected")}).drop("_llm_l")
