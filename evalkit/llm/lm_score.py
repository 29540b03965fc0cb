"""Language-model scores: Stupid Backoff over the corpus's own n-gram counts.

The score of a word after its predecessor is count(pair) / count(predecessor) if the pair
was seen often enough, else a fixed factor times the word's share of the corpus; the score
of a document is the mean logarithm over its words. Every word and pair of the corpus has its
own count, whatever its size. It is computed as a join:
1. Words are counted over the whole corpus (per batch, then by a partial aggregate). The
   frequent ones get numbers and are broadcast with their counts: those above ``WORD_ROWS``
   occurrences, or a fixed share of a small corpus. What is broadcast is bounded; it changes
   where a count is looked up, not the count.
2. So are the frequent pairs of frequent words. No key of the join below has more rows than
   these two numbers.
3. All other occurrences go to count tables partitioned by a hash: a pair of frequent words by
   the pair, a rare word by the word, with its neighbour. A partition counts its keys over the
   corpus, joins the counts to the occurrences and returns a sum per document. The count of a
   rare word meets both the pairs that end and those that begin with it there, so a pair of two
   rare words goes to both words' partitions, each of which knows its count.
4. The sums are partitioned by blocks of documents and added up.

Occurrences travel packed: one row per task, partition and block of documents, which holds
places in the block (2 bytes) and keys. Nothing passes the driver but the bounded tables.

Defined cases: a null text and a text without words have no words and a null score; the
first word of a text is scored by its share; repeated rows each count and get equal
scores; an empty table gives an empty table; extra columns are not carried.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalkit.llm.common import materialize, per_worker

BACKOFF = 0.4
#: A pair seen less often backs off.
MIN_PAIR = 2
#: Occurrences, or a share of all, from which a word or pair is broadcast, and how many are at most.
WORD_ROWS, WORD_SHARE, MAX_WORDS = 4_000_000, 1e-6, 2_000_000
PAIR_ROWS, PAIR_SHARE, MAX_PAIRS = 4_000_000, 1e-4, 4_000_000
#: Occurrences per hash partition aimed at (more in a very large corpus, so that a task still
#: sends several of them to each), and occurrences that a task collects before it sends them.
BUCKET_ROWS, COLLECTED = 500_000, 1_000_000
#: Bytes of text whose words a worker holds at once (one document at least), and bytes of
#: packed rows that it hands over at once (one row at least).
SLICE_BYTES, SENT_BYTES = 1024 * 1024, 2 * 1024 * 1024
BITS = 21  # of a frequent word's number
MIX = 0x9E3779B97F4A7C15
#: Documents of a block: their places take two bytes.
BLOCK_BITS = 16
#: Frequent words whose number a worker keeps.
KEPT = 200_000
PACKED = "bucket long, block long, payload binary"
NAMES = ["bucket", "block", "payload"]


def digest(words: list[bytes]) -> np.ndarray:
    """A negative number per word (63 bits of its hash)."""
    import xxhash
    return np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words), np.uint64, len(words)).view(np.int64) | np.int64(-2**63)


def batch_words(texts: list[str | None]) -> tuple[list[bytes], np.ndarray]:
    """All words of the texts in order, and how many each text has."""
    split = [t.encode("utf-8", "replace").split() if t else [] for t in texts]
    return [w for ws in split for w in ws], np.array([len(ws) for ws in split], np.int64)


def slices(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """The batch in runs of documents of about ``SLICE_BYTES`` of text."""
    ends = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False), dtype=np.int64)
    cut = np.flatnonzero(np.diff(ends // SLICE_BYTES, prepend=-1)).tolist()
    for start, stop in zip(cut, [*cut[1:], batch.num_rows]):
        yield batch.slice(start, stop - start)


def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counted = Counter()
        for part in slices(batch, 0):
            counted.update(batch_words(part.column(0).to_pylist())[0])
        yield pa.record_batch([pa.array(digest(list(counted))), pa.array(list(counted.values()), pa.int64())],
                              ["h", "c"])


def in_sorted(values: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each value in a sorted table and whether it is there."""
    at = np.minimum(np.searchsorted(table, values), max(len(table) - 1, 0))
    return at, (table[at] == values if len(table) else np.zeros(len(values), bool))


class Vocabulary:
    """Numbers (from 1) and counts of the frequent words; any other word is named by its hash,
    a negative number."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray, total: int):
        order = np.argsort(hashes)
        self.hashes, self.total = hashes[order], max(total, 1)
        self.logs = np.log(np.r_[1, counts[order]])  # by number
        self.counts = np.r_[0, counts[order]]
        self.known: dict[bytes, int] = {}

    def codes(self, words: list[bytes]) -> np.ndarray:
        known = self.known
        if len(known) > KEPT:
            known.clear()
        new = list(set(words) - known.keys())
        if not new:
            return np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        h = digest(new)
        at, hit = in_sorted(h, self.hashes)
        code = np.where(hit, at + 1, h)
        known.update(zip(new, code.tolist()))
        codes = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
        for i in np.flatnonzero(~hit).tolist():
            del known[new[i]]
        return codes

    def log_share(self, number: np.ndarray) -> np.ndarray:
        return self.logs[number] - np.log(self.total)

    def log_pairs(self, pair: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Logarithm of the Stupid Backoff score of pairs of frequent words with these counts."""
        seen = np.log(np.maximum(count, 1)) - self.logs[pair >> BITS]
        return np.where(count >= MIN_PAIR, seen, np.log(BACKOFF) + self.log_share(pair & ((1 << BITS) - 1)))


def least_rows(total: int, rows: int, share: float, most: int) -> float:
    """From how many occurrences a key is broadcast: at most ``most`` keys can have as many."""
    return max(total / most, min(total * share, rows), 1)


def bucket_of(key: np.ndarray, buckets: int) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(MIX)) >> np.uint64(20)).astype(np.int64) % buckets


# --- packed rows: five lengths, then the places and keys of five kinds of occurrences ------------
#: Bytes of the keys of a kind: a pair of frequent words; a rare word and the number of the word
#: before it (0: none), or of the word after it; two rare words, at the second's and the first's.
PAIR, ENDS, BEGINS, BOTH_ENDS, BOTH_BEGINS = range(5)
KEY_BYTES = ((6,), (8, 3), (8, 3), (8, 8), (8, 8))


def low_bytes(values: np.ndarray, n: int) -> bytes:
    if n == 8:
        return values.astype("<i8").tobytes()
    return values.astype("<i8").view(np.uint8).reshape(-1, 8)[:, :n].tobytes()


def from_low_bytes(data: bytes, n: int) -> np.ndarray:
    if n == 8:
        return np.frombuffer(data, "<i8")
    out = np.zeros((len(data) // n, 8), np.uint8)
    out[:, :n] = np.frombuffer(data, np.uint8).reshape(-1, n)
    return out.view("<i8").ravel()


def pack(kinds: Iterable[tuple[np.ndarray, ...]]) -> Iterator[tuple[int, int, bytes]]:
    """(bucket, block, payload) rows from (bucket, rid, key, ...) arrays of each kind."""
    parts: dict[tuple[int, int], list] = {}
    for kind, (bucket, rid, *keys) in enumerate(kinds):
        block = rid >> BLOCK_BITS
        order = np.lexsort((rid, bucket))
        b, k = bucket[order], block[order]
        cut = np.flatnonzero(np.r_[True, (np.diff(b) != 0) | (np.diff(k) != 0)]) if len(b) else np.empty(0, np.int64)
        place = (rid[order] & ((1 << BLOCK_BITS) - 1)).astype("<u2").tobytes()
        data = [low_bytes(x[order], n) for x, n in zip(keys, KEY_BYTES[kind])]
        for start, stop, at in zip(cut.tolist(), [*cut[1:].tolist(), len(b)], zip(b[cut].tolist(), k[cut].tolist())):
            row = parts.setdefault(at, [[0] * len(KEY_BYTES), []])
            row[0][kind] = stop - start
            row[1] += [place[2 * start:2 * stop], *[d[n * start:n * stop] for d, n in zip(data, KEY_BYTES[kind])]]
    for bucket, block in list(parts):
        lengths, data = parts.pop((bucket, block))
        yield bucket, block, np.array(lengths, "<u4").tobytes() + b"".join(data)


def rows_of(rows) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [[], [], []]
    return pa.record_batch([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary()))], NAMES)


def batches_of(rows: Iterable[tuple[int, int, bytes]]) -> Iterator[pa.RecordBatch]:
    part, size = [], 0
    for row in rows:
        part.append(row)
        size += len(row[2])
        if size >= SENT_BYTES:
            yield rows_of(part)
            part, size = [], 0
    if part:
        yield rows_of(part)


def sent(pieces: Iterable[tuple[list, list]], most: int) -> Iterator[pa.RecordBatch]:
    """Per piece its rows and, whenever ``most`` occurrences are held, those packed."""
    held, n = [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        # kind after kind, so that one of them is held twice at most
        return batches_of(pack(tuple(np.concatenate(x) for x in zip(*parts)) for parts in zip(*held)))

    for rows, kinds in pieces:
        yield from batches_of(rows)
        held.append(kinds)
        n += sum(len(kind[0]) for kind in kinds)
        if n >= most:
            yield from flush()
            held, n = [], 0
    if held:
        yield from flush()


def unpack(blocks: list[int], payloads: list[bytes]) -> list[list[np.ndarray]]:
    """Per kind: rid and keys of all occurrences of the rows."""
    rids: list[list] = [[] for _ in KEY_BYTES]
    keys: list[list[list]] = [[[] for _ in n] for n in KEY_BYTES]
    for block, payload in zip(blocks, payloads):
        at = 4 * len(KEY_BYTES)
        for kind, n in enumerate(np.frombuffer(payload[:at], "<u4").tolist()):
            if n:
                rids[kind].append(np.frombuffer(payload, "<u2", n, at).astype(np.int64) + (block << BLOCK_BITS))
                at += 2 * n
                for i, size in enumerate(KEY_BYTES[kind]):
                    keys[kind][i].append(payload[at:at + size * n])
                    at += size * n
    joined = lambda parts: np.concatenate(parts) if parts else np.empty(0, np.int64)
    return [[joined(r), *[from_low_bytes(b"".join(x), size) for x, size in zip(k, KEY_BYTES[kind])]]
            for kind, (r, k) in enumerate(zip(rids, keys))]


def occurrences(first: np.ndarray, second: np.ndarray, starts: np.ndarray, rid: np.ndarray, direct: np.ndarray,
                buckets: int) -> list[tuple[np.ndarray, ...]]:
    """Each kind's (bucket, rid, keys) of words ``second`` after ``first``; ``starts``: the word
    starts a text; ``direct``: it is scored already."""
    after_rare, rare = (first < 0) & ~starts, second < 0
    pair = ~direct & ~starts & ~after_rare & ~rare
    ends, begins, both = rare & ~after_rare, after_rare & ~rare, rare & after_rare
    key = first[pair] << BITS | second[pair]
    before = np.where(starts, 0, first)
    return [(bucket_of(key, buckets), rid[pair], key),
            (bucket_of(second[ends], buckets), rid[ends], second[ends], before[ends]),
            (bucket_of(first[begins], buckets), rid[begins], first[begins], second[begins]),
            (bucket_of(second[both], buckets), rid[both], second[both], first[both]),
            (bucket_of(first[both], buckets), rid[both], first[both], second[both])]


def counted(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """How often each (a, b) occurs, per occurrence."""
    order = np.lexsort((b, a))
    new = np.r_[True, (np.diff(a[order]) != 0) | (np.diff(b[order]) != 0)] if len(a) else np.empty(0, bool)
    group = np.cumsum(new) - 1
    out = np.empty(len(a), np.int64)
    out[order] = np.bincount(group)[group] if len(a) else 0
    return out


def joined_sums(kinds: list[list[np.ndarray]], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Documents and their sums of logarithms, from all occurrences of the keys of a partition."""
    (r0, key), (r1, a1, o1), (r2, a2, o2), (r3, a3, o3), (r4, a4, o4) = kinds
    found, inverse = np.unique(key, return_inverse=True)
    pairs = v.log_pairs(found, np.bincount(inverse, minlength=len(found)))[inverse] if len(found) else np.empty(0)
    # every occurrence of a rare word ends a pair or starts a text, so this is its count in the corpus
    words, times = np.unique(np.concatenate([a1, a3]), return_counts=True)
    log_of = lambda a: np.log(times[np.searchsorted(words, a)]) if len(a) else np.empty(0)
    share = lambda a: log_of(a) - np.log(v.total)
    back = np.log(BACKOFF)
    c1, c2, c3, c4 = counted(a1, o1), counted(a2, o2), counted(a3, o3), counted(a4, o4)
    seen = lambda c: np.log(np.maximum(c, 1))
    s1 = np.where(o1 == 0, share(a1), np.where(c1 >= MIN_PAIR, seen(c1) - v.logs[o1], back + share(a1)))
    s2 = np.where(c2 >= MIN_PAIR, seen(c2) - log_of(a2), back + v.log_share(o2))
    s3 = np.where(c3 >= MIN_PAIR, seen(c3), back + share(a3))
    again = c4 >= MIN_PAIR
    rid = np.concatenate([r0, r1, r2, r3, r4[again]])
    logs = np.concatenate([pairs, s1, s2, s3, -log_of(a4[again])])
    docs, at = np.unique(rid, return_inverse=True)
    return docs, np.bincount(at, logs, len(docs))


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", word_rows: int = WORD_ROWS,
           word_share: float = WORD_SHARE, pair_rows: int = PAIR_ROWS, pair_share: float = PAIR_SHARE) -> DataFrame:
    """doc_id, n_words, lm_score (mean natural logarithm per word), one row per document."""
    spark = docs.sparkSession
    texts = docs.select(F.col(text).alias("text"))
    words = materialize(texts.mapInArrow(count_words, "h long, c long").groupBy("h").agg(F.sum("c").alias("c")),
                        "lm-words")
    total = words.agg(F.sum("c")).first()[0] or 0
    # at most MAX_WORDS rows, since their counts add up to no more than the total
    frequent = words.filter(F.col("c") >= least_rows(total, word_rows, word_share, MAX_WORDS)).toPandas()
    vocabulary = Vocabulary(frequent["h"].to_numpy(np.int64), frequent["c"].to_numpy(np.int64), total)
    shared = spark.sparkContext.broadcast((vocabulary.hashes, vocabulary.counts[1:], total))
    run = uuid.uuid4().hex
    pair_least = least_rows(total, pair_rows, pair_share, MAX_PAIRS)
    common = vocabulary.counts >= pair_least

    def worker_vocabulary() -> Vocabulary:
        cache = per_worker(("lm-vocabulary",), dict)  # of one corpus at a time
        if cache.get("run") != run:
            cache.update(run=run, vocabulary=Vocabulary(*shared.value))
        return cache["vocabulary"]

    def chained(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Codes of the words and of those before them, which of them start a text, words per text."""
        found, n = batch_words(texts)
        second = worker_vocabulary().codes(found)
        starts = np.zeros(len(second), bool)
        starts[(np.cumsum(n) - n)[n > 0]] = True
        return np.where(starts, 0, np.roll(second, 1)), second, starts, n

    def count_common(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [np.empty(0, np.int64)]
            for part in slices(batch, 0):
                first, second, _, _ = chained(part.column(0).to_pylist())
                both = common[np.maximum(first, 0)] & common[np.maximum(second, 0)]
                pairs.append(first[both] << BITS | second[both])
            found, n = np.unique(np.concatenate(pairs), return_counts=True)
            yield pa.record_batch([pa.array(found), pa.array(n.astype(np.int64))], ["pair", "c"])

    # at most MAX_PAIRS rows, by the same argument
    hot = (texts.mapInArrow(count_common, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))
           .filter(F.col("c") >= pair_least).orderBy("pair").toPandas())
    hot_pairs = hot["pair"].to_numpy(np.int64)
    hot_table = spark.sparkContext.broadcast((hot_pairs, vocabulary.log_pairs(hot_pairs, hot["c"].to_numpy(np.int64))))
    per_bucket = max(BUCKET_ROWS, 4 * int(total ** 0.5))
    buckets = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), total // per_bucket, 1)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list, list]]:
        hot_pairs, hot_logs = hot_table.value
        for batch in (part for whole in batches for part in slices(whole, 2)):
            v = worker_vocabulary()
            rid = batch.column(0).to_numpy(zero_copy_only=False)
            first, second, starts, n = chained(batch.column(2).to_pylist())
            row = np.repeat(np.arange(len(n)), n)
            at, is_hot = in_sorted(first << BITS | second, hot_pairs)
            is_hot &= (first > 0) & (second > 0)
            direct = np.zeros(len(second))
            alone = starts & (second > 0)
            direct[alone] = v.log_share(second[alone])
            direct[is_hot] = hot_logs[at[is_hot]]
            own = np.bincount(row, direct, len(n)) if len(row) else np.zeros(len(n))
            # the documents themselves, with what is known of their sums already
            ids, known = batch.column(1).fill_null(0).to_numpy(), batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            block, place = rid >> BLOCK_BITS, (rid & ((1 << BLOCK_BITS) - 1)).astype("<u2")
            rows = [(-1 - int(b), int(b), document_rows(place[s], ids[s], known[s], n[s], own[s]))
                    for b in np.unique(block) for s in [block == b]]
            yield rows, occurrences(first, second, starts, rid[row], is_hot | starts, buckets)

    held = COLLECTED

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return sent(pieces(batches), held)

    def join_counts(table: pa.Table) -> pa.Table:
        if table.column("bucket")[0].as_py() < 0:
            return table
        kinds = unpack(table.column("block").to_pylist(), table.column("payload").to_pylist())
        rid, sums = joined_sums(kinds, worker_vocabulary())
        block = rid >> BLOCK_BITS
        cut = np.flatnonzero(np.r_[True, np.diff(block) != 0]) if len(rid) else np.empty(0, np.int64)
        place = (rid & ((1 << BLOCK_BITS) - 1)).astype("<u2")
        rows = [(1, int(block[a]), place[a:b].tobytes() + sums[a:b].tobytes())
                for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(rid)])]
        return pa.Table.from_batches([rows_of(rows)])

    def add_up(table: pa.Table) -> pa.Table:
        own, places, parts = [], [], []
        for bucket, payload in zip(table.column("bucket").to_pylist(), table.column("payload").to_pylist()):
            if bucket < 0:
                own.append(np.frombuffer(payload, DOCUMENT))
            else:
                n = len(payload) // 10
                places.append(np.frombuffer(payload, "<u2", n))
                parts.append(np.frombuffer(payload, "<f8", n, 2 * n))
        rows = np.concatenate(own)
        sums = np.zeros(1 << BLOCK_BITS)
        if parts:
            sums = np.bincount(np.concatenate(places), np.concatenate(parts), 1 << BLOCK_BITS)
        return pa.table([pa.array(rows["id"].astype(np.int64), pa.int64(), mask=~rows["known"]), pa.array(rows["n"].astype(np.int64)),
                         pa.array(rows["own"] + sums[rows["place"]])], names=["doc_id", "n_words", "sum"])

    numbered = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(doc_id).cast("long").alias("doc_id"),
                           F.col(text).alias("text"))
    sums = (numbered.mapInArrow(send, PACKED).groupBy("bucket").applyInArrow(join_counts, PACKED)
            .groupBy("block").applyInArrow(add_up, "doc_id long, n_words long, sum double"))
    return sums.select("doc_id", "n_words", F.when(F.col("n_words") > 0, F.col("sum") / F.col("n_words")).alias("lm_score"))


#: A document in a packed row.
DOCUMENT = np.dtype([("place", "<u2"), ("id", "<i8"), ("known", "?"), ("n", "<i8"), ("own", "<f8")])


def document_rows(*columns: np.ndarray) -> bytes:
    rows = np.empty(len(columns[0]), DOCUMENT)
    for name, values in zip(DOCUMENT.names, columns):
        rows[name] = values
    return rows.tobytes()
