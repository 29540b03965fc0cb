"""Near duplicates, fingerprints, language-model scores and the pipeline."""

import functools
import hashlib
import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from evalkit.llm import fingerprint, lm_score, near_dup, queries

from .helpers import edge_rows, edge_table, empty_table, prose


def edited(text: str, edits: int, seed: int) -> str:
    r, words = random.Random(seed), text.split()
    for i in r.sample(range(len(words)), edits):
        words[i] = f"edit{seed}x{i}"
    return " ".join(words)


def fixture() -> list[tuple[int, str]]:
    rows = []
    for g in range(12):  # groups of near copies of several lengths, in part beyond the threshold
        base = prose(1000 + g, 60 + 60 * g)
        rows.append((len(rows), base))
        rows += [(len(rows) + i, edited(base, e, 100 * g + i)) for i, e in enumerate((1, 2, 3, 5, 9, 20 + g))]
    rows += [(len(rows) + i, rows[i][1]) for i in range(20)]  # exact copies
    rows += [(len(rows) + i, "shared passage " + prose(77, 30) + " " + prose(5000 + i, 200)) for i in range(40)]
    rows += [(len(rows) + i, t) for i, t in enumerate(["", "", "one two", "one two", "One  two", "a b c d", "a b c d e"])]
    return rows


def brute_classes(rows):
    """Connected components over equal texts and pairs of labelled-shingle similarity 0.8."""
    def bag(text):
        w, seen, out = text.lower().split(), Counter(), set()
        for i in range(max(1, len(w) - 4) if w else 0):
            s = tuple(w[i:i + 5])
            out.add((s, seen[s]))
            seen[s] += 1
        return out
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    bags = [bag(t) for _, t in rows]
    for i, (a, ta) in enumerate(rows):
        for j in range(i):
            b, tb = rows[j]
            both = len(bags[i] & bags[j])
            if ta == tb or both and both >= 0.8 * (len(bags[i]) + len(bags[j]) - both):
                ra, rb = sorted((find(a), find(b)))
                parent[rb] = ra
    return {d: find(d) for d, _ in rows}


def test_classes_match_brute_force(spark, tmp_path):
    rows = fixture()
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r.class_id for r in queries.op9(spark, str(tmp_path)).collect()}
    assert got == brute_classes(rows)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(r.doc_id for r in near_dup.deduplicate(docs).collect()) == sorted(set(got.values()))


def test_near_duplicate_edge_rows(spark):
    docs = edge_table(spark, {"tid": "x", "root": "y", "class_id": "z"})
    got = near_dup.classes(docs).collect()
    assert len(got) == 11
    by_id = {r.doc_id: (r.class_id, r.class_size) for r in got}
    assert by_id[1] == (1, 1) and by_id[2] == (2, 1) and by_id[4] == (4, 3) and by_id[5] == (4, 3)
    once = near_dup.deduplicate(docs)
    assert once.columns == docs.columns
    # null texts are no document of any class; repeated rows leave one
    assert Counter(r.doc_id for r in once.collect()) == Counter([1, 2, 3, 4, None, 7, 8, 9, 10])
    assert near_dup.classes(empty_table(spark)).count() == 0
    assert near_dup.deduplicate(empty_table(spark)).count() == 0


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(0, 40)]
    star = [(100, i) for i in range(101, 150)]
    edges = spark.createDataFrame(random.Random(1).sample(chain + star, len(chain + star)), "a long, b long")
    got = {r.v: r.label for r in near_dup.components(edges).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 150)}}


def test_alignment_respects_order():
    h = np.arange(1, 101, dtype=np.uint64)
    assert near_dup.aligned(h, h) and near_dup.aligned(h, np.r_[h[:95], h[:5] + np.uint64(1000)])
    assert not near_dup.aligned(h, np.r_[h[50:], h[:50]])  # same shingles, halves swapped
    assert near_dup.aligned(h[:80], h) and not near_dup.aligned(h[:79], h)


def shingles(text: str) -> np.ndarray:
    import xxhash
    return near_dup.labelled_shingles(np.array([xxhash.xxh3_64_intdigest(w) for w in text.split()], np.uint64))


def test_the_smallest_values_are_found():
    factors = near_dup.mix(np.arange(1, 65, dtype=np.uint64)) | np.uint64(1)
    for n in (9, 48, 49, 200, 3000):
        h = near_dup.mix(np.arange(n, dtype=np.uint64))
        values = (h >> np.uint64(32)).astype(np.uint32)[None, :] * factors.astype(np.uint32)[:, None]
        assert (near_dup.smallest(h, factors, 8) == np.sort(np.argsort(values, axis=1)[:, :8], axis=1)).all()


def test_sketches_are_order_sensitive():
    h = shingles(prose(3, 300))
    assert len(set(h.tolist())) == len(h) == 296
    same = (near_dup.sketches(h) == near_dup.sketches(h.copy())).mean()
    swapped = (near_dup.sketches(h) == near_dup.sketches(np.r_[h[148:], h[:148]])).mean()
    assert same == 1 and swapped < 0.2
    twice = shingles("a b c d e " * 4)
    assert len(set(twice.tolist())) == len(twice)  # occurrence labels tell equal shingles apart


def test_op10_query(spark, tmp_path):
    rows = [(i * 3, prose(i, n)) for i, n in enumerate([0, 1, 3, 5, 80, 300, 300, 40, 1200] * 4)]
    rows[6] = (18, rows[5][1])  # equal texts, neighbours
    spark.createDataFrame(rows, "doc_id long, text string").repartition(4).write.parquet(f"{tmp_path}/documents.parquet")
    order = sorted(rows, reverse=True)
    want = {}
    for i, (d, t) in enumerate(order):
        following = order[(i + 1) % len(order)][1]
        half = len(t) // 2
        want[d] = (len(t), hashlib.sha256((t[:len(t) - half] + following[:half]).encode()).hexdigest())
    got = queries.op10(spark, str(tmp_path)).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == want
    prints = {r.doc_id: r.fingerprint for r in got}
    assert prints[15] == prints[18] and all(0 <= x <= 1 for r in got for x in (r.near_edited, r.near_next))
    assert {r.near_next for r in got if r.doc_id == 18} == {1.0}
    long = [r for r in got if r.n_chars > 1000 and r.doc_id != 18]
    assert all(0.25 < r.near_edited < 0.8 for r in long)


def test_sketches_merge_and_contain(spark):
    a, b = prose(1, 400), prose(2, 3000)
    df = spark.createDataFrame([(a, b, a + " " + b)], "a string, b string, ab string")
    s = df.select(*[fingerprint.sketch(F.col(c)).alias(c) for c in df.columns])
    r = s.select("a", "b", "ab", fingerprint.merge(F.col("a"), F.col("b")).alias("m"),
                 fingerprint.likeness(F.col("a"), F.col("ab")).alias("near")).first()
    assert set(r.a) | set(r.b) >= set(r.m) and r.near > 0.95
    assert len(set(r.m) ^ set(r.ab)) <= 4  # the shingles across the seam
    assert 60 < len(r.a) < 140  # a quarter of 396 shingles


def test_parity_sketches_never_rule_out_a_pair_that_matches():
    r = np.random.default_rng(2)
    for n in (5, 40, 300, 3000):
        for _ in range(20):
            a = r.integers(0, 2**63, n).astype(np.uint64)
            b = a.copy()
            gone = r.integers(0, n, n // 9)
            b[gone] = r.integers(0, 2**63, len(gone)).astype(np.uint64)
            differ = len(set(a.tolist()) ^ set(b.tolist()))
            bits = np.unpackbits((near_dup.parity(a) ^ near_dup.parity(b)).view(np.uint8)).sum()
            assert bits <= differ
    far = [near_dup.parity(r.integers(0, 2**63, 300).astype(np.uint64)) for _ in range(2)]
    assert np.unpackbits((far[0] ^ far[1]).view(np.uint8)).sum() > 2 * 300 / 9


def hand_sketch(text: str) -> list[int]:
    """The fingerprint from its definition, with the public hash function."""
    import struct

    import xxhash
    chain = lambda parts: functools.reduce(lambda seed, x: xxhash.xxh64_intdigest(struct.pack("<Q", x), seed), parts, 42)
    words = [xxhash.xxh64_intdigest(w.encode(), 42) for w in re.split("[ \t-\r]", text.lower()) if w]
    shingles = [chain(words[i:i + 5]) for i in range(len(words) - 4)] if len(words) >= 5 else [chain(words)] if words else []
    signed = {x - 2**64 if x >= 2**63 else x for x in shingles}
    below = {x for x in signed if x < -(2**63) + 2**64 // fingerprint.SCALE}
    return sorted(below or ({min(signed)} if signed else set()))


def test_fingerprints_and_likeness_match_their_definition(spark):
    rows = [(i, prose(i, n)) for i, n in enumerate([0, 1, 4, 5, 6, 9, 30, 200, 900])] + [(50, "Ärger  é\n中文 x Y z"), (51, "a b " * 40)]
    df = spark.createDataFrame(rows, "i int, t string").select("i", "t", fingerprint.sketch(F.col("t")).alias("s"))
    got = {r.i: r.s for r in df.collect()}
    assert got == {i: hand_sketch(t) for i, t in rows}
    pairs = df.alias("a").crossJoin(df.alias("b")).select(F.col("a.i"), F.col("b.i").alias("j"),
                                                          fingerprint.likeness(F.col("a.s"), F.col("b.s")).alias("x")).collect()
    least = -(2**63) + 2**64 // fingerprint.SCALE
    for r in pairs:
        a, b = set(got[r.i]), set(got[r.j])
        want = 1.0 if a == b else 0.0 if not a else len(a & b) / len(a) if min(a) < least else None
        assert r.x == (want if want is None else pytest.approx(want))


def test_short_texts_inside_longer_ones_are_contained_or_undecided(spark):
    rows = []
    for i in range(400):
        n = (5, 6, 8, 12)[i % 4]
        part = " ".join(f"w{i}x{k}" for k in range(n))
        rows.append((n, part, prose(i, 60) + " " + part + " " + prose(i + 1000, 60)))
    s = spark.createDataFrame(rows, "n int, a string, b string").select("n", fingerprint.likeness(
        fingerprint.sketch(F.col("a")), fingerprint.sketch(F.col("b"))).alias("x")).collect()
    assert {r.x for r in s if r.x is not None} == {1.0}
    told = Counter(r.n for r in s if r.x is not None)
    assert told[5] > 10 and told[12] > 80  # one shingle in four, and nearly all


def test_fingerprint_over_many_ranges_and_edge_rows(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "RANGE_ROWS", 7)
    docs = spark.range(200).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id")).alias("text"))
    got = {r.doc_id: r.next_text for r in fingerprint.with_next(docs).collect()}
    assert got == {i: f"text {(i - 1) % 200}" for i in range(200)}
    rows = fingerprint.with_edited(fingerprint.with_next(edge_table(spark, {"sketch": "x", "range": "y"}))).collect()
    assert len(rows) == 11 and Counter(r.text for r in rows) == Counter(t or "" for _, t, *_ in edge_rows())
    assert Counter(r.next_text for r in rows) == Counter(r.text for r in rows)
    assert fingerprint.with_next(empty_table(spark)).count() == 0


def brute_lm(texts):
    words = [(t or "").split() for t in texts]
    uni = Counter(w for ws in words for w in ws)
    total = sum(uni.values())
    pairs = Counter(p for ws in words for p in zip(ws, ws[1:]))
    out = []
    for ws in words:
        logs = [math.log(uni[w] / total) for w in ws[:1]]
        logs += [math.log(pairs[v, w] / uni[v]) if pairs[v, w] >= 2 else math.log(0.4 * uni[w] / total)
                 for v, w in zip(ws, ws[1:])]
        out.append(sum(logs) / len(logs) if logs else None)
    return out


SHARES = [{}, {"word_share": 0.01, "pair_share": 0.005}, {"word_share": 0.002, "pair_share": 1.0},
          {"word_share": 1.0, "pair_share": 1.0}, {"word_rows": 30, "pair_rows": 5, "word_share": 1.0, "pair_share": 1.0}]


@pytest.mark.parametrize("options", SHARES)
def test_scores_match_brute_force(spark, options):
    texts = [prose(i % 40, 20 + i) for i in range(60)] + [None, "", "word", "a a a a", "rare rarer rare rarer rarest", "rare rarer"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.lm_score for r in lm_score.scores(docs, **options).collect()}
    assert len(got) == len(texts)
    for i, want in enumerate(brute_lm(texts)):
        assert got[i] is None if want is None else got[i] == pytest.approx(want)


def test_scores_with_small_flushes_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "COLLECTED", 50)
    monkeypatch.setattr(lm_score, "BUCKET_ROWS", 100)
    texts = [prose(i % 30, 15 + i % 50) for i in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2)
    got = {r.doc_id: r.lm_score for r in lm_score.scores(docs, word_share=0.004, pair_share=0.002).collect()}
    assert [got[i] for i in range(300)] == pytest.approx(brute_lm(texts))


@pytest.mark.parametrize("copies", [1, 30])
def test_random_strings_score_below_the_corpus_at_every_size(spark, copies):
    """Rare words keep their own counts, so noise does not gain by the corpus's size."""
    r = random.Random(3)
    noise = [" ".join("".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(9)) for _ in range(60)) for _ in range(20)]
    texts = [prose(i, 80) for i in range(40)] * copies
    docs = spark.createDataFrame(list(enumerate(noise + texts)), "doc_id long, text string")
    got = {x.doc_id: x.lm_score for x in lm_score.scores(docs, word_share=1e-4, pair_share=1e-3).collect()}
    assert max(got[i] for i in range(20)) < min(got[i] for i in range(20, len(got)))


def test_packed_rows_come_back_as_they_were():
    r = np.random.default_rng(5)
    kinds = [(r.integers(0, 4, 50), r.integers(0, 1 << 18, 50), *[r.integers(0, 1 << 8 * n - 1, 50) if n < 8 else
                                                                 r.integers(-2**63, 2**63 - 1, 50) for n in sizes])
             for sizes in lm_score.KEY_BYTES]
    rows = list(lm_score.pack(kinds))
    back = lm_score.unpack([b for _, b, _ in rows], [p for _, _, p in rows])
    for (_, *want), got in zip(kinds, back):
        assert sorted(zip(*[x.tolist() for x in want])) == sorted(zip(*[x.tolist() for x in got]))


def test_sending_holds_a_bounded_part_of_a_task():
    """Three million occurrences of one task; kept whole, they and their copies took 300 MB of a worker."""
    r = np.random.default_rng(6)

    def pieces():
        none = np.empty(0, np.int64)
        for i in range(30):
            rid = np.arange(100_000) // 100 + 1000 * i
            yield ([(-1, 0, b"documents")], [(r.integers(0, 200, 100_000), rid, r.integers(0, 1 << 40, 100_000)),
                                             *[(none,) * (2 + len(n)) for n in lm_score.KEY_BYTES[1:]]])

    tracemalloc.start()
    try:
        n = 0
        for batch in lm_score.sent(pieces(), lm_score.COLLECTED):
            payloads = [(b, p) for b, p in zip(batch.column("block").to_pylist(), batch.column("payload").to_pylist())
                        if p != b"documents"]
            assert sum(len(p) for _, p in payloads[:-1]) < lm_score.SENT_BYTES
            n += len(lm_score.unpack(*map(list, zip(*payloads)))[0][0]) if payloads else 0
        assert n == 3_000_000 and tracemalloc.get_traced_memory()[1] < 128 * 2**20
    finally:
        tracemalloc.stop()


def test_slices_are_bounded_and_whole():
    texts = [None, "", "a" * 700_000, "b" * 700_000, None, "c" * 3_000_000, "d"] + ["e" * 1000] * 3000 + [None]
    batch = pa.record_batch([pa.array(range(len(texts))), pa.array(texts)], ["rid", "text"])
    parts = [p.column(1).to_pylist() for p in lm_score.slices(batch, 1)]
    assert [t for p in parts for t in p] == texts
    assert all(sum(len(t or "") for t in p[1:]) <= lm_score.SLICE_BYTES for p in parts) and len(parts) > 5
    assert list(lm_score.slices(batch.slice(0, 0), 1)) == []


def test_a_worker_keeps_the_numbers_of_frequent_words_alone():
    words = [b"often", b"rare", b"often", b"seldom", b"rare"]
    v = lm_score.Vocabulary(lm_score.digest([b"often"]), np.array([9]), 12)
    for _ in range(2):
        assert v.codes(words).tolist() == [1, *lm_score.digest([b"rare"]), 1, *lm_score.digest([b"seldom", b"rare"])]
        assert v.known == {b"often": 1}


def test_score_edge_rows(spark):
    rows = lm_score.scores(edge_table(spark, {"rid": "x", "n_words": "y"})).collect()
    assert len(rows) == 11 and len({r.lm_score for r in rows if r.doc_id in (4, 5)}) == 1
    assert all((r.lm_score is None) == (r.n_words == 0) for r in rows)
    assert lm_score.scores(empty_table(spark)).count() == 0


def test_pipeline_keeps_clean_documents_and_drops_copies(spark, tmp_path):
    clean = [(i, prose(i, 150), "en", f"s{i % 3}", 0) for i in range(40)]
    rows = clean + [(100 + i, edited(clean[i][1], 1, i), "en", "s0", 0) for i in range(10)]
    rows += [(200, None, "en", "s1", 0), (201, "# $ %", "en", "s1", 0), (202, "too short", "en", "s1", 0)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(
        f"{tmp_path}/documents.parquet")
    docs, seen = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, str(tmp_path)).persist()
        seen[name] = [r.doc_id for r in docs.select("doc_id").collect()]
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == before.columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert {200, 201}.isdisjoint(seen[names[0]]) and set(range(40)) <= set(seen[names[0]])
    assert sorted(seen[names[1]]) == [*range(40), *range(100, 110)]
    assert sorted(seen[names[2]]) == list(range(40))
    assert set(seen[names[3]]) <= set(range(40)) and max(Counter(seen[names[3]]).values()) <= 2
    assert sorted(seen[names[4]]) == sorted(seen[names[3]])
    assert docs.filter("not round_trip").count() == 0


def test_pipeline_run_and_empty_table(spark, tmp_path):
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert out.count() > 0 and out.filter("not round_trip or n_tokens != size(ids)").count() == 0
    empty_table(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
