import pytest
from pyspark.sql import functions as F

from evalkit.llm import mixing

from .helpers import edge_table, empty_table


def brute_targets(sizes: dict, weights=(5, 2, 1), share=1.5, cap=2.0) -> dict:
    """Share by weight, cap, share the excess again among the others, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    left, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        room = left - sum(cap * sizes[s] for s in full)
        got = {s: room * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if got[s] > cap * sizes[s] + 1e-9}
        if not over:
            return {**got, **{s: cap * sizes[s] for s in full}}
        full |= over


def table(spark, n=900):
    source = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 50 == 1, F.lit(None)).otherwise(
        F.concat(F.lit("s"), (F.col("id") % 7).cast("string")))
    text = F.array_join(F.array_repeat(F.lit("w"), (F.col("id") % 13).cast("int")), " ")
    return spark.range(n).select(F.col("id").alias("doc_id"), text.alias("text"), source.alias("source"))


def test_targets_match_the_rule_and_copies_come_near(spark):
    rows = mixing.copies(table(spark)).collect()
    sizes: dict = {}
    for r in rows:
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
    want = brute_targets(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source])
        assert r.copies <= 2 and r.copies in (int(r.rate), int(r.rate) + 1)
    assert sum(want.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s, t in want.items():
        taken = sum(r.copies * r["size"] for r in rows if r.source == s)
        assert taken == pytest.approx(t, rel=0.35)


def test_reruns_and_the_salted_join_agree(spark, monkeypatch):
    one = sorted(map(tuple, mixing.copies(table(spark)).collect()), key=str)
    monkeypatch.setattr(mixing, "small_enough", lambda *a: False)
    assert one == sorted(map(tuple, mixing.copies(table(spark)).collect()), key=str)


def test_mix_emits_whole_rows(spark):
    docs = table(spark)
    want = {r.doc_id: r.copies for r in mixing.copies(docs).collect() if r.copies}
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns
    got = {r.doc_id: r["n"] for r in mixed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert got == want


def test_edge_rows(spark):
    plan = mixing.copies(edge_table(spark, {"size": "x", "target": "y", "copies": "z"}))
    rows = plan.collect()
    assert len(rows) == 11 and {r["size"] for r in rows if not (r.text or "").split()} == {0}
    assert all(r.copies <= 2 for r in rows)
    assert mixing.mix(empty_table(spark)).count() == 0
