"""The Merkle manifest, against a tree built node by node."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from evalkit.llm import merkle

from .helpers import SCHEMA, edge_rows, edge_table, empty_table


def H(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(row, text):
    doc_id, _, lang, source, n_chars = row
    return H("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def grow(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H("".join(levels[-1][i:i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def beside(levels, i):
    for nodes in levels[:-1]:
        start = i // 8 * 8
        yield "".join(nodes[start:i]), "".join(nodes[i + 1:start + 8])
        i //= 8


def by_hand(rows, tampered):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    first = lambda r: (r[0] is not None, r[0] or 0, leaf(r, r[1]))
    order = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {g: grow([leaf(r, r[1]) for r in sorted(groups[g], key=first)]) for g in order}
    top, out = grow([trees[g][-1][0] for g in order]), []
    for k, g in enumerate(order):
        for i, r in enumerate(sorted(groups[g], key=first)):
            path = [*beside(trees[g], i), *beside(top, k)]
            text = r[1].translate({c: c + 32 for c in range(65, 91)}) if tampered(r[0]) and r[1] is not None else r[1]
            d = leaf(r, text)
            for a, b in path:
                d = H(a + d + b)
            out.append((r[0], trees[g][0][i], trees[g][-1][0], top[-1][0], H("".join(a + b for a, b in path)), d, d == top[-1][0]))
    return sorted(out, key=repr)


def audited(df):
    found = merkle.audit(df, F.col("doc_id") % 3 == 0, merkle.lowered(F.col("text")))
    names = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    return sorted(map(tuple, found.select(*names).collect()), key=repr)


THIRD = lambda i: i is not None and i % 3 == 0


def documents(n, langs, seed=1):
    r = random.Random(seed)
    return [(i, f"Text {r.random()} ÄB", r.choice(langs), "s", i) for i in range(n)]


@pytest.mark.parametrize("n, langs", [(1, ["en"]), (8, ["en"]), (9, ["en"]), (65, ["en"]), (700, ["en", None, "é", "z", "en", "en"]),
                                      (150, [f"l{k}" for k in range(70)])])
def test_trees_proofs_and_roots(spark, n, langs):
    rows = documents(n, langs)
    got = audited(spark.createDataFrame(rows, SCHEMA))
    assert got == by_hand(rows, THIRD)
    assert any(not r[-1] for r in got) and (n < 2 or any(r[-1] for r in got))


def test_edges(spark):
    rows = edge_rows()
    assert audited(edge_table(spark)) == by_hand(rows, THIRD)
    named = {k: "x" for k in ("leaf", "rank", "group", "size", "path", "digest", "root", "_llm_at")}
    assert audited(edge_table(spark, named)) == by_hand(rows, THIRD)
    assert audited(empty_table(spark)) == []
    repeated = [(5, "Same", "en", "a", 4)] * 40 + documents(20, ["en"])
    assert audited(spark.createDataFrame(repeated, SCHEMA)) == by_hand(repeated, THIRD)


def test_proofs_of_some_leaves(spark):
    rows = documents(200, ["en", "de"])
    placed = merkle.materialize(merkle.leaves(spark.createDataFrame(rows, SCHEMA)), "test-leaves")
    found, subroots = merkle.manifest(placed)
    some = merkle.proofs(found, subroots, placed.filter("doc_id % 20 = 0"))
    folded = some.select("doc_id", (merkle.fold(F.col("leaf"), F.col("path")) == F.col("root")).alias("ok"),
                         (merkle.fold(F.reverse("leaf"), F.col("path")) == F.col("root")).alias("wrong")).collect()
    assert sorted(r.doc_id for r in folded) == list(range(0, 200, 20)) and all(r.ok and not r.wrong for r in folded)
