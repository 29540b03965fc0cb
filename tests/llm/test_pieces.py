"""Pair-merge pieces by the prefix table, against the library."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F

from evalkit.llm import piece_bpe, queries

from .helpers import edge_rows, edge_table, empty_table

PIECES = public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["a", "th", "e", "ing", "▁", " ", "    ", " " * 17, "\n", "\t", "é", "中", "梦", "😀", "\x00", "<s>", "</s>", "<0x0A>",
            "1", "23", "...", "==", "//", "x" * 9, "​", "и", "ﬁ"]


@pytest.fixture(scope="module")
def model():
    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


@pytest.fixture(scope="module")
def coder():
    return piece_bpe.PieceBpe(PIECES)


def texts():
    r = random.Random(4)
    noise = ["".join(r.choice(ALPHABET) for _ in range(r.randrange(30))) for _ in range(4000)]
    return noise + ["", " ", "x" * 5000, "ab" * 3000, "中文" * 2000, " " * 300, "".join(map(chr, range(0x20, 0x2000)))]


def test_ids_and_texts_match_the_library(model, coder):
    rows = texts()
    packed = [coder.encode(t) for t in rows]
    expected = model.encode(rows, add_bos=True, add_eos=True, num_threads=1)
    assert [np.frombuffer(p, "<u4").tolist() for p in packed] == expected
    assert coder.decode(packed) == model.decode(expected)
    assert coder.decode([]) == []


def test_joined_pieces_match_the_library(model, coder):
    r = random.Random(8)
    pieces = [model.id_to_piece(i) for i in range(model.get_piece_size())]
    rows = ["".join(r.choice(pieces) for _ in range(r.randrange(1, 8))).replace("▁", " ") for _ in range(6000)]
    expected = model.encode(rows, add_bos=True, add_eos=True, num_threads=1)
    assert [np.frombuffer(coder.encode(t), "<u4").tolist() for t in rows] == expected


def test_a_prefix_has_one_last_token(coder):
    """The stored last token of every prefix is the last part that the merges leave of it."""
    for word in ("▁unbelievable", "▁▁▁the", "▁" * 9 + "x", "internationalisation", "aaaaaaaaaaaaa", "▁1234567"):
        last = coder.last_tokens(word)
        for end in range(1, len(word) + 1):
            assert coder.tokens[last[end]] == coder.merges.parts(word[:end])[-1]


def test_compatible_pairs_are_those_the_merges_leave(coder):
    r = random.Random(2)
    whole = [t for t in r.sample(coder.tokens, 400) if coder.merges.order(t)]
    for _ in range(3000):
        a, b = r.choice(whole), r.choice(whole)
        assert coder.merges.compatible(a, b) == (coder.merges.parts(a + b) == [a, b])


def test_merges_of_equal_scores_go_left_first():
    merges = piece_bpe.Merges({"aa": -1.0, "ab": -1.0, "ba": -1.0, "aab": -2.0})
    assert merges.parts("aab") == ["aab"] and merges.parts("bab") == ["ba", "b"]
    for a, b in (("a", "ab"), ("aa", "b"), ("ba", "b"), ("b", "ab"), ("aa", "aa"), ("aab", "a")):
        assert merges.compatible(a, b) == (merges.parts(a + b) == [a, b])


def test_bounded_tables_change_nothing(coder, model, monkeypatch):
    monkeypatch.setattr(piece_bpe, "KEPT", 3)
    monkeypatch.setattr(piece_bpe, "KEPT_PAIRS", 5)
    small = piece_bpe.PieceBpe(PIECES)
    for t in texts()[:300]:
        assert small.encode(t) == coder.encode(t)
    assert len(small.known) <= 3 and len(small.pairs) <= 5


def test_documents(spark, model):
    extra = {k: "x" for k in ("packed", "decoded", "ids", "n_tokens")}
    for df in (edge_table(spark), edge_table(spark, extra)):
        rows = piece_bpe.encode_documents(df, PIECES).select("doc_id", "text", "ids", "decoded").collect()
        assert len(rows) == len(edge_rows())
        for r in rows:
            expected = model.encode(r.text or "", add_bos=True, add_eos=True)
            assert r.ids == expected and r.decoded == model.decode(expected)
    assert piece_bpe.encode_documents(empty_table(spark), PIECES).count() == 0


def test_query_digests(spark, model):
    rows = {r.doc_id: r for r in queries.QUERIES["op13_piece_bpe"](spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("t")).collect()
    assert len(rows) == len(docs)
    for d in docs:
        ids = model.encode(d.t, add_bos=True, add_eos=True)
        assert tuple(rows[d.doc_id]) == (d.doc_id, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                                         hashlib.sha256(model.decode(ids).encode()).hexdigest())
