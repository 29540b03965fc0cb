"""Operators on public tokenizers, against the libraries themselves."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from evalkit.llm import bpe, common, langid, queries, token_count, token_files

from .helpers import edge_rows, edge_table, empty_table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = ["'", "'", "s", "t", "r", "e", "v", "l", "d", "m", "a", "Z", "é", " ", " ", "\n", "\t", " ", "1", "٣",
            ".", "!", "😀", "́", "\x1c", "\x85", "中", "'re", "▁", "</s>", "   "]


def noise(n=3000):
    r = random.Random(5)
    return ["".join(r.choice(ALPHABET) for _ in range(r.randrange(40))) for _ in range(n)]


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken
    with open(RANKS, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_boundaries_and_merges_match_the_library(tiktoken_encoding):
    texts = noise() + ["", "'", "'s", "x" * 3000, "ab" * 2000 + "'s", " " * 700, "\n", "a\n"]
    coder = bpe.ByteBpe(RANKS)
    ids, offsets = coder.encode(texts)
    for text, got, at in zip(texts, ids, offsets):
        assert got.tolist() == tiktoken_encoding.encode_ordinary(text)
        assert coder.decode(got) == text.encode()
        cuts = [*at.tolist(), len(text)]
        assert [i for a, b in zip(cuts, cuts[1:]) for i in coder.merge(text[a:b].encode())] == got.tolist()


def test_boundaries_do_not_depend_on_the_batch():
    texts = noise(300)
    coder = bpe.ByteBpe(RANKS)
    assert [x.tolist() for x in coder.encode(texts)[0]] == [coder.encode([t])[0][0].tolist() for t in texts]


def test_a_batch_is_encoded_a_few_texts_at_a_time(spark):
    import pyarrow as pa
    texts = [None, "", *noise(400), "y" * (common.CHUNK + 5), *["plain words, " * 9000] * 8, None]
    parts = list(bpe.round_trip(RANKS).func(iter([pa.array(texts)])))
    got = [x for part in parts for x in part.to_pylist()]
    want = bpe.ByteBpe(RANKS).encode([t or "" for t in texts])
    assert [(x["ids"], x["offsets"]) for x in got] == [(i.tolist(), o.tolist()) for i, o in zip(*want)]
    assert [x["decoded"] for x in got] == [(t or "").encode() for t in texts]
    for part in parts:  # a text longer than that has a part of its own, but for empty ones
        lengths = [len(x.decode()) for x in part.field("decoded").to_pylist()]
        assert sum(lengths) <= common.CHUNK or sum(n > 0 for n in lengths) == 1


def peak_of(run) -> int:
    """Most bytes that ``run`` holds at once."""
    import tracemalloc
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_arrays_of_a_batch_stay_small(spark):
    import pyarrow as pa
    batch = pa.array(["plain words, " * 300] * 1000)  # about as much as one batch holds
    encode, model = bpe.round_trip(RANKS).func, langid.fit(["plain words", "mots simples"] * 10, ["en", "fr"] * 10)
    predict = langid.predictor(model).func
    for _ in encode(iter([batch[:1]])):
        pass  # the table of ranks is there
    assert peak_of(lambda: [None for _ in encode(iter([batch]))]) < 40 << 20
    list(predict(iter([batch[:1]])))
    assert peak_of(lambda: [None for _ in predict(iter([batch]))]) < 64 << 20


def test_a_worker_lets_old_objects_go_first():
    import gc
    import weakref

    class Held:
        pass

    old = weakref.ref(common.per_worker(("old",), Held))
    assert old() is not None and common.per_worker(("old",), Held) is old()
    seen = []

    def make():
        gc.collect()
        seen.append(old())
        return common.per_worker(("part",), Held), Held()

    new = common.per_worker(("new",), make)
    assert seen == [None]
    assert common.per_worker(("new",), make) is new and common.per_worker(("part",), Held) is new[0]


def test_piece_counts_match_the_library():
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    texts = noise() + [" " * k for k in range(70)] + ["", "a ", " a", "x" * 500]
    counter = token_count.PieceCounter(PIECES)
    assert counter(texts) == [len(x) for x in model.encode(texts, num_threads=1)]
    counter.known = dict(counter.single)  # a forgotten table changes nothing
    assert counter(texts[:500]) == [len(x) for x in model.encode(texts[:500], num_threads=1)]


def test_a_full_table_of_counts_changes_nothing(monkeypatch):
    texts = noise(400)
    want = token_count.PieceCounter(PIECES)(texts)
    monkeypatch.setattr(token_count, "KEPT", 16_000)
    counter = token_count.PieceCounter(PIECES)
    assert [n for t in texts for n in counter([t])] == want


def test_edge_rows(spark):
    extra = {"ids": "x", "n_tokens": "y", "offsets": "z"}
    rows = bpe.encode_documents(edge_table(spark, extra), RANKS).collect()
    assert [bytes(r.decoded).decode() for r in rows] == [t or "" for _, t, *_ in edge_rows()]
    rows = token_count.token_counts(edge_table(spark, extra), PIECES).collect()
    assert [r.n_bytes for r in rows] == [len((t or "").encode()) for _, t, *_ in edge_rows()]
    assert rows[0].n_tokens == 0 and any(r.over_limit for r in rows)
    assert bpe.encode_documents(empty_table(spark), RANKS).count() == 0
    assert token_count.token_counts(empty_table(spark), PIECES).count() == 0


def test_op6_and_op8_queries(spark, tiktoken_encoding, tmp_path):
    import sentencepiece
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    edge_table(spark).filter("doc_id is not null").dropDuplicates(["doc_id"]).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {d: t or "" for d, t, *_ in edge_rows() if d is not None}
    for r in queries.op6(spark, str(tmp_path)).collect():
        assert r.n_tokens == len(model.encode(texts[r.doc_id])) and r.over_limit == (r.n_tokens > 4096)
    for r in queries.op8(spark, str(tmp_path)).collect():
        ids = tiktoken_encoding.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest()


def library_chain(rows):
    from tokenizers import Tokenizer
    tokenizer, start = Tokenizer.from_file(WORDS), 0
    for doc_id, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        yield doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_token_files_hold_the_chain(spark):
    folder = token_files.token_folder(spark)
    rows = [(r[0], r[1]) for r in edge_rows() if r[0] is not None and r[0] != 4] + [(100 + i, t) for i, t in enumerate(noise(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    found = token_files.write(docs, WORDS, folder, sequence=64, rows=4)
    got = sorted(map(tuple, token_files.read(found, folder, rows=4).collect()))
    assert got == list(library_chain(sorted(rows, key=lambda r: r[0])))


def test_token_files_with_equal_and_null_ids(spark):
    folder = token_files.token_folder(spark)
    got = token_files.read(token_files.write(edge_table(spark, {"start": "x"}), WORDS, folder), folder).collect()
    assert len(got) == 11
    chain = sorted(got, key=lambda r: r.start)
    assert [r.start for r in chain] == [sum(x.n_tokens for x in chain[:i]) for i in range(11)]
    assert chain[0].doc_id is None and len({r.ids_crc32 for r in got if r.doc_id == 4}) == 1
    folder = token_files.token_folder(spark)
    assert token_files.read(token_files.write(empty_table(spark), WORDS, folder), folder).count() == 0


def test_sequences_and_masks_are_read_in_place(tmp_path):
    import pyarrow as pa
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as sink:
        writer = token_files.SequenceWriter(sink, "<u2", 8, 2)
        writer.add(np.arange(21, dtype="<u2"))
        writer.close()
    reader = token_files.SequenceReader(pa.memory_map(str(tmp_path / "x.arrow")), 2)
    assert reader.span(3, 15).tolist() == list(range(3, 18))
    last = reader.sequences(1)
    assert last.column("mask").to_pylist() == [[True] * 5 + [False] * 3]


def test_op2_query(spark, tmp_path):
    rows = [(i, t) for i, t in enumerate(noise(60))]
    spark.createDataFrame(rows, "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(map(tuple, queries.op2(spark, str(tmp_path)).collect())) == list(library_chain(rows))


def test_a_tokenizer_that_keeps_spaces_encodes_whole_texts():
    encoder = token_files.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not encoder.by_piece and token_files.Encoder(WORDS).by_piece
    want = encoder.tokenizer.encode("two words", add_special_tokens=False).ids
    assert np.frombuffer(encoder(["two words"])[0], encoder.kind).tolist() == want
