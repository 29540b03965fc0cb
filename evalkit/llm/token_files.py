"""Token ids in Arrow files of equal-length sequences.

Documents are put in order by range partitioning, so each task holds a contiguous run
of them. A task encodes its run, chains the ids (each document closed by an end id) and
writes one Arrow IPC file: record batches of two fixed-size-list columns, the ids of a
sequence and its mask (true: an id, false: padding, which only the last sequence of a
file has). Any sequence, and so any span of the chain, is read at a computed position
without a copy. What a task wrote is listed in an index table, one row per document; it
names the file, so that files of lost or repeated attempts are never read.

Encoding goes through the tokenizer. Where it drops white space and never joins what a
space or a line feed parts (probed when it is loaded), texts are cut there and the ids
of frequent pieces are kept in a bounded table.

Defined cases: a null or empty text is its end id alone; rows with one id follow each
other in the order of a hash of the text, null ids first; texts of any length are
encoded whole; an empty table gives no file and an empty index; extra columns are not
carried.
"""

from __future__ import annotations

import gc
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalkit.llm.common import per_worker
from evalkit.session import scratch_path

SEQUENCE, ROWS = 1024, 256
#: Pieces whose ids a worker keeps, and the longest (characters) that it keeps.
KEPT, KEPT_CHARS = 300_000, 48
#: Words encoded together.
TOGETHER = 64
INDEX = "doc_id long, shard int, file string, start long, n_tokens long"


class Encoder:
    """Ids of texts, as the bytes of little-endian unsigned integers.

    What the tokenizer treats alike is probed once: whether a space or a line feed parts
    its input, whether case matters, whether a stop or comma after a letter stands alone,
    and whether a token's suffix marks the end of a word (then words are encoded together
    and their ids told apart)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        self.kind = id_type(self.tokenizer.get_vocab_size())
        self.code = "H" if self.kind == "<u2" else "I"
        self.known: dict[str, bytes] = {}
        one = lambda t: self._ids([t])[0]
        probes = ["a b", "a\nb", "a  b", " a", "a ", "\n", "Ab, c.\n\nd's 12 e"]
        self.by_piece = all(one(p) == b"".join(self._ids(p.replace("\n", " ").split(" "))) for p in probes)
        self.any_case = all(one(w) == one(w.lower()) for w in ("Abc", "THE", "iPhone"))
        self.stops = {c: one(c) for c in ".," if all(one(w + c) == one(w) + one(c) for w in ("a", "the", "Xyz"))}
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = None
        if self.by_piece and suffix:
            self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
            self.ends[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith(suffix)]] = True
        plain = "abc the zyzzyva".split()
        self.plain = all(self._model(w) == one(w) for w in plain) if self.any_case else False

    def _ids(self, texts: list[str]) -> list[bytes]:
        code = self.code
        return [array(code, e.ids).tobytes() for e in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _model(self, word: str) -> bytes:
        return array(self.code, [t.id for t in self.tokenizer.model.tokenize(word)]).tobytes()

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of words of letters only, encoded together."""
        out: list[bytes] = []
        for i in range(0, len(words), TOGETHER):
            part = words[i:i + TOGETHER]
            ids = np.array(self.tokenizer.encode(" ".join(part), add_special_tokens=False).ids, self.kind)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            if len(cuts) != len(part) or len(ids) != (cuts[-1] if len(cuts) else 0):
                out += self._ids(part)
            else:
                out += [ids[a:b].tobytes() for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist())]
        return out

    def _encode(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of distinct pieces. A stop or comma that ends one is left off, and a plain word
        goes to the model at once, in lower case if case does not matter."""
        known, stops, any_case, plain = self.known, self.stops, self.any_case, self.plain
        out, got, later, words, rest = {}, {}, [], [], []
        for p in pieces:
            core, tail = p, b""
            if len(p) > 1 and p[-1] in stops and p[-2].isascii() and p[-2].isalpha():
                core, tail = p[:-1], stops[p[-1]]
            if any_case and core.isascii() and core.isalpha():
                core = core.lower()
                if plain and len(core) <= KEPT_CHARS:
                    ids = known.get(core) or got.get(core)
                    if ids is None:
                        ids = got[core] = self._model(core)
                    out[p] = ids + tail if tail else ids
                    continue
            later.append((p, core, tail))
            if core not in got:
                got[core] = known.get(core)
                if got[core] is None:
                    (words if self.ends is not None and core.isalpha() else rest).append(core)
        got.update(zip(words, self._words(words)))
        got.update(zip(rest, self._ids(rest)))
        out.update([(p, got[core] + tail) for p, core, tail in later])
        return out

    def __call__(self, texts: list[str]) -> list[bytes]:
        if not self.by_piece:
            return self._ids(texts)
        # nothing made here refers to itself, so collecting cycles would only walk long lists
        gc.disable()
        try:
            return self._joined([t.replace("\n", " ").split(" ") for t in texts])
        finally:
            gc.enable()

    def _joined(self, split: list[list[str]]) -> list[bytes]:
        known = self.known
        new = list(set().union(*split).difference(known))
        known.update(self._encode(new))
        out = [b"".join(map(known.__getitem__, parts)) for parts in split]
        # frequent pieces come early, so a full table keeps what it has
        if len(known) > KEPT:
            for p in new[max(0, len(new) - (len(known) - KEPT)):]:
                del known[p]
        for p in new:
            if len(p) > KEPT_CHARS:
                known.pop(p, None)
        return out


def id_type(n: int) -> str:
    return "<u2" if n <= 1 << 16 else "<u4"


def file_system(uri: str):
    """The file system and the path of a folder all machines share."""
    from pyarrow import fs
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:"):]
    return fs.FileSystem.from_uri(uri)


class SequenceWriter:
    """Chains ids and writes them as fixed-length sequences with masks."""

    def __init__(self, sink, kind: str, sequence: int, rows: int):
        item = pa.from_numpy_dtype(np.dtype(kind))
        self.schema = pa.schema([("input_ids", pa.list_(item, sequence)), ("mask", pa.list_(pa.bool_(), sequence))])
        self.sequence, self.block, self.kind = sequence, sequence * rows, kind
        self.writer = pa.ipc.new_file(sink, self.schema)
        self.parts: list[np.ndarray] = []
        self.pending = 0

    def add(self, ids: np.ndarray) -> None:
        self.parts.append(ids)
        self.pending += len(ids)
        if self.pending >= self.block:
            chain = np.concatenate(self.parts)
            whole = len(chain) // self.block * self.block
            for at in range(0, whole, self.block):
                self._write(chain[at:at + self.block], self.block)
            self.parts, self.pending = [chain[whole:]], len(chain) - whole

    def _write(self, ids: np.ndarray, n: int) -> None:
        columns = [pa.array(ids), pa.array(np.arange(len(ids)) < n)]
        self.writer.write_batch(pa.record_batch([pa.FixedSizeListArray.from_arrays(c, self.sequence) for c in columns],
                                                schema=self.schema))

    def close(self) -> None:
        if self.pending:
            ids = np.concatenate(self.parts)
            room = -(-len(ids) // self.sequence) * self.sequence
            self._write(np.concatenate([ids, np.zeros(room - len(ids), self.kind)]), len(ids))
        self.writer.close()


class SequenceReader:
    """Spans of the chain of one file, by position."""

    def __init__(self, source, rows: int):
        self.reader = pa.ipc.open_file(source)
        self.sequence = self.reader.schema.field("input_ids").type.list_size
        self.block = self.sequence * rows
        self.at, self.chain = -1, None

    def sequences(self, i: int) -> pa.RecordBatch:
        """The record batch ``i``: ids and masks, not copied."""
        return self.reader.get_batch(i)

    def _ids(self, i: int) -> np.ndarray:
        if i != self.at:
            self.at, self.chain = i, self.sequences(i).column(0).flatten().to_numpy(zero_copy_only=True)
        return self.chain

    def span(self, start: int, n: int) -> np.ndarray:
        out = []
        while n > 0:
            i, skip = divmod(start, self.block)
            part = self._ids(i)[skip:skip + n]
            out.append(part)
            start, n = start + len(part), n - len(part)
        return out[0] if len(out) == 1 else np.concatenate(out)


def write(docs: DataFrame, tokenizer: str, folder: str, doc_id: str = "doc_id", text: str = "text",
          end_id: int = 1, sequence: int = SEQUENCE, rows: int = ROWS) -> DataFrame:
    """Write the files to ``folder``; returns their index (also written there)."""
    spark = docs.sparkSession
    fs, base = file_system(folder)
    fs.create_dir(f"{base}/sequences", recursive=True)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import uuid

        from pyspark import TaskContext
        encoder = per_worker(("tokenizer", tokenizer), lambda: Encoder(tokenizer))
        shard = TaskContext.get().partitionId()
        name = f"sequences/{shard:06d}-{uuid.uuid4().hex}.arrow"
        writer = sink = None
        chain = 0
        end = np.array([end_id], encoder.kind).tobytes()
        for batch in batches:
            if writer is None:
                shared, place = file_system(folder)
                sink = shared.open_output_stream(f"{place}/{name}")
                writer = SequenceWriter(sink, encoder.kind, sequence, rows)
            ids = [np.frombuffer(b + end, encoder.kind) for b in encoder([t or "" for t in batch.column(1).to_pylist()])]
            n = np.array([len(x) for x in ids], np.int64)
            starts = chain + np.cumsum(n) - n
            for x in ids:
                writer.add(x)
            chain += int(n.sum())
            yield pa.record_batch([batch.column(0), pa.array([shard] * len(n), pa.int32()), pa.array([name] * len(n)),
                                   pa.array(starts), pa.array(n)], ["doc_id", "shard", "file", "start", "n_tokens"])
        if writer is not None:
            writer.close()
            sink.close()

    ordered = (docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
               .withColumn("_tie", F.xxhash64("text")))
    ordered = ordered.repartitionByRange("doc_id", "_tie").sortWithinPartitions("doc_id", "_tie").drop("_tie")
    ordered.mapInArrow(encode, INDEX).write.parquet(f"{folder}/index")
    return index(spark, folder)


def index(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document: its file, its place in the file's chain and in the whole chain."""
    own = spark.read.schema(INDEX).parquet(f"{folder}/index")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    # one row per writing task
    shards = (own.groupBy("shard").agg(F.sum("n_tokens").alias("_n"))
              .select("shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("offset")))
    return own.join(F.broadcast(shards), "shard")


def read(found: DataFrame, folder: str, rows: int = ROWS) -> DataFrame:
    """Read the documents of an index back from the files: doc_id, start in the whole chain,
    n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared, place = file_system(folder)
        name, reader = None, None
        for batch in batches:
            crcs = []
            for file, start, n in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                if file != name:
                    name, reader = file, SequenceReader(shared.open_input_file(f"{place}/{file}"), rows)
                crcs.append(zlib.crc32(reader.span(start, n).astype("<u4").tobytes()))
            yield pa.record_batch([batch.column(0), batch.column(4), batch.column(3), pa.array(crcs, pa.int64())],
                                  ["doc_id", "start", "n_tokens", "ids_crc32"])

    tasks = max(1, found.select("shard").distinct().count())
    return (found.select("doc_id", "file", "start", "n_tokens", (F.col("offset") + F.col("start")).alias("chain"))
            .repartitionByRange(tasks, "file", "start").sortWithinPartitions("file", "start")
            .mapInArrow(spans, "doc_id long, start long, n_tokens long, ids_crc32 long"))


def token_folder(spark: SparkSession) -> str:
    return scratch_path(spark, "token-files")
