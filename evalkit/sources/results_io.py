"""Result files, prompt dumps, manifests, whole files, XML catalogs (S1-S3, S5-S9). Writers go to a folder the caller names (on a cluster, under
the shared ``spark.checkpoint.dir``; see ``evalkit.session.scratch_path``)."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from evalkit import schemas
from evalkit.session import hadoop_path

RESULTS_SCHEMA = schemas.RESULT_FILE
# file names such as benchmark_<model>_<yyyymmdd_HHMMSS>[.json|.csv], optionally with a suite infix
RUN_FILE = r"benchmark_(.+?)(?:_long_toolcall)?_(\d{8}_\d{6})"


def _file_opener():
    def shared_files(uri: str):
        """The file system and path of a folder that driver and executors share."""
        from pyarrow import fs
        if uri.startswith("file:/") and not uri.startswith("file://"):
            uri = "file://" + uri[len("file:"):]
        return fs.FileSystem.from_uri(uri)
    return shared_files


#: A nested function travels to the workers by value: they need not import this package.
shared_files = _file_opener()

# Files of given names are written in three steps. Every attempt of a task writes to files of
# its own under ``_attempts``; the rows that name them are written as a table by Spark, which
# keeps those of one attempt per task; then the files this table names are moved to their
# final names. Moving can be repeated: a file that stands whole under its final name is done.
ATTEMPTS = "_attempts"
WRITTEN = "file string, place long, temp string, n_bytes long, n_chars long, n_parts long"


def write_results_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines, UTF-8, non-ASCII kept as is."""
    df.write.mode(mode).json(path)


def _attempt_writer(opener, path, framed, place_of):
    """A task's function: writes rows (file, text) that follow each other to one file of this
    attempt per file name. ``framed`` writes the texts as the elements of a JSON array;
    ``place_of`` names the file of a task instead of a column."""
    def write(batches):
        import uuid

        import pyarrow as pa
        from pyspark import TaskContext
        fs, base = opener(path)
        task = TaskContext.get().partitionId()
        name = sink = None
        found = []

        def close():
            if framed:
                sink.write(b"\n]\n")
            found[-1][3] = sink.tell()
            sink.close()

        def start(n):
            temp = f"_attempts/{task:06d}-{len(found):06d}-{uuid.uuid4().hex}"
            out = fs.open_output_stream(f"{base}/{temp}")
            if framed:
                out.write(b"[")
            found.append([n, task, temp, 0, 0, 0])
            return out

        if place_of is not None:  # a file for every task, also for one without rows
            name, sink = place_of(task), start(place_of(task))
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            names = batch.column(0).to_pylist() if place_of is None else [name] * len(texts)
            for n, t in zip(names, texts):
                if sink is None or n != name:
                    if sink is not None:
                        close()
                    name, sink = n, start(n)
                row = found[-1]
                if framed:
                    sink.write((b"," if row[5] else b"") + b"\n")
                sink.write((t or "").encode("utf-8"))
                row[4] += len(t or "")
                row[5] += 1
        if sink is not None:
            close()
        names = ["file", "place", "temp", "n_bytes", "n_chars", "n_parts"]
        types = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 6, types)], names)
    return write


def _mover(opener, path, whole_bytes):
    """A task's function: gives written files their final names; runs of one file are put
    together, or stay parts of it if together they are longer than ``whole_bytes``."""
    def move(batches):
        import uuid

        import pyarrow as pa
        fs, base = opener(path)

        def size(name):
            info = fs.get_file_info(f"{base}/{name}")
            return info.size if info.is_file else -1

        def settle(temp, final, n):
            if size(final) == n and size(temp) < 0:
                return  # an earlier attempt has moved it
            if size(final) >= 0:
                fs.delete_file(f"{base}/{final}")
            try:
                fs.move(f"{base}/{temp}", f"{base}/{final}")
            except OSError:
                if size(final) != n:  # else another attempt was faster
                    raise

        for batch in batches:
            out = []
            for file, runs in zip(*(batch.column(i).to_pylist() for i in (0, 1))):
                total = sum(r["n_bytes"] for r in runs)
                if len(runs) == 1:
                    settle(runs[0]["temp"], file, total)
                    finals = [file]
                elif total <= whole_bytes:
                    if size(file) != total or all(size(r["temp"]) >= 0 for r in runs):
                        joined = f"_attempts/joined-{uuid.uuid4().hex}"
                        with fs.open_output_stream(f"{base}/{joined}") as sink:
                            for r in runs:
                                with fs.open_input_stream(f"{base}/{r['temp']}") as source:
                                    while block := source.read(1 << 20):
                                        sink.write(block)
                        settle(joined, file, total)
                    finals = [file]
                else:
                    finals = [f"{file}.part-{i:05d}" for i in range(len(runs))]
                    for r, final in zip(runs, finals):
                        settle(r["temp"], final, r["n_bytes"])
                out.append((file, finals, sum(r["n_chars"] for r in runs), sum(r["n_parts"] for r in runs)))
            columns = list(zip(*out)) if out else [[]] * 4
            yield pa.record_batch([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.list_(pa.string())),
                                   pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.int64())],
                                  ["file", "files", "n_chars", "n_parts"])
    return move


#: Files that several tasks wrote are put together up to this size; longer ones stay in parts.
WHOLE_FILE_BYTES = 256 * 1024 * 1024


def _commit(rows: DataFrame, path: str, framed: bool, place_of, whole_bytes: int, clean: bool) -> DataFrame:
    """Write ``rows`` (file, text; in their order within partitions) under ``path``. Returns the
    index (file, files, n_chars, n_parts), which is written beside the folder at the end."""
    spark, base = rows.sparkSession, path.rstrip("/")
    shared, folder = shared_files(base)
    shared.create_dir(f"{folder}/{ATTEMPTS}", recursive=True)
    attempt = uuid.uuid4().hex
    winners = f"{base}/{ATTEMPTS}/_winners-{attempt}"
    rows.mapInArrow(_attempt_writer(shared_files, base, framed, place_of), WRITTEN).write.parquet(winners)
    found = spark.read.schema(WRITTEN).parquet(winners)
    if clean:  # what an earlier result left and this one does not write
        from pyarrow import fs as afs
        for info in shared.get_file_info(afs.FileSelector(folder)):
            if info.is_file:
                shared.delete_file(info.path)
    # as many runs of a file as tasks wrote of it
    runs = found.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("place", "temp", "n_bytes", "n_chars", "n_parts"))).alias("runs"))
    index = f"{base}-index"
    (runs.mapInArrow(_mover(shared_files, base, whole_bytes), "file string, files array<string>, n_chars long, n_parts long")
     .write.mode("overwrite").parquet(index))
    shared.delete_dir(f"{folder}/{ATTEMPTS}")
    return spark.read.parquet(index)


def write_results_json_arrays(df: DataFrame, path: str) -> None:
    """Results of any size as JSON arrays of objects, one file per partition in a folder;
    each task writes its own rows in their order, one at a time. The files of an earlier
    result are replaced only when all new ones are written. For a file per run, partition
    ``df`` by the run."""
    _commit(_json_rows(df), path, True, _part_name(), 0, clean=True)


def _part_name():
    def name(task):
        return f"part-{task:05d}.json"
    return name


def _one_name(file):
    def name(task):
        return file
    return name


def write_results_json_array(df: DataFrame, path: str) -> None:
    """One JSON array of objects, as a single result file, of a bounded table: one task
    reads and writes all rows, in their order, one at a time. For results of any size use
    ``write_results_json_arrays`` or JSON lines."""
    folder, _, file = path.rstrip("/").rpartition("/")
    staged = f"{folder}/_{file}-{uuid.uuid4().hex}"
    _commit(_json_rows(df).coalesce(1), staged, True, _one_name(file), 0, clean=False)
    shared, place = shared_files(staged)
    final = place.rpartition("/")[0] + "/" + file
    if shared.get_file_info(final).is_file:
        shared.delete_file(final)
    shared.move(f"{place}/{file}", final)
    shared.delete_dir(place)
    shared.delete_dir(f"{place}-index")


def _json_rows(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "true"}).alias("row"))


def read_results_json(spark: SparkSession, path: str, schema: str | StructType = RESULTS_SCHEMA,
                      multiline: bool = False) -> DataFrame:
    """Read result rows; ``multiline=True`` reads files holding one JSON
    array of objects (each element becomes a row)."""
    return spark.read.schema(schema).option("multiLine", multiline).json(path)


def write_results_csv(df: DataFrame, path: str, first_columns: Sequence[str] | None = None,
                      mode: str = "first_row") -> None:
    """CSV with a header. ``first_row`` keeps only the columns of the first
    suite (others are dropped, missing ones left blank), as the reference does;
    ``full`` writes every column."""
    out = df if mode == "full" else df.select(*first_columns)
    (out.write.mode("overwrite").option("header", True).option("escape", '"')
     .option("quoteAll", False).csv(path))


def read_results_csv(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    return (spark.read.schema(schema).option("header", True).option("multiLine", True)
            .option("escape", '"').csv(path))


def with_run_identity(df: DataFrame) -> DataFrame:
    """S3: model and run timestamp from the last part of the file path that names a run:
    the file name, or the run folder that holds Spark's part files."""
    parts = F.transform(F.split(F.col("_metadata.file_path"), "/"), lambda x: F.url_decode(x))
    run = F.element_at(F.filter(F.concat(F.array(F.lit("")), parts), lambda x: (x == "") | x.rlike(RUN_FILE)), -1)
    return (df.withColumn("model", F.regexp_extract(run, RUN_FILE, 1))
            .withColumn("run_ts", F.to_timestamp_ntz(F.regexp_extract(run, RUN_FILE, 2), F.lit("yyyyMMdd_HHmmss"))))


def write_named_files(df: DataFrame, path: str, file: str, text: str, order: Sequence[str] = (),
                      whole_bytes: int = WHOLE_FILE_BYTES) -> DataFrame:
    """Text files of given names in one folder, and their index (file, files, n_chars,
    n_parts), which is written beside them when all files stand.

    Rows of one file are put end to end in ``order``, so a long text may come in parts and
    is never held whole. Rows are dealt to tasks by ranges of (file, order), so a very long
    file is written by several tasks; it is put together up to ``whole_bytes`` and stays in
    files of its own (``files``) beyond. Killed and doubled attempts leave no trace under the
    final names. Null texts write nothing."""
    rows = df.select(F.coalesce(F.col(file), F.lit("none")).alias("_file"), *[F.col(o).alias(f"_o{i}") for i, o in enumerate(order)],
                     F.col(text).alias("_text"))
    keys = ["_file", *[f"_o{i}" for i in range(len(order))]]
    placed = rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("_file", "_text")
    return _commit(placed, path, False, None, whole_bytes, clean=False)


def read_whole_files(spark: SparkSession, path: str) -> DataFrame:
    """One row per file: its name (``file``) and its whole content (``value``), to the
    last byte. Spark's file listing leaves out files of zero bytes."""
    w = spark.read.text(path, wholetext=True)
    return w.select(F.url_decode(F.col("_metadata.file_name")).alias("file"), "value")


def write_manifest(df: DataFrame, path: str) -> None:
    """Manifest rows as JSON lines."""
    df.write.mode("overwrite").json(path)


MANIFEST_SCHEMA = schemas.MANIFEST


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST_SCHEMA).json(path)


CATALOG_XML_SCHEMA = ("_id string, _name string, _type string, _version string, "
                      "data struct<_element_type: string, _shape: string, _offset: string, _size: string>")
CONSTANT = "Const"


def write_catalog_xml(cat: DataFrame, path: str) -> None:
    """S8 (writer for tests and fixtures): ``<layers><layer id name type
    version><data element_type shape offset size/></layer>...</layers>``."""
    kind = F.col("type") if "type" in cat.columns else F.lit(CONSTANT)
    rows = cat.select(F.col("id").alias("_id"), F.col("name").alias("_name"), kind.alias("_type"),
                      F.lit("opset1").alias("_version"),
                      F.struct(F.col("element_type").alias("_element_type"), F.col("shape").alias("_shape"),
                               F.col("offset").cast("string").alias("_offset"), F.col("size").cast("string").alias("_size")).alias("data"))
    (rows.write.mode("overwrite").format("xml").option("rootTag", "layers").option("rowTag", "layer")
     .save(path))


def read_catalog_xml(spark: SparkSession, path: str) -> DataFrame:
    """The constants of a model XML: id, name, type, element type, shape string,
    offset, size (XML attributes). Layers of other types and constants without data (no
    offset or size, or malformed ones) are left out."""
    x = spark.read.format("xml").option("rowTag", "layer").schema(CATALOG_XML_SCHEMA).load(path)
    rows = x.select(F.col("_id").alias("id"), F.col("_name").alias("name"), F.col("_type").alias("type"),
                    F.col("data._element_type").alias("element_type"), F.col("data._shape").alias("shape"),
                    F.col("data._offset").try_cast("long").alias("offset"),
                    F.col("data._size").try_cast("long").alias("size"))
    return rows.filter((F.col("type") == CONSTANT) & F.col("offset").isNotNull() & F.col("size").isNotNull())


#: Names the result that stands whole in a folder (readers pass over names with an underscore).
COMMITTED = "_COMMITTED"


def committed(spark: SparkSession, path: str) -> bool:
    """Whether ``write_once`` has finished a result in ``path``."""
    fs, place = hadoop_path(spark, f"{path.rstrip('/')}/{COMMITTED}")
    return fs.exists(place)


def write_once(df: DataFrame, path: str, fmt: str = "parquet", force: bool = False) -> bool:
    """Write unless a finished result is there (or ``force``); returns whether it wrote.

    The result is staged beside ``path``, moved there as a whole, and then marked. Only the
    mark counts: a folder that a crashed run left, in whatever state, is written anew."""
    spark, path = df.sparkSession, path.rstrip("/")
    if not force and committed(spark, path):
        return False
    staged = f"{path}-staged-{uuid.uuid4().hex}"
    df.write.format(fmt).save(staged)
    fs, place = hadoop_path(spark, path)
    if fs.exists(place):
        fs.delete(place, True)
    if not fs.rename(hadoop_path(spark, staged)[1], place):
        raise OSError(f"{staged} cannot be moved to {path}")
    fs.create(hadoop_path(spark, f"{path}/{COMMITTED}")[1], True).close()
    return True
