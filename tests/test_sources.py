import hashlib
import json
import os
import tempfile

from evalkit.sources import results_io as IO


def test_csv_first_row_columns_roundtrip(spark):
    d = tempfile.mkdtemp(prefix="evalkit-csv-")
    rows = [("niah", 4096, 0.25, "012345", 'say "hi"\nthen é', True), ("tool_call", 8192, None, None, None, None)]
    df = spark.createDataFrame(rows, "test string, context_length int, depth double, passkey string, answer string, "
                                     "correct boolean")
    IO.write_results_csv(df, d + "/out", first_columns=["test", "context_length", "depth", "passkey", "answer"])
    back = IO.read_results_csv(spark, d + "/out", "test string, context_length int, depth double, passkey string, "
                                                  "answer string").orderBy("test").collect()
    assert [tuple(r) for r in back] == [r[:5] for r in rows]


def test_json_array_files_and_run_identity(spark):
    d = tempfile.mkdtemp(prefix="evalkit-json-")
    rows = [{"test": "niah", "context_length": 4096, "depth": 0.5, "passkey": "000123", "answer": "000123",
             "correct": True, "elapsed": 1.5, "output_tokens": 1}]
    for name in ("benchmark_INT4_20260328_105117.json", "benchmark_INT4_long_toolcall_20260402_135500.json"):
        with open(os.path.join(d, name), "w", encoding="utf-8") as f:
            json.dump(rows, f, ensure_ascii=False, indent=2)
    df = IO.with_run_identity(IO.read_results_json(spark, d, multiline=True))
    got = sorted((r.model, str(r.run_ts), r.passkey) for r in df.collect())
    assert got == [("INT4", "2026-03-28 10:51:17", "000123"), ("INT4", "2026-04-02 13:55:00", "000123")]


def test_run_identity_from_run_folders_below_other_names(spark):
    d = tempfile.mkdtemp(prefix="evalkit-json-") + "/benchmark_runs"
    spark.createDataFrame([("niah",)], "test string").write.json(d + "/benchmark_My Model_20260101_000000")
    r = IO.with_run_identity(spark.read.schema("test string").json(d + "/*")).first()
    assert (r.model, str(r.run_ts)) == ("My Model", "2026-01-01 00:00:00")


def test_results_as_one_json_array(spark):
    d = tempfile.mkdtemp(prefix="evalkit-array-")
    df = spark.createDataFrame([(1, "é \"x\"", None), (2, "y", 0.5)], "context_length int, answer string, depth double")
    IO.write_results_json_array(df, f"file://{d}/out.json")
    with open(d + "/out.json", encoding="utf-8") as f:
        assert json.load(f) == [{"context_length": 1, "answer": "é \"x\""}, {"context_length": 2, "answer": "y", "depth": 0.5}]
    back = IO.read_results_json(spark, d + "/out.json", "context_length int, answer string, depth double", multiline=True)
    assert sorted(map(tuple, back.collect())) == [(1, "é \"x\"", None), (2, "y", 0.5)]


def test_results_as_json_arrays_of_each_partition(spark):
    d = tempfile.mkdtemp(prefix="evalkit-arrays-") + "/runs"
    IO.write_results_json_arrays(spark.range(5, numPartitions=5), f"file://{d}")
    IO.write_results_json_arrays(spark.range(1000, numPartitions=4), f"file://{d}")
    files = sorted(os.listdir(d))
    assert files == [f"part-{i:05d}.json" for i in range(4)]
    arrays = [json.load(open(f"{d}/{f}", encoding="utf-8")) for f in files]
    assert [len(a) for a in arrays] == [250] * 4 and [r["id"] for a in arrays for r in a] == list(range(1000))
    assert IO.read_results_json(spark, d, "id long", multiline=True).count() == 1000


def files_below(d):
    return sorted(os.path.relpath(os.path.join(a, f), d) for a, _, names in os.walk(d) for f in names if not f.endswith(".crc"))


def test_doubled_and_killed_attempts_leave_whole_files(spark):
    """An attempt that died half-way and one that ran twice: only what the winners wrote has a
    final name, and nothing else stays."""
    d = tempfile.mkdtemp(prefix="evalkit-attempts-") + "/w"
    os.makedirs(d + "/_attempts")
    with open(d + "/_attempts/000000-000000-dead", "w") as f:
        f.write("half a fi")  # a lost task's file
    with open(d + "/b.txt", "w") as f:
        f.write("an old and longer text under a final name")
    df = spark.createDataFrame([(f"{c}.txt", i, f"{c}{i};") for c in "abc" for i in range(50)], "name string, part int, v string")
    IO.write_named_files(df, f"file://{d}", "name", "v", order=["part"])
    assert files_below(d) == ["a.txt", "b.txt", "c.txt"]
    for c in "abc":
        assert open(f"{d}/{c}.txt").read() == "".join(f"{c}{i};" for i in range(50))


def test_moves_can_be_repeated(spark):
    """The step that gives final names may run again, in part or as a whole."""
    import pyarrow as pa
    d = tempfile.mkdtemp(prefix="evalkit-moves-")
    os.makedirs(d + "/_attempts")
    for name, text in (("t0", "one"), ("t1", "tw"), ("t2", "o")):
        with open(f"{d}/_attempts/{name}", "w") as f:
            f.write(text)
    run = lambda t, n: {"place": 0, "temp": f"_attempts/{t}", "n_bytes": n, "n_chars": n, "n_parts": 1}
    batch = pa.record_batch([pa.array(["x", "y"]), pa.array([[run("t0", 3)], [run("t1", 2), run("t2", 1)]])], ["file", "runs"])
    move = IO._mover(IO.shared_files, f"file://{d}", 100)
    for _ in range(3):
        out = next(move([batch]))
        assert out.column("files").to_pylist() == [["x"], ["y"]]
        assert open(d + "/x").read() == "one" and open(d + "/y").read() == "two"


def test_a_very_long_file_is_written_by_several_tasks_as_parts(spark):
    d = tempfile.mkdtemp(prefix="evalkit-long-") + "/w"
    df = spark.range(40_000).selectExpr("'long.txt' AS name", "id AS part", "concat(md5(cast(id as string)), md5(cast(-id as string)), md5(concat('a', id)), md5(concat('b', id)), '\n') AS v")
    df = df.union(spark.createDataFrame([("short.txt", 0, "s")], "name string, part long, v string"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "200k")
    try:
        index = {r.file: r for r in IO.write_named_files(df, f"file://{d}", "name", "v", order=["part"], whole_bytes=1000).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    long = index["long.txt"]
    assert len(long.files) > 1 and long.n_parts == 40_000 and index["short.txt"].files == ["short.txt"]
    text = "".join(open(f"{d}/{f}").read() for f in long.files)
    h = lambda x: hashlib.md5(x.encode()).hexdigest()
    assert text == "".join(h(f"{i}") + h(f"{-i}") + h(f"a{i}") + h(f"b{i}") + "\n" for i in range(40_000)) and len(text) == long.n_chars


def test_an_array_file_is_replaced_only_when_the_new_one_is_whole(spark):
    from pyspark.sql import functions as F
    d = tempfile.mkdtemp(prefix="evalkit-arrays-") + "/runs"
    IO.write_results_json_arrays(spark.range(10, numPartitions=2), f"file://{d}")
    bad = spark.range(10, numPartitions=3).select(F.when(F.col("id") < 9, F.col("id")).otherwise(F.raise_error(F.lit("no"))).alias("id"))
    try:
        IO.write_results_json_arrays(bad, f"file://{d}")
        raise AssertionError("the job should fail")
    except AssertionError:
        raise
    except Exception:
        pass
    kept = [json.load(open(f"{d}/part-{i:05d}.json")) for i in range(2)]
    assert [r["id"] for a in kept for r in a] == list(range(10)) and not os.path.exists(f"{d}/part-00002.json")


def test_write_once_rewrites_what_a_crashed_run_left(spark):
    d = tempfile.mkdtemp(prefix="evalkit-crash-") + "/t"
    spark.range(7).write.parquet(d)  # whole, but never marked
    assert not IO.committed(spark, d)
    assert IO.write_once(spark.range(3), d) and spark.read.parquet(d).count() == 3
    assert not IO.write_once(spark.range(10), d) and IO.committed(spark, d)
    os.remove(d + "/_COMMITTED")  # the run died between the move and the mark
    assert IO.write_once(spark.range(4), d) and spark.read.parquet(d).count() == 4


def test_write_once(spark):
    d = tempfile.mkdtemp(prefix="evalkit-once-") + "/t"
    IO.write_once(spark.range(3), d)
    IO.write_once(spark.range(10), d)
    assert spark.read.parquet(d).count() == 3
    IO.write_once(spark.range(10), d, force=True)
    assert spark.read.parquet(d).count() == 10


def test_named_and_whole_files(spark):
    d = tempfile.mkdtemp(prefix="evalkit-files-")
    df = spark.createDataFrame([("a 1.txt", 1, "a\nb"), ("a 1.txt", 0, "x=1\n"), ("b.txt", 0, ""), ("c.txt", 0, "end\n")],
                               "name string, part int, v string")
    index = IO.write_named_files(df, f"file://{d}/w", "name", "v", order=["part"])
    assert sorted(map(tuple, index.collect())) == [("a 1.txt", ["a 1.txt"], 7, 2), ("b.txt", ["b.txt"], 0, 1), ("c.txt", ["c.txt"], 4, 1)]
    got = sorted((r.file, r.value) for r in IO.read_whole_files(spark, d + "/w").collect())
    # every byte is kept, the last line break too
    assert got == [("a 1.txt", "x=1\na\nb"), ("c.txt", "end\n")]  # a file of zero bytes has no row


def test_catalog_xml_keeps_constants_with_data(spark):
    d = tempfile.mkdtemp(prefix="evalkit-xml-")
    rows = [("7", "m.layers.3.mlp.gate.weight", "Const", "u4", "128, 16, 128", 64, 131072),
            ("8", "relu", "ReLU", None, None, None, None), ("9", "no data", "Const", "f16", "1", None, None)]
    cat = spark.createDataFrame(rows, "id string, name string, type string, element_type string, shape string, "
                                      "offset long, size long")
    IO.write_catalog_xml(cat, d + "/x")
    assert [tuple(r) for r in IO.read_catalog_xml(spark, d + "/x").collect()] == [rows[0]]
    with open(d + "/bad.xml", "w") as f:
        f.write('<layers><layer id="1" name="n" type="Const"><data element_type="u4" shape="2" offset="x" size="1"/></layer></layers>')
    assert IO.read_catalog_xml(spark, d + "/bad.xml").count() == 0


def test_schemas_parse(spark):
    from pyspark.sql.types import _parse_datatype_string

    from evalkit import schemas
    for name in dir(schemas):
        if name.isupper():
            assert _parse_datatype_string(getattr(schemas, name)).fields


def test_csv_full_mode_keeps_all_columns(spark):
    d = tempfile.mkdtemp(prefix="evalkit-csvfull-")
    df = spark.createDataFrame([("niah", 1, None), ("tool_call", None, 5)], "test string, a int, score int")
    IO.write_results_csv(df, d + "/o", mode="full")
    back = IO.read_results_csv(spark, d + "/o", "test string, a int, score int").orderBy("test").collect()
    assert [tuple(r) for r in back] == [("niah", 1, None), ("tool_call", None, 5)]


def test_scratch_tables_go_when_asked(spark):
    from evalkit import session
    before = list(session._SCRATCH)
    path = session.scratch_path(spark, "test")
    spark.range(3).write.parquet(path)
    place = path.removeprefix("file:")
    assert os.path.exists(place)
    session._SCRATCH[:] = [path]  # those of the other tests stay
    assert session.remove_scratch(spark) == 1 and not os.path.exists(place)
    session._SCRATCH[:] = before
