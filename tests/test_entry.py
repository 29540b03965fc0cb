import duckdb
import pytest

import __spark_entry__ as E
from evalkit.sources.tables import TABLES
from tests.conftest import SF_SMALL

FAST_KEYS = ["tool_call_summary", "strict_json_flag", "passkey_extract", "needle_insert", "pack_to_budget",
             "session_turns", "quantise_groups", "mapping_file_lookup", "append_layout", "throughput_by_prompt",
             "model_compare", "calib_seeded_samples"]


def test_entry_runs(spark):
    df = E.entry(spark)
    rows = df.collect()
    assert len(rows) > 0 and set(df.columns) >= {"context_length", "avg_score", "n"}


def test_every_survey_key_registered():
    from evalkit.queries import ORACLE, QUERIES, load_all
    load_all()
    # beside the keys of the inventory, parts of them that have a query of their own
    parts = {"error_rows_accuracy", "error_rows_summary", "error_rows_json", "error_rows_csv", "results_json_arrays", "rescore_stored",
             "case_grid", "layer_sensitivity", "batch_metadata", "unpack_chunks"}
    assert parts <= set(QUERIES) and len(QUERIES) == 84 + len(parts) and set(ORACLE) == set(QUERIES)
    q, o = E.queries(), E.oracle_sql()
    assert set(QUERIES) <= set(q) and set(o) <= set(q)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def _norm(rows):
    out = []
    for r in rows:
        out.append(tuple(round(x, 6) if isinstance(x, float) else x for x in r))
    return sorted(out, key=repr)


@pytest.mark.parametrize("key", FAST_KEYS)
def test_oracle_matches_on_small_tables(spark, duck, key):
    sdf = E.queries()[key](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    s_rows = _norm(tuple(r[c] for c in cols) for r in sdf.collect())
    res = duck.execute(E.oracle_sql()[key])
    names = [d[0] for d in res.description]
    o_rows = _norm(tuple(r[names.index(c)] for c in cols) for r in res.fetchall())
    assert sorted(names) == cols and s_rows == o_rows
