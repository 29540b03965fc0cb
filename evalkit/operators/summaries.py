"""Result analytics: scoring of result rows, NIAH and tool-call summaries, run
comparison, suite union, degradation onset, narration outliers, first valid
attempt and re-scoring of stored runs (A1-A5, A11, J1, J2, U1, W5, W7, W8, O2, F3)."""

from __future__ import annotations

import functools

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalkit.functions import text as T
from evalkit.functions.scoring import score_tool_calls
from evalkit.plans.joins import bounded_broadcast
from evalkit.plans.ordering import exact_median, exact_medians

@functools.lru_cache(maxsize=16)
def _niah_columns(raw_answer: str, passkey: str) -> tuple[Column, list[Column]]:
    clean = T.strip_thinking(T.py_strip(raw_answer)).alias("_nh_clean")
    return clean, [T.passkey_extract("_nh_clean").alias("answer"),
                   T.passkey_correct("_nh_clean", passkey).alias("correct"),
                   T.word_count(raw_answer).cast("int").alias("output_tokens")]


def score_niah(df: DataFrame, raw_answer: str = "raw_answer", passkey: str = "passkey") -> DataFrame:
    """NIAH row scoring: strip, drop think blocks, extract (P9), check (P10)."""
    clean, outs = _niah_columns(raw_answer, passkey)
    keep = [c for c in df.columns if c not in ("answer", "correct", "output_tokens")]
    return df.select("*", clean).select(*keep, *outs)


@functools.lru_cache(maxsize=16)
def _response_extras(answer: str) -> tuple[Column, Column]:
    return T.preview(answer), T.word_count(answer).cast("int")


def score_responses(df: DataFrame, answer: str = "answer") -> DataFrame:
    """Tool-call rows: score (P1-P7), preview (P12), word count as output tokens."""
    prev, words = _response_extras(answer)
    return score_tool_calls(df, answer, "expected_tool", "expected_arg_key", "expected_arg_contains",
                            extra={"answer_preview": prev, "output_tokens": words})


def attach_cases(responses: DataFrame, cases: DataFrame, key: str = "case_id") -> DataFrame:
    """Pair each response with its case expectation (inner equi join). The
    case table is broadcast only after its size is checked."""
    return responses.join(bounded_broadcast(cases), key, "inner")


def cases_table(spark, triples=None) -> DataFrame:
    """The test cases (suite, expected tool, key, needle) as a small literal table."""
    from evalkit import pools
    rows = list(triples or pools.CASE_TRIPLES)
    return spark.createDataFrame(rows, "test string, expected_tool string, expected_arg_key string, "
                                       "expected_arg_contains string")


def rescore_results(results: DataFrame, cases: DataFrame, preview_chars: int = T.ANSWER_PREVIEW_CHARS,
                    on: Sequence[str] = ("test", "expected_tool")) -> DataFrame:
    """Re-score stored tool-call rows with the present scorer: each row gets its
    case expectation (equi-join on suite and tool, or the columns ``on``, against the case
    table, broadcast after a size check) and ``answer_preview`` is scored again. Only
    previews shorter than the stored cut are complete answers; ``reliable``
    marks them. Returns the stored and the new score side by side."""
    r = (results.filter(F.col("test").startswith("tool_call"))
         .withColumnRenamed("score", "stored_score")
         .drop("has_tool_call_tags", "valid_json", "correct_tool", "correct_arg_key", "correct_arg_value", "error"))
    side = cases.select(*on, "expected_arg_key", "expected_arg_contains")
    joined = r.join(bounded_broadcast(side), list(on), "left")
    out = score_tool_calls(joined, "answer_preview", "expected_tool", "expected_arg_key", "expected_arg_contains")
    return out.withColumn("reliable", F.length("answer_preview") < preview_chars)


def failed_niah(cells: DataFrame, message: Column | str = "message", keep: Sequence[str] = ()) -> DataFrame:
    """Result rows of needle runs that raised: answer ``ERROR``, not correct, no time and no
    output, the error text cut. ``cells`` has context_length, depth, passkey; its
    columns ``keep`` are kept."""
    return cells.select(*keep, F.lit("niah").alias("test"), "context_length", "depth", "passkey",
                        F.lit(T.ERROR_ANSWER).alias("answer"), F.lit(False).alias("correct"),
                        F.lit(0.0).alias("elapsed"), F.lit(0).alias("output_tokens"),
                        T.preview(message, T.ERROR_PREVIEW_CHARS).alias("error"))


def failed_tool_calls(cells: DataFrame, message: Column | str = "message", keep: Sequence[str] = ()) -> DataFrame:
    """Result rows of tool-call runs that raised: score 0, no checks, no time, the error text
    cut. ``cells`` has test, context_length, expected_tool, instruction; its columns ``keep`` are kept."""
    return cells.select(*keep, "test", "context_length", "expected_tool", "instruction", F.lit(0).alias("score"),
                        T.preview(message, T.ERROR_PREVIEW_CHARS).alias("error"), F.lit(0.0).alias("elapsed"))


def suite_filter(df: DataFrame, suites: Sequence[str]) -> DataFrame:
    """keep the chosen suites (pushed to the scan / partition filter)."""
    return df.filter(F.col("test").isin(list(suites)))


def suite_union(*frames: DataFrame) -> DataFrame:
    """UNION ALL of suites whose columns differ (missing columns are NULL)."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def context_label(cl: Column | str) -> Column:
    c = F.col(cl) if isinstance(cl, str) else cl
    return F.concat(F.floor(c / 1024).cast("string"), F.lit("K"))


def tool_call_summary(scored: DataFrame, by: Sequence[str] = ("test", "context_length")) -> DataFrame:
    """A3: per context: rows with a score, average score, perfect, tags, JSON,
    right-tool counts. Error rows count as score 0 and false checks; rows
    without a score (other suites) are ignored. Conditional aggregates are used
    instead of a filter so no predicate is pushed into the scoring projections."""
    by = list(by)
    has = F.col("score").isNotNull()

    def n_true(c: str) -> Column:
        return F.count_if(has & F.coalesce(F.col(c), F.lit(False)))

    out = (scored.groupBy(*by).agg(
        F.count("score").alias("n"),
        F.avg("score").alias("avg_score"),
        F.count_if(F.col("score") == 5).alias("perfect"),
        n_true("has_tool_call_tags").alias("has_tags"),
        n_true("valid_json").alias("valid_json"),
        n_true("correct_tool").alias("right_tool"))
        .withColumn("label", context_label("context_length")))
    return out.filter(F.col("n") > 0)


def niah_accuracy(niah: DataFrame, by: Sequence[str] = ("context_length",)) -> DataFrame:
    """A1: percent correct per context length."""
    return niah.groupBy(*by).agg(F.count(F.lit(1)).alias("n"),
                                 (F.avg(F.col("correct").cast("int")) * 100).alias("accuracy_pct"))


def niah_matrix(niah: DataFrame, contexts: Sequence[int], seq: str = "seq",
                by: Sequence[str] = ()) -> DataFrame:
    """A2: depth x context pivot of PASS/FAIL taken from the first row of each
    cell (first = smallest ``seq``), ``--`` where a cell has no row. The value
    list is explicit, so the pivot needs no extra job."""
    status = F.when(F.col("correct"), F.lit("PASS")).otherwise(F.lit("FAIL"))
    pv = (niah.withColumn("_st", status)
          .groupBy(*by, "depth").pivot("context_length", list(contexts))
          .agg(F.min_by("_st", F.col(seq))))
    renamed = [F.coalesce(F.col(str(c)), F.lit("--")).alias(f"c{c}") for c in contexts]
    return pv.select(*by, "depth", *renamed)


def tool_context_matrix(scored: DataFrame, tools: Sequence[str]) -> DataFrame:
    """Context x tool pivot of the average score and mean elapsed time."""
    return (scored.groupBy("context_length").pivot("expected_tool", list(tools))
            .agg(F.avg("score").alias("score"), F.avg("elapsed").alias("time")))


def model_compare(cells: DataFrame, run_a: str, run_b: str, *more_runs: str,
                  keys: Sequence[str] = ("test", "context_length", "depth", "expected_tool"),
                  run_col: str = "run_id") -> DataFrame:
    """One row per cell with the runs side by side (like a full outer join
    of the per-run cells) and the score difference between the last and the
    first run. One aggregation with a pivot over the explicit run list: a single
    shuffle of partial aggregates, whatever the number of runs. Runs are named
    by their full id (model and timestamp), so equal model names do not collide.
    Columns: ``score_a, n_a, score_b, n_b[, score_c, n_c ...], delta``."""
    runs = [run_a, run_b, *more_runs]
    tags = [chr(ord("a") + i) for i in range(len(runs))]
    metric = F.coalesce(F.col("score").cast("double"), F.col("correct").cast("int").cast("double") * 5)
    cell = [F.coalesce(F.col(k).cast("string"), F.lit("")).alias(k) for k in keys]
    pv = (cells.filter(F.col(run_col).isin(*runs))
          .select(*cell, F.col(run_col), metric.alias("_m"))
          .groupBy(*keys).pivot(run_col, runs)
          .agg(F.avg("_m").alias("score"), F.count(F.lit(1)).alias("n")))
    out = []
    for r, t in zip(runs, tags):
        n = F.col(f"{r}_n")
        out += [F.col(f"{r}_score").alias(f"score_{t}"), F.when(n > 0, n).alias(f"n_{t}")]
    return (pv.select(*keys, *out)
            .withColumn("delta", F.col(f"score_{tags[-1]}") - F.col(f"score_{tags[0]}")))


def throughput_by_prompt(runs: DataFrame, exact: bool = True, accuracy: int = 10_000) -> DataFrame:
    """A4: medians per prompt of tok/s, time and tokens. Exact (one distributed
    sort for the three) by default; ``exact=False`` uses ``percentile_approx``
    (a fixed-size sketch per group, one aggregation pass)."""
    r = runs.withColumn("tps", T.throughput("tokens", "elapsed"))
    if exact:
        return exact_medians(r, ["prompt"], ["tps", "elapsed", "tokens"])
    return r.groupBy("prompt").agg(*[F.percentile_approx(c, 0.5, accuracy).cast("double").alias(f"median_{c}")
                                     for c in ("tps", "elapsed", "tokens")])


def throughput_overall(runs: DataFrame) -> DataFrame:
    """A5: median, mean, min and max of tok/s over all runs, median/mean of time
    and tokens."""
    r = runs.withColumn("tps", T.throughput("tokens", "elapsed"))
    stats = r.agg(F.count(F.lit(1)).alias("runs"),
                  F.avg("tps").alias("mean_tps"), F.min("tps").alias("min_tps"),
                  F.max("tps").alias("max_tps"), F.avg("elapsed").alias("mean_elapsed"),
                  F.avg("tokens").alias("mean_tokens"))
    return stats.crossJoin(exact_medians(r, [], ["tps", "elapsed", "tokens"]))  # both sides are one row


def degradation_onset(scored: DataFrame, by: Sequence[str], bound: float = 4.5) -> DataFrame:
    """Per group, the first context whose average score is below ``bound``
    or below the best average seen at a shorter context. Aggregated per
    context first, so the window sees one row per (group, context)."""
    by = list(by)
    per = scored.groupBy(*by, "context_length").agg(F.avg("score").alias("avg_score"))
    w = Window.partitionBy(*by).orderBy("context_length").rowsBetween(Window.unboundedPreceding, -1)
    flagged = (per.withColumn("best_before", F.max("avg_score").over(w))
               .withColumn("drop", (F.col("avg_score") < bound)
                           | (F.col("avg_score") < F.coalesce(F.col("best_before"), F.col("avg_score")))))
    return flagged.groupBy(*by).agg(
        F.min(F.when(F.col("drop"), F.col("context_length"))).alias("onset_context"),
        F.max("avg_score").alias("best_avg"), F.min("avg_score").alias("worst_avg"))


def narration_outliers(scored: DataFrame, by: Sequence[str] = ("test", "context_length"),
                       factor: float = 3.0) -> DataFrame:
    """Answers much longer than the median of their (test, context) group and
    without a usable call (no body or invalid JSON). The median is exact and
    counted per distinct word count (a bounded domain), so no group is
    gathered in one task."""
    by = list(by)
    med = exact_median(scored, by, "output_tokens", name="median_words", method="counts")
    prose_words = F.when(~F.coalesce(F.col("valid_json"), F.lit(False)), F.col("output_tokens"))
    return scored.join(med, by).filter(prose_words > F.col("median_words") * factor)


def sorted_distinct_axes(df: DataFrame, axes: Sequence[str]) -> DataFrame:
    """O2: the distinct values of each axis with their rank in sorted order.
    The distinct sets are small (grid axes), so ranking them in one window is fine."""
    values = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("double").alias("value")) for a in axes])
    out = (df.select(F.explode(values).alias("_a")).select("_a.*")  # one scan for all axes
           .filter(F.col("value").isNotNull()).distinct())
    w = Window.partitionBy("axis").orderBy("value")
    return out.withColumn("pos", F.row_number().over(w).cast("long"))


def first_valid_attempt(attempts: DataFrame, key: str = "case_id", attempt: str = "attempt",
                        has_code: str = "has_code", ok: str = "ok") -> DataFrame:
    """Per case, the first attempt whose code parses; syntax errors and
    no-code attempts before it (each uses one attempt up).

    Equal attempts of a case are counted first, so what is kept per case is bounded by its
    attempt numbers, whatever the number of rows: a sorted array, from which one aggregate
    reads all results without a join. Attempts without a number are passed over; missing flags
    count as false."""
    flag = lambda c: F.coalesce(F.col(c), F.lit(False))
    code, parses = flag(has_code), flag(ok)
    counted = attempts.groupBy(key, attempt).agg(
        F.count_if(code & parses).alias("_ok"), F.count_if(code & ~parses).alias("_bad"), F.count_if(~code).alias("_none"))
    state = F.array_sort(F.collect_list(F.when(F.col(attempt).isNotNull(), F.struct(
        F.col(attempt).alias("a"), F.col("_ok"), F.col("_bad"), F.col("_none")))))
    per = counted.groupBy(key).agg(state.alias("_s"))
    per = per.withColumn("first_ok", F.try_element_at(F.filter("_s", lambda s: s["_ok"] > 0), F.lit(1))["a"])
    before = F.filter("_s", lambda s: F.col("first_ok").isNull() | (s["a"] < F.col("first_ok")))
    total = lambda c: F.aggregate(before, F.lit(0).cast("long"), lambda n, s: n + s[c])
    return per.select(key, "first_ok", total("_bad").alias("syntax_errors"), total("_none").alias("no_code"),
                      F.coalesce(F.col("first_ok"), F.try_element_at("_s", F.lit(-1))["a"]).alias("attempts_used"),
                      F.col("first_ok").isNotNull().alias("succeeded"))
