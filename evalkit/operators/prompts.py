"""Evaluation-set building (G1-G9, G12, G14): grids, filler, passkeys, needle
insertion, padded and agentic histories, prompt assembly, tool definitions.

Histories depend only on the token budget, so they are built once per distinct
budget (one short sequence each) and joined back to the cells: the work per
cell is a join, not a loop."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evalkit import pools
from evalkit.functions import text as T
from evalkit.plans.joins import bounded_broadcast
from evalkit.plans.ordering import global_index

# ---- fixed values -----------------------------------------------------------
NIAH_RESERVE_TOKENS = 200        # filler tokens = context - 200
CHARS_PER_TOKEN = 4
STEP_PREFIX = "Step %d: "        # user turns of the agentic cycle
# -----------------------------------------------------------------------------

def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def eval_grid(spark: SparkSession, contexts: Sequence[int], depths: Sequence[float] | None = None,
              cases: DataFrame | None = None) -> DataFrame:
    """G1: contexts x depths (NIAH) or contexts x cases (tool calls). Literal
    inputs; the result is as small as the product of the lists."""
    grid = spark.createDataFrame([(int(c),) for c in contexts], "context_length int")
    if depths is not None:
        grid = grid.crossJoin(F.broadcast(spark.createDataFrame([(float(d),) for d in depths], "depth double")))
    if cases is not None:
        grid = grid.crossJoin(F.broadcast(cases))
    return grid


def expand_grid(items: DataFrame, grid: DataFrame) -> DataFrame:
    """Every item in every grid cell: a broadcast nested loop against the literal grid."""
    return items.crossJoin(F.broadcast(grid))


def filler_text(paragraph: Column | str, n_chars: Column | str) -> Column:
    """Paragraph + blank line repeated, cut to ``n_chars`` characters."""
    unit = F.concat(_c(paragraph), F.lit("\n\n"))
    times = F.ceil(_c(n_chars) / F.length(unit)).cast("int")
    return F.substring(F.repeat(unit, times), F.lit(1), _c(n_chars).cast("int"))


def passkey(id_col: Column | str, seed: str = "42") -> Column:
    """Deterministic six-digit key from md5(seed:id); leading zeros kept."""
    h = F.md5(F.concat(F.lit(seed + ":"), _c(id_col).cast("string")))
    n = F.conv(F.substring(h, 1, 8), 16, 10).cast("long")
    return F.lpad(F.pmod(n, F.lit(1000000)).cast("string"), 6, "0")


def insert_position(text: Column | str, depth: Column | str, sep: str = "\n\n") -> Column:
    """Index where the needle goes: the last ``sep`` that ends at or before
    floor(len * depth), or that position itself when there is none."""
    t = _c(text)
    pos = F.floor(F.length(t) * _c(depth)).cast("int")
    pre = F.substring(t, F.lit(1), pos)
    # text after the last separator inside the prefix; its start is the break
    after_last = F.substring_index(pre, sep, -1)
    last = F.length(pre) - F.length(after_last) - F.lit(len(sep))
    return F.when(F.locate(sep, pre) > 0, last).otherwise(pos)


def insert_needle(text: Column | str, needle: Column | str, at: Column | str) -> Column:
    t, a = _c(text), _c(at)
    return F.concat(F.substring(t, F.lit(1), a), _c(needle), F.substring(t, a + 1, F.lit(2147483647)))


def padded_history(budgets: DataFrame, question: Callable[[Column], Column], paragraph: Column | str,
                   budget: str = "budget", cap: int = pools.ANSWER_CAP_TOKENS) -> DataFrame:
    """question/answer filler turns until chars // 4 of the history reaches the
    budget; each answer is filler of ``min(cap, budget - history)`` tokens (4 chars each).

    ``question`` gives the text of the question about a topic number (from 1),
    ``paragraph`` the text that answers repeat; both may use columns of ``budgets`` (of several
    rows with one budget, those of the smallest row in the order of its columns).
    One row per (budget, turn, slot) with role and content; at most budget / cap + 1
    turns per budget."""
    rest = [c for c in budgets.columns if c != budget]
    first = budgets.groupBy(budget).agg(F.min(F.struct(*rest, F.lit(0).alias("_"))).alias("_first"))
    b = first.select(budget, *[F.col(f"_first.{c}").alias(c) for c in rest]).withColumn("_p", _c(paragraph))
    turns = b.withColumn("turn", F.explode(F.sequence(F.lit(0), (F.col(budget) / cap).cast("int") + 1)))
    turns = turns.withColumn("_q", question(F.col("turn") + 1)).withColumn("q_tok", F.floor(F.length("_q") / 4))
    # every turn but the last has a full answer; the crossing turn is kept
    w = Window.partitionBy(budget).orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("before", F.coalesce(F.sum(F.col("q_tok") + cap).over(w), F.lit(0)))
    turns = turns.filter(F.col("before") < F.col(budget))
    a_tok = F.least(F.lit(cap), F.col(budget) - F.col("before"))
    messages = F.array(
        F.struct(F.lit(0).alias("slot"), F.lit("user").alias("role"), F.col("_q").alias("content"),
                 F.col("q_tok").cast("long").alias("tokens")),
        F.struct(F.lit(1).alias("slot"), F.lit("assistant").alias("role"),
                 filler_text(F.col("_p"), a_tok * CHARS_PER_TOKEN).alias("content"),
                 a_tok.cast("long").alias("tokens")))
    return turns.select(budget, "turn", F.explode(messages).alias("_m")).select(budget, "turn", "_m.*")


def agentic_history(budgets: DataFrame, cycle: DataFrame, budget: str = "budget") -> DataFrame:
    """A cycle of interactions (user line, tool call, tool result) repeated until the
    estimate (chars // 4 per message) reaches the budget; the crossing interaction is
    included.

    ``cycle`` has one row per step: step (from 0), tool, user_text, call_text,
    result_text. One row per (budget, interaction, slot) with tool, role and content."""
    size = cycle.agg(F.count(F.lit(1)).alias("n"),
                     F.min(sum(F.floor(F.length(c) / 4) for c in ("user_text", "call_text", "result_text"))).alias("least")
                     ).first()
    # the cheapest step bounds the length of the sequence
    least = max(1, int(size["least"] or 1))
    b = budgets.select(budget).distinct()
    seq = b.withColumn("interaction", F.explode(F.sequence(F.lit(1), (F.col(budget) / least).cast("int") + 1)))
    seq = seq.withColumn("step", F.pmod(F.col("interaction") - 1, F.lit(size["n"])).cast("int"))
    seq = seq.join(bounded_broadcast(cycle), "step")
    seq = seq.withColumn("user_text", F.concat(F.format_string(STEP_PREFIX, F.col("interaction")), F.col("user_text")))
    texts = [("user", "user_text"), ("assistant", "call_text"), ("user", "result_text")]
    cost = sum(F.floor(F.length(c) / 4) for _, c in texts)
    w = Window.partitionBy(budget).orderBy("interaction").rowsBetween(Window.unboundedPreceding, -1)
    seq = seq.withColumn("before", F.coalesce(F.sum(cost).over(w), F.lit(0))).filter(F.col("before") < F.col(budget))
    messages = F.array(*[F.struct(F.lit(i).alias("slot"), F.lit(role).alias("role"), F.col(c).alias("content"),
                                  F.floor(F.length(c) / 4).cast("long").alias("tokens"))
                         for i, (role, c) in enumerate(texts)])
    return (seq.select(budget, "interaction", "step", "tool", F.explode(messages).alias("_m"))
            .select(budget, "interaction", "step", "tool", "_m.*"))


def attach_by_budget(cells: DataFrame, per_budget: DataFrame, budget: str = "budget") -> DataFrame:
    """Join per-budget results back to the cells (broadcast after a size check)."""
    return cells.join(bounded_broadcast(per_budget), budget, "left")


def _message(role: Column, content: Column) -> list[Column]:
    return [role.alias("role"), content.alias("content")]


def prompt_messages(cells: DataFrame, history: DataFrame, system_text: str, instruction: str = "instruction",
                    budget: str = "budget", order: Sequence[str] = ("turn", "slot"),
                    values: Callable[[Column, Column], list[Column]] = _message,
                    gathered: Callable[[Column], list[Column]] | None = None) -> DataFrame:
    """Per cell the system message, the history rows of its budget (joined by
    budget, so each cell gets its own copy) and the user instruction with the no-think
    suffix. One row per message: the cell's columns, part (0 to 2), the order columns,
    role and content; prompts are never gathered into one value here.

    ``values`` makes other columns of a message from role and content (a digest, a
    length): they are worked out once per history row and copied to the cells in place of
    the texts. With ``gathered`` there is one row per cell: its columns, its first and last
    message as the structs ``system`` and ``user`` (part, order columns, values), and what
    ``gathered`` makes of the ordered array of such structs that is its history (as long as
    the budget lets a prompt be; null without a history). That too is worked out once per
    budget; no message is shuffled."""
    keys = [c for c in cells.columns if c != instruction]
    order = list(order)
    hist = history.select(budget, F.lit(1).alias("part"), *order, *values(F.col("role"), F.col("content")))
    last = F.concat(F.col(instruction), F.lit(T.NO_THINK_SUFFIX))

    def edge(part: int, role: str, content: Column) -> list[Column]:
        return [F.lit(part).alias("part"), *[F.lit(0).cast(history.schema[o].dataType).alias(o) for o in order],
                *values(F.lit(role), content)]

    system, user = edge(0, "system", F.lit(system_text)), edge(2, "user", last)
    if gathered is not None:
        per = hist.groupBy(budget).agg(F.array_sort(F.collect_list(F.struct(*hist.columns[1:]))).alias("_all"))
        per = per.select(budget, *gathered(F.col("_all")))
        return attach_by_budget(cells, per, budget).select(
            *keys, F.struct(*system).alias("system"), F.struct(*user).alias("user"), *per.columns[1:])
    hist = cells.select(*keys).join(hist, budget).select(*keys, *hist.columns[1:])
    return cells.select(*keys, *system).unionByName(hist).unionByName(cells.select(*keys, *user))


#: Tools per part of a tool list, and bytes that a prompt's tool list may have as a whole.
PART_TOOLS, WHOLE_BYTES = 256, 8 * 1024 * 1024


def tool_definitions(tools: DataFrame, name: str = "name", description: str = "description",
                     params: str = "parameters", part_tools: int = PART_TOOLS) -> DataFrame:
    """All distinct tool definitions as one compact JSON array, sorted by name, in parts:
    (part from 0, n_tools, tools_json). The parts put end to end are the array, so no row
    holds more than one part; an empty table is the empty array."""
    s = F.struct(F.col(name).alias("name"), F.col(description).alias("description"),
                 F.col(params).alias("parameters"))
    rows = tools.select(s.alias("t")).distinct().withColumn("_j", F.to_json("t"))
    placed = global_index(rows, ["t.name", "t.description", "_j"], name="_pos")
    part = F.floor(F.col("_pos") / part_tools).cast("long")
    per = (placed.select(part.alias("part"), F.struct("_pos", "_j").alias("_s")).groupBy("part")
           .agg(F.array_sort(F.collect_list("_s")).alias("_s"), F.count(F.lit(1)).alias("n_tools")))
    total = placed.agg(F.count(F.lit(1)).alias("_n"))  # one row
    body = F.array_join(F.transform("_s", lambda x: x["_j"]), ",")
    last = (F.col("part") + 1) * part_tools >= F.col("_n")
    out = (per.crossJoin(F.broadcast(total))
           .select("part", "n_tools", F.concat(F.when(F.col("part") == 0, "[").otherwise(","), body,
                                               F.when(last, "]").otherwise("")).alias("tools_json")))
    none = total.filter("_n = 0").select(F.lit(0).cast("long").alias("part"), F.lit(0).cast("long").alias("n_tools"),
                                         F.lit("[]").alias("tools_json"))
    return out.unionByName(none)


def whole_definitions(parts: DataFrame, max_bytes: int = WHOLE_BYTES) -> DataFrame:
    """The tool list of a prompt as one row (n_tools, tools_json). A prompt holds all its tools,
    so the list is bounded by what a prompt may hold; a longer one stops the job."""
    size = parts.agg(F.sum(F.octet_length("tools_json")).alias("b")).first()["b"] or 0
    if size > max_bytes:
        raise ValueError(f"the tool list has {size} bytes, more than the {max_bytes} of a prompt")
    s = F.array_sort(F.collect_list(F.struct("part", "tools_json")))
    return parts.agg(F.sum("n_tools").alias("n_tools"), F.array_join(F.transform(s, lambda x: x["tools_json"]), "").alias("tools_json"))


def exchange_range(max_seq_len: Column | str) -> Column:
    """(lo, hi) exchange counts for a maximum sequence length."""
    m = _c(max_seq_len)
    lo = F.lit(pools.EXCHANGE_RANGES[-1][1])
    hi = F.lit(pools.EXCHANGE_RANGES[-1][2])
    for floor_len, a, b in reversed(pools.EXCHANGE_RANGES[:-1]):
        lo = F.when(m >= floor_len, F.lit(a)).otherwise(lo)
        hi = F.when(m >= floor_len, F.lit(b)).otherwise(hi)
    return F.struct(lo.alias("lo"), hi.alias("hi"))


def position_columns(n_tokens: Column | str) -> tuple[Column, Column]:
    """position_ids 0..n-1 (empty for n = 0) and beam_idx [0]."""
    n = _c(n_tokens)
    pos = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    return pos, F.array(F.lit(0))
