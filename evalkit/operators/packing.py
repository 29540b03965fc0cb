"""Conversation-shaped window operators: budget packing (W2), chat sessions (W4),
message numbering (W6), head/tail previews (F7).

All per-conversation prefix sums go through ``plans.ordering.running_sums``, which cuts an
enormous conversation into buckets of about as many messages, so it does not end up in a
single task. No message is lost: rows with a null key are one conversation, messages with a
null turn come first in theirs, and messages of one turn are ordered by md5 of role and text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from evalkit.functions import text as T
from evalkit.plans.ordering import BUCKET_ROWS, cut_keys, of_cut_keys, running_sum, running_sums, tie_of, with_offsets

# ---- fixed values -----------------------------------------------------------
MESSAGE_HEADER = "=== [%s] (msg %d/%d) ==="
QUIT_WORDS = ("quit", "exit")
RESET_WORD = "reset"
# -----------------------------------------------------------------------------
#: Columns that order messages of one turn.
TIES = ("role", "text")
#: Messages per chunk of a rendered conversation.
CHUNK_MESSAGES = 256


def pack_to_budget(msgs: DataFrame, budget: int | Column, key: str = "conv_id",
                   order: str = "turn", tokens: Column | None = None, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Keep messages while the running estimate *before* them is below the
    budget (so the message that crosses the budget is kept). Adds ``tokens``
    (chars // 4 unless given) and ``tokens_before``."""
    tok = tokens if tokens is not None else T.chars_div4("text")
    b = F.lit(budget) if not isinstance(budget, Column) else budget
    m = msgs.withColumn("tokens", tok)
    # whole buckets whose offset already reaches the budget are dropped before the window
    out = running_sum(m, [key], order, "tokens", "tokens_before", inclusive=False, bucket_rows=bucket_rows, ties=TIES,
                      keep_bucket=(lambda off: off < b) if not isinstance(budget, Column) else None)
    return out.filter(F.col("tokens_before") < b)


def session_turns(turns: DataFrame, key: str = "conv_id", order: str = "turn",
                  text: str = "text", bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Interactive chat bookkeeping over typed inputs. Empty and null inputs are
    skipped, ``reset`` starts a new session (turn counter back to 0), ``quit`` or
    ``exit`` ends the conversation (that row and all later rows dropped). Returns
    the counted rows with ``session`` (1-based) and ``session_turn`` (1-based).

    A segmented scan: up to a row, the state is how many quits, resets and counted inputs
    there were, and how many were counted at the last reset. States of consecutive runs of
    rows compose (the first three add up; the last is the later run's, raised by what was
    counted before it, or the earlier one's if the later run has no reset), so one exchange
    brings buckets of a conversation together, and what precedes a bucket is composed from a
    small table of the buckets' states."""
    inp = F.coalesce(F.lower(T.py_strip(text)), F.lit(""))
    is_quit, is_reset = inp.isin(*QUIT_WORDS), inp == RESET_WORD
    counted = (inp != "") & ~is_reset & ~is_quit
    flagged = turns.withColumns({"_ek_quit": is_quit.cast("int"), "_ek_reset": is_reset.cast("int"), "_ek_in": counted.cast("int")})
    cut, large = cut_keys(flagged, [key], order, [c for c in TIES if c in turns.columns] or [text], bucket_rows)
    scanned = _scan(cut, key, order)
    before = {n: F.lit(0) for n in ("_ek_q0", "_ek_r0", "_ek_p0", "_ek_s0")}
    if large is not None:
        flags = of_cut_keys(cut, large, [key]).select(key, order, "_ek_t", "_ek_b", "_ek_quit", "_ek_reset", "_ek_in")
        ends = _scan(flags, key, order).groupBy(key, "_ek_b").agg(*[F.max(c).alias(c) for c in ("_ek_q", "_ek_r", "_ek_p", "_ek_s")])
        earlier = Window.partitionBy(key).orderBy("_ek_b").rowsBetween(Window.unboundedPreceding, -1)
        ends = ends.select(key, "_ek_b", "_ek_s", *[F.coalesce(F.sum(f"_ek_{c}").over(earlier), F.lit(0)).alias(f"_ek_{c}0")
                                                    for c in "qrp"])
        # positions only grow, so the last reset before a bucket is the one at the highest position
        ends = ends.withColumn("_ek_s0", F.max(F.col("_ek_p0") + F.col("_ek_s")).over(earlier)).drop("_ek_s")
        scanned = with_offsets(scanned, ends, [key])
        before = {n: F.coalesce(F.col(n), F.lit(0)) for n in before}
    start = F.coalesce(before["_ek_p0"] + F.col("_ek_s"), before["_ek_s0"])
    live = scanned.filter((F.col("_ek_q") + before["_ek_q0"] == 0) & (F.col("_ek_in") == 1))
    return live.select(*turns.columns, (F.col("_ek_r") + before["_ek_r0"] + 1).cast("long").alias("session"),
                       (F.col("_ek_p") + before["_ek_p0"] - start).cast("long").alias("session_turn"))


def _scan(cut: DataFrame, key: str, order: str) -> DataFrame:
    """The state at every row, counted from the start of its bucket."""
    upto = (Window.partitionBy(key, "_ek_b").orderBy(order, "_ek_t")
            .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    sums = cut.withColumns({n: F.sum(f).over(upto) for n, f in (("_ek_q", "_ek_quit"), ("_ek_r", "_ek_reset"), ("_ek_p", "_ek_in"))})
    return sums.withColumn("_ek_s", F.max(F.when(F.col("_ek_reset") == 1, F.col("_ek_p"))).over(upto))


def message_numbering(msgs: DataFrame, key: str = "conv_id", order: str = "turn",
                      bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """``=== [role] (msg i/n) ===`` headers (a null role is written as ``None``). ``i``
    and ``n`` come from one bucketed running count, so no conversation is brought together."""
    numbered = running_sums(msgs, [key], order, {"msg_no": F.lit(1)}, totals={"msg_no": "n_msgs"}, ties=TIES,
                            bucket_rows=bucket_rows)
    role = F.coalesce(F.col("role"), F.lit("None"))
    header = F.format_string(MESSAGE_HEADER, role, F.col("msg_no"), F.col("n_msgs"))
    return numbered.withColumn("header", header)


def head_tail_messages(msgs: DataFrame, key: str = "conv_id", order: str = "turn",
                       head: int = 4, tail: int = 3) -> DataFrame:
    """first ``head`` and last ``tail`` messages of each conversation with
    previews (500 characters for the first message, 200 for the others, the
    last message whole)."""
    num = message_numbering(msgs, key, order)
    keep = num.filter((F.col("msg_no") <= head) | (F.col("msg_no") > F.col("n_msgs") - tail))
    prev = (F.when(F.col("msg_no") == F.col("n_msgs"), F.col("text"))
            .when(F.col("msg_no") == 1, T.preview("text", 500))
            .otherwise(T.preview("text", 200)))
    return keep.withColumn("preview", prev)


def render_messages(msgs: DataFrame, key: str = "conv_id", order: str = "turn",
                    template: str = "numbered", chunk_messages: int = CHUNK_MESSAGES) -> DataFrame:
    """The rendered text of every conversation, whole, in chunks of ``chunk_messages``
    messages (key, chunk from 0, n_msgs, rendered): the chunks of a conversation put end
    to end are its text, and no row holds more than one chunk. ``numbered`` writes the
    dump form (header line, content, blank line); ``chatml`` writes
    ``<|im_start|>role`` blocks and, after the last message, the generation prompt."""
    num = message_numbering(msgs, key, order)
    content = F.coalesce(F.col("text"), F.lit(""))
    if template == "numbered":
        piece = F.concat(F.col("header"), F.lit("\n"), content, F.lit("\n\n"))
    elif template == "chatml":
        prompt = F.when(F.col("msg_no") == F.col("n_msgs"), F.lit("<|im_start|>assistant\n")).otherwise(F.lit(""))
        piece = F.concat(F.lit("<|im_start|>"), F.col("role"), F.lit("\n"), content, F.lit("<|im_end|>\n"), prompt)
    else:
        raise ValueError(f"unknown template {template!r}")
    return join_chunks(num, piece, key, order, chunk_messages, "rendered")


def join_chunks(numbered: DataFrame, piece: Column, key: str, order: str, chunk_messages: int, name: str) -> DataFrame:
    """Pieces of numbered messages joined per chunk, in order: (key, chunk, n_msgs, ``name``)."""
    chunk = F.floor((F.col("msg_no") - 1) / chunk_messages).cast("long")
    parts = numbered.select(key, chunk.alias("chunk"), F.struct(F.col("msg_no").alias("o"), piece.alias("p")).alias("s"))
    return (parts.groupBy(key, "chunk")
            .agg(F.array_sort(F.collect_list("s")).alias("_ps"), F.count(F.lit(1)).alias("n_msgs"))
            .select(key, "chunk", "n_msgs", F.array_join(F.transform("_ps", lambda s: s["p"]), "").alias(name)))


def prompt_cell_stats(msgs: DataFrame, cell: list[str], order: str = "turn") -> DataFrame:
    """Per cell: messages, characters, chars // 4 and the kilobytes of the
    numbered dump (header line, content and blank line per message, UTF-8)."""
    if len(cell) != 1:
        raise ValueError("prompt_cell_stats numbers messages within one key column")
    num = message_numbering(msgs, cell[0], order)
    dump_bytes = F.octet_length("header") + F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + F.lit(3)
    return (num.groupBy(*cell).agg(
        F.count(F.lit(1)).alias("n_msgs"),
        F.sum(F.length("text")).cast("long").alias("total_chars"),
        F.sum(dump_bytes).cast("long").alias("_bytes"))
        .withColumn("est_tokens", F.floor(F.col("total_chars") / 4).cast("long"))
        .withColumn("kb", F.floor(F.col("_bytes") / 1024).cast("long"))
        .drop("_bytes"))
