"""Budgets over ordered items: context size, conversation history, prompts.

A conversation may hold a large share of all rows. Running sums are therefore taken in
two levels: inside blocks of consecutive turns and over one total per block.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions import fixed
from corpusloom.session import dealt_join, settle

BLOCK = 65_536


def message_tokens(text: Column | str) -> Column:
    """Estimate of four characters per token, rounded up."""
    c = F.col(text) if isinstance(text, str) else text
    return F.ceil(F.length(c) / F.lit(float(fixed.CHARS_PER_TOKEN)))


def running_before(rows: DataFrame, group: str, order: str, size: str, name: str,
                   block: int = BLOCK) -> DataFrame:
    """Sum of ``size`` over the rows before each row of its group, by an integer order key.

    No task holds a whole group: rows are windowed per block of ``block`` order values, and
    block totals (one row per block) are summed over the group and joined back.
    """
    blocked = rows.withColumn("_block", F.floor(F.col(order) / block))
    totals = blocked.groupBy(group, "_block").agg(F.sum(size).alias("_total"))
    over = Window.partitionBy(group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(
        group, "_block", F.coalesce(F.sum("_total").over(over), F.lit(0)).alias("_start")
    )
    inner = Window.partitionBy(group, "_block").orderBy(order).rowsBetween(
        Window.unboundedPreceding, -1
    )
    return (
        blocked.withColumn("_in", F.coalesce(F.sum(size).over(inner), F.lit(0)))
        .join(starts, [group, "_block"])
        .withColumn(name, F.col("_start") + F.col("_in"))
        .drop("_block", "_in", "_start")
    )


def fit_budget(rows: DataFrame, group: str, order: str, size: str,
               budget: int = fixed.CONTEXT_BUDGET_CHARS) -> DataFrame:
    """Items whose preceding items together take at most ``budget``."""
    return running_before(rows, group, order, size, "before").where(F.col("before") <= budget)


def trim_history(messages: DataFrame, max_tokens: int = fixed.HISTORY_TOKEN_LIMIT,
                 keep: int = fixed.HISTORY_KEEP) -> DataFrame:
    """Prune long conversations to their first and last ``keep`` messages.

    A conversation is pruned when its tokens reach ``max_tokens`` and it has more than
    ``keep`` + 1 messages. Totals are pre-aggregated; the last turns come from a bounded
    ranking, so a long conversation is never sorted as a whole.
    """
    stats = messages.groupBy("conv_id").agg(
        F.sum(message_tokens("text")).alias("_tokens"),
        F.count("*").alias("_n"),
        F.min("turn").alias("_first"),
    )
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    last = (
        messages.select("conv_id", "turn")
        .withColumn("_r", F.row_number().over(w))
        .where(F.col("_r") <= keep)
        .groupBy("conv_id")
        .agg(F.min("turn").alias("_tail"))
    )
    limits = stats.join(last, "conv_id").withColumn(
        "pruned", (F.col("_tokens") >= max_tokens) & (F.col("_n") > keep + 1)
    )
    pruned = settle(limits.where("pruned").select("conv_id", "_first", "_tail", "pruned"))
    # only pruned conversations meet their messages; all other messages stay as they are
    return (
        dealt_join(messages, pruned, "conv_id", "left")
        .withColumn("pruned", F.coalesce("pruned", F.lit(False)))
        .where(~F.col("pruned") | (F.col("turn") == F.col("_first")) | (F.col("turn") >= F.col("_tail")))
        .drop("_first", "_tail")
    )


def token_use(messages: DataFrame, warn_above: int = fixed.TOKEN_WARNING) -> DataFrame:
    """Cumulative tokens per conversation with a warning flag."""
    sized = messages.withColumn("_tokens", message_tokens("text"))
    used = running_before(sized, "conv_id", "turn", "_tokens", "_before")
    total = (F.col("_before") + F.col("_tokens")).cast("bigint")
    return used.withColumn("used", total).withColumn("warn", F.col("used") > warn_above).drop(
        "_before", "_tokens"
    )


def chat_prompt(messages: DataFrame, system: Column, question: Column, last: int = 4) -> DataFrame:
    """Prompt per conversation: system text, the last messages, the question, role marks."""
    w = Window.partitionBy("conv_id").orderBy(F.col("turn").desc())
    recent = messages.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    # The chat role marks.
    start, end = F.lit("<|im_start|>"), F.lit("<|im_end|>\n")
    said = F.concat(start, "role", F.lit("\n"), "text", end)
    history = recent.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("turn", said.alias("said")))).alias("h")
    )
    return history.select(
        "conv_id",
        F.concat(
            start, F.lit("system\n"), system, end,
            F.array_join(F.col("h.said"), ""),
            start, F.lit("user\n"), question, end,
            start, F.lit("assistant\n"),
        ).alias("prompt"),
    )


def context_text(context: DataFrame, items: int = 3, width: int = 800) -> DataFrame:
    """Text of the first ``items`` results under their titles, long contents cut."""
    body = F.when(
        F.length("content") > width, F.concat(F.substring("content", 1, width), F.lit("..."))
    ).otherwise(F.col("content"))
    part = F.concat(F.lit("## "), "title", F.lit("\n"), body)
    return (
        context.where(F.col("rank") <= items)
        .groupBy("query_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", part.alias("t")))).alias("p"))
        .select("query_id", F.array_join(F.col("p.t"), "\n\n").alias("context"))
    )
