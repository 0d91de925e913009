"""Conversations: windows, titles, caps, lists; throttles."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def last_messages(d: DataFrame, most: int = 8, chars: int = 500) -> DataFrame:
    """Each conversation's last messages, oldest first, cut to so many characters."""
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    kept = d.withColumn("k", F.row_number().over(w)).where(F.col("k") <= most)
    w = Window.partitionBy("conv_id").orderBy("turn")
    return kept.select("conv_id", "turn", "role", F.substring("text", 1, chars).alias("content"), F.row_number().over(w).alias("place"))


def titles(d: DataFrame, most: int = 100) -> DataFrame:
    """The first user message, cut with an ellipsis."""
    first = d.where("role = 'user'").groupBy("conv_id").agg(F.min_by("text", "turn").alias("text"))
    return first.select("conv_id", F.concat(F.substring("text", 1, most), F.when(F.length("text") > most, "…").otherwise("")).alias("title"))


def listed(d: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    """Conversations by last turn, latest first: a page."""
    a = d.groupBy("conv_id").agg(F.max("turn").alias("updated"), F.count(F.lit(1)).alias("n_messages"))
    return a.orderBy(F.desc("updated"), "conv_id").offset(offset).limit(limit)


def within_cap(d: DataFrame, most: int = 20) -> DataFrame:
    """Whether a conversation may go on: pairs of messages so far below the cap."""
    a = d.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_messages"))
    return a.select("conv_id", "n_messages", (F.floor(F.col("n_messages") / 2) < most).alias("allowed"))


def throttled(d: DataFrame, who: str, at: str, seconds: int = 60, most: int = 5) -> DataFrame:
    """Each event with how many its origin made in the seconds up to it, and whether that is too many."""
    w = Window.partitionBy(who).orderBy(F.col("__s")).rangeBetween(-seconds, 0)
    d = d.withColumn("__s", F.unix_seconds(F.col(at).cast("timestamp")))
    return d.withColumn("recent", F.count(F.lit(1)).over(w)).withColumn("blocked", F.col("recent") > most).drop("__s")


#: Rows of a block of the rolling windows, at least.
BLOCK_ROWS = 65_536


def rolling(d: DataFrame, value: str, at: str, *ties: str, rows: int = 5000, block: int = BLOCK_ROWS) -> DataFrame:
    """Average and largest of the last rows up to each, over all the table.

    Rows are numbered by the hour, on the hours' running totals, and windows run in blocks
    of numbers, each with the rows before that its first ones look back on."""
    block = max(block, rows)
    hour = F.date_trunc("hour", F.col(at))
    n = d.groupBy(hour.alias("__hour")).agg(F.count(F.lit(1)).alias("__n"))
    n = n.withColumn("__before", F.sum("__n").over(Window.orderBy(F.asc_nulls_first("__hour"))) - F.col("__n")).select(F.col("__hour").alias("__of"), "__before")
    d = d.withColumn("__hour", hour).join(n, F.col("__hour").eqNullSafe(F.col("__of"))).drop("__of")
    d = d.withColumn("__k", F.col("__before") + F.row_number().over(Window.partitionBy("__hour").orderBy(at, *ties)) - 1)
    own = F.floor(F.col("__k") / block)
    d = d.withColumn("__own", own).withColumn("__block", F.explode(F.when(F.col("__k") % block > block - rows, F.array(own, own + 1)).otherwise(F.array(own))))
    w = Window.partitionBy("__block").orderBy("__k").rowsBetween(-(rows - 1), 0)
    d = d.withColumns({"rolling_avg": F.round(F.avg(value).over(w), 8), "rolling_max": F.round(F.max(value).over(w), 8)})
    return d.where(F.col("__block") == F.col("__own")).drop("__hour", "__before", "__k", "__own", "__block")


def role_lines(d: DataFrame) -> DataFrame:
    """History as lines of ``User:`` and ``Assistant:``, by turn."""
    line = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), F.col("content"))
    return d.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", line.alias("line")))), lambda s: s["line"]), "\n").alias("history"))


def soft_deleted(conversations: DataFrame, asked: DataFrame, user: str, key: str = "conv_id") -> DataFrame:
    """Marks the conversations asked for as deleted, if they are the user's."""
    on = asked.select(key).distinct().withColumn("__on", F.lit(True))
    gone = F.coalesce("deleted", F.lit(False)) | (F.coalesce("__on", F.lit(False)) & (F.col("user_id") == user))
    return conversations.join(on, key, "left").withColumn("deleted", gone).drop("__on")
