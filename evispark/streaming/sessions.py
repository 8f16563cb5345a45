"""Sessions that expire, and memoised tool runs, in batch and as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TTL = "30 minutes"
CAPACITY = 32


def ttl_sessions(events: DataFrame, ttl: str = TTL) -> DataFrame:
    """(user_id, start, last_used, n): uses of a user with less than the time to live between them. Works on streams with a watermark on ts."""
    return events.groupBy("user_id", F.session_window("ts", ttl).alias("w")).agg(F.count(F.lit(1)).alias("n"), F.max("ts").alias("last_used")).select("user_id", F.col("w.start").alias("start"), "last_used", "n")


def stream_sessions(events: DataFrame, ttl: str = TTL, late: str = "1 hour") -> DataFrame:
    """The same over an unbounded stream: state goes when the watermark has passed."""
    return ttl_sessions(events.withWatermark("ts", late), ttl)


def most_recent(sessions: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The sessions that a store of that capacity holds: the last used ones, found by a top-k and no global sort."""
    return sessions.orderBy(F.desc("last_used"), "user_id", F.desc("start")).limit(capacity)


def latest_runs(runs: DataFrame) -> DataFrame:
    """The last result of each tool of a session, in the order of the tools' first runs."""
    return runs.groupBy("session", "tool").agg(F.max_by("result", "seq").alias("result"), F.min("seq").alias("first_seq"))


def memoised(runs: DataFrame) -> DataFrame:
    """The first run of each (session, tool, parameters): later equal ones are answered from memory."""
    first = runs.groupBy("session", "tool", "params").agg(F.min("seq").alias("seq"), F.count(F.lit(1)).alias("calls"))
    return first.select("session", "tool", "params", "seq", (F.col("calls") - 1).alias("hits"))


def stream_memoised(runs: DataFrame, late: str = "1 hour") -> DataFrame:
    """Of an unbounded stream of runs the first of each key within the watermark."""
    return runs.withWatermark("ts", late).dropDuplicatesWithinWatermark(["session", "tool", "params"])


