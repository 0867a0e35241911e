"""How many intervals each interval overlaps, without forming a pair.

Of closed intervals, those that overlap [low, high] are all that begin at or before high but those
that end before low. Both are counts of values below a bound, so that one sweep over
the begins and ends of the one side and the bounds of the other, as prefix sums over
range partitions, answers all questions at once. Begins and ends at one place are one row
each, counted before the shuffle. Where intervals only meet within a key, the sweep goes
by key and value: what earlier keys add to both counts is the same and cancels.

Intervals are dealt by their ends, not by what they overlap: an interval that covers
everything is two rows like any other, and a moment that a third of all intervals share one.

Defined results: an interval whose begin or end is null, or that ends before it
begins, overlaps nothing and is counted 0; intervals that touch overlap; null keys are a
key; repeated rows are intervals of their own; an empty other side gives 0 for all.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.ranks import prefix_sums
from tessera.sources.tables import table, written


def overlap_counts(left: DataFrame, right: DataFrame, begin: str, end: str, by: Sequence[str] = (), name: str = "overlaps", parts: int | None = None) -> DataFrame:
    """left's rows with the number of right's intervals of the same key that each overlaps; both have columns begin and end of one orderable type."""
    rows = written(left.withColumn("__row", F.monotonically_increasing_id()), "intervals")
    sound = F.col(begin) <= F.col(end)
    known = right.where(sound).select(*by, F.col(begin).alias("__begin"), F.col(end).alias("__end"))
    none = F.lit(None).cast("long")

    # at one place: begins first, then bounds, then ends
    def counted(column: str, place: int, begins: int) -> DataFrame:
        n = known.groupBy(*by, F.col(column).alias("__value")).agg(F.count(F.lit(1)).alias("__n"))
        zero = F.lit(0).cast("long")
        return n.select(*by, "__value", F.lit(place).alias("__place"), (F.col("__n") if begins else zero).alias("__begins"), (zero if begins else F.col("__n")).alias("__ends"), none.alias("__row"))

    def asked(column: str, high: bool) -> DataFrame:
        zero = F.lit(0).cast("long")
        return rows.where(sound).select(*by, F.col(column).alias("__value"), F.lit(1).alias("__place"), zero.alias("__begins"), zero.alias("__ends"), (F.col("__row") * 2 + (1 if high else 0)).alias("__row"))

    every = counted("__begin", 0, 1).unionByName(counted("__end", 2, 0)).unionByName(asked(begin, False)).unionByName(asked(end, True))
    swept = prefix_sums(every, [*((c, "asc") for c in by), ("__value", "asc"), ("__place", "asc")], ["__begins", "__ends"], parts)
    high = F.pmod("__row", F.lit(2)) == 1
    answers = swept.where("__row IS NOT NULL").groupBy(F.shiftright("__row", 1).alias("__row")).agg(F.sum(F.when(high, F.col("__begins")).otherwise(-F.col("__ends"))).alias("__count"))
    found = rows.join(answers, "__row", "left")
    return found.select(*left.columns, F.coalesce("__count", F.lit(0)).alias(name))


def user_sessions(spark: SparkSession, sf_dir: str, gap: str = "30 minutes") -> DataFrame:
    """user_id, begin and end (its first and last event) of each session."""
    events = table(spark, sf_dir, "events").groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.min("ts").alias("begin"), F.max("ts").alias("end"))
    return events.select("user_id", "begin", "end")


def session_overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each user's session, how many sessions of all users it overlaps, its own left out."""
    sessions = user_sessions(spark, sf_dir)
    found = overlap_counts(sessions, sessions, "begin", "end")
    return found.select("user_id", "begin", "end", (F.col("overlaps") - 1).alias("overlaps"))


def session_purchases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each session, how many of its user's stretches from a purchase to two hours after it are open at some time of it."""
    bought = table(spark, sf_dir, "events").where("event_type = 'purchase'").select("user_id", F.col("ts").alias("begin"), (F.col("ts") + F.expr("INTERVAL 2 HOURS")).alias("end"))
    return overlap_counts(user_sessions(spark, sf_dir), bought, "begin", "end", ["user_id"], "open_purchases")


QUERIES = {"session_overlaps": session_overlaps, "session_purchases": session_purchases}

_SESSIONS = """
WITH marked AS (
  SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM marked
), sessions AS (
  SELECT user_id, n, min(ts) AS begin, max(ts) AS "end" FROM numbered GROUP BY user_id, n
)"""

ORACLES = {
    "session_overlaps": _SESSIONS + """
SELECT a.user_id, a.begin, a."end", count(*) - 1 AS overlaps FROM sessions a JOIN sessions b ON a.begin <= b."end" AND b.begin <= a."end" GROUP BY ALL""",
    "session_purchases": _SESSIONS + """
SELECT a.user_id, a.begin, a."end", count(b.ts) AS open_purchases
FROM sessions a LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') b ON a.user_id = b.user_id AND a.begin <= b.ts + INTERVAL 2 HOUR AND b.ts <= a."end" GROUP BY ALL""",
}
