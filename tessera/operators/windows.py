"""Windows, sorts, limits and set operations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.tables import table


def top_per_group(df: DataFrame, by: list[str], order: list, k: int) -> DataFrame:
    """The first k rows of each group; Spark limits groups before and after the shuffle."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("rank") <= k)


def sessions(events: DataFrame, user: str, ts: str, gap: str) -> DataFrame:
    return events.groupBy(user, F.session_window(ts, gap).alias("w")).agg(F.count(F.lit(1)).alias("events")).select(user, F.col("w.start").cast("timestamp_ntz").alias("start"), "events")


def matched_patterns(events: DataFrame, user: str, ts: str, tie: str, steps: list[Column], minutes: int) -> DataFrame:
    """Where each match of a sequence of steps ends: user, ts and tie of every row that is the first step, and ``end``, the least time of a last step that later rows reach through all steps in order, at most so many minutes after it.

    Other rows may lie between. The automaton runs backwards: from a row, step k can be
    completed at the least time at which, from any later row that is step k, the steps
    after it can; each step is a running minimum over one sort. Time is cut into cells of
    the given minutes, and a row is in its own cell and the one before, so that a match
    is whole in the cell of its first row and a user of any size is many groups.

    Rows of one time are ordered by tie; rows with a null user or time match nothing, and first
    steps without a match are left out.
    """
    width = minutes * 60_000_000
    micros = F.unix_micros(F.col(ts).cast("timestamp_ltz"))
    rows = events.where(F.col(user).isNotNull() & F.col(ts).isNotNull()).select(user, ts, tie, micros.alias("__at"), *(F.coalesce(step, F.lit(False)).alias(f"__{k}") for k, step in enumerate(steps)))
    cell = F.floor(F.col("__at") / width)
    dealt = rows.withColumn("__own", cell).withColumn("__cell", F.explode(F.array(F.col("__own"), F.col("__own") - 1)))
    later = Window.partitionBy(user, "__cell").orderBy("__at", tie).rowsBetween(1, Window.unboundedFollowing)
    end = F.col("__at")
    for k in range(len(steps) - 1, 0, -1):
        dealt = dealt.withColumn(f"__end{k}", F.min(F.when(F.col(f"__{k}"), end)).over(later))
        end = F.col(f"__end{k}")
    found = dealt.where(F.col("__0") & (F.col("__own") == F.col("__cell")) & (end <= F.col("__at") + width))
    return found.select(user, ts, tie, F.timestamp_micros(end).cast(events.schema[ts].dataType).alias("end"))


def purchases_after_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that a click of the same user follows, and a purchase after it, within two days of the view: when the first such purchase is."""
    kind = F.col("event_type")
    found = matched_patterns(table(spark, sf_dir, "events"), "user_id", "ts", "event_id", [kind == "view", kind == "click", kind == "purchase"], 2880)
    return found.select("user_id", "event_id", "ts", "end")


def top_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_per_group(table(spark, sf_dir, "orders"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"], 3).select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


def ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("s_nationkey").orderBy("s_acctbal")
    long = {n: f.over(w).cast("long").alias(n) for n, f in (("rank", F.rank()), ("dense_rank", F.dense_rank()), ("quarter", F.ntile(4)))}
    return table(spark, sf_dir, "supplier").select("s_suppkey", *long.values(), F.round(F.percent_rank().over(w), 6).alias("percent_rank"), F.round(F.cume_dist().over(w), 6).alias("cume_dist"))


def neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy("turn")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.lag("role").over(w).alias("before"), F.lead("role").over(w).alias("after"), F.first("role").over(w).alias("first"), F.last("role").over(whole).alias("last"), F.nth_value("role", 2).over(whole).alias("second"))


def moving_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts")
    events = table(spark, sf_dir, "events")
    day = F.expr("count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW)")
    return events.select("event_id", F.round(F.sum("value").over(w.rowsBetween(-2, 0)), 4).alias("last_three"), day.alias("last_day"))


def session_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sessions(table(spark, sf_dir, "events"), "user_id", "ts", "30 minutes")


def tumbling_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = table(spark, sf_dir, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return hours.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "events")


def sliding_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = table(spark, sf_dir, "events").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return hours.select(F.col("w.start").cast("timestamp_ntz").alias("start"), "events")


def top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice")


def offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(20).limit(20).select("o_orderkey", "o_totalprice")


def _keys(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("k")), table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("k"))


def union_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.union(b).distinct()


def intersect_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.intersectAll(b)


def except_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.exceptAll(b)


def except_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.where("k > 3").subtract(b.where("k < 20"))


def intersect(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = _keys(spark, sf_dir)
    return a.intersect(b)


def recursive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql("WITH RECURSIVE t(n, f) AS (SELECT 1L, 1L UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 15) SELECT n, f FROM t")


QUERIES = {
    "purchases_after_clicks": purchases_after_clicks,
    "top_orders": top_orders,
    "ranks": ranks,
    "neighbours": neighbours,
    "moving_sums": moving_sums,
    "session_windows": session_windows,
    "tumbling_windows": tumbling_windows,
    "sliding_windows": sliding_windows,
    "top_k": top_k,
    "offset": offset,
    "union_distinct": union_distinct,
    "intersect_all": intersect_all,
    "except_all": except_all,
    "except_distinct": except_distinct,
    "intersect": intersect,
    "recursive": recursive,
}

_KEYS = "WITH a AS (SELECT c_nationkey AS k FROM customer), b AS (SELECT s_nationkey AS k FROM supplier) "
ORACLES = {
    "purchases_after_clicks": """
SELECT v.user_id, v.event_id, v.ts, min(p.ts) AS "end"
FROM events v JOIN events c ON c.user_id = v.user_id AND c.event_type = 'click' AND c.ts > v.ts
JOIN events p ON p.user_id = v.user_id AND p.event_type = 'purchase' AND p.ts > c.ts AND p.ts <= v.ts + INTERVAL 2 DAY
WHERE v.event_type = 'view' GROUP BY ALL""",
    "top_orders": "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3",
    "ranks": "SELECT s_suppkey, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS percent_rank, round(cume_dist() OVER w, 6) AS cume_dist FROM supplier WINDOW w AS (PARTITION BY s_nationkey ORDER BY s_acctbal)",
    "neighbours": "SELECT conv_id, turn, lag(role) OVER w AS before, lead(role) OVER w AS after, first_value(role) OVER w AS first, last_value(role) OVER v AS last, nth_value(role, 2) OVER v AS second FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn), v AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)",
    "moving_sums": "SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS last_three, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS last_day FROM events",
    "session_windows": "SELECT user_id, min(ts) AS start, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s",
    "tumbling_windows": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events FROM events GROUP BY ALL",
    "sliding_windows": "SELECT start, count(*) AS events FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1",
    "top_k": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "offset": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 20",
    "union_distinct": _KEYS + "SELECT k FROM a UNION SELECT k FROM b",
    "intersect_all": _KEYS + "SELECT k FROM a INTERSECT ALL SELECT k FROM b",
    "except_all": _KEYS + "SELECT k FROM a EXCEPT ALL SELECT k FROM b",
    "except_distinct": _KEYS + "SELECT k FROM a WHERE k > 3 EXCEPT SELECT k FROM b WHERE k < 20",
    "intersect": _KEYS + "SELECT k FROM a INTERSECT SELECT k FROM b",
    "recursive": "SELECT n, list_product(range(1, n + 1))::BIGINT AS f FROM range(1, 16) t(n)",
}
