"""Aggregates: grouping sets, distinct counts, statistics, collections and sketches."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tessera.operators.ranks import quantiles
from tessera.sources.tables import table, written


def distinct_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.count_distinct("l_partkey").alias("parts"), F.count_distinct("l_suppkey").alias("suppliers"), F.count_distinct("l_partkey", "l_suppkey").alias("pairs"))


def _sums(grouped) -> DataFrame:
    return grouped.agg(F.grouping_id().cast("long").alias("level"), F.round(F.sum("l_quantity"), 2).alias("quantity"), F.count(F.lit(1)).alias("rows"))


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(table(spark, sf_dir, "lineitem").rollup("l_returnflag", "l_linestatus"))


def cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(table(spark, sf_dir, "lineitem").cube("l_returnflag", "l_linestatus"))


def grouping_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sums(table(spark, sf_dir, "lineitem").groupingSets([["l_returnflag"], ["l_linestatus"], []], "l_returnflag", "l_linestatus"))


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Moments in one aggregate; exact quantiles, whose groups may hold most of the table, by ranges."""
    value, events = F.col("value"), table(spark, sf_dir, "events")
    moments = events.groupBy("event_type").agg(
        F.round(F.stddev(value), 6).alias("deviation"), F.round(F.var_pop(value), 6).alias("variance"), F.round(F.corr(value, F.col("user_id")), 6).alias("correlation"),
        F.round(F.covar_samp(value, F.col("user_id")), 6).alias("covariance"), F.round(F.regr_slope(value, F.col("user_id")), 9).alias("slope"), F.round(F.skewness(value), 6).alias("skewness_pop"),
    )
    asked = quantiles(events, "value", (0.5, 0.9), ["event_type"]).groupBy("event_type")
    named = asked.agg(*(F.round(F.max(F.when(F.col("probability") == p, F.col("quantile"))), 6).alias(n) for n, p in (("median", 0.5), ("p90", 0.9))))
    return moments.join(named, "event_type", "left")


def extremes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.max_by("event_id", "ts").alias("last_event"), F.min_by("event_id", "ts").alias("first_event"), F.bool_or(F.col("event_type") == "error").alias("any_error"), F.count_if(F.col("event_type") == "click").alias("clicks"))


def collections(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("""
        SELECT n_regionkey, array_join(sort_array(collect_set(n_name)), ',') AS names, listagg(n_name, '|') WITHIN GROUP (ORDER BY n_name DESC) AS listed,
               array_join(sort_array(collect_list(length(n_name))), ',') AS lengths, mode(length(n_name), true) AS usual_length,
               array_contains(collect_set(n_name), any_value(n_name)) AS any_is_one
        FROM nation GROUP BY n_regionkey""")


def having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity")).where("quantity > 200")


def pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", ["click", "error", "purchase"]).agg(F.count(F.lit(1))).select("user_id", *(F.coalesce(F.col(c), F.lit(0)).alias(f"{c}s") for c in ("click", "error", "purchase")))


def unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_nationkey").cast("double").alias("nation"), F.col("s_acctbal").alias("balance"))
    return nation.unpivot("s_suppkey", ["nation", "balance"], "name", "value")


def approximate_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the sketches' estimates are within 5 percent of the exact count, which is an aggregate of its own: beside it, each value would have sketches."""
    lines = table(spark, sf_dir, "lineitem")
    exact = lines.agg(F.count_distinct("l_partkey").alias("parts"))
    found = lines.agg(F.approx_count_distinct("l_partkey", 0.01).alias("a"), F.hll_sketch_estimate(F.hll_sketch_agg("l_partkey", F.lit(14))).alias("b"))
    close = ((F.abs(F.col(c) - F.col("parts")) <= 0.05 * F.col("parts")).alias(n) for c, n in (("a", "approx_close"), ("b", "sketch_close")))
    return found.crossJoin(F.broadcast(exact)).select("parts", *close)  # a row each


def sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether quantiles and distinct counts from mergeable sketches are within their bounds of the exact ones, and a count-min sketch has counted every row.

    The exact distinct count is an aggregate of its own: beside it, each value would have sketches.
    """
    lines = table(spark, sf_dir, "lineitem")
    lines.createOrReplaceTempView("lineitem")
    bounds = quantiles(lines, "l_extendedprice", (0.45, 0.55)).agg(F.min("quantile").alias("low"), F.max("quantile").alias("high"))
    exact = lines.agg(F.count_distinct("l_suppkey").alias("suppliers"))
    found = spark.sql("""
        SELECT theta_sketch_estimate(theta_sketch_agg(l_suppkey)) AS theta, kll_sketch_get_quantile_double(kll_sketch_agg_double(l_extendedprice), 0.5D) AS kll,
               percentile_approx(l_extendedprice, 0.5, 1000) AS approx, count(l_partkey) AS rows, count_min_sketch(l_partkey, 0.01D, 0.95D, 7) AS counts
        FROM lineitem""")
    close = [(F.abs(F.col("theta") - F.col("suppliers")) <= 0.1 * F.col("suppliers")).alias("theta_close"), *(F.col(c).between(F.col("low"), F.col("high")).alias(f"{c}_close") for c in ("kll", "approx"))]
    total = F.hex(F.substring("counts", 5, 8)) == F.lpad(F.hex("rows"), 16, "0")  # a version of four bytes, then how many it has counted
    return found.crossJoin(F.broadcast(bounds)).crossJoin(F.broadcast(exact)).select("suppliers", *close, total.alias("has_counts"))  # a row each


def heavy_hitters(df: DataFrame, column: str, share: float, slack: float = 0.5) -> DataFrame:
    """Every value of the column that more than ``share`` of all rows have, with its exact number of rows, n.

    Each task summarises its rows by Misra and Gries's counters, 1 / (share * slack) of
    them, in which a value that has more than that part of the task's rows is never lost. Counters of one value are
    added up over tasks; what a task gave away bounds from above what a value may have lost, so
    that only values whose sum and bound together exceed the share are counted, in a second pass. Summaries have a fixed
    size, whatever the table's, and few values are left. Nulls are a value. An empty table gives no rows.
    """
    kept = int(1 / (share * slack)) + 1
    kind = df.schema[column].dataType.simpleString()
    values = df.select(F.col(column).alias("value"))

    def summed(batches):
        counters: dict = {}
        rows = lost = 0
        for batch in batches:
            met = batch.column(0).value_counts()
            rows += batch.num_rows
            for value, n in zip(met.field(0).to_pylist(), met.field(1).to_pylist()):
                counters[value] = counters.get(value, 0) + n
            if len(counters) > kept:  # the (kept + 1)-th count goes from all: at most that share of the rows is given away
                cut = sorted(counters.values(), reverse=True)[kept]
                lost += cut
                counters = {v: n - cut for v, n in counters.items() if n > cut}
        if rows:
            n = len(counters)
            yield pa.RecordBatch.from_arrays([pa.array(list(counters), value_type), pa.array(list(counters.values()), pa.int64()), pa.array([None] * n, pa.int64()), pa.array([None] * n, pa.int64())], names=["value", "n", "rows", "lost"])
            yield pa.RecordBatch.from_arrays([pa.nulls(1, value_type), pa.nulls(1, pa.int64()), pa.array([rows]), pa.array([lost])], names=["value", "n", "rows", "lost"])

    value_type = to_arrow_type(df.schema[column].dataType)
    summaries = written(values.mapInArrow(summed, f"value {kind}, n long, rows long, lost long"), "heavy-hitters")
    rows, lost = summaries.agg(F.sum("rows"), F.sum("lost")).first()
    if not rows:
        return values.limit(0).select(F.col("value").alias(column), F.lit(0).cast("long").alias("n"))
    likely = summaries.where("n IS NOT NULL").groupBy("value").agg(F.sum("n").alias("n")).where(F.col("n") + lost > share * rows).select(F.col("value").alias("__likely"))
    met = values.join(F.broadcast(likely), F.col("value").eqNullSafe(F.col("__likely")), "left_semi")  # 1 / (share * (1 - slack)) rows at most
    return met.groupBy("value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > share * rows).withColumnRenamed("value", column)


def frequent_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes and brands of the parts of all lines that more than a fiftieth of the lines have, and the days of shipment that more than a thousandth have."""
    lines = table(spark, sf_dir, "lineitem")
    parts = lines.join(table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey")).select(F.col("p_size").cast("string").alias("size"), "p_brand")
    found = {"size": heavy_hitters(parts, "size", 0.02), "brand": heavy_hitters(parts, "p_brand", 0.02), "day": heavy_hitters(lines.select(F.date_format("l_shipdate", "yyyy-MM-dd").alias("day")), "day", 0.0005)}
    named = [df.select(F.lit(kind).alias("kind"), F.col(df.columns[0]).alias("value"), "n") for kind, df in found.items()]
    return named[0].unionByName(named[1]).unionByName(named[2])


QUERIES = {
    "sketches": sketches,
    "frequent_parts": frequent_parts,
    "distinct_counts": distinct_counts,
    "rollup": rollup,
    "cube": cube,
    "grouping_sets": grouping_sets,
    "statistics": statistics,
    "extremes": extremes,
    "collections": collections,
    "having": having,
    "pivot": pivot,
    "unpivot": unpivot,
    "approximate_distinct": approximate_distinct,
}

_LEVELS = "SELECT l_returnflag, l_linestatus, grouping(l_returnflag, l_linestatus)::BIGINT AS level, round(sum(l_quantity), 2) AS quantity, count(*) AS rows FROM lineitem GROUP BY "
ORACLES = {
    "sketches": "SELECT count(DISTINCT l_suppkey) AS suppliers, true AS theta_close, true AS kll_close, true AS approx_close, true AS has_counts FROM lineitem",
    "frequent_parts": """
WITH parts AS (
  SELECT p_size::VARCHAR AS size, p_brand FROM lineitem JOIN part ON l_partkey = p_partkey
)
SELECT 'size' AS kind, size AS value, count(*) AS n FROM parts GROUP BY ALL HAVING count(*) > 0.02 * (SELECT count(*) FROM parts)
UNION ALL SELECT 'brand', p_brand, count(*) FROM parts GROUP BY ALL HAVING count(*) > 0.02 * (SELECT count(*) FROM parts)
UNION ALL SELECT 'day', strftime(l_shipdate, '%Y-%m-%d'), count(*) FROM lineitem GROUP BY ALL HAVING count(*) > 0.0005 * (SELECT count(*) FROM lineitem)""",
    "distinct_counts": "SELECT l_returnflag, count(DISTINCT l_partkey) AS parts, count(DISTINCT l_suppkey) AS suppliers, count(DISTINCT (l_partkey, l_suppkey)) AS pairs FROM lineitem GROUP BY 1",
    "rollup": _LEVELS + "ROLLUP (l_returnflag, l_linestatus)",
    "cube": _LEVELS + "CUBE (l_returnflag, l_linestatus)",
    "grouping_sets": _LEVELS + "GROUPING SETS ((l_returnflag), (l_linestatus), ())",
    "statistics": "SELECT event_type, round(stddev_samp(value), 6) AS deviation, round(var_pop(value), 6) AS variance, round(corr(value, user_id), 6) AS correlation, round(covar_samp(value, user_id), 6) AS covariance, round(regr_slope(value, user_id), 9) AS slope, round(median(value), 6) AS median, round(quantile_cont(value, 0.9), 6) AS p90, round((avg(value ** 3) - 3 * avg(value) * avg(value ** 2) + 2 * avg(value) ** 3) / var_pop(value) ** 1.5, 6) AS skewness_pop FROM events GROUP BY 1",
    "extremes": "SELECT user_id, arg_max(event_id, ts) AS last_event, arg_min(event_id, ts) AS first_event, bool_or(event_type = 'error') AS any_error, count(*) FILTER (event_type = 'click') AS clicks FROM events GROUP BY 1",
    "collections": "SELECT n_regionkey, string_agg(DISTINCT n_name, ',' ORDER BY n_name) AS names, string_agg(n_name, '|' ORDER BY n_name DESC) AS listed, string_agg(length(n_name)::VARCHAR, ',' ORDER BY length(n_name)) AS lengths, (SELECT min(l) FROM (SELECT length(n_name) AS l, count(*) AS k, max(count(*)) OVER () AS most FROM nation i WHERE i.n_regionkey = o.n_regionkey GROUP BY 1) WHERE k = most)::INTEGER AS usual_length, true AS any_is_one FROM nation o GROUP BY 1",
    "having": "SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1 HAVING sum(l_quantity) > 200",
    "pivot": "SELECT user_id, count(*) FILTER (event_type = 'click') AS clicks, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases FROM events GROUP BY 1",
    "unpivot": "SELECT s_suppkey, 'nation' AS name, s_nationkey::DOUBLE AS value FROM supplier UNION ALL SELECT s_suppkey, 'balance', s_acctbal FROM supplier",
    "approximate_distinct": "SELECT count(DISTINCT l_partkey) AS parts, true AS approx_close, true AS sketch_close FROM lineitem",
}
