"""All queries of the catalogue by name, with the SQL that each must match."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import python, scalar
from tessera.operators import aggregates, edits, graphs, intervals, joins, nearest, ranks, windows
from tessera.sources import formats, shards
from tessera.sources.tables import table
from tessera.streaming import streams


def pricing_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    price, discount, tax = F.col("l_extendedprice"), F.col("l_discount"), F.col("l_tax")
    return (
        table(spark, sf_dir, "lineitem")
        .where(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp_ntz"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum(price), 2).alias("sum_base_price"),
            F.round(F.sum(price * (1 - discount)), 2).alias("sum_disc_price"),
            F.round(F.sum(price * (1 - discount) * (1 + tax)), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 6).alias("avg_qty"),
            F.count(F.lit(1)).alias("count_order"),
        )
    )


MODULES = (joins, nearest, edits, intervals, graphs, aggregates, ranks, windows, scalar, python, formats, shards, streams)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"pricing_summary": pricing_summary}

ORACLES: dict[str, str] = {
    "pricing_summary": """
SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 6) AS avg_qty, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL
""",
}
for _module in MODULES:
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES
