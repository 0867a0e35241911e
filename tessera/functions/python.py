"""Python functions: vectorized scalar, grouped map, grouped aggregate, Arrow batches and table functions."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

from tessera.sources.tables import table


def scalar_udf(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.pandas_udf("double")
    def with_tax(price: pd.Series, tax: pd.Series) -> pd.Series:
        return (price * (1 + tax)).round(4)

    return table(spark, sf_dir, "lineitem").groupBy("l_linestatus").agg(F.round(F.sum(with_tax("l_extendedprice", "l_tax")), 1).alias("charge"))


def grouped_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    def spans(rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": [rows.user_id.iloc[0]], "events": [len(rows)], "seconds": [int((rows.ts.max() - rows.ts.min()).total_seconds())]})

    return table(spark, sf_dir, "events").select("user_id", "ts").groupBy("user_id").applyInPandas(spans, "user_id long, events long, seconds long")


#: Rows of a block, on average; its groups go to one call of Python.
BLOCK = 10_000


def grouped_aggregate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spread of values of each user and hour. Most have a row or two, so a call of the aggregate takes a block of them: one costs what many cost."""

    @F.arrow_udf("array<struct<user_id:bigint,hour:timestamp_ntz,spread:double>>")
    def spreads(user: pa.Array, hour: pa.Array, value: pa.Array) -> list:
        # as in pandas, values that are no numbers do not count
        found = pa.table({"user": user, "hour": hour, "value": pc.if_else(pc.is_nan(value), None, value)}).group_by(["user", "hour"]).aggregate([("value", "max"), ("value", "min")])
        width = pc.subtract(found["value_max"], found["value_min"]).to_pylist()
        return [{"user_id": u, "hour": h, "spread": None if w is None else round(w, 6)} for u, h, w in zip(found["user"].to_pylist(), found["hour"].to_pylist(), width)]

    events = table(spark, sf_dir, "events").select("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour"), "value")
    blocks = events.count() // BLOCK + 1
    # a group is whole in one block
    found = events.groupBy(F.pmod(F.xxhash64("user_id", "hour"), F.lit(blocks)).alias("block")).agg(spreads("user_id", "hour", "value").alias("found"))
    return found.select(F.inline("found"))


def arrow_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def large(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pc.greater(batch.column(1), 450_000.0))

    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").mapInArrow(large, "o_orderkey long, o_totalprice double")


def table_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.udtf(returnType="word string, place long")
    class Words:
        def eval(self, text: str):
            for place, word in enumerate(text.split(" ")):
                yield word, place

    spark.udtf.register("name_words", Words)
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT w.word, w.place, count(*) AS parts FROM part, LATERAL name_words(p_name) w GROUP BY w.word, w.place")


def pandas_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    def shares(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            yield pd.DataFrame({"p_partkey": rows.p_partkey, "words": rows.p_name.str.count(" ") + 1})

    return table(spark, sf_dir, "part").select("p_partkey", "p_name").mapInPandas(shares, "p_partkey long, words long")


def arrow_function(spark: SparkSession, sf_dir: str) -> DataFrame:
    @F.arrow_udf("double")
    def net(price: pa.Array, discount: pa.Array) -> pa.Array:
        return pc.round(pc.multiply(price, pc.subtract(1.0, discount)), 2)

    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.sum(net("l_extendedprice", "l_discount")), 0).alias("net"))


class FillGaps:
    """A table function over a table argument: its rows by key and time, and rows for the steps between a key's first and last time that it lacks.

    The arguments say which columns are the key, the time and the value, and the step in
    seconds; the schema follows from them, and so do the partitioning and the order, which a caller need not give. New rows
    have the value that the key had last (fill = 'last'), or that number. Times are expected to be multiples of the step from the first;
    null keys are a key, and rows with a null time come as they are, first. A partition streams: nothing but its last row is held.
    """

    @staticmethod
    def analyze(rows: AnalyzeArgument, key: AnalyzeArgument, at: AnalyzeArgument, value: AnalyzeArgument, step: AnalyzeArgument, fill: AnalyzeArgument) -> AnalyzeResult:
        if not rows.isTable:
            raise ValueError("the first argument is a table")
        names = [key.value, at.value, value.value]
        fields = {f.name: f for f in rows.dataType.fields}
        for name in names:
            if name not in fields:
                raise ValueError(f"the table has no column {name}")
        if not isinstance(fields[at.value].dataType, (T.TimestampType, T.TimestampNTZType)):
            raise ValueError(f"{at.value} is no time")
        schema = T.StructType([T.StructField(n, fields[n].dataType) for n in names]).add("filled", "boolean")
        return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(key.value)], orderBy=[OrderingColumn(at.value, ascending=True, overrideNullsFirst=True)])

    def __init__(self):
        self.before = None

    def eval(self, rows: Row, key: str, at: str, value: str, step: int, fill: str):
        now = rows[at]
        if self.before is not None and now is not None:
            width, between = datetime.timedelta(seconds=step), self.before[0]
            while (between := between + width) < now:
                yield rows[key], between, self.before[1] if fill == "last" else type(self.before[1])(fill), True
        yield rows[key], now, rows[value], False
        if now is not None:
            self.before = now, rows[value]


def hourly_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of each user by the hour, with the hours between that have none."""
    events = table(spark, sf_dir, "events")
    hours = events.groupBy("user_id", F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    spark.udtf.register("fill_gaps", F.udtf(FillGaps))
    hours.createOrReplaceTempView("hours_of_users")
    return spark.sql("SELECT * FROM fill_gaps(TABLE(hours_of_users), 'user_id', 'hour', 'n', 3600, '0')")


QUERIES = {"hourly_series": hourly_series, "pandas_batches": pandas_batches, "arrow_function": arrow_function, "scalar_udf": scalar_udf, "grouped_map": grouped_map, "grouped_aggregate_udf": grouped_aggregate, "arrow_batches": arrow_batches, "table_function": table_function}

ORACLES = {
    "hourly_series": """
WITH hours AS (
  SELECT user_id, date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY ALL
), every AS (
  SELECT user_id, unnest(generate_series(min(hour), max(hour), INTERVAL 1 HOUR)) AS hour FROM hours GROUP BY user_id
)
SELECT user_id, e.hour, coalesce(n, 0) AS n, n IS NULL AS filled FROM every e LEFT JOIN hours USING (user_id, hour)""",
    "pandas_batches": "SELECT p_partkey, len(string_split(p_name, ' ')) AS words FROM part",
    "arrow_function": "SELECT l_returnflag, round(sum(round_even(l_extendedprice * (1 - l_discount), 2)), 0) AS net FROM lineitem GROUP BY 1",
    "scalar_udf": "SELECT l_linestatus, round(sum(round_even(l_extendedprice * (1 + l_tax), 4)), 1) AS charge FROM lineitem GROUP BY 1",
    "grouped_map": "SELECT user_id, count(*) AS events, floor(epoch(max(ts)) - epoch(min(ts)))::BIGINT AS seconds FROM events GROUP BY 1",
    "grouped_aggregate_udf": "SELECT user_id, date_trunc('hour', ts) AS hour, round(max(value) - min(value), 6) AS spread FROM events GROUP BY ALL",
    "arrow_batches": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 450000",
    "table_function": "SELECT word, place, count(*) AS parts FROM (SELECT unnest(string_split(p_name, ' ')) AS word, unnest(range(len(string_split(p_name, ' ')))) AS place FROM part) GROUP BY ALL",
}
