"""Readers and writers: CSV, JSON, ORC, text, XML, partitioned Parquet and bucketed tables, each as a round trip; tables of databases by JDBC."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.tables import scratch as folder
from tessera.sources.tables import table


def _round_trip(df: DataFrame, kind: str, **options) -> DataFrame:
    path = folder(df.sparkSession, kind)
    df.write.format(kind).options(**options).save(path)
    return df.sparkSession.read.format(kind).schema(df.schema).options(**options).load(path)


def csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(table(spark, sf_dir, "supplier"), "csv", header="true")


def json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(table(spark, sf_dir, "orders"), "json").select("o_orderkey", "o_totalprice", "o_orderdate")


def orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(table(spark, sf_dir, "nation"), "orc")


def text(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "region").select(F.concat_ws("\t", F.col("r_regionkey").cast("string"), "r_name").alias("value"))
    found = F.split(F.col("value"), "\t")
    return _round_trip(lines, "text").select(found[0].cast("int").alias("r_regionkey"), found[1].alias("r_name"))


def partitioned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parquet partitioned by a column, of which the filter reads one partition."""
    path = folder(spark, "partitioned")
    table(spark, sf_dir, "customer").repartition("c_mktsegment").write.partitionBy("c_mktsegment").parquet(path)
    return spark.read.parquet(path).where("c_mktsegment = 'BUILDING'").select("c_custkey", "c_acctbal", "c_mktsegment")


def bucketed_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables bucketed by the join key meet without a shuffle."""
    names = [f"{n}_{uuid.uuid4().hex[:8]}" for n in ("orders_by_key", "lines_by_key")]
    table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority").write.bucketBy(8, "o_orderkey").sortBy("o_orderkey").saveAsTable(names[0])
    table(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity").write.bucketBy(8, "l_orderkey").sortBy("l_orderkey").saveAsTable(names[1])
    joined = spark.table(names[0]).hint("merge").join(spark.table(names[1]), F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("o_orderpriority").agg(F.sum("l_quantity").alias("quantity"))


def dynamic_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers of Asia's nations, from a table that is partitioned by nation: the join's other side, a table of fixed size, says at run time which partitions are read."""
    path = folder(spark, "by-nation")
    table(spark, sf_dir, "supplier").repartition("s_nationkey").write.partitionBy("s_nationkey").parquet(path)
    nations = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region").where("r_name = 'ASIA'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return spark.read.parquet(path).join(F.broadcast(nations), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "n_name")


def interleaved(columns: list[Column], bits: int) -> Column:
    """A Z-order key: the bits of whole numbers from 0 to 2^bits - 1, highest first, in turn; neighbours on the curve are near in each of them."""
    key = F.lit(0).cast("long")
    for bit in range(bits - 1, -1, -1):
        for c in columns:
            key = F.shiftleft(key, 1).bitwiseOR(F.shiftright(c.cast("long"), bit).bitwiseAND(F.lit(1)))
    return key


def _at_or_below(bounds: Column, value: Column) -> Column:
    """How many bounds are at or below the value; none for null."""
    return F.coalesce(F.array_size(F.filter(bounds, lambda bound: bound <= value)), F.lit(0))


def write_clustered(df: DataFrame, columns: list[str], path: str, files: int, bits: int = 10) -> None:
    """df as Parquet files, each of a range of the Z-order of the columns, so that statistics let a filter on any of them skip files.

    A column's place is its rank among approximate quantiles of the table, which spread skewed values
    evenly; nulls are first. Ranges follow the rows' numbers, ties of a value are told apart by the
    other columns, and rows that are equal in all of them by their place in the input.
    """
    marks = [k / 2**bits for k in range(1, 2**bits)]
    cuts = df.agg(*(F.percentile_approx(c, F.array(*map(F.lit, marks)), 2 ** (bits + 2)).alias(c) for c in columns)).first()  # 2^bits numbers a column
    places = []
    for c in columns:
        bounds = F.array(*(F.lit(v).cast(df.schema[c].dataType) for v in sorted(set(cuts[c] or []))))
        places.append(_at_or_below(bounds, F.col(c)))
    df.withColumn("__z", interleaved(places, bits)).withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(files, "__z", "__tie").drop("__z", "__tie").write.parquet(path)


def clustered_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a few days, and lines of few parts, from one table in files by Z-order of day and part."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate", "l_extendedprice").withColumn("day", F.date_diff(F.col("l_shipdate"), F.lit("1995-01-01")))
    path = folder(spark, "clustered")
    write_clustered(lines, ["day", "l_partkey"], path, 16, 6)
    found = spark.read.parquet(path)
    return found.where("day BETWEEN 100 AND 120 OR l_partkey < 20").select("l_orderkey", "l_partkey", "day", "l_extendedprice")


def xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _round_trip(table(spark, sf_dir, "nation"), "xml", rowTag="nation")


def jdbc_table(spark: SparkSession, url: str, name: str, key: str, parts: int, **options) -> DataFrame:
    """A database's table, read by so many connections at once, each a range of the whole-number key between its least and its greatest value.

    Rows with a null key are in the first range. Filters and columns go to the database.
    """
    quoted = spark.sparkContext._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    ends = spark.read.format("jdbc").options(url=url, query=f"SELECT min({quoted}) AS low, max({quoted}) AS high FROM {name}", **options)
    low, high = ends.load().first()
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if low is None or low == high:
        return reader.load()
    return reader.options(partitionColumn=key, lowerBound=low, upperBound=high, numPartitions=parts).load()


def upsert(target: DataFrame, changes: DataFrame, key: str) -> DataFrame:
    """target with the rows of changes in place of, or beside, its own by key: one anti join and a union, so that untouched rows are not compared."""
    return target.join(changes.select(key), key, "left_anti").select(*target.columns).unionByName(changes)


def upserted(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal")
    settled = customer.where("c_acctbal < 0").withColumn("c_acctbal", F.lit(0.0))
    new = table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1_000_000_000).alias("c_custkey"), F.col("s_name").alias("c_name"), F.col("s_acctbal").alias("c_acctbal"))
    return upsert(customer, settled.unionByName(new), "c_custkey")


def sampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sample of lineitem: whether its size is within five standard deviations, and whether each of its rows is of the table."""
    items = table(spark, sf_dir, "lineitem")
    sample = items.sample(0.2, seed=7)
    size = items.agg(F.count(F.lit(1)).alias("n")).crossJoin(sample.agg(F.count(F.lit(1)).alias("k")))  # a row each
    strange = sample.join(items, items.columns, "left_anti").agg(F.count(F.lit(1)).alias("strange"))
    return size.crossJoin(strange).select("n", (F.abs(F.col("k") - 0.2 * F.col("n")) <= 5 * F.sqrt(0.16 * F.col("n"))).alias("size_close"), "strange")


QUERIES = {"xml_round_trip": xml, "upsert": upserted, "sample": sampled, "csv_round_trip": csv, "json_round_trip": json, "orc_round_trip": orc, "text_round_trip": text, "partition_pruning": partitioned, "bucketed_join": bucketed_join, "dynamic_pruning": dynamic_pruning, "clustered_scan": clustered_scan}

ORACLES = {
    "dynamic_pruning": "SELECT s_suppkey, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA'",
    "clustered_scan": "SELECT l_orderkey, l_partkey, date_diff('day', DATE '1995-01-01', l_shipdate::DATE)::INTEGER AS day, l_extendedprice FROM lineitem WHERE day BETWEEN 100 AND 120 OR l_partkey < 20",
    "xml_round_trip": "SELECT * FROM nation",
    "upsert": "SELECT c_custkey, c_name, greatest(c_acctbal, 0) AS c_acctbal FROM customer UNION ALL SELECT s_suppkey + 1000000000, s_name, s_acctbal FROM supplier",
    "sample": "SELECT count(*) AS n, true AS size_close, 0 AS strange FROM lineitem",
    "csv_round_trip": "SELECT * FROM supplier",
    "json_round_trip": "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders",
    "orc_round_trip": "SELECT * FROM nation",
    "text_round_trip": "SELECT r_regionkey, r_name FROM region",
    "partition_pruning": "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'",
    "bucketed_join": "SELECT o_orderpriority, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
}
