"""The Python data source: round trips, files that filters skip, writes that fail, and streams."""

import datetime
import os
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.sources import shards

ROWS = [(k if k % 9 else None, f"n{k}", float(k) if k % 4 else None, datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=k), [k, None]) for k in range(200)]
SCHEMA = "k long, name string, v double, t timestamp_ntz, list array<int>"


@pytest.fixture
def source(spark):
    spark.dataSource.register(shards.Shards)
    spark.conf.set(shards.PUSHDOWN, "true")
    return lambda path: spark.read.format("shards").option("key", "k").load(path)


def write(df, path, mode="append"):
    df.write.format("shards").option("key", "k").mode(mode).save(path)


def values(df):
    return Counter((k, n, v, t, tuple(x)) for k, n, v, t, x in df.collect())


def data_files(path):
    return sorted(f"{folder}/{name}" for folder in os.listdir(f"{path}/data") for name in os.listdir(f"{path}/data/{folder}"))


WANT = Counter((k, n, v, t, tuple(x)) for k, n, v, t, x in ROWS)


def test_round_trip_append_and_overwrite(spark, source, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame(ROWS, SCHEMA)
    write(df.repartitionByRange(4, "k"), path)
    assert source(path).schema == df.schema and values(source(path)) == WANT
    write(df.where("k < 10"), path)
    assert source(path).count() == 200 + df.where("k < 10").count()
    assert values(source(path).select("k", "name", "v", "t", "list").where("k = 3 OR name = 'n9'")) == values(df.where("k = 3 OR name = 'n9'").unionByName(df.where("k = 3")))
    write(df.where("k > 190"), path, "overwrite")
    assert values(source(path)) == values(df.where("k > 190"))
    assert len(os.listdir(f"{path}/manifests")) == 1 and set(data_files(path)) == {s.file for s in shards.shards(path, shards.manifests(path))}


def test_filters_on_the_key_skip_files(spark, source, tmp_path):
    path = str(tmp_path / "t")
    write(spark.createDataFrame(ROWS, SCHEMA).repartitionByRange(8, "k"), path)
    every = source(path).rdd.getNumPartitions()
    assert every == 8
    for condition in ("k = 100", "k > 180", "k >= 20 AND k < 25", "k IN (5, 6, 7)", "100 > k AND v > 80"):
        found = source(path).where(condition)
        assert found.rdd.getNumPartitions() < every
        assert values(found) == values(spark.createDataFrame(ROWS, SCHEMA).where(condition))
    assert source(path).where("k = 100000").count() == 0 and source(path).where("k IS NULL").count() == sum(r[0] is None for r in ROWS)


def test_a_failed_write_leaves_nothing(spark, source, tmp_path):
    """One task fails after rows were written: its file, the others' files and the manifest are not there, and what was there before stays."""
    path = str(tmp_path / "t")
    df = spark.createDataFrame(ROWS, SCHEMA)
    write(df, path)
    before = data_files(path)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10")
    try:
        with pytest.raises(Exception, match="no such row"):
            write(df.repartitionByRange(4, "k").withColumn("v", F.when(F.col("k") == 199, F.raise_error(F.lit("no such row")).cast("double")).otherwise(F.col("v"))), path)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert data_files(path) == before and len(shards.manifests(path)) == 1
    assert values(source(path)) == WANT


def test_empty_tables(spark, source, tmp_path):
    path = str(tmp_path / "t")
    with pytest.raises(Exception, match="no complete write"):
        source(path).count()
    assert spark.read.format("shards").schema(SCHEMA).load(path).count() == 0
    write(spark.createDataFrame([], SCHEMA), path)
    assert source(path).count() == 0 and len(source(path).columns) == 5


def test_a_stream_takes_writes_in_order(spark, source, tmp_path):
    """Each write once, those that come later when the stream goes on from its checkpoint."""
    path, out = str(tmp_path / "t"), str(tmp_path / "out")
    df = spark.createDataFrame(ROWS, SCHEMA)

    def drain():
        stream = spark.readStream.format("shards").schema(SCHEMA).load(path)
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out).count()

    write(df.where("k < 50"), path)
    first = drain()
    assert first == df.where("k < 50").count()
    write(df.where("k >= 50"), path)
    assert drain() == df.where("k IS NOT NULL").count()
    assert values(spark.read.parquet(out)) == values(df.where("k IS NOT NULL"))
