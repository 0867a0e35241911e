"""A Python data source: tables as Parquet shards with manifests, for batches and streams.

A write's tasks put their rows in files of their own, in the write's folder, and report them with the key's least and
greatest value; nothing counts until the driver has renamed the manifest of the whole
write. A task that fails removes its file, and an aborted write its folder. A read plans
a partition for each file that the key's filters allow, and a stream takes manifests as offsets, in
order. Files go through Arrow's file systems, so that the path may be in any store that these know.

Options: path, and key (a column of numbers or strings whose range each file records).
Defined results: files without rows are not written; null keys are in no range, so that a filter on the key skips
files with nulls alone; a path without manifests is an empty table, which needs a schema from the reader.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema

from tessera.sources.tables import scratch, table


def _store(path: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


@dataclass
class Shard(InputPartition):
    """A file, and its key's range where it has one."""

    file: str
    low: object = None
    high: object = None


@dataclass
class Written(WriterCommitMessage):
    """A task's file and rows; no file for no rows."""

    file: str | None
    rows: int = 0
    low: object = None
    high: object = None


def manifests(path: str) -> list[str]:
    """The names of complete writes, in order."""
    files, top = _store(path)
    found = files.get_file_info(pa.fs.FileSelector(f"{top}/manifests", allow_not_found=True))
    return sorted(f.base_name for f in found if f.base_name.endswith(".json"))


def _manifest(path: str, name: str) -> dict:
    files, top = _store(path)
    with files.open_input_stream(f"{top}/manifests/{name}") as stream:
        return json.loads(stream.read())


def shards(path: str, names: list[str]) -> list[Shard]:
    return [Shard(f["file"], f["low"], f["high"]) for name in names for f in _manifest(path, name)["files"]]


def read_shard(path: str, shard: Shard, schema: T.StructType) -> Iterator[pa.RecordBatch]:
    files, top = _store(path)
    target = to_arrow_schema(schema)
    with files.open_input_file(f"{top}/data/{shard.file}") as stream:
        for batch in pq.ParquetFile(stream).iter_batches(10_000, columns=schema.names):
            yield from pa.Table.from_batches([batch]).select(schema.names).cast(target).to_batches()


class ShardReader(DataSourceReader):
    def __init__(self, path: str, key: str | None, schema: T.StructType):
        self.path, self.key, self.schema, self.tests = path, key, schema, []

    def pushFilters(self, filters):
        """Filters on the key decide about files; Spark still applies all of them to rows."""
        for f in filters:
            if getattr(f, "attribute", None) == (self.key,):
                self.tests.append(f)
            yield f

    def allows(self, shard: Shard) -> bool:
        if not self.tests:
            return True
        if shard.low is None:
            return False
        kinds = {
            EqualTo: lambda v: shard.low <= v <= shard.high,
            In: lambda v: any(shard.low <= x <= shard.high for x in v if x is not None),
            GreaterThan: lambda v: shard.high > v,
            GreaterThanOrEqual: lambda v: shard.high >= v,
            LessThan: lambda v: shard.low < v,
            LessThanOrEqual: lambda v: shard.low <= v,
        }
        return all(kinds[type(f)](f.value) for f in self.tests if type(f) in kinds and f.value is not None)

    def partitions(self) -> list[Shard]:
        found = [s for s in shards(self.path, manifests(self.path)) if self.allows(s)]
        return found or [Shard("")]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from read_shard(self.path, partition, self.schema)


class ShardStream(DataSourceStreamReader):
    """Offsets are numbers of manifests."""

    def __init__(self, path: str, schema: T.StructType):
        self.path, self.schema = path, schema

    def initialOffset(self) -> dict:
        return {"writes": 0}

    def latestOffset(self) -> dict:
        return {"writes": len(manifests(self.path))}

    def partitions(self, start: dict, end: dict) -> list[Shard]:
        return shards(self.path, manifests(self.path)[start["writes"] : end["writes"]]) or [Shard("")]

    def read(self, partition: Shard) -> Iterator[pa.RecordBatch]:
        if partition.file:
            yield from read_shard(self.path, partition, self.schema)


class ShardWriter(DataSourceArrowWriter):
    def __init__(self, path: str, key: str | None, schema: T.StructType, overwrite: bool):
        self.path, self.key, self.schema, self.overwrite, self.folder = path, key, schema, overwrite, uuid.uuid4().hex
        files, top = _store(path)
        for folder in (f"data/{self.folder}", "manifests"):
            files.create_dir(f"{top}/{folder}", recursive=True)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        files, top = _store(self.path)
        name, out, done = f"{self.folder}/{uuid.uuid4().hex}.parquet", None, Written(None)
        try:
            for batch in iterator:
                if not batch.num_rows:
                    continue
                if out is None:
                    out = pq.ParquetWriter(f"{top}/data/{name}", batch.schema, filesystem=files)
                out.write_batch(batch)
                done.file, done.rows = name, done.rows + batch.num_rows
                if self.key:
                    ends = pc.min_max(batch.column(batch.schema.get_field_index(self.key))).as_py()
                    if ends["min"] is not None:
                        done.low = ends["min"] if done.low is None else min(done.low, ends["min"])
                        done.high = ends["max"] if done.high is None else max(done.high, ends["max"])
            if out is not None:
                out.close()
            return done
        except BaseException:
            if out is not None:
                out.close()
                files.delete_file(f"{top}/data/{name}")
            raise

    def commit(self, messages: list[Written | None]) -> None:
        """One rename makes the write visible as a whole."""
        files, top = _store(self.path)
        before = manifests(self.path)
        kept = [m for m in messages if m is not None and m.file]
        row = {"schema": self.schema.json(), "files": [{"file": m.file, "rows": m.rows, "low": m.low, "high": m.high} for m in kept]}
        number = int(before[-1].removesuffix(".json")) + 1 if before else 0
        with files.open_output_stream(f"{top}/manifests/.{number:010d}.tmp") as stream:
            stream.write(json.dumps(row).encode())
        files.move(f"{top}/manifests/.{number:010d}.tmp", f"{top}/manifests/{number:010d}.json")
        if self.overwrite:  # the writes before it go when it is there
            for name in before:
                gone = {s.file.split("/")[0] for s in shards(self.path, [name])}
                files.delete_file(f"{top}/manifests/{name}")
                for folder in gone:
                    files.delete_dir(f"{top}/data/{folder}")

    def abort(self, messages: list[Written | None]) -> None:
        """The write's folder goes, with what tasks left that were ended without a word; one that is still running has nowhere to write."""
        files, top = _store(self.path)
        files.delete_dir(f"{top}/data/{self.folder}")


class Shards(DataSource):
    """``spark.dataSource.register(Shards)``, then format("shards")."""

    @classmethod
    def name(cls) -> str:
        return "shards"

    def _path(self) -> str:
        if not self.options.get("path"):
            raise ValueError("shards need a path")
        return self.options["path"]

    def schema(self) -> T.StructType:
        names = manifests(self._path())
        if not names:
            raise ValueError(f"{self._path()} has no complete write and no schema was given")
        return T.StructType.fromJson(json.loads(_manifest(self._path(), names[-1])["schema"]))

    def reader(self, schema: T.StructType) -> ShardReader:
        return ShardReader(self._path(), self.options.get("key"), schema)

    def streamReader(self, schema: T.StructType) -> ShardStream:
        return ShardStream(self._path(), schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> ShardWriter:
        return ShardWriter(self._path(), self.options.get("key"), schema, overwrite)


PUSHDOWN = "spark.sql.python.filterPushdown.enabled"


def shard_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written by ranges of their key, and some of them read back from the files that can hold them."""
    spark.dataSource.register(Shards)
    spark.conf.set(PUSHDOWN, "true")
    path = scratch(spark, "shards")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate", "o_orderpriority")
    orders.repartitionByRange(8, "o_orderkey").write.format("shards").option("key", "o_orderkey").mode("append").save(path)
    found = spark.read.format("shards").option("key", "o_orderkey").load(path)
    return found.where((F.col("o_orderkey") > 100) & (F.col("o_orderkey") <= 700) & (F.col("o_totalprice") > 1000))


QUERIES = {"shard_round_trip": shard_round_trip}

ORACLES = {"shard_round_trip": "SELECT o_orderkey, o_custkey, o_totalprice, o_orderdate, o_orderpriority FROM orders WHERE o_orderkey > 100 AND o_orderkey <= 700 AND o_totalprice > 1000"}
