"""Deterministic sharded WARC archives: a writer and a reader.

Records are range-sorted by page id in one shuffle, which also brings each page the
decision whether it repeats another one: a row without payload that sorts before
the page. The ranges come from exact running sums of bytes over all ids and payloads,
not from samples, so that they are the same in every run and hold about equal
bytes however ids crowd; rows of one id are told apart by their payloads' digests, and only repeated rows stay together. A task writes its range to files of ``roll_bytes`` compressed bytes (each
record a gzip member with a fixed time stamp), under a name of its own attempt, and
renames a file when it is complete; its row of the manifest is its result. The
manifest is written by Spark's committer when all tasks have ended, and the reader
opens what the manifest names and nothing else: files of lost or repeated attempts
are never read. Headers, digests, record ids and dates come from the records, so
that the same input gives the same bytes.

Payloads of ``least_bytes`` or more that are equal (SHA-256 and SHA-1 alike) are
stored once, with the largest page id; the others become revisit records. A hot
payload is one row of a partial aggregate and of a join that can be split.

The reader streams record by record and verifies lengths and digests; its tasks get
the manifest's files by their number and bytes.

Files go through Arrow's file systems, to the folder given, which must be one that
all executors share (the query takes spark.checkpoint.dir).

Defined results: null html is an empty payload; a null url is written as empty; a
null page id is kept as null and is never the stored copy of others' payloads; rows
with the same page id are records of their own; of equal payloads all rows with the
largest page id are responses; other columns are ignored; an empty table gives
an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import blocks_for, checkpoint, small_batches
from tessera.operators.ranks import prefix_sums

LEAST_BYTES, ROLL_BYTES = 1000, 16_000_000
#: Payload bytes that a task writes, more for large inputs; compressed bytes that a task reads where there are many files.
PART_BYTES, MOST_PART_BYTES, PARTS, READ_BYTES = 8_000_000, 256_000_000, 4096, 64_000_000
#: What a record has besides its payload, about.
HEAD_BYTES = 600
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "file string, records long, bytes long, sha256 string, first_page long, last_page long"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page: int | None, copy: int, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """One record, compressed as a gzip member. Its id holds the page, the payload's digest and how many records with both stand before."""
    head = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=UTF-8", f"Content-Length: {len(payload)}", "", ""]
    block = "\r\n".join(head).encode() + (payload if refers_to is None else b"")
    name = "none" if page is None else str(page)
    digest = hashlib.sha256(payload).hexdigest()
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{name}:{digest}:{copy}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", url.replace("\r", "%0D").replace("\n", "%0A")),
        ("WARC-Payload-Digest", _sha1(payload)),
        ("WARC-Block-Digest", _sha1(block)),
        *((("WARC-Profile", REVISIT_PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}:{digest}:0>")) if refers_to is not None else ()),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(text.encode() + block + b"\r\n\r\n") + packer.flush()


class Roller:
    """Files of one task: written under temporary names, renamed when complete."""

    def __init__(self, folder: str, part: int, attempt: int, roll_bytes: int):
        self.fs, self.folder = pa.fs.FileSystem.from_uri(folder)
        self.part, self.attempt, self.roll = part, attempt, roll_bytes
        self.sequence, self.out = 0, None
        self.done: list[dict] = []

    def write(self, page: int | None, data: bytes) -> None:
        if self.out is None:
            self.temporary = f"{self.folder}/.tmp-{self.part:05d}-{self.sequence:05d}-{self.attempt}"
            self.out, self.sum = self.fs.open_output_stream(self.temporary, compression=None), hashlib.sha256()
            self.row = {"records": 0, "bytes": 0, "first_page": page}
        self.out.write(data)
        self.sum.update(data)
        self.row |= {"records": self.row["records"] + 1, "bytes": self.row["bytes"] + len(data), "last_page": page}
        if self.row["bytes"] >= self.roll:
            self.close()

    def close(self) -> None:
        if self.out is None:
            return
        self.out.close()
        name = f"part-{self.part:05d}-{self.sequence:05d}.warc.gz"
        self.fs.move(self.temporary, f"{self.folder}/{name}")
        self.done.append({"file": name, "sha256": self.sum.hexdigest(), **self.row})
        self.sequence, self.out = self.sequence + 1, None


def _local(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def outline(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages(page_id, payload) to page_id, bytes, digest, and the digests of payloads that may be stored once."""
    large = F.octet_length("payload") >= least_bytes
    digested = pages.select("page_id", F.octet_length("payload").alias("bytes"), F.sha2("payload", 256).alias("digest"), F.when(large, F.sha1("payload")).alias("sha1"))
    return checkpoint(digested.withColumn("key", F.when(F.col("sha1").isNotNull(), F.col("digest"))))


def repeats(outlined: DataFrame) -> DataFrame:
    """(page_id, payload key, refers_to) of the pages that repeat another page's payload."""
    small = outlined.where("key IS NOT NULL").select("page_id", "key", "sha1")
    kept = small.groupBy("key", "sha1").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n")).where("n > 1 AND refers_to IS NOT NULL")
    return small.join(kept, ["key", "sha1"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to"))).select("page_id", "key", "refers_to")


def ranges(outlined: DataFrame) -> tuple[DataFrame, int]:
    """One row with ``firsts``, the least (page_id, digest) of each part in order, and the number of parts: ranges of about equal bytes."""
    size = F.col("bytes") + HEAD_BYTES
    each = outlined.groupBy("page_id", "digest").agg(F.sum(size).alias("own"))
    total = each.agg(F.sum("own")).first()[0] or 0
    part_bytes = min(max(PART_BYTES, total // PARTS), MOST_PART_BYTES)
    placed = prefix_sums(each.withColumn("sum", F.col("own")), [("page_id", "asc"), ("digest", "asc")], ["sum"])
    part = F.floor((F.col("sum") - F.col("own")) / part_bytes)
    firsts = checkpoint(placed.groupBy(part.alias("part")).agg(F.min(F.struct("page_id", "digest")).alias("first")), 1)
    return firsts.agg(F.sort_array(F.collect_list("first")).alias("firsts")), max(firsts.count(), 1)  # a row a part


def part_of(page_id: Column, digest: Column, firsts: Column, n_parts: int) -> Column:
    """The part of a row: how many firsts are at or before it, less one, by halving."""
    own = F.struct(page_id.alias("page_id"), digest.alias("digest"))

    def halve(s: Column, _: Column) -> Column:
        middle = F.floor((s["low"] + s["high"]) / 2).cast("int")
        after = F.get(firsts, middle) <= own
        return F.struct(F.when(after & (s["low"] < s["high"]), middle + 1).otherwise(s["low"]).alias("low"), F.when(after | (s["low"] >= s["high"]), s["high"]).otherwise(middle).alias("high"))

    begin = F.struct(F.lit(0).alias("low"), F.lit(n_parts).alias("high"))
    found = F.aggregate(F.sequence(F.lit(1), F.lit(n_parts.bit_length() + 1)), begin, halve)
    return F.greatest(found["low"] - 1, F.lit(0))


def write(df: DataFrame, folder: str, roll_bytes: int = ROLL_BYTES, least_bytes: int = LEAST_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Archive the rows of df below folder; the manifest."""
    spark = df.sparkSession
    folder = _local(folder.rstrip("/"))
    pages = df.select(F.col(id_col).cast("long").alias("page_id"), F.coalesce(F.col(url_col).cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "UTF-8").alias("payload"))
    none = F.lit(None)
    stored = pages.select("page_id", F.lit(1).alias("kind"), "url", "payload", F.sha2("payload", 256).alias("key"), none.cast("long").alias("refers_to"))
    outlined = outline(pages, least_bytes)
    decided = repeats(outlined).select("page_id", F.lit(0).alias("kind"), none.cast("string").alias("url"), none.cast("binary").alias("payload"), "key", "refers_to").distinct()
    firsts, n_parts = ranges(outlined)
    part = part_of(F.col("page_id"), F.col("key"), F.col("firsts"), n_parts)
    dealt = stored.unionByName(decided).crossJoin(F.broadcast(firsts)).withColumn("part", part)  # one row
    columns = ("page_id", "kind", "url", "payload", "key", "refers_to")
    ordered = dealt.select(*columns, "part").repartitionById(n_parts, "part").sortWithinPartitions("page_id", "key", "kind", "url").select(*columns)
    file_system, top = pa.fs.FileSystem.from_uri(folder)
    file_system.create_dir(f"{top}/data")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        out = Roller(f"{folder}/data", context.partitionId(), context.taskAttemptId(), roll_bytes)
        now, copy, target = None, 0, None
        for batch in batches:
            columns = [batch.column(i) for i in range(6)]
            for i in range(batch.num_rows):
                page, kind, url, payload, key, refers_to = (c[i] for c in columns)
                own = page.as_py(), key.as_py()
                if own != now:
                    now, copy, target = own, 0, None
                if kind.as_py() == 0:  # stands before the rows that it decides
                    target = refers_to.as_py()
                    continue
                out.write(own[0], record(own[0], copy, url.as_py(), payload.as_py(), target))
                copy += 1
        out.close()
        yield pa.RecordBatch.from_pylist(out.done, pa.schema([("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string()), ("first_page", pa.int64()), ("last_page", pa.int64())]))

    with small_batches(spark):
        ordered.mapInArrow(run, MANIFEST).write.parquet(f"{folder}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")


def records_of(stream) -> Iterator[tuple[dict, bytes]]:
    """Headers and block of each record; a member is read as it comes, so that memory holds one record."""
    pending = b""
    while True:
        unpacker, parts = zlib.decompressobj(31), []
        while not unpacker.eof:
            data = pending or stream.read(1 << 20)
            pending = b""
            if not data:
                if parts:
                    raise ValueError("an archive ends within a record")
                return
            parts.append(unpacker.decompress(data))
        pending = unpacker.unused_data
        head, _, rest = b"".join(parts).partition(b"\r\n\r\n")
        version, *lines = head.decode().split("\r\n")
        if version != "WARC/1.1":
            raise ValueError(f"not a record: {version[:40]}")
        fields = dict(line.split(": ", 1) for line in lines)
        block = rest[: int(fields["Content-Length"])]
        if rest[len(block) :] != b"\r\n\r\n" or fields["WARC-Block-Digest"] != _sha1(block):
            raise ValueError(f"a damaged record: {fields['WARC-Record-ID']}")
        yield fields, block


def _page(name: str) -> int | None:
    page = name.split(":")[2]
    return None if page == "none" else int(page)


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the files that the manifest names, verified: the columns of RECORDS (a revisit's payload is null)."""
    folder = _local(folder.rstrip("/"))
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file", "records")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, top = pa.fs.FileSystem.from_uri(f"{folder}/data")
        for batch in batches:
            for name, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows, held, met = [], 0, 0
                with files.open_input_stream(f"{top}/{name}", compression=None) as stream:
                    for fields, block in records_of(stream):
                        http, _, payload = block.partition(b"\r\n\r\n")
                        size = int(http.rpartition(b"Content-Length: ")[2])
                        revisit = fields["WARC-Type"] == "revisit"
                        if not revisit and (len(payload) != size or fields["WARC-Payload-Digest"] != _sha1(payload)):
                            raise ValueError(f"a damaged payload: {fields['WARC-Record-ID']}")
                        digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                        rows.append((_page(fields["WARC-Record-ID"]), fields["WARC-Target-URI"], size, digest, fields["WARC-Type"], _page(fields["WARC-Refers-To"]) if revisit else None, None if revisit else payload))
                        met += 1
                        held += len(payload)
                        if held > 4_000_000 or len(rows) > 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                            rows, held = [], 0
                if met != expected:
                    raise ValueError(f"{name} has {met} records instead of {expected}")
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files, size = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").agg(F.count(F.lit(1)), F.sum("bytes")).first()
    # the rows are names: adaptive execution, which goes by their bytes, would leave all files to one task
    tasks = max(blocks_for(size or 0, READ_BYTES), min(files, 4 * spark.sparkContext.defaultParallelism), 1)
    return manifest.repartition(tasks, "file").mapInArrow(run, RECORDS)
