"""Exact deduplication by content-defined chunk recipes.

A text's UTF-8 bytes are cut where a rolling hash of the last 32 bytes has its
low bits zero, so that equal passages give equal chunks wherever they stand. The
ordered list of a text's chunk identifiers is its recipe, and texts are equal
exactly if their recipes are, provided that an identifier stands for one content.
That is verified, not assumed: the distinct (identifier, chunk) pairs of the whole
corpus are formed with a combine before the shuffle, and an identifier with two
contents is not trusted; texts whose recipes hold such an identifier are compared
as a whole instead. Chunk bytes are moved once, and
copies of a chunk within a task not at all; everything after that moves recipes
of some 16 bytes for 3 KB of text.

A group of copies, however large, is one row of a partial aggregate; the join that
gives each row its group is an equi-join that adaptive execution can split.

Defined results: a null text counts as empty; all empty texts are equal to each
other; repeated rows are rows of their own in ``group_size`` and all rows that
carry the largest doc_id of a group are kept; rows with a null doc_id stay only in
groups that have no other; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import checkpoint

MIN_BYTES, MEAN_BITS, MAX_BYTES, WINDOW, PIECE = 1024, 11, 16384, 32, 4_000_000
#: A random word for each byte value, from a fixed seed.
GEAR = np.random.default_rng(20240229).integers(0, 2**32, 256, dtype=np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """At each byte the gear hash of the 32 bytes that end there, by doubling."""
    h = GEAR[data]
    width = 1
    while width < WINDOW:
        h[width:] += h[:-width] << np.uint32(width)
        width *= 2
    return h


def cuts(data: np.ndarray) -> list[int]:
    """Ends of the chunks of one text's bytes.

    Whether a byte is a border depends on the 32 bytes before it alone, and a chunk
    has MIN_BYTES to MAX_BYTES but for the last one.
    """
    n = len(data)
    if n <= MIN_BYTES:
        return [n] if n else []
    places: list[int] = []
    for begin in range(0, n, PIECE):  # bounds the memory for very long texts
        before = min(begin, WINDOW - 1)
        high = rolling(data[begin - before : begin + PIECE])[before:] >> np.uint32(32 - MEAN_BITS)
        places += (np.flatnonzero(high == 0) + begin + 1).tolist()
    ends, at = [], 0
    while n - at > MIN_BYTES:
        i = bisect_left(places, at + MIN_BYTES)
        at = min(places[i] if i < len(places) else n, at + MAX_BYTES, n)
        ends.append(at)
    if at < n:
        ends.append(n)
    return ends


def chunks_of(buffer: memoryview) -> list[memoryview]:
    ends = cuts(np.frombuffer(buffer, np.uint8))
    return [buffer[a:b] for a, b in zip([0, *ends], ends)]


def _binary(column: pa.Array) -> pa.Array:
    return column.cast(pa.binary()) if pa.types.is_string(column.type) else column.cast(pa.large_binary())


def _digest(chunk: memoryview, size: int) -> bytes:
    return hashlib.blake2b(chunk, digest_size=size).digest()


def recipes(df: DataFrame, digest_size: int = 16) -> DataFrame:
    """Columns ``id``, ``digest`` (SHA-256 of the text) and ``recipe`` (ordered chunk identifiers)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = _binary(batch.column(2))
            found = [[_digest(c, digest_size) for c in chunks_of(memoryview(t.as_buffer()))] for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.list_(pa.binary()))], names=["id", "digest", "recipe"])

    return df.select("id", F.sha2(F.encode("text", "UTF-8"), 256).alias("digest"), "text").mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, digest string, recipe array<binary>")


def chunks(df: DataFrame, digest_size: int = 16, flush_bytes: int = 4_000_000) -> DataFrame:
    """Columns ``chunk_id`` and ``chunk``: every chunk of every text, without those that a batch has twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            seen: dict[bytes, memoryview] = {}
            held = 0
            for t in _binary(batch.column(0)):
                for c in chunks_of(memoryview(t.as_buffer())):
                    key = _digest(c, digest_size)
                    if key in seen and seen[key] == c:
                        continue
                    if key in seen or held > flush_bytes:  # another content by the same identifier must not be lost
                        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(map(bytes, seen.values())), pa.binary())], names=["chunk_id", "chunk"])
                        seen, held = {}, 0
                    seen[key] = c
                    held += len(c)
            if seen:
                yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(map(bytes, seen.values())), pa.binary())], names=["chunk_id", "chunk"])

    return df.select("text").mapInArrow(run, "chunk_id binary, chunk binary")


def untrusted(chunk_rows: DataFrame) -> DataFrame:
    """Chunk identifiers that stand for more than one content."""
    return chunk_rows.groupBy("chunk_id", "chunk").agg(F.lit(1).alias("one")).groupBy("chunk_id").agg(F.count("one").alias("contents")).where("contents > 1").select("chunk_id")


def exact_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_size: int = 16) -> DataFrame:
    """Per row: the id column, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``."""
    texts = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = checkpoint(recipes(texts, digest_size))
    bad = checkpoint(untrusted(chunks(texts, digest_size)))
    if not bad.isEmpty():
        affected = rows.select("digest", F.explode(F.array_distinct("recipe")).alias("chunk_id")).join(bad, "chunk_id", "left_semi").select("digest").distinct()
        data = F.encode("text", "UTF-8")
        whole = texts.withColumn("digest", F.sha2(data, 256)).join(affected, "digest", "left_semi").select("id", "digest", F.array(data).alias("recipe"))
        rows = checkpoint(rows.join(affected, "digest", "left_anti").select("id", "digest", "recipe").unionByName(whole))
    groups = rows.groupBy("recipe").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(groups, "recipe").select(
        F.col("id").alias(id_col),
        "keep_id",
        "group_size",
        F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def keep_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with their own columns; of rows with one id each is judged by its own text."""
    groups = exact_groups(df, id_col, text_col).where("kept").select(F.col(id_col).alias("__kept"), F.col("text_sha256").alias("__digest"))
    digest = F.sha2(F.encode(F.coalesce(df[text_col].cast("string"), F.lit("")), "UTF-8"), 256)
    return df.join(groups, df[id_col].eqNullSafe(groups["__kept"]) & (digest == groups["__digest"]), "left_semi")
