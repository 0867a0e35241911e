"""Importance resampling towards a target's distribution of hashed word n-grams.

Words are ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text with A-Z lower-cased, and
features all runs of 1 to ``NGRAM`` consecutive words, joined by a space, each in the
bucket of its CRC-32 modulo ``BUCKETS``. A bucket's gain is the logarithm of its share
in the target by its share in the corpus, both smoothed, in thousandths; a document's
weight is the floored mean over its features. Weights with Gumbel noise of the id's
hash are scores, and the highest scores are a draw without replacement.

Long texts are cut at word boundaries into chunks of some ``CHUNK`` bytes, which are
dealt to all tasks. A chunk owns the features that begin at its own words, and brings the
NGRAM - 1 words that follow along, so that each feature counts once. Short texts stay
where they are read, as chunks of their own. Counts are summed by bucket; sums and
numbers of a document's chunks are summed by document. Checksums are computed for all words
of a batch together, byte place by byte place, and those of two words from the words'.

The draw numbers all scores by one range sort; no task holds them all.

Defined results: null and empty texts have no features, weight 0, and are not drawn;
ties of score go to the smaller id, null ids last (their noise is that of the text
``7:null``); repeated rows are rows of their own, each drawn or not; rows of one id
have their own weights; other columns are ignored; an empty table gives no rows, and an
empty target a T of 0. A single word longer than a chunk stays whole.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import scratch, small_batches
from tessera.operators.ranks import row_numbers

BUCKETS, NGRAM, LEAST_WORDS, PERCENT, SEED = 10_000, 2, 20, 25, 7
#: Bytes of a chunk, about, and of texts that are hashed at a time.
CHUNK, PIECE = 1 << 16, 500_000
#: Words up to this many bytes are hashed together, longer ones alone.
TOGETHER = 48
_BYTES = np.arange(256)
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_AFTER = LOWER[_BYTES]
IS_WORD = ((_AFTER >= 0x30) & (_AFTER <= 0x39)) | ((_AFTER >= 0x61) & (_AFTER <= 0x7A)) | (_AFTER >= 0x80)


def _table() -> np.ndarray:
    """What a byte does to a CRC-32 register (the reflected polynomial 0xEDB88320)."""
    row = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        row = np.where(row & 1, (row >> np.uint32(1)) ^ np.uint32(0xEDB88320), row >> np.uint32(1))
    return row


CRC = _table()


def _step(register: np.ndarray, byte: np.ndarray | int) -> np.ndarray:
    return CRC[(register ^ byte) & np.uint32(255)] ^ (register >> np.uint32(8))


def _shifts(most: int) -> np.ndarray:
    """[n, k, b]: what n zero bytes make of a register whose k-th byte is b; a register is the exclusive-or of its bytes' parts."""
    out = np.empty((most + 1, 4, 256), np.uint32)
    for k in range(4):
        out[0, k] = np.arange(256, dtype=np.uint32) << np.uint32(8 * k)
    for n in range(most):
        out[n + 1] = _step(out[n], 0)
    return out


SHIFTS = _shifts(TOGETHER)


def word_sums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word of lower-cased bytes."""
    order = np.argsort(-sizes, kind="stable")
    places, lengths = starts[order], sizes[order]
    register = np.full(len(order), 0xFFFFFFFF, np.uint32)
    long = int(np.searchsorted(-lengths, -TOGETHER))  # so many are longer
    more = np.searchsorted(-lengths, -np.arange(1, TOGETHER + 1), "right")  # so many have that many bytes at least
    for k in range(TOGETHER):
        n = int(more[k])
        if n <= long:
            break
        register[long:n] = _step(register[long:n], data[places[long:n] + k])
    out = np.empty(len(order), np.uint32)
    out[order] = ~register
    for k in range(long):
        out[order[k]] = zlib.crc32(data[places[k] : places[k] + lengths[k]].tobytes())
    return out


def pair_sums(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, sums: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The CRC-32 of each word of first, a space and the next word: the register after the space goes on by as many zero bytes, and the next word's own sum is added."""
    left = ~_step(~sums[first], np.uint32(32))
    size, right = sizes[first + 1], sums[first + 1]
    short = np.minimum(size, TOGETHER)
    out = right.copy()
    for k in range(4):
        out ^= SHIFTS[short, k, (left >> np.uint32(8 * k)) & np.uint32(255)]
    for k in np.flatnonzero(size > TOGETHER):
        w = first[k] + 1
        out[k] = zlib.crc32(data[starts[w] : starts[w] + sizes[w]].tobytes(), int(left[k]))
    return out


def features(column: pa.Array, owned: np.ndarray | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For some texts at a time: the first's number, how many words each owns, and each feature's text (from 0) and bucket.

    owned: of how many first bytes of each text the words are its own; the rest is what it brings along.
    """
    column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) else np.int32
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], width)[column.offset : column.offset + n + 1].astype(np.int64)
    whole = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + PIECE, "right")) - 1)
        data = LOWER[whole[offsets[at] : offsets[stop]]]
        bounds = offsets[at : stop + 1] - offsets[at]
        word = np.zeros(len(data) + 1, bool)
        word[:-1] = IS_WORD[data]
        border = np.zeros(len(data) + 1, bool)
        border[bounds] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | border[1:]
        ends = word[:-1] & (~word[1:] | border[1:])
        starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        text = np.searchsorted(bounds, starts, "right") - 1
        sizes = stops - starts
        own = np.ones(len(starts), bool) if owned is None else starts - bounds[text] < owned[at:stop][text]
        sums = word_sums(data, starts, sizes)
        first = np.flatnonzero((text[1:] == text[:-1]) & own[:-1])
        pairs = pair_sums(data, starts, sizes, sums, first)
        owner = np.concatenate([text[own], text[first]])
        yield at, np.bincount(text[own], minlength=stop - at), owner, (np.concatenate([sums[own], pairs]) % np.uint32(BUCKETS)).astype(np.int64)
        at = stop


def cut(data: bytes, size: int | None = None) -> list[tuple[int, int, int]]:
    """begin, end of what is owned, end of what is brought along, for each chunk of a text: ends stand before a word, or at the end."""
    size = size or CHUNK
    bytes_ = np.frombuffer(data, np.uint8)
    word = IS_WORD[bytes_]
    starts = np.flatnonzero(word & np.append(True, ~word[:-1])[: len(word)])
    out, at = [], 0
    while at < len(data):
        k = int(np.searchsorted(starts, at + size))
        stop = int(starts[k]) if k < len(starts) else len(data)
        after = k + NGRAM - 1
        out.append((at, stop, int(starts[after]) if after < len(starts) else len(data)))
        at = stop
    return out


def chunks(long_texts: DataFrame, id_type: str) -> DataFrame:
    """id, hash, text to id, hash, chunk (its number), owned (bytes) and text (with what is brought along)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["id", "hash", "chunk", "owned", "text"]
        for batch in batches:
            contents = batch.column(2).cast(pa.binary() if pa.types.is_string(batch.column(2).type) else pa.large_binary())
            for row, content in enumerate(contents):
                data = content.as_py()
                places = cut(data)
                for k in range(0, len(places), 64):
                    part = places[k : k + 64]
                    ids = batch.column(0).take(pa.array([row] * len(part)))
                    hashes = batch.column(1).take(pa.array([row] * len(part)))
                    texts = pa.array([data[a:c] for a, _, c in part], pa.binary()).cast(pa.string())
                    yield pa.RecordBatch.from_arrays([ids, hashes, pa.array(range(k, k + len(part)), pa.int64()), pa.array([b - a for a, b, _ in part], pa.int64()), texts], names=names)

    return long_texts.select("id", "hash", "text").mapInArrow(run, f"id {id_type}, hash long, chunk long, owned long, text string")


def bucket_counts(texts: DataFrame) -> dict[int, int]:
    """Features by bucket of texts(owned, text): one list a task, and at most BUCKETS sums in the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            for _, _, _, buckets in features(batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)):
                counts += np.bincount(buckets, minlength=BUCKETS)
        seen = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(counts[seen])], names=["bucket", "n"])

    found = texts.select("owned", "text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r["bucket"]: r["n"] for r in found.collect()}


def gains(corpus: dict[int, int], target: dict[int, int]) -> np.ndarray:
    """Per bucket floor(1000 ln(((t + 1)(S + B)) / ((s + 1)(T + B)))), in doubles."""
    s, t = (np.array([c.get(b, 0) for b in range(BUCKETS)], np.float64) for c in (corpus, target))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + BUCKETS) / ((s + 1) * (t.sum() + BUCKETS)))).astype(np.int64)


def weighed(texts: DataFrame, gain: np.ndarray, id_type: str) -> DataFrame:
    """texts(id, hash, chunk, owned, text) with n_words, n_features and the sum of gains instead of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, many, sums = (np.zeros(batch.num_rows, np.int64) for _ in range(3))
            for at, own, owner, buckets in features(batch.column(4), batch.column(3).to_numpy(zero_copy_only=False)):
                n = len(own)
                words[at : at + n] = own
                many[at : at + n] = np.bincount(owner, minlength=n)
                # sums of whole numbers below 2^53 are exact in doubles
                sums[at : at + n] = np.bincount(owner, gain[buckets], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(words), pa.array(many), pa.array(sums)], names=["id", "hash", "chunk", "n_words", "n_features", "gain"])

    return texts.select("id", "hash", "chunk", "owned", "text").mapInArrow(run, f"id {id_type}, hash long, chunk long, n_words long, n_features long, gain long")


def _texts(df: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """(short, long): texts that are a chunk by themselves, and those to be cut."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = df.select(F.col(id_col).alias("id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    size = F.octet_length("text").cast("long")
    return rows.where(size <= CHUNK).select("id", "hash", F.lit(0).cast("long").alias("chunk"), size.alias("owned"), "text"), rows.where(size > CHUNK)


def importance(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """Per row of df: id, n_words, n_features, weight."""
    spark = df.sparkSession
    id_type = df.select(id_col).schema[0].dataType.simpleString()
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))

    def both(rows: DataFrame, id_name: str, text_name: str, kind: str) -> tuple[DataFrame, DataFrame, DataFrame]:
        short, long = _texts(rows, id_name, text_name)
        dealt = chunks(long, kind).repartition(n, "hash", "chunk")
        return short, long, dealt

    with small_batches(spark):
        short, long, dealt = both(df, id_col, text_col, id_type)
        path = scratch(spark, "resampling-chunks")
        dealt.write.parquet(path)  # the long texts, cut and dealt once for both passes
        dealt = spark.read.schema(dealt.schema).parquet(path)
        aims = both(target.select(F.lit(0).alias("id"), target_col), "id", target_col, "int")
        gain = gains(bucket_counts(short.unionByName(dealt)), bucket_counts(aims[0].unionByName(aims[2])))
        # a chunk that repeated rows have comes once for the sums
        parts = weighed(dealt, gain, id_type).dropDuplicates(["id", "hash", "chunk"])
        sums = parts.groupBy("id", "hash").agg(*(F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")))
        known = sums.select(F.col("id").alias("sum_id"), F.col("hash").alias("sum_hash"), "n_words", "n_features", "gain")
        keys = long.select("id", "hash")
        joined = keys.join(known, keys["id"].eqNullSafe(known["sum_id"]) & (keys["hash"] == known["sum_hash"])).select("id", "n_words", "n_features", "gain")
        rows = weighed(short, gain, id_type).select("id", "n_words", "n_features", "gain").unionByName(joined)
        path = scratch(spark, "resampling-weights")
        rows.write.parquet(path)
    found = spark.read.schema(rows.schema).parquet(path)
    # floors go down for negative sums too
    mean = F.when(F.col("n_features") > 0, F.expr("(gain - pmod(gain, n_features)) div n_features")).otherwise(F.lit(0))
    return found.select("id", "n_words", "n_features", mean.cast("long").alias("weight"))


def resampled(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """Per row of df: the id column, n_features, weight, score and rank (1 is drawn first; null: not drawn)."""
    spark = df.sparkSession
    found = importance(df, target, id_col, text_col, target_col)
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("id").cast("string"), F.lit("null"))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    scored = found.withColumn("score", (F.col("weight") + noise).cast("long"))
    path = scratch(spark, "resampling-scores")
    scored.write.parquet(path)
    scored = spark.read.schema(scored.schema).parquet(path)
    eligible = F.col("n_words") >= least_words
    drawn = percent * scored.where(eligible).count() // 100
    able = scored.where(eligible).select("id", "n_features", "weight", "score", F.col("id").isNull().alias("no_id"))
    ranked = row_numbers(able, [("score", "desc"), ("no_id", "asc"), ("id", "asc")], "rank")
    rank = F.when(F.col("rank") <= drawn, F.col("rank"))
    rest = scored.where(~eligible).select("id", "n_features", "weight", "score", F.lit(None).cast("long").alias("rank"))
    both = ranked.select("id", "n_features", "weight", "score", rank.alias("rank")).unionByName(rest)
    return both.select(F.col("id").alias(id_col), "n_features", "weight", "score", "rank")
