"""N-gram Jaccard self-join with adaptive multi-match prefixes.

Two texts link when the Jaccard similarity of their 5-word shingle sets is at least
``PERCENT`` percent. Shingles have one global order: by estimated frequency, then by
hash. Of a set of n, at least t = ceil(n * PERCENT / 100) are shared with any
partner, so that the first n - t + l in that order hold at least l of them, for
every l up to t. Each document picks its own l: a longer prefix has more candidates
to count, but a candidate must then share l of its shingles before it is verified.
The cost is estimated from the frequencies, taking (sum of frequencies) / l as the
number of candidates with l matches, which bounds it from above. A pair is a
candidate if it shares as many prefix shingles as the smaller l of the two.

Frequencies are excesses over a task's mean in a table of ``BUCKETS`` counters; a
task hands on the buckets that stand out alone, and of their sums the ``HEAVY``
largest are kept. That table's size is fixed; it orders the prefixes and no result
depends on how good it is.

Linking a group of n near copies needs no n^2 pairs. Exact copies (equal sets) are
one class. Then, per prefix shingle, every document is paired with the least one
that has it (a star), and the stars' likely pairs are verified and joined to
components. What is left are the shingles whose documents lie in more than one
component. There each document tries, in rounds, the closest by their sketches of a
few chance partners from other components, which joins nearly all that links with
many; a round has some pairs a document, whatever the group's size. Then all pairs of
documents that still are in different components are counted, and
verified if they share enough. Both happen between blocks of documents, where a document
comes once to each block that it has shared shingles, or pairs, with: no row is made for a shingle of a pair,
and no text or set moves with each pair. Pairs that are just not similar are all decided, as they must be.
A pair that is never formed is one whose
ends are in one component already, so that the components are exact. A very long text is a block by itself.

Enough is more than the smaller l: beyond their prefixes, two sets can share no more
than the longer of their rests, so that of the overlap that the threshold asks for,
what exceeds that rest must be shared in the prefixes. And sketches, the parities of a
set's shingles by hash, bound the overlap from above, as each bit in which two sketches
differ is a shingle that one of the sets has alone. Frequent shingles are salted in the stars, so that no
task holds more than a bounded part of a posting list.

Texts are moved for verification only, and only those that a fixed-size bitmap of
the candidates lets through, or, up to PAIR_ROWS candidates, these themselves.

Tables of few rows (ids and sketches of up to PAIR_ROWS documents, up to POSTING_ROWS
postings) are one partition, grouped without a shuffle and joined without a broadcast (some
joins still shuffle them): each shuffle or broadcast costs the driver a thread for a minute, a plan and a job, which are more than such rows are worth.

Defined results: null and empty texts have an empty set and link with nothing, and
so do rows with a null doc_id; repeated rows are one document for the links and a
row each in the result; rows with one doc_id and different texts are documents of
their own, as are rows whose ids are no integers, and are told apart by a 64-bit hash; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import blocks_for, checkpoint, drop_shuffles, scratch, small_batches
from tessera.llm.components import as_one, checkpoint_parts, components
from tessera.llm.shingles import sets, shared
from tessera.operators.ranks import prefix_sums

PERCENT = 75
MOST_MATCHES = 4
#: Cost of verifying a candidate, in counted matches.
VERIFY_COST = 50.0
BUCKET_BITS, HEAVY = 18, 65_536
BUCKETS = 1 << BUCKET_BITS
SALT_ROWS = 20_000
#: Stars with this share of the shingles that a similar pair must share are verified.
STAR_SHARE = 0.4
BITMAP_BITS = 1 << 22
SKETCH_BITS = 512
#: Rounds of chance partners, each by several random orders, go on, up to ROUNDS, while this share of the tries are links; the exact rest follows in any case.
ROUNDS, ORDERS, LEAST_YIELD = 4, 2, 0.1
#: Documents of a shingle that a round's task orders together, about: it bounds the memory of a frequent shingle.
DEALT_ROWS = 1_000
#: Pairs are kept in partitions of about this many documents' own, so that few files are written.
PAIR_ROWS = 20_000
#: Postings up to which one partition holds them.
POSTING_ROWS = 200_000
#: Shingles and documents of a block, of which two meet in a task.
BLOCK_SHINGLES, BLOCK_ROWS = 500_000, 512
#: Documents of a shingle up to which pairs are formed for it.
FEW_ROWS = 16


def written(df: DataFrame, label: str) -> DataFrame:
    """A table in the shared folder, which cuts the lineage in less space than a checkpoint."""
    path = scratch(df.sparkSession, label)
    with small_batches(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _together(table: DataFrame, most_rows: int) -> DataFrame:
    """A table that ``written`` has returned, as one partition if it has so many rows at most."""
    return as_one(table) if table.count() <= most_rows else table


def discard(table: DataFrame) -> None:
    """Remove the files of a table that ``written`` has returned and that nothing reads any more."""
    context = table.sparkSession.sparkContext
    for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
        path = context._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def parities(own: np.ndarray) -> np.ndarray:
    """The parity of the set's shingles in each of SKETCH_BITS cells, 64 to an integer."""
    odd = np.bincount((own & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def outline(texts: DataFrame) -> DataFrame:
    """id, n, key (digest of the set), sketch (parities); and rows of frequent buckets: bucket and its excess (as n)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.int64)
        names = ["id", "n", "key", "sketch", "bucket"]
        for batch in batches:
            n, keys, sketches = [], [], []
            for own in sets(batch.column(1)):
                n.append(len(own))
                keys.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest())
                sketches.append(parities(own))
                np.add.at(counts, bucket(own), 1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(keys, pa.binary()), pa.array(sketches, pa.list_(pa.int64())), pa.nulls(len(n), pa.int64())], names=names)
        mean = counts.mean()
        high = np.flatnonzero(counts > mean + 6 * np.sqrt(mean) + 2)
        if len(high):
            yield pa.RecordBatch.from_arrays([pa.nulls(len(high), texts_id), pa.array((counts[high] - mean).astype(np.int64)), pa.nulls(len(high), pa.binary()), pa.nulls(len(high), pa.list_(pa.int64())), pa.array(high)], names=names)

    kind = texts.schema["id"].dataType
    texts_id = pa.int64() if isinstance(kind, T.LongType) else pa.int32()
    return texts.mapInArrow(run, f"id {kind.simpleString()}, n long, key binary, sketch array<bigint>, bucket long")


def prefix(own: np.ndarray, weight: np.ndarray, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray, int]:
    """A set's prefix in the global order, its estimated frequencies, and the matches that it asks for."""
    n = len(own)
    least = -(-n * percent // 100)
    most = min(MOST_MATCHES, least)
    frequency = weight[bucket(own)]
    if not frequency.any():
        return own[: n - least + 1], frequency[: n - least + 1], 1
    order = np.argsort(frequency, kind="stable")[: n - least + most]
    frequency = frequency[order]
    sums = np.cumsum(frequency)[n - least :]
    matches = np.arange(1, most + 1)
    best = int(np.argmin(sums + VERIFY_COST * sums / matches)) + 1
    return own[order][: n - least + best], frequency[: n - least + best], best


def postings(texts: DataFrame, heavy: dict[int, int], percent: int) -> DataFrame:
    """A row for each prefix shingle: id, n, matches, token, salt (-1: the token has one group)."""
    places, excess = np.array(list(heavy), np.int64), np.array(list(heavy.values()), np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weight = np.zeros(BUCKETS, np.float32)
        weight[places] = excess
        for batch in batches:
            ids, found, salts, n, matches = [], [], [], [], []

            def flush() -> pa.RecordBatch:
                lengths = list(map(len, found))
                at = np.repeat(np.arange(len(ids)), lengths)
                arrays = [pa.array(ids, batch.column(0).type).take(pa.array(at)), pa.array(np.array(n)[at]), pa.array(np.array(matches, np.int32)[at]), pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(salts))]
                return pa.RecordBatch.from_arrays(arrays, names=["id", "n", "matches", "token", "salt"])

            held = 0
            for id_, own in zip(batch.column(0).to_pylist(), sets(batch.column(1))):
                if id_ is None or not len(own):
                    continue
                tokens, frequency, least = prefix(own, weight, percent)
                groups = (frequency // SALT_ROWS).astype(np.int64) + 1
                ids.append(id_)
                n.append(len(own))
                matches.append(least)
                found.append(tokens)
                salts.append(np.where(groups > 1, hash(id_) % groups, -1).astype(np.int32))
                held += len(tokens)
                if held > 200_000:
                    yield flush()
                    ids, found, salts, n, matches = [], [], [], [], []
                    held = 0
            if found:
                yield flush()

    return texts.mapInArrow(run, f"id {texts.schema['id'].dataType.simpleString()}, n long, matches int, token long, salt int")


def similar_size(n: Column, m: Column, percent: int) -> Column:
    return F.least(n, m) * 100 >= F.greatest(n, m) * percent


def asked(n: Column, matches: Column, m: Column, other: Column, percent: int) -> Column:
    """How many prefix shingles a similar pair shares at least: sets of n and m, with their own demands."""
    overlap = F.ceil((n + m) * percent / (100 + percent))
    rest = F.greatest(F.ceil(n * percent / 100) - matches, F.ceil(m * percent / 100) - other)
    return F.greatest(F.least(matches, other), overlap - rest)


def overlap_allows(n: Column, m: Column, apart: Column, percent: int) -> Column:
    """Whether sets of n and m whose sketches differ in so many bits can be similar."""
    return (100 + percent) * F.floor((n + m - apart) / 2) >= percent * (n + m)


def through_bitmap(df: DataFrame, ids: DataFrame, bits: int = BITMAP_BITS) -> DataFrame:
    """The rows of df whose id may be among ids, by a bitmap of so many bits: rows of 4 KB, of a fixed number."""
    place = F.pmod(F.xxhash64("id"), F.lit(bits)) + 1
    maps = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bits"))
    byte = F.conv(F.hex(F.substring(F.col("bits"), (F.bitmap_bit_position("p") / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    found = df.withColumn("p", place).join(F.broadcast(maps), F.bitmap_bucket_number("p") == F.col("part"))
    return found.where(byte.bitwiseAND(F.pow(F.lit(2), F.bitmap_bit_position("p") % 8).cast("int")) != 0).select(*df.columns)


def _with_texts(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs (a, b) with their texts, one and two. Up to PAIR_ROWS pairs go to the texts, which then move once for a pair, in one shuffle; more are joined to them."""
    if pairs.count() <= PAIR_ROWS:
        ends = pairs.select("a", "b", F.explode(F.array("a", "b")).alias("id"))
        side = lambda name: F.first(F.when(F.col("id") == F.col(name), F.col("text")), ignorenulls=True)
        both = texts.join(F.broadcast(ends), "id").groupBy("b", "a").agg(side("a").alias("one"), side("b").alias("two"))
        return both.where("one IS NOT NULL AND two IS NOT NULL").select("a", "b", "one", "two")
    ids = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id")))
    few = through_bitmap(texts, ids)
    one = pairs.join(few.select(F.col("id").alias("a"), F.col("text").alias("one")), "a")
    return one.join(few.select(F.col("id").alias("b"), F.col("text").alias("two")), "b").select("a", "b", "one", "two")


def verified(pairs: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b), a checkpoint, those whose texts are similar."""
    both = _with_texts(pairs, texts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, known = None, None
        for batch in batches:
            step = 256
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                keep = []
                seconds = part.column(1).to_pylist()
                for i, first in enumerate(sets(part.column(2))):
                    if seconds[i] != last:
                        last, known = seconds[i], next(iter(sets(part.column(3).slice(i, 1))))
                    common = shared(first, known)
                    keep.append(common > 0 and 100 * common >= percent * (len(first) + len(known) - common))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    kind = texts.schema["id"].dataType.simpleString()
    return both.mapInArrow(run, f"a {kind}, b {kind}").distinct()


def similarity_join(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT, all_links: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, links).

    members has a row for each row of df: id, n (size of its set), class_id (least id
    with the same set; null for an empty one or a null id) and component_id. links(a, b)
    are verified pairs of classes whose components are those of all pairs; with
    ``all_links`` they are all similar pairs of classes, a < b, whose number (and the
    work) grows with the square of a group of different near copies.
    """
    members, links, _ = _judged_rows(df, id_col, text_col, percent, all_links)
    return members.select("id", "n", "class_id", "component_id"), links


def _row(id_: Column, text: Column) -> Column:
    """What stands for a row where ids do not: a hash of id and text; null for a null id."""
    return F.when(id_.isNotNull(), F.xxhash64(id_, text.cast("string")))


def _judged_rows(df: DataFrame, id_col: str, text_col: str, percent: int, all_links: bool = False) -> tuple[DataFrame, DataFrame, bool]:
    """similarity_join's result, whose members also have ``row`` and ``stays`` (is the one that stays of its component), and whether rows are hashes.

    Links join ids; where these are no integers, or stand for several sets, rows by _row instead.
    """
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    if isinstance(texts.schema["id"].dataType, (T.LongType, T.IntegerType)):
        seen = written(outline(texts), "outline")
        several = seen.where("id IS NOT NULL").groupBy("id").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
        if several.isEmpty():
            members, links = _joined(texts, seen, percent, all_links)
            return members.select("*", F.col("id").alias("row"), F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("stays")), links, False
    hashed = texts.select("id", "text", _row(F.col("id"), F.col("text")).alias("row"))
    texts = hashed.select(F.col("row").alias("id"), "text")
    members, links = _joined(texts, written(outline(texts), "outline"), percent, all_links)
    known = hashed.where("row IS NOT NULL").groupBy("row").agg(F.min("id").alias("own"))
    named = members.select(F.col("id").alias("row"), "n", F.col("class_id").alias("class_row"), F.col("component_id").alias("root")).join(known, "row", "left")
    first = named.where("root IS NOT NULL").groupBy("root").agg(F.min(F.struct("own", "row")).alias("first"))
    same = named.where("class_row IS NOT NULL").groupBy("class_row").agg(F.min("own").alias("class_id"))
    named = named.join(first, "root", "left").join(same, "class_row", "left")
    named = named.select(F.col("own").alias("id"), "n", "class_id", F.col("first.own").alias("component_id"), "row", F.coalesce(F.col("first.row") == F.col("row"), F.lit(True)).alias("stays"))
    for side in "ab":
        links = links.join(known.select(F.col("row").alias(side), F.col("own").alias(f"own_{side}")), side)
    return named, links.select(F.least("own_a", "own_b").alias("a"), F.greatest("own_a", "own_b").alias("b")), True


def _joined(texts: DataFrame, seen: DataFrame, percent: int, all_links: bool) -> tuple[DataFrame, DataFrame]:
    """similarity_join of texts(id, text), whose ids are integers that stand for one set each, and their outline."""
    documents = seen.where("bucket IS NULL").select("id", "n", "key", "sketch")
    heavy = {r["bucket"]: r["n"] for r in seen.where("bucket IS NOT NULL").groupBy("bucket").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "bucket").limit(HEAVY).collect()}
    classes = documents.where("id IS NOT NULL AND n > 0").groupBy("key", "n").agg(F.min("id").alias("class_id"))
    members = documents.join(classes, ["key", "n"], "left").select("id", "n", "sketch", F.when(F.col("id").isNotNull(), F.col("class_id")).alias("class_id"))
    members = written(members, "members")
    discard(seen)
    slim = _together(members, PAIR_ROWS)
    class_of = slim.where("class_id <> id").select("id", "class_id").distinct()
    sketches = slim.where("class_id = id").select("id", "n", "sketch")
    few = blocks_for(sketches.count(), PAIR_ROWS)

    if all_links:
        # no pair is left out for what others connect: each that meets often enough and that the sketches allow is verified
        met = written(_shared_tokens(postings(texts, heavy, percent)), "postings")
        whole = sketches.dropDuplicates(["id"]).select("id", "sketch", F.col("id").alias("root"))
        rows = written(met.join(whole, "id").withColumn("few", F.lit(0)), "whole")
        blocks = written(_blocks(rows), "blocks")
        pairs = checkpoint(_met_enough(rows, blocks, percent).where("met >= asked").select("a", "b").distinct())
        links = checkpoint(verified_in_blocks(pairs, texts, blocks, percent))
        return _named(members, components(links)), links

    # stars: each document with the least of its shingle's group, each group's least with the shingle's
    rows = postings(texts, heavy, percent)
    own = Window.partitionBy("token", "salt")
    met = rows.withColumns({"rep": F.min(F.struct("id", "n", "matches")).over(own), "last": F.max("id").over(own)})
    met = written(met.where("salt >= 0 OR last <> rep.id").select("id", "n", "matches", "token", "salt", "rep"), "postings")
    one = met.count() <= POSTING_ROWS
    met = as_one(met) if one else met
    del rows
    drop_shuffles(texts.sparkSession)
    groups = met.where("salt >= 0").groupBy("token", "rep").agg(F.count(F.lit(1)).alias("rows"))
    tops = groups.groupBy("token").agg(F.min("rep").alias("top"))
    upper = groups.join(tops, "token").select("rep.id", "rep.n", "rep.matches", F.col("top").alias("rep"))
    near = met.select("id", "n", "matches", "rep").unionByName(upper).where("id <> rep.id").where(similar_size(F.col("n"), F.col("rep.n"), percent))
    near = as_one(near) if one else near
    stars = near.groupBy("id", "n", "matches", "rep").agg(F.count(F.lit(1)).alias("met"))
    # a star's count leaves out shingles whose least document is another one, and so decides what is worth a try only
    share = F.col("met") / asked(F.col("n"), F.col("matches"), F.col("rep.n"), F.col("rep.matches"), percent)
    stars = _by_class(stars.select(F.col("rep.id").alias("a"), F.col("id").alias("b"), share.alias("share")).where(F.col("share") >= STAR_SHARE), class_of)
    stars = checkpoint_parts(stars.groupBy("a", "b").agg(F.max("share").alias("share")), few)
    # first the best star of each document, then the stars that still lie between components
    best = checkpoint_parts(stars.groupBy("b").agg(F.max_by("a", F.struct("share", -F.col("a"))).alias("a")).select("a", "b"), few)
    links = checkpoint_parts(verified(checkpoint_parts(_plausible(best, sketches, percent), few), texts, percent), few)
    roots = components(links)
    others = stars.join(best, ["a", "b"], "left_anti").select("a", "b")
    others = checkpoint_parts(_plausible(_apart(others, roots).select("a", "b"), sketches, percent), few)
    more = checkpoint_parts(verified(others, texts, percent), few)
    links = links.unionByName(more)
    roots = components(links)
    drop_shuffles(texts.sparkSession)

    # what lies between components: rounds of chance partners, then all pairs that are left
    between = _together(written(_between(met, sketches, roots), "between"), POSTING_ROWS)
    discard(met)
    drop_shuffles(texts.sparkSession)
    for number in range(ROUNDS):
        tries = checkpoint_parts(_partners(between, number, percent), few)
        drop_shuffles(texts.sparkSession)
        found = checkpoint_parts(verified(tries.select("a", "b"), texts, percent), few)
        n_found = found.count()
        links = links.unionByName(found)
        if not n_found:
            break
        roots = checkpoint_parts(_merged(roots, tries.join(found, ["a", "b"], "left_semi")), few)
        if n_found < LEAST_YIELD * tries.count():  # the roots in between stay those of before, which forms a few pairs more
            break
        before, between = between, _together(written(_between(between, sketches, roots), "between"), POSTING_ROWS)
        discard(before)
        drop_shuffles(texts.sparkSession)
    drop_shuffles(texts.sparkSession)
    if between.isEmpty():
        return _named(members, roots), links
    blocks = _together(written(_blocks(between), "blocks"), PAIR_ROWS)
    counted = _plausible(_met_in_all(_met_enough(between.where(F.col("rows") > FEW_ROWS), blocks, percent), _met_rarely(between, percent)), sketches, percent)
    rest = checkpoint(counted.join(stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), ["a", "b"], "left_anti"))
    discard(between)
    drop_shuffles(texts.sparkSession)
    if not rest.isEmpty():
        links = links.unionByName(checkpoint(verified_in_blocks(rest, texts, blocks, percent)))
        roots = components(links)
    return _named(members, roots), links


def link_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """Per class of equal sets that links with another: class_id, n_rows (of the class) and n_links, the number of other classes whose sets are similar; exact."""
    members, links = similarity_join(df, id_col, text_col, percent, all_links=True)
    ends = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count(F.lit(1)).alias("n_links"))
    return members.where("class_id IS NOT NULL").groupBy("class_id").agg(F.count(F.lit(1)).alias("n_rows")).join(ends, "class_id")


def _shared_tokens(rows: DataFrame) -> DataFrame:
    """The postings of shingles that more than one document has in its prefix, with the least of these."""
    several = rows.groupBy("token").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select("token", F.col("low").alias("least"))
    return rows.select("id", "n", "matches", "token").distinct().join(several, "token")


def _between(rows: DataFrame, sketches: DataFrame, roots: DataFrame) -> DataFrame:
    """Of the postings (id, matches, token) those of classes and of shingles whose documents lie in more than one component, with n, sketch, root, into how many parts a round deals the shingle's documents, how many these are, the least of them, and how many of the document's shingles up to FEW_ROWS documents, or more, have."""
    rooted = rows.select("id", "matches", "token").join(sketches.select("id").distinct().join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("root")), "id")
    # a window, as an aggregate that is joined to its own rows would move them twice
    same = Window.partitionBy("token")
    tokens = rooted.withColumns({"low": F.min("root").over(same), "high": F.max("root").over(same), "rows": F.count(F.lit(1)).over(same), "least": F.min("id").over(same)}).where("low < high")
    kept = tokens.select("id", "matches", "token", "root", (F.floor(F.col("rows") / DEALT_ROWS) + 1).alias("parts"), "least", "rows")
    named = kept.join(sketches.select("id", "n", "sketch").dropDuplicates(["id"]), "id")
    own, frequent = Window.partitionBy("id"), F.col("rows") > FEW_ROWS
    named = named.withColumns({"few": F.count_if(~frequent).over(own), "many": F.count_if(frequent).over(own)})
    return named.select("id", "n", "matches", "token", "root", "parts", "sketch", "least", "rows", "few", "many")


def _apart_bits(one: Column, two: Column) -> Column:
    """In how many bits two sketches differ."""
    return sum((F.bit_count(F.get(one, F.lit(k)).bitwiseXOR(F.get(two, F.lit(k)))) for k in range(SKETCH_BITS // 64)), F.lit(0))


def _partners(rows: DataFrame, number: int, percent: int) -> DataFrame:
    """Pairs (a, b) with their roots: for each document and order one at most, with the closest by the sketches of those that stand before it in a random order of a shingle's documents, in another component."""
    part = F.pmod(F.xxhash64(F.lit(number), "id"), F.col("parts"))
    dealt = rows.select("id", "n", "sketch", "root", "token", part.alias("part"))
    known = F.struct("id", "n", "sketch", "root")
    own = Window.partitionBy("token", "part")
    for order in range(ORDERS):
        dealt = dealt.withColumn(f"other{order}", F.lag(known).over(own.orderBy(F.xxhash64(F.lit(number * ORDERS + order), "id"), "id")))

    def best(order: int) -> Column:
        other = F.col(f"other{order}")
        apart = _apart_bits(F.col("sketch"), other["sketch"])
        likely = (other["root"] != F.col("root")) & similar_size(F.col("n"), other["n"], percent) & overlap_allows(F.col("n"), other["n"], apart, percent)
        return F.when(likely, F.struct((-apart / (F.col("n") + other["n"])).alias("close"), other["id"].alias("with"), "root", other["root"].alias("other_root")))

    names = [f"best{order}" for order in range(ORDERS)]
    tried = dealt.select("id", *(best(order).alias(names[order]) for order in range(ORDERS))).where(F.coalesce(*names).isNotNull())
    found = tried.groupBy("id").agg(*(F.max(name).alias(name) for name in names))
    near = found.select("id", F.explode(F.array(*names)).alias("best")).where("best IS NOT NULL")
    ends = near.select(F.least("id", "best.with").alias("a"), F.greatest("id", "best.with").alias("b"), F.least("best.root", "best.other_root").alias("low"), F.greatest("best.root", "best.other_root").alias("high"))
    return ends.distinct()


def _merged(roots: DataFrame, found: DataFrame) -> DataFrame:
    """Components (id, root) after links between them: found(low, high) are the roots that each link joins."""
    joined = components(found.select(F.col("low").alias("a"), F.col("high").alias("b"))).withColumnsRenamed({"id": "r", "root": "top"})
    moved = roots.join(joined, roots["root"] == joined["r"], "left").select("id", F.coalesce("top", "root").alias("root"))
    # components of one document have no row yet
    return moved.unionByName(joined.join(roots, joined["r"] == roots["id"], "left_anti").select(F.col("r").alias("id"), F.col("top").alias("root")))


def _blocks(rows: DataFrame) -> DataFrame:
    """id, n, matches, root, sketch, few and block: documents of a group, told by the least that shares a shingle, lie in neighbouring blocks of BLOCK_SHINGLES shingles and BLOCK_ROWS documents at most, but for longer documents alone."""
    near = rows.groupBy("id").agg(F.min("least").alias("group"), *(F.first(c).alias(c) for c in ("n", "matches", "root", "sketch", "few")))
    weight = F.greatest("n", F.lit(BLOCK_SHINGLES // BLOCK_ROWS))
    placed = prefix_sums(near.withColumns({"sum": weight, "own": weight}), [("group", "asc"), ("id", "asc")], ["sum"])
    return placed.select("id", "n", "matches", "root", "sketch", "few", F.floor((F.col("sum") - F.col("own")) / BLOCK_SHINGLES).alias("block"))


def _met_enough(rows: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b), in different components, that may share as many prefix shingles as is asked for and whose sketches allow the overlap, with how many of rows they share (met) and how many are asked.

    The shingles of rows are counted in blocks: a document comes once to each block that shares some
    with it, with those alone, and a pair of blocks counts its pairs as products of incidence matrices. As many as a document has
    few of, beside rows, a pair may share in addition.
    """
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.select("id", "token", "root", "n").join(blocks.select("id", "block"), "id").repartition(parts, "token")
    there = placed.groupBy("token", "block").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("n").alias("short"), F.max("n").alias("long")).withColumnRenamed("block", "other")
    likely = ((F.col("low") != F.col("root")) | (F.col("high") != F.col("root"))) & (F.col("long") * 100 >= F.col("n") * percent) & (F.col("n") * 100 >= F.col("short") * percent)
    met = placed.join(there, "token").where(likely).select("id", "other", "token")
    sent = met.groupBy("id", "other").agg(F.collect_set("token").alias("tokens")).join(blocks, "id")
    sent = sent.select(F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "block", "id", "n", "matches", "root", "sketch", "few", "tokens")

    def pairs(cell: pa.Table) -> pa.RecordBatch | None:
        block, ids, n, matches, root, few = (cell.column(c).to_numpy() for c in ("block", "id", "n", "matches", "root", "few"))
        lists = cell.column("tokens").combine_chunks()
        tokens = lists.flatten().to_numpy(zero_copy_only=False)
        owner = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
        _, number, count = np.unique(tokens, return_inverse=True, return_counts=True)
        several = count[number] > 1
        number, owner = np.unique(number[several], return_inverse=True)[1], owner[several]
        shared_ = np.zeros((len(ids), len(ids)), np.float32)
        order = np.argsort(number, kind="stable")
        number, owner = number[order], owner[order]
        for low in range(0, int(number[-1]) + 1 if len(number) else 0, 4096):
            begin, end = np.searchsorted(number, [low, low + 4096])
            has = np.zeros((len(ids), 4096), np.float32)
            has[owner[begin:end], number[begin:end] - low] = 1
            shared_ += has @ has.T
        one, two = np.nonzero(np.triu(shared_, 1))
        crossing = block[one] != block[two] if cell.column("x")[0] != cell.column("y")[0] else np.ones(len(one), bool)
        least, most = np.minimum(n[one], n[two]), np.maximum(n[one], n[two])
        good = crossing & (root[one] != root[two]) & (least * 100 >= most * percent)
        one, two = one[good], two[good]
        sizes = n[one] + n[two]
        overlap = -(-(sizes * percent) // (100 + percent))
        rest = np.maximum(-(-(n[one] * percent) // 100) - matches[one], -(-(n[two] * percent) // 100) - matches[two])
        least = np.maximum(np.minimum(matches[one], matches[two]), overlap - rest)
        good = shared_[one, two] + np.minimum(few[one], few[two]) >= least
        one, two, sizes, least = one[good], two[good], sizes[good], least[good]
        bits = np.unpackbits(cell.column("sketch").combine_chunks().flatten().to_numpy(zero_copy_only=False).view(np.uint8).reshape(len(ids), -1), axis=1)
        good = np.zeros(len(one), bool)
        for at in range(0, len(one), 8192):
            part = slice(at, at + 8192)
            apart = np.count_nonzero(bits[one[part]] != bits[two[part]], axis=1)
            good[part] = (100 + percent) * ((sizes[part] - apart) // 2) >= percent * sizes[part]
        a, b = ids[one[good]], ids[two[good]]
        counts = pa.array(shared_[one[good], two[good]].astype(np.int64)), pa.array(least[good].astype(np.int64))
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)).cast(kind), pa.array(np.maximum(a, b)).cast(kind), *counts], names=["a", "b", "met", "asked"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cell in by_cell(batches):
            yield pairs(cell)

    kind = pa.int64() if isinstance(rows.schema["id"].dataType, T.LongType) else pa.int32()
    name = rows.schema["id"].dataType.simpleString()
    return _dealt(sent, "x", "y").mapInArrow(run, f"a {name}, b {name}, met long, asked long")


def _met_rarely(rows: DataFrame, percent: int) -> DataFrame:
    """As _met_enough, without sketches, for pairs that share a shingle of FEW_ROWS documents or fewer: a row for each pair of its documents, which are few for a shingle. As many as a document has many of, a pair may share in addition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    slim = rows.where(F.col("rows") <= FEW_ROWS).select("token", "id", "n", "matches", "root", "many").repartition(parts, "token").dropDuplicates(["token", "id"])
    left, right = (slim.select("token", *(F.col(c).alias(f"{c}_{side}") for c in ("id", "n", "matches", "root", "many"))) for side in "ab")
    n, m = F.col("n_a"), F.col("n_b")
    both = left.join(right, "token").where((F.col("id_a") < F.col("id_b")) & (F.col("root_a") != F.col("root_b")) & similar_size(n, m, percent))
    least = asked(n, F.col("matches_a"), m, F.col("matches_b"), percent)
    counted = both.groupBy(F.col("id_a").alias("a"), F.col("id_b").alias("b")).agg(F.count(F.lit(1)).alias("met"), F.min(least).alias("asked"), F.min(F.least("many_a", "many_b")).alias("more"))
    return counted.where("met + more >= asked").select("a", "b", "met", "asked")


def _met_in_all(frequent: DataFrame, rare: DataFrame) -> DataFrame:
    """Pairs (a, b) whose counts together are enough. One that either list has left out has no more than the other says, or too few in any case."""
    both = frequent.unionByName(rare).groupBy("a", "b").agg(F.sum("met").alias("met"), F.max("asked").alias("asked"))
    return both.where("met >= asked").select("a", "b")


def by_cell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """The rows of each pair of blocks (x, y), of rows that are sorted by these."""
    held: list[pa.RecordBatch] = []
    key = None
    for batch in batches:
        if not batch.num_rows:
            continue
        x, y = (batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in "xy")
        cuts = [0, *(np.flatnonzero((x[1:] != x[:-1]) | (y[1:] != y[:-1])) + 1).tolist(), batch.num_rows]
        for begin, end in zip(cuts, cuts[1:]):
            if held and key != (x[begin], y[begin]):
                yield pa.Table.from_batches(held)
                held = []
            key = (x[begin], y[begin])
            held.append(batch.slice(begin, end - begin))
    if held:
        yield pa.Table.from_batches(held)


def _dealt(df: DataFrame, *names: str) -> DataFrame:
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(n, "x", "y").sortWithinPartitions(*names)


def cells(pairs: DataFrame, blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): the pairs of blocks (x, y) with the documents that their pairs name, each once, and the pairs."""
    placed = pairs.join(blocks.select(F.col("id").alias("a"), F.col("block").alias("block_a")), "a").join(blocks.select(F.col("id").alias("b"), F.col("block").alias("block_b")), "b")
    placed = placed.select(F.least("block_a", "block_b").alias("x"), F.greatest("block_a", "block_b").alias("y"), "a", "b")
    return placed.select("x", "y", F.explode(F.array("a", "b")).alias("id")).distinct(), placed


def verified_in_blocks(pairs: DataFrame, texts: DataFrame, blocks: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) those whose texts are similar: a document's text moves once to each pair of blocks that has pairs with it, however many, and is hashed there."""
    members, placed = cells(pairs, blocks)
    members = written(members, "members-of-blocks")
    ids = members.select("id").distinct()
    known = through_bitmap(texts, ids).join(ids, "id", "left_semi").groupBy("id").agg(F.first("text").alias("text"))
    none = F.lit(None).cast(texts.schema["id"].dataType)
    rows = members.join(known, "id").select("x", "y", F.lit(0).alias("kind"), F.col("id").alias("a"), none.alias("b"), "text").unionByName(placed.select("x", "y", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("string").alias("text")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}
        for batch in batches:
            keep = []
            x, y, kinds, one, two = (batch.column(k).to_pylist() for k in range(5))
            for i, kind in enumerate(kinds):
                if key != (x[i], y[i]):
                    key, held = (x[i], y[i]), {}
                if kind == 0:
                    held[one[i]] = next(iter(sets(batch.column(5).slice(i, 1))))
                    keep.append(False)
                else:
                    first, second = held[one[i]], held[two[i]]
                    common = shared(first, second)
                    keep.append(common > 0 and 100 * common >= percent * (len(first) + len(second) - common))
            yield pa.RecordBatch.from_arrays([batch.column(3), batch.column(4)], names=["a", "b"]).filter(pa.array(keep, pa.bool_()))

    name = texts.schema["id"].dataType.simpleString()
    return _dealt(rows, "x", "y", "kind").mapInArrow(run, f"a {name}, b {name}").distinct()


def _named(members: DataFrame, roots: DataFrame) -> DataFrame:
    named = members.join(roots.withColumnRenamed("id", "class_id"), "class_id", "left")
    return named.select("id", "n", "class_id", F.coalesce("root", "class_id", "id").alias("component_id"))


def _by_class(pairs: DataFrame, class_of: DataFrame) -> DataFrame:
    """Pairs between documents as pairs between their classes."""
    for side in "ab":
        known = class_of.select(F.col("id").alias(side), "class_id")
        pairs = pairs.join(known, side, "left").withColumn(side, F.coalesce("class_id", side)).drop("class_id")
    return pairs.where("a <> b")


def _plausible(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """The pairs whose sketches allow the overlap that is asked for."""
    for side in "ab":
        pairs = pairs.join(sketches.select(F.col("id").alias(side), F.col("n").alias(f"n_{side}"), F.col("sketch").alias(f"sketch_{side}")), side)
    apart = F.aggregate(F.zip_with("sketch_a", "sketch_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    return pairs.where(overlap_allows(F.col("n_a"), F.col("n_b"), apart, percent)).select("a", "b")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """The pairs whose ends are not in one component."""
    for side in "ab":
        pairs = pairs.join(roots.select(F.col("id").alias(side), F.col("root").alias(f"root_{side}")), side, "left")
    return pairs.where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT) -> DataFrame:
    """The rows with the least id of each component, and those that link with nothing, with their own columns."""
    members, _, hashed = _judged_rows(df, id_col, text_col, percent)
    dropped = members.where("NOT stays").select(F.col("id").alias("__dropped"), F.col("row").alias("__row")).distinct()
    same = df[id_col] == dropped["__dropped"]
    if hashed:
        same = same & (_row(df[id_col], df[text_col]) == dropped["__row"])
    return df.join(dropped, same, "left_anti")
