"""Mixing sources to target weights by multinomial draws of fixed-length blocks.

The words of a source's documents, laid end to end in a fixed order, are packed
into blocks of ``block_words`` words; a last shorter block may follow. A source's
target is a number of words, and so a number of slots, one a block. Output shards
of ``shard_slots`` slots draw their slots' sources from the target shares by a
hash of the slot's index, which gives each shard multinomial counts. As the draws'
totals wander about the targets, slots that a source drew beyond its own are
handed, in order, to the sources that drew too few, so that totals are met to the
word. A source's r-th slot reads block p(r) of an epoch, where p is a pseudorandom
permutation of the block indexes (a Feistel network that walks until it is within
range; the short block stays last), and slots meet blocks by an equi-join on
source and index. A source's target is at most twice its size, which is two
epochs, so that no document is used more than twice.

Where each document stands in its source is a prefix sum in two steps: hash
buckets of bounded size, whose totals are summed over buckets, then sums within a
bucket. A hot source is thereby spread over all buckets. All steps are DataFrame
operations and every choice is a hash of indexes, so that reruns agree.

Defined results: a very long text spans blocks like any other; a null text has size 0; null sources are one source, the last in
order; documents without words, and sources without words, take 0; rows with the
same doc_id are rows of their own; an empty table gives no rows. The table of sources is
broadcast up to ``broadcast_sources`` rows, and joined like any other beyond that.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import SPACE_CHARS, WORD, blocks_for, checkpoint, n_words

WEIGHTS = (3, 1, 2)
SPACE = r"\x20\x09-\x0D"
#: Slots that a task plans, more where that would make over MOST_PARTS tasks; cells that the range of draws is cut into, more where there are more sources.
PLAN_SLOTS, MOST_PARTS, LEAST_CELLS = 16_384, 100_000, 4096


def with_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sources(source, source_size) with ``rank`` and ``target``.

    The targets are the water level over the caps: with sources in order of cap by
    weight, a source is capped exactly if its cap is at or below its share of what
    the capped ones before it leave.
    """
    one = Window.partitionBy(F.lit(0))
    before = one.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.col("rank") % len(weights)) + 1).cast("int"))
    ranked = (
        sources.withColumn("rank", (F.row_number().over(one.orderBy(F.asc_nulls_last("source"))) - 1).cast("long"))
        .withColumn("weight", weight.cast("double"))
        .withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("total", F.sum("source_size").over(one) * F.lit(float(share)))
        .withColumn("left", F.col("total") - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weight_left", F.sum("weight").over(one) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("capped", F.col("cap") * F.col("weight_left") <= F.col("left") * F.col("weight"))
    )
    level = F.min(F.when(~F.col("capped"), F.struct(F.col("cap") / F.col("weight"), "rank", (F.col("left") / F.col("weight_left")).alias("level")))).over(one)["level"]
    return ranked.withColumn("target", F.when(F.col("capped"), F.col("cap")).otherwise(level * F.col("weight"))).select("source", "source_size", "rank", "target")


def permuted(index: Column, n: Column, key: Column, rounds: int = 3, walks: int = 6) -> Column:
    """A pseudorandom permutation of 0..n-1: a Feistel network over pairs below a and b, the least square or so that holds n, walked until within range."""
    a = F.greatest(F.ceil(F.sqrt(n)), F.lit(1)).cast("long")
    b = F.greatest(F.ceil(n / a), F.lit(1)).cast("long")

    def network(x: Column) -> Column:
        def swap(state: Column, round_: Column) -> Column:
            left = F.pmod(state["l"] + F.pmod(F.xxhash64(state["r"], round_, key), a), a)
            return F.struct(left.alias("l"), F.pmod(state["r"] + F.pmod(F.xxhash64(left, round_, key, F.lit(1)), b), b).alias("r"))

        begin = F.struct(F.floor(x / b).alias("l"), F.pmod(x, b).alias("r"))
        end = F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), begin, swap)
        return end["l"] * b + end["r"]

    def walk(x: Column, steps: int) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), x, lambda x, _: F.when(x < n, x).otherwise(network(x)))

    # the pairs beyond n are fewer than a, and at most a third: a long walk is needed once in some thousand times and stays outside once in 10^30
    return F.transform(F.array(walk(network(index), walks)), lambda x: F.when(x < n, x).otherwise(walk(x, 64)))[0]


def positions(df: DataFrame, id_col: str, text_col: str, source_col: str, bucket_rows: int) -> DataFrame:
    """id, source, size, bucket, place (in its bucket and source) and start (of its words in the source)."""
    sized = df.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), n_words(F.col(text_col).cast("string")).alias("size"))
    sized = checkpoint(sized)
    buckets = blocks_for(sized.count(), bucket_rows)
    sized = sized.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(buckets)))
    sums = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    ahead = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(F.col("source").alias("s"), F.col("bucket").alias("b"), F.coalesce(F.sum("words").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy("source", "bucket").orderBy("id", "size")
    placed = sized.withColumns({"place": F.row_number().over(within), "inside": F.coalesce(F.sum("size").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))})
    same = placed["source"].eqNullSafe(sums["s"]) & (placed["bucket"] == sums["b"])
    return placed.join(sums, same).select("id", "source", "size", "bucket", "place", (F.col("ahead") + F.col("inside")).alias("start"))


def with_slots(sources: DataFrame, block_words: int) -> DataFrame:
    """sources with the words to take, blocks and full blocks of an epoch, and slots."""
    words = F.floor(F.col("target") + 0.5)
    full = F.floor(F.col("source_size") / block_words)
    per_epoch = F.ceil(F.col("source_size") / block_words)
    epochs = F.when(F.col("source_size") > 0, F.floor(words / F.col("source_size"))).otherwise(F.lit(0))
    rest = words - epochs * F.col("source_size")
    return sources.select("source", "source_size", "target", "rank", words.alias("words"), full.alias("full"), per_epoch.alias("blocks"), (epochs * per_epoch + F.ceil(rest / block_words)).alias("slots"))


def slot_plan(sources: DataFrame, block_words: int, shard_slots: int, seed: int, small: bool = True) -> DataFrame:
    """shard, slot, rank (of the source), epoch, block, words (from the block's start). small: the table of sources may be broadcast."""
    spark = sources.sparkSession
    held = F.broadcast if small else (lambda df: df)
    known = sources.select("rank", F.col("source_size").alias("size"), "words", "blocks", "full", "slots")
    slots = known.agg(F.sum("slots")).first()[0]
    if not slots:
        return spark.sql("SELECT 0L shard, 0L slot, 0L rank, 0L epoch, 0L block, 0L words WHERE false")
    # a draw is one of all slots; a source's slots are a range of draws, cut into cells for an equi-join
    parts = blocks_for(slots, max(PLAN_SLOTS, slots // MOST_PARTS))
    earlier = Window.partitionBy(F.lit(0)).orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    width = blocks_for(slots, max(LEAST_CELLS, known.count()))
    ranges = known.where("slots > 0").select("rank", "slots", F.coalesce(F.sum("slots").over(earlier), F.lit(0)).alias("low")).withColumn("high", F.col("low") + F.col("slots"))
    cells = ranges.select("rank", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / width), F.floor((F.col("high") - 1) / width))).alias("cell"))
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col("id")), F.lit(slots))
    drawn = spark.range(0, slots, 1, parts).select(F.col("id").alias("slot"), F.floor(F.col("id") / shard_slots).alias("shard"), draw.alias("draw")).withColumn("cell", F.floor(F.col("draw") / width))
    drawn = drawn.join(held(cells), "cell").where((F.col("draw") >= F.col("low")) & (F.col("draw") < F.col("high"))).select("slot", "shard", "rank")
    counts = drawn.groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("n"))
    ahead = Window.partitionBy("rank").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("ahead", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    numbered = drawn.withColumn("inside", F.row_number().over(Window.partitionBy("shard", "rank").orderBy("slot")) - 1)
    numbered = numbered.join(counts.select("rank", "shard", "ahead"), ["rank", "shard"]).withColumn("r", F.col("ahead") + F.col("inside"))
    # what a source drew beyond its slots goes, in order, to those that drew too few; one row a source
    totals = known.join(counts.groupBy("rank").agg(F.sum("n").alias("n")), "rank", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    totals = totals.withColumns({"over": F.greatest(F.col("n") - F.col("slots"), F.lit(0)), "under": F.greatest(F.col("slots") - F.col("n"), F.lit(0))})
    totals = totals.withColumns({"over_ahead": F.coalesce(F.sum("over").over(earlier), F.lit(0)), "under_ahead": F.coalesce(F.sum("under").over(earlier), F.lit(0))})
    numbered = numbered.join(held(totals.select("rank", "slots", "over_ahead")), "rank")
    own = numbered.where(F.col("r") < F.col("slots")).select("slot", "shard", "rank", "r")
    beyond = numbered.where(F.col("r") >= F.col("slots")).select("slot", "shard", (F.col("over_ahead") + F.col("r") - F.col("slots")).alias("e"))
    takers = totals.where("under > 0").select("rank", "n", "under_ahead", F.explode(F.sequence(F.col("under_ahead"), F.col("under_ahead") + F.col("under") - 1)).alias("e"))
    handed = beyond.join(takers, "e").select("slot", "shard", "rank", (F.col("n") + F.col("e") - F.col("under_ahead")).alias("r"))
    # rows are a few numbers that each cost a walk: adaptive execution, which goes by bytes, would leave them to few tasks
    placed = own.unionByName(handed).repartition(parts, "slot").join(held(known), "rank")
    epoch, index = F.floor(F.col("r") / F.col("blocks")), F.col("r") % F.col("blocks")
    block = F.when(index < F.col("full"), permuted(index, F.col("full"), F.xxhash64(F.lit(seed), F.col("rank"), epoch))).otherwise(index)
    done = epoch * F.col("size") + index * F.lit(block_words)
    words = F.least(F.when(index < F.col("full"), F.lit(block_words)).otherwise(F.col("size") % F.lit(block_words)), F.col("words") - done)
    return placed.select("shard", "slot", "rank", epoch.alias("epoch"), block.alias("block"), words.cast("long").alias("words"))


class Mixture:
    """A mix of one table: ``documents`` (a row each, with its size and its source's size and target) and ``segments`` (what each slot reads)."""

    def __init__(self, df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = WEIGHTS, share: float = 1.5, most: float = 2.0, block_words: int = 512, shard_slots: int = 4096, bucket_rows: int = 4096, seed: int = 7, broadcast_sources: int = 10_000):
        placed = checkpoint(positions(df, id_col, text_col, source_col, bucket_rows))
        sizes = placed.groupBy("source").agg(F.sum("size").alias("source_size"))
        sources = checkpoint(with_slots(with_targets(sizes, weights, share, most), block_words))
        small = sources.count() <= broadcast_sources
        self.id_col = id_col
        known = sources.select(F.col("source").alias("s"), "source_size", "rank", "target")
        self.documents = placed.join(F.broadcast(known) if small else known, placed["source"].eqNullSafe(known["s"])).drop("s")
        self.slots = slot_plan(sources, block_words, shard_slots, seed, small)
        ends = F.floor((F.col("start") + F.col("size") - 1) / block_words)
        spread = self.documents.where("size > 0").select("rank", "id", "bucket", "place", "start", "size", F.explode(F.sequence(F.floor(F.col("start") / block_words), ends)).alias("block"))
        low = F.greatest(F.col("start"), F.col("block") * block_words)
        high = F.least(F.col("start") + F.col("size"), F.col("block") * block_words + F.col("words"))
        self.segments = (
            spread.join(self.slots, ["rank", "block"])
            .where(high > low)
            .select("shard", "slot", "rank", "epoch", "block", "id", "bucket", "place", (low - F.col("start")).alias("word_from"), (high - low).alias("n_words"))
        )

    def taken(self) -> DataFrame:
        """Per document: id, source, size, source_size, target, taken."""
        none = F.lit(0).cast("long")
        key = ["rank", "bucket", "place"]
        rows = self.documents.select(*key, "id", "source", "size", "source_size", "target", none.alias("n"))
        used = self.segments.select(*key, *(F.lit(None).alias(c) for c in ("id", "source", "size", "source_size", "target")), F.col("n_words").alias("n"))
        both = rows.unionByName(used).groupBy(*key).agg(*(F.first(c, ignorenulls=True).alias(c) for c in ("id", "source", "size", "source_size", "target")), F.sum("n").alias("taken"))
        return both.select(F.col("id").alias(self.id_col), "source", "size", "source_size", "target", F.col("taken").cast("long").alias("taken"))


def mix(df: DataFrame, **options) -> DataFrame:
    """Per document: the id column, source, size, source_size, target, taken."""
    return Mixture(df, **options).taken()


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The documents of the mix with their own columns: each as often as the words taken from it make up its size, rounded (0, 1 or 2 times).

    Rows of one id are told apart by their sizes; those of one id and size all stay as often as the one that the mix takes most of.
    """
    mixed = mix(df, id_col=id_col, text_col=text_col, **options).select(F.col(id_col).alias("__id"), F.col("size").alias("__size"), F.floor(F.try_divide("taken", "size") + 0.5).cast("int").alias("__copies"))
    copies = mixed.where("__copies > 0").groupBy("__id", "__size").agg(F.max("__copies").alias("__copies"))
    same = df[id_col].eqNullSafe(copies["__id"]) & (n_words(df[text_col].cast("string")) == copies["__size"])
    joined = df.join(copies, same).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
    return joined.select(*(df[c] for c in df.columns))


def mixed_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """What the mix's slots take, with the documents' own columns: a row for each stretch of a document that an epoch takes without a gap, whose text is that stretch.

    Words and the white space between them are the document's; a document that is taken
    whole keeps its text as it is. The words of a source add up to its target.
    """
    mixed = Mixture(df, id_col=id_col, text_col=text_col, **options)
    key = ["rank", "bucket", "place"]
    in_epoch = Window.partitionBy(*key, "epoch").orderBy("word_from")
    gap = F.col("word_from") != F.lag(F.col("word_from") + F.col("n_words"), 1, -1).over(in_epoch)
    runs = mixed.segments.select(*key, "epoch", "word_from", "n_words", gap.cast("int").alias("gap"))
    runs = runs.withColumn("run", F.sum("gap").over(in_epoch)).groupBy(*key, "epoch", "run").agg(F.min("word_from").alias("word_from"), F.sum("n_words").alias("n_words"))
    runs = runs.groupBy(*key).agg(F.collect_list(F.struct("epoch", "word_from", "n_words")).alias("__runs"))
    # rows of equal id and size are told apart by their order: which of them stands where changes nothing of the sums
    nth = F.row_number().over(Window.partitionBy("id", "size").orderBy("source", "bucket", "place"))
    taken = mixed.documents.withColumn("__nth", nth).join(runs, key).select(F.col("id").alias("__id"), F.col("size").alias("__size"), "__nth", "__runs", F.col("source").alias("__source"))
    size = n_words(F.col(text_col).cast("string"))
    source = F.col(options.get("source_col", "source"))
    numbered = df.withColumn("__n", size).withColumn("__k", F.row_number().over(Window.partitionBy(id_col, "__n").orderBy(source, text_col)))
    joined = numbered.join(taken, numbered[id_col].eqNullSafe(taken["__id"]) & (F.col("__n") == F.col("__size")) & (F.col("__k") == F.col("__nth")))
    words = F.array(F.regexp_extract_all(F.col(text_col).cast("string"), F.lit(f"{WORD}[{SPACE}]*"), F.lit(0)))
    # the words are bound to a variable, so that a long document is split once
    cut = F.flatten(F.transform(words, lambda w: F.transform("__runs", lambda r: F.when(r["n_words"] == F.col("__n"), F.col(text_col).cast("string")).otherwise(F.rtrim(F.array_join(F.slice(w, (r["word_from"] + 1).cast("int"), r["n_words"].cast("int")), ""), F.lit(SPACE_CHARS))))))
    return joined.withColumn("__piece", F.explode(cut)).select(*(F.col("__piece").alias(c) if c == text_col else numbered[c] for c in df.columns))
