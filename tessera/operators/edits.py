"""Pairs of strings within one or two edits, by signatures that lose no pair.

Two strings within two edits differ by s substitutions, d characters that only the one
has and n that only the other has, s + d + n <= 2. Deleting s + d characters of the one and s + n
of the other leaves the same rest. So each string's signatures are what deletions
leave: with none, one or two characters gone. Two deletions on both sides mean two
substitutions, which leave the places the same: such signatures hold the places, and
meet each other alone. All others meet where at most one of the two sides has two
deletions. Candidates are checked by ``levenshtein``, which also undoes collisions
of the 64-bit signatures.

A signature that more than ``BLOCK`` strings share is split: its strings are dealt to
blocks, and each pair of blocks is a group of its own. Nothing but signatures and ids
moves until pairs are distinct. A string of L characters has some L^2 signatures at two edits: the join is
meant for names and keys, not for texts.

Defined results: nulls are in no pair; equal strings are one string; the empty string is
within two edits of strings of up to two characters; characters are code points; ids are
not used, and other columns are ignored; an empty table gives no pairs.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.tables import table, written

#: Strings of one signature that meet in one group.
BLOCK = 2_048


def _signatures(s: Column, edits: int) -> Column:
    """An array of (key, gone, placed): the hash of what is left, how many characters are gone, and whether the key holds their places."""

    def without(text: Column, i: Column) -> Column:
        return F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text)))

    def signature(key: Column, gone: int, placed: bool = False) -> Column:
        return F.struct(key.alias("key"), F.lit(gone).cast("byte").alias("gone"), F.lit(placed).alias("placed"))

    n = F.length(s)
    nothing = F.array().cast("array<struct<key:bigint,gone:tinyint,placed:boolean>>")
    whole = F.array(signature(F.xxhash64(s), 0))
    one = F.when(n >= 1, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: signature(F.xxhash64(without(s, i)), 1)))).otherwise(nothing)
    parts = [whole, one]
    if edits > 1:

        def second(make) -> Column:
            # after the i-th character is gone, the j-th of the rest, from i on, is a later one
            return F.flatten(F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.transform(F.sequence(i, n - 1), lambda j: make(i, j))))

        left = lambda i, j: without(without(s, i), j)
        parts.append(F.when(n >= 2, F.array_distinct(second(lambda i, j: signature(F.xxhash64(left(i, j)), 2)))).otherwise(nothing))
        parts.append(F.when(n >= 2, second(lambda i, j: signature(F.xxhash64(i, j, left(i, j)), 2, True))).otherwise(nothing))
    return F.concat(*parts)


def edit_join(left: DataFrame, right: DataFrame | None, column: str, other: str | None = None, edits: int = 2, block: int | None = None, unequal: bool = False) -> DataFrame:
    """a, b, distance: pairs of different strings of left's column (a < b) or, with right, of left's and right's, at most so many edits apart (1 or 2).

    Between two tables equal strings are a pair of distance 0. With unequal, only pairs of strings of different lengths.
    """
    if edits not in (1, 2):
        raise ValueError("edits must be 1 or 2")
    block = block or BLOCK
    alone = right is None

    def strings(df: DataFrame, name: str) -> DataFrame:
        return df.select(F.col(name).cast("string").alias("s")).where("s IS NOT NULL").distinct()

    a = strings(left, column).withColumn("side", F.lit(0).cast("byte"))
    every = a if alone else a.unionByName(strings(right, other or column).withColumn("side", F.lit(1).cast("byte")))
    # the hash of a string stands for it until pairs are few; strings of one hash are told apart by the check
    each = every.select("side", F.xxhash64("s").alias("id"), F.explode(_signatures(F.col("s"), edits)).alias("x")).select("side", "id", "x.key", "x.gone", "x.placed")
    if unequal:  # what is left is as long on both sides
        each = each.where(~F.col("placed"))
    each = written(each, "edit-signatures")
    counts = each.groupBy("key", "placed").agg(F.count(F.lit(1)).alias("n"), F.min("side").alias("low"), F.max("side").alias("high")).where("n > 1" if alone else "low < high")
    blocks = F.ceil(F.col("n") / block).cast("int")
    met = each.join(counts.select("key", "placed", blocks.alias("blocks")), ["key", "placed"]).withColumn("own", F.pmod(F.xxhash64("id", "side"), F.col("blocks")).cast("int"))
    met = met.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    met = met.select("key", "placed", "side", "id", "gone", "own", F.least("own", "with").alias("x"), F.greatest("own", "with").alias("y"))
    one, two = (met.select("key", "placed", "x", "y", *(F.col(c).alias(f"{c}{k}") for c in ("side", "id", "gone", "own"))) for k in (1, 2))
    sides = F.col("id1") < F.col("id2") if alone else F.col("side1") < F.col("side2")
    within = F.when(F.col("placed"), F.lit(True)).otherwise(F.col("gone1") + F.col("gone2") <= (3 if edits == 2 else 2))
    if unequal:
        within = within & (F.col("gone1") != F.col("gone2"))
    pairs = one.join(two, ["key", "placed", "x", "y"]).where(sides & within & ((F.col("x") == F.col("y")) | (F.col("own1") != F.col("own2"))))
    pairs = pairs.select("id1", "id2").distinct()
    named = every.select("side", "s", F.xxhash64("s").alias("id"))
    first = named.where("side = 0").select(F.col("id").alias("id1"), F.col("s").alias("a"))
    last = named.where("side = 0" if alone else "side = 1").select(F.col("id").alias("id2"), F.col("s").alias("b"))
    met = pairs.join(first, "id1").join(last, "id2")
    if alone:
        met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    return met.select("a", "b", F.levenshtein("a", "b", edits).cast("long").alias("distance")).where("distance >= 0")


def edit_counts(df: DataFrame, column: str) -> DataFrame:
    """The column's strings that have others within two edits, and how many are within one and within two: one_edit, two_edits.

    Where many strings differ in few places, as numbered names do, each has a thousand others near it. Those are counted and not paired:

    * N strings equal one outside the places i and j, M(i) of them outside i alone: N - M(i) - M(j) + 1 differ from it at
      both places. Places where all strings of a length agree need no look.
    * Strings of one length that are a deletion and an insertion apart, and differ at three places or more, differ first at p and
      last at e, and what the one leaves without p is what the other leaves without e, where p ends a run of equal characters of the
      one and e begins one of the other. Such pairs meet there, twice at most (and count once), and leave their group as numbers.
    * Strings of different lengths are few where lengths are few; ``edit_join`` pairs them.
    """
    names = df.select(F.col(column).cast("string").alias("s")).where("s IS NOT NULL").distinct().withColumn("n", F.length("s"))
    ends = names.groupBy("n").agg(*(f(c).alias(k) for c, a, b in (("s", "low", "high"), (F.reverse("s"), "last", "first")) for f, k in ((F.min, a), (F.max, b)))).collect()  # a row a length
    spans, lengths = [], {r["n"] for r in ends}
    for r in ends:
        begin, rest = (len(os.path.commonprefix([r[a], r[b]])) for a, b in (("low", "high"), ("last", "first")))
        near = any(r["n"] + k in lengths for k in (-2, -1, 1, 2))
        spans.append((r["n"], begin + 1, max(r["n"] - rest, begin), near))
    spans = df.sparkSession.createDataFrame(spans, "n int, begin int, end int, near boolean")
    names = names.join(F.broadcast(spans), "n")
    varied = names.where("begin <= end")
    places = F.sequence("begin", "end")

    def without(i: Column, j: Column | None = None) -> Column:
        rest = F.concat(F.substring("s", F.lit(1), i - 1), F.lit("\0"), F.substring("s", i + 1, F.length("s")))
        return rest if j is None else F.concat(F.substring(rest, F.lit(1), j - 1), F.lit("\0"), F.substring(rest, j + 1, F.length("s")))

    # i = j: one place alone. Each other place takes M(i) from its pairs, so that M(i) counts 1 - (places - 1) times
    several = F.flatten(F.transform(places, lambda i: F.transform(F.sequence(i, F.col("end")), lambda j: F.struct(i.alias("i"), j.alias("j")))))
    each = varied.select("s", (F.col("end") - F.col("begin")).alias("others"), F.explode(several).alias("at")).select("s", "others", "at.i", "at.j")
    each = each.select("s", "others", "i", "j", F.when(F.col("i") == F.col("j"), without(F.col("i"))).otherwise(without(F.col("i"), F.col("j"))).alias("rest"))
    met = F.count(F.lit(1)).over(Window.partitionBy("i", "j", "rest")) - 1
    single = F.col("i") == F.col("j")
    alike = each.select("s", met.alias("met"), "others", single.alias("single")).select(
        "s", F.when(F.col("single"), F.col("met")).otherwise(0).alias("one"), F.when(F.col("single"), -F.col("others") * F.col("met")).otherwise(F.col("met")).alias("two")
    )

    # a deletion and an insertion
    left = varied.select("s", F.explode(places).alias("at"))
    here, before, after = (F.substring("s", F.col("at") + k, F.lit(1)) for k in (0, -1, 1))
    left = left.select("s", "at", F.concat(F.substring("s", F.lit(1), F.col("at") - 1), F.substring("s", F.col("at") + 1, F.length("s"))).alias("rest"), F.length("s").alias("n"), (here != after).alias("ends"), ((F.col("at") == 1) | (here != before)).alias("begins"))
    first = left.where("ends").select("rest", "n", F.col("s").alias("a"), F.col("at").alias("p"))
    last = left.where("begins").select("rest", "n", F.col("s").alias("b"), F.col("at").alias("e"))

    def part(name: str, begin: Column, size: Column) -> Column:
        return F.substring(F.col(name), begin, size)

    p, size = F.col("p"), F.col("e") - F.col("p")
    more = part("a", p + 1, size - 1) != part("b", p + 1, size - 1)  # differ at more than the two ends
    turned = part("b", p + 1, size) == part("a", p, size)  # meet with sides changed, too
    moved = first.join(last, ["rest", "n"]).where((p < F.col("e")) & more & (~turned | (F.col("a") < F.col("b"))))
    moved = moved.select(F.explode(F.array("a", "b")).alias("s"), F.lit(0).cast("long").alias("one"), F.lit(1).cast("long").alias("two"))

    found = alike.unionByName(moved)
    if any(near for *_, near in (tuple(r) for r in spans.collect())):
        pairs = edit_join(names.where("near"), None, "s", unequal=True).select(F.explode(F.array("a", "b")).alias("s"), "distance")
        found = found.unionByName(pairs.select("s", (F.col("distance") == 1).cast("long").alias("one"), (F.col("distance") == 2).cast("long").alias("two")))
    counts = found.groupBy("s").agg(F.sum("one").alias("one_edit"), F.sum("two").alias("two_edits")).where("one_edit + two_edits > 0")
    return counts.withColumnRenamed("s", column)


def similar_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many other customers' names are within one and two edits of each, mostly by digits: all names begin alike."""
    return edit_counts(table(spark, sf_dir, "customer"), "c_name")


def similar_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of different part names within two edits."""
    return edit_join(table(spark, sf_dir, "part"), None, "p_name")


def customers_like_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of customers and suppliers that are within one edit as text."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("customer"))
    suppliers = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("string").alias("supplier"))
    return edit_join(customers, suppliers, "customer", "supplier", edits=1).withColumnsRenamed({"a": "customer", "b": "supplier"})


QUERIES = {"similar_customers": similar_customers, "similar_parts": similar_parts, "customers_like_suppliers": customers_like_suppliers}

ORACLES = {
    "similar_customers": """
WITH names AS (SELECT DISTINCT c_name FROM customer), pairs AS (
  SELECT a.c_name, levenshtein(a.c_name, b.c_name) AS distance FROM names a JOIN names b ON a.c_name <> b.c_name
)
SELECT c_name, count(*) FILTER (distance = 1) AS one_edit, count(*) FILTER (distance = 2) AS two_edits FROM pairs WHERE distance <= 2 GROUP BY 1""",
    "similar_parts": """
WITH names AS (SELECT DISTINCT p_name FROM part)
SELECT a.p_name AS a, b.p_name AS b, levenshtein(a.p_name, b.p_name) AS distance FROM names a JOIN names b ON a.p_name < b.p_name WHERE levenshtein(a.p_name, b.p_name) <= 2""",
    "customers_like_suppliers": """
SELECT c_custkey::VARCHAR AS customer, s_suppkey::VARCHAR AS supplier, levenshtein(c_custkey::VARCHAR, s_suppkey::VARCHAR) AS distance
FROM customer, supplier WHERE levenshtein(c_custkey::VARCHAR, s_suppkey::VARCHAR) <= 1""",
}
