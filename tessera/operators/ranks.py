"""Ranks, tiles and exact quantiles over a whole table, without a window that holds it.

Rows are dealt by range of the order's columns, and of an arbitrary number beyond them,
so that a value that a third of all rows share is dealt to many parts too. The parts
are written once; their row counts, a few numbers a part, are summed in the driver
to what stands before each part. A row's global number is then its number in its
part plus that. Rows of equal values that lie in several parts share the rank of
the first, which the parts' first and last values tell.

Defined results: nulls come first ascending and last descending, and tie with each other; which of several rows
with equal values comes first is arbitrary for ``row_number`` and ``ntile``; a tie shares
``rank``, ``dense_rank``, ``percent_rank`` and ``cume_dist``; the only row of a table has
percent_rank 0; an empty table gives no rows. Names that begin with ``__`` are the operator's.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.tables import table, written

FUNCTIONS = ("row_number", "rank", "dense_rank", "percent_rank", "cume_dist")
#: A column's name and its direction: nulls come first ascending and last descending.
Order = Sequence[tuple[str, str]]


def _columns(order: Order) -> list[Column]:
    return [F.asc_nulls_first(name) if direction == "asc" else F.desc_nulls_last(name) for name, direction in order]


def _ranged(df: DataFrame, order: Order, parts: int | None) -> DataFrame:
    """df dealt by range; the last column tells rows apart, so that no value fills a part alone."""
    n = parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.withColumn("__tie", F.monotonically_increasing_id()).repartitionByRange(n, *_columns(order), "__tie")


def row_numbers(df: DataFrame, order: Order, name: str = "row_number", parts: int | None = None) -> DataFrame:
    """df with the number, from 1, of each row in the order; one shuffle of the rows."""
    ranged = _ranged(df, order, parts).sortWithinPartitions(*_columns(order), "__tie")
    # within a partition these ids count up from the partition's number times 2^33
    numbered = written(ranged.withColumn("__place", F.monotonically_increasing_id()).drop("__tie"), "ranks")
    part = F.shiftrightunsigned("__place", 33).cast("int")
    rows, at = [], 0
    for r in sorted(numbered.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect()):  # a row a part
        rows.append((r["part"], at))
        at += r["n"]
    before = F.broadcast(df.sparkSession.createDataFrame(rows, "__part int, __before long"))
    inside = F.col("__place").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return numbered.withColumn("__part", part).join(before, "__part").select(*df.columns, (F.col("__before") + inside).alias(name))


def _same(a: tuple, b: tuple) -> bool:
    return all(x == y or (x != x and y != y) for x, y in zip(a, b))


def _borders(ends: list) -> list[tuple[int, int, int, int, int, int]]:
    """For each part: its number, rows before it, distinct values before it (less one if it begins with the last of them), the first value's rank, its last value's rank within it, and the rows up to and with the last value's ties."""
    out, at, dense, start, last = [], 0, 0, 1, None
    for r in ends:
        if last is not None and _same(last, r["first"]):
            dense -= 1
        else:
            start = at + 1
        out.append([r["part"], at, dense, start, r["last_rank"], at + r["n"]])
        if r["distinct"] > 1:
            start = at + r["last_rank"]
        at, dense, last = at + r["n"], dense + r["distinct"], r["last"]
    for k in range(len(ends) - 2, -1, -1):
        following = ends[k + 1]
        if _same(ends[k]["last"], following["first"]):
            out[k][5] = out[k + 1][5] if following["distinct"] == 1 else out[k + 1][1] + following["first_run"]
    return [tuple(row) for row in out]


def ranks(df: DataFrame, order: Order, functions: Sequence[str] = FUNCTIONS, tiles: int | None = None, parts: int | None = None) -> DataFrame:
    """df with the asked-for functions as columns of their names, and ``ntile`` if tiles is given; two shuffles of the rows."""
    ranged = _ranged(df, order, parts).withColumn("__part", F.spark_partition_id())
    own = Window.partitionBy("__part")
    ordered = own.orderBy(*_columns(order))
    local = ranged.withColumns({"__rn": F.row_number().over(own.orderBy(*_columns(order), "__tie")), "__rank": F.rank().over(ordered), "__dense": F.dense_rank().over(ordered), "__upto": F.count(F.lit(1)).over(ordered)})
    local = written(local.drop("__tie"), "ranks")
    value = F.struct(*(name for name, _ in order))
    ends = local.groupBy(F.col("__part").alias("part")).agg(
        F.count(F.lit(1)).alias("n"), F.max("__dense").alias("distinct"), F.max("__rank").alias("last_rank"), F.min("__upto").alias("first_run"), F.min_by(value, "__rn").alias("first"), F.max_by(value, "__rn").alias("last")
    )
    ends = sorted(ends.collect(), key=lambda r: r["part"])  # a row a part
    borders, total = _borders(ends), sum(r["n"] for r in ends)
    known = df.sparkSession.createDataFrame(borders, "__part int, __before long, __dense_before long, __start long, __last_rank int, __end long")
    joined = local.join(F.broadcast(known), "__part")
    row_number = F.col("__before") + F.col("__rn")
    rank = F.when(F.col("__rank") == 1, F.col("__start")).otherwise(F.col("__before") + F.col("__rank"))
    upto = F.when(F.col("__rank") == F.col("__last_rank"), F.col("__end")).otherwise(F.col("__before") + F.col("__upto"))
    found = {
        "row_number": row_number,
        "rank": rank,
        "dense_rank": F.col("__dense_before") + F.col("__dense"),
        "percent_rank": (rank - 1).cast("double") / F.lit(float(max(total - 1, 1))),
        "cume_dist": upto.cast("double") / F.lit(float(max(total, 1))),
    }
    columns = [found[name].alias(name) for name in functions]
    if tiles:
        size, longer = divmod(total, tiles)
        edge = longer * (size + 1)  # the first tiles have a row more
        tile = F.when(row_number <= edge, F.floor((row_number - 1) / F.lit(size + 1))).otherwise(F.lit(longer) + F.floor((row_number - 1 - edge) / F.lit(max(size, 1))))
        columns.append((tile + 1).cast("long").alias("ntile"))
    return joined.select(*df.columns, *columns)


def prefix_sums(df: DataFrame, order: Order, names: Sequence[str], parts: int | None = None) -> DataFrame:
    """df with the whole numbers in the columns of names replaced by their sums over the rows up to and with each; nulls add nothing, and rows that tie come in any order."""
    ranged = _ranged(df, order, parts).withColumn("__part", F.spark_partition_id())
    own = Window.partitionBy("__part").orderBy(*_columns(order), "__tie").rowsBetween(Window.unboundedPreceding, 0)
    number = {name: F.coalesce(F.col(name).cast("long"), F.lit(0)) for name in names}
    sums = {name: F.sum(value).over(own) for name, value in number.items()}
    local = written(ranged.withColumns({**sums, **{f"__own_{name}": value for name, value in number.items()}}).drop("__tie"), "sums")
    totals = local.groupBy("__part").agg(*(F.sum(f"__own_{name}").alias(name) for name in names)).collect()  # a row a part
    rows, at = [], [0] * len(names)
    for r in sorted(totals, key=lambda r: r["__part"]):
        rows.append((r["__part"], *at))
        at = [a + r[name] for a, name in zip(at, names)]
    before = df.sparkSession.createDataFrame(rows, ", ".join(["__part int", *(f"__before_{name} long" for name in names)]))
    joined = local.join(F.broadcast(before), "__part")
    return joined.select(*((F.col(c) + F.col(f"__before_{c}")).alias(c) if c in names else F.col(c) for c in df.columns))


def quantiles(df: DataFrame, value: str, probabilities: Sequence[float], by: Sequence[str] = (), parts: int | None = None) -> DataFrame:
    """by, probability, quantile: exact, between neighbours in proportion, over the values that are not null.

    All groups are numbered in one order of group and value; a group's quantiles are the
    rows at two numbers each, which an equi-join finds. A group may hold the whole table.
    """
    kept = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("__value"))
    numbered = row_numbers(kept, [*((name, "asc") for name in by), ("__value", "asc")], "__rn", parts)
    groups = numbered.groupBy(*by).agg(F.min("__rn").alias("__first"), F.count(F.lit(1)).alias("__n")).where("__n > 0")
    place = F.col("probability") * (F.col("__n") - 1)
    asked = groups.withColumn("probability", F.explode(F.array(*(F.lit(float(p)) for p in probabilities)))).withColumn("__share", place - F.floor(place))
    ends = F.array(F.struct(F.floor(place).alias("at"), (1 - F.col("__share")).alias("weight")), F.struct(F.ceil(place).alias("at"), F.col("__share").alias("weight")))
    each = asked.withColumn("__end", F.explode(ends)).select(*by, "probability", (F.col("__first") + F.col("__end.at")).alias("__rn"), F.col("__end.weight").alias("__weight"))
    met = each.join(numbered.select("__rn", "__value"), "__rn")
    return met.groupBy(*by, "probability").agg(F.sum(F.when(F.col("__weight") > 0, F.col("__weight") * F.col("__value")).otherwise(F.lit(0.0))).alias("quantile"))


def price_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where each line stands among all lines by price, as far as ties allow to say."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    found = ranks(lines, [("l_extendedprice", "desc")], ("rank", "dense_rank", "percent_rank", "cume_dist"))
    return found.withColumns({name: F.round(name, 12) for name in ("percent_rank", "cume_dist")})


def quantity_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of fifty values that all lines share: ties that lie in many parts."""
    lines = table(spark, sf_dir, "lineitem").select("l_quantity")
    found = ranks(lines, [("l_quantity", "asc")], ("rank", "dense_rank", "cume_dist"))
    return found.groupBy("l_quantity", "rank", "dense_rank", F.round("cume_dist", 12).alias("cume_dist")).agg(F.count(F.lit(1)).alias("lines"))


def line_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Global numbers and hundredths of all lines, in an order that tells all different lines apart."""
    names = ("l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    found = ranks(table(spark, sf_dir, "lineitem").select(*names), [(names[0], "desc"), *((name, "asc") for name in names[1:])], ("row_number",), tiles=100)
    return found.select(*names, "row_number", "ntile")


def price_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all lines, and of each return flag."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_extendedprice")
    asked = (0.01, 0.25, 0.5, 0.75, 0.99)
    every = quantiles(lines, "l_extendedprice", asked).withColumn("l_returnflag", F.lit("all"))
    return quantiles(lines, "l_extendedprice", asked, ["l_returnflag"]).unionByName(every).select("l_returnflag", "probability", F.round("quantile", 4).alias("quantile"))


QUERIES = {"price_ranks": price_ranks, "quantity_ranks": quantity_ranks, "line_numbers": line_numbers, "price_quantiles": price_quantiles}

ORACLES = {
    "price_ranks": """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank,
       round(percent_rank() OVER w, 12) AS percent_rank, round(cume_dist() OVER w, 12) AS cume_dist
FROM lineitem WINDOW w AS (ORDER BY l_extendedprice DESC)""",
    "quantity_ranks": """
SELECT l_quantity, rank, dense_rank, round(cume_dist, 12) AS cume_dist, count(*) AS lines
FROM (SELECT l_quantity, rank() OVER w AS rank, dense_rank() OVER w AS dense_rank, cume_dist() OVER w AS cume_dist FROM lineitem WINDOW w AS (ORDER BY l_quantity)) GROUP BY ALL""",
    "line_numbers": """
SELECT l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, row_number() OVER w AS row_number, ntile(100) OVER w AS ntile
FROM lineitem WINDOW w AS (ORDER BY l_shipdate DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice)""",
    "price_quantiles": """
SELECT l_returnflag, unnest([0.01, 0.25, 0.5, 0.75, 0.99])::DOUBLE AS probability, round(unnest(q), 4) AS quantile
FROM (SELECT l_returnflag, quantile_cont(l_extendedprice, [0.01, 0.25, 0.5, 0.75, 0.99]) AS q
      FROM (SELECT l_returnflag, l_extendedprice FROM lineitem UNION ALL SELECT 'all', l_extendedprice FROM lineitem) GROUP BY ALL)""",
}
