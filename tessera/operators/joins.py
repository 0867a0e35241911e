"""Joins: equi, outer, semi, anti, inequality, band, as-of, containment, lateral and scalar subqueries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.tables import table


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, values: list[str], hot_rows: int | None = None, spans: int = 64) -> DataFrame:
    """Each left row with the values of the latest right row of the same key at or before it.

    One union and one window per key instead of a join of all pairs: right rows sort
    before left rows of the same time, and ``last`` carries the values forward. The
    values travel as one struct, so that a null value in the latest row stays null.

    With hot_rows, a key with more rows than that is cut at quantiles of its times into
    spans of about equal numbers of rows, each a window of its own, which begins with the last
    right row of the spans before it; rows of one time stay together. The plan stays lazy: keys are counted, from the
    key and time columns alone, when it runs. Without, a key is one window, which sorts and spills in one task.
    """
    packed = F.struct(*(F.col(v) for v in values))
    none = F.lit(None).cast(right.select(packed.alias("v")).schema["v"].dataType)
    rest = [c for c in left.columns if c not in (*by, on)]
    a = left.select(*by, on, F.lit(1).alias("__side"), F.struct(*rest).alias("__left"), none.alias("__right"))
    b = right.select(*by, on, F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__left"].dataType).alias("__left"), packed.alias("__right"))
    rows = a.unionByName(b).withColumn("__span", F.lit(0))
    ordered = (T.NumericType, T.TimestampType, T.TimestampNTZType, T.DateType)
    if hot_rows is not None and isinstance(left.schema[on].dataType, ordered):
        both = left.select(*by, on).unionByName(right.select(*by, on))
        cuts = F.percentile_approx(on, F.array(*(F.lit(k / spans) for k in range(1, spans))), 100 * spans)
        rows = _with_spans(rows, both.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), cuts.alias("__cuts")).where(F.col("__n") > hot_rows), by, on)
    order = Window.partitionBy(*by, "__span").orderBy(F.asc_nulls_first(on), "__side").rowsBetween(Window.unboundedPreceding, 0)
    filled = rows.withColumn("__last", F.last("__right", ignorenulls=True).over(order)).where("__side = 1")
    return filled.select(*by, on, *(F.col(f"__left.{c}") for c in rest), *(F.col(f"__last.{v}").alias(f"asof_{v}") for v in values))


def _with_spans(rows: DataFrame, hot: DataFrame, by: list[str], on: str) -> DataFrame:
    """The union's rows with the span of hot keys (how many of the key's cuts are below the time), and a row before each span with what the right rows before it leave."""
    known = hot.select(*(F.col(c).alias(f"__{c}") for c in by), "__cuts")
    same = F.lit(True)
    for c in by:
        same = same & rows[c].eqNullSafe(known[f"__{c}"])
    span = F.coalesce(F.size(F.filter("__cuts", lambda cut: cut < F.col(on))), F.lit(0))
    dealt = rows.drop("__span").join(known, same, "left")
    dealt = dealt.withColumn("__span", F.when(F.col("__cuts").isNull(), 0).otherwise(span)).withColumn("__most", F.size("__cuts")).select(*rows.columns, "__most")
    ends = dealt.where("__most > 0 AND __side = 0").groupBy(*by, "__span").agg(F.max_by("__right", on).alias("__right"), F.first("__most").alias("__most"))
    until = F.lead("__span").over(Window.partitionBy(*by).orderBy("__span"))
    carried = ends.withColumn("__until", F.coalesce(until, F.col("__most"))).where(F.col("__until") > F.col("__span")).withColumn("__span", F.explode(F.sequence(F.col("__span") + 1, F.col("__until"))))
    first = carried.select(*by, F.lit(None).cast(rows.schema[on].dataType).alias(on), F.lit(-1).alias("__side"), F.lit(None).cast(rows.schema["__left"].dataType).alias("__left"), "__right", "__span")
    return dealt.drop("__most").unionByName(first)


def band_join(left: DataFrame, right: DataFrame, value: str, other: str, width: float) -> DataFrame:
    """Pairs whose values differ by at most width, by an equi-join on cells of that width.

    A left row meets the three cells around its own, so that the join hashes instead of
    comparing all pairs.
    """
    cells = left.withColumn("__cell", F.explode(F.transform(F.array(*map(F.lit, (-1, 0, 1))), lambda d: F.floor(F.col(value) / width) + d)))
    other_cells = right.withColumn("__cell", F.floor(F.col(other) / width))
    return cells.join(other_cells, "__cell").where(F.abs(F.col(value) - F.col(other)) <= width).drop("__cell")


def containment_join(documents: DataFrame, passages: DataFrame, text: str, passage: str, words: int = 8, listed: int = 10_000) -> DataFrame:
    """Pairs of a document and a passage whose whole text is in it.

    A passage may begin and end inside of words of the document, but all words between
    are whole: an equi-join on the hash of the passage's second and following words
    makes the candidates; of shorter passages there are as many
    words between as they have (4, 2 or 1). Hashes alone are exploded and meet, with the hash of the whole text for the
    text; the distinct pairs of texts meet the documents and the passages once, for contains(). Passages of one or two words have no words between: up
    to ``listed`` of them go to each document as one list, more of them meet the
    documents on their first four characters.
    """

    def tokens(c: str) -> Column:
        return F.split(F.col(c), r"\s+")

    def windows(ks: list[int]) -> Column:
        def of(words: Column, k: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - k + 1, F.lit(1))), lambda i: F.xxhash64(F.lit(k), F.array_join(F.slice(words, i, k), " ")))

        # the words are bound to a variable, so that a document is split once
        return F.array_distinct(F.flatten(F.flatten(F.transform(F.array(tokens(text)), lambda w: F.array(*(of(w, k) for k in ks))))))

    def met(part: DataFrame, ks: list[int]) -> DataFrame:
        known = part.withColumn("__passage", F.xxhash64(passage))
        asked = known.select("__passage", F.xxhash64("__k", F.array_join(F.slice(tokens(passage), F.lit(2), F.col("__k")), " ")).alias("__window")).distinct()
        named = documents.withColumn("__text", F.xxhash64(text))
        found = named.select("__text", F.explode(windows(ks)).alias("__window")).join(asked, "__window").select("__text", "__passage").distinct()
        return named.join(found, "__text").join(known.drop("__k"), "__passage").drop("__text", "__passage")

    size = F.size(tokens(passage))
    between = {k: F.when(size >= k + 2, F.lit(k)) for k in sorted({words, *(k for k in (4, 2, 1) if k < words)}, reverse=True)}
    sized = passages.withColumn("__k", F.coalesce(*between.values(), F.when(size > 0, F.lit(0))))
    present = {r["__k"]: r["count"] for r in sized.groupBy("__k").count().collect()}  # six rows at most
    ks = [k for k in between if k in present]
    found = [met(sized.where("__k > 0"), ks)] if ks else []
    tiny = sized.where("__k = 0").drop("__k")
    columns = F.struct(*(F.col(c) for c in passages.columns))
    if present.get(0, 0) <= listed:
        every = tiny.agg(F.collect_list(columns).alias("__list"))  # one row
        held = documents.crossJoin(F.broadcast(every)).withColumn("__one", F.explode(F.filter("__list", lambda p: F.contains(F.col(text), p[passage]))))
        found.append(held.select(*documents.columns, "__one.*"))
    else:
        chars = F.least(F.length(passage), F.lit(4))
        heads = tiny.withColumn("__head", F.substring(F.col(passage), F.lit(1), chars))

        def heads_of(k: int) -> Column:
            return F.transform(F.sequence(F.lit(1), F.length(text) + 1), lambda i: F.substring(F.col(text), i, F.lit(k)))

        grams = [heads_of(k) for k in range(5)]
        found.append(documents.where(F.col(text).isNotNull()).withColumn("__head", F.explode(F.array_distinct(F.flatten(F.array(*grams))))).join(heads, "__head").drop("__head"))
    every_pair = found[0]
    for more in found[1:]:
        every_pair = every_pair.unionByName(more)
    return every_pair.where(F.contains(F.col(text), F.col(passage)))


def regional_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = {n: table(spark, sf_dir, n) for n in ("customer", "orders", "lineitem", "supplier", "nation", "region")}
    joined = (
        t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey"))
        .join(t["customer"], F.col("o_custkey") == F.col("c_custkey"))
        .join(t["supplier"], (F.col("l_suppkey") == F.col("s_suppkey")) & (F.col("c_nationkey") == F.col("s_nationkey")))
        .join(t["nation"], F.col("s_nationkey") == F.col("n_nationkey"))
        .join(t["region"], F.col("n_regionkey") == F.col("r_regionkey"))
    )
    return joined.groupBy("r_name", "n_name").agg(F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue"))


def left_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_totalprice > 400000")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_mktsegment").agg(F.count("o_orderkey").alias("large_orders"), F.count(F.lit(1)).alias("rows"))


def right_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "lineitem").where("l_quantity > 49").select("l_orderkey")
    return items.join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"), "right").groupBy("o_orderpriority").agg(F.count("l_orderkey").alias("matched"), F.count(F.lit(1)).alias("rows"))


def full_outer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels"), "doc_id", "full").select("doc_id", "lang", "quality", "toxic")


def semi_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = table(spark, sf_dir, "lineitem").where("l_quantity >= 45").select(F.col("l_orderkey").alias("o_orderkey"))
    return table(spark, sf_dir, "orders").join(late, "o_orderkey", "left_semi").groupBy("o_orderpriority").agg(F.count(F.lit(1)).alias("orders"))


def anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    failed = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").join(failed, "c_custkey", "left_anti").select("c_custkey", "c_name")


def not_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("customer")
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    return spark.sql("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)")


def inequality_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers against the nations' mean balance: a join on an inequality whose one side is a row a nation."""
    supplier = table(spark, sf_dir, "supplier")
    means = supplier.groupBy(F.col("s_nationkey").alias("nation")).agg(F.avg("s_acctbal").alias("mean"))
    return supplier.join(means, (F.col("s_acctbal") > F.col("mean")) & (F.col("s_nationkey") != F.col("nation"))).groupBy("s_suppkey").agg(F.count(F.lit(1)).alias("nations_below"))


def band_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_acctbal")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return band_join(customer, supplier, "c_acctbal", "s_acctbal", 5.0).select("c_custkey", "s_suppkey")


def asof_join_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    purchases = events.where("event_type = 'purchase'").select("user_id", "ts", "event_id")
    views = events.where("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"), "value")
    return asof_join(purchases, views, ["user_id"], "ts", ["view_id", "value"], hot_rows=1_000_000).select("event_id", "user_id", F.col("asof_view_id").alias("view_id"), F.col("asof_value").alias("view_value"))


def scalar_subquery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A correlated scalar subquery, which Catalyst turns into an aggregate and a join."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    table(spark, sf_dir, "part").createOrReplaceTempView("part")
    return spark.sql("SELECT p_brand, round(sum(l_extendedprice) / 7.0, 2) AS yearly FROM lineitem l JOIN part ON l_partkey = p_partkey WHERE p_size < 10 AND l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey) GROUP BY p_brand")


def broadcast_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nations, a table of fixed size, go to every task."""
    nation = F.broadcast(table(spark, sf_dir, "nation"))
    return table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.round(F.sum("c_acctbal"), 2).alias("balance"))


def shuffled_hash_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both sides by the hash of the key, the smaller one hashed in each task: no sorts."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus").hint("shuffle_hash")
    return table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("lines"))


def filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    kept = F.col("p_size").isin(1, 5, 9, 20) & (F.col("p_name").like("%a%e%") | F.col("p_type").ilike("%STEEL%")) & ~F.col("p_brand").like("%3") & F.col("p_retailprice").between(900, 2000)
    return part.where(kept & part["p_name"].isNotNull()).select("p_partkey", "p_name", "p_size")


def pipe_syntax(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("lineitem")
    return spark.sql("FROM lineitem |> WHERE l_quantity > 10 |> EXTEND l_quantity * l_discount AS off |> AGGREGATE count(*) AS lines, round(sum(off), 2) AS off GROUP BY l_returnflag |> WHERE lines > 0")


def lateral_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "region").createOrReplaceTempView("region")
    table(spark, sf_dir, "nation").createOrReplaceTempView("nation")
    return spark.sql("SELECT r_name, n.last_name, n.nations FROM region, LATERAL (SELECT max(n_name) AS last_name, count(*) AS nations FROM nation WHERE n_regionkey = r_regionkey) n")


def cross_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two dimension tables of fixed size."""
    return table(spark, sf_dir, "region").select("r_name").crossJoin(table(spark, sf_dir, "nation").select("n_name"))


def containment_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = containment_join(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")), "text", "passage")
    return pairs.select("doc_id", "item_id").distinct()


QUERIES = {
    "regional_revenue": regional_revenue,
    "left_outer_join": left_outer,
    "right_outer_join": right_outer,
    "full_outer_join": full_outer,
    "semi_join": semi_join,
    "anti_join": anti_join,
    "not_in": not_in,
    "inequality_join": inequality_join,
    "band_join": band_join_query,
    "asof_join": asof_join_query,
    "scalar_subquery": scalar_subquery,
    "lateral_join": lateral_join,
    "cross_join": cross_join,
    "containment_join": containment_query,
    "broadcast_join": broadcast_join,
    "shuffled_hash_join": shuffled_hash_join,
    "filters": filters,
    "pipe_syntax": pipe_syntax,
}

ORACLES = {
    "broadcast_join": "SELECT n_name, round(sum(c_acctbal), 2) AS balance FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1",
    "shuffled_hash_join": "SELECT o_orderstatus, count(*) AS lines FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "filters": "SELECT p_partkey, p_name, p_size FROM part WHERE p_size IN (1, 5, 9, 20) AND (p_name LIKE '%a%e%' OR p_type ILIKE '%STEEL%') AND p_brand NOT LIKE '%3' AND p_retailprice BETWEEN 900 AND 2000",
    "pipe_syntax": "SELECT l_returnflag, count(*) AS lines, round(sum(l_quantity * l_discount), 2) AS off FROM lineitem WHERE l_quantity > 10 GROUP BY 1",
    "regional_revenue": "SELECT r_name, n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL",
    "left_outer_join": "SELECT c_mktsegment, count(o_orderkey) AS large_orders, count(*) AS rows FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey GROUP BY ALL",
    "right_outer_join": "SELECT o_orderpriority, count(l_orderkey) AS matched, count(*) AS rows FROM (SELECT l_orderkey FROM lineitem WHERE l_quantity > 49) RIGHT JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL",
    "full_outer_join": "SELECT doc_id, lang, quality, toxic FROM documents FULL JOIN labels USING (doc_id)",
    "semi_join": "SELECT o_orderpriority, count(*) AS orders FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity >= 45) GROUP BY ALL",
    "anti_join": "SELECT c_custkey, c_name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'F')",
    "not_in": "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000)",
    "inequality_join": "SELECT s_suppkey, count(*) AS nations_below FROM supplier JOIN (SELECT s_nationkey AS nation, avg(s_acctbal) AS mean FROM supplier GROUP BY 1) ON s_acctbal > mean AND s_nationkey <> nation GROUP BY 1",
    "band_join": "SELECT c_custkey, s_suppkey FROM customer, supplier WHERE abs(c_acctbal - s_acctbal) <= 5.0",
    "asof_join": "SELECT p.event_id, p.user_id, v.event_id AS view_id, v.value AS view_value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON p.user_id = v.user_id AND p.ts >= v.ts",
    "scalar_subquery": "SELECT p_brand, round(sum(l_extendedprice) / 7.0, 2) AS yearly FROM lineitem l JOIN part ON l_partkey = p_partkey WHERE p_size < 10 AND l_quantity < (SELECT 0.2 * avg(l_quantity) FROM lineitem i WHERE i.l_partkey = l.l_partkey) GROUP BY 1",
    "lateral_join": "SELECT r_name, max(n_name) AS last_name, count(*) AS nations FROM region JOIN nation ON n_regionkey = r_regionkey GROUP BY 1",
    "cross_join": "SELECT r_name, n_name FROM region, nation",
    "containment_join": "SELECT d.doc_id, b.item_id FROM documents d, benchmark b WHERE contains(d.text, b.text)",
}
