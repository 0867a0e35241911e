"""k-cores of large graphs by rounds of peeling.

The k-core is what is left when nodes with fewer than k neighbours are taken away
until none is left that has. A node's core number is the largest k whose core
holds it. It is the fixed point of a local rule: begin with the degree; a node's next
number is the largest h such that h of its neighbours have h or more. All nodes are
lowered at once in a round, and the rounds stop when no number changes.

A hub with a third of all edges is no group: its neighbours' numbers are counted by
value before the shuffle, values beyond its own number as that number, and the largest
h comes from running sums over the different values. Numbers are written after each
round, so that lineage stays short.

Defined results: edges have no direction, repeated edges and loops count nothing, and edges
with a null end are left out; nodes are those of some edge; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.tables import table, written


def core_numbers(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 1000) -> DataFrame:
    """node and core: the core number of each node of the edges."""
    one = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    both = one.unionByName(one.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct()
    both = written(both, "core-edges")
    numbers = written(both.groupBy(F.col("u").alias("node")).agg(F.count(F.lit(1)).alias("core")), "core-0")
    for number in range(1, max_rounds + 1):
        known = numbers.select(F.col("node").alias("v"), F.col("core").alias("other"))
        own = numbers.select(F.col("node").alias("u"), "core")
        # what a neighbour has beyond the node's own number says no more than that number
        seen = both.join(known, "v").join(own, "u").select("u", "core", F.least("other", "core").alias("other"))
        counts = seen.groupBy("u", "core", "other").agg(F.count(F.lit(1)).alias("n"))
        upward = F.sum("n").over(Window.partitionBy("u").orderBy(F.desc("other")))
        h = counts.withColumn("many", upward).groupBy("u").agg(F.max(F.least("other", "many")).alias("core"), F.first("core").alias("before"))
        h = written(h.withColumnRenamed("u", "node"), f"core-{number}")
        changed = h.where("core < before").limit(1).count()
        numbers = h.select("node", "core")
        if not changed:
            return numbers
    raise RuntimeError("core numbers did not settle")


def customer_supplier_cores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Core numbers in the graph of customers and the suppliers that they ordered more than 45 pieces from."""
    lines = table(spark, sf_dir, "lineitem").where("l_quantity > 45").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    edges = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.concat(F.lit("c"), "o_custkey").alias("a"), F.concat(F.lit("s"), "l_suppkey").alias("b"))
    return core_numbers(edges).select("node", "core")


QUERIES = {"customer_supplier_cores": customer_supplier_cores}

#: The same rule, round by round; numbers settle after few.
ORACLES = {
    "customer_supplier_cores": """
WITH RECURSIVE edges AS (
  SELECT DISTINCT 'c' || o_custkey AS u, 's' || l_suppkey AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_quantity > 45
), sides AS (
  SELECT u, v FROM edges UNION ALL SELECT v, u FROM edges
), rounds AS (
  SELECT 0 AS i, u AS node, count(*) AS core FROM sides GROUP BY u
  UNION ALL
  SELECT i, u, max(least(other, many)) FROM (
    SELECT i, u, other, count(*) OVER (PARTITION BY i, u ORDER BY other DESC) AS many
    FROM (SELECT r.i + 1 AS i, s.u, least(r.core, o.core) AS other FROM rounds r JOIN sides s ON s.v = r.node JOIN rounds o ON o.node = s.u AND o.i = r.i WHERE r.i < 60)
  ) GROUP BY i, u
)
SELECT node, core FROM rounds WHERE i = 60""",
}
