"""Each query of the catalogue against its SQL in DuckDB, and the plans that matter at scale."""

import datetime
import glob
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from tessera.operators import joins
from tessera.plans import catalogue
from tessera.sources.tables import table


@pytest.fixture(scope="module")
def con(sf_dir):
    found = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        found.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return found


def norm(value):
    return float(value) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query_equals_sql(spark, sf_dir, con, name):
    got = catalogue.QUERIES[name](spark, sf_dir)
    found = con.execute(catalogue.ORACLES[name])
    names = [c[0] for c in found.description]
    assert sorted(got.columns) == sorted(names)
    a = Counter(tuple(map(norm, r)) for r in got.select(*names).collect())
    b = Counter(tuple(map(norm, r)) for r in found.fetchall())
    assert a == b


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_scans_prune_and_push_down(spark, sf_dir):
    found = plan(catalogue.QUERIES["pricing_summary"](spark, sf_dir))
    assert "PushedFilters: [IsNotNull(l_shipdate), LessThanOrEqual(l_shipdate" in found
    assert "l_comment" not in found and "l_partkey" not in found


def test_partition_filter_reaches_the_scan(spark, sf_dir):
    assert "PartitionFilters: [isnotnull(c_mktsegment" in plan(catalogue.QUERIES["partition_pruning"](spark, sf_dir))


def test_bucketed_join_has_no_exchange_below_the_join(spark, sf_dir):
    found = plan(catalogue.QUERIES["bucketed_join"](spark, sf_dir))
    assert found.count("Exchange hashpartitioning(o_orderkey") + found.count("Exchange hashpartitioning(l_orderkey") == 0


def test_band_join_hashes(spark, sf_dir):
    found = plan(catalogue.QUERIES["band_join"](spark, sf_dir))
    assert "NestedLoop" not in found and "Cartesian" not in found


def test_asof_join_ties_and_nulls(spark):
    at = lambda s: datetime.datetime(2024, 1, 1, 0, 0, s)
    left = spark.createDataFrame([(1, at(5), "a"), (1, at(1), "b"), (2, at(9), "c"), (None, at(5), "d")], "k int, t timestamp, x string")
    right = spark.createDataFrame([(1, at(5), 50, None), (1, at(3), 30, 3), (2, at(10), 100, 1), (None, at(1), 7, 7)], "k int, t timestamp, v int, w int")
    found = joins.asof_join(left, right, ["k"], "t", ["v", "w"]).collect()
    # a null key meets null keys, as in a window; the latest row's null stays null
    assert {(r["x"], r["asof_v"], r["asof_w"]) for r in found} == {("a", 50, None), ("b", None, None), ("c", None, None), ("d", 7, 7)}


def test_containment_needs_whole_passages(spark):
    passage = "one two three four five six seven eight nine ten eleven"
    docs = spark.createDataFrame([(1, f"x {passage} y"), (2, passage[:-1]), (3, f"pre{passage}post"), (4, None)], "doc_id int, text string")
    items = spark.createDataFrame([(7, passage), (8, "wo three fou"), (9, "x one"), (10, "eno"), (11, None)], "item_id int, passage string")
    found = joins.containment_join(docs, items, "text", "passage").select("doc_id", "item_id").distinct().collect()
    assert {tuple(r) for r in found} == {(1, 7), (3, 7), (1, 8), (2, 8), (3, 8), (1, 9)}


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert set(catalogue.QUERIES) <= set(__spark_entry__.queries())


def test_tables_are_read_whole(spark, sf_dir, con):
    for name in ("lineitem", "documents", "events"):
        assert table(spark, sf_dir, name).agg(F.count(F.lit(1))).first()[0] == con.execute(f"SELECT count(*) FROM {name}").fetchone()[0]


def test_broadcast_and_shuffled_hash_joins(spark, sf_dir):
    assert "BroadcastHashJoin" in plan(catalogue.QUERIES["broadcast_join"](spark, sf_dir))
    assert "ShuffledHashJoin" in plan(catalogue.QUERIES["shuffled_hash_join"](spark, sf_dir))


def test_asof_join_of_hot_keys(spark):
    """A key cut into spans of time gives what one window gives, where spans are without rows of either side too."""
    import random

    rng = random.Random(3)
    for kind, make in (("timestamp", lambda s: datetime.datetime(2024, 1, 1) + datetime.timedelta(seconds=s)), ("long", int)):
        times = [rng.randrange(500) * (1 if rng.random() < 0.5 else 20) for _ in range(300)]
        left = spark.createDataFrame([(i % 3, make(t), i) for i, t in enumerate(times)], f"k int, t {kind}, x int")
        right = spark.createDataFrame([(i % 2, make(7 * i * i % 9000), i, None if i % 4 else i) for i in range(90)], f"k int, t {kind}, v int, w int")
        one, two = (Counter(map(tuple, joins.asof_join(left, right, ["k"], "t", ["v", "w"], hot_rows=n, spans=16).collect())) for n in (None, 20))
        assert one == two and len(one) == 300


def test_asof_join_of_a_burst_is_lazy_and_spread(spark):
    """A key whose rows are in one second but for one stray time: spans go by numbers of rows, and no job runs before the result is asked for."""
    rows = [(1, 1_000_000 + k, k) for k in range(2000)] + [(1, 10**15, -1), (2, 5, 7)]
    left = spark.createDataFrame(rows, "k int, t long, x int")
    right = spark.createDataFrame([(1, 1_000_000 + 7 * k, k) for k in range(280)] + [(1, -(10**15), -5)], "k int, t long, v int")
    tracker = spark.sparkContext.statusTracker()
    before = len(tracker.getJobIdsForGroup(None))
    found = joins.asof_join(left, right, ["k"], "t", ["v"], hot_rows=100, spans=16)
    assert len(tracker.getJobIdsForGroup(None)) == before
    plain = joins.asof_join(left, right, ["k"], "t", ["v"])
    assert Counter(map(tuple, found.collect())) == Counter(map(tuple, plain.collect()))
    both = left.select("k", "t").unionByName(right.select("k", "t"))
    cuts = both.groupBy("k").agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("t", F.array(*(F.lit(k / 16) for k in range(1, 16))), 1600).alias("__cuts")).where("__n > 100")
    spread = joins._with_spans(both.select("k", "t", F.lit(1).alias("__side"), F.lit(1).alias("__left"), F.lit(None).cast("int").alias("__right"), F.lit(0).alias("__span")), cuts, ["k"], "t")
    sizes = [r["count"] for r in spread.where("k = 1").groupBy("__span").count().collect()]
    assert len(sizes) == 16 and max(sizes) <= 2 * sum(sizes) / len(sizes)


def test_containment_explodes_hashes_alone(spark, sf_dir):
    """What is exploded and joined by windows has no text in it."""
    docs, items = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage"))
    found = joins.containment_join(docs, items, "text", "passage")
    carried = [line.rsplit("), [", 1)[1].split("]")[0] for line in plan(found).splitlines() if "Generate explode" in line and "xxhash64" in line]
    assert carried and all(c.startswith("__text#") and "," not in c for c in carried)
    repeated = docs.unionByName(docs)
    pairs = joins.containment_join(repeated, items, "text", "passage").groupBy("doc_id", "item_id").count()
    assert {r["count"] for r in pairs.collect()} <= {2}


def test_many_tiny_passages(spark):
    """Passages of one or two words, as a list and by their first characters alike; no nested loop over pairs."""
    docs = spark.createDataFrame([(1, "abc def"), (2, "xx"), (3, ""), (4, None), (5, "c dx")], "doc_id int, text string")
    items = spark.createDataFrame([(1, "c d"), (2, "x"), (3, ""), (4, "bc"), (5, "abc def"), (6, "f g"), (7, "c d")], "item_id int, passage string")
    want = {(1, 1), (1, 7), (5, 1), (5, 7), (2, 2), (5, 2), (1, 3), (2, 3), (3, 3), (5, 3), (1, 4), (1, 5)}
    for listed in (100, 2):
        found = joins.containment_join(docs, items, "text", "passage", listed=listed).select("doc_id", "item_id").distinct()
        assert {tuple(r) for r in found.collect()} == want


def test_batches_that_run_again_do_not_double(spark, sf_dir):
    from tessera.streaming import streams

    counts = streams.events_stream(spark, sf_dir).select("event_id")
    assert streams.drained(counts, "append").count() == table(spark, sf_dir, "events").count()
    before = spark.conf.get(streams.STATE_STORE)
    streams.stream_state(spark, sf_dir)
    assert spark.conf.get(streams.STATE_STORE) == before


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    from tessera.sources import tables

    def session(master):
        return SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master))

    assert tables.shared_dir(session("local[4]"))
    for master in ("spark://host:7077", "yarn", "local-cluster[2,1,1024]"):
        with pytest.raises(ValueError):
            tables.shared_dir(session(master))


def test_jdbc_table(spark, sf_dir):
    """A table of a database in this process's memory: read in ranges, filters pushed down, null keys and empty tables included."""
    from tessera.sources.formats import jdbc_table

    url, driver = "jdbc:derby:memory:tessera;create=true", "org.apache.derby.jdbc.EmbeddedDriver"
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").unionByName(spark.createDataFrame([(None, 1.0)], "o_orderkey long, o_totalprice double"))
    for name, df in (("orders", orders), ("none_yet", orders.limit(0)), ("single", orders.where("o_orderkey = 7"))):
        df.write.format("jdbc").options(url=url, dbtable=name, driver=driver).save()
        found = jdbc_table(spark, url, name, "o_orderkey", 4, driver=driver)
        assert Counter(map(tuple, found.collect())) == Counter(map(tuple, df.collect()))
        assert found.rdd.getNumPartitions() == (4 if name == "orders" else 1)
    cheap = jdbc_table(spark, url, "orders", "o_orderkey", 4, driver=driver).where("o_totalprice < 5000")
    assert "PushedFilters: [*IsNotNull(o_totalprice), *LessThan(o_totalprice" in plan(cheap)
    assert cheap.count() == orders.where("o_totalprice < 5000").count()
