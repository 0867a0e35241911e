"""Operators of their own algorithm against brute force on small tables, with ties, nulls, hot groups and plans."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import edits, intervals, nearest, ranks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


# --- ranks


def brute_ranks(values, tiles, descending=False):
    """For each value, nulls least: rank, dense rank, percent rank, cumulative share; and the multiset of (value, number, tile)."""
    key = lambda v: (v is not None, v or 0)
    ordered = sorted(values, key=key, reverse=descending)
    n = len(ordered)
    shared = {}
    for k, v in enumerate(ordered):
        first, dense, _ = shared.get(v, (k + 1, len(shared) + 1, 0))
        shared[v] = (first, dense, k + 1)
    size, longer = divmod(n, tiles)
    ends = [0]
    for t in range(tiles):
        ends.append(ends[-1] + size + (t < longer))
    numbered = Counter((v, k + 1, next(t for t in range(1, tiles + 1) if k < ends[t])) for k, v in enumerate(ordered))
    return {v: (a, b, (a - 1) / max(n - 1, 1), c / n) for v, (a, b, c) in shared.items()}, numbered


@pytest.mark.parametrize("parts", [1, 7])
@pytest.mark.parametrize("kind", ["spread", "hot", "one", "two"])
def test_ranks_equal_brute_force(spark, parts, kind):
    """Ties that fill several parts, in both directions, with nulls."""
    rng = random.Random(7)
    values = {"spread": [rng.randrange(40) for _ in range(200)], "hot": [5] * 150 + [rng.randrange(12) for _ in range(50)], "one": [3] * 60, "two": [1] * 50 + [2] * 50}[kind]
    values += [None] * (9 if kind != "one" else 0)
    df = spark.createDataFrame([(v, "x") for v in values], "v int, row_n string").repartition(4)
    for direction in ("asc", "desc"):
        found = ranks.ranks(df, [("v", direction)], tiles=7, parts=parts)
        assert found.columns == ["v", "row_n", *ranks.FUNCTIONS, "ntile"]
        rows = found.collect()
        shared, numbered = brute_ranks(values, 7, direction == "desc")
        assert len(rows) == len(values)
        for r in rows:
            want = shared[r["v"]]
            assert (r["rank"], r["dense_rank"]) == want[:2]
            assert math.isclose(r["percent_rank"], want[2]) and math.isclose(r["cume_dist"], want[3])
        assert Counter((r["v"], r["row_number"], r["ntile"]) for r in rows) == numbered
        again = ranks.row_numbers(df.select("v"), [("v", direction)], parts=parts)
        assert Counter(map(tuple, again.collect())) == Counter((v, k) for v, k, _ in numbered.elements())


def test_ranks_of_nothing_and_more_tiles_than_rows(spark):
    df = spark.createDataFrame([(2.0,), (float("nan"),), (1.0,)], "v double")
    rows = {r["row_number"]: r for r in ranks.ranks(df, [("v", "asc")], tiles=5).collect()}
    assert [rows[k]["ntile"] for k in (1, 2, 3)] == [1, 2, 3] and rows[1]["v"] == 1.0
    assert ranks.ranks(df.limit(0), [("v", "asc")], tiles=2).count() == 0
    assert ranks.row_numbers(df.limit(0), [("v", "asc")]).count() == 0
    assert ranks.quantiles(df.limit(0), "v", [0.5]).count() == 0


def test_borders_join_runs_over_many_parts():
    """A value that begins at the end of a part, fills two, and ends in a fourth."""
    end = lambda part, n, distinct, last_rank, first_run, first, last: {"part": part, "n": n, "distinct": distinct, "last_rank": last_rank, "first_run": first_run, "first": (first,), "last": (last,)}
    ends = [end(0, 5, 2, 4, 3, 1, 2), end(1, 4, 1, 1, 4, 2, 2), end(2, 4, 1, 1, 4, 2, 2), end(3, 5, 2, 3, 2, 2, 3), end(4, 1, 1, 1, 1, 4, 4)]
    assert ranks._borders(ends) == [(0, 0, 0, 1, 4, 15), (1, 5, 1, 4, 1, 15), (2, 9, 1, 4, 1, 15), (3, 13, 1, 4, 3, 18), (4, 18, 3, 19, 1, 19)]


@pytest.mark.parametrize("parts", [1, 5])
def test_quantiles_equal_brute_force(spark, parts):
    """Groups that hold most rows, one row, nulls only, infinities."""
    rng = random.Random(8)
    rows = [("hot", round(rng.gauss(0, 1), 3)) for _ in range(300)] + [("few", 4.0)] + [("none", None)] + [(None, float(k)) for k in range(4)] + [("end", float("inf")), ("end", 1.0)]
    found = {(r["g"], r["probability"]): r["quantile"] for r in ranks.quantiles(spark.createDataFrame(rows, "g string, v double"), "v", [0.0, 0.3, 0.5, 1.0], ["g"], parts).collect()}
    groups = {}
    for g, v in rows:
        if v is not None:
            groups.setdefault(g, []).append(v)
    want = {}
    for g, own in groups.items():
        own.sort()
        for p in (0.0, 0.3, 0.5, 1.0):
            at = p * (len(own) - 1)
            low, share = int(at), at - int(at)
            want[g, p] = own[low] * (1 - share) + (own[low + 1] * share if share else 0.0)
    assert found.keys() == want.keys() and all(math.isclose(found[k], want[k]) for k in want)


def test_prefix_sums_equal_brute_force(spark):
    rng = random.Random(9)
    rows = [(k, rng.randrange(-5, 9) if k % 7 else None) for k in range(200)]
    found = ranks.prefix_sums(spark.createDataFrame(rows, "k int, v int").repartition(3), [("k", "desc")], ["v"], 6)
    at, want = 0, {}
    for k, v in reversed(rows):
        at += v or 0
        want[k] = at
    assert {r["k"]: r["v"] for r in found.collect()} == want


def test_global_ranks_have_no_window_over_everything(spark, sf_dir, monkeypatch):
    """Windows deal rows by part: no exchange to a single partition but of what is no window, and no percentile of a whole table."""
    seen = []
    monkeypatch.setattr(ranks, "written", lambda df, label, f=ranks.written: (seen.append(plan(df)), f(df, label))[1])
    for name in ("price_ranks", "line_numbers", "price_quantiles"):
        seen.append(plan(ranks.QUERIES[name](spark, sf_dir)))
    windows = [p for p in seen if "Window" in p]
    assert windows and all("Exchange hashpartitioning(__part" in p for p in windows)
    assert not any("SinglePartition" in p and "Window" in p for p in seen)
    assert not any("percentile" in p for p in seen)
    assert any("rangepartitioning" in p for p in seen)


# --- nearest neighbours


def brute_nearest(rows, k, queries):
    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(y * y for y in b)))

    good = {i: v for i, v in rows if i is not None and v is not None and len(v) == 4 and any(v) and all(math.isfinite(x) for x in v)}
    return {q: sorted(((-round(cosine(good[q], v), 9), i) for i, v in good.items() if i != q))[:k] for q in queries if q in good}


def vectors_of(rng, n):
    rows = [(i, [rng.choice([-1.0, 0.0, 1.0, rng.random()]) for _ in range(4)]) for i in range(n)]
    rows += [(n + i, [1.0, 2.0, 0.0, 0.5]) for i in range(n // 2)]  # a third are one vector
    rows += [(n + i, [2.0, 4.0, 0.0, 1.0]) for i in range(n // 2, n // 2 + 5)]  # of one direction with them
    return rows + [(900, None), (901, [0.0] * 4), (902, [1.0]), (903, [float("nan"), 1.0, 1.0, 1.0]), (904, [float("inf"), 0.0, 0.0, 0.0]), (None, [1.0, 0.0, 0.0, 0.0]), rows[0]]


@pytest.mark.parametrize("block, probes, cells", [(8192, 8, None), (7, 1, 9), (7, 2, 1)])
def test_nearest_join_equals_brute_force(spark, monkeypatch, block, probes, cells):
    """Exact for any number of probes, with hot vectors and cells that fill many blocks; vectors without direction are left out."""
    monkeypatch.setattr(nearest, "BLOCK", block)
    monkeypatch.setattr(nearest, "QUERY_BLOCK", block)
    rows = vectors_of(random.Random(11), 80)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 5 = 0 OR vec_id > 890")
    found = nearest.nearest_join(asked, df, 6, probes=probes, cells=cells).collect()
    want = brute_nearest(rows, 6, {i for i, _ in rows if i is not None and (i % 5 == 0 or i > 890)})
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r["query_id"], []).append((-round(r["cosine"], 9), r["id"]))
    assert got.keys() == want.keys()
    for q in want:
        assert [c for c, _ in got[q]] == pytest.approx([c for c, _ in want[q]], abs=1e-6)
        last = want[q][-1][0]
        assert {i for c, i in got[q] if c < last - 1e-9} == {i for c, i in want[q] if c < last - 1e-9}


def test_nearest_join_of_few_or_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.1])], "vec_id long, embedding array<double>")
    assert {(r["query_id"], r["id"], r["rank"]) for r in nearest.nearest_join(df, df).collect()} == {(1, 2, 1), (2, 1, 1)}
    assert nearest.nearest_join(df, df.limit(0)).count() == 0
    assert nearest.nearest_join(df.limit(0), df).count() == 0


def test_recall_without_exact_search(spark, sf_dir):
    """Of the 22 cells, 16 hold at least nine of ten neighbours that the exact join finds, and few probes fewer."""
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    asked = vectors.where("vec_id % 50 = 0")
    exact, some, few = ({(r["query_id"], r["id"]) for r in nearest.nearest_join(asked, vectors, probes=p, exact=e).collect()} for p, e in ((8, True), (16, False), (4, False)))
    assert len(exact) == 10 * asked.count()
    assert len(exact & some) >= 0.9 * len(exact) > len(exact & few)


def test_nearest_join_meets_by_cell(spark, sf_dir, monkeypatch):
    """Blocks meet by an equi-join on cells; nothing is a cross join."""
    seen = []
    monkeypatch.setattr(nearest, "written", lambda df, label, f=nearest.written: (seen.append((label, plan(df))), f(df, label))[1])
    nearest.nearest_vectors(spark, sf_dir)
    assert not any("NestedLoop" in p or "Cartesian" in p for _, p in seen)
    assert all("Join [cell" in p for label, p in seen if label == "nearest-pairs")


# --- edit distance


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y)))
    return row[-1]


@pytest.mark.parametrize("edit, block", [(1, 2048), (2, 2048), (2, 3), (1, 1)])
def test_edit_join_equals_brute_force(spark, edit, block):
    """All edits at all places, strings of no or few characters, repeated ones, beyond ASCII, and hot signatures in blocks."""
    rng = random.Random(12)
    strings = ["", "a", "b", "ab", "ba", "é", "name"] + ["".join(rng.choice("abé") for _ in range(rng.randrange(9))) for _ in range(60)] + [f"key {k:03d}" for k in range(0, 60, 2)]
    df = spark.createDataFrame([(s,) for s in [*strings, *strings[:9], None]], "s string")
    different = sorted(set(strings))
    want = {(a, b, d) for a in different for b in different if a < b and (d := brute_distance(a, b)) <= edit}
    got = [tuple(r) for r in edits.edit_join(df, None, "s", edits=edit, block=block).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    other = different[::3] + ["nam", "zz"]
    two = edits.edit_join(df, spark.createDataFrame([(s,) for s in other], "t string"), "s", "t", edit, block)
    assert sorted(map(tuple, two.collect())) == sorted((a, b, d) for a in different for b in set(other) if (d := brute_distance(a, b)) <= edit)


def test_edit_join_of_names_that_begin_alike_forms_few_pairs(spark):
    """Names of one long beginning: what meets is in proportion to what is similar, and no signature's group is whole in one task."""
    df = spark.createDataFrame([(f"Customer#{k:09d}",) for k in range(400)], "s string")
    found = edits.edit_join(df, None, "s", block=16)
    assert found.count() == sum(brute_distance(f"{a:03d}", f"{b:03d}") <= 2 for a in range(400) for b in range(a))
    assert "NestedLoop" not in plan(found) and "Cartesian" not in plan(found)
    with pytest.raises(ValueError):
        edits.edit_join(df, None, "s", edits=3)
    assert edits.edit_join(df.limit(0), None, "s").count() == 0


# --- intervals


@pytest.mark.parametrize("parts", [1, 4])
@pytest.mark.parametrize("by", [(), ("k",)])
def test_overlap_counts_equal_brute_force(spark, parts, by):
    """Touching, equal, empty, turned and open intervals, and keys that are null."""
    rng = random.Random(13)

    def some(n):
        return [(rng.choice(["a", "b", None]), rng.choice([None, *range(30)]), rng.choice([None, *range(30)])) for _ in range(n)]

    left, right = some(80), some(60) + [("a", 3, 20)] * 30
    schema = "k string, low int, high int"
    found = intervals.overlap_counts(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), "low", "high", by, "n", parts)
    sound = lambda r: None not in r[1:] and r[1] <= r[2]
    want = Counter((*a, sum(sound(a) and sound(b) and a[1] <= b[2] and b[1] <= a[2] and (not by or a[0] == b[0]) for b in right)) for a in left)
    assert Counter(map(tuple, found.collect())) == want
    none = intervals.overlap_counts(spark.createDataFrame(left, schema), spark.createDataFrame([], schema), "low", "high", by, "n", parts)
    assert {r["n"] for r in none.collect()} == {0}


def test_overlap_counts_form_no_pairs(spark, sf_dir, monkeypatch):
    """The sweep has no join of intervals with intervals: rows that are summed are at most two for each interval of either side."""
    seen = []
    monkeypatch.setattr(intervals, "prefix_sums", lambda df, *a, f=intervals.prefix_sums, **b: (seen.append(df), f(df, *a, **b))[1])
    sessions = intervals.user_sessions(spark, sf_dir)
    intervals.overlap_counts(sessions, sessions, "begin", "end").count()
    assert seen[0].count() <= 4 * sessions.count() and "Join" not in plan(seen[0])


# --- heavy hitters


@pytest.mark.parametrize("share, slack", [(0.05, 0.5), (0.2, 0.9), (0.01, 0.1)])
def test_heavy_hitters_equal_brute_force(spark, monkeypatch, share, slack):
    """Shares just above and just at the limit, hidden in one part or spread, nulls, and batches that overflow the counters."""
    from tessera.operators import aggregates

    rng = random.Random(14)
    values = ["hot"] * 500 + [None] * 130 + ["edge"] * 101 + ["at"] * 100 + [f"v{rng.randrange(700)}" for _ in range(1169)]
    assert len(values) == 2000
    last = ["late"] * 150
    rng.shuffle(values)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "97")
    try:
        df = spark.createDataFrame([(v,) for v in values + last], "s string").coalesce(3)
        found = {r["s"]: r["n"] for r in aggregates.heavy_hitters(df, "s", share, slack).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert found == {v: n for v, n in Counter(values + last).items() if n > share * 2150}
    assert aggregates.heavy_hitters(df.limit(0), "s", share).count() == 0


# --- cores


def test_core_numbers_equal_brute_force(spark):
    """Cliques, chains, a hub, loops, repeated and turned edges, and null ends."""
    from tessera.operators import graphs

    rng = random.Random(15)
    edges = [(a, b) for a in range(6) for b in range(a)] + [(5, 10), (10, 11), (11, 12)] + [(100, k) for k in range(20, 60)] + [(rng.randrange(60), rng.randrange(60)) for _ in range(120)]
    edges += [(b, a) for a, b in edges[:10]] + [(3, 3), (200, 200)]
    near = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    want, k = {}, 0
    while near:
        while low := [v for v, n in near.items() if len(n) <= k]:
            for v in low:
                want[v] = k
                for n in near.pop(v):
                    if n in near:
                        near[n].discard(v)
        k += 1
    found = graphs.core_numbers(spark.createDataFrame([*edges, (1, None), (None, 2)], "a int, b int"))
    assert {r["node"]: r["core"] for r in found.collect()} == want
    assert graphs.core_numbers(spark.createDataFrame([], "a int, b int")).count() == 0


# --- patterns


@pytest.mark.parametrize("minutes", [3, 10, 100_000])
def test_matched_patterns_equal_brute_force(spark, minutes):
    """Matches across cells, ties of time, negative times, nulls, and four steps of which two are the same."""
    import datetime

    from tessera.operators import windows

    rng = random.Random(16)
    at = lambda m: datetime.datetime(1970, 1, 1) + datetime.timedelta(minutes=m)
    rows = [(rng.choice([1, 2, None]), rng.randrange(-60, 90), i, rng.choice("abcx")) for i in range(300)]
    df = spark.createDataFrame([(u, at(m) if i % 40 else None, i, kind) for u, m, i, kind in rows], "u int, ts timestamp_ntz, i int, kind string")
    steps = ["a", "b", "b", "c"]
    found = windows.matched_patterns(df, "u", "ts", "i", [F.col("kind") == s for s in steps], minutes)
    good = sorted((u, m, i, kind) for u, m, i, kind in rows if u is not None and i % 40)
    want = set()
    for k, (u, m, i, kind) in enumerate(good):
        if kind != "a":
            continue
        step = 1
        for v, n, _, other in good[k + 1 :]:
            if v != u or n > m + minutes:
                break
            if other == steps[step]:
                step += 1
                if step == 4:
                    want.add((u, at(m), i, at(n)))
                    break
    assert {tuple(r) for r in found.collect()} == want


# --- table functions, pruning, clustering


def test_fill_gaps(spark):
    """Keys that are null, times that are null, both fills, a schema of other types, and arguments that are refused."""
    import datetime

    from tessera.functions.python import FillGaps

    hour = lambda h: datetime.datetime(2024, 1, 1, h)
    rows = [("a", hour(1), 2.5), ("a", hour(4), 1.0), (None, hour(2), 7.0), (None, hour(3), 8.0), ("b", None, 0.5), ("b", hour(9), 6.0)]
    spark.createDataFrame(rows, "k string, t timestamp_ntz, v double").createOrReplaceTempView("gaps")
    spark.udtf.register("fill_gaps", F.udtf(FillGaps))
    for fill, value in (("last", 2.5), ("0", 0.0)):
        found = spark.sql(f"SELECT * FROM fill_gaps(TABLE(gaps), 'k', 't', 'v', 3600, '{fill}')")
        assert found.dtypes == [("k", "string"), ("t", "timestamp_ntz"), ("v", "double"), ("filled", "boolean")]
        want = Counter((k, t, v, False) for k, t, v in rows) + Counter([("a", hour(2), value, True), ("a", hour(3), value, True)])
        assert Counter(map(tuple, found.collect())) == want
    for wrong in ("'k', 'k', 'v'", "'k', 't', 'w'"):
        with pytest.raises(Exception, match="no time|no column"):
            spark.sql(f"SELECT * FROM fill_gaps(TABLE(gaps), {wrong}, 3600, 'last')").collect()


def scanned_files(df):
    """Run the query; the scans of its final plan with how many files each read."""
    df.collect()
    found = []

    def walk(node):
        kind = node.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            return walk(node.executedPlan())
        if kind.endswith("QueryStageExec"):
            return walk(node.plan())
        if kind == "FileSourceScanExec":
            found.append((node.toString(), node.metrics().apply("numFiles").value()))
        children = node.children()
        for k in range(children.size()):
            walk(children.apply(k))

    walk(df._jdf.queryExecution().executedPlan())
    return found


def test_dynamic_pruning_reads_the_joined_partitions(spark, sf_dir):
    """The scan has the other side's keys as a dynamic filter and reads fewer partitions than there are."""
    from tessera.sources import formats

    found = formats.dynamic_pruning(spark, sf_dir)
    assert "dynamicpruning" in plan(found)
    nations = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_nationkey").distinct().count()
    read = [n for text, n in scanned_files(found) if "dynamicpruning" in text]
    assert len(read) == 1 and read[0] < nations


def test_clustered_files_are_skipped_on_either_column(spark, tmp_path):
    """By Z-order, a filter on either column leaves few of the files whose statistics allow a row; sorted by one, the other leaves all. Skewed values and nulls too."""
    import glob

    import pyarrow.parquet as pq

    from tessera.sources import formats

    rng = random.Random(17)
    rows = [(int(rng.paretovariate(1)) if k % 50 else None, rng.randrange(1000), k) for k in range(8000)] + [(1, 1, 1)] * 500
    df = spark.createDataFrame(rows, "a int, b int, c int")
    formats.write_clustered(df, ["a", "b"], f"{tmp_path}/z", 16, 6)
    df.repartitionByRange(16, "b", "c").write.parquet(f"{tmp_path}/sorted")

    def possible(path, column, low, high):
        kept = 0
        for name in glob.glob(f"{tmp_path}/{path}/*.parquet"):
            group = pq.ParquetFile(name).metadata.row_group(0).column("abc".index(column)).statistics
            kept += group.has_min_max and group.min <= high and group.max >= low
        return kept

    assert Counter(map(tuple, spark.read.parquet(f"{tmp_path}/z").collect())) == Counter(rows)
    assert possible("z", "b", 100, 110) <= 10 and possible("z", "a", 20, 30) <= 10
    assert possible("sorted", "a", 20, 30) >= 14
    key = spark.range(1).select(formats.interleaved([F.lit(5), F.lit(3)], 3)).first()[0]
    assert key == 0b100111
