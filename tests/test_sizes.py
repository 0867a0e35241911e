"""What the work of queries grows with, and rows that cuts would lose."""

import datetime
import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from tessera.functions import python
from tessera.operators import aggregates, edits
from tessera.streaming import streams


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_distinct_value_has_a_sketch(spark, sf_dir):
    """A sketch for each distinct value would be kilobytes for each part of the table."""
    for query, key in ((aggregates.approximate_distinct, "l_partkey"), (aggregates.sketches, "l_suppkey")):
        found = query(spark, sf_dir)
        keyed = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Aggregate" in line] + re.findall(rf".*keys=\[{key}.*", plan(found))
        assert len(keyed) > 2 and not any(f"keys=[{key}" in line and re.search("sketch|hyperlog|approx", line, re.I) for line in keyed)


def test_count_min_sketch_counts_every_row(spark, tmp_path):
    """The sketches query hands on whether its count-min sketch holds all rows that have a part, nulls left out."""
    rows = [(i % 50, None if i == 7 else i % 90, float(i)) for i in range(1000)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_extendedprice double").write.parquet(f"{tmp_path}/lineitem.parquet")
    assert aggregates.sketches(spark, str(tmp_path)).first().asDict() == {"suppliers": 50, "theta_close": True, "kll_close": True, "approx_close": True, "has_counts": True}


def test_sessions_in_any_order_of_files_are_whole(spark, tmp_path):
    """Files out of the order of time, sessions that are open at the end, gaps of just 30 minutes, and events without user or time."""
    at = lambda m, us=0: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m, microseconds=us)
    rng = random.Random(5)
    rows = [(at(rng.randrange(20_000)), rng.choice([1, 2, 3, None])) for _ in range(400)] + [(at(30_000), 7), (at(30_030), 7), (at(30_000, 1), 8), (at(30_030), 8), (at(30_040), 9), (at(30_000), 9), (None, 1), (None, 1)]
    rows.sort(key=lambda r: rng.random())
    for part in range(8):
        spark.createDataFrame(rows[part::8], "ts timestamp_ntz, user_id long").coalesce(1).write.mode("append").parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    found = streams.stream_session(spark, str(tmp_path)).select("user_id", "start", "events")
    assert Counter(map(tuple, found.collect())) == Counter(con.execute(streams.ORACLES["stream_session"]).fetchall())


def test_timed_sessions_keep_sessions_not_times():
    """However many times an open session has, a batch reads and writes its state once, and sets one timer."""

    class Fake:
        value, timers, reads, writes = None, [], 0, 0

        def exists(self):
            return self.value is not None

        def get(self):
            self.reads += 1
            return self.value

        def update(self, value):
            self.writes += 1
            self.value = value

        def clear(self):
            self.value = None

        def getValueState(self, *args):
            return self

        getMapState = getValueState

        def registerTimer(self, at):
            self.timers.append(at)

    class Clock:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

        getExpiryTimeInMs = getCurrentWatermarkInMs

    minute, fake, sessions = 60_000_000, Fake(), streams.TimedSessions()
    sessions.init(fake)
    times = [m * minute for m in range(1000)] + [2000 * minute, 2030 * minute]
    random.Random(1).shuffle(times)
    parts = (pd.DataFrame({"at": times[k::3]}) for k in range(3))
    assert not list(sessions.handleInputRows((5,), parts, Clock(0)))
    assert (fake.writes, fake.timers) == (1, [1029 * 60_000]) and sum(map(len, fake.value[:3])) == 3 * 3 * 8
    late = list(sessions.handleInputRows((5,), iter([pd.DataFrame({"at": [minute, 999 * minute]})]), Clock(1000 * 60_000)))
    assert [list(map(tuple, f.values)) for f in late] == [[(5, "late", minute, minute, 1), (5, "late", 999 * minute, 999 * minute, 1)]]
    (closed,) = sessions.handleExpiredTimer((5,), Clock(1030 * 60_000), Clock(1029 * 60_000))
    assert list(map(tuple, closed.values)) == [(5, "session", 0, 999 * minute, 1000)] and fake.timers[-1] == 2030 * 60_000
    assert [len(f) for f in sessions.handleExpiredTimer((5,), Clock(3000 * 60_000), Clock(2030 * 60_000))] == [2] and fake.value is None


def test_groups_of_an_aggregate_share_calls(spark, tmp_path):
    """A call of Python takes many groups; nulls, no numbers and groups without values are as before."""
    at = datetime.datetime(2024, 1, 1)
    rows = [(i % 700, at + datetime.timedelta(minutes=i % 90), i * 0.37 % 11) for i in range(3000)]
    rows += [(None, at, 1.0), (None, at, 3.5), (1, None, 2.0), (9999, at, None), (9998, at, float("nan")), (9998, at, 1.0), (9998, at, 4.0), (2**60 + 1, at, 1.0)]
    spark.createDataFrame(rows, "user_id long, ts timestamp_ntz, value double").write.parquet(f"{tmp_path}/events.parquet")
    found = python.grouped_aggregate(spark, str(tmp_path))
    groups = {}
    for user, ts, value in rows:
        groups.setdefault((user, ts and ts.replace(minute=0)), []).extend([] if value is None or value != value else [value])
    assert {(r["user_id"], r["hour"]): r["spread"] for r in found.collect()} == {k: round(max(v) - min(v), 6) if v else None for k, v in groups.items()}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [pmod(xxhash64(user_id") + found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [_groupingexpression") == 1


@pytest.mark.parametrize("alphabet, longest, prefix", [("ab", 7, ""), ("01", 6, "Name#"), ("aé𝄞c", 4, "")])
def test_edit_counts_equal_brute_force(spark, alphabet, longest, prefix):
    """Strings of one and of several lengths, runs and alternations, with and without a common part; no pair of names of one length is formed for substitutions."""
    rng = random.Random(7)
    for lengths in ((longest,), range(longest + 1)):
        strings = {prefix + "".join(rng.choice(alphabet) for _ in range(rng.choice(lengths))) + prefix for _ in range(90)}

        def apart(a, b):
            row = list(range(len(b) + 1))
            for i, x in enumerate(a, 1):
                new = [i]
                for j, y in enumerate(b, 1):
                    new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
                row = new
            return row[-1]

        expected = {}
        for a in strings:
            near = Counter(apart(a, b) for b in strings if a != b)
            if near[1] + near[2]:
                expected[a] = (near[1], near[2])
        df = spark.createDataFrame([(s,) for s in [*strings, *strings, None]], "s string")
        assert {r["s"]: (r["one_edit"], r["two_edits"]) for r in edits.edit_counts(df, "s").collect()} == expected
    assert edits.edit_counts(df.limit(0), "s").count() == 0
