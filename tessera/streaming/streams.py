"""Structured Streaming: windowed aggregates, deduplication, interval joins and custom state.

Each query drains the events table as a stream (available now) to a Parquet or
callback sink below the shared folder, which ``sources.tables.release`` removes, and returns what arrived as a batch.
"""

from __future__ import annotations

import datetime
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from tessera.sources.tables import scratch, table

STEP_FILES = 4
#: Ranges of time in which sessions' events come.
STEPS = 6
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"


def _folder(spark: SparkSession) -> str:
    return scratch(spark, "stream")


def events_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table, one file or folder, as a stream with event time as a zoned timestamp, which watermarks need."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    # a glob that matches a single file or the files of a folder
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 4).parquet(path if not path.endswith(".parquet") else f"{sf_dir}/events.parquet*")
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def drained(stream: DataFrame, mode: str, folder: str | None = None) -> DataFrame:
    """All that the stream gives: appended rows, or the last state of a complete or updated result, by its batches; with folder, after those of earlier runs there.

    A batch has a folder of its own that it overwrites, so that one that runs again
    after a failure does not count twice.
    """
    spark, schema = stream.sparkSession, stream.schema
    folder, done = folder or _folder(spark), []

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/{number:010d}")
        done.append(number)

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    spark.createDataFrame([], schema).write.mode("overwrite").parquet(f"{folder}/out/none")  # so that a stream without rows has a result too
    if mode == "complete" and done:
        return spark.read.schema(schema).parquet(f"{folder}/out/{max(done):010d}")
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/out")


def _latest(changed: DataFrame, *keys: str) -> DataFrame:
    """Of an updated result, whose counts only grow, each key's last count."""
    return changed.groupBy(*keys).agg(F.max("events").alias("events"))


def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts by type: a batch hands on the windows that it changed, and those that the watermark has passed leave the state."""
    counts = events_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return _latest(drained(counts, "update").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "events"), "start", "event_type")


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of two hours, every hour, as stream_tumbling."""
    counts = events_stream(spark, sf_dir).withWatermark("ts", "1 hour").groupBy(F.window("ts", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return _latest(drained(counts, "update").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "events"), "start")


def in_runs(steps: Iterable[DataFrame], made: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """All rows that the stream appends. Each step's files are added to its input and then a run of their own takes them, as one batch that begins where the last run ended.

    So a step's rows never meet a watermark of their own step, however many files it has. Times (ts) become zoned.
    """
    folder = rows = None
    for step in steps:
        spark, schema = step.sparkSession, step.schema
        folder = folder or _folder(spark)
        step.write.mode("append").parquet(f"{folder}/in")
        stream = spark.readStream.schema(schema).parquet(f"{folder}/in")
        rows = drained(made(stream.withColumn("ts", F.col("ts").cast("timestamp"))), "append", folder)
    return rows


def stream_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of users, each handed on once, when the watermark closes it.

    The events come in STEPS ranges of time, so that none is late in whatever order files hold them. A row of no user, beyond the
    gap and the watermark's delay after the last event, ends the stream: it closes what is still open and stays open itself. Events without
    a time are a session without a begin.
    """
    events = table(spark, sf_dir, "events").select("ts", "user_id")
    timed = events.where("ts IS NOT NULL")
    shares = [i / STEPS for i in range(1, STEPS)]
    borders, last = timed.agg(F.percentile_approx("ts", shares), F.max("ts")).first()
    rows = events.where("ts IS NULL").groupBy("user_id").agg(F.lit(None).cast("timestamp_ntz").alias("start"), F.count(F.lit(1)).alias("events"))
    if last is None:
        return rows
    borders = [F.lit(b) for b in sorted(set(borders))]
    parts = [timed.where((F.col("ts") >= low if low is not None else F.lit(True)) & (F.col("ts") < high if high is not None else F.lit(True))) for low, high in zip([None, *borders], [*borders, None])]
    end = spark.createDataFrame([(last + datetime.timedelta(hours=3), None)], timed.schema)

    def sessions(stream: DataFrame) -> DataFrame:
        return stream.withWatermark("ts", "1 hour").groupBy(F.session_window("ts", "30 minutes").alias("w"), "user_id").agg(F.count(F.lit(1)).alias("events"))

    found = in_runs([*parts, end], sessions)
    return found.select("user_id", F.col("w.start").cast("timestamp_ntz").alias("start"), "events").unionByName(rows)


def stream_distinct(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first event of each user and type within the watermark; here the watermark spans the table."""
    seen = events_stream(spark, sf_dir).withWatermark("ts", "60 days").dropDuplicatesWithinWatermark(["user_id", "event_type"])
    return drained(seen, "append").select("user_id", "event_type")


def stream_interval_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = events_stream(spark, sf_dir)
    views = events.where("event_type = 'view'").select(F.col("event_id").alias("view_id"), "user_id", F.col("ts").alias("view_ts")).withWatermark("view_ts", "1 day")
    buys = events_stream(spark, sf_dir).where("event_type = 'purchase'").select(F.col("event_id").alias("buy_id"), F.col("user_id").alias("buyer"), F.col("ts").alias("buy_ts")).withWatermark("buy_ts", "1 day")
    met = views.join(buys, (F.col("user_id") == F.col("buyer")) & F.col("buy_ts").between(F.col("view_ts"), F.col("view_ts") + F.expr("INTERVAL 2 HOURS")))
    return drained(met, "append").select("view_id", "buy_id")


class Totals(StatefulProcessor):
    """Per user, how many events came and their value, as of each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("totals", "n long, value double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        n, value = self.state.get() if self.state.exists() else (0, 0.0)
        for part in rows:
            n, value = n + len(part), value + float(part["value"].sum())
        self.state.update((n, value))
        yield pd.DataFrame({"user_id": [key[0]], "events": [n], "value": [value]})

    def close(self) -> None:
        pass


def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = events_stream(spark, sf_dir).groupBy("user_id").transformWithStateInPandas(Totals(), "user_id long, events long, value double", "update", "none")
        found = drained(stream, "update")
    finally:
        spark.conf.set(STATE_STORE, before)
    latest = found.groupBy("user_id").agg(F.max_by("value", "events").alias("value"), F.max("events").alias("events"))
    return latest.select("user_id", "events", F.round("value", 4).alias("value"))


class TimedSessions(StatefulProcessor):
    """Sessions per user that event-time timers close, and rows that came too late beside them.

    The state holds a user's open sessions, each as begin, end and number of events, of which a span of time has few, however many events
    come; a batch reads and writes it once a user. One timer is set for when the first of them may end; when the
    watermark has passed it, the sessions that no row can lengthen any more are handed on and leave the state. A row
    behind the watermark changes nothing and is handed on as late. Rows may come in any order within the watermark's delay.
    """

    GAP = 30 * 60_000_000
    COLUMNS = ("user_id", "kind", "begin", "end", "events")

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("sessions", "begins binary, ends binary, events binary, timer long")

    def open(self) -> tuple[np.ndarray, int | None]:
        """Open sessions, in order, as rows of begin, end and events, and the time of the timer that is set, in milliseconds, if one is."""
        if not self.state.exists():
            return np.empty((3, 0), np.int64), None
        *packed, timer = self.state.get()
        return np.stack([np.frombuffer(bytes(p), np.int64) for p in packed]), timer

    def keep(self, sessions: np.ndarray, timer: int | None) -> None:
        """Keep the open sessions, and set a timer for the first that may end unless one is set by then."""
        if not sessions.shape[1]:
            self.state.clear()
            return
        first = -(-(int(sessions[1].min()) + self.GAP) // 1000)
        if timer is None or first < timer:
            self.handle.registerTimer(first)
            timer = first
        self.state.update((*(row.tobytes() for row in sessions), timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed, late = timerValues.getCurrentWatermarkInMs() * 1000, []
        sessions, timer = self.open()
        fresh = False
        for part in rows:
            at = part["at"].to_numpy(np.int64)
            late.append(at[at < passed])
            at = at[at >= passed]
            if len(at):
                sessions, fresh = self.merged(np.concatenate([sessions, [at, at, np.ones_like(at)]], 1)), True
        if fresh:
            self.keep(sessions, timer)
        behind = np.concatenate(late)
        if len(behind):
            yield pd.DataFrame({"user_id": key[0], "kind": "late", "begin": behind, "end": behind, "events": 1})

    def merged(self, sessions: np.ndarray) -> np.ndarray:
        sessions = sessions[:, np.argsort(sessions[0], kind="stable")]
        ends = np.maximum.accumulate(sessions[1])
        first = np.flatnonzero(np.append(True, sessions[0, 1:] - ends[:-1] >= self.GAP))
        return np.stack([sessions[0, first], np.maximum.reduceat(ends, first), np.add.reduceat(sessions[2], first)])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        sessions, timer = self.open()
        over = sessions[1] + self.GAP <= passed
        # the timer is gone once it has fired; one that was set before an earlier one came finds the state as it is
        self.keep(sessions[:, ~over], None if timer is not None and timer <= expiredTimerInfo.getExpiryTimeInMs() else timer)
        if over.any():
            begins, ends, events = sessions[:, over]
            yield pd.DataFrame({"user_id": key[0], "kind": "session", "begin": begins, "end": ends, "events": events})

    def close(self) -> None:
        pass


def in_steps(events: DataFrame, late: Column, borders: list[str]) -> list[DataFrame]:
    """events in steps by time, STEP_FILES files each, of which the last has the late rows."""
    low, steps = F.lit(True), []
    for border in borders:
        high = F.col("ts") < F.lit(border).cast("timestamp_ntz")
        steps.append(events.where(low & high & ~late).repartition(STEP_FILES))
        low = ~high
    return [*steps, events.where(low | late).repartition(STEP_FILES)]


def stream_session_timers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions closed by timers, and the rows of the last step that the watermark had passed."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def sessions(stream: DataFrame) -> DataFrame:
        # the time goes as a number: rows behind a column with a watermark would be dropped before they are seen
        numbers = stream.withWatermark("ts", "1 hour").select("user_id", F.unix_micros("ts").alias("at"))
        return numbers.groupBy("user_id").transformWithStateInPandas(TimedSessions(), "user_id long, kind string, begin long, end long, events long", "append", "eventTime")

    try:
        events = table(spark, sf_dir, "events").select("user_id", "ts", "event_type")
        late = (F.col("ts") < F.lit("2024-01-05").cast("timestamp_ntz")) & (F.col("event_type") == "error")
        rows = in_runs(in_steps(events, late, ["2024-01-20", "2024-01-25"]), sessions)
    finally:
        spark.conf.set(STATE_STORE, before)
    return rows.select("user_id", "kind", *(F.timestamp_micros(c).cast("timestamp_ntz").alias(c) for c in ("begin", "end")), "events")


def stream_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly counts of a stream whose last file has rows of long ago: the watermark has passed their hours, which stay as they were.

    A batch judges lateness by the watermark with which the batch before it ended, hence three steps, each of
    STEP_FILES files that as many tasks write and one batch reads.
    """
    events = table(spark, sf_dir, "events").select("ts", "event_type")
    late = F.expr("ts < TIMESTAMP_NTZ '2024-01-05 00:00:00' AND event_type = 'error'")
    first, second = (F.expr(f"ts < TIMESTAMP_NTZ '2024-01-{day} 00:00:00'") & ~late for day in (20, 25))
    path = f"{_folder(spark)}/in"
    for part in (events.where(first), events.where(second & ~first), events.where(~second)):
        part.repartition(STEP_FILES).write.mode("append").parquet(path)
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", STEP_FILES).parquet(path).withColumn("ts", F.col("ts").cast("timestamp"))
    counts = stream.withWatermark("ts", "1 hour").groupBy(F.window("ts", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("events"))
    return drained(counts, "append").select(F.col("w.start").cast("timestamp_ntz").alias("start"), "events")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "stream_tumbling": stream_tumbling,
    "stream_sliding": stream_sliding,
    "stream_session": stream_session,
    "stream_distinct": stream_distinct,
    "stream_interval_join": stream_interval_join,
    "stream_state": stream_state,
    "stream_late": stream_late,
    "stream_session_timers": stream_session_timers,
}

ORACLES = {
    "stream_session_timers": """
WITH rows AS (
  SELECT *, ts < TIMESTAMP '2024-01-05' AND event_type = 'error' AS late FROM events
), marked AS (
  SELECT *, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM rows WHERE NOT late WINDOW w AS (PARTITION BY user_id ORDER BY ts)
), numbered AS (
  SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts) AS n FROM marked
)
SELECT user_id, 'session' AS kind, min(ts) AS begin, max(ts) AS "end", count(*) AS events FROM numbered GROUP BY user_id, n HAVING max(ts) + INTERVAL 30 MINUTE <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR
UNION ALL SELECT user_id, 'late', ts, ts, 1 FROM rows WHERE late""",
    "stream_late": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, count(*) AS events FROM events WHERE NOT (ts < TIMESTAMP '2024-01-05' AND event_type = 'error') GROUP BY 1 HAVING time_bucket(INTERVAL 1 HOUR, any_value(ts)) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR",
    "stream_tumbling": "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS events FROM events GROUP BY ALL",
    "stream_sliding": "SELECT start, count(*) AS events FROM (SELECT unnest([time_bucket(INTERVAL 1 HOUR, ts), time_bucket(INTERVAL 1 HOUR, ts) - INTERVAL 1 HOUR]) AS start FROM events) GROUP BY 1",
    "stream_session": "SELECT user_id, min(ts) AS start, count(*) AS events FROM (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS s FROM (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events)) GROUP BY user_id, s",
    "stream_distinct": "SELECT DISTINCT user_id, event_type FROM events",
    "stream_interval_join": "SELECT v.event_id AS view_id, b.event_id AS buy_id FROM events v JOIN events b ON v.user_id = b.user_id AND b.ts BETWEEN v.ts AND v.ts + INTERVAL 2 HOUR WHERE v.event_type = 'view' AND b.event_type = 'purchase'",
    "stream_state": "SELECT user_id, count(*) AS events, round(sum(value), 4) AS value FROM events GROUP BY 1",
}
