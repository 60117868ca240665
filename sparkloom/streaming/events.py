"""Structured Streaming over ``events``: windows, watermarks, sessions, duplicates and state.

Each query reads the table as a stream of four parts, runs to the end of what
is there (``availableNow``), stops and goes on from its checkpoint with the next
part, and returns what it has written to the shared folder. On a
cluster the same plans run with a continuous trigger and a lasting sink.
"""

from __future__ import annotations

from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from sparkloom.session import new_folder as shared_folder

QUERIES: dict = {}
ORACLES: dict = {}


@contextmanager
def rocks(spark: SparkSession):
    """The state store that processors with several kinds of state need, for the queries that start inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def visits(events: DataFrame, gap_ms: int, kept: int = 5, delay: str = "10 minutes") -> DataFrame:
    """user_id, visit, start, n, buys, longest_before of each visit: events of a user less than ``gap_ms`` apart.

    A visit is put out once the watermark has passed its end, so each once and in
    order, whatever order its events came in and however often the query stopped.
    """
    rows = events.select("user_id", "ts", (F.col("event_type") == "purchase").alias("buy"), F.unix_micros("ts").alias("us")).withWatermark("ts", delay)
    kind = "user_id long, visit long, start long, n long, buys long, longest_before long"
    return rows.groupBy("user_id").transformWithState(Visits(gap_ms, kept), kind, "append", "EventTime")


class Visits(StatefulProcessor):
    """Open visits and the time of the timer in one value, the number of closed ones in another, the sizes of the last few in a list.

    Each call to the state costs as much as some hundred rows, so a user's open visits are read and written as one, and a
    user has one timer, at the first end, whatever number of visits is open.
    """

    def __init__(self, gap_ms: int, kept: int, buffer: int = 10_000):
        self.gap_ms, self.kept, self.buffer = gap_ms, kept, buffer

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", "timer long, visits array<struct<start: long, last: long, n: long, buys: long>>")
        self.closed = handle.getValueState("closed", "n long")
        self.sizes = handle.getListState("sizes", "n long")

    def end(self, last: int) -> int:
        """Millisecond from which no event can belong to a visit any more."""
        return -(-last // 1000) + self.gap_ms

    def merged(self, visits: list[tuple]) -> list[tuple]:
        """(start, last, n, buys) by start, those less than the gap apart as one."""
        out, gap = [], self.gap_ms * 1000
        for start, last, n, buys in sorted(visits):
            if out and start - out[-1][1] < gap:
                a, b, m, k = out[-1]
                out[-1] = a, max(b, last), m + n, k + buys
            else:
                out.append((start, last, n, buys))
        return out

    def keep(self, timer: int | None, visits: list[tuple]) -> None:
        """The state of open ``visits``, with a timer at the first end, which fires when the watermark is there; ``timer`` is the one set so far."""
        wanted = min((self.end(v[1]) for v in visits), default=None)
        if timer is not None and timer != wanted:
            self.handle.deleteTimer(timer)
        if wanted is not None and timer != wanted:
            self.handle.registerTimer(wanted)
        if visits:
            self.open.update((wanted, visits))
        else:
            self.open.clear()

    def handleInputRows(self, key, rows, timerValues):
        timer, visits = self.open.get() or (None, [])
        visits = [tuple(v) for v in visits]
        for r in rows:
            visits.append((r.us, r.us, 1, int(bool(r.buy))))
            if len(visits) >= 2 * self.buffer:
                visits = self.merged(visits)
                self.buffer = max(self.buffer, len(visits))  # so that a list that stays long isn't sorted for each row
        self.keep(timer, self.merged(visits))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        at = timerValues.getCurrentWatermarkInMs()
        visits = [tuple(v) for v in (self.open.get() or (None, []))[1]]
        ended = [v for v in visits if self.end(v[1]) <= at]
        self.keep(None, [v for v in visits if self.end(v[1]) > at])  # those end later: the timer that fired is taken away after this call, so none may be set at its time
        if ended:
            done = (self.closed.get() or (0,))[0]
            sizes = [x[0] for x in self.sizes.get()] if done else []
            for k, (start, _, n, buys) in enumerate(ended, done + 1):
                yield Row(user_id=key[0], visit=k, start=start, n=n, buys=buys, longest_before=max(sizes, default=None))
                sizes = [*sizes, n][-self.kept :]
            self.closed.update((done + len(ended),))
            self.sizes.put([(x,) for x in sizes])

    def close(self) -> None:
        pass


def query(sql: str | None):
    def add(f):
        if f.__name__ in QUERIES:
            raise ValueError(f"{f.__name__} is registered already")
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


class Feed:
    """``events`` as a stream that comes in parts, by time; after each the query runs to the end of what is there and stops.

    So every query sees several micro-batches, and goes on from its checkpoint as often: what it holds then comes from its state.
    """

    def __init__(self, spark: SparkSession, sf_dir: str, parts: int = 4):
        self.spark, self.folder, self.parts = spark, shared_folder(spark), parts
        self.table = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
        low, high = self.table.agg(F.unix_micros(F.min("ts")), F.unix_micros(F.max("ts"))).first()
        place = (F.unix_micros("ts") - F.lit(low or 0)) * parts / F.lit((high or 0) - (low or 0) + 1)
        self.part = F.coalesce(F.floor(place), F.lit(0))
        self.table.limit(0).write.parquet(self.folder)

    @property
    def rows(self) -> DataFrame:
        return self.spark.readStream.schema(self.table.schema).parquet(self.folder)

    def drain(self, stream: DataFrame, mode: str, last: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
        """The rows written after all parts, through ``last`` if a key can be written more than once."""
        folder = shared_folder(self.spark)
        out = stream.writeStream.outputMode(mode).trigger(availableNow=True).option("checkpointLocation", f"{folder}/offsets")
        if mode == "append":
            out = out.format("parquet").option("path", f"{folder}/rows")
        else:  # each batch is a folder of its own; a batch that runs again replaces what it wrote
            out = out.foreachBatch(lambda df, n: df.withColumn("_batch", F.lit(n)).write.mode("overwrite").parquet(f"{folder}/rows/_batch_number={n}"))
        for k in range(self.parts):
            self.table.where(self.part == k).write.mode("append").parquet(self.folder)
            out.start().awaitTermination()
        schema = stream.schema if mode == "append" else stream.schema.add("_batch", "long")
        rows = self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{folder}/rows")
        return last(rows) if last else rows


@query("SELECT * FROM (SELECT CAST(epoch(time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '1970-01-01')) AS BIGINT) AS start, event_type, count(*) AS n FROM events GROUP BY ALL) WHERE start + 21600 <= (SELECT max(epoch(ts)) - 600 FROM events)")
def stream_tumbling(spark: SparkSession, d: str) -> DataFrame:
    """Closed windows only: those that ended before the watermark, ten minutes behind the latest event."""
    feed = Feed(spark, d)
    w = feed.rows.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return feed.drain(w.select(F.unix_seconds("w.start").alias("start"), "event_type", "n"), "append")


@query("SELECT * FROM (SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts, TIMESTAMP '1970-01-01')) AS BIGINT) - 3600 * k AS start, count(*) AS n FROM events CROSS JOIN (VALUES (0), (1), (2)) v(k) GROUP BY ALL) WHERE start + 10800 <= (SELECT max(epoch(ts)) - 600 FROM events)")
def stream_sliding(spark, d):
    feed = Feed(spark, d)
    w = feed.rows.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "3 hours", "1 hour").alias("w")).agg(F.count("*").alias("n"))
    return feed.drain(w.select(F.unix_seconds("w.start").alias("start"), "n"), "append")


@query("WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e), g AS (SELECT user_id, k, min(epoch_us(ts)) AS start, max(epoch_us(ts)) AS stop, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, start, n FROM g WHERE stop + 21600000000 <= (SELECT max(epoch_us(ts)) - 600000000 FROM events)")
def stream_sessions(spark, d):
    feed = Feed(spark, d)
    w = feed.rows.withWatermark("ts", "10 minutes").groupBy(F.session_window("ts", "6 hours").alias("w"), "user_id").agg(F.count("*").alias("n"))
    return feed.drain(w.select("user_id", F.unix_micros("w.start").alias("start"), "n"), "append")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_deduplicate(spark, d):
    """Each event twice in the stream, once in the result."""
    feed = Feed(spark, d)
    e = feed.rows
    doubled = e.select("event_id", "event_type", "ts", F.explode(F.array(F.lit(1), F.lit(2))).alias("copy"))
    unique = feed.drain(doubled.withWatermark("ts", "1 hour").dropDuplicatesWithinWatermark(["event_id"]).select("event_id", "event_type"), "append")
    return unique.groupBy("event_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL")
def stream_complete(spark, d):
    """Totals without a watermark, complete after each batch; the last batch counts."""
    feed = Feed(spark, d)
    e = feed.rows.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    final = lambda rows: rows.groupBy("event_type", "user_id").agg(F.max_by("n", "_batch").alias("n")).groupBy("event_type").agg(F.sum("n").alias("n"), F.count("*").alias("users"))
    return feed.drain(e, "complete", final)


@query("SELECT user_id, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total FROM events GROUP BY ALL")
def stream_user_state(spark, d):
    """Running count and total (in cents) of each user, kept in state of our own."""

    feed = Feed(spark, d)
    def update(key, batches, state):
        import pandas as pd

        n, cents = state.get if state.exists else (0, 0)
        for b in batches:
            n, cents = n + len(b), cents + int((b["value"] * 100).round().sum())
        state.update((n, cents))
        yield pd.DataFrame({"user_id": [key[0]], "n": [n], "cents": [cents]})

    e = feed.rows.select("user_id", "value").groupBy("user_id").applyInPandasWithState(update, "user_id long, n long, cents long", "n long, cents long", "update", "NoTimeout")
    final = lambda rows: rows.groupBy("user_id").agg(F.max_by(F.struct("n", "cents"), "_batch").alias("x")).select("user_id", "x.n", (F.col("x.cents") / 100).alias("total"))
    return feed.drain(e, "update", final)


@query("SELECT a.event_id, r.r_name FROM events a JOIN nation ON a.user_id % 25 = n_nationkey JOIN region r ON n_regionkey = r_regionkey WHERE a.event_type = 'purchase'")
def stream_static_join(spark, d):
    """A stream beside tables of fixed size."""
    feed = Feed(spark, d)
    places = spark.read.parquet(f"{d}/nation.parquet").join(spark.read.parquet(f"{d}/region.parquet"), F.expr("n_regionkey = r_regionkey")).select("n_nationkey", "r_name")
    e = feed.rows.where("event_type = 'purchase'")
    return feed.drain(e.join(F.broadcast(places), F.expr("user_id % 25 = n_nationkey")).select("event_id", "r_name"), "append")


_BUCKET = "CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600"
_MIDDLE = f"(SELECT CAST(floor((min(epoch(ts)) + max(epoch(ts))) / 2 / 21600) AS BIGINT) * 21600 FROM events)"


@query(f"SELECT * FROM (SELECT {_BUCKET} AS start, event_type, count(*) AS n FROM events WHERE epoch(ts) >= {_MIDDLE} GROUP BY ALL) WHERE start + 21600 <= (SELECT max(epoch(ts)) - 600 FROM events)")
def stream_late_rows(spark, d):
    """The later half of the time first, then two parts of rows that come too late and are dropped."""
    feed = Feed(spark, d)
    rows = spark.read.parquet(f"{d}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    low, high = (F.unix_seconds(f("ts")) for f in (F.min, F.max))
    middle = rows.agg((F.floor((low + high) / 2 / 21600) * 21600).alias("m")).first().m
    late = F.unix_seconds("ts") < middle
    feed = Feed(spark, d, 3)
    feed.part = F.when(late, 1 + F.col("event_id") % 2).otherwise(0)
    w = feed.rows.withWatermark("ts", "10 minutes").groupBy(F.window("ts", "6 hours").alias("w"), "event_type").agg(F.count("*").alias("n"))
    return feed.drain(w.select(F.unix_seconds("w.start").alias("start"), "event_type", "n"), "append")


GAP_MS = 6 * 3600 * 1000


@query(
    """WITH e AS (SELECT user_id, ts, event_type, CASE WHEN ts - lag(ts) OVER w >= INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM e),
    g AS (SELECT user_id, k, min(epoch_us(ts)) AS start, max(epoch_us(ts)) AS stop, count(*) AS n, count(CASE WHEN event_type = 'purchase' THEN 1 END) AS buys FROM s GROUP BY ALL),
    c AS (SELECT * FROM g WHERE stop + 21600000000 <= (SELECT max(epoch_us(ts)) - 600000000 FROM events))
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY start) AS visit, start, n, buys, max(n) OVER (PARTITION BY user_id ORDER BY start ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING) AS longest_before FROM c"""
)
def stream_visits(spark, d):
    """Closed visits of each user, with their number and the longest of the five before: state of our own, closed by event-time timers."""
    feed = Feed(spark, d)
    with rocks(spark):
        return feed.drain(visits(feed.rows, GAP_MS), "append")
