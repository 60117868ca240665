"""The state processor on events that come out of order, over a stopped and resumed query."""

import random

from pyspark.sql import Row

from sparkloom.session import new_folder
from sparkloom.streaming.events import Visits, rocks, visits


def test_visits_out_of_order(spark):
    rng, hour = random.Random(5), 3_600_000_000
    rows, start = [], 1_700_000_000_000_000
    for user in range(6):
        at = start
        for _ in range(40):
            at += rng.choice([1, 2, 3, 9, 30]) * hour // 2 + rng.randint(0, 1000)
            rows.append((user, at, rng.choice(["purchase", "view"])))
    rows += [(99, max(r[1] for r in rows) + 1000 * hour, "view")]  # closes all the others
    first = min(r[1] for r in rows)
    parts = [[], [], []]
    for r in rows:  # up to a day late
        parts[min(2, max(0, (r[1] - first) // (150 * hour) - rng.randint(0, 1)))].append(r) if r[0] < 99 else parts[2].append(r)
    folder, out = new_folder(spark), new_folder(spark)
    spark.createDataFrame([], "user_id long, us long, event_type string").write.parquet(folder)
    for part in parts:
        rng.shuffle(part)
        spark.createDataFrame(part, "user_id long, us long, event_type string").write.mode("append").parquet(folder)
        stream = spark.readStream.schema("user_id long, us long, event_type string").parquet(folder).selectExpr("user_id", "timestamp_micros(us) AS ts", "event_type")
        with rocks(spark):
            query = visits(stream, 6 * 3_600_000, kept=2, delay="400 hours").writeStream.outputMode("append").trigger(availableNow=True)
            query.option("checkpointLocation", f"{out}/offsets").format("parquet").option("path", f"{out}/rows").start().awaitTermination()
    want = set()
    for user in range(6):
        mine, closed = sorted(r[1:] for r in rows if r[0] == user), []
        for at, kind in mine:
            if closed and at - closed[-1][1] < 6 * hour:
                closed[-1][1:] = [at, closed[-1][2] + 1, closed[-1][3] + (kind == "purchase")]
            else:
                closed.append([at, at, 1, int(kind == "purchase")])
        want |= {(user, k + 1, v[0], v[2], v[3], max((x[2] for x in closed[max(0, k - 2) : k]), default=None)) for k, v in enumerate(closed)}
    got = [tuple(r) for r in spark.read.parquet(f"{out}/rows").collect()]
    assert len(got) == len(want) and set(got) == want


def test_visit_that_ends_at_the_watermark(spark):
    """Closed when the watermark is at its end, not a millisecond earlier; a visit that waits is closed later, once."""
    gap, start = 6 * 3_600_000_000, 1_700_000_000_000_000
    parts = [[(1, start, "view"), (2, start + 1000, "purchase"), (9, start + gap, "view")], [(9, start + gap + 1000, "view")], [(9, start + 100 * gap, "view")]]
    folder, out, kind = new_folder(spark), new_folder(spark), "user_id long, us long, event_type string"
    spark.createDataFrame([], kind).write.parquet(folder)
    seen = []
    for part in parts:
        spark.createDataFrame(part, kind).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(kind).parquet(folder).selectExpr("user_id", "timestamp_micros(us) AS ts", "event_type")
        with rocks(spark):
            query = visits(stream, gap // 1000, delay="0 seconds").writeStream.outputMode("append").trigger(availableNow=True)
            query.option("checkpointLocation", f"{out}/offsets").format("parquet").option("path", f"{out}/rows").start().awaitTermination()
        seen.append(sorted(r.user_id for r in spark.read.schema("user_id long").parquet(f"{out}/rows").collect()))
    assert seen == [[1], [1, 2], [1, 2, 9]]


class Cell:
    """A value or list of the state in memory; calls are counted."""

    def __init__(self, calls):
        self.calls, self.held = calls, None

    def get(self):
        self.calls.append("get")
        return self.held if not isinstance(self.held, list) else iter(self.held)

    def update(self, value):
        self.calls.append("update")
        self.held = value

    put = update

    def clear(self):
        self.update(None)


class Handle:
    def __init__(self):
        self.calls, self.timers = [], set()

    def getValueState(self, name, schema):
        return Cell(self.calls)

    getListState = getMapState = getValueState

    def registerTimer(self, at):
        self.calls.append("timer")
        self.timers.add(at)

    def deleteTimer(self, at):
        self.calls.append("timer")
        self.timers.discard(at)


def test_calls_to_the_state_do_not_grow_with_visits():
    handle, gap, n = Handle(), 1000, 5000
    processor = Visits(gap, 3, buffer=64)
    processor.init(handle)
    rows = [Row(us=k * 10_000_000 + 1000 * j, buy=j == 0) for k in range(n) for j in range(2)]
    random.Random(1).shuffle(rows)
    now = lambda ms: type("Now", (), {"getCurrentWatermarkInMs": lambda self: ms})()
    list(processor.handleInputRows((7,), iter(rows[: n // 2]), now(0)))
    list(processor.handleInputRows((7,), iter(rows[n // 2 :]), now(0)))
    assert len(handle.timers) == 1
    got = list(processor.handleExpiredTimer((7,), now(10**12), None))
    assert [(r.visit, r.start, r.n, r.buys, r.longest_before) for r in got] == [(k + 1, k * 10_000_000, 2, 1, 2 if k else None) for k in range(n)]
    assert len(handle.calls) < 20
