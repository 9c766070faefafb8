"""Streams with state: restarts, files in parts, timers and the change log."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from recollect.streaming import changes, events, tiers

START = datetime(2024, 1, 1)


def write(spark, folder, rows, schema, name):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}")


def stream_of(spark, folder, schema):
    return spark.readStream.schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(folder)


ITEMS = "agent string, ts timestamp, event_id long, topic string, importance long, access boolean"


def happenings(n=160):
    """Rows of two agents over two days; the second half starts where the first ends."""
    out = []
    for i in range(n):
        at = START + timedelta(minutes=17 * i)
        out.append(("ab"[i % 3 == 0], at, i, f"t{i % 4}", 100 + (i * 37) % 901, i % 5 == 2))
    return out


def by_hand(rows, capacity, until):
    """The same memory in plain Python, hour by hour."""
    log, stores = [], {}
    first = START
    while first + timedelta(hours=1) <= until:
        tick = first + timedelta(hours=1)
        for agent in "ab":
            items = stores.setdefault(agent, [])
            due = [r for r in rows if r[0] == agent and first <= r[1] < tick]
            for _, at, event_id, topic, importance, access in due:
                if access:
                    for i in items:
                        if i["topic"] == topic:
                            i["activation"], i["rehearsals"] = min(1000, i["activation"] + 200), i["rehearsals"] + 1
                    continue
                if len(items) == capacity:
                    gone = min(items, key=lambda i: i["activation"] * i["importance"])
                    items.remove(gone)
                    log.append((agent, gone["id"], "evicted", at))
                items.append({"id": event_id, "topic": topic, "importance": importance, "activation": 1000, "rehearsals": 0, "promoted": importance >= 800})
                if importance >= 800:
                    log.append((agent, event_id, "promoted", at))
            for i in items:
                i["activation"] = max(0, i["activation"] - 100)
                if not i["promoted"] and i["importance"] >= 600 and i["rehearsals"] >= 2:
                    i["promoted"] = True
                    log.append((agent, i["id"], "promoted", tick))
            if due:
                log.append((agent, len(items), sum(i["activation"] for i in items), tick))
        first = tick
    return sorted(log, key=str)


def run_tiers(spark, source, work, capacity):
    with tiers.rocksdb(spark):
        out = events.drain(tiers.tier_stream(stream_of(spark, source, ITEMS), capacity=capacity, late="10 minutes"), work)
    shown = []
    for r in out.collect():
        at = datetime(1970, 1, 1) + timedelta(seconds=r.at)
        shown.append((r.agent, r.items, r.activation, at) if r.change == "tick" else (r.agent, r.event_id, r.change, at))
    return sorted(shown, key=str)


@pytest.mark.parametrize("cuts", [[], [1, 60, 61, 130]])
def test_tiers_do_not_depend_on_files_and_restarts(spark, tmp_path, cuts):
    rows = happenings()
    parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True)]
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    for i, part in enumerate(parts):
        write(spark, source, part, ITEMS, f"p{i}")
        if i in (1, 2):
            assert run_tiers(spark, source, work, 6)  # ends in the middle, and starts again from its checkpoint
    got = run_tiers(spark, source, work, 6)
    assert run_tiers(spark, source, work, 6) == got  # nothing new has come
    want = by_hand(rows, 6, rows[-1][1] - timedelta(minutes=10))
    assert got == want
    assert {"evicted", "promoted"} <= {r[2] for r in got}


def test_sensory_buffer(spark, tmp_path):
    rows = [("a", START + timedelta(seconds=s), i) for i, s in enumerate([0, 1, 2, 3, 70, 71, 200, 400])] + [("b", START, 100), ("b", START + timedelta(seconds=500), 101)]
    source, work = str(tmp_path / "in"), str(tmp_path / "work")
    schema = "agent string, ts timestamp, event_id long"
    write(spark, source, rows[:3], schema, "p0")
    write(spark, source, rows[3:], schema, "p1")
    with tiers.rocksdb(spark):
        out = events.drain(tiers.sensory_stream(stream_of(spark, source, schema), 60, 2, "1 minute"), work)
    base = int((START - datetime(1970, 1, 1)).total_seconds())
    got = sorted((r.agent, r.event_id, r.left_at - base, r.reason) for r in out.collect())
    assert got == [("a", 0, 2, "overflow"), ("a", 1, 3, "overflow"), ("a", 2, 62, "expired"), ("a", 3, 63, "expired"), ("a", 4, 130, "expired"), ("a", 5, 131, "expired"), ("a", 6, 260, "expired"), ("b", 100, 60, "expired")]


def test_latest_restarts(spark, tmp_path):
    schema = "k string, version long, text string"
    source, work = str(tmp_path / "in"), str(tmp_path / "work")

    def run():
        return sorted(tuple(r) for r in events.latest(stream_of(spark, source, schema), ["k"], "version", work).collect())

    write(spark, source, [("a", 1, "x"), ("b", 1, "y")], schema, "p0")
    assert run() == [("a", 1, "x"), ("b", 1, "y")]
    assert run() == [("a", 1, "x"), ("b", 1, "y")]
    write(spark, source, [("a", 3, "z"), ("b", 0, "old"), ("c", 1, None)], schema, "p1")
    write(spark, source, [("a", 2, "late")], schema, "p2")
    assert run() == run() == run() == [("a", 3, "z"), ("b", 1, "y"), ("c", 1, None)]


MEMORY = "id long, memory_type string, updated_at timestamp_ntz, strength double, access_count long, is_active boolean, is_consolidated boolean, merged_into long, note string"


def test_change_log(spark):
    at = START
    old = [(i, "short_term" if i == 8 else "semantic", at, 0.5, 1, True, False, None, None) for i in range(1, 11)]
    later = at + timedelta(hours=1)
    new = [
        (1, "semantic", at, 0.5, 1, True, False, None, None),  # as it was
        (2, "semantic", later, 0.5, 2, True, False, None, None),  # read
        (3, "semantic", later, 0.05, 1, True, False, None, None),  # decayed below the threshold
        (4, "semantic", later, 0.5, 1, True, False, None, "new"),  # a null became a text
        (5, "semantic", later, 0.04, 1, False, False, None, None),  # collected
        (6, "semantic", later, 0.5, 1, False, False, None, None),  # softly deleted
        (7, "semantic", later, 0.5, 1, True, True, None, None),  # promoted
        (8, "short_term", later, 0.5, 1, True, True, 7, None),  # promoted and merged
        (11, "semantic", later, 0.7, 0, True, False, None, None),  # new
        (10, "fact", later, 0.6, 1, True, False, None, None),  # retyped, and stronger
    ]
    before, after = spark.createDataFrame(old, MEMORY), spark.createDataFrame(new, MEMORY)
    got = sorted((r.memory_id or 0, r.event, r.old, r.new) for r in changes.change_log(before, after, "test").collect())
    assert got == [
        (0, "consolidation_completed", None, 14.0), (0, "consolidation_started", None, None), (2, "memory_accessed", 1.0, 2.0), (3, "decay_updated", 0.5, 0.05), (3, "strength_below_threshold", 0.5, 0.05),
        (4, "memory_updated", None, None), (5, "decay_updated", 0.5, 0.04), (5, "memory_garbage_collected", None, None), (5, "strength_below_threshold", 0.5, 0.04), (6, "memory_deleted", 0.5, None),
        (7, "episodic_promoted", None, None), (8, "memory_merged", None, 7.0), (8, "stm_promoted", None, None), (9, "memory_deleted", 0.5, None), (10, "memory_updated", None, None), (11, "memory_created", None, 0.7),
    ]
    assert changes.change_log(before, before, "test").count() == 0
    assert changes.change_log(before.limit(0), before.limit(0), "test").count() == 0


def test_published_log_is_a_stream(spark, tmp_path):
    rows = spark.createDataFrame([(i, "semantic", START + timedelta(minutes=10 * i), 0.5, 1, True, False, None, "x") for i in range(30)], MEMORY)
    first = changes.change_log(rows.limit(0), rows, "load")
    second = changes.change_log(rows, rows.withColumn("strength", F.col("strength") / 2).withColumn("updated_at", F.col("updated_at") + F.expr("INTERVAL 5 HOURS")), "decay")
    folder, work = str(tmp_path / "log"), str(tmp_path / "work")
    changes.publish(first, folder, 1)
    changes.publish(first, folder, 1)
    counts = changes.event_counts(changes.log_stream(first, folder))
    assert events.drain(counts, work).where("event = 'memory_created'").agg(F.sum("n")).first()[0] == 24
    changes.publish(second, folder, 2)
    got = {(r.event, r.total) for r in events.drain(counts, work).groupBy("event").agg(F.sum("n").alias("total")).collect()}
    assert got == {("memory_created", 30), ("consolidation_started", 2), ("consolidation_completed", 1), ("decay_updated", 24)}


class Counted:
    """State of one key in plain Python that counts the ids that are read."""

    def __init__(self):
        self.read, self.timers, self.held, self.parts, self.list = 0, set(), None, {}, []

    def getListState(self, name, schema):
        outer = self

        class State:
            def appendValue(self, row):
                outer.list.append(row)

            def put(self, rows):
                outer.list = list(rows)

            def clear(self):
                outer.list = []

            def get(self):
                outer.read += len(outer.list)
                return iter(outer.list)

        return State()

    def getMapState(self, name, key, value):
        outer = self

        class State:
            def updateValue(self, key, value):
                outer.parts[key] = value

            def getValue(self, key):
                outer.read += len(outer.parts[key][0])
                return outer.parts[key]

            def removeKey(self, key):
                del outer.parts[key]

        return State()

    def getValueState(self, name, schema):
        outer = self

        class State:
            def exists(self):
                return outer.held is not None

            def get(self):
                return outer.held

            def update(self, value):
                outer.held = value

            def clear(self):
                outer.held = None

        return State()

    def registerTimer(self, at):
        self.timers.add(at)


@pytest.mark.parametrize("held", [100_000, 7])
@pytest.mark.parametrize("cuts", [[], [100, 333]])
def test_sensory_buffer_reads_a_row_once(monkeypatch, cuts, held):
    import random
    from types import SimpleNamespace

    monkeypatch.setattr(tiers, "HELD", held, raising=False)
    draw = random.Random(5)
    rows = sorted((draw.choice([3, 4, 5, draw.randrange(300)]) if i < 300 else draw.randrange(200, 900), i) for i in range(600))
    state, out = Counted(), []
    buffer = tiers.Sensory(60, 10)
    buffer.init(state)
    for a, b in zip([0, *cuts], [*cuts, len(rows)], strict=True):
        shuffled = draw.sample(rows[a:b], b - a)
        out += buffer.handleInputRows(("a",), iter([SimpleNamespace(at=at, event_id=i) for at, i in shuffled]), None)
        watermark = rows[b][0] * 1000 - 1 if b < len(rows) else 800_000
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda w=watermark: w)
        while due := sorted(t for t in state.timers if t <= watermark):
            state.timers.remove(due[0])
            out += buffer.handleExpiredTimer(("a",), now, SimpleNamespace(getExpiryTimeInMs=lambda t=due[0]: t))
    want = []
    for n, (at, i) in enumerate(rows):
        pushed = rows[n + 10][0] if n + 10 < len(rows) else 10**9
        want += [(i, pushed, "overflow") if pushed <= at + 60 else (i, at + 60, "expired")] if at + 60 <= 800 else []
    assert sorted((r.event_id, r.left_at, r.reason) for r in out) == sorted(want)
    assert state.read <= len(rows)  # before, each timer read the whole buffer
