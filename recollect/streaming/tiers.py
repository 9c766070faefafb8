"""Keyed state with timers: the sensory buffer and short-term memory of every agent.

Both processors keep what has arrived in state and act only when an event-time
timer fires, that is when the watermark says that nothing older can come.  So
the rows that come out do not depend on how the input was cut into batches, nor on restarts.
Times are whole seconds; activation and importance are whole thousandths, so sums are exact.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import groupby, islice

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor
from pyspark.sql.streaming.stateful_processor import StatefulProcessorHandle

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOUR = 3600
HELD = 100_000  # rows of an agent that are Python objects at once


class Sensory(StatefulProcessor):
    """Rows leave the buffer after ``seconds``, or earlier when ``most`` newer ones have come.

    The ids of a second are written once, in parts of a batch, and read once, when the second leaves; what pushes a row
    out is told by how many rows the next seconds have, which is kept beside.  One timer stands at the first second
    that has not left; when it fires, all seconds that the watermark has passed leave at once.
    """

    def __init__(self, seconds: int, most: int):
        self.seconds, self.most = seconds, most

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.ids = handle.getMapState("ids", "at long, part long", "ids array<long>")
        self.held = handle.getValueState("held", "seconds array<struct<at: long, n: long, parts: long>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        held = {at: [n, parts] for at, n, parts in self.held.get()[0]} if self.held.exists() else {}
        first = None
        while some := list(islice(rows, HELD)):
            new = defaultdict(list)
            for r in some:
                new[r.at].append(r.event_id)
            for at, ids in new.items():
                have = held.setdefault(at, [0, 0])
                self.ids.updateValue((at, have[1]), (ids,))
                have[0] += len(ids)
                have[1] += 1
            first = min(new) if first is None else min(first, *new)
        if first is not None:
            self.held.update(([(at, *held[at]) for at in sorted(held)],))
            self.handle.registerTimer((first + self.seconds) * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # an earlier timer of this batch may have done this second already
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) // 1000
        held = [tuple(s) for s in self.held.get()[0]] if self.held.exists() else []
        due = sum(at + self.seconds <= now for at, _, _ in held)
        if not due:
            return
        if due < len(held):
            self.held.update((held[due:],))
            self.handle.registerTimer((held[due][0] + self.seconds) * 1000)
        else:
            self.held.clear()
        before = 0  # rows of the seconds before this one
        pusher, until = 0, held[0][1]  # the second that holds the row that pushes out, and the rows up to its end
        for at, n, parts in held[:due]:
            ids = []
            for part in range(parts):
                ids += self.ids.getValue((at, part))[0]
                self.ids.removeKey((at, part))
            for i, event_id in enumerate(sorted(ids), before + self.most):
                while pusher < len(held) and i >= until:
                    pusher += 1
                    until += held[pusher][1] if pusher < len(held) else 0
                early = pusher < len(held) and held[pusher][0] <= at + self.seconds
                yield Row(agent=key[0], event_id=event_id, left_at=held[pusher][0] if early else at + self.seconds, reason="overflow" if early else "expired")
            before += n


class ShortTerm(StatefulProcessor):
    """Items of limited number whose activation falls every hour and rises when they are accessed.

    At the end of an hour in which something happened: what arrived in it is applied in
    order (time, id), then the tick lowers activation and promotes.  Quiet hours are
    made up for by lowering it that many times.  A timer stands at the first hour that is
    not done; when it fires, all hours that the watermark has passed are done at once, so
    the state is read and written once a key and batch, not once an hour.
    """

    def __init__(self, capacity: int, decay: int, gain: int):
        self.capacity, self.decay, self.gain = capacity, decay, gain

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pending = handle.getListState("pending", "at long, event_id long, topic string, importance long, access boolean")
        self.memory = handle.getValueState("memory", "tick long, items array<struct<event_id: long, topic: string, importance: long, activation: long, rehearsals: long, promoted: boolean>>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.at, r.event_id, r.topic, r.importance, r.access) for r in rows]
        if new:
            self.pending.appendList(new)
            self.handle.registerTimer((min(r[0] for r in new) // HOUR + 1) * HOUR * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        # an earlier timer of this batch may have done this hour already
        until = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) // 1000 // HOUR * HOUR
        have = sorted(tuple(r) for r in self.pending.get())
        due = [r for r in have if r[0] < until]
        if not due:
            return
        later = have[len(due) :]
        if later:
            self.pending.put(later)
            self.handle.registerTimer((later[0][0] // HOUR + 1) * HOUR * 1000)
        else:
            self.pending.clear()
        before = self.memory.get() if self.memory.exists() else None
        last, items = (before[0], [list(i) for i in before[1]]) if before else (None, [])  # in order of arrival
        for hour, rows in groupby(due, lambda r: r[0] // HOUR):
            tick = (hour + 1) * HOUR
            yield from self._hour(key[0], tick, (tick - last) // HOUR - 1 if last is not None else 0, items, rows)
            last = tick
        self.memory.update((last, [tuple(i) for i in items]))

    def _hour(self, agent, tick: int, quiet: int, items: list[list], rows) -> Iterator[Row]:
        """One hour's rows applied to ``items``, then its tick."""
        for i in items:
            i[3] = max(0, i[3] - self.decay * quiet)
        accessed = 0
        log = []
        for at, event_id, topic, importance, access in rows:
            if access:
                for i in items:
                    if i[1] == topic:
                        i[3] = min(1000, i[3] + self.gain)
                        i[4] += 1
                        accessed += 1
                continue
            if len(items) >= self.capacity:
                weakest = min(range(len(items)), key=lambda n: items[n][3] * items[n][2])
                log.append((items.pop(weakest)[0], "evicted", at))
            items.append([event_id, topic, importance, 1000, 0, importance >= 800])
            if importance >= 800:
                log.append((event_id, "promoted", at))
        for i in items:
            i[3] = max(0, i[3] - self.decay)
            if not i[5] and i[2] >= 600 and i[4] >= 2:
                i[5] = True
                log.append((i[0], "promoted", tick))
        for event_id, change, at in log:
            yield Row(agent=agent, tick=tick, event_id=event_id, change=change, at=at, items=None, activation=None, accessed=None)
        yield Row(agent=agent, tick=tick, event_id=None, change="tick", at=tick, items=len(items), activation=sum(i[3] for i in items), accessed=accessed)


@contextmanager
def rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, which these processors need."""
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _seconds(stream: DataFrame, late: str) -> DataFrame:
    return stream.withWatermark("ts", late).withColumn("at", F.unix_timestamp("ts"))


def sensory_stream(stream: DataFrame, seconds: int = 60, most: int = 100, late: str = "1 hour") -> DataFrame:
    """(agent, event_id, left_at, reason) of every row (agent, ts, event_id) that left its agent's sensory buffer."""
    return _seconds(stream, late).select("agent", "ts", "at", "event_id").groupBy("agent").transformWithState(
        statefulProcessor=Sensory(seconds, most), outputStructType=f"agent {dict(stream.dtypes)['agent']}, event_id long, left_at long, reason string", outputMode="Append", timeMode="EventTime"
    )


def tier_stream(stream: DataFrame, capacity: int = 20, decay: int = 100, gain: int = 200, late: str = "1 hour") -> DataFrame:
    """What happens in each agent's short-term memory, out of rows (agent, ts, event_id, topic, importance, access).

    A row stores an item, or accesses the stored items of its topic.  Out come (agent,
    tick, event_id, change, at, items, activation, accessed): ``evicted`` and
    ``promoted`` items with their time, and a ``tick`` at the end of every hour with rows, with the
    number of items, their activation and the accesses of that hour.
    """
    return _seconds(stream, late).select("agent", "ts", "at", "event_id", "topic", "importance", "access").groupBy("agent").transformWithState(
        statefulProcessor=ShortTerm(capacity, decay, gain),
        outputStructType=f"agent {dict(stream.dtypes)['agent']}, tick long, event_id long, change string, at long, items long, activation long, accessed long",
        outputMode="Append", timeMode="EventTime",
    )
