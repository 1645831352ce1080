"""Coverage of maps as their events come in, and one alert when a map's coverage unlocks its gap analysis."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from paperloom.operators.usage import METHODOLOGY_BASE, METHODOLOGY_CAP, STALE_PENALTY

ALERT = "map_id bigint, coverage double, ts timestamp"
FEW = 10  # different explored nodes beyond which exploration counts no more


def methodology(comparisons: list[tuple[int, list[int]]]) -> float:
    """What comparisons (seq, works) are worth together, as ``usage.comparison_contribution`` has it for a table of them."""
    seen: dict[int, int] = {}
    several = sorted((seq, works) for seq, works in comparisons if len(works) >= 2)
    for seq, works in several:
        for w in works:
            seen.setdefault(w, seq)
    worth = (max(METHODOLOGY_BASE[min(len(works), 4)] - STALE_PENALTY * sum(seen[w] < seq for w in works), 0.0) for seq, works in several)
    return min(sum(worth), METHODOLOGY_CAP)


class Coverage(StatefulProcessor):
    """The state of a map: whether its timeline was seen, up to ``FEW`` explored nodes, its comparisons, and whether it was told of.

    Comparisons are kept with their order, so that one that comes late makes later ones stale as it
    would have in time. A timer, moved on by every event, clears what was idle for ``idle_ms``.
    """

    def __init__(self, timeline_type: str, node_types: tuple[str, ...], unlock: float, idle_ms: int):
        self.timeline_type, self.node_types, self.unlock, self.idle_ms = timeline_type, node_types, unlock, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.flags = handle.getValueState("flags", "timeline boolean, told boolean, last bigint")
        self.explored = handle.getMapState("explored", "work_id bigint, activity_type string", "there boolean")
        self.compared = handle.getMapState("compared", "comparison_id bigint", "seq bigint, works array<bigint>")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        timeline, told, last = self.flags.get() if self.flags.exists() else (False, False, 0)
        newest = last
        n = sum(1 for _ in self.explored.keys()) if self.explored.exists() else 0
        for part in rows:
            for r in part.itertuples(index=False):
                newest = max(newest, int(r.ts.timestamp() * 1000))
                timeline = timeline or r.activity_type == self.timeline_type
                if r.activity_type in self.node_types and n < FEW and not self.explored.containsKey((int(r.work_id), r.activity_type)):
                    self.explored.updateValue((int(r.work_id), r.activity_type), (True,))
                    n += 1
                if r.work_ids is not None and len(r.work_ids):
                    self.compared.updateValue((int(r.event_id),), (int(r.seq), [int(w) for w in r.work_ids]))
        comparisons = [(v[0], list(v[1])) for v in self.compared.values()] if self.compared.exists() else []
        total = 0.15 * timeline + min(0.30, 0.03 * n) + methodology(comparisons)
        unlocked = not told and round(total, 9) >= self.unlock
        self.flags.update((timeline, told or unlocked, newest))
        if newest > last:
            if last:
                self.handle.deleteTimer(last + self.idle_ms)
            self.handle.registerTimer(newest + self.idle_ms)
        if unlocked:
            yield pd.DataFrame({"map_id": [key[0]], "coverage": [total], "ts": [pd.Timestamp(newest, unit="ms")]})

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for state in (self.flags, self.explored, self.compared):
            state.clear()
        yield from ()

    def close(self) -> None:
        pass


def coverage_alerts(events: DataFrame, timeline_type: str, node_types: list[str], unlock: float = 0.40, idle: str = "30 days") -> DataFrame:
    """(map_id, coverage, ts): an alert for each map, once its coverage reaches ``unlock``.

    ``events``: a stream with a watermark on ts, of event_id, map_id, activity_type, work_id, ts, and for
    comparisons seq (their order in the map) and work_ids. Events later than the watermark are dropped; repeats of
    an event change nothing. A map without events for ``idle`` of event time is forgotten, and told of
    again if it comes back and unlocks again. The state lives in RocksDB, as state with timers asks.
    """
    spark = events.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    columns = events.select("map_id", "event_id", "activity_type", "work_id", "ts", "seq", "work_ids")
    processor = Coverage(timeline_type, tuple(node_types), unlock, int(pd.Timedelta(idle).total_seconds() * 1000))
    return columns.groupBy("map_id").transformWithStateInPandas(processor, ALERT, "Append", "EventTime")
