"""Episodes as a stream: the same grouping as operators.episodes, decided as time passes.

Observations of one key wait until no earlier one can still be accepted, and then join, open or merge
episodes in the order of time and id, as a batch would have them. An episode goes out, once, when nothing
can join it any more: after a silence of more than the gap, or when it has lasted for the span. State is
what waits and the open episodes, so a place that is never silent does not grow without bound.

Two bounds on lateness: what is later than `delay` behind the greatest time seen goes out as a row of its
own (LATE) and takes no part; what is later than `drop` is dropped by Spark and counted in its metrics.
A batch over the stored observations (operators.increments) takes in both.

The key must hold together whatever is within the link distance: a component, a site, or a region.
Defined results: rows with a null id, time or coordinate are ignored; equal times go by id; a delivery
that is repeated must be removed before (deduplicated()).
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta
from math import ceil

import numpy as np
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from cindertrace.functions.geo import A, E2
from cindertrace.operators.episodes import Limits, identity
from cindertrace.shipping import ship

POINT = "at double, id long, lon double, lat double"
OPEN = "at double, anchor long, last double, ids array<long>, lon array<double>, lat array<double>, choices int, merges int"
OUT = "kind string, event_id string, anchor long, started_at timestamp, ended_at timestamp, members array<long>, event_ambiguous int, merges int, event_diameter_m double"


def metres(lon: float, lat: float, lons: np.ndarray, lats: np.ndarray) -> np.ndarray:
    """From one point to others nearby."""
    middle = np.radians((lats + lat) / 2)
    w = np.sqrt(1 - E2 * np.sin(middle) ** 2)
    return np.hypot(np.radians(lats - lat) * A * (1 - E2) / w**3, np.radians(lons - lon) * A * np.cos(middle) / w)


class Episode:
    """An open one: when it began, its last time, its observations and their distinct spots."""

    def __init__(self, at: float, anchor: int):
        self.at, self.anchor, self.last = at, anchor, at
        self.ids: list[int] = []
        self.spots: dict[tuple[float, float], None] = {}
        self.choices = self.merges = 0

    @classmethod
    def of(cls, row: tuple) -> Episode:
        """From row()."""
        at, anchor, last, ids, lon, lat, choices, merges = row
        e = cls(at, anchor)
        e.last, e.ids, e.spots, e.choices, e.merges = last, list(ids), dict.fromkeys(zip(lon, lat, strict=True)), choices, merges
        return e

    def row(self) -> tuple:
        lon, lat = zip(*self.spots, strict=True)
        return self.at, self.anchor, self.last, self.ids, list(lon), list(lat), self.choices, self.merges

    def reach(self, lon: float, lat: float) -> np.ndarray:
        own = np.array(list(self.spots))
        return metres(lon, lat, own[:, 0], own[:, 1])

    def spread(self) -> float:
        return max(float(self.reach(*s).max()) for s in self.spots)


def join(open_: list[Episode], at: float, id_: int, lon: float, lat: float, limits: Limits) -> None:
    """One observation, later than all before it, finds its episode among the open ones."""
    gap, span = limits.gap_hours * 3600, limits.span_hours * 3600
    reach = [(e, e.reach(lon, lat)) for e in open_ if at - e.last <= gap and at - e.at <= span]
    touched = [(float(d.min()), float(d.max()), e) for e, d in reach if d.min() <= limits.link_m]
    roomy = sorted(((d, e.at, e.anchor, e) for d, far, e in touched if far <= limits.diameter_m), key=lambda x: x[:3])
    choice = len(touched) > bool(roomy)
    if roomy:
        home = roomy[0][3]
    else:
        home = Episode(at, id_)
        open_.append(home)
    if len(roomy) > 1:
        first, *others = sorted((e for *_, e in roomy), key=lambda e: (e.at, e.anchor))
        union = Episode(at, id_)
        union.spots = {(lon, lat): None} | {s: None for *_, e in roomy for s in e.spots}
        if union.spread() <= limits.diameter_m:
            home, choice = first, False
            for e in others:
                home.ids += e.ids
                home.spots |= e.spots
                home.choices += e.choices
                home.merges += e.merges
                open_.remove(e)
            home.merges += 1
    home.choices += choice
    home.ids.append(id_)
    home.spots[lon, lat] = None
    home.last = at


class Assembly(StatefulProcessor):
    """State of one key: what waits, and the open episodes."""

    def __init__(self, key: str, limits: Limits, ahead: float):
        self.key, self.limits, self.ahead = key, limits, ahead

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting, self.open = handle.getListState("waiting", POINT), handle.getListState("open", OPEN)

    def bound(self, timers) -> float:
        """No observation before this time is taken in any more (seconds)."""
        return timers.getCurrentWatermarkInMs() / 1000 + self.ahead

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        bound, late, new = self.bound(timerValues), [], []
        for r in rows:
            if r["id"] is None or r["acquired_at"] is None or r["lon"] is None or r["lat"] is None:
                continue
            at = r["acquired_at"].timestamp()
            if at < bound:
                late.append(Row(**{self.key: key[0]}, kind="LATE", event_id=None, anchor=r["id"], started_at=r["acquired_at"], ended_at=r["acquired_at"], members=[r["id"]], event_ambiguous=None, merges=None, event_diameter_m=None))
            else:
                new.append((at, r["id"], r["lon"], r["lat"]))
        if new:
            self.waiting.appendList(new)
        yield from late
        yield from self.advance(key, bound)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        yield from self.advance(key, self.bound(timerValues))

    def advance(self, key, bound: float) -> Iterator[Row]:
        """Takes in what waited for the bound, lets closed episodes go, and asks to be called when more is due."""
        from datetime import UTC, datetime

        limits = self.limits
        gap, span = limits.gap_hours * 3600, limits.span_hours * 3600
        waiting = sorted(tuple(r) for r in self.waiting.get())
        open_ = [Episode.of(tuple(r)) for r in self.open.get()]
        for at, id_, lon, lat in waiting:
            if at >= bound:
                break
            join(open_, at, id_, lon, lat, limits)
        left = [w for w in waiting if w[0] >= bound]
        closed = [e for e in open_ if bound - e.last > gap or bound - e.at > span]
        open_ = [e for e in open_ if e not in closed]
        for state, rows in ((self.waiting, left), (self.open, [e.row() for e in open_])):
            state.put(rows) if rows else state.clear()
        due = [w[0] for w in left[:1]] + [min(e.last + gap, e.at + span) for e in open_]
        if due:  # one millisecond after the bound has passed the moment
            self.handle.registerTimer(ceil((min(due) - self.ahead) * 1000) + 1)
        for e in closed:
            yield Row(**{self.key: key[0]}, kind="EPISODE", event_id=identity("event", limits, sorted(e.ids)), anchor=e.anchor, started_at=datetime.fromtimestamp(e.at, UTC), ended_at=datetime.fromtimestamp(e.last, UTC), members=sorted(e.ids), event_ambiguous=e.choices, merges=e.merges, event_diameter_m=e.spread())

    def close(self) -> None:
        pass


def episodes_stream(detections: DataFrame, key: str, limits: Limits = Limits(), delay: timedelta = timedelta(days=7), drop: timedelta = timedelta(days=30)) -> DataFrame:
    """The stream of closed episodes and late observations of detections(key, id, acquired_at, lon, lat)."""
    spark = ship(detections.sparkSession)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    if drop < delay:
        raise ValueError("rows would be dropped before they are late")
    kind = dict(detections.dtypes)[key]
    seen = detections.select(key, "id", "acquired_at", "lon", "lat").withWatermark("acquired_at", f"{int(drop.total_seconds())} seconds")
    return seen.groupBy(key).transformWithState(Assembly(key, limits, (drop - delay).total_seconds()), f"{key} {kind}, {OUT}", "Append", "EventTime")
