"""Convex hulls of groups of any size, and the greatest distance within a group.

A task keeps the hull of what it has read of each group, never the points; the tasks' hulls of a group
are merged into one. The farthest two points of a group are corners of its hull.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from cindertrace.functions.geo import A, E2
from cindertrace.operators.groups import each_group
from cindertrace.shipping import ship

#: Points that a task holds before it reduces them to hulls.
HELD = 1 << 18
POINT = pa.struct([("lon", pa.float64()), ("lat", pa.float64())])


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the hull of rows of (x, y), counter-clockwise from the least."""
    points = np.unique(points, axis=0)
    if len(points) > 32:  # what lies inside the polygon of eight extreme points is no corner
        ways = points @ np.array([[1, 0], [1, 1], [0, 1], [-1, 1], [-1, 0], [-1, -1], [0, -1], [1, -1]]).T
        ring = points[ways.argmax(axis=0)]
        side = np.roll(ring, -1, axis=0) - ring
        inner = np.all(side[:, 0] * (points[:, None, 1] - ring[:, 1]) - side[:, 1] * (points[:, None, 0] - ring[:, 0]) > 1e-12 * np.abs(side).sum(axis=1), axis=1) if (side != 0).any(axis=1).all() else np.zeros(len(points), bool)
        points = points[~inner]
    rows = [tuple(p) for p in points.tolist()]
    if len(rows) < 2:
        return points
    sides: list[list] = [[], []]
    for side, run in zip(sides, (rows, rows[::-1]), strict=True):
        for p in run:
            while len(side) > 1 and (side[-1][0] - side[-2][0]) * (p[1] - side[-2][1]) <= (side[-1][1] - side[-2][1]) * (p[0] - side[-2][0]):
                side.pop()
            side.append(p)
    return np.array(sides[0][:-1] + sides[1][:-1])


def hulls(points: DataFrame, key: str) -> DataFrame:
    """key, hull (array of (lon, lat), not closed) of points(key, lon, lat); rows with a null are left out."""
    ship(points.sparkSession)
    rows = points.select(key, "lon", "lat").dropna()
    kind = dict(rows.dtypes)[key]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []

        def reduced() -> pa.Table:
            t = pa.concat_tables(held).sort_by(key)
            names = t.column(key).combine_chunks()
            code = names.dictionary_encode().indices.to_numpy()
            at = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
            xy = np.stack([t.column(c).to_numpy() for c in ("lon", "lat")], axis=1)
            own = [hull(xy[a:z]) for a, z in zip(at, np.append(at[1:], len(xy)), strict=True)]
            every = np.concatenate(own)
            return pa.table({key: names.take(pa.array(np.repeat(at, [len(h) for h in own]))), "lon": every[:, 0], "lat": every[:, 1]})

        for b in batches:
            if b.num_rows:
                held.append(pa.Table.from_batches([b]))
            if sum(t.num_rows for t in held) >= HELD:
                done = reduced()
                held = [done]
                if done.num_rows >= HELD // 2:  # many groups: they go on as they are
                    yield from done.to_batches()
                    held = []
        if held:
            yield from reduced().to_batches()

    def merged(t: pa.Table) -> dict:
        own = hull(np.stack([t.column(c).to_numpy() for c in ("lon", "lat")], axis=1))
        return {key: [t.column(key)[0].as_py()], "hull": [[{"lon": x, "lat": y} for x, y in own.tolist()]]}

    schema = pa.schema([(key, pa.string() if kind == "string" else pa.int64()), ("hull", pa.list_(POINT))])
    some = rows.mapInArrow(partial, f"{key} {kind}, lon double, lat double")
    return each_group(some, [key], ["lon", "lat"], merged, schema, f"{key} {kind}, hull array<struct<lon:double,lat:double>>")


def diameter_m(hull_: Column) -> Column:
    """The greatest distance between two corners of a hull, as geo.distance_m measures it."""
    from pyspark.sql.functions import arrow_udf

    def metres(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        middle = np.radians((a[:, None, 1] + b[None, :, 1]) / 2)
        w = np.sqrt(1 - E2 * np.sin(middle) ** 2)
        degree = np.pi / 180 * A
        return np.hypot((a[:, None, 1] - b[None, :, 1]) * degree * (1 - E2) / w**3, (a[:, None, 0] - b[None, :, 0]) * degree * np.cos(middle) / w)

    @arrow_udf("double")
    def widest(rows: pa.Array) -> pa.Array:
        out = []
        for own in rows:
            if not own.is_valid:
                out.append(None)
                continue
            corners = np.stack([own.values.field(c).to_numpy() for c in ("lon", "lat")], axis=1)
            out.append(max((float(metres(corners[i : i + 512], corners).max()) for i in range(0, len(corners), 512)), default=0.0))
        return pa.array(out, pa.float64())

    return widest(hull_)
