"""Files, requests, maps, runs and shapes: cases with known answers, and brute force."""

import json
from datetime import date, datetime, timedelta
from hashlib import sha256
from math import pi

import numpy as np
import pytest
from pyspark.sql import functions as F

from cindertrace.functions import geo
from cindertrace.operators import cases, features, groups, landcover, ranks, runs
from cindertrace.sources import detections, exports, mapped, requests

T0 = datetime(2026, 3, 4, 5)
HEADER = ",".join(detections.COLUMNS)
ROW = "22.3,69.8,310,0.4,0.5,2026-01-02,905,N20,VIIRS,n,2.0NRT,295,0,D"


def test_rows_of_a_file(spark, tmp_path):
    (tmp_path / "a.csv").write_text("﻿" + HEADER + ",type\r\n" + "\n".join([ROW + ",0", ROW, ROW + ",7", ROW + ",0,1", ROW + ","]) + "\n")
    rows = detections.read_csv(spark, str(tmp_path / "a.csv"))
    v = detections.validate(rows, "N20", "2026-01-01", 3, (69.5, 22.0, 70.5, 23.0))
    assert [(r["row_number"], r["reason"]) for r in v.orderBy("row_number").collect()] == [(2, None), (3, "RAGGED_ROW"), (4, "INVALID_TYPE"), (5, "RAGGED_ROW"), (6, None)]
    for name, head in (("b", HEADER + ",frp"), ("c", "latitude,longitude")):
        (tmp_path / f"{name}.csv").write_text(head + "\n")
        with pytest.raises(ValueError):
            detections.read_csv(spark, str(tmp_path / f"{name}.csv"))


def test_requests():
    box = requests.Box.parse("69.5,22,70.5,23")
    r = requests.Request(box, date(2026, 1, 30), 3, limit=100, offset=9950)
    assert r.end == date(2026, 2, 2) and r.next_offset(20_000) is None and requests.Request(box, date(2026, 1, 1), 1).next_offset(101) == 100 and requests.Request(box, date(2026, 1, 1), 1).next_offset(100) is None
    for bad in (lambda: requests.Box(0, 0, 6, 1), lambda: requests.Box(1, 0, 1, 1), lambda: requests.Box.parse("1,2,3"), lambda: requests.Request(box, date(2026, 1, 1), 32), lambda: requests.Request(box, date(2026, 1, 1), 1, "X"), lambda: requests.guard_name("Bad Name")):
        with pytest.raises(ValueError):
            bad()
    today = date(2026, 1, 5)
    requests.guard_ingest("LIVE", "PROVIDER", today, today)
    for args in (("LIVE", "FILE", today, today), ("HISTORICAL_REPLAY", "PROVIDER", today, today), ("LIVE", "PROVIDER", today + timedelta(1), today), ("LIVE", "PROVIDER", today, today, "a", "b"), ("LIVE", "PROVIDER", today, today, None, None, "key=s3cret", "s3cret")):
        with pytest.raises(ValueError):
            requests.guard_ingest(*args)


def test_exports_are_refused_not_cut(spark, tmp_path):
    rows = spark.createDataFrame([(float(k), 1.0, f"n{k}") for k in range(3)], "lon double, lat double, name string")
    whole = json.loads(exports.feature_collection(rows, 3))
    assert whole["type"] == "FeatureCollection" and len(whole["features"]) == 3
    with pytest.raises(ValueError):
        exports.feature_collection(rows, 2)
    first = exports.put_once(spark, str(tmp_path), b"abc", ".csv")
    assert exports.put_once(spark, str(tmp_path), b"abc", ".csv") == first and first.endswith(sha256(b"abc").hexdigest() + ".csv")
    open(first, "wb").write(b"abd")
    for crc in tmp_path.rglob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError):
        exports.put_once(spark, str(tmp_path), b"abc", ".csv")
    files = spark.createDataFrame([("b", "2"), ("a", "1")], "path string, sha256 string")
    assert exports.manifest_digest(files) == sha256(b"a 1\nb 2").hexdigest()


def test_runs_are_kept_and_known_again(spark, tmp_path):
    rows = [(k, T0 + timedelta(hours=k), 70.0, 22.0 + 0.0001 * k, "NRT") for k in range(6)]
    df = spark.createDataFrame(rows, "obs_id long, acquired_at timestamp, lon double, lat double, product string")
    one = runs.build(df, str(tmp_path))
    assert one["status"] == "SUCCEEDED" and runs.build(df.orderBy(F.desc("obs_id")), str(tmp_path)) == {"run_id": one["run_id"], "status": "UNCHANGED", "inputs": 6}
    two = runs.build(df.filter("obs_id < 5"), str(tmp_path))
    assert two["status"] == "SUCCEEDED" and spark.read.parquet(f"{tmp_path}/runs").count() == 2
    assert spark.read.parquet(f"{tmp_path}/members/{two['run_id']}").count() == 5
    mixed = df.withColumn("product", F.when(F.col("obs_id") == 3, "SP").otherwise("NRT"))
    for bad in (mixed, df.limit(0), spark.range(20_001).select(F.col("id").alias("obs_id"), F.lit(T0).alias("acquired_at"), F.lit(70.0).alias("lon"), F.lit(22.0).alias("lat"), F.lit("NRT").alias("product"))):
        with pytest.raises(ValueError):
            runs.build(bad, str(tmp_path))


def ring(x, y, r):
    return [(x + a * r, y + b * r) for a, b in ((-1, -1), (1, -1), (1, 1), (-1, 1), (-1, -1))]


def test_overlap_of_circles_and_areas(spark):
    """Against points thrown at the circle; a ring inside another is a hole."""
    shapes = {"whole": [ring(0, 0, 0.1)], "half": [[(0, -0.1), (0.1, -0.1), (0.1, 0.1), (0, 0.1), (0, -0.1)]], "inside": [ring(0.001, 0.002, 0.002)], "hole": [ring(0, 0, 0.1), ring(0.002, 0, 0.003)], "apart": [ring(0.5, 0, 0.1)], "corner": [ring(0.008, 0.007, 0.006)], "triangle": [[(-0.01, -0.002), (0.012, 0.001), (0.001, 0.015), (-0.01, -0.002)]]}
    floats = [(k, [[(float(x), float(y)) for x, y in r] for r in rings]) for k, rings in shapes.items()]
    df = spark.createDataFrame(floats, "k string, rings array<array<struct<lon:double,lat:double>>>")
    got = {r["k"]: r["x"] for r in df.select("k", geo.circle_overlap(F.lit(0.0), F.lit(0.0), F.lit(800.0), F.col("rings")).alias("x")).collect()}
    rng = np.random.default_rng(1)
    p = rng.uniform(-800, 800, (60_000, 2))
    p = p[(p**2).sum(axis=1) <= 800**2]
    x, y = p[:, 0] / (pi / 180 * 6378137.0), p[:, 1] / (pi / 180 * 6378137.0 * (1 - 0.00669437999014))
    for k, rings in shapes.items():
        odd = np.zeros(len(p), int)
        for r in rings:
            for (ax, ay), (bx, by) in zip(r, r[1:]):
                if ay != by:
                    odd += ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
        assert got[k] == pytest.approx((odd % 2).mean(), abs=0.01), k
    assert got["whole"] == pytest.approx(1) and got["apart"] == pytest.approx(0, abs=1e-9) and got["half"] == pytest.approx(0.5)


def test_hulls(spark):
    rng = np.random.default_rng(2)
    sets = {0: [(1.0, 2.0)] * 3, 1: [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0)], 2: [(0.0, 0.0), (4.0, 0.0), (4.0, 2.0), (0.0, 2.0), (1.0, 1.0), (2.0, 0.0)]} | {k: [tuple(map(float, p)) for p in rng.integers(0, 9, (25, 2))] for k in range(3, 9)}
    df = spark.createDataFrame([(k, v) for k, v in sets.items()], "k int, p array<struct<lon:double,lat:double>>").withColumn("h", geo.convex_hull(F.col("p"))).withColumn("c", geo.hull_centroid(F.col("h")))
    for r in df.collect():
        h, points = [(p["lon"], p["lat"]) for p in r["h"]], set(sets[r["k"]])
        cross = lambda a, b, c: (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
        if len(h) > 2:
            assert all(cross(a, b, p) >= 0 for a, b in zip(h, h[1:] + h[:1]) for p in points)
            assert all(cross(a, b, c) > 0 for a, b, c in zip(h, h[1:] + h[:1], h[2:] + h[:2]))
        assert set(h) <= points and h[0] == min(points)
    found = {r["k"]: (len(r["h"]), r["c"]["lon"], r["c"]["lat"]) for r in df.collect()}
    assert found[0] == (1, 1, 2) and found[1] == (2, 1, 1) and found[2] == (4, 2, 1)


def test_rings_from_lines(spark):
    a, b, c, d = (0.0, 0.0), (2.0, 0.0), (2.0, 2.0), (0.0, 2.0)
    lines = {"any way": [[a, b], [d, c], [d, a], [c, b]], "two": [[a, b, c, d, a], [(5.0, 5.0), (6.0, 5.0), (5.0, 6.0), (5.0, 5.0)]], "open": [[a, b], [b, c]], "one point": [[a]], "none": []}
    df = spark.createDataFrame(list(lines.items()), "k string, l array<array<struct<lon:double,lat:double>>>")
    got = {r["k"]: r["r"] for r in df.select("k", mapped.stitched(F.col("l")).alias("r")).collect()}
    assert [len(got[k] or []) for k in lines] == [1, 2, 0, 0, 0] and len(got["any way"][0]) == 5


def test_elements_that_cannot_be_used(spark):
    line = lambda *p: [{"lon": x, "lat": y} for x, y in p]
    way = lambda *p: {"type": "way", "role": "outer", "geometry": line(*p)}
    e = [
        {"type": "way", "id": 1, "tags": {}, "geometry": line((0, 0), (1, 1), (2, 2), (3, 3), (0, 0))}, {"type": "way", "id": 2, "tags": {}, "geometry": line((0, 0), (200, 0), (200, 1), (0, 0))}, {"type": "node", "id": 3, "lat": 95.0, "lon": 0.0, "tags": {}},
        {"type": "relation", "id": 4, "tags": {"type": "multipolygon"}, "members": [way((0, 0), (1, 0)), way((1, 1), (1, 0)), way((0, 0), (1, 1))]}, {"type": "relation", "id": 5, "tags": {"type": "multipolygon"}, "members": [way((0, 0), (1, 0)), way((1, 1), (2, 0))]},
        {"type": "relation", "id": 6, "tags": {"type": "multipolygon"}, "members": [way((0, 0), (1, 0), (1, 1), (0, 0)), {"type": "way", "role": "inner"}]}, {"type": "relation", "id": 7, "tags": {"type": "route"}, "members": [way((0, 0), (1, 0))]},
    ]
    got = {r["id"]: (r["reason"], r["rings"]) for r in mapped.elements(spark.createDataFrame([(json.dumps({"elements": e}),)], "json string")).collect()}
    assert [got[k][0] for k in range(1, 8)] == ["INVALID_GEOMETRY", "COORDINATE_OUT_OF_RANGE", "COORDINATE_OUT_OF_RANGE", None, "OPEN_RING", "INCOMPLETE_RELATION", "UNSUPPORTED_RELATION"]
    assert len(got[4][1]) == 1 and len(got[4][1][0]) == 4


def test_numbers_within_keys(spark):
    rng = np.random.default_rng(3)
    rows = [(int(k), int(o)) for k, o in zip(np.where(rng.random(600) < 0.7, 0, rng.integers(1, 9, 600)), rng.permutation(600), strict=True)]
    got = ranks.numbered(spark.createDataFrame(rows, "k long, o long").repartition(5), ["k"], ["o"], "n").collect()
    for k in range(9):
        assert [r["n"] for r in sorted((r for r in got if r["k"] == k), key=lambda r: r["o"])] == list(range(1, sum(a == k for a, _ in rows) + 1))


def test_groups_longer_than_batches(spark):
    import pyarrow as pa

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = [(int(k), j) for k, n in enumerate((1, 30, 7, 14, 2, 1)) for j in range(n)]
    work = lambda t: {"k": [t.column("k")[0].as_py()], "all": [",".join(map(str, t.column("j").to_pylist()))]}
    out = groups.each_group(spark.createDataFrame(rows, "k long, j long").repartition(4), ["k"], ["j"], work, pa.schema([("k", pa.int64()), ("all", pa.string())]), "k long, all string").collect()
    assert {r["k"]: r["all"] for r in out} == {k: ",".join(map(str, range(n))) for k, n in enumerate((1, 30, 7, 14, 2, 1))} and len(out) == 6
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "256")


def test_a_version_never_changes(spark):
    rows = spark.createDataFrame([(1, 2.0), (2, None), (3, 4.0)], "id long, x double")
    none = spark.createDataFrame([], "id long, sha256 string")
    stored = features.frozen(none, rows.filter("id < 3"), "id")
    assert {r["id"]: r["outcome"] for r in features.frozen(stored, rows, "id", strict=True).collect()} == {1: "UNCHANGED", 2: "UNCHANGED", 3: "NEW"}
    with pytest.raises(ValueError):
        features.frozen(stored, rows.fillna(0.0), "id", strict=True)


def test_land_cover_batch(spark):
    a = np.full((300, 300), 40, np.uint8)
    points = spark.createDataFrame([(1, 69.8, 22.3, 400.0), (2, 69.8, 22.3, 0.0), (3, 69.8, 86.0, 400.0), (4, 69.8, 22.3, 400.0), (5, 69.8, 22.3, 400.0)], "id long, lon double, lat double, radius_m double")
    chips = spark.createDataFrame([(k, a.tobytes(), 300, 300, 69.785, 22.315, 0.0001, 0.0001) for k in (1, 4)], "id long, chip binary, rows int, cols int, origin_lon double, origin_lat double, px double, py double")
    done = spark.createDataFrame([(4,)], "id long")
    good, failed = landcover.extract(points, chips, done)
    assert [(r["id"], r["fractions"]) for r in good.collect()] == [(1, {"crop": 1.0})]
    assert sorted(map(tuple, failed.collect())) == [(2, "RADIUS"), (3, "LATITUDE"), (5, "NO_WINDOW")]
    assert sorted(r["id"] for r in landcover.extract(points, chips, done, force=True)[0].collect()) == [1, 4]
    h = chips.select(landcover.window_digest(F.col("rows"), F.col("cols"), F.lit("t"), F.col("chip"))).first()[0]
    assert h == sha256(b"300|300|t" + a.tobytes()).hexdigest()


def test_groups_that_facilities_tie(spark):
    sites = spark.createDataFrame([(k, 70.0 + 0.1 * k, 22.0) for k in range(6)], "site long, lon double, lat double")
    area = spark.createDataFrame([(1, 70.0, 22.0), (1, 70.1, 22.0), (2, 70.3, 22.004)], "fac_id long, lon double, lat double")
    plants = spark.createDataFrame([(1, 70.2, 22.01), (1, 70.3, 22.01)], "fac_id long, lon double, lat double")
    got = {r["site"]: r["split_group"] for r in cases.site_groups(sites, area, plants).collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 2, 4: 4, 5: 5}
