"""Polygons from any rings, hulls and diameters, coverage as bits, running sums, and queries that must not lose rows."""

from datetime import date, datetime, timedelta
from math import pi

import numpy as np
import pytest
from pyspark.sql import functions as F

from cindertrace import catalog
from cindertrace.functions import geo, polygons
from cindertrace.operators import coverage, features, hulls, ranks
from cindertrace.plans.adapter import Tables
from cindertrace.sources import mapped

RNG = np.random.default_rng(21)


def square(x, y, r, turned=False):
    ring = [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r), (x - r, y - r)]
    return ring[::-1] if turned else ring


def area(ring):
    r = np.asarray(ring, float)
    return ((r[:-1, 0] * r[1:, 1] - r[1:, 0] * r[:-1, 1]).sum()) / 2


def inside(x, y, rings):
    odd = np.zeros(len(x), int)
    for r in rings:
        for (ax, ay), (bx, by) in zip(r, r[1:], strict=False):
            if ay != by:
                odd += ((ay > y) != (by > y)) & (x < (bx - ax) * (y - ay) / (by - ay) + ax)
    return odd % 2 == 1


@pytest.mark.parametrize(
    ("rings", "areas"),
    [
        ([square(0, 0, 1, True)], [4]),
        ([square(0, 0, 1), square(5, 0, 1, True)], [4, 4]),
        ([square(0, 0, 3), square(0, 0, 2), square(0, 0, 1, True)], [-16, 4, 36]),
        ([[(0, 0), (2, 2), (2, 0), (0, 2), (0, 0)]], [1, 1]),
        ([square(0, 0, 1), square(1, 1, 1)], [3, 3]),
        ([square(0, 0, 1), square(0, 0, 1)], []),
        ([square(0, 0, 1), square(2, 0, 1)], [8]),
        ([square(0, 0, 1), square(2, 2, 1)], [4, 4]),
        ([square(0, 0, 2), square(1, 0, 1)], [12]),
        ([[(0, 0), (1, 1), (2, 2), (0, 0)]], []),
        ([], []),
    ],
)
def test_boundaries(rings, areas):
    assert sorted(round(area(r), 9) for r in polygons.boundary([np.array(r, float) for r in rings])) == areas


@pytest.mark.parametrize("whole", [True, False])
def test_boundaries_of_random_rings(whole):
    """The built rings hold the same points, cross nowhere and meet no corner twice."""
    for _ in range(150):
        rings = []
        for _ in range(RNG.integers(1, 5)):
            p = RNG.integers(0, 7, (RNG.integers(3, 9), 2)).astype(float) if whole else RNG.random((RNG.integers(3, 9), 2)) * 6
            rings.append(np.concatenate([p, p[:1]]))
        made = polygons.boundary(rings)
        x, y = RNG.random((2, 300)) * 7 - 0.5
        assert (inside(x, y, rings) == inside(x, y, made)).all()
        assert all(len({tuple(p) for p in r[:-1].tolist()}) == len(r) - 1 for r in made)
        if made:
            again = polygons.boundary(made)
            assert sum(map(area, again)) == pytest.approx(sum(map(area, made)), abs=1e-9) and sum(map(area, made)) > 0


def test_overlap_of_several_outers(spark):
    """Disjoint outers, an island in a hole, a bow tie and crossing outers against points thrown at the circle."""
    s = 0.001
    shapes = {
        "one": [square(2 * s, 0, s)], "two": [square(2 * s, 0, s), square(-2 * s, 0, s)], "three": [square(2 * s, 0, s), square(-2 * s, 0, s, True), square(0, 4 * s, s)],
        "island": [square(0, 0, 5 * s), square(0, 0, 3 * s), square(0, 0, s)], "bow": [[(-4 * s, -4 * s), (4 * s, 4 * s), (4 * s, -4 * s), (-4 * s, 4 * s), (-4 * s, -4 * s)]], "crossing": [square(0, 0, 3 * s), square(2 * s, 2 * s, 3 * s)],
    }
    df = spark.createDataFrame([(k, [[(float(a), float(b)) for a, b in r] for r in rings]) for k, rings in shapes.items()], f"k string, rings {polygons.KIND}")
    circle = (F.lit(0.0), F.lit(0.0), F.lit(800.0))
    got = {r["k"]: (r["any"], r["valid"]) for r in df.withColumn("b", polygons.built(F.col("rings"))).select("k", geo.circle_overlap(*circle, F.when(F.col("k") == "bow", F.col("b")).otherwise(F.col("rings"))).alias("any"), geo.circle_overlap(*circle, F.col("b"), True).alias("valid")).collect()}
    p = RNG.uniform(-800, 800, (80_000, 2))
    p = p[(p**2).sum(axis=1) <= 800**2]
    x, y = p[:, 0] / (pi / 180 * 6378137.0), p[:, 1] / (pi / 180 * 6378137.0 * (1 - 0.00669437999014))
    for k, rings in shapes.items():
        assert got[k][0] == pytest.approx(got[k][1], abs=1e-9) and got[k][1] == pytest.approx(inside(x, y, rings).mean(), abs=0.01), k
    assert got["two"][1] == pytest.approx(2 * got["one"][1], rel=1e-6)


def test_elements_become_valid_polygons(spark):
    """A bow tie counts as two triangles; a relation's rings nest by where they lie, whatever their roles say."""
    import json

    line = lambda *p: [{"lon": x, "lat": y} for x, y in p]
    way = lambda role, ring: {"type": "way", "role": role, "geometry": line(*ring)}
    e = [
        {"type": "way", "id": 1, "tags": {}, "geometry": line((0, 0), (2, 2), (2, 0), (0, 2), (0, 0))},
        {"type": "relation", "id": 2, "tags": {"type": "multipolygon"}, "members": [way("outer", square(0, 0, 3)), way("inner", square(0, 0, 2, True)), way("outer", square(0, 0, 1)), way("outer", square(9, 0, 1, True))]},
        {"type": "relation", "id": 3, "tags": {"type": "multipolygon"}, "members": [way("outer", square(0, 0, 1)), way("outer", square(0, 0, 1))]},
    ]
    df = spark.createDataFrame([(json.dumps({"elements": e}),)], "json string")
    got = {r["id"]: r for r in mapped.elements(df).collect()}
    areas = {k: sorted(round(area([(p["lon"], p["lat"]) for p in ring]), 6) for ring in r["rings"] or []) for k, r in got.items()}
    assert areas == {1: [1, 1], 2: [-16, 4, 4, 36], 3: []} and got[3]["reason"] == "INVALID_GEOMETRY" and got[1]["reason"] is None


def test_merged_hulls_and_diameters(spark, monkeypatch):
    """Against all points and all pairs, at any width; tasks hold few points."""
    monkeypatch.setattr(hulls, "HELD", 64)
    groups = {1: RNG.normal(size=(400, 2)) * 0.001, 2: RNG.normal(size=(300, 2)) * 0.05, 3: np.repeat(RNG.random((1, 2)), 50, axis=0), 4: np.linspace((0, 0), (0.01, 0.02), 40), 5: RNG.integers(0, 5, (200, 2)) * 0.01, 6: np.array([[1.0, 2.0]])}
    rows = [(k, float(70 + x), float(22 + y)) for k, p in groups.items() for x, y in p] + [(1, None, 1.0)]
    df = spark.createDataFrame(rows, "place long, lon double, lat double").repartition(4)
    got = {r["place"]: r for r in hulls.hulls(df, "place").withColumn("d", hulls.diameter_m(F.col("hull"))).collect()}
    assert set(got) == set(groups)
    for k in groups:
        p = np.array([(x, y) for g, x, y in rows if g == k and x is not None])
        middle = np.radians((p[:, None, 1] + p[None, :, 1]) / 2)
        w = np.sqrt(1 - 0.00669437999014 * np.sin(middle) ** 2)
        m = np.hypot((p[:, None, 1] - p[None, :, 1]) * pi / 180 * 6378137.0 * (1 - 0.00669437999014) / w**3, (p[:, None, 0] - p[None, :, 0]) * pi / 180 * 6378137.0 * np.cos(middle) / w)
        assert got[k]["d"] == pytest.approx(m.max(), abs=1e-6)
        h = [(c["lon"], c["lat"]) for c in got[k]["hull"]]
        want = spark.createDataFrame([([(float(a), float(b)) for a, b in p],)], "p array<struct<lon:double,lat:double>>").select(geo.convex_hull(F.col("p")).alias("h")).first()["h"]
        assert h == [(c["lon"], c["lat"]) for c in want]


def test_coverage_bits(spark):
    """Days counted one by one, over block borders, long archives, and what was received later."""
    subjects = [(k, 70.0, 22.0, datetime(2026, 1, 1) + timedelta(days=23 * k, hours=5)) for k in range(12)]
    passes = []
    for k in range(300):
        first = date(2025, 1, 1) + timedelta(days=int(RNG.integers(0, 700)))
        passes.append((first, first + timedelta(days=int(RNG.integers(0, 5))), "SUCCEEDED" if k % 9 else "FAILED", "M", "SP" if k % 3 else "NRT", 0, datetime(2025, 1, 1) + timedelta(days=int(RNG.integers(0, 900))), 69.0, 21.0, 71.0 if k % 5 else 69.5, 23.0))
    s = spark.createDataFrame(subjects, "sid long, lon double, lat double, as_of timestamp")
    p = spark.createDataFrame(passes, "start_date date, end_date date, status string, mode string, product string, rejected_rows long, received_at timestamp, west double, south double, east double, north double")
    for operational in (False, True):
        days = coverage.covered(s, p, "M", 750.0, 182, operational)
        last = F.to_date("as_of")
        counted = s.select("sid", "as_of").join(days, "sid").groupBy("sid", "product").agg(*[F.sum(coverage.days_in(F.col("bits"), F.col("block"), F.date_sub(last, d), last)).alias(f"n{d}") for d in (7, 90, 182)], F.sum(F.bit_count("bits")).alias("n"))
        got = {(r["sid"], r["product"]): (r["n7"], r["n90"], r["n182"], r["n"]) for r in counted.collect()}
        want = {}
        for sid, _, _, as_of in subjects:
            for product in ("SP", "NRT"):
                own = {a + timedelta(days=i) for a, z, status, _, kind, _, received, _, _, east, _ in passes for i in range((z - a).days + 1) if status == "SUCCEEDED" and kind == product and east == 71.0 and (not operational or received <= as_of)}
                own = {d for d in own if as_of.date() - timedelta(days=182) <= d <= as_of.date()}
                if own:
                    want[sid, product] = tuple(sum(as_of.date() - timedelta(days=n) <= d < as_of.date() for d in own) for n in (7, 90, 182)) + (len(own),)
        assert got == want


def test_running_sums_and_exact_average_precision(spark):
    df = spark.createDataFrame([(k * 7 % 101, k) for k in range(101)], "o long, v long").repartition(5)
    got = {r["o"]: r["s"] for r in ranks.running(df, "o", {"v": "s"}).collect()}
    total = 0
    for o, v in sorted((k * 7 % 101, k) for k in range(101)):
        total += v
        assert got[o] == total
    p = np.round(RNG.random(500), 6) * 1e-4 + 0.5  # scores that four decimals cannot tell apart
    y = (RNG.random(500) < p).astype(int)
    found = features.average_precision(spark.createDataFrame([(float(a), int(b)) for a, b in zip(p, y, strict=True)], "p double, y int")).first()["pr_auc"]
    order = np.argsort(-p, kind="stable")
    steps = {}
    for k, i in enumerate(order):
        steps[p[i]] = (k + 1, y[order[: k + 1]].sum())
    before, want = 0, 0.0
    for seen, hits in steps.values():
        want += (hits - before) * hits / seen
        before = hits
    assert found == pytest.approx(want / y.sum(), abs=1e-6)


def test_trees_by_the_number(spark, monkeypatch):
    """As many trees as asked for, 300 by default; each held-out region is scored by a fit that has not seen it."""
    import inspect

    assert inspect.signature(features.boosted_scores).parameters["rounds"].default == 300 == features.Trees(["x"]).rounds
    rows = [(k, f"r{k % 3}", ("TRAIN", "TRAIN", "TRAIN", "TEST", "VALIDATION")[k % 5], int(k * 37 % 100 < 50), float(k * 37 % 100) if k % 11 else None) for k in range(400)]
    df = spark.createDataFrame(rows, "id long, region_id string, split string, target int, x double")
    seen, fit = [], features.Trees.fit
    monkeypatch.setattr(features.Trees, "fit", lambda self, train, target: seen.append({r["region_id"] for r in train.select("region_id").distinct().collect()}) or fit(self, train, target))
    got = features.held_out_scores(df, ["x"], rounds=5).collect()
    assert sorted(map(tuple, seen), key=str) and sorted(map(sorted, seen)) == [["r0", "r1"], ["r0", "r2"], ["r1", "r2"]]
    assert {r["id"] for r in got} == {r[0] for r in rows if r[2] == "TEST"} and np.mean([(r["p"] >= 0.5) == r["y"] for r in got]) > 0.9
    scored = features.boosted_scores(df, ["x"], "target", "id", 5).collect()
    assert len(scored) == 400 and np.mean([(r["p"] >= 0.5) == r["y"] for r in scored]) > 0.9


def test_all_reviews_stay(spark, small):
    t = Tables(spark, small)
    assert t.reviews().count() == t.read("lineitem").count() and t.reviews().select("id", "seq").distinct().count() == t.reviews().count()


def test_groups_of_sites_have_gaps(spark):
    sizes = [r["n"] for r in catalog.QUERIES["facility_aware_groups"](spark, "/root/testdata/sf0.01").groupBy("split_group").agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 30 and max(sizes) == 3 and {1, 2, 3} == set(sizes)
    statuses = {r["status"] for r in catalog.QUERIES["held_out_regions"](spark, "/root/testdata/sf0.01").collect()}
    assert statuses == {"SCORED"}
