"""Cases with known answers for what SQL over the tables does not reach."""

from datetime import datetime, timedelta
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from cindertrace import catalog
from cindertrace.functions import geo
from cindertrace.operators import components, episodes, features, history, labels, landcover, rules
from cindertrace.plans.adapter import Tables
from cindertrace.sources import detections, exports, mapped

T0 = datetime(2026, 1, 2, 9)


DEGREE = 110_574.0  # metres in a degree of latitude at the equator, by whose meridian the points below lie


def assemble(spark, points, **limits):
    """points: (id, metres north, hours)."""
    rows = [(i, T0 + timedelta(hours=h), 10.0, y / DEGREE) for i, y, h in points]
    out = episodes.assemble(spark.createDataFrame(rows, "id long, acquired_at timestamp, lon double, lat double"), episodes.Limits(**limits)).collect()
    assert sorted(r["id"] for r in out) == sorted(i for i, _, _ in points)
    return {r["id"]: r for r in out}


def plain_groups(points, limits):
    """The rules read out literally, over all pairs: (episodes, sites) as sets of ids, and counts of unclear joins and merges."""
    y = {i: m for i, m, _ in points}
    apart = lambda a, b: abs(y[a] - y[b])
    episodes_, merges = [], 0
    for i, _, h in sorted(points, key=lambda p: (p[2], p[0])):
        offers = [e for e in episodes_ if h - e["to"] <= limits.gap_hours and h - e["from"] <= limits.span_hours and any(apart(i, m) <= limits.link_m for m in e["ids"])]
        free = [e for e in offers if all(apart(i, m) <= limits.diameter_m for m in e["ids"])]
        free.sort(key=lambda e: (min(apart(i, m) for m in e["ids"]), e["from"], e["ids"][0]))
        everyone = [m for e in free for m in e["ids"]] + [i]
        if len(free) > 1 and all(apart(a, b) <= limits.diameter_m for a in everyone for b in everyone):
            free.sort(key=lambda e: (e["from"], e["ids"][0]))
            into, merges = free[0], merges + 1
            for e in free[1:]:
                into["ids"] += e["ids"]
                into["unclear"] += e["unclear"]
                episodes_.remove(e)
        elif free:
            into = free[0]
            into["unclear"] += len(offers) > 1
        else:
            into = {"ids": [], "from": h, "unclear": int(bool(offers))}
            episodes_.append(into)
        into["ids"].append(i)
        into["to"] = h
    return episodes_, merges


@pytest.mark.parametrize("seed", range(4))
def test_episodes_as_the_rules_read(spark, seed):
    rng = np.random.default_rng(seed)
    line = rng.uniform(0, 6000, 40) if seed % 2 else rng.integers(0, 60, 40) * 97.0  # repeated spots in every other case
    points = [(int(k), float(y), float(h)) for k, y, h in zip(rng.permutation(220), rng.choice(line, 220), rng.integers(0, 500, 220) * 1.0, strict=True)]
    limits = episodes.Limits(gap_hours=(24, 60)[seed // 2])
    rows = assemble(spark, points, gap_hours=limits.gap_hours)
    want, merges = plain_groups(points, limits)
    got = {}
    for i, r in rows.items():
        got.setdefault(r["event_id"], set()).add(i)
    assert sorted(map(sorted, got.values())) == sorted(sorted(e["ids"]) for e in want)
    for e in want:
        one = rows[e["ids"][0]]
        y = [p[1] for p in points if p[0] in e["ids"]]
        assert one["event_ambiguous"] == e["unclear"] and one["event_diameter_m"] == pytest.approx(max(y) - min(y), abs=1)
    assert sum({r["event_id"]: r["merges"] for r in rows.values()}.values()) == merges
    homes = {}
    for r in rows.values():
        homes.setdefault(r["event_id"], set()).add(r["site_id"])
    assert all(len(s) == 1 for s in homes.values())
    for site in {r["site_id"] for r in rows.values()}:
        y = [p[1] for p in points if rows[p[0]]["site_id"] == site]
        assert max(y) - min(y) <= 1501 and all(r["site_diameter_m"] == pytest.approx(max(y) - min(y), abs=1) for r in rows.values() if r["site_id"] == site)


def test_a_source_that_lasts_is_one_site_of_many_episodes(spark):
    rows = assemble(spark, [(k, 80.0 * (k % 4), 20.0 * k) for k in range(30)])
    spans = {}
    for k, r in rows.items():
        spans.setdefault(r["event_id"], []).append(20 * k)
    assert sorted((min(v), max(v)) for v in spans.values()) == [(0, 160), (180, 340), (360, 520), (540, 580)]
    assert len({r["site_id"] for r in rows.values()}) == 1 and rows[0]["site_diameter_m"] == pytest.approx(240, abs=1)


def test_silences_part_runs(spark):
    points = spark.createDataFrame([(1, T0 + timedelta(hours=h)) for h in (0, 24, 48.5, 100)] + [(2, T0)], "root long, acquired_at timestamp")
    assert sorted((r["root"], (r["run"] - T0).total_seconds() / 3600) for r in episodes.silence_runs(points, 24).collect()) == [(1, 0), (1, 0), (1, 48.5), (1, 100), (2, 0)]


def test_names_depend_on_kind_limits_and_members():
    a = episodes.identity("event", episodes.Limits(), [1, 2])
    assert len({a, episodes.identity("site", episodes.Limits(), [1, 2]), episodes.identity("event", episodes.Limits(gap_hours=25), [1, 2]), episodes.identity("event", episodes.Limits(), [12])}) == 4


def test_components_of_a_chain(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "a long, b long")
    nodes = spark.createDataFrame([(k,) for k in [*range(61), 100, 101, 200]], "node long")
    found = {r["node"]: r["root"] for r in components.components(nodes, edges).collect()}
    assert {found[k] for k in range(61)} == {0} and found[101] == 100 and found[200] == 200


def test_overpass_max_and_stats(spark):
    rows = [(1, T0, 2.0, "N20", "N"), (1, T0, 3.0, "N20", "N"), (1, T0, None, "N20", "N")]
    o = history.overpass_max(spark.createDataFrame(rows, "place long, acquired_at timestamp, frp_mw double, satellite string, daynight string"), "place")
    assert [r["frp"] for r in o.collect()] == [3.0]
    s = history.robust_stats(o, "place").first()
    assert (s["n"], s["mad_log1p"]) == (1, 0.0)


def test_z_floor_and_cap(spark):
    z = lambda c, m, d: spark.range(1).select(history.robust_z(F.lit(c), F.lit(m), F.lit(d))).first()[0]
    assert z(10.0, float(np.log(3)), 0.0) == pytest.approx((np.log(11) - np.log(3)) / 0.1, abs=1e-3)
    assert z(1e9, 0.0, 0.0) == 50.0


def test_priority_rows(spark):
    cases = [("INDUSTRIAL", "ABNORMAL_RELATIVE_TO_BASELINE", "HIGHER", "P1_HIGH"), ("INDUSTRIAL", "NEW_OR_TRANSIENT", None, "P2_HIGH"), ("UNKNOWN", "NEW_OR_TRANSIENT", None, "P3_REVIEW"), ("UNKNOWN", "INSUFFICIENT_HISTORY", None, "P4_MEDIUM"), ("UNKNOWN", "ABNORMAL_RELATIVE_TO_BASELINE", "LOWER", "P5_MEDIUM"), ("INDUSTRIAL", "RECURRENT_WITHIN_BASELINE", None, "P6_LOW"), ("VEGETATION_FIRE", "NEW_OR_TRANSIENT", None, "P7_LOW")]
    df = spark.createDataFrame(cases, "s string, b string, d string, want string")
    assert df.filter(rules.priority_rule(F.col("s"), F.col("b"), F.col("d")) != F.col("want")).count() == 0


def test_kappa(spark):
    k = lambda rows: labels.cohen_kappa(spark.createDataFrame(rows, "a string, b string")).first()["kappa"]
    assert k([]) is None and k([("x", "x"), ("y", "y")]) == 1.0 and k([("x", "y"), ("y", "x")]) == -1.0 and k([("x", "x")]) is None


def test_confusion(spark):
    r = features.confusion(spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "y int, pred int")).first()
    assert (r["tn"], r["fp"], r["fn"], r["tp"]) == (1, 1, 0, 2) and r["macro_f1"] == pytest.approx((0.8 + 2 / 3) / 2, abs=1e-6)


def test_identity_does_not_depend_on_spelling(spark):
    cells = ["22.3", "22.30", "+22.3", "022.300", "-0", "-0.0", "0", ".5", "0.50"]
    got = [r[0] for r in spark.createDataFrame([(c,) for c in cells], "x string").select(detections.decimal_text(F.col("x"))).collect()]
    assert got == ["22.3"] * 4 + ["0"] * 3 + ["0.5"] * 2


def test_read_validate(spark, tmp_path):
    header = ",".join(detections.COLUMNS)
    rows = ["22.3,69.8,310,0.4,0.5,2026-01-02,905,N20,VIIRS,n,2.0NRT,295,0,D", "92,69.8,310,0.4,0.5,2026-01-02,905,N20,VIIRS,n,2.0NRT,295,,D", "22.3,69.8,310,0,0.5,2026-01-02,905,N20,VIIRS,n,2.0NRT,295,,D"]
    (tmp_path / "a.csv").write_text("\n".join([header, *rows]) + "\n")
    v = detections.validate(detections.read_csv(spark, str(tmp_path / "a.csv")), "N20", "2026-01-01", 3, (69.5, 22.0, 70.5, 23.0))
    assert sorted(str(r["reason"]) for r in v.collect()) == ["INVALID_COORDINATE", "INVALID_PIXEL", "None"]
    (tmp_path / "b.csv").write_text("latitude\n1\n")
    with pytest.raises(ValueError):
        detections.read_csv(spark, str(tmp_path / "b.csv"))


def square(x, y, r):
    return [(x - r, y - r), (x + r, y - r), (x + r, y + r), (x - r, y + r), (x - r, y - r)]


def test_polygon_with_a_hole(spark):
    rings = [square(69.8, 22.3, 0.005), square(69.8, 22.303, 0.001)]
    df = spark.createDataFrame([("in", 69.8, 22.3, rings), ("hole", 69.8, 22.303, rings), ("out", 69.83, 22.3, rings)], "k string, lon double, lat double, rings array<array<struct<lon:double,lat:double>>>")
    got = {r["k"]: (r["i"], r["d"]) for r in df.select("k", geo.in_rings(F.col("lon"), F.col("lat"), F.col("rings")).alias("i"), geo.ring_distance_m(F.col("lon"), F.col("lat"), F.col("rings")).alias("d")).collect()}
    assert got["in"] == (True, 0.0) and not got["hole"][0] and 90 < got["hole"][1] < 120 and not got["out"][0] and 2500 < got["out"][1] < 2700


def test_tiles(spark):
    got = [r[0] for r in spark.createDataFrame([(69.8, 22.3), (3.0, -1.0), (-0.1, 0.0)], "x double, y double").select(geo.tile_id(F.col("x"), F.col("y"))).collect()]
    assert got == ["N21E069", "S03E003", "N00W003"]


def test_elements(spark):
    import json

    g = [{"lon": x, "lat": y} for x, y in square(69.8, 22.3, 0.01)]
    flat = [{"lon": 1.0, "lat": 1.0}] * 5
    e = [{"type": "node", "id": 1, "lat": 1.0, "lon": 2.0, "tags": {"power": "plant"}}, {"type": "way", "id": 2, "tags": {}, "geometry": g}, {"type": "way", "id": 3, "tags": {}, "geometry": g[:3]}, {"type": "way", "id": 4, "tags": {}, "geometry": flat}, {"type": "relation", "id": 5, "tags": {"type": "multipolygon"}, "members": [{"type": "way", "role": "outer", "geometry": g}]}, {"type": "node", "id": 1, "lat": 9.0, "lon": 9.0, "tags": {}}]
    out = {(r["type"], r["id"]): r for r in mapped.elements(spark.createDataFrame([(json.dumps({"elements": e}),)], "json string")).collect()}
    assert len(out) == 5 and out["node", 1]["lat"] == 1.0
    assert [out[k]["reason"] for k in (("way", 2), ("way", 3), ("way", 4), ("relation", 5))] == [None, "OPEN_WAY", "INVALID_GEOMETRY", None]


def test_land_cover(spark):
    a = np.full((400, 400), 40, np.uint8)
    a[:, 200:] = 50
    a[5, 5] = 7
    row = (1, 69.8, 22.3, 500.0, a.tobytes(), 400, 400, 69.78, 22.32, 0.0001, 0.0001)
    schema = "id long, lon double, lat double, radius_m double, chip binary, rows int, cols int, origin_lon double, origin_lat double, px double, py double"
    r = landcover.summarise(spark.createDataFrame([row], schema)).first()
    assert r["status"] == "OK" and r["valid_fraction"] == 1.0 and abs(r["fractions"]["crop"] - 0.5) < 0.02


def test_geojson_and_hash(spark):
    f = exports.features(spark.createDataFrame([(1.0, 2.0, float("nan"), "x")], "lon double, lat double, v double, s string")).first()[0]
    assert '"coordinates":[1.0,2.0]' in f and '"v":null' in f
    h = spark.range(1).select(episodes.stable_hash("a", F.lit("b"))).first()[0]
    assert h == sha256(b"a\x1fb").hexdigest()


def test_streams(spark, tmp_path):
    from cindertrace.streaming import episodes as streams

    rows = [(k, 1, T0 + timedelta(hours=h), 1.0) for k, h in enumerate([0, 1, 2, 40, 400])]
    df = spark.createDataFrame(rows + rows[:2], "obs_id long, place long, acquired_at timestamp, frp_mw double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    q = streams.deduplicated(source, "1 hour").writeStream.format("memory").queryName("once").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("once").count() == 5
    q = streams.closed_sessions(source.dropDuplicates(["obs_id"]), "24 hours", "1 hour").writeStream.outputMode("append").format("memory").queryName("closed").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("closed").collect()) == [1, 3]


def test_all_pairs_of_observations(spark, small):
    points = [(r["obs_id"], r["lon"], r["lat"]) for r in Tables(spark, small).obs().select("obs_id", "lon", "lat").collect()]
    ids, lon, lat = (np.array(x) for x in zip(*sorted(points), strict=True))
    a, b = np.triu_indices(len(ids), 1)
    middle = np.radians((lat[a] + lat[b]) / 2)
    w = np.sqrt(1 - 0.00669437999014 * np.sin(middle) ** 2)
    north = np.radians(lat[a] - lat[b]) * 6378137.0 * (1 - 0.00669437999014) / w**3
    d = np.hypot(north, np.radians(lon[a] - lon[b]) * 6378137.0 * np.cos(middle) / w)
    want = {(int(ids[i]), int(ids[j])): x for i, j, x in zip(a, b, d.tolist(), strict=True) if x <= 1500}
    got = {(r["a"], r["b"]): r["distance_m"] for r in catalog.QUERIES["all_pair_distances"](spark, small).collect()}
    assert got == {k: pytest.approx(x, abs=1e-3) for k, x in want.items()}
    assert any(x % 10 or y % 10 for x, y in got)
