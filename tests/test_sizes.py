"""Plans whose cost must follow the input: no broadcast of rows that a small file holds, few pairs of crowded spots."""

from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from cindertrace import catalog
from cindertrace.operators import assessment, components, episodes, features, groups, spatial
from cindertrace.plans.adapter import Tables


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_filed_rows_are_not_broadcast(spark, tmp_path):
    """A file of some bytes a row, each of which is filed under nine cells."""
    spark.range(2000).select("id", (70 + F.col("id") * 0.001).alias("lon"), (22 + F.col("id") * 0.001).alias("lat")).write.parquet(f"{tmp_path}/p")
    p = spark.read.parquet(f"{tmp_path}/p")
    pairs = spatial.self_pairs(p, 300.0)
    assert "Broadcast" not in plan_of(pairs)
    assert pairs.count() == 1999  # each with the next, 152 m away


def test_history_does_not_broadcast_subjects_or_days(spark, tmp_path):
    at = datetime(2024, 1, 10)
    spark.createDataFrame([(1, 70.0, 22.0, at)], "sid long, lon double, lat double, as_of timestamp").write.parquet(f"{tmp_path}/s")
    spark.createDataFrame([(1, "SP", 308, 1)], "sid long, product string, block int, bits long").write.parquet(f"{tmp_path}/d")
    seen = spark.createDataFrame([(5, 70.0, 22.0, at, 1.0, "N20", "D", "NRT", at)], "obs_id long, lon double, lat double, acquired_at timestamp, frp_mw double, satellite string, daynight string, product string, available_at timestamp")
    s, days = spark.read.parquet(f"{tmp_path}/s"), spark.read.parquet(f"{tmp_path}/d")
    rows = assessment.as_of_history(s, seen, days)
    for df in (rows, assessment.withheld(s, seen, days), assessment.features(s, rows, days).select("sid", "covered_90", "detections_7", "superseded")):
        assert "Broadcast" not in plan_of(df)
    assert [(r["sid"], r["obs_id"], r["kept"]) for r in rows.collect()] == [(1, 5, True)]


def test_archive_does_not_broadcast_itself(spark, small):
    assert "Broadcast" not in plan_of(Tables(spark, small).archive())


@pytest.mark.parametrize("lat", [0.0, 22.0, 59.0, -84.0])
def test_spots_are_linked_by_small_cells(spark, lat):
    """Two crowds of 150 spots in 300 m, a bridge to one of them, and loners: few pairs, and the components of brute force."""
    rng = np.random.default_rng(3)
    north, east = 1 / 111_000, 1 / 111_000 / np.cos(np.radians(lat))
    at = np.concatenate([rng.uniform(0, 300, (150, 2)), rng.uniform(0, 300, (150, 2)) + [1100, 0], [[1700.0, 700.0], [2200.0, 1100.0]], rng.uniform(0, 20_000, (60, 2)) + [5000, 0]])
    spots = spark.createDataFrame([(k, float(70 + x * east), float(lat + y * north)) for k, (x, y) in enumerate(at)], "spot long, lon double, lat double")
    filed = episodes.by_small_cells(spots, 750.0).localCheckpoint()
    links = episodes.linked_roots(filed, filed, 750.0)
    assert links.count() < 300  # a crowd alone has 11,175 pairs of spots
    roots = {r["node"]: r["root"] for r in components.components(filed.select(F.col("root").alias("node")).distinct(), links).collect()}
    root = list(range(len(at)))
    close = spatial.self_pairs(spots, 750.0, "spot").collect()
    for _ in root:
        for p in close:
            root[p["a"]] = root[p["b"]] = min(root[p["a"]], root[p["b"]])
        if all(root[p["a"]] == root[p["b"]] for p in close):
            break
    assert {r["spot"]: roots[r["root"]] for r in filed.collect()} == dict(enumerate(root))


def test_radius_history_files_places_not_observations(spark, small, monkeypatch):
    filed, whole = [], spatial.near
    monkeypatch.setattr(spatial, "near", lambda left, right, *a, **k: filed.append(right) or whole(left, right, *a, **k))
    catalog.QUERIES["radius_history"](spark, small)
    assert filed[0].count() == Tables(spark, small).places().count() < Tables(spark, small).obs().count()


def test_built_areas_are_dealt_over_tasks(spark, small):
    assert "REPARTITION_BY_NUM" in plan_of(catalog.QUERIES["built_areas"](spark, small))


def test_distinct_counts_do_not_multiply_rows(spark, small, tmp_path):
    """A row for each distinct count would make a task hold many times its rows."""
    at = datetime(2024, 1, 10)
    spark.createDataFrame([(1, 70.0, 22.0, at, at)], "sid long, lon double, lat double, as_of timestamp, started_at timestamp").write.parquet(f"{tmp_path}/s")
    spark.createDataFrame([(1, "SP", 308, 1)], "sid long, product string, block int, bits long").write.parquet(f"{tmp_path}/d")
    noon, none = datetime(2024, 1, 8, 12), None
    rows = [(1, at, True, k, t, 1.0, s, n) for k, (t, s, n) in enumerate([(noon, "N20", "N"), (noon, "N20", none), (noon, none, "D"), (noon, none, "D"), (datetime(2024, 1, 1), "N20", none), (at, "N20", "N")])]
    seen = spark.createDataFrame(rows, "sid long, as_of timestamp, kept boolean, obs_id long, acquired_at timestamp, frp_mw double, satellite string, daynight string").withColumn("day", F.to_date("acquired_at"))
    s, days = spark.read.parquet(f"{tmp_path}/s"), spark.read.parquet(f"{tmp_path}/d")
    told, prior = assessment.features(s, seen, days), features.prior_inputs(s, seen.drop("as_of"), days)
    for df in (told, prior, catalog.QUERIES["window_features"](spark, small)):
        assert "Expand" not in plan_of(df)
    r, p = told.first(), prior.first()
    assert [(r[f"detections_{d}"], r[f"overpasses_{d}"], r[f"active_days_{d}"], r[f"days_since_{d}"]) for d in (7, 30)] == [(4, 2, 1, 0.5), (5, 3, 2, 0.5)]
    assert (r["current_detections"], r["latest"]) == (1, at)
    assert (p["active_days_30"], p["overpasses_90"], p["history_night_fraction_90"], p["days_since_last"]) == (2, 3, 0.333333, 1.5)


def test_grouping_tasks_hold_bounded_rows(spark, tmp_path, monkeypatch):
    """More rows, more tasks, though their bytes are few."""
    spark.range(1000).select("id", F.lit(1).alias("x")).write.parquet(f"{tmp_path}/r")
    monkeypatch.setattr(groups, "TASK_ROWS", 50)
    assert groups.dealt(spark.read.parquet(f"{tmp_path}/r"), "id").rdd.getNumPartitions() == 20
