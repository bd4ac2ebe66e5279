"""Stored runs: what is built from an earlier run equals a build from nothing; one writer wins; lineage and late arrivals."""

from datetime import datetime, timedelta
from random import Random

import pytest
from pyspark.sql import functions as F

from cindertrace.operators import episodes, increments

T0 = datetime(2026, 1, 1)


def rows_of(rng, n, first=0):
    """Points of some chains of spots, so that new ones may join components, and long silences."""
    out = []
    for k in range(n):
        group, step = rng.randrange(4), rng.randrange(12)
        out.append((first + k, T0 + timedelta(hours=rng.randrange(0, 1200)), 70.0 + 0.05 * group + 0.004 * step, 22.0 + 0.001 * rng.randrange(3), "NRT"))
    return out


def told(df):
    return sorted(tuple(r) for r in df.select("id", "event_id", "site_id", "event_ambiguous", "merges", F.round("event_diameter_m", 6), "site_ambiguous", F.round("site_diameter_m", 6)).collect())


def test_increments_equal_full_builds(spark, tmp_path):
    rng = Random(5)
    shape = "id long, acquired_at timestamp, lon double, lat double, product string"
    rows = rows_of(rng, 120)
    folder = str(tmp_path / "store")
    carried = []
    for step in range(4):
        df = spark.createDataFrame(rows, shape)
        entry = increments.build(df, folder)
        assert entry["number"] == step and told(increments.newest_members(spark, folder)) == told(episodes.assemble(df))
        carried.append(entry["carried"])
        assert increments.build(df.orderBy(F.rand()), folder)["status"] == "UNCHANGED"
        rows = [r for r in rows if step != 1 or rng.random() > 0.1] + rows_of(rng, 12, 1000 * (step + 1))  # once, some rows go
    assert carried[0] == 0 and all(c > 0 for c in carried[1:])


def test_lineage_and_late_arrivals(spark, tmp_path):
    shape = "id long, acquired_at timestamp, lon double, lat double, product string"
    at = lambda k, h, x: (k, T0 + timedelta(hours=h), 70.0 + x, 22.0, "NRT")
    first = [at(1, 0, 0), at(2, 10, 0), at(3, 100, 0), at(4, 0, 1), at(5, 5, 1), at(6, 300, 2)]
    folder = str(tmp_path)
    one = increments.build(spark.createDataFrame(first, shape), folder)
    assert (one["late"], one["events"], one["sites"]) == (0, 4, 3)
    two = increments.build(spark.createDataFrame([*first, at(7, 110, 0), at(8, 20, 0), at(9, 400, 2)], shape), folder)
    assert (two["late"], two["earliest_late"], two["previous_run"]) == (2, str(T0 + timedelta(hours=20)), one["run_id"])
    relations = sorted((r["relation"], r["shared"]) for r in increments.newest_lineage(spark, folder).collect())
    assert relations == [("GREW", 1), ("GREW", 2), ("SAME", 1), ("SAME", 2)]
    assert two["carried"] == 3
    events = {r["anchor"]: (r["n"], r["site_events"], r["site_observations"]) for r in increments.newest_events(spark, folder).collect()}
    assert events == {1: (3, 2, 5), 3: (2, 2, 5), 4: (2, 1, 2), 6: (1, 2, 2), 9: (1, 2, 2)}


def test_two_writers_cannot_both_win(spark, tmp_path, monkeypatch):
    shape = "id long, acquired_at timestamp, lon double, lat double, product string"
    rows = [(k, T0 + timedelta(hours=k), 70.0, 22.0, "NRT") for k in range(4)]
    folder = str(tmp_path)
    real, raced = increments.attempt, []

    def slow(points, *rest):
        made = real(points, *rest)
        if not raced:
            raced.append(1)
            increments.build(spark.createDataFrame(rows[:3], shape), folder)  # another writer commits first
        return made

    monkeypatch.setattr(increments, "attempt", slow)
    entry = increments.build(spark.createDataFrame(rows, shape), folder)
    assert entry["number"] == 1 and entry["inputs"] == 4 and increments.newest_members(spark, folder).count() == 4
    ledger = increments.Ledger(spark, folder)
    with pytest.raises(increments.Conflict):
        ledger.create(1, {})
    assert ledger.newest()["run_id"] == entry["run_id"]


def test_refusals(spark, tmp_path):
    shape = "id long, acquired_at timestamp, lon double, lat double, product string"
    df = spark.createDataFrame([(1, T0, 70.0, 22.0, "NRT"), (2, T0, 70.0, 22.0, "SP"), (None, T0, 70.0, 22.0, "NRT")], shape)
    for bad, most in ((df, None), (df.limit(0), None), (df.filter("id IS NULL"), None), (df.filter("product = 'NRT'"), 0)):
        with pytest.raises(ValueError):
            increments.build(bad, str(tmp_path), most=most)
