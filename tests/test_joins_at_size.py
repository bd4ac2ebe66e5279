"""Joins of the grouping, its stored runs and a reviewer's desk: nothing in the driver, no row by its id, no table read anew."""

import re
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from cindertrace import catalog
from cindertrace.operators import components, increments, reviewing


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_grouping_is_not_broadcast(spark, small, monkeypatch):
    """Files of some bytes a row, each of which is far more in a hash table; components make one in every round."""
    plans, write = [], components.checkpointed
    monkeypatch.setattr(components, "checkpointed", lambda df: plans.append(plan_of(df)) or write(df))
    built = catalog.QUERIES["event_builder_full"](spark, small)
    assert len(plans) > 2 and not any("Broadcast" in p for p in [*plans, plan_of(built)])
    assert "Broadcast" not in plan_of(catalog.QUERIES["site_rollup"](spark, small))


def test_stored_runs_carry_rows_over_without_their_ids(spark, tmp_path, monkeypatch):
    """Rows of a known run are stored already, so neither they nor their times are looked up by id."""
    at = lambda k, h, x: (k, datetime(2026, 1, 1) + timedelta(hours=h), 70.0 + x, 22.0, "NRT")
    shape = "id long, acquired_at timestamp, lon double, lat double, product string"
    first = [at(1, 0, 0), at(2, 10, 0), at(3, 100, 0), at(4, 0, 1)]
    increments.build(spark.createDataFrame(first, shape), str(tmp_path))
    plans, write = [], increments.checkpointed
    monkeypatch.setattr(increments, "checkpointed", lambda df: plans.append(plan_of(df)) or write(df))
    entry = increments.build(spark.createDataFrame([*first, at(5, 105, 0)], shape), str(tmp_path))
    assert plans and not any(re.search(r"Join \[id#", p) for p in plans)
    rows = {r["id"]: (r["carried"], str(r["acquired_at"])) for r in increments.newest_members(spark, str(tmp_path)).collect()}
    assert entry["carried"] == 3 and rows[4] == (True, "2026-01-01 00:00:00") and rows[3] == (False, "2026-01-05 04:00:00")


def test_desk_judges_cases_once(spark, tmp_path):
    role = F.when(F.col("id") % 3 == 0, "ADJUDICATOR").when(F.col("id") % 3 == 1, "REVIEWER")
    spark.range(100).select("id", role.alias("role"), (100 - F.col("id")).alias("place"), (F.col("id") % 2 == 0).alias("history_complete"), F.lit(0).alias("reviews"), F.lit(2).alias("review_slots")).write.parquet(f"{tmp_path}/j")
    desk = reviewing.desk(spark.read.parquet(f"{tmp_path}/j"), 2)
    assert plan_of(desk).count("FileScan parquet") == 1
    assert sorted((r["role"], r["id"]) for r in desk.collect()) == [("ADJUDICATOR", 90), ("ADJUDICATOR", 96), ("REVIEWER", 88), ("REVIEWER", 94)]
