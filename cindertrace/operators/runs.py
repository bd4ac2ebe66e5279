"""Runs of the grouping by region: what may be built, what is unchanged, and reading the newest run's events."""

from __future__ import annotations

from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cindertrace.functions import geo
from cindertrace.operators import episodes
from cindertrace.operators.labels import fingerprint

# The most inputs of one run, and the products that are one sensor's record.
MOST_INPUTS, FAMILY = 20_000, ("NRT", "SP")


def overlap_days(observations: DataFrame) -> DataFrame:
    """region, day with both the near-real-time and the archived product: one detection would count twice."""
    rows = observations.filter(F.col("product").isin(*FAMILY))
    return rows.groupBy("region", F.to_date("acquired_at").alias("day")).agg(F.count_distinct("product").alias("n")).filter("n > 1").select("region", "day")


def plan(observations: DataFrame, earlier: DataFrame, most: int = MOST_INPUTS) -> DataFrame:
    """region, n, input_sha256, late, action for observations(region, obs_id, acquired_at, product).

    earlier: region, input_sha256, latest (its newest input) of each region's newest run. action: REFUSED_SIZE,
    REFUSED_OVERLAP, UNCHANGED or BUILD; late: inputs older than the newest of that run which it had not.
    """
    own = fingerprint(observations.select("region", "obs_id"), ["region"], "obs_id").withColumnRenamed("digest", "input_sha256")
    mixed = overlap_days(observations).groupBy("region").agg(F.count("*").alias("mixed"))
    before = earlier.withColumnRenamed("input_sha256", "_old")
    out = own.join(mixed, "region", "left").join(before.select("region", "_old", "latest"), "region", "left")
    action = F.when(F.col("n") > most, "REFUSED_SIZE").when(F.col("mixed") > 0, "REFUSED_OVERLAP").when(F.col("_old") == F.col("input_sha256"), "UNCHANGED").otherwise("BUILD")
    return out.select("region", "n", "input_sha256", action.alias("action"))


def late(observations: DataFrame, inputs: DataFrame) -> DataFrame:
    """region, late, earliest: how many observations an earlier run's inputs(region, obs_id, acquired_at) lack although they are older than its newest."""
    newest = inputs.groupBy("region").agg(F.max("acquired_at").alias("newest"))
    new = observations.join(inputs.select("region", "obs_id"), ["region", "obs_id"], "left_anti").join(newest, "region")
    return new.filter(F.col("acquired_at") < F.col("newest")).groupBy("region").agg(F.count("*").alias("late"), F.min("acquired_at").alias("earliest"))


def newest_runs(runs: DataFrame, key: str = "region") -> DataFrame:
    """The newest successful run of each key (ties: the greater run_id)."""
    best = F.max_by(F.struct(*[F.col(c) for c in runs.columns if c != key]), F.struct("completed_at", "run_id"))
    return runs.filter("status = 'SUCCEEDED'").groupBy(key).agg(best.alias("r")).select(key, "r.*")


def newest_overlapping(runs: DataFrame, box: tuple[float, float, float, float], start: str, end: str) -> DataFrame:
    """The newest run that covers a box and meets the days [start, end]: one row at most."""
    w, s, e, n = map(F.lit, box)
    covers = (F.col("west") <= w) & (F.col("south") <= s) & (F.col("east") >= e) & (F.col("north") >= n)
    meets = (F.col("start_date") <= F.lit(end).cast("date")) & (F.col("end_date") >= F.lit(start).cast("date"))
    return runs.filter(covers & meets).orderBy(F.desc("received_at"), F.desc("run_id")).limit(1)


def events_in(events: DataFrame, box: tuple[float, float, float, float], start: Column, end: Column, most: int) -> DataFrame:
    """Events(event_id, west, ..., started_at, ended_at) that meet a box and a half-open time, newest first; `truncated` if there are more."""
    own = tuple(F.col(c) for c in ("west", "south", "east", "north"))
    some = events.filter(geo.boxes_overlap(own, tuple(map(F.lit, box))) & (F.col("started_at") < end) & (F.col("ended_at") >= start)).orderBy(F.desc("started_at"), "event_id").limit(most + 1)
    every = Window.partitionBy()  # of most + 1 rows
    return some.withColumns({"truncated": F.count("*").over(every) > most, "_k": F.row_number().over(every.orderBy(F.desc("started_at"), "event_id"))}).filter(F.col("_k") <= most).drop("_k")


def details(members: DataFrame, *keys: str) -> DataFrame:
    """keys, first, last, members: each event's observations in the order of time and id."""
    order = F.array_sort(F.collect_list(F.struct("acquired_at", "obs_id", "frp_mw")))
    return members.groupBy(*keys).agg(order.alias("members"), F.min("acquired_at").alias("first"), F.max("acquired_at").alias("last"))


def extents(members: DataFrame, *keys: str) -> DataFrame:
    """Each event's box, span and size."""
    return members.groupBy(*keys).agg(F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"), F.min("acquired_at").alias("started_at"), F.max("acquired_at").alias("ended_at"), F.count("*").alias("n"))


def build(observations: DataFrame, folder: str, limits: episodes.Limits = episodes.Limits(), force: bool = False) -> dict:
    """Groups one region's observations(obs_id, acquired_at, lon, lat, product) and saves the run under the folder.

    Returns run_id and status: UNCHANGED (the newest run had the same inputs and limits) or SUCCEEDED. Too many
    inputs, or days of both products, are refused with an error. Runs are only ever added.
    """
    spark: SparkSession = observations.sparkSession
    rows = observations.withColumn("region", F.lit("one"))
    planned = plan(rows, spark.createDataFrame([], "region string, input_sha256 string, latest timestamp")).first()
    if planned is None:
        raise ValueError("NO_INPUTS")
    if planned["action"].startswith("REFUSED"):
        raise ValueError(planned["action"])
    sha = f"{planned['input_sha256']}-{limits.digest()}"
    table = f"{folder.rstrip('/')}/runs"
    path = spark._jvm.org.apache.hadoop.fs.Path(table)
    held = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    newest = newest_runs(spark.read.parquet(table)).first() if held else None
    if newest and newest["input_sha256"] == sha and not force:
        return {"run_id": newest["run_id"], "status": "UNCHANGED", "inputs": planned["n"]}
    run_id = uuid4().hex
    assembled = episodes.assemble(rows.select(F.col("obs_id").alias("id"), "acquired_at", "lon", "lat"), limits).withColumn("run_id", F.lit(run_id))
    assembled.write.parquet(f"{folder.rstrip('/')}/members/{run_id}")
    ledger = spark.createDataFrame([("one", run_id, sha, newest["run_id"] if newest else None, "SUCCEEDED", datetime.now(UTC))], "region string, run_id string, input_sha256 string, previous_run string, status string, completed_at timestamp")
    ledger.write.mode("append").parquet(table)
    return {"run_id": run_id, "status": "SUCCEEDED", "inputs": planned["n"]}
