"""Episodes as a stream against the batch over the same rows."""

from datetime import UTC, datetime, timedelta
from random import Random

from pyspark.sql import functions as F

from cindertrace.operators import episodes
from cindertrace.streaming import assembly
from cindertrace.streaming import episodes as streams

T0 = datetime(2026, 1, 1)
SHAPE = "id long, area long, acquired_at timestamp, lon double, lat double"


def arrivals(spark, tmp_path, batches, **options):
    """The rows that come out when batches arrive one after another, each in a run of its own."""
    for rows in batches:
        spark.createDataFrame(rows, SHAPE).write.mode("append").parquet(f"{tmp_path}/in")
        source = spark.readStream.schema(SHAPE).parquet(f"{tmp_path}/in")
        q = assembly.episodes_stream(source, "area", **options).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out").collect()


def test_stream_equals_batch(spark, tmp_path):
    """Two areas of chains that merge, split by span and diameter; rows come within the delay in any order."""
    rng = Random(9)
    rows = [(k, k % 2, T0 + timedelta(hours=rng.randrange(0, 900)), 70.0 + (k % 2) + 0.004 * rng.randrange(6), 22.0 + 0.002 * rng.randrange(3)) for k in range(160)]
    order = sorted(rows, key=lambda r: r[2] + timedelta(hours=rng.randrange(0, 60)))
    far = [(10_000 + a, a, T0 + timedelta(days=400), 70.0 + a, 22.0) for a in (0, 1)]
    got = arrivals(spark, tmp_path, [order[:50], order[50:110], [*order[110:], *far]], delay=timedelta(days=4))
    assert all(r["kind"] == "EPISODE" for r in got)
    want = episodes.assemble(spark.createDataFrame(rows, SHAPE)).groupBy("event_id", "event_ambiguous", "merges").agg(F.array_sort(F.collect_list("id")).alias("m"), F.first("event_diameter_m").alias("d")).collect()
    assert sorted((r["event_id"], r["event_ambiguous"], r["merges"], r["members"], round(r["event_diameter_m"], 6)) for r in got) == sorted((r["event_id"], r["event_ambiguous"], r["merges"], r["m"], round(r["d"], 6)) for r in want)
    assert len(got) > 20 and any(r["merges"] for r in got) and any(r["event_ambiguous"] for r in got)


def test_late_rows_and_open_episodes(spark, tmp_path):
    at = lambda k, h: (k, 1, T0 + timedelta(hours=h), 70.0, 22.0)
    batches = [[at(1, 0), at(2, 20), at(3, 200)], [at(4, 10), at(5, 199), (None, 1, T0, 70.0, 22.0)], [at(6, 500), at(7, 100)]]
    got = {(r["kind"], r["anchor"]): r for r in arrivals(spark, tmp_path, batches, delay=timedelta(hours=48), drop=timedelta(hours=1000))}
    assert set(got) == {("EPISODE", 1), ("LATE", 4), ("LATE", 7), ("EPISODE", 5)}  # 6 is still open
    assert got["EPISODE", 1]["members"] == [1, 2] and got["EPISODE", 5]["members"] == [3, 5]
    assert got["EPISODE", 5]["started_at"].replace(tzinfo=UTC) == (T0 + timedelta(hours=199)).replace(tzinfo=UTC)


def test_sessions_as_they_close(spark, tmp_path):
    """What has closed by the last watermark, and nothing else."""
    rows = [(k, 1, T0 + timedelta(hours=h), 1.0) for k, h in enumerate([0, 1, 2, 40, 400])]
    df = spark.createDataFrame(rows + rows[:2], "obs_id long, place long, acquired_at timestamp, frp_mw double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    out = streams.closed_sessions(source.dropDuplicates(["obs_id"]), "24 hours", "1 hour")
    q = out.writeStream.outputMode("append").format("memory").queryName("closed_by_then").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r["n"], r["started_at"]) for r in spark.table("closed_by_then").collect()) == [(1, T0 + timedelta(hours=40)), (3, T0)]
