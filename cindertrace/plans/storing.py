"""Queries over stored runs (a second run, built from a first one) and over observations that arrive as a stream."""

from __future__ import annotations

from datetime import timedelta
from uuid import uuid4

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindertrace.functions import geo
from cindertrace.operators import increments
from cindertrace.operators.components import shared_folder
from cindertrace.plans.adapter import Tables, sql
from cindertrace.plans.raw import RAW, raw_rows
from cindertrace.registry import register
from cindertrace.sources import stores
from cindertrace.streaming.assembly import episodes_stream


def episodes_sql(name: str, where: str = "true") -> str:
    """name(place, no, obs_id, acquired_at): a place's points all link, so an episode is a cut of its points in their order."""
    ends = f"o.acquired_at - {name}0.acquired_at > INTERVAL 24 HOUR OR o.acquired_at - {name}0.first > INTERVAL 168 HOUR"
    return f""", {name}s AS (SELECT place, obs_id, acquired_at, row_number() OVER (PARTITION BY place ORDER BY acquired_at, obs_id) AS k FROM obs WHERE {where}),
 {name}0 AS (SELECT place, obs_id, acquired_at, k, acquired_at AS first, 1 AS no FROM {name}s WHERE k = 1 UNION ALL SELECT o.place, o.obs_id, o.acquired_at, o.k, CASE WHEN {ends} THEN o.acquired_at ELSE {name}0.first END, {name}0.no + CASE WHEN {ends} THEN 1 ELSE 0 END FROM {name}0 JOIN {name}s o ON o.place = {name}0.place AND o.k = {name}0.k + 1),
 {name} AS (SELECT *, first_value(obs_id) OVER (PARTITION BY place, no ORDER BY acquired_at, obs_id) AS anchor FROM {name}0)"""


def recursive(rest: str) -> str:
    return sql("obs", rest).replace("WITH ", "WITH RECURSIVE ", 1)


#: What the first run has: most of the observations, some late ones and all of some places' missing.
FIRST = "obs_id % 7 <> 3 OR place % 3 > 0"


def stored(t: Tables) -> str:
    """The folder of two runs: one of FIRST, and one of all observations built from it."""
    folder = f"{shared_folder(t.spark)}/runs-{uuid4().hex}"
    o = t.obs().select(F.col("obs_id").alias("id"), "place", "acquired_at", "lon", "lat").withColumnRenamed("id", "obs_id")
    for rows in (o.filter(FIRST), o):
        increments.build(rows.withColumnRenamed("obs_id", "id").drop("place"), folder)
    return folder


NEWEST = episodes_sql("e") + ", ev AS (SELECT place, anchor, min(lon) AS west, min(lat) AS south, max(lon) AS east, max(lat) AS north, min(e.acquired_at) AS started_at, max(e.acquired_at) AS ended_at, count(*) AS n FROM e JOIN obs USING (place, obs_id) GROUP BY place, anchor), st AS (SELECT place, count(*) AS site_events, CAST(sum(n) AS BIGINT) AS site_observations FROM ev GROUP BY place)"
WINDOW = "west <= 70.2 AND east >= 69.6 AND south <= 22.4 AND north >= 22.0 AND started_at < TIMESTAMP '2024-01-20' AND ended_at >= TIMESTAMP '2024-01-05'"


@register(recursive(NEWEST + f" SELECT anchor, n, CAST(epoch(started_at) AS BIGINT) AS started_at, site_events, site_observations FROM ev JOIN st USING (place) WHERE {WINDOW}"))
def newest_run_events(t: Tables) -> DataFrame:
    """Events of the newest run that meet a window, with what their site holds in all."""
    found = increments.newest_events(t.spark, stored(t))
    own = tuple(F.col(c) for c in ("west", "south", "east", "north"))
    box = tuple(map(F.lit, (69.6, 22.0, 70.2, 22.4)))
    meets = geo.boxes_overlap(own, box) & (F.col("started_at") < F.lit("2024-01-20").cast("timestamp")) & (F.col("ended_at") >= F.lit("2024-01-05").cast("timestamp"))
    return found.filter(meets).select("anchor", "n", F.unix_timestamp("started_at").alias("started_at"), "site_events", "site_observations")


LINEAGE = episodes_sql("e") + episodes_sql("b", FIRST) + """, l AS (SELECT e.anchor AS new_anchor, b.anchor AS old_anchor, count(*) AS shared FROM e JOIN b USING (obs_id) GROUP BY ALL), en AS (SELECT anchor, count(*) AS n FROM e GROUP BY anchor), bn AS (SELECT anchor, count(*) AS n FROM b GROUP BY anchor),
 c AS (SELECT l.*, en.n AS nn, bn.n AS no, count(*) OVER (PARTITION BY new_anchor) AS s, count(*) OVER (PARTITION BY old_anchor) AS t FROM l JOIN en ON en.anchor = new_anchor JOIN bn ON bn.anchor = old_anchor)
 SELECT new_anchor, old_anchor, CASE WHEN s > 1 AND t > 1 THEN 'CHANGED' WHEN s > 1 THEN 'MERGED' WHEN t > 1 THEN 'SPLIT' WHEN shared = nn AND shared = no THEN 'SAME' WHEN shared = no THEN 'GREW' WHEN shared = nn THEN 'SHRANK' ELSE 'CHANGED' END AS relation, shared FROM c"""


@register(recursive(LINEAGE))
def newest_run_lineage(t: Tables) -> DataFrame:
    """How the second run's events relate to the first's, by the first observation of each."""
    folder = stored(t)
    newest = increments.Ledger(t.spark, folder).newest()
    anchors = [t.spark.read.parquet(f"{folder}/{run}/members").select("event_id", "anchor").distinct() for run in (newest["run_id"], newest["previous_run"])]
    new, old = (a.select(F.col("event_id").alias(f"{w}_id"), F.col("anchor").alias(f"{w}_anchor")) for a, w in zip(anchors, ("new", "old"), strict=True))
    return increments.newest_lineage(t.spark, folder).join(new, "new_id").join(old, "old_id").select("new_anchor", "old_anchor", "relation", "shared")


@register(recursive(episodes_sql("e") + f" SELECT (SELECT count(*) FROM obs) AS inputs, (SELECT count(DISTINCT anchor) FROM e) AS events, (SELECT count(DISTINCT place) FROM obs) AS sites, count(*) AS late, CAST(epoch(min(acquired_at)) AS BIGINT)::DOUBLE AS earliest_late FROM obs WHERE NOT ({FIRST}) AND acquired_at < (SELECT max(acquired_at) FROM obs WHERE {FIRST})"))
def newest_run_entry(t: Tables) -> DataFrame:
    """What the ledger says of the second run."""
    entry = increments.Ledger(t.spark, stored(t)).newest()
    row = t.spark.createDataFrame([(entry["inputs"], entry["events"], entry["sites"], entry["late"], entry["earliest_late"])], "inputs long, events long, sites long, late long, earliest string")
    return row.select("inputs", "events", "sites", "late", F.unix_timestamp(F.col("earliest").cast("timestamp")).cast("double").alias("earliest_late"))


#: Which of three arrivals an observation comes with: in time, but for every third that comes up to three days late and a few that come last of all.
ARRIVAL = "CASE WHEN obs_id % 97 = 0 THEN 2 WHEN acquired_at < CASE WHEN obs_id % 3 = 0 THEN TIMESTAMP '2024-01-08' ELSE TIMESTAMP '2024-01-11' END THEN 0 WHEN acquired_at < TIMESTAMP '2024-01-21' THEN 1 ELSE 2 END"
DELAY = timedelta(days=7)
#: Later than the delay when they come; and what the stream has taken in by its end.
LATE = f"({ARRIVAL} = 1 AND acquired_at < (SELECT max(acquired_at) FROM obs WHERE {ARRIVAL} = 0) - INTERVAL 7 DAY OR {ARRIVAL} = 2 AND acquired_at < (SELECT max(acquired_at) FROM obs WHERE {ARRIVAL} < 2) - INTERVAL 7 DAY)"
BOUND = "(SELECT max(acquired_at) FROM obs) - INTERVAL 7 DAY"


@register(recursive(episodes_sql("e", f"NOT {LATE} AND acquired_at < {BOUND}") + f""", ev AS (SELECT place, anchor, min(acquired_at) AS started_at, max(acquired_at) AS ended_at, count(*) AS n FROM e GROUP BY place, anchor)
 SELECT 'EPISODE' AS kind, place, anchor, CAST(epoch(started_at) AS BIGINT) AS started_at, CAST(epoch(ended_at) AS BIGINT) AS ended_at, n FROM ev WHERE {BOUND} - ended_at > INTERVAL 24 HOUR OR {BOUND} - started_at > INTERVAL 168 HOUR
 UNION ALL SELECT 'LATE', place, obs_id, CAST(epoch(acquired_at) AS BIGINT), CAST(epoch(acquired_at) AS BIGINT), 1 FROM obs WHERE {LATE}"""))
def streamed_episodes(t: Tables) -> DataFrame:
    """Episodes that have closed, and late observations, when all observations have come in three arrivals."""
    folder = f"{shared_folder(t.spark)}/stream-{uuid4().hex}"
    rows = t.obs().select(F.col("obs_id").alias("id"), "place", "acquired_at", "lon", "lat", F.expr(ARRIVAL).alias("arrival"))
    for k in range(3):
        rows.filter(F.col("arrival") == k).drop("arrival").write.mode("append").parquet(f"{folder}/in")
        source = t.spark.readStream.schema(rows.drop("arrival").schema).parquet(f"{folder}/in")
        out = episodes_stream(source, "place", delay=DELAY).writeStream.format("parquet").option("checkpointLocation", f"{folder}/state")
        out.trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
    found = t.spark.read.parquet(f"{folder}/out")
    return found.select("kind", "place", "anchor", F.unix_timestamp("started_at").alias("started_at"), F.unix_timestamp("ended_at").alias("ended_at"), F.size("members").cast("long").alias("n"))


#: Two batches that share a third of their rows; the first comes a second time.
BATCHES = ("id % 3 <> 0", "id % 3 <> 1")
#: An observation by what makes it the same, the values of a revision, and the batch that a row comes with first.
PUT = RAW + f""", w AS (SELECT v.*, strftime(ts, '%Y-%m-%d') || '|' || lpad(tm, 4, '0') || '|' || CAST(la AS DOUBLE) || '|' || CAST(lo AS DOUBLE) AS key, concat_ws('|', frp, conf, dn) AS payload FROM v WHERE reason IS NULL),
 b AS (SELECT 1 AS n, * FROM w WHERE {BATCHES[0]} UNION ALL SELECT 2, * FROM w WHERE {BATCHES[1]}), o AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n, id) AS k, first_value(payload) OVER (PARTITION BY key ORDER BY n, id) AS first FROM b),
 bad AS (SELECT 1 AS n, reason FROM v WHERE reason IS NOT NULL AND {BATCHES[0]} UNION ALL SELECT 2, reason FROM v WHERE reason IS NOT NULL AND {BATCHES[1]})"""


@register(PUT + " SELECT n AS batch, count(*) AS receipts, count(*) FILTER (k = 1) AS inserted, count(*) FILTER (k > 1 AND payload = first) AS duplicates, count(*) FILTER (payload <> first) AS conflicts, (SELECT count(*) FROM bad WHERE bad.n = o.n) AS quarantined FROM o GROUP BY n")
def receipt_store(t: Tables) -> DataFrame:
    """What a store holds of two batches, the first of which was delivered twice."""
    folder = f"{shared_folder(t.spark)}/store-{uuid4().hex}"
    rows = raw_rows(t).withColumn("row_number", F.col("id")).drop("id")
    for where in (*BATCHES, BATCHES[0]):
        entry = stores.receive(rows.filter(where.replace("id", "row_number")), folder, "N20", "2024-01-10", 5, (69.5, 22.0, 70.5, 23.0), "nasa", "VIIRS_NOAA20_NRT")
    assert entry["status"] == "REPEATED"
    names = t.spark.createDataFrame([(e["batch"], e["number"] + 1) for e in stores.committed(t.spark, folder)], "batch string, n int")
    counts = stores.receipts(t.spark, folder).groupBy("batch").agg(F.count("*").alias("receipts"), *[F.count_if(F.col("outcome") == o).alias(c) for o, c in (("INSERTED", "inserted"), ("DUPLICATE", "duplicates"), ("SOURCE_REVISION_CONFLICT", "conflicts"))])
    gone = stores.quarantine(t.spark, folder).groupBy("batch").agg(F.count("*").alias("quarantined"))
    return counts.join(gone, "batch").join(names, "batch").select(F.col("n").alias("batch"), "receipts", "inserted", "duplicates", "conflicts", "quarantined")
