"""Stored runs of the grouping that build only what new inputs touch.

A run is a folder with its spots (and their components), its members (observations with episode and
site) and its lineage, and an entry in the ledger. The next run starts from the newest one:

* components: pairs are taken only between spots that are new, or whose component has lost a spot, and
  all others; components of the run before are nodes of the graph, not their spots;
* episodes: each run between silences has a digest of its observations. Digests that the run before had
  carry its episodes over, with their observations as they were stored; only other runs are numbered. What
  a run of observations gives depends on nothing else, so the result is that of a build from nothing;
* sites: likewise by the digest of a component's episodes;
* lineage: carried episodes are the SAME; rebuilt ones are compared with those that their observations had.

Entries are numbered files. A writer may only create the entry after the one that it started from, and
creating an entry that exists fails, so of two writers one wins and the other builds again from the
winner's run. (This needs a file system whose create is exclusive, as HDFS and local disks have it.)
What a writer leaves behind that does not win, or dies, is never read.

Defined results: as in episodes; an empty table is refused, as are too many inputs and days of both
products where limits are asked for. Rows that an earlier run had and this one lacks are gone.
"""

from __future__ import annotations

import json
from datetime import UTC, datetime
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindertrace.operators import episodes
from cindertrace.operators.components import checkpointed, components
from cindertrace.operators.episodes import Limits
from cindertrace.operators.labels import fingerprint
from cindertrace.operators.runs import overlap_days

#: Writers that may win before this one gives up.
TRIES = 5


class Conflict(Exception):
    """Another writer has committed the run that this one meant to."""


class Ledger:
    """Numbered entries in a folder, each created once."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/ledger")
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def newest(self) -> dict | None:
        """The entry with the greatest number; the ledger has a short line for each run."""
        if not self.files.exists(self.path):
            return None
        numbers = [int(f.getPath().getName()) for f in self.files.listStatus(self.path) if f.getPath().getName().isdigit() and f.getLen()]
        if not numbers:
            return None
        text = self.spark.read.text(f"{self.folder}/ledger/{max(numbers):09d}", wholetext=True).first()[0]
        return json.loads(text)

    def create(self, number: int, entry: dict) -> None:
        """Raises Conflict if the number is taken."""
        place = self.spark._jvm.org.apache.hadoop.fs.Path(self.path, f"{number:09d}")
        try:
            out = self.files.create(place, False)
        except Exception as e:
            if self.files.exists(place):
                raise Conflict(str(number)) from e
            raise
        out.write(json.dumps(entry | {"number": number}).encode())
        out.close()


def digest(*columns: str) -> list:
    """Two sums over rows that tell sets of rows apart, whatever their order."""
    return [F.sum(F.xxhash64(*columns).cast("decimal(38,0)")).alias("d1"), F.bit_xor(F.xxhash64(F.lit(1), *columns)).alias("d2"), F.count("*").alias("size")]


DIGEST = ["d1", "d2", "size"]


def grown_components(spots: DataFrame, before: DataFrame | None, reach: float) -> DataFrame:
    """spot, lon, lat, root of all spots, given those of the run before (spot, lon, lat, root)."""
    if before is None:
        before = spots.select("*", F.col("spot").alias("root")).limit(0)
    old = before.select("spot", "root")
    broken = old.join(spots.hint("merge"), "spot", "left_anti").select("root").distinct()
    known = checkpointed(spots.join(old.hint("merge"), "spot").join(broken.hint("merge"), "root", "left_anti").select("spot", "lon", "lat", "root"))
    fresh = checkpointed(episodes.by_small_cells(spots.join(known.select("spot").hint("merge"), "spot", "left_anti").select("spot", "lon", "lat"), reach))
    every = checkpointed(known.unionByName(fresh))
    pairs = episodes.linked_roots(every, fresh, reach)
    roots = components(every.select(F.col("root").alias("node")).distinct(), pairs).select(F.col("node").alias("root"), F.col("root").alias("new"))
    joined = every.join(roots.hint("merge"), "root")
    # a component goes by its least spot, as if built from nothing
    least = joined.groupBy("new").agg(F.min("spot").alias("least"))
    return joined.join(least.hint("merge"), "new").select("spot", "lon", "lat", F.col("least").alias("root"))


def attempt(points: DataFrame, folder: str, base: dict | None, limits: Limits, entry: dict) -> dict:
    """Writes a run next to the one of the entry `base`; returns its own entry."""
    spark = points.sparkSession
    run_id = uuid4().hex
    own = f"{folder}/{run_id}"

    def earlier(name: str) -> DataFrame | None:
        return spark.read.parquet(f"{folder}/{base['run_id']}/{name}") if base else None

    spots = checkpointed(grown_components(checkpointed(episodes.spots_of(points)), earlier("spots"), episodes.reach_of(limits)))
    spots.write.parquet(f"{own}/spots")
    runs = checkpointed(episodes.silence_runs(points.join(spots.select("spot", "root").hint("merge"), "spot"), limits.gap_hours))
    sums = runs.groupBy("root", "run").agg(*digest("id", "acquired_at", "lon", "lat"))
    before = earlier("members")
    if before is None:
        new = episodes.episodes_of_runs(runs, limits).join(sums.hint("merge"), ["root", "run"])
        members = checkpointed(new.withColumn("carried", F.lit(False)))
    else:
        sums = checkpointed(sums)
        held = before.select(*DIGEST).distinct()
        fresh = sums.join(held.hint("merge"), DIGEST, "left_anti")
        new = episodes.episodes_of_runs(runs.join(fresh.select("root", "run").hint("merge"), ["root", "run"], "left_semi"), limits).join(fresh.hint("merge"), ["root", "run"]).withColumn("carried", F.lit(False))
        # equal digests, equal observations: all that a stored row lacks is what its run is called now
        kept = before.drop("root", "run", "carried").join(sums.hint("merge"), DIGEST).withColumn("carried", F.lit(True))
        members = checkpointed(new.unionByName(kept.select(*new.columns)))
    events = checkpointed(episodes.events_of(members))
    event_sums = events.groupBy("root").agg(*digest("event_id")).withColumnsRenamed({c: f"site_{c}" for c in DIGEST})
    site_columns = ["event_id", "site_id", "site_ambiguous", "site_diameter_m"]
    site_digest = [f"site_{c}" for c in DIGEST]
    if before is None:
        sites = episodes.sites_of_components(events, limits)
    else:
        held = before.select(*site_digest).distinct().withColumn("known", F.lit(True))
        told = checkpointed(events.join(event_sums.join(held.hint("merge"), site_digest, "left").select("root", F.coalesce("known", F.lit(False)).alias("known")).hint("merge"), "root"))
        kept = told.filter("known").select("event_id").join(before.select(*site_columns).distinct().hint("merge"), "event_id")
        sites = episodes.sites_of_components(told.filter("NOT known").drop("known"), limits).unionByName(kept)
    told = events.select("event_id", "root").join(event_sums.hint("merge"), "root").drop("root").join(sites.hint("merge"), "event_id")
    members.join(told.hint("merge"), "event_id").write.parquet(f"{own}/members")
    written = spark.read.parquet(f"{own}/members")
    counts = written.agg(F.count_if("carried").alias("carried"), F.count_distinct("event_id").alias("events"), F.count_distinct("site_id").alias("sites"), F.max("acquired_at").alias("latest")).first()
    if before is None:
        lineage = spark.createDataFrame([], "new_id string, old_id string, relation string, shared long")
        late = (0, None)
    else:
        same = written.filter("carried").groupBy("event_id").agg(F.count("*").alias("shared")).select(F.col("event_id").alias("new_id"), F.col("event_id").alias("old_id"), F.lit("SAME").alias("relation"), "shared")
        rebuilt = written.filter("NOT carried").select("event_id", F.col("id").alias("obs_id"))
        replaced = before.select("event_id", F.col("id").alias("obs_id")).join(same.select(F.col("old_id").alias("event_id")), "event_id", "left_anti")
        lineage = same.unionByName(episodes.lineage(rebuilt, replaced))
        cutoff = F.lit(base["latest"]).cast("timestamp")
        missed = points.select("id", "acquired_at").filter(F.col("acquired_at") < cutoff).join(before.select("id").hint("merge"), "id", "left_anti")
        late = missed.agg(F.count("*"), F.min("acquired_at").cast("string")).first()
    lineage.write.parquet(f"{own}/lineage")
    return entry | {
        "run_id": run_id, "previous_run": base and base["run_id"], "status": "SUCCEEDED", "carried": counts["carried"], "events": counts["events"], "sites": counts["sites"],
        "latest": str(counts["latest"]), "late": late[0], "earliest_late": late[1], "completed_at": datetime.now(UTC).isoformat(),
    }


def build(observations: DataFrame, folder: str, limits: Limits = Limits(), force: bool = False, most: int | None = None) -> dict:
    """Groups observations(id, acquired_at, lon, lat, product) into a stored run; returns its ledger entry, or status UNCHANGED.

    most: refuses more inputs than that. Days that both products of one sensor cover are refused.
    """
    spark = observations.sparkSession
    folder = folder.rstrip("/")
    ledger = Ledger(spark, folder)
    rows = observations.withColumn("region", F.lit("one"))
    if "product" in rows.columns and not overlap_days(rows).isEmpty():
        raise ValueError("REFUSED_OVERLAP")
    points = checkpointed(episodes.points_of(observations))
    told = fingerprint(points, [], "id", "acquired_at", "lon", "lat").first()
    if told is None or not told["n"]:
        raise ValueError("NO_INPUTS")
    if most is not None and told["n"] > most:
        raise ValueError("REFUSED_SIZE")
    entry = {"inputs": told["n"], "input_sha256": told["digest"], "limits": limits.digest()}
    for _ in range(TRIES):
        newest = ledger.newest()
        if newest and not force and all(newest[k] == v for k, v in entry.items()):
            return newest | {"status": "UNCHANGED"}
        base = newest if newest and newest["limits"] == entry["limits"] else None
        made = attempt(points, folder, base, limits, entry)
        try:
            ledger.create(newest["number"] + 1 if newest else 0, made)
            return made | {"number": newest["number"] + 1 if newest else 0}
        except Conflict:
            continue
    raise Conflict("other writers won every time")


def newest_members(spark: SparkSession, folder: str) -> DataFrame:
    """The newest run's members: id, acquired_at, lon, lat, event_id, site_id and what else is told of both."""
    newest = Ledger(spark, folder).newest()
    if newest is None:
        raise ValueError("NO_RUN")
    return spark.read.parquet(f"{folder.rstrip('/')}/{newest['run_id']}/members")


def newest_lineage(spark: SparkSession, folder: str) -> DataFrame:
    """new_id, old_id, relation, shared of the newest run against the one before it."""
    newest = Ledger(spark, folder).newest()
    if newest is None:
        raise ValueError("NO_RUN")
    return spark.read.parquet(f"{folder.rstrip('/')}/{newest['run_id']}/lineage")


def newest_events(spark: SparkSession, folder: str) -> DataFrame:
    """The newest run's events: box, times, size, site, and how many events and observations the site has."""
    m = newest_members(spark, folder)
    sites = m.groupBy("site_id").agg(F.count_distinct("event_id").alias("site_events"), F.count("*").alias("site_observations"))
    own = m.groupBy("event_id", "site_id").agg(
        F.min("lon").alias("west"), F.min("lat").alias("south"), F.max("lon").alias("east"), F.max("lat").alias("north"), F.min("acquired_at").alias("started_at"), F.max("acquired_at").alias("ended_at"), F.count("*").alias("n"),
        F.round(F.first("event_diameter_m"), 1).alias("diameter_m"), F.first("event_ambiguous").alias("ambiguous"), F.min_by("id", F.struct("acquired_at", "id")).alias("anchor"),
    )
    return own.join(sites, "site_id")
