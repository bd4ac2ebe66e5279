"""Stores that take in batches once: detections with receipts and quarantine, map snapshots by their content.

A batch goes by the digest of its rows. What it brings is written to a folder of its own; it counts when
its entry in the ledger is created, and an entry can be created only after the one that the writer started
from (operators.increments.Ledger). So a batch that is delivered again, at once or later, is REPEATED and
adds nothing, and a writer that loses compares its batch with what the winner has brought. Folders
of writers that lose or die are never read.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindertrace.operators.components import checkpointed
from cindertrace.operators.increments import TRIES, Conflict, Ledger
from cindertrace.operators.labels import fingerprint
from cindertrace.sources import detections, mapped


def committed(spark: SparkSession, folder: str) -> list[dict]:
    """The entries of a store in their order: a short line for each batch."""
    import json

    ledger = Ledger(spark, folder)
    if ledger.newest() is None:
        return []
    lines = spark.read.text(f"{folder.rstrip('/')}/ledger", wholetext=True).filter("value != ''").collect()
    return sorted((json.loads(r["value"]) for r in lines), key=lambda e: e["number"])


def part(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """What all committed batches have of one kind."""
    paths = [f"{folder.rstrip('/')}/{e['data']}/{name}" for e in committed(spark, folder) if e["data"]]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def append(spark: SparkSession, folder: str, sha: str, bring: Callable[[str], dict]) -> dict:
    """Commits a batch; bring(path) writes it and returns its counts. A known batch gives its first entry, as REPEATED."""
    ledger = Ledger(spark, folder)
    for _ in range(TRIES):
        known = committed(spark, folder)
        same = next((e for e in known if e["sha256"] == sha), None)
        if same:
            return same | {"status": "REPEATED"}
        data = uuid4().hex
        entry = {"sha256": sha, "data": data, **bring(f"{folder.rstrip('/')}/{data}")}
        try:
            ledger.create(len(known), entry)
            return entry | {"number": len(known)}
        except Conflict:
            continue
    raise Conflict("other writers won every time")


def digest(rows: DataFrame) -> str:
    """Of all columns of a batch's rows, whatever their order."""
    found = fingerprint(rows, [], *sorted(rows.columns)).first()
    return found["digest"] if found else "none"


OBSERVATION = "id string, payload string, acquired_at timestamp, lon double, lat double, frp_mw double, satellite string, daynight string, batch string, row_number long"
RECEIPT, QUARANTINE = "batch string, row_number long, id string, outcome string", "batch string, row_number long, reason string, raw string"


def receive(rows: DataFrame, folder: str, satellite: str, start: str, days: int, box: tuple[float, float, float, float], namespace: str, product: str) -> dict:
    """Takes in rows of a detection file (with row_number): new observations, a receipt for every valid row, the rest in quarantine.

    A row that gives a known observation other values is a SOURCE_REVISION_CONFLICT: it has a receipt and
    changes nothing. Rows that are not valid are kept as they came, with their reason.
    """
    spark = rows.sparkSession
    batch = uuid4().hex
    checked = checkpointed(detections.validate(rows, satellite, start, days, box).withColumns({"id": F.when(F.col("reason").isNull(), detections.identity(namespace, product)), "payload": detections.payload_hash()}))
    good = checked.filter("reason IS NULL")
    raw = F.to_json(F.struct(*[F.col(c) for c in rows.columns if c != "row_number"]), {"ignoreNullFields": "false"})
    rejected = checked.filter("reason IS NOT NULL").select(F.lit(batch).alias("batch"), F.col("row_number").cast("long").alias("row_number"), "reason", raw.alias("raw"))

    def bring(path: str) -> dict:
        known = part(spark, folder, "observations", OBSERVATION).select("id", "payload")
        told = checkpointed(detections.ingest(known, good.select("id", "payload", "row_number")))
        first = told.filter("outcome = 'INSERTED'").select("id", "row_number")
        own = good.join(first, ["id", "row_number"]).select("id", "payload", "acquired_at", "lon", "lat", detections.number(F.col("frp")).alias("frp_mw"), "satellite", "daynight", F.lit(batch).alias("batch"), F.col("row_number").cast("long").alias("row_number"))
        own.write.parquet(f"{path}/observations")
        told.select(F.lit(batch).alias("batch"), F.col("row_number").cast("long").alias("row_number"), "id", "outcome").write.parquet(f"{path}/receipts")
        rejected.write.parquet(f"{path}/quarantine")
        counts = {r["outcome"]: r["count"] for r in told.groupBy("outcome").count().collect()}
        bad = rejected.count()
        conflicts = counts.get("SOURCE_REVISION_CONFLICT", 0)
        return {"batch": batch, "total": sum(counts.values()) + bad, "inserted": counts.get("INSERTED", 0), "duplicates": counts.get("DUPLICATE", 0), "conflicts": conflicts, "rejected": bad, "status": "PARTIAL" if bad or conflicts else "SUCCEEDED"}

    return append(spark, folder, digest(rows), bring)


def observations(spark: SparkSession, folder: str) -> DataFrame:
    return part(spark, folder, "observations", OBSERVATION)


def receipts(spark: SparkSession, folder: str) -> DataFrame:
    return part(spark, folder, "receipts", RECEIPT)


def quarantine(spark: SparkSession, folder: str) -> DataFrame:
    return part(spark, folder, "quarantine", QUARANTINE)


FEATURE = f"snapshot_id string, type string, id long, tags map<string,string>, rings {mapped.RINGS}, lon double, lat double"
REJECTED = "snapshot_id string, type string, id long, reason string"


def take_snapshot(payload: DataFrame, folder: str, region: str) -> dict:
    """Takes in one map download, payload(json) of one row: its features, or why it cannot be used.

    A snapshot goes by the digest of its text and region. An unusable download is told of and kept out of the store.
    """
    spark = payload.sparkSession
    own = checkpointed(payload.select("json"))
    found = own.select(mapped.payload_problem(F.col("json")).alias("problem"), F.sha2(F.col("json"), 256).alias("sha"), F.get_json_object("json", "$.osm3s.timestamp_osm_base").alias("base_at")).first()
    if found is None or found["problem"]:
        return {"status": "REFUSED", "problem": found["problem"] if found else "NO_ELEMENTS"}
    snapshot = found["sha"]

    def bring(path: str) -> dict:
        rows = checkpointed(mapped.elements(own).withColumn("snapshot_id", F.lit(snapshot)))
        rows.filter("reason IS NULL").select("snapshot_id", "type", "id", "tags", "rings", "lon", "lat").write.parquet(f"{path}/features")
        rows.filter("reason IS NOT NULL").select("snapshot_id", "type", "id", "reason").write.parquet(f"{path}/rejected")
        n = rows.agg(F.count_if(F.col("reason").isNull()).alias("a"), F.count_if(F.col("reason").isNotNull()).alias("r")).first()
        return {"snapshot_id": snapshot, "region": region, "base_at": found["base_at"], "accepted": n["a"], "rejected": n["r"], "status": "SUCCEEDED"}

    return append(spark, folder, f"{region}:{snapshot}", bring)


def features(spark: SparkSession, folder: str) -> DataFrame:
    return part(spark, folder, "features", FEATURE)


def rejected_elements(spark: SparkSession, folder: str) -> DataFrame:
    return part(spark, folder, "rejected", REJECTED)
