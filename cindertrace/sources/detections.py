"""Detection files: reading, row-wise validation with reasons, identity, idempotent ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The columns of a detection file.
MOST_ROWS = 20_000
COLUMNS = ["latitude", "longitude", "bright_ti4", "scan", "track", "acq_date", "acq_time", "satellite", "instrument", "confidence", "version", "bright_ti5", "frp", "daynight"]


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """All columns as trimmed text, with file, row_number (from 2, by file) and ragged (another number of cells).

    All files under the path have the header of the first one by name; it must have the required columns,
    each once. A file of more than MOST_ROWS rows is refused.
    """
    lines = spark.read.option("lineSep", "\n").text(path).select(F.regexp_replace("value", r"^\ufeff|\r$", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("at"))
    heads = lines.groupBy("file").agg(F.min_by("line", "at").alias("head"))
    names = [c.strip() for c in heads.orderBy("file").first()["head"].split(",")]
    missing = set(COLUMNS) - set(names)
    if missing or len(names) != len(set(names)):
        raise ValueError(f"missing columns: {sorted(missing)}" if missing else "a column stands twice")
    if not heads.filter(F.col("head") != ",".join(names)).isEmpty():
        raise ValueError("files with different headers")
    numbered = lines.filter("line != ''").withColumn("row_number", F.row_number().over(Window.partitionBy("file").orderBy("at")))
    if not numbered.filter(F.col("row_number") > MOST_ROWS + 1).isEmpty():
        raise ValueError("ROW_LIMIT_EXCEEDED")
    schema = ", ".join(f"`{c}` string" for c in names)
    cells = F.from_csv("line", F.lit(schema))
    rows = numbered.filter("row_number > 1").select("file", "row_number", (F.size(F.split(F.regexp_replace("line", '"[^"]*"', ""), ",")) != len(names)).alias("ragged"), cells.alias("c"))
    return rows.select(*[F.trim(F.col("c")[c]).alias(c) for c in names], "file", "row_number", "ragged")


def number(text: Column) -> Column:
    """A double, or null for empty and for what is no finite number."""
    value = F.nullif(F.trim(text), F.lit("")).try_cast("double")
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def decimal_text(text: Column) -> Column:
    """One spelling for each decimal: no plus, no needless zeros, no minus zero."""
    plain = F.regexp_replace(F.regexp_replace(F.trim(text), r"^\+", ""), r"^(-?)0+(?=\d)", "$1")
    short = F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", "")
    whole = F.regexp_replace(short, r"^(-?)\.", "$10.")
    return F.when(whole.isin("-0", "", "-"), "0").otherwise(whole)


def acquired_at(acq_date: Column, acq_time: Column) -> Column:
    return F.try_to_timestamp(F.concat_ws(" ", acq_date, F.lpad(acq_time, 4, "0")), F.lit("yyyy-MM-dd HHmm"))


def positive(text: Column, least: float = 0.0, strict: bool = True) -> Column:
    """Holds for an empty text too."""
    value = number(text)
    empty = F.coalesce(F.trim(text), F.lit("")) == ""
    return empty | F.coalesce(value > least if strict else value >= least, F.lit(False))


def validate(rows: DataFrame, satellite: str, start: str, days: int, box: tuple[float, float, float, float]) -> DataFrame:
    """Adds acquired_at, lon, lat and reason (null: valid); the first reason that holds is given."""
    lon, lat = number(F.col("longitude")), number(F.col("latitude"))
    rows = rows.withColumns({"acquired_at": acquired_at(F.col("acq_date"), F.col("acq_time")), "lon": lon, "lat": lat})
    first = F.lit(start).cast("date")
    day = F.to_date("acquired_at")
    checks = [
        (F.col("ragged") if "ragged" in rows.columns else F.lit(False), "RAGGED_ROW"),
        ((F.col("instrument") != "VIIRS") | (F.col("satellite") != satellite), "SENSOR_MISMATCH"),
        (~F.col("daynight").isin("D", "N") | (F.coalesce("version", F.lit("")) == ""), "MISSING_PROVENANCE"),
        (~F.coalesce(F.col("acq_time"), F.lit("")).rlike(r"^\d{1,4}$") | F.col("acquired_at").isNull(), "INVALID_TIME"),
        ((day < first) | (day > F.date_add(first, days - 1)), "OUTSIDE_WINDOW"),
        (F.col("lon").isNull() | F.col("lat").isNull() | (F.abs("lon") > 180) | (F.abs("lat") > 90), "INVALID_COORDINATE"),
        (~(F.col("lon").between(box[0], box[2]) & F.col("lat").between(box[1], box[3])), "OUTSIDE_BOUNDS"),
        (~F.coalesce("confidence", F.lit("")).isin("", "l", "n", "h"), "INVALID_CONFIDENCE"),
        (~positive(F.col("frp"), strict=False), "INVALID_FRP"),
        (~(positive(F.col("bright_ti4")) & positive(F.col("bright_ti5"))), "INVALID_BRIGHTNESS"),
        (~(positive(F.col("scan")) & positive(F.col("track"))), "INVALID_PIXEL"),
    ]
    if "type" in rows.columns:  # archived files only
        checks.append((~F.coalesce("type", F.lit("")).isin("", "0", "1", "2", "3"), "INVALID_TYPE"))
    reason = None
    for bad, name in checks:
        bad = F.coalesce(bad, F.lit(True))
        reason = F.when(bad, name) if reason is None else reason.when(bad, name)
    return rows.withColumn("reason", reason)


def identity(namespace: str, product: str) -> Column:
    """SHA-256 of the sorted compact JSON of what makes an observation the same."""
    fields = {
        "acquired_at": F.date_format("acquired_at", "yyyy-MM-dd'T'HH:mm:ss'+00:00'"),
        "latitude": decimal_text(F.col("latitude")),
        "longitude": decimal_text(F.col("longitude")),
        "namespace": F.lit(namespace),
        "product": F.lit(product),
        "satellite": F.col("satellite"),
        "sensor": F.lit("VIIRS"),
        "version": F.lit("firms-identity-v1"),
    }
    return F.sha2(F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()])), 256)


def payload_hash() -> Column:
    """Tells revisions of one observation apart: all values that it has, numbers by their value."""
    numbers = {c: number(F.col(c)).alias(c) for c in ("latitude", "longitude", "bright_ti4", "bright_ti5", "scan", "track", "frp")}
    texts = {c: F.nullif(F.trim(F.col(c)), F.lit("")).alias(c) for c in ("satellite", "instrument", "confidence", "version", "daynight")}
    fields = numbers | texts | {"acquired_at": F.date_format("acquired_at", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("acquired_at")}
    return F.sha2(F.to_json(F.struct(*[fields[c] for c in sorted(fields)]), {"ignoreNullFields": "false"}), 256)


def receipts(outcomes: DataFrame) -> DataFrame:
    """run_id, row_number, id of every accepted row of ingest() outcomes (with their run_id), duplicates too."""
    return outcomes.filter("outcome != 'SOURCE_REVISION_CONFLICT'").select("run_id", "row_number", "id")


def ledger(outcomes: DataFrame, rejected: DataFrame) -> DataFrame:
    """One row for each run of outcomes(run_id, outcome) and rejected(run_id): its counts and status."""
    rows = outcomes.select("run_id", "outcome").unionByName(rejected.select("run_id", F.lit("REJECTED").alias("outcome")))
    bad = F.col("outcome").isin("REJECTED", "SOURCE_REVISION_CONFLICT")
    counts = rows.groupBy("run_id").agg(F.count("*").alias("total_rows"), F.count_if(~bad).alias("accepted_rows"), F.count_if(F.col("outcome") == "INSERTED").alias("inserted_rows"), F.count_if(F.col("outcome") == "DUPLICATE").alias("duplicate_rows"), F.count_if(bad).alias("rejected_rows"))
    return counts.withColumn("status", F.when(F.col("rejected_rows") > 0, "PARTIAL").otherwise("SUCCEEDED"))


def clocks_in_order(acquired: Column, published: Column, available: Column, ingested: Column, evidence: Column) -> Column:
    """Do the four clocks of an observation agree? Unknown availability may not be invented."""
    known = F.when(evidence == "KNOWN", available.isNotNull()).when(evidence == "UNKNOWN", available.isNull()).otherwise(False)
    in_order = (F.coalesce(published, acquired) >= acquired) & (F.coalesce(available, published, acquired) >= F.coalesce(published, acquired)) & (ingested >= F.coalesce(available, acquired))
    return F.coalesce(known & in_order, F.lit(False))


def known_as_of(acquired: Column, available: Column, evidence: Column, as_of: Column) -> Column:
    return F.coalesce((evidence == "KNOWN") & (acquired <= as_of) & (available <= as_of), F.lit(False))


def ingest(known: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming(id, payload, row_number) with outcome: INSERTED, DUPLICATE or SOURCE_REVISION_CONFLICT.

    The first row of an id wins, before it whatever is known(id, payload).
    """
    first = Window.partitionBy("id").orderBy("row_number")
    rows = incoming.withColumns({"n": F.row_number().over(first), "first_payload": F.first("payload").over(first)})
    rows = rows.join(known.select("id", F.col("payload").alias("known_payload")), "id", "left")
    winner = F.coalesce("known_payload", "first_payload")
    outcome = F.when(F.col("payload") != winner, "SOURCE_REVISION_CONFLICT").when((F.col("n") == 1) & F.col("known_payload").isNull(), "INSERTED").otherwise("DUPLICATE")
    return rows.select("id", "row_number", outcome.alias("outcome"))
