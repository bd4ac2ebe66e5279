"""Sinks: spreadsheet-safe CSV cells, GeoJSON features, packages with digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindertrace.functions.geo import support_radius_m
from cindertrace.sources.requests import refuse_over

# What spreadsheets take for the start of a formula (the last four are full-width signs).
FORMULA = r"^[  　]*[=+\-@\t\r\n＝＋－＠]"


def csv_cell(text: Column) -> Column:
    """A text that a spreadsheet would evaluate gets an apostrophe; null is empty."""
    return F.when(text.isNull(), "").when(text.rlike(FORMULA), F.concat(F.lit("'"), text)).otherwise(text)


def write_csv(records: DataFrame, path: str) -> None:
    cells = [csv_cell(F.col(c)).alias(c) if t == "string" else F.col(c) for c, t in records.dtypes]
    records.select(cells).write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)


def features(records: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One GeoJSON feature (a JSON text) for each record; numbers that are no numbers become null."""
    own = [F.when(~F.isnan(c), F.col(c)).alias(c) if t in ("double", "float") else F.col(c) for c, t in records.dtypes if c not in (lon, lat)]
    point = F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates"))
    return records.select(F.to_json(F.struct(F.lit("Feature").alias("type"), point.alias("geometry"), F.struct(*own).alias("properties")), {"ignoreNullFields": "false"}).alias("feature"))


def verify(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """path, problem for manifest(path, sha256) against files(path, sha256)."""
    both = manifest.withColumnRenamed("sha256", "wanted").join(files.withColumnRenamed("sha256", "found"), "path", "full")
    problem = F.when(F.col("found").isNull(), "MISSING").when(F.col("wanted").isNull(), "NOT_IN_MANIFEST").when(F.col("wanted") != F.col("found"), "HASH_MISMATCH")
    return both.select("path", problem.alias("problem")).filter("problem IS NOT NULL")


def package_files(spark, folder: str) -> DataFrame:
    """path and sha256 of all files of a package."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
    return raw.select("path", F.sha2("content", 256).alias("sha256"))


# The columns of an export, in their order.
RECORD = [
    "observation_id", "acquired_at_utc", "latitude", "longitude", "location_meaning", "pixel_support_radius_m", "pixel_support_basis", "frp_mw", "brightness_i4_k", "brightness_i5_k", "scan_km", "track_km", "daynight", "nasa_confidence",
    "satellite", "sensor", "product", "collection_version", "data_mode", "historical_availability", "raw_file_sha256", "raw_row_number", "ingestion_run_id", "imported_at_utc", "source_attribution",
]


def finite(value: Column) -> Column:
    return F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)


def utc(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def records(observations: DataFrame, mode: str, attribution: str) -> DataFrame:
    """The RECORD columns of observations with their newest receipt (run_id, row_number, received_at, file_sha256)."""
    known = F.col("scan").isNotNull() & F.col("track").isNotNull()
    values = {
        "observation_id": F.col("obs_id"), "acquired_at_utc": utc(F.col("acquired_at")), "latitude": finite(F.col("lat")), "longitude": finite(F.col("lon")), "location_meaning": F.lit("PIXEL_CENTRE"),
        "pixel_support_radius_m": F.round(support_radius_m(F.col("scan"), F.col("track")), 1), "pixel_support_basis": F.when(known, "SCAN_TRACK").otherwise("NOMINAL_VIIRS_I_BAND"), "frp_mw": finite(F.col("frp_mw")), "brightness_i4_k": finite(F.col("i4")), "brightness_i5_k": finite(F.col("i5")),
        "scan_km": finite(F.col("scan")), "track_km": finite(F.col("track")), "daynight": F.col("daynight"), "nasa_confidence": F.col("confidence"), "satellite": F.col("satellite"), "sensor": F.lit("VIIRS"), "product": F.col("product"), "collection_version": F.col("version"), "data_mode": F.lit(mode),
        "historical_availability": F.lit("KNOWN" if mode == "LIVE" else "UNKNOWN"), "raw_file_sha256": F.col("file_sha256"), "raw_row_number": F.col("row_number"), "ingestion_run_id": F.col("run_id"), "imported_at_utc": utc(F.col("received_at")), "source_attribution": F.concat(F.lit(attribution), F.col("product")),
    }
    return observations.select(*[values[c].alias(c) for c in RECORD])


def feature_collection(records: DataFrame, most: int, lon: str = "lon", lat: str = "lat") -> str:
    """A GeoJSON text of at most `most` records; more are refused, not cut."""
    rows = refuse_over(features(records, lon, lat), most).collect()  # bounded by `most`
    return '{"type":"FeatureCollection","features":[' + ",".join(r["feature"] for r in rows) + "]}"


def manifest_digest(entries: DataFrame) -> str:
    """SHA-256 over path and digest of a package's files, in the order of their paths: a row for each file of one package."""
    return entries.agg(F.expr("sha2(listagg(concat(path, ' ', sha256), '\n') WITHIN GROUP (ORDER BY path), 256)").alias("d")).first()["d"]


def package_runs(passes: DataFrame) -> DataFrame:
    """product, start_date, end_date, sha256, received_at, status, files, shared: saved files by window; shared tells of another file for it."""
    from pyspark.sql import Window

    rows = passes.groupBy("product", "start_date", "end_date", "sha256").agg(F.min("received_at").alias("received_at"), F.min("status").alias("status"), F.count("*").alias("files"))
    return rows.withColumn("shared", F.count("*").over(Window.partitionBy("product", "start_date", "end_date")) > 1)


def with_sidecars(files: DataFrame, sidecars: DataFrame) -> DataFrame:
    """path, sha256, retrieved_at and use of saved files: USABLE, NO_SIDECAR, or UNREADABLE_TIME."""
    notes = sidecars.groupBy("sha256").agg(F.min("retrieved_at").alias("said"), F.count("*").alias("_n"))
    at = F.try_to_timestamp("said")
    use = F.when(F.col("_n").isNull(), "NO_SIDECAR").when(at.isNull(), "UNREADABLE_TIME").otherwise("USABLE")
    return files.join(notes, "sha256", "left").select("path", "sha256", at.alias("retrieved_at"), use.alias("use"))


def put_once(spark, folder: str, payload: bytes, suffix: str = "") -> str:
    """Saves bytes under their digest, once: what is there already must be the same."""
    from hashlib import sha256

    path = f"{folder.rstrip('/')}/raw/{sha256(payload).hexdigest()}{suffix}"
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    store = target.getFileSystem(spark._jsc.hadoopConfiguration())
    if store.exists(target):
        held = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("h")).first()["h"]
        if held != sha256(payload).hexdigest():
            raise ValueError("CONFLICT")
        return path
    out = store.create(target, False)
    try:
        out.write(payload)
    finally:
        out.close()
    return path


def windows(requests: DataFrame, observations: DataFrame, most: int) -> DataFrame:
    """request_id, matches, refused: how many observations each request's window holds, and whether that is more than `most`.

    requests: request_id, west, south, east, north, start_date, end_date (of which the last day is not in it); observations: obs_id,
    lon, lat, acquired_at. Both meet on whole degrees and days, of which a request of the greatest size has 36 times 31.
    """
    return _matched(requests, observations).groupBy("request_id").agg(F.count("*").alias("n")).join(requests.select("request_id"), "request_id", "right").select(
        "request_id", F.coalesce("n", F.lit(0)).alias("matches"), (F.coalesce("n", F.lit(0)) > most).alias("refused")
    )


def window_rows(requests: DataFrame, judged: DataFrame, observations: DataFrame) -> DataFrame:
    """request_id and the columns of the observations of the requests that windows() has not refused."""
    return _matched(requests.join(judged.filter("NOT refused").select("request_id"), "request_id", "left_semi"), observations)


def _matched(requests: DataFrame, observations: DataFrame) -> DataFrame:
    def steps(low: str, high: str) -> Column:
        return F.explode(F.sequence(F.floor(low), F.floor(high)))

    days = F.explode(F.sequence("start_date", F.date_sub("end_date", 1)))
    asked = requests.select("request_id", "west", "south", "east", "north", steps("west", "east").alias("_x"), "start_date", "end_date").withColumn("_y", steps("south", "north")).withColumn("_day", days)
    own = observations.withColumns({"_x": F.floor("lon"), "_y": F.floor("lat"), "_day": F.to_date("acquired_at")})
    inside = F.col("lon").between(F.col("west"), F.col("east")) & F.col("lat").between(F.col("south"), F.col("north"))
    return own.join(asked.drop("start_date", "end_date"), ["_x", "_y", "_day"]).filter(inside).drop("_x", "_y", "_day", "west", "south", "east", "north")
