"""Packages of saved files: a manifest with a digest tree, verification, and a load that goes on where it ended.

The manifest has a row for each file (path within the package, bytes, sha256). The tree's leaves are those
rows; rows whose paths hash alike (a 4096th) are digested in their order, and those digests in theirs, so
no text grows with the package. Files are read by tasks, never by the driver.

Loading takes detection files in groups, each a batch of a store (sources.stores): groups that a load has
committed are REPEATED in the next one, so a load that was killed is simply run again, and a second load of
a whole package adds nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cindertrace.operators.components import checkpointed
from cindertrace.sources import detections, stores
from cindertrace.sources.exports import verify as differences

#: Files that one batch of a load takes.
GROUP_FILES = 256
MANIFEST = "path string, bytes long, sha256 string"


def qualified(spark: SparkSession, folder: str) -> str:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def files_of(spark: SparkSession, folder: str) -> DataFrame:
    """path (within the folder), bytes, sha256 of every file; empty if there is none."""
    root = qualified(spark, folder).rstrip("/") + "/"
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # file:/x and file:///x are one place
    path = F.regexp_replace("path", "^([a-z0-9]+):/+", "$1:/")
    own = F.substring(path, F.lit(len(_short(root)) + 1), F.length(path))
    return raw.select(own.alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def _short(path: str) -> str:
    scheme, rest = path.split(":", 1)
    return f"{scheme}:/{rest.lstrip('/')}"


def tree_digest(manifest: DataFrame) -> str:
    """One digest of all rows of a manifest."""
    leaf = F.concat_ws(" ", "path", F.col("bytes").cast("string"), "sha256")
    rows = manifest.select(F.substring(F.sha2("path", 256), 1, 3).alias("block"), "path", leaf.alias("leaf"))
    blocks = rows.groupBy("block").agg(F.expr("sha2(listagg(leaf, '\n') WITHIN GROUP (ORDER BY path), 256)").alias("d"))
    found = blocks.agg(F.expr("sha2(listagg(concat(block, d), '\n') WITHIN GROUP (ORDER BY block), 256)").alias("d")).first()["d"]
    return found or "none"


def build(spark: SparkSession, folder: str, manifest_path: str) -> str:
    """Writes the manifest of a folder's files beside it; returns the tree's digest."""
    manifest = checkpointed(files_of(spark, folder))
    manifest.coalesce(1 + manifest.count() // 1_000_000).write.mode("overwrite").parquet(manifest_path)
    return tree_digest(manifest)


def verified(spark: SparkSession, folder: str, manifest_path: str, digest: str | None = None) -> DataFrame:
    """path, problem of files that are missing, not in the manifest, or others; a manifest that is not the one meant is refused."""
    manifest = spark.read.schema(MANIFEST).parquet(manifest_path)
    if digest is not None and tree_digest(manifest) != digest:
        raise ValueError("ANOTHER_MANIFEST")
    return differences(manifest.select("path", "sha256"), files_of(spark, folder).select("path", "sha256"))


def group_of(path: Column, groups: int) -> Column:
    return F.pmod(F.xxhash64(path), F.lit(groups))


def load(spark: SparkSession, folder: str, manifest_path: str, digest: str, store: str, satellite: str, start: str, days: int, box: tuple[float, float, float, float], namespace: str, product: str) -> dict:
    """Takes the detection files (*.csv) of a verified package into a store; returns the counts of what was new.

    May be run again after it was stopped at any point.
    """
    wrong = verified(spark, folder, manifest_path, digest)
    if not wrong.isEmpty():
        raise ValueError(f"PACKAGE_DIFFERS: {wrong.first()['path']} {wrong.first()['problem']}")
    manifest = spark.read.schema(MANIFEST).parquet(manifest_path).filter("path LIKE '%.csv' AND bytes > 0")
    groups = -(-manifest.count() // GROUP_FILES)
    done = {"groups": groups, "repeated": 0, "total": 0, "inserted": 0, "duplicates": 0, "conflicts": 0, "rejected": 0}
    if not groups:
        return done
    root = qualified(spark, folder).rstrip("/")
    rows = checkpointed(detections.read_csv(spark, f"{root}/*.csv"))
    name = F.regexp_extract("file", "([^/]+)$", 1)
    for k in range(groups):
        own = rows.filter(group_of(name, groups) == k).withColumn("file", name)
        # a row's number within the group: files in the order of their names, of which a group has some hundreds
        order = own.select("file").distinct().withColumn("place", F.row_number().over(Window.orderBy("file")))
        own = own.join(F.broadcast(order), "file").withColumn("row_number", (F.col("place") - 1).cast("long") * (detections.MOST_ROWS + 2) + F.col("row_number")).drop("place")
        entry = stores.receive(own, store, satellite, start, days, box, namespace, product)
        if entry["status"] == "REPEATED":
            done["repeated"] += 1
            continue
        for c in ("total", "inserted", "duplicates", "conflicts", "rejected"):
            done[c] += entry[c]
    return done
