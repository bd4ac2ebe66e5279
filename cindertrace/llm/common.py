"""Session helpers shared by the corpus operators."""

from __future__ import annotations

import hashlib
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cindertrace.shipping import ship

#: Arrow batches hold few rows, so that a batch of very long texts still fits a Python worker.
BATCH_ROWS = 256


def prepare(spark: SparkSession) -> SparkSession:
    """Bounds Arrow batches, sends the package along, and makes sure that there is a folder for cut().

    On a cluster spark.checkpoint.dir names a shared folder. Where it is unset, a temporary one is
    used if the master is local, as in tests, and anything else is refused: executors would not see it.
    """
    ship(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    if not spark.conf.get("spark.checkpoint.dir", None) and not spark.sparkContext.getCheckpointDir():
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cindertrace-"))
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that the driver and all executors share."""
    prepare(spark)
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Writes df once, as Parquet in the shared folder, so that what is lost later is read again, not recomputed."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/cindertrace-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def sha256_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def texts(documents: DataFrame) -> DataFrame:
    """doc_id and text alone; a null text counts as an empty one."""
    prepare(documents.sparkSession)
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))


def row_key(*columns: Column | str) -> Column:
    """Tells rows apart where doc_id does not: a hash of doc_id and text."""
    return F.xxhash64(*columns)


def packed(documents: DataFrame) -> DataFrame:
    """row (all columns, whatever they are called), doc_id and key, to join what was found about rows."""
    doc_id = F.col("doc_id").cast("long")
    return documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), doc_id.alias("doc_id"), row_key(doc_id, F.coalesce("text", F.lit(""))).alias("key"))


def same_row(found: DataFrame, rows: DataFrame) -> Column:
    """Join condition on doc_id, which may be null, and key."""
    return rows["doc_id"].eqNullSafe(found["doc_id"]) & (rows["key"] == found["key"])


def without(documents: DataFrame, gone: DataFrame) -> DataFrame:
    """documents without the rows of gone(doc_id, key)."""
    prepare(documents.sparkSession)
    rows = packed(documents)
    return rows.join(gone, same_row(gone, rows), "left_anti").select("row.*")


def record_batch(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) if not isinstance(c, pa.Array) else c for c, t in zip(columns, schema.types, strict=True)], schema=schema)
