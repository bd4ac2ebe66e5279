"""Connected components of a graph given as edges, by repeated linking to the least neighbour."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder. Where none is set, a temporary one serves a local master; on a cluster executors would not see it."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="cindertrace-"))
        folder = spark.sparkContext.getCheckpointDir()
    return folder.rstrip("/")


def checkpointed(df: DataFrame) -> DataFrame:
    """Writes df once into the shared folder and reads it back, which cuts its lineage."""
    spark: SparkSession = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node, root (the least node of its component) for nodes(node) and edges(a, b).

    Each round links every node to the least root among its neighbours' and then follows roots to
    their roots, so long chains shrink by doubling. Joins have merge hints: nodes are small as files, but not
    as a hash table in the driver, once for each round.
    """
    both = checkpointed(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    known = checkpointed(nodes.select("node", F.col("node").alias("root")))
    while True:
        seen = both.join(known.select(F.col("node").alias("b"), "root").hint("merge"), "b").groupBy("a").agg(F.min("root").alias("least"))
        hooked = known.join(seen.withColumnRenamed("a", "node").hint("merge"), "node", "left").select("node", "root", F.least("root", F.coalesce("least", "root")).alias("new"))
        # a root takes over the least that any of its members has seen
        taken = hooked.groupBy("root").agg(F.min("new").alias("via"))
        step = hooked.join(taken.hint("merge"), "root").select("node", F.col("root").alias("old"), F.least("new", "via").alias("root"))
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = checkpointed(step.join(jump.hint("merge"), "root").select("node", "old", F.least("root", "above").alias("root")))
        if new.filter("root != old").isEmpty():
            return new.select("node", "root")
        known = new.select("node", "root")
