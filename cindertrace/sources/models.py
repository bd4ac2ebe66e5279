"""Trained models as folders of files with a manifest, and a registry of what was trained.

A model's folder has the model itself (Spark ML's writer), its inputs, its calibration, its predictions (CSV,
written by tasks), its metrics and a card. The manifest has each file's digest, and its tree's digest is the
model's, so a changed file is found. A registry entry is created once.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cindertrace.sources import exports, packages
from cindertrace.sources.requests import guard_name

#: A model that was fitted to try the machinery out: its scores stay in its folder.
DRY_RUN = "DRY_RUN_NOT_EVIDENCE"
#: What a summary says of a report.
SUMMARY = ("status", "support", "label_policy", "reason", "baselines_macro_f1", "do_not_quote")
ENTRY = "model_id string, case_set string, algorithm string, status string, label_policy string, labels_sha256 string, artifact_sha256 string, summary string, created_at string"


def summary(report: dict) -> dict:
    """What may be shown of a report: no scores of a dry run."""
    out = {k: report[k] for k in SUMMARY if k in report}
    if report["status"] == DRY_RUN:
        out.pop("baselines_macro_f1", None)
        return out
    judged = report.get("evaluation") or {}
    scores = {k: v["macro_f1"] for k, v in judged.items() if isinstance(v, dict) and "macro_f1" in v}
    if judged:
        out |= {"macro_f1": scores, "brier": judged.get("brier_full_calibrated")}
    return out


def card(report: dict) -> str:
    """A model's card: what it is, what it rests on, and how it was judged."""
    lines = [f"# Model {report['model_id']}", "", f"Status: {report['status']}. Algorithm: {report['algorithm']}. Labels: {report['label_policy']}.", ""]
    if report["status"] == DRY_RUN:
        lines += ["Fitted to try the machinery out; its scores are no evidence.", ""]
    for title in ("support", "evaluation"):
        lines += [f"## {title.capitalize()}", "", "```json", json.dumps(report.get(title), indent=2, sort_keys=True), "```", ""]
    return "\n".join(lines)


def put(spark: SparkSession, path: str, payload: bytes) -> None:
    """Writes a file that must not be there yet."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    out = place.getFileSystem(spark._jsc.hadoopConfiguration()).create(place, False)
    out.write(payload)
    out.close()


def save(spark: SparkSession, folder: str, report: dict, created_at: str, model=None, inputs: list[str] | None = None, calibration: dict | None = None, predictions: DataFrame | None = None) -> dict:
    """Writes a model's files, its manifest and its registry entry; returns the entry.

    report: model_id, case_set, algorithm, status, label_policy, labels_sha256, and what summary() takes. The
    entry is written last, so a model that was only half written is not in the registry; its id is then free
    only under another folder.
    """
    own = f"{folder.rstrip('/')}/models/{guard_name(report['model_id'])}"
    files = f"{own}/files"
    if model is not None:
        model.write().save(f"{files}/model")
        put(spark, f"{files}/features.json", json.dumps({"columns": inputs}, indent=2).encode())
        put(spark, f"{files}/calibration.json", json.dumps(calibration, indent=2).encode())
    if predictions is not None:
        exports.write_csv(predictions, f"{files}/test_predictions")
    put(spark, f"{files}/metrics.json", json.dumps(report, indent=2, sort_keys=True).encode())
    put(spark, f"{files}/model_card.md", card(report).encode())
    digest = packages.build(spark, files, f"{own}/manifest")
    entry = {k: report[k] for k in ("model_id", "case_set", "algorithm", "status", "label_policy", "labels_sha256")}
    entry |= {"artifact_sha256": digest, "summary": json.dumps(summary(report), sort_keys=True), "created_at": created_at}
    put(spark, f"{folder.rstrip('/')}/registry/{report['model_id']}.json", json.dumps(entry).encode())
    return entry


def registry(spark: SparkSession, folder: str) -> DataFrame:
    """The entries of all models."""
    return spark.read.schema(ENTRY).json(f"{folder.rstrip('/')}/registry")


def newest(spark: SparkSession, folder: str, most: int = 20) -> DataFrame:
    """The newest models, newest first."""
    return registry(spark, folder).orderBy(F.desc("created_at"), "model_id").limit(most)


def changed(spark: SparkSession, folder: str, model_id: str) -> DataFrame:
    """path, problem of a model's files that are not what was saved; empty if all are."""
    entry = registry(spark, folder).filter(F.col("model_id") == model_id).first()
    if entry is None:
        raise ValueError("UNKNOWN_MODEL")
    own = f"{folder.rstrip('/')}/models/{model_id}"
    return packages.verified(spark, f"{own}/files", f"{own}/manifest", entry["artifact_sha256"])


def predictions(spark: SparkSession, folder: str, model_id: str, schema: str) -> DataFrame:
    """A model's saved predictions."""
    return spark.read.schema(schema).option("header", True).csv(f"{folder.rstrip('/')}/models/{model_id}/files/test_predictions")
