"""Packages: digests of trees, verification, and loads that are stopped and run again."""

from pathlib import Path

import pytest

from cindertrace.sources import detections, packages, stores
from tests.test_stores import ASKED, ROW


def package(folder: Path, files: int) -> None:
    folder.mkdir()
    for k in range(files):
        lines = [{**ROW, "latitude": f"22.{k % 7 + 1}", "longitude": f"69.{51 + k}", "acq_time": str(900 + j)} for j in range(3)] + [{**ROW, "latitude": "92"}]
        (folder / f"w{k:02d}.csv").write_text("\n".join([",".join(detections.COLUMNS)] + [",".join(r[c] for c in detections.COLUMNS) for r in lines]) + "\n")
    (folder / "notes.txt").write_text("of no use here")


def told(spark, store):
    return sorted(r["id"] for r in stores.observations(spark, store).collect()), stores.receipts(spark, store).count(), stores.quarantine(spark, store).count()


def test_load_is_resumed(spark, tmp_path, monkeypatch):
    folder, manifest = tmp_path / "p", str(tmp_path / "manifest")
    package(folder, 6)
    digest = packages.build(spark, str(folder), manifest)
    monkeypatch.setattr(packages, "GROUP_FILES", 2)
    go = lambda store: packages.load(spark, str(folder), manifest, digest, str(tmp_path / store), *ASKED)
    whole = go("whole")
    assert (whole["groups"], whole["total"], whole["inserted"], whole["rejected"], whole["repeated"]) == (3, 24, 18, 6, 0)
    real, calls = stores.receive, []

    def dies(*a):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt
        return real(*a)

    monkeypatch.setattr(stores, "receive", dies)
    with pytest.raises(KeyboardInterrupt):
        go("halved")
    monkeypatch.setattr(stores, "receive", real)
    rest = go("halved")
    assert rest["repeated"] == 1 and told(spark, str(tmp_path / "halved")) == told(spark, str(tmp_path / "whole"))
    assert go("halved")["repeated"] == 3 and told(spark, str(tmp_path / "halved")) == told(spark, str(tmp_path / "whole"))


def test_packages_that_differ(spark, tmp_path):
    folder, manifest = tmp_path / "p", str(tmp_path / "manifest")
    package(folder, 2)
    digest = packages.build(spark, str(folder), manifest)
    assert packages.build(spark, str(folder), str(tmp_path / "again")) == digest and packages.verified(spark, str(folder), manifest, digest).isEmpty()
    (folder / "w00.csv").write_text("x")
    (folder / "new.csv").write_text("y")
    (folder / "notes.txt").unlink()
    assert sorted((r["path"], r["problem"]) for r in packages.verified(spark, str(folder), manifest, digest).collect()) == [("new.csv", "NOT_IN_MANIFEST"), ("notes.txt", "MISSING"), ("w00.csv", "HASH_MISMATCH")]
    with pytest.raises(ValueError, match="PACKAGE_DIFFERS"):
        packages.load(spark, str(folder), manifest, digest, str(tmp_path / "s"), *ASKED)
    with pytest.raises(ValueError, match="ANOTHER_MANIFEST"):
        packages.verified(spark, str(folder), manifest, "0" * 64)
