"""Stores of detections and map snapshots: batches count once, also when two writers bring them together."""

import json

import pytest
from pyspark.sql import functions as F

from cindertrace.operators import increments
from cindertrace.sources import detections, stores

ROW = dict(zip(detections.COLUMNS, ["22.3", "69.8", "310", "0.4", "0.5", "2026-01-02", "905", "N20", "VIIRS", "n", "2.0NRT", "295", "0", "D"], strict=True))
ASKED = ("N20", "2026-01-01", 3, (69.5, 22.0, 70.5, 23.0), "nasa", "VIIRS_NOAA20_NRT")


def rows(spark, *changes):
    return spark.createDataFrame([{**ROW, "row_number": 2 + k, **c} for k, c in enumerate(changes)], ", ".join(f"{c} string" for c in detections.COLUMNS) + ", row_number int")


def test_receipts(spark, tmp_path):
    folder = str(tmp_path)
    one = rows(spark, {}, {"latitude": "22.30"}, {"latitude": "92"}, {"longitude": "70.0", "frp": ""}, {"frp": "6"})
    got = stores.receive(one, folder, *ASKED)
    assert {k: got[k] for k in ("number", "total", "inserted", "duplicates", "conflicts", "rejected", "status")} == {"number": 0, "total": 5, "inserted": 2, "duplicates": 1, "conflicts": 1, "rejected": 1, "status": "PARTIAL"}
    again = stores.receive(one.orderBy(F.desc("row_number")).repartition(3), folder, *ASKED)
    assert again["status"] == "REPEATED" and again["batch"] == got["batch"] and stores.observations(spark, folder).count() == 2
    two = stores.receive(rows(spark, {}, {"latitude": "22.4"}), folder, *ASKED)
    assert (two["number"], two["inserted"], two["duplicates"], two["status"]) == (1, 1, 1, "SUCCEEDED")
    held = stores.quarantine(spark, folder).collect()
    assert [(r["row_number"], r["reason"]) for r in held] == [(4, "INVALID_COORDINATE")] and json.loads(held[0]["raw"])["latitude"] == "92"
    assert stores.receipts(spark, folder).groupBy("batch").count().count() == 2 and {r["frp_mw"] for r in stores.observations(spark, folder).collect()} == {0.0, None}
    assert stores.receive(rows(spark), folder, *ASKED)["total"] == 0  # a file without rows is a batch like others


def test_writers_that_meet(spark, tmp_path, monkeypatch):
    """The loser sees what the winner has brought: the same batch is repeated, another one is compared with it."""
    folder = str(tmp_path)
    batch, other = rows(spark, {}), rows(spark, {}, {"latitude": "22.5"})
    real, first = increments.Ledger.create, []

    def create(self, number, entry):
        if not first:
            first.append(1)
            stores.receive(batch, folder, *ASKED)
        return real(self, number, entry)

    monkeypatch.setattr(increments.Ledger, "create", create)
    assert stores.receive(batch, folder, *ASKED)["status"] == "REPEATED" and stores.observations(spark, folder).count() == 1
    first.clear()
    late = stores.receive(other, folder, *ASKED)
    assert (late["number"], late["inserted"], late["duplicates"]) == (1, 1, 1) and stores.observations(spark, folder).select("id").distinct().count() == stores.observations(spark, folder).count() == 2


def test_snapshots(spark, tmp_path):
    folder = str(tmp_path)
    square = [{"lon": x, "lat": y} for x, y in ((0, 0), (1, 0), (1, 1), (0, 1), (0, 0))]
    text = json.dumps({"osm3s": {"timestamp_osm_base": "2026-01-01T00:00:00Z"}, "elements": [{"type": "way", "id": 1, "tags": {"industrial": "yes"}, "geometry": square}, {"type": "way", "id": 2, "tags": {}, "geometry": square[:3]}, {"type": "node", "id": 3, "lat": 1.0, "lon": 2.0, "tags": {}}]})
    payload = spark.createDataFrame([(text,)], "json string")
    got = stores.take_snapshot(payload, folder, "kutch")
    assert (got["accepted"], got["rejected"], got["status"], got["base_at"]) == (2, 1, "SUCCEEDED", "2026-01-01T00:00:00Z")
    assert stores.take_snapshot(payload, folder, "kutch")["status"] == "REPEATED" and stores.take_snapshot(payload, folder, "mumbai")["number"] == 1
    assert stores.take_snapshot(spark.createDataFrame([('{"elements": 5}',)], "json string"), folder, "kutch") == {"status": "REFUSED", "problem": "NO_ELEMENTS"}
    assert stores.features(spark, folder).count() == 4 and {r["reason"] for r in stores.rejected_elements(spark, folder).collect()} == {"OPEN_WAY"}
    with pytest.raises(ValueError):
        increments.newest_members(spark, str(tmp_path / "none"))
