"""Tiles as a data source: one read for a block, the same bytes as single reads, summaries from chips."""

import numpy as np


from cindertrace.operators import landcover
from cindertrace.shipping import ship
from cindertrace.sources import tiles

RNG = np.random.default_rng(4)
ROWS, COLS, P = 600, 500, 0.001


def points(spark, tmp_path):
    rows = [(k, 69.0 + float(RNG.uniform(0.01, COLS * P - 0.01)), 24.0 - float(RNG.uniform(0.01, ROWS * P - 0.01)), float(RNG.uniform(300, 2000))) for k in range(60)]
    rows += [(100, 69.0001, 23.9999, 900.0), (101, 60.0, 10.0, 500.0), (102, 69.1, 23.9, 6000.0), (103, 69.1, 86.0, 500.0), (104, None, 23.0, 500.0), (0, rows[0][1], rows[0][2], rows[0][3])]
    df = spark.createDataFrame(rows, "id long, lon double, lat double, radius_m double")
    return rows, df


def test_tile_blocks(spark, tmp_path, monkeypatch):
    ship(spark)
    pixels = RNG.choice(np.array([0, 7, 10, 20, 30, 40, 50, 80], np.uint8), (ROWS, COLS))
    tiles.write_tile(f"{tmp_path}/tiles", "N21E069", pixels, 69.0, 24.0, P, P)
    rows, df = points(spark, tmp_path)
    tiles.dealt(df.repartition(3), f"{tmp_path}/tiles", f"{tmp_path}/points")
    spark.dataSource.register(tiles.TileSource)
    read = lambda **o: spark.read.format("cindertrace_tiles").options(folder=f"{tmp_path}/tiles", points=f"{tmp_path}/points", **o).load()
    got = read().collect()
    status = {r["id"]: r["status"] for r in got}
    assert len(got) == len(rows) and {k: status[k] for k in range(101, 105)} == {101: "NO_TILE", 102: "RADIUS", 103: "LATITUDE", 104: "LATITUDE"} and all(status[k] == "OK" for k in [*range(60), 100])
    assert sum(r["reads"] for r in got) == 1  # one block, one range
    single = read(mostpixels=1).collect()
    assert sum(r["reads"] for r in single) == 62 and sorted((r["id"], r["chip"]) for r in got if r["chip"]) == sorted((r["id"], r["chip"]) for r in single if r["chip"])
    by = {r["id"]: r for r in got}
    for i, lon, lat, radius in rows[:60]:
        r = by[i]
        a = np.frombuffer(r["chip"], np.uint8).reshape(r["rows"], r["cols"])
        y0, x0 = round((24.0 - r["origin_lat"]) / P), round((r["origin_lon"] - 69.0) / P)
        whole = np.zeros_like(a)
        ys, xs = slice(max(y0, 0), min(y0 + r["rows"], ROWS)), slice(max(x0, 0), min(x0 + r["cols"], COLS))
        whole[ys.start - y0 : ys.stop - y0, xs.start - x0 : xs.stop - x0] = pixels[ys, xs]
        assert (a == whole).all()
    assert by[100]["clipped"] and not all(r["clipped"] for r in got if r["status"] == "OK")
    found = landcover.summarise(read().filter("status = 'OK'").dropDuplicates(["id"]).join(df.dropDuplicates(["id"]), "id").select("id", "lon", "lat", "radius_m", "chip", "rows", "cols", "origin_lon", "origin_lat", "px", "py")).collect()
    yc, xc = 24.0 - (np.arange(ROWS) + 0.5) * P, 69.0 + (np.arange(COLS) + 0.5) * P
    for r in found:
        if r["id"] >= 60:
            continue
        _, lon, lat, radius = rows[r["id"]]
        north, east = landcover.scale(lat)
        inside = pixels[((xc[None, :] - lon) * east) ** 2 + ((yc[:, None] - lat) * north) ** 2 <= radius**2]
        valid = np.isin(inside, list(landcover.CLASSES))
        if not by[r["id"]]["clipped"]:
            assert r["valid_fraction"] == round(valid.mean(), 6) and r["fractions"].get("crop", 0) == round(np.mean(inside[valid] == 40), 6)


def test_blocks_are_partitions(spark, tmp_path, monkeypatch):
    """Points of several blocks and tiles are planned apart."""
    tiles.write_tile(f"{tmp_path}/tiles", "N21E069", np.zeros((4100, 2100), np.uint8), 69.0, 24.0, P / 2, P / 2)
    tiles.write_tile(f"{tmp_path}/tiles", "S03W003", np.zeros((10, 10), np.uint8), -3.0, 0.0, P, P)
    df = spark.createDataFrame([(1, 69.1, 23.9, 500.0), (2, 69.1, 22.9, 500.0), (3, 69.2, 23.8, 500.0), (4, -2.999, -0.001, 50.0)], "id long, lon double, lat double, radius_m double")
    tiles.dealt(df, f"{tmp_path}/tiles", f"{tmp_path}/points")
    planned = tiles.TileReader({"folder": f"{tmp_path}/tiles", "points": f"{tmp_path}/points"}).partitions()
    reader = tiles.TileReader({"folder": f"{tmp_path}/tiles", "points": f"{tmp_path}/points"})
    read = [[r for t in reader.read(b) for r in t.to_pylist()] for b in planned]
    assert sorted(sorted(r["id"] for r in rows) for rows in read) == [[1, 3], [2], [4]]
    assert all(r["status"] == "OK" for rows in read for r in rows) and [sum(r["reads"] for r in rows) for rows in read] == [1, 1, 1]
