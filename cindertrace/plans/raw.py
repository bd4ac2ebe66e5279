"""Events as rows of a detection file, some of them faulty, for Spark and for the oracle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindertrace.plans.adapter import Tables


def raw_rows(t: Tables) -> DataFrame:
    """Events as rows of a detection file, some of them faulty."""
    e = F.col("event_id")

    def pick(*values: str, by: int = 1) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), (F.floor(e / by) % len(values) + 1).cast("int"))

    return t.read("events").select(
        e.alias("id"), pick("22.30", "22.3", "92", "x", "22.301", "22.310").alias("latitude"), pick("69.8", "69.80", "0069.8", "70.9", by=2).alias("longitude"), F.lit("310").alias("bright_ti4"), F.lit("0.4").alias("scan"), F.lit("0.5").alias("track"),
        F.date_format("ts", "yyyy-MM-dd").alias("acq_date"), pick("905", "0905", "5", "2460", "1x", by=3).alias("acq_time"), pick("N20", "N20", "N20", "N21", by=5).alias("satellite"), F.lit("VIIRS").alias("instrument"), pick("n", "l", "", "z", by=7).alias("confidence"),
        pick("2.0NRT", "2.0NRT", "", by=11).alias("version"), F.lit("295").alias("bright_ti5"), pick("0", "5.5", "-1", "", by=13).alias("frp"), pick("D", "N", "X", by=17).alias("daynight"),
    )


RAW = """WITH r AS (SELECT event_id AS id, ts, (['22.30','22.3','92','x','22.301','22.310'])[event_id % 6 + 1] AS la, (['69.8','69.80','0069.8','70.9'])[event_id // 2 % 4 + 1] AS lo, (['905','0905','5','2460','1x'])[event_id // 3 % 5 + 1] AS tm, (['N20','N20','N20','N21'])[event_id // 5 % 4 + 1] AS sat, (['n','l','','z'])[event_id // 7 % 4 + 1] AS conf, (['2.0NRT','2.0NRT',''])[event_id // 11 % 3 + 1] AS ver, (['0','5.5','-1',''])[event_id // 13 % 4 + 1] AS frp, (['D','N','X'])[event_id // 17 % 3 + 1] AS dn FROM events),
 v AS (SELECT *, CASE WHEN sat <> 'N20' THEN 'SENSOR_MISMATCH' WHEN dn = 'X' OR ver = '' THEN 'MISSING_PROVENANCE' WHEN tm IN ('2460', '1x') THEN 'INVALID_TIME' WHEN ts < TIMESTAMP '2024-01-10' OR ts >= TIMESTAMP '2024-01-15' THEN 'OUTSIDE_WINDOW' WHEN la IN ('x', '92') THEN 'INVALID_COORDINATE' WHEN lo = '70.9' THEN 'OUTSIDE_BOUNDS' WHEN conf = 'z' THEN 'INVALID_CONFIDENCE' WHEN frp = '-1' THEN 'INVALID_FRP' END AS reason FROM r)"""
