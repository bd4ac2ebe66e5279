"""What may be asked for: named regions, products and windows, and guards before anything is read."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta

from pyspark.sql import DataFrame, SparkSession

# Satellites by product, and the pilot regions (id, west, south, east, north).
SATELLITES = {"VIIRS_NOAA20_NRT": "N20", "VIIRS_NOAA21_NRT": "N21", "VIIRS_SNPP_NRT": "N", "VIIRS_NOAA20_SP": "N20"}
REGIONS = [
    ("jamnagar", 69.5, 22.0, 70.5, 23.0), ("singrauli", 82.0, 23.5, 83.0, 24.5), ("punjab", 74.5, 30.0, 75.5, 31.0), ("jharia", 86.0, 23.5, 87.0, 24.5), ("korba", 82.0, 22.0, 83.0, 23.0), ("talcher", 84.5, 20.5, 85.5, 21.5), ("paradip", 86.0, 19.8, 87.0, 20.8),
    ("mathura", 77.2, 27.0, 78.2, 28.0), ("panipat", 76.5, 29.0, 77.5, 30.0), ("vizag", 82.8, 17.2, 83.8, 18.2), ("mumbai", 72.5, 18.6, 73.5, 19.6), ("haldia", 87.6, 21.6, 88.6, 22.6), ("simlipal", 85.8, 21.4, 86.8, 22.4), ("kgbasin", 81.5, 16.0, 82.5, 17.0),
]
MOST_DEGREES, MOST_DAYS, MOST_ROWS, MOST_OFFSET, MOST_PAGE = 5.0, 31, 20_000, 10_000, 500
MOST_EXPORTED, MOST_WITH_RULES = 2000, 100


@dataclass(frozen=True)
class Box:
    west: float
    south: float
    east: float
    north: float

    def __post_init__(self):
        inside = -180 <= self.west <= 180 and -180 <= self.east <= 180 and -90 <= self.south <= 90 and -90 <= self.north <= 90
        if not inside or not 0 < self.east - self.west <= MOST_DEGREES or not 0 < self.north - self.south <= MOST_DEGREES:
            raise ValueError("a box spans more than zero and at most five degrees on each axis")

    @classmethod
    def parse(cls, text: str) -> Box:
        parts = text.split(",")
        if len(parts) != 4:
            raise ValueError("west,south,east,north")
        return cls(*map(float, parts))


@dataclass(frozen=True)
class Request:
    """A window of observations: half-open in time, up to `days` days."""

    box: Box
    start: date
    days: int
    product: str = "VIIRS_NOAA20_NRT"
    limit: int = 100
    offset: int = 0

    def __post_init__(self):
        if self.product not in SATELLITES:
            raise ValueError("unknown product")
        if not 1 <= self.days <= MOST_DAYS or not 1 <= self.limit <= MOST_PAGE or not 0 <= self.offset <= MOST_OFFSET:
            raise ValueError("days, limit or offset out of range")

    @property
    def end(self) -> date:
        return self.start + timedelta(days=self.days)

    def next_offset(self, total: int) -> int | None:
        """Where the next page begins, if there is one that may be asked for."""
        following = self.offset + self.limit
        return following if following < total and following <= MOST_OFFSET else None


def guard_ingest(mode: str, origin: str, start: date, today: date, payload_sha256: str | None = None, expected_sha256: str | None = None, payload: str = "", secret: str | None = None) -> None:
    """Refuses an ingest before anything is read."""
    if (mode == "LIVE") != (origin == "PROVIDER"):
        raise ValueError("LIVE needs the provider, and the provider is LIVE only")
    if start > today:
        raise ValueError("FUTURE_WINDOW")
    if expected_sha256 and payload_sha256 != expected_sha256:
        raise ValueError("HASH_MISMATCH")
    if secret and secret in payload:
        raise ValueError("SECRET_IN_PAYLOAD")


def guard_name(name: str) -> str:
    if not re.fullmatch(r"[a-z0-9][a-z0-9_-]{2,60}", name):
        raise ValueError("INVALID_CASE_SET_NAME")
    return name


def regions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGIONS, "region string, west double, south double, east double, north double")


def refuse_over(rows: DataFrame, most: int) -> DataFrame:
    """The rows, or an error if there are more than `most`: an export is never cut."""
    found = rows.limit(most + 1).count()
    if found > most:
        raise ValueError(f"EXPORT_TOO_LARGE: more than {most}")
    return rows
