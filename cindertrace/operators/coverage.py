"""Which days complete retrievals cover around subjects, as bits: 64 days in a long.

Retrievals come in few boxes. Their days become bits by box and block of 64 days; a subject meets the four
blocks at most that its look-back touches, whatever the length of the archive, and counts set bits
under a mask.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cindertrace.operators import context
from cindertrace.operators.components import checkpointed

#: Days in a block.
BLOCK = 64


def day_number(day: Column) -> Column:
    return F.unix_date(day)


def block_of(day: Column) -> Column:
    return F.floor(day_number(day) / BLOCK).cast("int")


def bit_of(day: Column) -> Column:
    """The place of a day in its block."""
    return F.pmod(day_number(day), F.lit(BLOCK)).cast("int")


def mask(first: Column, end: Column, block: Column) -> Column:
    """The bits of the days in [first, end) that lie in a block."""

    def below(day: Column) -> Column:
        n = F.least(F.greatest(day_number(day) - block * BLOCK, F.lit(0)), F.lit(BLOCK)).cast("int")
        return F.when(n == BLOCK, F.lit(-1).cast("long")).otherwise(F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), n)))

    return below(end).bitwiseAND(F.bitwise_not(below(first)))


def days_in(bits: Column, block: Column, first: Column, end: Column) -> Column:
    """How many of the days in [first, end) are set."""
    return F.bit_count(bits.bitwiseAND(mask(first, end, block)))


def covered(subjects: DataFrame, passes: DataFrame, mode: str, radius_m: float, look_back: int, operational: bool = False) -> DataFrame:
    """sid, product, block, bits: the days within look_back before each subject's as_of that a complete retrieval covers, known by then if operational."""
    corners = ["west", "south", "east", "north"]
    good = passes.filter((F.col("mode") == mode) & (F.col("status") == "SUCCEEDED") & (F.col("rejected_rows") == 0)).withColumn("box", F.xxhash64(*corners))
    days = good.select("box", "product", F.explode(F.sequence("start_date", "end_date")).alias("day"), *["received_at"] * operational)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), bit_of(F.col("day")))
    held = days.groupBy("box", "product", block_of(F.col("day")).alias("block"), *["received_at"] * operational).agg(F.bit_or(bit).alias("bits"))
    few = checkpointed(good.select("box", *corners).distinct())  # so their size is known, and subjects are not broadcast in their place
    boxes = context.covering(subjects.select("sid", "lon", "lat", "as_of"), few, F.lit(radius_m)).select("sid", "as_of", "box")
    last = F.to_date("as_of")
    first = F.date_sub(last, look_back)
    asked = boxes.withColumn("block", F.explode(F.sequence(block_of(first), block_of(last))))
    found = asked.join(held, ["box", "block"])
    found = found.filter(F.col("received_at") <= F.col("as_of")) if operational else found
    own = F.col("bits").bitwiseAND(mask(first, F.date_add(last, 1), F.col("block")))
    return found.groupBy("sid", "product", "block").agg(F.bit_or(own).alias("bits")).filter("bits != 0")


def any_product(days: DataFrame) -> DataFrame:
    """sid, block, bits of covered(), whatever the product."""
    return days.groupBy("sid", "block").agg(F.bit_or("bits").alias("bits"))
