"""The quarter axis: texts such as 2014q3, their index, ranges and eras."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The eras and their last quarters.
ERAS = [("laers", "2012q3"), ("faers_early", "2014q2"), ("faers_modern", "9999q4")]

_QUARTER = r"^([0-9]{4})[qQ]([1-4])$"


def quarter_index(quarter: Column) -> Column:
    """Year times four plus quarter less one; NULL for other texts."""
    text = F.trim(quarter)
    year = F.regexp_extract(text, _QUARTER, 1).try_cast("int")
    return year * 4 + F.regexp_extract(text, _QUARTER, 2).try_cast("int") - 1


def quarter_name(index: Column) -> Column:
    """The inverse of ``quarter_index``."""
    return F.concat(F.floor(index / 4).cast("int").cast("string"), F.lit("q"), (index % 4 + 1).cast("int").cast("string"))


def era_of(quarter: Column) -> Column:
    """The era a quarter falls into; NULL for texts that are no quarter."""
    out = F.lit(None).cast("string")
    for name, last in reversed(ERAS):
        out = F.when(F.lower(F.trim(quarter)) <= last, F.lit(name)).otherwise(out)
    return F.when(quarter_index(quarter).isNotNull(), out)


def era_group(era: Column) -> Column:
    """The id space of an era: laers, or faers for both later ones."""
    return F.when(era == "laers", F.lit("laers")).otherwise(F.lit("faers"))


def quarters(spark: SparkSession, first: str, last: str) -> DataFrame:
    """One row per quarter from first through last: (quarter_idx, quarter)."""
    index = lambda q: int(q[:4]) * 4 + int(q[5]) - 1
    ids = spark.range(index(first), index(last) + 1).select(F.col("id").cast("int").alias("quarter_idx"))
    return ids.select("quarter_idx", quarter_name(F.col("quarter_idx")).alias("quarter"))
