"""Quarters arriving as a stream of files. An extension: the batch operators do not need it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from casemill.operators.resolve import latest_versions


def read_arrivals(spark: SparkSession, folder: str, schema: StructType, files_per_batch: int = 100) -> DataFrame:
    """The Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def distinct_arrivals(stream: DataFrame, keys: Sequence[str], time: str, delay: str = "90 days") -> DataFrame:
    """The first of rows with equal keys; state older than the delay is given up, so it stays bounded."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(list(keys))


def windowed_counts(stream: DataFrame, time: str, by: Sequence[str], width: str = "30 days", delay: str = "90 days") -> DataFrame:
    """(start, end, by..., n) per tumbling window; rows later than the delay are left out."""
    counted = stream.withWatermark(time, delay).groupBy(F.window(time, width), *by).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *by, "n")


def superseding(target: str) -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` function that keeps the current report of each case in the folder ``target``.

    Each batch reads the last state, takes the winners of both, and writes a folder of its
    own; a batch that is run again writes the same folder again.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = latest_versions(batch)
        if number:
            old = spark.read.schema(new.schema).parquet(f"{target}/state={number - 1}")
            both = old.unionByName(new)
            rank = F.struct(F.coalesce(F.col("rank"), F.lit(-(2**62))), "report_id", "quarter")
            names = [c for c in both.columns if c not in ("era_group", "case_id")]
            best = both.groupBy("era_group", "case_id").agg(F.max_by(F.struct(*names), rank).alias("r"))
            new = best.select("era_group", "case_id", "r.*").select(*new.columns)
        new.write.mode("overwrite").parquet(f"{target}/state={number}")

    return merge
