"""Session builder and the one way this library cuts lineage."""

from __future__ import annotations

import atexit
import os
import re
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

LOCAL_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}

_OWN: list[str] = []


def local_session(cores: int | str = 8, memory: str = "8g", partitions: int = 8) -> SparkSession:
    """A local session for tests and the benchmark; a cluster brings its own."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("casemill")
    for key, value in LOCAL_CONF.items():
        builder = builder.config(key, value)
    return (
        builder.config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .getOrCreate()
    )


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing (tests on one machine) a temporary folder is
    made once and deleted when the process ends. On a cluster without the
    setting this would be a machine-local folder, so a non-local master raises.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    if not re.match(r"local(\[|$)", spark.conf.get("spark.master", "")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="casemill-"))
        atexit.register(shutil.rmtree, _OWN[0][7:], ignore_errors=True)
    return _OWN[0]


def cut(df: DataFrame, label: str = "cut") -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    The written files survive the loss of any executor, and the rows are computed
    once however often the result is used. The schema is kept, also of empty input.
    """
    path = os.path.join(shared_dir(df.sparkSession), f"{label}-{uuid.uuid4().hex}")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def slots(spark: SparkSession) -> int:
    """As many partitions as there are cores, or shuffle partitions if more."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` in ``slots`` partitions, by ``keys`` if given.

    For few bytes with much work behind each row, which the adaptive planner would merge
    into few tasks; a number that is asked for is left alone.
    """
    return df.repartition(slots(df.sparkSession), *keys)
