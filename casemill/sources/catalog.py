"""Tables by name in the session, and the settings of an analysis as a file."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.sources.tables import table


@dataclass(frozen=True)
class Settings:
    """The numbers an analysis depends on; a changed one makes a new object, never a changed file."""

    item_cap: int = 20
    screen_items: int = 200
    pool_items: int = 400
    least_pair: int = 3
    target_rate: float = 0.05
    threshold: float | None = None

    def calibrated(self, threshold: float) -> Settings:
        """The same settings with the threshold a pool gave."""
        return replace(self, threshold=threshold)


def register(spark: SparkSession, folder: str, names: Iterable[str], prefix: str = "") -> dict[str, DataFrame]:
    """Temporary views of the tables, so that SQL finds them by name; an older view of the name is replaced."""
    frames = {name: table(spark, folder, name) for name in names}
    for name, df in frames.items():
        df.createOrReplaceTempView(prefix + name)
    return frames


def like_prefix(spark: SparkSession, view: str, column: str, name: str) -> DataFrame:
    """Distinct values of the column that begin with ``name`` and a blank, the name being a bound parameter."""
    return spark.sql(f"select distinct `{column}` from `{view}` where startswith(`{column}`, :name || ' ')", args={"name": name})


def write_settings(spark: SparkSession, settings: Settings, path: str) -> None:
    """The settings as one line of JSON in the folder ``path``."""
    kinds = {"int": "bigint", "float": "double", "float | None": "double"}
    schema = ", ".join(f"{f.name} {kinds[f.type]}" for f in fields(Settings))
    spark.createDataFrame([tuple(asdict(settings).values())], schema).coalesce(1).write.mode("overwrite").json(path)


def read_settings(spark: SparkSession, path: str) -> Settings:
    """The settings of the folder; what it does not name has its default, and names it does not know are left out."""
    row = spark.read.json(path).withColumn("_", F.lit(0)).first().asDict()
    known = {f.name: row[f.name] for f in fields(Settings) if row.get(f.name) is not None}
    return Settings(**known)
