"""Checks of keys, references, row counts, casts and column sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions.ordinals import quarter_index
from casemill.functions.text import number


def duplicate_keys(df: DataFrame, key: str, by: str) -> DataFrame:
    """(by, n_rows, distinct_keys, duplicates) of the groups in which the key repeats."""
    counted = df.groupBy(by, key).agg(F.count(F.lit(1)).alias("n"))
    sums = counted.groupBy(by).agg(F.sum("n").alias("n_rows"), F.count(F.col(key)).alias("distinct_keys"))
    return sums.filter("n_rows <> distinct_keys").withColumn("duplicates", F.col("n_rows") - F.col("distinct_keys"))


def orphans(child: DataFrame, parent: DataFrame, keys: Sequence[str], limit: float = 0.0) -> DataFrame:
    """One row (n_rows, orphans, rate, status): child rows without a parent; a NULL key is an orphan.

    The child is first counted by key, so a hot key is one row in the join.
    """
    counted = child.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    known = parent.select(*keys).distinct().withColumn("_known", F.lit(1))
    met = counted.join(known, list(keys), "left")
    sums = met.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("_known").isNull(), F.col("n"))), F.lit(0)).alias("orphans"))
    rate = F.coalesce(F.try_divide(F.col("orphans"), F.col("n_rows")), F.lit(0.0))
    return sums.withColumn("rate", F.round(rate, 6)).withColumn("status", F.when(rate <= limit, "PASS").otherwise("FAIL"))


def row_counts(frames: dict[str, DataFrame], manifest: DataFrame) -> DataFrame:
    """(table_name, expected, found, status) for a manifest of (table_name, expected)."""
    found = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("found")).withColumn("table_name", F.lit(name))
        found = one if found is None else found.unionByName(one)
    got = manifest.groupBy("table_name").agg(F.sum("expected").alias("expected")).join(found, "table_name", "full")
    ok = F.coalesce(F.col("expected") == F.col("found"), F.lit(False))
    return got.select("table_name", "expected", "found", F.when(ok, "PASS").otherwise("FAIL").alias("status"))


def id_overlap(ids: DataFrame, known: DataFrame, key: str = "case_id", least: float = 0.1) -> DataFrame:
    """One row (n_ids, low, high, matched, rate, status): a plausible share of the ids must be known."""
    distinct = ids.select(key).filter(F.col(key).isNotNull()).distinct()
    met = distinct.join(known.select(key).distinct().withColumn("_known", F.lit(1)), key, "left")
    sums = met.agg(F.count(F.lit(1)).alias("n_ids"), F.min(key).alias("low"), F.max(key).alias("high"), F.count("_known").alias("matched"))
    rate = F.coalesce(F.try_divide(F.col("matched"), F.col("n_ids")), F.lit(0.0))
    return sums.withColumn("rate", F.round(rate, 6)).withColumn("status", F.when(rate > least, "PASS").otherwise("FAIL"))


def _cast(col: Column, kind: str) -> Column:
    return number(col) if kind == "double" else F.trim(col.cast("string")).try_cast(kind)


def cast_failures(df: DataFrame, kinds: dict[str, str], tolerance: float = 0.01) -> DataFrame:
    """(column_name, n_filled, failures, rate, status): filled texts that do not cast, in one pass."""
    filled = {c: F.coalesce(F.trim(F.col(c).cast("string")) != "", F.lit(False)) for c in kinds}
    sums = df.agg(
        *(F.count_if(filled[c]).alias(f"n_{i}") for i, c in enumerate(kinds)),
        *(F.count_if(filled[c] & _cast(F.col(c), k).isNull()).alias(f"f_{i}") for i, (c, k) in enumerate(kinds.items())),
    )
    rows = F.array(
        *(F.struct(F.lit(c).alias("column_name"), F.col(f"n_{i}").alias("n_filled"), F.col(f"f_{i}").alias("failures")) for i, c in enumerate(kinds))
    )
    got = sums.select(F.explode(rows).alias("r")).select("r.*")
    rate = F.coalesce(F.try_divide(F.col("failures"), F.col("n_filled")), F.lit(0.0))
    return got.withColumn("rate", F.round(rate, 6)).withColumn("status", F.when(rate <= tolerance, "PASS").otherwise("FAIL"))


def missing_tables(files: DataFrame, expected: Sequence[str]) -> DataFrame:
    """(series_id, quarter, table_name, n_files): expected tables of a series and quarter that are missing or there twice."""
    spots = files.select("series_id", "quarter").distinct().select("series_id", "quarter", F.explode(F.array(*map(F.lit, expected))).alias("table_name"))
    have = files.groupBy("series_id", "quarter", "table_name").agg(F.count(F.lit(1)).alias("n_files"))
    return spots.join(have, ["series_id", "quarter", "table_name"], "left").fillna(0, ["n_files"]).filter("n_files <> 1")


def column_changes(layout: DataFrame) -> DataFrame:
    """(series_id, table_name, quarter, change, added, removed, n_columns) where the column set differs.

    ``layout`` has (series_id, table_name, quarter, file_id, names); a first file is listed
    as first_observed with all its columns.
    """
    order = Window.partitionBy("series_id", "table_name").orderBy("quarter", "file_id")
    sets = layout.withColumn("now", F.array_sort(F.array_distinct("names"))).withColumn("before", F.lag("now").over(order))
    first = F.col("before").isNull()
    none = F.array().cast("array<string>")
    got = sets.filter(first | (F.col("now") != F.col("before")))
    return got.select(
        "series_id",
        "table_name",
        "quarter",
        F.when(first, "first_observed").otherwise("columns_changed").alias("change"),
        F.array_join(F.when(first, F.col("now")).otherwise(F.array_except("now", "before")), ";").alias("added"),
        F.array_join(F.when(first, none).otherwise(F.array_except("before", "now")), ";").alias("removed"),
        F.size("now").alias("n_columns"),
    )


def presence(layout: DataFrame) -> DataFrame:
    """(table_name, column_name, first_quarter, last_quarter, n_quarters, n_files) of every column."""
    rows = layout.select("table_name", "quarter", "file_id", F.explode("names").alias("column_name")).filter("column_name <> ''")
    return rows.groupBy("table_name", "column_name").agg(
        F.min("quarter").alias("first_quarter"),
        F.max("quarter").alias("last_quarter"),
        F.count_distinct("quarter").alias("n_quarters"),
        F.count_distinct("file_id").alias("n_files"),
    )


def against_config(layout: DataFrame, declared: dict[str, Sequence[str]]) -> DataFrame:
    """(table_name, column_name, n_files): columns of files that the declared schema of their table lacks."""
    known = F.create_map(*(x for t, names in declared.items() for x in (F.lit(t), F.array(*map(F.lit, names)))))
    rows = layout.select("table_name", "file_id", F.explode("names").alias("column_name")).filter("column_name <> ''")
    unknown = ~F.coalesce(F.array_contains(F.try_element_at(known, F.col("table_name")), F.col("column_name")), F.lit(False))
    return rows.filter(unknown).groupBy("table_name", "column_name").agg(F.count_distinct("file_id").alias("n_files"))


def quarter_gaps(df: DataFrame) -> DataFrame:
    """(quarter, n_rows, gap): rows per quarter and the number of quarters missing before it."""
    counted = df.filter(quarter_index(F.col("quarter")).isNotNull()).groupBy("quarter").agg(F.count(F.lit(1)).alias("n_rows"))
    # As many rows as there are quarters.
    before = F.lag(quarter_index(F.col("quarter"))).over(Window.orderBy("quarter"))
    return counted.withColumn("gap", F.coalesce(quarter_index(F.col("quarter")) - before - 1, F.lit(0)))
