"""Event flags from a curated vocabulary, and checks of the vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions.ordinals import quarter_index, quarters


def vocabulary(reac: DataFrame) -> DataFrame:
    """(pt, reports, first_quarter, last_quarter, n_quarters) of each term in the data."""
    return (
        reac.select(F.upper(F.trim("pt")).alias("pt"), "era", "report_id", "quarter")
        .filter("pt <> ''")
        .groupBy("pt")
        .agg(
            F.count_distinct("era", "report_id").alias("reports"),
            F.min("quarter").alias("first_quarter"),
            F.max("quarter").alias("last_quarter"),
            F.count_distinct("quarter").alias("n_quarters"),
        )
    )


def verified(terms: DataFrame, known: DataFrame) -> DataFrame:
    """Each curated term with its reports; NOT_FOUND where the data never use it."""
    got = terms.join(known, "pt", "left")
    return got.select(
        "pt", "tier", "concept", F.coalesce("reports", F.lit(0)).alias("reports"),
        F.when(F.col("reports").isNotNull(), "OK").otherwise("NOT_FOUND").alias("status"),
    )


def case_terms(reac: DataFrame, cases: DataFrame, terms: DataFrame) -> DataFrame:
    """(case_id, era, report_id, quarter, pt, concept, tier): the event terms of the surviving reports."""
    rows = reac.select("era", "report_id", F.upper(F.trim("pt")).alias("pt"))
    return (
        rows.join(terms.select("pt", "tier", "concept"), "pt")
        .join(cases.select("case_id", "era", "report_id", "quarter"), ["era", "report_id"])
        .select("case_id", "era", "report_id", "quarter", "pt", "concept", "tier")
    )


def case_events(found: DataFrame) -> DataFrame:
    """(case_id, is_core, is_broad, concepts); every matched case is broad."""
    return found.groupBy("case_id").agg(
        F.bool_or(F.col("tier") == "core").alias("is_core"),
        F.lit(True).alias("is_broad"),
        F.array_sort(F.collect_set("concept")).alias("concepts"),
    )


def continuity(found: DataFrame, first: str, last: str, baseline: float = 10.0) -> DataFrame:
    """Breaks in the quarterly series of each concept.

    A quarter is a break if the concept has no case in it after a mean of at least
    ``baseline`` over the four quarters before. The calendar runs from the concept's
    first quarter to the end of the window, so a term given up at the end is seen.
    """
    series = found.groupBy("concept", "quarter").agg(F.count_distinct("case_id").alias("n"))
    calendar = quarters(found.sparkSession, first, last)
    spans = series.groupBy("concept").agg(F.min(quarter_index(F.col("quarter"))).alias("start"))
    ends = F.sequence("start", F.lit(int(last[:4]) * 4 + int(last[5]) - 1))
    dense = spans.select("concept", "start", F.explode(ends).alias("quarter_idx")).join(calendar, "quarter_idx").join(series, ["concept", "quarter"], "left").fillna(0, ["n"])
    before = Window.partitionBy("concept").orderBy("quarter_idx").rowsBetween(-4, -1)
    marked = dense.withColumn("mean_before", F.avg("n").over(before)).withColumn(
        "broken", (F.col("n") == 0) & (F.col("quarter_idx") >= F.col("start") + 4) & (F.col("mean_before") >= baseline)
    )
    broken = F.array_join(F.array_sort(F.collect_list(F.when(F.col("broken"), F.col("quarter")))), ";")
    return marked.groupBy("concept").agg(
        F.min(F.when(F.col("n") > 0, F.col("quarter"))).alias("first_quarter"),
        F.max(F.when(F.col("n") > 0, F.col("quarter"))).alias("last_quarter"),
        F.count_if(F.col("n") > 0).alias("quarters_present"),
        F.sum("n").alias("total_reports"),
        broken.alias("break_quarters"),
    ).withColumn("status", F.when(F.col("break_quarters") == "", "PASS").otherwise("BREAK"))


def mechanical(known: DataFrame, pattern: str) -> DataFrame:
    """The terms of the vocabulary a pattern picks."""
    return known.filter(F.col("pt").rlike(pattern)).select("pt")


def set_agreement(one: DataFrame, two: DataFrame, column: str = "pt") -> DataFrame:
    """(n_one, n_two, n_both, jaccard, recall) of two lists; recall is the share of the first in the second."""
    a, b = (df.select(column).distinct() for df in (one, two))
    joined = a.withColumn("a", F.lit(1)).join(b.withColumn("b", F.lit(1)), column, "full")
    sums = joined.agg(
        F.count("a").alias("n_one"), F.count("b").alias("n_two"), F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("n_both"), F.count(F.lit(1)).alias("n_any")
    )
    ratio: Column = F.try_divide(F.col("n_both"), F.col("n_any"))
    return sums.select("n_one", "n_two", "n_both", F.round(ratio, 6).alias("jaccard"), F.round(F.try_divide(F.col("n_both"), F.col("n_one")), 6).alias("recall"))
