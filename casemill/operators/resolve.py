"""From report versions to one record per case.

Each step is a function of data frames; the windows partition by case, fingerprint or
report, so they spread with the data. Repeated rows of one case are first reduced by a
map-side maximum, which keeps a case with very many rows out of one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions.ordinals import era_group
from casemill.functions.text import number
from casemill.session import cut

# Years in one of each coded unit.
AGE_FACTORS = {"DEC": 10.0, "YR": 1.0, "MON": 1 / 12, "WK": 1 / 52.1775, "DY": 1 / 365.25, "HR": 1 / 8766.0}

#: The parts of a fingerprint that must be there for two cases to be duplicates.
REQUIRED = ["event_dt", "age_years", "drug_set", "pt_set"]
REQUIRED_LOOSE = ["event_dt", "drug_set", "pt_set"]


def age_years(age: Column, code: Column) -> Column:
    """Age in years to one decimal; a blank code means years, an unknown one gives NULL."""
    unit = F.upper(F.trim(F.coalesce(code, F.lit(""))))
    factor = F.when(unit == "", 1.0)
    for name, years in AGE_FACTORS.items():
        factor = factor.when(unit == name, years)
    return F.round(number(age) * factor, 1)


def latest_versions(demo: DataFrame) -> DataFrame:
    """The current report of each case within each id space.

    Order: highest version (the early id space has none; a missing one is lowest), highest
    report id, latest quarter. The maximum of a struct does it with map-side combine.
    """
    country = F.coalesce(F.nullif(F.trim("occr_country"), F.lit("")), F.nullif(F.trim("reporter_country"), F.lit("")), F.lit(""))
    version = F.when(F.col("era") != "laers", F.col("caseversion").try_cast("bigint"))
    rows = demo.filter("case_id is not null").select(
        "case_id",
        era_group(F.col("era")).alias("era_group"),
        F.struct(
            version.alias("rank"),
            "report_id",
            "quarter",
            "era",
            F.coalesce(F.trim("event_dt"), F.lit("")).alias("event_dt"),
            F.coalesce(F.trim("sex"), F.lit("")).alias("sex"),
            age_years(F.col("age"), F.col("age_cod")).alias("age_years"),
            country.alias("country"),
        ).alias("r"),
    )
    best = rows.groupBy("era_group", "case_id").agg(F.max("r").alias("r"))
    return best.select("era_group", "case_id", "r.rank", "r.report_id", "r.quarter", "r.era", "r.event_dt", "r.sex", "r.age_years", "r.country")


def bridged(latest: DataFrame) -> DataFrame:
    """One row per case id over both id spaces; the later space wins, then the latest quarter."""
    order = Window.partitionBy("case_id").orderBy(F.col("era_group") == "laers", F.desc_nulls_last("quarter"))
    return latest.withColumn("_rn", F.row_number().over(order)).filter("_rn = 1").drop("_rn")


def without(cases: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """The cases whose id is not in ``withdrawn``."""
    return cases.join(withdrawn.select("case_id").distinct(), "case_id", "left_anti")


def set_hashes(rows: DataFrame, value: str, name: str) -> DataFrame:
    """(era, report_id, name): count, xor and sum of the hashes of a report's distinct values."""
    distinct = (
        rows.filter(F.trim(value) != "")
        .select("era", "report_id", F.xxhash64(F.upper(F.trim(value))).alias("h"))
        .distinct()
    )
    return distinct.groupBy("era", "report_id").agg(
        F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor("h").alias("x"), F.sum(F.col("h").cast("decimal(38,0)")).alias("s")).alias(name)
    )


def fingerprints(cases: DataFrame, drug: DataFrame, reac: DataFrame) -> DataFrame:
    """``cases`` with drug_set, pt_set and a fingerprint of all parts."""
    got = cases.join(set_hashes(drug, "drugname", "drug_set"), ["era", "report_id"], "left").join(
        set_hashes(reac, "pt", "pt_set"), ["era", "report_id"], "left"
    )
    parts = ["event_dt", "sex", F.col("age_years").cast("string"), "country"]
    sets = [F.to_json(s) for s in ("drug_set", "pt_set")]
    text = F.concat_ws("~", *(F.coalesce(p if isinstance(p, Column) else F.col(p), F.lit("")) for p in (*parts, *sets)))
    return got.withColumn("fingerprint", F.md5(text))


def eligible(required: list[str]) -> Column:
    """All required parts of the fingerprint are there."""
    tests = {"event_dt": F.col("event_dt") != "", "sex": F.col("sex") != "", "country": F.col("country") != ""}
    return reduce(lambda a, b: a & b, (tests.get(r, F.col(r).isNotNull()) for r in required))


def without_near_duplicates(printed: DataFrame, required: list[str] | None = None) -> DataFrame:
    """The smallest case id of each fingerprint; sparse cases are kept as they are. The parts of the fingerprint are left out.

    A sparse case has its own id for a fingerprint, so one grouping serves both.
    """
    alone = F.concat(F.lit("case "), F.col("case_id").cast("string"))
    key = F.when(F.coalesce(eligible(required or REQUIRED), F.lit(False)), F.col("fingerprint")).otherwise(alone)
    names = [c for c in printed.columns if c not in ("drug_set", "pt_set", "fingerprint")]
    first = printed.groupBy(key.alias("_key")).agg(F.min(F.struct("case_id", *(c for c in names if c != "case_id"))).alias("r"))
    return first.select("r.*").select(*names)


def one_per_report(cases: DataFrame) -> DataFrame:
    """One case per report: the latest quarter's, then the highest case id."""
    rest = [c for c in cases.columns if c not in ("era", "report_id", "quarter", "case_id")]
    best = cases.groupBy("era", "report_id").agg(F.max(F.struct("quarter", "case_id", *rest)).alias("r"))
    return best.select("era", "report_id", "r.*").select(*cases.columns)


def case_set(demo: DataFrame, drug: DataFrame, reac: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """All steps: latest version, bridge, withdrawal, near-duplicates, one case per report."""
    printed = fingerprints(without(bridged(latest_versions(demo)), withdrawn), drug, reac)
    return one_per_report(without_near_duplicates(printed)).select(
        "case_id", "report_id", "era", "quarter", "event_dt", "sex", "age_years", "country"
    )


def duplicate_rule(printed: DataFrame, required: list[str]) -> DataFrame:
    """What another eligibility rule would remove: (removed, largest_group)."""
    groups = printed.filter(eligible(required)).groupBy("fingerprint").count()
    return groups.agg(
        F.coalesce(F.sum("count") - F.count(F.lit(1)), F.lit(0)).alias("removed"), F.coalesce(F.max("count"), F.lit(0)).alias("largest_group")
    )


def attrition(demo: DataFrame, drug: DataFrame, reac: DataFrame, withdrawn: DataFrame) -> DataFrame:
    """(stage, cases_remaining) after each step.

    The latest versions and the cases without near-duplicates are written once; what the
    bridge and the withdrawals leave is counted by case id alone.
    """
    latest = cut(latest_versions(demo), "latest")
    unique = cut(without_near_duplicates(fingerprints(without(bridged(latest), withdrawn), drug, reac)), "unique")
    gone = withdrawn.select("case_id").distinct().withColumn("gone", F.lit(True))
    count, n = F.count(F.lit(1)), "cases_remaining"
    spaces = latest.agg(F.count_if(F.col("era_group") == "laers").alias("a"), F.count_if(F.col("era_group") == "faers").alias("b"))
    ids = latest.select("case_id").distinct().join(gone, "case_id", "left").agg(count.alias("a"), F.count_if(F.col("gone").isNull()).alias("b"))

    def both(df: DataFrame, first: str, second: str) -> DataFrame:
        each = F.array(*(F.struct(F.lit(s).alias("stage"), F.col(c).alias(n)) for s, c in ((first, "a"), (second, "b"))))
        return df.select(F.explode(each).alias("x")).select("x.*")

    def one(df: DataFrame, stage: str) -> DataFrame:
        return df.agg(count.alias(n)).select(F.lit(stage).alias("stage"), n)

    parts = [
        one(demo, "0_rows"), both(spaces, "1_within_laers", "2_within_faers"), both(ids, "3_bridge", "4_withdrawn"), one(unique, "5_near_duplicates"),
        one(unique.select("era", "report_id").distinct(), "6_one_per_report"),
    ]
    return reduce(DataFrame.unionByName, parts)
