"""The best representative of each duplicate group: skyline selection.

Records of a group are compared by trust (version), recency (quarter) and completeness
(number of filled fields). One dominates another if it is not worse in any of them and
better in version or quarter; records equal in both are left to the policy. The
dominance layer of a record is one more than the highest layer among its dominators. The
lexicographic policy (version, quarter, report id, each highest first) picks the
survivor from the first layer; each field it lacks is filled from the first layer that
has it, by the same policy.

Layers depend on (version, quarter, completeness) only. Records are first aggregated to
these points, with the policy's best value of each field, so a group with a third of all
rows reaches the second step as few points: versions x quarters x fields at most.

Defined results: a NULL key forms no group; a version that is no number is the lowest,
as is a NULL quarter; blank fields count as missing; repeated rows change nothing but
``n_rows``; a field no record has stays NULL. Columns named ``n_rows`` or ``n_layers`` are
replaced by the counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.text import filled


def version_number(version: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.trim(version.cast("string")), r"\.0+$", "").try_cast("bigint"), F.lit(-1))


def survivors(
    df: DataFrame, key: str = "case_id", version: str = "caseversion", quarter: str = "quarter", ident: str = "report_id",
    fields: list[str] | None = None, fill: list[str] | None = None,
) -> DataFrame:
    """One row per key: key, ident, quarter, version of the survivor, the filled fields, n_rows, n_layers.

    ``fields`` are what completeness counts, ``fill`` (all of them by default) those to be
    filled; the values of the others need not be carried along.
    """
    if fields is None:
        fields = [c for c in df.columns if c not in (key, version, quarter, ident, "n_rows", "n_layers")]
    values = {f"_f{i}": name for i, name in enumerate(fields if fill is None else fill)}
    has = [filled(F.col(n).cast("string")).cast("int") for n in fields]
    base = df.filter(F.col(key).isNotNull()).select(
        F.col(key).alias("_key"),
        version_number(F.col(version)).alias("_v"),
        F.coalesce(F.col(quarter).cast("string"), F.lit("")).alias("_q"),
        F.coalesce(F.col(ident).cast("bigint"), F.lit(-1)).alias("_r"),
        sum(has, F.lit(0)).alias("_c"),
        *(F.when(filled(F.col(n).cast("string")), F.col(n)).alias(f) for f, n in values.items()),
    )
    points = (
        base.groupBy("_key", "_v", "_q", "_c")
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.max("_r").alias("_r"),
            *(F.max(F.when(F.col(f).isNotNull(), F.struct(F.col("_r"), F.col(f).alias("x")))).alias(f) for f in values),
        )
    )
    # Best first, so every dominator stands before what it dominates.
    groups = points.groupBy("_key").agg(
        F.reverse(F.array_sort(F.collect_list(F.struct("_v", "_q", "_c", "_r", "_n", *values)))).alias("_points"),
        F.sum("_n").alias("n_rows"),
    )

    def layered(seen: Column, p: Column) -> Column:
        above = F.filter(
            seen,
            lambda s: (s["v"] >= p["_v"]) & (s["q"] >= p["_q"]) & (s["c"] >= p["_c"]) & ((s["v"] > p["_v"]) | (s["q"] > p["_q"])),
        )
        layer = F.coalesce(F.array_max(F.transform(above, lambda s: s["layer"])), F.lit(0)) + 1
        return F.array_append(seen, F.struct(p["_v"].alias("v"), p["_q"].alias("q"), p["_c"].alias("c"), layer.alias("layer")))

    layers = F.aggregate("_points", F.array().cast("array<struct<v:bigint,q:string,c:int,layer:int>>"), layered)
    ranked = groups.withColumn("_layers", F.transform(layers, lambda s: s["layer"])).withColumn("_at", F.arrays_zip("_points", "_layers"))

    def value(f: str) -> Column:
        having = F.filter("_at", lambda z: z["_points"][f].isNotNull())
        best = F.array_max(
            F.transform(
                having,
                lambda z: F.struct(
                    (-z["_layers"]).alias("l"), z["_points"]["_v"].alias("v"), z["_points"]["_q"].alias("q"), z["_points"][f].alias("x")
                ),
            )
        )
        return best["x"]["x"]

    first = F.array_max(
        F.transform(
            F.filter("_at", lambda z: z["_layers"] == 1),
            lambda z: F.struct(z["_points"]["_v"].alias("v"), z["_points"]["_q"].alias("q"), z["_points"]["_r"].alias("r")),
        )
    )
    got = ranked.withColumn("_first", first)
    return got.select(
        F.col("_key").alias(key),
        F.when(F.col("_first.r") != -1, F.col("_first.r")).alias(ident),
        F.nullif(F.col("_first.q"), F.lit("")).alias(quarter),
        F.when(F.col("_first.v") != -1, F.col("_first.v")).alias(version),
        *(value(f).alias(n) for f, n in values.items()),
        "n_rows",
        F.array_max("_layers").alias("n_layers"),
    )
