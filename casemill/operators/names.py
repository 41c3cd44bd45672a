"""Name keys, majority dictionaries and the resolution ladder, in built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.text import normalised
from casemill.operators.lexicon import DOSE_UNITS, FORMS, SALT_COMPOUNDS, SALTS, UNITS

_DOSE = (
    r"\b[0-9]+(?:[.,][0-9]+)?\s*(?:" + "|".join(u for u in DOSE_UNITS if u != "%") + r"|%)\b(?:\s*/\s*\S+)?"
)


def relaxed(col: Column) -> Column:
    """The name without brackets, doses, marks, forms, units and bare numbers."""
    text = F.regexp_replace(F.upper(col), r"\([^)]*\)", " ")
    text = F.regexp_replace(text, _DOSE, " ")
    text = F.regexp_replace(text, r"[^A-Z0-9 ]+", " ")
    noise = sorted({*FORMS, *UNITS})
    return F.array_join(
        F.filter(F.split(text, " +"), lambda t: (t != "") & ~t.isin(noise) & ~t.rlike("^[0-9]+$")), " "
    )


def without_salts(col: Column) -> Column:
    """The name without salt words at its end; never empty, and compounds keep theirs.

    The words are folded from the back: a word is dropped while everything behind it is
    dropped, it is a salt, it is not the first, and the words so far are no compound.
    """
    words = F.filter(F.split(F.regexp_replace(F.upper(col), r"[^A-Z0-9 ]+", " "), " +"), lambda t: t != "")
    start = F.struct(words.alias("left"), F.lit(False).alias("stop"))

    def step(acc: Column, _: Column) -> Column:
        left = acc["left"]
        last = F.element_at(left, -1)
        stop = acc["stop"] | (F.size(left) <= 1) | ~last.isin(SALTS) | F.array_join(left, " ").isin(SALT_COMPOUNDS)
        return F.struct(F.when(stop, left).otherwise(F.slice(left, 1, F.greatest(F.size(left) - 1, F.lit(0)))).alias("left"), stop.alias("stop"))

    return F.array_join(F.when(F.size(words) > 0, F.aggregate(words, start, step)["left"]).otherwise(words), " ")


def majority(rows: DataFrame, key: str, value: str) -> DataFrame:
    """The most frequent value of each key; of equally frequent ones the smallest."""
    counted = rows.filter((F.col(value) != "") & (F.col(key) != "")).groupBy(key, value).count()
    best = counted.groupBy(key).agg(F.min(F.struct((-F.col("count")).alias("n"), F.col(value))).alias("b"))
    return best.select(key, F.col(f"b.{value}").alias(value))


def resolved(drug: DataFrame) -> DataFrame:
    """The ladder: (era, report_id, drug_seq, role_cod, drugname, resolution_level, ingredient_raw).

    Level 1 is the row's own canonical name, 2 the majority of its exact key, 3 that of
    its relaxed key, 4 the key itself. Rows with both names blank are left out.
    """
    rows = drug.select(
        "era",
        "report_id",
        "drug_seq",
        F.upper(F.trim("role_cod")).alias("role_cod"),
        F.coalesce(F.trim("drugname"), F.lit("")).alias("drugname"),
        F.coalesce(F.trim("prod_ai"), F.lit("")).alias("prod_ai"),
    ).filter("drugname <> '' or prod_ai <> ''")
    keyed = rows.withColumn("name_key", normalised(F.col("drugname"))).withColumn("relaxed_key", relaxed(F.col("drugname")))
    exact = majority(keyed, "name_key", "prod_ai").withColumnRenamed("prod_ai", "exact_ai")
    loose = majority(keyed, "relaxed_key", "prod_ai").withColumnRenamed("prod_ai", "relaxed_ai")
    joined = keyed.join(exact, "name_key", "left").join(loose, "relaxed_key", "left")
    level = (
        F.when(F.col("prod_ai") != "", 1).when(F.col("exact_ai").isNotNull(), 2).when(F.col("relaxed_ai").isNotNull(), 3).otherwise(4)
    )
    raw = F.coalesce(
        F.nullif("prod_ai", F.lit("")), F.col("exact_ai"), F.col("relaxed_ai"), F.nullif("relaxed_key", F.lit("")), F.col("name_key")
    )
    return joined.select(
        "era", "report_id", "drug_seq", "role_cod", "drugname", level.alias("resolution_level"), raw.alias("ingredient_raw")
    )


def ingredients(ladder: DataFrame) -> DataFrame:
    """One row per part of a combination (split at the backslash), salts taken off."""
    part = ladder.select("era", "report_id", "drug_seq", "role_cod", "resolution_level", F.explode(F.split("ingredient_raw", r"\\")).alias("part"))
    return part.withColumn("ingredient", without_salts(F.col("part"))).filter("ingredient <> ''").drop("part")


def coverage(ladder: DataFrame) -> DataFrame:
    """(era, drug_rows, resolved_rows, share): rows resolved to an ingredient."""
    return ladder.groupBy("era").agg(
        F.count(F.lit(1)).alias("drug_rows"),
        F.count_if(F.col("resolution_level") <= 3).alias("resolved_rows"),
        F.round(F.avg((F.col("resolution_level") <= 3).cast("double")), 6).alias("share"),
    )


def entity_coverage(items: DataFrame, names: DataFrame) -> DataFrame:
    """(name, reports, item_rows, unmerged_variants, status) of each listed name.

    A variant is another item that begins with the name and a blank. The items are
    counted first; each is then met by its own prefixes, so no pair of unrelated texts
    is ever compared.
    """
    counted = items.groupBy("ingredient").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("era", "report_id").alias("reports")
    )
    words = F.split("ingredient", " ")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(words)), lambda k: F.array_join(F.slice(words, 1, k), " "))
    met = counted.select("ingredient", "n", "reports", F.explode(prefixes).alias("name")).join(names.select("name").distinct(), "name")
    own = F.col("ingredient") == F.col("name")
    hits = met.groupBy("name").agg(
        F.sum(F.when(own, F.col("reports")).otherwise(0)).alias("reports"),
        F.sum(F.when(own, F.col("n")).otherwise(0)).alias("item_rows"),
        F.count_if(~own).alias("unmerged_variants"),
    )
    got = names.select("name").distinct().join(hits, "name", "left").fillna(0, ["reports", "item_rows", "unmerged_variants"])
    return got.withColumn("status", F.when(F.col("reports") > 0, "OK").otherwise("MISSING"))


def annotation_agreement(drug: DataFrame, least: int = 20) -> DataFrame:
    """How consistent the canonical name of one verbatim name is, over names with at least ``least`` annotated rows.

    (names_examined, rows_examined, modal_agreement, names_unanimous, fraction_unanimous);
    the agreement is the share of rows that carry their name's most frequent value.
    """
    rows = drug.filter((F.trim("prod_ai") != "") & (F.trim("drugname") != "")).select(
        F.upper(F.trim("drugname")).alias("name"), F.upper(F.trim("prod_ai")).alias("ai")
    )
    modal = rows.groupBy("name", "ai").count().groupBy("name").agg(F.sum("count").alias("n"), F.max("count").alias("top"))
    sums = modal.filter(F.col("n") >= least).agg(
        F.count(F.lit(1)).alias("names_examined"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("rows_examined"),
        F.round(F.try_divide(F.sum("top"), F.sum("n")), 6).alias("modal_agreement"),
        F.count_if(F.col("top") == F.col("n")).alias("names_unanimous"),
    )
    return sums.withColumn("fraction_unanimous", F.round(F.try_divide(F.col("names_unanimous"), F.col("names_examined")), 6))
