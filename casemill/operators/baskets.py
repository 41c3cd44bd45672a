"""Baskets of items per case, the population behind them, and pair counts.

A case counts once in every number. The population holds all cases but the excluded
ones, those without any item included; strata are extra grouping columns, never other
tables.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The roles that count under each policy.
ROLES = {"primary": ["PS", "SS", "I"], "sensitivity": ["PS", "SS", "I", "C"]}


#: Items of a basket that one task takes as an array.
BLOCK = 1000


def raw_baskets(items: DataFrame, cases: DataFrame, policy: str = "primary") -> DataFrame:
    """Distinct (case_id, ingredient) of the surviving reports under a role policy."""
    rows = items.filter(F.upper(F.trim("role_cod")).isin(ROLES[policy])).select(
        "era", "report_id", F.upper(F.trim("ingredient")).alias("ingredient")
    )
    return rows.filter("ingredient <> ''").join(cases.select("case_id", "era", "report_id"), ["era", "report_id"]).select("case_id", "ingredient").distinct()


def excluded_cases(raw: DataFrame, cap: int | None = 20, context: Sequence[str] = ()) -> DataFrame:
    """Distinct ids of cases over ``cap`` items (None: no cap) or with a context item."""
    out = raw.select("case_id").limit(0)
    if cap is not None:
        out = out.union(raw.groupBy("case_id").count().filter(F.col("count") > cap).select("case_id"))
    if context:
        out = out.union(raw.filter(F.col("ingredient").isin(list(context))).select("case_id"))
    return out.distinct()


def population(cases: DataFrame, events: DataFrame, excluded: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(case_id, is_core, is_broad, keep...): every case that is not excluded."""
    flags = events.select("case_id", "is_core", "is_broad")
    return (
        cases.select("case_id", *keep)
        .join(excluded, "case_id", "left_anti")
        .join(flags, "case_id", "left")
        .select("case_id", F.coalesce("is_core", F.lit(False)).alias("is_core"), F.coalesce("is_broad", F.lit(False)).alias("is_broad"), *keep)
    )


def baskets(raw: DataFrame, flags: DataFrame, tier: str = "core", keep: Sequence[str] = ()) -> DataFrame:
    """(case_id, ingredient, event, keep...): the baskets of the population with its event flag."""
    return raw.join(flags.select("case_id", F.col(f"is_{tier}").alias("event"), *keep), "case_id")


def totals(flags: DataFrame, tier: str = "core", keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., n_total, n_event): one row per stratum, one in all without strata."""
    aggs = (F.count(F.lit(1)).alias("n_total"), F.count_if(F.col(f"is_{tier}")).alias("n_event"))
    return flags.groupBy(*keep).agg(*aggs) if keep else flags.agg(*aggs)


def marginals(rows: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., ingredient, n_item, n_item_event) of the baskets."""
    return rows.groupBy(*keep, "ingredient").agg(F.count(F.lit(1)).alias("n_item"), F.count_if("event").alias("n_item_event"))


def top_items(single: DataFrame, n: int, order: str = "n_item_event", least: int = 0) -> DataFrame:
    """The ``n`` items with the highest count, ties by name."""
    return single.filter(F.col("n_item") >= least).orderBy(F.desc(order), "ingredient").limit(n)


def pair_rows(rows: DataFrame, carry: Sequence[str], largest: int | None = None) -> DataFrame:
    """(carry..., item_a, item_b): a row per case and unordered pair of its items, a before b.

    ``rows`` is (case_id, ingredient, carry...), the carried columns being the same in all
    rows of a case. Each basket becomes one sorted array; from it the items after each
    item are taken. ``largest`` is the size no basket exceeds, if the caller knows one;
    without it, or beyond ``BLOCK``, a basket over ``BLOCK`` items is not made an array but
    split into parts of about that size, each of which meets all items in a task of its own.
    """
    split = None
    if largest is None or largest > BLOCK:
        size = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("_size")).filter(F.col("_size") > BLOCK).withColumn("_parts", F.ceil(F.col("_size") / BLOCK).cast("int"))
        large = rows.join(size.select("case_id", "_parts"), "case_id")
        left = large.select("case_id", *carry, F.col("ingredient").alias("item_a"), F.pmod(F.xxhash64("ingredient"), F.col("_parts")).cast("int").alias("_part"))
        right = large.select("case_id", F.col("ingredient").alias("item_b"), F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)).alias("_part"))
        split = left.join(right, ["case_id", "_part"]).filter("item_a < item_b").select(*carry, "item_a", "item_b")
        rows = rows.join(size, "case_id", "left_anti")
    arrays = rows.groupBy("case_id").agg(F.array_sort(F.collect_list("ingredient")).alias("items"), *(F.max(c).alias(c) for c in carry))
    heads = arrays.filter(F.size("items") > 1).select(*carry, "items", F.posexplode("items").alias("at", "item_a"))
    pairs = heads.select(*carry, "item_a", F.explode(F.slice("items", F.col("at") + 2, F.size("items"))).alias("item_b"))
    return pairs if split is None else pairs.unionByName(split)


def pair_counts(rows: DataFrame, items: DataFrame | None = None, least: int = 1, keep: Sequence[str] = (), largest: int | None = None) -> DataFrame:
    """(keep..., item_a, item_b, n_ab, n_abz) of unordered pairs, a before b.

    Baskets are cut to ``items`` first, and the counts of pairs are combined map-side before
    the shuffle. ``keep`` are strata, the same in all rows of a case; for ``largest`` see
    ``pair_rows``.
    """
    if items is not None:
        rows = rows.join(items.select("ingredient").distinct(), "ingredient", "left_semi")
    counted = pair_rows(rows, [*keep, "event"], largest).groupBy(*keep, "item_a", "item_b").agg(F.count(F.lit(1)).alias("n_ab"), F.count_if("event").alias("n_abz"))
    return counted.filter(F.col("n_ab") >= least)


def cap_sweep(raw: DataFrame, flags: DataFrame, caps: Sequence[int | None]) -> DataFrame:
    """(cap, n_total, n_event, n_pairs, pair_rows) for several caps on the size of a basket; None is no cap.

    ``flags`` is the population without a cap. A pair is there under a cap if its smallest
    basket is, so all caps come from one pass over the pairs.
    """
    sizes = raw.groupBy("case_id").agg(F.count(F.lit(1)).alias("k"))
    cases = flags.select("case_id", "is_core").join(sizes, "case_id", "left").fillna(0, ["k"])
    least = pair_rows(raw.join(sizes, "case_id"), ["k"]).groupBy("item_a", "item_b").agg(F.min("k").alias("k"))
    inside = {i: F.lit(True) if cap is None else F.col("k") <= cap for i, cap in enumerate(caps)}
    pair_number = F.col("k") * (F.col("k") - 1) / 2
    one = cases.agg(
        *(F.count_if(w).alias(f"n{i}") for i, w in inside.items()), *(F.count_if(w & F.col("is_core")).alias(f"e{i}") for i, w in inside.items()),
        *(F.coalesce(F.sum(F.when(w, pair_number)), F.lit(0)).cast("bigint").alias(f"r{i}") for i, w in inside.items()),
    )
    two = least.agg(*(F.count_if(w).alias(f"p{i}") for i, w in inside.items()))
    each = F.array(
        *(F.struct(F.lit(cap).cast("int").alias("cap"), *(F.col(f"{c}{i}").alias(n) for c, n in (("n", "n_total"), ("e", "n_event"), ("p", "n_pairs"), ("r", "pair_rows")))) for i, cap in enumerate(caps))
    )
    return one.join(F.broadcast(two)).select(F.explode(each).alias("x")).select("x.*")  # single rows


def with_margins(pairs: DataFrame, single: DataFrame, whole: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """``pairs`` with n_a, n_az, n_b, n_bz, n_total and n_event; ``whole`` is one row per stratum."""
    a = single.select(*keep, F.col("ingredient").alias("item_a"), F.col("n_item").alias("n_a"), F.col("n_item_event").alias("n_az"))
    b = single.select(*keep, F.col("ingredient").alias("item_b"), F.col("n_item").alias("n_b"), F.col("n_item_event").alias("n_bz"))
    got = pairs.join(a, [*keep, "item_a"]).join(b, [*keep, "item_b"])
    if keep:
        return got.join(whole, list(keep))
    return got.join(F.broadcast(whole))  # a single row


def size_bands(raw: DataFrame, flags: DataFrame, tier: str = "core") -> DataFrame:
    """(band, cases, events, pair_share, event_rate) by number of items in a case."""
    sized = raw.groupBy("case_id").agg(F.count(F.lit(1)).alias("k")).join(flags.select("case_id", F.col(f"is_{tier}").alias("event")), "case_id")
    band = F.when(F.col("k") <= 1, "1").when(F.col("k") <= 5, "2-5").when(F.col("k") <= 10, "6-10").when(F.col("k") <= 20, "11-20").otherwise("21+")
    by = sized.groupBy(band.alias("band")).agg(
        F.count(F.lit(1)).alias("cases"), F.count_if("event").alias("events"), F.sum(F.col("k") * (F.col("k") - 1) / 2).alias("pairs")
    )
    whole = by.agg(F.sum("pairs").alias("all_pairs"))
    return by.join(F.broadcast(whole)).select(  # a single row
        "band", "cases", "events",
        F.round(F.try_divide(F.col("pairs"), F.col("all_pairs")), 6).alias("pair_share"),
        F.round(F.col("events") / F.col("cases"), 6).alias("event_rate"),
    )
