"""Scores of item pairs against an event, as column expressions.

A pair is eight numbers: n_abz with both items and the event, the pair margins n_ab,
n_az, n_bz, the single margins n_a, n_b, n_event, and n_total. They determine the
2 x 2 x 2 table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ALPHA = 0.5
#: Halvings of the root search; doubles have no more to give.
HALVINGS = 60


def _d(name: str) -> Column:
    return F.col(name).cast("double")


def cells() -> dict[str, Column]:
    """The eight cells by item a, item b, event."""
    n, ab, az, bz = _d("n_abz"), _d("n_ab"), _d("n_az"), _d("n_bz")
    a, b, z, total = _d("n_a"), _d("n_b"), _d("n_event"), _d("n_total")
    return {
        "c111": n,
        "c110": ab - n,
        "c101": az - n,
        "c100": a - ab - az + n,
        "c011": bz - n,
        "c010": b - ab - bz + n,
        "c001": z - az - bz + n,
        "c000": total - a - b - z + ab + az + bz - n,
    }


def with_cells(pairs: DataFrame) -> DataFrame:
    """``pairs`` with the cells and ``negative_cell``, true where the counts contradict each other."""
    table = cells()
    bad = F.lit(False)
    for c in table.values():
        bad = bad | (c < -1e-9)
    return pairs.withColumns({**table, "negative_cell": bad})


def expected_no_three_way() -> Column:
    """The expected n_abz if all pairwise associations hold and nothing more.

    With the margins fixed every cell is affine in x, and the odds ratios of the two
    layers are equal where an increasing product meets a decreasing one; the root is
    found by halving the feasible interval. NULL if a single margin is 0.
    """
    ab, az, bz = _d("n_ab"), _d("n_az"), _d("n_bz")
    a, b, z, total = _d("n_a"), _d("n_b"), _d("n_event"), _d("n_total")
    rest = total - a - b - z + ab + az + bz
    low = F.greatest(F.lit(0.0), ab + az - a, ab + bz - b, az + bz - z)
    high = F.least(ab, az, bz, rest)

    def halve(acc: Column, _: Column) -> Column:
        x = (acc["lo"] + acc["hi"]) / 2
        up = x * (a - ab - az + x) * (b - ab - bz + x) * (z - az - bz + x)
        down = (ab - x) * (az - x) * (bz - x) * (rest - x)
        return F.struct(F.when(up < down, x).otherwise(acc["lo"]).alias("lo"), F.when(up < down, acc["hi"]).otherwise(x).alias("hi"))

    start = F.struct(low.alias("lo"), F.greatest(low, high).alias("hi"))
    root = F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda acc: (acc["lo"] + acc["hi"]) / 2)
    return F.when((a > 0) & (b > 0) & (z > 0), root)


def expected_closed_form() -> Column:
    """The product formula n_ab n_az n_bz n_total / (n_a n_b n_event), for comparison only."""
    return F.try_divide(_d("n_ab") * _d("n_az") * _d("n_bz"), _d("n_a") * _d("n_b") * _d("n_event")) * _d("n_total")


def expected_additive() -> Column:
    """The expected n_abz if excess risks add up; never below the larger single risk, never above 1."""
    risk_a, risk_b = F.try_divide(_d("n_az"), _d("n_a")), F.try_divide(_d("n_bz"), _d("n_b"))
    base = F.try_divide(_d("n_event"), _d("n_total"))
    joint = F.least(F.greatest(risk_a + risk_b - base, risk_a, risk_b), F.lit(1.0)) * _d("n_ab")
    return F.when((F.col("n_a") > 0) & (F.col("n_b") > 0) & (F.col("n_total") > 0), joint)


def expected_naive() -> Column:
    """The expected n_abz if everything were independent."""
    return F.try_divide(_d("n_a") * _d("n_b") * _d("n_event"), _d("n_total") * _d("n_total"))


def log_ratio(observed: Column, expected: Column, alpha: float = ALPHA) -> Column:
    """log2 of observed to expected, both shrunk by ``alpha``."""
    return F.log2((observed + alpha) / (expected + alpha))


def scored(pairs: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """``pairs`` with the three expectations and their log ratios."""
    n = _d("n_abz")
    got = pairs.withColumns(
        {"expected": expected_no_three_way(), "additive_expected": expected_additive(), "naive_expected": expected_naive()}
    )
    return got.withColumns(
        {
            "omega": log_ratio(n, F.col("expected"), alpha),
            "omega_add": log_ratio(n, F.col("additive_expected"), alpha),
            "naive_log2_oe": log_ratio(n, F.col("naive_expected"), alpha),
        }
    )


def relative_risk(event: Column, count: Column, all_events: Column, total: Column) -> Column:
    """Event rate of an item over that of the population; NULL without events."""
    ratio = F.try_divide(F.try_divide(event.cast("double"), count.cast("double")), F.try_divide(all_events.cast("double"), total.cast("double")))
    return F.when(event > 0, ratio)


def with_strength(pairs: DataFrame) -> DataFrame:
    """``pairs`` with rr_a, rr_b and strength, log2 of their product."""
    z, total = F.col("n_event"), F.col("n_total")
    got = pairs.withColumns(
        {"rr_a": relative_risk(F.col("n_az"), F.col("n_a"), z, total), "rr_b": relative_risk(F.col("n_bz"), F.col("n_b"), z, total)}
    )
    return got.withColumn("strength", F.log2(F.col("rr_a") * F.col("rr_b")))


def partner_excess(scored_pairs: DataFrame, least_pair: int = 20, least_partners: int = 20, alpha: float = ALPHA) -> DataFrame:
    """``item_a, item_b, partner_excess``: log2 excess over what each item does with its other partners.

    Both orientations of each pair give the item's partner rates as a sorted array; the
    median without the partner itself is read off by position, so no pair of partners is
    ever formed. The smaller of the two excesses counts; NULL with too few partners.
    """
    both = scored_pairs.select(F.col("item_a").alias("item"), F.col("item_b").alias("partner"), "n_ab", "n_abz").unionByName(
        scored_pairs.select(F.col("item_b").alias("item"), F.col("item_a").alias("partner"), "n_ab", "n_abz")
    )
    usable = both.filter(F.col("n_ab") >= least_pair).withColumn("rate", F.col("n_abz") / F.col("n_ab"))
    lists = usable.groupBy("item").agg(F.array_sort(F.collect_list("rate")).alias("rates"))
    joined = both.join(lists, "item", "left").withColumn("rate", F.col("n_abz") / F.col("n_ab"))
    own = F.when(F.col("n_ab") >= least_pair, F.array_position("rates", F.col("rate"))).otherwise(F.lit(0))
    k = F.coalesce(F.size("rates"), F.lit(0)) - F.when(own > 0, 1).otherwise(0)
    joined = joined.withColumns({"own": own.cast("int"), "k": k})

    def at(i: Column) -> Column:
        """The i-th rate, from 0, of the list without the own one."""
        place = i + F.when((F.col("own") > 0) & (i + 1 >= F.col("own")), 1).otherwise(0)
        return F.get("rates", place)

    half = F.floor(F.col("k") / 2).cast("int")
    median = F.when(F.col("k") % 2 == 1, at(half)).otherwise((at(half - 1) + at(half)) / 2)
    excess = F.when(F.col("k") >= least_partners, F.log2((F.col("n_abz") + alpha) / (F.col("n_ab") * median + alpha)))
    sides = joined.select(F.least("item", "partner").alias("item_a"), F.greatest("item", "partner").alias("item_b"), excess.alias("e"))
    got = sides.groupBy("item_a", "item_b").agg(F.min("e").alias("low"), F.count("e").alias("n"))
    return got.select("item_a", "item_b", F.when(F.col("n") == 2, F.col("low")).alias("partner_excess"))
