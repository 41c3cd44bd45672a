"""Intervals, permutation tests and cluster bootstraps over item pairs.

Closed forms are column expressions. Replicated statistics run one replicate per row of a
range: each has a seed of its own, made from the base seed and its number, so results do
not depend on the partitioning. The pair list a replicate needs is sent to the workers as
arrays behind a check of its size; a longer list is refused, not sampled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions.special import student_p
from casemill.session import cut

#: A replicate holds the pairs in memory; 5 million take about 100 MB.
MAX_PAIRS = 5_000_000
SEED = 20260802


def rule_of_three(trials: Column, level: float = 0.95) -> Column:
    """Upper bound of a rate with no event in ``trials``; NULL without trials."""
    return F.try_divide(F.lit(-math.log(1 - level)), trials.cast("double"))


def ratio_interval(ka: Column, na: Column, kb: Column, nb: Column, level: float = 0.95) -> tuple[Column, Column, Column]:
    """(ratio, low, high) of two proportions on the log scale; NULL where a count is 0."""
    z = NormalDist().inv_cdf(1 - (1 - level) / 2)
    ok = (ka > 0) & (kb > 0) & (na > 0) & (nb > 0)
    ratio = F.try_divide(F.try_divide(ka, na), F.try_divide(kb, nb))
    one = F.lit(1.0)
    se = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(one, ka) - F.try_divide(one, na) + F.try_divide(one, kb) - F.try_divide(one, nb)))
    low, high = F.exp(F.log(ratio) - z * se), F.exp(F.log(ratio) + z * se)
    return F.when(ok, ratio), F.when(ok, low), F.when(ok, high)


def correlation(df: DataFrame, x: str, y: str, level: float = 0.95) -> DataFrame:
    """One row (n, r, ci_low, ci_high, p_value): Pearson's r with Fisher's interval."""
    both = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = both.agg(F.count(F.lit(1)).alias("n"), F.corr(x, y).alias("r"))
    z = NormalDist().inv_cdf(1 - (1 - level) / 2)

    @F.pandas_udf("double")
    def p_value(n: pd.Series, r: pd.Series) -> pd.Series:
        def one(n: int, r: float) -> float | None:
            if r != r or n < 3 or abs(r) > 1:
                return None
            return 0.0 if abs(r) == 1 else student_p(r * math.sqrt((n - 2) / (1 - r * r)), n - 2)

        return pd.Series([one(*x) for x in zip(n, r.astype("float64"))], dtype="float64")

    half = F.when(F.col("n") > 3, z / F.sqrt(F.greatest(F.col("n") - 3, F.lit(1))))
    middle = F.atanh("r")
    return sums.select(
        "n", "r", F.tanh(middle - half).alias("ci_low"), F.tanh(middle + half).alias("ci_high"), p_value("n", "r").alias("p_value")
    )


def leave_one_out(df: DataFrame, first: str, second: str) -> DataFrame:
    """One row: recovery if each control's method is chosen on the others.

    The choice for a control needs only the totals less its own outcome, so one
    aggregate row joined to all does it.
    """
    one, two = F.col(first).cast("int"), F.col(second).cast("int")
    sums = df.agg(F.sum(one).alias("_s1"), F.sum(two).alias("_s2"))
    folds = df.join(F.broadcast(sums))  # a single row
    pick = (F.col("_s1") - one) >= (F.col("_s2") - two)
    got = folds.agg(
        F.count(F.lit(1)).alias("n_folds"),
        F.count_if(pick).alias("folds_first"),
        F.sum(F.when(pick, one).otherwise(two)).alias("loo_recovered"),
        F.sum(one).alias("in_sample_recovered"),
    )
    return got.withColumn("optimism", F.round((F.col("in_sample_recovered") - F.col("loo_recovered")) / F.col("n_folds"), 6))


def mantel_haenszel(df: DataFrame, signal: str, exposed: str, by: str, strata: int = 10, least: int = 20) -> DataFrame:
    """One row (ratio, n_strata_used): the risk ratio over quantile strata of ``by``.

    Strata are half-open but the last; one with under ``least`` rows or an empty arm is
    skipped.
    """
    shares = [i / strata for i in range(strata + 1)]
    edges = df.agg(F.percentile(by, F.array(*map(F.lit, shares))).alias("edges"))
    place = F.least(F.size(F.filter("edges", lambda e: e <= F.col(by))) - 1, F.lit(strata - 1))
    cells = (
        df.join(F.broadcast(edges))  # a single row
        .groupBy(place.alias("stratum"))
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_if(exposed).alias("e"),
            F.count_if(F.col(exposed) & F.col(signal)).alias("se"),
            F.count_if(~F.col(exposed) & F.col(signal)).alias("su"),
        )
        .withColumn("u", F.col("n") - F.col("e"))
        .filter((F.col("n") >= least) & (F.col("e") > 0) & (F.col("u") > 0))
    )
    sums = cells.agg(
        F.sum(F.col("se") * F.col("u") / F.col("n")).alias("top"), F.sum(F.col("su") * F.col("e") / F.col("n")).alias("low"), F.count(F.lit(1)).alias("n_strata_used")
    )
    return sums.select(F.round(F.try_divide(F.col("top"), F.col("low")), 6).alias("ratio"), "n_strata_used")


def benjamini_hochberg(df: DataFrame, p: str, q: float = 0.05) -> DataFrame:
    """``df`` with ``discovery``: true for the p-values the step-up rule accepts.

    The largest accepted value is found over the distinct p-values: their counts are
    summed up in order, and a value is accepted if any value not below it passes its
    line. Distinct values are range-partitioned and their partition sums added, so the
    ranking needs no single task for all rows.
    """
    counts = df.filter(F.col(p).isNotNull()).groupBy(p).agg(F.count(F.lit(1)).alias("_n"))
    # Written once: the ranges are drawn by sampling and may differ when computed again.
    ordered = cut(counts.repartitionByRange(F.col(p)).withColumn("_part", F.spark_partition_id()), "ranks")
    parts = ordered.groupBy("_part").agg(F.sum("_n").alias("_n")).orderBy("_part").collect()  # a row per partition
    total, before = 0, {}
    for row in parts:
        before[row["_part"]] = total
        total += row["_n"]
    if not total:
        return df.withColumn("discovery", F.lit(False))
    offsets = F.create_map(*(F.lit(x) for pair in before.items() for x in pair))
    within = Window.partitionBy("_part").orderBy(p).rowsBetween(Window.unboundedPreceding, 0)
    lined = ordered.withColumn("_rank", F.sum("_n").over(within) + F.try_element_at(offsets, F.col("_part")))
    limit = lined.filter(F.col(p) <= q * F.col("_rank") / total).agg(F.max(p).alias("_limit"))
    return df.join(F.broadcast(limit)).withColumn("discovery", F.coalesce(F.col(p) <= F.col("_limit"), F.lit(False))).drop("_limit")  # a single row


def _arrays(df: DataFrame, columns: list[str]) -> pd.DataFrame:
    """The rows on the driver, behind a check of their number, in a fixed order."""
    if df.select(F.lit(1)).limit(MAX_PAIRS + 1).count() > MAX_PAIRS:
        raise ValueError(f"more than {MAX_PAIRS} rows for a replicated statistic")
    return df.select(*columns).orderBy(*columns).toPandas()


def replicated(df: DataFrame, columns: list[str], n: int, statistic: Callable[[pd.DataFrame, np.random.Generator], float | None], seed: int = SEED) -> DataFrame:
    """(replicate, value): ``statistic`` of the broadcast rows, one seed per replicate."""
    spark = df.sparkSession
    rows = spark.sparkContext.broadcast(_arrays(df, columns))

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [statistic(rows.value, np.random.default_rng([seed, int(i)])) for i in frame["id"]]
            yield pd.DataFrame({"replicate": frame["id"], "value": pd.Series(got, dtype="float64")})

    return spark.range(n).repartition(max(1, min(n, spark.sparkContext.defaultParallelism))).mapInPandas(batches, "replicate bigint, value double")


_LAST: list = []


def _coded(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``_codes``, remembered for the frame of the replicates before."""
    if not _LAST or _LAST[0] is not rows:
        _LAST[:] = [rows, _codes(rows)]
    return _LAST[1]


def _codes(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The item names, and each pair's two places among them."""
    names, codes = np.unique(np.concatenate([rows["item_a"], rows["item_b"]]).astype(str), return_inverse=True)
    return names, codes[: len(rows)], codes[len(rows) :]


def permutation_test(pairs: DataFrame, implicated: DataFrame, n: int = 10_000, seed: int = SEED) -> DataFrame:
    """One row: is the signal rate among pairs of implicated items above chance?

    ``pairs`` is (item_a, item_b, signal). The graph and the signals stay; which items are
    implicated is drawn anew, their number kept. The statistic is the rate with both over
    the rate with neither; p counts the observed value among the replicates.
    """
    listed = set(_arrays(implicated.select("ingredient").distinct(), ["ingredient"])["ingredient"])

    def enrichment(flags: np.ndarray, left: np.ndarray, right: np.ndarray, signal: np.ndarray) -> float:
        both, neither = flags[left] & flags[right], ~flags[left] & ~flags[right]
        if not both.any() or not neither.any() or not signal[neither].any():
            return float("nan")
        return float(signal[both].mean() / signal[neither].mean())

    def one(rows: pd.DataFrame, rng: np.random.Generator) -> float:
        names, left, right = _coded(rows)
        flags = np.zeros(len(names), bool)
        flags[rng.choice(len(names), size=sum(x in listed for x in names), replace=False)] = True
        return enrichment(flags, left, right, rows["signal"].to_numpy(bool))

    rows = _arrays(pairs, ["item_a", "item_b", "signal"])
    names, left, right = _coded(rows)
    flags = np.array([x in listed for x in names], bool)
    observed = enrichment(flags, left, right, rows["signal"].to_numpy(bool))
    null = replicated(pairs, ["item_a", "item_b", "signal"], n, one, seed).filter("value is not null and not isnan(value)")
    return null.agg(
        F.lit(observed).alias("observed"),
        F.percentile("value", F.lit(0.5)).alias("null_median"),
        F.percentile("value", F.lit(0.95)).alias("null_p95"),
        ((1 + F.count_if(F.col("value") >= observed)) / (1 + F.count(F.lit(1)))).alias("p_value"),
        F.count(F.lit(1)).alias("n_permutations"),
        F.lit(int(flags.sum())).alias("n_implicated"),
        F.lit(len(names)).alias("n_items"),
    )


def _kept(rows: pd.DataFrame, rng: np.random.Generator) -> np.ndarray:
    """The pairs whose two items were both drawn, whatever their multiplicity."""
    names, left, right = _coded(rows)
    drawn = np.zeros(len(names), bool)
    drawn[rng.integers(0, len(names), size=len(names))] = True
    return drawn[left] & drawn[right]


def mh_ratio(signal: np.ndarray, exposed: np.ndarray, by: np.ndarray, strata: int = 10, least: int = 20) -> float | None:
    """The ratio of ``mantel_haenszel`` for arrays."""
    if not len(by):
        return None
    edges = np.quantile(by, np.linspace(0, 1, strata + 1))
    place = np.clip(np.searchsorted(edges, by, side="right") - 1, 0, strata - 1)
    count = lambda mask: np.bincount(place[mask], minlength=strata).astype(float)
    n, e, se, su = count(np.ones(len(by), bool)), count(exposed), count(exposed & signal), count(~exposed & signal)
    u = n - e
    ok = (n >= least) & (e > 0) & (u > 0)
    low = (su[ok] * e[ok] / n[ok]).sum()
    return float((se[ok] * u[ok] / n[ok]).sum() / low) if low else None


def _interval(values: DataFrame, least: int = 100, level: float = 0.95) -> DataFrame:
    tail = (1 - level) / 2
    finite = values.filter("value is not null and not isnan(value)")
    got = finite.agg(
        F.count(F.lit(1)).alias("n_effective"), F.percentile("value", F.lit(tail)).alias("_low"), F.percentile("value", F.lit(1 - tail)).alias("_high")
    )
    enough = F.col("n_effective") >= least
    return got.select("n_effective", F.when(enough, F.col("_low")).alias("ci_low"), F.when(enough, F.col("_high")).alias("ci_high"))


def mh_bootstrap(pairs: DataFrame, n: int = 2_000, seed: int = SEED) -> DataFrame:
    """One row (n_effective, ci_low, ci_high): the stratified ratio's interval, items resampled.

    ``pairs`` is (item_a, item_b, signal, documented, n_ab). A replicate needs 100 pairs
    and 5 documented ones.
    """

    def one(rows: pd.DataFrame, rng: np.random.Generator) -> float | None:
        keep = _kept(rows, rng)
        documented = rows["documented"].to_numpy(bool)[keep]
        if keep.sum() < 100 or documented.sum() < 5:
            return None
        return mh_ratio(rows["signal"].to_numpy(bool)[keep], documented, rows["n_ab"].to_numpy(float)[keep])

    return _interval(replicated(pairs, ["item_a", "item_b", "signal", "documented", "n_ab"], n, one, seed))


def pair_cluster_interval(pairs: DataFrame, n: int = 2_000, least: int = 50, seed: int = SEED) -> DataFrame:
    """One row: the interval of the share of signals over (item_a, item_b, signal), items resampled."""

    def one(rows: pd.DataFrame, rng: np.random.Generator) -> float | None:
        keep = _kept(rows, rng)
        return float(rows["signal"].to_numpy(bool)[keep].mean()) if keep.sum() >= least else None

    return _interval(replicated(pairs, ["item_a", "item_b", "signal"], n, one, seed))


def cluster_interval(trials: DataFrame, n: int = 2_000, seed: int = SEED) -> DataFrame:
    """One row: the interval of a proportion over (cluster, success), clusters resampled with multiplicity.

    A cluster enters as its counts, so the trials never leave the executors.
    """
    sums = trials.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.count_if("success").alias("k"))

    def one(rows: pd.DataFrame, rng: np.random.Generator) -> float | None:
        if rows.empty:
            return None
        pick = rng.integers(0, len(rows), size=len(rows))
        return float(rows["k"].to_numpy()[pick].sum() / rows["n"].to_numpy()[pick].sum())

    return _interval(replicated(sums, ["cluster", "n", "k"], n, one, seed))


def heldout_calibration(pool: DataFrame, score: str, target: float = 0.05, n: int = 500, seed: int = SEED) -> DataFrame:
    """One row (n_splits, mean_rate, low, high): thresholds set on a random half, measured on the other."""

    def one(rows: pd.DataFrame, rng: np.random.Generator) -> float | None:
        values = rows[score].to_numpy(float)
        if len(values) < 2:
            return None
        order = rng.permutation(len(values))
        fit, test = values[order[: len(values) // 2]], values[order[len(values) // 2 :]]
        return float((test > np.quantile(fit, 1 - target)).mean())

    rates = replicated(pool.filter(F.col(score).isNotNull()), [score], n, one, seed).filter("value is not null")
    return rates.agg(
        F.count(F.lit(1)).alias("n_splits"), F.avg("value").alias("mean_rate"), F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high")
    )


def induced_correlation(pairs: DataFrame, expected: str, n: int = 10_000, alpha: float = 0.5, seed: int = SEED) -> DataFrame:
    """One row (median, low, high): the correlation of log ratio and strength that the model alone induces.

    ``pairs`` has n_ab, strength and the expectation; the triple count is drawn from it.
    """

    def one(rows: pd.DataFrame, rng: np.random.Generator) -> float | None:
        e, ab, x = (rows[c].to_numpy(float) for c in (expected, "n_ab", "strength"))
        draw = rng.binomial(ab.astype(int), np.clip(e / ab, 1e-12, 1.0))
        y = np.log2((draw + alpha) / (e + alpha))
        xc, yc = x - x.mean(), y - y.mean()
        scale = math.sqrt((xc**2).sum() * (yc**2).sum())
        return float((xc * yc).sum() / scale) if scale else None

    usable = pairs.filter(f"n_ab > 0 and {expected} > 0 and strength is not null")
    values = replicated(usable, [expected, "n_ab", "strength"], n, one, seed).filter("value is not null")
    return values.agg(F.percentile("value", F.lit(0.5)).alias("median"), F.percentile("value", F.lit(0.025)).alias("low"), F.percentile("value", F.lit(0.975)).alias("high"))
