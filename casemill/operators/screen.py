"""Ranked screening: support bands, negative pools, calibration, regimes.

The pair frames carry item_a, item_b, the eight counts and scores. ``score`` names the
column a rule looks at, so that point scores and bounds go through the same code. The
control and implicated lists are data frames; they are joined, never collected.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BANDS = ["positive_control", "known_pair", "plausible", "unsupported"]


def sorted_pairs(pairs: DataFrame, a: str = "item_a", b: str = "item_b") -> DataFrame:
    """Distinct (item_a, item_b) with the names normalised and in order."""
    x, y = F.upper(F.trim(a)), F.upper(F.trim(b))
    return pairs.select(F.least(x, y).alias("item_a"), F.greatest(x, y).alias("item_b")).distinct()


def _flag(pairs: DataFrame, listed: DataFrame, on: list[str], name: str) -> DataFrame:
    marked = listed.select(*on).distinct().withColumn(name, F.lit(True))
    return pairs.join(marked, on, "left").withColumn(name, F.coalesce(name, F.lit(False)))


def annotated(pairs: DataFrame, controls: DataFrame, implicated: DataFrame) -> DataFrame:
    """``pairs`` with n_implicated and support, the band of prior support."""
    names = implicated.select("ingredient").distinct()
    got = _flag(pairs, sorted_pairs(controls), ["item_a", "item_b"], "is_control")
    got = _flag(got, names.withColumnRenamed("ingredient", "item_a"), ["item_a"], "implicated_a")
    got = _flag(got, names.withColumnRenamed("ingredient", "item_b"), ["item_b"], "implicated_b")
    n = F.col("implicated_a").cast("int") + F.col("implicated_b").cast("int")
    band = F.when(F.col("is_control"), BANDS[0]).when(n == 2, BANDS[1]).when(n == 1, BANDS[2]).otherwise(BANDS[3])
    return got.withColumn("n_implicated", n).withColumn("support", band).drop("implicated_a", "implicated_b")


def ranked(pairs: DataFrame, score: str = "omega_add_lower") -> DataFrame:
    """``pairs`` in falling order of the score, ties by name."""
    return pairs.orderBy(F.desc_nulls_last(score), "item_a", "item_b")


def band_rates(pairs: DataFrame, threshold: Column | float, score: str = "omega_add_lower", keep: Sequence[str] = ()) -> DataFrame:
    """(keep..., support, tested, signalled, rate, enrichment): the rate of each band against the unsupported one of the same rows."""
    by = pairs.groupBy(*keep, "support").agg(F.count(F.lit(1)).alias("tested"), F.count_if(F.col(score) > threshold).alias("signalled"))
    by = by.withColumn("rate", F.col("signalled") / F.col("tested"))
    base = by.groupBy(*keep).agg(F.max(F.when(F.col("support") == "unsupported", F.col("rate"))).alias("base"))
    met = by.join(base, list(keep)) if keep else by.join(F.broadcast(base))  # a single row
    return met.select(
        *keep, "support", "tested", "signalled", F.round("rate", 6).alias("rate"), F.round(F.when(F.col("base") > 0, F.col("rate") / F.col("base")), 6).alias("enrichment")
    )


def top_by_rate(pairs: DataFrame, least: int, k: int) -> DataFrame:
    """The ``k`` pairs of at least ``least`` co-reports with the highest event rate, ties by name."""
    rated = pairs.filter(F.col("n_ab") >= least).withColumn("rate", F.col("n_abz") / F.col("n_ab"))
    return rated.orderBy(F.desc("rate"), "item_a", "item_b").limit(k)


def ordered_union(lists: Sequence[DataFrame]) -> DataFrame:
    """(item_a, item_b, position) of short lists one after the other, each pair at its first place.

    A list keeps its order, so give it sorted; the positions are numbered in one task.
    """
    placed = [df.select("item_a", "item_b", F.lit(i).alias("_list"), F.monotonically_increasing_id().alias("_at")) for i, df in enumerate(lists)]
    firsts = reduce(DataFrame.unionByName, placed).groupBy("item_a", "item_b").agg(F.min(F.struct("_list", "_at")).alias("_first"))
    return firsts.select("item_a", "item_b", F.row_number().over(Window.orderBy("_first", "item_a", "item_b")).alias("position"))


def bounds_by_stratum(per_stratum: DataFrame, stratum: str, names: Sequence[str], score: str = "omega_add_lower") -> DataFrame:
    """(item_a, item_b, om025_<stratum>..., eras_with_signal, eras_signalled): a bound per stratum and the strata where it is above 0."""
    wide = per_stratum.groupBy("item_a", "item_b").agg(*(F.max(F.when(F.col(stratum) == n, F.col(score))).alias(f"om025_{n}") for n in names))
    up = F.filter(F.array(*(F.when(F.col(f"om025_{n}") > 0, F.lit(n)) for n in names)), lambda x: x.isNotNull())
    return wide.withColumn("eras_with_signal", F.size(up)).withColumn("eras_signalled", F.array_join(up, ";"))


def control_results(controls: DataFrame, scored: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each control pair with its scores; a pair never counted has n_ab and n_abz 0 and no signal."""
    got = sorted_pairs(controls).join(scored.select("item_a", "item_b", "n_ab", "n_abz", *columns), ["item_a", "item_b"], "left")
    return got.fillna(0, ["n_ab", "n_abz"]).withColumns({f"signal_{c}": F.coalesce(F.col(c) > 0, F.lit(False)) for c in columns})


def negative_pool(scored: DataFrame, controls: DataFrame, implicated: DataFrame, tolerance: float = 0.5, hard_rr: float = 2.0) -> DataFrame:
    """Pairs that are no control and not both implicated, about as frequent as some control.

    The control counts, as few as the controls, form one sorted array on a single row;
    a pair stays if one of them is within ``tolerance`` on the log scale. stratum is
    hard if an item has at least ``hard_rr`` times the background rate.
    """
    marked = annotated(scored, controls, implicated)
    targets = marked.filter("is_control and n_ab > 0").agg(F.array_sort(F.collect_set(F.log10("n_ab"))).alias("targets"))
    near = F.exists("targets", lambda t: F.abs(t - F.log10("n_ab")) <= tolerance)
    rest = marked.filter("not is_control and n_implicated < 2 and n_ab > 0").join(F.broadcast(targets)).filter(near)  # a single row
    top = F.greatest(F.coalesce("rr_a", F.lit(0.0)), F.coalesce("rr_b", F.lit(0.0)))
    return rest.withColumn("stratum", F.when(top >= hard_rr, "hard").otherwise("easy")).drop("targets")


#: Parts of a stratum that are ranked apart before the stratum is.
SALTS = 64


def sampled(pool: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """At most ``n`` pairs of each stratum by the order of a keyed hash: the same pairs in every run.

    The first ``n`` of each of ``SALTS`` parts are taken first, so that a stratum is never sorted as a whole.
    """
    order = [F.md5(F.concat_ws("|", F.lit(seed), "item_a", "item_b")), F.col("item_a"), F.col("item_b")]
    salted = pool.withColumn("_salt", F.pmod(F.xxhash64("item_b", "item_a"), F.lit(SALTS)))
    for by in (["stratum", "_salt"], ["stratum"]):
        salted = salted.withColumn("_rn", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_rn") <= n).drop("_rn")
    return salted.drop("_salt")


def false_positive_rates(pool: DataFrame, threshold: float = 0.0, add: str = "omega_add_lower", mult: str = "omega_lower") -> DataFrame:
    """(stratum, n_pairs, fpr_additive, fpr_multiplicative, median, p95, median_n_ab) by stratum and for all."""
    both = pool.withColumn("stratum", F.explode(F.array(F.col("stratum"), F.lit("all"))))
    return both.groupBy("stratum").agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.round(F.avg((F.col(add) > threshold).cast("double")), 6).alias("fpr_additive"),
        F.round(F.avg((F.col(mult) > threshold).cast("double")), 6).alias("fpr_multiplicative"),
        F.round(F.percentile(add, F.lit(0.5)), 6).alias("median_additive"),
        F.round(F.percentile(add, F.lit(0.95)), 6).alias("p95_additive"),
        F.percentile("n_ab", F.lit(0.5)).alias("median_n_ab"),
    )


def calibrated(pool: DataFrame, target: float = 0.05, score: str = "omega_add_lower") -> DataFrame:
    """One row: the threshold that this share of the pool passes."""
    return pool.agg(F.percentile(score, F.lit(1 - target)).alias("threshold"))


def quintiles(pool: DataFrame, add: str, mult: str, by: str = "strength", n: int = 5) -> DataFrame:
    """(bin, low, high, n, rate_additive, rate_multiplicative) over quantile bins of ``by``.

    Both edges of a bin belong to it, so a value on an inner edge counts in two bins.
    """
    shares = [i / n for i in range(n + 1)]
    usable = pool.filter(F.col(by).isNotNull())
    edges = usable.agg(F.percentile(by, F.array(*map(F.lit, shares))).alias("edges"))
    bins = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.col(by) >= F.get("edges", i)) & (F.col(by) <= F.get("edges", i + 1)))
    rows = usable.join(F.broadcast(edges)).withColumn("i", F.explode(bins))  # a single row
    return rows.groupBy((F.col("i") + 1).alias("bin")).agg(
        F.round(F.min(F.get("edges", F.col("i"))), 6).alias("low"),
        F.round(F.min(F.get("edges", F.col("i") + 1)), 6).alias("high"),
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg((F.col(add) > 0).cast("double")), 6).alias("rate_additive"),
        F.round(F.avg((F.col(mult) > 0).cast("double")), 6).alias("rate_multiplicative"),
    )


def in_regime(pool: DataFrame, controls: DataFrame, by: str = "strength") -> DataFrame:
    """The pairs of the pool at least as strong as the weakest control."""
    cut = controls.agg(F.min(by).alias("_cut"))
    return pool.join(F.broadcast(cut)).filter(F.col(by) >= F.col("_cut")).drop("_cut")  # a single row


def operating_characteristic(controls: DataFrame, pool: DataFrame, targets: Sequence[float], scores: dict[str, str]) -> DataFrame:
    """(target_fpr, and per score threshold_, realised_, recovered_) over a sweep of target rates."""
    ask = F.array(*(F.lit(1 - t) for t in targets))
    cuts = pool.agg(*(F.percentile(c, ask).alias(f"_{k}") for k, c in scores.items()))
    listed = cuts.select(F.posexplode(F.array(*map(F.lit, targets))).alias("_i", "target_fpr"), *(f"_{k}" for k in scores))
    listed = listed.select("target_fpr", *(F.get(f"_{k}", F.col("_i")).alias(f"threshold_{k}") for k in scores))

    def passed(df: DataFrame, name: str, how) -> DataFrame:
        rows = df.join(F.broadcast(listed))  # as many rows as targets
        return rows.groupBy("target_fpr").agg(*(how(F.col(c) > F.col(f"threshold_{k}")).alias(f"{name}_{k}") for k, c in scores.items()))

    realised = passed(pool, "realised", lambda p: F.round(F.avg(p.cast("double")), 6))
    recovered = passed(controls, "recovered", F.count_if)
    out = listed.join(realised, "target_fpr").join(recovered, "target_fpr")
    return out.withColumns({f"threshold_{k}": F.round(f"threshold_{k}", 6) for k in scores})


def strength_matched(screen: DataFrame, pool: DataFrame, threshold: float, score: str, by: str = "strength", n: int = 5) -> DataFrame:
    """(support, tested, observed, expected_pooled, expected_matched): what chance alone gives each band.

    The rate of the pool's quantile bin a pair falls into is summed over the band; pairs
    outside the pool's range take the first or last bin.
    """
    shares = [i / n for i in range(n + 1)]
    usable = pool.filter(F.col(by).isNotNull())
    edges = usable.agg(
        F.percentile(by, F.array(*map(F.lit, shares))).alias("edges"), F.avg((F.col(score) > threshold).cast("double")).alias("pooled")
    )
    bins = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.col(by) >= F.get("edges", i)) & (F.col(by) <= F.get("edges", i + 1)))
    rates = (
        usable.join(F.broadcast(edges)).withColumn("i", F.explode(bins)).groupBy("i").agg(F.avg((F.col(score) > threshold).cast("double")).alias("rate"))
    )
    below = F.size(F.filter("edges", lambda e: e <= F.col(by))) - 1
    placed = screen.filter(F.col(by).isNotNull()).join(F.broadcast(edges))
    placed = placed.withColumn("i", F.least(F.greatest(below, F.lit(0)), F.lit(n - 1))).join(F.broadcast(rates), "i", "left")  # n rows
    return placed.groupBy("support").agg(
        F.count(F.lit(1)).alias("tested"),
        F.count_if(F.col(score) > threshold).alias("observed"),
        F.round(F.sum("pooled"), 6).alias("expected_pooled"),
        F.round(F.sum(F.coalesce("rate", "pooled")), 6).alias("expected_matched"),
    )


def strata_signals(per_stratum: DataFrame, threshold: float, score: str, stratum: str = "era_bin") -> DataFrame:
    """(item_a, item_b, n_strata, strata_with_signal): in how many strata a pair passes."""
    return per_stratum.groupBy("item_a", "item_b").agg(
        F.count(F.lit(1)).alias("n_strata"), F.count_if(F.col(score) > threshold).alias("strata_with_signal")
    )


def stability(screen: DataFrame, strata: DataFrame, negatives: DataFrame, threshold: float, score: str, n_strata: int) -> DataFrame:
    """One row: how many screened and negative pairs pass, and pass in every stratum."""
    keyed = _flag(screen.join(strata, ["item_a", "item_b"], "left").fillna(0, ["strata_with_signal"]), negatives, ["item_a", "item_b"], "is_negative")
    up = F.col(score) > threshold
    stable = up & (F.col("strata_with_signal") == n_strata)
    return keyed.agg(
        F.count_if("is_negative").alias("negatives"),
        F.count_if(F.col("is_negative") & up).alias("negatives_passing"),
        F.count_if(F.col("is_negative") & stable).alias("negatives_stable"),
        F.count_if(up).alias("signalled"),
        F.count_if(stable).alias("stable"),
    )


def documented_enrichment(pairs: DataFrame, documented: DataFrame, threshold: float, score: str, drop_items: DataFrame | None = None) -> DataFrame:
    """One row: tested and signalled pairs inside and outside a reference, and the ratio of their rates.

    Pairs with an item of ``drop_items`` are left out first.
    """
    if drop_items is not None:
        for side in ("item_a", "item_b"):
            pairs = pairs.join(drop_items.select(F.col("ingredient").alias(side)).distinct(), side, "left_anti")
    keyed = _flag(pairs, documented, ["item_a", "item_b"], "documented")
    up, doc = F.col(score) > threshold, F.col("documented")
    sums = keyed.agg(
        F.count_if(doc).alias("documented_tested"),
        F.count_if(doc & up).alias("documented_signalled"),
        F.count_if(~doc).alias("undocumented_tested"),
        F.count_if(~doc & up).alias("undocumented_signalled"),
    )
    ratio = F.try_divide(
        F.try_divide(F.col("documented_signalled"), F.col("documented_tested")), F.try_divide(F.col("undocumented_signalled"), F.col("undocumented_tested"))
    )
    return sums.withColumn("enrichment", F.round(ratio, 6))


def reference_coverage(pairs: DataFrame, having: DataFrame, documented: DataFrame, threshold: float, score: str, drop_items: DataFrame) -> DataFrame:
    """One row: screened items and pairs without a text, and ``documented_enrichment`` of the pairs of which both items have one.

    A pair of which one item has no text can never be documented, so it says nothing of
    the reference; ``having`` are the items with a text.
    """
    items = pairs.select(F.explode(F.array("item_a", "item_b")).alias("ingredient")).distinct()
    known = having.select("ingredient").distinct()
    counts = items.agg(F.count(F.lit(1)).alias("screened_items")).join(F.broadcast(items.join(known, "ingredient", "left_anti").agg(F.count(F.lit(1)).alias("items_without_text"))))
    marked = pairs
    for side in "ab":
        marked = _flag(marked, known.withColumnRenamed("ingredient", f"item_{side}"), [f"item_{side}"], f"_text_{side}")
    whole = marked.agg(F.count(F.lit(1)).alias("pairs_total"), F.count_if(~(F.col("_text_a") & F.col("_text_b"))).alias("pairs_without_text"))
    whole = whole.withColumn("share_without_text", F.round(F.try_divide(F.col("pairs_without_text"), F.col("pairs_total")), 6))
    covered = documented_enrichment(marked.filter("_text_a and _text_b"), documented, threshold, score, drop_items)
    return counts.join(F.broadcast(whole)).join(F.broadcast(covered))  # single rows


def nesting(pairs: DataFrame, mult: str, add: str) -> DataFrame:
    """One row: when the signal set of the multiplicative null lies inside that of the additive one."""
    up = (F.col("rr_a") > 1) & (F.col("rr_b") > 1)
    violates = (F.col(mult) > 0) & ~F.coalesce(F.col(add) > 0, F.lit(False))
    ordered = F.col("expected") >= F.col("additive_expected")
    usable = pairs.filter(f"{mult} is not null and {add} is not null")
    return usable.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.count_if(up).alias("n_both_elevated"),
        F.count_if(violates).alias("violations_all"),
        F.count_if(violates & up).alias("violations_both_elevated"),
        F.count_if(ordered).alias("n_ordered"),
        F.count_if(violates & ordered).alias("violations_ordered"),
    )


def third_item_share(pairs: DataFrame, rows: DataFrame, implicated: DataFrame) -> DataFrame:
    """(item_a, item_b, event_cases, with_third, share, background_share) for a list of pairs.

    The event cases of a pair come from one join of its two items, for all pairs at once;
    a case's count of implicated items less the pair's own says whether it holds a third.
    """
    names = implicated.select("ingredient").distinct().withColumn("imp", F.lit(1))
    events = rows.filter("event").select("case_id", "ingredient").join(names, "ingredient", "left")
    per_case = events.groupBy("case_id").agg(F.count("imp").alias("n_imp"))
    listed = pairs.select("item_a", "item_b").distinct()
    a = events.select("case_id", F.col("ingredient").alias("item_a"), F.coalesce("imp", F.lit(0)).alias("ia"))
    b = events.select("case_id", F.col("ingredient").alias("item_b"), F.coalesce("imp", F.lit(0)).alias("ib"))
    hit = listed.join(a, "item_a").join(b, ["case_id", "item_b"]).join(per_case, "case_id")
    third = F.col("n_imp") - F.col("ia") - F.col("ib") > 0
    sums = hit.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("event_cases"), F.count_if(third).alias("with_third"))
    background = per_case.agg(F.avg((F.col("n_imp") > 0).cast("double")).alias("b"))
    got = listed.join(sums, ["item_a", "item_b"], "left").fillna(0, ["event_cases", "with_third"]).join(F.broadcast(background))  # a single row
    return got.select(
        "item_a", "item_b", "event_cases", "with_third",
        F.round(F.try_divide(F.col("with_third"), F.col("event_cases")), 6).alias("share"), F.round("b", 6).alias("background_share"),
    )


def triage(pairs: DataFrame, rows: DataFrame, marked: DataFrame, labels: DataFrame, k: int = 3) -> DataFrame:
    """(item_a, item_b, event_cases, marked_fraction, top_labels) for a list of pairs, in one pass.

    ``marked`` are case ids with some marker, ``labels`` are (case_id, label); the ``k``
    most frequent labels of a pair's event cases are joined to one text.
    """
    listed = pairs.select("item_a", "item_b").distinct()
    events = rows.filter("event").select("case_id", "ingredient")
    hit = (
        listed.join(events.withColumnRenamed("ingredient", "item_a"), "item_a")
        .join(events.withColumnRenamed("ingredient", "item_b"), ["case_id", "item_b"])
        .join(marked.select("case_id").distinct().withColumn("mark", F.lit(1)), "case_id", "left")
    )
    sums = hit.groupBy("item_a", "item_b").agg(F.count(F.lit(1)).alias("event_cases"), F.avg(F.col("mark").isNotNull().cast("double")).alias("marked_fraction"))
    counted = hit.join(labels.select("case_id", "label").distinct(), "case_id").groupBy("item_a", "item_b", "label").count()
    order = Window.partitionBy("item_a", "item_b").orderBy(F.desc("count"), "label")
    top = counted.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= k)
    text = F.concat(F.col("label"), F.lit("("), F.col("count").cast("string"), F.lit(")"))
    lists = top.groupBy("item_a", "item_b").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rn", text.alias("t")))), lambda x: x["t"]), ";").alias("top_labels"))
    return listed.join(sums, ["item_a", "item_b"], "left").join(lists, ["item_a", "item_b"], "left").fillna(0, ["event_cases"])


def without_invalid(pairs: DataFrame, non_specific: DataFrame, same_moiety: DataFrame) -> DataFrame:
    """The pairs that could be interactions: no non-specific item, not two names of one moiety.

    ``same_moiety`` is (ingredient, moiety).
    """
    for side in ("item_a", "item_b"):
        pairs = pairs.join(non_specific.select(F.col("ingredient").alias(side)).distinct(), side, "left_anti")
        pairs = pairs.join(same_moiety.select(F.col("ingredient").alias(side), F.col("moiety").alias(f"_m_{side}")), side, "left")
    same = F.coalesce(F.col("_m_item_a") == F.col("_m_item_b"), F.lit(False))
    return pairs.filter(~same).drop("_m_item_a", "_m_item_b")


def fuzzy_duplicates(cases: DataFrame, rows: DataFrame, least: float = 0.8) -> DataFrame:
    """One row: further near-duplicates among event cases by the Jaccard index of their items.

    Cases are blocked on event date, age, sex and country. Within a block identical item
    sets are first put together, so a block of copies is one member. Sets that reach the
    index share an item among their rarest ``n - ceil(least n) + 1``; only those items are
    joined, and a pair is kept at its first shared one, so no link is lost and none is
    met twice. (cases, exact_pairs, fuzzy_pairs, fuzzy_cases)
    """
    block = ["event_dt", "age_years", "sex", "country"]
    events = rows.filter("event").select("case_id", "ingredient").distinct()
    weights = events.groupBy("ingredient").agg(F.count(F.lit(1)).alias("w"))
    lists = events.join(weights, "ingredient").groupBy("case_id").agg(F.array_sort(F.collect_list(F.struct("w", "ingredient"))).alias("items"))
    keyed = cases.filter("event_dt <> '' and age_years is not null").select("case_id", *block).join(lists, "case_id")
    sets = keyed.groupBy(*block, "items").agg(F.count(F.lit(1)).alias("n"), F.min("case_id").alias("first"))
    size = F.size("items")
    heads = sets.withColumn("head", F.slice("items", F.lit(1), size - F.ceil(F.lit(least) * size).cast("int") + 1))
    flat = heads.select(*block, "items", "n", "first", "head", F.explode("head").alias("key"))
    a = flat.select(*block, "key", *(F.col(c).alias(f"{c}_a") for c in ("items", "n", "first", "head")))
    b = flat.select(*block, "key", *(F.col(c).alias(f"{c}_b") for c in ("items", "n", "first", "head")))
    both = F.size(F.array_intersect("items_a", "items_b"))
    met = (
        a.join(b, [*block, "key"])
        .filter("items_a < items_b")
        .filter(F.col("key") == F.array_min(F.array_intersect("head_a", "head_b")))
        .filter(both / (F.size("items_a") + F.size("items_b") - both) >= least)
    )
    # A case is removable if a case of a set like its own has a smaller id.
    ways = [met.select(*block, F.col(f"items_{x}").alias("items"), F.col(f"first_{y}").alias("other")) for x, y in ("ab", "ba")]
    lowest = ways[0].unionByName(ways[1]).groupBy(*block, "items").agg(F.min("other").alias("other"))
    later = keyed.join(lowest, [*block, "items"]).filter("case_id > other")
    parts = (
        sets.agg(
            F.coalesce(F.sum("n"), F.lit(0)).alias("cases"),
            F.coalesce(F.sum(F.col("n") * (F.col("n") - 1) / 2), F.lit(0)).cast("bigint").alias("exact_pairs"),
        ),
        met.agg(F.coalesce(F.sum(F.col("n_a") * F.col("n_b")), F.lit(0)).alias("fuzzy_pairs")),
        later.agg(F.count(F.lit(1)).alias("fuzzy_cases")),
    )
    return parts[0].join(F.broadcast(parts[1])).join(F.broadcast(parts[2]))  # single rows
