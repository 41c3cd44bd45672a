"""Sources mixed to target weights of tokens, small ones repeated up to a cap.

The total is the largest at which every source can give its share within its repeats.
A source's budget is used up by whole rounds over the source, then by a cut: records get
hash-random keys, the keys are ranges of equal width (a range sort by construction), the
ranges' sums are summed up over each source in a window, and only the one range in which
the budget ends is ordered record by record. No source is ever sorted as a whole, and
neither sums nor targets go through the driver.

Defined results: records of sources without target, and targets without records, are
left out; the shares of the targets that have tokens are scaled to 1, and the report
lists the others with 0. A target named twice counts once, with its largest share and
cap. Records without tokens cost nothing. A tie of keys is broken by the record's id.
A record is taken while half of it fits the rest of the budget, so a source's tokens
miss its budget by half a record at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from casemill.session import cut

#: A source is 2**BITS ranges: a range of 10**10 records has some 150,000.
BITS = 16


def _wanted(targets: DataFrame) -> DataFrame:
    """(source, share, cap) of the targets, each source once."""
    named = targets.filter("source is not null and target_share is not null")
    return named.groupBy("source").agg(F.max("target_share").cast("double").alias("share"), F.max("max_repeats").cast("bigint").alias("cap"))


def budgets(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, rounds, rest): whole rounds and rest of each source that has tokens, a positive share and a cap.

    ``sizes`` is (source, size), the tokens of each source.
    """
    usable = _wanted(targets).join(sizes, "source").filter("size > 0 and share > 0 and cap > 0")
    whole = usable.agg(F.sum("share").alias("whole"))
    scaled = usable.join(F.broadcast(whole)).withColumn("part", F.col("share") / F.col("whole"))  # a single row
    total = scaled.agg(F.min(F.col("cap") * F.col("size") / F.col("part")).alias("total"))
    # The small number keeps a budget that is whole from falling below itself in the product.
    budget = F.least(F.floor(F.col("total") * F.col("part") + 1e-6), F.col("cap") * F.col("size"))
    split = scaled.join(F.broadcast(total)).withColumn("budget", budget)  # a single row
    return split.select("source", F.floor(F.col("budget") / F.col("size")).cast("int").alias("rounds"), (F.col("budget") % F.col("size")).alias("rest"))


def selection(sized: DataFrame, targets: DataFrame, key: str = "doc_id", seed: int = 17) -> DataFrame:
    """(key, source, n_tokens, times) of the records taken; ``sized`` has key, source, n_tokens and is read three times."""
    keyed = sized.select(
        key, "source", F.coalesce("n_tokens", F.lit(0)).cast("bigint").alias("n_tokens"), F.xxhash64(F.lit(seed), F.col(key)).alias("_key")
    ).withColumn("_range", F.shiftrightunsigned("_key", 64 - BITS).cast("int"))
    sums = keyed.groupBy("source", "_range").agg(F.sum("n_tokens").alias("n"))
    sizes = sums.groupBy("source").agg(F.sum("n").alias("size"))
    order = Window.partitionBy("source").orderBy("_range").rowsBetween(Window.unboundedPreceding, 0)
    ends = sums.join(budgets(sizes, targets), "source").withColumn("_sum", F.sum("n").over(order)).filter("_sum > rest")
    # The first range in which the running sum passes the rest; nothing is cut where no rest is.
    cuts = ends.groupBy("source").agg(F.first("rounds").alias("_rounds"), F.first("rest").alias("_rest"), F.min(F.struct("_range", (F.col("rest") - F.col("_sum") + F.col("n")).alias("left"))).alias("c"))
    # A row per target, written so that sums and budgets are made once.
    cuts = cut(cuts.select("source", "_rounds", F.when(F.col("_rest") > 0, F.col("c._range")).otherwise(F.lit(-1)).alias("_cut"), F.col("c.left").alias("_left")), "cuts")
    placed = keyed.join(cuts, "source")
    inside = placed.filter("_range <> _cut").withColumn("times", F.col("_rounds") + (F.col("_range") < F.col("_cut")).cast("int"))
    within = Window.partitionBy("source").orderBy(F.expr("_key"), key).rowsBetween(Window.unboundedPreceding, 0)
    edge = (
        placed.filter("_range = _cut")
        .withColumn("_sum", F.sum("n_tokens").over(within))
        .withColumn("times", F.col("_rounds") + (2 * F.col("_sum") - F.col("n_tokens") <= 2 * F.col("_left")).cast("int"))
        .drop("_sum")
    )
    return inside.unionByName(edge).filter("times > 0").select(key, "source", "n_tokens", "times")


def shares(taken: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, tokens, n_docs, max_times) of every target."""
    sums = taken.groupBy("source").agg(
        F.sum(F.col("n_tokens") * F.col("times")).alias("tokens"), F.count(F.lit(1)).alias("n_docs"), F.max("times").alias("max_times")
    )
    whole = sums.agg(F.sum("tokens").alias("all_tokens"))
    joined = targets.select("source", "target_share").join(sums, "source", "left").join(F.broadcast(whole))  # one row
    return joined.select(
        "source",
        "target_share",
        F.coalesce(F.try_divide(F.col("tokens"), F.col("all_tokens")), F.lit(0.0)).alias("reached_share"),
        F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"),
        F.coalesce("n_docs", F.lit(0)).cast("bigint").alias("n_docs"),
        F.coalesce("max_times", F.lit(0)).cast("int").alias("max_times"),
    )
