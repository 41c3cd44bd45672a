"""Items that appear together: stripes, merged by key, with a log-likelihood ratio.

Each case's distinct items are a basket. In each task every item gets a stripe, the
counts of the items after it in its baskets, already summed over the task. Stripes
are merged by item and shard of the neighbour in one pass over sorted partitions, which
holds one stripe at a time; an item that stands in a third of all cases is spread over
the shards. A basket over ``BLOCK`` items is never put in one row: its items are dealt
into chunks of about ``BLOCK``, and every two chunks of it meet in a row of their own. Items below the support cannot be in a pair that reaches it and are left
out first; that changes no result.

Defined results: NULL case ids and NULL or blank items are no rows; repeated rows count
once; a case with one item counts in n and n_a. Items are compared as normalised texts.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.functions.text import normalised
from casemill.session import cut

SHARDS = 16
BLOCK = 1024
AT_ONCE = 2_000_000
FLUSH = 4_000_000

_STRIPE = "item string, shard int, neighbours array<string>, counts array<bigint>"


class _Stripes:
    """Pair counts of a task, as sorted keys of two item numbers."""

    def __init__(self) -> None:
        self.number: dict[str, int] = {}
        self.keys, self.counts = np.zeros(0, "int64"), np.zeros(0, "int64")
        self.parts: list[np.ndarray] = []
        self.found = 0

    def coded(self, lists) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, codes, sizes): codes rise with the names, ``number`` turns them into the task's item numbers."""
        names, codes = np.unique(np.concatenate(list(lists)).astype(object), return_inverse=True)
        number = np.array([self.number.setdefault(n, len(self.number)) for n in names], dtype="int64")
        return number, codes, np.array([len(x) for x in lists])

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        self.parts.append((left << 32 | right).ravel())
        self.found += self.parts[-1].size
        if self.found > AT_ONCE:
            self.fold()

    def fold(self) -> None:
        if not self.parts:
            return
        keys, counts = np.unique(np.concatenate(self.parts), return_counts=True)
        both, place = np.unique(np.concatenate([self.keys, keys]), return_inverse=True)
        sums = np.zeros(len(both), "int64")
        np.add.at(sums, place, np.concatenate([self.counts, counts]))
        self.keys, self.counts, self.parts, self.found = both, sums, [], 0

    def take(self) -> Iterator[pd.DataFrame]:
        """The stripes by item and shard of the neighbour; the counts start anew."""
        self.fold()
        if not self.keys.size:
            return
        names = np.array(list(self.number), dtype=object)
        left, right = self.keys >> 32, self.keys & 0xFFFFFFFF
        shard = np.array([zlib.crc32(n.encode()) % SHARDS for n in names])[right]
        order = np.lexsort((shard, left))
        left, right, shard, counts = left[order], right[order], shard[order], self.counts[order]
        cuts = np.flatnonzero((np.diff(left) != 0) | (np.diff(shard) != 0)) + 1
        firsts = np.concatenate([[0], cuts])
        yield pd.DataFrame(
            {"item": names[left[firsts]], "shard": shard[firsts], "neighbours": [names[x] for x in np.split(right, cuts)], "counts": np.split(counts, cuts)}
        )
        self.__init__()


def _stripes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stripes of baskets (items): every item against those after it.

    Counts are summed over the batches of a task until ``FLUSH`` pairs are held.
    """
    held = _Stripes()
    for frame in frames:
        if frame.empty:
            continue
        number, codes, sizes = held.coded(frame["items"])
        starts = np.cumsum(sizes) - sizes
        for m in np.unique(sizes):
            # Baskets of one size are the rows of a matrix; each shift of it gives one pair of every row.
            picked, step = starts[sizes == m], max(1, AT_ONCE // int(m))
            for at in range(0, len(picked), step):
                rows = number[np.sort(codes[picked[at : at + step, None] + np.arange(m)], axis=1)]
                for shift in range(1, m):
                    held.add(rows[:, :-shift], rows[:, shift:])
        held.fold()
        if held.keys.size > FLUSH:
            yield from held.take()
    yield from held.take()


def _chunk_stripes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Stripes of two chunks (left, right) of one basket: all pairs between them, or within one that meets itself."""
    held = _Stripes()
    for frame in frames:
        for left, right, own in zip(frame["left"], frame["right"], frame["own"]):
            number, codes, sizes = held.coded([left, right])
            one, two = np.sort(codes[: sizes[0]]), np.sort(codes[sizes[0] :])
            for i, code in enumerate(one):
                other = one[i + 1 :] if own else two
                held.add(number[np.minimum(code, other)], number[np.maximum(code, other)])
            held.fold()
            if held.keys.size > FLUSH:
                yield from held.take()
    yield from held.take()


def _merged(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum of the stripes of each (item, shard); the rows come sorted by them."""
    key, sums = None, {}
    for frame in frames:
        done = []
        for item, shard, neighbours, counts in zip(frame["item"], frame["shard"], frame["neighbours"], frame["counts"]):
            if key != (item, shard):
                if key is not None:
                    done.append((*key, list(sums), list(sums.values())))
                key, sums = (item, shard), {}
            for name, n in zip(neighbours, counts.tolist()):
                sums[name] = sums.get(name, 0) + n
        yield pd.DataFrame(done, columns=["item", "shard", "neighbours", "counts"])
    if key is not None:
        yield pd.DataFrame([(*key, list(sums), list(sums.values()))], columns=["item", "shard", "neighbours", "counts"])


def stripes(rows: DataFrame, large: DataFrame | None = None) -> DataFrame:
    """(item, shard, neighbours, counts) of distinct rows (case_id, item).

    ``large`` is (case_id, chunks) of the cases over ``BLOCK`` items, None if there are none.
    """
    small = rows if large is None else rows.join(large, "case_id", "left_anti")
    baskets = small.groupBy("case_id").agg(F.collect_list("item").alias("items")).filter(F.size("items") > 1)
    made = baskets.select("items").mapInPandas(_stripes, _STRIPE)
    if large is not None:
        dealt = rows.join(large, "case_id").withColumn("chunk", F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int"))
        chunks = cut(dealt.groupBy("case_id", "chunks", "chunk").agg(F.collect_list("item").alias("items")), "chunks")
        # A chunk goes to each row it has a place in, so that no case is a key.
        left = chunks.select("case_id", F.col("items").alias("left"), F.col("chunk").alias("i"), F.explode(F.sequence("chunk", F.col("chunks") - 1)).alias("j"))
        right = chunks.select("case_id", F.col("items").alias("right"), F.col("chunk").alias("j"), F.explode(F.sequence(F.lit(0), "chunk")).alias("i"))
        met = left.join(right, ["case_id", "i", "j"]).select("left", "right", (F.col("i") == F.col("j")).alias("own"))
        made = made.unionByName(met.mapInPandas(_chunk_stripes, _STRIPE))
    return made.repartition("item", "shard").sortWithinPartitions("item", "shard").mapInPandas(_merged, _STRIPE)


def _entropy(*terms: Column) -> Column:
    """Sum of x ln x, 0 where x is 0."""
    total = F.lit(0.0)
    for x in terms:
        total = total + F.when(x > 0, x * F.log(x)).otherwise(0.0)
    return total


def log_likelihood(ab: Column, a: Column, b: Column, n: Column) -> Column:
    """G squared of the 2 x 2 table of two items; never below zero."""
    cells = [ab.cast("double"), (a - ab).cast("double"), (b - ab).cast("double"), (n - a - b + ab).cast("double")]
    rows, cols = [a.cast("double"), (n - a).cast("double")], [b.cast("double"), (n - b).cast("double")]
    return F.greatest(F.lit(0.0), 2 * (_entropy(*cells) - _entropy(*rows) - _entropy(*cols) + _entropy(n.cast("double"))))


def pairs(df: DataFrame, case: str = "case_id", item: str = "ingredient", support: int = 5) -> DataFrame:
    """(item_a, item_b, n_ab, n_a, n_b, n, lift, llr) of all pairs in at least ``support`` cases."""
    rows = cut(
        df.select(F.col(case).alias("case_id"), normalised(F.col(item)).alias("item"))
        .filter("case_id is not null and item <> ''")
        .distinct(),
        "case_items",
    )
    sizes = rows.groupBy("case_id").agg(F.count(F.lit(1)).alias("size"))
    n, n_large = sizes.agg(F.count(F.lit(1)), F.count_if(F.col("size") > BLOCK)).first()
    large = sizes.filter(F.col("size") > BLOCK).select("case_id", F.ceil(F.col("size") / BLOCK).cast("int").alias("chunks")) if n_large else None
    # Written, so that it is counted once and the planner knows its size.
    singles = cut(rows.groupBy("item").agg(F.count(F.lit(1)).alias("n_item")).filter(F.col("n_item") >= support), "singles")
    together = (
        stripes(rows.join(singles.select("item"), "item", "left_semi"), large)
        .select(F.col("item").alias("item_a"), F.explode(F.arrays_zip("neighbours", "counts")).alias("z"))
        .select("item_a", F.col("z.neighbours").alias("item_b"), F.col("z.counts").alias("n_ab"))
        .filter(F.col("n_ab") >= support)
    )
    a = singles.select(F.col("item").alias("item_a"), F.col("n_item").alias("n_a"))
    b = singles.select(F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    joined = together.join(a, "item_a").join(b, "item_b").withColumn("n", F.lit(n).cast("bigint"))
    lift = F.col("n_ab").cast("double") * F.col("n") / (F.col("n_a").cast("double") * F.col("n_b"))
    return joined.withColumn("lift", lift).withColumn(
        "llr", log_likelihood(F.col("n_ab"), F.col("n_a"), F.col("n_b"), F.col("n"))
    ).select("item_a", "item_b", "n_ab", "n_a", "n_b", "n", "lift", "llr")


def above_chance(found: DataFrame, times: int = 5) -> DataFrame:
    """The pairs that occur at least ``times`` as often as chance has it, compared in exact integers."""
    big = {c: F.col(c).cast("decimal(38,0)") for c in ("n_ab", "n", "n_a", "n_b")}
    return found.filter(big["n_ab"] * big["n"] >= F.lit(times) * big["n_a"] * big["n_b"])
