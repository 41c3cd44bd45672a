"""Freely written values mapped to the entries of a reference list, by a BK-tree.

Names are compared by their skeletons: accents and look-alike letters folded, digits
read as the letters they stand for, blanks and marks dropped. A value is freed of
strengths, forms, salts and brackets, its skeleton is searched in a BK-tree over the
reference entries, and the nearest entry within the threshold wins. Names cut short are
found in a second tree over the beginnings of the entries. Only distinct values are
searched; the answers are joined back to all rows.

How a value is taken apart depends on the whole reference and never on a shard; shards
only answer which entries are near one skeleton. A reference of at most ``SHARD``
entries is broadcast. A longer one is cut into shards that stay rows of a table: each
skeleton meets every shard, every entry within the threshold comes back with its
distance, the nearest over all shards wins, and only then values are given a meaning.
So the size of a shard changes no result.

Defined results: NULL and blank values are no rows; a value that equals an entry after
normalisation, or stands for several substances, is none either; a placeholder, an
unknown name, and a tie between different entries give -1. Of reference names with one
skeleton the first by name counts. A reference of over ``MAX_NAMES`` names is refused.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.functions.text import folded, letters, normalised, normalised_py
from casemill.llm.bktree import BKTree
from casemill.operators.lexicon import DOSE_UNITS, EXTRA_FORMS, FORMS, SALTS, UNITS, is_placeholder, is_salt
from casemill.operators.packed import Grammar, names_of
from casemill.session import cut, slots, spread

SHARD = 50_000
#: Skeletons that meet a shard in one task.
AT_ONCE = 20_000
SEVERAL = -2
NONE = -1
#: Distances of beginnings count from here on, so that whole names come first.
BEGUN = 10
NOTHING = (99, NONE)

_UNIT = "|".join(sorted((re.escape(u) for u in DOSE_UNITS), key=len, reverse=True))
_STRENGTH = re.compile(
    rf"(?<![\w])[0-9]+(?:[.,][0-9]+)?\s*(?:{_UNIT})?(?:\s*/\s*[0-9]*(?:[.,][0-9]+)?\s*(?:{_UNIT})?)?(?![\w])"
)
_NOISE = set(FORMS) - {"TOPICAL"} | set(UNITS) | set(EXTRA_FORMS)
_SALTS = set(SALTS)
_EMPTY_BRACKETS = re.compile(r"[(\[{]\s*[)\]}]")
_BRACKETED = re.compile(r"[(\[{]([^()\[\]{}]*)[)\]}]")
_WORD_EDGE = ".,;:?!*#\"'()[]{}"


def threshold(size: int) -> int:
    """Edits allowed for a skeleton of that many letters."""
    return 3 if size >= 9 else 2 if size >= 6 else 1 if size >= 4 else 0


def threshold_begun(size: int) -> int:
    """Edits allowed for a skeleton read as the beginning of an entry."""
    return 1 if size >= 9 else 0


def cleaned(text: str) -> str:
    """The normalised text without strengths, forms and units."""
    text = _EMPTY_BRACKETS.sub(" ", _STRENGTH.sub(" ", text.upper()))
    words = [w for w in text.split() if w.strip(_WORD_EDGE) not in _NOISE or not w.strip(_WORD_EDGE)]
    text = " ".join(words)
    return re.sub(r"\s*,\s*(?=,|$)|^\s*,\s*", "", re.sub(r"\s+", " ", text)).strip(" ?.;:,!*")


def without_edge_salts(text: str) -> str:
    """The text without salt words at either end, bracketed or not."""
    words = text.split()
    while len(words) > 1 and words[-1].strip(_WORD_EDGE) in _SALTS:
        words.pop()
    while len(words) > 1 and words[0].strip(_WORD_EDGE) in _SALTS:
        words.pop(0)
    return " ".join(words)


def readings(text: str) -> list[str]:
    """The skeletons a single name may have: 1 is read as I, and as L."""
    out = [letters(text)]
    if "1" in text:
        out.append(letters(folded(text).replace("1", "L")))
    return out


def _segments(text: str) -> Iterator[tuple[int, int, str]]:
    """(start, end, name) of up to three neighbouring parts between hyphens."""
    parts = text.split("-")
    for end in range(1, len(parts) + 1):
        for start in range(max(0, end - 3), end):
            yield start, end, without_edge_salts("-".join(parts[start:end]).strip())


class Reader:
    """Takes values apart by the whole reference; ``find`` says which entry one skeleton is nearest to."""

    def __init__(self, grammar: Grammar):
        self.grammar = grammar

    def parts(self, value: str) -> list[str] | None:
        """The names a normalised value consists of besides salts and strengths; None if it lists several."""
        if is_placeholder(value):
            return []
        text = cleaned(value)
        if not text:
            return []
        outside = without_edge_salts(_BRACKETED.sub(" ", text).strip())
        inside = [x.strip() for x in _BRACKETED.findall(text)]
        pieces = [p for p in (normalised_py(v.text) for v in self.grammar.values(outside)) if p]
        if len(pieces) > 1:
            return None
        parts = [p for p in (outside, *inside) if p and not is_salt(p) and not is_placeholder(p)]
        if pieces and outside in parts:
            parts[parts.index(outside)] = pieces[0]
        return [without_edge_salts(p) for p in parts]

    def words(self, value: str) -> set[str]:
        """Every skeleton ``meaning`` may ask for."""
        out: set[str] = set()
        for part in self.parts(value) or []:
            out.update(readings(part))
            if "-" in part:
                for _, _, name in _segments(part):
                    out.update(readings(name))
        return out

    def meaning(self, value: str, find: Callable[[str], tuple[int, int]]) -> tuple[int, int]:
        """(distance, id) for a normalised value; the id is SEVERAL for several substances."""
        parts = self.parts(value)
        if parts is None:
            return 0, SEVERAL
        found = [self._one(p, find) for p in parts]
        keys = {key for _, key in found if key != NONE}
        if SEVERAL in keys or len(keys) > 1:
            return 0, SEVERAL
        return min((f for f in found if f[1] != NONE), default=NOTHING)

    @staticmethod
    def _nearest(text: str, find: Callable[[str], tuple[int, int]]) -> tuple[int, int]:
        return min(find(word) for word in readings(text))

    def _one(self, text: str, find: Callable[[str], tuple[int, int]]) -> tuple[int, int]:
        """The nearest entry, unless the text is a chain of names joined by hyphens."""
        best = self._nearest(text, find)
        if best[0] < BEGUN or "-" not in text:
            return best
        # reach[k]: the most names the first k segments can be read as, a name having hyphens of its own.
        last = text.count("-") + 1
        reach: list[int | None] = [0] + [None] * last
        for start, end, name in _segments(text):
            limit = BEGUN if end - start == last else NOTHING[0]
            if reach[start] is not None and self._nearest(name, find)[0] < limit:
                reach[end] = max(reach[end] or 0, reach[start] + 1)
        return (0, SEVERAL) if (reach[-1] or 0) > 1 else best


class Trees:
    """The BK-trees of one shard: whole entries, and beginnings of entries."""

    def __init__(self, whole: dict[str, int], begun: dict[str, int]):
        self.whole = whole
        self.sides = []
        for entries, within, base in ((whole, threshold, 0), (begun, threshold_begun, BEGUN)):
            listed = sorted(entries)
            self.sides.append((BKTree(listed), [entries[x] for x in listed], within, base))

    def near(self, word: str) -> tuple[int, int, int] | None:
        """(distance, lowest id, highest id) of the nearest entries within the threshold; beginnings only where no whole entry is."""
        if word in self.whole:
            return 0, self.whole[word], self.whole[word]
        for tree, ids, within, base in self.sides:
            found = tree.search(word, within(len(word)))
            if found:
                keys = [ids[row] for distance, row in found if distance == found[0][0]]
                return base + found[0][0], min(keys), max(keys)
        return None


class Matcher:
    """Reader and trees over a reference that fits one shard."""

    def __init__(self, names: list[str], ids: list[int]):
        self.reader = Reader(Grammar(names))
        whole: dict[str, int] = {}
        for name, key in sorted(zip(names, ids)):
            if skeleton := letters(name):
                whole.setdefault(skeleton, key)
        starts: dict[str, set[int]] = {}
        for entry, key in whole.items():
            for start in beginnings(entry):
                starts.setdefault(start, set()).add(key)
        self.trees = Trees(whole, {s: next(iter(k)) for s, k in starts.items() if len(k) == 1 and s not in whole})
        self.memory: dict[str, tuple[int, int]] = {}

    def find(self, word: str) -> tuple[int, int]:
        if word not in self.memory:
            if len(self.memory) > 200_000:
                self.memory.clear()
            distance, low, high = self.trees.near(word) or (*NOTHING, NONE)
            # A tie of different entries is none, and beginnings do not mend it.
            self.memory[word] = (distance, low) if low == high else NOTHING
        return self.memory[word]

    def meaning(self, value: str) -> tuple[int, int]:
        return self.reader.meaning(value, self.find)


def beginnings(entry: str) -> list[str]:
    """The beginnings by which an entry can be told: 55 % of it at least, and four letters."""
    return [entry[:size] for size in range(max(4, -(-len(entry) * 11 // 20)), len(entry))]


@lru_cache(maxsize=2)
def _matcher(names: tuple[str, ...], ids: tuple[int, ...]) -> Matcher:
    """One matcher for all tasks of a worker."""
    return Matcher(list(names), list(ids))


@lru_cache(maxsize=2)
def _reader(names: tuple[str, ...]) -> Reader:
    return Reader(Grammar(list(names)))


_ANSWER = "raw_value string, distance int, substance_id bigint"


def _answered(values: pd.Series, got: list[tuple[int, int]]) -> pd.DataFrame:
    return pd.DataFrame({"raw_value": values, "distance": [g[0] for g in got], "substance_id": [g[1] for g in got]})


def _entries(named: DataFrame) -> DataFrame:
    """(begun, word, substance_id) of the two trees: entries by skeleton, and the beginnings only one id has."""

    @F.pandas_udf("string")
    def skeleton(names: pd.Series) -> pd.Series:
        return names.map(letters)

    @F.pandas_udf("array<string>")
    def begun(words: pd.Series) -> pd.Series:
        return words.map(beginnings)

    whole = named.withColumn("word", skeleton("name")).filter("word <> ''").groupBy("word").agg(F.min_by("substance_id", F.struct("name", "substance_id")).alias("substance_id"))
    whole = cut(whole, "entries")
    starts = whole.select(F.explode(begun("word")).alias("word"), "substance_id").groupBy("word").agg(F.min("substance_id").alias("substance_id"), F.max("substance_id").alias("other"))
    starts = starts.filter("substance_id = other").join(whole.select("word"), "word", "left_anti")
    return whole.select(F.lit(False).alias("begun"), "word", "substance_id").unionByName(starts.select(F.lit(True).alias("begun"), "word", "substance_id"))


def _nearest_over_shards(words: DataFrame, named: DataFrame, size: int) -> DataFrame:
    """(word, distance, substance_id) of distinct skeletons against a reference in shards.

    Words and entries meet by (shard, portion of the words) in a cogroup: a task holds one
    shard and about ``AT_ONCE`` words, and nothing goes through the driver.
    """
    entries = cut(_entries(named), "trees")
    n_shards = max(1, -(-entries.count() // size))
    portions = max(1, -(-words.count() // AT_ONCE), -(-slots(words.sparkSession) // n_shards))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    sharded = entries.withColumn("shard", F.pmod(F.xxhash64("word"), F.lit(n_shards)).cast("int")).withColumn("portion", every(portions))
    asked = words.withColumn("portion", F.pmod(F.xxhash64("word", F.lit(1)), F.lit(portions)).cast("int")).withColumn("shard", every(n_shards))

    def searched(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sides = [dict(zip(part["word"], part["substance_id"])) for part in (right[~right["begun"]], right[right["begun"]])]
        trees = Trees(*sides)
        rows = [(word, *hit) for word in left["word"] if (hit := trees.near(word))]
        return pd.DataFrame(rows, columns=["word", "distance", "low", "high"])

    by = ("shard", "portion")
    near = spread(asked, *by).groupBy(*by).cogroup(spread(sharded, *by).groupBy(*by)).applyInPandas(searched, "word string, distance int, low bigint, high bigint")
    best = near.groupBy("word", "distance").agg(F.min("low").alias("low"), F.max("high").alias("high")).groupBy("word").agg(F.min(F.struct("distance", "low", "high")).alias("b"))
    unique = F.col("b.low") == F.col("b.high")
    return best.select(
        "word", F.when(unique, F.col("b.distance")).otherwise(NOTHING[0]).alias("distance"), F.when(unique, F.col("b.low")).otherwise(F.lit(NONE)).cast("bigint").alias("substance_id")
    )


def mapped(values: DataFrame, substances: DataFrame, size: int = SHARD) -> DataFrame:
    """(raw_value, distance, substance_id) of distinct values, the same whatever the size of a shard."""
    spark = values.sparkSession
    named = substances.filter("name is not null and substance_id is not null").select(normalised(F.col("name")).alias("name"), "substance_id").distinct()
    # Few bytes with much work: as many tasks as there are partitions, which the adaptive planner would merge.
    values = spread(values)
    if named.limit(size + 1).count() <= size:
        rows = named.orderBy("name", "substance_id").collect()  # at most ``size`` entries
        shard = spark.sparkContext.broadcast((tuple(r[0] for r in rows), tuple(r[1] for r in rows)))

        def whole(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            matcher = _matcher(*shard.value)
            for frame in frames:
                yield _answered(frame["raw_value"], [matcher.meaning(v) for v in frame["raw_value"]])

        return values.mapInPandas(whole, _ANSWER)

    names = spark.sparkContext.broadcast(tuple(names_of(named)))

    def asked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _reader(names.value)
        for frame in frames:
            yield pd.DataFrame({"raw_value": frame["raw_value"], "words": [sorted(reader.words(v)) for v in frame["raw_value"]]})

    def meant(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = _reader(names.value)
        for frame in frames:
            got = []
            for value, hits in zip(frame["raw_value"], frame["hits"]):
                known = {h["word"]: (h["distance"], h["substance_id"]) for h in hits}
                got.append(reader.meaning(value, lambda w, known=known: known.get(w, NOTHING)))
            yield _answered(frame["raw_value"], got)

    wanted = cut(values.mapInPandas(asked, "raw_value string, words array<string>"), "wanted")
    flat = wanted.select("raw_value", F.explode_outer("words").alias("word"))
    near = _nearest_over_shards(flat.filter("word is not null").select("word").distinct(), named, size)
    hit = F.when(F.col("distance").isNotNull(), F.struct("word", "distance", "substance_id"))
    # A row's hits are the skeletons of one value.
    lists = flat.join(near, "word", "left").groupBy("raw_value").agg(F.collect_list(hit).alias("hits"))
    return spread(lists).mapInPandas(meant, _ANSWER)


def canonical(fields: list[tuple[str, DataFrame]], substances: DataFrame, keys: list[str], size: int = SHARD) -> DataFrame:
    """(field, keys..., raw_value, distance, substance_id) for (name, frame with ``keys`` and the field) pairs.

    Values that equal an entry leave first, by an anti-join; the rest are written once,
    searched as distinct values, and joined back by equality.
    """
    rows = None
    for name, df in fields:
        part = df.select(F.lit(name).alias("field"), *keys, normalised(F.col(name)).alias("raw_value")).filter("raw_value <> ''").distinct()
        rows = part if rows is None else rows.unionByName(part)
    entries = substances.select(normalised(F.col("name")).alias("raw_value")).distinct()
    rows = cut(rows.join(entries, "raw_value", "left_anti"), "free_values")
    answers = mapped(rows.select("raw_value").distinct(), substances, size)
    return (
        rows.join(answers, "raw_value")
        .filter(F.col("substance_id") != SEVERAL)
        .select("field", *keys, "raw_value", "distance", "substance_id")
    )
