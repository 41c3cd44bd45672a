"""Item pairs mined from texts: which item's text names which other item, and near what.

Terms are indexed by their first word: a word of a text that begins some term leads to
that term, and the text at that place is compared with the whole term. Text and term
lists are never compared pair by pair. An index of at most ``MAX_TERMS`` terms is
broadcast, and texts are read in one pass without a shuffle; beyond, words and terms meet
in an equi-join.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 600
MAX_TERMS = 200_000
_WORD = re.compile(r"\w+", re.UNICODE)


def _places(text: str, known) -> dict[str, list[int]]:
    """The places of the words of ``text`` that are ``known``."""
    places: dict[str, list[int]] = {}
    for m in _WORD.finditer(text):
        if m.group() in known:
            places.setdefault(m.group(), []).append(m.start())
    return places


def _whole(text: str, term: str, lead: int, places: Iterable[int]) -> Iterator[tuple[int, int]]:
    """Where ``term`` stands as whole words, given the places of its first word."""
    part = lambda i: 0 <= i < len(text) and (text[i].isalnum() or text[i] == "_")
    for at in sorted(places):
        start, end = at - lead, at - lead + len(term)
        if start >= 0 and text.startswith(term, start) and not part(end) and not part(start - 1):
            yield start, end


class _Judge:
    """What a text says of a term at its mentions."""

    def __init__(self, endpoint: str | None, restriction: str | None):
        self.near, self.bar = (re.compile(p) if p else None for p in (endpoint, restriction))

    def __call__(self, text: str, term: str, lead: int, places: Iterable[int]) -> tuple | None:
        found = [text[max(0, a - WINDOW) : b + WINDOW] for a, b in _whole(text, term, lead, places)]
        if not found:
            return None
        near = [bool(self.near and self.near.search(x)) for x in found]
        return term, len(found), any(near), near[0], bool(self.bar and self.bar.search(found[0]))


_COLUMNS = ["term", "n_mentions", "near", "near_first", "restricted_first"]


def mentions(
    docs: DataFrame, terms: DataFrame, key: str = "ingredient", endpoint: str | None = None, restriction: str | None = None, shortest: int = 5, most: int = MAX_TERMS
) -> DataFrame:
    """(key, term, n_mentions, near, near_first, restricted_first) of terms named in other items' texts.

    A term of at least ``shortest`` letters counts where it stands as whole words. ``near``
    says whether the endpoint pattern occurs within ``WINDOW`` letters of any mention,
    ``near_first`` and ``restricted_first`` look at the first mention only. A text's own
    key is no mention. NULL and empty texts, and texts without a key, mention nothing. ``most`` is the longest list
    of terms that is broadcast.
    """
    texts = docs.filter("text is not null and text <> ''").filter(F.col(key).isNotNull()).select(key, F.upper("text").alias("text"))
    listed = terms.select(F.upper(F.trim("term")).alias("term")).filter(F.length("term") >= shortest).distinct()
    listed = listed.withColumn("word", F.regexp_extract("term", r"(?U)\w+", 0)).filter("word <> ''").withColumn("lead", F.instr(F.col("term"), F.col("word")) - 1)
    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, term string, n_mentions int, near boolean, near_first boolean, restricted_first boolean"
    if listed.limit(most + 1).count() > most:
        return _joined(texts, listed, key, kind, schema, endpoint, restriction)
    index: dict[str, list[tuple[str, int]]] = {}
    for row in listed.collect():
        index.setdefault(row["word"], []).append((row["term"], row["lead"]))
    sent = docs.sparkSession.sparkContext.broadcast(index)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = _Judge(endpoint, restriction)
        for frame in frames:
            out = []
            for k, text in zip(frame[key], frame["text"]):
                own = str(k).upper()
                for word, at in _places(text, sent.value).items():
                    out += [(k, *got) for term, lead in sent.value[word] if term != own and (got := judge(text, term, lead, at))]
            yield pd.DataFrame(out, columns=[key, *_COLUMNS])

    return texts.mapInPandas(batches, schema)


def _joined(texts: DataFrame, listed: DataFrame, key: str, kind: str, schema: str, endpoint: str | None, restriction: str | None) -> DataFrame:
    """``mentions`` where the terms are too many to send: the distinct words of the texts meet them in a join."""

    class All:
        def __contains__(self, word: str) -> bool:
            return True

    def words(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, w, at) for k, text in zip(frame[key], frame["text"]) for w, at in _places(text, All()).items()]
            yield pd.DataFrame(rows, columns=[key, "word", "at"])

    flat = texts.mapInPandas(words, f"`{key}` {kind}, word string, at array<int>")
    hits = flat.join(listed, "word").filter(F.col("term") != F.upper(F.col(key).cast("string")))
    # One row per text with its terms, so that a text is sent once.
    by_text = hits.groupBy(key).agg(F.collect_list(F.struct("term", "lead", "at")).alias("hits")).join(texts, key)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = _Judge(endpoint, restriction)
        for frame in frames:
            out = []
            for k, rows, text in zip(frame[key], frame["hits"], frame["text"]):
                out += [(k, *got) for r in rows if (got := judge(text, r["term"], r["lead"], r["at"]))]
            yield pd.DataFrame(out, columns=[key, *_COLUMNS])

    return by_text.mapInPandas(batches, schema)


def gathered(found: DataFrame, owners: DataFrame, doc: str, key: str = "ingredient") -> DataFrame:
    """The mentions of single texts by the item that owns them, ``owners`` being (doc, key): one row per item and term.

    What any text of the item says counts; the first mention is that of each text.
    """
    return (
        found.join(owners.select(doc, key), doc)
        .filter(F.col("term") != F.upper(F.col(key)))
        .groupBy(key, "term")
        .agg(F.sum("n_mentions").alias("n_mentions"), *(F.bool_or(c).alias(c) for c in ("near", "near_first", "restricted_first")))
    )


def undirected(found: DataFrame, key: str = "ingredient") -> DataFrame:
    """Distinct sorted pairs (item_a, item_b) of a mention frame."""
    return found.select(F.least(key, "term").alias("item_a"), F.greatest(key, "term").alias("item_b")).distinct()


def verified_pairs(controls: DataFrame, docs: DataFrame, found: DataFrame, key: str = "ingredient") -> DataFrame:
    """(item_a, item_b, texts_available, named, status): what the texts of both items say of a listed pair.

    A missing text gives ``no_text``; otherwise the first mention in either direction
    decides between restriction, endpoint, other mention and none.
    """
    has = docs.filter("text is not null and text <> ''").select(F.col(key).alias("item")).distinct()
    both = controls.select("item_a", "item_b").distinct()
    ways = both.select("item_a", "item_b", F.col("item_a").alias("item"), F.col("item_b").alias("partner")).unionByName(
        both.select("item_a", "item_b", F.col("item_b").alias("item"), F.col("item_a").alias("partner"))
    )
    seen = ways.join(has.withColumn("has", F.lit(1)), "item", "left").join(
        found.select(F.col(key).alias("item"), F.col("term").alias("partner"), "near_first", "restricted_first"), ["item", "partner"], "left"
    )
    sums = seen.groupBy("item_a", "item_b").agg(
        F.count("has").alias("texts_available"),
        F.coalesce(F.bool_or(F.col("near_first").isNotNull()), F.lit(False)).alias("named"),
        F.coalesce(F.bool_or("near_first"), F.lit(False)).alias("near"),
        F.coalesce(F.bool_or("restricted_first"), F.lit(False)).alias("restricted"),
    )
    status = (
        F.when(F.col("texts_available") == 0, "no_text")
        .when(F.col("near") & F.col("restricted"), "restriction")
        .when(F.col("near"), "endpoint")
        .when(F.col("named"), "other_mention")
        .otherwise("not_found")
    )
    return sums.select("item_a", "item_b", "texts_available", "named", status.alias("status"))
