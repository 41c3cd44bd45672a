"""Several values packed in one field: a parsing expression grammar.

    field   <- value (delimiter value)* end
    value   <- quoted / bracketed / protected / bare
    quoted  <- quote (doubled quote / any but quote)* quote  &(delimiter / end)
    bracketed <- "[" any* "]" &(delimiter / end), likewise "{}" and "()"
    bare    <- (strength / any but delimiter)+
    delimiter <- one of \\ / | ; + & ,  or the word AND, or a line break

Alternatives are tried in order; one that fails gives its text back to the next, so a
quote or bracket that is never closed is read as part of a bare value and flagged. ``protected``
is a name of the reference list that holds a delimiter itself ("X, BOVINE"), also
misspelt, cut short or followed by a salt.

Defined results: NULL, empty and placeholder texts have no values; a strength or
placeholder between delimiters is no value; salts behind a delimiter belong to the value
before them (or after, at the start), and are a value where there is no other; empty
values between delimiters are skipped and not counted. Texts are never shortened.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.functions.text import letters, normalised_py
from casemill.operators.lexicon import is_placeholder, is_salt, is_strength, without_salts

#: Reference lists are sent to the workers; this is their largest size.
MAX_NAMES = 200_000
CACHE = 50_000

_DELIMITER = re.compile(r"\s*(?:[\\/|;+&,\n]|(?<=\s)[AÀÁА]ND(?=\s))\s*", re.IGNORECASE)
_NUMBER_INSIDE = re.compile(r"[0-9][,/][0-9]|%/[0-9]")
_UNIT_RATE = re.compile(r"(?:MG|MCG|UG|G|IU|U)\s*/\s*(?:[0-9.,]*\s*)(?:ML|L|H|HR|HOUR|DAY|KG|G)\b", re.IGNORECASE)
_QUOTED = {q: re.compile(rf"{q}((?:[^{q}]|{q}{q})*){q}\s*(?=$|{_DELIMITER.pattern})", re.IGNORECASE) for q in "\"'"}
_CLOSE = {"[": "]", "{": "}", "(": ")"}
_STRENGTH_END = re.compile(r"(?: [0-9][0-9.,/]*%?)+$")


class Value(NamedTuple):
    text: str
    flags: str


class Grammar:
    """The grammar over one reference list of names."""

    def __init__(self, names: list[str]):
        self.whole = set(names)
        self.skeletons = {letters(n) for n in names}
        self.protected: list[tuple[str, str, set[str], int]] = []  # before and behind the first delimiter, bigrams, delimiters
        for name in names:
            if m := _DELIMITER.search(name):
                head = letters(name[: m.start()])
                self.protected.append((head, letters(name[m.end() :]), _bigrams(head), sum(1 for _ in _DELIMITER.finditer(name))))
        #: Delimiters to look at: as many as a name holds, one it was misspelt with, and the one behind it.
        self.reach = max((p[3] for p in self.protected), default=0) + 2
        self.cache: dict[str, list[Value]] = {}
        self.judged: dict[tuple[str, bool], bool] = {}

    def is_protected(self, text: str, whole: bool = False) -> bool:
        """``_protects``, remembered."""
        if (text, whole) not in self.judged:
            if len(self.judged) >= CACHE:
                self.judged.clear()
            self.judged[text, whole] = self._protects(text, whole)
        return self.judged[text, whole]

    def _protects(self, text: str, whole: bool) -> bool:
        """Does ``text`` mean one name that holds a delimiter, allowing for misspelling and cutting?

        What stands behind the delimiter must not be a name of its own. With ``whole`` the
        name must have as many delimiters as the text, so that it is not cut short at one.
        """
        name = normalised_py(text)
        if name in self.whole:
            return True
        name = without_salts(_STRENGTH_END.sub("", name))
        m = _DELIMITER.search(name)
        if not m:
            return False
        head, tail = letters(name[: m.start()]), letters(name[m.end() :])
        if not tail or tail in self.skeletons:
            return False
        near_head, near_tail = max(2, len(head) // 6), max(2, len(tail) // 5)
        grams, marks = _bigrams(head), sum(1 for _ in _DELIMITER.finditer(name)) if whole else 0
        return any(
            (not whole or n == marks)
            and abs(len(head) - len(first)) <= near_head
            and len(tail) <= len(rest) + near_tail
            and len(grams & known) >= len(known) - 3 * near_head  # an edit breaks three bigrams at most
            and _distances(head, first, near_head)[-1] <= near_head
            and min(_distances(tail, rest, near_tail)) <= near_tail
            for first, rest, known, n in self.protected
        )

    def values(self, text: str | None) -> list[Value]:
        """The values of ``text`` in their order."""
        if text is None:
            return []
        if text in self.cache:
            return self.cache[text]
        if len(self.cache) >= CACHE:
            self.cache.clear()
        got = self.cache[text] = self._parse(text)
        return got

    def _parse(self, text: str) -> list[Value]:
        name = normalised_py(text)
        if not name or is_placeholder(name) or is_strength(name):
            return []
        if name in self.whole:
            return [Value(text.strip(), "")]
        pieces: list[tuple[int, int, str, str]] = []  # start, end, value, flags
        at = 0
        while at <= len(text):
            start = at + len(text[at:]) - len(text[at:].lstrip())
            end, value, flags = self._value(text, start)
            if value.strip():
                pieces.append((start, end, value, flags))
            gap = _DELIMITER.match(text, end)
            if not gap or gap.end() == end:
                break
            at = gap.end()
        merged: list[tuple[int, int, str, str]] = []
        lead: tuple[int, int, str, str] | None = None
        for start, end, value, flags in pieces:
            clean = normalised_py(value)
            if is_salt(clean):
                if merged:
                    first = merged[-1]
                    merged[-1] = (first[0], end, text[first[0] : end], first[3])
                elif lead is None:
                    lead = (start, end, value, flags)
                else:
                    lead = (lead[0], end, text[lead[0] : end], lead[3])
                continue
            if is_placeholder(clean) or is_strength(clean):
                continue
            if lead is not None:
                start, value, lead = lead[0], text[lead[0] : end], None
            merged.append((start, end, value, flags))
        if lead is not None:
            merged.append(lead)
        return [Value(v.strip(), f) for _, _, v, f in merged]

    def _value(self, text: str, at: int) -> tuple[int, str, str]:
        """(end, value, flags) of the value at ``at``: the first alternative that fits."""
        flags = ""
        if at < len(text) and text[at] in _QUOTED:
            found = _QUOTED[text[at]].match(text, at)
            if found:
                return found.end(1) + 1, found[1].replace(text[at] * 2, text[at]), "quoted"
            flags = "malformed_quote"
        elif at < len(text) and text[at] in _CLOSE:
            shut = text.find(_CLOSE[text[at]], at)
            if shut > 0 and (shut + 1 == len(text) or _DELIMITER.match(text, shut + 1)):
                return shut + 1, text[at + 1 : shut], "bracketed"
            flags = "malformed_bracket" if shut < 0 else ""
        stops = []
        if self.protected:
            for m in _DELIMITER.finditer(text, at):
                if not self._inside(text, m):
                    stops.append(m)
                    if len(stops) == self.reach:
                        break
        else:
            stops = [m for m in _DELIMITER.finditer(text, at) if not self._inside(text, m)][:1]
        ends = [m.start() for m in stops[1:]] + [len(text)] * (0 < len(stops) < self.reach)
        # A name of many delimiters goes before one it begins with; a name cut short comes last.
        for end in reversed(ends) if self.reach > 3 else ():
            if self.is_protected(text[at:end], True):
                return end, text[at:end], flags
        for end in ends:
            if self.is_protected(text[at:end]):
                return end, text[at:end], flags
        end = stops[0].start() if stops else len(text)
        return end, text[at:end], flags

    @staticmethod
    def _inside(text: str, m: re.Match) -> bool:
        """Is the delimiter part of a number or a rate, such as 0,9 or 70/30 or MG/ML?"""
        mark = m.group()
        if len(mark) == 1 and mark in ",/" and _NUMBER_INSIDE.match(text, max(m.start() - 1, 0)):
            return True
        return "/" in mark and any(r.start() < m.start() < r.end() for r in _UNIT_RATE.finditer(text, max(0, m.start() - 5)))


def _bigrams(word: str) -> set[str]:
    return {word[i : i + 2] for i in range(len(word) - 1)}


def _distances(word: str, full: str, limit: int) -> list[int]:
    """Edit distances of ``word`` to every beginning of ``full``, swapped neighbours counting once; over the limit they may be too low."""
    before, last = list(range(len(full) + 1)), [limit + 1] * (len(full) + 1)
    for i, x in enumerate(word, 1):
        now = [i]
        for j, y in enumerate(full, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (x != y)))
            if i > 1 and j > 1 and x == full[j - 2] and word[i - 2] == y:
                now[-1] = min(now[-1], last[j - 2] + 1)
        if min(now) > limit:
            return [limit + 1]
        last, before = before, now
    return before


def names_of(substances: DataFrame, column: str = "name") -> list[str]:
    """The reference names, collected behind a check of their number."""
    rows = substances.select(column).filter(F.col(column).isNotNull()).limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"the reference list has over {MAX_NAMES} names; give a narrower one")
    return sorted({r[0] for r in rows})


def split_values(df: DataFrame, text: str, keys: list[str], names: list[str]) -> DataFrame:
    """(keys..., position, piece, n_pieces, flags): a row per value of ``text``.

    ``piece`` is without enclosing quotes and normalised, ``position`` counts from 1. All
    texts go through the grammar, those without a delimiter too.
    """
    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)

    # At most ``MAX_NAMES`` names, see ``names_of``.
    sent = df.sparkSession.sparkContext.broadcast(names)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grammar = Grammar(sent.value)
        for frame in frames:
            lists = [grammar.values(v) for v in frame[text]]
            out = frame[keys].copy()
            out["pieces"] = [[normalised_py(v.text) for v in vs] for vs in lists]
            out["flags"] = [[v.flags for v in vs] for vs in lists]
            yield out

    packed = df.filter(F.trim(text) != "").select(*keys, text)
    out = packed.mapInPandas(batches, f"{schema}, pieces array<string>, flags array<string>")
    return (
        out.select(*keys, F.size("pieces").alias("n_pieces"), F.posexplode(F.arrays_zip("pieces", "flags")).alias("at", "v"))
        .select(*keys, (F.col("at") + 1).alias("position"), F.col("v.pieces").alias("piece"), "n_pieces", F.col("v.flags").alias("flags"))
    )
