"""Files whose columns drift: rescue-column ingestion and the list of changes.

Each line that loads goes through ``Rescue``: the target schema of its table takes the
values that cast, and unknown fields and values that do not cast are rescued. ``ingest``
makes of this one typed table with the rescued values as JSON in ``_rescued``; the list
of changes compares, file by file, what was taken and what was rescued under which name
and of which type. ``promote`` adds an approved rescued field as a typed column and
replays its rescued values; ``replay`` does so for columns whose type was corrected.

Defined results: blank values are NULL and never rescued; of columns that mean the same
attribute in one file the first filled one counts; a file without lines that load has
no types, so only its names are compared; a column blank throughout has no type and is
never ``retyped``.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casemill.functions.text import number
from casemill.operators.attributes import ATTRIBUTE, SCHEMA, attribute
from casemill.operators.badrows import DELIMITER, headed, headers, read_frame
from casemill.session import cut

SKETCH = 16
MERGES = 64
_WHOLE = re.compile(r"[+-]?[0-9]+")
_DECIMAL = re.compile(r"[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+)")
_INTEGER = re.compile(r"([+-]?[0-9]+)(?:\.0+)?")
_NUMBER = re.compile(r"[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?")
_BITS = {"bigint": 63, "int": 31}


def fits(value: str, kind: str) -> bool:
    """Does the trimmed text cast to the type?"""
    if kind == "string":
        return True
    if kind == "double":
        return bool(_NUMBER.fullmatch(value))
    m = _INTEGER.fullmatch(value)
    return bool(m) and -(2 ** _BITS[kind]) <= int(m[1]) < 2 ** _BITS[kind]


class Rescue:
    """The rows of one header under the target schema of its table."""

    def __init__(self, header: str, table: str):
        self.names = header.split(DELIMITER)
        self.schema = SCHEMA.get(table, {})
        self.attributes = [attribute(n) for n in self.names]
        self.kinds = [self.schema.get(a) for a in self.attributes]

    def row(self, fields: list[str]) -> tuple[dict[str, str], dict[str, str]]:
        """(taken, rescued): attribute to text of the values the schema takes, and of those it does not."""
        taken: dict[str, str] = {}
        rescued: dict[str, str] = {}
        bad: dict[str, str] = {}
        for value, name, kind in zip(fields, self.attributes, self.kinds):
            value = value.strip()
            if not value or name in taken or name in rescued or name in bad:
                continue
            if kind is None:
                rescued[name] = value
            elif fits(value, kind):
                taken[name] = value
            else:
                bad[name] = value
        if bad:
            rescued.update((n, bad[n]) for n in self.schema if n in bad)
        return taken, rescued


def _kind(value: str) -> int:
    """1 whole number, 2 decimal, 3 text."""
    return 1 if _WHOLE.fullmatch(value) else 2 if _DECIMAL.fullmatch(value) else 3


def _sketch(values: Iterable[str]) -> list[int]:
    """The ``SKETCH`` lowest hashes of the values."""
    return sorted({zlib.crc32(v.upper().encode()) for v in values})[:SKETCH]


class _Profile:
    """What the rows of one file in one batch hold, by attribute: the type, the values if a sketch is wanted, and whether any was rescued."""

    def __init__(self, rescue: Rescue, sketched: bool):
        self.rescue, self.sketched = rescue, sketched
        self.kinds: dict[str, int] = {}
        self.values: dict[str, set[str]] = {}
        self.rescued: set[str] = set()

    def add(self, fields: list[str]) -> None:
        taken, rescued = self.rescue.row(fields)
        if rescued:
            self.rescued.update(rescued)
            taken.update(rescued)
        for name, value in taken.items():
            kind = self.kinds.get(name, 0)
            if kind < 3:
                self.kinds[name] = max(kind, _kind(value))
            if self.sketched:
                self.values.setdefault(name, set()).add(value)


_ORDER = ("quarter", "received_at", "file_id")


def sketched(files: DataFrame, heads: DataFrame) -> DataFrame:
    """``heads`` with ``sketched``: a name of no known attribute comes or goes between the file and one beside it.

    Only then are values compared, so only then a sketch is needed.
    """
    order = Window.partitionBy("series_id", "table_name").orderBy(*_ORDER)
    unknown = lambda names: F.filter(names, lambda n: ~n.isin(list(ATTRIBUTE)))
    rows = heads.drop("table_name").join(files.select("file_id", "series_id", "table_name", "quarter", "received_at"), "file_id")
    rows = rows.withColumn("_own", unknown("names")).withColumns({"_back": F.lag("_own").over(order), "_next": F.lead("_own").over(order)})
    changed = F.lit(False)
    for other in ("_back", "_next"):
        moved = F.size(F.array_except("_own", other)) + F.size(F.array_except(other, "_own")) > 0
        changed = changed | (F.col(other).isNotNull() & moved)
    return rows.withColumn("sketched", changed).select(*heads.columns, "sketched")


def profiles(files: DataFrame, lines: DataFrame, heads: DataFrame | None = None) -> DataFrame:
    """(file_id, attribute, kind, sketch, rescued) of what ingestion takes and rescues of each file.

    ``kind`` is 1 whole, 2 decimal, 3 text; ``sketch`` is a bottom-k sketch of the values,
    empty where no value will be compared. ``heads`` are the headers if they are written already.
    Lines are parsed and rescued in one pass, and profiles are first made per Arrow batch,
    so that a file with a third of all rows is merged from a few rows per batch.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple[str, str], Rescue] = {}
        for frame in frames:
            found: dict[int, _Profile] = {}
            for file_id, table, header, wanted, (fields, _) in zip(frame["file_id"], frame["table_name"], frame["header"], frame["sketched"], read_frame(frame, False)):
                if fields is not None:
                    if file_id not in found:
                        if (table, header) not in known:
                            known[table, header] = Rescue(header, str(table).lower())
                        found[file_id] = _Profile(known[table, header], bool(wanted))
                    found[file_id].add(fields)
            rows = [(f, name, kind, _sketch(p.values.get(name, ())), name in p.rescued) for f, p in found.items() for name, kind in p.kinds.items()]
            yield pd.DataFrame(rows, columns=["file_id", "attribute", "kind", "sketch", "rescued"])

    heads = cut(sketched(files, headers(files, lines) if heads is None else heads), "sketched")
    merged = headed(files, lines, heads, ["sketched"]).mapInPandas(batches, "file_id bigint, attribute string, kind int, sketch array<bigint>, rescued boolean")
    lowest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("sketch")))), 1, SKETCH).alias("sketch")
    sums = (F.max("kind").alias("kind"), lowest, F.bool_or("rescued").alias("rescued"))
    # Twice, so that the many batches of a hot file never meet in one row.
    salted = merged.groupBy("file_id", "attribute", F.pmod(F.xxhash64("sketch"), F.lit(MERGES)).alias("salt")).agg(*sums)
    return salted.groupBy("file_id", "attribute").agg(*sums)


def layouts(files: DataFrame, headers: DataFrame, profile: DataFrame) -> DataFrame:
    """Each file with its columns and those of the file before it in its series and table.

    One row per file; the window runs over the files of one series and table, which are
    as many as there are quarters.
    """
    known = F.create_map(*(F.lit(x) for pair in sorted(ATTRIBUTE.items()) for x in pair))
    named = (
        headers.select("file_id", F.posexplode("names").alias("at", "name"))
        .filter("name <> ''")
        .withColumn("attribute", F.coalesce(F.try_element_at(known, F.col("name")), F.col("name")))
        .join(profile, ["file_id", "attribute"], "left")
        .groupBy("file_id")
        .agg(F.array_sort(F.collect_list(F.struct("at", "name", "kind", "sketch"))).alias("columns"))
    )
    order = Window.partitionBy("series_id", "table_name").orderBy(*_ORDER)
    return (
        files.select("file_id", "series_id", "table_name", "quarter", "received_at")
        .join(named, "file_id")
        .withColumn("before", F.lag("columns").over(order))
        .filter(F.col("before").isNotNull())
        .select("file_id", "columns", "before")
    )


def compared(before: list, now: list) -> list[tuple[str, str]]:
    """The (column, change) pairs between two lists of (at, name, kind, sketch).

    Names of one attribute are the same column. Names no attribute is known for are
    matched by their values: the same type and half of the sketch in common.
    """
    old = {c["name"]: c for c in reversed(before)}
    new = {c["name"]: c for c in reversed(now)}
    pairs = [(name, name) for name in new if name in old]
    gone, come = [n for n in old if n not in new], [n for n in new if n not in old]

    def like(a: str, b: str) -> float:
        if attribute(a) == attribute(b):
            return 2.0
        if a in ATTRIBUTE and b in ATTRIBUTE:
            return 0.0
        x, y = (set(c["sketch"] if c["sketch"] is not None else []) for c in (old[a], new[b]))
        if not x or not y or old[a]["kind"] != new[b]["kind"]:
            return 0.0
        lowest = sorted(x | y)[:SKETCH]
        return sum(v in x and v in y for v in lowest) / len(lowest)

    found = []
    for score, a, b in sorted(((like(a, b), a, b) for a in gone for b in come), key=lambda s: (-s[0], s[1], s[2])):
        if score >= 0.5 and a in gone and b in come:
            gone.remove(a)
            come.remove(b)
            pairs.append((a, b))
            found.append((b, "renamed"))
    found += [(n, "removed") for n in gone] + [(n, "added") for n in come]
    for a, b in pairs:
        x, y = old[a]["kind"], new[b]["kind"]
        if x is not None and y is not None and x == x and y == y and x != y:
            found.append((b, "retyped"))
    return found


def changes(layout: DataFrame) -> DataFrame:
    """(file_id, column_name, change), where change is added, removed, renamed or retyped."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame(
                [
                    (file_id, name, change)
                    for file_id, now, before in zip(frame["file_id"], frame["columns"], frame["before"])
                    for name, change in compared(before, now)
                ],
                columns=["file_id", "column_name", "change"],
            )

    return layout.mapInPandas(batches, "file_id bigint, column_name string, change string").distinct()


def _typed(text: Column, kind: str) -> Column:
    if kind in ("bigint", "int"):
        text = F.regexp_replace(text, r"\.0+$", "")
    return number(text) if kind == "double" else text.try_cast(kind)


def ingest(files: DataFrame, lines: DataFrame, table_name: str) -> DataFrame:
    """The lines of ``table_name`` that load, in its target schema, with ``_rescued`` JSON."""
    schema = SCHEMA[table_name]

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, Rescue] = {}
        for frame in frames:
            rows = []
            for file_id, line_no, header, (fields, _) in zip(frame["file_id"], frame["line_no"], frame["header"], read_frame(frame, False)):
                if fields is None:
                    continue
                if header not in known:
                    known[header] = Rescue(header, table_name)
                taken, rescued = known[header].row(fields)
                rows.append((file_id, line_no, *(taken.get(n) for n in schema), json.dumps(rescued, ensure_ascii=False, separators=(",", ":")) if rescued else None))
            yield pd.DataFrame(rows, columns=["file_id", "line_no", *schema, "_rescued"], dtype=object)

    wanted = files.filter(F.lower("table_name") == table_name)
    own = lines.join(wanted.select("file_id"), "file_id", "left_semi")
    texts = headed(wanted, own).mapInPandas(batches, f"file_id bigint, line_no int, {', '.join(f'{n} string' for n in schema)}, _rescued string")
    return texts.select("file_id", "line_no", *(_typed(F.col(n), kind).alias(n) for n, kind in schema.items()), "_rescued")


def promote(df: DataFrame, field: str, kind: str, column: str | None = None) -> DataFrame:
    """Give the rescued ``field`` a typed column of its own and replay its rescued values.

    A value that casts leaves ``_rescued``; one that does not stays there. Where the
    column exists, its filled values win and the rescued ones fill the gaps.
    """
    column = column or field
    rescued = F.from_json("_rescued", "map<string,string>")
    value = _typed(F.try_element_at(rescued, F.lit(field)), kind)
    rest = F.map_filter(rescued, lambda k, v: (k != field) | F.lit(False))
    current = F.col(column) if column in df.columns else F.lit(None).cast(kind)
    return (
        df.withColumn("_value", value)
        .withColumn("_rescued", F.when(F.col("_value").isNull(), F.col("_rescued")).otherwise(F.when(F.size(rest) > 0, F.to_json(rest))))
        .withColumn(column, F.coalesce(current, F.col("_value")))
        .drop("_value")
    )


def replay(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """``promote`` for every column of ``kinds``: rescued values go into the columns that take them now."""
    for column, kind in kinds.items():
        if column in df.columns and dict(df.dtypes)[column] != kind:
            df = df.withColumn(column, F.col(column).cast(kind))
        df = promote(df, column, kind)
    return df
