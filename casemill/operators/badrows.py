"""Delimited lines that do not parse: minimum-cost error parse.

A line is read as a path through a few states (field start, bare field, quoted field,
closed quote). Reading a token costs nothing; inserting or deleting a quote or a
delimiter costs one. Lines whose cheapest path to the header's field count costs
nothing, and whose typed fields hold valid values, load; for the others the edits of
the cheapest path state the reason.

Defined results: an empty or blank line gives no row at all; a line of a file without
header fails with ``no_header``; NULL lines count as blank. Lines are never shortened.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.operators.attributes import NAMES
from casemill.session import cut

DELIMITER = "$"
_TOKEN = re.compile(r'\$|"|[^$"]+')
_ID = re.compile(r"[0-9]{1,18}(?:\.0)?")
_UNSAFE = re.compile("[\x00-\x1f\x7f-\x9f�]")
# NEW: nothing stands between the quotes so far.
START, BARE, QUOTED, CLOSED, QUOTED_NEW, CLOSED_NEW = range(6)
_QUOTE = {START: QUOTED_NEW, BARE: BARE, QUOTED: CLOSED, CLOSED: QUOTED, QUOTED_NEW: CLOSED_NEW, CLOSED_NEW: QUOTED}
_OPEN, _SHUT = (QUOTED, QUOTED_NEW), (CLOSED, CLOSED_NEW)


def split_line(line: str) -> list[str] | None:
    """The fields on the path that costs nothing, or None where the quoting is broken."""
    if '"' not in line:
        return line.split(DELIMITER)
    fields, at = [], 0
    while True:
        if line.startswith('"', at):
            end = at + 1
            while True:
                end = line.find('"', end)
                if end < 0:
                    return None
                if not line.startswith('"', end + 1):
                    break
                end += 2
            fields.append(line[at + 1 : end].replace('""', '"'))
            at = end + 1
            if at < len(line) and line[at] != DELIMITER:
                return None
        else:
            end = line.find(DELIMITER, at)
            end = len(line) if end < 0 else end
            fields.append(line[at:end])
            at = end
        if at >= len(line):
            return fields
        at += 1


def cheapest_edits(line: str, width: int) -> list[str]:
    """The edits of a cheapest path of ``line`` to ``width`` fields, each with its place.

    The table holds, for each token, six states times the number of delimiters read
    (at most ``width``), so the work is tokens x width. One empty field more than
    ``width`` is allowed at the end.
    """
    return _few_edits(line, width) if '"' not in line else searched_edits(line, width)


def _few_edits(line: str, width: int) -> list[str]:
    """``searched_edits`` of a line without a quote, where the costs can be told: too few or too many delimiters."""
    places = [m.start() for m in re.finditer(r"\$", line)]
    more = len(places) + 1 - width
    if more <= 0:
        return [f"insert_delimiter@{len(line)}"] * -more
    if line.endswith(DELIMITER):  # the one empty field that is allowed
        more -= 1
        places.pop()
    if more <= 2:
        return [f"delete_delimiter@{p}" for p in places[len(places) - more :]]
    return [f"insert_quote@{places[width - 2] + 1 if width > 1 else 0}", f"insert_quote@{len(line)}"]


def searched_edits(line: str, width: int) -> list[str]:
    """The edits of a cheapest path over (token, state, delimiters read), by dynamic programming in order of cost.

    All places a path of one cost can reach are filled in before those of the next, so the
    search ends with the first path that reaches the end.
    """
    tokens = [(m.group(), m.start()) for m in _TOKEN.finditer(line)]
    end = len(tokens)
    origin: dict[tuple[int, int, int], tuple | None] = {(0, START, 0): None}
    layer = list(origin)
    while True:
        following: list[tuple[tuple, tuple, str]] = []
        for place in layer:  # grows: free steps stay in the layer
            i, mode, count = place
            if i == end:
                if mode not in _OPEN and (count == width - 1 or count == width and mode in (START, CLOSED_NEW)):
                    return _edits(origin, place)
                at, token = len(line), ""
            else:
                token, at = tokens[i]
            free = None
            if token == DELIMITER:
                free = (i + 1, QUOTED, count) if mode in _OPEN else (i + 1, START, count + 1) if count < width else None
            elif token == '"':
                free = (i + 1, _QUOTE[mode], count)
            elif token and mode not in _SHUT:
                free = (i + 1, QUOTED if mode in _OPEN else BARE, count)
            if free and free not in origin:
                origin[free] = (place, "")
                layer.append(free)
            steps = []
            if token == DELIMITER or token == '"':
                steps.append(((i + 1, mode, count), f"delete_{'delimiter' if token == DELIMITER else 'quote'}@{at}"))
            if mode not in _OPEN and count < width:
                steps.append(((i, START, count + 1), f"insert_delimiter@{at}"))
            if mode != BARE:
                steps.append(((i, _QUOTE[mode], count), f"insert_quote@{at}"))
            following += [(new, place, what) for new, what in steps]
        layer = []
        for new, place, what in following:
            if new not in origin:
                origin[new] = (place, what)
                layer.append(new)


def _edits(origin: dict, place: tuple) -> list[str]:
    """The edits on the way to ``place``."""
    edits = []
    while origin[place]:
        place, what = origin[place]
        if what:
            edits.append(what)
    return edits[::-1]


def read_line(line: str, width: int, id_at: int, name_at: int, reasons: bool = True) -> tuple[list[str] | None, str | None]:
    """Fields and None of a line that loads, else None and the reason.

    A path that costs nothing proves the line: each token has one free step at most, so
    where the splitter fails no such path is. The edits that state the reason are looked
    for only with ``reasons``.
    """
    fields = split_line(line)
    if fields is not None and len(fields) == width + 1 and fields[-1] == "":
        fields.pop()
    if fields is None or len(fields) != width:
        kind = "quoting" if fields is None else "field_count"
        return None, f"{kind}: " + " ".join(cheapest_edits(line, width)) if reasons else kind
    if id_at >= 0 and not _ID.fullmatch(fields[id_at].strip()):
        return None, "report_id: not 1 to 18 digits"
    if name_at >= 0:
        if not fields[name_at].strip():
            return None, "drugname: blank"
        if _UNSAFE.search(fields[name_at]):
            return None, "drugname: control or replacement character"
    return fields, None


def headers(files: DataFrame, lines: DataFrame) -> DataFrame:
    """One row per file: its cleaned column names, and where the checked columns stand.

    Names are trimmed, lower-cased and freed of a byte-order mark and of enclosing
    quotes; an empty name behind a last delimiter is no column.
    """
    raw = F.split(F.regexp_replace("line", "\r$", ""), r"\$", -1)
    names = F.transform(raw, lambda x: F.lower(F.trim(F.regexp_replace(x, '[﻿"\t]', ""))))
    names = F.when((F.size(names) > 1) & (F.element_at(names, -1) == ""), F.slice(names, 1, F.size(names) - 1)).otherwise(names)

    def place(attribute: str):
        found = F.array_position(
            F.transform("names", lambda x: x.isin(NAMES[attribute])), F.lit(True)
        )
        return (found - 1).cast("int")

    return (
        lines.filter((F.col("line_no") == 1) & F.col("line").isNotNull())
        .select("file_id", names.alias("names"))
        .join(files.select("file_id", "table_name"), "file_id")
        .withColumn("id_at", place("report_id"))
        .withColumn("name_at", F.when(F.lower("table_name") == "drug", place("drugname")).otherwise(F.lit(-1)))
    )


def headed(files: DataFrame, lines: DataFrame, heads: DataFrame | None = None, carry: Sequence[str] = ()) -> DataFrame:
    """All non-blank lines after the headers with what is needed of their header: (file_id, line_no, line, table_name, header, width, id_at, name_at).

    The headers are written first: their size is then known, so that the planner sends
    them to all tasks while they are small and no line is moved; otherwise it joins them
    by file and splits hot files. ``header`` is the names in one text. ``heads`` are the
    headers if they are written already, ``carry`` further columns of them.
    """
    heads = cut(headers(files, lines), "headers") if heads is None else heads
    known = heads.select("file_id", "table_name", F.concat_ws(DELIMITER, "names").alias("header"), F.size("names").alias("width"), "id_at", "name_at", *carry)
    body = lines.filter((F.col("line_no") > 1) & F.col("line").rlike(r"\S"))
    return body.select("file_id", "line_no", "line").join(known, "file_id", "left")


def read_frame(frame: pd.DataFrame, reasons: bool = True) -> Iterator[tuple[list[str] | None, str | None]]:
    """``read_line`` for each row of a batch of ``headed``."""
    for line, width, id_at, name_at in zip(frame["line"], frame["width"], frame["id_at"], frame["name_at"]):
        if width != width or not width:
            yield None, "no_header"
        else:
            yield read_line(line.removesuffix("\r"), int(width), int(id_at), int(name_at), reasons)


def parse(files: DataFrame, lines: DataFrame, reasons: bool = True) -> DataFrame:
    """All non-blank lines after the headers: (file_id, line_no, table_name, header, fields, reason).

    ``reason`` is NULL and ``fields`` filled for the lines that load; the other way round
    for the rest. ``header`` holds the names of the fields, with the delimiter between them.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = list(read_frame(frame, reasons))
            out = frame[["file_id", "line_no", "table_name", "header"]].copy()
            out["fields"], out["reason"] = [g[0] for g in got], [g[1] for g in got]
            yield out

    return headed(files, lines).mapInPandas(batches, "file_id bigint, line_no int, table_name string, header string, fields array<string>, reason string")


def rejected(parsed: DataFrame) -> DataFrame:
    """The lines that do not load, with the reason: (file_id, line_no, reason)."""
    return parsed.filter(F.col("reason").isNotNull()).select("file_id", "line_no", "reason").distinct()
