"""Archives and delimited members: scan, verify, classify, decode, split, and write.

``binaryFile`` gives one row per archive or file; members are unpacked inside the tasks.
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators.attributes import ATTRIBUTE, attribute

# Fixed value: the names of table members, such as DEMO14Q3.TXT.
MEMBER = re.compile(r"(DEMO|DRUG|REAC|OUTC|RPSR|THER|INDI|STAT)([0-9]{2})Q([0-9])[A-Z0-9_]*\.TXT$", re.IGNORECASE)
PAD = 5


def decode(raw: bytes) -> tuple[str, int]:
    """Text and number of replaced bytes: UTF-8 if it is, else Windows-1252."""
    try:
        return raw.decode("utf-8"), 0
    except UnicodeDecodeError:
        text = raw.decode("cp1252", errors="replace")
        return text, text.count("�")


def decoded(df: DataFrame, raw: str) -> DataFrame:
    """``df`` with (text, decode_errors) of its bytes: UTF-8 where they are, else Windows-1252. NULL bytes give NULL and 0."""

    @F.pandas_udf("text string, decode_errors int")
    def read(values: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, 0) if v is None else decode(bytes(v)) for v in values], columns=["text", "decode_errors"])

    return df.withColumn("_d", read(raw)).select(*df.columns, "_d.text", "_d.decode_errors")


def archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256, ok, n_members, error) of each archive."""

    @F.pandas_udf("ok boolean, n_members int, error string")
    def checked(contents: pd.Series) -> pd.DataFrame:
        rows = []
        for raw in contents:
            try:
                rows.append((True, len(zipfile.ZipFile(io.BytesIO(raw)).namelist()), None))
            except (zipfile.BadZipFile, OSError) as error:
                rows.append((False, 0, str(error)))
        return pd.DataFrame(rows, columns=["ok", "n_members", "error"])

    files = spark.read.format("binaryFile").load(path)
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), checked("content").alias("c")).select("path", "length", "sha256", "c.*")


def classified(member: Column) -> tuple[Column, Column]:
    """(table, kind) of a member's path; kind is table, deleted_cases, documentation, directory or other."""
    base = F.substring_index(member, "/", -1)
    table = F.lower(F.regexp_extract(base, "(?i)" + MEMBER.pattern, 1))
    kind = (
        F.when((base == "") | member.endswith("/"), "directory")
        .when(table != "", "table")
        .when(F.lower(member).contains("delet"), "deleted_cases")
        .when(F.lower(member).rlike(r"\.(doc|pdf|docx|txt)$"), "documentation")
        .otherwise("other")
    )
    return F.when((table != "") & (kind == "table"), table), kind


def members(spark: SparkSession, path: str) -> DataFrame:
    """(path, member, content) of every member of every archive."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for name, raw in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                    for info in archive.infolist():
                        yield pd.DataFrame({"path": [name], "member": [info.filename], "content": [archive.read(info)]})

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(batches, "path string, member string, content binary")


#: A member without a line end in its first MiB has no header.
HEADER_LIMIT = 1 << 20


def member_headers(spark: SparkSession, path: str, delimiter: str = "$") -> DataFrame:
    """(path, member, size, header, names) of every member of every archive; only first lines are unpacked.

    ``header`` and ``names`` are NULL for folders and members without a line end in the
    first ``HEADER_LIMIT`` bytes that are longer than it; names are trimmed and lower-cased.
    """

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name, raw in zip(frame["path"], frame["content"]):
                with zipfile.ZipFile(io.BytesIO(raw)) as archive:
                    for info in archive.infolist():
                        with archive.open(info) as member:
                            first = member.readline(HEADER_LIMIT)
                        whole = not info.is_dir() and (first.endswith(b"\n") or len(first) < HEADER_LIMIT)
                        header = decode(first)[0].strip("\r\n") if whole else None
                        names = [n.strip().lstrip("\ufeff").lower() for n in header.split(delimiter)] if whole else None
                        rows.append((name, info.filename, info.file_size, header, names))
            yield pd.DataFrame(rows, columns=["path", "member", "size", "header", "names"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(batches, "path string, member string, size bigint, header string, names array<string>")


def lines_of(unpacked: DataFrame) -> DataFrame:
    """(path, member, line_no, line, decode_errors) of the non-blank lines, without their ends."""

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for path, member, raw in zip(frame["path"], frame["member"], frame["content"]):
                text, errors = decode(bytes(raw))
                rows = [(i, x.rstrip("\r")) for i, x in enumerate(text.split("\n"), 1) if x.strip()]
                yield pd.DataFrame({"path": path, "member": member, "line_no": [i for i, _ in rows], "line": [x for _, x in rows], "decode_errors": errors})

    return unpacked.mapInPandas(batches, "path string, member string, line_no int, line string, decode_errors int")


def harmonised(header: str, delimiter: str = "$") -> list[str]:
    """The attributes of a raw header; two columns of one attribute raise."""
    names = [attribute(n.strip().lstrip("﻿").strip().lower()) for n in header.rstrip("\r").split(delimiter)]
    double = sorted({n for n in names if names.count(n) > 1})
    if double:
        raise ValueError(f"duplicate columns after harmonisation: {double}")
    return names


def harmonised_headers(headers: DataFrame) -> DataFrame:
    """``headers`` (file_id, names) as (file_id, attributes, doubled): era-neutral names, and those two columns of a file share."""
    known = F.create_map(*(F.lit(x) for pair in sorted(ATTRIBUTE.items()) for x in pair))
    named = headers.select("file_id", F.transform("names", lambda n: F.coalesce(F.try_element_at(known, n), n)).alias("attributes"))
    twice = F.filter(F.array_distinct("attributes"), lambda a: F.size(F.filter("attributes", lambda b: a == b)) > 1)
    return named.withColumn("doubled", F.array_sort(twice))


def split_fields(df: DataFrame, names: list[str], line: str = "line", delimiter: str = "$") -> DataFrame:
    """``df`` with a trimmed text column per name, and ``has_trailing`` and ``n_surplus``.

    Nothing is quoted and nothing is inferred. Up to ``PAD`` more fields than names are
    taken off and counted: one empty one is the usual trailing delimiter. Lines with more
    than that are left out; missing fields at the end of a short line are empty.
    """
    parts = F.split(F.regexp_replace(F.col(line), "\r$", ""), re.escape(delimiter), -1)
    rows = df.withColumn("_f", parts).filter(F.size("_f") <= len(names) + PAD)
    extra = F.slice("_f", len(names) + 1, PAD)
    got = rows.withColumns(
        {n: F.coalesce(F.trim(F.get("_f", F.lit(i))), F.lit("")) for i, n in enumerate(names)}
    )
    return got.withColumn("has_trailing", F.size("_f") > len(names)).withColumn("n_surplus", F.size(F.filter(extra, lambda x: F.trim(x) != ""))).drop("_f")


def split_by_header(lines: DataFrame, headers: DataFrame, delimiter: str = "$") -> DataFrame:
    """``lines`` (file_id, line) of files of different columns, split plainly by ``headers`` (file_id, names).

    Adds names, fields (trimmed, one per name), has_trailing, n_surplus and ``skipped``,
    true for lines with more than ``PAD`` fields over the names, which have no fields.
    """
    parts = F.split(F.regexp_replace("line", "\r$", ""), re.escape(delimiter), -1)
    rows = lines.join(headers.select("file_id", "names"), "file_id").withColumn("_f", parts).withColumn("_n", F.size("names"))
    extra = F.filter(F.slice("_f", F.col("_n") + 1, F.lit(PAD)), lambda x: F.trim(x) != "")
    fields = F.transform(F.sequence(F.lit(0), F.col("_n") - 1), lambda i: F.coalesce(F.trim(F.get("_f", i)), F.lit("")))
    skipped = F.size("_f") > F.col("_n") + PAD
    return rows.withColumns(
        {"skipped": skipped, "has_trailing": ~skipped & (F.size("_f") > F.col("_n")), "n_surplus": F.when(skipped, 0).otherwise(F.size(extra)), "fields": F.when(~skipped, fields)}
    ).drop("_f", "_n")


def scan_statistics(split: DataFrame, by: str) -> DataFrame:
    """(by, rows_raw, rows_parsed, rows_skipped, trailing, surplus_values) of ``split_by_header``, in one pass."""
    return split.groupBy(by).agg(
        F.count(F.lit(1)).alias("rows_raw"), F.count_if(~F.col("skipped")).alias("rows_parsed"), F.count_if("skipped").alias("rows_skipped"),
        F.count_if("has_trailing").alias("trailing"), F.sum("n_surplus").alias("surplus_values"),
    )


def id_list(lines: DataFrame, line: str = "line") -> DataFrame:
    """Distinct case ids among the blank-separated words of lists of withdrawn cases."""
    words = lines.select(F.explode(F.split(F.trim(line), r"\s+")).alias("w"))
    return words.filter(F.col("w").rlike("^[0-9]{1,18}$")).select(F.col("w").cast("bigint").alias("case_id")).distinct()


def write_parquet(df: DataFrame, path: str, by: str = "quarter") -> None:
    """Partitioned, zstd-compressed Parquet; rows of a partition are brought together first, a hot one in several parts."""
    df.hint("rebalance", by).write.mode("overwrite").option("compression", "zstd").partitionBy(by).parquet(path)


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    """Parquet of drifting schemas as one table, united by column name."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """A small result as one CSV file with a header; other columns are left out."""
    df.select(*columns).coalesce(1).write.mode("overwrite").option("header", "true").csv(path)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.option("header", "true").schema(schema).csv(path)


def read_label_documents(spark: SparkSession, path: str) -> DataFrame:
    """(ingredient, found, text) from one JSON document per file; text only where found."""
    return spark.read.option("multiLine", "true").schema("ingredient string, found boolean, text string").json(path)


def numbers_json(rows: DataFrame) -> DataFrame:
    """One JSON text of (metric, value) rows; a metric given twice keeps its larger value."""
    once = rows.groupBy("metric").agg(F.max("value").alias("value"))
    return once.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("metric", "value"))))).alias("document"))
