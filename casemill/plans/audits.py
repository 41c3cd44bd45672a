"""Queries of the quality, ingestion and text operators, and their SQL."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators import badrows, events, quality, textref
from casemill.operators.attributes import ATTRIBUTE, SCHEMA
from casemill.session import cut, shared_dir
from casemill.sources import catalog, delimited
from casemill.sources.tables import table

CHILDREN = {"drug": "quarter", "reac": "quarter", "outc": "quarter", "drug_resolved": "era", "drug_ingredients": "era"}
TABLES = ["demo", "drug", "drug_resolved", "drug_ingredients", "case_drugs", "reac", "outc", "documents", "substances", "mix_targets", "raw_files", "raw_lines"]
#: The endpoint and restriction patterns of the text queries.
ENDPOINT = "MUSCLE|JOINT|KINASE"
RESTRICTION = "AVOID|DO NOT EXCEED|CONTRAINDICAT"


def key_uniqueness(spark: SparkSession, folder: str) -> DataFrame:
    """Quarters of demo in which a report id repeats (Q1)."""
    return quality.duplicate_keys(table(spark, folder, "demo", "report_id", "quarter"), "report_id", "quarter")


def orphans(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each child table without a demo row in their quarter, or in their era where they have no quarter (Q2)."""
    parts = []
    for name, by in CHILDREN.items():
        parent = table(spark, folder, "demo", by, "report_id")
        parts.append(quality.orphans(table(spark, folder, name, by, "report_id"), parent, [by, "report_id"]).withColumn("table_name", F.lit(name)))
    return reduce(DataFrame.unionByName, parts)


def rowcounts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each table against a manifest made of the distinct ones (Q3)."""
    frames = {t: table(spark, folder, t) for t in TABLES}
    manifest = reduce(
        DataFrame.unionByName,
        (df.distinct().agg(F.count(F.lit(1)).alias("expected")).withColumn("table_name", F.lit(t)) for t, df in frames.items()),
    )
    return quality.row_counts(frames, manifest)


def id_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Case ids of the documents against those of demo (Q4)."""
    return quality.id_overlap(table(spark, folder, "documents", "case_id"), table(spark, folder, "demo", "case_id"))


def cast_failures(spark: SparkSession, folder: str) -> DataFrame:
    """Filled values of demo that do not cast (Q5)."""
    return quality.cast_failures(table(spark, folder, "demo", "caseversion", "age", "wt", "fda_dt"), {"caseversion": "bigint", "age": "double", "wt": "double", "fda_dt": "bigint"})


def missing_tables(spark: SparkSession, folder: str) -> DataFrame:
    """Tables missing from a series' quarter, or there twice (Q6)."""
    return quality.missing_tables(table(spark, folder, "raw_files", "series_id", "quarter", "table_name"), ["demo", "drug", "outc"])


def _layout(spark: SparkSession, folder: str) -> DataFrame:
    files, lines = table(spark, folder, "raw_files"), table(spark, folder, "raw_lines")
    heads = badrows.headers(files, lines).select("file_id", "names")
    return files.select("file_id", "series_id", "table_name", "quarter").join(heads, "file_id")


def schema_changes(spark: SparkSession, folder: str) -> DataFrame:
    """Files whose column set differs from the one before (Q7)."""
    return quality.column_changes(_layout(spark, folder))


def column_presence(spark: SparkSession, folder: str) -> DataFrame:
    """First and last quarter of every column."""
    return quality.presence(_layout(spark, folder))


def schema_vs_config(spark: SparkSession, folder: str) -> DataFrame:
    """Columns of the files that the target schema does not name (Q7)."""
    return quality.against_config(_layout(spark, folder), {t: list(c) for t, c in SCHEMA.items()})


def quarter_gaps(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per quarter and quarters missing before it."""
    return quality.quarter_gaps(table(spark, folder, "demo", "quarter"))


def _split(spark: SparkSession, folder: str) -> DataFrame:
    """All raw lines behind the headers, split plainly by the header of their file."""
    files, lines = table(spark, folder, "raw_files"), table(spark, folder, "raw_lines")
    body = lines.filter((F.col("line_no") > 1) & F.col("line").rlike(r"\S"))
    return delimited.split_by_header(body, badrows.headers(files, lines)).join(files.select("file_id", "table_name"), "file_id")


def delimited_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Every raw line in the fields of its header, without regard to quotes."""
    rows = _split(spark, folder)
    return rows.select("file_id", "line_no", "skipped", "has_trailing", "n_surplus", F.array_join("fields", "|").alias("fields"))


def scan_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Counters of the plain split over all raw lines, by table (Q8)."""
    return delimited.scan_statistics(_split(spark, folder), "table_name")


def header_scan(spark: SparkSession, folder: str) -> DataFrame:
    """The header of every raw file and its number of columns; only first lines are read."""
    files, lines = table(spark, folder, "raw_files"), table(spark, folder, "raw_lines")
    return badrows.headers(files, lines).select("file_id", "table_name", F.array_join("names", ";").alias("columns"), F.size("names").alias("n_columns"))


def header_harmonisation(spark: SparkSession, folder: str) -> DataFrame:
    """The era-neutral names of every raw file, and names that two of its columns share."""
    files, lines = table(spark, folder, "raw_files"), table(spark, folder, "raw_lines")
    got = delimited.harmonised_headers(badrows.headers(files, lines))
    return got.select("file_id", F.array_join("attributes", ";").alias("attributes"), F.array_join("doubled", ";").alias("doubled"))


def encoding_fallback(spark: SparkSession, folder: str) -> DataFrame:
    """Raw lines as bytes, of even files in UTF-8 and of odd ones in Windows-1252, read without being told which."""
    lines = table(spark, folder, "raw_lines").filter("line is not null")
    # A line Windows-1252 cannot write stays in UTF-8.
    fits = F.col("line").rlike("^[\x00-\x7f\xa0-\xff]*$") & (F.col("file_id") % 2 == 1)
    raw = F.when(fits, F.encode("line", "ISO-8859-1")).otherwise(F.encode("line", "UTF-8"))
    return delimited.decoded(lines.withColumn("raw", raw), "raw").select("file_id", "line_no", "text", "decode_errors")


def _written(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def parquet_sink(spark: SparkSession, folder: str) -> DataFrame:
    """Reactions written by quarter and read again, the schema merged."""
    path = _written(spark, "sink-parquet")
    delimited.write_parquet(table(spark, folder, "reac"), path)
    return delimited.read_parquet(spark, path).groupBy("quarter").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("report_id").alias("n_reports"))


def csv_sink(spark: SparkSession, folder: str) -> DataFrame:
    """The term vocabulary as one CSV file with a header, read again."""
    path = _written(spark, "sink-csv")
    delimited.write_csv(events.vocabulary(table(spark, folder, "reac")), path, ["pt", "reports", "n_quarters"])
    return delimited.read_csv(spark, path, "pt string, reports bigint, n_quarters bigint")


def name_variants(spark: SparkSession, folder: str) -> DataFrame:
    """The ingredients that begin with the first word of the first longer one and a blank, the word a bound parameter of the SQL."""
    view = f"v_{uuid.uuid4().hex}_"
    items = catalog.register(spark, folder, ["drug_ingredients"], view)["drug_ingredients"]
    name = items.filter(F.col("ingredient").rlike("^[A-Z]+ ")).agg(F.min(F.substring_index("ingredient", " ", 1))).first()[0]
    return catalog.like_prefix(spark, view + "drug_ingredients", "ingredient", name or "")


def member_classes(spark: SparkSession, folder: str) -> DataFrame:
    """Table and kind of every raw file by its name (S3)."""
    name, kind = delimited.classified(F.col("file_name"))
    return table(spark, folder, "raw_files", "file_name").withColumn("member_table", name).withColumn("kind", kind)


def withdrawn_list(spark: SparkSession, folder: str) -> DataFrame:
    """Case ids among the words of the documents, as from lists of withdrawn cases."""
    return delimited.id_list(table(spark, folder, "documents", "text").filter("text is not null"), "text")


def canonical_numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Row counts of all tables as one JSON document."""
    rows = reduce(
        DataFrame.unionByName, (table(spark, folder, t).agg(F.count(F.lit(1)).alias("value")).select(F.lit(f"rows_{t}").alias("metric"), "value") for t in TABLES)
    )
    return delimited.numbers_json(rows)


def _mentions(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents", "doc_id", "text").withColumnRenamed("doc_id", "ingredient")
    return textref.mentions(docs, table(spark, folder, "substances").select(F.col("name").alias("term")), "ingredient", ENDPOINT, RESTRICTION)


def term_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Which documents name which substances."""
    return _mentions(spark, folder).select(F.col("ingredient").alias("doc_id"), "term")


def proximity(spark: SparkSession, folder: str) -> DataFrame:
    """The mentions near an endpoint word."""
    return _mentions(spark, folder).filter("near").select(F.col("ingredient").alias("doc_id"), "term")


def _labels(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Label sections keyed by the first substance they name, and the mentions of all of them by substance.

    The stand-in for one label text per item: every section counts, however many one substance has.
    """
    docs = table(spark, folder, "documents", "doc_id", "text", "doc_type").filter("doc_type = 'label_section'")
    terms = table(spark, folder, "substances").select(F.col("name").alias("term"))
    found = cut(textref.mentions(docs, terms, "doc_id", ENDPOINT, RESTRICTION), "labels")
    first = found.groupBy("doc_id").agg(F.min("term").alias("ingredient"))
    return first.join(docs.select("doc_id", "text"), "doc_id").select("ingredient", "text"), textref.gathered(found, first, "doc_id")


def mention_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Undirected pairs of substances of which one's label names the other."""
    return textref.undirected(_labels(spark, folder)[1])


def verified_controls(spark: SparkSession, folder: str) -> DataFrame:
    """What the labels say of each pair of substances they mention (T4)."""
    labels, found = _labels(spark, folder)
    found = cut(found, "mentions")
    return textref.verified_pairs(textref.undirected(found), labels, found)


QUERIES = {
    f.__name__: f
    for f in (
        key_uniqueness, orphans, rowcounts, id_overlap, cast_failures, missing_tables, schema_changes, column_presence, schema_vs_config, quarter_gaps, delimited_parse,
        scan_statistics, header_scan, header_harmonisation, encoding_fallback, name_variants, parquet_sink, csv_sink, member_classes, withdrawn_list, canonical_numbers, term_mentions, proximity, mention_pairs, verified_controls,
    )
}

_NUMBER = r"regexp_full_match(trim({0}), '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')"


def _cast_row(column: str, bad: str) -> str:
    return f"select '{column}' column_name, count(*) filter (where trim({column}::varchar) <> '') n, count(*) filter (where trim({column}::varchar) <> '' and {bad}) k from demo"


_LAYOUT = r"""
with heads as (
  select file_id, series_id, table_name, quarter, case when len(n) > 1 and n[-1] = '' then n[:-2] else n end names from (
    select f.file_id, series_id, table_name, quarter, list_transform(string_split(regexp_replace(line, '\r$', ''), '$'), lambda x: lower(trim(replace(replace(replace(x, chr(65279), ''), '"', ''), chr(9), '')))) n
    from raw_lines l join raw_files f on f.file_id = l.file_id where line_no = 1 and line is not null)
)
"""
_SPLIT = _LAYOUT + r""", split as (
  select file_id, line_no, table_name, len(f) > k + 5 skipped, len(f) > k and len(f) <= k + 5 has_trailing, case when len(f) > k + 5 then 0 else len(list_filter(f[k + 1:k + 5], lambda x: trim(x) <> '')) end n_surplus,
    case when len(f) <= k + 5 then array_to_string(list_transform(range(1, k + 1), lambda i: coalesce(trim(f[i]), '')), '|') end fields
  from (select file_id, line_no, table_name, len(names) k, string_split(regexp_replace(line, '\r$', ''), '$') f from raw_lines join heads using (file_id) where line_no > 1 and regexp_matches(line, '\S'))
)
"""
#: Whole-word mentions of the substances in the documents: where they stand, and what stands around them.
_MENTION = rf"""
with docs as (select doc_id, doc_type, upper(text) t from documents where text is not null), found as (
  select doc_id, doc_type, t, name term, string_split(t, name) parts from docs join (select distinct upper(trim(name)) name from substances) on contains(t, name) where length(name) >= 5
), placed as (
  select *, list_filter(list_transform(range(1, len(parts)), lambda k: list_sum(list_transform(parts[1:k], lambda p: length(p))) + (k - 1) * length(term) + 1),
    lambda a: not regexp_matches(substr(t, (a - 1)::bigint, 1), '[\p{{L}}\p{{N}}_]') and not regexp_matches(substr(t, (a + length(term))::bigint, 1), '[\p{{L}}\p{{N}}_]')) places from found
), around as (
  select *, list_transform(places, lambda a: substr(t, greatest(1, a - 600)::bigint, (a + length(term) + 600 - greatest(1, a - 600))::bigint)) windows from placed where len(places) > 0
), hits as (
  select doc_id, doc_type, term, len(list_filter(windows, lambda w: regexp_matches(w, '{ENDPOINT}'))) > 0 near, regexp_matches(windows[1], '{ENDPOINT}') near_first, regexp_matches(windows[1], '{RESTRICTION}') restricted_first from around
), owner as (
  select doc_id, min(term) ingredient from hits where doc_type = 'label_section' group by 1
), told as (
  select ingredient, term, bool_or(near_first) near, bool_or(restricted_first) restricted from hits join owner using (doc_id) where doc_type = 'label_section' and term <> ingredient group by 1, 2
), listed as (
  select distinct least(ingredient, term) item_a, greatest(ingredient, term) item_b from told
)
"""

SQL = {
    "key_uniqueness": "select quarter, count(*) n_rows, count(distinct report_id) distinct_keys, count(*) - count(distinct report_id) duplicates from demo group by 1 having count(*) <> count(distinct report_id)",
    "orphans": " union all ".join(
        f"select '{t}' table_name, count(*) n_rows, count(*) filter (where o) orphans, round(count(*) filter (where o) / count(*), 6) rate, case when count(*) filter (where o) = 0 then 'PASS' else 'FAIL' end status "
        f"from (select not exists (select 1 from demo d where d.{by} = c.{by} and d.report_id = c.report_id) o from {t} c)"
        for t, by in CHILDREN.items()
    ),
    "rowcounts": " union all ".join(
        f"select '{t}' table_name, (select count(*) from (select distinct * from {t})) expected, (select count(*) from {t}) found, "
        f"case when (select count(*) from (select distinct * from {t})) = (select count(*) from {t}) then 'PASS' else 'FAIL' end status"
        for t in TABLES
    ),
    "id_overlap": "select count(*) n_ids, min(case_id) as low, max(case_id) as high, count(*) filter (where k) matched, round(count(*) filter (where k) / count(*), 6) rate, "
    "case when count(*) filter (where k) / count(*) > 0.1 then 'PASS' else 'FAIL' end status "
    "from (select distinct case_id, case_id in (select case_id from demo where case_id is not null) k from documents where case_id is not null)",
    "cast_failures": "select column_name, n n_filled, k failures, round(k / n, 6) rate, case when k / n <= 0.01 then 'PASS' else 'FAIL' end status from ("
    + " union all ".join(
        [_cast_row(c, f"try_cast(trim({c}::varchar) as bigint) is null") for c in ("caseversion", "fda_dt")] + [_cast_row(c, "not " + _NUMBER.format(c)) for c in ("age", "wt")]
    )
    + ")",
    "missing_tables": """select series_id, quarter, t table_name, count(f.file_id) n_files from (select distinct series_id, quarter, t from raw_files, (values ('demo'), ('drug'), ('outc')) v(t)) s
      left join raw_files f using (series_id, quarter) where f.table_name = t or f.table_name is null group by all having count(f.file_id) <> 1
      union all select series_id, quarter, t, 0 from (select distinct series_id, quarter, t from raw_files, (values ('demo'), ('drug'), ('outc')) v(t)) s
      where not exists (select 1 from raw_files f where f.series_id = s.series_id and f.quarter = s.quarter and f.table_name = s.t)""",
    "schema_changes": _LAYOUT
    + """select series_id, table_name, quarter, case when b is null then 'first_observed' else 'columns_changed' end change,
      array_to_string(case when b is null then n else list_filter(n, lambda x: not list_contains(b, x)) end, ';') added,
      array_to_string(case when b is null then [] else list_filter(b, lambda x: not list_contains(n, x)) end, ';') removed, len(n) n_columns
    from (select *, lag(n) over (partition by series_id, table_name order by quarter, file_id) b from (select *, list_sort(list_distinct(names)) n from heads)) where b is null or b <> n""",
    "column_presence": _LAYOUT
    + """select table_name, column_name, min(quarter) first_quarter, max(quarter) last_quarter, count(distinct quarter) n_quarters, count(distinct file_id) n_files
    from (select *, unnest(names) column_name from heads) where column_name <> '' group by 1, 2""",
    "schema_vs_config": _LAYOUT
    + "select table_name, column_name, count(distinct file_id) n_files from (select *, unnest(names) column_name from heads) where column_name <> '' and not ("
    + " or ".join(f"table_name = '{t}' and column_name in ({', '.join(repr(x) for x in c)})" for t, c in SCHEMA.items())
    + ") group by 1, 2",
    "quarter_gaps": "select quarter, n_rows, coalesce(i - lag(i) over (order by quarter) - 1, 0) gap from (select quarter, count(*) n_rows, "
    "min(substr(quarter, 1, 4)::int * 4 + substr(quarter, 6, 1)::int) i from demo where quarter is not null group by 1)",
    "delimited_parse": _SPLIT + "select file_id, line_no, skipped, has_trailing, n_surplus, fields from split",
    "scan_statistics": _SPLIT + "select table_name, count(*) rows_raw, count(*) filter (where not skipped) rows_parsed, count(*) filter (where skipped) rows_skipped, "
    "count(*) filter (where has_trailing) as trailing, sum(n_surplus)::bigint surplus_values from split group by 1",
    "header_scan": _LAYOUT + "select file_id, table_name, array_to_string(names, ';') columns, len(names) n_columns from heads",
    "header_harmonisation": _LAYOUT
    + ", known as (select * from (values "
    + ", ".join(f"('{n}', '{a}')" for n, a in sorted(ATTRIBUTE.items()))
    + """) v(n, a)), placed as (select file_id, i, coalesce(a, x.n) a from (select file_id, unnest(range(1, len(names) + 1)) i, unnest(names) n from heads) x left join known k on k.n = x.n)
    select file_id, attributes, coalesce(doubled, '') doubled from (select file_id, string_agg(a, ';' order by i) attributes from placed group by 1)
    left join (select file_id, string_agg(a, ';' order by a) doubled from (select file_id, a from placed group by 1, 2 having count(*) > 1) group by 1) using (file_id)""",
    "encoding_fallback": "select file_id, line_no, line as text, 0 decode_errors from raw_lines where line is not null",
    "name_variants": "select distinct ingredient from drug_ingredients where starts_with(ingredient, (select min(split_part(ingredient, ' ', 1)) from drug_ingredients where regexp_matches(ingredient, '^[A-Z]+ ')) || ' ')",
    "parquet_sink": "select quarter, count(*) n_rows, count(distinct report_id) n_reports from reac group by 1",
    "csv_sink": "select upper(trim(pt)) pt, count(distinct era || '|' || report_id) reports, count(distinct quarter) n_quarters from reac where trim(pt) <> '' group by 1",
    "canonical_numbers": "select '{' || string_agg('\"rows_' || t || '\":' || n, ',' order by 'rows_' || t) || '}' document from ("
    + " union all ".join(f"select '{t}' t, count(*) n from {t}" for t in TABLES)
    + ")",
    "proximity": _MENTION + "select doc_id, term from hits where near",
    "mention_pairs": _MENTION + "select item_a, item_b from listed",
    "verified_controls": _MENTION
    + """select item_a, item_b, (select count(distinct ingredient) from owner where ingredient in (item_a, item_b)) texts_available, true named,
      case when bool_or(near) and bool_or(restricted) then 'restriction' when bool_or(near) then 'endpoint' else 'other_mention' end status
    from listed join told on least(ingredient, term) = item_a and greatest(ingredient, term) = item_b group by item_a, item_b""",
    "member_classes": r"select file_name, lower(regexp_extract(file_name, '(?i)(DEMO|DRUG|REAC|OUTC|RPSR|THER|INDI|STAT)([0-9]{2})Q([0-9])[A-Z0-9_]*\.TXT$', 1)) member_table, 'table' kind from raw_files",
    "withdrawn_list": r"select distinct w::bigint case_id from (select unnest(regexp_split_to_array(trim(text), '[\s\x0b]+')) w from documents) where regexp_full_match(w, '[0-9]{1,18}')",
    "term_mentions": _MENTION + "select doc_id, term from hits",
}
