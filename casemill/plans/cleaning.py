"""Queries of the cleaning operators over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.operators import badrows, drift, packed, units
from casemill.operators.attributes import ATTRIBUTE, SCHEMA
from casemill.session import cut
from casemill.sources.tables import table


def p1_ages(spark: SparkSession, folder: str) -> DataFrame:
    """Every usable age of demo in years, with its unit and where the unit came from."""
    got = units.ages(table(spark, folder, "demo"))
    return got.filter("age_years is not null").select(
        "report_id", "case_id", "quarter", "age", "age_cod", "age_unit", "age_unit_from", F.round("age_years", 6).alias("age_years")
    )


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """Reports with a readable age stated in another unit than years."""
    got = units.ages(table(spark, folder, "demo", "report_id", "quarter", "mfr_sndr", "age", "age_cod"))
    return got.filter("age_years is not null and age_unit <> 'YR'").select("report_id", "quarter").distinct()


def _raw(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, folder, "raw_files", "file_id", "series_id", "table_name", "quarter", "received_at"), table(spark, folder, "raw_lines")


def _ingested(name: str):
    def query(spark: SparkSession, folder: str) -> DataFrame:
        return drift.ingest(*_raw(spark, folder), name)

    query.__doc__ = f"The raw lines of {name} in one typed table, the rest as rescued JSON."
    return query


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Column changes of each raw file against the file before it: from what ingestion takes and rescues of their rows."""
    files, lines = _raw(spark, folder)
    heads = cut(badrows.headers(files, lines), "headers")
    return drift.changes(drift.layouts(files, heads, drift.profiles(files, lines, heads)))


def p2_promoted(spark: SparkSession, folder: str) -> DataFrame:
    """The drug lines with two rescued fields promoted to typed columns."""
    rows = drift.promote(drift.ingest(*_raw(spark, folder), "drug"), "dose_amt", "double")
    return drift.promote(rows, "nda_num", "bigint").select("file_id", "line_no", "report_id", "drugname", "dose_amt", "nda_num", "_rescued")


def _values(spark: SparkSession, folder: str) -> DataFrame:
    names = packed.names_of(table(spark, folder, "substances", "name"))
    parts = [("prod_ai", "drug"), ("ingredient_raw", "drug_resolved")]
    got = [
        packed.split_values(table(spark, folder, t, "report_id", "drug_seq", f).distinct(), f, ["report_id", "drug_seq"], names)
        .withColumn("field", F.lit(f))
        for f, t in parts
    ]
    return got[0].unionByName(got[1])


def p3_values(spark: SparkSession, folder: str) -> DataFrame:
    """Every value of prod_ai and ingredient_raw with its position and error flags."""
    return _values(spark, folder).select("field", "report_id", "drug_seq", "position", "piece", "flags").distinct()


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """The values of the fields that hold two or more."""
    return _values(spark, folder).filter("n_pieces >= 2").select("field", "report_id", "drug_seq", "position", "piece").distinct()


def _rows(spark: SparkSession, folder: str) -> DataFrame:
    rows = badrows.parse(*_raw(spark, folder), reasons=False).filter("reason is null")
    return rows.select("file_id", "line_no", "table_name", F.split("header", r"\$", -1).alias("names"), "fields")


def p5_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that load, as arrays of names and fields."""
    return _rows(spark, folder)


def p5_values(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that load, a row per column that is filled."""
    each = _rows(spark, folder).select("file_id", "line_no", "table_name", F.explode(F.arrays_zip("names", "fields")).alias("z"))
    return each.select("file_id", "line_no", "table_name", F.col("z.names").alias("column_name"), F.col("z.fields").alias("value")).filter("value <> ''")


def p5_rejected(spark: SparkSession, folder: str) -> DataFrame:
    """The lines that do not load, with the edits or the value that state the reason."""
    return badrows.rejected(badrows.parse(*_raw(spark, folder)))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Non-blank lines after the header that do not load."""
    return p5_rejected(spark, folder).select("file_id", "line_no")


QUERIES = {
    "p1_ages": p1_ages,
    "p1_found": p1_found,
    "p2_demo": _ingested("demo"),
    "p2_drug": _ingested("drug"),
    "p2_outc": _ingested("outc"),
    "p2_found": p2_found,
    "p2_promoted": p2_promoted,
    "p3_values": p3_values,
    "p3_found": p3_found,
    "p5_rows": p5_rows,
    "p5_values": p5_values,
    "p5_rejected": p5_rejected,
    "p5_found": p5_found,
}

_AGE_SQL = r"""
with spelled as (
  select *, lower(trim(regexp_replace(coalesce(age, ''), '\s+', ' ', 'g'))) t, lower(trim(coalesce(age_cod, ''))) c from demo
), words as (
  select *, regexp_replace(regexp_replace(t, '^p(t?)([0-9.,]+)([a-z])$', '\2 \3'), '^(one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve) ', '1 ') u from spelled
), read as (
  select *, coalesce(nullif(list_position(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten', 'eleven', 'twelve'], regexp_extract(t, '^[a-z]+')), 0)::double,
      try_cast(replace(regexp_extract(u, '[0-9]+([.,][0-9]+)?'), ',', '.') as double)) v,
    case when regexp_matches(u, '^[0-9]+([.,][0-9]+)?$') then 'none'
         when regexp_matches(u, '^[0-9]+/12$') then 'MON' when regexp_matches(u, '^[0-9]+/52$') then 'WK' when regexp_matches(u, '^[0-9]+/7$') then 'DY'
         when regexp_matches(u, '[0-9][ -]?(dec|decades?|dec\.|décennies?|dekaden?)$') then 'DEC'
         when regexp_matches(u, '^(age )?[0-9]+[ -]?(y|yrs?|years?|year-old|jahre?|ans?|años?|y/o)$') then 'YR'
         when regexp_matches(u, '[0-9][ -]?(m|mo|mos\.|mths|months?|month-old|monate?|mois|mes|meses)$') then 'MON'
         when regexp_matches(u, '[0-9][ -]?(w|wk|wks old|weeks?|wochen?|semaines?|semanas?)$') then 'WK'
         when regexp_matches(u, '[0-9][ -]?(d|days?|day-old|days old|tage?|jours?)$') or regexp_matches(u, '^day [0-9]+ of life$') then 'DY'
         when regexp_matches(u, '[0-9][ -]?(h|hrs|hours?|std\.|heures?)$') then 'HR' end tu,
    case when c in ('dec', 'decade') then 'DEC' when c in ('yr', 'y', 'yrs', 'year', 'years') then 'YR'
         when c in ('mon', 'mo', 'mth', 'months') then 'MON' when c in ('wk', 'w', 'wks', 'week') then 'WK'
         when c in ('dy', 'd', 'day', 'days') then 'DY' when c in ('hr', 'h', 'hrs', 'hours') then 'HR' end cu
  from words
), plain as (
  select mfr_sndr, median(v) filter (where tu = 'none' and c = '') med, max(v) filter (where tu = 'none' and c = '') mx,
    count(*) filter (where tu = 'none' and c = '') n, count(*) filter (where tu <> 'none' or c <> '') k
  from read where v > 0 and tu is not null and trim(mfr_sndr) <> '' group by mfr_sndr
), custom as (
  select mfr_sndr, case when med < 175 then 'YR' when med < 1300 then 'MON' when med < 6900 then 'WK' when med < 90000 then 'DY' else 'HR' end su
  from plain where n >= 5 and k * 20 <= n and mx > 145
), unit as (
  select r.*, case when v is null or tu is null then null when tu <> 'none' and (c = '' or cu is not null) then tu when cu is not null then cu
    when c <> '' then null else coalesce(su, 'YR') end unit,
    case when tu <> 'none' and (c = '' or cu is not null) then 'text' when cu is not null then 'code' when su is not null then 'source' else 'default' end unit_from
  from read r left join custom using (mfr_sndr)
)
"""

_LINES_SQL = r"""
with names as (
  select file_id, table_name, list_transform(string_split(regexp_replace(line, '\r$', ''), '$'), lambda x: lower(trim(replace(x, chr(65279), '')))) names
  from raw_lines join raw_files using (file_id) where line_no = 1
), body as (
  select l.file_id, line_no, table_name, names, regexp_replace(line, '\r$', '') s
  from raw_lines l join names using (file_id) where line_no > 1 and regexp_matches(line, '\S')
), cells as (
  select *, regexp_full_match(s, '(?s)(?:"(?:[^"]|"")*"|[^"$][^$]*)?(?:\$(?:"(?:[^"]|"")*"|[^"$][^$]*)?)*') quoted,
    list_transform(regexp_extract_all('$' || s, '(?s)\$("(?:[^"]|"")*"|[^"$][^$]*)?'), lambda x: case when x[2:2] = '"' then replace(x[3:len(x) - 1], '""', '"') else x[2:] end) f
  from body
), placed as (
  select *, case when len(f) = len(names) + 1 and f[len(f)] = '' then len(names) else len(f) end width,
    f[list_position(list_transform(names, lambda n: n in ('report_id', 'isr', 'primaryid', 'safetyreportid', 'rpt_no')), true)] id,
    f[list_position(list_transform(names, lambda n: n in ('drugname', 'drug_name', 'medicinalproduct')), true)] dn
  from cells
), judged as (
  select *, not quoted or width <> len(names) or not regexp_full_match(trim(id), '[0-9]{1,18}(\.0)?')
    or (table_name = 'drug' and (trim(dn) = '' or regexp_matches(dn, '[\x00-\x1f\x7f-\x{9f}\x{FFFD}]'))) bad
  from placed
)
"""

SQL = {
    "p1_found": _AGE_SQL + "select distinct report_id, quarter from unit where unit <> 'YR'",
    "p1_ages": _AGE_SQL
    + f"select report_id, case_id, quarter, age, age_cod, unit age_unit, unit_from age_unit_from, round(v * case unit {' '.join(f'when {u!r} then {f!r}' for u, f in units.YEARS.items())} end, 6) age_years from unit where unit is not null",
    "p2_found": _LINES_SQL
    + ", known as (select * from (values "
    + ", ".join(f"('{n}', '{a}')" for n, a in sorted(ATTRIBUTE.items()))
    + r""") v(n, a)), cells2 as (
  select file_id, unnest(names) n, unnest(f[1:len(names)]) v from judged where not bad
), kinds as (
  select file_id, n, max(case when regexp_full_match(trim(v), '[+-]?[0-9]+') then 1 when regexp_full_match(trim(v), '[+-]?([0-9]+\.[0-9]*|\.[0-9]+)') then 2 else 3 end) k
  from cells2 where trim(v) <> '' group by all
), columns as (
  select file_id, c.n, coalesce(a, c.n) a, k from (select file_id, unnest(names) n from names) c left join known using (n) left join kinds using (file_id, n)
), steps as (
  select file_id, lag(file_id) over (partition by series_id, table_name order by quarter, received_at, file_id) p from raw_files
), met as (
  select coalesce(x.file_id, y.file_id) file_id, x.n now, y.n old, x.k k, y.k j
  from (select s.file_id, n, a, k from steps s join columns c on c.file_id = s.file_id where p is not null) x
  full join (select s.file_id, n, a, k from steps s join columns c on c.file_id = s.p) y on x.file_id = y.file_id and x.a = y.a
)
select file_id, old column_name, 'removed' change from met where now is null
union select file_id, now, 'added' from met where old is null
union select file_id, now, 'renamed' from met where now <> old
union select file_id, now, 'retyped' from met where k <> j""",
    "p5_values": _LINES_SQL + "select file_id, line_no, table_name, n column_name, v as value from (select file_id, line_no, table_name, unnest(names) n, unnest(f[1:len(names)]) v from judged where not bad) where v <> ''",
    "p5_found": _LINES_SQL + "select distinct file_id, line_no from judged where bad",
}


def _ingested_sql(name: str) -> str:
    """The typed table of ``name`` in SQL: the first filled value of each attribute, cast or rescued."""
    schema = SCHEMA[name]
    order = " ".join(f"when '{c}' then {i}" for i, c in enumerate(schema))
    kinds = " ".join(f"when '{c}' then '{k}'" for c, k in schema.items())

    def typed(column: str, kind: str) -> str:
        value = f"max(v) filter (where a = '{column}' and ok)"
        return f"try_cast({value} as double)" if kind == "double" else f"try_cast(regexp_replace({value}, '[.]0+$', '') as {kind})" if kind != "string" else value

    return (
        _LINES_SQL
        + r""", known as (select * from (values """
        + ", ".join(f"('{n}', '{a}')" for n, a in sorted(ATTRIBUTE.items()))
        + rf""") v(n, a)), entries as (
  select file_id, line_no, i, coalesce(a, n) a, trim(regexp_replace(v, '^\s+|\s+$', '', 'g')) v from (
    select file_id, line_no, unnest(range(1, len(names) + 1)) i, unnest(names) n, unnest(f[1:len(names)]) v from judged where not bad and table_name = '{name}') left join known using (n)
), firsts as (
  select *, case a {kinds} end k from (select *, row_number() over (partition by file_id, line_no, a order by i) rn from entries where v <> '') where rn = 1
), checked as (
  select *, case when k = 'string' then true when k = 'double' then regexp_full_match(v, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
    when k is not null then regexp_full_match(v, '[+-]?[0-9]+(\.0+)?') and case k when 'int' then try_cast(regexp_replace(v, '\.0+$', '') as int) is not null else try_cast(regexp_replace(v, '\.0+$', '') as bigint) is not null end
    else false end ok from firsts
), lines as (select file_id, line_no from judged where not bad and table_name = '{name}'),
typed as (
  select file_id, line_no, {', '.join(f'{typed(c, k)} {c}' for c, k in schema.items())},
    '{{' || string_agg('"' || a || '":' || to_json(v)::varchar, ',' order by coalesce(case when k is not null then case a {order} end end, -1), i) filter (where not ok) || '}}' _rescued
  from lines left join checked using (file_id, line_no) group by file_id, line_no
)
"""
    )


for _name in SCHEMA:
    SQL[f"p2_{_name}"] = _ingested_sql(_name) + "select * from typed"
SQL["p2_promoted"] = _ingested_sql("drug") + r"""
select file_id, line_no, report_id, drugname, case when regexp_full_match(dose, '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?') then dose::double end dose_amt,
  case when regexp_full_match(nda, '[+-]?[0-9]+(\.0+)?') then try_cast(regexp_replace(nda, '\.0+$', '') as bigint) end nda_num,
  case when left_over <> '{}' then left_over end _rescued
from (select *, _rescued->>'dose_amt' dose, _rescued->>'nda_num' nda,
    '{' || array_to_string(list_transform(list_filter(json_keys(coalesce(_rescued, '{}')), lambda k: not (
      k = 'dose_amt' and regexp_full_match(_rescued->>'dose_amt', '[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?')
      or k = 'nda_num' and regexp_full_match(_rescued->>'nda_num', '[+-]?[0-9]+(\.0+)?') and try_cast(regexp_replace(_rescued->>'nda_num', '\.0+$', '') as bigint) is not null)),
      lambda k: '"' || k || '":' || to_json(json_extract_string(_rescued, '$."' || k || '"'))::varchar), ',') || '}' left_over from typed)"""
