"""Queries of this subpackage over whole tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casemill.llm import canon, cooccur, mixing, pii, survivor, tokens
from casemill.session import cut
from casemill.sources.tables import table

#: Key of the surrogates; a deployment passes its own to ``pii.replaced``.
SURROGATE_KEY = "public test key"


def _canonical(spark: SparkSession, folder: str) -> DataFrame:
    fields = [
        ("drugname", table(spark, folder, "drug", "report_id", "drug_seq", "drugname")),
        ("prod_ai", table(spark, folder, "drug", "report_id", "drug_seq", "prod_ai")),
        ("ingredient", table(spark, folder, "drug_ingredients", "report_id", "drug_seq", "ingredient")),
    ]
    return canon.canonical(fields, table(spark, folder, "substances"), ["report_id", "drug_seq"])


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each free value with the substance it means, or -1."""
    return _canonical(spark, folder).select("field", "report_id", "drug_seq", "raw_value", "substance_id").distinct()


def p4_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The values that mean no substance, with the number of rows they stand in."""
    return _canonical(spark, folder).filter("substance_id = -1").groupBy("field", "raw_value").agg(F.count(F.lit(1)).alias("n_rows"))


def p6_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Every pair in at least five cases with its counts, lift and log-likelihood ratio."""
    got = cooccur.pairs(table(spark, folder, "case_drugs", "case_id", "ingredient"))
    return got.withColumn("lift", F.round("lift", 6)).withColumn("llr", F.round("llr", 4))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs in at least five cases and at least five times as often as by chance."""
    got = cooccur.above_chance(cooccur.pairs(table(spark, folder, "case_drugs", "case_id", "ingredient")))
    return got.select(F.col("item_a").alias("ingredient_a"), F.col("item_b").alias("ingredient_b"))


def p7_survivors(spark: SparkSession, folder: str) -> DataFrame:
    """One row per case, its gaps filled from the following dominance layers."""
    return survivor.survivors(table(spark, folder, "demo").drop("loaded_at"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """The row to keep of each case with two or more rows."""
    got = survivor.survivors(table(spark, folder, "demo").drop("loaded_at"), fill=[])
    return got.filter("n_rows >= 2").select("case_id", "report_id", "quarter")


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The token ids of every text."""
    return tokens.encoded(table(spark, folder, "documents", "doc_id", "text"))


def p8_roundtrip(spark: SparkSession, folder: str) -> DataFrame:
    """Every document decoded from its ids, and whether that gives the text back."""
    docs = table(spark, folder, "documents", "doc_id", "text").withColumn("original", F.coalesce("text", F.lit("")))
    back = tokens.decoded(tokens.encoded(docs, keep=["doc_id", "original"]))
    return back.select("doc_id", F.size("ids").alias("n_ids"), (F.col("text") == F.col("original")).alias("same"))


def _taken(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    targets = table(spark, folder, "mix_targets")
    docs = table(spark, folder, "documents", "doc_id", "source", "text").join(targets.select("source"), "source", "left_semi")
    sized = cut(tokens.counted(docs), "sizes")
    return mixing.selection(sized, targets), targets


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """The documents taken and how many times each."""
    return _taken(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """The reached share of tokens of each target source."""
    return mixing.shares(*_taken(spark, folder))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """The personal details in the documents, as written: those the surrogate operator replaces."""
    got = pii.replacements(table(spark, folder, "documents", "doc_id", "text"), SURROGATE_KEY)
    return got.filter("new is not null").select("doc_id", "kind", "span").distinct()


def p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with typed placeholders for personal details."""
    return pii.redacted(table(spark, folder, "documents", "doc_id", "text"))


def p10_surrogates(spark: SparkSession, folder: str) -> DataFrame:
    """The documents with keyed surrogates for personal details."""
    return pii.replaced(table(spark, folder, "documents", "doc_id", "text"), SURROGATE_KEY)


QUERIES = {
    "p4_found": p4_found,
    "p4_unmatched": p4_unmatched,
    "p6_pairs": p6_pairs,
    "p6_found": p6_found,
    "p7_survivors": p7_survivors,
    "p7_found": p7_found,
    "p8_ids": p8_ids,
    "p8_roundtrip": p8_roundtrip,
    "p9_mix": p9_mix,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_redacted": p10_redacted,
    "p10_surrogates": p10_surrogates,
}

_PAIRS_SQL = r"""
with rows as (
  select distinct case_id, trim(regexp_replace(upper(ingredient), '\s+', ' ', 'g')) item from case_drugs
  where case_id is not null and trim(regexp_replace(ingredient, '\s+', ' ', 'g')) <> ''
), one as (select item, count(*) n_item from rows group by item having count(*) >= 5),
total as (select count(distinct case_id) n from rows),
kept as (select rows.* from rows semi join one using (item)),
two as (
  select a.item item_a, b.item item_b, count(*) n_ab from kept a join kept b on a.case_id = b.case_id and a.item < b.item
  group by a.item, b.item having count(*) >= 5
), joined as (
  select item_a, item_b, n_ab, x.n_item n_a, y.n_item n_b, n from two join one x on item_a = x.item join one y on item_b = y.item, total
)
"""

SQL = {
    "p6_pairs": _PAIRS_SQL
    + """
select *, round(n_ab::double * n / (n_a::double * n_b), 6) lift, round(greatest(0, 2 * (
    h(n_ab) + h(n_a - n_ab) + h(n_b - n_ab) + h(n - n_a - n_b + n_ab) - h(n_a) - h(n - n_a) - h(n_b) - h(n - n_b) + h(n))), 4) llr from joined
""",
    "p6_found": _PAIRS_SQL + "select item_a ingredient_a, item_b ingredient_b from joined where n_ab::hugeint * n >= 5::hugeint * n_a * n_b",
    "p7_found": """
with ranked as (
  select case_id, report_id, quarter, count(*) over (partition by case_id) n,
    row_number() over (partition by case_id order by coalesce(try_cast(caseversion as bigint), -1) desc, quarter desc, report_id desc) rn
  from demo where case_id is not null
)
select case_id, report_id, quarter from ranked where rn = 1 and n >= 2
""",
}
# The fields of demo that completeness counts.
_FIELDS = "i_f_cod event_dt fda_dt rept_cod mfr_num mfr_sndr age age_cod sex wt wt_cod occp_cod reporter_country occr_country era".split()
_FILLED = {f: f"case when trim({f}) <> '' then {f} end" for f in _FIELDS}
SQL["p7_survivors"] = f"""
with recursive base as (
  select case_id k, coalesce(try_cast(caseversion as bigint), -1) v, coalesce(quarter, '') q, coalesce(report_id, -1) r, {' + '.join(f"(coalesce(trim({f}), '') <> '')::int" for f in _FIELDS)} c,
    {', '.join(f'{x} {f}' for f, x in _FILLED.items())} from demo where case_id is not null
), points as (select distinct k, v, q, c from base),
above as (
  select b.k, a.v av, a.q aq, a.c ac, b.v, b.q, b.c from points a join points b on a.k = b.k and a.v >= b.v and a.q >= b.q and a.c >= b.c and (a.v > b.v or a.q > b.q)
), deep as (
  select k, v, q, c, 1 layer from points
  union
  select x.k, x.v, x.q, x.c, d.layer + 1 from deep d join above x on x.k = d.k and x.av = d.v and x.aq = d.q and x.ac = d.c
), layers as (select k, v, q, c, max(layer) layer from deep group by all),
placed as (select base.*, layer from base join layers using (k, v, q, c)),
best as (select k, arg_max({{'r': r, 'q': q, 'v': v}}, (v, q, r)) filter (where layer = 1) b, count(*) n_rows, max(layer) n_layers,
    {', '.join(f'arg_max({f}, (-layer, v, q, r, {f})) filter (where {f} is not null) {f}' for f in _FIELDS)} from placed group by k)
select k case_id, nullif(b.r, -1) report_id, nullif(b.q, '') as quarter, nullif(b.v, -1) caseversion, {', '.join(_FIELDS)}, n_rows, n_layers from best
"""
_H = "case when ({0}) > 0 then ({0})::double * ln(({0})::double) else 0 end"
for _term in ("n_ab", "n_a - n_ab", "n_b - n_ab", "n - n_a - n_b + n_ab", "n_a", "n - n_a", "n_b", "n - n_b", "n"):
    SQL["p6_pairs"] = SQL["p6_pairs"].replace(f"h({_term})", _H.format(_term))
