"""Queries of the case, name, event, pair and screening operators, and their SQL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casemill.functions.ordinals import era_of, quarter_index, quarter_name
from casemill.functions.text import normalised
from casemill.operators import baskets as B
from casemill.operators import bounds, contingency, events, inference, names, resolve, screen, textref
from casemill.operators.lexicon import DOSE_UNITS, FORMS, SALT_COMPOUNDS, SALTS, UNITS
from casemill.session import cut
from casemill.sources.tables import table

# The event vocabulary of these queries (term, tier, concept); the last is not in the data.
TERMS = [
    ("MUSCLE WEAKNESS", "core", "WEAKNESS"),
    ("MUSCLE BLEEDING", "core", "BLEEDING"),
    ("MUSCLE PAIN", "broad", "PAIN"),
    ("MUSCLE SPASM", "broad", "SPASM"),
    ("MUSCLE MELTING", "core", "MELTING"),
]
# The strata of the era-stratified queries.
BINS = [("early", "2009q1", "2012q3"), ("middle", "2012q4", "2015q2"), ("late", "2015q3", "2018q4")]
MARKER_TERMS = ["CHEST PAIN", "CHEST DISCOMFORT"]
N_SCREEN, N_POOL, N_CONTROL, N_IMPLICATED, LEAST_PAIR = 200, 400, 6, 15, 3
SIZES = (100, 200, 400, 800)
CAP, CAPS = 20, (10, 15, 20, 30, 40, None)
ALPHAS = (0.1, 0.25, 0.5, 1.0, 2.0)
#: The share of the negative pool that may pass, and the decimals bounds and threshold are kept to,
#: so that no comparison hangs on the last digit.
TARGET, DECIMALS = 0.05, 6
#: Least co-reports and partners of the partner-anchored excess, and least co-reports of a ranked pair.
LEAST_PARTNERS, LEAST_RANKED = 2, 5
# Replicates of permutations and simulations, and of cluster bootstraps.
REPLICATES, RESAMPLES = 10_000, 20_000
FIRST, LAST = "2009q1", "2018q4"


class Base:
    """The frames most queries start from, built when asked for."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.kept: dict[tuple, DataFrame] = {}

    def t(self, name: str, *columns: str) -> DataFrame:
        return table(self.spark, self.folder, name, *columns)

    def withdrawn(self) -> DataFrame:
        return self.t("demo", "case_id", "rept_cod").filter("rept_cod = '5DAY' and case_id is not null").select("case_id")

    def left(self) -> DataFrame:
        return resolve.without(resolve.bridged(resolve.latest_versions(self.t("demo"))), self.withdrawn())

    def printed(self) -> DataFrame:
        return resolve.fingerprints(self.left(), self.t("drug", "era", "report_id", "drugname"), self.t("reac", "era", "report_id", "pt"))

    def once(self, key: tuple, make) -> DataFrame:
        """The frame ``make`` gives, written once per query and read from there however often it is used."""
        if key not in self.kept:
            self.kept[key] = cut(make(), str(key[0]))
        return self.kept[key]

    def cases(self) -> DataFrame:
        drug, reac = self.t("drug", "era", "report_id", "drugname"), self.t("reac", "era", "report_id", "pt")
        return self.once(("cases",), lambda: resolve.case_set(self.t("demo"), drug, reac, self.withdrawn()))

    def terms(self) -> DataFrame:
        return self.spark.createDataFrame(TERMS, "pt string, tier string, concept string")

    def found(self) -> DataFrame:
        return self.once(("found",), lambda: events.case_terms(self.t("reac", "era", "report_id", "pt"), self.cases(), self.terms()))

    def binned(self) -> DataFrame:
        """The cases with their era bin and sex key."""
        era_bin = F.lit(None).cast("string")
        for name, first, last in BINS:
            era_bin = F.when(F.col("quarter").between(first, last), name).otherwise(era_bin)
        sex = F.upper("sex")
        return self.cases().withColumn("era_bin", era_bin).withColumn("sex_key", F.when(sex.isin("F", "M"), sex))

    def raw(self, policy: str = "primary") -> DataFrame:
        items = self.t("drug_ingredients", "era", "report_id", "role_cod", "ingredient")
        return self.once(("raw", policy), lambda: B.raw_baskets(items, self.cases(), policy))

    def flags(self, cap: int | None = CAP, policy: str = "primary") -> DataFrame:
        keep = ("era_bin", "sex_key")
        made = lambda: B.population(self.binned(), events.case_events(self.found()), B.excluded_cases(self.raw(policy), cap), keep)
        return self.once(("flags", cap, policy), made)

    def rows(self, cap: int | None = CAP, policy: str = "primary", tier: str = "core") -> DataFrame:
        keep = ("era_bin", "sex_key")
        return self.once(("rows", cap, policy, tier), lambda: B.baskets(self.raw(policy), self.flags(cap, policy), tier, keep))

    def single(self) -> DataFrame:
        return self.once(("single",), lambda: B.marginals(self.rows()))

    def first(self, n: int) -> DataFrame:
        """The items most often seen with the event."""
        return B.top_items(self.single().filter("n_item_event > 0"), n)

    def counted(self, top: DataFrame) -> DataFrame:
        return B.with_margins(B.pair_counts(self.rows(), top, LEAST_PAIR, largest=CAP), self.single(), B.totals(self.flags()))

    def pairs(self) -> DataFrame:
        """The screened pairs with all their counts."""
        return self.once(("pairs",), lambda: self.counted(self.first(N_SCREEN)))

    def scored(self) -> DataFrame:
        """The screened pairs with scores and bounds, for the queries that need no threshold."""
        return self.once(("scored",), lambda: bound_of(contingency.with_strength(contingency.scored(self.pairs()))))

    def universe(self) -> DataFrame:
        """Pairs of the screen and of the pool, counted and scored once; ``screen`` and ``wide`` say whose they are."""

        def made() -> DataFrame:
            one = self.first(N_SCREEN).select("ingredient", F.lit(1).alias("s"), F.lit(0).alias("w"))
            two = B.top_items(self.single(), N_POOL, "n_item", 5).select("ingredient", F.lit(0).alias("s"), F.lit(1).alias("w"))
            items = cut(one.union(two).groupBy("ingredient").agg(F.max("s").alias("s"), F.max("w").alias("w")), "items")
            pairs = self.counted(items)
            for side in "ab":
                pairs = pairs.join(items.select(F.col("ingredient").alias(f"item_{side}"), F.col("s").alias(f"s_{side}"), F.col("w").alias(f"w_{side}")), f"item_{side}")
            pairs = pairs.withColumn("screen", (F.col("s_a") + F.col("s_b")) == 2).withColumn("wide", (F.col("w_a") + F.col("w_b")) == 2).drop("s_a", "s_b", "w_a", "w_b")
            return bound_of(contingency.with_strength(contingency.scored(cut(pairs.filter("screen or wide"), "universe_counts"))))

        return self.once(("universe",), made)

    def implicated(self) -> DataFrame:
        return self.once(("implicated",), lambda: self.first(N_IMPLICATED).select("ingredient"))

    def controls(self) -> DataFrame:
        """All pairs of the first items."""

        def made() -> DataFrame:
            names_ = self.first(N_CONTROL).agg(F.array_sort(F.collect_list("ingredient")).alias("x"))
            heads = names_.select("x", F.posexplode("x").alias("i", "item_a"))
            return heads.select("item_a", F.explode(F.slice("x", F.col("i") + 2, F.size("x"))).alias("item_b"))

        return self.once(("controls",), made)

    def pool(self) -> DataFrame:
        """The negative pool among the most frequent items."""
        made = lambda: screen.negative_pool(self.universe().filter("wide").drop("screen", "wide"), self.controls(), self.implicated(), 0.3, 2.0)
        return self.once(("pool",), made)

    def threshold(self) -> float:
        """The additive bound that one in twenty of the pool passes; 0 without a pool. A single value."""
        if ("threshold",) not in self.kept:
            found = screen.calibrated(self.pool(), TARGET, "omega_add_lower").select(F.round("threshold", DECIMALS)).first()[0]
            self.kept[("threshold",)] = 0.0 if found is None else found
        return self.kept[("threshold",)]

    def screened(self) -> DataFrame:
        """Scored pairs with their support band, and ``signal``: the bound is above the calibrated threshold."""

        def made() -> DataFrame:
            pairs = screen.annotated(self.universe().filter("screen").drop("screen", "wide"), self.controls(), self.implicated())
            return pairs.withColumn("signal", F.col("omega_add_lower") > self.threshold())

        return self.once(("screened",), made)

    def labels(self) -> tuple[DataFrame, DataFrame]:
        """(ingredient) of the items a label section is filed under, and (item_a, item_b): pairs of which one's label names the other."""

        def made() -> DataFrame:
            docs = self.t("documents", "doc_id", "text", "doc_type").filter("doc_type = 'label_section'")
            found = cut(textref.mentions(docs, self.t("substances", "name").withColumnRenamed("name", "term"), "doc_id"), "labels")
            first = found.groupBy("doc_id").agg(F.min("term").alias("ingredient"))
            return textref.gathered(found, first, "doc_id").select("ingredient", "term").unionByName(first.select("ingredient", F.lit(None).cast("string").alias("term")))

        kept = self.once(("label_texts",), made)
        return kept.select("ingredient").distinct(), textref.undirected(kept.filter("term is not null"))


def bound_of(scored: DataFrame) -> DataFrame:
    """``scored`` with both lower bounds, to ``DECIMALS``."""
    return bounds.bounded(scored).withColumns({c: F.round(c, DECIMALS) for c in ("omega_lower", "omega_add_lower")})


QUERIES: dict = {}
SQL: dict[str, str] = {}
BLOCKS: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of ``Base`` as a query, with its SQL over the blocks it names."""

    def add(f):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(Base(spark, folder))

        run.__doc__ = f.__doc__
        QUERIES[name] = run
        if sql is not None:
            SQL[name] = with_blocks(sql)
        return f

    return add


def with_blocks(sql: str) -> str:
    """``sql`` behind the blocks it uses, each once, in order of need; a ``with`` of its own comes after them."""
    order: list[str] = []

    def need(text: str) -> None:
        for name in BLOCKS:
            if name not in order and re.search(rf"\b{name}\b", text):
                need(BLOCKS[name])
                if name not in order:
                    order.append(name)

    need(sql)
    if not order:
        return sql
    own = sql.removeprefix("with ")
    return "with " + ", ".join(f"{n} as ({BLOCKS[n]})" for n in order) + (", " if own != sql else " ") + own


def _in(values) -> str:
    return ", ".join(f"'{v}'" for v in values)


def _r(x: str, digits: int = 6) -> str:
    return f"round({x}, {digits})"


# ---------------------------------------------------------------- blocks of SQL

_FACTOR = "case " + " ".join(f"when upper(trim(coalesce(age_cod, ''))) = '{u}' then {f!r}" for u, f in resolve.AGE_FACTORS.items()) + (
    " when trim(coalesce(age_cod, '')) = '' then 1.0 end"
)
_AGE = f"round(try_cast(age as double) * ({_FACTOR}), 1)"
BLOCKS["b_latest"] = f"""
  select era_group, case_id, report_id, quarter, era, event_dt, sex, age_years, country from (
    select *, row_number() over (partition by era_group, case_id order by version desc nulls last, report_id desc nulls last, quarter desc nulls last,
      era desc, event_dt desc, sex desc, age_years desc nulls last, country desc) rn
    from (select case when era = 'laers' then 'laers' else 'faers' end era_group, case_id, report_id, quarter, era,
      case when era <> 'laers' then try_cast(caseversion as bigint) end as version, coalesce(trim(event_dt), '') event_dt, coalesce(trim(sex), '') sex,
      {_AGE} age_years, coalesce(nullif(trim(occr_country), ''), nullif(trim(reporter_country), ''), '') country
      from demo where case_id is not null)) where rn = 1"""
BLOCKS["b_bridged"] = """
  select * exclude (rn) from (select *, row_number() over (partition by case_id order by era_group = 'laers', quarter desc nulls last) rn from b_latest) where rn = 1"""
BLOCKS["b_withdrawn"] = "select distinct case_id from demo where rept_cod = '5DAY' and case_id is not null"
BLOCKS["b_left"] = "select * from b_bridged anti join b_withdrawn using (case_id)"
BLOCKS["b_printed"] = """
  select c.*, d.s drug_set, r.s pt_set from b_left c
  left join (select era, report_id, list_sort(list(distinct upper(trim(drugname)))) s from drug where trim(drugname) <> '' group by all) d using (era, report_id)
  left join (select era, report_id, list_sort(list(distinct upper(trim(pt)))) s from reac where trim(pt) <> '' group by all) r using (era, report_id)"""
BLOCKS["b_unique"] = """
  select * from b_printed where not (event_dt <> '' and age_years is not null and drug_set is not null and pt_set is not null)
  union all
  select * from b_printed where case_id in (select min(case_id) from b_printed
    where event_dt <> '' and age_years is not null and drug_set is not null and pt_set is not null
    group by event_dt, sex, age_years, country, drug_set, pt_set)"""
BLOCKS["b_cases"] = """
  select case_id, report_id, era, quarter, event_dt, sex, age_years, country from (
    select *, row_number() over (partition by era, report_id order by quarter desc nulls last, case_id desc) rn from b_unique) where rn = 1"""
BLOCKS["b_terms"] = "select * from (values " + ", ".join(f"('{p}', '{t}', '{c}')" for p, t, c in TERMS) + ") v(pt, tier, concept)"
BLOCKS["b_found"] = """
  select c.case_id, c.era, c.report_id, c.quarter, e.pt, e.concept, e.tier from reac r join b_terms e on e.pt = upper(trim(r.pt))
  join b_cases c on c.era = r.era and c.report_id = r.report_id"""
BLOCKS["b_events"] = "select case_id, bool_or(tier = 'core') is_core, true is_broad, list_sort(list(distinct concept)) concepts from b_found group by case_id"
BLOCKS["b_raw"] = f"""
  select distinct c.case_id, upper(trim(d.ingredient)) ingredient from drug_ingredients d join b_cases c using (era, report_id)
  where upper(trim(d.role_cod)) in ({_in(B.ROLES['primary'])}) and trim(d.ingredient) <> ''"""
BLOCKS["b_over"] = "select case_id from b_raw group by case_id having count(*) > 20"
BLOCKS["b_flags"] = """
  select case_id, quarter, sex, coalesce(is_core, false) is_core, coalesce(is_broad, false) is_broad from b_cases left join b_events using (case_id) anti join b_over using (case_id)"""
BLOCKS["b_rows"] = "select r.case_id, r.ingredient, f.is_core event from b_raw r join b_flags f using (case_id)"
BLOCKS["b_single"] = "select ingredient, count(*) n_item, count(*) filter (where event) n_item_event from b_rows group by 1"
BLOCKS["b_total"] = "select count(*) n_total, count(*) filter (where is_core) n_event from b_flags"
BLOCKS["b_top"] = f"select ingredient from b_single where n_item_event > 0 order by n_item_event desc, ingredient limit {N_SCREEN}"
BLOCKS["b_implicated"] = f"select ingredient from b_single where n_item_event > 0 order by n_item_event desc, ingredient limit {N_IMPLICATED}"
BLOCKS["b_first"] = f"select ingredient from b_single where n_item_event > 0 order by n_item_event desc, ingredient limit {N_CONTROL}"
BLOCKS["b_controls"] = "select a.ingredient item_a, b.ingredient item_b from b_first a join b_first b on a.ingredient < b.ingredient"


def _pairs(top: str) -> str:
    return f"""
  select p.*, x.n_item n_a, x.n_item_event n_az, y.n_item n_b, y.n_item_event n_bz, n_total, n_event from (
    select a.ingredient item_a, b.ingredient item_b, count(*) n_ab, count(*) filter (where a.event) n_abz
    from b_rows a join b_rows b on a.case_id = b.case_id and a.ingredient < b.ingredient
    where a.ingredient in (select ingredient from {top}) and b.ingredient in (select ingredient from {top})
    group by 1, 2 having count(*) >= {LEAST_PAIR}) p
  join b_single x on x.ingredient = item_a join b_single y on y.ingredient = item_b, b_total"""


_ROOT = """list_reduce(list_transform(range(61), lambda i: {'lo': greatest(0, n_ab + n_az - n_a, n_ab + n_bz - n_b, n_az + n_bz - n_event)::double,
      'hi': greatest(greatest(0, n_ab + n_az - n_a, n_ab + n_bz - n_b, n_az + n_bz - n_event), least(n_ab, n_az, n_bz, n_total - n_a - n_b - n_event + n_ab + n_az + n_bz))::double}),
    lambda s, i: case when ((s.lo + s.hi) / 2) * (n_a - n_ab - n_az + (s.lo + s.hi) / 2) * (n_b - n_ab - n_bz + (s.lo + s.hi) / 2) * (n_event - n_az - n_bz + (s.lo + s.hi) / 2)
      < (n_ab - (s.lo + s.hi) / 2) * (n_az - (s.lo + s.hi) / 2) * (n_bz - (s.lo + s.hi) / 2) * (n_total - n_a - n_b - n_event + n_ab + n_az + n_bz - (s.lo + s.hi) / 2)
      then {'lo': (s.lo + s.hi) / 2, 'hi': s.hi} else {'lo': s.lo, 'hi': (s.lo + s.hi) / 2} end)"""


def _gamma(x: str, a: str) -> str:
    """P(a, x), the distribution function of the gamma law, by its series; ``x`` is given as its logarithm."""
    return f"list_sum(list_transform(range(400), lambda k: exp(({a} + k) * {x} - exp({x}) - lgamma({a} + k + 1))))"


def _gamma_quantile(q: float, a: str) -> str:
    """The quantile of the gamma law of shape ``a``, by halving its logarithm."""
    half = "((s.lo + s.hi) / 2)"
    return (
        f"exp(list_reduce(list_transform(range(61), lambda i: {{'lo': -60.0::double, 'hi': ln({a} + 10 * sqrt({a}) + 20)}}), "
        f"lambda s, i: case when {_gamma(half, a)} < {q} then {{'lo': {half}, 'hi': s.hi}} else {{'lo': s.lo, 'hi': {half}}} end).lo)"
    )


def _beta(x: str, a: str, b: str) -> str:
    """I_x(a, b), the distribution function of the beta law, by its series."""
    return f"list_sum(list_transform(range(4000), lambda k: exp(({a} + k) * ln({x}) + {b} * ln(1 - {x}) + lgamma({a} + {b} + k) - lgamma({a} + k + 1) - lgamma({b}))))"


def _beta_quantile(q: float, a: str, b: str) -> str:
    half = "((t.lo + t.hi) / 2)"
    return (
        f"list_reduce(list_transform(range(61), lambda i: {{'lo': 0.0::double, 'hi': 1.0::double}}), "
        f"lambda t, i: case when {_beta(half, a, b)} < {q} then {{'lo': {half}, 'hi': t.hi}} else {{'lo': t.lo, 'hi': {half}}} end).lo"
    )


def _jeffreys(k: str, n: str) -> tuple[str, str]:
    low = f"case when {n} > 0 then case when {k} = 0 then 0.0 else {_beta_quantile(0.025, f'({k} + 0.5)', f'({n} - {k} + 0.5)')} end end"
    high = f"case when {n} > 0 then case when {k} = {n} then 1.0 else {_beta_quantile(0.975, f'({k} + 0.5)', f'({n} - {k} + 0.5)')} end end"
    return low, high


BLOCKS["b_most"] = "select range n_abz from range(0, (select coalesce(max(n_item_event), 0) + 1 from (select count(*) filter (where tier in ('core', 'broad')) n_item_event from b_raw join b_found using (case_id) group by ingredient)))"
BLOCKS["b_gamma"] = f"select n_abz, {_gamma_quantile(0.025, '(n_abz + 0.5)')} g_low, {_gamma_quantile(0.975, '(n_abz + 0.5)')} g_high from b_most"


def _scored(pairs: str) -> str:
    return f"""
  select * exclude (g_low, g_high), log2((n_abz + 0.5) / (expected + 0.5)) omega, log2((n_abz + 0.5) / (additive_expected + 0.5)) omega_add,
    log2((n_abz + 0.5) / (naive_expected + 0.5)) naive_log2_oe, log2(rr_a * rr_b) strength,
    {_r('log2(g_low / (expected + 0.5))', DECIMALS)} omega_lower, {_r('log2(g_low / (additive_expected + 0.5))', DECIMALS)} omega_add_lower from (
  select *, case when n_a > 0 and n_b > 0 and n_event > 0 then (root.lo + root.hi) / 2 end expected,
    least(greatest(n_az / n_a + n_bz / n_b - n_event / n_total, n_az / n_a, n_bz / n_b), 1.0) * n_ab additive_expected,
    n_a::double * n_b * n_event / (n_total::double * n_total) naive_expected,
    case when n_az > 0 then (n_az / n_a) / (n_event / n_total) end rr_a, case when n_bz > 0 then (n_bz / n_b) / (n_event / n_total) end rr_b
  from (select *, {_ROOT} root from {pairs})) join b_gamma using (n_abz)"""


def _annotated(scored: str) -> str:
    return f"""
  select *, case when is_control then 'positive_control' when n_implicated = 2 then 'known_pair' when n_implicated = 1 then 'plausible' else 'unsupported' end support
  from (select s.*, c.item_a is not null is_control, (s.item_a in (select ingredient from b_implicated))::int + (s.item_b in (select ingredient from b_implicated))::int n_implicated
    from {scored} s left join b_controls c on c.item_a = s.item_a and c.item_b = s.item_b)"""


BLOCKS["b_pairs"] = _pairs("b_top")
BLOCKS["b_scored"] = _scored("b_pairs")
BLOCKS["b_banded"] = _annotated("b_scored")
BLOCKS["b_screen"] = "select *, omega_add_lower > (select t from b_threshold) signal from b_banded"
BLOCKS["b_wide"] = f"select ingredient from b_single where n_item >= 5 order by n_item desc, ingredient limit {N_POOL}"
BLOCKS["b_widepairs"] = _pairs("b_wide")
BLOCKS["b_widescored"] = _scored("b_widepairs")
BLOCKS["b_widemarked"] = _annotated("b_widescored")
BLOCKS["b_pool"] = """
  select *, case when greatest(coalesce(rr_a, 0), coalesce(rr_b, 0)) >= 2.0 then 'hard' else 'easy' end stratum from b_widemarked m
  where not is_control and n_implicated < 2 and exists (select 1 from b_widemarked c where c.is_control and abs(log10(c.n_ab) - log10(m.n_ab)) <= 0.3)"""

BLOCKS["b_threshold"] = f"select coalesce({_r(f'quantile_cont(omega_add_lower, {1 - TARGET})', DECIMALS)}, 0) t from b_pool"

BLOCKS["b_label_hits"] = r"""
  select doc_id, name term from (select doc_id, upper(text) t from documents where doc_type = 'label_section' and text is not null) join (select distinct upper(trim(name)) name from substances) on contains(t, name)
  where length(name) >= 5 and regexp_matches(t, '(^|[^\p{L}\p{N}_])' || regexp_escape(name) || '($|[^\p{L}\p{N}_])')"""
BLOCKS["b_label_first"] = "select doc_id, min(term) ingredient from b_label_hits group by 1"
BLOCKS["b_labelled"] = "select distinct ingredient from b_label_first"
BLOCKS["b_label_pairs"] = "select distinct least(ingredient, term) item_a, greatest(ingredient, term) item_b from b_label_hits join b_label_first using (doc_id) where term <> ingredient"

# ---------------------------------------------------------------- ordinals and cases


@query(
    "quarter_axis",
    "select distinct quarter, substr(quarter, 1, 4)::int * 4 + substr(quarter, 6, 1)::int - 1 quarter_idx, "
    "case when quarter <= '2012q3' then 'laers' when quarter <= '2014q2' then 'faers_early' else 'faers_modern' end era_of_quarter, quarter round_trip from demo",
)
def quarter_axis(b: Base) -> DataFrame:
    """Every quarter of demo with its index, its era and back."""
    q = b.t("demo", "quarter").distinct()
    got = q.withColumn("quarter_idx", quarter_index(F.col("quarter"))).withColumn("era_of_quarter", era_of(F.col("quarter")))
    return got.withColumn("round_trip", quarter_name(F.col("quarter_idx")))


@query("age_units", f"select distinct report_id, quarter, age, age_cod, {_AGE} age_years from demo")
def age_units(b: Base) -> DataFrame:
    """Coded ages in years."""
    return b.t("demo").select("report_id", "quarter", "age", "age_cod", resolve.age_years(F.col("age"), F.col("age_cod")).alias("age_years")).distinct()


@query("latest_version", "select * from b_latest")
def latest_version(b: Base) -> DataFrame:
    """The current report of each case in each id space."""
    return resolve.latest_versions(b.t("demo")).drop("rank")


@query("bridge", "select case_id, report_id, era, quarter from b_bridged")
def bridge(b: Base) -> DataFrame:
    """One row per case over both id spaces."""
    return resolve.bridged(resolve.latest_versions(b.t("demo"))).select("case_id", "report_id", "era", "quarter")


@query("withdrawn_anti", "select case_id, report_id from b_left")
def withdrawn_anti(b: Base) -> DataFrame:
    """Cases that were not withdrawn."""
    return b.left().select("case_id", "report_id")


@query("near_dup_survivors", "select case_id from b_unique")
def near_dup_survivors(b: Base) -> DataFrame:
    """Cases left after near-duplicates (E5)."""
    return resolve.without_near_duplicates(b.printed()).select("case_id")


@query("one_per_report", "select * from b_cases")
def one_per_report(b: Base) -> DataFrame:
    """The final case set."""
    return b.cases()


@query(
    "attrition",
    " union all ".join(
        f"select '{s}' stage, count(*) cases_remaining from {t}"
        for s, t in [
            ("0_rows", "demo"), ("1_within_laers", "b_latest where era_group = 'laers'"), ("2_within_faers", "b_latest where era_group = 'faers'"),
            ("3_bridge", "b_bridged"), ("4_withdrawn", "b_left"), ("5_near_duplicates", "b_unique"), ("6_one_per_report", "b_cases"),
        ]
    ),
)
def attrition(b: Base) -> DataFrame:
    """Cases after each step."""
    return resolve.attrition(b.t("demo"), b.t("drug"), b.t("reac"), b.withdrawn())


@query(
    "dup_rule_sensitivity",
    "select (coalesce(sum(n) - count(*), 0))::bigint removed, coalesce(max(n), 0) largest_group from (select count(*) n from b_printed "
    "where event_dt <> '' and drug_set is not null and pt_set is not null group by event_dt, sex, age_years, country, drug_set, pt_set)",
)
def dup_rule_sensitivity(b: Base) -> DataFrame:
    """What a looser duplicate rule would remove."""
    return resolve.duplicate_rule(b.printed(), resolve.REQUIRED_LOOSE)


@query(
    "union_by_name",
    "select 'demo' source, report_id, quarter, caseversion, null pt from demo union all select 'reac', report_id, quarter, null, pt from reac",
)
def union_by_name(b: Base) -> DataFrame:
    """Tables of different columns united by name."""
    one = b.t("demo", "report_id", "quarter", "caseversion").withColumn("source", F.lit("demo"))
    two = b.t("reac", "report_id", "quarter", "pt").withColumn("source", F.lit("reac"))
    return one.unionByName(two, allowMissingColumns=True).select("source", "report_id", "quarter", "caseversion", "pt")


# ---------------------------------------------------------------- names

_NORM = r"trim(regexp_replace(upper({0}), '\s+', ' ', 'g'))"
_UNITS_RE = "|".join(u for u in DOSE_UNITS if u != "%")
_RELAX = (
    r"array_to_string(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(upper({0}), '\([^)]*\)', ' ', 'g'), "
    rf"'\b[0-9]+(?:[.,][0-9]+)?\s*(?:{_UNITS_RE}|%)\b(?:\s*/\s*\S+)?', ' ', 'g'), '[^A-Z0-9 ]+', ' ', 'g'), ' '), "
    + "lambda t: t <> '' and t not in ("
    + _in(sorted({*FORMS, *UNITS})).replace("{", "{{")
    + ") and not regexp_full_match(t, '[0-9]+')), ' ')"
)
BLOCKS["b_named"] = f"""
  select era, report_id, drug_seq, upper(trim(role_cod)) role_cod, coalesce(trim(drugname), '') drugname, coalesce(trim(prod_ai), '') prod_ai,
    {_NORM.format("coalesce(trim(drugname), '')")} name_key, {_RELAX.format("coalesce(trim(drugname), '')")} relaxed_key
  from drug where trim(coalesce(drugname, '')) <> '' or trim(coalesce(prod_ai, '')) <> ''"""
for _key, _name in (("name_key", "b_exact"), ("relaxed_key", "b_loose")):
    BLOCKS[_name] = f"""
  select {_key}, prod_ai ai from (select {_key}, prod_ai, row_number() over (partition by {_key} order by count(*) desc, prod_ai) rn
    from b_named where prod_ai <> '' and {_key} <> '' group by {_key}, prod_ai) where rn = 1"""
BLOCKS["b_ladder"] = """
  select era, report_id, drug_seq, role_cod, drugname,
    case when prod_ai <> '' then 1 when e.ai is not null then 2 when r.ai is not null then 3 else 4 end resolution_level,
    coalesce(nullif(prod_ai, ''), e.ai, r.ai, nullif(relaxed_key, ''), name_key) ingredient_raw
  from b_named left join b_exact e using (name_key) left join b_loose r using (relaxed_key)"""


@query("name_normalise", f"select distinct drugname, {_NORM.format('drugname')} name_key from drug")
def name_normalise(b: Base) -> DataFrame:
    """The exact key of every name."""
    return b.t("drug", "drugname").distinct().withColumn("name_key", normalised(F.col("drugname")))


@query("name_relax", f"select distinct drugname, {_RELAX.format('drugname')} relaxed_key from drug where drugname is not null")
def name_relax(b: Base) -> DataFrame:
    """The relaxed key of every name."""
    return b.t("drug", "drugname").filter("drugname is not null").distinct().withColumn("relaxed_key", names.relaxed(F.col("drugname")))


_WORDS = "list_filter(string_split(regexp_replace(upper({0}), '[^A-Z0-9 ]+', ' ', 'g'), ' '), lambda t: t <> '')"
_STRIP = (  # the fewest words whose rest are salts, with no compound beyond them
    "coalesce(array_to_string(w[1:list_min(list_filter(range(1, len(w) + 1), lambda k: len(list_filter(w[k + 1:], lambda t: t not in (" + _in(SALTS) + "))) = 0 "
    "and len(list_filter(range(k + 1, len(w) + 1), lambda j: array_to_string(w[1:j], ' ') in (" + _in(SALT_COMPOUNDS) + "))) = 0))], ' '), '')"
)


@query("strip_suffix", f"select ingredient, {_STRIP} stripped from (select distinct ingredient, {_WORDS.format('ingredient')} w from drug_ingredients where ingredient is not null)")
def strip_suffix(b: Base) -> DataFrame:
    """Every ingredient without salt words."""
    return b.t("drug_ingredients", "ingredient").filter("ingredient is not null").distinct().withColumn("stripped", names.without_salts(F.col("ingredient")))


@query("backfill_exact", "select name_key, ai prod_ai from b_exact")
def backfill_exact(b: Base) -> DataFrame:
    """The majority canonical name of each exact key."""
    rows = b.t("drug").select(normalised(F.trim("drugname")).alias("name_key"), F.coalesce(F.trim("prod_ai"), F.lit("")).alias("prod_ai"))
    return names.majority(rows, "name_key", "prod_ai")


@query("resolution_ladder", "select * from b_ladder")
def resolution_ladder(b: Base) -> DataFrame:
    """Every drug row with the level it resolves at."""
    return names.resolved(b.t("drug"))


@query(
    "combo_split",
    f"""select era, report_id, drug_seq, role_cod, resolution_level, ingredient from (select *, {_STRIP} ingredient from (
      select *, {_WORDS.format('part')} w from (select *, unnest(string_split(ingredient_raw, chr(92))) part from b_ladder))) where ingredient <> ''""",
)
def combo_split(b: Base) -> DataFrame:
    """Combinations split and salts taken off."""
    return names.ingredients(names.resolved(b.t("drug")))


@query(
    "coverage_by_era",
    f"select era, count(*) drug_rows, count(*) filter (where resolution_level <= 3) resolved_rows, {_r('avg((resolution_level <= 3)::int)')} share from b_ladder group by era",
)
def coverage_by_era(b: Base) -> DataFrame:
    """Rows resolved to an ingredient by era."""
    return names.coverage(names.resolved(b.t("drug")))


@query(
    "entity_coverage",
    """select n.name, coalesce(reports, 0) reports, coalesce(item_rows, 0) item_rows, coalesce(v, 0) unmerged_variants,
      case when coalesce(reports, 0) > 0 then 'OK' else 'MISSING' end status
    from (select distinct name from substances) n
    left join (select ingredient, count(*) item_rows, count(distinct era || '|' || report_id) reports from drug_ingredients group by 1) i on i.ingredient = n.name
    left join (select name, count(distinct ingredient) v from substances join drug_ingredients on starts_with(ingredient, name || ' ') group by 1) v on v.name = n.name""",
)
def entity_coverage(b: Base) -> DataFrame:
    """How often each reference name is found, and its variants."""
    return names.entity_coverage(b.t("drug_ingredients", "era", "report_id", "ingredient").filter("ingredient is not null"), b.t("substances", "name"))


@query(
    "annotation_agreement",
    f"""select count(*) names_examined, coalesce(sum(n), 0)::bigint rows_examined, {_r('sum(top) / sum(n)')} modal_agreement,
      count(*) filter (where n = top) names_unanimous, {_r('count(*) filter (where n = top) / count(*)')} fraction_unanimous
    from (select sum(n) n, max(n) top from (select upper(trim(drugname)) d, upper(trim(prod_ai)) a, count(*) n from drug
      where trim(prod_ai) <> '' and trim(drugname) <> '' group by 1, 2) group by d having sum(n) >= 20)""",
)
def annotation_agreement(b: Base) -> DataFrame:
    """Agreement of the canonical names of one verbatim name."""
    return names.annotation_agreement(b.t("drug", "drugname", "prod_ai"))


# ---------------------------------------------------------------- events


@query(
    "pt_vocabulary",
    "select upper(trim(pt)) pt, count(distinct era || '|' || report_id) reports, min(quarter) first_quarter, max(quarter) last_quarter, count(distinct quarter) n_quarters "
    "from reac where trim(pt) <> '' group by 1",
)
def pt_vocabulary(b: Base) -> DataFrame:
    """The terms of the data with their reports and quarters."""
    return events.vocabulary(b.t("reac"))


@query(
    "term_check",
    "select t.pt, tier, concept, count(distinct era || '|' || report_id) reports, case when count(r.pt) > 0 then 'OK' else 'NOT_FOUND' end status "
    "from b_terms t left join reac r on upper(trim(r.pt)) = t.pt group by all",
)
def term_check(b: Base) -> DataFrame:
    """Every curated term and whether the data have it."""
    return events.verified(b.terms(), events.vocabulary(b.t("reac")))


@query("event_flags", "select case_id, is_core, is_broad, array_to_string(concepts, ';') concepts from b_events")
def event_flags(b: Base) -> DataFrame:
    """Cases with the event."""
    return events.case_events(b.found()).withColumn("concepts", F.array_join("concepts", ";"))


@query(
    "alternate_event",
    "select case_id, coalesce(x, false) is_event from b_cases left join (select c.case_id, true x from reac r join b_cases c using (era, report_id) "
    "where upper(trim(r.pt)) in ('JOINT PAIN', 'JOINT SWELLING') group by 1) using (case_id)",
)
def alternate_event(b: Base) -> DataFrame:
    """Flags of the whole population for another event definition."""
    cases = b.cases()
    terms = b.spark.createDataFrame([("JOINT PAIN", "core", "J"), ("JOINT SWELLING", "core", "J")], "pt string, tier string, concept string")
    found = events.case_events(events.case_terms(b.t("reac", "era", "report_id", "pt"), cases, terms))
    return cases.select("case_id").join(found.select("case_id", "is_core"), "case_id", "left").select("case_id", F.coalesce("is_core", F.lit(False)).alias("is_event"))


@query(
    "continuity_breaks",
    """select concept, min(quarter) filter (where n > 0) first_quarter, max(quarter) filter (where n > 0) last_quarter, count(*) filter (where n > 0) quarters_present,
      sum(n)::bigint total_reports, coalesce(string_agg(quarter, ';' order by quarter) filter (where broken), '') break_quarters,
      case when count(*) filter (where broken) = 0 then 'PASS' else 'BREAK' end status
    from (select *, n = 0 and i >= start + 4 and avg(n) over (partition by concept order by i rows between 4 preceding and 1 preceding) >= 1.0 broken from (
      select c.concept, c.start, i, (i // 4)::varchar || 'q' || (i % 4 + 1) as quarter, coalesce(s.n, 0) n
      from (select concept, min(substr(quarter, 1, 4)::int * 4 + substr(quarter, 6, 1)::int - 1) start from b_found group by 1) c
      join range(2009 * 4, 2018 * 4 + 4) t(i) on i >= start
      left join (select concept, quarter, count(distinct case_id) n from b_found group by 1, 2) s on s.concept = c.concept and s.quarter = (i // 4)::varchar || 'q' || (i % 4 + 1)))
    group by concept""",
)
def continuity_breaks(b: Base) -> DataFrame:
    """Breaks in the quarterly series of each concept."""
    return events.continuity(b.found(), FIRST, LAST, 1.0)


@query(
    "pt_jaccard",
    f"""select count(*) filter (where a) n_one, count(*) filter (where b) n_two, count(*) filter (where a and b) n_both,
      {_r('count(*) filter (where a and b) / count(*)')} jaccard, {_r('count(*) filter (where a and b) / count(*) filter (where a)')} recall
    from (select pt, bool_or(k = 1) a, bool_or(k = 2) b from (select pt, 1 k from b_terms union all
      select distinct upper(trim(pt)), 2 from reac where regexp_matches(upper(trim(pt)), 'MUSCLE')) group by pt)""",
)
def pt_jaccard(b: Base) -> DataFrame:
    """The curated terms against those a pattern picks."""
    return events.set_agreement(b.terms(), events.mechanical(events.vocabulary(b.t("reac")), "MUSCLE"))


# ---------------------------------------------------------------- baskets and pairs


@query("baskets_capped", "select case_id, ingredient, event from b_rows")
def baskets_capped(b: Base) -> DataFrame:
    """Items per case, large cases left out."""
    return b.rows().select("case_id", "ingredient", "event")


@query(
    "baskets_context",
    "select case_id, ingredient from b_raw where case_id not in (select case_id from b_over) and case_id not in (select case_id from b_raw where ingredient in (select ingredient from b_first))",
)
def baskets_context(b: Base) -> DataFrame:
    """Baskets without the cases that hold a context item."""
    rows, context = b.rows(), b.first(N_CONTROL)
    held = rows.join(context.select("ingredient"), "ingredient", "left_semi").select("case_id").distinct()
    return rows.join(held, "case_id", "left_anti").select("case_id", "ingredient")


@query("exclusion_union", "select case_id from b_over union select case_id from b_raw where ingredient in (select ingredient from b_first)")
def exclusion_union(b: Base) -> DataFrame:
    """Excluded cases: too many items, or a context item."""
    raw, context = b.raw(), b.first(N_CONTROL)
    return B.excluded_cases(raw, 20).union(raw.join(context.select("ingredient"), "ingredient", "left_semi").select("case_id")).distinct()


@query("population", "select case_id, is_core, is_broad from b_flags")
def population(b: Base) -> DataFrame:
    """The denominator, cases without items included."""
    return b.flags().select("case_id", "is_core", "is_broad")


@query("totals", "select * from b_total")
def totals(b: Base) -> DataFrame:
    """Cases and event cases."""
    return B.totals(b.flags())


@query("marginals", "select * from b_single")
def marginals(b: Base) -> DataFrame:
    """Cases and event cases of each item."""
    return b.single()


@query("pair_counts", f"select item_a, item_b, n_ab, n_abz from ({_pairs('b_single')})")
def pair_counts(b: Base) -> DataFrame:
    """Counts of all pairs of items (C4)."""
    return B.pair_counts(b.rows(), None, LEAST_PAIR)


@query("top_items", f"select ingredient, n_item, n_item_event from b_single where n_item_event > 0 order by n_item_event desc, ingredient limit {N_SCREEN}")
def top_items(b: Base) -> DataFrame:
    """The items most often seen with the event (O1)."""
    return b.first(N_SCREEN)


@query("top_items_by_volume", f"select ingredient, n_item, n_item_event from b_single where n_item >= 5 order by n_item desc, ingredient limit {N_POOL}")
def top_items_by_volume(b: Base) -> DataFrame:
    """The most frequent items (O2, O3)."""
    return B.top_items(b.single(), N_POOL, "n_item", 5)


_COUNTS = "item_a, item_b, n_ab, n_abz, n_a, n_az, n_b, n_bz, n_event, n_total"


@query(
    "cells_2x2x2",
    """select item_a, item_b, n_abz::double c111, (n_ab - n_abz)::double c110, (n_az - n_abz)::double c101, (n_a - n_ab - n_az + n_abz)::double c100,
      (n_bz - n_abz)::double c011, (n_b - n_ab - n_bz + n_abz)::double c010, (n_event - n_az - n_bz + n_abz)::double c001,
      (n_total - n_a - n_b - n_event + n_ab + n_az + n_bz - n_abz)::double c000, false negative_cell from b_pairs""",
)
def cells_2x2x2(b: Base) -> DataFrame:
    """The eight cells of each pair."""
    return contingency.with_cells(b.pairs()).select("item_a", "item_b", *contingency.cells(), "negative_cell")


def _column(name: str, digits: int = 6):
    def make(b: Base) -> DataFrame:
        return b.scored().select("item_a", "item_b", F.round(name, digits).alias(name))

    make.__doc__ = f"The column {name} of each screened pair."
    return make


for _q, _c in {
    "expected_no3way": "expected", "omega_point": "omega", "expected_additive": "additive_expected", "omega_add_point": "omega_add", "naive_oe": "naive_log2_oe",
}.items():
    query(_q, f"select item_a, item_b, {_r(_c)} {_c} from b_scored")(_column(_c))


@query("expected_closed_form", f"select item_a, item_b, {_r('n_ab::double * n_az * n_bz / (n_a::double * n_b * n_event) * n_total')} expected_closed from b_pairs")
def expected_closed_form(b: Base) -> DataFrame:
    """The product formula."""
    return b.pairs().select("item_a", "item_b", F.round(contingency.expected_closed_form(), 6).alias("expected_closed"))


@query("marginal_rr", f"select item_a, item_b, {_r('rr_a')} rr_a, {_r('rr_b')} rr_b, {_r('strength')} strength from b_scored")
def marginal_rr(b: Base) -> DataFrame:
    """Relative risks of both items and their joint strength (C17)."""
    return b.scored().select("item_a", "item_b", *(F.round(c, 6).alias(c) for c in ("rr_a", "rr_b", "strength")))


@query("score", f"select {_COUNTS}, {_r('expected')} expected, {_r('additive_expected')} additive_expected, {_r('omega')} omega, {_r('omega_add')} omega_add from b_scored")
def score(b: Base) -> DataFrame:
    """All counts and point scores of the screened pairs (C14)."""
    names_ = [c.strip() for c in _COUNTS.split(",")]
    return b.scored().select(*names_, *(F.round(c, 6).alias(c) for c in ("expected", "additive_expected", "omega", "omega_add")))


@query("omega_lower", "select item_a, item_b, n_abz, omega_lower, omega_add_lower from b_scored")
def omega_lower(b: Base) -> DataFrame:
    """Lower credibility bounds under both nulls."""
    return b.scored().select("item_a", "item_b", "n_abz", "omega_lower", "omega_add_lower")


@query("omega_interval", f"select item_a, item_b, {_r('log2(g_low / (expected + 0.5))')} as low, {_r('log2(g_high / (expected + 0.5))')} as high from b_scored join b_gamma using (n_abz)")
def omega_interval(b: Base) -> DataFrame:
    """Both ends of the credibility interval."""
    n, e = F.col("n_abz"), F.col("expected")
    return b.scored().select("item_a", "item_b", *(F.round(bounds.log_ratio_bound(n, e, q), DECIMALS).alias(c) for c, q in (("low", 0.025), ("high", 0.975))))


@query(
    "alpha_sweep",
    f"select item_a, item_b, alpha, {_r('log2(g / (additive_expected + alpha))')} as lower from b_scored join ("
    + " union all ".join(f"select n_abz, {a}::double alpha, {_gamma_quantile(0.025, f'(n_abz + {a})')} g from b_most" for a in ALPHAS)
    + ") using (n_abz)",
)
def alpha_sweep(b: Base) -> DataFrame:
    """The additive bound for several shrinkage constants."""
    n, e = F.col("n_abz"), F.col("additive_expected")
    each = F.array(*(F.struct(F.lit(a).alias("alpha"), F.round(bounds.log_ratio_bound(n, e, 0.025, a), DECIMALS).alias("lower")) for a in ALPHAS))
    return b.scored().select("item_a", "item_b", F.explode(each).alias("x")).select("item_a", "item_b", "x.*")


BLOCKS["b_rates"] = """
  select item, partner, n_abz / n_ab rate from (select item_a item, item_b partner, n_ab, n_abz from b_pairs union all select item_b, item_a, n_ab, n_abz from b_pairs) where n_ab >= 3"""


@query(
    "partner_median_excess",
    f"""select item_a, item_b, {_r('case when count(e) = 2 then min(e) end')} partner_excess from (
      select p.item_a, p.item_b, case when count(r.rate) >= {LEAST_PARTNERS} then log2((p.n_abz + 0.5) / (p.n_ab * median(r.rate) + 0.5)) end e
      from (select *, item_a item, item_b partner from b_pairs union all select *, item_b, item_a from b_pairs) p
      left join b_rates r on r.item = p.item and r.partner <> p.partner group by p.item_a, p.item_b, p.item, p.n_abz, p.n_ab) group by 1, 2""",
)
def partner_median_excess(b: Base) -> DataFrame:
    """The excess over what each item does with its other partners."""
    got = contingency.partner_excess(b.pairs(), LEAST_PAIR, LEAST_PARTNERS)
    return got.select("item_a", "item_b", F.round("partner_excess", 6).alias("partner_excess"))


# ---------------------------------------------------------------- screening


@query("screen_bands", "select item_a, item_b, support, omega_add_lower, signal from b_screen")
def screen_bands(b: Base) -> DataFrame:
    """Screened pairs with their band and signal: the lower bound is above the calibrated threshold."""
    return b.screened().select("item_a", "item_b", "support", "omega_add_lower", "signal")


@query("ranked_screen", "select item_a, item_b, support, omega_add_lower from b_screen")
def ranked_screen(b: Base) -> DataFrame:
    """The screen in falling order of its lower bound."""
    return screen.ranked(b.screened()).select("item_a", "item_b", "support", "omega_add_lower")


_BAND = f"""select support, tested, signalled, {_r('signalled / tested')} rate, {_r("(signalled / tested) / nullif(max(case when support = 'unsupported' then signalled / tested end) over (), 0)")} enrichment
  from (select support, count(*) tested, count(*) filter (where signal) signalled from {{0}} group by 1)"""


@query("band_enrichment", _BAND.format("b_screen"))
def band_enrichment(b: Base) -> DataFrame:
    """Signal rate of each band against the unsupported one."""
    return screen.band_rates(b.screened(), b.threshold(), "omega_add_lower")


BLOCKS["b_moiety"] = "select name ingredient, substance_id::varchar moiety from substances where name is not null"
BLOCKS["b_valid"] = """
  select s.* from b_screen s left join b_moiety x on x.ingredient = item_a left join b_moiety y on y.ingredient = item_b
  where item_a not in (select min(ingredient) from b_first) and item_b not in (select min(ingredient) from b_first) and coalesce(x.moiety <> y.moiety, true)"""


@query("vocabulary_hygiene", _BAND.format("b_valid"))
def vocabulary_hygiene(b: Base) -> DataFrame:
    """Band rates without non-specific items and without two names of one substance."""
    vague = b.first(N_CONTROL).agg(F.min("ingredient").alias("ingredient"))
    same = b.t("substances", "name", "substance_id").filter("name is not null").select(F.col("name").alias("ingredient"), F.col("substance_id").cast("string").alias("moiety"))
    return screen.band_rates(screen.without_invalid(b.screened(), vague, same), b.threshold(), "omega_add_lower")


@query(
    "control_results",
    "select c.item_a, c.item_b, coalesce(n_ab, 0) n_ab, coalesce(n_abz, 0) n_abz, omega_add_lower, omega_lower, coalesce(omega_add_lower > 0, false) signal_omega_add_lower, "
    "coalesce(omega_lower > 0, false) signal_omega_lower from b_controls c left join b_scored s on s.item_a = c.item_a and s.item_b = c.item_b",
)
def control_results(b: Base) -> DataFrame:
    """The control pairs under both nulls."""
    return screen.control_results(b.controls(), b.scored(), ["omega_add_lower", "omega_lower"])


@query("negative_pool", f"select item_a, item_b, n_ab, stratum, {_r('rr_a')} rr_a, {_r('rr_b')} rr_b from b_pool")
def negative_pool(b: Base) -> DataFrame:
    """Pairs like the controls that are none."""
    return b.pool().select("item_a", "item_b", "n_ab", "stratum", F.round("rr_a", 6).alias("rr_a"), F.round("rr_b", 6).alias("rr_b"))


@query(
    "negative_sample",
    "select item_a, item_b, stratum from (select *, row_number() over (partition by stratum order by md5('7|' || item_a || '|' || item_b), item_a, item_b) rn from b_pool) where rn <= 25",
)
def negative_sample(b: Base) -> DataFrame:
    """A fixed sample of the pool, as many of each stratum."""
    return screen.sampled(b.pool(), 25, 7).select("item_a", "item_b", "stratum")


@query(
    "fpr_by_stratum",
    f"""select stratum, count(*) n_pairs, {_r('avg((omega_add_lower > 0)::int)')} fpr_additive, {_r('avg((omega_lower > 0)::int)')} fpr_multiplicative,
      {_r('quantile_cont(omega_add_lower, 0.5)')} median_additive, {_r('quantile_cont(omega_add_lower, 0.95)')} p95_additive, quantile_cont(n_ab, 0.5)::double median_n_ab
    from (select * from b_pool union all select * replace ('all' as stratum) from b_pool) group by 1""",
)
def fpr_by_stratum(b: Base) -> DataFrame:
    """False-positive rates of the pool."""
    return screen.false_positive_rates(b.pool())


@query("calibration_quantile", f"select {_r('quantile_cont(omega_add_lower, 0.95)')} threshold from b_pool")
def calibration_quantile(b: Base) -> DataFrame:
    """The threshold one in twenty of the pool passes."""
    return screen.calibrated(b.pool(), TARGET, "omega_add_lower").select(F.round("threshold", DECIMALS).alias("threshold"))


_BIN = "case " + " ".join(f"when quarter between '{f}' and '{l}' then '{n}'" for n, f, l in BINS) + " end"


def _strata_sql(key: str, flags: str = "b_flags", top: str = "b_top", least: int = LEAST_PAIR) -> str:
    """Pairs of the screened items within the strata that ``key``, an expression over the flags, makes."""
    f = f"(select *, {key} stratum from {flags})"
    return f"""
  select stratum, item_a, item_b, n_ab, n_abz, n_a, n_az, n_b, n_bz, n_total, n_event from (
    select stratum, a.ingredient item_a, b.ingredient item_b, count(*) n_ab, count(*) filter (where is_core) n_abz
    from b_raw a join b_raw b on a.case_id = b.case_id and a.ingredient < b.ingredient join {f} f on f.case_id = a.case_id
    where stratum is not null and a.ingredient in (select ingredient from {top}) and b.ingredient in (select ingredient from {top}) group by all having count(*) >= {least})
  join (select stratum, ingredient item_a, count(*) n_a, count(*) filter (where is_core) n_az from b_raw join {f} using (case_id) group by all) using (stratum, item_a)
  join (select stratum, ingredient item_b, count(*) n_b, count(*) filter (where is_core) n_bz from b_raw join {f} using (case_id) group by all) using (stratum, item_b)
  join (select stratum, count(*) n_total, count(*) filter (where is_core) n_event from {f} group by all) using (stratum)"""


_SEX = "case when upper(sex) in ('F', 'M') then upper(sex) end"
BLOCKS["b_inside"] = "select distinct c.case_id from outc o join b_cases c using (era, report_id) where upper(trim(o.outc_cod)) = 'HO'"
BLOCKS["b_hospital_flags"] = "select f.*, case_id in (select case_id from b_inside) hospitalised from b_flags f"
for _stratum, _sql in (("era", _strata_sql(_BIN)), ("sex", _strata_sql(_SEX)), ("hospital", _strata_sql("hospitalised", "b_hospital_flags"))):
    BLOCKS[f"b_{_stratum}_strata"] = _sql
    BLOCKS[f"b_{_stratum}_scored"] = _scored(f"b_{_stratum}_strata")


def _strata(b: Base, key: str, flags: DataFrame | None = None, rows: DataFrame | None = None, items: DataFrame | None = None, least: int = LEAST_PAIR) -> DataFrame:
    """Scored pairs within each stratum, from one pass with the stratum as a grouping column."""
    flags, rows = (df.filter(F.col(key).isNotNull()) for df in (flags or b.flags(), rows or b.rows()))
    counts = B.pair_counts(rows, items or b.first(N_SCREEN), least, (key,), CAP)
    pairs = B.with_margins(counts, B.marginals(rows, (key,)), B.totals(flags, "core", (key,)), (key,))
    return bound_of(contingency.scored(cut(pairs, "strata")))


@query("era_stratified_pairs", f"select stratum era_bin, item_a, item_b, n_ab, n_abz, {_r('omega_add')} omega_add, omega_add_lower from b_era_scored")
def era_stratified_pairs(b: Base) -> DataFrame:
    """Pairs scored within each era bin."""
    return _strata(b, "era_bin").select("era_bin", "item_a", "item_b", "n_ab", "n_abz", F.round("omega_add", 6).alias("omega_add"), "omega_add_lower")


BLOCKS["b_stable"] = "select item_a, item_b, count(*) n_strata, count(*) filter (where omega_add_lower > (select t from b_threshold)) strata_with_signal from b_era_scored group by 1, 2"


@query(
    "era_stability",
    """select count(*) filter (where neg) negatives, count(*) filter (where neg and up) negatives_passing, count(*) filter (where neg and up and k = 3) negatives_stable,
      count(*) filter (where up) signalled, count(*) filter (where up and k = 3) stable
    from (select s.signal up, coalesce(t.strata_with_signal, 0) k, p.item_a is not null neg from b_screen s left join b_stable t using (item_a, item_b)
      left join b_pool p on p.item_a = s.item_a and p.item_b = s.item_b)""",
)
def era_stability(b: Base) -> DataFrame:
    """How many pairs, and negative ones, pass in every era."""
    strata = screen.strata_signals(_strata(b, "era_bin"), b.threshold(), "omega_add_lower")
    return screen.stability(b.screened(), strata, b.pool(), b.threshold(), "omega_add_lower", len(BINS))


@query("sex_strata", f"select stratum sex_key, item_a, item_b, n_ab, n_abz, {_r('omega_add')} omega_add, omega_add_lower from b_sex_scored")
def sex_strata(b: Base) -> DataFrame:
    """Pairs scored within each sex."""
    return _strata(b, "sex_key").select("sex_key", "item_a", "item_b", "n_ab", "n_abz", F.round("omega_add", 6).alias("omega_add"), "omega_add_lower")


def _hospital(b: Base) -> tuple[DataFrame, DataFrame]:
    """Flags and baskets with ``hospitalised``: an outcome of the case says so."""
    inside = b.t("outc", "era", "report_id", "outc_cod").filter(F.upper(F.trim("outc_cod")) == "HO").join(b.cases(), ["era", "report_id"]).select("case_id").distinct()
    inside = cut(inside.withColumn("h", F.lit(True)), "inside")
    flags, rows = (df.join(inside, "case_id", "left").withColumn("hospitalised", F.coalesce("h", F.lit(False))).drop("h") for df in (b.flags(), b.rows()))
    return flags, rows


@query("hospital_strata", f"select hospitalised, count(*) n_cases, count(*) filter (where is_core) n_event, {_r('avg(is_core::int)')} event_rate from b_hospital_flags group by 1")
def hospital_strata(b: Base) -> DataFrame:
    """Population and event rate by reported hospitalisation."""
    return _hospital(b)[0].groupBy("hospitalised").agg(
        F.count(F.lit(1)).alias("n_cases"), F.count_if("is_core").alias("n_event"), F.round(F.avg(F.col("is_core").cast("double")), 6).alias("event_rate")
    )


BLOCKS["b_hospital_banded"] = _annotated("b_hospital_scored")


@query(
    "hospital_bands",
    f"""select hospitalised, support, tested, signalled, {_r('signalled / tested')} rate,
      {_r("(signalled / tested) / nullif(max(case when support = 'unsupported' then signalled / tested end) over (partition by hospitalised), 0)")} enrichment
    from (select stratum hospitalised, support, count(*) tested, count(*) filter (where omega_add_lower > (select t from b_threshold)) signalled from b_hospital_banded group by 1, 2)""",
)
def hospital_bands(b: Base) -> DataFrame:
    """Pairs rescored within hospitalised cases and the others: the rates of the bands in each."""
    flags, rows = _hospital(b)
    pairs = screen.annotated(_strata(b, "hospitalised", flags, rows), b.controls(), b.implicated())
    return screen.band_rates(pairs, b.threshold(), "omega_add_lower", ("hospitalised",))


@query(
    "polypharmacy_bands",
    f"""select band, cases, events, {_r('pairs / sum(pairs) over ()')} pair_share, {_r('events / cases')} event_rate from (
      select case when k <= 1 then '1' when k <= 5 then '2-5' when k <= 10 then '6-10' when k <= 20 then '11-20' else '21+' end band, count(*) cases,
        count(*) filter (where coalesce(is_core, false)) events, sum(k * (k - 1) / 2) pairs
      from (select case_id, count(*) k from b_raw group by 1) left join b_events using (case_id) group by 1)""",
)
def polypharmacy_bands(b: Base) -> DataFrame:
    """Share of pairs and event rate by size of the case."""
    return B.size_bands(b.raw(), b.flags(None))


BLOCKS["b_size"] = "select case_id, coalesce(k, 0) k, coalesce(is_core, false) is_core from b_cases left join (select case_id, count(*) k from b_raw group by 1) using (case_id) left join b_events using (case_id)"
BLOCKS["b_first_size"] = "select a.ingredient x, b.ingredient y, min(k) k from b_raw a join b_raw b on a.case_id = b.case_id and a.ingredient < b.ingredient join b_size s on s.case_id = a.case_id group by 1, 2"


@query(
    "cap_sweep",
    " union all ".join(
        f"select {'null' if c is None else c}::int cap, (select count(*) from b_size where k <= {c or 10**9}) n_total, (select count(*) from b_size where k <= {c or 10**9} and is_core) n_event, "
        f"(select count(*) from b_first_size where k <= {c or 10**9}) n_pairs, (select coalesce(sum(k * (k - 1) // 2), 0)::bigint from b_size where k <= {c or 10**9}) pair_rows"
        for c in CAPS
    ),
)
def cap_sweep(b: Base) -> DataFrame:
    """Cases, event cases and pair rows for several caps; none is a case of its own."""
    return B.cap_sweep(b.raw(), b.flags(None), CAPS)


_SIZED = """select least(greatest(a.r, b.r), 1000000) r, s.omega_add_lower > (select t from b_threshold) up from b_sized_scored s join b_rank_{0} a on a.ingredient = item_a join b_rank_{0} b on b.ingredient = item_b"""
for _order in ("n_item_event", "n_item"):
    BLOCKS[f"b_rank_{_order}"] = f"select ingredient, row_number() over (order by {_order} desc, ingredient) r from b_single where n_item_event > 0"
BLOCKS["b_sized"] = f"select distinct ingredient from (select * from b_rank_n_item_event union all select * from b_rank_n_item) where r <= {max(SIZES)}"
BLOCKS["b_sized_pairs"] = _pairs("b_sized")
BLOCKS["b_sized_scored"] = _scored("b_sized_pairs")


@query(
    "screen_sizes",
    " union all ".join(
        f"select '{o}' item_order, {n} n_items, count(*) n_pairs, count(*) filter (where up) n_signal from ({_SIZED.format(o)}) where r <= {n}" for o in ("n_item_event", "n_item") for n in SIZES
    ),
)
def screen_sizes(b: Base) -> DataFrame:
    """Pairs and signals of wider screens and other item orders (C29); all pairs are counted once."""
    items = b.single().filter("n_item_event > 0")
    tops = {o: B.top_items(items, max(SIZES), o) for o in ("n_item_event", "n_item")}
    # As many rows as the widest screen has items.
    ranks = {o: cut(df.withColumn("r", F.row_number().over(Window.orderBy(F.desc(o), "ingredient"))).select("ingredient", "r"), "ranks") for o, df in tops.items()}
    pairs = bound_of(contingency.scored(cut(b.counted(reduce(DataFrame.unionByName, ranks.values())), "sizes"))).select("item_a", "item_b", (F.col("omega_add_lower") > b.threshold()).alias("up"))
    pairs, out = cut(pairs, "sizes"), []
    for order, rank in ranks.items():
        placed = pairs
        for side in "ab":
            placed = placed.join(rank.select(F.col("ingredient").alias(f"item_{side}"), F.col("r").alias(f"r_{side}")), f"item_{side}")
        worst = F.greatest("r_a", "r_b")
        sums = placed.agg(*(F.count_if(worst <= n).alias(f"n{n}") for n in SIZES), *(F.count_if((worst <= n) & F.col("up")).alias(f"k{n}") for n in SIZES))
        each = F.array(*(F.struct(F.lit(n).alias("n_items"), F.col(f"n{n}").alias("n_pairs"), F.col(f"k{n}").alias("n_signal")) for n in SIZES))
        out.append(sums.select(F.lit(order).alias("item_order"), F.explode(each).alias("x")).select("item_order", "x.*"))
    return reduce(DataFrame.unionByName, out)


def _recovered(b: Base, rows: DataFrame, flags: DataFrame, tier: str = "core") -> DataFrame:
    """(n_controls, recovered_additive, recovered_multiplicative) of the control pairs in other baskets."""
    controls = b.controls()
    items = controls.select(F.explode(F.array("item_a", "item_b")).alias("ingredient"))
    got = bound_of(contingency.scored(cut(B.with_margins(B.pair_counts(rows, items, largest=CAP), B.marginals(rows), B.totals(flags, tier)), "controls")))
    res = screen.control_results(controls, got, ["omega_add_lower", "omega_lower"])
    return res.agg(
        F.count(F.lit(1)).alias("n_controls"), F.count_if("signal_omega_add_lower").alias("recovered_additive"), F.count_if("signal_omega_lower").alias("recovered_multiplicative")
    )


def _recovered_sql(label: str, rows: str, flags: str) -> str:
    """The same for (case_id, ingredient, event) rows and (case_id, event) flags."""
    pairs = f"""select p.*, x.n n_a, x.k n_az, y.n n_b, y.k n_bz, n_total, n_event from (
        select a.ingredient item_a, b.ingredient item_b, count(*) n_ab, count(*) filter (where a.event) n_abz from {rows} a join {rows} b on a.case_id = b.case_id and a.ingredient < b.ingredient
        where a.ingredient in (select ingredient from b_first) and b.ingredient in (select ingredient from b_first) group by 1, 2) p
      join (select ingredient, count(*) n, count(*) filter (where event) k from {rows} group by 1) x on x.ingredient = item_a
      join (select ingredient, count(*) n, count(*) filter (where event) k from {rows} group by 1) y on y.ingredient = item_b, (select count(*) n_total, count(*) filter (where event) n_event from {flags})"""
    return f"""select {label}, count(*) n_controls, count(*) filter (where omega_add_lower > 0) recovered_additive, count(*) filter (where omega_lower > 0) recovered_multiplicative
      from b_controls left join ({_scored(f'({pairs})')}) using (item_a, item_b)"""


for _policy in ("primary", "sensitivity"):
    BLOCKS[f"b_raw_{_policy}"] = f"""
  select distinct c.case_id, upper(trim(d.ingredient)) ingredient from drug_ingredients d join b_cases c using (era, report_id)
  where upper(trim(d.role_cod)) in ({_in(B.ROLES[_policy])}) and trim(d.ingredient) <> ''"""
    for _tier in ("core", "broad"):
        BLOCKS[f"b_flags_{_policy}_{_tier}"] = f"""
  select case_id, coalesce(is_{_tier}, false) event from b_cases left join b_events using (case_id) where case_id not in (select case_id from b_raw_{_policy} group by 1 having count(*) > {CAP})"""
        BLOCKS[f"b_rows_{_policy}_{_tier}"] = f"select r.*, event from b_raw_{_policy} r join b_flags_{_policy}_{_tier} using (case_id)"


@query(
    "specification_grid",
    " union all ".join(
        _recovered_sql(f"'{p}' as policy, '{t}' tier", f"b_rows_{p}_{t}", f"b_flags_{p}_{t}") for p in ("primary", "sensitivity") for t in ("core", "broad")
    ),
)
def specification_grid(b: Base) -> DataFrame:
    """Controls recovered under each role policy and event tier."""
    cells = [(p, t) for p in ("primary", "sensitivity") for t in ("core", "broad")]
    out = [_recovered(b, b.rows(CAP, p, t), b.flags(CAP, p), t).select(F.lit(p).alias("policy"), F.lit(t).alias("tier"), "*") for p, t in cells]
    return reduce(DataFrame.unionByName, out)


@query(
    "proxy_third_item",
    f"""select item_a, item_b, count(e.case_id) event_cases, count(*) filter (where third) with_third, {_r('count(*) filter (where third) / nullif(count(e.case_id), 0)')} share,
      {_r("(select avg((n > 0)::int) from (select case_id, count(*) filter (where ingredient in (select ingredient from b_implicated)) n from b_rows where event group by 1))")} background_share
    from b_controls c left join (select a.case_id, a.ingredient x, b.ingredient y, exists (select 1 from b_rows r where r.case_id = a.case_id and r.ingredient <> a.ingredient
        and r.ingredient <> b.ingredient and r.ingredient in (select ingredient from b_implicated)) third
      from b_rows a join b_rows b on a.case_id = b.case_id where a.event) e on e.x = item_a and e.y = item_b group by 1, 2""",
)
def proxy_third_item(b: Base) -> DataFrame:
    """The share of a pair's event cases with another implicated item."""
    return screen.third_item_share(b.controls(), b.rows(), b.implicated())


N_PANEL, N_RATE = 20, 10
BLOCKS["b_best"] = f"select item_a, item_b from b_screen order by omega_add_lower desc, item_a, item_b limit {N_PANEL}"
BLOCKS["b_panel"] = "select item_a, item_b from b_best union select item_a, item_b from b_controls"
BLOCKS["b_panel_items"] = "select item_a ingredient from b_panel union select item_b from b_panel"
BLOCKS["b_panel_strata"] = _strata_sql(_BIN, "b_flags", "b_panel_items", 1)
BLOCKS["b_panel_scored"] = _scored("b_panel_strata")
BLOCKS["b_marked"] = f"select distinct c.case_id from reac r join b_cases c using (era, report_id) where upper(trim(r.pt)) in ({_in(MARKER_TERMS)})"
BLOCKS["b_hit"] = """
  select a.case_id, item_a, item_b from b_panel join b_rows a on a.ingredient = item_a join b_rows b on b.ingredient = item_b and b.case_id = a.case_id where a.event"""
_ERAS = [n for n, _, _ in BINS]


@query(
    "top_k_per_pair",
    f"""select c.item_a, c.item_b, coalesce(support, 'not_screened') support, coalesce(event_cases, 0) event_cases, {_r('marked_fraction')} marked_fraction,
      {_r('marked_fraction / nullif((select avg((case_id in (select case_id from b_marked))::int) from b_flags where is_core), 0)')} marked_vs_background, top_labels,
      {", ".join(f"om025_{n}" for n in _ERAS)}, {" + ".join(f"coalesce(om025_{n} > 0, false)::int" for n in _ERAS)} eras_with_signal,
      concat_ws(';', {", ".join(f"case when om025_{n} > 0 then '{n}' end" for n in _ERAS)}) eras_signalled
    from b_panel c left join (select item_a, item_b, support from b_screen) using (item_a, item_b)
    left join (select item_a, item_b, count(*) event_cases, avg((case_id in (select case_id from b_marked))::int) marked_fraction from b_hit group by 1, 2) using (item_a, item_b)
    left join (select item_a, item_b, {", ".join(f"max(omega_add_lower) filter (where stratum = '{n}') om025_{n}" for n in _ERAS)} from b_panel_scored group by 1, 2) using (item_a, item_b)
    left join (select item_a, item_b, string_agg(label || '(' || n || ')', ';' order by n desc, label) top_labels from (
      select item_a, item_b, label, count(*) n, row_number() over (partition by item_a, item_b order by count(*) desc, label) rn
      from b_hit join (select distinct c.case_id, upper(trim(o.outc_cod)) as label from outc o join b_cases c using (era, report_id) where trim(o.outc_cod) <> '') using (case_id)
      group by 1, 2, 3) where rn <= 3 group by 1, 2) using (item_a, item_b)""",
)
def top_k_per_pair(b: Base) -> DataFrame:
    """Triage panel of the head of the screen and the controls: marker share against background, outcomes, bounds by era."""
    keyed = b.cases().select("case_id", "era", "report_id")
    marked = cut(b.t("reac", "era", "report_id", "pt").filter(F.upper(F.trim("pt")).isin(MARKER_TERMS)).join(keyed, ["era", "report_id"]).select("case_id").distinct(), "marked")
    labels = b.t("outc", "era", "report_id", "outc_cod").filter(F.trim("outc_cod") != "").join(keyed, ["era", "report_id"]).select("case_id", F.upper(F.trim("outc_cod")).alias("label"))
    panel = cut(screen.ordered_union([screen.ranked(b.screened()).limit(N_PANEL), b.controls()]).select("item_a", "item_b"), "panel")
    got = screen.triage(panel, b.rows(), marked, labels)
    events = b.flags().filter("is_core").join(marked.withColumn("m", F.lit(1.0)), "case_id", "left")
    background = events.agg(F.avg(F.coalesce("m", F.lit(0.0))).alias("background"))
    items = panel.select(F.explode(F.array("item_a", "item_b")).alias("ingredient"))
    eras = screen.bounds_by_stratum(_strata(b, "era_bin", items=items, least=1), "era_bin", _ERAS)
    out = got.join(b.screened().select("item_a", "item_b", "support"), ["item_a", "item_b"], "left").join(eras, ["item_a", "item_b"], "left").join(F.broadcast(background))  # a single row
    out = out.fillna({"support": "not_screened", "eras_with_signal": 0, "eras_signalled": ""})
    return out.withColumn("marked_vs_background", F.round(F.try_divide(F.col("marked_fraction"), F.col("background")), 6)).withColumn("marked_fraction", F.round("marked_fraction", 6)).drop("background")


BLOCKS["b_rated"] = f"select *, n_abz / n_ab rate from b_screen where n_ab >= {LEAST_RANKED}"


@query(
    "top_by_rate",
    f"""select r.item_a, r.item_b, n_ab, n_abz, {_r('rate')} rate, support, omega_add_lower, coalesce(strata_with_signal, 0) eras_with_signal
    from (select * from b_rated order by rate desc, item_a, item_b limit {N_RATE}) r left join b_stable using (item_a, item_b)""",
)
def top_by_rate(b: Base) -> DataFrame:
    """The pairs with the highest event rate among enough co-reports."""
    strata = screen.strata_signals(_strata(b, "era_bin"), b.threshold(), "omega_add_lower").select("item_a", "item_b", F.col("strata_with_signal").alias("eras_with_signal"))
    top = screen.top_by_rate(b.screened(), LEAST_RANKED, N_RATE)
    return top.join(strata, ["item_a", "item_b"], "left").fillna(0, ["eras_with_signal"]).select("item_a", "item_b", "n_ab", "n_abz", F.round("rate", 6).alias("rate"), "support", "omega_add_lower", "eras_with_signal")


BLOCKS["b_leading"] = "select * from b_rated where signal order by rate desc, item_a, item_b limit 5"


@query(
    "ranked_proxy",
    f"""select r.item_a, r.item_b, n_ab, n_abz, {_r('rate')} rate, omega_add_lower, omega_lower, coalesce(omega_lower > 0, false) signals_multiplicative_too, support,
      (item_a, item_b) in (select (item_a, item_b) from b_label_pairs) documented, {_r('third')} third_share
    from b_leading r left join (select l.item_a, l.item_b, avg((exists (select 1 from b_rows c where c.case_id = a.case_id and c.ingredient not in (l.item_a, l.item_b)
        and c.ingredient in (select ingredient from b_implicated)))::int) third
      from b_leading l join b_rows a on a.ingredient = l.item_a join b_rows b on b.ingredient = l.item_b and b.case_id = a.case_id where a.event group by 1, 2) using (item_a, item_b)""",
)
def ranked_proxy(b: Base) -> DataFrame:
    """The signalled pairs of the highest event rate, and how many of their event cases hold a third implicated item."""
    top = cut(screen.top_by_rate(b.screened().filter("signal"), LEAST_RANKED, 5), "leading")
    shares = screen.third_item_share(top, b.rows(), b.implicated()).select("item_a", "item_b", F.col("share").alias("third_share"))
    documented = b.labels()[1].withColumn("documented", F.lit(True))
    got = top.join(shares, ["item_a", "item_b"], "left").join(documented, ["item_a", "item_b"], "left")
    return got.select(
        "item_a", "item_b", "n_ab", "n_abz", F.round("rate", 6).alias("rate"), "omega_add_lower", "omega_lower", F.coalesce(F.col("omega_lower") > 0, F.lit(False)).alias("signals_multiplicative_too"),
        "support", F.coalesce("documented", F.lit(False)).alias("documented"), "third_share",
    )


@query(
    "nesting_counts",
    """select count(*) n_pairs, count(*) filter (where up) n_both_elevated, count(*) filter (where bad) violations_all, count(*) filter (where bad and up) violations_both_elevated,
      count(*) filter (where o) n_ordered, count(*) filter (where bad and o) violations_ordered
    from (select coalesce(rr_a > 1 and rr_b > 1, false) up, omega_lower > 0 and not omega_add_lower > 0 bad, expected >= additive_expected o from b_scored where omega_lower is not null and omega_add_lower is not null)""",
)
def nesting_counts(b: Base) -> DataFrame:
    """When one null's signals lie inside the other's."""
    return screen.nesting(b.scored(), "omega_lower", "omega_add_lower")


BLOCKS["b_edges"] = "select quantile_cont(strength, [0, 0.2, 0.4, 0.6, 0.8, 1.0]) e, avg((omega_add_lower > (select t from b_threshold))::int) pooled from b_pool where strength is not null"
_CUTS = "(select min(strength) from b_screen where is_control)"


@query(
    "in_regime_quintiles",
    f"""select i + 1 as bin, {_r('min(e[i + 1])')} as low, {_r('min(e[i + 2])')} as high, count(*) n, {_r('avg((omega_add_lower > 0)::int)')} rate_additive, {_r('avg((omega_lower > 0)::int)')} rate_multiplicative
    from b_pool, b_edges, range(5) t(i) where strength >= e[i + 1] and strength <= e[i + 2] group by i""",
)
def in_regime_quintiles(b: Base) -> DataFrame:
    """False-positive rates by marginal strength."""
    return screen.quintiles(b.pool(), "omega_add_lower", "omega_lower")


@query(
    "high_marginal_pool",
    f"select item_a, item_b, {_r('strength')} strength from b_pool where strength >= {_CUTS}",
)
def high_marginal_pool(b: Base) -> DataFrame:
    """The pool's pairs as strong as the weakest control."""
    marked = b.screened().filter("is_control")
    return screen.in_regime(b.pool(), marked).select("item_a", "item_b", F.round("strength", 6).alias("strength"))


BLOCKS["b_regime"] = f"select omega_add_lower, omega_lower from b_pool where strength >= {_CUTS}"
BLOCKS["b_sweep"] = " union all ".join(
    f"select {t} target_fpr, quantile_cont(omega_add_lower, {q}) ta, quantile_cont(omega_lower, {q}) tm from b_regime" for t, q in ((0.05, 0.95), (0.1, 0.9), (0.2, 0.8))
)


@query(
    "operating_characteristic",
    f"""select target_fpr::double target_fpr, {_r('ta')} threshold_additive, {_r('tm')} threshold_multiplicative,
      {_r('(select avg((omega_add_lower > ta)::int) from b_regime)')} realised_additive, {_r('(select avg((omega_lower > tm)::int) from b_regime)')} realised_multiplicative,
      (select count(*) from b_screen where is_control and omega_add_lower > ta) recovered_additive, (select count(*) from b_screen where is_control and omega_lower > tm) recovered_multiplicative
    from b_sweep""",
)
def operating_characteristic(b: Base) -> DataFrame:
    """Controls recovered at matched false-positive rates."""
    controls = b.screened().filter("is_control")
    pool = screen.in_regime(b.pool(), controls)
    return screen.operating_characteristic(controls, pool, [0.05, 0.1, 0.2], {"additive": "omega_add_lower", "multiplicative": "omega_lower"})


@query(
    "strength_matched",
    f"""select support, count(*) tested, count(*) filter (where signal) observed, {_r('sum(pooled)')} expected_pooled, {_r('sum(coalesce(rate, pooled))')} expected_matched
    from (select s.support, s.signal, pooled, least(greatest(len(list_filter(e, lambda x: x <= s.strength)) - 1, 0), 4) i from b_screen s, b_edges where s.strength is not null) k
    left join (select i, avg((omega_add_lower > (select t from b_threshold))::int) rate from b_pool, b_edges, range(5) t(i) where strength >= e[i + 1] and strength <= e[i + 2] group by i) using (i) group by 1""",
)
def strength_matched(b: Base) -> DataFrame:
    """What chance alone gives each band, by strength."""
    return screen.strength_matched(b.screened(), b.pool(), b.threshold(), "omega_add_lower")


BLOCKS["b_partner"] = f"""
  select item_a, item_b, {_r('case when count(e) = 2 then min(e) end')} partner_excess from (
      select p.item_a, p.item_b, case when count(r.rate) >= {LEAST_PARTNERS} then log2((p.n_abz + 0.5) / (p.n_ab * median(r.rate) + 0.5)) end e
      from (select *, item_a item, item_b partner from b_pairs union all select *, item_b, item_a from b_pairs) p
      left join b_rates r on r.item = p.item and r.partner <> p.partner group by p.item_a, p.item_b, p.item, p.n_abz, p.n_ab) group by 1, 2"""


@query("third_estimand", "select s.item_a, s.item_b, support, partner_excess, omega_add_lower, omega_lower from b_screen s join b_partner using (item_a, item_b) where partner_excess is not null")
def third_estimand(b: Base) -> DataFrame:
    """The partner-anchored excess beside both nulls on the same pairs."""
    anchored = contingency.partner_excess(b.universe().filter("screen"), LEAST_PAIR, LEAST_PARTNERS).filter("partner_excess is not null")
    return b.screened().join(anchored, ["item_a", "item_b"]).select("item_a", "item_b", "support", F.round("partner_excess", 6).alias("partner_excess"), "omega_add_lower", "omega_lower")


_DOCUMENTED = f"""select nd documented_tested, kd documented_signalled, nu undocumented_tested, ku undocumented_signalled, {_r('(kd / nullif(nd, 0)) / nullif(ku / nullif(nu, 0), 0)')} enrichment
    from (select count(*) filter (where d) nd, count(*) filter (where d and signal) kd, count(*) filter (where not d) nu, count(*) filter (where not d and signal) ku
      from (select s.*, (item_a, item_b) in (select (item_a, item_b) from b_label_pairs) d from b_screen s where item_a not in (select ingredient from b_first) and item_b not in (select ingredient from b_first){{0}}))"""
_COVERED = " and item_a in (select ingredient from b_labelled) and item_b in (select ingredient from b_labelled)"


@query("documented_enrichment", _DOCUMENTED.format(""))
def documented_enrichment(b: Base) -> DataFrame:
    """Signals inside and outside the pairs that label texts name together, control items left out."""
    drop = b.controls().select(F.explode(F.array("item_a", "item_b")).alias("ingredient"))
    return screen.documented_enrichment(b.screened(), b.labels()[1], b.threshold(), "omega_add_lower", drop)


@query(
    "reference_coverage",
    f"""select * from (select count(*) screened_items, count(*) filter (where ingredient not in (select ingredient from b_labelled)) items_without_text
      from (select item_a ingredient from b_screen union select item_b from b_screen)),
    (select count(*) pairs_total, count(*) filter (where u) pairs_without_text, {_r('count(*) filter (where u) / count(*)')} share_without_text
      from (select item_a not in (select ingredient from b_labelled) or item_b not in (select ingredient from b_labelled) u from b_screen)), ({_DOCUMENTED.format(_COVERED)})""",
)
def reference_coverage(b: Base) -> DataFrame:
    """How many screened items and pairs no text can document, and the enrichment among the others."""
    drop = b.controls().select(F.explode(F.array("item_a", "item_b")).alias("ingredient"))
    having, pairs = b.labels()
    return screen.reference_coverage(b.screened(), having, pairs, b.threshold(), "omega_add_lower", drop)


_ADD_LOW, _ADD_HIGH = _jeffreys("k_add", "n_pairs")
_MULT_LOW, _MULT_HIGH = _jeffreys("k_mult", "n_pairs")


def _interval(k: str, n: str, prefix: str = "") -> list:
    ci = bounds.jeffreys(F.col(k), F.col(n))
    return [F.round(ci[side], 6).alias(prefix + side) for side in ("low", "high")]


@query(
    "independent_controls",
    f"""select n_pairs, k_add, k_mult, {_r(_ADD_LOW)} add_low, {_r(_ADD_HIGH)} add_high, {_r(_MULT_LOW)} mult_low, {_r(_MULT_HIGH)} mult_high
    from (select count(*) n_pairs, count(*) filter (where omega_add_lower > 0) k_add, count(*) filter (where omega_lower > 0) k_mult from b_screen where not is_control and n_implicated = 2 and n_ab >= 5)""",
)
def independent_controls(b: Base) -> DataFrame:
    """Recovery of implicated pairs that are no controls, with Jeffreys intervals."""
    rows = b.screened().filter("not is_control and n_implicated = 2 and n_ab >= 5")
    sums = rows.agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if(F.col("omega_add_lower") > 0).alias("k_add"), F.count_if(F.col("omega_lower") > 0).alias("k_mult"))
    return sums.select("n_pairs", "k_add", "k_mult", *_interval("k_add", "n_pairs", "add_"), *_interval("k_mult", "n_pairs", "mult_"))


EVENT_WORDS = ("JOINT", "CHEST", "SKIN")
for _word in EVENT_WORDS:
    _terms = _in(f"{_word} {x}" for x in ("PAIN", "SWELLING", "WEAKNESS"))
    BLOCKS[f"b_flags_{_word.lower()}"] = f"""
  select case_id, case_id in (select c.case_id from reac r join b_cases c using (era, report_id) where upper(trim(r.pt)) in ({_terms})) event from b_cases where case_id not in (select case_id from b_over)"""
    BLOCKS[f"b_rows_{_word.lower()}"] = f"select r.*, event from b_raw r join b_flags_{_word.lower()} using (case_id)"


@query("event_generalisation", " union all ".join(_recovered_sql(f"'{w}' as event", f"b_rows_{w.lower()}", f"b_flags_{w.lower()}") for w in EVENT_WORDS))
def event_generalisation(b: Base) -> DataFrame:
    """The same controls under other events."""
    cases, out, raw = b.cases(), [], b.raw()
    for word in EVENT_WORDS:
        terms = b.spark.createDataFrame([(f"{word} {x}", "core", word) for x in ("PAIN", "SWELLING", "WEAKNESS")], "pt string, tier string, concept string")
        found = events.case_events(events.case_terms(b.t("reac", "era", "report_id", "pt"), cases, terms))
        flags = cut(B.population(cases, found, B.excluded_cases(raw, CAP)), "flags")
        rows = cut(B.baskets(raw, flags), "rows")
        out.append(_recovered(b, rows, flags).select(F.lit(word).alias("event"), "*"))
    return reduce(DataFrame.unionByName, out)


BLOCKS["b_sets"] = """
  select c.case_id, c.event_dt, c.age_years, c.sex, c.country, list_sort(list(distinct ingredient)) x from b_cases c join b_rows r using (case_id)
  where event and event_dt <> '' and age_years is not null group by all"""
BLOCKS["b_setpairs"] = """
  select b.case_id c, a.x = b.x same, len(list_intersect(a.x, b.x)) / len(list_distinct(list_concat(a.x, b.x))) j
  from b_sets a join b_sets b on a.event_dt = b.event_dt and a.age_years = b.age_years and a.sex = b.sex and a.country = b.country and a.case_id < b.case_id"""


@query(
    "fuzzy_jaccard",
    """select (select count(*) from b_sets) cases, count(*) filter (where same) exact_pairs, count(*) filter (where not same and j >= 0.8) fuzzy_pairs,
      count(distinct c) filter (where not same and j >= 0.8) fuzzy_cases from b_setpairs""",
)
def fuzzy_jaccard(b: Base) -> DataFrame:
    """Further near-duplicates among event cases."""
    return screen.fuzzy_duplicates(b.cases(), b.rows())


WINDOW_OF_CASES = ("2009q1", "2015q2")
BLOCKS["b_rate_sets"] = """
  select 'control' of, n_abz / n_ab rate from b_scored join b_controls using (item_a, item_b)
  union all select 'documented', n_abz / n_ab from b_scored anti join b_controls using (item_a, item_b) semi join b_label_pairs using (item_a, item_b)"""


@query(
    "provenance",
    "select metric, round(value, 6) as value from ("
    + " union all ".join(
        [
            "select 'raw_rows_' || era metric, count(*)::double as value from demo group by era",
            "select 'rows_without_case_id_' || era, count(*) from demo where case_id is null group by era",
            "select 'cases_' || era, count(*) from b_cases group by era",
            "select 'term_vocabulary', count(distinct upper(trim(pt))) from reac where trim(pt) <> ''",
            "select 'bridged_ids', (select count(*) from b_latest) - (select count(*) from b_bridged)",
            f"select 'cases_in_window', count(*) from b_cases where quarter between '{WINDOW_OF_CASES[0]}' and '{WINDOW_OF_CASES[1]}'",
            "select 'cases_over_cap', count(*) from b_over",
            "select 'context_excluded_cases', count(distinct case_id) from b_rows where ingredient in (select ingredient from b_first)",
            "select 'hospital_outcome_rows', count(*) from outc where upper(trim(outc_cod)) = 'HO'",
            "select 'implicated_share_of_event_cases', avg((n > 0)::int) from (select case_id, count(*) filter (where ingredient in (select ingredient from b_implicated)) n from b_rows where event group by 1)",
            "select 'baseline_event_rate', n_event / n_total from b_total",
            "select of || '_pairs', count(*) from b_rate_sets group by of",
            "select of || '_median_rate', median(rate) from b_rate_sets group by of",
            "select of || '_median_rate_vs_baseline', median(rate) / (select n_event / n_total from b_total) from b_rate_sets group by of",
        ]
    )
    + ")",
)
def provenance(b: Base) -> DataFrame:
    """Counts by era, exclusions, and the gap in event rate between control and documented pairs, one row a figure."""
    demo, reac, rows, count = b.t("demo", "era", "case_id"), b.t("reac", "pt"), b.rows(), F.count(F.lit(1))
    name = lambda text: F.concat(F.lit(text), F.col("era"))
    latest = cut(resolve.latest_versions(b.t("demo")), "latest")
    implicated = rows.filter("event").join(b.implicated().withColumn("i", F.lit(1)), "ingredient", "left").groupBy("case_id").agg(F.count("i").alias("n"))
    rates = b.scored().withColumn("rate", F.col("n_abz") / F.col("n_ab"))
    keys, controls = ["item_a", "item_b"], b.controls()
    sets = rates.join(controls, keys, "left_semi").select(F.lit("control").alias("of"), "rate").unionByName(
        rates.join(controls, keys, "left_anti").join(b.labels()[1], keys, "left_semi").select(F.lit("documented").alias("of"), "rate")
    )
    base = B.totals(b.flags()).select((F.col("n_event") / F.col("n_total")).alias("value"))
    of = lambda text: F.concat(F.col("of"), F.lit(text))
    medians = cut(sets.groupBy("of").agg(count.alias("n"), F.percentile("rate", F.lit(0.5)).alias("m")), "medians")
    parts = [
        demo.groupBy("era").agg(count.alias("value")).select(name("raw_rows_").alias("metric"), "value"),
        demo.filter("case_id is null").groupBy("era").agg(count.alias("value")).select(name("rows_without_case_id_").alias("metric"), "value"),
        b.cases().groupBy("era").agg(count.alias("value")).select(name("cases_").alias("metric"), "value"),
        medians.select(of("_pairs").alias("metric"), F.col("n").alias("value")),
        medians.select(of("_median_rate").alias("metric"), F.col("m").alias("value")),
        medians.join(F.broadcast(base)).select(of("_median_rate_vs_baseline").alias("metric"), (F.col("m") / F.col("value")).alias("value")),  # a single row
    ]
    single = {
        "term_vocabulary": reac.filter("trim(pt) <> ''").agg(F.count_distinct(F.upper(F.trim("pt"))).alias("value")),
        "bridged_ids": latest.agg((count - F.count_distinct("case_id")).alias("value")),
        "cases_in_window": b.cases().filter(F.col("quarter").between(*WINDOW_OF_CASES)).agg(count.alias("value")),
        "cases_over_cap": B.excluded_cases(b.raw(), CAP).agg(count.alias("value")),
        "context_excluded_cases": rows.join(b.first(N_CONTROL).select("ingredient"), "ingredient", "left_semi").agg(F.count_distinct("case_id").alias("value")),
        "hospital_outcome_rows": b.t("outc", "outc_cod").filter(F.upper(F.trim("outc_cod")) == "HO").agg(count.alias("value")),
        "implicated_share_of_event_cases": implicated.agg(F.avg((F.col("n") > 0).cast("double")).alias("value")),
        "baseline_event_rate": base,
    }
    parts += [df.select(F.lit(metric).alias("metric"), "value") for metric, df in single.items()]
    return reduce(DataFrame.unionByName, (p.select("metric", F.round(F.col("value").cast("double"), 6).alias("value")) for p in parts))


# ---------------------------------------------------------------- inference

_LOW, _HIGH = _jeffreys("signalled", "tested")


@query("jeffreys", f"select support, tested, signalled, {_r(_LOW)} as low, {_r(_HIGH)} as high from (select support, count(*) tested, count(*) filter (where signal) signalled from b_screen group by 1)")
def jeffreys(b: Base) -> DataFrame:
    """Jeffreys interval of each band's signal rate."""
    by = screen.band_rates(b.screened(), b.threshold(), "omega_add_lower")
    return by.select("support", "tested", "signalled", *_interval("signalled", "tested"))


@query("rule_of_three", f"select support, {_r('-ln(1 - 0.95) / count(*)')} upper_bound from b_screen group by 1")
def rule_of_three(b: Base) -> DataFrame:
    """The bound of a rate without events."""
    return b.screened().groupBy("support").agg(F.count(F.lit(1)).alias("n")).select("support", F.round(inference.rule_of_three(F.col("n")), 6).alias("upper_bound"))


@query(
    "ratio_ci",
    f"""select support, {_r('case when ok then ratio end')} ratio, {_r('case when ok then exp(ln(ratio) - 1.959963984540054 * se) end')} low, {_r('case when ok then exp(ln(ratio) + 1.959963984540054 * se) end')} high
    from (select *, ka > 0 and kb > 0 ok, case when ka > 0 and kb > 0 then (ka / na) / (kb / nb) end ratio, case when ka > 0 and kb > 0 then sqrt(greatest(0, 1 / ka - 1 / na + 1 / kb - 1 / nb)) end se
      from (select a.support, a.k ka, a.n na, b.k kb, b.n nb from (select support, count(*) n, count(*) filter (where signal) k from b_screen group by 1) a,
        (select count(*) n, count(*) filter (where signal) k from b_screen where support = 'unsupported') b))""",
)
def ratio_ci(b: Base) -> DataFrame:
    """Each band's rate against the unsupported one, with an interval."""
    by = b.screened().groupBy("support").agg(F.count(F.lit(1)).alias("na"), F.count_if("signal").alias("ka"))
    base = by.filter("support = 'unsupported'").select(F.col("na").alias("nb"), F.col("ka").alias("kb"))
    r, low, high = inference.ratio_interval(F.col("ka"), F.col("na"), F.col("kb"), F.col("nb"))
    return by.join(F.broadcast(base)).select("support", F.round(r, 6).alias("ratio"), F.round(low, 6).alias("low"), F.round(high, 6).alias("high"))  # a single row


@query("pearson", f"select count(*) n, {_r('corr(omega, strength)')} r from b_scored where omega is not null and strength is not null")
def pearson(b: Base) -> DataFrame:
    """The correlation of score and strength (I4)."""
    return inference.correlation(b.scored(), "omega", "strength").select("n", F.round("r", 6).alias("r"))


_P = f"case when x <= (n / 2.0) / (n / 2.0 + 1.5) then {_beta('x', '((n - 2) / 2.0)', '0.5')} else 1 - {_beta('(1 - x)', '0.5', '((n - 2) / 2.0)')} end"


@query(
    "pearson_interval",
    f"""select n, {_r('r')} r, {_r('tanh(atanh(r) - 1.959963984540054 / sqrt(n - 3))')} ci_low, {_r('tanh(atanh(r) + 1.959963984540054 / sqrt(n - 3))')} ci_high, {_r(_P)} p_value
    from (select *, 1 - r * r x from (select count(*) n, corr(omega_add, strength) r from b_scored where omega_add is not null and strength is not null))""",
)
def pearson_interval(b: Base) -> DataFrame:
    """The same for the additive score, with interval and p-value (I4)."""
    got = inference.correlation(b.scored(), "omega_add", "strength")
    return got.select("n", *(F.round(c, 6).alias(c) for c in ("r", "ci_low", "ci_high", "p_value")))


@query(
    "leave_one_out",
    f"""select count(*) n_folds, count(*) filter (where pick) folds_first, sum(case when pick then a else m end)::bigint loo_recovered, sum(a)::bigint in_sample_recovered,
      {_r('(sum(a) - sum(case when pick then a else m end)) / count(*)')} optimism
    from (select *, sum(a) over () - a >= sum(m) over () - m pick from (select (omega_add_lower > 0)::int a, (omega_lower > 0)::int m from b_banded where is_control))""",
)
def leave_one_out(b: Base) -> DataFrame:
    """Recovery with the null chosen on the other controls."""
    rows = b.screened().filter("is_control").select((F.col("omega_add_lower") > 0).alias("a"), (F.col("omega_lower") > 0).alias("m"))
    return inference.leave_one_out(rows, "a", "m")


BLOCKS["b_mh"] = """
  select signal s, n_implicated >= 1 d, least(len(list_filter(e, lambda x: x <= n_ab)) - 1, 9) st from b_screen,
    (select quantile_cont(n_ab, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) e from b_screen)"""


@query(
    "mantel_haenszel",
    f"""select {_r('sum(se * u / n) / nullif(sum(su * e / n), 0)')} ratio, count(*) n_strata_used from (
      select st, count(*) n, count(*) filter (where d) e, count(*) filter (where not d) u, count(*) filter (where d and s) se, count(*) filter (where not d and s) su from b_mh group by 1)
    where n >= 20 and e > 0 and u > 0""",
)
def mantel_haenszel(b: Base) -> DataFrame:
    """The risk ratio stratified by co-report count."""
    rows = b.screened().select("signal", (F.col("n_implicated") >= 1).alias("documented"), "n_ab")
    return inference.mantel_haenszel(rows, "signal", "documented", "n_ab")


def _signals(b: Base) -> DataFrame:
    return b.screened().select("item_a", "item_b", "n_ab", "support", "n_implicated", "signal", (F.col("n_implicated") >= 1).alias("documented"))


@query("permutation")
def permutation(b: Base) -> DataFrame:
    """Permutation test of the implicated items."""
    return inference.permutation_test(_signals(b), b.implicated(), REPLICATES)


@query("mh_bootstrap")
def mh_bootstrap(b: Base) -> DataFrame:
    """Interval of the stratified ratio, items resampled (I8)."""
    return inference.mh_bootstrap(_signals(b), 1000)


@query("cluster_ci")
def cluster_ci(b: Base) -> DataFrame:
    """Interval of the controls' recovery, first items resampled."""
    return inference.cluster_interval(_signals(b).filter("support = 'positive_control'").select(F.col("item_a").alias("cluster"), F.col("signal").alias("success")), RESAMPLES)


@query("pair_cluster_ci")
def pair_cluster_ci(b: Base) -> DataFrame:
    """Interval of the signal rate, items resampled."""
    return inference.pair_cluster_interval(_signals(b), RESAMPLES)


@query("heldout_calibration")
def heldout_calibration(b: Base) -> DataFrame:
    """Threshold set on one half of the pool, measured on the other."""
    return inference.heldout_calibration(b.pool(), "omega_add_lower", TARGET)


@query("induced_corr")
def induced_corr(b: Base) -> DataFrame:
    """The correlation the model induces by itself."""
    return inference.induced_correlation(b.scored(), "expected", REPLICATES)


@query(
    "bh_fdr",
    f"""with tails as (select item_a, item_b, n_abz, case when n_abz = 0 then 1.0 else {_gamma('ln(greatest(additive_expected, 1e-12))', 'n_abz')} end p from b_scored),
    lined as (select *, p <= 0.05 * count(*) over (order by p range between unbounded preceding and current row) / count(*) over () ok from tails)
    select item_a, item_b, n_abz, {_r('p', 9)} p, coalesce(p <= (select max(p) from lined where ok), false) discovery from tails""",
)
def bh_fdr(b: Base) -> DataFrame:
    """Discoveries among Poisson tails."""
    rows = b.scored().withColumn("p", bounds.poisson_tail(F.col("n_abz"), F.greatest(F.col("additive_expected"), F.lit(1e-12))))
    return inference.benjamini_hochberg(rows.select("item_a", "item_b", "n_abz", "p"), "p").withColumn("p", F.round("p", 9))
