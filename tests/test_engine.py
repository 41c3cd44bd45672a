"""The operators on cases, names, events, pairs, statistics, texts and files."""

from __future__ import annotations

import io
import math
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from casemill.functions import special
from casemill.functions.ordinals import era_of, quarter_index, quarter_name, quarters
from casemill.operators import baskets as B
from casemill.operators import bounds, contingency, events, inference, names, quality, resolve, screen, textref
from casemill.sources import delimited

DEMO = "report_id bigint, case_id bigint, caseversion string, era string, quarter string, event_dt string, sex string, age string, age_cod string, occr_country string, reporter_country string"


def demo_row(report, case, version, era="faers_modern", quarter="2015q1", dt="20150101", sex="F", age="50", cod="YR", country="US"):
    return (report, case, version, era, quarter, dt, sex, age, cod, country, None)


def demo(spark, *rows):
    return spark.createDataFrame(rows, DEMO)


def test_ordinals(spark):
    df = spark.createDataFrame([("2004q1",), ("2012Q4",), ("x",), (None,)], "q string")
    got = df.select(quarter_index(F.col("q")).alias("i"), quarter_name(quarter_index(F.col("q"))).alias("n"), era_of(F.col("q")).alias("e")).collect()
    assert [tuple(r) for r in got] == [(8016, "2004q1", "laers"), (8051, "2012q4", "faers_early"), (None, None, None), (None, None, None)]
    assert [r["quarter"] for r in quarters(spark, "2011q3", "2012q2").orderBy("quarter_idx").collect()] == ["2011q3", "2011q4", "2012q1", "2012q2"]


def test_age_years(spark):
    cases = [("50", "YR", 50), ("50", "", 50), ("50", None, 50), ("24", "MON", 2), ("6", "dec ", 60), ("52", "WK", 1), ("365", "DY", 1), ("", "YR", None), ("abc", "YR", None), ("12d", "YR", None), ("50", "NONSENSE", None)]
    df = spark.createDataFrame([(a, c) for a, c, _ in cases], "a string, c string")
    assert [r[0] for r in df.select(resolve.age_years(F.col("a"), F.col("c"))).collect()] == [w for *_, w in cases]


def test_latest_versions(spark):
    df = demo(spark, demo_row(1, 500, "1"), demo_row(2, 500, "10"), demo_row(3, 500, "9"), demo_row(4, 500, None), demo_row(2, 500, "10"), demo_row(7001, 7, None, "laers"),
              demo_row(7009, 7, "1", "laers"), demo_row(7005, 7, "9", "laers"), demo_row(9, None, "1"), demo_row(8, 7, "1"))
    got = {(r["era_group"], r["case_id"]): r["report_id"] for r in resolve.latest_versions(df).collect()}
    assert got == {("faers", 500): 2, ("laers", 7): 7009, ("faers", 7): 8}
    bridged = {r["case_id"]: r["report_id"] for r in resolve.bridged(resolve.latest_versions(df)).collect()}
    assert bridged == {500: 2, 7: 8}


DRUG, REAC = "report_id bigint, era string, drugname string", "report_id bigint, era string, pt string"


def test_near_duplicates(spark):
    rows = [demo_row(1, 10, "1"), demo_row(2, 11, "1"), demo_row(3, 12, "1"), demo_row(4, 13, "1", dt=""), demo_row(5, 14, "1", dt="")]
    drug = spark.createDataFrame([(1, "faers_modern", "A"), (1, "faers_modern", "b "), (2, "faers_modern", "B"), (2, "faers_modern", "a"), (2, "faers_modern", "A"), (3, "faers_modern", "A"), (4, "faers_modern", "A"), (5, "faers_modern", "A")], DRUG)
    reac = spark.createDataFrame([(i, "faers_modern", "Pain" if i % 2 else "PAIN") for i in range(1, 6)], REAC)
    none = spark.createDataFrame([], "case_id bigint")
    got = {r["case_id"] for r in resolve.case_set(demo(spark, *rows), drug, reac, none).collect()}
    assert got == {10, 12, 13, 14}  # 11 has the sets of 10 in another order; sparse cases stay
    gone = spark.createDataFrame([(10,), (10,)], "case_id bigint")
    assert {r["case_id"] for r in resolve.case_set(demo(spark, *rows), drug, reac, gone).collect()} == {11, 12, 13, 14}
    assert resolve.case_set(demo(spark), drug, reac, none).count() == 0


def test_one_report_in_two_cases(spark):
    df = spark.createDataFrame([("e", 1, "2010q1", 5), ("e", 1, "2010q2", 4), ("e", 2, None, 6)], "era string, report_id bigint, quarter string, case_id bigint")
    assert {r["case_id"] for r in resolve.one_per_report(df).collect()} == {4, 6}


def test_names(spark):
    relaxed = [("LIPITOR (ATORVA) 40 MG/0.8 ML TABLET", "LIPITOR"), ("aspirin 81mg ec tabs", "ASPIRIN EC"), ("X 12", "X"), ("TABLET 5 MG", ""), ("", "")]
    df = spark.createDataFrame([(a,) for a, _ in relaxed], "n string")
    assert [r[0] for r in df.select(names.relaxed(F.col("n"))).collect()] == [w for _, w in relaxed]
    salts = [("ABC FUMARATE DIHYDRATE", "ABC"), ("CALCIUM CARBONATE", "CALCIUM CARBONATE"), ("SODIUM", "SODIUM"), ("LITHIUM CARBONATE", "LITHIUM"), ("ABC-HCL", "ABC"), ("  ", "")]
    df = spark.createDataFrame([(a,) for a, _ in salts], "n string")
    assert [r[0] for r in df.select(names.without_salts(F.col("n"))).collect()] == [w for _, w in salts]


def test_ladder(spark):
    rows = [("m", 1, 1, "ps", "Foo 5 mg", "BAR"), ("m", 2, 1, "PS", " foo  5 MG", None), ("l", 3, 1, "C", "FOO", ""), ("l", 4, 1, "C", "Other 5 MG", None), ("l", 5, 1, "C", " ", None), ("l", 6, 1, "C", "X 1 MG", "A\\B SODIUM")]
    got = names.resolved(spark.createDataFrame(rows, "era string, report_id bigint, drug_seq int, role_cod string, drugname string, prod_ai string"))
    assert {r["report_id"]: (r["resolution_level"], r["ingredient_raw"]) for r in got.collect()} == {1: (1, "BAR"), 2: (2, "BAR"), 3: (3, "BAR"), 4: (4, "OTHER"), 6: (1, "A\\B SODIUM")}
    parts = {(r["report_id"], r["ingredient"]) for r in names.ingredients(got).collect()}
    assert (6, "A") in parts and (6, "B") in parts


def test_continuity(spark):
    axis = [r["quarter"] for r in quarters(spark, "2010q1", "2013q4").orderBy("quarter_idx").collect()]

    def status(counts):
        rows = [("C", q, i * 1000 + k) for i, q in enumerate(axis) for k in range(counts.get(q, 0))]
        df = spark.createDataFrame(rows, "concept string, quarter string, case_id bigint")
        return events.continuity(df, axis[0], axis[-1]).first()["status"]

    assert status({q: 20 for q in axis}) == "PASS"
    assert status({q: 20 for q in axis[:-1]}) == "BREAK"  # given up in the last quarter
    assert status({q: 20 for q in axis if q != axis[8]}) == "BREAK"
    assert status({q: 20 for q in axis[9:]}) == "PASS"  # begins late
    assert status({q: 2 for q in axis[:-3]}) == "PASS"  # too few to tell


def test_population_keeps_cases_without_items(spark):
    cases = spark.createDataFrame([(1, "e", 1), (2, "e", 2), (3, "e", 3)], "case_id bigint, era string, report_id bigint")
    items = spark.createDataFrame([("e", 1, "PS", "a"), ("e", 1, "PS", "A "), ("e", 1, "C", "z"), ("e", 2, "SS", "a"), ("e", 2, "SS", "b"), ("e", 2, "I", "c")], "era string, report_id bigint, role_cod string, ingredient string")
    raw = B.raw_baskets(items, cases)
    assert {tuple(r) for r in raw.collect()} == {(1, "A"), (2, "A"), (2, "B"), (2, "C")}
    found = spark.createDataFrame([(1, True, True)], "case_id bigint, is_core boolean, is_broad boolean")
    flags = B.population(cases, found, B.excluded_cases(raw, 2))
    assert {tuple(r) for r in flags.collect()} == {(1, True, True), (3, False, False)}
    assert B.population(cases, found, B.excluded_cases(raw, None)).count() == 3


def test_pair_counts_against_loops(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = sorted({(int(c), f"I{i}", bool(c % 3 == 0)) for c, i in zip(rng.integers(0, 60, 400), rng.integers(0, 9, 400))})
    want = {}
    for c in {r[0] for r in rows}:
        items = sorted(r[1] for r in rows if r[0] == c)
        for i, a in enumerate(items):
            for b in items[i + 1 :]:
                n, z = want.get((a, b), (0, 0))
                want[a, b] = (n + 1, z + (c % 3 == 0))
    df = spark.createDataFrame(rows, "case_id bigint, ingredient string, event boolean")
    for block in (B.BLOCK, 3):  # all baskets over three items are split into parts
        monkeypatch.setattr(B, "BLOCK", block)
        assert {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_abz"]) for r in B.pair_counts(df).collect()} == want
    assert B.pair_counts(df.limit(0)).count() == 0


def test_cap_sweep_against_loops(spark):
    rng = np.random.default_rng(2)
    baskets = {c: {f"I{i}" for i in rng.integers(0, 9, rng.integers(0, 8))} for c in range(50)}
    raw = spark.createDataFrame([(c, i) for c, items in baskets.items() for i in sorted(items)], "case_id bigint, ingredient string")
    flags = spark.createDataFrame([(c, c % 4 == 0) for c in baskets], "case_id bigint, is_core boolean")
    for r in B.cap_sweep(raw, flags, (0, 2, 4, None)).collect():
        kept = {c: x for c, x in baskets.items() if r["cap"] is None or len(x) <= r["cap"]}
        pairs = [(a, b) for x in kept.values() for a in x for b in x if a < b]
        assert (r["n_total"], r["n_event"], r["n_pairs"], r["pair_rows"]) == (len(kept), sum(c % 4 == 0 for c in kept), len(set(pairs)), len(pairs))


def test_lists_of_pairs_keep_their_order(spark):
    schema = "item_a string, item_b string, x int"
    one, two = spark.createDataFrame([("C", "D", 3), ("A", "B", 2)], schema).orderBy("x", ascending=False).limit(5), spark.createDataFrame([("A", "B", 1), ("A", "Z", 1)], schema)
    got = screen.ordered_union([one, two]).orderBy("position").collect()
    assert [(r["item_a"], r["item_b"]) for r in got] == [("C", "D"), ("A", "B"), ("A", "Z")]


def test_samples_are_those_of_the_whole_stratum(spark):
    pool = spark.createDataFrame([(f"A{i}", f"B{i % 7}", "hard" if i % 3 else "easy") for i in range(300)], "item_a string, item_b string, stratum string")
    got = screen.sampled(pool, 10, 3).orderBy("stratum", "item_a", "item_b").collect()
    from hashlib import md5

    want = []
    for stratum in ("easy", "hard"):
        rows = [r for r in pool.collect() if r["stratum"] == stratum]
        want += sorted(sorted(rows, key=lambda r: md5(f"3|{r['item_a']}|{r['item_b']}".encode()).hexdigest())[:10])
    assert got == want
    assert screen.sampled(pool.limit(0), 10).count() == 0


def test_bounds_are_quantiles_of_the_gamma_law(spark):
    """At the bound the distribution function of the shrunk rate is the level asked for."""
    rows = [(float(n), e) for n in (0, 1, 2, 7, 40) for e in (0.0, 0.3, 2.0, 55.5)]
    df = spark.createDataFrame(rows, "n double, e double").select("n", "e", *(bounds.log_ratio_bound(F.col("n"), F.col("e"), q).alias(f"b{q}".replace(".", "_")) for q in (0.025, 0.975)))
    for r in df.collect():
        for q, b in ((0.025, r["b0_025"]), (0.975, r["b0_975"])):
            assert float(special.gamma_p(r["n"] + 0.5, 2**b * (r["e"] + 0.5))) == pytest.approx(q, abs=1e-9)


def ipf(table, sweeps=5000):
    fit = np.ones((2, 2, 2))
    for _ in range(sweeps):
        for axis in (2, 1, 0):
            fit *= np.expand_dims(table.sum(axis) / np.maximum(fit.sum(axis), 1e-300), axis)
    return fit[1, 1, 1]


def margins(t):
    return tuple(float(x) for x in (t[1, 1, 1], t[1, 1].sum(), t[1, :, 1].sum(), t[:, 1, 1].sum(), t[1].sum(), t[:, 1].sum(), t[:, :, 1].sum(), t.sum()))


COUNTS = "n_abz double, n_ab double, n_az double, n_bz double, n_a double, n_b double, n_event double, n_total double"


def test_expected_against_proportional_fitting(spark):
    rng = np.random.default_rng(3)
    tables = [rng.dirichlet(np.full(8, 2.0)).reshape(2, 2, 2) * 1e5 for _ in range(20)]
    df = spark.createDataFrame([(*margins(t), float(ipf(t))) for t in tables], COUNTS + ", want double")
    for r in contingency.scored(df).collect():
        assert r["expected"] == pytest.approx(r["want"], rel=1e-6)


def test_no_synergy_scores_zero(spark):
    a, b, z = np.meshgrid([0, 1], [0, 1], [0, 1], indexing="ij")
    t = np.exp(-3 * a - 2 * b - 4 * z + 0.7 * a * b + 1.1 * a * z + 0.5 * b * z)
    t = t / t.sum() * 1e7
    r = contingency.scored(spark.createDataFrame([margins(t)], COUNTS)).first()
    assert r["omega"] == pytest.approx(0, abs=1e-6) and abs(r["naive_log2_oe"]) > 0.1


def test_degenerate_margins_give_null(spark):
    r = contingency.scored(spark.createDataFrame([(0.0, 0.0, 0.0, 0.0, 0.0, 5.0, 0.0, 10.0)], COUNTS)).first()
    assert r["expected"] is None and r["additive_expected"] is None and r["omega"] is None


def test_additive_floor(spark):
    r = contingency.scored(spark.createDataFrame([(1.0, 100.0, 1.0, 2.0, 1000.0, 1000.0, 500.0, 10000.0)], COUNTS)).first()
    assert r["additive_expected"] == pytest.approx(0.2)  # the larger single risk, not a negative number


def test_special_functions():
    shapes = np.array([0.5, 1, 3.5, 40, 1e4])
    for q in (0.025, 0.5, 0.975):
        assert np.allclose(special.gamma_p(shapes, special.gamma_quantile(q, shapes)), q, atol=1e-9)
    assert special.gamma_p(1.0, 2.0) == pytest.approx(1 - math.exp(-2))
    assert special.beta_i(2, 3, 0.4) == pytest.approx(0.5248)
    assert special.beta_quantile(0.5, np.array([2.0]), np.array([2.0]))[0] == pytest.approx(0.5)
    assert special.student_p(2.228, 10) == pytest.approx(0.05, abs=1e-4)


def test_bounds(spark):
    df = spark.createDataFrame([(0.0, 2.0), (10.0, 2.0), (None, 2.0), (3.0, None)], "n double, e double")
    got = df.select("n", bounds.log_ratio_bound(F.col("n"), F.col("e")).alias("low"), bounds.log_ratio_bound(F.col("n"), F.col("e"), 0.975).alias("high"), bounds.poisson_tail(F.col("n"), F.col("e")).alias("p")).collect()
    assert got[0]["low"] < got[0]["high"] and got[1]["low"] > 0 and got[2]["low"] is None and got[3]["low"] is None
    assert got[0]["p"] == 1 and got[1]["p"] == pytest.approx(4.65e-5, rel=1e-2)
    ci = spark.createDataFrame([(0, 10), (10, 10), (5, 10), (0, 0)], "k int, n int").select(bounds.jeffreys(F.col("k"), F.col("n")).alias("c")).collect()
    assert ci[0]["c"]["low"] == 0 and ci[1]["c"]["high"] == 1 and ci[2]["c"]["low"] == pytest.approx(0.2235, abs=1e-3) and math.isnan(ci[3]["c"]["low"] or float("nan"))


def pairs_frame(spark, n=30, seed=0):
    rng = np.random.default_rng(seed)
    rows = [(f"I{i:02d}", f"I{j:02d}", bool(rng.random() < (0.6 if i < 8 and j < 8 else 0.1)), bool(rng.random() < 0.3), float(rng.integers(5, 500))) for i in range(n) for j in range(i + 1, n)]
    return spark.createDataFrame(rows, "item_a string, item_b string, signal boolean, documented boolean, n_ab double")


def test_permutation_and_bootstraps(spark):
    pairs = pairs_frame(spark)
    implicated = spark.createDataFrame([(f"I{i:02d}",) for i in range(8)], "ingredient string")
    one = inference.permutation_test(pairs, implicated, 200).first()
    assert one["observed"] > 2 and one["p_value"] < 0.02 and one["n_implicated"] == 8
    assert inference.permutation_test(pairs.repartition(7), implicated, 200).first() == one  # whatever the partitioning
    ci = inference.pair_cluster_interval(pairs, 300).first()
    assert ci["n_effective"] >= 100 and ci["ci_low"] < ci["ci_high"]
    assert inference.mh_bootstrap(pairs, 150).first()["n_effective"] > 0
    trials = spark.createDataFrame([(f"c{i % 4}", i % 3 > 0) for i in range(40)], "cluster string, success boolean")
    low, high = inference.cluster_interval(trials, 300).select("ci_low", "ci_high").first()
    assert 0 <= low <= 2 / 3 <= high <= 1


def test_mantel_haenszel_against_arrays(spark):
    pairs = pairs_frame(spark, seed=4)
    frame = pairs.toPandas()
    want = inference.mh_ratio(frame["signal"].to_numpy(bool), frame["documented"].to_numpy(bool), frame["n_ab"].to_numpy(float))
    assert inference.mantel_haenszel(pairs, "signal", "documented", "n_ab").first()["ratio"] == pytest.approx(want, abs=1e-5)


def test_benjamini_hochberg(spark):
    rng = np.random.default_rng(2)
    p = np.round(np.concatenate([rng.uniform(0, 0.002, 40), rng.uniform(0, 1, 200)]), 4)
    order = np.sort(p)
    passing = np.where(order <= 0.05 * np.arange(1, len(p) + 1) / len(p))[0]
    want = int((p <= order[passing[-1]]).sum())
    df = spark.createDataFrame([(float(x),) for x in p] + [(None,)], "p double")
    assert inference.benjamini_hochberg(df, "p").filter("discovery").count() == want
    assert inference.benjamini_hochberg(spark.createDataFrame([], "p double"), "p").count() == 0


def test_closed_forms(spark):
    r = spark.range(1).select(inference.rule_of_three(F.lit(100)).alias("u"), *(c.alias(n) for c, n in zip(inference.ratio_interval(F.lit(10), F.lit(100), F.lit(5), F.lit(100)), "rlh"))).first()
    assert r["u"] == pytest.approx(0.02996, abs=1e-4) and r["r"] == pytest.approx(2) and r["l"] < 1 < 2 < r["h"]
    loo = inference.leave_one_out(spark.createDataFrame([(True, False), (True, True), (False, True), (True, False)], "a boolean, m boolean"), "a", "m").first()
    assert loo["n_folds"] == 4 and loo["in_sample_recovered"] == 3
    xs = [(float(x), 2.0 * x + (x % 3)) for x in range(30)]
    c = inference.correlation(spark.createDataFrame(xs, "x double, y double"), "x", "y").first()
    assert c["ci_low"] < c["r"] < c["ci_high"] and c["p_value"] < 1e-6


def test_screen_bands_and_pool(spark):
    rows = [("A", "B", 100, 3.0, 2.5, 2.5), ("A", "C", 90, 1.0, 2.5, 1.0), ("C", "D", 120, -1.0, 1.0, 1.0), ("D", "E", 5000, 0.0, 3.0, 1.0), ("E", "F", 150, 0.5, 3.0, None)]
    df = spark.createDataFrame(rows, "item_a string, item_b string, n_ab int, omega_add double, rr_a double, rr_b double")
    controls, implicated = spark.createDataFrame([("b", " a")], "item_a string, item_b string"), spark.createDataFrame([("A",), ("B",)], "ingredient string")
    bands = {(r["item_a"], r["item_b"]): r["support"] for r in screen.annotated(df, controls, implicated).collect()}
    assert bands == {("A", "B"): "positive_control", ("A", "C"): "plausible", ("C", "D"): "unsupported", ("D", "E"): "unsupported", ("E", "F"): "unsupported"}
    pool = {(r["item_a"], r["item_b"]): r["stratum"] for r in screen.negative_pool(df, controls, implicated).collect()}
    assert pool == {("A", "C"): "hard", ("C", "D"): "easy", ("E", "F"): "hard"}  # D-E is too frequent
    none = screen.control_results(spark.createDataFrame([("X", "Y")], "item_a string, item_b string"), df.withColumn("n_abz", F.lit(0)), ["omega_add"]).first()
    assert none["n_ab"] == 0 and none["signal_omega_add"] is False


def test_partner_excess(spark):
    rng = np.random.default_rng(6)
    rows = [(f"I{i}", f"I{j}", int(rng.integers(1, 60)), 0) for i in range(9) for j in range(i + 1, 9)]
    rows = [(a, b, n, int(rng.integers(0, n + 1))) for a, b, n, _ in rows]
    got = contingency.partner_excess(spark.createDataFrame(rows, "item_a string, item_b string, n_ab int, n_abz int"), 20, 3)
    rates = {}
    for a, b, n, z in rows:
        if n >= 20:
            rates.setdefault(a, {})[b] = rates.setdefault(b, {})[a] = z / n
    for r in got.collect():
        a, b = r["item_a"], r["item_b"]
        n, z = next((n, z) for x, y, n, z in rows if (x, y) == (a, b))
        sides = []
        for me, other in ((a, b), (b, a)):
            mine = [v for k, v in rates.get(me, {}).items() if k != other]
            sides.append(math.log2((z + 0.5) / (n * float(np.median(mine)) + 0.5)) if len(mine) >= 3 else None)
        want = None if None in sides else min(sides)
        assert (r["partner_excess"] is None) == (want is None) and (want is None or r["partner_excess"] == pytest.approx(want))


def test_fuzzy_duplicates_against_loops(spark):
    rng = np.random.default_rng(8)
    base = [sorted(rng.choice(12, size=rng.integers(1, 9), replace=False)) for _ in range(12)]
    baskets_ = []
    for case in range(60):
        items = set(base[case % 12])
        if rng.random() < 0.5:
            items ^= {int(rng.integers(0, 12))}
        baskets_.append((case, items or {0}, "d1" if case % 2 else "d2"))
    cases = spark.createDataFrame([(c, d, 50.0, "F", "US") for c, _, d in baskets_], "case_id bigint, event_dt string, age_years double, sex string, country string")
    rows = spark.createDataFrame([(c, f"i{i}", True) for c, x, _ in baskets_ for i in x], "case_id bigint, ingredient string, event boolean")
    exact, fuzzy, later = 0, 0, set()
    for c, x, d in baskets_:
        for e, y, f in baskets_:
            if c < e and d == f:
                if x == y:
                    exact += 1
                elif len(x & y) / len(x | y) >= 0.8:
                    fuzzy += 1
                    later.add(e)
    assert tuple(screen.fuzzy_duplicates(cases, rows).first()) == (60, exact, fuzzy, len(later))


def test_mentions(spark):
    docs = spark.createDataFrame([("ALPHA", "Take with betamine. " + "x" * 700 + " muscle pain with BETAMINE, avoid."), ("BETAMINE", "no partner"), ("GAMMA", None), ("DELTA", ""), ("EPS", "BETAMINES and UN-BETAMINE ACID X"), (None, "BETAMINE")], "ingredient string, text string")
    terms = spark.createDataFrame([("BETAMINE",), ("ALPHA",), ("X",), ("BETAMINE ACID",), ("Betamine",)], "term string")
    found = textref.mentions(docs, terms, "ingredient", "MUSCLE", "AVOID")
    assert sorted(textref.mentions(docs, terms, "ingredient", "MUSCLE", "AVOID", most=0).collect()) == sorted(found.collect())  # terms too many to send
    got = {(r["ingredient"], r["term"]): (r["n_mentions"], r["near"], r["near_first"], r["restricted_first"]) for r in found.collect()}
    assert got == {("ALPHA", "BETAMINE"): (2, True, False, False), ("EPS", "BETAMINE"): (1, False, False, False), ("EPS", "BETAMINE ACID"): (1, False, False, False)}
    status = {r["item_a"] + r["item_b"]: r["status"] for r in textref.verified_pairs(spark.createDataFrame([("ALPHA", "BETAMINE"), ("DELTA", "GAMMA"), ("BETAMINE", "EPS"), ("ALPHA", "EPS")], "item_a string, item_b string"), docs, found).collect()}
    assert status == {"ALPHABETAMINE": "other_mention", "DELTAGAMMA": "no_text", "BETAMINEEPS": "other_mention", "ALPHAEPS": "not_found"}


def test_archives(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("ascii/REAC04Q1.TXT", "ISR$PT\r\n4204616$NAUSEA$\r\n\r\n4204617$X$UNEXPECTED\r\n".encode())
        z.writestr("ascii/DRUG04Q1.TXT", b"ISR$DRUGNAME\r\n1$CROHN\x92S\r\n")
        z.writestr("deleted/ADR04Q1DeletedCases.txt", "12 34\n34 x")
        z.writestr("readme.pdf", "x")
    (tmp_path / "b.zip").write_bytes(b"no archive")
    ok = {r["path"].rsplit("/", 1)[-1]: (r["ok"], r["n_members"]) for r in delimited.archives(spark, str(tmp_path)).collect()}
    assert ok == {"a.zip": (True, 4), "b.zip": (False, 0)}
    members = delimited.members(spark, str(tmp_path / "a.zip"))
    name, kind = delimited.classified(F.col("member"))
    kinds = {r["member"]: (r["t"], r["k"]) for r in members.select("member", name.alias("t"), kind.alias("k")).collect()}
    assert kinds["ascii/REAC04Q1.TXT"] == ("reac", "table") and kinds["deleted/ADR04Q1DeletedCases.txt"] == (None, "deleted_cases") and kinds["readme.pdf"][1] == "documentation"
    lines = delimited.lines_of(members)
    reac = lines.filter("member like '%REAC%' and line_no > 1")
    names_ = delimited.harmonised("﻿ISR$PT")
    assert names_ == ["report_id", "pt"]
    got = {tuple(r) for r in delimited.split_fields(reac, names_).select("report_id", "pt", "has_trailing", "n_surplus").collect()}
    assert got == {("4204616", "NAUSEA", True, 0), ("4204617", "X", True, 1)}
    heads = spark.createDataFrame([(1, names_)], "file_id int, names array<string>")
    more = reac.select(F.lit(1).alias("file_id"), "line").union(spark.createDataFrame([(1, "$".join("abcdefghi")), (1, "7")], "file_id int, line string"))
    stats = delimited.scan_statistics(delimited.split_by_header(more, heads).withColumn("t", F.lit("reac")), "t").first()
    assert (stats["rows_raw"], stats["rows_skipped"], stats["trailing"], stats["surplus_values"]) == (4, 1, 2, 1)
    first = {r["member"]: r["names"] for r in delimited.member_headers(spark, str(tmp_path / "a.zip")).collect()}
    assert first["ascii/REAC04Q1.TXT"] == ["isr", "pt"] and first["ascii/DRUG04Q1.TXT"] == ["isr", "drugname"]
    assert "CROHN’S" in {r["line"].split("$")[1] for r in lines.filter("member like '%DRUG%' and line_no > 1").collect()}
    assert {r[0] for r in delimited.id_list(lines.filter("member like '%elet%'")).collect()} == {12, 34}
    with pytest.raises(ValueError):
        delimited.harmonised("ISR$PRIMARYID")


def test_sinks(spark, tmp_path):
    one = spark.createDataFrame([(1, "2010q1")], "report_id bigint, quarter string")
    delimited.write_parquet(one, str(tmp_path / "p"))
    spark.createDataFrame([(2, "x")], "report_id bigint, extra string").write.parquet(str(tmp_path / "p" / "quarter=2010q2"))
    back = delimited.read_parquet(spark, str(tmp_path / "p"))
    assert set(back.columns) == {"report_id", "quarter", "extra"} and back.count() == 2
    delimited.write_csv(one.withColumn("more", F.lit(1)), str(tmp_path / "c"), ["report_id", "quarter"])
    assert delimited.read_csv(spark, str(tmp_path / "c"), "report_id bigint, quarter string").first()["quarter"] == "2010q1"
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "A.json").write_text('{\n"ingredient": "A", "found": true,\n "text": "T"}')
    assert tuple(delimited.read_label_documents(spark, str(tmp_path / "j")).first()) == ("A", True, "T")


def test_quality(spark):
    child, parent = spark.createDataFrame([("q", 1), ("q", 2), ("q", None), ("q", 2)], "quarter string, report_id bigint"), spark.createDataFrame([("q", 1), ("q", 1)], "quarter string, report_id bigint")
    r = quality.orphans(child, parent, ["quarter", "report_id"]).first()
    assert (r["n_rows"], r["orphans"], r["status"]) == (4, 3, "FAIL")
    assert quality.orphans(child.limit(0), parent, ["quarter", "report_id"]).first()["status"] == "PASS"
    assert [tuple(x) for x in quality.duplicate_keys(child, "report_id", "quarter").collect()] == [("q", 4, 2, 2)]
    casts = {x["column_name"]: x["failures"] for x in quality.cast_failures(spark.createDataFrame([("1", "2.5"), ("x", "1d"), ("", None)], "a string, b string"), {"a": "bigint", "b": "double"}).collect()}
    assert casts == {"a": 1, "b": 1}
    lay = spark.createDataFrame([(1, "demo", "2010q1", 1, ["a", "b"]), (1, "demo", "2010q2", 2, ["b", "a"]), (1, "demo", "2010q3", 3, ["a", "c"])], "series_id bigint, table_name string, quarter string, file_id bigint, names array<string>")
    assert [(x["quarter"], x["added"], x["removed"]) for x in quality.column_changes(lay).orderBy("quarter").collect()] == [("2010q1", "a;b", ""), ("2010q3", "c", "b")]


def test_streaming(spark, tmp_path):
    from casemill.streaming import arrivals

    schema = demo(spark).schema
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    demo(spark, demo_row(1, 10, "1"), demo_row(2, 11, "1")).coalesce(1).write.parquet(source)
    demo(spark, demo_row(3, 10, "2"), demo_row(1, 10, "1")).coalesce(1).write.mode("append").parquet(source)
    stream = arrivals.read_arrivals(spark, source, schema, 1)
    run = stream.writeStream.foreachBatch(arrivals.superseding(target)).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    run.awaitTermination(120)
    last = max((tmp_path / "out").iterdir(), key=lambda p: int(p.name.split("=")[1]))
    assert {r["case_id"]: r["report_id"] for r in spark.read.parquet(str(last)).collect()} == {10: 3, 11: 2}


def test_every_query_is_callable():
    import __spark_entry__ as entry

    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(callable(q) for q in queries.values())


def test_catalog_and_settings(spark, tmp_path, small):
    from casemill.sources import catalog

    catalog.register(spark, small, ["substances", "drug_ingredients"], "t_")
    assert spark.sql("select count(*) from t_substances").first()[0] > 700
    name = spark.sql("select ingredient from t_drug_ingredients where ingredient like '% %' order by 1 limit 1").first()[0]
    got = {r[0] for r in catalog.like_prefix(spark, "t_drug_ingredients", "ingredient", name.split(" ")[0]).collect()}
    assert name in got and all(x.startswith(name.split(" ")[0] + " ") for x in got)
    assert catalog.like_prefix(spark, "t_drug_ingredients", "ingredient", "x' or '1'='1").count() == 0
    settings = catalog.Settings(least_pair=5).calibrated(0.25)
    catalog.write_settings(spark, settings, str(tmp_path / "s"))
    assert catalog.read_settings(spark, str(tmp_path / "s")) == settings
    catalog.write_settings(spark, catalog.Settings(), str(tmp_path / "s"))
    assert catalog.read_settings(spark, str(tmp_path / "s")) == catalog.Settings()
