"""The universes of the screening queries."""

from __future__ import annotations

import pytest

from casemill.plans import signals

WHOLE = (20, "primary")


@pytest.fixture(scope="module")
def base(spark):
    """450 items, two and two in five event cases each, so that ties by name rank them; as many cases without items."""
    b = signals.Base(spark, "")
    cases = [(5 * k + i, k) for k in range(225) for i in range(5)]
    rows = [(case, f"I{2 * k + j:03}", True, None, None) for case, k in cases for j in (0, 1)]
    flags = [(case, True, True, None, None) for case, _ in cases] + [(10_000 + i, False, False, None, None) for i in range(len(cases))]
    b.kept["rows", *WHOLE, "core"] = spark.createDataFrame(rows, "case_id bigint, ingredient string, event boolean, era_bin string, sex_key string").cache()
    b.kept["flags", *WHOLE] = spark.createDataFrame(flags, "case_id bigint, is_core boolean, is_broad boolean, era_bin string, sex_key string").cache()
    return b


def test_screen_and_pool_span_the_reference_universe(base):
    assert {(r["item_a"], r["item_b"]) for r in base.pairs().select("item_a", "item_b").collect()} == {(f"I{i:03}", f"I{i + 1:03}") for i in range(0, 200, 2)}
    # Controls are the three pairs of the first six items, seven pairs have both items among the first fifteen.
    assert {r["item_a"] for r in base.pool().select("item_a").collect()} == {f"I{i:03}" for i in range(14, 400, 2)}


def test_sizes_are_swept_around_the_screen(base):
    got = {(r["item_order"], r["n_items"]): r["n_pairs"] for r in signals.screen_sizes(base).collect()}
    assert got == {(order, n): min(n, 450) // 2 for order in ("n_item_event", "n_item") for n in (100, 200, 400, 800)}


def test_replicates_are_those_of_the_reference(base, monkeypatch):
    asked = {}
    take = lambda name, at: lambda *args: asked.setdefault(name, args[at])
    for name, at in (("permutation_test", 2), ("induced_correlation", 2), ("cluster_interval", 1), ("pair_cluster_interval", 1)):
        monkeypatch.setattr(signals.inference, name, take(name, at))
    for f in (signals.permutation, signals.induced_corr, signals.cluster_ci, signals.pair_cluster_ci):
        f(base)
    assert asked == {"permutation_test": 10_000, "induced_correlation": 10_000, "cluster_interval": 20_000, "pair_cluster_interval": 20_000}
