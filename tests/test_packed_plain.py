"""Packed fields without a plain delimiter."""

from __future__ import annotations

import pytest

from casemill.operators import packed


@pytest.fixture(scope="module")
def got(spark):
    texts = ['"ALPHANOL"', "[Betamine]", '"ALPHANOL', "??", "UNKNOWN DRUG", "10 MG", "A\tAND\tB", "A and B", "Alphanol  acid", "SODIUM", "[POTASSIUM CHLORIDE]", "[DELTA] X"]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    found: dict[str, list] = {}
    for r in packed.split_values(df, "text", ["k"], ["ALPHANOL", "BETAMINE"]).orderBy("k", "position").collect():
        found.setdefault(texts[r["k"]], []).append((r["piece"], r["n_pieces"], r["flags"]))
    return found


def test_single_values_go_through_the_grammar(got):
    assert got['"ALPHANOL"'] == [("ALPHANOL", 1, "quoted")] and got["[Betamine]"] == [("BETAMINE", 1, "bracketed")]
    assert got['"ALPHANOL'] == [('"ALPHANOL', 1, "malformed_quote")]
    assert not {"??", "UNKNOWN DRUG", "10 MG"} & set(got)
    assert got["Alphanol  acid"] == [("ALPHANOL ACID", 1, "")] and got["[DELTA] X"] == [("[DELTA] X", 1, "")]


def test_and_between_any_blanks_splits(got):
    assert got["A\tAND\tB"] == got["A and B"] == [("A", 2, ""), ("B", 2, "")]


def test_a_salt_alone_is_a_value(got):
    assert got["SODIUM"] == [("SODIUM", 1, "")] and got["[POTASSIUM CHLORIDE]"] == [("POTASSIUM CHLORIDE", 1, "bracketed")]
