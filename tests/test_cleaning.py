"""Units, drift, packed fields and error parse, on fixtures with every kind of dirt."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from casemill.operators import badrows, drift, packed, units
from casemill.operators.packed import Grammar

AGE = "report_id bigint, mfr_sndr string, age string, age_cod string, quarter string"


@pytest.mark.parametrize(
    ("shape", "unit"),
    [("# yrs", "YR"), ("# mnoths", "MON"), ("approx. # weeks", "WK"), ("p#d", "DY"), ("pt#h", "HR"), ("#/12", "MON"), ("#/52", "WK"), ("#-month-old", "MON"),
     ("# décennies", "DEC"), ("day # of life", "DY"), ("# y/o", "YR"), ("# woche", "WK"), ("#", None)],
)
def test_units_of_shapes(shape, unit):
    got, _, readable = units.reading(shape)
    assert readable and got == unit


@pytest.mark.parametrize("shape", ["adult", "?", "unk", "na", "# months # days", "# years # months", "", "#/99", "p#q"])
def test_unreadable_shapes(shape):
    assert not units.reading(shape)[2]


@pytest.mark.parametrize("code", ["unk", "zz", "?", "mg", "xyz"])
def test_unknown_codes(code):
    assert units.unit_of(code) is None


def test_ages(spark):
    rows = [(1, "A", "50", "YR", "q"), (2, "A", "24", "MON", "q"), (3, "A", "7,5", "DEC", "q"), (4, "A", "five months", None, "q"), (5, "A", "50", "ZZ", "q"), (6, "A", None, "YR", "q"),
            (7, "A", "", "", "q"), (8, None, "30", None, "q"), (8, None, "30", None, "q"), (9, "A", "x" * 5000, "YR", "q"), (10, "A", "60 yrs", "MON", "q")]
    rows += [(100 + i, "Months Ltd", str(200 + 20 * i), None, "q") for i in range(40)]
    got = {r["report_id"]: r for r in units.ages(spark.createDataFrame(rows, AGE).withColumn("unit", F.lit("clash"))).collect()}
    years = {k: round(r["age_years"], 3) if r["age_years"] is not None else None for k, r in got.items() if k < 100}
    assert years == {1: 50, 2: 2, 3: 75, 4: round(5 / 12, 3), 5: None, 6: None, 7: None, 8: 30, 9: None, 10: 60}
    assert all(got[100 + i]["age_unit"] == "MON" and got[100 + i]["age_unit_from"] == "source" for i in range(40))
    assert got[1]["unit"] == "clash"
    assert units.ages(spark.createDataFrame(rows, AGE)).count() == len(rows)


def test_sender_of_children_in_months(spark):
    """Values impossible as years are not years, however near their median is to an adult's age."""
    rows = [(i, "A", str(40 + i), "YR", "q") for i in range(30)] + [(100 + i, "Child Ltd", str(5 * i + 3), None, "q") for i in range(40)]
    got = units.ages(spark.createDataFrame(rows, AGE)).filter("report_id >= 100").select("age_unit").distinct().collect()
    assert [r[0] for r in got] == ["MON"]


def test_no_ages(spark):
    assert units.ages(spark.createDataFrame([], AGE)).count() == 0


def cost_by_search(line: str, width: int) -> int:
    """Least number of edits by trying all lines up to two edits away."""
    marks = '"$'
    level, seen = {line}, {line}
    for cost in range(4):
        for x in level:
            fields = badrows.split_line(x)
            if fields is not None and (len(fields) == width or len(fields) == width + 1 and fields[-1] == ""):
                return cost
        nxt = set()
        for x in level:
            nxt |= {x[:i] + m + x[i:] for i in range(len(x) + 1) for m in marks}
            nxt |= {x[:i] + x[i + 1 :] for i in range(len(x)) if x[i] in marks}
        level = nxt - seen
        seen |= nxt
    return 4


def test_cheapest_edits_against_search():
    rng = random.Random(5)
    for _ in range(150):
        line, width = "".join(rng.choice('ab$"') for _ in range(rng.randint(0, 7))), rng.randint(1, 4)
        want = cost_by_search(line, width)
        if want < 4:
            fields = badrows.split_line(line)
            zero = fields is not None and (len(fields) == width or len(fields) == width + 1 and fields[-1] == "")
            got = 0 if zero else len(badrows.cheapest_edits(line, width))
            assert got == want, (line, width, got, want)


def test_few_edits_against_the_table():
    rng = random.Random(6)
    assert len(badrows.cheapest_edits("1$b$c$d$", 3)) == 1
    for _ in range(400):
        line, width = "".join(rng.choice("ab$$") for _ in range(rng.randint(0, 9))), rng.randint(1, 5)
        assert len(badrows.cheapest_edits(line, width)) == len(badrows.searched_edits(line, width)), (line, width)


def test_a_path_without_edits_is_the_split():
    """The table finds cost 0 exactly where the splitter gives the header's count of fields."""
    rng = random.Random(7)
    for _ in range(600):
        line, width = "".join(rng.choice('a"$') for _ in range(rng.randint(0, 9))), rng.randint(1, 4)
        fields = badrows.split_line(line)
        free = fields is not None and (len(fields) == width or len(fields) == width + 1 and fields[-1] == "")
        assert free == (not badrows.searched_edits(line, width)), (line, width)


@pytest.mark.parametrize(
    ("line", "fields"),
    [("1$a", ["1", "a"]), ('1$"a$b"', ["1", "a$b"]), ('1$"a ""b"""', ["1", 'a "b"']), ("1$a$", ["1", "a"]), ("12345678901234567.0$x", ["12345678901234567.0", "x"]), ('1$5" tip', ["1", '5" tip'])],
)
def test_lines_that_load(line, fields):
    assert badrows.read_line(line, 2, 0, 1) == (fields, None)


@pytest.mark.parametrize(
    ("line", "reason"),
    [('1$"a', "quoting"), ('1$"a"b', "quoting"), ("1", "field_count"), ("1$a$b", "field_count"), ("1$a$$", "field_count"), ("x$a", "report_id"), ("1234567890123456789$a", "report_id"),
     ("$a", "report_id"), ("1$ ", "drugname"), ("1$a\tb", "drugname"), ("1$a�", "drugname"), ("1.00$a", "report_id")],
)
def test_lines_that_fail(line, reason):
    fields, why = badrows.read_line(line, 2, 0, 1)
    assert fields is None and why.startswith(reason)


FILES = "file_id bigint, series_id bigint, table_name string, quarter string, received_at string"
LINES = "file_id bigint, line_no int, line string"


def drifting(spark):
    files = [(1, 1, "demo", "2010q1", "b"), (2, 1, "demo", "2010q2", "a"), (3, 1, "demo", "2010q4", "c"), (4, 2, "drug", "2010q1", "d")]
    texts = {
        1: ["ISR$GNDR_COD$Age$Note$Extra", "1$F$50$x1$v", "2$M$51$x2$w", " "],
        2: ["﻿isr $sex$Age$comment", "3$1$52.5$x1", "4$2$60$x2", "\r", None],
        3: ["sex$primaryid$age$comment", "1$5.0$a$x1", "2$6.0$7$"],
        4: ["primaryid$drugname", "7$ ", "8$A\r"],
    }
    lines = [(f, i, line) for f, ls in texts.items() for i, line in enumerate(ls, 1)]
    return spark.createDataFrame(files, FILES), spark.createDataFrame(lines, LINES)


def test_changes(spark):
    files, lines = drifting(spark)
    profile = drift.profiles(files, lines)
    got = {tuple(r) for r in drift.changes(drift.layouts(files, badrows.headers(files, lines), profile)).collect()}
    assert got == {
        (2, "sex", "renamed"), (2, "sex", "retyped"), (2, "age", "retyped"), (2, "comment", "renamed"), (2, "extra", "removed"),
        (3, "primaryid", "renamed"), (3, "primaryid", "retyped"), (3, "age", "retyped"),
    }


def test_rescue_and_promotion(spark):
    files, lines = drifting(spark)
    parsed = badrows.parse(files, lines)
    demo = drift.ingest(files, lines, "demo")
    rows = {r["report_id"]: r for r in demo.collect()}
    assert set(rows) == {1, 2, 3, 4, 5, 6}
    assert rows[1]["sex"] == "F" and rows[3]["sex"] == "1" and rows[3]["age"] == 52.5
    assert rows[5]["age"] is None and '"age":"a"' in rows[5]["_rescued"]
    assert '"note":"x1"' in rows[1]["_rescued"] and rows[6]["_rescued"] is None
    more = drift.promote(demo, "comment", "string")
    assert {r["comment"] for r in more.collect()} == {None, "x1", "x2"}
    fixed = {r["report_id"]: r for r in drift.replay(demo, {"age": "string"}).collect()}
    assert fixed[5]["age"] == "a" and fixed[5]["_rescued"] == '{"comment":"x1"}'
    assert [tuple(r) for r in badrows.rejected(parsed).select("file_id", "line_no").collect()] == [(4, 2)]


def test_renames_no_list_knows(spark):
    """Columns under names of no attribute: those whose values recur are found again, others are removed and added."""
    rng = random.Random(8)
    words = ["".join(rng.choice("bdfgklmn") + rng.choice("aeiou") for _ in range(3)) for _ in range(400)]
    columns = [[rng.choice(words) for _ in range(rng.choice((2, 5, 12, 40)))] for _ in range(40)]  # each column has values of its own
    files, lines, planted = [], [], set()
    for series in range(20):
        names = [f"c{series}_{i}" for i in range(6)]
        kinds = rng.sample(range(len(columns)), 6)
        for quarter in (1, 2):
            file_id = 2 * series + quarter
            files.append((file_id, series, "demo", f"2010q{quarter}", "x"))
            if quarter == 2:
                for i in rng.sample(range(6), 2):
                    names[i] = f"new{series}_{i}"
                    planted.add((file_id, names[i], "renamed"))
            lines.append((file_id, 1, "$".join(["isr", *names])))
            lines += [(file_id, n, "$".join([str(n), *(rng.choice(columns[k]) for k in kinds)])) for n in range(2, 302)]
    files, lines = spark.createDataFrame(files, FILES), spark.createDataFrame(lines, LINES)
    got = {tuple(r) for r in drift.changes(drift.layouts(files, badrows.headers(files, lines), drift.profiles(files, lines))).collect()}
    found = {g for g in got if g[2] == "renamed"}
    assert len(found & planted) >= 0.9 * len(planted) and len(found - planted) <= 0.1 * len(found)


def test_empty_files(spark):
    files, lines = spark.createDataFrame([], FILES), spark.createDataFrame([(9, 2, "1$2")], LINES)
    parsed = badrows.parse(files, lines)
    assert [r["reason"] for r in parsed.collect()] == ["no_header"]
    assert drift.ingest(files, lines, "demo").count() == 0


NAMES = ["ALPHANOL", "BETAMINE", "GAMMASIN ACID", "DELTAVIR, BOVINE", "EPSILO AND ZETARIN EXTRACT", "ETA-THETANE"]


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ("ALPHANOL\\BETAMINE", ["ALPHANOL", "BETAMINE"]),
        ("alphanol / betamine and gammasin acid sodium", ["alphanol", "betamine", "gammasin acid sodium"]),
        ('"DELTAVIR, BOVINE";X', ["DELTAVIR, BOVINE", "X"]),
        ("DELTAVIR, BOVIN SODIUM\\ALPHANOL", ["DELTAVIR, BOVIN SODIUM", "ALPHANOL"]),
        ("EPSILO AND ZETARI", ["EPSILO AND ZETARI"]),
        ("EPSILO AND BETAMINE", ["EPSILO", "BETAMINE"]),
        ("ALPHANOL 0,9%", ["ALPHANOL 0,9%"]),
        ("ALPHANOL 70/30", ["ALPHANOL 70/30"]),
        ("ALPHANOL\\10 MG\\UNKNOWN", ["ALPHANOL"]),
        ("ALPHANOL, SODIUM; BETAMINE", ["ALPHANOL, SODIUM", "BETAMINE"]),
        ("SODIUM, ALPHANOL", ["SODIUM, ALPHANOL"]),
        ("'A''B' + C", ["A'B", "C"]),
        ('"ALPHANOL\\BETAMINE', ['"ALPHANOL', "BETAMINE"]),
        ("[ALPHANOL]|(BETAMINE)", ["ALPHANOL", "BETAMINE"]),
        ("\\\\A;;B\\", ["A", "B"]),
        ("N/A", []), ("", []), ("  ", []), ("UNKNOWN", []),
        ("ETA-THETANE", ["ETA-THETANE"]),
    ],
)
def test_grammar(text, values):
    assert [v.text for v in Grammar(NAMES).values(text)] == values


def test_malformed_quote_is_flagged():
    assert Grammar(NAMES).values('"A\\B')[0].flags == "malformed_quote"


def test_split_values(spark):
    rows = [(1, 1, "A\\B"), (1, 1, "A\\B"), (2, 1, None), (3, None, " c  d "), (4, 2, "A;" * 3000 + "Z")]
    df = spark.createDataFrame(rows, "report_id bigint, drug_seq int, position string")
    got = packed.split_values(df.withColumnRenamed("position", "text"), "text", ["report_id", "drug_seq"], NAMES)
    by = {}
    for r in got.collect():
        by.setdefault(r["report_id"], []).append((r["position"], r["piece"]))
    assert sorted(by[1]) == [(1, "A"), (1, "A"), (2, "B"), (2, "B")] and by[3] == [(1, "C D")]
    assert 2 not in by and len(by[4]) == 3001 and max(by[4])[1] == "Z"
