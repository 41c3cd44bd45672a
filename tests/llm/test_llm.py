"""The operators for training data, against brute force, exact round trips and held-out cases."""

from __future__ import annotations

import math
import random
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from casemill.llm import canon, cooccur, details, mixing, pii, survivor, tokens
from casemill.llm.bktree import BKTree, plain_distance

VOCABULARY = Path(tokens.DEFAULT_VOCABULARY)
needs_vocabulary = pytest.mark.skipif(not VOCABULARY.exists(), reason="no vocabulary file")


def words(n, seed, low=3, high=16):
    rng = random.Random(seed)
    return sorted({"".join(rng.choice("ABCDELMNORST") for _ in range(rng.randint(low, high))) for _ in range(n)})


def test_tree_finds_every_entry_within_the_threshold():
    entries = words(400, 1) + ["A" * 70, "A" * 66 + "BCDE", ""]
    tree = BKTree(entries)
    rng = random.Random(2)
    for _ in range(120):
        q = list(rng.choice(entries))
        for _ in range(rng.randint(0, 3)):
            q.insert(rng.randint(0, len(q)), rng.choice("ABCZ"))
        q, t = "".join(q), rng.randint(0, 4)
        assert tree.search(q, t) == sorted((d, i) for i, e in enumerate(entries) if (d := plain_distance(q, e)) <= t)
    assert BKTree([]).search("A", 2) == []


SUBSTANCES = [("ALPHANOLIDE", 1), ("BRANDALPHA", 1), ("BETAMYCINE", 2), ("GAMMASTATIN ACID", 3), ("DELTAVIRANE, BOVINE", 4), ("ETHA-THETANOL", 5), ("OMEGALIN", 6)]


@pytest.mark.parametrize(
    ("value", "key"),
    [
        ("ALPHANOLID", 1), ("ALFANOLIDE", 1), ("ALPHAN0L1DE 20 MG", 1), ("BRANDALPHA (ALPHANOLIDE) 40 MG/0.8 ML PEN", 1), ("ÁLPHANOLÍDE", 1), ("АLРHАNOLIDE", 1), ("ALPHA NOLIDE TABLET", 1),
        ("GENERIC BETAMYCINE", 2), ("SODIUM, BETAMYCINE", 2), ("BETAMYCINE (SULFATE)", 2), ("[BETAMYCINE]", 2), ("BETAMYCINE?", 2), ("BETAMYCINE, CAPSULES, 12MG", 2), ("BETAMYC", 2),
        ("GAMMASTATINACID SODIUM", 3), ("GAMMASTATIN", 3), ("DELTAVIRANE, BOVNE 5 MG", 4), ("ETHA THETANOL", 5), ("ET-HATHETANOL", 5), ("OMEGALIN\\10 MG", 6),
        ("UNKNOWN", -1), ("XYLOPHONIUM", -1), ("?", -1), ("10 MG TABLET", -1), ("SODIUM", -1), ("N/A", -1),
        ("ALPHANOLIDE\\BETAMYCINE", canon.SEVERAL), ("ALPHANOLIDE-BETAMYCINE TAB", canon.SEVERAL), ("ALPHANOLIDE AND XYLOPHONIUM", canon.SEVERAL), ("OMEGALIN-ETHA-THETANOL", canon.SEVERAL),
    ],
)
def test_meaning(value, key):
    names, ids = zip(*SUBSTANCES)
    assert canon.Matcher(list(names), list(ids)).meaning(value)[1] == key


def test_canonical_and_shards(spark):
    reference = spark.createDataFrame([*SUBSTANCES, (None, 9)], "name string, substance_id bigint")
    rows = [(1, 1, " alphanolide "), (2, 1, "alphanolid"), (2, 1, "alphanolid"), (3, None, None), (4, 1, " "), (5, 1, "ZZZZZZ"), (6, 1, "A" * 3000), (None, 2, "betamycin"), (7, 1, "a\\b")]
    df = spark.createDataFrame(rows, "report_id bigint, drug_seq int, f string")
    got = {(r["report_id"], r["raw_value"]): r["substance_id"] for r in canon.canonical([("f", df)], reference, ["report_id", "drug_seq"]).collect()}
    assert got == {(2, "ALPHANOLID"): 1, (5, "ZZZZZZ"): -1, (6, "A" * 3000): -1, (None, "BETAMYCIN"): 2}
    sharded = {(r["report_id"], r["raw_value"]): r["substance_id"] for r in canon.canonical([("f", df)], reference, ["report_id", "drug_seq"], 2).collect()}
    assert sharded == got
    assert canon.canonical([("f", df.limit(0))], reference, ["report_id", "drug_seq"]).count() == 0
    assert canon.canonical([("f", df.limit(0))], reference, ["report_id", "drug_seq"], 2).count() == 0


def test_no_result_depends_on_the_size_of_a_shard(spark):
    """Protected names, chains and combinations over shards, ties, and beginnings."""
    values = ["DELTAVIRANE, BOVNE 5 MG", "DELTAVIRANE, BOVINE\\ALPHANOLIDE", "ALPHANOLIDE-BETAMYCINE TAB", "OMEGALIN-ETHA-THETANOL", "BETAMYCINE (ALPHANOLIDE)", "BRANDALPHA (ALPHANOLID)", "BETAMYC", "ET-HATHETANOL",
              "GAMMASTATIN", "TIEA", "TIEB", "TIE", "ALPHAN0L1DE", "XYLOPHONIUM", "?", "A-B-C", "OMEGALIN, DELTAVIRANE, BOVINE", "ALPHANOLIDE AND XYLOPHONIUM"]
    reference = spark.createDataFrame([*SUBSTANCES, ("TIECA", 8), ("TIECB", 9), ("TIECC", 9), ("ALPHANOLID-E", 7)], "name string, substance_id bigint")
    df = spark.createDataFrame([(v,) for v in values], "raw_value string")
    whole = sorted(canon.mapped(df, reference).collect())
    assert len(whole) == len(values) and len({r["substance_id"] for r in whole}) > 5
    for size in (1, 3, 10):
        assert sorted(canon.mapped(df, reference, size).collect()) == whole


def pair_loops(rows, support):
    cases = {}
    for case, item in rows:
        if case is not None and item and item.strip():
            cases.setdefault(case, set()).add(" ".join(item.upper().split()))
    one = Counter(i for items in cases.values() for i in items)
    two = Counter((a, b) for items in cases.values() for a in items for b in items if a < b)
    return {p: (n, one[p[0]], one[p[1]], len(cases)) for p, n in two.items() if n >= support}


def test_pairs_against_loops(spark, monkeypatch):
    rng = random.Random(3)
    rows = [(rng.randint(0, 80), rng.choice(["a", " a ", "B", "c  d", "E", "f", "", None])) for _ in range(900)]
    rows += [(500, f"item{i}") for i in range(60)] * 2 + [(501, f"item{i}") for i in range(0, 60, 2)] + [(None, "a"), (502, "a"), (503, None)]
    df = spark.createDataFrame(rows, "case_id bigint, ingredient string").withColumn("n", F.lit(1))
    for block in (cooccur.BLOCK, 8):
        monkeypatch.setattr(cooccur, "BLOCK", block)
        got = {(r["item_a"], r["item_b"]): (r["n_ab"], r["n_a"], r["n_b"], r["n"]) for r in cooccur.pairs(df, support=2).collect()}
        assert got == pair_loops(rows, 2)
    assert cooccur.pairs(df.limit(0)).count() == 0


def test_log_likelihood(spark):
    r = spark.range(1).select(cooccur.log_likelihood(*(F.lit(x) for x in (10, 20, 30, 1000))).alias("g"), cooccur.log_likelihood(*(F.lit(x) for x in (2, 20, 100, 1000))).alias("z")).first()
    cells = [(10, 0.6), (10, 19.4), (20, 29.4), (960, 950.6)]
    assert r["g"] == pytest.approx(2 * sum(o * math.log(o / e) for o, e in cells)) and r["z"] == pytest.approx(0, abs=1e-9)


DEMO = "report_id bigint, case_id bigint, caseversion string, quarter string, age string, sex string, country string"


def survivor_loops(rows):
    """Layers and fills by comparing all records with all others."""
    out = {}
    for key in {r[1] for r in rows if r[1] is not None}:
        recs = []
        for r in rows:
            if r[1] == key:
                version = int(float(r[2])) if r[2] and r[2].strip() else -1
                fields = [x if x and x.strip() else None for x in r[4:]]
                recs.append((version, r[3] or "", sum(x is not None for x in fields), r[0], fields))

        def above(a, b):
            return a[0] >= b[0] and a[1] >= b[1] and a[2] >= b[2] and (a[0] > b[0] or a[1] > b[1])

        layer = {}

        def depth(i):
            if i not in layer:
                layer[i] = 1 + max((depth(j) for j in range(len(recs)) if above(recs[j], recs[i])), default=0)
            return layer[i]

        best = max((r[0], r[1], r[3]) for i, r in enumerate(recs) if depth(i) == 1)
        filled = []
        for f in range(3):
            have = [(-depth(i), r[0], r[1], r[3], r[4][f]) for i, r in enumerate(recs) if r[4][f] is not None]
            filled.append(max(have)[4] if have else None)
        out[key] = (best[2], best[1], *filled, len(recs), max(layer.values()))
    return out


def test_survivors_against_loops(spark):
    rng = random.Random(4)
    rows = [(rng.randint(1, 40), rng.choice([1, 2, 3, 4, None]), rng.choice(["1", "2", "3", "10", " 2 ", "", None]), rng.choice(["2010q1", "2010q2", "2011q1"]),
             rng.choice(["50", "", None]), rng.choice(["F", "M", None]), rng.choice(["US", " ", "DE"])) for _ in range(160)]
    rows += rows[:20]
    df = spark.createDataFrame(rows, DEMO).withColumn("n_rows", F.lit("clash"))
    got = survivor.survivors(df)
    cols = ("report_id", "quarter", "age", "sex", "country", "n_rows", "n_layers")
    assert {r["case_id"]: tuple(r[c] for c in cols) for r in got.collect()} == survivor_loops(rows)
    assert survivor.survivors(df.limit(0)).count() == 0


@needs_vocabulary
def test_ids_against_reference_encoder(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = {t: i for i, t in enumerate(tokens.vocabulary())}
    own = tiktoken.Encoding("own", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(5)
    texts = ["".join(rng.choice("ab cdE'sll 12\n\t é漢字👩🏽‍⚕️<|endoftext|>…") for _ in range(rng.randint(0, 60))) for _ in range(400)]
    texts += ["", None, "<|endoftext|>", "a" * 50_000, " " * 3_000, "​﻿", "don't we'll THEY'RE"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("ids", F.lit("clash"))
    got = {r["doc_id"]: r["ids"] for r in tokens.encoded(df).collect()}
    assert all(got[i] == (own.encode_ordinary(t) if t else []) for i, t in enumerate(texts))
    back = {r["doc_id"]: r["text"] for r in tokens.decoded(tokens.encoded(df)).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts))
    sizes = {r["doc_id"]: r["n_tokens"] for r in tokens.counted(df.drop("ids")).collect()}
    assert all(sizes[i] == len(got[i]) for i in got)
    assert tokens.encoded(df.limit(0)).count() == 0


def test_mixture(spark):
    rng = random.Random(6)
    docs = [(i, s, rng.randint(0, 60)) for i, s in enumerate(["big"] * 3000 + ["mid"] * 700 + ["tiny"] * 60 + ["none"] * 50)]
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid", 0.3, 2), ("tiny", 0.1, 4), ("absent", 0.0, 3)], "source string, target_share double, max_repeats int")
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, n_tokens bigint")
    taken = mixing.selection(sized, targets)
    rows = {r["doc_id"]: r["times"] for r in taken.collect()}
    caps = {"big": 1, "mid": 2, "tiny": 4}
    assert all(0 < n <= caps[docs[i][1]] for i, n in rows.items())
    got = {r["source"]: r for r in mixing.shares(taken, targets).collect()}
    whole = sum(r["tokens"] for r in got.values())
    for source, share in (("big", 0.6), ("mid", 0.3), ("tiny", 0.1)):
        assert abs(got[source]["tokens"] - share * whole) <= 61
        assert got[source]["tokens"] == sum(n * docs[i][2] for i, n in rows.items() if docs[i][1] == source)
    assert got["absent"]["tokens"] == 0
    assert max(r["max_times"] for r in got.values()) == 4  # the source that binds is used up to its cap
    assert {r["doc_id"]: r["times"] for r in mixing.selection(sized.repartition(9), targets).collect()} == rows
    assert mixing.selection(sized.limit(0), targets).count() == 0
    assert mixing.selection(sized, targets.limit(0)).count() == 0


def test_mixture_of_very_many_sources(spark):
    n = 10_000
    sized = spark.range(3 * n).select(F.col("id").alias("doc_id"), F.format_string("s%05d", F.col("id") % n).alias("source"), (F.col("id") % 7 + 1).alias("n_tokens"))
    targets = spark.range(n).select(F.format_string("s%05d", "id").alias("source"), F.lit(1.0).alias("target_share"), F.lit(2).alias("max_repeats"))
    got = mixing.shares(mixing.selection(sized, targets), targets).agg(F.count(F.lit(1)).alias("n"), F.min("tokens").alias("low"), F.max("tokens").alias("high"), F.max("max_times").alias("times")).first()
    assert got["n"] == n and 0 < got["low"] and got["high"] - got["low"] <= 7 and got["times"] <= 2


TEXT = (
    "Spoke with Mrs Vanda de Torrin about the missing data. Signed Dr. Pelm Oskarn The patient, Torrin, Vanda, called back the next morning. "
    "Home address: Flat 3, 12 Elmgate St., Norbury NO4 7QZ. Mail vanda.t AT torrmail DOT co.example for the discharge letter. Her mobile is (01632) 960336 ext. 77. "
    "Passport QQ 12 34 56 Z was shown at intake. The Pelm-Torrin syndrome was ruled out. Case reference 6007122. Reporter: Q. Zand. Urine was taken @ bedtime."
)
FOUND = {
    ("name", "Vanda de Torrin"), ("name", "Pelm Oskarn"), ("name", "Torrin, Vanda"), ("name", "Q. Zand"), ("address", "Flat 3, 12 Elmgate St., Norbury NO4 7QZ"),
    ("email", "vanda.t AT torrmail DOT co.example"), ("phone", "(01632) 960336 ext. 77"), ("id_number", "QQ 12 34 56 Z"),
}


@pytest.mark.parametrize(
    ("text", "found"),
    [
        (TEXT, FOUND),
        ("MAIL A.B@C-CLINIC.EXAMPLE FOR X. REACHED AT JO_1 (AT) MAIL (DOT) TEST.", {("email", "A.B@C-CLINIC.EXAMPLE"), ("email", "JO_1 (AT) MAIL (DOT) TEST")}),
        ("Rückruf unter 0049-30-23125-714 erbeten. Wohnhaft: Torstr. 5, 00123 Nord.", {("phone", "0049-30-23125-714"), ("address", "Torstr. 5, 00123 Nord")}),
        ("Rappeler au 01.99.00.42.49. Domicile : 20 bis, impasse Tor, 00811 Nord. Déclarant : Mme Ann Tor.", {("phone", "01.99.00.42.49"), ("address", "20 bis, impasse Tor, 00811 Nord"), ("name", "Ann Tor")}),
        ("Llamar al 900-000-715. Documento de identidad X-0009203-Q adjunto. Domicilio: C/ Tor 5, 00123 Nord.", {("phone", "900-000-715"), ("id_number", "X-0009203-Q"), ("address", "C/ Tor 5, 00123 Nord")}),
        ("Fax five five five, 0104, attention. Tel. +1 (555) 555 0151 x040 The end", {("phone", "five five five, 0104"), ("phone", "+1 (555) 555 0151 x040")}),
        ("The manufacturer, Tor & Vale, agreed. Subject 112-582 in arm 1. BP 135/94. Alphanol was assigned to Betamine.", set()),
        ("", set()), (None, set()),
    ],
)
def test_details(text, found):
    assert {(s.kind, text[s.start : s.end]) for s in details.spans(text)} == found


# Written for this test, in words and with names the tables do not use.
GENERAL = [
    ("Dr. Emily Watson called about the event.", "name", "Emily Watson"), ("My name is Peter Brown.", "name", "Peter Brown"), ("Patient Maria Garcia reports pain.", "name", "Maria Garcia"),
    ("I talked to the nurse, Sarah O'Neill, on Monday.", "name", "Sarah O'Neill"), ("The caller's mother, Mrs. Anna-Lena Krüger, was present.", "name", "Anna-Lena Krüger"),
    ("His son Mark drove him to the ward.", "name", "Mark"), ("Please forward questions to Prof. J. R. Hill, Dept of Surgery.", "name", "J. R. Hill"), ("Sincerely,\nJonathan Miller", "name", "Jonathan Miller"),
    ("Patient name: Li Wei; date of birth unknown.", "name", "Li Wei"), ("Karen Smith said the tablets were bitter.", "name", "Karen Smith"), ("Herr Weber rief am Montag an.", "name", "Weber"),
    ("Telefonat mit Frau Dr. Sabine Vogel am Dienstag.", "name", "Sabine Vogel"), ("Entretien avec Mme Claire Dubois hier.", "name", "Claire Dubois"), ("Se habló con el médico, Juan Pérez, ayer.", "name", "Juan Pérez"),
    ("La paciente Lucía Fernández refiere dolor.", "name", "Lucía Fernández"), ("REPORTED BY DR HELEN MARSH ON FRIDAY.", "name", "HELEN MARSH"), ("Consumer Thomas Lee phoned on Sunday.", "name", "Thomas Lee"),
    ("The physician, Dr. Ahmed Khan, stopped the drug.", "name", "Ahmed Khan"), ("Interview with Olga Petrova took place.", "name", "Olga Petrova"), ("her daughter Susan answered the phone", "name", "Susan"),
    ("Signed: M. Rossi, MD", "name", "M. Rossi"), ("The husband of the patient met with Ivan Dragunov at noon.", "name", "Ivan Dragunov"), ("Reported by: Chloe Bennett, RN", "name", "Chloe Bennett"),
    ("Correspondence: c/o Ruth Adler, 3rd floor", "name", "Ruth Adler"), ("Elena wrote that her rash is gone.", "name", "Elena"), ("Ms Ngozi Okafor, a pharmacist, called.", "name", "Ngozi Okafor"),
    ("Write to jane.doe+ae@mail.example.org today.", "email", "jane.doe+ae@mail.example.org"), ("Contact me: bob (at) clinic (dot) example", "email", "bob (at) clinic (dot) example"),
    ("Her address is 12 Old Mill Road, Springfield, IL 62704.", "address", "12 Old Mill Road, Springfield, IL 62704"), ("He lives at 45 Baker Street, London NW1 6XE.", "address", "45 Baker Street, London NW1 6XE"),
    ("Wohnhaft: Lindenstraße 4, 10969 Berlin.", "address", "Lindenstraße 4, 10969 Berlin"), ("Domicile : 8 rue de la Paix, 75002 Paris.", "address", "8 rue de la Paix, 75002 Paris"),
    ("Calle Mayor 10, 28013 Madrid es su domicilio.", "address", "Calle Mayor 10, 28013 Madrid"), ("Ship it to 7 Elm Ct, Dayton.", "address", "7 Elm Ct, Dayton"),
    ("SSN 123-45-6789 was on the chart.", "id_number", "123-45-6789"), ("Passport number: C01234567 copied.", "id_number", "C01234567"), ("DNI 12345678Z en el expediente.", "id_number", "12345678Z"),
    ("NHS number 943 476 5919 verified.", "id_number", "943 476 5919"), ("National Insurance no. QQ 12 34 56 C.", "id_number", "QQ 12 34 56 C"), ("Social security number is 078-05-1120.", "id_number", "078-05-1120"),
    ("Reisepass Nr. C01X00T47 lag vor.", "id_number", "C01X00T47"), ("Cell 415-555-0134, evenings only.", "phone", "415-555-0134"), ("You can reach her at (555) 123-4567 or by mail.", "phone", "(555) 123-4567"),
    ("Tel. 030 1234567", "phone", "030 1234567"), ("Call me on +44 20 7946 0958 please.", "phone", "+44 20 7946 0958"), ("Fax: 212-555-0199.", "phone", "212-555-0199"),
    ("Rückruf bitte unter 0171 5551234.", "phone", "0171 5551234"), ("Her work number: 020 7946 0123.", "phone", "020 7946 0123"), ("Móvil 612 345 678 por las tardes.", "phone", "612 345 678"),
]
PLAIN = [
    "The Mayo Clinic confirmed the result.", "Muscle biopsy confirmed the diagnosis.", "Dose 100-200-3000 mg was given on 2014-05-06.", "Case ID 12345678 was closed.", "Batch no. AB1234567 expired.",
    "Protocol 123-45-67 ended.", "Spoke with the patient about it.", "The nurse, however, called.", "Stevens-Johnson syndrome was reported.", "Patient was well. Reporter agreed.", "Subject 415-555 stopped.",
    "The physician was informed.", "Her husband agreed.", "Symptoms began at 8:20 and eased by noon.", "Signed on Monday.", "The case was described in NCT01234567 and ref. 144.",
]


def test_details_of_other_texts():
    hits = [any(s.kind == kind and text[s.start : s.end] == span for s in details.spans(text)) for text, kind, span in GENERAL]
    assert sum(hits) >= 0.9 * len(hits)
    assert sum(bool(details.spans(text)) for text in PLAIN) <= 0.1 * len(PLAIN)


def test_redaction_and_surrogates(spark):
    texts = [TEXT, None, "", "no details", "Spoke with Vanda de Torrin about it. 👩🏽 Mail vanda.t@torrmail.co.example now.", "Signed TORRIN Vanda", TEXT + " x" * 20_000]
    rows = [*enumerate(texts), (4, texts[4]), (None, texts[4]), (4, "Signed Dr. Pelm Oskarn")]  # repeated, NULL and clashing keys
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("details", F.lit("clash"))
    got = {r["doc_id"]: r["text"] for r in pii.redacted(df.limit(7)).collect()}
    assert got[1] is None and got[2] == "" and got[3] == "no details"
    assert got[4] == "Spoke with [NAME] about it. 👩🏽 Mail [EMAIL] now."
    assert got[0].count("[NAME]") == 4 and "Torrin syndrome" in got[0] and "Mrs [NAME]" in got[0]
    every = [(r["doc_id"], r["text"]) for r in pii.replaced(df.drop("details"), "k").collect()]
    assert len(every) == len(rows) and sorted(x for _, x in every if x) == sorted(x for _, x in [(r["doc_id"], r["text"]) for r in pii.replaced(df.drop("details").repartition(7), "k").collect()] if x)
    new = {k: t for k, t in every if k is None or k != 4}
    four = sorted(t for k, t in every if k == 4)
    assert new[1] is None and new[2] == "" and new[3] == "no details" and four.count(new[None]) == 2
    assert not any(s in t for t in (new[0], new[6], *four) for _, s in FOUND) and "Flat 3, 12 Elmgate" not in new[0] and "St., " in new[0]
    one, two = new[0][len("Spoke with Mrs ") :].split(" about")[0], new[None][len("Spoke with ") :].split(" about")[0]
    assert one == two and one[0].isupper() and " de " in one and one.split(" ")[0].endswith("a")  # the same woman in both texts
    assert {r["text"] for r in pii.replaced(df.drop("details"), "other").collect()} != {t for _, t in every}
    assert pii.replaced(df.drop("details").limit(0), "k").count() == 0 and pii.redacted(df.limit(0)).count() == 0


FORMS = [
    ("name", "Li", ""), ("name", "Jane Smith", "f"), ("name", "SMITH, Jane", "f"), ("name", "Иван Петров", "m"), ("name", "田中太郎", ""), ("name", "Γιώργος Παπάς", "m"), ("name", "Vanda de Torrin", "f"),
    ("name", "J. Smith", ""), ("name", "Anne-Marie O'Hara", "f"), ("email", "vanda.t AT torrmail DOT co.example", ""), ("email", "A.B@C-CLINIC.EXAMPLE", ""), ("email", "a [at] b (dot) example", ""),
    ("phone", "(01632) 960336 ext. 77", ""), ("phone", "five five five, 0104", ""), ("phone", "5", ""), ("id_number", "QQ 12 34 56 Z", ""), ("address", "Flat 3, 12 Elmgate St.,\nNorbury NO4 7QZ", ""),
    ("address", "TORSTRASSE 5, 00123 NORD", ""),
]


@pytest.mark.parametrize(("kind", "span", "gender"), FORMS)
def test_forms_of_surrogates(kind, span, gender):
    known = pii.entity(kind, span)
    for attempt in (0, 1, 5, 9, 17, 40):
        new = pii.surrogate_of(kind, known, b"k", attempt, gender)
        text = pii.dressed(kind, span, known, new)
        assert pii.entity(kind, text) == new  # what is checked is what is printed
        assert {pii._script(c) for c in text if c.isalpha()} == {pii._script(c) for c in span if c.isalpha()}
        assert text.isupper() == span.isupper()
    if gender == "f" and " " in span:
        assert new.split(" ")[0][-1] in "aаα"


def test_short_forms_are_one_person():
    text = "Spoke with Jane Smith about it. Reporter: J. Smith. Mrs Smith called. Signed Dr. Pelm Oskarn"
    got = {d["span"]: d["entity"] for d in pii._details(text, details.spans(text))}
    assert got == {"Jane Smith": "jane smith", "J. Smith": "jane smith", "Smith": "jane smith", "Pelm Oskarn": "pelm oskarn"}
    assert pii.dressed("name", "J. Smith", "jane smith", "kasa torma") == "K. Torma" and pii.dressed("name", "SMITH", "jane smith", "kasa torma") == "TORMA"
    assert pii.linked(["jane smith", "john smith", "smith"])["smith"] == "smith"  # either may be meant


def test_surrogates_stay_distinct(spark):
    """Kinds that run out of draws of their length get longer ones, and never the real text."""
    short = [a + b for a in "bdfg" for b in "aeiou"]
    rows = [("phone", str(i)) for i in range(10)] + [("name", w) for w in short] + [("id_number", f"{i:02}") for i in range(100)]
    got = pii.surrogates(spark.createDataFrame(rows, "kind string, entity string"), "k").collect()
    assert len(got) == len(rows) and len({(r["kind"], r["surrogate"]) for r in got}) == len(rows)
    real = {e for _, e in rows}
    assert not {pii.dressed(r["kind"], r["entity"], r["entity"], r["surrogate"]) for r in got} & real


def test_no_real_name_is_printed(spark):
    """All two-letter names of one kind at once: their draws are all real names."""
    names = [n for a in "BDFGKLMNPRSTVZ" for b in "aeiou" if details.spans(f"Spoke with {(n := a + b)} about it.")]  # but function words
    assert len(names) > 50
    df = spark.createDataFrame([(i, f"Spoke with {n} about it.") for i, n in enumerate(names)], "doc_id bigint, text string")
    printed = [r["text"][len("Spoke with ") : -len(" about it.")] for r in pii.replaced(df, "k").collect()]
    assert len(set(printed)) == len(names) and not set(printed) & set(names)


def test_queries_run_on_the_small_tables(spark, small):
    from casemill.llm.queries import QUERIES

    found = QUERIES["p4_found"](spark, small)
    assert found.columns == ["field", "report_id", "drug_seq", "raw_value", "substance_id"] and found.filter("substance_id = -2").isEmpty()
    assert QUERIES["p7_found"](spark, small).columns == ["case_id", "report_id", "quarter"]
    assert QUERIES["p10_found"](spark, small).columns == ["doc_id", "kind", "span"]
    if VOCABULARY.exists():
        assert QUERIES["p8_roundtrip"](spark, small).filter("not same").isEmpty()
