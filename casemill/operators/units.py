"""One quantity in many units: spellings mapped by n-grams and weighted edit distance.

The text of a value is cut into a number and a *shape*, the text with the number made
``#``. Only the distinct shapes and unit codes, few beside the rows, are matched: their
words are looked up in an inverted index of character bigrams over the known unit
names, and candidates are verified by a weighted edit distance. The alias dictionary so
made is joined to all rows. Where neither text nor code names a unit, the unit counts
in which that source evidently records everything.

Defined results: NULL, empty or unreadable text gives no value; a code that names no
unit gives no value (unless it is blank); text outranks the code; a negative number is
unreadable. Values of any size are kept.
"""

from __future__ import annotations

import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from casemill.session import cut

# Years in one of each unit.
YEARS = {"DEC": 10.0, "YR": 1.0, "MON": 1 / 12, "WK": 1 / 52.1775, "DY": 1 / 365.25, "HR": 1 / 8766.0}

# How units are written.
UNIT_NAMES = {
    "DEC": ["decade", "decades", "dec", "decs", "décennie", "décennies", "dekade", "dekaden", "jahrzehnt",
            "jahrzehnte", "década", "décadas", "decennio"],
    "YR": ["year", "years", "yr", "yrs", "y", "yo", "jahr", "jahre", "jahren", "jährig", "j", "an", "ans", "année",
           "années", "año", "años", "a", "yrs old", "yoa", "anno", "anni"],
    "MON": ["month", "months", "mon", "mons", "mo", "mos", "mth", "mths", "mnth", "mnths", "m", "monat", "monate",
            "monaten", "mois", "mes", "meses"],
    "WK": ["week", "weeks", "wk", "wks", "w", "woche", "wochen", "semaine", "semaines", "sem", "semana", "semanas"],
    "DY": ["day", "days", "dy", "dys", "d", "tag", "tage", "tagen", "jour", "jours", "día", "días", "dia", "dias"],
    "HR": ["hour", "hours", "hr", "hrs", "h", "std", "stunde", "stunden", "heure", "heures", "hora", "horas"],
}

# Words for numbers.
NUMBER_WORDS = {
    "zero": 0, "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9,
    "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16,
    "seventeen": 17, "eighteen": 18, "nineteen": 19, "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50,
    "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90,
}

# N of a "value/n" text and its unit; letters of ISO 8601 durations.
FRACTIONS = {"12": "MON", "52": "WK", "53": "WK", "7": "DY", "365": "DY", "24": "HR"}
ISO_DATE = {"y": "YR", "m": "MON", "w": "WK", "d": "DY"}
ISO_TIME = {"h": "HR"}

# Words that may stand beside number and unit, and words that are no value.
FILLERS = {"age", "aged", "of", "life", "old", "approx", "approximately", "about", "ca", "circa", "alt", "edad", "âgé",
           "o", "at", "least", "over", "under", "almost", "nearly", "de", "vida", "vie"}

VOWELS = set("aeiouyäöüáéíóú")


def plain(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower()) if not unicodedata.combining(c))


def bigrams(word: str) -> set[str]:
    padded = f"^{word}$"
    return {padded[i : i + 2] for i in range(len(padded) - 1)}


def weighted_distance(a: str, b: str) -> float:
    """Edit distance in which vowels and doubled letters are cheap, the first letter dear."""

    def drop(word: str, i: int) -> float:
        if i == 0:
            return 1.5
        return 0.5 if word[i] in VOWELS or word[i] == word[i - 1] else 1.0

    before = [0.0]
    for j in range(len(b)):
        before.append(before[-1] + drop(b, j))
    two_back: list[float] = []
    for i, x in enumerate(a):
        now = [before[0] + drop(a, i)]
        for j, y in enumerate(b):
            change = 0.0 if x == y else 0.5 if x in VOWELS and y in VOWELS else 1.0
            now.append(min(before[j + 1] + drop(a, i), now[j] + drop(b, j), before[j] + change))
            if i and j and x == b[j - 1] and a[i - 1] == y:
                now[-1] = min(now[-1], two_back[j - 1] + 0.75)
        two_back, before = before, now
    return before[-1]


@lru_cache(maxsize=1)
def _index() -> tuple[dict[str, str], dict[str, set[str]]]:
    names = {plain(n): unit for unit, spelled in UNIT_NAMES.items() for n in spelled}
    grams: dict[str, set[str]] = defaultdict(set)
    for name in names:
        for gram in bigrams(name):
            grams[gram].add(name)
    return names, grams


@lru_cache(maxsize=65536)
def unit_of(word: str, tolerance: float = 0.25) -> str | None:
    """The unit ``word`` names, if the nearest known name is near enough and no other unit is as near.

    Words of up to three letters must match exactly; longer ones may differ by a
    weighted distance of ``tolerance`` of their length.
    """
    word = plain(word).strip(".")
    names, grams = _index()
    if word in names:
        return names[word]
    if len(word) <= 3:
        return None
    shared = Counter(name for gram in bigrams(word) for name in grams.get(gram, ()))
    near = []
    for name, n in shared.items():
        if len(name) > 2 and n >= max(2, (len(word) + 1) // 3):
            distance = weighted_distance(word, name)
            if distance <= tolerance * max(len(word), len(name)):
                near.append((distance, names[name]))
    best = min(near, default=(0, None))
    return None if any(d == best[0] and u != best[1] for d, u in near) else best[1]


def reading(shape: str) -> tuple[str | None, float | None, bool]:
    """(unit, number written as a word, readable) of a shape in lower case."""
    import regex

    shape = shape.strip()
    if regex.fullmatch(r"#", shape):
        return None, None, True
    iso = regex.fullmatch(r"p(t?)#([a-z])", shape)
    if iso:
        unit = (ISO_TIME if iso[1] else ISO_DATE).get(iso[2])
        return unit, None, unit is not None
    part = regex.fullmatch(r"#/([0-9]+)", shape)
    if part:
        unit = FRACTIONS.get(part[1])
        return unit, None, unit is not None
    words = regex.findall(r"[\p{L}]+|#", shape.replace("y/o", "yo").replace("#", " # "))
    number, units, spelled = words.count("#"), [], []
    for word in words:
        if word == "#":
            continue
        if plain(word) in NUMBER_WORDS:
            spelled.append(float(NUMBER_WORDS[plain(word)]))
        elif (unit := unit_of(word)) and not (word in FILLERS and len(word) > 1):
            units.append(unit)
        elif word not in FILLERS:
            return None, None, False
    if number + (1 if spelled else 0) != 1 or len(set(units)) > 1:
        return None, None, False
    return (units[0] if units else None), (sum(spelled) if spelled else None), True


def aliases(texts: DataFrame, column: str, what: str) -> DataFrame:
    """The alias dictionary of a column of distinct spellings: (spelling, unit, word_number, readable)."""
    read = reading if what == "shape" else lambda code: (unit_of(code), None, unit_of(code) is not None)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            got = [read(s) for s in frame["spelling"]]
            yield pd.DataFrame(
                {"spelling": frame["spelling"], "unit": [g[0] for g in got], "word_number": [g[1] for g in got], "readable": [g[2] for g in got]}
            )

    distinct = texts.filter(F.col(column).isNotNull() & (F.col(column) != "")).select(F.col(column).alias("spelling")).distinct()
    return distinct.mapInPandas(batches, "spelling string, unit string, word_number double, readable boolean")


NUMBER = r"[0-9]+(?:[.,][0-9]+)?"


def shape_of(text: Column) -> tuple[Column, Column]:
    """(shape, number): the first number, with comma or point, is cut out of the lower-cased text."""
    low = F.trim(F.regexp_replace(F.lower(text), r"(?U)\s+", " "))
    number = F.regexp_replace(F.regexp_extract(low, f"({NUMBER})", 1), ",", ".").try_cast("double")
    return F.regexp_replace(F.regexp_replace(low, rf"^([^0-9#]*){NUMBER}", "$1#"), r"^[~≈<>=+ ]+(?=#)", ""), number


LOG_STEP = 0.05


def _median(bins: str, n: Column) -> Column:
    """The first of the sorted (_bin, n) by which half of ``n`` is seen; NULL if there is nothing."""
    return F.aggregate(
        bins,
        F.struct(F.lit(0).cast("bigint").alias("seen"), F.lit(None).cast("int").alias("median")),
        lambda acc, b: F.struct(
            (acc["seen"] + b["n"]).alias("seen"),
            F.when(acc["median"].isNull() & (n > 0) & ((acc["seen"] + b["n"]) * 2 >= n), b["_bin"]).otherwise(acc["median"]).alias("median"),
        ),
    )["median"]


#: log10 of the middle of ages in years where no value is named as years.
TYPICAL = 1.7
#: Nobody is older, in years.
OLDEST = 130


def custom_units(plain_values: DataFrame, source: str, value: str, named: str, years: str) -> DataFrame:
    """(source, custom_unit) of the sources that evidently record all values in another unit than years.

    ``plain_values`` has a row per readable value: ``value``, whether a unit is ``named``,
    and whether it is named as ``years``. Per source the unnamed values are counted in
    log-spaced bins, so a source of any size is a few hundred counters. The median of all
    values named as years, whatever their source, is the yardstick; a source's unit is
    the one that brings its median nearest to it. It is evident if the source names
    hardly any unit itself (one value in twenty), has at least five values, and its
    largest bin is impossible as years (over ``OLDEST``; then years and decades are out of
    the question, however near) or, for decades, none is over 13 and most are written
    with decimals.
    """
    bins = (
        plain_values.filter(F.col(value) > 0)
        .withColumn("_bin", F.floor(F.log10(value) / LOG_STEP).cast("int"))
        .groupBy(source, "_bin")
        .agg(
            F.count_if(~F.col(named)).alias("n"),
            F.count_if(F.col(named)).alias("n_named"),
            F.count_if(F.col(years)).alias("n_years"),
            F.count_if(~F.col(named) & (F.col(value) != F.floor(value))).alias("n_decimal"),
        )
    )
    bins = cut(bins, "bins")  # read for the yardstick and for the sources
    # A few hundred bins: the first by which half of the values named as years are seen.
    per_bin = bins.groupBy("_bin").agg(F.sum("n_years").alias("n")).agg(F.array_sort(F.collect_list(F.struct("_bin", "n"))).alias("bins"), F.sum("n").alias("n"))
    yardstick = per_bin.select(F.coalesce((_median("bins", F.col("n")) + 0.5) * LOG_STEP, F.lit(TYPICAL)).alias("typical"))
    lists = bins.filter(F.col(source).isNotNull() & (F.trim(source) != "")).groupBy(source).agg(
        F.array_sort(F.collect_list(F.struct("_bin", "n"))).alias("bins"),
        F.sum("n").alias("n"),
        F.sum("n_named").alias("n_named"),
        F.sum("n_decimal").alias("n_decimal"),
        F.max(F.when(F.col("n") > 0, F.col("_bin"))).alias("top"),
    )
    lists = lists.join(F.broadcast(yardstick))  # a single row
    middle = (F.col("median") + 0.5) * LOG_STEP
    highest = F.pow(F.lit(10.0), F.col("top") * LOG_STEP)

    def nearest(units: dict[str, float]) -> Column:
        return F.array_min(F.array(*(F.struct(F.abs(middle + F.log10(F.lit(f)) - F.col("typical")).alias("far"), F.lit(u).alias("unit")) for u, f in units.items())))["unit"]

    small = {u: f for u, f in YEARS.items() if f < 1}
    decades = (nearest(YEARS) == "DEC") & (highest <= 13) & (F.col("n_decimal") * 2 > F.col("n"))
    return (
        lists.filter((F.col("n") >= 5) & (F.col("n_named") * 20 <= F.col("n")))
        .withColumn("median", _median("bins", F.col("n")))
        .withColumn("custom_unit", F.when(highest > OLDEST, nearest(small)).when(decades, "DEC"))
        .filter("custom_unit is not null")
        .select(source, "custom_unit")
    )


def ages(demo: DataFrame, text: str = "age", code: str = "age_cod", source: str = "mfr_sndr") -> DataFrame:
    """``demo`` with ``age_unit``, ``age_unit_from`` (text, code, source, default) and ``age_years``.

    All rows are kept; columns of these names that are there already are replaced. Both dictionaries and the source table are joined by equality on
    the left, so the adaptive planner broadcasts them while small and splits hot keys.
    """
    made = ("age_unit", "age_unit_from", "age_years")
    demo = demo.drop(*made)
    shape, number = shape_of(F.col(text))
    rows = demo.withColumn("_shape", F.coalesce(shape, F.lit(""))).withColumn("_number", number)
    rows = rows.withColumn("_code", F.lower(F.trim(F.coalesce(F.col(code), F.lit("")))))
    # Written, so that each is made once and the planner knows how small it is.
    shapes = cut(aliases(rows, "_shape", "shape"), "shapes").select(
        F.col("spelling").alias("_shape"), F.col("unit").alias("_text_unit"), F.col("word_number").alias("_word"), F.col("readable").alias("_readable")
    )
    codes = cut(aliases(rows, "_code", "code"), "codes").select(F.col("spelling").alias("_code"), F.col("unit").alias("_code_unit"))
    joined = (
        rows.join(shapes, "_shape", "left")
        .join(codes, "_code", "left")
        .withColumn("_value", F.when(F.col("_readable"), F.coalesce("_word", "_number")))
        .withColumn("_named", F.col("_text_unit").isNotNull() | (F.col("_code") != ""))
        .withColumn("_years", F.coalesce(F.coalesce("_text_unit", "_code_unit") == "YR", F.lit(False)))
    )
    custom = custom_units(joined.filter("_value is not null").select(source, "_value", "_named", "_years"), source, "_value", "_named", "_years")
    custom = custom.withColumnRenamed("custom_unit", "_custom")
    unit_from = (
        F.when(F.col("_value").isNull(), F.lit(None))
        .when(F.col("_text_unit").isNotNull() & ((F.col("_code") == "") | F.col("_code_unit").isNotNull()), "text")
        .when(F.col("_code_unit").isNotNull(), "code")
        .when(F.col("_code") != "", F.lit(None))
        .when(F.col("_custom").isNotNull(), "source")
        .otherwise("default")
    )
    factor = F.create_map(*(F.lit(x) for pair in YEARS.items() for x in pair))
    out = (
        joined.join(custom, source, "left")
        .withColumn("age_unit_from", unit_from)
        .withColumn(
            "age_unit",
            F.when(F.col("age_unit_from") == "text", F.col("_text_unit"))
            .when(F.col("age_unit_from") == "code", F.col("_code_unit"))
            .when(F.col("age_unit_from") == "source", F.col("_custom"))
            .when(F.col("age_unit_from") == "default", F.lit("YR")),
        )
        .withColumn("age_years", F.col("_value") * F.try_element_at(factor, F.col("age_unit")))
    )
    return out.select(*demo.columns, *made)
