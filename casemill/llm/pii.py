"""Personal details in free text: detection, typed placeholders, and keyed surrogates.

Details are found by the grammars of ``details``; texts are read whole. Surrogates are
made per entity, an entity being a kind with its normalised text, so the same person or
number gets the same replacement everywhere. Within one text initials and single names
belong to the one full name they fit ("J. Smith", "Smith" and "Jane Smith").

A replacement is drawn by a keyed hash and has the form of the original: letters become
letters of the same script, digits digits, marks, particles, initials and words such as
"Street" stay. The first name of a woman or a man, as titles and kin tell, ends as such
names do. A draw is kept only if no other entity holds it and neither it nor a short
form of it is a text of any real entity; later draws grow longer, so every entity gets
one, and nothing is printed in place of a missing one.

Defined results: NULL and empty texts have no details and stay as they are; repeated
details give one row in the found list but are all replaced; repeated rows and NULL keys
are treated row by row. Columns named ``details`` or ``n_details`` are replaced by the
results.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casemill.llm.details import Span, spans
from casemill.session import cut, spread

#: Draws an entity makes in one round (one in the first), and rounds before the job fails.
DRAWS, ROUNDS = 4, 60
#: From this draw on, and at every multiple of it, draws are one unit longer.
GROWS = 8

_SPELLED = re.compile(r"\s?[\[({](?:at|dot)[\])}]\s?|\s(?:AT|DOT)\s", re.IGNORECASE)
_RUN = re.compile(r"[^\W\d_]+")
# Parts of names and addresses that stay.
PARTICLES = set("van von de da del di la le der den du dos los al".split())
PLACES = set(
    "flat unit apt suite box po st street avenue ave boulevard blvd crescent court lane road rd drive way close terrace place square bis ter rue impasse chemin allée calle c avda avenida "
    "plaza paseo".split()
)
# Spelled digits by length, so that one takes the place of another.
DIGIT_WORDS = {2: ["oh"], 3: ["one", "two", "six"], 4: ["zero", "four", "five", "nine"], 5: ["three", "seven", "eight"]}
_DIGIT_WORD = re.compile("|".join(w for ws in DIGIT_WORDS.values() for w in ws))
STREET_ENDS = ("straße", "strasse", "str", "weg", "allee", "platz", "gasse")


def _fold(text: str) -> str:
    """Lower case of the same length."""
    return "".join(c.lower() if len(c.lower()) == 1 else c for c in text)


def entity(kind: str, span: str) -> str:
    """The normalised text an entity is known by: names without case and order, numbers by digits and letters."""
    if kind == "name":
        if "," in span:
            last, first = span.split(",", 1)
            span = f"{first.strip()} {last.strip()}"
        return " ".join(_fold(span).split())
    if kind == "email":
        return _fold(_SPELLED.sub(lambda m: "@" if "a" in m.group().lower() else ".", span).replace(" ", ""))
    if kind in ("phone", "id_number"):
        return _fold(re.sub(r"\W", "", span))
    return " ".join(_fold(span).split())


def short_forms(name: str) -> list[str]:
    """The first and the last word of a full name, and the last with an initial."""
    words = name.split(" ")
    return [] if len(words) < 2 else [words[0], words[-1], f"{words[0][0]}. {words[-1]}"]


def linked(names: list[str]) -> dict[str, str]:
    """Each name of one text with the full name it stands for, itself if none or several fit."""
    full = {n for n in names if " " in n and "." not in n.split(" ")[0]}
    by_form: dict[str, set[str]] = {}
    for n in full:
        for form in short_forms(n):
            by_form.setdefault(form, set()).add(n)

    def owner(n: str) -> str:
        words = n.split(" ")
        form = f"{words[0][0]}. {words[-1]}" if len(words) > 1 and "." in words[0] else n
        fits = by_form.get(form, set()) if n not in full else set()
        return next(iter(fits)) if len(fits) == 1 else n

    return {n: owner(n) for n in names}


_DETAIL = "struct<start:int,end:int,kind:string,span:string,own:string,entity:string,gender:string>"


def _details(text: str, found: list[Span]) -> list[dict]:
    own = [entity(s.kind, text[s.start : s.end]) for s in found]
    owners = linked([o for s, o in zip(found, own) if s.kind == "name"])
    return [
        {"start": s.start, "end": s.end, "kind": s.kind, "span": text[s.start : s.end], "own": o, "entity": owners[o] if s.kind == "name" else o, "gender": s.gender}
        for s, o in zip(found, own)
    ]


def detected(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with ``details``: place (in code points), kind, text, entity and gender of each detail."""
    df = df.drop("details")
    names = df.columns
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)

    def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = frame[names].copy()
            out["details"] = [_details(t, spans(t)) if t else [] for t in frame[text]]
            yield out

    return df.mapInPandas(batches, f"{schema}, details array<{_DETAIL}>")


def _spliced(text: str, parts: list[tuple[int, int, str]]) -> str:
    """``text`` with each (start, end, new) put in."""
    out, at = [], 0
    for start, end, new in sorted(parts):
        out += (text[at:start], new)
        at = end
    return "".join(out) + text[at:]


def redacted(df: DataFrame, text: str = "text") -> DataFrame:
    """``df`` with each detail replaced by a placeholder such as ``[NAME]``; nothing else changes."""

    @F.pandas_udf("string")
    def placed(texts: pd.Series, details: pd.Series) -> pd.Series:
        return pd.Series([_spliced(t, [(d["start"], d["end"], f"[{d['kind'].upper()}]") for d in ds]) if t else t for t, ds in zip(texts, details)])

    got = detected(df.drop("n_details"), text).withColumn("n_details", F.size("details"))
    return got.withColumn(text, F.when(F.col("n_details") > 0, placed(text, "details")).otherwise(F.col(text))).drop("details")


# ---------------------------------------------------------------- drawing

# Vowels and consonants to draw from, and how first names of women and men end.
ALPHABETS = {
    "LATIN": ("aeiou", "bdfgklmnprstvz", {"f": "a", "m": "o"}),
    "CYRILLIC": ("аеиоу", "бвгдзклмнпрст", {"f": "а", "m": "н"}),
    "GREEK": ("αειου", "βγδζκλμνπρτφ", {"f": "α", "m": "ο"}),
}
_OTHER_VOWELS = set("yàáâäãåæèéêëìíîïòóôöõøùúûüýіїєэыюяёήίόύώάέ")


@lru_cache(maxsize=4096)
def _script(letter: str) -> str:
    return unicodedata.name(letter, "LATIN").split(" ")[0].split("-")[0]


@lru_cache(maxsize=4096)
def _neighbours(letter: str) -> str:
    """Letters of the same script near ``letter``, for scripts without an alphabet here."""
    first, script = ord(letter) & ~63, _script(letter)
    return "".join(c for c in map(chr, range(first, first + 64)) if c.isalpha() and _script(c) == script and c.lower() == c) or letter


class _Stream:
    """Numbers from a keyed hash."""

    def __init__(self, key: bytes, *parts: str):
        self.seed, self.n, self.left = hmac.new(key, "\x00".join(parts).encode(), hashlib.sha256).digest(), 0, b""

    def below(self, n: int) -> int:
        if len(self.left) < 4:
            self.left = hashlib.sha256(self.seed + self.n.to_bytes(4, "big")).digest()
            self.n += 1
        got, self.left = int.from_bytes(self.left[:4], "big"), self.left[4:]
        return got % n

    def one(self, of):
        return of[self.below(len(of))]


def _letter(c: str, stream: _Stream) -> str:
    known = ALPHABETS.get(_script(c))
    if not known:
        return stream.one(_neighbours(c))
    return stream.one(known[0] if c in known[0] or c in _OTHER_VOWELS else known[1])


def _drawn_run(run: str, stream: _Stream, more: int = 0, gender: str = "") -> str:
    """A pronounceable run of letters as long as ``run``, ``more`` syllables longer, ending by gender."""
    known = ALPHABETS.get(_script(run[0]))
    if not known:
        return "".join(_letter(c, stream) for c in run) + "".join(stream.one(_neighbours(run[-1])) for _ in range(more))
    sides = (known[1], known[0]) if run[0] not in known[0] and run[0] not in _OTHER_VOWELS else (known[0], known[1])
    size = len(run) + 2 * more
    word = [stream.one(sides[i % 2]) for i in range(size)]
    if gender and size > 1:
        word[-1] = known[2][gender]
    return "".join(word)


def surrogate_of(kind: str, name: str, key: bytes, attempt: int = 0, gender: str = "") -> str:
    """A replacement for an entity's normalised text: words for words, letters for letters, digits for digits."""
    stream, more = _Stream(key, kind, name, str(attempt)), attempt // GROWS
    if kind == "name":
        words = name.split(" ")
        out = []
        for i, word in enumerate(words):
            runs = _RUN.findall(word)
            if word in PARTICLES and 0 < i < len(words) - 1 or not runs:
                out.append(word)
            elif "." in word:
                out.append(_RUN.sub(lambda m: _letter(m.group()[0], stream), word))
            else:
                first = gender or {ending: g for s in ALPHABETS.values() for g, ending in s[2].items()}.get(word[-1], "")
                own = (first if i == 0 and len(words) > 1 else "", more if i == len(words) - 1 else 0)
                out.append(_RUN.sub(lambda m, own=own: _drawn_run(m.group(), stream, own[1], own[0]), word))
        if more and "." in words[-1]:
            out.append(_drawn_run("ba" * more, stream))
        return " ".join(out)

    def changed(text: str) -> str:
        return "".join(str(stream.below(10)) if c.isdigit() else _letter(c, stream) if c.isalpha() else c for c in text)

    extra = "".join(str(stream.below(10)) for _ in range(more))
    if kind == "email":
        local, _, domain = name.partition("@")
        host, dot, end = domain.partition(".")
        return f"{extra}{changed(local)}@{changed(host)}{dot}{end}"
    if kind == "address":
        return re.sub(r"[^\W_]+", lambda m: _place(m.group(), changed), name) + extra
    if kind == "phone":  # letters are those of "ext." or spelled digits
        spelled = _DIGIT_WORD.sub(lambda m: stream.one(DIGIT_WORDS[len(m.group())]), name)
        return re.sub("[0-9]", lambda m: str(stream.below(10)), spelled) + extra
    return changed(name) + extra


def _place(word: str, changed) -> str:
    """A word of an address: words for streets stay, also at the end of a German one."""
    if word in PLACES:
        return word
    end = next((e for e in STREET_ENDS if word.endswith(e) and len(word) > len(e)), "")
    return changed(word[: len(word) - len(end)]) + end


def _like(word: str, original: str) -> str:
    """``word`` in capitals, with a capital at each part, or small, as ``original`` is."""
    if len(original) > 1 and original.isupper():
        return word.upper()
    return _RUN.sub(lambda m: m.group()[0].upper() + m.group()[1:], word) if original[:1].isupper() else word


def dressed(kind: str, span: str, known: str, replacement: str) -> str:
    """The surrogate of the entity ``known`` in the form of the span: its order, marks and case."""
    if kind == "name":
        own = entity("name", span)
        words, new = own.split(" "), replacement.split(" ")
        if own != known:  # a short form of the entity
            full = known.split(" ")
            if len(words) > 1:
                new = [new[0][0] + ".", *new[-1:]] if len(words) == 2 else [new[0][0] + ".", *words[1:-1], new[-1]]
            else:
                new = [new[0] if words[0] == full[0] else new[-1]]
        if "," in span:
            k = len(span.split(",", 1)[0].split())
            order, originals = new[-k:] + new[:-k], span.replace(",", " ").split()
            order = [_like(w, o) for w, o in zip(order, originals)] + order[len(originals) :]
            return " ".join(order[:k]) + ", " + " ".join(order[k:])
        originals = span.split()
        return " ".join(_like(w, originals[min(i, len(originals) - 1)]) for i, w in enumerate(new))
    places = {m.start() + i for m in _SPELLED.finditer(span) for i in range(len(m.group()))} if kind == "email" else set()
    letters = [c for c in replacement if c.isalnum()]
    held = sum(c.isalnum() and i not in places for i, c in enumerate(span))
    extra = len(letters) - held
    before, body = ("".join(letters[:extra]), letters[extra:]) if kind == "email" and extra > 0 else ("", letters)
    out, at = [], 0
    for i, c in enumerate(span):
        if c.isalnum() and i not in places:
            out.append(body[at].upper() if c.isupper() else body[at])
            at += 1
        else:
            out.append(c)
    return before + "".join(out) + "".join(body[at:])


# ---------------------------------------------------------------- the table of surrogates


def entities(details: DataFrame) -> DataFrame:
    """(kind, entity, gender) of a frame with ``details``: one row each, the gender most mentions tell."""
    flat = details.select(F.explode("details").alias("d")).groupBy("d.kind", "d.entity").agg(F.sum(F.expr("int(d.gender = 'f') - int(d.gender = 'm')")).alias("n"))
    return flat.select("kind", "entity", F.when(F.col("n") > 0, "f").when(F.col("n") < 0, "m").otherwise("").alias("gender"))


def surrogates(known: DataFrame, key: str, taken: DataFrame | None = None, rounds: int = ROUNDS) -> DataFrame:
    """(kind, entity, surrogate), one to one within a kind; neither it nor a short form is a real text.

    ``taken`` has further real texts in ``real``. Each round the entities still open make a
    few draws; of a draw several want the first gets it, and an entity keeps its first.
    An entity open after all rounds fails the job, so that no real text is let through.
    """
    secret = key.encode()

    def drawn(first: int):
        def batches(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = []
                for kind, name, gender in zip(frame["kind"], frame["entity"], frame["gender"]):
                    for attempt in range(first, first + (DRAWS if first else 1)):
                        new = surrogate_of(kind, name, secret, attempt, gender)
                        rows.append((kind, name, attempt, new, [new, *(short_forms(new) if kind == "name" else [])]))
                yield pd.DataFrame(rows, columns=["kind", "entity", "attempt", "surrogate", "forms"])

        return batches

    if "gender" not in known.columns:
        known = known.withColumn("gender", F.lit(""))
    known = cut(known.select("kind", "entity", "gender"), "entities")
    real = known.select(F.col("entity").alias("real"))
    real = cut((real if taken is None else real.union(taken.select("real"))).distinct(), "real")
    done: DataFrame | None = None
    open_ = known
    for number in range(rounds):
        draws = open_.mapInPandas(drawn(number * DRAWS), "kind string, entity string, attempt int, surrogate string, forms array<string>")
        draws = cut(draws, "draws")
        barred = draws.select("kind", "entity", "attempt", F.explode("forms").alias("real")).join(real, "real", "left_semi").select("kind", "entity", "attempt").distinct()
        free = draws.drop("forms").join(barred, ["kind", "entity", "attempt"], "left_anti")
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min(F.struct("attempt", "entity")).alias("w"))
        kept = won.groupBy("kind", "w.entity").agg(F.min(F.struct("w.attempt", "surrogate")).alias("k")).select("kind", "entity", F.col("k.surrogate").alias("surrogate"))
        kept = cut(kept, "surrogates")
        done = kept if done is None else done.unionByName(kept)
        open_ = known.join(done, ["kind", "entity"], "left_anti")
        if open_.isEmpty():
            return done
    raise RuntimeError(f"entities without a free surrogate after {rounds} rounds")


def _flat(details: DataFrame, key: str, ids: list[str]) -> DataFrame:
    """(ids..., start, end, kind, span, new) of a written frame with ``details``."""
    flat = details.select(*ids, F.explode("details").alias("d")).select(*ids, "d.*")
    table = surrogates(entities(details), key, flat.select(F.col("own").alias("real")).distinct())

    @F.pandas_udf("string")
    def form(kinds: pd.Series, originals: pd.Series, known: pd.Series, new: pd.Series) -> pd.Series:
        return pd.Series([dressed(*x) for x in zip(kinds, originals, known, new)])

    return flat.join(table, ["kind", "entity"]).select(*ids, "start", "end", "kind", "span", form("kind", "span", "entity", "surrogate").alias("new"))


def replacements(df: DataFrame, key: str, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, start, end, kind, span, new): every detail of every text with what replaces it."""
    details = cut(spread(detected(df.select(doc, text), text).filter(F.size("details") > 0).select(doc, "details")), "details")
    return _flat(details, key, [doc])


def replaced(df: DataFrame, key: str, text: str = "text") -> DataFrame:
    """``df`` with each detail replaced by its entity's surrogate in the form of the original."""
    rows = cut(detected(df, text).withColumn("_pii_row", F.monotonically_increasing_id()), "details")
    some = rows.filter(F.size("details") > 0)
    new = _flat(some.select("_pii_row", "details"), key, ["_pii_row"])
    # A row's list holds the details of one text.
    lists = new.groupBy("_pii_row").agg(F.collect_list(F.struct("start", "end", "new")).alias("_pii_new"))

    @F.pandas_udf("string")
    def placed(texts: pd.Series, parts: pd.Series) -> pd.Series:
        return pd.Series([_spliced(t, [(p["start"], p["end"], p["new"]) for p in ps]) for t, ps in zip(texts, parts)])

    got = some.drop("details").join(lists, "_pii_row").withColumn(text, placed(text, "_pii_new")).drop("_pii_new")
    return rows.filter(F.size("details") == 0).drop("details").unionByName(got).select(*df.drop("details").columns)
