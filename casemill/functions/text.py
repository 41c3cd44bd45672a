"""Text expressions shared by the operators."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def normalised(col: Column) -> Column:
    """Upper case, trimmed, inner runs of blanks made one blank. NULL stays NULL."""
    return F.trim(F.regexp_replace(F.upper(col), r"(?U)\s+", " "))


def filled(col: Column) -> Column:
    """True where the text is neither NULL nor blank."""
    return F.coalesce(F.trim(col) != "", F.lit(False))


def number(col: Column) -> Column:
    """The text as a double; NULL for all but plain decimal numbers (a cast alone takes ``12d``, too)."""
    text = F.trim(col.cast("string"))
    return F.when(text.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"), text.try_cast("double"))


_BLANKS = re.compile(r"\s+")


def normalised_py(text: str) -> str:
    """``normalised`` for one Python string."""
    return _BLANKS.sub(" ", text.upper()).strip()


# Letters of other scripts that look like Latin ones, and digits that
# character recognition puts for letters.
LOOKALIKE_FROM = "АВЕКМНОРСТУХІЈЅΑΒΕΖΗΙΚΜΝΟΡΤΥΧ"
LOOKALIKE_TO = "ABEKMHOPCTYXIJSABEZHIKMNOPTYX"
DIGIT_FROM = "013589"
DIGIT_TO = "OIESBG"

_LOOKALIKE = str.maketrans(LOOKALIKE_FROM, LOOKALIKE_TO)
_DIGITS = str.maketrans(DIGIT_FROM, DIGIT_TO)


def folded(text: str) -> str:
    """Upper case without accents and with look-alike letters made Latin."""
    text = unicodedata.normalize("NFKD", text.upper().translate(_LOOKALIKE))
    return "".join(c for c in text if not unicodedata.combining(c))


def letters(text: str) -> str:
    """The skeleton names are compared by: folded, digits read as letters, nothing but letters."""
    return "".join(c for c in folded(text).translate(_DIGITS) if "A" <= c <= "Z")
