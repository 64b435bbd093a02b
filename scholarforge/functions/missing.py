"""Values that say "not known": one definition for every operator that needs it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words, signs and placeholder numbers that stand for "not known", in lower case.
STAND_INS = (
    "unknown", "n/a", "na", "n.a.", "n.a", "n. a.", "not stated", "not known", "not available", "not applicable", "none", "null", "nil", "nan", "tbc", "tba", "tbd",
    "missing", "undefined", "unspecified", "no data", "empty", "?", "??", "???", "-", "--", "---", "–", "—", ".", "..", "...", "…", "*", "/", "_", "x", "xx", "xxx",
    "0", "00", "000", "0000", "0.0", "9999", "9999.0", "-1", "-1.0", "-99", "-999", "99999", "1900-01-01", "#n/a", "(none)", "(null)", "(unknown)",
)

_SPACES = r"[\s\u0085\u00a0\u00ad\u1680\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]+"


def plain(value: Column) -> Column:
    """Lower case, full-width forms made ordinary, any white space and invisible characters as one blank, trimmed."""
    wide = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
    text = F.translate(value, wide, "".join(chr(ord(c) - 0xFEE0) for c in wide))
    return F.lower(F.trim(F.regexp_replace(text, _SPACES, " ")))


def has_value(value: Column) -> Column:
    """Whether a cell holds a value: false for null, blank and stand-ins, never null."""
    text = plain(value.cast("string"))
    return F.coalesce((text != "") & ~text.isin(*STAND_INS), F.lit(False))


def known(value: Column) -> Column:
    """The value itself, or null where it holds none."""
    return F.when(has_value(value), value)
