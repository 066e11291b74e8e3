"""Column expressions on free-text cells."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Texts that only say that a value is not known, trimmed and in lower case.
PLACEHOLDERS = [
    "", "-", "--", "---", ".", "..", "...", "?", "??", "???", "fixme", "missing", "n.a.", "n/a", "na", "nan", "nil", "no data",
    "not known", "null", "tba", "tbc", "tbd", "todo", "undefined", "unknown", "unspecified", "xxx",
]

#: Blanks of a text cell, also those beyond ASCII.
BLANKS = r"[\s\u00a0\u1680\u2000-\u200a\u202f\u205f\u3000]"


def trimmed(c: Column) -> Column:
    return F.regexp_replace(c.cast("string"), f"^{BLANKS}+|{BLANKS}+$", "")


def is_placeholder(c: Column) -> Column:
    """True for placeholders and null."""
    return F.coalesce(F.lower(trimmed(c)).isin(PLACEHOLDERS), F.lit(True))


def usable_word(c: Column) -> Column:
    """The cell trimmed and in lower case; null where it is no value."""
    word = F.lower(trimmed(c))
    return F.when(word.isin(PLACEHOLDERS), None).otherwise(word)


def plain_key(c: Column) -> Column:
    """A spelling without letter case, blanks and punctuation."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]+", ""))
