"""Lines of typeset tables and macros; what is missing shows as a mark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "??"


def _text(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(MARK))


def latex_escaped(value: Column) -> Column:
    """Characters that LaTeX reads as commands, as text."""
    plain = F.regexp_replace(value, r"\\", "\x00")
    plain = F.regexp_replace(plain, r"([&%$#_{}])", r"\\$1")
    for c, word in (("~", "asciitilde"), (r"\^", "asciicircum"), ("\x00", "backslash")):
        plain = F.regexp_replace(plain, c, rf"\\text{word}{{}}")
    return plain


def latex_row(*columns: str) -> Column:
    return F.concat(F.concat_ws(" & ", *(latex_escaped(_text(c)) for c in columns)), F.lit(r" \\"))


def markdown_row(*columns: str) -> Column:
    cells = (F.regexp_replace(F.regexp_replace(_text(c), r"\|", r"\\|"), r"\s*\n\s*", " ") for c in columns)
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))


def latex_macro(name: str, value: str) -> Column:
    """A macro of a value; its name keeps letters only, and digits become letters from a on."""
    letters = F.regexp_replace(F.translate(F.col(name).cast("string"), "0123456789", "abcdefghij"), "[^A-Za-z]", "")
    return F.concat(F.lit(r"\newcommand{" + "\\"), letters, F.lit("}{"), latex_escaped(_text(value)), F.lit("}"))
