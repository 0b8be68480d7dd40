"""Text normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def utrim(text: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def utrim_end(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)\s+$", "")


def or_null(text: Column) -> Column:
    """Null for an empty text."""
    return F.when(text != "", text)


def recognized_text(text: Column) -> Column:
    """What a text recognizer's answer becomes: trimmed, null if nothing is left."""
    return or_null(utrim(text))


def lines_of(text: Column) -> Column:
    """Trimmed lines that are not empty; carriage returns and newlines both end a line."""
    return F.filter(F.transform(F.split(text, "[\r\n]"), utrim), lambda x: x != "")


def inline(text: Column) -> Column:
    """All lines on one line."""
    return F.array_join(lines_of(text), " ")


def bullets(text: Column) -> Column:
    """A Markdown list of the lines, without the bullets that they had; a line of bullets only stays."""

    def one(line: Column) -> Column:
        bare = F.regexp_replace(line, r"^[-*•· ]+", "")
        return F.concat(F.lit("- "), F.when(bare == "", line).otherwise(bare))

    return utrim_end(F.array_join(F.transform(lines_of(text), one), "\n"))


def normalize_latex(text: Column) -> Column:
    """Trimmed LaTeX without one pair of math delimiters; null if nothing is left."""
    s = utrim(text)
    n = F.length(s)
    inner = lambda k: F.substring(s, F.lit(k + 1), n - 2 * k)
    bare = (
        F.when(s.startswith("$$") & s.endswith("$$") & (n >= 4), inner(2))
        .when(s.startswith("$") & s.endswith("$") & (n >= 2), inner(1))
        .when(s.startswith("\\[") & s.endswith("\\]") & (n >= 4), inner(2))
        .when(s.startswith("\\(") & s.endswith("\\)") & (n >= 4), inner(2))
        .otherwise(s)
    )
    return or_null(utrim(bare))
