"""Text expressions: column-name normalising, numeric text, number formatting."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters a table heading may carry that become one underscore.
HEADING_PUNCTUATION = " ()/-,."
_PUNCTUATION = "[" + re.escape(HEADING_PUNCTUATION) + "]"
# Texts that stand for a missing number.
MISSING_TEXT = ("", "nan", "None")
MINUS_SIGN = "−"


def clean_name(name: str) -> str:
    """Heading to column name. Python twin of :func:`clean_name_col`, for schema work on the driver."""
    text = name.strip().replace("\n", " ").replace("'", "").replace("%", "Percent")
    return re.sub(r"_+", "_", re.sub(_PUNCTUATION, "_", text)).strip("_")


def clean_name_col(c: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, r"^\s+|\s+$", ""), "\n", " "), "'", "")
    text = F.regexp_replace(F.regexp_replace(text, "%", "Percent"), _PUNCTUATION, "_")
    return F.regexp_replace(F.regexp_replace(text, "_+", "_"), "^_+|_+$", "")


def to_number(c: Column) -> Column:
    """Numeric text with thousands commas, percent signs, blanks or a typographic minus; bad text is NULL."""
    bare = F.translate(F.translate(c, ",% ", ""), MINUS_SIGN, "-")
    suffixed = bare.rlike(r"[0-9.][dDfF]$")  # Java number suffixes are no part of a number here
    return coerce(F.when(bare.isin(*MISSING_TEXT) | suffixed, F.lit(None)).otherwise(bare))


def coerce(c: Column) -> Column:
    """Anything to double; what is no number becomes NULL, and so does NaN."""
    d = c.try_cast("double")
    return F.when(F.isnan(d), F.lit(None)).otherwise(d)


def thousands(c: Column) -> Column:
    return F.format_number(c, 0)


def fixed(c: Column, digits: int) -> Column:
    return F.format_string(f"%.{digits}f", c)


def percent(c: Column, digits: int) -> Column:
    return F.concat(F.format_string(f"%.{digits}f", c * 100), F.lit("%"))


def table_row(*cells: Column) -> Column:
    """One line of a pipe table."""
    return F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |"))
