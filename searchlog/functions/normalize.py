"""Column expressions that clean raw log fields."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The search type that means "issued by hand" in each log layout.
INTERACTIVE_LABEL = {
    "format_2012": "historical",
    "format_2013": "historical",
    "format_2014": "adhoc",
}

# The characters that count as whitespace at the ends of a text.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# What a decimal literal looks like, so that suffixes such as 1.5f stay out.
_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"
_SPECIAL_NUMBER = r"(?i)^\s*[+-]?(nan|inf|infinity)\s*$"
_UTC_OFFSET = r"\s*(Z|[+-]\d{2}:?\d{2})\s*$"


def clean_text(text: Column) -> Column:
    """Strip whitespace of every kind from both ends."""
    return F.trim(text, F.lit(WHITESPACE))


def parse_time(raw: Column, wall_clock: bool = False) -> Column:
    """A timestamp, or null for malformed input.

    ``wall_clock`` drops the UTC offset and reads the clock time in the session zone.
    """
    if wall_clock:
        raw = F.regexp_replace(raw, _UTC_OFFSET, "")
    return F.try_to_timestamp(raw)


def lenient_double(raw: Column) -> Column:
    """A double, or null for anything that is not a number (``N/A``, empty)."""
    text = F.trim(raw)
    special = F.when(F.lower(text).contains("nan"), F.lit(float("nan"))).otherwise(
        F.when(text.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    )
    return F.when(raw.rlike(_NUMBER), text.try_cast("double")).when(raw.rlike(_SPECIAL_NUMBER), special)


def realtime_flag(raw: Column) -> Column:
    """True or false for exactly those words, else null."""
    return F.when(raw == "true", True).when(raw == "false", False)


def first_present(df: DataFrame, *names: str) -> Column:
    """The first of several alias columns that is not null; null when the layout has none of them."""
    present = [F.col(f"`{name}`") for name in names if name in df.columns]
    return F.coalesce(*present) if present else F.lit(None).cast("string")


def interactive_flag(search_type: Column, version: str = "format_2014") -> Column:
    """Whether the search type is the layout's interactive label; a missing type is not."""
    if version not in INTERACTIVE_LABEL:
        raise ValueError(f"unknown log version {version!r}, expected one of {sorted(INTERACTIVE_LABEL)}")
    return F.coalesce(search_type == INTERACTIVE_LABEL[version], F.lit(False))


def split_interactive(queries: DataFrame, version: str) -> DataFrame:
    """Set ``is_interactive`` on every query by the layout's label."""
    return queries.withColumn("is_interactive", interactive_flag(F.col("search_type"), version))


def truth_value(raw: Column) -> Column:
    """``true``/``t`` in any case, or a number other than zero."""
    return F.coalesce(F.lower(raw).isin("true", "t") | (lenient_double(raw) != 0), F.lit(False))
