"""Reading free-form text values as typed values, as column expressions.

A value is *missing* when it is null, nothing but blanks (spaces and tabs) or one
of ``MISSING`` in any case; blanks at both ends never matter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The texts that stand for a missing value, and the two boolean word lists.
MISSING = ("na", "n/a", "null", "-", "?")
TRUE_WORDS = ("true", "yes", "1")
FALSE_WORDS = ("false", "no", "0")

INTEGER_PATTERN = r"[+-]?[0-9]+"
DECIMAL_PATTERN = r"[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?"
DATE_PATTERN = r"[0-9]{4}-[0-9]{2}-[0-9]{2}"

#: Spark type of a typed column for each declared value type.
SPARK_TYPES = {"string": "string", "integer": "decimal(38,0)", "decimal": "double", "boolean": "boolean", "date": "date"}


def strip_blanks(text: Column) -> Column:
    """Without spaces and tabs at both ends."""
    return F.btrim(text, F.lit(" \t"))


def field_key(name: Column) -> Column:
    """The form in which field names are compared."""
    return F.lower(strip_blanks(name))


def present(text: Column) -> Column:
    """The stripped text, or null where it is missing."""
    bare = strip_blanks(text)
    return F.when((bare == "") | F.lower(bare).isin(*MISSING), F.lit(None)).otherwise(bare)


def full_match(text: Column, pattern: str) -> Column:
    return text.rlike(rf"\A(?:{pattern})\z")


def as_integer(text: Column) -> Column:
    """DECIMAL(38,0); null where not readable or of more than 38 digits."""
    return F.when(full_match(text, INTEGER_PATTERN), text.try_cast("decimal(38,0)"))


def as_decimal(text: Column) -> Column:
    return F.when(full_match(text, DECIMAL_PATTERN), text.try_cast("double"))


def as_boolean(text: Column) -> Column:
    low = F.lower(text)
    return F.when(low.isin(*TRUE_WORDS), F.lit(True)).when(low.isin(*FALSE_WORDS), F.lit(False))


def as_date(text: Column) -> Column:
    """Days of the years 0001 to 9999."""
    return F.when(full_match(text, DATE_PATTERN) & ~text.startswith("0000"), text.try_cast("date"))


READERS = {"string": lambda text: text, "integer": as_integer, "decimal": as_decimal, "boolean": as_boolean, "date": as_date}


def typed(text: Column, value_type: str) -> Column:
    """``text`` read as the declared type; null where missing or not readable."""
    return READERS[value_type](present(text))


def canonical(column: Column, value_type: str) -> Column:
    """A typed value as text: plain integers, three decimals, true/false, yyyy-MM-dd."""
    if value_type == "decimal":
        return F.when(column.isNotNull(), F.format_string("%.3f", column))
    return column.cast("string")
