"""Expressions on raw text cells: trimming, null tokens, numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Optional sign, digits with an optional point, optional exponent; \z, for $ allows a line break.
DECIMAL = r"\A[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\z"
WHOLE = r"\A[+-]?[0-9]+\z"
#: Types whose cells must be numbers.
NUMBER_TYPES = ("numerical", "discrete")


def trimmed(c: Column) -> Column:
    """Without spaces and tabs at both ends."""
    return F.trim(c, F.lit(" \t"))


def is_decimal(c: Column) -> Column:
    return c.rlike(DECIMAL)


def lower_tokens(tokens: Column) -> Column:
    """The null tokens in lower case; no list counts as an empty one, null entries as none."""
    return F.coalesce(F.transform(F.filter(tokens, lambda t: t.isNotNull()), F.lower), F.array().cast("array<string>"))


def is_missing(cell: Column, feature_type: Column, lowered_tokens: Column) -> Column:
    """A cell that holds no value: null, blank, a null token in any case, or no number where one is due.

    An unknown feature type (null) counts as categorical. Never null.
    """
    t = trimmed(cell)
    number = F.coalesce(F.lower(feature_type).isin(*NUMBER_TYPES), F.lit(False))
    return cell.isNull() | (t == "") | F.array_contains(lowered_tokens, F.lower(t)) | (number & ~is_decimal(t))
