"""Numbers written as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A plain decimal number. Guards the cast against Java-only spellings such as '12d'.
_PLAIN_NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*\z"


def is_numeric_type(data_type: T.DataType) -> bool:
    return isinstance(data_type, T.NumericType)


def is_plain_number(cell: Column) -> Column:
    return cell.rlike(_PLAIN_NUMBER)


def plain_number(cell: Column) -> Column:
    """Text -> double when the whole cell is a number, else null."""
    return F.when(is_plain_number(cell), F.trim(cell).try_cast("double"))


def locale_number(cell: Column, decimal: str = ".") -> Column:
    """Text -> double after dropping currency signs, letters and spaces.

    ``decimal=','`` reads dots as thousands separators and the comma as the decimal mark;
    ``decimal='.'`` drops commas. What is left over and is no number gives null.
    """
    def read(text):
        # ',' decimal: ',' -> '.', '.' dropped; '.' decimal: ',' dropped
        return (F.translate(text, ",.", ".") if decimal == "," else F.translate(text, ",", "")) \
            .try_cast("double")

    foreign = cell.rlike(r"[^\d,.\-]")          # bare cells skip the costly rewrite
    return read(F.when(foreign, F.regexp_replace(cell, r"[^\d,.\-]+", "")).otherwise(cell))


def number_column(cell: Column, data_type: T.DataType, decimal: str = ".") -> Column:
    """Double from a numeric column (as it is; NaN is missing) or a text column."""
    if is_numeric_type(data_type):
        value = cell.cast("double")
        return F.when(~F.isnan(value), value)
    return locale_number(cell.cast("string"), decimal)


def czech_money(cell: Column) -> Column:
    """'1 234,56' or '-129,46' -> double; spaces may be no-break spaces."""
    return plain_number(F.translate(cell, ", \u00a0", "."))
