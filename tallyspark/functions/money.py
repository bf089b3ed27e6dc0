"""Fixed-point sums.

Adding doubles gives a result that depends on the order of the rows, hence on partitioning
and on retries. Lines are therefore turned into whole ten-thousandths (BIGINT) before they
are added. Such sums are exact, order-free and stay in the generated aggregation code. One
group holds up to 9.2e14 currency units; beyond that ANSI arithmetic raises. Totals over
groups are added as DECIMAL.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALE = 10_000.0
#: The largest amount of one line; what is beyond, infinite or no number gets a drop reason.
LARGEST = 1e12


def fits(value: Column) -> Column:
    """Whether an amount can be added; true for a missing one."""
    return F.coalesce(F.abs(value) <= F.lit(LARGEST), F.lit(True))


def units(value: Column) -> Column:
    """Double -> whole ten-thousandths."""
    return F.rint(value * F.lit(SCALE)).cast("long")


def amount(total_units: Column) -> Column:
    """Whole ten-thousandths -> double."""
    return total_units.cast("double") / F.lit(SCALE)


def sum_units(value: Column) -> Column:
    """Sum of a double column, in ten-thousandths; 0 for a group without values."""
    return F.coalesce(F.sum(units(value)), F.lit(0).cast("long"))


def grand_total(total_units: Column) -> Column:
    """Sum of group totals, wide enough for any number of groups, as a double amount."""
    return amount(F.coalesce(F.sum(total_units.cast("decimal(19,0)")), F.lit(0)))


def half_even(value: Column, digits: int) -> Column:
    """Round half to even on the decimal text of the double; -0.0 becomes 0.0."""
    return F.bround(value, digits) + F.lit(0.0)
