"""Dates of unknown spelling, and whole-day arithmetic on wall-clock timestamps.

Everything is TIMESTAMP_NTZ: order dates carry no zone, so no result may depend on the
session time zone.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .numbers import is_plain_number, plain_number
from .order_stats import median
from .text import strip

_NUMERIC_DATE = r"^\s*(\d{1,2})([./-])(\d{1,2})[./-]"
_EPOCH_LIMIT = 9_223_372_036      # seconds; beyond it a nanosecond timestamp does not exist


# How a cell writes its date, by its first characters.
SHAPES = ("iso", "named", "short", "other")


@dataclass(frozen=True)
class DateStyle:
    """How a column writes dates. kind: timestamp | excel | seconds | millis | text.
    ``shapes`` are the text shapes that occur; ``half_day`` tells whether AM/PM does."""

    kind: str
    day_first: bool = False
    shapes: tuple[str, ...] = SHAPES
    half_day: bool = True


def _starts_short(text: Column) -> Column:
    separators = [".", "/", "-"]
    return F.substring(text, 2, 1).isin(separators) | F.substring(text, 3, 1).isin(separators)


def _ends_like_half_day(text: Column) -> Column:
    return F.right(text, F.lit(1)).isin("m", "M", ".")


def shape_of(text: Column) -> Column:
    """One of SHAPES for a trimmed cell; character tests before the regex."""
    return (F.when(F.substring(text, 5, 1) == "-", "iso")
             .when(text.rlike("[A-Za-z]{3}"), "named")
             .when(_starts_short(text), "short")
             .otherwise("other"))


def day_first_evidence(cell: Column) -> dict[str, Column]:
    """Aggregates that decide between day/month and month/day."""
    short = F.when(_starts_short(strip(cell)), cell)
    first = F.regexp_extract(short, _NUMERIC_DATE, 1)
    second = F.regexp_extract(short, _NUMERIC_DATE, 3)
    no = F.lit(False)

    def over_12(part):
        return F.coalesce(F.bool_or(part.try_cast("int") > 12), no)

    return {
        "first_over_12": over_12(first),
        "second_over_12": over_12(second),
        "dotted": F.coalesce(F.bool_or(F.regexp_extract(short, _NUMERIC_DATE, 2) == "."), no),
    }


def day_first_rule(first_over_12: Column, second_over_12: Column, dotted: Column) -> Column:
    return (F.when(first_over_12 & ~second_over_12, True)
             .when(second_over_12 & ~first_over_12, False)
             .otherwise(dotted))


def kind_rule(numeric_share: Column, middle: Column) -> Column:
    """Name of the date kind from the share of numeric cells and their median."""
    return F.when(numeric_share > 0.9,
                  F.when(middle.between(20_000, 80_000), "excel")
                   .when(middle.between(1e9, 3e9), "seconds")
                   .when(middle.between(1e12, 3e12), "millis")
                   .otherwise("text")).otherwise("text")


def date_profile(df: DataFrame, column: str) -> DataFrame:
    """One row (kind, day_first, numeric_share, shapes, half_day) describing how ``column``
    writes dates.

    One aggregation over the whole column; a second pass for the exact median runs only
    when the column is mostly numeric.
    """
    cell = F.col(column).cast("string")
    text = strip(cell)
    shape = shape_of(text)
    evidence = df.select(cell.alias("cell"), text.alias("text"), shape.alias("shape")).agg(
        (F.count_if(is_plain_number(F.col("cell")))
         / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("numeric_share"),
        *[F.coalesce(F.bool_or(F.col("shape") == s), F.lit(False)).alias(f"has_{s}")
          for s in SHAPES],
        F.coalesce(F.bool_or(_ends_like_half_day(F.col("text"))), F.lit(False))
         .alias("half_day"),
        *[agg.alias(name) for name, agg in day_first_evidence(F.col("cell")).items()],
    ).first()
    middle = None
    if evidence.numeric_share > 0.9:
        middle = median(df.select(plain_number(cell).alias("n")), "n")
    one = df.sparkSession.range(1)
    return one.select(
        kind_rule(F.lit(evidence.numeric_share), F.lit(middle).cast("double")).alias("kind"),
        day_first_rule(F.lit(evidence.first_over_12), F.lit(evidence.second_over_12),
                       F.lit(evidence.dotted)).alias("day_first"),
        F.lit(evidence.numeric_share).alias("numeric_share"),
        F.array(*[F.lit(s) for s in SHAPES if evidence[f"has_{s}"]]).cast("array<string>")
         .alias("shapes"),
        F.lit(evidence.half_day).alias("half_day"),
    )


def detect_style(df: DataFrame, column: str) -> DateStyle:
    data_type = df.schema[column].dataType
    if isinstance(data_type, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return DateStyle("timestamp")
    row = date_profile(df, column).first()
    return DateStyle(row.kind, row.day_first, tuple(row.shapes), row.half_day)


def from_epoch_seconds(seconds: Column) -> Column:
    """Double seconds since 1970 -> timestamp; null when out of range."""
    exact = F.when(F.abs(seconds) <= _EPOCH_LIMIT, seconds).cast("decimal(18,6)")
    zero = F.lit(0)
    return (F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
            + F.make_dt_interval(zero, zero, zero, exact))


# Rewrites to ISO, tried in turn; each leaves text of another shape alone.
_COMPACT_DAY = (r"^(\d{4})(\d{2})(\d{2})(?=$|[T ]|\d{4}$|\d{6}$)[T ]?", "$1-$2-$3 ")
_COMPACT_CLOCK = (r"^(\d{4}-\d{2}-\d{2}) (\d{2})(\d{2})(\d{2})?$", "$1 $2:$3:0$4")
_YEAR_FIRST = (r"^(\d{4})[./](\d{1,2})[./](\d{1,2})", "$1-$2-$3")
_TWO_DIGIT_2000 = (r"^(\d{1,2}[./-] ?\d{1,2}[./-] ?)(?=[0-6]\d(?!\d))", "$120")
_TWO_DIGIT_1900 = (r"^(\d{1,2}[./-] ?\d{1,2}[./-] ?)(?=\d{2}(?!\d))", "$119")
_DAY_MONTH = (r"^(\d{1,2})[./-] ?(0?[1-9]|1[0-2])[./-] ?(\d{4})(?!\d),?", "$3-$2-$1")
_MONTH_DAY = (r"^(0?[1-9]|1[0-2])[./-] ?(\d{1,2})[./-] ?(\d{4})(?!\d),?", "$3-$1-$2")
_HALF_DAY = r"(?i)\s*([ap])\.?m\.?$"


def parse_text_date(cell: Column, day_first: bool, shapes: tuple[str, ...] = SHAPES,
                    half_day: bool = True) -> Column:
    """Text -> timestamp for ISO, day/month and month/day with ``. / -``, compact
    ``yyyyMMdd`` and English month names, each with or without a time; else null.

    Every spelling is rewritten to ISO and read by one non-throwing cast. When the
    preferred day/month order is impossible the other one is taken. Two-digit years below
    70 are of this century. Only the branches for ``shapes`` become part of the plan, so a
    profiled column costs what its own spelling needs.
    """
    text = strip(cell)
    marked = _ends_like_half_day(text)
    clock = (F.when(marked, F.regexp_replace(text, _HALF_DAY, "")).otherwise(text)
             if half_day else text)

    def rewritten(steps):
        out = clock
        for pattern, target in steps:
            out = F.regexp_replace(out, pattern, target)
        return out

    def by_name():
        month_at = F.position(
            F.lower(F.substring(F.regexp_extract(clock, r"([A-Za-z]{3,9})", 1), 1, 3)),
            F.lit("jan feb mar apr may jun jul aug sep oct nov dec"))
        day = r"(?:^|[A-Za-z,. -])(\d{1,2})(?:st|nd|rd|th)?(?:[ ,.-]|$)"
        return F.concat_ws(
            " ",
            F.concat_ws(
                "-", F.regexp_extract(clock, r"\b(\d{4})\b", 1),
                F.when(month_at > 0, F.floor((month_at + 3) / 4).cast("string"))
                 .otherwise("x"),
                F.regexp_extract(clock, day, 1)),
            F.regexp_extract(clock, r"(\d{1,2}:\d{2}(?::\d{2}(?:\.\d+)?)?)", 1))

    order = [_DAY_MONTH, _MONTH_DAY] if day_first else [_MONTH_DAY, _DAY_MONTH]
    branches = {
        "iso": (F.substring(text, 5, 1) == "-", lambda: clock),
        "named": (clock.rlike("[A-Za-z]{3}"), by_name),
        "short": (_starts_short(text),
                  lambda: rewritten([_TWO_DIGIT_2000, _TWO_DIGIT_1900, *order])),
        "other": (F.lit(True),
                  lambda: rewritten([_COMPACT_DAY, _COMPACT_CLOCK, _YEAR_FIRST])),
    }
    iso = F.when(F.lit(False), F.lit(None).cast("string"))
    for shape in shapes:
        fits, rewrite = branches[shape]
        iso = iso.when(fits, rewrite())
    stamp = strip(iso).try_cast("timestamp_ntz")
    if not half_day:
        return stamp
    half = F.when(marked, F.lower(F.regexp_extract(text, _HALF_DAY, 1)))
    twelve = F.regexp_extract(text, r"(\d{1,2}):\d{2}", 1) == "12"
    shift = (F.when((half == "p") & ~twelve, 12).when((half == "a") & twelve, -12)
              .otherwise(0))
    zero = F.lit(0)
    return stamp + F.make_dt_interval(zero, shift, zero, zero)


def parse_date(cell: Column, style: DateStyle) -> Column:
    """Column of any date spelling -> TIMESTAMP_NTZ, bad cells null."""
    if style.kind == "timestamp":
        return cell.cast("timestamp_ntz")
    text = cell.cast("string")
    if style.kind == "excel":
        return from_epoch_seconds((plain_number(text) - 25_569) * 86_400.0)
    if style.kind == "seconds":
        return from_epoch_seconds(plain_number(text))
    if style.kind == "millis":
        return from_epoch_seconds(plain_number(text) / 1_000.0)
    return parse_text_date(text, style.day_first, style.shapes, style.half_day)


def whole_days(later: Column, earlier: Column) -> Column:
    """Full 24-hour periods from ``earlier`` to ``later``, rounded down."""
    calendar = F.datediff(later, earlier)
    zero = F.lit(0)
    overshoot = earlier + F.make_dt_interval(calendar, zero, zero, zero) > later
    return F.when(overshoot, calendar - 1).otherwise(calendar)
