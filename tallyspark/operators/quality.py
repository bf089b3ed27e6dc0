"""Frame summary, headline figures and the warnings about weak data."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnusableInput
from ..functions.dates import whole_days
from ..functions.money import amount, grand_total, half_even, sum_units
from ..functions.order_stats import median
from ..schema import SUSPICIOUS_REASONS
from ..session import stage
from .features import COUNTRY, ORDER, cells_of, lattice


def one_row(*parts: DataFrame) -> DataFrame:
    """Single-row frames side by side, without a join."""
    stacked = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return stacked.agg(*[F.max(c).alias(c) for c in stacked.columns])


def order_totals(cells: DataFrame) -> DataFrame:
    """(order_id, rows, units, first, last) per order, from the order cells of a lattice."""
    return cells_of(cells, ORDER).groupBy(F.col("key").alias("order_id")).agg(
        F.sum("rows").alias("rows"),
        F.sum("value_units").alias("units"),
        F.min("first_line").alias("first"),
        F.max("last_line").alias("last"))


def distinct_values(df: DataFrame, column: str, name: str) -> DataFrame:
    """One row with the exact number of distinct non-null values."""
    return df.select(column).distinct().agg(F.count(column).alias(name))


def distinct_customers(cells: DataFrame) -> DataFrame:
    return cells_of(cells, ORDER).select("customer_id").distinct().agg(
        F.count("customer_id").alias("customers"))


def summary(lines: DataFrame, cells: DataFrame | None = None) -> DataFrame:
    """Rows, customers, orders, countries, date range, revenue and mean order value.

    Read off the lattice of the lines where there is one; for these few figures alone three
    narrow aggregations cost less than making one. None has several distinct counts, which would
    send every line three times through the shuffle.
    """
    totals = order_totals(cells) if cells is not None else lines.groupBy("order_id").agg(
        F.count(F.lit(1)).alias("rows"), sum_units(F.col("line_value")).alias("units"),
        F.min("order_date").alias("first"), F.max("order_date").alias("last"))
    orders = totals.agg(
        F.sum("rows").alias("rows"),
        F.count("order_id").alias("orders"),
        F.date_format(F.min("first"), "yyyy-MM-dd").alias("date_from"),
        F.date_format(F.max("last"), "yyyy-MM-dd").alias("date_to"),
        half_even(grand_total(F.col("units")), 2).alias("revenue"),
        half_even(F.try_divide(grand_total(F.col("units")), F.count("order_id")), 2)
        .alias("avg_order_value"))
    if cells is None:
        return one_row(orders, distinct_values(lines, "customer_id", "customers"),
                       distinct_values(lines, "country", "countries"))
    return one_row(orders, distinct_customers(cells),
                   distinct_values(cells_of(cells, COUNTRY), "key", "countries"))


def require_customers(summary_row) -> None:
    """Reject input that cannot be segmented."""
    if not summary_row.rows:
        raise UnusableInput("no usable rows; check the file or the column mapping")
    if summary_row.customers < 2:
        raise UnusableInput("at least two customers are needed")


def kpis(features: DataFrame) -> DataFrame:
    """Customers, share of repeat buyers, mean order value and revenue.

    Read off the feature table: its spend and order counts add up to the order totals.
    """
    return features.agg(
        F.count(F.lit(1)).alias("total_customers"),
        half_even(F.count_if(F.col("frequency") > 1) / F.count(F.lit(1)) * 100, 1)
        .alias("repeat_rate_pct"),
        half_even(grand_total(F.rint(F.col("monetary") * 10_000.0).cast("long"))
                  / F.sum("frequency"), 2).alias("avg_order_value"),
        half_even(grand_total(F.rint(F.col("monetary") * 10_000.0).cast("long")), 2)
        .alias("revenue"))


def suspicious_share(report: DataFrame) -> DataFrame:
    """Share of input rows lost to parsing or mapping problems, from the ingest report."""
    bad = F.sum(F.when(F.col("reason").isin(SUSPICIOUS_REASONS), F.col("rows")).otherwise(0))
    return report.agg(F.coalesce(F.try_divide(bad, F.sum("rows")), F.lit(0.0))
                      .alias("suspicious_share"))


def quality_inputs(lines: DataFrame, report: DataFrame | None = None,
                   cells: DataFrame | None = None) -> DataFrame:
    """One row (span_days, median_order, customers, suspicious_share), read off the lattice of
    the lines (``cells`` where there is one already)."""
    cells = lattice(lines, (ORDER,)) if cells is None else cells
    totals = stage(order_totals(cells).select(
        amount(F.col("units")).alias("v"), "first", "last"), "totals")
    middle = median(totals, "v")
    span = totals.agg(whole_days(F.max("last"), F.min("first")).alias("span_days"),
                      F.lit(middle).cast("double").alias("median_order"))
    parts = [span, distinct_customers(cells)]
    if report is not None:
        parts.append(suspicious_share(report))
    row = one_row(*parts)
    return row if report is not None else row.withColumn("suspicious_share", F.lit(0.0))


# Warning texts, in the two content languages.
WARNING_TEXT = {
    "short-window": {
        "en": "The data covers only %d days. Frequency-based segmentation needs roughly "
              "6+ months — on a short window almost everyone looks like a one-time buyer.",
        "cs": "Data pokrývají jen %d dní. Segmentace podle frekvence nákupů potřebuje "
              "zhruba 6+ měsíců – na krátkém okně vypadá skoro každý jako jednorázový "
              "zákazník.",
    },
    "tiny-money": {
        "en": "Median order value is %.2f — money columns were probably parsed with the "
              "wrong decimal separator. Re-check the mapping (decimal , vs .).",
        "cs": "Mediánová hodnota objednávky je %.2f – peněžní sloupce se nejspíš načetly "
              "se špatným desetinným oddělovačem. Zkontrolujte mapování (desetinná , vs .).",
    },
    "few-customers": {
        "en": "Only %d customers — quantile-based segments are coarse below ~50; read "
              "them as rough groups.",
        "cs": "Jen %d zákazníků – kvantilové segmenty jsou pod ~50 zákazníky hrubé; berte "
              "je jako orientační skupiny.",
    },
    "high-drop": {
        "en": "%d %% of rows were dropped as unparseable — the column mapping or the "
              "decimal/date format is probably off for part of the file.",
        "cs": "%d %% řádků se nepodařilo načíst – mapování sloupců nebo formát desetinných "
              "čísel či dat je pro část souboru nejspíš špatně.",
    },
    "weak-structure": {
        "en": "Rule-based segments and KMeans clusters barely agree (ARI %.2f) — segment "
              "boundaries are uncertain. Often a symptom of a short or sparse history.",
        "cs": "Pravidlové segmenty a shluky KMeans se téměř neshodují (ARI %.2f) – hranice "
              "segmentů jsou nejisté. Bývá to příznak krátké nebo řídké historie.",
    },
}


def warnings(inputs: DataFrame, agreement: Column | None = None,
             language: str = "en") -> DataFrame:
    """(code, severity, message) for every rule that fires on the one-row ``inputs``."""
    language = "cs" if language == "cs" else "en"
    ari = (agreement if agreement is not None else F.lit(None)).cast("double")
    days, customers = F.col("span_days"), F.col("customers")
    share, middle = F.col("suspicious_share"), F.col("median_order")
    percent = F.bround(100 * share, 0).cast("int")
    rules = [
        ("short-window", "high", days < 180, days),
        ("tiny-money", "high", middle < 1, middle),
        ("few-customers", "medium", customers < 50, customers),
        ("high-drop", "medium", share > 0.2, percent),
        ("weak-structure", "medium", (ari < 0.15) & (customers >= 50), ari),
    ]
    rows = F.array(*[
        F.when(fires, F.struct(
            F.lit(code).alias("code"), F.lit(severity).alias("severity"),
            F.format_string(WARNING_TEXT[code][language], value).alias("message")))
        for code, severity, fires, value in rules])
    return inputs.select(F.explode(F.array_compact(rows)).alias("w")).select("w.*")
