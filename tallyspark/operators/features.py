"""Order roll-up and the customer feature table."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import UnusableInput
from ..functions.dates import whole_days
from ..functions.money import SCALE, amount, sum_units
from ..session import stage
from .canonical import REASON


def product_flag(lines: DataFrame) -> Column:
    return F.col("is_product") if "is_product" in lines.columns else F.lit(True)


#: What the cells of a lattice count lines by, besides the customer.
ORDER, PRODUCT, COUNTRY = "order", "product", "country"


def lattice(lines: DataFrame, kinds: tuple[str, ...] = (ORDER, PRODUCT, COUNTRY)) -> DataFrame:
    """(customer_id, kind, key, rows, first_line, last_line, value_units, item_units): one row per
    customer and order, per customer and product, and per customer and country.

    All counts, most frequent values and sums of the lines are read off this table, which is
    staged: the lines, and whatever joins they come from, are gone through once. Each line is
    added to its cells in a hash map before the shuffle. Money and quantity are kept in
    ten-thousandths, with the orders only; lines that are no products have no product cell.
    """
    flag = product_flag(lines)
    source = {ORDER: "order_id", PRODUCT: "product", COUNTRY: "country"}
    entries = [F.struct(F.lit(kind).alias("kind"), F.col(source[kind]).cast("string").alias("key"))
               for kind in kinds]
    entries = [F.when(flag, e) if kind == PRODUCT else e for kind, e in zip(kinds, entries)]
    cells = lines.select(
        "customer_id", "order_date", "line_value", F.when(flag, F.col("quantity")).alias("items"),
        F.explode(F.array_compact(F.array(*entries))).alias("cell"))
    of_order = F.col("cell.kind") == ORDER
    return stage(cells.groupBy(
        "customer_id", F.col("cell.kind").alias("kind"), F.col("cell.key").alias("key")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.min("order_date").alias("first_line"),
        F.max("order_date").alias("last_line"),
        sum_units(F.when(of_order, F.col("line_value"))).alias("value_units"),
        sum_units(F.when(of_order, F.col("items"))).alias("item_units")), "lattice")


def cells_of(cells: DataFrame, kind: str) -> DataFrame:
    return cells.where(F.col("kind") == kind)


def _by_order_and_customer(lines: DataFrame) -> DataFrame:
    return lines.groupBy(F.col("order_id").alias("key"), "customer_id").agg(
        F.min("order_date").alias("first_line"),
        F.max("order_date").alias("last_line"),
        sum_units(F.col("line_value")).alias("value_units"),
        sum_units(F.when(product_flag(lines), F.col("quantity"))).alias("item_units"))


def _orders(per_order_and_customer: DataFrame) -> DataFrame:
    return per_order_and_customer.groupBy(F.col("key").alias("order_id")).agg(
        F.min_by("customer_id", F.struct("first_line", "customer_id")).alias("customer_id"),
        F.min("first_line").alias("order_date"),
        F.max("last_line").alias("last_line"),
        F.sum("value_units").alias("value_units"),
        F.sum("item_units").alias("item_units"),
    )


def order_rollup(lines: DataFrame) -> DataFrame:
    """One row per order: its customer, first and last date, value and product quantity.

    An order shared by several customers belongs to the customer of its earliest line
    (then the lowest id). Money and quantity are kept in ten-thousandths.

    The lines collapse to (order, customer) first: all its aggregates have a fixed width, so
    they combine in a hash map before the shuffle, whereas picking a text value per order
    would sort every line.
    """
    return _orders(_by_order_and_customer(lines))


def product_diversity(cells: DataFrame) -> DataFrame:
    """Distinct products per customer: product cells are distinct already."""
    return cells_of(cells, PRODUCT).groupBy("customer_id").agg(
        F.count("key").alias("distinct_products"))


def dominant_country(cells: DataFrame) -> DataFrame:
    """Most frequent country per customer, the lowest name on ties."""
    return cells_of(cells, COUNTRY).groupBy("customer_id").agg(
        F.min_by("key", F.struct((-F.col("rows")).alias("r"), F.col("key"))).alias("country"))


def customer_activity(lines: DataFrame, snapshot: datetime | None = None) -> DataFrame:
    """Recency, frequency, spend, basket and tenure per customer.

    Recency is measured from ``snapshot``, by default a day after the last line. That date
    is read off the per-customer table, which is staged for it: the lines are read once.
    """
    return activity_of_orders(order_rollup(lines), snapshot)


def activity_of_orders(orders: DataFrame, snapshot: datetime | None = None) -> DataFrame:
    """``customer_activity`` from the order roll-up."""
    per_customer = orders.groupBy("customer_id").agg(
        F.min("order_date").alias("first_seen"),
        F.max("order_date").alias("last_seen"),
        F.max("last_line").alias("last_line"),
        F.count(F.lit(1)).alias("frequency"),
        F.sum("value_units").alias("spend"),
        F.sum("item_units").alias("items"),
    )
    if snapshot is None:
        per_customer = stage(per_customer, "activity")
        last = per_customer.agg(F.max("last_line").cast("timestamp_ntz")).first()[0]
        if last is None:
            raise UnusableInput("no order lines")
        snapshot = last + timedelta(days=1)
    now = F.lit(snapshot.isoformat(sep=" ")).cast("timestamp_ntz")
    tenure = whole_days(F.col("last_seen"), F.col("first_seen"))
    scaled_orders = F.col("frequency") * F.lit(SCALE)
    return per_customer.select(
        "customer_id",
        whole_days(now, F.col("last_seen")).alias("recency"),
        "frequency",
        amount(F.col("spend")).alias("monetary"),
        (F.col("spend") / scaled_orders).alias("avg_order_value"),
        (F.col("items") / scaled_orders).alias("avg_basket_items"),
        tenure.alias("tenure_days"),
        "first_seen", "last_seen",
        F.when(F.col("frequency") > 1, tenure / (F.col("frequency") - 1))
         .alias("interpurchase_days"),
    )


def customer_features(lines: DataFrame, snapshot: datetime | None = None,
                      cells: DataFrame | None = None) -> DataFrame:
    """One row per customer, read off the lattice of the lines (``cells`` where there is one
    already). The three branches end hash-partitioned by customer, so joining them needs no
    further shuffle."""
    assert REASON not in lines.columns, "pass kept(canonical), not the flagged frame"
    cells = lattice(lines) if cells is None else cells
    return (activity_of_orders(_orders(cells_of(cells, ORDER)), snapshot)
            .join(product_diversity(cells), "customer_id", "left")
            .join(dominant_country(cells), "customer_id", "left")
            .withColumn("distinct_products",
                        F.coalesce("distinct_products", F.lit(0).cast("long"))))
