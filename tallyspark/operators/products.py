"""Product categories, catalog lookups and the segment by category mix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import amount, half_even, sum_units
from ..functions.text import category_from_word, category_label, telling_word
from ..schema import CATALOG_COLUMNS
from ..session import stage
from .canonical import compute_once
from .hot_join import hot_join

#: Products of a catalog that is sent to every task, at a few hundred bytes each.
SENT = 100_000


def with_category(lines: DataFrame, carried: list[str]) -> DataFrame:
    """The ``carried`` columns and the best ``category`` the frame offers: a ready one, the
    catalog's, or one made from the product text (the word is searched once per line)."""
    columns = lines.columns
    for ready in ("category", "cat_2_name", "cat_1_name"):
        if ready in columns:
            return lines.select(*carried, category_label(F.col(ready)).alias("category"))
    for text in ("product_name", "product_desc", "description", "product"):
        if text in columns:
            name = F.col(text).cast("string")
            found = compute_once(lines, [telling_word(name).alias("word")],
                                 [*map(F.col, carried), name.alias("name")])
            return found.select(*carried, category_from_word(F.col("name"), F.col("word"))
                                .alias("category"))
    return lines.select(*carried, F.lit("Other").alias("category"))


def product_mix(lines: DataFrame, segments: DataFrame, top_n: int = 12) -> DataFrame:
    """(segment, category, revenue, customers) for the ``top_n`` categories by revenue.

    Lines are first added up per customer and category, so the join with the segments sees
    at most one row per customer and category however often one customer buys, and the
    customers of a cell are then plain rows. Only the ``top_n`` category names are
    broadcast.
    """
    bought = (with_category(lines, ["customer_id", "line_value"])
              .groupBy("customer_id", "category")
              .agg(sum_units(F.col("line_value")).alias("units")))
    cells = (bought.join(segments.select("customer_id", "segment")
                         .where(F.col("segment").isNotNull()), "customer_id")
             .groupBy("segment", "category")
             .agg(F.sum("units").alias("units"), F.count(F.lit(1)).alias("customers")))
    top = (cells.groupBy("category").agg(F.sum("units").alias("all_units"))
           .orderBy(F.desc("all_units"), "category").limit(top_n).select("category"))
    return (cells.join(F.broadcast(top), "category", "left_semi")
            .select("segment", "category",
                    half_even(amount(F.col("units")), 2).alias("revenue"), "customers"))


def one_row_per_product(catalog: DataFrame) -> DataFrame:
    """A repeated product id would multiply order lines: keep its lowest-named row and
    count the repeats."""
    have = [c for c in CATALOG_COLUMNS if c in catalog.columns]
    chosen = F.min(F.struct(*have))
    return (catalog.groupBy("product_id")
            .agg(chosen.alias("entry"), F.count(F.lit(1)).alias("entries"))
            .select("product_id", *[F.col(f"entry.{c}").alias(c) for c in have], "entries"))


def enrich(lines: DataFrame, catalog: DataFrame | None, key: str = "product") -> DataFrame:
    """Left join of the catalog columns on the product id; no catalog, no change.

    A catalog of at most ``SENT`` products is sent to every task, so the lines stay where they
    are. With a larger one both sides are shuffled, and a product that holds a large share of
    the lines is salted, whatever the session's settings.
    """
    if catalog is None or key not in lines.columns:
        return lines
    have = [c for c in CATALOG_COLUMNS if c in catalog.columns]
    if not have:
        return lines
    single = stage(one_row_per_product(catalog).select(
        F.col("product_id").alias(key), *have), "catalog")
    if single.limit(SENT + 1).count() <= SENT:
        return lines.join(F.broadcast(single), key, "left")
    return hot_join(lines, single, [key], "left")


def missing_products(lines: DataFrame, catalog: DataFrame | None,
                     key: str = "product") -> DataFrame:
    """Numeric product ids of the lines that the catalog lacks."""
    ids = (lines.where(F.col(key).rlike(r"^\d+\z"))
           .select(F.col(key).alias("product_id")).distinct())
    if catalog is None:
        return ids
    return ids.join(catalog.select("product_id"), "product_id", "left_anti")


# The placeholder category of a product nobody described.
PLACEHOLDER = {"cat_1_ID": "C99", "cat_1_name": "Ostatni",
               "cat_2_ID": "C9901", "cat_2_name": "Nezarazeno"}


def placeholder_rows(product_ids: DataFrame) -> DataFrame:
    """Catalog rows for products without an entry."""
    return product_ids.select(
        "product_id",
        F.concat(F.lit("Produkt "), F.col("product_id")).alias("product_name"),
        *[F.lit(value).alias(name) for name, value in PLACEHOLDER.items()])


def complete_catalog(lines: DataFrame, catalog: DataFrame, key: str = "product") -> DataFrame:
    """The catalog followed by placeholder rows for what the lines hold besides it."""
    return catalog.unionByName(placeholder_rows(missing_products(lines, catalog, key)))

