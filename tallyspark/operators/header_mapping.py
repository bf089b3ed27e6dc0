"""What the columns of unknown tables mean: names, number format, currency, language."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Canonical column -> parts of a header that mean it. The order counts:
# earlier columns take their header first.
ALIASES = {
    "customer_name": ["jmeno", "jméno", "prijmeni", "příjmení", "customer name",
                      "contact name", "full name", "vorname", "nachname"],
    "customer_id": ["customer", "zakazn", "zákazn", "klient", "kunde", "cliente",
                    "client", "email", "e-mail", "mail", "user", "uzivatel",
                    "uživatel", "odberatel", "odběratel", "kupujic", "kupujíc",
                    "buyer", "firma", "company", "telefon", "phone", "key"],
    "customer_email": ["email", "e-mail", "mail", "kontakt"],
    "order_id": ["order", "objedn", "obj.", "invoice", "faktur", "transaction",
                 "transak", "bestell", "pedido", "doklad", "code"],
    "order_date": ["date", "datum", "datetime", "created", "creation", "time",
                   "cas", "čas", "den", "zeit", "fecha"],
    "quantity": ["quantity", "qty", "mnozstv", "množstv", "amount", "pocet", "počet",
                 "menge", "cantidad", "ks", "pieces", "kusy"],
    "line_value": ["line_value", "celkem", "total", "summe", "gesamt", "castka",
                   "částka", "suma", "trzb", "tržb", "revenue", "hodnota", "subtotal"],
    "unit_price": ["unit_price", "unitprice", "price", "cena", "preis", "precio",
                   "prix", "jednotk", "cena_ks"],
    "product": ["product", "produkt", "item", "sku", "zbozi", "zboží", "nazev",
                "název", "name", "artikel", "articulo"],
    "country": ["country", "zeme", "země", "land", "stat", "stát", "pais", "país"],
}
# Currency symbol -> how it is written; the first found wins.
CURRENCIES = {"Kč": ["kc", "kč", "czk"], "€": ["eur", "€"], "$": ["usd", "$"],
              "£": ["gbp", "£"], "zł": ["pln", "zł", "zl"]}
# Number shapes. Grouped thousands are the strongest sign of a locale.
EU_GROUPED = r"\d{1,3}(?:\.\d{3})+(?:,\d+)?(?![\d.])"
US_GROUPED = r"\d{1,3}(?:,\d{3})+(?:\.\d+)?(?![\d,])"
COMMA_DECIMAL = r"\d+,\d{1,2}(?!\d)"
DOT_DECIMAL = r"\d+\.\d{1,2}(?!\d)"
# Fixed value: letters that mark Czech text.
CZECH = "[ěščřžýáíéúůňťď]"


def _holds(pattern: str):
    return lambda header: F.lower(header).rlike(pattern)


def map_headers(headers: DataFrame) -> DataFrame:
    """(table, canonical, header) from rows (table, position, header).

    Each canonical column, in order, takes the first header of the table that holds one of
    its aliases and is still free. A group is one table's header; the choice is a chain of
    array expressions.
    """
    listed = headers.groupBy("table").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("position", "header"))),
                    lambda x: x["header"]).alias("free"))
    for canonical, aliases in ALIASES.items():
        fits = F.filter("free", _holds("|".join(re.escape(a) for a in aliases)))
        listed = listed.withColumn(canonical, F.get(fits, F.lit(0)))
        listed = listed.withColumn(
            "free", F.when(F.col(canonical).isNull(), F.col("free"))
                     .otherwise(F.array_remove("free", F.col(canonical))))
    pairs = F.array(*[F.struct(F.lit(c).alias("canonical"), F.col(c).alias("header"))
                      for c in ALIASES])
    return (listed.select("table", F.explode(pairs).alias("p"))
            .select("table", "p.canonical", "p.header")
            .where(F.col("header").isNotNull()))


def missing_required(mapped: DataFrame) -> DataFrame:
    """(table, missing): required columns no header stands for, as sorted text."""
    have = F.collect_set("canonical")
    money = F.lit("unit_price (or a total column)")
    absent = F.array_compact(F.array(
        F.when(~F.array_contains(have, "customer_id"), "customer_id"),
        F.when(~F.array_contains(have, "order_date"), "order_date"),
        F.when(~F.array_contains(have, "unit_price") & ~F.array_contains(have, "line_value"),
               money)))
    return mapped.groupBy("table").agg(F.concat_ws(", ", absent).alias("missing"))


def cell_evidence(cell: Column) -> dict[str, Column]:
    """Aggregates over text cells; every one is a sum or an or, combined before shuffling."""
    text = F.lower(cell)

    def found(words):
        return F.coalesce(F.bool_or(F.greatest(*[text.contains(w) for w in words], F.lit(False))),
                          F.lit(False))

    counts = {name: F.coalesce(F.sum(F.regexp_count(text, F.lit(pattern))), F.lit(0))
              for name, pattern in (("eu_grouped", EU_GROUPED), ("us_grouped", US_GROUPED),
                                    ("comma_decimal", COMMA_DECIMAL),
                                    ("dot_decimal", DOT_DECIMAL))}
    return {**counts,
            **{f"currency_{i}": found(words) for i, words in enumerate(CURRENCIES.values())},
            "czech": F.coalesce(F.bool_or(text.rlike(CZECH)), F.lit(False))}


def decide(delimiter: Column) -> list[Column]:
    """decimal, currency and language from the evidence columns."""
    col = F.col
    decimal = (F.when(col("eu_grouped") > col("us_grouped"), ",")
                .when(col("us_grouped") > col("eu_grouped"), ".")
                .when(col("comma_decimal") > col("dot_decimal"), ",")
                .when(col("dot_decimal") > col("comma_decimal"), ".")
                .when(delimiter == ";", ",").otherwise("."))
    currency = F.when(F.lit(False), "")
    for i, symbol in enumerate(CURRENCIES):
        currency = currency.when(col(f"currency_{i}"), symbol)
    return [decimal.alias("decimal"), currency.otherwise("").alias("currency"),
            F.when(col("czech"), "cs").otherwise("en").alias("language")]


def column_evidence(cells: DataFrame, key: str = "table",
                    delimiter: Column | None = None) -> DataFrame:
    """One row per table from rows (table, cell): number format, currency and language,
    judged on all cells (pass header names as cells too)."""
    evidence = cells.groupBy(key).agg(
        *[agg.alias(name) for name, agg in cell_evidence(F.col("cell")).items()])
    return evidence.select(key, "eu_grouped", "us_grouped", "comma_decimal", "dot_decimal",
                           *decide(delimiter if delimiter is not None else F.lit("")))


def table_cells(df: DataFrame, name: str) -> DataFrame:
    """(table, cell): every cell of a text table, and its header names once."""
    cells = df.select(F.lit(name).alias("table"),
                      F.explode(F.array(*[F.col(f"`{c}`") for c in df.columns])).alias("cell"))
    header = df.sparkSession.range(1).select(
        F.lit(name).alias("table"),
        F.explode(F.array(*[F.lit(c) for c in df.columns])).alias("cell"))
    return cells.unionByName(header)
