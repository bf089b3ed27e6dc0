"""Any order-line table -> the canonical frame, with a reason for every dropped row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..errors import UnusableInput
from ..functions.dates import DateStyle, detect_style, parse_date
from ..functions.money import fits
from ..functions.numbers import number_column
from ..functions.text import strip

REASON = "drop_reason"
DEFAULT_MAPPING = {c: c for c in S.CANONICAL + S.CONTACT}


def map_columns(raw: DataFrame, mapping: dict[str, str] | None = None) -> DataFrame:
    """Rename source columns to canonical ones; unmapped and absent ones disappear."""
    wanted = {**DEFAULT_MAPPING, **(mapping or {})}
    present = set(raw.columns)
    return raw.select(*[F.col(f"`{source}`").alias(name)
                        for name, source in wanted.items() if source in present])


def compute_once(df: DataFrame, costly: list[Column], carried: list[Column]) -> DataFrame:
    """``costly`` and ``carried`` columns, the costly ones evaluated once per row.

    Filters on plain projections are pushed below them with their expressions copied; for
    text parsing that doubles the work. A generator row is not looked through. Carried
    columns stay prunable.
    """
    return df.select(*carried, F.inline(F.array(F.struct(*costly))))


def require_columns(columns: list[str]) -> None:
    for name in ("customer_id", "order_date"):
        if name not in columns:
            raise UnusableInput(f"no column is mapped to {name}")
    if "unit_price" not in columns and "line_value" not in columns:
        raise UnusableInput("no column is mapped to a price or a total")


def missing_customer(customer: Column) -> Column:
    return customer.isNull() | F.lower(customer).isin("", "nan", "none")


def synthetic_order_id(customer: Column, day: Column) -> Column:
    """One order per customer and day, for sources without order ids."""
    return F.concat_ws("@", customer, F.date_format(day, "yyyy-MM-dd"))


def derived_price(total: Column, quantity: Column) -> Column:
    return F.try_divide(total, F.nullif(quantity, F.lit(0.0)))


def plain_text(cell: Column) -> Column:
    """Passthrough text: missing and 'nan' become empty."""
    text = F.coalesce(cell.cast("string"), F.lit(""))
    return F.when(text == "nan", "").otherwise(text)


def first_reason(*rules: tuple[Column, str]) -> Column:
    """The first rule that holds names the reason; null when the row is kept."""
    chosen = F.when(F.lit(False), F.lit(None).cast("string"))
    for failed, reason in rules:
        chosen = chosen.when(failed, reason)
    return chosen


def canonicalize(raw: DataFrame, mapping: dict[str, str] | None = None, decimal: str = ".",
                 date_style: DateStyle | None = None, drop_cancellations: bool = True,
                 drop_nonpositive: bool = True) -> DataFrame:
    """Canonical columns, mapped passthrough columns and ``drop_reason`` for every row.

    Nothing is filtered here: :func:`kept` gives the usable rows and :func:`ingest_report`
    the counts. The only job this starts is the date profile of a text or numeric date
    column; pass ``date_style`` to skip it.
    """
    df = map_columns(raw, mapping)
    require_columns(df.columns)
    style = date_style or detect_style(df, "order_date")
    has = set(df.columns)
    types = {f.name: f.dataType for f in df.schema}

    def number(name: str) -> Column:
        return number_column(F.col(name), types[name], decimal)

    customer = strip(F.col("customer_id").cast("string"))
    parsed_columns = [
        customer.alias("customer_id"),
        parse_date(F.col("order_date"), style).alias("order_date"),
        (F.col("order_id").cast("string") if "order_id" in has
         else F.lit(None).cast("string")).alias("given_order"),
        F.coalesce(number("quantity") if "quantity" in has else F.lit(None).cast("double"),
                   F.lit(1.0)).alias("quantity"),
        (number("unit_price") if "unit_price" in has
         else F.lit(None).cast("double")).alias("given_price"),
        (number("line_value") if "line_value" in has
         else F.lit(None).cast("double")).alias("given_total"),
    ]
    carried = [
        *[(F.coalesce(F.col(c).cast("string"), F.lit("")) if c in has
           else F.lit("")).alias(c) for c in ("product", "country")],
        *[plain_text(F.col(c)).alias(c) for c in S.PASSTHROUGH if c in has],
    ]
    parsed = (compute_once(df, parsed_columns, carried) if style.kind != "timestamp"
              else df.select(*parsed_columns, *carried))
    price = (F.col("given_price") if "unit_price" in has
             else derived_price(F.col("given_total"), F.col("quantity")))
    priced = parsed.withColumn("unit_price", price)
    never = F.lit(False)
    cancelled = (F.coalesce(F.col("given_order").rlike(r"^[Cc]\d+\z"), never)
                 | ~(F.col("quantity") > 0)) if drop_cancellations else never
    nonpositive = ~(F.col("unit_price") > 0) if drop_nonpositive else never
    reason = first_reason(
        (F.col("order_date").isNull(), S.REASON_DATE),
        (missing_customer(F.col("customer_id")), S.REASON_CUSTOMER),
        (F.col("unit_price").isNull() | ~fits(F.col("unit_price"))
         | ~fits(F.coalesce("given_total", F.col("quantity") * F.col("unit_price"))),
         S.REASON_PRICE),
        (cancelled, S.REASON_CANCELLED),
        (nonpositive, S.REASON_NONPOSITIVE),
    )
    return priced.select(
        "customer_id",
        F.coalesce("given_order",
                   synthetic_order_id(F.col("customer_id"), F.col("order_date")))
         .alias("order_id"),
        "order_date", "quantity", "unit_price",
        F.coalesce("given_total", F.col("quantity") * F.col("unit_price")).alias("line_value"),
        "product", "country",
        *[c for c in S.PASSTHROUGH if c in has],
        reason.alias(REASON),
    )


def is_product_line(product: Column) -> Column:
    """Billing, shipping and coupon lines are no products; gifts are."""
    return ~F.upper(product).rlike("^(BILLING|SHIPPING|COUPON)")


# Order states that never became revenue.
UNREALISED_STATUS = ["Stornována", "Vrácená objednávka", "Platba selhala"]


def canonicalize_shop(lines: DataFrame) -> DataFrame:
    """Rules of the partner-shop export on an already typed frame.

    Expects customer_id, order_id, order_date, quantity, unit_price, line_value, product,
    country, status. Coupon lines stay with their negative value; only structural lines
    and orders that were never realised go. Zero prices, negative lines and unknown states
    stay.
    """
    reason = first_reason(
        (missing_shop_customer(F.col("customer_id")) | F.col("order_date").isNull()
         | F.col("line_value").isNull() | ~fits(F.col("line_value")), S.REASON_SHOP_MISSING),
        (F.coalesce(F.upper("product").rlike("^(BILLING|SHIPPING)"), F.lit(False)),
         S.REASON_SHOP_STRUCTURAL),
        (F.coalesce(F.col("status").isin(UNREALISED_STATUS), F.lit(False)),
         S.REASON_SHOP_STATUS),
    )
    return (lines
            .withColumn(REASON, reason)
            .withColumn("is_product", is_product_line(F.coalesce("product", F.lit(""))))
            .withColumn("quantity", F.coalesce("quantity", F.lit(0.0)))
            .withColumn("unit_price", F.coalesce("unit_price", F.lit(0.0))))


def missing_shop_customer(customer: Column) -> Column:
    return customer.isNull() | (customer == "") | (F.lower(customer) == "nan")


def kept(canonical: DataFrame) -> DataFrame:
    """The usable rows of a canonicalised frame."""
    return canonical.where(F.col(REASON).isNull()).drop(REASON)


def ingest_report(canonical: DataFrame) -> DataFrame:
    """(reason, rows): one row per drop reason and one for the kept rows."""
    return (canonical.groupBy(F.coalesce(REASON, F.lit("kept")).alias("reason"))
            .agg(F.count(F.lit(1)).alias("rows")))
