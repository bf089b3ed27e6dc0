"""The query catalogue: every operator as a query over the given tables."""

from __future__ import annotations

from datetime import timedelta
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import UnusableInput
from ..functions.dates import date_profile, detect_style, parse_date
from ..functions.money import amount, half_even
from ..functions.numbers import locale_number
from ..functions.text import (
    category_from_text, category_label, content_language, currency_symbol)
from ..operators import (
    audience, calendar, campaigns, clusters, factors, history, nearest, products, quality)
from ..operators import features as feat
from ..operators import lookalikes as similar
from ..operators import segments as seg
from ..operators.canonical import (
    REASON, canonicalize, derived_price, ingest_report, kept, synthetic_order_id)
from ..operators.header_mapping import column_evidence, map_headers, missing_required
from ..session import stage, stage_path
from . import analysis
from ..sources import sinks
from ..sources.catalog_table import read_catalog
from ..sources.dialects import dialect_profile
from ..sources.dispatch import load, load_exports
from ..sources.factor_table import read_factors
from ..sources.partner_shop import read_partner_shop
from ..sources.retail import read_retail
from ..streaming.ledger import Ledger
from .views import lines_events, lines_tpch, order_lines, spread, table

QUERIES = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


def features_tpch(spark: SparkSession, sf: str) -> DataFrame:
    return stage(feat.customer_features(lines_tpch(spark, sf)), "features")


def features_events(spark: SparkSession, sf: str) -> DataFrame:
    return stage(feat.customer_features(lines_events(spark, sf)), "features")


def activity_tpch(spark: SparkSession, sf: str) -> DataFrame:
    """Only what scoring needs: no diversity and no country branch."""
    return feat.customer_activity(order_lines(spark, sf))


def activity_events(spark: SparkSession, sf: str) -> DataFrame:
    return feat.customer_activity(lines_events(spark, sf))


def scored_tpch(spark: SparkSession, sf: str) -> DataFrame:
    return seg.score_customers(activity_tpch(spark, sf))


def day(column: str):
    return F.date_format(column, "yyyy-MM-dd")


def moment(column: str):
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss.SSSSSS")


# --- segments ---------------------------------------------------------------------------

@query
def segment_profile(spark, sf):
    return seg.segment_profile(scored_tpch(spark, sf))


@query
def segment_profile_events(spark, sf):
    return seg.segment_profile(seg.score_customers(activity_events(spark, sf)))


@query
def rfm_scores(spark, sf):
    return scored_tpch(spark, sf).select("customer_id", "R", "F", "M", "segment", "rfm_cell")


@query
def rfm_scores_events(spark, sf):
    return (seg.score_customers(activity_events(spark, sf))
            .select("customer_id", "R", "F", "M", "segment", "rfm_cell"))


@query
def rfm_cells(spark, sf):
    return (scored_tpch(spark, sf).groupBy("rfm_cell", "segment")
            .agg(F.count(F.lit(1)).alias("customers")))


# --- features ---------------------------------------------------------------------------

@query
def order_rollup(spark, sf):
    return feat.order_rollup(order_lines(spark, sf)).select(
        "order_id", "customer_id", day("order_date").alias("order_day"),
        amount(F.col("value_units")).alias("order_value"),
        amount(F.col("item_units")).alias("order_items"))


def _feature_rows(features):
    return features.select(
        "customer_id", "recency", "frequency", "monetary",
        "avg_order_value", "avg_basket_items", "tenure_days", moment("first_seen").alias("first_seen"),
        moment("last_seen").alias("last_seen"), "distinct_products", "country",
        "interpurchase_days")


@query
def customer_features(spark, sf):
    return _feature_rows(feat.customer_features(lines_tpch(spark, sf)))


@query
def customer_features_events(spark, sf):
    return _feature_rows(feat.customer_features(lines_events(spark, sf)))


# --- canonical frame --------------------------------------------------------------------

def _cents_text(value, mark: str = ","):
    cents = F.rint(value * 100).cast("long")
    return F.concat((cents / 100).cast("long").cast("string"), F.lit(mark),
                    F.lpad((cents % 100).cast("string"), 2, "0"))


def _grouped_text(value, group: str, mark: str):
    cents = F.rint(value * 100).cast("long")
    whole = F.translate(F.format_number((cents / 100).cast("long"), 0), ",", group)
    return F.concat(whole, F.lit(mark), F.lpad((cents % 100).cast("string"), 2, "0"))


def messy_lines(spark, sf):
    """All line items as text cells in a foreign layout, some of them broken."""
    lines = lines_tpch(spark, sf, returns=True)
    m = (F.col("order_id").cast("long") * 7 + F.col("line_number")) % 40
    euro = F.concat(_cents_text(F.col("unit_price")), F.lit(" Kč"))
    return lines.select(
        F.when(m == 1, " ").when(m == 8, "NaN").when(m != 6, F.concat(
            F.lit(" "), "customer_id", F.lit(" "))).alias("kunde"),
        F.when(m == 3, F.concat(F.lit("C"), "order_id")).otherwise(F.col("order_id"))
         .alias("beleg"),
        F.when(m == 0, "not a date").otherwise(F.date_format("order_date", "dd.MM.yyyy"))
         .alias("datum"),
        F.when(m == 4, "0").when(m == 7, "")
         .otherwise(F.col("quantity").cast("long").cast("string")).alias("menge"),
        F.when(m == 2, "n/a").when(m == 5, "-5,00").otherwise(euro).alias("preis"),
        F.col("product").alias("artikel"), F.col("country").alias("land"))


MESSY_MAPPING = {"customer_id": "kunde", "order_id": "beleg", "order_date": "datum",
                 "quantity": "menge", "unit_price": "preis", "product": "artikel",
                 "country": "land"}


def _canonical_rows(df):
    return df.select("customer_id", "order_id", day("order_date").alias("order_day"),
                     "quantity", "unit_price", "line_value", "product", "country")


@query
def clean_lines(spark, sf):
    return _canonical_rows(kept(canonicalize(messy_lines(spark, sf), MESSY_MAPPING, ",")))


@query
def ingest_reasons(spark, sf):
    return ingest_report(canonicalize(messy_lines(spark, sf), MESSY_MAPPING, ","))


@query
def retail_scan(spark, sf):
    path = stage_path(spark, "retail")
    (lines_tpch(spark, sf, returns=True).select(
        F.col("customer_id").alias("CustomerID"),
        F.when(F.col("return_flag") == "R", F.concat(F.lit("C"), "order_id"))
         .otherwise(F.col("order_id")).alias("InvoiceNo"),
        F.col("order_date").alias("InvoiceDate"), F.col("quantity").alias("Quantity"),
        F.col("unit_price").alias("UnitPrice"), F.col("product").alias("Description"),
        F.col("country").alias("Country")).write.parquet(path))
    return _canonical_rows(kept(read_retail(spark, path)))


def shop_export(spark, sf):
    """Line items as the partner shop's export: text cells, Czech money and states."""
    lines = lines_tpch(spark, sf, returns=True)
    kind = F.col("part_key") % 10
    name = F.col("part_key").cast("string")
    product = (F.when(kind == 0, F.concat(F.lit("SHIPPING-"), name))
                .when(kind == 1, F.concat(F.lit("billing-"), name))
                .when(kind == 2, F.concat(F.lit("COUPON-"), name))
                .when(kind == 3, F.concat(F.lit("GIFT-"), name)).otherwise(name))
    value = F.concat(F.when(kind == 2, "-").otherwise(""),
                     _grouped_text(F.col("line_value"), " ", ","))
    status = (F.when(F.col("order_status") == "P", "Stornována")
               .when((F.col("order_status") == "O") & (kind == 9), "Platba selhala")
               .otherwise("Vyřízena"))
    broken = (F.col("order_id").cast("long") * 7 + F.col("line_number")) % 50
    return lines.select(
        F.when(broken == 0, "").otherwise(F.col("customer_id")).alias("customer_key"),
        "order_id",
        F.date_format("order_date", "yyyy-MM-dd HH:mm:ss").alias("order_datetime"),
        F.when(broken == 1, "").otherwise(F.col("quantity").cast("long").cast("string"))
         .alias("product_quantity"),
        _cents_text(F.col("unit_price")).alias("unit_price"),
        F.when(broken == 2, "?").otherwise(value).alias("revenue_per_line"),
        _cents_text(F.col("unit_price") * 0.5).alias("cost_per_line"),
        product.alias("product_id"), "country", status.alias("order_status"),
        F.lit("110").alias("zip_prefix"))


def _shop_frame(spark, sf):
    path = stage_path(spark, "shop-export")
    shop_export(spark, sf).write.csv(path, header=True, escape='"')
    return read_partner_shop(spark, path)


@query
def shop_lines(spark, sf):
    return kept(_shop_frame(spark, sf)).select(
        "customer_id", "order_id", day("order_date").alias("order_day"), "quantity",
        "unit_price", "line_value", "line_cost", "product", "country", "status",
        "is_product")


@query
def shop_report(spark, sf):
    return ingest_report(_shop_frame(spark, sf))


@query
def parse_numbers_eu(spark, sf):
    text = F.concat(F.lit("€ "), _grouped_text(F.col("line_value"), ".", ","))
    return order_lines(spark, sf, returns=True).select(
        "order_id", "line_number", locale_number(text, ",").alias("value"))


@query
def parse_numbers_us(spark, sf):
    text = F.concat(F.lit("$"), _grouped_text(F.col("line_value"), ",", "."))
    return order_lines(spark, sf, returns=True).select(
        "order_id", "line_number", locale_number(text, ".").alias("value"))


def date_renderings(spark, sf):
    """Order dates written in nine ways; the epoch counts are ten years later."""
    stamp = F.col("o_orderdate").cast("timestamp_ntz") + F.make_dt_interval(
        F.lit(0), (F.col("o_orderkey") % 24).cast("int"),
        (F.col("o_orderkey") % 60).cast("int"), F.lit(0))
    days = F.datediff("o_orderdate", F.lit("1899-12-30").cast("date")).cast("string")
    seconds = ((F.datediff("o_orderdate", F.lit("1970-01-01").cast("date")) + 3652)
               .cast("long") * 86400)
    return table(spark, sf, "orders").select(
        F.col("o_orderkey").cast("string").alias("order_id"),
        F.date_format(stamp, "yyyy-MM-dd HH:mm").alias("iso"),
        F.date_format(stamp, "d.M.yyyy HH:mm").alias("dotted"),
        F.date_format(stamp, "dd/MM/yyyy").alias("slashed"),
        F.date_format(stamp, "MM/dd/yyyy hh:mm a").alias("american"),
        F.date_format(stamp, "yyyyMMdd").alias("compact"),
        F.date_format(stamp, "MMMM d, yyyy").alias("named"),
        days.alias("excel"),
        seconds.cast("string").alias("seconds"),
        F.concat(seconds.cast("string"), F.lit("000")).alias("millis"))


RENDERINGS = ["iso", "dotted", "slashed", "american", "compact", "named", "excel",
              "seconds", "millis"]


@query
def date_kinds(spark, sf):
    texts = stage(date_renderings(spark, sf), "dates")
    parts = [date_profile(texts, c).select(F.lit(c).alias("rendering"), "kind", "day_first",
                                           "numeric_share") for c in RENDERINGS]
    return reduce(DataFrame.unionByName, parts)


@query
def parse_dates(spark, sf):
    texts = stage(date_renderings(spark, sf), "dates")
    return texts.select("order_id", *[
        F.date_format(parse_date(F.col(c), detect_style(texts, c)), "yyyy-MM-dd HH:mm:ss")
         .alias(c) for c in RENDERINGS])


@query
def order_id_synthesis(spark, sf):
    return (order_lines(spark, sf)
            .select(synthetic_order_id(F.col("customer_id"), F.col("order_date"))
                    .alias("order_id"), "line_value")
            .groupBy("order_id").agg(F.count(F.lit(1)).alias("rows")))


@query
def derive_prices(spark, sf):
    """Price from the total; every seventh line has no quantity to divide by."""
    lines = order_lines(spark, sf, returns=True)
    quantity = F.when(F.col("line_number") == 7, 0.0).otherwise(F.col("quantity"))
    return lines.select("order_id", "line_number",
                        derived_price(F.col("line_value"), quantity).alias("unit_price"))


# --- text exports, nested orders ----------------------------------------------------------

@query
def export_folder(spark, sf):
    """Line items written as text exports in three dialects, read back as one frame."""
    path = stage_path(spark, "exports")
    lines = lines_tpch(spark, sf, returns=True)
    eu = _cents_text(F.col("unit_price"))
    us = _cents_text(F.col("unit_price"), ".")
    number = F.col("quantity").cast("long").cast("string")
    czech = lines.where(F.col("order_status") == "F").select(
        F.col("customer_id").alias("Zákazník"), F.col("order_id").alias("Objednávka"),
        F.date_format("order_date", "dd.MM.yyyy").alias("Datum"),
        number.alias("Kusy"), F.concat(eu, F.lit(" Kc")).alias("Cena"),
        F.col("product").alias("Název"))
    english = lines.where(F.col("order_status") == "O").select(
        F.col("customer_id").alias("customer"), F.col("order_id").alias("order no"),
        F.date_format("order_date", "yyyy-MM-dd").alias("date"),
        number.alias("qty"), F.concat(F.lit('$"quoted" '), us).alias("price"),
        F.concat("product", F.lit("\nsecond line")).alias("item"))
    tabbed = lines.where(F.col("order_status") == "P").select(
        F.col("customer_id").alias("klient"), F.col("order_id").alias("doklad"),
        F.date_format("order_date", "MM/dd/yyyy").alias("datum"),
        F.col("quantity").cast("string").alias("ks"), us.alias("cena"),
        F.col("product").alias("produkt"))
    common = {"header": True, "escape": '"'}
    czech.write.csv(f"{path}/cz", sep=";", encoding="ISO-8859-1", **common)
    english.write.csv(f"{path}/en", sep=",", **common)
    tabbed.write.csv(f"{path}/tab", sep="\t", **common)
    return _canonical_rows(kept(load_exports(spark, path)))


@query
def export_quoted(spark, sf):
    """Line items whose products hold line breaks, separators and quotes, written as quoted text
    and read back in splits."""
    path = stage_path(spark, "quoted")
    lines = lines_tpch(spark, sf, returns=True)
    lines.select(
        F.col("customer_id").alias("customer"), F.col("order_id").alias("order no"),
        F.date_format("order_date", "yyyy-MM-dd").alias("date"),
        F.concat(F.lit('27" of '), "product", F.lit(',\n"second"\n\n, line')).alias("item"),
        F.col("quantity").cast("long").cast("string").alias("qty"),
        _cents_text(F.col("unit_price"), ".").alias("price")).write.csv(
            path, header=True, escape='"', quoteAll=True)
    return _canonical_rows(kept(load_exports(spark, path)))


@query
def export_repeated_header(spark, sf):
    """The ingest report of exports in which every thousandth order repeats the header: only a
    file's first header is left out, the others are rows with a reason."""
    path = stage_path(spark, "repeated")
    lines = lines_tpch(spark, sf, returns=True)
    names = ["customer", "order no", "date", "qty", "price"]
    rows = lines.select(
        F.col("customer_id").alias(names[0]), F.col("order_id").alias(names[1]),
        F.date_format("order_date", "yyyy-MM-dd").alias(names[2]),
        F.col("quantity").cast("long").cast("string").alias(names[3]),
        _cents_text(F.col("unit_price"), ".").alias(names[4]))
    again = table(spark, sf, "orders").where("o_orderkey % 1000 < 4").select(
        *[F.lit(n).alias(n) for n in names])
    rows.unionByName(again).write.csv(path, header=True)
    return ingest_report(load_exports(spark, path))


@query
def export_ragged(spark, sf):
    """Text rows that are shorter or longer than their header, and blank ones."""
    path = stage_path(spark, "ragged")
    lines = lines_tpch(spark, sf, returns=True)
    row = F.concat_ws("|", "customer_id", "order_id", F.date_format("order_date", "yyyy-MM-dd"),
                      F.col("quantity").cast("long").cast("string"),
                      _cents_text(F.col("unit_price"), "."))
    # Whole rows stand at the head of each file; further down cells are missing or too many.
    kind = F.col("line_number") % 3
    text = F.concat(row, F.when(kind == 1, "|whole||").when(kind == 2, "|long||x|y").otherwise(""))
    blank = F.when(F.col("line_number") == 5, "| | |")
    name = "client|invoice|created|qty|price|item|note|more"
    (lines.select(F.explode(F.array_compact(F.array(text, blank))).alias(name), kind.alias("kind"))
     .repartition(4).sortWithinPartitions(F.col("kind") != 1).select(F.col(f"`{name}`"))
     .write.option("quote", "").csv(path, header=True, sep="\x01"))
    return _canonical_rows(kept(load_exports(spark, path)))


@query
def export_dialects(spark, sf):
    """What the dialect profile says about events written in three ways."""
    path = stage_path(spark, "dialects")
    events = table(spark, sf, "events").select(
        F.col("user_id").alias("zákazník"),
        F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd HH:mm:ss").alias("datum"),
        F.col("value").alias("celkem"), "event_type")
    for name, options in (("semicolon", {"sep": ";", "encoding": "ISO-8859-1"}),
                          ("comma", {"sep": ","}), ("bar", {"sep": "|"})):
        events.coalesce(1).write.csv(f"{path}/{name}", header=True, **options)
    return dialect_profile(spark, path).select(
        F.regexp_extract("file", "/([a-z]+)/[^/]*$", 1).alias("folder"), "encoding",
        "delimiter", "multiline", "skipped_rows",
        F.concat_ws("|", "columns").alias("header"))


@query
def nested_orders(spark, sf):
    path = stage_path(spark, "order-pages")
    item = F.struct(F.col("quantity").cast("long").cast("string").alias("amount"),
                    F.col("product").alias("name"),
                    F.struct(_cents_text(F.col("unit_price"), ".").alias("withVat"))
                    .alias("itemPrice"))
    orders = (lines_tpch(spark, sf, returns=True)
              .groupBy("order_id", "customer_id", "order_date", "country")
              .agg(F.collect_list(item).alias("items")))
    (orders.select(F.struct(F.array(F.struct(
        F.concat("customer_id", F.lit("@shop.example")).alias("email"),
        F.col("order_id").alias("code"),
        F.date_format("order_date", "yyyy-MM-dd'T'HH:mm:ss").alias("creationTime"),
        F.struct("country").alias("billingAddress"), "items")).alias("orders")).alias("data"))
     .write.json(path))
    return _canonical_rows(kept(load(spark, "json", path=path)))


# --- column meaning -----------------------------------------------------------------------

@query
def number_evidence(spark, sf):
    """Number format, currency and language of four renderings of the line values."""
    lines = order_lines(spark, sf, returns=True)
    value = F.col("line_value")
    cells = F.array(
        F.struct(F.lit("eu").alias("table"),
                 F.concat(_grouped_text(value, ".", ","), F.lit(" Kč")).alias("cell")),
        F.struct(F.lit("us").alias("table"),
                 F.concat(F.lit("$"), _grouped_text(value, ",", ".")).alias("cell")),
        F.struct(F.lit("plain").alias("table"), _cents_text(value, ".").alias("cell")),
        F.struct(F.lit("comma").alias("table"),
                 F.concat(_cents_text(value), F.lit(" EUR")).alias("cell")))
    return column_evidence(lines.select(F.explode(cells).alias("c")).select("c.*"))


HEADERS = ["Datum", "E-Mail Kunde", "Bestell-Nr", "Menge", "Einzelpreis", "Artikel", "Land"]


def order_headers(spark, sf):
    """One header per order: its line numbers choose the column names."""
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("table"),
        F.col("l_linenumber").alias("position"),
        F.element_at(F.array(*[F.lit(h) for h in HEADERS]), F.col("l_linenumber"))
         .alias("header"))


@query
def header_mapping(spark, sf):
    return map_headers(order_headers(spark, sf).distinct())


@query
def missing_required_columns(spark, sf):
    return missing_required(map_headers(order_headers(spark, sf).distinct()))


# --- summary and quality --------------------------------------------------------------------

@query
def frame_summary(spark, sf):
    return quality.summary(lines_tpch(spark, sf))


@query
def frame_summary_events(spark, sf):
    return quality.summary(lines_events(spark, sf))


@query
def kpis(spark, sf):
    return quality.kpis(activity_tpch(spark, sf))


@query
def quality_inputs(spark, sf):
    canon = stage(canonicalize(messy_lines(spark, sf), MESSY_MAPPING, ","), "canonical")
    return quality.quality_inputs(kept(canon), ingest_report(canon)).select(
        "span_days", half_even(F.col("median_order"), 4).alias("median_order"), "customers",
        half_even(F.col("suspicious_share"), 6).alias("suspicious_share"))


@query
def quality_inputs_events(spark, sf):
    return quality.quality_inputs(lines_events(spark, sf))


@query
def quality_warnings(spark, sf):
    """Events cover one month: the short window must be reported, in Czech too."""
    inputs = quality.quality_inputs(lines_events(spark, sf))
    return (quality.warnings(inputs, F.lit(0.06))
            .unionByName(quality.warnings(inputs, F.lit(0.06), "cs")))


@query
def unusable_inputs(spark, sf):
    """Whether an analysis accepts all lines, those of one customer, and none."""
    lines = lines_tpch(spark, sf)
    one = lines.agg(F.min("customer_id")).first()[0]
    found = []
    for case, some in (("all", lines), ("one customer", lines.where(F.col("customer_id") == one)),
                       ("no lines", lines.where("quantity < 0"))):
        row = quality.summary(some).first()
        try:
            quality.require_customers(row)
            verdict = "accepted"
        except UnusableInput as error:
            verdict = str(error)
        found.append((case, row.rows or 0, row.customers, verdict))
    return spark.createDataFrame(
        found, "input string, rows long, customers long, verdict string")


# --- calendar -------------------------------------------------------------------------------

@query
def daily_sales(spark, sf):
    return calendar.daily_sales(order_lines(spark, sf)).withColumn("date", day("date"))


@query
def daily_sales_events(spark, sf):
    return calendar.daily_sales(lines_events(spark, sf)).withColumn("date", day("date"))


@query
def daily_sales_streamed(spark, sf):
    """Daily sales of events that arrive in several files, booked micro-batch by micro-batch."""
    arrivals = stage_path(spark, "arrivals")
    lines = lines_events(spark, sf).withColumn(REASON, F.lit(None).cast("string"))
    lines.repartition(4).write.parquet(arrivals)
    ledger = Ledger(spark, stage_path(spark, "ledger"), timedelta(days=36500))
    (spark.readStream.schema(lines.schema).option("maxFilesPerTrigger", 2).parquet(arrivals)
     .writeStream.foreachBatch(ledger.sink())
     .option("checkpointLocation", stage_path(spark, "offsets"))
     .trigger(availableNow=True).start().awaitTermination())
    return ledger.daily_sales().withColumn("date", day("date"))


@query
def monthly_curve(spark, sf):
    return calendar.monthly_curve(order_lines(spark, sf))


@query
def seasonality(spark, sf):
    return calendar.seasonality_index(order_lines(spark, sf))


@query
def seasonality_events(spark, sf):
    return calendar.seasonality_index(lines_events(spark, sf))


@query
def peak_month(spark, sf):
    return calendar.peak_and_low(calendar.seasonality_index(order_lines(spark, sf)))


# --- factors --------------------------------------------------------------------------------

def event_factors(spark, sf):
    """Daily counts of other events and a weekend flag, through a factor file."""
    path = stage_path(spark, "factors")
    at = F.to_date(F.col("ts").cast("timestamp_ntz"))
    other = (table(spark, sf, "events").where(F.col("event_type") != "purchase")
             .groupBy(at.alias("d")).agg(
        F.count_if(F.col("event_type") == "error").alias("errors"),
        F.count_if(F.col("event_type") == "click").alias("clicks"),
        F.count_if(F.col("event_type") == "view").alias("views")))
    other.select(F.date_format("d", "yyyyMMdd").alias("Datum"), "errors", "clicks", "views",
                 F.dayofweek("d").isin(1, 7).cast("int").alias("weekend"),
                 F.lit(1).alias("constant"), F.lit("note").alias("label")) \
         .write.csv(path, header=True)
    return read_factors(spark, path)


@query
def factor_effects(spark, sf):
    daily = calendar.daily_sales(lines_events(spark, sf))
    return factors.factor_effects(factors.combine(daily, event_factors(spark, sf))) \
        .withColumn("on_days", F.coalesce("on_days", F.lit(0).cast("long")))


@query
def factor_matched(spark, sf):
    daily = calendar.daily_sales(lines_events(spark, sf))
    half = event_factors(spark, sf).where(F.dayofmonth("date") <= 20)
    return factors.matched_days(factors.combine(daily, half))


# --- products -------------------------------------------------------------------------------

@query
def category_from_names(spark, sf):
    return table(spark, sf, "part").select(
        "p_partkey", category_from_text(F.concat(
            F.lit("the 12 ("), F.col("p_name"), F.lit(")/"), F.col("p_brand")))
        .alias("category"), category_label(F.when(F.col("p_size") > 5, F.col("p_type")))
        .alias("label"))


@query
def product_mix(spark, sf):
    return products.product_mix(lines_tpch(spark, sf), scored_tpch(spark, sf), top_n=4)


@query
def product_mix_from_text(spark, sf):
    return products.product_mix(lines_tpch(spark, sf).drop("category"),
                                scored_tpch(spark, sf))


def part_catalog(spark, sf):
    """Parts as a product catalog with gaps and repeated ids."""
    part = table(spark, sf, "part").where(F.col("p_partkey") % 7 != 0)
    entry = part.select(
        F.col("p_partkey").cast("string").alias("product_id"),
        F.col("p_name").alias("product_name"),
        F.substring("p_type", 1, 2).alias("cat_1_ID"), F.col("p_type").alias("cat_1_name"),
        F.col("p_brand").alias("cat_2_ID"), F.col("p_brand").alias("cat_2_name"))
    again = entry.where(F.col("product_id").cast("long") % 5 == 0) \
                 .withColumn("product_name", F.concat(F.lit("z "), "product_name"))
    path = stage_path(spark, "catalog")
    entry.unionByName(again).write.csv(path, header=True, escape='"')
    return read_catalog(spark, path)


def lines_by_part(spark, sf):
    return lines_tpch(spark, sf).withColumn("product", F.col("part_key").cast("string"))


@query
def catalog_join(spark, sf):
    return products.enrich(lines_by_part(spark, sf), part_catalog(spark, sf)).select(
        "order_id", "line_number", "product", "product_name", "cat_1_name", "cat_2_name")


@query
def catalog_repeats(spark, sf):
    return products.one_row_per_product(part_catalog(spark, sf)).select(
        "product_id", "product_name", "entries")


@query
def catalog_missing(spark, sf):
    return products.placeholder_rows(
        products.missing_products(lines_by_part(spark, sf), part_catalog(spark, sf)))


@query
def catalog_complete(spark, sf):
    return products.complete_catalog(lines_by_part(spark, sf), part_catalog(spark, sf))


# --- clusters and lookalikes ------------------------------------------------------------------

def scaled_tpch(spark, sf):
    return stage(clusters.scale_features(seg.score_customers(features_tpch(spark, sf))),
                 "scaled")


@query
def scaled_features(spark, sf):
    return clusters.scale_features(features_tpch(spark, sf)).select(
        "customer_id", *[half_even(F.col(c), 6).alias(c) for c in clusters.SCALED])


@query
def lookalikes(spark, sf):
    scaled = scaled_tpch(spark, sf)
    anchor = scaled.agg(F.min("customer_id")).first()[0]
    return similar.lookalikes(scaled, anchor)


@query
def lookalikes_many(spark, sf):
    """The eight customers closest to each Champion, among all customers."""
    scaled = stage(scaled_tpch(spark, sf), "scaled")
    return nearest.lookalikes_many(scaled, scaled.where("segment = 'Champions'"))


@query
def segment_expansion(spark, sf):
    return similar.expand_segment(scaled_tpch(spark, sf), "Champions")


def _prospects(spark, sf):
    scaled = scaled_tpch(spark, sf)
    profile = seg.segment_profile(scaled)
    seed = similar.seed_segment(profile).first().seed
    return scaled, profile, seed, similar.expand_segment(scaled, seed)


@query
def seed_segment(spark, sf):
    return similar.seed_segment(seg.segment_profile(scored_tpch(spark, sf)))


def _prospect_statistics(scaled, seed, found):
    totals = quality.kpis(scaled).first()
    return similar.prospect_statistics(found, seed, totals.total_customers, totals.revenue)


@query
def prospect_stats(spark, sf):
    scaled, _, seed, found = _prospects(spark, sf)
    stats = _prospect_statistics(scaled, seed, found)
    return stats.select("for_segment", "customers", "share_pct", "rev_share_pct", *[
        half_even(F.col(c), 4).alias(c)
        for c in ("avg_recency", "avg_frequency", "avg_monetary", "avg_order_value")])


def _market(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("customer_id"),
        F.col("c_mktsegment").alias("market_segment"))


@query
def rand_index(spark, sf):
    labels = scored_tpch(spark, sf).join(_market(spark, sf), "customer_id")
    return clusters.rand_index(labels, "segment", "market_segment").select(
        half_even(F.col("ari"), 6).alias("ari"))


@query
def silhouette(spark, sf):
    return clusters.silhouette(scaled_tpch(spark, sf), "segment").select(
        half_even(F.col("silhouette"), 6).alias("silhouette"))


@query
def silhouette_sampled(spark, sf):
    """By Euclidean distance over all customers; the name is from when it drew a sample."""
    return clusters.silhouette_euclidean(scaled_tpch(spark, sf), "segment").select(
        half_even(F.col("silhouette"), 6).alias("silhouette"))


@query
def kmeans(spark, sf):
    scaled = stage(clusters.scale_features(features_tpch(spark, sf)), "scaled")
    return clusters.kmeans_labels(scaled).select("customer_id", "cluster")


@query
def kmeans_facts(spark, sf):
    """What must hold for any good clustering: all customers, k clusters, and less than half
    of the squared distances left."""
    scaled = stage(clusters.scale_features(features_tpch(spark, sf)), "scaled")
    labels = stage(clusters.kmeans_labels(scaled), "labels")
    square = sum(F.col(c) * F.col(c) for c in clusters.SCALED)
    by_cluster = labels.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("n"), F.sum(square).alias("square"),
        *[F.avg(c).alias(c) for c in clusters.SCALED])
    within = F.sum(F.col("square") - F.col("n") * square)
    return by_cluster.agg(F.sum("n").alias("customers"), F.count(F.lit(1)).alias("clusters"),
                          (within < F.sum("square") / 2).alias("halved"))


@query
def factor_first_values(spark, sf):
    """A factor file with many rows per day: the first value read for a day is its value."""
    path = stage_path(spark, "factors")
    day_of = F.date_format(F.col("ts").cast("timestamp_ntz"), "yyyy-MM-dd")
    (table(spark, sf, "events").select(day_of.alias("date"), "event_id", F.when(
        F.col("event_id") % 3 != 0, F.col("value")).alias("level"))
     .repartitionByRange(4, "date").sortWithinPartitions("date", "event_id")
     .select("date", "level").write.csv(path, header=True))
    return read_factors(spark, path).select(day("date").alias("date"), "level")


# --- history ----------------------------------------------------------------------------------

@query
def segment_migration(spark, sf):
    """Segments of all orders against those known before 1997, through the history table. Every
    ninth customer is left out of the later run, so that some leave."""
    path = stage_path(spark, "history")
    lines = order_lines(spark, sf)

    def segments(part):
        return seg.score_customers(feat.customer_activity(part))

    cut = F.lit("1997-01-01 00:00:00").cast("timestamp_ntz")
    sinks.append_snapshot(segments(lines.where(F.col("order_date") < cut)), path,
                          "run-1", "1996-12-31")
    late = lines.where(F.col("customer_id").cast("long") % 9 != 0)
    current = segments(late)
    return history.migration(sinks.previous_snapshot(spark, path, "run-2"), current)


@query
def migration_between_runs(spark, sf):
    """Three runs of the history, one of them written twice and one that never ended: the
    customers who moved between the first and the last committed one."""
    path = stage_path(spark, "history")
    lines = order_lines(spark, sf)

    def run(number, end):
        cut = F.lit(f"{end} 00:00:00").cast("timestamp_ntz")
        scored = seg.score_customers(feat.customer_activity(lines.where(F.col("order_date") < cut)))
        sinks.append_snapshot(scored, path, f"run-{number}", end)

    run(1, "1997-08-01")
    run(2, "2001-01-01")
    run(2, "1999-01-01")
    aborted = sinks.snapshot(spark, path, "run-1").withColumn("segment", F.lit("New"))
    sinks.write_snapshot(aborted, path, "run-3", "2000-01-01")
    return history.migration(sinks.snapshot(spark, path, "run-1"),
                             sinks.previous_snapshot(spark, path, "run-9"))


# --- campaigns ----------------------------------------------------------------------------------

@query
def campaign_estimates(spark, sf):
    return campaigns.with_estimate(seg.segment_profile(scored_tpch(spark, sf))).select(
        "segment", "customers", "assumed_response_rate", "expected_responders",
        "est_incremental_revenue")


def _cards(spark, sf, language="en"):
    scaled, profile, seed, found = _prospects(spark, sf)
    return campaigns.campaign_cards(profile, _prospect_statistics(scaled, seed, found),
                                    language), scaled, found


@query
def campaign_cards(spark, sf):
    return _cards(spark, sf)[0]


@query
def campaign_cards_czech(spark, sf):
    return _cards(spark, sf, "cs")[0]


DISCOUNTS = [("Champions", "percent", "15", "VIP15"), ("Dormant", "amount", "10", ""),
             ("New", "free_shipping", None, "SHIP1")]


@query
def owner_discounts(spark, sf):
    discounts = spark.createDataFrame(
        DISCOUNTS, "segment string, kind string, value string, code string")
    cards = campaigns.apply_discounts(_cards(spark, sf)[0], discounts)
    return cards.select("segment", "offer", "headline", "source", "discount_kind",
                        "discount_code")


@query
def copy_audit(spark, sf):
    """Whole documents as campaign copy, with a voucher phrase added to each."""
    texts = spread(table(spark, sf, "documents"), "doc_id").select("doc_id", F.concat(
        "text", F.lit(" Use code SAVE"), F.col("doc_id").cast("string"),
        F.when(F.col("doc_id") % 3 == 0, " for 20 % off").otherwise(" today"),
        F.lit(" or KEEP7 now")).alias("copy"))
    return campaigns.audit_copy(texts, ["copy"], keep="KEEP7").select(
        "doc_id", F.md5("clean_copy").alias("clean_md5"),
        F.length("clean_copy").alias("clean_length"), "promises_discount")


# --- audience -------------------------------------------------------------------------------------

def contact_lines(spark, sf):
    """Order lines whose customers left several addresses, none, or are one themselves."""
    key = F.col("order_id").cast("long")
    own = F.col("customer_id").cast("long") % 5 == 0
    return lines_tpch(spark, sf).select(
        F.when(own, F.concat(F.lit("c"), "customer_id", F.lit("@mail.example")))
         .otherwise(F.col("customer_id")).alias("customer_id"),
        "order_id", "order_date", "line_value", "quantity", "product", "country",
        F.when(own | (key % 3 != 0), "").otherwise(
            F.concat(F.lit(" u"), "customer_id", F.lit("_"), (key % 4).cast("string"),
                     F.lit("@shop.example"))).alias("customer_email"),
        F.when(key % 2 == 0, F.concat(F.lit("Name\r\n"), "customer_name")).otherwise(" ")
         .alias("customer_name"))


@query
def contacts(spark, sf):
    return audience.contacts(contact_lines(spark, sf))


def _recipients(spark, sf):
    lines = contact_lines(spark, sf)
    scored = stage(seg.score_customers(feat.customer_activity(lines)), "scored")
    return scored, audience.recipients(
        audience.customer_table(scored, audience.contacts(lines)))


@query
def audience_export(spark, sf):
    return _recipients(spark, sf)[1]


@query
def audience_files(spark, sf):
    """The recipients written as audience files of even size, and read back."""
    path = stage_path(spark, "audiences")
    sinks.write_audiences(_recipients(spark, sf)[1], path, rows_per_file=200)
    return sinks.read_audiences(spark, path)


@query
def csv_export(spark, sf):
    """Customers with names that a spreadsheet would run, written as CSV and read back."""
    path = stage_path(spark, "csv")
    sign = F.element_at(F.array(*map(F.lit, ["=", "+", "-", "@", "", "\"a, b\" "])),
                        (F.col("c_custkey") % 6 + 1).cast("int"))
    sinks.write_csv(table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer"), F.concat(sign, "c_name").alias("name"),
        F.col("c_mktsegment").alias("segment")), path)
    return spark.read.schema("customer long, name string, segment string").csv(
        path, header=True, escape='"')


@query
def mailings(spark, sf):
    scored, rows = _recipients(spark, sf)
    return audience.mailings(campaigns.campaign_cards(seg.segment_profile(scored)), rows)


@query
def customers_by_spend(spark, sf):
    lines = contact_lines(spark, sf)
    scored = _recipients(spark, sf)[0]
    return (audience.customer_table(scored, audience.contacts(lines))
            .orderBy(F.desc("monetary"), "customer_id"))


@query
def currency_of_orders(spark, sf):
    """Currency code -> symbol and content language, counted over the orders."""
    code = F.element_at(F.array(*[F.lit(c) for c in ("CZK", " eur", "USD", "gbp ", "CHF")]),
                        (F.col("o_orderkey") % 5 + 1).cast("int"))
    return (table(spark, sf, "orders").select(currency_symbol(code).alias("symbol"))
            .withColumn("language", content_language(F.col("symbol")))
            .groupBy("symbol", "language").agg(F.count(F.lit(1)).alias("orders")))


# --- end to end -----------------------------------------------------------------------------------

@query
def analysis_tables(spark, sf):
    """The whole run over the messy text lines: every result table with its row count."""
    canonical = canonicalize(messy_lines(spark, sf), MESSY_MAPPING, ",")
    result = analysis.analyze(canonical, currency="CZK")
    return reduce(DataFrame.unionByName, [
        df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("table"), "rows")
        for name, df in result.items()])
