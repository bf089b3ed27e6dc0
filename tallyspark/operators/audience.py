"""Contacts per customer, recipient lists and mailing texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import looks_like_email, one_line, strip

# Mailing phrases in the two content languages.
GREETING = {"en": "Hello,", "cs": "Dobrý den,"}
THANKS = {"en": "Thank you for shopping with us.", "cs": "Děkujeme, že u nás nakupujete."}
CODE_LINE = {"en": "Your code: ", "cs": "Váš kód: "}
SIGNATURE = {"en": "Your team", "cs": "Váš tým"}


def contacts(lines: DataFrame) -> DataFrame:
    """(customer_id, email, name): the value on the latest line that has one (the greatest
    value when lines share that moment); without any e-mail, the id when it is one.

    Lines collapse to distinct (customer, e-mail, name) first, so a customer with very
    many lines costs no more than the contacts they used.
    """
    def column(name):
        return (F.coalesce(F.col(name).cast("string"), F.lit("")) if name in lines.columns
                else F.lit("")).alias(name)

    used = (lines.select("customer_id", column("customer_email"), column("customer_name"),
                         "order_date")
            .groupBy("customer_id", "customer_email", "customer_name")
            .agg(F.max("order_date").alias("last")))

    def latest(name):
        cell = F.col(name)
        return F.max_by(F.when(strip(cell) != "", cell),
                        F.when(strip(cell) != "", F.struct(F.col("last"), cell)))

    own_id = F.when(looks_like_email(F.col("customer_id")), F.col("customer_id"))
    return (used.groupBy("customer_id")
            .agg(latest("customer_email").alias("email"), latest("customer_name").alias("name"))
            .select("customer_id",
                    F.coalesce("email", own_id, F.lit("")).alias("email"),
                    F.coalesce("name", F.lit("")).alias("name")))


def customer_table(scored: DataFrame, contact: DataFrame) -> DataFrame:
    """Customers with segment, behaviour and contact."""
    return (scored.join(contact, "customer_id", "left")
            .select("customer_id", "segment", "recency", "frequency", "monetary",
                    F.coalesce("email", F.lit("")).alias("email"),
                    F.coalesce("name", F.lit("")).alias("name")))


def recipients(customers: DataFrame, prospects: DataFrame | None = None) -> DataFrame:
    """(audience, customer_id, email, name), fields cleaned: every customer under their
    segment, and the prospect list once more under 'Prospects'.

    The prospect list is a top-k result; it is the small side of the join.
    """
    rows = customers.select(F.col("segment").alias("audience"), "customer_id", "email", "name")
    if prospects is not None:
        extra = customers.join(F.broadcast(prospects.select("customer_id")), "customer_id",
                               "left_semi")
        rows = rows.unionByName(extra.select(F.lit("Prospects").alias("audience"),
                                             "customer_id", "email", "name"))
    cid, mail = one_line(F.col("customer_id")), one_line(F.col("email"))
    return (rows.select("audience", cid.alias("customer_id"),
                        F.when((mail == "") & cid.contains("@"), cid).otherwise(mail)
                         .alias("email"),
                        one_line(F.col("name")).alias("name"))
            .where(F.col("customer_id") != ""))


def body_text(card_columns: list[str], language: str = "en",
              signature: str | None = None) -> Column:
    """Mailing text of a card: the owner's own body with the signature, or greeting,
    headline, offer, code, thanks and signature."""
    lang = "cs" if language == "cs" else "en"
    signed = F.lit((signature or "").strip() or SIGNATURE[lang])
    offer = F.coalesce("offer", F.lit(""))
    headline = F.coalesce("headline", F.lit(""))
    code = (F.coalesce("discount_code", F.lit("")) if "discount_code" in card_columns
            else F.lit(""))
    gap = F.lit("\n\n")
    built = F.concat(
        F.lit(GREETING[lang]), gap, headline,
        F.when((offer != "") & (offer != headline), F.concat(gap, offer)).otherwise(""),
        F.when(code != "", F.concat(gap, F.lit(CODE_LINE[lang]), code)).otherwise(""),
        gap, F.lit(THANKS[lang]), gap, signed)
    if "body" not in card_columns:
        return built
    own = F.btrim(F.coalesce("body", F.lit("")), F.lit(" \t\r\n"))
    return (F.when(own == "", built)
             .when(own.contains(signed), own)
             .otherwise(F.concat(own, gap, signed)))


def mailings(cards: DataFrame, recipient_rows: DataFrame, language: str = "en",
             signature: str | None = None) -> DataFrame:
    """One row per card: subject, text, number of recipients and of deliverable ones."""
    counts = recipient_rows.groupBy(F.col("audience").alias("segment")).agg(
        F.count(F.lit(1)).alias("recipients"),
        F.count_if(F.col("email") != "").alias("deliverable"))
    none = F.lit(0).cast("long")
    return (cards.join(counts, "segment", "left")
            .select("segment", "channel", F.col("headline").alias("subject"),
                    body_text(cards.columns, language, signature).alias("body_text"),
                    F.coalesce("recipients", none).alias("recipients"),
                    F.coalesce("deliverable", none).alias("deliverable")))
