"""Campaign cards: playbook text, impact estimate, priority, owner discounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import promises_discount, strip_voucher_codes

# Share of an audience expected to respond.
RESPONSE_RATES = {"Champions": 0.25, "Loyal": 0.15, "At-risk": 0.08, "New": 0.20,
                  "Dormant": 0.04, "Prospects": 0.12}
DEFAULT_RATE = 0.05

# Objective, offer and channel per segment, in the two content languages.
PLAYBOOK = {
    "en": {
        "Champions": ("Reward & upsell; protect the relationship",
                      "VIP early access + bundle", "Email"),
        "Loyal": ("Increase frequency; grow basket", "Loyalty points 2x this month", "Email"),
        "At-risk": ("Win back before they churn", "A 14-day comeback offer", "Email+SMS"),
        "New": ("Drive the crucial 2nd purchase", "Free shipping on order #2", "Email"),
        "Dormant": ("Reactivate or let go cheaply",
                    "We miss you – a welcome-back gift", "Email"),
        None: ("Engage the segment", "Targeted offer", "Email"),
    },
    "cs": {
        "Champions": ("Odměnit a rozšířit nákup; udržet vztah",
                      "VIP přístup k novinkám + dárek", "E-mail"),
        "Loyal": ("Zvýšit frekvenci; větší košík", "Dvojnásobné věrnostní body", "E-mail"),
        "At-risk": ("Získat zpět, než odejdou", "Návratová nabídka na 14 dní", "E-mail+SMS"),
        "New": ("Podpořit klíčový druhý nákup", "Doprava zdarma na druhou objednávku",
                "E-mail"),
        "Dormant": ("Reaktivovat, nebo levně opustit", "Chybíte nám – dárek k návratu",
                    "E-mail"),
        None: ("Oslovit segment", "Cílená nabídka", "E-mail"),
    },
}
# The card for customers who resemble the seed segment.
PROSPECT_CARD = {
    "en": ("Move high-potential shoppers up into %s", "An incentive for their next order",
           "Email"),
    "cs": ("Posunout nadějné zákazníky mezi „%s“", "Pobídka k dalšímu nákupu", "E-mail"),
}
# The reason given on a rule-based card.
RATIONALE = {"en": "Rule-based default.", "cs": "Pravidlové výchozí nastavení."}

CARD_TEXT = ("objective", "offer", "headline", "rationale")


def _language(language: str) -> str:
    return "cs" if language == "cs" else "en"


def response_rate(segment: Column) -> Column:
    rule = F.when(F.lit(False), F.lit(DEFAULT_RATE))
    for name, rate in RESPONSE_RATES.items():
        rule = rule.when(segment == name, F.lit(rate))
    return rule.otherwise(F.lit(DEFAULT_RATE))


def with_estimate(audiences: DataFrame) -> DataFrame:
    """Adds the expected responders and their revenue; both round half to even. Needs
    segment, customers, avg_order_value (as rounded in the profile)."""
    rate = response_rate(F.col("segment"))
    responders = F.rint(F.col("customers") * rate).cast("long")
    return audiences.select(
        "*", rate.alias("assumed_response_rate"), responders.alias("expected_responders"),
        F.rint(responders * F.col("avg_order_value")).cast("long")
         .alias("est_incremental_revenue"))


def playbook_table(spark: SparkSession, language: str = "en") -> DataFrame:
    rows = [(name, *text) for name, text in PLAYBOOK[_language(language)].items() if name]
    return spark.createDataFrame(
        rows, "segment string, objective string, offer string, channel string")


def campaign_cards(profile: DataFrame, prospects: DataFrame | None = None,
                   language: str = "en") -> DataFrame:
    """One card per segment of the profile, one more for the prospect list when it is not
    empty. Priority follows the estimated revenue: two high, two medium, the rest low.

    ``profile`` and ``prospects`` are aggregates of at most six rows together.
    """
    lang = _language(language)
    book = playbook_table(profile.sparkSession, lang)
    other = PLAYBOOK[lang][None]
    cards = (profile.select("segment", "position", "customers", "avg_order_value")
             .join(F.broadcast(book), "segment", "left")
             .withColumns({"objective": F.coalesce("objective", F.lit(other[0])),
                           "offer": F.coalesce("offer", F.lit(other[1])),
                           "channel": F.coalesce("channel", F.lit(other[2])),
                           "audience": F.lit("segment"),
                           "seed_segment": F.lit("")}))
    if prospects is not None:
        objective, offer, channel = PROSPECT_CARD[lang]
        cards = cards.unionByName(
            prospects.where(F.col("customers") > 0).select(
                F.lit("Prospects").alias("segment"), F.lit(99).alias("position"),
                "customers", "avg_order_value",
                F.format_string(objective, F.col("for_segment")).alias("objective"),
                F.lit(offer).alias("offer"), F.lit(channel).alias("channel"),
                F.lit("prospects").alias("audience"),
                F.col("for_segment").alias("seed_segment")))
    best_first = Window.orderBy(F.desc("est_incremental_revenue"), "position")
    place = F.row_number().over(best_first)
    return (with_estimate(cards)
            .withColumn("place", place)
            .select("place", "segment", "audience", "seed_segment", "objective", "channel",
                    "offer", F.col("offer").alias("headline"),
                    F.lit(RATIONALE[lang]).alias("rationale"),
                    F.when(F.col("place") <= 2, "high").when(F.col("place") <= 4, "medium")
                     .otherwise("low").alias("priority"),
                    F.lit("fallback").alias("source"),
                    "customers", "assumed_response_rate", "expected_responders",
                    "est_incremental_revenue"))


def discount_phrase(kind: Column, value: Column, code: Column, language: str = "en",
                    currency: str = "£") -> Column:
    """Words for an owner's discount: kind is percent | amount | free_shipping."""
    if _language(language) == "cs":
        base = (F.when(kind == "free_shipping", "doprava zdarma")
                 .when(kind == "amount", F.concat(F.lit("sleva "), value, F.lit(f" {currency}")))
                 .otherwise(F.concat(F.lit("sleva "), value, F.lit(" %"))))
        link = " s kódem "
    else:
        base = (F.when(kind == "free_shipping", "free shipping")
                 .when(kind == "amount", F.concat(F.lit(currency), value, F.lit(" off")))
                 .otherwise(F.concat(value, F.lit("% off"))))
        link = " with code "
    given = F.coalesce(code, F.lit("")) != ""
    return F.when(given, F.concat(base, F.lit(link), code)).otherwise(base)


def apply_discounts(cards: DataFrame, discounts: DataFrame, language: str = "en",
                    currency: str = "£") -> DataFrame:
    """Cards rewritten around the owner's discounts (segment, kind, value, code); cards
    without one stay as they are. Both tables have one row per segment."""
    phrase = discount_phrase(F.coalesce("kind", F.lit("percent")), F.col("value"),
                             F.col("code"), language, currency)
    offer = F.concat(F.upper(F.substring(phrase, 1, 1)),
                     F.right(phrase, F.length(phrase) - 1))
    has = F.col("discounted")
    marked = discounts.select("segment", "kind", "value", "code",
                              F.lit(True).alias("discounted"))
    joined = cards.join(marked, "segment", "left")
    return joined.select(
        *[F.when(has, offer).otherwise(F.col(c)).alias(c) if c in ("offer", "headline")
          else F.when(has, "owner-discount").otherwise(F.col(c)).alias(c) if c == "source"
          else F.col(c) for c in cards.columns],
        F.when(has, F.coalesce("kind", F.lit("percent"))).alias("discount_kind"),
        F.col("value").alias("discount_value"),
        F.when(F.col("code") != "", F.col("code")).alias("discount_code"))


def audit_copy(texts: DataFrame, columns: list[str], keep: str | None = None) -> DataFrame:
    """Adds ``clean_<column>`` without unissued voucher codes, and ``promises_discount``
    on the cleaned text. One scan, no shuffle."""
    cleaned = texts.withColumns({f"clean_{c}": strip_voucher_codes(F.col(c), keep)
                                 for c in columns})
    return cleaned.withColumn("promises_discount",
                              promises_discount(*[F.col(f"clean_{c}") for c in columns]))
