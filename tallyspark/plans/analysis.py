"""The end-to-end run: canonical lines -> all result tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.money import half_even
from ..functions.text import CURRENCY_SYMBOLS
from ..operators import (
    audience, calendar, campaigns, clusters, features, history, lookalikes, products,
    quality, segments)
from ..operators.canonical import ingest_report, kept
from ..session import stage
from ..sources import sinks

PROSPECTS = 15  # the default of ``analyze``


def small(df: DataFrame) -> DataFrame:
    """A result with a fixed bound on its rows (segments, months, one-row totals, a top-k),
    computed once and reused as a literal table."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def symbol_and_language(currency: str, language: str | None, source: str | None):
    symbol = CURRENCY_SYMBOLS.get(currency.strip().upper(), currency.strip())
    czech = source == "eshop" or symbol == "Kč"
    return symbol, language or ("cs" if czech else "en")


def analyze(canonical: DataFrame, currency: str = "£", language: str | None = None,
            source: str | None = None, history_path: str | None = None,
            run_id: str | None = None, catalog: DataFrame | None = None,
            top_categories: int = 12) -> dict[str, DataFrame]:
    """All result tables of one run over a canonicalised frame (with ``drop_reason``).

    Four tables are written to the staging folder and reread: the canonical lines, their
    lattice, the customer features, and the scored customers. Everything else is an independent
    DataFrame over one of them. With ``history_path`` the segments are compared with the
    latest earlier run, and ``save`` adds them to it.
    """
    symbol, lang = symbol_and_language(currency, language, source)
    canon = stage(canonical, "canonical")
    lines = kept(canon)
    report = small(ingest_report(canon))
    cells = features.lattice(lines)
    summary = small(quality.summary(lines, cells))
    totals = summary.first()
    quality.require_customers(totals)

    feature_table = stage(features.customer_features(lines, cells=cells), "features")
    scored = stage(clusters.kmeans_labels(stage(
        clusters.scale_features(segments.score_customers(feature_table)), "scaled")), "scored")
    profile = small(segments.segment_profile(scored))
    ari = small(clusters.rand_index(scored, "segment", "cluster"))
    silhouette = clusters.silhouette(scored, "cluster")
    agreement = ari.first().ari

    seed = lookalikes.seed_segment(profile).first().seed
    prospects = small(lookalikes.expand_segment(scored, seed, PROSPECTS))
    prospect_stats = small(lookalikes.prospect_statistics(
        prospects, seed, totals.customers, totals.revenue))
    season = small(calendar.seasonality_index(lines))
    enriched = products.enrich(lines, catalog)

    tables = {
        "summary": summary.select("*", F.lit(symbol).alias("currency"),
                                  F.lit(source or "upload").alias("source"),
                                  F.lit(lang).alias("language")),
        "kpis": quality.kpis(feature_table),
        "segments": profile,
        "prospects": prospects,
        "seasonality_index": season,
        "monthly_curve": calendar.monthly_curve(lines),
        "peak_month": calendar.peak_and_low(season),
        "daily_sales": calendar.daily_sales(lines),
        "campaigns": campaigns.campaign_cards(profile, prospect_stats, lang),
        "product_mix": products.product_mix(enriched, scored, top_categories),
        "validation": silhouette.select(
            half_even(F.col("silhouette"), 3).alias("kmeans_silhouette_squared"),
            half_even(F.lit(agreement), 3).alias("rfm_kmeans_ari"),
            F.lit(totals.customers).alias("n_customers")),
        "ingest": report,
        "warnings": quality.warnings(quality.quality_inputs(lines, report, cells),
                                     F.lit(agreement), lang),
        "customers": audience.customer_table(scored, audience.contacts(lines)),
    }
    if history_path:
        run_id = run_id or sinks.new_run_id()
        earlier = sinks.previous_snapshot(canonical.sparkSession, history_path, run_id)
        if earlier is not None:
            tables["migration"] = history.migration(earlier, scored)
        tables["snapshot"] = scored.select(
            "customer_id", "segment", F.lit(totals.date_to).alias("date_to"),
            F.lit(run_id).alias("run_id"))
    return tables


def save(tables: dict[str, DataFrame], path: str, history_path: str | None = None) -> None:
    """Write every result table as parquet below ``path``, then the segments to the history.

    The history is committed last: a run that is not saved to its end leaves none, and one that
    is saved again replaces its own.
    """
    sinks.write_tables(tables, path)
    if history_path and "snapshot" in tables:
        run = tables["snapshot"].select("run_id", "date_to").first()
        if run is not None:
            sinks.append_snapshot(tables["snapshot"], history_path, run.run_id, run.date_to)


def mailing_tables(tables: dict[str, DataFrame], language: str = "en",
                   signature: str | None = None) -> dict[str, DataFrame]:
    """Recipient rows and mailing texts for the cards of a run."""
    rows = audience.recipients(tables["customers"], tables["prospects"])
    return {"recipients": rows,
            "mailings": audience.mailings(tables["campaigns"], rows, language, signature)}
