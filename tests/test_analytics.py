import pathlib
import random

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyspark import session
from tallyspark.errors import UnusableInput
from tallyspark.functions import order_stats
from tallyspark.functions.order_stats import Wanted, find_ranks, medians
from tallyspark.functions.text import (
    category_from_text, currency_symbol, formula_safe, looks_like_email, one_line,
    promises_discount, strip_voucher_codes)
from tallyspark.operators import (
    audience, calendar, campaigns, clusters, factors, features, history, lookalikes,
    products, quality, segments)
from tallyspark.plans import analysis, queries
from tallyspark.sources.catalog_table import append_catalog, read_catalog
from tallyspark.sources.dispatch import load
from tallyspark.sources.factor_table import read_factors
from tallyspark.sources.relational import jdbc_options
from tallyspark.sources import sinks


def text(spark, value, expression):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c"))).first()[0]


# --- order statistics and scores ------------------------------------------------------------

def numbers(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "v double").repartition(5)


@pytest.mark.parametrize("shape", ["ties", "third_one_value", "distinct", "tiny"])
def test_scores_equal_average_rank_rule(spark, shape):
    rng = random.Random(3)
    values = {"ties": [rng.randint(0, 30) for _ in range(2003)],
              "third_one_value": [5.0] * 700 + [rng.random() * 10 for _ in range(1400)],
              "distinct": [rng.random() for _ in range(1501)],
              "tiny": [1, 2, 2]}[shape]
    df = numbers(spark, values)
    cuts = segments.quintile_cuts(df, ["v"])["v"]
    got = {r.v: (r.s, r.r) for r in df.select(
        "v", segments.quintile(F.col("v"), cuts).alias("s"),
        segments.quintile(F.col("v"), cuts, reverse=True).alias("r")).distinct().collect()}
    series = pd.Series(values, dtype=float)
    want = np.ceil(series.rank(pct=True) * 5).clip(1, 5).astype(int)
    assert all(got[float(v)] == (w, 6 - w) for v, w in zip(series, want))


@pytest.mark.parametrize("n,score", [(1, 5), (3, 4), (5, 3), (9, 3)])
def test_constant_column(spark, n, score):
    df = numbers(spark, [7] * n)
    cuts = segments.quintile_cuts(df, ["v"])["v"]
    assert df.select(segments.quintile(F.col("v"), cuts)).first()[0] == score


def test_ranks_survive_a_wrong_sketch(spark, monkeypatch):
    values = list(range(1000))
    monkeypatch.setattr(order_stats.F, "percentile_approx",
                        lambda c, edges, accuracy: F.array(*[F.max(F.lit(3.0)) for _ in edges]))
    found = find_ranks(numbers(spark, values), [Wanted("v", 0.5, lambda n: 500),
                                                Wanted("v", 0.0, lambda n: 1)], ranked=50)
    assert [(f.value, f.below, f.equal) for f in found] == [(499.0, 499, 1), (0.0, 0, 1)]


@pytest.mark.parametrize("shape", ["even", "steep", "two_values", "mostly_one", "signed_steep"])
def test_the_last_step_stays_small(spark, monkeypatch, shape):
    """However the values lie, and ten times as many of them: no more rows than the bound are
    ranked, and the rank is exact."""
    rng = random.Random(9)
    one = {"even": [rng.random() for _ in range(900)],
           "steep": [10.0 ** (k % 600 - 300) for k in range(900)],
           "two_values": [rng.choice([1.0, 2.0]) for _ in range(900)],
           "mostly_one": [7.0] * 700 + [7.0 + rng.random() for _ in range(200)],
           "signed_steep": [rng.choice([-1, 1]) * 2.0 ** rng.randrange(-900, 900)
                            for _ in range(900)]}[shape]
    settle, inside = order_stats._rank_inside, []
    monkeypatch.setattr(order_stats, "_rank_inside", lambda values, spans, size: (
        inside.extend(s.inside for s in spans.values()), settle(values, spans, size))[1])
    for times in (1, 10):
        data = sorted(one * times)
        n = len(data)
        wanted = [Wanted("v", f, lambda n, f=f: max(1, round(f * n))) for f in (0, 0.2, 0.5, 0.99, 1)]
        df = spark.createDataFrame([(v,) for v in one], "v double").join(
            spark.range(times).select(F.lit(1).alias("one")), how="cross").repartition(4)
        got = find_ranks(df, wanted, ranked=40)
        for w, f in zip(wanted, got):
            value = data[w.rank(n) - 1]
            assert (f.value, f.below, f.equal, f.n) == (
                value, sum(x < value for x in data), data.count(value), n)
    assert max(inside, default=0) <= 40


def test_medians(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, 5.0), (4.0, None), (9.0, 7.0)], "a double, b double")
    assert medians(df, ["a", "b"]) == {"a": 3.0, "b": 6.0}
    assert medians(df.where("a > 100"), ["a"]) == {"a": None}


# --- features ---------------------------------------------------------------------------------

def test_coupons_and_shared_orders(spark, lines):
    df = lines([("c1", "o1", "2025-01-01 10:00", 2.0, 10.0, "A", "CZ"),
                ("c1", "o1", "2025-01-01 10:00", 1.0, -5.0, "COUPON1", "CZ"),
                ("c1", "o2", "2025-01-11 09:00", 1.0, 20.0, "B", "SK"),
                ("c2", "o2", "2025-01-11 09:30", 1.0, 20.0, "B", "DE")])
    df = df.withColumn("is_product", ~F.col("product").startswith("COUPON"))
    rows = {r.customer_id: r for r in features.customer_features(df).collect()}
    assert set(rows) == {"c1"}                      # o2 belongs to its earliest line
    r = rows["c1"]
    assert (r.distinct_products, r.frequency, r.monetary) == (2, 2, 55.0)
    assert (r.recency, r.tenure_days, r.avg_basket_items) == (1, 9, 2.0)
    assert r.interpurchase_days == 9.0 and r.country == "CZ"


def test_single_order_customer_has_no_gap(spark, lines):
    df = lines([("c1", "o1", "2025-01-01", 1.0, 1.0, "A", "b"), ("c1", "o1", "2025-01-01", 1.0, 1.0, "A", "a")])
    r = features.customer_features(df).first()
    assert r.interpurchase_days is None and r.country == "a"


def test_sums_do_not_depend_on_partitioning(spark, lines):
    df = lines([("c", f"o{i % 7}", "2025-01-01", 1.0, 0.1 * i, "p", "x") for i in range(500)])
    sums = {features.customer_features(df.repartition(n)).first().monetary for n in (1, 3, 8)}
    assert len(sums) == 1


# --- clusters, lookalikes ------------------------------------------------------------------------

def customers(spark, n, seed=1):
    rng = random.Random(seed)
    return spark.createDataFrame(
        [(f"c{i:03}", rng.randint(1, 300), rng.randint(1, 9), rng.random() * 1000,
          rng.random() * 100, rng.random() * 5, rng.randint(1, 9),
          "Champions" if i % 4 == 0 else "Loyal") for i in range(n)],
        "customer_id string, recency int, frequency long, monetary double, "
        "avg_order_value double, avg_basket_items double, distinct_products long, segment string")


def test_scaling_fills_and_flattens(spark):
    df = customers(spark, 50).withColumn("distinct_products", F.lit(3)).withColumn(
        "avg_basket_items", F.when(F.col("recency") > 30, F.col("avg_basket_items")))
    got = clusters.scale_features(df).select(*clusters.SCALED).toPandas()
    assert (got.z_distinct_products == 0).all() and not got.isna().any().any()
    assert np.allclose(got.drop(columns="z_distinct_products").mean(), 0, atol=1e-9)
    assert np.allclose(got.drop(columns="z_distinct_products").std(ddof=0), 1)


def test_rand_index(spark):
    same = spark.createDataFrame([(i % 3, (i % 3) * 10) for i in range(30)], "a int, b int")
    assert clusters.rand_index(same, "a", "b").first().ari == 1.0
    rng = random.Random(2)
    mixed = spark.createDataFrame([(rng.randint(0, 3), rng.randint(0, 3)) for _ in range(800)], "a int, b int")
    assert abs(clusters.rand_index(mixed, "a", "b").first().ari) < 0.05


def test_kmeans_and_silhouette_on_small_data(spark):
    scaled = clusters.scale_features(customers(spark, 4))
    labelled = clusters.kmeans_labels(scaled, starts=2)
    assert labelled.select("cluster").distinct().count() <= 3
    pair = clusters.scale_features(customers(spark, 2))
    assert {r.cluster for r in clusters.kmeans_labels(pair).collect()} == {0}
    assert clusters.silhouette(clusters.kmeans_labels(pair), "cluster").first().silhouette is None


def test_silhouette_equals_brute_force(spark):
    scaled = clusters.scale_features(customers(spark, 120))
    frame = scaled.toPandas()
    x, lab = frame[clusters.SCALED].to_numpy(), frame.segment.to_numpy()
    squared = ((x[:, None] - x[None]) ** 2).sum(2)
    for d, result in ((squared, clusters.silhouette(scaled, "segment")),
                      (np.sqrt(squared), clusters.silhouette_sampled(scaled, "segment", 1000))):
        s = []
        for i in range(len(x)):
            own = (lab == lab[i]) & (np.arange(len(x)) != i)
            a, b = d[i, own].mean(), d[i, lab != lab[i]].mean()
            s.append((b - a) / max(a, b))
        assert abs(result.first().silhouette - np.mean(s)) < 1e-9


def test_the_query_of_the_euclidean_silhouette_takes_all_customers(spark):
    """1500 customers, by brute force; near and equal points of one cluster and of two."""
    scaled = queries.scaled_tpch(spark, "/root/testdata/sf0.01")
    got = queries.QUERIES["silhouette_sampled"](spark, "/root/testdata/sf0.01").first().silhouette
    frame = scaled.select("segment", *clusters.SCALED).toPandas()
    assert len(frame) > 500 and abs(got - brute_silhouette(frame)) < 1e-6
    near = pd.concat([frame[:90], frame[:40], frame[20:60].assign(segment="New"),
                      frame[:30].assign(z_recency=frame.z_recency[:30] + 1e-9),
                      frame[:1].assign(segment="alone"), frame[:1].assign(segment=None)])
    for block in (17, 1000):
        got = clusters.silhouette_euclidean(spark.createDataFrame(near), "segment", block)
        assert abs(got.first().silhouette - brute_silhouette(near.fillna("?"))) < 1e-9


def test_a_block_that_meets_itself_measures_each_pair_once(monkeypatch):
    """Points of three clusters with weights; sums by cluster, of one block and of two."""
    rng, n, measured = np.random.default_rng(2), 1500, []
    x, own, weight = rng.normal(size=(n, 6)), rng.integers(0, 3, n), rng.integers(1, 4, n)
    table = pa.table({"point": np.arange(n) * 7, "own": own, "weight": weight,
                      **dict(zip(clusters.SCALED, x.T))})
    true = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    root = np.sqrt
    monkeypatch.setattr(np, "sqrt", lambda g, **more: measured.append(g.size) or root(g, **more))
    parts = [np.arange(n) < 600, np.arange(n) >= 600]
    for a, b, pairs in ((0, 0, 0.7 * 600 ** 2), (1, 1, 0.7 * 900 ** 2), (0, 1, 600 * 900)):
        measured.clear()
        got = clusters._gaps(3)((pa.scalar(a), pa.scalar(b)), table.filter(pa.array(parts[a])),
                                table.filter(pa.array(parts[b])))
        assert sum(measured) <= pairs
        found = dict(zip(got["point"].to_pylist(), got["totals"].to_pylist()))
        for mine, other in {(a, b), (b, a)}:
            for i in np.flatnonzero(parts[mine]):
                want = [(true[i] * weight)[parts[other] & (own == c)].sum() for c in range(3)]
                assert np.allclose(found[i * 7], want, rtol=1e-9)


def brute_silhouette(frame):
    x, names = frame[clusters.SCALED].to_numpy(), frame.segment.to_numpy()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    scores = []
    for i in range(len(x)):
        own = (names == names[i]) & (np.arange(len(x)) != i)
        if not own.any():
            scores.append(0.0)
            continue
        a = d[i, own].mean()
        b = min(d[i, names == k].mean() for k in set(names) - {names[i]})
        scores.append((b - a) / max(a, b) if max(a, b) else 0.0)
    return np.mean(scores)


def test_the_sampled_silhouette_always_samples(spark):
    scaled = clusters.scale_features(customers(spark, 120))
    some = clusters.silhouette_sampled(scaled, "segment", 40).first().silhouette
    assert some is not None and some != clusters.silhouette_sampled(scaled, "segment", 120).first().silhouette


def test_lookalikes_match_brute_force(spark):
    scaled = clusters.scale_features(customers(spark, 60))
    frame = scaled.toPandas()
    x = frame[clusters.SCALED].to_numpy()
    u = x / (np.linalg.norm(x, axis=1, keepdims=True) + 1e-9)
    at = frame.index[frame.customer_id == "c007"][0]
    order = [i for i in np.argsort(-(u @ u[at])) if i != at][:8]
    assert [r.customer_id for r in lookalikes.lookalikes(scaled, "c007").collect()] == list(frame.customer_id[order])
    assert lookalikes.lookalikes(scaled, "c007", k=500).count() == 59
    with pytest.raises(UnusableInput):
        lookalikes.lookalikes(scaled, "nobody")
    assert lookalikes.expand_segment(scaled, "Dormant").count() == 0
    grown = lookalikes.expand_segment(scaled, "Champions", k=1000)
    assert grown.count() == 45 and grown.where("segment = 'Champions'").count() == 0


# --- calendar, factors, quality --------------------------------------------------------------------

def test_calendar_gaps_and_shared_order(spark, lines):
    df = lines([("c", "o1", "2025-01-31", 1.0, 31.0, "", ""), ("c", "o1", "2025-01-31", 1.0, 1.0, "", ""),
                ("c", "o1", "2025-03-01", 1.0, 5.0, "", "")])
    curve = calendar.monthly_curve(df).orderBy("month").collect()
    assert [(r.month, r.revenue, r.orders) for r in curve] == [
        ("2025-01", 32.0, 1), ("2025-02", 0.0, 0), ("2025-03", 5.0, 1)]
    index = {r.month: r["index"] for r in calendar.seasonality_index(df).collect()}
    assert index == {"Jan": 259, "Feb": 0, "Mar": 41}
    peak = calendar.peak_and_low(calendar.seasonality_index(df)).first()
    assert (peak.peak_month, peak.peak_uplift_pct, peak.low_month) == ("Jan", 159, "Feb")


def daily(spark, rows):
    return spark.createDataFrame(rows, "d string, revenue double, orders long") \
        .selectExpr("cast(d as date) as date", "revenue", "orders")


def test_factor_effects(spark, tmp_path):
    days = [f"2025-{m:02}-{d:02}" for m in (1, 2) for d in range(1, 29)]
    (tmp_path / "f.csv").write_text("holiday,promo,temp,flat,revenue,note\n" + "\n".join(
        f"{d.replace('-', '')},{int(i % 2 == 0)},{i},1,{-i},x" for i, d in enumerate(days)) + "\n20250101,9,9,9,9,9\n")
    loaded = read_factors(spark, str(tmp_path / "f.csv"))
    assert "factor_revenue" in loaded.columns and loaded.count() == 56
    sales = daily(spark, [(d, 200.0 if i % 2 == 0 else 100.0, 1) for i, d in enumerate(days)])
    got = {r.factor: r for r in factors.factor_effects(factors.combine(sales, loaded)).collect()}
    assert (got["promo"].type, got["promo"].effect_pct, got["promo"].position) == ("flag", 100.0, 1)
    assert "flat" not in got and "note" not in got and got["temp"].strength == "weak"
    trend = daily(spark, [(d, 10.0 * i + 50, 1) for i, d in enumerate(days)])
    r = {x.factor: x for x in factors.factor_effects(factors.combine(trend, loaded)).collect()}
    assert r["temp"].correlation == 1.0 and r["factor_revenue"].direction == "lowers"
    short = factors.combine(daily(spark, [(days[0], 1.0, 1)]), loaded)
    assert factors.factor_effects(short).count() == 0


def codes(df):
    return {r.code for r in df.collect()}


def test_warnings(spark, lines):
    weak = lines([(f"c{i % 5}", f"o{i}", "2025-01-01", 1.0, 0.04, "", "") for i in range(10)])
    report = spark.createDataFrame([("kept", 69), ("unparseable date", 31)], "reason string, rows long")
    inputs = quality.quality_inputs(weak, report)
    assert codes(quality.warnings(inputs, F.lit(0.01))) == {
        "short-window", "tiny-money", "few-customers", "high-drop"}
    message = {r.code: r.message for r in quality.warnings(inputs, None, "cs").collect()}
    assert message["high-drop"].startswith("31 % řádků") and "0.04" in message["tiny-money"]
    fine = lines([(f"c{i}", f"o{i}", f"2025-{1 + i % 9:02}-01", 1.0, 50.0, "", "") for i in range(60)])
    assert codes(quality.warnings(quality.quality_inputs(fine), F.lit(0.1))) == {"weak-structure"}
    assert codes(quality.warnings(quality.quality_inputs(fine), F.lit(0.3))) == set()


def test_too_few_customers(spark, lines):
    one = quality.summary(lines([("c", "o", "2025-01-01", 1.0, 1.0, "", "")])).first()
    with pytest.raises(UnusableInput):
        quality.require_customers(one)


# --- products, history, campaigns, audience ---------------------------------------------------------

@pytest.mark.parametrize("name,category", [
    ("laptop stand adjustable", "Laptop"), ("a pro display", "Display"), ("", "Other"), ("  ", "Other"),
    ("100 Kč dárkový poukaz", "Dárkový"), ("(THE) [mug]/cup", "Mug"), ("12 34", "12 34"), ("ab", "Ab"),
    ("for-the_x,ab|toLong", "Tolong"), ("it's", "It's"), ("'quoted' word", "Quoted"), (None, "Other"),
    ("e xtra", "Xtra")])
def test_category(spark, name, category):
    assert text(spark, name, category_from_text) == category


def test_product_mix(spark, lines):
    df = lines([("c1", "o1", "2025-01-01", 1.0, 50.0, "Laptop stand", "CZ"),
                ("c1", "o1", "2025-01-01", 1.0, 30.0, "Laptop bag", "CZ"),
                ("c2", "o2", "2025-01-01", 1.0, 20.0, "Coffee mug", "CZ"),
                ("c3", "o3", "2025-01-01", 1.0, 80.0, "Laptop stand", "CZ"),
                ("c3", "o3", "2025-01-01", 1.0, 10.0, "Coffee mug", "CZ"),
                ("c4", "o4", "2025-01-01", 1.0, 99.0, "Coffee mug", "CZ")])
    seg = spark.createDataFrame([("c1", "Champions"), ("c2", "New"), ("c3", "Loyal")],
                                "customer_id string, segment string")
    rows = products.product_mix(df, seg).collect()
    assert sum(r.revenue for r in rows) == 190.0
    assert {(r.segment, r.category, r.customers) for r in rows} == {
        ("Champions", "Laptop", 1), ("New", "Coffee", 1), ("Loyal", "Laptop", 1), ("Loyal", "Coffee", 1)}
    assert {r.category for r in products.product_mix(df, seg, top_n=1).collect()} == {"Laptop"}
    assert products.with_category(df.withColumn("cat_2_name", F.lit("")), []).first().category == "Other"


def test_catalog_file(spark, tmp_path, lines):
    assert read_catalog(spark, str(tmp_path / "none.csv")) is None
    df = lines([("c", "o", "2025-01-01", 1.0, 1.0, p, "CZ") for p in ("11", "12", "GIFT", "12")])
    path = str(tmp_path / "catalog")
    append_catalog(products.placeholder_rows(products.missing_products(df, None)), path)
    catalog = read_catalog(spark, path)
    assert {r.product_name for r in catalog.collect()} == {"Produkt 11", "Produkt 12"}
    assert products.missing_products(df, catalog).count() == 0
    doubled = catalog.unionByName(catalog)
    assert products.enrich(df, doubled).count() == 4
    assert products.enrich(df, None) is df


def test_history(spark, tmp_path):
    schema = "customer_id string, segment string"
    first = spark.createDataFrame([("a", "Champions"), ("b", "Loyal"), ("e", "")], schema)
    second = spark.createDataFrame([("a", "At-risk"), ("b", "Loyal"), ("c", "New"), ("e", "New")], schema)
    path = str(tmp_path / "history")
    assert sinks.previous_snapshot(spark, path, "r1") is None
    sinks.append_snapshot(first, path, "r1", "2025-01-01")
    sinks.append_snapshot(second, path, "r2", "2025-02-01")
    got = history.migration(sinks.previous_snapshot(spark, path, "r2"), second)
    assert {(r.change, r["from"], r["to"], r.customers) for r in got.collect()} == {
        ("moved", "Champions", "At-risk", 1), ("entered", "", "", 1)}
    assert sinks.new_run_id() < sinks.new_run_id()
    # A run that ended half-way is not seen; one that is written again replaces itself.
    sinks.write_snapshot(first, path, "r3", "2025-03-01")
    sinks.append_snapshot(second, path, "r2", "2025-02-01")
    assert sinks.committed_runs(spark, path) == ["r1", "r2"]
    assert sinks.previous_snapshot(spark, path, "r9").count() == 4
    assert sinks.snapshot(spark, path, "r1").count() == 3
    with pytest.raises(UnusableInput):
        sinks.snapshot(spark, path, "r3")


def test_estimates_and_priority(spark):
    prof = spark.createDataFrame([(s, i, 100, 500.0 / (i + 1)) for i, s in enumerate(
        ["Champions", "Loyal", "At-risk", "New", "Dormant"])],
        "segment string, position int, customers long, avg_order_value double")
    cards = campaigns.campaign_cards(prof).orderBy("place").collect()
    assert (cards[0].segment, cards[0].expected_responders, cards[0].est_incremental_revenue) == ("Champions", 25, 12500)
    assert [c.priority for c in cards] == ["high", "high", "medium", "medium", "low"]
    half = campaigns.with_estimate(spark.createDataFrame([("Champions", 10, 1.0)], "segment string, customers long, avg_order_value double"))
    assert half.first().expected_responders == 2


@pytest.mark.parametrize("copy,keep,clean", [
    ("Use code SAVE20 now", None, "now"), ("Sleva s kódem JARO15!", None, "Sleva!"),
    ("Grab SUMMER2025 today", None, "Grab today"), ("Use code VIP15 now", "VIP15", "Use code VIP15 now"),
    ("SALE today", None, "SALE today"), (None, None, None)])
def test_voucher_codes(spark, copy, keep, clean):
    assert text(spark, copy, lambda c: strip_voucher_codes(c, keep)) == clean


@pytest.mark.parametrize("copy,found", [("15 % dolů", True), ("get 50€ off", True), ("Kč3000", True),
                                        ("100 kč sleva", True), ("a comeback offer", False), ("25 $", True)])
def test_concrete_discounts(spark, copy, found):
    assert text(spark, copy, promises_discount) is found


def test_discount_rewrite(spark):
    cards = spark.createDataFrame([("New", "o", "h", "fallback"), ("Loyal", "o", "h", "fallback")],
                                  "segment string, offer string, headline string, source string")
    deal = spark.createDataFrame([("New", "amount", "100", "JARO")], "segment string, kind string, value string, code string")
    got = {r.segment: r for r in campaigns.apply_discounts(cards, deal, "cs", "Kč").collect()}
    assert got["New"].offer == "Sleva 100 Kč s kódem JARO" == got["New"].headline
    assert (got["Loyal"].offer, got["Loyal"].discount_code) == ("o", None)


def test_recipients_and_mailing(spark):
    people = spark.createDataFrame([("c1", "New", " a@x.cz\r\n", "A\r\nB"), ("b@x.cz", "New", "", ""),
                                    ("hash123", "New", "", ""), (" ", "New", "", "")],
                                   "customer_id string, segment string, email string, name string")
    rows = audience.recipients(people)
    assert {(r.customer_id, r.email, r.name) for r in rows.collect()} == {
        ("c1", "a@x.cz", "A  B"), ("b@x.cz", "b@x.cz", ""), ("hash123", "", "")}
    card = spark.createDataFrame([("New", "Email", "Hi", "Hi", "JARO15")],
                                 "segment string, channel string, headline string, offer string, discount_code string")
    mail = audience.mailings(card, rows, "cs", "Petr").first()
    assert (mail.recipients, mail.deliverable) == (3, 2)
    assert mail.body_text.startswith("Dobrý den,\n\nHi\n\nVáš kód: JARO15") and mail.body_text.endswith("\n\nPetr")
    own = audience.mailings(card.withColumn("body", F.lit(" My text ")), rows, "en", "Petr").first()
    assert own.body_text == "My text\n\nPetr"


def test_contacts(spark, lines):
    df = lines([("c1", "o1", "2025-01-01", 1.0, 1.0, "", "", "old@x", "N"), ("c1", "o2", "2025-01-02", 1.0, 1.0, "", "", "new@x", " "),
                ("c1", "o3", "2025-01-03", 1.0, 1.0, "", "", "  ", " "), ("d@x.cz", "o4", "2025-01-03", 1.0, 1.0, "", "", "", "")],
               ["customer_email", "customer_name"])
    got = {r.customer_id: (r.email, r.name) for r in audience.contacts(df).collect()}
    assert got == {"c1": ("new@x", "N"), "d@x.cz": ("d@x.cz", "")}
    plain = df.drop("customer_email", "customer_name")
    assert {r.email for r in audience.contacts(plain).collect()} == {"", "d@x.cz"}


def test_small_text_rules(spark):
    assert text(spark, "=1+1", formula_safe) == "'=1+1" and text(spark, "ok", formula_safe) == "ok"
    assert text(spark, " a\r\nb ", one_line) == "a  b"
    assert text(spark, "a@b.cz", looks_like_email) is True and text(spark, "a@b", looks_like_email) is False
    assert text(spark, " czk", currency_symbol) == "Kč" and text(spark, "CHF ", currency_symbol) == "CHF"


# --- sources, end to end --------------------------------------------------------------------------------

def test_jdbc_options():
    assert jdbc_options("jdbc:x", "SELECT 1")["query"] == "SELECT 1"
    ranged = jdbc_options("jdbc:x", "SELECT 1", "id", (0, 10), 4)
    assert ranged["dbtable"].startswith("(SELECT 1)") and ranged["numPartitions"] == "4" and "query" not in ranged
    with pytest.raises(UnusableInput):
        jdbc_options("jdbc:x", "SELECT 1", "id")


def test_nested_orders(spark, tmp_path):
    (tmp_path / "page.json").write_text(
        '{"data":{"orders":[{"email":"a@x.cz","code":"1","creationTime":"2025-01-01T10:00:00",'
        '"billingAddress":{"country":"CZ"},"items":[{"amount":"2","name":"A","itemPrice":{"withVat":"10.5"}},'
        '{"amount":"1","name":"B"}]},{"email":"b@x.cz","code":"2","items":[]}]}}\n')
    out = load(spark, "json", path=str(tmp_path))
    rows = [r for r in out.collect() if r.drop_reason is None]
    assert [(r.customer_id, r.line_value, r.country) for r in rows] == [("a@x.cz", 21.0, "CZ")]
    assert {r.drop_reason for r in out.collect()} == {None, "unparseable price"}
    with pytest.raises(UnusableInput):
        load(spark, "carrier pigeon")


def test_end_to_end(spark, folder, tmp_path):
    from tallyspark.plans.queries import MESSY_MAPPING, messy_lines
    from tallyspark.operators.canonical import canonicalize
    canonical = canonicalize(messy_lines(spark, folder), MESSY_MAPPING, ",")
    result = analysis.analyze(canonical, currency="CZK", history_path=str(tmp_path / "h"), run_id="1")
    assert "migration" not in result and result["summary"].first().language == "cs"
    assert abs(sum(r.share_pct for r in result["segments"].collect()) - 100) < 0.5
    assert result["customers"].count() == result["summary"].first().customers
    mail = analysis.mailing_tables(result, "cs")
    assert mail["mailings"].count() == result["campaigns"].count()
    sinks.write_audiences(mail["recipients"], str(tmp_path / "audiences"))
    sinks.write_csv(result["customers"], str(tmp_path / "csv"))
    analysis.save({"kpis": result["kpis"]}, str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out/kpis")).count() == 1
    assert sinks.committed_runs(spark, str(tmp_path / "h")) == []
    analysis.save({"snapshot": result["snapshot"]}, str(tmp_path / "out"), str(tmp_path / "h"))
    assert sinks.committed_runs(spark, str(tmp_path / "h")) == ["1"]


def test_a_run_leaves_nothing_staged(spark, lines):
    rows = lines([(f"c{k % 9}", f"o{k}", f"2025-0{1 + k % 6}-11 10:00", 1.0, 5.0 + k, "A", "CZ")
                  for k in range(40)])
    with session.run_scope(spark) as folder:
        summary = quality.summary(rows).first()
        with session.run_scope(spark) as inner:
            assert inner.startswith(folder) and session.stage(rows, "x").count() == 40
        assert not pathlib.Path(inner).exists() and list(pathlib.Path(folder).iterdir())
    assert summary.rows == 40 and not pathlib.Path(folder).exists()
    outside = session.stage_path(spark, "x")
    with pytest.raises(ZeroDivisionError), session.run_scope(spark) as folder:
        session.stage(rows, "y")
        1 / 0
    assert not pathlib.Path(folder).exists() and "/run-" not in outside


def test_audience_files_are_even(spark, tmp_path):
    """A third of all recipients in one audience: its files are as large as those of others."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), F.col("id") % 20))
        .alias("audience"), F.col("id").cast("string").alias("customer_id"),
        F.lit("").alias("email"), F.concat(F.lit("n"), "id").alias("name"))
    sinks.write_audiences(rows, str(tmp_path / "x"), rows_per_file=100)
    back = sinks.read_audiences(spark, str(tmp_path / "x"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    sizes = [r["count"] for r in spark.read.json(str(tmp_path / "x")).groupBy(
        F.input_file_name(), "audience").count().collect()]
    assert max(sizes) <= 200 and len(sizes) < 60
