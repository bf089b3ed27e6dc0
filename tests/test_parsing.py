from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tallyspark.errors import UnusableInput
from tallyspark.functions.dates import detect_style, parse_date, parse_text_date, whole_days
from tallyspark.functions.numbers import czech_money, locale_number, plain_number
from tallyspark.operators.canonical import canonicalize, ingest_report, kept


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "c string").select(expression(F.col("c"))).first()[0]


@pytest.mark.parametrize("text,decimal,value", [
    ("€1.234,56", ",", 1234.56), ("1 000,00", ",", 1000.0), ("$1,234.56", ".", 1234.56),
    ("9.90", ".", 9.90), ("Kč 49,90", ",", 49.90), ("1e5", ".", 15.0), ("1-2", ".", None),
    ("", ".", None), ("n/a", ",", None), ("-5", ".", -5.0), (None, ".", None)])
def test_locale_number(spark, text, decimal, value):
    assert one(spark, text, lambda c: locale_number(c, decimal)) == value


@pytest.mark.parametrize("text,value", [
    ("1 234,56", 1234.56), ("-129,46", -129.46), ("1 000", 1000.0), ("12d", None), ("?", None)])
def test_czech_money(spark, text, value):
    assert one(spark, text, czech_money) == value


@pytest.mark.parametrize("text,value", [("12d", None), (" 1e3 ", 1000.0), (".5", 0.5), ("5.", 5.0),
                                        ("nan", None)])
def test_plain_number(spark, text, value):
    assert one(spark, text, plain_number) == value


@pytest.mark.parametrize("text,day_first,expected", [
    ("2026-03-05", True, (2026, 3, 5)), ("2026-03-05T07:08:09", False, (2026, 3, 5, 7, 8, 9)),
    ("05/03/2026", True, (2026, 3, 5)), ("05/03/2026", False, (2026, 5, 3)),
    ("25/03/2026", False, (2026, 3, 25)), ("03/25/2026", True, (2026, 3, 25)),
    ("5.3.2026 14:30", True, (2026, 3, 5, 14, 30)), ("5. 3. 2026", True, (2026, 3, 5)),
    ("05/03/26", True, (2026, 3, 5)), ("05/03/99", True, (1999, 3, 5)),
    ("20260305", False, (2026, 3, 5)), ("20260305 1430", False, (2026, 3, 5, 14, 30)),
    ("2026/03/05", True, (2026, 3, 5)), ("March 5, 2026", False, (2026, 3, 5)),
    ("5 Mar 2026 10:15", False, (2026, 3, 5, 10, 15)),
    ("03/05/2026 12:05 AM", False, (2026, 3, 5, 0, 5)),
    ("03/05/2026 1:05 p.m.", False, (2026, 3, 5, 13, 5)),
    ("not a date", True, None), ("99/99/2026", True, None), ("", True, None), (None, True, None)])
def test_text_dates(spark, text, day_first, expected):
    got = one(spark, text, lambda c: parse_text_date(c, day_first))
    assert got == (datetime(*expected) if expected else None)


@pytest.mark.parametrize("cells,kind,day_first", [
    (["13/02/2025", "01/03/2025"], "text", True), (["02/13/2025", "03/01/2025"], "text", False),
    (["5.3.2025"], "text", True), (["2025-03-05"], "text", False),
    (["45000", "45010"], "excel", False), (["1740000000", "1750000000"], "seconds", False),
    (["1740000000000"], "millis", False), (["20250305"], "text", False)])
def test_date_style(spark, cells, kind, day_first):
    df = spark.createDataFrame([(c,) for c in cells], "d string")
    style = detect_style(df, "d")
    assert (style.kind, style.day_first) == (kind, day_first)
    years = {r[0].year for r in df.select(parse_date(F.col("d"), style)).collect()}
    assert years <= {2023, 2025}


def test_profiled_shapes_parse_like_all_shapes(spark):
    cells = ["2025-03-05", "13/02/2025 10:00", "5 May 2025", "20250101", "01/02/2025 3:00 PM", "x", None]
    df = spark.createDataFrame([(c,) for c in cells], "d string")
    style = detect_style(df, "d")
    rows = df.select(parse_date(F.col("d"), style).alias("a"),
                     parse_text_date(F.col("d"), style.day_first).alias("b")).collect()
    assert [r.a for r in rows] == [r.b for r in rows]


@pytest.mark.parametrize("later,earlier,days", [
    ("2025-01-02 10:00", "2025-01-01 09:00", 1), ("2025-01-02 08:00", "2025-01-01 09:00", 0),
    ("2025-01-01 08:00", "2025-01-01 09:00", -1), ("2025-03-31 00:00", "2025-03-30 00:00", 1)])
def test_whole_days_floor(spark, later, earlier, days):
    df = spark.createDataFrame([(later, earlier)], "a string, b string")
    assert df.select(whole_days(F.col("a").cast("timestamp_ntz"),
                                F.col("b").cast("timestamp_ntz"))).first()[0] == days


def canonical(spark, rows, names, **kw):
    return canonicalize(spark.createDataFrame(rows, ", ".join(f"{n} string" for n in names)), **kw)


NAMES = ["customer_id", "order_id", "order_date", "quantity", "unit_price"]


def test_each_row_counts_at_its_first_failing_step(spark):
    rows = [("a", str(i), "2025-01-05", "1", "10") for i in range(47)]
    rows += [("", "x", "bad", "1", "10"), ("a", "x", "2025-01-05", "1", "?"),
             ("nan", "x", "2025-01-05", "1", "?")]
    report = {r.reason: r.rows for r in ingest_report(canonical(spark, rows, NAMES)).collect()}
    assert report == {"kept": 47, "unparseable date": 1, "unparseable price": 1,
                      "missing customer id": 1}


def test_cancellations_are_c_and_digits_only(spark):
    rows = [("a", "536365", "2025-01-01", "1", "10"), ("a", "C536366", "2025-01-02", "1", "10"),
            ("a", "CZ2025-1", "2025-01-02", "1", "10"), ("a", "7", "2025-01-02", "-1", "10"),
            ("a", "8", "2025-01-02", "1", "0")]
    ids = [r.order_id for r in kept(canonical(spark, rows, NAMES)).collect()]
    assert sorted(ids) == ["536365", "CZ2025-1"]


def test_total_wins_and_price_is_derived(spark):
    rows = [("c1", "2025-01-01", "30", "3"), ("c2", "2025-01-01", "", "3"), ("c3", "2025-01-01", "8", "")]
    out = kept(canonical(spark, rows, ["customer_id", "order_date", "line_value", "quantity"]))
    got = {r.customer_id: (r.order_id, r.unit_price, r.line_value) for r in out.collect()}
    assert got == {"c1": ("c1@2025-01-01", 10.0, 30.0), "c3": ("c3@2025-01-01", 8.0, 8.0)}


def test_null_order_ids_stay_apart(spark):
    rows = [("a", None, "2025-01-01", "1", "1"), ("b", None, "2025-01-02", "1", "1")]
    assert {r.order_id for r in kept(canonical(spark, rows, NAMES)).collect()} == {
        "a@2025-01-01", "b@2025-01-02"}


def test_required_columns(spark):
    with pytest.raises(UnusableInput):
        canonical(spark, [("a", "2025-01-01")], ["customer_id", "order_date"])
    with pytest.raises(UnusableInput):
        canonical(spark, [("a", "1")], ["customer_id", "unit_price"])
