"""Order lines of the given tables, written as text in many dialects, must read back the same."""

import datetime

import duckdb
import pytest
from pyspark.sql import functions as F

from tallyspark.errors import UnusableInput
from tallyspark.operators.canonical import ingest_report, kept
from tallyspark.sources.dialects import dialect_profile, repaired_names
from tallyspark.sources.dispatch import describe_exports, load, load_exports
from tallyspark.sources.factor_table import read_factors

LINES = duckdb.sql("""
    SELECT 'c' || o_custkey, 'n' || o_orderkey, CAST(o_orderdate AS DATE), CAST(l_quantity AS INT),
           CAST(round(l_extendedprice / l_quantity, 2) AS DOUBLE)
    FROM '/root/testdata/sf0.001/lineitem.parquet'
    JOIN '/root/testdata/sf0.001/orders.parquet' ON l_orderkey = o_orderkey
    ORDER BY l_orderkey, l_linenumber LIMIT 240""").fetchall()
TOTAL = sum(q * p for _, _, _, q, p in LINES)


def grouped(value, thousands, decimal):
    text = f"{value:,.2f}"
    return text.replace(",", "~").replace(".", decimal).replace("~", thousands)


def layout(first, row, codec="utf-8"):
    return codec, first, row


LAYOUTS = {
    "plain": layout("client,invoice,created,pieces,price",
                    lambda c, o, d, q, p: f"{c},{o},{d},{q},{p}"),
    "czech_bytes": layout("klient;doklad;čas;počet;cena",
                          lambda c, o, d, q, p: f"{c};{o};{d:%d.%m.%Y};{q};{grouped(p, ' ', ',')} Kč",
                          "cp1250"),
    "marked_utf8": layout("kunde;bestellung;zeit;menge;preis",
                          lambda c, o, d, q, p: f"{c};{o};{d:%d.%m.%Y} 08:15;{q};{grouped(p, '.', ',')}",
                          "utf-8-sig"),
    "sums_only": layout("buyer|order|day created|total",
                        lambda c, o, d, q, p: f"{c}|{o}|{d}|{q * p:.2f}"),
    "no_orders": layout("buyer\tday created\ttotal", lambda c, o, d, q, p: f"{c}\t{d}\t{q * p:.2f}"),
    "titles": layout("Report of the year\nprinted on 3.4.1999\n;;;;\nclient;invoice;created;qty;price",
                     lambda c, o, d, q, p: f"{c};{o};{d};{q};{p}"),
    "serial_days": layout("client,invoice,created,qty,price", lambda c, o, d, q, p: (
        f"{c},{o},{(d - datetime.date(1899, 12, 30)).days},{q},{p}")),
    "comma_prices_dotted_days": layout(
        "client,invoice,created,sent date,qty,price", lambda c, o, d, q, p: (
            f'{c},{o},{d:%d.%m.%Y},{d:%d.%m.%Y},{q},"{p:.2f}"'.replace(f"{p:.2f}", grouped(p, "", ",")))),
    "repeated_names": layout("client,invoice,created,qty,price,,price",
                             lambda c, o, d, q, p: f"{c},{o},{d},{q},{p},-,{p}"),
    "short_and_long_rows": layout("client|invoice|created|qty|price|note", lambda c, o, d, q, p: (
        f"{c}|{o}|{d}|{q}|{p}" + ("|first" if (c, o, d, q, p) == LINES[0] else "" if q % 2 else "|a|b"))),
    "quotes": layout("client,invoice,created,qty,price,item", lambda c, o, d, q, p: (
        f'{c},{o},{d},{q},{p},"27"" screen, new\nin its box"')),
}


def put(path, name, lines=LINES):
    codec, first, row = LAYOUTS[name]
    path.write_bytes("\n".join([first, *(row(*x) for x in lines), "", ""]).encode(codec))
    return str(path)


def facts(frame):
    r = kept(frame).agg(
        F.count("*").alias("n"), F.countDistinct("customer_id").alias("c"),
        F.sum("line_value").alias("v"), F.min(F.to_date("order_date")).alias("a"),
        F.max(F.to_date("order_date")).alias("b")).first()
    return r.n, r.c, round(r.v, 1), r.a, r.b


EXPECTED = (len(LINES), len({x[0] for x in LINES}), round(TOTAL, 1), min(x[2] for x in LINES),
            max(x[2] for x in LINES))


@pytest.mark.parametrize("name", sorted(LAYOUTS))
def test_every_layout_gives_the_same_lines(spark, tmp_path, name):
    frame = load_exports(spark, put(tmp_path / "a.csv", name))
    got = facts(frame)
    assert got[:2] + got[3:] == EXPECTED[:2] + EXPECTED[3:]
    assert abs(got[2] - TOTAL) < 1
    if name == "quotes":
        assert kept(frame).select("product").distinct().first()[0] == '27" screen, new\nin its box'


def test_files_that_differ_in_titles_are_one_dialect(spark, tmp_path):
    for k in range(4):
        head, rest = LAYOUTS["titles"][1].split("\n", 1)
        (tmp_path / f"{k}.csv").write_text("\n".join(
            [f"{head} {k}", rest, *(LAYOUTS["titles"][2](*x) for x in LINES[k::4])]))
    frame = load_exports(spark, str(tmp_path))
    assert abs(facts(frame)[2] - TOTAL) < 1 and facts(frame)[0] == len(LINES)
    assert "Union" not in frame._jdf.queryExecution().optimizedPlan().toString()


def test_dialects_of_a_folder_become_one_frame(spark, tmp_path):
    for name in ("plain", "czech_bytes", "no_orders"):
        put(tmp_path / f"{name}.csv", name)
    assert kept(load_exports(spark, str(tmp_path))).count() == 3 * len(LINES)


def test_one_description_per_dialect(spark, tmp_path):
    put(tmp_path / "a.csv", "czech_bytes")
    put(tmp_path / "b.csv", "comma_prices_dotted_days")
    (tmp_path / "c.csv").write_text("client,price\nx,1.5\ny,2.5\n")
    rows = sorted(describe_exports(spark, str(tmp_path)).collect(), key=lambda r: r.table)
    assert [(r.delimiter, r.decimal, r.currency, r.language, r.missing) for r in rows] == [
        (";", ",", "Kč", "cs", ""), (",", ",", "", "en", ""), (",", ".", "", "en", "order_date")]
    assert rows[0].mapping["unit_price"] == "cena" and rows[0].encoding == "cp1250"


def test_the_callers_decimal_mark_counts(spark, tmp_path):
    (tmp_path / "a.csv").write_text("client,created,price\nx,2024-01-02,1.250\ny,2024-01-03,2.500\n")
    values = [r.line_value for r in kept(load(spark, "file", path=str(tmp_path), decimal=","))
              .orderBy("customer_id").collect()]
    assert values == [1250.0, 2500.0]


def test_unusable_cells_get_a_reason(spark, tmp_path):
    path = put(tmp_path / "a.csv", "plain")
    with open(path, "a") as f:
        f.write(f"x,n1,no day,1,10\nx,n2,2024-01-01,1,{'9' * 20}\nx,n3,2024-01-01,1,none\n"
                "  \t,n4,2024-01-01,1,1\n c1\t,z5,\t2024-01-01,1,1\n")
    report = {r.reason: r.rows for r in ingest_report(load_exports(spark, path)).collect()}
    assert report["kept"] == len(LINES) + 1 and report["unparseable date"] == 1
    assert sum(report.values()) == len(LINES) + 5
    ids = kept(load_exports(spark, path)).where("order_id = 'z5'").select("customer_id").first()[0]
    assert ids == "c1"


def test_profile(spark, tmp_path):
    put(tmp_path / "a.csv", "titles")
    put(tmp_path / "b.csv", "czech_bytes")
    (tmp_path / "c.csv").write_bytes(b"name;value\n\x81\xe1;1\nx;2\n")
    rows = {r.file[-5:]: r for r in dialect_profile(spark, str(tmp_path)).collect()}
    assert (rows["a.csv"].skipped_rows, rows["a.csv"].encoding) == (2, "utf-8")
    assert (rows["b.csv"].encoding, rows["b.csv"].delimiter) == ("cp1250", ";")
    assert rows["b.csv"].columns[3] == "počet"
    assert rows["c.csv"].encoding == "latin-1"


def test_header_names(spark):
    frame = spark.createDataFrame([("f", ["a", " ", "a", "b", "a"])], "file string, cells array<string>")
    assert repaired_names(frame).first().columns == ["a", "col2", "a_2", "b", "a_3"]


def test_unusable_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text("just one line, no data")
    with pytest.raises(UnusableInput):
        load_exports(spark, str(tmp_path))
    (tmp_path / "a.csv").write_text("client,created\nx,2025-01-01\ny,2025-01-02\n")
    with pytest.raises(UnusableInput):
        load_exports(spark, str(tmp_path))


def test_first_factor_of_a_day_is_the_first_read(spark, tmp_path):
    (tmp_path / "a.csv").write_text("date,rain\n2024-01-01,1\n2024-01-02,5\n")
    (tmp_path / "b.csv").write_text("date,rain\n2024-01-01,2\n" + "2024-01-03,7\n" * 3000)
    rows = {str(r.date): r.rain for r in read_factors(spark, str(tmp_path)).collect()}
    assert rows == {"2024-01-01": 1.0, "2024-01-02": 5.0, "2024-01-03": 7.0}
