import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).resolve().parent.parent))

from tallyspark.session import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build_session("tests", "local[4]", **{
        "spark.sql.shuffle.partitions": "4", "spark.ui.enabled": "false",
        "spark.driver.memory": "4g", "spark.ui.showConsoleProgress": "false"})
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def folder():
    return "/root/testdata/sf0.001"


@pytest.fixture
def lines(spark):
    """Canonical order lines from (customer, order, date, quantity, price, product, country)."""
    def make(rows, extra=()):
        names = ["customer_id", "order_id", "day", "quantity", "unit_price", "product",
                 "country", *extra]
        return (spark.createDataFrame(rows, names)
                .selectExpr("*", "cast(day as timestamp_ntz) as order_date",
                            "quantity * unit_price as line_value").drop("day"))
    return make
