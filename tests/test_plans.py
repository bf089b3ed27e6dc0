"""What the plans must and must not contain."""

from datetime import datetime

from pyspark.sql import functions as F

from tallyspark.operators import calendar, features, products, quality
from tallyspark.operators.canonical import canonicalize, kept
from tallyspark.plans.queries import MESSY_MAPPING, messy_lines
from tallyspark.plans.views import lines_events, lines_tpch, order_lines
from tallyspark.streaming.daily import daily_sales_stream


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_features_stay_in_the_jvm_without_global_windows(spark, folder):
    text = plan(features.customer_features(lines_tpch(spark, folder), datetime(2002, 1, 1)))
    assert "Python" not in text and "Window" not in text and "CartesianProduct" not in text


def test_every_input_is_read_once(spark, folder):
    """Counts, modes and sums come from one staged table of the lines."""
    lines = lines_tpch(spark, folder)
    assert plan(lines).count("Scan parquet") == 5
    cells = features.lattice(lines)
    for frame in (features.customer_features(lines, datetime(2002, 1, 1)),
                  quality.summary(lines, cells), quality.quality_inputs(lines)):
        assert "lineitem" not in plan(frame) and "orders.parquet" not in plan(frame)


def test_filters_and_columns_reach_the_scan(spark, folder):
    text = plan(calendar.daily_sales(order_lines(spark, folder)))
    assert "Not(EqualTo(l_returnflag,R))" in text
    assert "l_tax" not in text and "l_shipdate" not in text and "p_name" not in text
    assert "EqualTo(event_type,purchase)" in plan(lines_events(spark, folder))


def test_lines_collapse_before_the_first_shuffle(spark, folder):
    text = plan(features.order_rollup(order_lines(spark, folder)))
    assert "HashAggregate(keys=[order_id" in text
    assert text.index("partial_sum") > 0


def test_dates_are_parsed_once(spark, folder):
    out = kept(canonicalize(messy_lines(spark, folder), MESSY_MAPPING, ","))
    assert plan(out).count("try_cast(trim(CASE") == 1


def test_only_bounded_sides_are_broadcast_by_hint(spark, folder):
    seg = spark.range(1).select(F.lit("a").alias("customer_id"), F.lit("b").alias("segment"))
    text = products.product_mix(lines_tpch(spark, folder), seg)._jdf.queryExecution().logical().toString()
    assert text.count("strategy=broadcast") == 1 and "GlobalLimit 12" in text


def test_stream_equals_batch(spark, folder, tmp_path):
    lines_events(spark, folder).repartition(3).write.parquet(str(tmp_path / "in"))
    schema = lines_events(spark, folder).schema
    stream = daily_sales_stream(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), "60 days")
    run = (stream.writeStream.outputMode("complete").format("memory").queryName("daily")
           .option("checkpointLocation", str(tmp_path / "cp")).start())
    run.processAllAvailable()
    run.stop()
    got = {(r.date, r.revenue) for r in spark.table("daily").collect()}
    want = {(r.date, r.revenue) for r in calendar.daily_sales(lines_events(spark, folder)).collect()}
    assert got == want
