"""A stream booked in batches gives what one run gives, whatever is sent again or too late."""

from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import calendar
from tallyspark.operators.canonical import REASON, ingest_report, kept
from tallyspark.streaming.daily import daily_orders_stream
from tallyspark.streaming.ledger import Ledger


@pytest.fixture
def arrived(lines):
    """Canonical rows with a reason; some dropped, an order in several batches."""
    def make(rows):
        frame = lines([("c", o, d, 1.0, float(v), "p", "x") for o, d, v in rows])
        return frame.withColumn(REASON, F.when(F.col("line_value") < 0, "non-positive price"))
    return make


BATCHES = [
    [("o1", "2025-01-01 10:00", 10), ("o2", "2025-01-01 11:00", 5), ("o3", "2025-01-02 09:00", -1)],
    [("o1", "2025-01-01 12:00", 2), ("o4", "2025-01-03 09:00", 7), ("o9", "2025-01-08 00:10", 1)],
    [("o5", "2025-01-01 09:00", 100), ("o6", "2025-01-07 09:00", 3)],
]


def daily(frame):
    return sorted((str(r.date), r.revenue, r.orders) for r in frame.collect())


def test_batches_are_counted_once(spark, tmp_path, arrived):
    ledger = Ledger(spark, str(tmp_path), timedelta(days=2))
    assert ledger.daily_sales().collect() == [] and ledger.close() is None
    assert ledger.book(arrived(BATCHES[0]), 0) and not ledger.book(arrived(BATCHES[0]), 0)
    # Batch 1 ended half-way: files, but no mark. It is sent again with what it had.
    Ledger(spark, str(tmp_path))._write(arrived(BATCHES[2]).select(
        F.to_date("order_date").alias("day"), "order_id", F.lit(5).cast("long").alias("units"),
        F.lit(1).cast("long").alias("batch")), "sums", "batch")
    assert daily(ledger.daily_sales()) == [("2025-01-01", 15.0, 2)]
    assert ledger.book(arrived(BATCHES[1]), 1)
    # The day of o5 ended more than two days before o9, which came a batch earlier.
    assert ledger.book(arrived(BATCHES[2]), 2)
    want = [("2025-01-01", 17.0, 2), ("2025-01-03", 7.0, 1), ("2025-01-07", 3.0, 1),
            ("2025-01-08", 1.0, 1)]
    assert daily(ledger.daily_sales()) == want
    assert [(str(r.day), r.lines, r.revenue) for r in ledger.late_lines().collect()] == [
        ("2025-01-01", 1, 100.0)]
    on_time = arrived([r for k, b in enumerate(BATCHES) for r in b if r[0] != "o5"])
    assert daily(calendar.daily_sales(kept(on_time))) == want
    every = arrived([r for b in BATCHES for r in b])
    assert sorted(map(tuple, ledger.ingest_report().collect())) == sorted(
        map(tuple, ingest_report(every).collect()))
    # Closed days become rows, and stay what they were; what comes for them is late.
    assert str(ledger.close()) == "2025-01-05" and str(ledger.close()) == "2025-01-05"
    assert daily(ledger.daily_sales()) == want
    assert ledger.book(arrived([("o7", "2025-01-05 23:00", 9), ("o8", "2025-01-08 23:00", 9)]), 3)
    assert daily(ledger.daily_sales()) == want[:3] + [("2025-01-08", 10.0, 2)]
    assert sum(r.lines for r in ledger.late_lines().collect()) == 2


def test_a_stream_through_restarts(spark, tmp_path, folder, arrived):
    """Files one by one through two queries with one checkpoint: the result of one batch run."""
    for k, some in enumerate(BATCHES[:2]):
        arrived(some).coalesce(1).write.parquet(str(tmp_path / "in" / f"part={k}"))
    ledger = Ledger(spark, str(tmp_path / "ledger"), timedelta(days=365))
    schema = arrived(BATCHES[0]).schema

    def run():
        (spark.readStream.schema(schema).option("maxFilesPerTrigger", 1)
         .parquet(str(tmp_path / "in")).drop("part").writeStream.foreachBatch(ledger.sink())
         .option("checkpointLocation", str(tmp_path / "offsets"))
         .trigger(availableNow=True).start().awaitTermination())

    run()
    arrived(BATCHES[2]).coalesce(1).write.parquet(str(tmp_path / "in" / "part=2"))
    run()
    run()
    every = kept(arrived([r for b in BATCHES for r in b]))
    assert daily(ledger.daily_sales()) == daily(calendar.daily_sales(every))
    assert ledger.late_lines().collect() == []


def test_stateful_days_and_orders(spark, tmp_path, arrived):
    """Days that the watermark has passed, with their distinct orders."""
    out, source = str(tmp_path / "out"), str(tmp_path / "in")
    rows = [("o1", "2025-01-01 10:00", 10), ("o1", "2025-01-01 12:00", 2),
            ("o2", "2025-01-01 11:00", 5), ("o4", "2025-01-03 09:00", 7)]
    for k, some in enumerate((rows, [("o9", "2025-02-08 00:10", 1)], [("o9", "2025-02-09 00:10", 1)])):
        kept(arrived(some)).coalesce(1).write.parquet(f"{source}/part={k}")
    stream = (spark.readStream.schema(kept(arrived(rows)).schema)
              .option("maxFilesPerTrigger", 1).parquet(source).drop("part"))
    (daily_orders_stream(stream).writeStream.format("parquet").option("path", out)
     .option("checkpointLocation", str(tmp_path / "offsets")).outputMode("append")
     .trigger(availableNow=True).start().awaitTermination())
    got = spark.read.parquet(out)
    assert daily(got) == daily(calendar.daily_sales(kept(arrived(rows))))
    assert got.where("orders = 2").first().lines == 3
