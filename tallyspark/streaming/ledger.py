"""Order lines of a stream, booked batch by batch: daily sales, late lines, dropped rows.

Each micro-batch is written under its number: what its lines add to each (day, order), the lines
that came too late, and why rows were dropped. A mark written last makes the batch count. A batch
that is sent again is known by its mark; one that failed half-way has none, and its files are
replaced. What is read are the marked batches, so the tables are those of a run in one go however
often the stream was restarted.

A day is open until its end lies ``late_by`` behind the latest line of earlier batches. ``close``
turns the days that are over into plain daily rows; afterwards only the orders of open days are
read again, as with the state of a windowed aggregation.
"""

from __future__ import annotations

from datetime import date, datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import amount, sum_units
from ..operators.canonical import ingest_report, kept

MARK = "batch long, latest timestamp_ntz, closed date, base long"
SUMS = "day date, order_id string, units long, batch long"
REASONS = "reason string, rows long, batch long"
BASE = "day date, units long, orders long, base long"


class Ledger:
    """The booked batches below ``path``, a folder all executors reach."""

    def __init__(self, spark: SparkSession, path: str, late_by: timedelta = timedelta(days=2)):
        self.spark, self.path, self.late_by = spark, path.rstrip("/"), late_by

    def _read(self, kind: str, schema: str) -> DataFrame:
        """All files of a kind, whether or not their batch counts; none is an empty table."""
        folder = f"{self.path}/{kind}"
        jvm = self.spark.sparkContext._jvm
        there = jvm.org.apache.hadoop.fs.Path(folder)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        if not there.getFileSystem(conf).exists(there):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(folder)

    def _marks(self) -> list:
        """One row per batch: its number and its latest line."""
        return self._read("marks", MARK).orderBy("batch").collect()

    def _write(self, df: DataFrame, kind: str, partition: str) -> None:
        """Replaces the files of this batch alone."""
        (df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(partition).parquet(f"{self.path}/{kind}"))

    def _counted(self, kind: str, schema: str, numbers: list[int], name: str) -> DataFrame:
        counted = self.spark.createDataFrame([(n,) for n in numbers], f"{name} long")
        return self._read(kind, schema).join(F.broadcast(counted), name, "left_semi")

    @staticmethod
    def watermark(marks: list, late_by: timedelta) -> datetime | None:
        latest = [m.latest for m in marks if m.latest is not None]
        return max(latest) - late_by if latest else None

    def _too_late(self, marks: list) -> Column:
        seen, closed = self.watermark(marks, self.late_by), self.closed(marks)
        over = F.lit(False)
        if seen is not None:
            over = F.col("day") < F.lit(seen.date())
        return over if closed is None else over | (F.col("day") <= F.lit(closed))

    @staticmethod
    def closed(marks: list) -> date | None:
        return max((m.closed for m in marks if m.closed is not None), default=None)

    def book(self, lines: DataFrame, batch: int) -> bool:
        """Books canonical rows (with ``drop_reason``) as this batch; False if it was before."""
        marks = self._marks()
        if any(m.batch == batch and m.base is None for m in marks):
            return False
        earlier = [m for m in marks if m.batch < batch or m.base is not None]
        number = F.lit(batch).cast("long").alias("batch")
        lines = lines.persist()
        try:
            dated = kept(lines).withColumn("day", F.to_date("order_date"))
            late = F.coalesce(self._too_late(earlier), F.lit(False))
            self._write(ingest_report(lines).select("reason", "rows", number), "reasons", "batch")
            self._write(dated.where(late).withColumn("batch", number), "late", "batch")
            self._write(dated.where(~late).groupBy("day", "order_id").agg(
                sum_units(F.col("line_value")).alias("units")).select(
                "day", "order_id", "units", number), "sums", "batch")
            latest = dated.agg(F.max("order_date").cast("timestamp_ntz")).first()[0]
        finally:
            lines.unpersist()
        self._mark(batch, latest, None, None)
        return True

    def _mark(self, batch, latest, closed, base) -> None:
        self.spark.createDataFrame([(batch, latest, closed, base)], MARK).coalesce(1).write.mode(
            "append").parquet(f"{self.path}/marks")

    def sink(self, canonicalize=None):
        """For ``writeStream.foreachBatch``; ``canonicalize`` makes raw rows canonical."""
        def add(rows: DataFrame, batch: int) -> None:
            self.book(canonicalize(rows) if canonicalize else rows, batch)
        return add

    def _batches(self, marks: list) -> list[int]:
        return sorted({m.batch for m in marks if m.base is None})

    def _open(self, marks: list) -> DataFrame:
        """(day, units, orders) of the days that are not closed: orders first, so that an order
        whose lines came in several batches is one."""
        sums = self._counted("sums", SUMS, self._batches(marks), "batch")
        closed = self.closed(marks)
        if closed is not None:
            sums = sums.where(F.col("day") > F.lit(closed))
        return (sums.groupBy("day", "order_id").agg(F.sum("units").alias("units"))
                .groupBy("day").agg(F.sum("units").alias("units"),
                                    F.count(F.lit(1)).alias("orders")))

    def _all_days(self, marks: list) -> DataFrame:
        bases = [m.base for m in marks if m.base is not None]
        done = self._counted("base", BASE, [max(bases)] if bases else [], "base")
        return done.select("day", "units", "orders").unionByName(self._open(marks))

    def close(self) -> date | None:
        """Writes the days that are over as daily rows; the last of them, None without any."""
        marks = self._marks()
        seen = self.watermark(marks, self.late_by)
        if seen is None:
            return None
        last = seen.date() - timedelta(days=1)
        if self.closed(marks) is not None and self.closed(marks) >= last:
            return self.closed(marks)
        base = max((m.base for m in marks if m.base is not None), default=0) + 1
        over = self._all_days(marks).where(F.col("day") <= F.lit(last))
        self._write(over.withColumn("base", F.lit(base).cast("long")), "base", "base")
        self._mark(max(self._batches(marks)), None, last, base)
        return last

    def daily_sales(self) -> DataFrame:
        """(date, revenue, orders) of all days, open ones as far as they are booked."""
        return self._all_days(self._marks()).select(
            F.col("day").alias("date"), amount(F.col("units")).alias("revenue"), "orders")

    def late_lines(self) -> DataFrame:
        """(day, lines, revenue): what came after its day was over."""
        late = self._counted("late", "day date, line_value double, batch long",
                             self._batches(self._marks()), "batch")
        return late.groupBy("day").agg(
            F.count(F.lit(1)).alias("lines"), amount(sum_units(F.col("line_value"))).alias("revenue"))

    def ingest_report(self) -> DataFrame:
        """(reason, rows) over all batches."""
        return (self._counted("reasons", REASONS, self._batches(self._marks()), "batch")
                .groupBy("reason").agg(F.sum("rows").alias("rows")))
