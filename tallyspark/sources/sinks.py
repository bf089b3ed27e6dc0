"""Result tables, audience files, CSV for spreadsheets, snapshot history."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import UnusableInput
from ..functions.text import formula_safe
from ..session import stage


def write_tables(tables: dict[str, DataFrame], path: str) -> None:
    """One parquet table per result below ``path``."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


RECIPIENT = "customer_id string, email string, name string, audience string"


def write_audiences(recipients: DataFrame, path: str, rows_per_file: int = 100_000) -> None:
    """Recipient rows as JSON lines, one folder per audience, in files of about even size.

    An audience gets as many files as it has times ``rows_per_file``, dealt by a hash of the row,
    so a large one is written by many tasks and a small one is not torn apart.
    """
    recipients = stage(recipients, "recipients")
    files = recipients.groupBy(F.col("audience").alias("of")).agg(
        F.ceil(F.count(F.lit(1)) / F.lit(rows_per_file)).cast("int").alias("files"))
    total = files.agg(F.sum("files")).first()[0] or 1
    dealt = (recipients.join(F.broadcast(files), F.col("audience").eqNullSafe(F.col("of")))
             .withColumn("file", F.pmod(F.xxhash64(*recipients.columns), F.col("files"))))
    (dealt.repartition(total, "audience", "file").drop("of", "files", "file")
     .write.mode("overwrite").option("maxRecordsPerFile", 2 * rows_per_file)
     .partitionBy("audience").json(path))


def read_audiences(spark: SparkSession, path: str) -> DataFrame:
    """The recipients of all audience files below ``path``."""
    return spark.read.schema(RECIPIENT).json(path).select(
        "audience", "customer_id", "email", "name")


def write_csv(df: DataFrame, path: str) -> None:
    """CSV whose text cells no spreadsheet runs as a formula."""
    safe = [formula_safe(F.col(f.name)).alias(f.name)
            if isinstance(f.dataType, T.StringType) else F.col(f.name) for f in df.schema]
    df.select(*safe).write.mode("overwrite").csv(path, header=True, escape='"')


def new_run_id() -> str:
    """Sorts by time, also within one second."""
    return datetime.now(timezone.utc).strftime("%Y%m%d-%H%M%S-%f")


def write_snapshot(scored: DataFrame, path: str, run_id: str, date_to: str) -> None:
    """The segments of one run, as partition ``run_id`` of the history. They do not count before
    the run is committed; a run that is written again replaces its own partition alone."""
    (scored.select("customer_id", "segment", F.lit(date_to).alias("date_to"),
                   F.lit(run_id).alias("run_id"))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("run_id").parquet(f"{path}/segments"))


def commit_run(spark: SparkSession, path: str, run_id: str) -> None:
    """From now on readers see this run; committing it again changes nothing."""
    spark.createDataFrame([(run_id,)], "run string").withColumn("run_id", F.lit(run_id)).coalesce(
        1).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "run_id").parquet(f"{path}/runs")


def append_snapshot(scored: DataFrame, path: str, run_id: str, date_to: str) -> None:
    """Add the segments of one run to the history table and commit the run."""
    write_snapshot(scored, path, run_id, date_to)
    commit_run(scored.sparkSession, path, run_id)


def committed_runs(spark: SparkSession, path: str) -> list[str]:
    """The runs whose segments are whole, oldest first."""
    try:
        runs = spark.read.schema("run string, run_id string").parquet(f"{path}/runs")
    except AnalysisException as error:
        if error.getCondition() == "PATH_NOT_FOUND":
            return []
        raise
    return sorted(r["run_id"] for r in runs.select("run_id").distinct().collect())


def snapshot(spark: SparkSession, path: str, run_id: str) -> DataFrame:
    """The segments of a committed run. Only its partition is read."""
    if run_id not in committed_runs(spark, path):
        raise UnusableInput(f"no committed run {run_id!r}")
    schema = "customer_id string, segment string, date_to string, run_id string"
    return spark.read.schema(schema).parquet(f"{path}/segments").where(F.col("run_id") == run_id)


def previous_snapshot(spark: SparkSession, path: str, run_id: str) -> DataFrame | None:
    """The latest earlier committed run of the history, or None."""
    earlier = [r for r in committed_runs(spark, path) if r < run_id]
    return snapshot(spark, path, earlier[-1]) if earlier else None
