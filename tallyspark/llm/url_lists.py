"""URL filter: every capture against the list entries that were in force when it was fetched.

A list is a log of dated entries: on a day a host pattern is added to or removed from a
category. Entries of a pattern and category become intervals from an addition up to the next
entry. A capture is tested with its host and every parent domain. The as-of join is an
equi-join on (pattern, month) between the distinct (host, day) pairs, so a host with a third of
all captures is one row per day, and the intervals cut at month borders. The verdicts are then
joined back to the captures; that join has no aggregation behind it, so a hot (host, day) can
be split. Only column functions are used.

Defined results: a null URL, or one without a host, and a null day are kept and never blocked;
repeated captures each get their verdict; of entries for one pattern, category and day a
removal counts last; repeated entries count once; entries without pattern, category or day are
ignored. Empty captures give no rows, empty lists block nothing; very long URLs are read whole;
other columns of either table are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import column

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?(\[[^\]/?#@]*\]|[^/?#:@\[\]]+)"


def host_of(url: Column) -> Column:
    """Lower-case host of a URL without final dot, an address in brackets with them; null where
    there is none."""
    return F.nullif(F.regexp_replace(F.lower(F.regexp_extract(url, HOST, 1)), r"\.$", ""),
                    F.lit(""))


def month(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def intervals(entries: DataFrame, pattern: str = "pattern", category: str = "category",
              day: str = "day", action: str = "action") -> DataFrame:
    """(pattern, category, since, until): in force from ``since`` up to, not on, ``until``."""
    rows = (entries.select(F.lower(column(entries, pattern, "string")).alias("pattern"),
                           column(entries, category, "string").alias("category"),
                           column(entries, day, "date").alias("since"),
                           (column(entries, action, "string") == "add").alias("added"))
            .where("pattern is not null and category is not null and since is not null")
            .groupBy("pattern", "category", "since")
            .agg(F.min(F.coalesce("added", F.lit(False))).alias("added")))
    following = F.lead("since").over(Window.partitionBy("pattern", "category").orderBy("since"))
    return (rows.withColumn("until", F.coalesce(following, F.lit("9999-12-31").cast("date")))
            .where("added").select("pattern", "category", "since", "until"))


def judge_captures(captures: DataFrame, entries: DataFrame, id: str = "page_id",
                   url: str = "url", day: str = "day") -> DataFrame:
    """Per capture: id, url, day, host, blocked, the categories (comma list) and the most
    specific pattern that blocks it."""
    base = captures.select(column(captures, id, "long").alias("page_id"),
                           column(captures, url, "string").alias("url"),
                           column(captures, day, "date").alias("day"))
    base = base.withColumn("host", host_of(F.col("url")))
    asked = (base.where("host is not null and day is not null")
             .groupBy("host", "day").agg(F.lit(1).alias("one")).drop("one"))
    labels = F.split("host", r"\.")
    tested = asked.withColumn("pattern", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)),
        lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))))
    tested = tested.withColumn("month", month(F.col("day")))
    # An interval without end is cut at the last day that is asked for.
    last = asked.agg(F.max("day").alias("last"))
    active = (intervals(entries).join(F.broadcast(last), F.col("since") <= F.col("last"))
              .withColumn("month", F.explode(F.sequence(
                  month(F.col("since")), month(F.least("until", "last"))))))
    hits = tested.join(active.drop("last"), ["pattern", "month"]).where(
        "since <= day and day < until")
    verdicts = hits.groupBy("host", "day").agg(
        F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories"),
        F.max_by("pattern", F.length("pattern")).alias("pattern"))
    return (base.join(verdicts, ["host", "day"], "left")
            .select("page_id", "url", "day", "host", F.col("pattern").isNotNull().alias("blocked"),
                    F.coalesce("categories", F.lit("")).alias("categories"), "pattern"))
