"""Equi-joins whose left side may have a hot key, without relying on session settings.

A mergeable sketch of the key's hashes (fixed size, one pass) tells the keys that hold more
than a task's fair share of the left rows. Their left rows are dealt to several salts by a hash
of the whole row, the matching right rows are copied to those salts, and everything else keeps
salt 0: one join, in which no task gets more than about its share. The salt of a row depends on
the row alone, so a task that is run again deals its rows as before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Keys the sketch tracks, and the most that can be hot (each holds a share above 1 / HOT).
TRACKED, HOT = 4096, 512


def _hash(df: DataFrame, keys: list[str]) -> Column:
    return F.xxhash64(*[df[f"`{k}`"] for k in keys])


def hot_keys(df: DataFrame, keys: list[str], tasks: int) -> dict[int, int]:
    """Hash of each hot key -> the number of salts its rows are dealt to.

    Hot is a key with more than half of a task's fair share, ``rows / tasks``. The sketch
    overcounts by at most ``rows / (0.75 * TRACKED)``, so none is missed.
    """
    least = min(HOT, 2 * tasks)
    top = f"approx_top_k(h, {least}, {TRACKED})"
    row = df.select(_hash(df, keys).alias("h")).agg(
        F.count(F.lit(1)).alias("n"), F.expr(top).alias("top")).first()
    if not row["n"]:
        return {}
    share = row["n"] / tasks
    return {x["item"]: min(tasks, -(-2 * x["count"] // max(1, round(share)))) for x in row["top"]
            if x["item"] is not None and x["count"] > share / 2}


def _dealable(df: DataFrame) -> list[str]:
    """Columns a row can be hashed by."""
    return [f.name for f in df.schema.fields
            if not isinstance(f.dataType, (T.MapType, T.VariantType))]


def hot_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left",
             tasks: int | None = None) -> DataFrame:
    """``left.join(right, keys, how)`` for how in inner, left, left_semi, left_anti.

    ``right`` may have any number of rows per key. Null keys match nothing; in a left join
    they stay, dealt out like those of a hot key. ``tasks`` is the number of shuffle partitions
    unless given. Equal left rows cannot be told apart and share a salt.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a hot left key cannot be salted in a {how} join")
    spark = left.sparkSession
    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    hot = hot_keys(left, keys, tasks)
    if not hot:
        return left.join(right, keys, how)
    # Names that neither side has.
    salt = "salt"
    while salt in left.columns or salt in right.columns:
        salt += "_"
    salts = F.create_map(*[F.lit(x).cast("int" if k % 2 else "long")
                           for k, x in enumerate(y for pair in hot.items() for y in pair)])

    def many(df: DataFrame) -> Column:
        return F.coalesce(F.try_element_at(salts, _hash(df, keys)), F.lit(1))

    spread = F.pmod(F.xxhash64(F.lit(7), *[left[f"`{c}`"] for c in _dealable(left)]), many(left))
    dealt = left.withColumn(salt, spread.cast("int"))
    copied = right.withColumn(salt, F.explode(F.sequence(F.lit(0), many(right) - 1)))
    return dealt.join(copied, [*keys, salt], how).drop(salt)
