"""Per-key aggregation that stays balanced when a few keys hold most rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SALTS = 64
HEAVY_SHARE = 0.002


def heavy_keys(df: DataFrame, key: str, share: float = HEAVY_SHARE) -> DataFrame:
    """(key) of the keys that hold more than ``share`` of all rows.

    At most 1/share keys can qualify, so the result is bounded by a parameter
    and safe to broadcast at any size of input.  The count is map-side combined.
    """
    counts = df.groupBy(key).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).where(F.col("n") > F.col("total") * F.lit(share)).select(key)


def salted_aggregate(df: DataFrame, key: str, spread: Column, partial: dict[str, Column], merge: dict[str, Column], salts: int = SALTS, share: float = HEAVY_SHARE) -> DataFrame:
    """Two-stage aggregation: rows of heavy keys get a salt, partials per (key, salt) are merged by key.

    ``spread`` decides the salt and must be the column whose equal values belong
    together (so that distinct counts per salt add up); light keys get salt 0.
    ``partial`` maps names to aggregates of rows, ``merge`` to aggregates of the
    partial columns.  A NULL key is a group of its own.
    """
    heavy = heavy_keys(df, key, share).select(F.col(key).alias("_key"), F.lit(True).alias("_heavy"))
    marked = df.join(F.broadcast(heavy), F.col(key).eqNullSafe(F.col("_key")), "left")
    salt = F.when(F.col("_heavy"), F.pmod(F.xxhash64(spread), F.lit(salts))).otherwise(F.lit(0)).cast("int")
    salted = marked.withColumn("_salt", salt).groupBy(key, "_salt").agg(*[c.alias(n) for n, c in partial.items()])
    return salted.groupBy(key).agg(*[c.alias(n) for n, c in merge.items()])
