"""Total orders over tables of any size: ranks, running totals and smoothing without a one-task window.

Rows are range-partitioned by the order, each partition is scanned on its own,
and what the partitions before it hold is added from a table with one row per
partition (bounded by the number of shuffle partitions, hence broadcast).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens.session import spill


def ranked(df: DataFrame, order: list[Column], sums: list[str] | None = None, name: str = "ranked") -> DataFrame:
    """Adds ``rank`` (1..n in the given order) and ``cum_<c>`` for every column c of ``sums``.

    The order must be total (end with a unique key), else ties fall in any
    order.  NULLs in summed columns count as 0; an empty table stays empty.
    """
    sums = sums or []
    cut = df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id())
    # Written once: the range bounds are sampled, so that a second run could cut elsewhere.
    cut = spill(cut, name)
    within = Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = cut.select("*", F.count(F.lit(1)).over(within).alias("_rank"), *[F.sum(F.coalesce(c, F.lit(0))).over(within).alias(f"_cum_{c}") for c in sums])
    parts = cut.groupBy("_part").agg(F.count("*").alias("_n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(f"_s_{c}") for c in sums])
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_n0"), *[F.coalesce(F.sum(f"_s_{c}").over(before), F.lit(0)).alias(f"_o_{c}") for c in sums])
    out = local.join(F.broadcast(offsets), "_part")
    return out.select(*df.columns, (F.col("_rank") + F.col("_n0")).alias("rank"), *[(F.col(f"_cum_{c}") + F.col(f"_o_{c}")).alias(f"cum_{c}") for c in sums])


def smoothed(df: DataFrame, values: list[str], share: float, least: int = 3) -> DataFrame:
    """Centred moving averages over ``rank`` with repeated edge values: adds ``smooth_<v>``.

    ``df`` comes from ``ranked`` with running totals of the values.  The window
    has ``share`` of the rows (at least ``least``, made odd); its sum is the
    difference of two running totals, looked up by rank with two joins.
    """
    size = df.agg(F.count("*").alias("n"), *[F.max(F.when(F.col("rank") == 1, F.col(v))).alias(f"_first_{v}") for v in values])
    last = df.join(F.broadcast(size.select("n")), F.col("rank") == F.col("n")).select(*[F.col(v).alias(f"_last_{v}") for v in values])
    odd = F.greatest(F.lit(least), F.floor(F.col("n") * F.lit(share)).cast("long"))
    odd = odd + F.when(odd % 2 == 0, 1).otherwise(0)
    info = size.crossJoin(last).withColumn("_size", odd).withColumn("_h", F.floor(F.col("_size") / 2).cast("long"))
    base = df.crossJoin(F.broadcast(info))
    base = base.withColumn("_hi", F.least(F.col("rank") + F.col("_h"), F.col("n"))).withColumn("_lo", F.greatest(F.col("rank") - F.col("_h"), F.lit(1)) - 1)
    high = df.select(F.col("rank").alias("_hi"), *[F.col(f"cum_{v}").alias(f"_hi_{v}") for v in values])
    low = df.select(F.col("rank").alias("_lo"), *[F.col(f"cum_{v}").alias(f"_lo_{v}") for v in values])
    both = base.join(high, "_hi").join(low, "_lo", "left")
    before = F.greatest(F.lit(0), F.col("_h") - F.col("rank") + 1)
    after = F.greatest(F.lit(0), F.col("rank") + F.col("_h") - F.col("n"))
    smooth = lambda v: (F.col(f"_hi_{v}") - F.coalesce(f"_lo_{v}", F.lit(0.0)) + before * F.col(f"_first_{v}") + after * F.col(f"_last_{v}")) / F.col("_size")
    return both.select(*df.columns, *[smooth(v).alias(f"smooth_{v}") for v in values])
