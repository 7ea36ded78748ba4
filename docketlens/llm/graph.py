"""Connected components over an edge table, by hash-to-min with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlens.session import discard, spill


def components(edges: DataFrame, name: str) -> DataFrame:
    """(node, component): the least node reachable over edges (a, b).

    Alternates large-star and small-star steps (each one aggregation over the
    edge table), which end after a number of rounds logarithmic in the longest
    path; every round is written to the shared folder, nothing is collected but
    one row of counts.  An empty edge table gives an empty result.
    """
    current = spill(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), f"{name}-0")
    before = None
    for round_ in range(1, 40):
        both = current.select("u", "v").unionAll(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.distinct()
        small_min = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_min, "u")
        star = small.select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        after = spill(star, f"{name}-{round_}")
        mark = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        discard(current)
        current = after
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError("components did not settle in 40 rounds")
    roots = current.select(F.col("v").alias("node"), F.col("v").alias("component"))
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).unionAll(roots).distinct()
