"""Concentration of counts: Lorenz curve, Gini, coverage and thresholds, from counts per value.

Documents with equal counts are interchangeable, so everything that needs a
running total works on (value, documents) pairs; their number grows with the
spread of the counts, not with the documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def value_counts(df: DataFrame, column: str) -> DataFrame:
    """(v, docs) of the non-negative counts; NULL counts as 0."""
    v = F.greatest(F.coalesce(F.col(column), F.lit(0)), F.lit(0)).cast("long")
    return df.select(v.alias("v")).groupBy("v").agg(F.count("*").alias("docs"))


def gini(values: DataFrame) -> DataFrame:
    """(docs, total, gini): 1 - 2 * area under the running shares, the curve starting at the first document.

    One document has 1, no documents or a total of 0 have 0.  Within documents of
    one value the running total is an arithmetic sequence, summed in closed form.
    """
    order = Window.orderBy("v")
    part = values.withColumn("mass", F.col("v").cast("double") * F.col("docs"))
    running = part.withColumn("before", F.coalesce(F.sum("mass").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    # Sum over the value's documents of (before + i * v), i = 1..docs.
    area = running.withColumn("area", F.col("docs") * F.col("before") + F.col("v").cast("double") * F.col("docs") * (F.col("docs") + 1) / 2)
    g = area.agg(F.coalesce(F.sum("docs"), F.lit(0)).alias("docs"), F.coalesce(F.sum("mass"), F.lit(0.0)).alias("total"), F.sum("area").alias("area"), F.min("v").alias("least"))
    share = F.try_divide(F.col("area"), F.col("total"))
    first = F.try_divide(F.col("least").cast("double"), F.col("total"))
    body = 1 - 2 * F.try_divide(share - (first + 1) / 2, (F.col("docs") - 1).cast("double"))
    return g.select("docs", F.col("total").cast("long").alias("total"), F.when(F.col("total") <= 0, 0.0).when(F.col("docs") == 1, 1.0).otherwise(body).alias("gini"))


def thresholds(values: DataFrame) -> DataFrame:
    """Comments covered by the top 1, 5 and 10 % of documents, and the share of documents that holds 50, 80, 90 and 95 % of comments."""
    back = Window.orderBy(F.desc("v"))
    upto = back.rowsBetween(Window.unboundedPreceding, -1)
    rows = values.select("v", "docs", F.coalesce(F.sum("docs").over(upto), F.lit(0)).alias("d0"), F.coalesce(F.sum(F.col("v") * F.col("docs")).over(upto), F.lit(0)).alias("m0"))
    total = values.agg(F.sum("docs").alias("n"), F.sum(F.col("v") * F.col("docs")).alias("total"))
    joined = rows.crossJoin(F.broadcast(total)).where("total > 0")
    out = []
    for t in (1, 5, 10):
        k = F.ceil(F.col("n") * F.lit(t / 100))
        inside = (F.col("d0") < k) & (k <= F.col("d0") + F.col("docs"))
        out.append(F.max(F.when(inside, (F.col("m0") + F.col("v") * (k - F.col("d0"))) / F.col("total").cast("double"))).alias(f"coverage_top_{t}pct_docs"))
    for t in (50, 80, 90, 95):
        need = F.col("total") * F.lit(t / 100)
        # Documents of this value whose running total stays below the target.
        below = F.when(F.col("v") == 0, F.when(F.col("m0") < need, F.col("docs")).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("docs"), F.ceil((need - F.col("m0")) / F.greatest(F.col("v"), F.lit(1))) - 1)))
        out.append(F.least(F.sum(below) + 1, F.max("n")).alias(f"k_{t}"))
    g = joined.agg(F.max("n").alias("n"), *out)
    return g.select(*[f"coverage_top_{t}pct_docs" for t in (1, 5, 10)], *[(F.col(f"k_{t}") / F.col("n")).alias(f"docs_share_for_{t}pct_comments") for t in (50, 80, 90, 95)])
