"""Reproducible sampling: hash-ranked draws per group, two-stage plans, weighted draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens.functions import exprs as X

SEED, SALTS = 42, 32


def draw_per_group(df: DataFrame, groups: list[str], key: str, size: Column, seed: int = SEED) -> DataFrame:
    """The ``size`` rows of each group that come first by MD5 of seed and key.

    Ranked twice: first within a salt of the group, which keeps at most ``size``
    rows each, then within the group; so a group that holds a third of all rows
    is never in one task.  ``size`` may be a column of the group; where it is
    not below the number of rows all are kept.
    """
    marked = df.withColumn("_draw", X.draw_key(seed, key)).withColumn("_size", size).withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    first = F.row_number().over(Window.partitionBy(*groups, "_salt").orderBy("_draw"))
    kept = marked.withColumn("_r", first).where(F.col("_r") <= F.col("_size"))
    second = F.row_number().over(Window.partitionBy(*groups).orderBy("_draw"))
    return kept.withColumn("_r", second).where(F.col("_r") <= F.col("_size")).drop("_draw", "_size", "_salt", "_r")


def strata(documents: DataFrame) -> DataFrame:
    """Per agency and size class: documents, comments and the comments wanted."""
    rows = documents.withColumn("comment_bin", X.comment_bin("comment_count"))
    g = rows.groupBy("agency", "comment_bin").agg(F.count("*").alias("num_docs"), F.sum("comment_count").alias("total_comments"))
    return g.withColumn("target_comments", X.sample_size(F.col("total_comments")))


def sampled_documents(documents: DataFrame, seed: int = SEED) -> DataFrame:
    """First stage: all documents of a small stratum (10 documents or 25 comments), else the square root of their number, at least three."""
    rows = documents.withColumn("comment_bin", X.comment_bin("comment_count"))
    small = (F.col("num_docs") <= 10) | (F.col("total_comments") <= 25)
    wanted = F.when(small, F.col("num_docs")).otherwise(F.least(F.col("num_docs"), F.greatest(F.ceil(F.sqrt("num_docs")), F.lit(3))))
    plan = strata(documents).withColumn("take", wanted)
    joined = rows.join(plan.withColumnRenamed("agency", "_a").withColumnRenamed("comment_bin", "_b"), F.col("agency").eqNullSafe(F.col("_a")) & (F.col("comment_bin") == F.col("_b"))).drop("_a", "_b")
    return draw_per_group(joined, ["agency", "comment_bin"], "document_number", F.col("take"), seed)


def sampled_comments(documents: DataFrame, ids: DataFrame, seed: int = SEED) -> DataFrame:
    """Second stage: comments of the sampled documents, per document in proportion to the stratum's target; all where the stratum has no more."""
    drawn = sampled_documents(documents, seed).select("document_number", "agency", "comment_bin", "target_comments")
    found = ids.join(drawn, "document_number")
    per_document = found.groupBy("document_number", "agency", "comment_bin", "target_comments").agg(F.count("*").alias("have"))
    within = Window.partitionBy("agency", "comment_bin")  # one row per document
    sized = per_document.withColumn("stratum", F.sum("have").over(within))
    rate = F.col("target_comments") / F.col("stratum")
    take = F.when(F.col("stratum") <= F.col("target_comments"), F.col("have")).otherwise(F.least(F.col("have"), F.greatest(F.lit(1), F.floor(F.col("have") * rate))))
    return draw_per_group(ids.join(sized.select("document_number", take.alias("take")), "document_number"), ["document_number"], "comment_id", F.col("take"), seed).select("document_number", "comment_id")


def pilot_size(vectors: DataFrame, key: str, vector: str, pilot: int = 500, z: float = 3.291, error: float = 0.05, seed: int = SEED) -> DataFrame:
    """Sample size from the spread of vector norms in a pilot, corrected for the population; one for no spread."""
    total = vectors.agg(F.count("*").alias("population"))
    norm = F.sqrt(F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    chosen = vectors.select(X.draw_key(seed, key).alias("o"), norm.alias("norm")).orderBy("o").limit(pilot)
    sigma = chosen.agg(F.coalesce(F.stddev_pop("norm"), F.lit(0.0)).alias("sigma"))
    g = total.crossJoin(F.broadcast(sigma))
    n = F.lit(z * z) * F.col("sigma") * F.col("sigma") / F.lit(error * error)
    corrected = F.ceil(n / (1 + (n - 1) / F.greatest("population", F.lit(1))))
    size = F.when(F.col("population") == 0, 0).when(F.col("sigma") == 0, F.least(F.lit(1), "population")).otherwise(F.greatest(F.lit(1), F.least(F.col("population"), corrected)))
    return g.select("population", F.round("sigma", 6).alias("sigma"), size.cast("long").alias("n"))


def weighted_draw(rows: DataFrame, key: str, weight: str, n: int, seed: int = SEED) -> DataFrame:
    """n rows without replacement, chances by weight: the smallest of -ln(u)/w, u from the key's MD5."""
    u = (F.conv(F.substring(X.draw_key(seed, key), 1, 12), 16, 10).cast("double") + 1) / F.lit(float(16**12 + 1))
    return rows.where(F.col(weight) > 0).withColumn("_t", -F.log(u) / F.col(weight)).orderBy("_t", key).limit(n).drop("_t")
