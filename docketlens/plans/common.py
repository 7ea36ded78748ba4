"""Frames and SQL fragments that several query modules share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketlens.functions import exprs as X
from docketlens.session import load


def fr(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "federal_register_comments")


def comments(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "comments_raw")


def results(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "makeup_results")


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "makeup_data")


def r6(x: Column) -> Column:
    """Doubles to six places, for comparison between engines."""
    return F.round(x.cast("double"), 6)


def sample(spark: SparkSession, d: str) -> DataFrame:
    """Labelled comments with known category, one row per comment (the first category in label order)."""
    rows = labelled(spark, d).withColumn("category", X.known_category("category")).where("category is not null")
    order = Window.partitionBy("comment_id").orderBy("category", "document_number", F.coalesce("agency", F.lit("")))
    return rows.withColumn("rn", F.row_number().over(order)).where("rn = 1").select("document_number", "comment_id", "agency", "category")


def weighted(spark: SparkSession, d: str) -> DataFrame:
    """The sample with comment_count, comment_bin, weight, n_sample_doc and weight_doc.

    ``weight`` brings a comment up to its stratum (agency and size class),
    ``weight_doc`` to its document.  A stratum the population lacks (a NULL
    agency among them) has weight 1.  The strata and per-document counts are
    joined back as small aggregates of the sample.
    """
    documents = fr(spark, d)
    rows = sample(spark, d).join(documents.select("document_number", F.col("comment_count").alias("known")), "document_number", "left")
    rows = rows.withColumn("comment_count", F.coalesce("known", F.lit(1))).withColumn("comment_bin", X.comment_bin("comment_count")).drop("known")
    population = documents.where("comment_count > 0 and agency is not null").groupBy("agency", X.comment_bin("comment_count").alias("comment_bin")).agg(F.sum("comment_count").alias("n_pop"))
    drawn = rows.where("agency is not null").groupBy("agency", "comment_bin").agg(F.count("*").alias("n_sample"))
    weights = population.join(drawn, ["agency", "comment_bin"]).select("agency", "comment_bin", (F.col("n_pop") / F.col("n_sample")).alias("weight"))
    per_document = rows.groupBy("document_number").agg(F.count("*").alias("n_sample_doc"))
    joined = rows.join(weights, ["agency", "comment_bin"], "left").join(per_document, "document_number", "left")
    return joined.select(
        "document_number", "comment_id", "agency", "category", "comment_count", "comment_bin",
        F.coalesce("weight", F.lit(1.0)).alias("weight"), F.col("weight").isNotNull().alias("matched"), "n_sample_doc", (F.col("comment_count") / F.col("n_sample_doc")).alias("weight_doc"),
    )


def agency_metrics(rows: DataFrame) -> DataFrame:
    """Per agency: total weight, weight and share per category (n_0 to n_4, share_0 to share_4 in label order), X and Y.  A NULL agency is left out."""
    sums = [F.sum(F.when(F.col("category") == x, F.col("weight")).otherwise(0.0)).alias(f"n_{i}") for i, x in enumerate(X.CATEGORIES)]
    wide = rows.where("agency is not null").groupBy("agency").agg(F.sum("weight").alias("total"), *sums)
    safe = F.when(F.col("total") > 0, F.col("total")).otherwise(1.0)
    wide = wide.select("*", *[(F.col(f"n_{i}") / safe).alias(f"share_{i}") for i in range(5)])
    clip = lambda x, low, high: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    return wide.withColumn("x", clip(F.col("share_1") - F.col("share_2"), -1.0, 1.0)).withColumn("y", clip(F.col("share_3") + F.col("share_4"), 0.0, 1.0))


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def sql_bin(x: str) -> str:
    return f"case when {x} <= 10 then '0-10' when {x} <= 100 then '11-100' when {x} <= 1000 then '101-1000' when {x} <= 10000 then '1001-10000' else '10000+' end"


def sql_category(x: str) -> str:
    return "case " + " ".join(f"when {x} in ({', '.join(quoted(s) for s in sorted({*spellings, label}))}) then {quoted(label)}" for label, spellings in X.SPELLINGS.items()) + " end"


SQL_SAMPLE = f"""sample as (
  select document_number, comment_id, agency, cat as category from (
    select *, row_number() over (partition by comment_id order by cat, document_number, coalesce(agency, '')) as rn
    from (select document_number, comment_id, agency, {sql_category('category')} as cat from makeup_data) where cat is not null) where rn = 1)"""

SQL_WEIGHTED = f"""{SQL_SAMPLE},
rows_ as (select s.*, coalesce(f.comment_count, 1) as comment_count, {sql_bin('coalesce(f.comment_count, 1)')} as comment_bin
  from sample s left join federal_register_comments f using (document_number)),
pop_ as (select agency, {sql_bin('comment_count')} as comment_bin, sum(comment_count) as n_pop from federal_register_comments where comment_count > 0 and agency is not null group by 1, 2),
drawn_ as (select agency, comment_bin, count(*) as n_sample from rows_ where agency is not null group by 1, 2),
weighted as (select r.*, coalesce(p.n_pop::double / d.n_sample, 1.0::double) as weight, p.n_pop is not null and d.n_sample is not null as matched,
    count(*) over (partition by r.document_number) as n_sample_doc, r.comment_count::double / count(*) over (partition by r.document_number) as weight_doc
  from rows_ r left join drawn_ d on d.agency = r.agency and d.comment_bin = r.comment_bin left join pop_ p on p.agency = d.agency and p.comment_bin = d.comment_bin)"""

_N = ", ".join(f"sum(case when category = {quoted(x)} then weight else 0 end) as n_{i}" for i, x in enumerate(X.CATEGORIES))
_S = ", ".join(f"n_{i} / case when total > 0 then total else 1 end as share_{i}" for i in range(5))
SQL_METRICS = f"""{SQL_WEIGHTED},
wide_ as (select agency, sum(weight) as total, {_N} from weighted where agency is not null group by agency),
shares_ as (select *, {_S} from wide_),
metrics as (select *, least(greatest(share_1 - share_2, -1.0::double), 1.0::double) as x, least(greatest(share_3 + share_4, 0.0::double), 1.0::double) as y from shares_)"""
