"""p4: per-docket figures although a few dockets hold most of the comments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlens.operators.salted import SALTS, heavy_keys, salted_aggregate
from docketlens.session import load


def docket_totals(comments: DataFrame, dockets: DataFrame) -> DataFrame:
    """One row per docket that has comments: rows, distinct comments, text lengths and latest dates next to comment_count.

    A comment_id that repeats is one comment; its longest text and latest dates
    count.  Heavy dockets are salted by comment_id twice: first the repeats of
    each comment are folded per (docket, salt, comment), then the partial figures per
    (docket, salt) are merged.  NULL or empty text has length 0, a NULL docket
    is dropped (it joins no docket), NULL comment ids are one comment, dates are
    compared as ISO text.
    """
    rows = comments.where(F.col("document_number").isNotNull()).select(
        "document_number",
        F.coalesce("comment_id", F.lit("")).alias("comment_id"),
        F.coalesce(F.length("comment_text"), F.lit(0)).cast("long").alias("chars"),
        F.coalesce(F.length("attachment_text"), F.lit(0)).cast("long").alias("attachment_chars"),
        "posted_date",
        "receive_date",
    )
    folded = rows.groupBy("document_number", "comment_id").agg(
        F.count("*").alias("copies"), F.max("chars").alias("chars"), F.max("attachment_chars").alias("attachment_chars"), F.max("posted_date").alias("posted"), F.max("receive_date").alias("received")
    )
    totals = salted_aggregate(
        folded,
        "document_number",
        F.col("comment_id"),
        partial={
            "p_rows": F.sum("copies"),
            "p_comments": F.count("*"),
            "p_chars": F.sum("chars"),
            "p_attachment": F.sum("attachment_chars"),
            "p_longest": F.max("chars"),
            "p_posted": F.max("posted"),
            "p_received": F.max("received"),
        },
        merge={
            "n_rows": F.sum("p_rows"),
            "n_comments": F.sum("p_comments"),
            "text_chars": F.sum("p_chars"),
            "attachment_chars": F.sum("p_attachment"),
            "longest_text": F.max("p_longest"),
            "latest_posted": F.max("p_posted"),
            "latest_received": F.max("p_received"),
        },
    )
    known = dockets.select("document_number", "comment_count")
    return totals.join(known, "document_number", "left").select("document_number", "n_rows", "n_comments", "text_chars", "attachment_chars", "longest_text", "latest_posted", "latest_received", "comment_count")


def p4_docket_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return docket_totals(load(spark, sf_dir, "comments_raw"), load(spark, sf_dir, "federal_register_comments"))


def p4_heavy_dockets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dockets that are salted."""
    return heavy_keys(load(spark, sf_dir, "comments_raw").select("document_number"), "document_number").where(F.col("document_number").isNotNull()).select("document_number", F.lit(SALTS).alias("salts"))


QUERIES = {"p4_docket_totals": p4_docket_totals, "p4_heavy_dockets": p4_heavy_dockets}

SQL = {
    "p4_docket_totals": """
with f as (
  select document_number, coalesce(comment_id, '') as comment_id, count(*) as copies,
         max(coalesce(length(comment_text), 0)) as chars, max(coalesce(length(attachment_text), 0)) as attachment_chars,
         max(posted_date) as posted, max(receive_date) as received
  from comments_raw where document_number is not null group by 1, 2)
select f.document_number, cast(sum(copies) as bigint) as n_rows, count(*) as n_comments, cast(sum(chars) as bigint) as text_chars,
       cast(sum(f.attachment_chars) as bigint) as attachment_chars, cast(max(chars) as bigint) as longest_text,
       max(posted) as latest_posted, max(received) as latest_received, max(d.comment_count) as comment_count
from f left join federal_register_comments d on d.document_number = f.document_number group by f.document_number""",
    "p4_heavy_dockets": """
select document_number, 64 as salts from comments_raw where document_number is not null
group by 1 having count(*) > (select count(*) from comments_raw) * 0.002::double""",
}
