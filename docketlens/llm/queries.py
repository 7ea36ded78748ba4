"""Queries and SQL of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlens.llm import encoding_repair, leakage, name_linkage, near_duplicates, packing, percentiles, personal_data, residue, scan_repair
from docketlens.session import load


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_pairs(load(spark, sf_dir, "comments_raw"))


def p1_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates.near_duplicate_groups(load(spark, sf_dir, "comments_raw"))


GROUPS = ["agency", "submission_channel"]


def p2_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact percentiles of known comment_count per agency and channel."""
    return percentiles.multi_select(percentiles.partials(load(spark, sf_dir, "federal_register_comments"), GROUPS, "comment_count"), GROUPS)


def p2_yearly_partials(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mergeable form: counts per group, publication year and value (7 leading bits: error under 1 %)."""
    rows = load(spark, sf_dir, "federal_register_comments").withColumn("year", F.substring("publication_date", 1, 4))
    return percentiles.partials(rows, GROUPS, "comment_count", bits=7, part=["year"])


def p2_merged_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from the merged yearly partials, at most 2^-7 below the exact ones."""
    return percentiles.multi_select(p2_yearly_partials(spark, sf_dir).drop("year"), GROUPS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.damaged_records(load(spark, sf_dir, "comments_raw"))


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encoding_repair.restored_records(load(spark, sf_dir, "comments_raw"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.fields_with_items(load(spark, sf_dir, "comments_raw"))


def p5_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data.redacted_texts(load(spark, sf_dir, "comments_raw"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_linkage.name_pairs(load(spark, sf_dir, "comments_raw"))


def p6_linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return name_linkage.linked_names(load(spark, sf_dir, "comments_raw"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repair.noise_kinds(load(spark, sf_dir, "comments_raw"))


def p7_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_repair.repaired_texts(load(spark, sf_dir, "comments_raw"))


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_items(load(spark, sf_dir, "documents"))


def p8_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packing_summary(load(spark, sf_dir, "documents"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leaked_items(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p9_leak_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leakage.leak_report(load(spark, sf_dir, "documents"), load(spark, sf_dir, "eval_items"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.residue_kinds(load(spark, sf_dir, "documents"))


def p10_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return residue.without_residue(load(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: value for name, value in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


_RANKED = """
with known as (select agency, submission_channel, {value} as v from federal_register_comments where comment_count is not null),
r as (select *, row_number() over (partition by agency, submission_channel order by v) as rn, count(*) over (partition by agency, submission_channel) as n from known)
select agency, submission_channel, max(n) as n_known,
  min(case when rn >= greatest(1, ceil(round(0.25::double * n, 9))) then v end) as p25,
  min(case when rn >= greatest(1, ceil(round(0.5::double * n, 9))) then v end) as median,
  min(case when rn >= greatest(1, ceil(round(0.75::double * n, 9))) then v end) as p75,
  min(case when rn >= greatest(1, ceil(round(0.9::double * n, 9))) then v end) as p90,
  min(case when rn >= greatest(1, ceil(round(0.99::double * n, 9))) then v end) as p99
from r group by agency, submission_channel"""
_BITS = "(comment_count - comment_count % (1::bigint << greatest(0, length(ltrim(bin(comment_count), '0')) - 8)))"

SQL: dict[str, str] = {
    "p2_percentiles": _RANKED.format(value="comment_count"),
    "p2_merged_percentiles": _RANKED.format(value=_BITS),
    "p2_yearly_partials": f"select agency, submission_channel, substring(publication_date, 1, 4) as year, {_BITS} as value, count(*) as n from federal_register_comments where comment_count is not null group by 1, 2, 3, 4",
    "p9_found": """
with d as (select doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from documents where text is not null),
i as (select item_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') as w from eval_items where text is not null),
dw as (select doc_id, array_to_string(w[k:k + 11], ' ') as win from (select doc_id, w, unnest(range(1, len(w) - 10)) as k from d where len(w) >= 12)),
iw as (select item_id, array_to_string(w[k:k + 11], ' ') as win from (select item_id, w, unnest(range(1, len(w) - 10)) as k from i where len(w) >= 12))
select distinct doc_id, item_id from dw join iw using (win)""",
}
