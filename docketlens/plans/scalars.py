"""Projections, filters and CASE chains (PRJ, FLT, CAS and the text functions)."""

from __future__ import annotations

from pyspark.sql import functions as F

from docketlens.functions import exprs as X
from docketlens.plans.common import comments, fr, labelled, quoted, results, sql_bin, sql_category

QUERIES, SQL = {}, {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


_LIKE = lambda col, words: "(" + " or ".join(f"contains({col}, '{w}')" for w in words) + ")"


@query("prj1_agency_string", "select document_number, array_to_string(list_filter(list_transform(string_split(agency, ','), lambda x: trim(x)), lambda x: x <> ''), ', ') as agency_string from federal_register_comments where agency is not null")
def _(spark, d):
    names = F.transform(F.split("agency", ","), lambda x: F.named_struct(F.lit("name"), F.nullif(F.trim(x), F.lit(""))))
    entries = fr(spark, d).where("agency is not null").select("document_number", names.alias("agencies"))
    return entries.select("document_number", F.array_join(F.transform(F.filter("agencies", lambda a: a["name"].isNotNull()), lambda a: a["name"]), ", ").alias("agency_string"))


_CHANNEL = """case when coalesce(regs_document_id, '') <> '' then 'regs.gov' when u = '' then 'unknown' when contains(u, 'regulations.gov') then 'regs.gov' when contains(u, 'ecfs.fcc.gov') then 'fcc-ecfs'
 when contains(u, 'efiling.ferc.gov') then 'ferc-portal' when contains(u, 'www.sec.gov/comments') then 'sec-portal' when starts_with(u, 'mailto:') then 'email' when starts_with(u, 'http') then 'other-portal' else 'unknown' end"""


@query("prj2_submission_channel", f"select document_number, {_CHANNEL} as channel from (select *, lower(coalesce(comment_url, '')) as u from federal_register_comments)")
def _(spark, d):
    return fr(spark, d).select("document_number", X.submission_channel("regs_document_id", "comment_url").alias("channel"))


@query(
    "prj4_count_cascade",
    """select document_number, case when not has then null when regs >= 0 then regs when meta >= 0 then meta when reg >= 0 then reg else 0 end as n,
 case when not has then 'unknown' when regs >= 0 then 'regulations.gov' when meta >= 0 then 'regulations.gov-meta' when reg >= 0 then 'federalregister' else 'unknown' end as source
 from (select document_number, coalesce(regs_document_id, '') <> '' as has, case when count_source = 'regulations.gov' then comment_count end as regs, case when count_source = 'regulations.gov-meta' then comment_count end as meta,
 case when count_source = 'federalregister' then comment_count end as reg from federal_register_comments)""",
)
def _(spark, d):
    pick = lambda s: F.when(F.col("count_source") == s, F.col("comment_count"))
    count, source = X.count_cascade(pick("regulations.gov"), pick("regulations.gov-meta"), pick("federalregister"), X.filled("regs_document_id").isNotNull())
    return fr(spark, d).select("document_number", count.alias("n"), source.alias("source"))


_T1 = "document_number, title, agency, publication_date, comment_url, comments_close_on, regs_document_id, comment_count, count_source, eligibility_reason, submission_channel"


@query("prj5_document_columns", f"select {_T1} from federal_register_comments")
def _(spark, d):
    return fr(spark, d).select(*_T1.split(", "))


@query("prj6_list_payload", "select comment_id as id, coalesce(nullif(comment_text, ''), '') as text, coalesce(nullif(first_name, ''), '') as first, coalesce(nullif(organization, ''), '') as org, posted_date as posted, coalesce(has_attachments, false) as has_attachments from comments_raw")
def _(spark, d):
    """A list payload (nested JSON) flattened again, with the alternative text fields."""
    attributes = F.struct(F.lit(None).cast("string").alias("comment"), F.lit("").alias("commentText"), F.col("comment_text"), F.col("first_name").alias("firstName"), "organization", F.col("posted_date").alias("postedDate"), F.col("has_attachments").alias("hasAttachments"))
    payload = comments(spark, d).select(F.to_json(F.struct(F.col("comment_id").alias("id"), attributes.alias("attributes"))).alias("j"))
    kind = "struct<id:string, attributes:struct<comment:string, commentText:string, comment_text:string, firstName:string, organization:string, postedDate:string, hasAttachments:boolean>>"
    p = payload.select(F.from_json("j", kind).alias("p")).select("p.id", "p.attributes.*")
    empty = F.lit("")
    return p.select("id", F.coalesce(X.first_filled("comment", "commentText", "comment_text"), empty).alias("text"), F.coalesce(X.filled("firstName"), empty).alias("first"), F.coalesce(X.filled("organization"), empty).alias("org"), F.col("postedDate").alias("posted"), F.coalesce("hasAttachments", F.lit(False)).alias("has_attachments"))


@query(
    "prj7_detail_payload",
    "select comment_id as id, document_number, coalesce(nullif(comment_text, ''), '') as text, nullif(city, '') as city, nullif(zip, '') as zip, nullif(gov_agency, '') as gov_agency, coalesce(duplicate_comments, 0) as duplicates, coalesce(page_count, 0) as pages, cast(case when coalesce(attachment_formats, '') = '' then 0 else len(string_split(attachment_formats, ',')) end as bigint) as attachments from comments_raw",
)
def _(spark, d):
    """A detail payload with included attachments flattened, alternatives resolved."""
    included = F.when(X.filled("attachment_formats").isNull(), F.array().cast("array<struct<format:string>>")).otherwise(F.transform(F.split("attachment_formats", ","), lambda f: F.struct(f.alias("format"))))
    data = F.struct(F.col("comment_id").alias("id"), F.struct(F.col("comment_text").alias("comment"), F.lit(None).cast("string").alias("title"), "city", "zip", F.col("gov_agency").alias("govAgency"), F.lit(None).cast("long").alias("numItemsRecieved"), F.col("duplicate_comments").alias("duplicateComments"), F.col("page_count").alias("pageCount")).alias("attributes"))
    p = comments(spark, d).select("document_number", data.alias("data"), included.alias("included"))
    a = "data.attributes."
    return p.select(
        F.col("data.id").alias("id"), "document_number", F.coalesce(X.first_filled(a + "comment", a + "title"), F.lit("")).alias("text"), X.filled(a + "city").alias("city"), X.filled(a + "zip").alias("zip"), X.filled(a + "govAgency").alias("gov_agency"),
        F.coalesce(a + "numItemsRecieved", a + "duplicateComments", F.lit(0)).alias("duplicates"), F.coalesce(a + "pageCount", F.lit(0)).alias("pages"), F.size("included").cast("long").alias("attachments"),
    )


@query("prj8_attachment_formats", "select comment_id, attachment_count, array_to_string(list_sort(list_distinct(string_split(attachment_formats, ','))), ',') as formats from comments_raw where coalesce(attachment_formats, '') <> ''")
def _(spark, d):
    rows = comments(spark, d).where(X.filled("attachment_formats").isNotNull())
    return rows.select("comment_id", "attachment_count", F.array_join(F.array_sort(F.array_distinct(F.split("attachment_formats", ","))), ",").alias("formats"))


@query("prj9_first_pdf", "select comment_id, attachment_count, list_filter(string_split(attachment_formats, ','), lambda f: contains(lower(f), 'pdf'))[1] as pdf from comments_raw where coalesce(attachment_formats, '') <> ''")
def _(spark, d):
    formats = F.transform(F.split("attachment_formats", ","), lambda f: F.struct(f.alias("format"), f.alias("fileUrl")))
    return comments(spark, d).where(X.filled("attachment_formats").isNotNull()).select("comment_id", "attachment_count", F.get(F.filter(formats, lambda f: F.lower(f["format"]).contains("pdf")), F.lit(0))["fileUrl"].alias("pdf"))


@query("prj10_needs_detail", "select comment_id, (length(coalesce(comment_text, '')) = 0 or (coalesce(has_attachments, false) and length(coalesce(comment_text, '')) < 3000)) as needs_detail from comments_raw")
def _(spark, d):
    n = F.length(F.coalesce("comment_text", F.lit("")))
    return comments(spark, d).select("comment_id", ((n == 0) | (F.coalesce("has_attachments", F.lit(False)) & (n < 3000))).alias("needs_detail"))


@query("prj11_author_and_domain", "select document_number, lower(case when contains(comment_url, '@') then split_part(comment_url, '@', 2) end) as domain, trim(coalesce(title, '') || ' ' || coalesce(agency, '')) as author from federal_register_comments where starts_with(comment_url, 'mailto:')")
def _(spark, d):
    rows = fr(spark, d).where(F.col("comment_url").startswith("mailto:"))
    return rows.select("document_number", F.lower(F.when(F.col("comment_url").contains("@"), F.split_part("comment_url", F.lit("@"), F.lit(2)))).alias("domain"), F.trim(F.concat(F.coalesce("title", F.lit("")), F.lit(" "), F.coalesce("agency", F.lit("")))).alias("author"))


@query("prj12_sanitise_utf8", "select comment_id, nullif(comment_text, '') as text from comments_raw")
def _(spark, d):
    return comments(spark, d).select("comment_id", X.filled(F.try_validate_utf8("comment_text")).alias("text"))


@query("flt1_minable_documents", "select document_number, comment_count from federal_register_comments where regs_document_id is not null and comment_count > 0")
def _(spark, d):
    return fr(spark, d).where("regs_document_id is not null and comment_count > 0").select("document_number", "comment_count")


_HAS_TEXT = r"(regexp_replace(coalesce(comment_text, ''), '[\s\x{00a0}\x{0085}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}\x{000b}]', '', 'g') <> '' or regexp_replace(coalesce(attachment_text, ''), '[\s\x{00a0}\x{0085}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{1680}\x{000b}]', '', 'g') <> '')"


@query("flt2_text_gate", f"select comment_id, document_number from comments_raw where {_HAS_TEXT}")
def _(spark, d):
    return comments(spark, d).where(X.has_text("comment_text", "attachment_text")).select("comment_id", "document_number")


@query("flt3_channel", "select document_number from federal_register_comments where submission_channel = 'regs.gov'")
def _(spark, d):
    return fr(spark, d).where(F.col("submission_channel") == "regs.gov").select("document_number")


_DATE = "case when regexp_matches(publication_date, '^\\d{4}-\\d{2}-\\d{2}') then try_cast(substring(publication_date, 1, 10) as date) end"


@query("flt4_year", f"select document_number, dt from (select document_number, {_DATE} as dt from federal_register_comments) where year(dt) = 2020")
def _(spark, d):
    return fr(spark, d).select("document_number", X.iso_date("publication_date").alias("dt")).where(F.year("dt") == 2020)


@query("flt5_min_age", f"select document_number, dt from (select document_number, {_DATE} as dt from federal_register_comments) where date_diff('day', dt, date '2025-06-30') > 30")
def _(spark, d):
    return fr(spark, d).select("document_number", X.iso_date("publication_date").alias("dt")).where(F.datediff(F.lit("2025-06-30").cast("date"), "dt") > 30)


@query("flt6_year_mismatch", f"select year(dt) as found_year, count(*) as n, year(dt) is distinct from 2020 as mismatch from (select {_DATE} as dt from federal_register_comments) group by 1")
def _(spark, d):
    """Documents per publication year against the expected one, over all rows."""
    years = fr(spark, d).groupBy(F.year(X.iso_date("publication_date")).alias("found_year")).agg(F.count("*").alias("n"))
    return years.withColumn("mismatch", ~F.col("found_year").eqNullSafe(F.lit(2020)))


@query("flt7_known_category", f"select document_number, comment_id, cat as category from (select *, {sql_category('category')} as cat from makeup_data) where cat is not null")
def _(spark, d):
    return labelled(spark, d).withColumn("category", X.known_category("category")).where("category is not null").select("document_number", "comment_id", "category")


@query("flt8_known_count", "select document_number, comment_count from federal_register_comments where count_source is distinct from 'unknown'")
def _(spark, d):
    return fr(spark, d).where(~F.col("count_source").eqNullSafe(F.lit("unknown"))).select("document_number", "comment_count")


@query("flt9_volume_floor", "select agency, count(*) as num_docs from federal_register_comments where agency is not null group by 1 having count(*) >= 50")
def _(spark, d):
    return fr(spark, d).where("agency is not null").groupBy("agency").agg(F.count("*").alias("num_docs")).where("num_docs >= 50")


@query("flt10_skip_empty", "select document_number from federal_register_comments where coalesce(comment_count, 0) <> 0")
def _(spark, d):
    return fr(spark, d).where(F.coalesce("comment_count", F.lit(0)) != 0).select("document_number")


@query("cas1_comment_bin", f"select document_number, {sql_bin('comment_count')} as comment_bin from federal_register_comments where comment_count is not null")
def _(spark, d):
    return fr(spark, d).where("comment_count is not null").select("document_number", X.comment_bin("comment_count").alias("comment_bin"))


SQL_RULE = f"""case when o is not null and f is null and {_LIKE('lower(o)', X.COMPANY_WORDS)} then 'Organization/Corporation' when g is not null then {quoted(X.EXPERT)}
 when {_LIKE('k', X.BUSINESS_TYPES)} then 'Organization/Corporation' when contains(k, 'individual') and o is null then {quoted(X.CITIZEN)}
 when o is not null and f is not null and {_LIKE('lower(o)', X.SCHOLAR_WORDS + X.ADVISER_WORDS)} then {quoted(X.EXPERT)} end"""
SQL_RULE_INPUT = "(select *, nullif(organization, '') as o, coalesce(nullif(first_name, ''), nullif(last_name, '')) as f, nullif(gov_agency, '') as g, lower(nullif(submitter_type, '')) as k from comments_raw)"


@query("cas2_author_rules", f"select comment_id, attachment_count, {SQL_RULE} as label from {SQL_RULE_INPUT}")
def _(spark, d):
    return comments(spark, d).select("comment_id", "attachment_count", X.author_rule("organization", "first_name", "last_name", "gov_agency", "submitter_type").alias("label"))


@query("cas3_category_map", f"select comment_id, category, coalesce({sql_category('category')}, category) as mapped from makeup_results")
def _(spark, d):
    return results(spark, d).select("comment_id", "category", F.coalesce(X.known_category("category"), "category").alias("mapped"))


_MAIN = "case when coalesce(agency, '') = '' then 'Unknown' else trim(string_split(agency, ',')[1]) end"
_SUB = "case when len(string_split(agency, ',')) > 1 then array_to_string(list_transform(string_split(agency, ',')[2:], lambda x: trim(x)), ', ') end"


@query("cas4_agency_hierarchy", f"select document_number, {_MAIN} as main_agency, {_SUB} as sub_agency from federal_register_comments")
def _(spark, d):
    return fr(spark, d).select("document_number", X.main_agency("agency").alias("main_agency"), X.sub_agency("agency").alias("sub_agency"))


@query("cas7_volume_bin", "select document_number, case when comment_count <= 0 then null when comment_count <= 1 then '1' when comment_count <= 5 then '2-5' when comment_count <= 10 then '6-10' when comment_count <= 50 then '11-50' when comment_count <= 100 then '51-100' else '100+' end as volume from federal_register_comments where comment_count is not null")
def _(spark, d):
    return fr(spark, d).where("comment_count is not null").select("document_number", X.volume_bin("comment_count").alias("volume"))


@query("cas8_engagement_level", "select document_number, cast((comment_count >= 10)::int + (comment_count >= 25)::int + (comment_count >= 40)::int + (comment_count >= 60)::int as int) as lvl from federal_register_comments where comment_count is not null union all select document_number, 0 from federal_register_comments where comment_count is null")
def _(spark, d):
    return fr(spark, d).select("document_number", X.engagement_level("comment_count").alias("lvl"))


@query(
    "cas9_reply_parser",
    f"""select comment_id, model, case when r = '' then {quoted(X.UNDECIDED)} when contains(r, 'undecided') then {quoted(X.UNDECIDED)} when contains(r, 'citizen') then {quoted(X.CITIZEN)} when contains(r, 'org') then 'Organization/Corporation'
 when contains(r, 'expert') then {quoted(X.EXPERT)} when contains(r, 'lobbyist') then {quoted(X.LOBBYIST)} else {quoted(X.UNDECIDED)} end as label from (select *, lower(trim(coalesce(model_response, ''))) as r from makeup_results)""",
)
def _(spark, d):
    return results(spark, d).select("comment_id", "model", X.reply_label("model_response").alias("label"))


@query("cas10_fetch_strategy", "select document_number, round(case when comment_count <= 1000 then 1.0::double else least(5000, floor(comment_count * 0.1::double)) / comment_count::double end, 6) as rate from federal_register_comments where comment_count > 0")
def _(spark, d):
    return fr(spark, d).where("comment_count > 0").select("document_number", F.round(X.fetch_rate("smart", F.col("comment_count")), 6).alias("rate"))


_STRIP = lambda x: rf"regexp_replace({x}, '^[\s\x{{00a0}}\x{{000b}}]+|[\s\x{{00a0}}\x{{000b}}]+$', '', 'g')"


@query("txt1_combined_text", f"select comment_id, concat_ws(chr(10) || chr(10), case when a <> '' and lower(a) <> 'none' then a end, case when b <> '' and lower(b) <> 'none' then b end) as text from (select comment_id, {_STRIP('comment_text')} as a, {_STRIP('attachment_text')} as b from comments_raw)")
def _(spark, d):
    return comments(spark, d).select("comment_id", X.combined_text("comment_text", "attachment_text").alias("text"))


@query(
    "txt2_tokens",
    f"""select comment_id, len(t) as n_tokens, md5(array_to_string(t, ' ')) as digest from (select comment_id, list_filter(string_split_regex(lower(comment_text), '[^\\p{{L}}\\p{{N}}\\p{{M}}_]+'), lambda x: regexp_full_match(x, '[a-z]{{3,}}') and not list_contains([{', '.join(quoted(w) for w in X.STOPWORDS)}], x)) as t from comments_raw where comment_text is not null)""",
)
def _(spark, d):
    rows = comments(spark, d).where("comment_text is not null").select("comment_id", X.tokens("comment_text").alias("t"))
    return rows.select("comment_id", F.size("t").cast("long").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("digest"))


@query("txt3_prompt", "select comment_id, attachment_count, 'Organization: ' || coalesce(nullif(organization, ''), 'N/A') || chr(10) || 'Type: ' || coalesce(nullif(submitter_type, ''), 'N/A') || chr(10) || 'Text: ' || substring(coalesce(comment_text, ''), 1, 3000) as prompt from comments_raw")
def _(spark, d):
    """A labelling prompt; missing metadata reads N/A, the text is cut at 3000 characters."""
    na = F.lit("N/A")
    prompt = F.concat(F.lit("Organization: "), F.coalesce(X.filled("organization"), na), F.lit("\nType: "), F.coalesce(X.filled("submitter_type"), na), F.lit("\nText: "), F.substring(F.coalesce("comment_text", F.lit("")), 1, 3000))
    return comments(spark, d).select("comment_id", "attachment_count", prompt.alias("prompt"))


@query("txt4_numeric_coercion", "select comment_id, greatest(coalesce(try_cast(zip as bigint), 0), 0) as zip_number, attachment_count from comments_raw")
def _(spark, d):
    return comments(spark, d).select("comment_id", F.greatest(F.coalesce(F.expr("try_cast(zip as bigint)"), F.lit(0)), F.lit(0)).cast("long").alias("zip_number"), "attachment_count")


@query("txt5_truncation", "select document_number, case when length(title) > 40 then substring(title, 1, 25) || '…' || right(title, 14) else title end as short from federal_register_comments where title is not null")
def _(spark, d):
    title = F.col("title")
    return fr(spark, d).where("title is not null").select("document_number", F.when(F.length("title") > 40, F.concat(F.substring("title", 1, 25), F.lit("…"), F.right(title, F.lit(14)))).otherwise(title).alias("short"))
