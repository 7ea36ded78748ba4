"""Sampling, labelling, sources, sinks and incremental steps (SM, SRC, SNK, ST, CTL)."""

from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from docketlens.functions import exprs as X
from docketlens.operators import density, labelling, persistence, sampling
from docketlens.plans.common import comments, fr, labelled, quoted, results, sql_bin
from docketlens.session import load
from docketlens.sources import harvest
from docketlens.streaming import incremental

QUERIES, SQL = {}, {}
#: Rows of one page of the comment cursor, and pages that a micro-batch takes.
CURSOR_PAGE, CURSOR_PAGES = 1000, 50


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


_SIZE = lambda n: f"case when {n} <= 0 then 0 when {n} < 10 then {n} else least(cast(floor({1.96 * 1.96 * 0.25 / (0.05 * 0.05)!r}::double / (1 + ({1.96 * 1.96 * 0.25 / (0.05 * 0.05)!r}::double - 1) / {n}::double)) as bigint) + 1, {n}) end"
_DOCS = f"docs as (select document_number, agency, comment_count, {sql_bin('comment_count')} as comment_bin from federal_register_comments where regs_document_id is not null and comment_count > 0)"
_STRATA = f"strata as (select agency, comment_bin, count(*) as num_docs, cast(sum(comment_count) as bigint) as total_comments, cast({_SIZE('sum(comment_count)')} as bigint) as target_comments from docs group by 1, 2)"
_DRAWN = """drawn as (select * from (select d.*, s.num_docs, s.total_comments, s.target_comments, row_number() over (partition by d.agency, d.comment_bin order by md5('42:' || d.document_number)) as rn from docs d join strata s on s.agency is not distinct from d.agency and s.comment_bin = d.comment_bin)
 where rn <= case when num_docs <= 10 or total_comments <= 25 then num_docs else least(num_docs, greatest(ceil(sqrt(num_docs)), 3)) end)"""
_IDS = "ids as (select distinct document_number, comment_id from comments_raw where comment_id is not null)"


def minable(spark, d):
    return fr(spark, d).where("regs_document_id is not null and comment_count > 0").select("document_number", "agency", "comment_count")


def ids(spark, d):
    return comments(spark, d).where("comment_id is not null").select("document_number", "comment_id").distinct()


@query("sm1_sample_size", f"select n, cast({_SIZE('n')} as bigint) as take from (select distinct comment_count as n from federal_register_comments where comment_count is not null)")
def _(spark, d):
    return fr(spark, d).where("comment_count is not null").select(F.col("comment_count").alias("n")).distinct().withColumn("take", X.sample_size(F.col("n")))


@query("sm2_sampled_documents", f"with {_DOCS}, {_STRATA}, {_DRAWN} select document_number, agency, comment_bin, target_comments from drawn")
def _(spark, d):
    return sampling.sampled_documents(minable(spark, d)).select("document_number", "agency", "comment_bin", "target_comments")


@query(
    "sm3_sampled_comments",
    f"""with {_DOCS}, {_STRATA}, {_DRAWN}, {_IDS}, have as (select i.document_number, any_value(agency) as agency, any_value(comment_bin) as comment_bin, any_value(target_comments) as target, count(*) as have from ids i join drawn d on d.document_number = i.document_number group by 1),
 sized as (select *, sum(have) over (partition by agency, comment_bin) as stratum from have), takes as (select document_number, case when stratum <= target then have else least(have, greatest(1, floor(have * (target::double / stratum)))) end as take from sized)
 select document_number, comment_id from (select i.*, t.take, row_number() over (partition by i.document_number order by md5('42:' || comment_id)) as rn from ids i join takes t on t.document_number = i.document_number) where rn <= take""",
)
def _(spark, d):
    return sampling.sampled_comments(minable(spark, d), ids(spark, d))


@query("sm4_strategy_sample", f"with {_IDS}, have as (select document_number, count(*) as n from ids group by 1), t as (select document_number, least(n, greatest(1, floor(n * case when n <= 1000 then 1.0::double else least(5000, floor(n * 0.1::double)) / n::double end))) as take from have) select document_number, comment_id from (select i.*, take, row_number() over (partition by i.document_number order by md5('42:' || comment_id)) as rn from ids i join t on t.document_number = i.document_number) where rn <= take")
def _(spark, d):
    """All comments of a document up to 1,000, else a tenth, at most 5,000."""
    rows = ids(spark, d)
    n = F.col("n")
    rate = X.fetch_rate("by size", n)
    takes = rows.groupBy("document_number").agg(F.count("*").alias("n")).select("document_number", F.least(n, F.greatest(F.lit(1), F.floor(n * rate))).alias("take"))
    return sampling.draw_per_group(rows.join(takes, "document_number"), ["document_number"], "comment_id", F.col("take")).select("document_number", "comment_id")


@query("sm5_capped_new_ids", f"with {_IDS} select document_number, comment_id from (select *, row_number() over (partition by document_number order by md5('42:' || comment_id)) as rn from ids) i where rn <= 200 and not exists (select 1 from makeup_data m where m.comment_id = i.comment_id)")
def _(spark, d):
    """At most 200 ids a document, those already labelled left out."""
    capped = sampling.draw_per_group(ids(spark, d), ["document_number"], "comment_id", F.lit(200))
    return capped.join(labelled(spark, d).select("comment_id"), "comment_id", "left_anti").select("document_number", "comment_id")


@query("sm6_document_vectors")
def _(spark, d):
    """Unit vectors of all comments with text, by word vectors trained on them."""
    texts = comments(spark, d).where("comment_text is not null").select("comment_id", "comment_text")
    return density.document_vectors(texts, "comment_id", "comment_text")


@query("sm7_pilot_size", "with n as (select vec_id, sqrt(list_sum(list_transform(embedding, lambda x: x::double * x::double))) as norm from embeddings), s as (select coalesce(stddev_pop(norm), 0) as sigma from (select norm from n order by md5('42:' || vec_id) limit 500)), p as (select count(*) as population from embeddings) select population, round(sigma, 6) as sigma, cast(greatest(1, least(population, ceil(3.291::double * 3.291 * sigma * sigma / 0.0025 / (1 + (3.291::double * 3.291 * sigma * sigma / 0.0025 - 1) / population)))) as bigint) as n from s, p")
def _(spark, d):
    return sampling.pilot_size(load(spark, d, "embeddings"), "vec_id", "embedding")


@query("sm8_density_sample")
def _(spark, d):
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("embedding").alias("vector"))
    return density.density_sample(vectors, 100)


@query("sm9_threshold_route", f"with {_IDS} select document_number, count(*) as n, case when count(*) <= 1000 then 'all' else 'sample' end as route from ids group by 1")
def _(spark, d):
    return ids(spark, d).groupBy("document_number").agg(F.count("*").alias("n")).withColumn("route", F.when(F.col("n") <= 1000, "all").otherwise("sample"))


_PHRASES = labelling.KeyWords().phrases
_REPLY = "case " + " ".join(f"when contains(lower(p), '{p}') then '{r}'" for p, r in _PHRASES) + " else 'undecided' end"
_STRIP = lambda x: rf"regexp_replace({x}, '^[\s\x{{00a0}}\x{{000b}}]+|[\s\x{{00a0}}\x{{000b}}]+$', '', 'g')"
_PROMPT = f"(select comment_id, substring(concat_ws(chr(10) || chr(10), case when a <> '' and lower(a) <> 'none' then a end, case when b <> '' and lower(b) <> 'none' then b end), 1, 3000) as p from (select comment_id, {_STRIP('comment_text')} as a, {_STRIP('attachment_text')} as b from comments_raw) where coalesce(a, '') <> '' or coalesce(b, '') <> '')"
_LABEL = f"case r when 'undecided' then {quoted(X.UNDECIDED)} when 'citizen' then {quoted(X.CITIZEN)} when 'org' then 'Organization/Corporation' when 'expert' then {quoted(X.EXPERT)} else {quoted(X.LOBBYIST)} end"


@query("sm10_labelled", f"select comment_id, r as model_response, {_LABEL} as category from (select comment_id, {_REPLY} as r from {_PROMPT})")
def _(spark, d):
    """Comments labelled by the offline stand-in through the model interface."""
    return labelling.label(comments(spark, d), labelling.KeyWords()).select("comment_id", "model_response", "category")


_VALID = "r in ('citizen', 'org', 'expert')"


# The written label is a synonym of the known category.
_KNOWN = _LABEL.replace("'Organization/Corporation'", "'Large Organization/Corporation'")


@query("sm11_structured_labels", f"select comment_id, case when {_VALID} then {_KNOWN} else {quoted(X.UNDECIDED)} end as category, case when {_VALID} then 0.9::double else 0.0::double end as confidence, case when {_VALID} then null else 'invalid reply' end as error from (select comment_id, {_REPLY} as r from {_PROMPT})")
def _(spark, d):
    """Labels from JSON replies; sentences and unknown categories are invalid and stay undecided."""
    return labelling.label_structured(comments(spark, d), labelling.StructuredKeyWords())


@query("sm13_hybrid_fetch", "select comment_id, needs as from_detail, case when needs then coalesce(duplicate_comments, 0) else 0 end as duplicates from (select *, (length(coalesce(comment_text, '')) = 0 or (coalesce(has_attachments, false) and length(coalesce(comment_text, '')) < 3000)) as needs from comments_raw)")
def _(spark, d):
    """Detail fields only where the list payload doesn't suffice; one pass instead of two branches."""
    n = F.length(F.coalesce("comment_text", F.lit("")))
    needs = (n == 0) | (F.coalesce("has_attachments", F.lit(False)) & (n < 3000))
    return comments(spark, d).select("comment_id", needs.alias("from_detail"), F.when(needs, F.coalesce("duplicate_comments", F.lit(0))).otherwise(0).alias("duplicates"))


# -- sources and sinks ----------------------------------------------------------------------------------------------------


@query("src1_document_list", "select document_number, title, publication_date, agency from federal_register_comments where regexp_full_match(publication_date, '2020-\\d{2}-\\d{2}')")
def _(spark, d):
    harvest.register(spark)
    return spark.read.format("docket_documents").option("path", f"{d}/federal_register_comments.parquet").option("year", "2020").load()


@query("src3_memo_lookup", "select comment_id, document_number, attachment_count, substring(md5(document_number), 1, 16) as object_id from comments_raw")
def _(spark, d):
    """An object id per document, looked up once per distinct document."""
    rows = comments(spark, d).select("comment_id", "document_number", "attachment_count")
    return harvest.memo_lookup(rows, "document_number", lambda k: {"object_id": hashlib.md5(k.encode()).hexdigest()[:16]}, "object_id string")


@query("src5_cursor_window", f"select distinct posted_date, comment_id, document_number from comments_raw where posted_date >= '2022-06-01' order by 1, 2, 3 limit 500")
def _(spark, d):
    """The next 500 comments after a cursor, boundary rows once."""
    rows = comments(spark, d).where("posted_date >= '2022-06-01'").select("posted_date", "comment_id", "document_number").distinct()
    return rows.orderBy("posted_date", "comment_id", "document_number").limit(500)


@query("src7_id_fallback", "select document_number, coalesce(nullif(regs_document_id, ''), 'FR-' || document_number) as regs_id from federal_register_comments")
def _(spark, d):
    return fr(spark, d).select("document_number", F.coalesce(X.filled("regs_document_id"), F.concat(F.lit("FR-"), "document_number")).alias("regs_id"))


@query("src9_csv_round_trip", "select comment_id, nullif(comment_text, '') as comment_text, attachment_count, has_attachments from comments_raw")
def _(spark, d):
    """Comments through a CSV file with quotes and line breaks inside fields; empty fields come back as NULL."""
    rows = comments(spark, d).select("comment_id", "comment_text", "attachment_count", "has_attachments")
    path = incremental.folder(spark, "csv")
    persistence.write_csv(rows, path)
    return persistence.read_csv(spark, path, rows.schema)


@query("src10_first_path", "select 'federal_register_comments' as found")
def _(spark, d):
    path = persistence.first_existing(spark, [f"{d}/none.parquet", f"{d}/federal_register_comments.parquet", f"{d}/comments_raw.parquet"])
    return spark.range(1).select(F.lit(path.rsplit("/", 1)[1].removesuffix(".parquet") if path else None).alias("found"))


@query("snk1_partitioned", "select case when regexp_matches(publication_date, '^\\d{4}-\\d{2}-\\d{2}') then cast(substring(publication_date, 1, 4) as int) else 0 end as year, count(*) as n from federal_register_comments group by 1")
def _(spark, d):
    path = incremental.folder(spark, "by-year")
    persistence.write_by_year(fr(spark, d), "publication_date", path)
    return spark.read.parquet(path).groupBy("year").agg(F.count("*").alias("n"))


@query("snk2_evolving_append", "select comment_id, category, model, cast(null as varchar) as agency from makeup_results union all select comment_id, category, null, agency from makeup_data")
def _(spark, d):
    return persistence.evolved_union(results(spark, d).select("comment_id", "category", "model"), labelled(spark, d).select("comment_id", "category", "agency"))


@query("snk3_keep_first_upsert", "select comment_id, category from (select comment_id, min(category) as category from makeup_data group by 1) union all select comment_id, min(category) from makeup_results r where not exists (select 1 from makeup_data m where m.comment_id = r.comment_id) and comment_id is not null group by 1")
def _(spark, d):
    old = labelled(spark, d).groupBy("comment_id").agg(F.min("category").alias("category"))
    return persistence.keep_first(old, results(spark, d).select("comment_id", "category"), "comment_id")


# -- incremental -----------------------------------------------------------------------------------------------------------


@query("st1_cursor_stream", "select distinct comment_id, posted_date, document_number from comments_raw where posted_date is not null and comment_id is not null")
def _(spark, d):
    """The whole comment list read page by page through the streaming source; rows without a date are left out after reading."""
    harvest.register(spark)
    stream = spark.readStream.format("docket_comments").option("path", f"{d}/comments_raw.parquet").option("page", str(CURSOR_PAGE)).option("pages", str(CURSOR_PAGES)).load().where("posted_date is not null")
    path = incremental.folder(spark, "cursor")
    started = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", incremental.folder(spark, "cursor-state")).start()
    started.processAllAvailable()
    started.stop()
    return spark.read.schema("comment_id string, posted_date string, document_number string").parquet(path)


def _delivery(spark, d):
    """Labels as a folder of files, delivered twice with overlap."""
    path = incremental.folder(spark, "delivery")
    results(spark, d).select("comment_id", "category").repartition(2).write.parquet(path)
    labelled(spark, d).select("comment_id", "category").write.mode("append").parquet(path)
    return spark.readStream.schema("comment_id string, category string").option("maxFilesPerTrigger", "2").parquet(path)


@query("st2_exactly_once", "select distinct comment_id from (select comment_id from makeup_results union all select comment_id from makeup_data)")
def _(spark, d):
    """Each id once out of overlapping deliveries, with state bounded by a watermark."""
    stream = _delivery(spark, d).withColumn("at", F.lit("2025-01-01").cast("timestamp"))
    path = incremental.folder(spark, "once")
    incremental.run_to_end(incremental.without_repeats(stream, "comment_id", "at").select("comment_id"), path, incremental.folder(spark, "once-state"))
    return spark.read.schema("comment_id string").parquet(path)


@query("st3_upsert", "select count(*) as n, count(distinct comment_id) as ids from (select distinct comment_id from (select comment_id from makeup_results union all select comment_id from makeup_data))")
def _(spark, d):
    path = incremental.folder(spark, "upsert")
    incremental.upsert_ignore(_delivery(spark, d), "comment_id", path, incremental.folder(spark, "upsert-state"))
    return spark.read.schema("comment_id string, category string").parquet(path).agg(F.count("*").alias("n"), F.countDistinct("comment_id").alias("ids"))


@query("ctl3_key_spec", "select * from (values ('a', 9000), ('b', 5000), ('c', 200)) t(key, per_hour)")
def _(spark, d):
    return spark.createDataFrame(harvest.parse_keys("a:9000, b,c:200"), "key string, per_hour int")


# -- lookups against snapshots, resumed labelling ------------------------------------------------------------------------------


@query("src2_document_detail", "select c.comment_id, c.attachment_count, f.title, f.comment_url from comments_raw c left join federal_register_comments f on f.document_number = c.document_number")
def _(spark, d):
    """Details of each distinct document joined back to its comments."""
    rows = comments(spark, d).select("comment_id", "attachment_count", "document_number")
    keys = rows.where("document_number is not null").select("document_number").distinct()
    details = keys.join(fr(spark, d).select("document_number", "title", "comment_url"), "document_number")
    return rows.join(details, "document_number", "left").select("comment_id", "attachment_count", "title", "comment_url")


@query("src4_comment_totals", "select f.document_number, coalesce(t.n, 0) as total_elements from federal_register_comments f left join (select document_number, count(distinct comment_id) as n from comments_raw group by 1) t on t.document_number = f.document_number where f.regs_document_id is not null")
def _(spark, d):
    """Number of comments per document; ids are made distinct first, so that one large docket is no single task."""
    totals = ids(spark, d).groupBy("document_number").agg(F.count("*").alias("n"))
    return fr(spark, d).where("regs_document_id is not null").select("document_number").join(totals, "document_number", "left").select("document_number", F.coalesce("n", F.lit(0)).alias("total_elements"))


@query("src6_comment_detail", "select comment_id, max(city) as city, max(zip) as zip, max(page_count) as page_count from comments_raw where comment_id is not null group by 1")
def _(spark, d):
    """Detail fields of each comment, taken from whichever of its rows has them."""
    return comments(spark, d).where("comment_id is not null").groupBy("comment_id").agg(F.max("city").alias("city"), F.max("zip").alias("zip"), F.max("page_count").alias("page_count"))


@query("sm12_resumed_labels", f"select comment_id, r as model_response from (select comment_id, {_REPLY} as r from {_PROMPT}) p where not exists (select 1 from makeup_results m where m.comment_id = p.comment_id)")
def _(spark, d):
    """A second run labels only what the first left over; appending its result any number of times adds nothing twice."""
    left = comments(spark, d).where("comment_id is not null").join(results(spark, d).select("comment_id"), "comment_id", "left_anti")
    return labelling.label(left, labelling.KeyWords()).select("comment_id", "model_response")


@query("cas2_rule_counts", "select label, count(*) as n from makeup_rules group by 1".replace("makeup_rules", "(select case when model = 'metadata' then 'rule' else 'model' end as label from makeup_results)"))
def _(spark, d):
    """Labels by origin: metadata rules or the model."""
    return results(spark, d).groupBy(F.when(F.col("model") == "metadata", "rule").otherwise("model").alias("label")).agg(F.count("*").alias("n"))
