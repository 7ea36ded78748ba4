"""Joins, aggregates, set operations, sorts and windows over the rulemaking tables (JN, AG, SO, SL, WN)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketlens.functions import exprs as X
from docketlens.plans.common import SQL_METRICS, SQL_SAMPLE, SQL_WEIGHTED, agency_metrics, comments, fr, labelled, quoted, r6, results, sample, weighted
from docketlens.plans.scalars import SQL_RULE, SQL_RULE_INPUT

QUERIES, SQL = {}, {}
_MAIN = "case when coalesce(agency, '') = '' then 'Unknown' else trim(string_split(agency, ',')[1]) end"
_SUB = "case when len(string_split(agency, ',')) > 1 then array_to_string(list_transform(string_split(agency, ',')[2:], lambda x: trim(x)), ', ') end"
_DATE = "case when regexp_matches(publication_date, '^\\d{4}-\\d{2}-\\d{2}') then try_cast(substring(publication_date, 1, 10) as date) end"
_CITIZEN = quoted(X.CITIZEN)


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


# -- joins ---------------------------------------------------------------------------------------------------------


@query("jn1_comments_with_labels", "select c.document_number, c.comment_id, r.category, r.model from comments_raw c left join makeup_results r on r.comment_id = c.comment_id")
def _(spark, d):
    """Labels beside comments; a comment labelled twice gives two rows."""
    return comments(spark, d).select("document_number", "comment_id").join(results(spark, d).select("comment_id", "category", "model"), "comment_id", "left").select("document_number", "comment_id", "category", "model")


@query("jn2_labelled_with_agency", "select c.document_number, c.comment_id, r.category, f.agency from comments_raw c join makeup_results r on r.comment_id = c.comment_id left join federal_register_comments f on f.document_number = c.document_number where r.category is not null")
def _(spark, d):
    named = comments(spark, d).select("document_number", "comment_id").join(results(spark, d).where("category is not null").select("comment_id", "category"), "comment_id")
    return named.join(fr(spark, d).select("document_number", "agency"), "document_number", "left").select("document_number", "comment_id", "category", "agency")


@query("jn3_unlabelled", "select document_number, comment_id from comments_raw c where comment_id is not null and not exists (select 1 from makeup_results r where r.comment_id = c.comment_id)")
def _(spark, d):
    return comments(spark, d).where("comment_id is not null").select("document_number", "comment_id").join(results(spark, d).select("comment_id"), "comment_id", "left_anti").select("document_number", "comment_id")


@query("jn4_new_ids", "select distinct comment_id from comments_raw c where comment_id is not null and not exists (select 1 from makeup_data m where m.comment_id = c.comment_id)")
def _(spark, d):
    """Ids of the comment list that the labelled file doesn't hold."""
    return comments(spark, d).where("comment_id is not null").select("comment_id").distinct().join(labelled(spark, d).select("comment_id"), "comment_id", "left_anti")


@query("jn5_sample_with_counts", f"with {SQL_WEIGHTED} select document_number, comment_id, comment_count, comment_bin from weighted")
def _(spark, d):
    return weighted(spark, d).select("document_number", "comment_id", "comment_count", "comment_bin")


@query("jn6_strata_weights", f"with {SQL_WEIGHTED} select p.agency, p.comment_bin, cast(p.n_pop as bigint) as n_pop, d.n_sample, round(p.n_pop::double / d.n_sample, 6) as weight from pop_ p join drawn_ d on d.agency = p.agency and d.comment_bin = p.comment_bin")
def _(spark, d):
    rows = weighted(spark, d).where("matched")
    drawn = rows.groupBy("agency", "comment_bin").agg(F.count("*").alias("n_sample"), F.max("weight").alias("weight"))
    return drawn.select("agency", "comment_bin", F.round(F.col("weight") * F.col("n_sample")).cast("long").alias("n_pop"), "n_sample", r6(F.col("weight")).alias("weight"))


@query("jn7_sample_weights", f"with {SQL_WEIGHTED} select comment_id, n_sample_doc, round(weight, 6) as weight, round(weight_doc, 6) as weight_doc from weighted")
def _(spark, d):
    return weighted(spark, d).select("comment_id", "n_sample_doc", r6(F.col("weight")).alias("weight"), r6(F.col("weight_doc")).alias("weight_doc"))


@query("jn8_shares", f"with {SQL_SAMPLE} select agency, category, count(*) as n, round(count(*)::double / sum(count(*)) over (partition by agency), 6) as share from sample where agency is not null group by 1, 2")
def _(spark, d):
    """Share of each category in its agency, by a window instead of a join of totals."""
    n = sample(spark, d).where("agency is not null").groupBy("agency", "category").agg(F.count("*").alias("n"))
    return n.withColumn("share", r6(F.col("n") / F.sum("n").over(Window.partitionBy("agency"))))


_FR_STATS = f"""with {SQL_WEIGHTED},
est as (select document_number, coalesce(sum(case when category = {_CITIZEN} then weight_doc end), 0) as e from weighted group by 1),
stats as (select f.document_number, f.comment_count, f.count_source, f.publication_date, e.document_number is not null as is_sampled, case when f.comment_count = 0 then 0.0 else e.e end as est from federal_register_comments f left join est e on e.document_number = f.document_number)"""


def document_stats(spark, d):
    """Every document with its estimated citizen comments; the sample of a document is one aggregate, joined once."""
    estimates = weighted(spark, d).groupBy("document_number").agg(F.coalesce(F.sum(F.when(F.col("category") == X.CITIZEN, F.col("weight_doc"))), F.lit(0.0)).alias("e"), F.lit(True).alias("is_sampled"))
    stats = fr(spark, d).select("document_number", "comment_count", "count_source", "publication_date").join(estimates, "document_number", "left")
    return stats.select("document_number", "comment_count", "count_source", "publication_date", F.coalesce("is_sampled", F.lit(False)).alias("is_sampled"), F.when(F.col("comment_count") == 0, 0.0).otherwise(F.col("e")).alias("est"))


@query("jn9_document_stats", f"{_FR_STATS} select document_number, comment_count, is_sampled, round(est, 6) as est from stats")
def _(spark, d):
    return document_stats(spark, d).select("document_number", "comment_count", "is_sampled", r6(F.col("est")).alias("est"))


@query("cas6_citizen_flags", f"{_FR_STATS} select document_number, coalesce(est > 0.5, false) as has_citizens, coalesce(comment_count = 0, false) or is_sampled as has_data, count_source is distinct from 'unknown' as known_count from stats")
def _(spark, d):
    known = ~F.col("count_source").eqNullSafe(F.lit("unknown"))
    return document_stats(spark, d).select("document_number", F.coalesce(F.col("est") > 0.5, F.lit(False)).alias("has_citizens"), (F.coalesce(F.col("comment_count") == 0, F.lit(False)) | F.col("is_sampled")).alias("has_data"), known.alias("known_count"))


@query("jn10_citizen_by_document", f"with {_FR_STATS[5:]} select document_number, cast(max(comment_count) as bigint) as true_total, round(sum(case when category = {_CITIZEN} then weight_doc else 0 end), 6) as citizen_total from weighted group by 1")
def _(spark, d):
    return weighted(spark, d).groupBy("document_number").agg(F.max("comment_count").cast("long").alias("true_total"), r6(F.sum(F.when(F.col("category") == X.CITIZEN, F.col("weight_doc")).otherwise(0.0))).alias("citizen_total"))


_TOP = "top_ as (select document_number from (select document_number, row_number() over (order by comment_count desc nulls last, document_number) as rn from federal_register_comments) where rn <= (select greatest(10, ceil(count(*) * 0.01::double)) from federal_register_comments))"


def top_documents(spark, d, least: int = 10, share: float = 0.01):
    """The largest documents by comment_count: a top-k of data-dependent size, ties by document number.

    The rank that bounds the set is found on (count, documents) pairs, so that no
    global window sees a row per document; only ties at the bound are ranked.
    """
    rows = fr(spark, d).select("document_number", F.coalesce("comment_count", F.lit(-1)).alias("n"))
    per_count = rows.groupBy("n").agg(F.count("*").alias("docs"))
    total = rows.agg(F.greatest(F.lit(least), F.ceil(F.count("*") * F.lit(share))).cast("long").alias("k"))
    above = per_count.withColumn("before", F.sum("docs").over(Window.orderBy(F.desc("n")).rowsBetween(Window.unboundedPreceding, -1)))
    cut = above.crossJoin(F.broadcast(total)).where(F.coalesce("before", F.lit(0)) < F.col("k")).select("n", (F.col("k") - F.coalesce("before", F.lit(0))).alias("room"), "docs")
    near = rows.join(cut, "n").withColumn("rn", F.row_number().over(Window.partitionBy("n").orderBy("document_number")))
    return near.where("docs <= room or rn <= room").select("document_number")


@query("jn11_without_top_documents", f"with {SQL_SAMPLE}, {_TOP} select comment_id, category from sample s where not exists (select 1 from top_ t where t.document_number = s.document_number)")
def _(spark, d):
    return sample(spark, d).join(top_documents(spark, d), "document_number", "left_anti").select("comment_id", "category")


@query("jn12_large_sub_agencies", f"with {SQL_SAMPLE}, h as (select *, {_MAIN} as main_agency, coalesce({_SUB}, {_MAIN}) as sub from sample) select comment_id, main_agency, sub from (select *, count(*) over (partition by main_agency, sub) as n from h) where n >= 50")
def _(spark, d):
    h = sample(spark, d).select("comment_id", X.main_agency("agency").alias("main_agency"), F.coalesce(X.sub_agency("agency"), X.main_agency("agency")).alias("sub"))
    large = h.groupBy("main_agency", "sub").agg(F.count("*").alias("n")).where("n >= 50")
    return h.join(large, ["main_agency", "sub"], "left_semi").select("comment_id", "main_agency", "sub")


@query("jn14_category_order", f"with {SQL_SAMPLE}, o(category, ord) as (values {', '.join(f'({quoted(x)}, {i + 1})' for i, x in enumerate(X.CATEGORIES))}) select o.category, o.ord, count(s.comment_id) as n from o left join sample s on s.category = o.category group by 1, 2")
def _(spark, d):
    order = spark.createDataFrame([(x, i + 1) for i, x in enumerate(X.CATEGORIES)], "category string, ord int")
    n = sample(spark, d).groupBy("category").agg(F.count("*").alias("n"))
    return order.join(n, "category", "left").select("category", "ord", F.coalesce("n", F.lit(0)).alias("n"))


@query("jn15_lookup_probe", "select c.comment_id, f.title, f.submission_channel from comments_raw c join federal_register_comments f on f.document_number = c.document_number")
def _(spark, d):
    return comments(spark, d).select("comment_id", "document_number").join(fr(spark, d).select("document_number", "title", "submission_channel"), "document_number").select("comment_id", "title", "submission_channel")


@query("jn16_documents_with_counts", "select m.document_number, m.labelled, f.comment_count from (select document_number, count(*) as labelled from makeup_data group by 1) m left join (select distinct document_number, comment_count from federal_register_comments) f on f.document_number = m.document_number")
def _(spark, d):
    """Labelled rows per document beside the document's comment count."""
    per = labelled(spark, d).groupBy("document_number").agg(F.count("*").alias("labelled"))
    return per.join(fr(spark, d).select("document_number", "comment_count").distinct(), "document_number", "left")


# -- aggregates ----------------------------------------------------------------------------------------------------


@query("ag1_strata", "select agency, case when comment_count <= 10 then '0-10' when comment_count <= 100 then '11-100' when comment_count <= 1000 then '101-1000' when comment_count <= 10000 then '1001-10000' else '10000+' end as comment_bin, cast(sum(comment_count) as bigint) as total, count(*) as num_docs, min(document_number) as first_doc from federal_register_comments where regs_document_id is not null and comment_count > 0 group by 1, 2")
def _(spark, d):
    """Strata of minable documents; the documents stay rows, a stratum holds only figures."""
    rows = fr(spark, d).where("regs_document_id is not null and comment_count > 0")
    return rows.groupBy("agency", X.comment_bin("comment_count").alias("comment_bin")).agg(F.sum("comment_count").alias("total"), F.count("*").alias("num_docs"), F.min("document_number").alias("first_doc"))


@query("ag2_value_counts", " union all ".join(f"select '{c}' as field, {c} as value, count(*) as n from federal_register_comments where {c} is not null group by 2" for c in ("eligibility_reason", "count_source", "submission_channel", "agency")))
def _(spark, d):
    """Counts of four columns in one pass."""
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("value")) for c in ("eligibility_reason", "count_source", "submission_channel", "agency")])
    return fr(spark, d).select(F.explode(fields).alias("f")).select("f.*").where("value is not null").groupBy("field", "value").agg(F.count("*").alias("n"))


@query("ag3_describe", "select count(*) as n, round(avg(x), 6) as mean, min(x) as least, round(quantile_cont(x, 0.25), 6) as p25, round(quantile_cont(x, 0.5), 6) as p50, round(quantile_cont(x, 0.75), 6) as p75, max(x) as most from (select coalesce(comment_count, 0)::double as x from federal_register_comments)")
def _(spark, d):
    x = F.coalesce("comment_count", F.lit(0)).cast("double")
    q = lambda p: r6(F.expr(f"percentile(x, {p}D)"))
    return fr(spark, d).select(x.alias("x")).agg(F.count("*").alias("n"), r6(F.avg("x")).alias("mean"), F.min("x").alias("least"), q(0.25).alias("p25"), q(0.5).alias("p50"), q(0.75).alias("p75"), F.max("x").alias("most"))


@query("ag8_stratum_totals", f"with {SQL_WEIGHTED} select agency, comment_bin, count(*) as n_sample, round(sum(weight), 4) as n_population from weighted where matched group by 1, 2")
def _(spark, d):
    return weighted(spark, d).where("matched").groupBy("agency", "comment_bin").agg(F.count("*").alias("n_sample"), F.round(F.sum("weight"), 4).alias("n_population"))


@query("ag9_document_weights", f"with {SQL_WEIGHTED} select document_number, count(*) as n, round(sum(weight_doc), 4) as total, round(max(weight_doc), 6) as w from weighted group by 1")
def _(spark, d):
    return weighted(spark, d).groupBy("document_number").agg(F.count("*").alias("n"), F.round(F.sum("weight_doc"), 4).alias("total"), r6(F.max("weight_doc")).alias("w"))


@query("ag10_weight_diagnostics", f"with {SQL_WEIGHTED} select count(*) as n, count(*) filter (where weight = 1.0) as weight_one, count(*) filter (where not matched) as unmatched, round(avg(weight), 6) as mean_weight, round(max(weight), 6) as max_weight, round(100.0 * count(*) filter (where not matched) / count(*), 6) as unmatched_pct from weighted")
def _(spark, d):
    return weighted(spark, d).agg(F.count("*").alias("n"), F.count_if(F.col("weight") == 1.0).alias("weight_one"), F.count_if(~F.col("matched")).alias("unmatched"), r6(F.avg("weight")).alias("mean_weight"), r6(F.max("weight")).alias("max_weight"), r6(F.expr("try_divide(100.0D * count_if(not matched), count(*))")).alias("unmatched_pct"))


_M = ", ".join([f"round(n_{i}, 4) as n_{i}, round(share_{i}, 6) as share_{i}" for i in range(5)])


@query("ag11_agency_metrics", f"with {SQL_METRICS} select agency, round(total, 4) as total, {_M}, round(x, 6) as x, round(y, 6) as y from metrics")
def _(spark, d):
    m = agency_metrics(weighted(spark, d))
    return m.select("agency", F.round("total", 4).alias("total"), *[F.round(f"n_{i}", 4).alias(f"n_{i}") for i in range(5)], *[r6(F.col(f"share_{i}")).alias(f"share_{i}") for i in range(5)], r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query("ag12_composition", f"""with {SQL_WEIGHTED}, {_TOP}, m as (select w.category, sum(weight) as a, sum(case when t.document_number is null then weight else 0 end) as b from weighted w left join top_ t on t.document_number = w.document_number group by 1)
select category, round(100 * a / sum(a) over (), 6) as pct, round(100 * b / sum(b) over (), 6) as pct_without, round(100 * b / sum(b) over () - 100 * a / sum(a) over (), 6) as difference from m""")
def _(spark, d):
    """Composition of all comments and without the largest documents, from one pass."""
    rows = weighted(spark, d).join(top_documents(spark, d).withColumn("top", F.lit(True)), "document_number", "left")
    m = rows.groupBy("category").agg(F.sum("weight").alias("a"), F.sum(F.when(F.col("top").isNull(), F.col("weight")).otherwise(0.0)).alias("b"))
    everything = Window.partitionBy()  # five rows
    a, b = 100 * F.col("a") / F.sum("a").over(everything), 100 * F.col("b") / F.sum("b").over(everything)
    return m.select("category", r6(a).alias("pct"), r6(b).alias("pct_without"), r6(b - a).alias("difference"))


@query("ag13_document_citizens", f"with {SQL_WEIGHTED} select document_number, max(comment_count) as total, round(sum(case when category = {_CITIZEN} then weight_doc else 0 end), 6) as citizens, sum(case when category = {_CITIZEN} then weight_doc else 0 end) <= max(comment_count) + 0.000001 as plausible from weighted group by 1")
def _(spark, d):
    citizens = F.sum(F.when(F.col("category") == X.CITIZEN, F.col("weight_doc")).otherwise(0.0))
    return weighted(spark, d).groupBy("document_number").agg(F.max("comment_count").alias("total"), r6(citizens).alias("citizens"), (citizens <= F.max("comment_count") + 0.000001).alias("plausible"))


_DOCSHARE = ", ".join(f"round(coalesce(sum(case when category = {quoted(x)} then weight_doc end), 0) / sum(weight_doc), 6) as share_{i}" for i, x in enumerate(X.CATEGORIES))


def document_shares(spark, d):
    """Per document: comment_count and the share of each category by document weight; documents without comments are left out."""
    share = lambda x: F.expr("try_divide(v, w)") if x is None else F.try_divide(F.coalesce(F.sum(F.when(F.col("category") == x, F.col("weight_doc"))), F.lit(0.0)), F.sum("weight_doc"))
    return weighted(spark, d).where("comment_count > 0").groupBy("document_number").agg(F.max("comment_count").alias("comment_count"), *[share(x).alias(f"share_{i}") for i, x in enumerate(X.CATEGORIES)])


@query("ag14_document_composition", f"with {SQL_WEIGHTED} select document_number, max(comment_count) as comment_count, {_DOCSHARE} from weighted where comment_count > 0 group by 1")
def _(spark, d):
    return document_shares(spark, d).select("document_number", "comment_count", *[r6(F.col(f"share_{i}")).alias(f"share_{i}") for i in range(5)])


_HIER = f"hier as (select {_MAIN} as main_agency, coalesce({_SUB}, {_MAIN}) as sub, category, sum(weight) as n from weighted group by 1, 2, 3), hs as (select *, sum(n) over (partition by main_agency, sub) as sub_total, sum(n) over (partition by main_agency) as main_total from hier)"


def hierarchy(spark, d):
    """Weight per main agency, sub-agency and category with both totals; totals are windows over the aggregate."""
    rows = weighted(spark, d).withColumn("main_agency", X.main_agency("agency")).withColumn("sub", F.coalesce(X.sub_agency("agency"), "main_agency"))
    n = rows.groupBy("main_agency", "sub", "category").agg(F.sum("weight").alias("n"))
    return n.withColumn("sub_total", F.sum("n").over(Window.partitionBy("main_agency", "sub"))).withColumn("main_total", F.sum("n").over(Window.partitionBy("main_agency")))


@query("ag15_hierarchy_metrics", f"with {SQL_WEIGHTED}, {_HIER} select main_agency, sub, category, round(n, 4) as n, round(sub_total, 4) as sub_total, round(n / case when sub_total > 0 then sub_total else 1 end, 6) as share, round(main_total, 4) as main_total from hs")
def _(spark, d):
    h = hierarchy(spark, d)
    return h.select("main_agency", "sub", "category", F.round("n", 4).alias("n"), F.round("sub_total", 4).alias("sub_total"), r6(F.col("n") / F.when(F.col("sub_total") > 0, F.col("sub_total")).otherwise(1.0)).alias("share"), F.round("main_total", 4).alias("main_total"))


_ORD = "case category " + " ".join(f"when {quoted(x)} then {i + 1}" for i, x in enumerate(X.CATEGORIES)) + " end"


@query("ag16_dominant_category", f"with {SQL_WEIGHTED}, {_HIER} select main_agency, sub, category, round(n / sub_total, 6) as share from (select *, row_number() over (partition by main_agency, sub order by round(n, 6) desc, {_ORD}) as rn from hs) where rn = 1")
def _(spark, d):
    best = F.max_by(F.struct("category", "n", "sub_total"), F.struct(F.round("n", 6), -X.category_order("category")))
    return hierarchy(spark, d).groupBy("main_agency", "sub").agg(best.alias("b")).select("main_agency", "sub", "b.category", r6(F.col("b.n") / F.col("b.sub_total")).alias("share"))


@query("ag17_flow_edges", f"with {SQL_WEIGHTED}, {_HIER} select 'All' as source, main_agency as target, cast(floor(round(sum(n), 6)) as bigint) as value from hs group by main_agency union all select main_agency, main_agency || ' / ' || sub, cast(floor(round(sum(n), 6)) as bigint) from hs group by main_agency, sub union all select main_agency || ' / ' || sub, category, cast(floor(round(n, 6)) as bigint) from hs")
def _(spark, d):
    h = hierarchy(spark, d)
    whole = lambda x: F.floor(F.round(x, 6)).cast("long").alias("value")
    path = F.concat("main_agency", F.lit(" / "), "sub")
    top = h.groupBy("main_agency").agg(whole(F.sum("n"))).select(F.lit("All").alias("source"), F.col("main_agency").alias("target"), "value")
    middle = h.groupBy("main_agency", "sub").agg(whole(F.sum("n"))).select(F.col("main_agency").alias("source"), path.alias("target"), "value")
    return top.unionByName(middle).unionByName(h.select(path.alias("source"), F.col("category").alias("target"), whole(F.col("n"))))


@query("ag18_participation", "with k as (select comment_count as n from federal_register_comments where count_source is distinct from 'unknown' and comment_count is not null) select count(*) as known_docs, count(*) filter (where n = 0) as zero_docs, round(100.0 * count(*) filter (where n = 0) / count(*), 6) as zero_pct, round(quantile_cont(case when n > 0 then n::double end, 0.5), 6) as nonzero_median, round(100.0 * count(*) filter (where n <= 5) / count(*), 6) as at_most_five_pct from k")
def _(spark, d):
    k = fr(spark, d).where(~F.col("count_source").eqNullSafe(F.lit("unknown")) & F.col("comment_count").isNotNull()).select(F.col("comment_count").alias("n"))
    pct = lambda cond: r6(F.expr(f"try_divide(100.0D * count_if({cond}), count(*))"))
    return k.agg(F.count("*").alias("known_docs"), F.count_if(F.col("n") == 0).alias("zero_docs"), pct("n = 0").alias("zero_pct"), r6(F.expr("percentile(if(n > 0, n, null), 0.5D)")).alias("nonzero_median"), pct("n <= 5").alias("at_most_five_pct"))


@query("ag18_log_histogram", "with k as (select log10(comment_count::double) as x from federal_register_comments where comment_count > 0), b as (select min(x) as lo, (max(x) - min(x)) / 30 as w from k) select cast(least(29, floor((x - lo) / w)) as int) as bin, count(*) as n from k, b group by 1")
def _(spark, d):
    k = fr(spark, d).where("comment_count > 0").select(F.log10(F.col("comment_count").cast("double")).alias("x"))
    bounds = k.agg(F.min("x").alias("lo"), ((F.max("x") - F.min("x")) / 30).alias("w"))
    return k.crossJoin(F.broadcast(bounds)).groupBy(F.least(F.lit(29), F.floor(F.try_divide(F.col("x") - F.col("lo"), F.col("w")))).cast("int").alias("bin")).agg(F.count("*").alias("n"))


_VOL = "case when comment_count <= 1 then '1' when comment_count <= 5 then '2-5' when comment_count <= 10 then '6-10' when comment_count <= 50 then '11-50' when comment_count <= 100 then '51-100' else '100+' end"


@query("ag19_citizens_by_volume", f"{_FR_STATS} select {_VOL} as volume, count(*) as n, round(100 * avg(case when est > 0.5 then 1.0 else 0.0 end), 6) as pct from stats where comment_count > 0 and is_sampled group by 1")
def _(spark, d):
    rows = document_stats(spark, d).where("comment_count > 0 and is_sampled")
    return rows.groupBy(X.volume_bin("comment_count").alias("volume")).agg(F.count("*").alias("n"), r6(100 * F.avg(F.when(F.col("est") > 0.5, 1.0).otherwise(0.0))).alias("pct"))


@query("ag20_document_statistics", f"{_FR_STATS} select count(*) as docs, count(*) filter (where is_sampled) as sampled, count(*) filter (where est > 0.5) as with_citizens, round(sum(est), 4) as citizens from stats")
def _(spark, d):
    return document_stats(spark, d).agg(F.count("*").alias("docs"), F.count_if("is_sampled").alias("sampled"), F.count_if(F.col("est") > 0.5).alias("with_citizens"), F.round(F.sum("est"), 4).alias("citizens"))


@query("ag21_zero_clustering", f"with z as (select date_trunc('month', {_DATE})::date as m from federal_register_comments where comment_count = 0), g as (select m, count(*) as n from z where m is not null group by 1), l as (select *, row_number() over (order by m desc) as rn from g) select count(*) as months, cast(sum(n) filter (where rn <= 3) as bigint) as last_three, (select count(*) from z) as total, round(100.0 * sum(n) filter (where rn <= 3) / (select count(*) from z), 6) as pct, count(*) >= 3 and 100.0 * sum(n) filter (where rn <= 3) / (select count(*) from z) > 30 as clustered from l")
def _(spark, d):
    """Whether documents without comments crowd in the last three months that have any."""
    zero = fr(spark, d).where("comment_count = 0").select(F.trunc(X.iso_date("publication_date"), "month").alias("m"))
    months = zero.where("m is not null").groupBy("m").agg(F.count("*").alias("n"))
    ranked = months.withColumn("rn", F.row_number().over(Window.orderBy(F.desc("m"))))  # a row per month
    g = ranked.agg(F.count("*").alias("months"), F.sum(F.when(F.col("rn") <= 3, F.col("n"))).alias("last_three")).crossJoin(F.broadcast(zero.agg(F.count("*").alias("total"))))
    pct = F.try_divide(100.0 * F.col("last_three"), F.col("total"))
    return g.select("months", "last_three", "total", r6(pct).alias("pct"), ((F.col("months") >= 3) & (pct > 30)).alias("clustered"))


@query("ag31_narrative", f"with {SQL_WEIGHTED}, {_TOP.replace('greatest(10, ceil(count(*) * 0.01::double))', 'greatest(1, ceil(count(*) * 0.01::double))')}, f as (select f.*, t.document_number is not null as top from federal_register_comments f left join top_ t using (document_number)) select (select count(*) from weighted) as n, (select round(sum(weight), 4) from weighted) as total, (select round(sum(case when category = {_CITIZEN} then weight else 0 end), 4) from weighted) as citizens, count(*) filter (where comment_count = 0 and count_source is distinct from 'unknown') as zero_docs, round(100.0 * sum(case when top then comment_count end) / sum(comment_count), 6) as top_share from f")
def _(spark, d):
    w = weighted(spark, d).agg(F.count("*").alias("n"), F.round(F.sum("weight"), 4).alias("total"), F.round(F.sum(F.when(F.col("category") == X.CITIZEN, F.col("weight")).otherwise(0.0)), 4).alias("citizens"))
    f = fr(spark, d).join(top_documents(spark, d, 1).withColumn("top", F.lit(True)), "document_number", "left")
    g = f.agg(F.count_if((F.col("comment_count") == 0) & ~F.col("count_source").eqNullSafe(F.lit("unknown"))).alias("zero_docs"), r6(F.try_divide(100.0 * F.sum(F.when(F.col("top"), F.col("comment_count"))), F.sum("comment_count"))).alias("top_share"))
    return w.crossJoin(F.broadcast(g))


@query("ag32_spotlight", f"with {SQL_METRICS} select * from (select 'citizen' as metric, agency, round(share_1, 6) as value from metrics order by value desc, agency limit 1) union all select * from (select 'organization', agency, round(share_2, 6) as value from metrics order by value desc, agency limit 1) union all select * from (select 'expert', agency, round(share_3, 6) as value from metrics order by value desc, agency limit 1) union all select * from (select 'lobbyist', agency, round(share_4, 6) as value from metrics order by value desc, agency limit 1)")
def _(spark, d):
    """Agency with the greatest share of each of four categories, the first by name on a tie."""
    m = agency_metrics(weighted(spark, d))
    long = m.select("agency", F.explode(F.array(*[F.struct(F.lit(name).alias("metric"), F.round(f"share_{i}", 6).alias("value")) for i, name in ((1, "citizen"), (2, "organization"), (3, "expert"), (4, "lobbyist"))])).alias("v")).select("agency", "v.*")
    top = long.groupBy("metric").agg(F.max("value").alias("value"))
    return long.join(top, ["metric", "value"]).groupBy("metric", "value").agg(F.min("agency").alias("agency")).select("metric", "agency", "value")


@query("ag33_coverage_report", "select count(*) as n, count(*) filter (where coalesce(organization, '') <> '') as with_org, count(*) filter (where coalesce(first_name, '') <> '' or coalesce(last_name, '') <> '') as with_name, count(*) filter (where has_attachments) as with_attachment, count(*) filter (where coalesce(comment_text, '') = '') as empty_text, count(*) filter (where length(comment_text) between 1 and 49) as minimal_text, count(*) filter (where coalesce(comment_text, '') = '' and coalesce(attachment_text, '') = '') as no_content, round(100.0 * count(*) filter (where coalesce(organization, '') <> '') / count(*), 6) as org_pct from comments_raw")
def _(spark, d):
    return comments(spark, d).agg(
        F.count("*").alias("n"), F.count_if(X.filled("organization").isNotNull()).alias("with_org"), F.count_if(X.first_filled("first_name", "last_name").isNotNull()).alias("with_name"), F.count_if("has_attachments").alias("with_attachment"), F.count_if(X.filled("comment_text").isNull()).alias("empty_text"),
        F.count_if(F.length("comment_text").between(1, 49)).alias("minimal_text"), F.count_if(X.first_filled("comment_text", "attachment_text").isNull()).alias("no_content"), r6(F.try_divide(100.0 * F.count_if(X.filled("organization").isNotNull()), F.count("*"))).alias("org_pct"),
    )


@query("ag34_category_breakdown", "select category, count(*) as n, round(100.0 * count(*) / sum(count(*)) over (), 6) as pct from makeup_results group by 1")
def _(spark, d):
    n = results(spark, d).groupBy("category").agg(F.count("*").alias("n"))
    return n.crossJoin(F.broadcast(n.agg(F.sum("n").alias("total")))).select("category", "n", r6(100.0 * F.col("n") / F.col("total")).alias("pct"))


@query("ag35_phase_report", f"select count(*) as n, count(*) filter (where label is not null) as by_rule, count(*) filter (where label is null and not has) as excluded, count(*) filter (where label is null and has) as to_label from (select {SQL_RULE} as label, trim(coalesce(comment_text, '')) <> '' or trim(coalesce(attachment_text, '')) <> '' as has from {SQL_RULE_INPUT})")
def _(spark, d):
    rows = comments(spark, d).select(X.author_rule("organization", "first_name", "last_name", "gov_agency", "submitter_type").alias("label"), ((F.trim(F.coalesce("comment_text", F.lit(""))) != "") | (F.trim(F.coalesce("attachment_text", F.lit(""))) != "")).alias("has"))
    return rows.agg(F.count("*").alias("n"), F.count_if(F.col("label").isNotNull()).alias("by_rule"), F.count_if(F.col("label").isNull() & ~F.col("has")).alias("excluded"), F.count_if(F.col("label").isNull() & F.col("has")).alias("to_label"))


_QUAD = "case when round(x, 9) >= 0 and round(y, 9) >= 0.5 then 1 when round(x, 9) < 0 and round(y, 9) >= 0.5 then 2 when round(x, 9) >= 0 and round(y, 9) < 0.5 then 3 else 4 end"


def with_quadrant(m):
    return m.withColumn("quadrant", X.quadrant(F.round("x", 9), F.round("y", 9)))


@query("cas5_quadrant", f"with {SQL_METRICS} select agency, {_QUAD} as quadrant from metrics")
def _(spark, d):
    return with_quadrant(agency_metrics(weighted(spark, d))).select("agency", "quadrant")


@query("ag36_quadrant_stats", f"with {SQL_METRICS} select {_QUAD} as quadrant, count(*) as agencies, round(sum(total), 4) as total from metrics group by 1")
def _(spark, d):
    return with_quadrant(agency_metrics(weighted(spark, d))).groupBy("quadrant").agg(F.count("*").alias("agencies"), F.round(F.sum("total"), 4).alias("total"))


@query("ag37_distinct", "select count(distinct document_number) as documents, count(distinct comment_id) as comments, count(distinct organization) as organizations from comments_raw")
def _(spark, d):
    """Distinct counts, each by its own two-phase aggregate over one expanded pass."""
    return comments(spark, d).agg(F.countDistinct("document_number").alias("documents"), F.countDistinct("comment_id").alias("comments"), F.countDistinct("organization").alias("organizations"))


@query("ag39_weight_histogram", f"with {SQL_WEIGHTED}, k as (select log10(weight) as x from weighted where weight > 0), b as (select min(x) as lo, (max(x) - min(x)) / 50 as w from k) select cast(least(49, floor(round((x - lo) / w, 9))) as int) as bin, count(*) as n from k, b group by 1")
def _(spark, d):
    k = weighted(spark, d).where("weight > 0").select(F.log10("weight").alias("x"))
    bounds = k.agg(F.min("x").alias("lo"), ((F.max("x") - F.min("x")) / 50).alias("w"))
    return k.crossJoin(F.broadcast(bounds)).groupBy(F.least(F.lit(49), F.floor(F.round(F.try_divide(F.col("x") - F.col("lo"), F.col("w")), 9))).cast("int").alias("bin")).agg(F.count("*").alias("n"))


@query("ag41_zero_comment_agencies", "select agency, count(*) as docs from federal_register_comments where agency is not null group by 1 having sum(coalesce(comment_count, 0)) = 0")
def _(spark, d):
    return fr(spark, d).where("agency is not null").groupBy("agency").agg(F.count("*").alias("docs"), F.sum(F.coalesce("comment_count", F.lit(0))).alias("s")).where("s = 0").select("agency", "docs")


# -- windows, sorts, sets --------------------------------------------------------------------------------------------


@query("wn7_top_per_quadrant", f"with {SQL_METRICS} select agency, quadrant, rn from (select agency, {_QUAD} as quadrant, row_number() over (partition by {_QUAD} order by round(total, 6) desc, agency) as rn from metrics) where rn <= (select greatest(2, least(15, floor(count(*) * 0.05::double))) from metrics)")
def _(spark, d):
    m = with_quadrant(agency_metrics(weighted(spark, d)))
    ranked = m.withColumn("rn", F.row_number().over(Window.partitionBy("quadrant").orderBy(F.desc(F.round("total", 6)), "agency")))
    size = m.agg(F.greatest(F.lit(2), F.least(F.lit(15), F.floor(F.count("*") * F.lit(0.05)))).alias("k"))
    return ranked.crossJoin(F.broadcast(size)).where("rn <= k").select("agency", "quadrant", "rn")


@query("wn9_keep_first", "select comment_id, document_number, has_attachments, posted_date from (select *, row_number() over (partition by comment_id order by (has_attachments is true) desc, coalesce(attachment_count, 0) desc, coalesce(length(attachment_text), 0) desc, posted_date, document_number) as rn from comments_raw) where rn = 1")
def _(spark, d):
    """One row per comment; of repeats the one that has the attachment."""
    has = F.coalesce("has_attachments", F.lit(False)).cast("int")
    order = Window.partitionBy("comment_id").orderBy(F.desc(has), F.desc(F.coalesce("attachment_count", F.lit(0))), F.desc(F.coalesce(F.length("attachment_text"), F.lit(0))), "posted_date", "document_number")
    return comments(spark, d).withColumn("rn", F.row_number().over(order)).where("rn = 1").select("comment_id", "document_number", "has_attachments", "posted_date")


@query("sl1_multi_key_sort", "select agency, submission_channel, count(*) as n from federal_register_comments group by 1, 2 order by n desc, agency, submission_channel")
def _(spark, d):
    return fr(spark, d).groupBy("agency", "submission_channel").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "agency", "submission_channel")


@query("sl2_top_three", "select document_number, comment_count from federal_register_comments where comment_count is not null order by comment_count desc, document_number limit 3")
def _(spark, d):
    return fr(spark, d).where("comment_count is not null").select("document_number", "comment_count").orderBy(F.desc("comment_count"), "document_number").limit(3)


@query("sl3_largest_documents", f"with {_TOP} select document_number from top_")
def _(spark, d):
    return top_documents(spark, d)


@query("sl4_head", "select document_number, publication_date from federal_register_comments order by publication_date nulls first, document_number limit 100")
def _(spark, d):
    return fr(spark, d).select("document_number", "publication_date").orderBy(F.asc_nulls_first("publication_date"), "document_number").limit(100)


@query("sl5_head_and_tail", "select * from (select agency, count(*) as n, 'most' as part from federal_register_comments where agency is not null group by 1 order by n desc, agency limit 5) union all select * from (select agency, count(*) as n, 'least' from federal_register_comments where agency is not null group by 1 order by n, agency limit 5)")
def _(spark, d):
    n = fr(spark, d).where("agency is not null").groupBy("agency").agg(F.count("*").alias("n"))
    return n.orderBy(F.desc("n"), "agency").limit(5).withColumn("part", F.lit("most")).unionByName(n.orderBy("n", "agency").limit(5).withColumn("part", F.lit("least")))


@query("sl6_scaled_k", "select greatest(2, least(15, cast(floor(n * 0.05::double) as bigint))) as k1, least(30, greatest(10, cast(floor(n * 0.25::double) as bigint))) as k2, least(20, greatest(8, cast(floor(n * 0.15::double) as bigint))) as k3, greatest(10, cast(ceil(n * 0.01::double) as bigint)) as k4 from (select count(distinct agency) as n from federal_register_comments)")
def _(spark, d):
    n = fr(spark, d).agg(F.countDistinct("agency").alias("n"))
    low = lambda s: F.floor(F.col("n") * F.lit(s)).cast("long")
    return n.select(F.greatest(F.lit(2).cast("long"), F.least(F.lit(15).cast("long"), low(0.05))).alias("k1"), F.least(F.lit(30).cast("long"), F.greatest(F.lit(10).cast("long"), low(0.25))).alias("k2"), F.least(F.lit(20).cast("long"), F.greatest(F.lit(8).cast("long"), low(0.15))).alias("k3"), F.greatest(F.lit(10).cast("long"), F.ceil(F.col("n") * F.lit(0.01)).cast("long")).alias("k4"))


@query("so1_evolving_union", "select comment_id, category, model_response, model, cast(null as varchar) as agency, cast(null as varchar) as document_number from makeup_results union all select comment_id, category, null, null, agency, document_number from makeup_data")
def _(spark, d):
    return results(spark, d).select("comment_id", "category", "model_response", "model").unionByName(labelled(spark, d), allowMissingColumns=True)


@query("so2_union_keep_first", "select comment_id, category from (select *, row_number() over (partition by comment_id order by p, category) as rn from (select comment_id, category, 0 as p from makeup_data union all select comment_id, category, 1 from makeup_results)) where rn = 1")
def _(spark, d):
    both = labelled(spark, d).select("comment_id", "category", F.lit(0).alias("p")).unionByName(results(spark, d).select("comment_id", "category", F.lit(1).alias("p")))
    return both.groupBy("comment_id").agg(F.min(F.struct("p", "category")).alias("m")).select("comment_id", "m.category")


@query("so3_branches", "select document_number, case when coalesce(regs_document_id, '') <> '' then 'regs' else 'other' end as branch, comment_count from federal_register_comments")
def _(spark, d):
    return fr(spark, d).select("document_number", F.when(X.filled("regs_document_id").isNotNull(), "regs").otherwise("other").alias("branch"), "comment_count")


@query("so4_difference", "select distinct document_number from federal_register_comments f where not exists (select 1 from comments_raw c where c.document_number = f.document_number)")
def _(spark, d):
    return fr(spark, d).select("document_number").distinct().join(comments(spark, d).select("document_number"), "document_number", "left_anti")
