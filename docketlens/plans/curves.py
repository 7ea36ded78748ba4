"""Concentration, calendars, ribbons, trends and ranked streams, and the chart tables built from them (AG22-30, WN1-8, CH)."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from docketlens.functions import exprs as X
from docketlens.operators.concentration import gini, thresholds, value_counts
from docketlens.operators.ordering import ranked, smoothed
from docketlens.plans.common import SQL_METRICS, SQL_WEIGHTED, agency_metrics, fr, quoted, r6, weighted
from docketlens.plans.relational import _FR_STATS, document_shares, document_stats

QUERIES, SQL = {}, {}
_DATE = "case when regexp_matches(publication_date, '^\\d{4}-\\d{2}-\\d{2}') then try_cast(substring(publication_date, 1, 10) as date) end"
_CITIZEN = quoted(X.CITIZEN)
YEAR = 2020


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return put


# -- concentration ---------------------------------------------------------------------------------------------------

_COUNTS = "c as (select greatest(coalesce(comment_count, 0), 0) as v, document_number from federal_register_comments where submission_channel = 'regs.gov')"


def regs(spark, d):
    return fr(spark, d).where("submission_channel = 'regs.gov'").select("document_number", F.greatest(F.coalesce("comment_count", F.lit(0)), F.lit(0)).alias("v"))


_GINI = "case when sum(v) <= 0 then 0.0 when count(*) = 1 then 1.0 else 1 - 2 * (sum(y) - (min(y) + 1) / 2) / (count(*) - 1) end"


@query("ag22_gini", f"with {_COUNTS}, l as (select v, sum(v) over (order by v, document_number rows unbounded preceding)::double / (select sum(v) from c) as y from c) select count(*) as docs, cast(sum(v) as bigint) as total, round({_GINI}, 6) as gini from l")
def _(spark, d):
    """Gini of the counts in one channel, unknown counts as 0."""
    return gini(value_counts(regs(spark, d), "v")).select("docs", "total", r6(F.col("gini")).alias("gini"))


@query("ag22_gini_known", f"with c as (select comment_count as v, document_number from federal_register_comments where comment_count is not null), l as (select v, sum(v) over (order by v, document_number rows unbounded preceding)::double / (select sum(v) from c) as y from c) select count(*) as docs, cast(sum(v) as bigint) as total, round({_GINI}, 6) as gini from l")
def _(spark, d):
    """Gini of known counts over all channels."""
    return gini(value_counts(fr(spark, d).where("comment_count is not null"), "comment_count")).select("docs", "total", r6(F.col("gini")).alias("gini"))


@query("ag22_lorenz", f"with {_COUNTS} select document_number, round((row_number() over (order by v, document_number) - 1) / greatest((select count(*) from c) - 1, 1)::double, 6) as x, round(sum(v) over (order by v, document_number rows unbounded preceding)::double / (select sum(v) from c), 6) as y from c")
def _(spark, d):
    rows = ranked(regs(spark, d), [F.col("v"), F.col("document_number")], ["v"], "lorenz")
    total = rows.agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    return rows.crossJoin(F.broadcast(total)).select("document_number", r6((F.col("rank") - 1) / F.greatest(F.col("n") - 1, F.lit(1))).alias("x"), r6(F.try_divide(F.col("cum_v"), F.col("s"))).alias("y"))


@query("ag23_frontier", f"with {_COUNTS} select document_number, round(row_number() over (order by v desc, document_number)::double / (select count(*) from c), 6) as x, round(sum(v) over (order by v desc, document_number rows unbounded preceding)::double / (select sum(v) from c), 6) as y from c")
def _(spark, d):
    rows = ranked(regs(spark, d), [F.desc("v"), F.col("document_number")], ["v"], "frontier")
    total = rows.agg(F.count("*").alias("n"), F.sum("v").alias("s"))
    return rows.crossJoin(F.broadcast(total)).select("document_number", r6(F.col("rank") / F.col("n")).alias("x"), r6(F.try_divide(F.col("cum_v"), F.col("s"))).alias("y"))


_COV = ", ".join(f"round(max(case when i = ceil((select count(*) from c) * {t / 100}::double) then y end), 6) as coverage_top_{t}pct_docs" for t in (1, 5, 10))
_SHARE = ", ".join(f"round(least(count(*) filter (where m < {t / 100}::double * (select sum(v) from c)) + 1, count(*))::double / count(*), 6) as docs_share_for_{t}pct_comments" for t in (50, 80, 90, 95))
_THRESHOLDS = f"with {_COUNTS}, f as (select row_number() over (order by v desc, document_number) as i, sum(v) over (order by v desc, document_number rows unbounded preceding) as m, sum(v) over (order by v desc, document_number rows unbounded preceding)::double / (select sum(v) from c) as y from c) select {_COV}, {_SHARE} from f"


@query("ag24_threshold_metrics", _THRESHOLDS)
def _(spark, d):
    t = thresholds(value_counts(regs(spark, d), "v"))
    return t.select(*[r6(F.col(c)).alias(c) for c in t.columns])


@query("snk4_metrics_row", f"select * from ({_THRESHOLDS}), (with {_COUNTS}, l as (select v, sum(v) over (order by v, document_number rows unbounded preceding)::double / (select sum(v) from c) as y from c) select count(*) as docs_total, cast(sum(v) as bigint) as comments_total, round({_GINI}, 6) as gini from l)")
def _(spark, d):
    """The row the JSON sink writes."""
    values = value_counts(regs(spark, d), "v")
    t = thresholds(values)
    g = gini(values).select(F.col("docs").alias("docs_total"), F.col("total").alias("comments_total"), r6(F.col("gini")).alias("gini"))
    return t.select(*[r6(F.col(c)).alias(c) for c in t.columns]).crossJoin(F.broadcast(g))


@query("ag25_rank_size", f"with {_COUNTS} select document_number, v, row_number() over (order by v desc, document_number) as doc_rank from c")
def _(spark, d):
    return ranked(regs(spark, d), [F.desc("v"), F.col("document_number")], None, "ranksize").withColumnRenamed("rank", "doc_rank")


QUERIES |= {"wn1_cumulative_share": QUERIES["ag23_frontier"], "wn2_rank": QUERIES["ag25_rank_size"]}
SQL |= {"wn1_cumulative_share": SQL["ag23_frontier"], "wn2_rank": SQL["ag25_rank_size"]}


# -- weighted quantiles, ribbon, trends ------------------------------------------------------------------------------


def weighted_quantiles(rows, group: list[str], value: str, weight: str, points: dict[str, float]):
    """First value whose running weight reaches q of the group's total; NULL for a total of 0.

    Equal values are added up before the window, which runs within groups only.
    """
    each = rows.groupBy(*group, value).agg(F.sum(weight).alias("w"))
    within = Window.partitionBy(*group)
    run = each.withColumn("cw", F.sum("w").over(within.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))).withColumn("tw", F.sum("w").over(within))
    return run.groupBy(*group).agg(*[F.min(F.when((F.col("tw") > 0) & (F.round("cw", 9) >= F.round(F.lit(q) * F.col("tw"), 9)), F.col(value))).alias(n) for n, q in points.items()])


_RX = "m as (select agency, round(x, 9) as x, round(y, 9) as y, total from metrics)"


@query("ag26_weighted_median", f"with {SQL_METRICS}, {_RX}, g as (select y, sum(total) as w from m group by 1), r as (select y, sum(w) over (order by y rows unbounded preceding) as cw, sum(w) over () as tw from g) select min(case when round(cw, 9) >= round(0.25 * tw, 9) then y end) as q25, min(case when round(cw, 9) >= round(0.5 * tw, 9) then y end) as q50, min(case when round(cw, 9) >= round(0.75 * tw, 9) then y end) as q75 from r")
def _(spark, d):
    m = agency_metrics(weighted(spark, d)).select(F.lit(1).alias("all"), F.round("y", 9).alias("y"), "total")
    return weighted_quantiles(m, ["all"], "y", "total", {"q25": 0.25, "q50": 0.5, "q75": 0.75}).drop("all")


def edge_bin(value, low, high, bins: int):
    """Equal-width bins, right-closed, the lowest value in the first: counts the inner edges below the value."""
    return F.lit(1) + sum((F.when(value > low + k * ((high - low) / bins), 1).otherwise(0) for k in range(1, bins)), F.lit(0))


def ribbon(m, bins: int = 30):
    """Per bin of X: mean X and the weighted quartiles of Y."""
    rows = m.select(F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), "total")
    bounds = rows.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    binned = rows.crossJoin(F.broadcast(bounds)).where("lo < hi").withColumn("bin", edge_bin(F.col("x"), F.col("lo"), F.col("hi"), bins))
    centers = binned.groupBy("bin").agg(F.avg("x").alias("x_center"))
    return centers.join(weighted_quantiles(binned, ["bin"], "y", "total", {"y_q25": 0.25, "y_median": 0.5, "y_q75": 0.75}), "bin")


_BIN = lambda v, n: "1 + " + " + ".join(f"({v} > lo + {k} * ((hi - lo) / {n}))::int" for k in range(1, n))
_RIBBON = f"""with {SQL_METRICS}, {_RX}, b as (select m.*, {_BIN('x', 30)} as bin from m, (select min(x) as lo, max(x) as hi from m) where lo < hi), g as (select bin, y, sum(total) as w from b group by 1, 2),
r as (select bin, y, sum(w) over (partition by bin order by y rows unbounded preceding) as cw, sum(w) over (partition by bin) as tw from g),
q as (select bin, min(case when round(cw, 9) >= round(0.25 * tw, 9) then y end) as y_q25, min(case when round(cw, 9) >= round(0.5 * tw, 9) then y end) as y_median, min(case when round(cw, 9) >= round(0.75 * tw, 9) then y end) as y_q75 from r group by 1),
ribbon as (select q.bin, (select avg(x) from b where b.bin = q.bin) as x_center, y_q25, y_median, y_q75 from q)"""


@query("ag27_ribbon", f"{_RIBBON} select bin, round(x_center, 6) as x_center, round(y_q25, 6) as y_q25, round(y_median, 6) as y_median, round(y_q75, 6) as y_q75 from ribbon")
def _(spark, d):
    r = ribbon(agency_metrics(weighted(spark, d)))
    return r.select("bin", *[r6(F.col(c)).alias(c) for c in ("x_center", "y_q25", "y_median", "y_q75")])


@query("ag40_ribbon_insight", f"{_RIBBON} select round(avg(case when x_center < -0.3 then y_median end), 6) as low_side, round(avg(case when x_center > 0.3 then y_median end), 6) as high_side, round(arg_max(x_center, (round(y_median, 6), -bin)), 6) as peak_x from ribbon")
def _(spark, d):
    r = ribbon(agency_metrics(weighted(spark, d)))
    side = lambda cond: r6(F.avg(F.when(cond, F.col("y_median"))))
    return r.agg(side(F.col("x_center") < -0.3).alias("low_side"), side(F.col("x_center") > 0.3).alias("high_side"), r6(F.max_by("x_center", F.struct(F.round("y_median", 6), -F.col("bin")))).alias("peak_x"))


@query("ag28_log_trend", f"with {SQL_METRICS}, k as (select total, n_1, round(log10(greatest(total, 1)), 9) as x from metrics), b as (select k.*, {_BIN('x', 10)} as bin from k, (select min(x) as lo, max(x) as hi from k) where lo < hi) select bin, count(*) as n, round(quantile_cont(total, 0.5), 4) as total, round(quantile_cont(n_1, 0.5), 4) as citizens from b group by 1 having count(*) >= 2")
def _(spark, d):
    k = agency_metrics(weighted(spark, d)).select("total", "n_1", F.round(F.log10(F.greatest("total", F.lit(1.0))), 9).alias("x"))
    bounds = k.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = k.crossJoin(F.broadcast(bounds)).where("lo < hi").withColumn("bin", edge_bin(F.col("x"), F.col("lo"), F.col("hi"), 10))
    median = lambda c: F.round(F.expr(f"percentile({c}, 0.5D)"), 4)
    return b.groupBy("bin").agg(F.count("*").alias("n"), median("total").alias("total"), median("n_1").alias("citizens")).where("n >= 2")


def power_fit(rows, x: str, y: str):
    """Power law by least squares on logarithms: exponent, factor, and the spread of the residuals as a factor."""
    logs = rows.where((F.col(x) > 0) & (F.col(y) > 0)).select(F.log10(F.col(x).cast("double")).alias("lx"), F.log10(F.col(y).cast("double")).alias("ly"))
    g = logs.agg(F.count("*").alias("n"), F.regr_slope("ly", "lx").alias("b"), F.regr_intercept("ly", "lx").alias("a"), F.regr_syy("ly", "lx").alias("syy"), F.regr_r2("ly", "lx").alias("r2"))
    sigma = F.sqrt(F.greatest(F.lit(0.0), F.try_divide(F.col("syy") * (1 - F.col("r2")), F.col("n"))))
    return g.where("n >= 10").select("n", F.round("b", 5).alias("exponent"), F.round("a", 5).alias("log_factor"), F.round(sigma, 5).alias("log_spread"))


_FIT = lambda src, x, y: f"select n, round(b, 5) as exponent, round(a, 5) as log_factor, round(sqrt(greatest(0, syy * (1 - r2) / n)), 5) as log_spread from (select count(*) as n, regr_slope(ly, lx) as b, regr_intercept(ly, lx) as a, regr_syy(ly, lx) as syy, regr_r2(ly, lx) as r2 from (select log10({x}::double) as lx, log10({y}::double) as ly from {src} where {x} > 0 and {y} > 0)) where n >= 10"


@query("ag29_power_fit", f"with {SQL_METRICS} {_FIT('metrics', 'total', 'n_1')}")
def _(spark, d):
    return power_fit(agency_metrics(weighted(spark, d)), "total", "n_1")


@query("ch6_document_fit", f"with {SQL_WEIGHTED}, g as (select document_number, max(comment_count) as total, sum(case when category = {_CITIZEN} then weight_doc else 0 end) as citizens from weighted group by 1) {_FIT('g', 'total', 'citizens')}")
def _(spark, d):
    g = weighted(spark, d).groupBy("document_number").agg(F.max("comment_count").alias("total"), F.sum(F.when(F.col("category") == X.CITIZEN, F.col("weight_doc")).otherwise(0.0)).alias("citizens"))
    return power_fit(g, "total", "citizens")


@query("ag30_binned_spread", f"with {SQL_METRICS}, k as (select round(log10(total), 9) as x, n_1 from metrics where total > 0), b as (select k.*, {_BIN('x', 10)} as bin from k, (select min(x) as lo, max(x) as hi from k) where lo < hi) select bin, count(*) as n, round(avg(n_1), 4) as mean, round(stddev_pop(n_1), 4) as spread from b group by 1")
def _(spark, d):
    k = agency_metrics(weighted(spark, d)).where("total > 0").select(F.round(F.log10("total"), 9).alias("x"), "n_1")
    bounds = k.agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    b = k.crossJoin(F.broadcast(bounds)).where("lo < hi").withColumn("bin", edge_bin(F.col("x"), F.col("lo"), F.col("hi"), 10))
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.round(F.avg("n_1"), 4).alias("mean"), F.round(F.stddev_pop("n_1"), 4).alias("spread"))


# -- ranked stream and continuum ----------------------------------------------------------------------------------------

_SHARES = ", ".join(f"coalesce(sum(case when category = {quoted(x)} then weight_doc end), 0) / sum(weight_doc) as share_{i}" for i, x in enumerate(X.CATEGORIES))
_ODD = lambda s: f"(select k + (1 - k % 2) from (select greatest(3, cast(floor(count(*) * {s}::double) as bigint)) as k from src))"


def _sql_smooth(share: float) -> str:
    """SQL of the clamped moving average: every rank joined with its window of clamped neighbours."""
    avg = ", ".join(f"avg(s.share_{i}) as a{i}" for i in range(5))
    return f"w as (select (({_ODD(share)}) - 1) // 2 as h), n as (select count(*) as n from src), sm as (select r.rank, {avg} from src r, w, n, unnest(range(-h, h + 1)) as o(k) join src s on s.rank = least(greatest(r.rank + o.k, 1), n.n) group by 1)"


_NORM = ", ".join(f"round(100 * a{i} / case when a0 + a1 + a2 + a3 + a4 = 0 then 1 else a0 + a1 + a2 + a3 + a4 end, 6) as pct_{i}" for i in range(5))
_DOCS = f"src as (select *, row_number() over (order by comment_count, document_number) as rank from (select document_number, max(comment_count) as comment_count, {_SHARES} from weighted where comment_count > 0 group by 1))"


def stream(rows, order, share: float, name: str):
    values = [f"share_{i}" for i in range(5)]
    s = smoothed(ranked(rows, order, values, name), values, share)
    total = sum((F.col(f"smooth_{v}") for v in values), F.lit(0.0))
    return s.select("*", *[r6(100 * F.col(f"smooth_{v}") / F.when(total == 0, 1.0).otherwise(total)).alias(f"pct_{i}") for i, v in enumerate(values)])


@query("ch11_ranked_stream", f"with {SQL_WEIGHTED}, {_DOCS}, {_sql_smooth(0.05)} select src.document_number, src.comment_count, src.rank as doc_rank, {_NORM} from sm join src using (rank)")
def _(spark, d):
    """Composition along documents ordered by comment count, smoothed over a twentieth of them."""
    s = stream(document_shares(spark, d), [F.col("comment_count"), F.col("document_number")], 0.05, "stream")
    return s.select("document_number", "comment_count", F.col("rank").alias("doc_rank"), *[f"pct_{i}" for i in range(5)])


QUERIES["wn4_moving_average"] = QUERIES["ch11_ranked_stream"]
SQL["wn4_moving_average"] = SQL["ch11_ranked_stream"]


@query("wn5_first_crossing", f"with {SQL_WEIGHTED}, {_DOCS}, w as (select (({_ODD(0.05)}) - 1) // 2 as h), r as (select rank, comment_count, case when rank > h and rank <= (select count(*) from src) - h then (select avg(s.share_1) from src s where s.rank between q.rank - h and q.rank + h) end as m from src q, w), g as (select *, sign(round(m - 0.5, 9)) as s, lag(sign(round(m - 0.5, 9))) over (order by rank) as p from r) select min(rank) as rank, count(*) as crossings from g where p is not null and s is not null and s <> p")
def _(spark, d):
    """Where the centred rolling citizen share first crosses one half; edges without a full window don't count."""
    rows = ranked(document_shares(spark, d), [F.col("comment_count"), F.col("document_number")], ["share_1"], "crossing")
    k = F.greatest(F.lit(3), F.floor(F.count("*") * F.lit(0.05)).cast("long"))
    info = rows.agg(F.count("*").alias("n"), k.alias("k")).select("n", F.floor((F.col("k") + 1 - F.col("k") % 2 - 1) / 2).cast("long").alias("h"))
    base = rows.crossJoin(F.broadcast(info)).where("rank > h and rank <= n - h").select("rank", "h", (F.col("rank") + F.col("h")).alias("hi"), (F.col("rank") - F.col("h") - 1).alias("lo"))
    cum = lambda name: rows.select(F.col("rank").alias(name), F.col("cum_share_1").alias(f"c_{name}"))
    mean = base.join(cum("hi"), "hi").join(cum("lo"), "lo", "left").select("rank", F.signum(F.round((F.col("c_hi") - F.coalesce("c_lo", F.lit(0.0))) / (2 * F.col("h") + 1) - 0.5, 9)).alias("s"))
    prior = mean.select((F.col("rank") + 1).alias("rank"), F.col("s").alias("p"))
    return mean.join(prior, "rank").where("s <> p").agg(F.min("rank").alias("rank"), F.count("*").alias("crossings"))


@query("wn8_milestones", f"with {SQL_WEIGHTED}, {_DOCS} select m.m as milestone, (select min(rank) from src where comment_count >= m.m) as doc_rank from (values (1), (5), (10), (50), (100), (500), (1000)) m(m)")
def _(spark, d):
    rows = ranked(document_shares(spark, d), [F.col("comment_count"), F.col("document_number")], None, "milestones")
    g = rows.agg(*[F.min(F.when(F.col("comment_count") >= m, F.col("rank"))).alias(str(m)) for m in (1, 5, 10, 50, 100, 500, 1000)])
    return g.select(F.explode(F.array(*[F.struct(F.lit(m).alias("milestone"), F.col(str(m)).alias("doc_rank")) for m in (1, 5, 10, 50, 100, 500, 1000)])).alias("r")).select("r.*")


_AGSRC = "src as (select agency, total, share_0, share_1, share_2, share_3, share_4, row_number() over (order by round(x, 9), agency) as rank from metrics)"


@query("wn3_cumulative_volume", f"with {SQL_METRICS}, {_AGSRC} select agency, round(c, 6) as cum_volume, round((c + coalesce(lag(c) over (order by rank), 0)) / 2, 6) as center from (select agency, rank, sum(total) over (order by rank rows unbounded preceding) / sum(total) over () as c from src)")
def _(spark, d):
    m = agency_metrics(weighted(spark, d)).withColumn("rx", F.round("x", 9))
    rows = ranked(m.select("agency", "total", "rx"), [F.col("rx"), F.col("agency")], ["total"], "volume")
    total = rows.agg(F.sum("total").alias("s"))
    c, before = F.col("cum_total") / F.col("s"), (F.col("cum_total") - F.col("total")) / F.col("s")
    return rows.crossJoin(F.broadcast(total)).select("agency", r6(c).alias("cum_volume"), r6((c + before) / 2).alias("center"))


@query("ch13_continuum", f"with {SQL_METRICS}, {_AGSRC}, {_sql_smooth(0.07)} select src.agency, src.rank as agency_rank, {_NORM} from sm join src using (rank)")
def _(spark, d):
    m = agency_metrics(weighted(spark, d)).withColumn("rx", F.round("x", 9)).select("agency", "rx", "total", *[f"share_{i}" for i in range(5)])
    s = stream(m, [F.col("rx"), F.col("agency")], 0.07, "continuum")
    return s.select("agency", F.col("rank").alias("agency_rank"), *[f"pct_{i}" for i in range(5)])


# -- calendars ---------------------------------------------------------------------------------------------------------

_DAILY = f"days as (select {_DATE} as dt, document_number, comment_count, agency from federal_register_comments)"
_SPINE = f"spine as (select unnest(generate_series(date '{YEAR}-01-01', date '{YEAR}-12-31', interval 1 day))::date as dt)"


def year(spark) -> int:
    """The calendar year of a run: ``docketlens.year`` of the session, else YEAR."""
    return int(spark.conf.get("docketlens.year", str(YEAR)))


def days(spark, d):
    return fr(spark, d).select(X.iso_date("publication_date").alias("dt"), "document_number", "comment_count", "agency").where(F.year("dt") == year(spark))


def daily(rows, least: int):
    engaged = F.sum(F.when(F.col("comment_count") >= least, 1).otherwise(0))
    g = rows.groupBy("dt").agg(F.count("document_number").alias("docs"), engaged.alias("engaged"), F.coalesce(F.sum("comment_count"), F.lit(0)).alias("comments"))
    return g.withColumn("rate", 100.0 * F.col("engaged") / F.col("docs"))


def on_spine(spark, g):
    spine = spark.sql(f"select explode(sequence(date '{year(spark)}-01-01', date '{year(spark)}-12-31')) as dt")
    return spine.join(g, "dt", "left").select("dt", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("docs", "engaged", "comments")], "rate")


@query("ag4_daily_engagement", f"with {_DAILY} select dt, count(document_number) as docs, cast(sum(case when comment_count >= 1 then 1 else 0 end) as bigint) as engaged, cast(coalesce(sum(comment_count), 0) as bigint) as comments, round_even(100.0::double * sum(case when comment_count >= 1 then 1 else 0 end) / count(*), 1) as rate from days where year(dt) = {YEAR} group by 1")
def _(spark, d):
    return daily(days(spark, d), 1).withColumn("rate", F.bround("rate", 1))


@query("jn13_calendar_spine", f"with {_DAILY}, {_SPINE} select s.dt, count(document_number) as docs, cast(coalesce(sum(comment_count), 0) as bigint) as comments from spine s left join days on days.dt = s.dt group by 1")
def _(spark, d):
    return on_spine(spark, daily(days(spark, d), 1)).select("dt", "docs", "comments")


_GRID = f"date_diff('day', date_trunc('week', date '{YEAR}-01-01')::date, s.dt) // 7"


@query("ch16_calendar_grid", f"with {_DAILY}, {_SPINE}, g as (select dt, count(*) as docs, 100.0::double * sum(case when comment_count >= 1 then 1 else 0 end) / count(*) as rate from days group by 1) select s.dt, cast(isodow(s.dt) - 1 as int) as weekday, cast({_GRID} as int) as week, round(g.rate, 6) as rate, (coalesce(g.rate, 0) >= 10)::int + (coalesce(g.rate, 0) >= 25)::int + (coalesce(g.rate, 0) >= 40)::int + (coalesce(g.rate, 0) >= 60)::int as lvl from spine s left join g on g.dt = s.dt")
def _(spark, d):
    """Engagement by weekday (Monday is 0) and week of the year, with levels; days without documents have no rate."""
    g = on_spine(spark, daily(days(spark, d), 1))
    start = F.trunc(F.lit(f"{year(spark)}-01-01").cast("date"), "week")
    return g.select("dt", F.weekday("dt").alias("weekday"), F.floor(F.datediff("dt", start) / 7).cast("int").alias("week"), r6(F.col("rate")).alias("rate"), X.engagement_level("rate").alias("lvl"))


@query("ag38_grid_stats", f"with {_DAILY}, {_SPINE}, g as (select dt, 100.0::double * sum(case when comment_count >= 1 then 1 else 0 end) / count(*) as rate from days where year(dt) = {YEAR} group by 1) select round(avg(rate), 6) as mean, round(quantile_cont(rate, 0.5), 6) as median, round(min(rate), 6) as least, round(max(rate), 6) as most, count(*) filter (where rate < 25) as low_days, count(*) filter (where rate is null) as empty_days from spine left join g using (dt)")
def _(spark, d):
    g = on_spine(spark, daily(days(spark, d), 1))
    return g.agg(r6(F.avg("rate")).alias("mean"), r6(F.expr("percentile(rate, 0.5D)")).alias("median"), r6(F.min("rate")).alias("least"), r6(F.max("rate")).alias("most"), F.count_if(F.col("rate") < 25).alias("low_days"), F.count_if(F.col("rate").isNull()).alias("empty_days"))


def agency_engagement(rows):
    engaged = F.sum(F.when(F.col("comment_count") >= 1, 1).otherwise(0))
    return rows.where("agency is not null").groupBy("agency").agg(F.count("*").alias("docs"), engaged.alias("engaged"), F.sum(F.when(F.coalesce("comment_count", F.lit(0)) == 0, 1).otherwise(0)).alias("docs_without_comments"))


_AGENG = "select agency, count(*) as docs, cast(sum(case when comment_count >= 1 then 1 else 0 end) as bigint) as engaged, cast(sum(case when coalesce(comment_count, 0) = 0 then 1 else 0 end) as bigint) as docs_without_comments from federal_register_comments where agency is not null group by 1"


@query("ag5_agency_engagement", f"select agency, docs, engaged, round(100.0::double * engaged / docs, 6) as rate from ({_AGENG}) where docs >= 50")
def _(spark, d):
    g = agency_engagement(fr(spark, d)).where("docs >= 50")
    return g.select("agency", "docs", "engaged", r6(100.0 * F.col("engaged") / F.col("docs")).alias("rate"))


@query("ag6_overall_rate", "select round(100.0 * avg(case when comment_count >= 1 then 1.0 else 0.0 end), 6) as rate from federal_register_comments")
def _(spark, d):
    return fr(spark, d).agg(r6(100.0 * F.avg(F.when(F.col("comment_count") >= 1, 1.0).otherwise(0.0))).alias("rate"))


@query("ag7_agency_stats", _AGENG)
def _(spark, d):
    return agency_engagement(fr(spark, d))


@query("ch17_agency_comparison", f"with a as ({_AGENG}), r as (select agency, round(100.0::double * engaged / docs, 6) as rate from a where docs >= 50), p as (select * from (select agency, 'best' as side from r order by rate desc, agency limit 1) union all select * from (select agency, 'worst' from r order by rate, agency limit 1)), {_DAILY} select p.side, p.agency, date_trunc('month', dt)::date as mon, count(*) as docs, cast(coalesce(sum(comment_count), 0) as bigint) as comments from days join p on p.agency = days.agency where year(dt) = {YEAR} group by 1, 2, 3")
def _(spark, d):
    """Monthly figures of the most and the least engaging large agency."""
    g = agency_engagement(fr(spark, d)).where("docs >= 50").select("agency", r6(100.0 * F.col("engaged") / F.col("docs")).alias("rate"))
    pick = g.orderBy(F.desc("rate"), "agency").limit(1).withColumn("side", F.lit("best")).unionByName(g.orderBy("rate", "agency").limit(1).withColumn("side", F.lit("worst")))
    return days(spark, d).join(F.broadcast(pick.drop("rate")), "agency").groupBy("side", "agency", F.trunc("dt", "month").alias("mon")).agg(F.count("*").alias("docs"), F.coalesce(F.sum("comment_count"), F.lit(0)).alias("comments"))


@query("ch18_stacked_calendars", f"with a as (select agency from ({_AGENG}) order by docs desc, agency limit 6), {_DAILY} select days.agency, dt, count(*) as docs, cast(sum(case when comment_count >= 1 then 1 else 0 end) as bigint) as engaged from days join a on a.agency = days.agency where year(dt) = {YEAR} group by 1, 2")
def _(spark, d):
    top = agency_engagement(fr(spark, d)).orderBy(F.desc("docs"), "agency").limit(6).select("agency")
    return days(spark, d).join(F.broadcast(top), "agency").groupBy("agency", "dt").agg(F.count("*").alias("docs"), F.sum(F.when(F.col("comment_count") >= 1, 1).otherwise(0)).alias("engaged"))


# -- chart tables that are views of the above -----------------------------------------------------------------------------


@query("ch4_workload_by_category", f"with {SQL_METRICS} select agency, c.category, round(total, 4) as total, round(case c.i when 0 then n_0 when 1 then n_1 when 2 then n_2 when 3 then n_3 else n_4 end, 4) as n from metrics, (values {', '.join(f'({i}, {quoted(x)})' for i, x in enumerate(X.CATEGORIES))}) c(i, category)")
def _(spark, d):
    m = agency_metrics(weighted(spark, d))
    long = F.explode(F.array(*[F.struct(F.lit(x).alias("category"), F.round(f"n_{i}", 4).alias("n")) for i, x in enumerate(X.CATEGORIES)])).alias("v")
    return m.select("agency", F.round("total", 4).alias("total"), long).select("agency", "v.category", "total", "v.n")


@query("ch8_citizens_by_volume", f"{_FR_STATS} select case when comment_count <= 10 then '0-10' when comment_count <= 100 then '11-100' else '100+' end as size, count(*) as docs, round(sum(est), 4) as citizens from stats where comment_count is not null and is_sampled group by 1")
def _(spark, d):
    size = F.when(F.col("comment_count") <= 10, "0-10").when(F.col("comment_count") <= 100, "11-100").otherwise("100+")
    return document_stats(spark, d).where("comment_count is not null and is_sampled").groupBy(size.alias("size")).agg(F.count("*").alias("docs"), F.round(F.sum("est"), 4).alias("citizens"))


_VIEWS = {
    "ch1_weight_distribution": "ag39_weight_histogram", "ch2_composition": "ag12_composition", "ch3_agency_compass": "ag11_agency_metrics", "ch3_compass_labels": "wn7_top_per_quadrant", "ch5_agency_fit": "ag29_power_fit", "ch7_participation_gap": "ag18_participation",
    "ch9_lorenz": "ag22_lorenz", "ch10_ribbon": "ag27_ribbon", "ch12_spotlight": "ag32_spotlight", "ch14_hierarchy_tree": "ag16_dominant_category", "ch15_flow": "ag17_flow_edges", "ch19_frontier": "ag23_frontier", "sl7_search_sorted": "ag24_threshold_metrics", "wn6_cumulative_weight": "ag26_weighted_median",
}


def _views() -> None:
    from docketlens.plans import relational

    for name, source in _VIEWS.items():
        for module in (relational,):
            if source in module.QUERIES:
                QUERIES[name], SQL[name] = module.QUERIES[source], module.SQL[source]
        if source in QUERIES:
            QUERIES[name], SQL[name] = QUERIES[source], SQL[source]


_views()
