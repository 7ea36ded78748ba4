"""Percentiles per group by distributed multi-select over mergeable partial counts.

A *partial* is the table (group, value, n) of one day, year or any other part of
the rows; partials merge by adding n.  With ``bits`` set, a value keeps its
leading bits only, so that a partial has at most 64 * 2^bits rows per group and
every percentile is at most the relative error 2^-bits below the exact one; without,
percentiles are exact (error 0).

Selection never sorts a group.  All open ranks of a group share one table of the
values that may still hold one of them, cut into disjoint ranges.  In each round every
batch of rows proposes its local median of each range, and the medians of the halves
and quarters beside it; the weighted median of the proposals for each place is a
pivot, rows are counted below, at and above every pivot, and the parts that hold no
wanted rank are discarded, until every rank is found.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketlens.session import discard, spill

QUANTILES = {"p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.9, "p99": 0.99}


def leading_bits(value: Column, bits: int) -> Column:
    """The number nearest to ``value`` towards zero that has only ``bits`` + 1 leading binary digits; -2^63 stays as it is."""
    size = F.abs(value)
    extra = F.greatest(F.lit(0), F.length(F.bin(size)) - (bits + 1)).cast("int")
    short = size - F.pmod(size, F.call_function("shiftleft", F.lit(1).cast("long"), extra))
    return F.when(value == F.lit(-(2**63)), value).when(value < 0, -short).otherwise(short)


def partials(rows: DataFrame, groups: list[str], value: str, bits: int | None = None, part: list[str] | None = None) -> DataFrame:
    """Mergeable form: counts per (groups, part, value).  NULL values are unknown and left out; NULL group names are a group.

    With ``bits`` a value, and so every percentile, is off by at most 2^-bits of itself, towards zero.
    """
    known = rows.where(F.col(value).isNotNull()).withColumn("value", F.col(value).cast("long"))
    if bits is not None:
        known = known.withColumn("value", leading_bits(F.col("value"), bits))
    return known.groupBy(*groups, *(part or []), "value").agg(F.count("*").alias("n"))


#: Places of a batch's range that it proposes as pivots: the median, and the medians of halves and quarters.
PLACES = tuple(k / 8 for k in range(1, 8))
_PROPOSED = pa.schema([("g", pa.int64()), ("r", pa.int64()), ("n", pa.int64()), *((f"p{i}", pa.int64()) for i in range(len(PLACES)))])
_PROPOSED_SQL = "g long, r long, n long, " + ", ".join(f"p{i} long" for i in range(len(PLACES)))


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Local pivots of each range (g, r) in each batch, with the batch's weight."""
    for batch in batches:
        if not batch.num_rows:
            continue
        g, r, value, n = (batch.column(c).to_numpy() for c in ("g", "r", "value", "n"))
        order = np.lexsort((value, r, g))
        g, r, value, n = g[order], r[order], value[order], n[order]
        first = np.nonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (r[1:] != r[:-1]))))[0]
        last = np.concatenate((first[1:], [len(g)])) - 1
        up_to = np.cumsum(n)
        before = up_to[first] - n[first]
        weight = up_to[last] - before
        proposed = [value[np.searchsorted(up_to, before + np.maximum(1, np.ceil(place * weight).astype(np.int64)))] for place in PLACES]
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (g[first], r[first], weight, *proposed)], schema=_PROPOSED)


def selected(counts: DataFrame, groups: list[str], quantiles: dict[str, float] = QUANTILES) -> tuple[DataFrame, DataFrame, int]:
    """(totals per group with its columns as _c0, _c1 ..., (g, q, value) of every wanted rank, number of rounds)."""
    key = F.xxhash64(F.to_json(F.struct(*[F.col(c).alias(f"c{i}") for i, c in enumerate(groups)])))
    inner = [f"_c{i}" for i in range(len(groups))]
    merged = counts.groupBy(*groups, "value").agg(F.sum("n").alias("n")).select(*[F.col(c).alias(i) for c, i in zip(groups, inner)], key.alias("g"), "value", "n")
    active = spill(merged.select(*inner, "g", F.lit(0).cast("long").alias("r"), "value", "n"), "p2-active0")
    totals = spill(active.groupBy("g", *inner).agg(F.sum("n").alias("n_known")), "p2-totals")
    wanted = F.array(*[F.lit(float(q)) for q in quantiles.values()])
    rank = F.greatest(F.lit(1), F.ceil(F.round(F.col("q") * F.col("n_known"), 9))).cast("long")
    # A wanted rank: the k-th value of range r of group g.
    ranks = totals.select("g", F.lit(0).cast("long").alias("r"), "n_known", F.explode(wanted).alias("q")).select("g", "r", "q", rank.alias("k"))
    found, rounds = [], 0
    while not ranks.isEmpty():
        rounds += 1
        proposed = active.select("g", "r", "value", "n").mapInArrow(_propose, _PROPOSED_SQL)
        pivots = proposed.groupBy("g", "r").agg(F.array_sort(F.array_distinct(F.array(*[F.floor(F.expr(f"percentile(p{i}, 0.5D, n)")).cast("long") for i in range(len(PLACES))]))).alias("pivots"))
        # Even parts lie between pivots, odd ones are the pivots themselves.
        part = F.expr("2 * size(filter(pivots, p -> p < value)) + if(array_contains(pivots, value), 1, 0)")
        counted = active.join(pivots, ["g", "r"]).withColumn("part", part).groupBy("g", "r", "part").agg(F.sum("n").alias("n"), F.max("value").alias("top"), F.first("pivots").alias("pivots"))
        up_to = F.sum("n").over(Window.partitionBy("g", "r").orderBy("part"))
        placed = ranks.select("g", "r", "q", "k").join(counted.withColumn("up_to", up_to), ["g", "r"]).where("k <= up_to and k > up_to - n")
        fresh_r = F.dense_rank().over(Window.partitionBy("g").orderBy("r", "part")).cast("long")
        told = placed.select("g", F.col("r").alias("parent"), "q", fresh_r.alias("r"), "part", "top", F.expr("k - (up_to - n)").alias("k"), F.expr("get(pivots, cast(part / 2 - 1 as int))").alias("low"), F.expr("get(pivots, cast(part / 2 as int))").alias("high"))
        told = spill(told, f"p2-told{rounds}")
        found.append(told.where("part % 2 = 1").select("g", "q", F.col("top").alias("value")))
        ranks = told.where("part % 2 = 0")
        kept = ranks.select("g", "parent", F.col("r").alias("fresh"), "low", "high").distinct()
        inside = (active["g"] == kept["g"]) & (active["r"] == kept["parent"]) & F.expr("(low is null or value > low) and (high is null or value < high)")
        left = spill(active.join(kept, inside).select(active["g"], F.col("fresh").alias("r"), "value", "n"), f"p2-active{rounds}")
        discard(active)
        active = left
    values = reduce(DataFrame.unionAll, found) if found else ranks.select("g", "q", F.col("k").alias("value"))
    return totals, values, rounds


def multi_select(counts: DataFrame, groups: list[str], quantiles: dict[str, float] = QUANTILES) -> DataFrame:
    """One row per group: its number of rows and, per quantile q, the value of rank ceil(q * rows) (at least 1).

    ``counts`` is any merge of partials; equal values may occur in several rows.
    An empty table gives an empty result, ties need no rule (ranks count them).
    """
    totals, values, _ = selected(counts, groups, quantiles)
    named = values.groupBy("g").agg(*[F.max(F.when(F.col("q") == float(q), F.col("value"))).alias(name) for name, q in quantiles.items()])
    joined = totals.join(named, "g")
    return joined.select(*[F.col(f"_c{i}").alias(c) for i, c in enumerate(groups)], "n_known", *quantiles)
