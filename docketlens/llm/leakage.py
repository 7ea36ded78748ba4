"""Evaluation passages inside the corpus: prefix-filtered set join and exact windows.

A leaked passage is a window of ``WINDOW`` consecutive item words.  As a set, a
window is its ``WINDOW - SHINGLE + 1`` word shingles, all of which must occur,
so the necessary prefix of a window is its rarest shingle by corpus frequency.
The corpus is joined on these prefix tokens only; length and position bounds
drop hits whose window would leave the document, and the window is verified by
the hash of all its words at exactly that place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlens.llm import textops as tx
from docketlens.session import spill

WINDOW, SHINGLE = 12, 5
#: Item shingles (8 bytes each) that may be sent to the tasks; beyond it the shingles are joined by a shuffle.
SENT_SHINGLES = 2_000_000
U64 = np.uint64
_HIT = pa.schema([("id", pa.int64()), ("pos", pa.int32()), ("words", pa.int32()), ("shingle", pa.int64()), ("run", pa.int64())])
_HIT_SQL = "id long, pos int, words int, shingle long, run long"


def _shingle_rows(keep: np.ndarray | None, ids: str, text: str):
    """mapInArrow function: shingles of each text with place, text length and the hash of the WINDOW-word run that starts there (0 if none)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = tx.WordIds()
        for batch in batches:
            flat, lengths = tx.word_ids(batch.column(text).to_pylist(), memo)
            value, at, runs = tx.shingles(flat, lengths, SHINGLE)
            if not len(value):
                continue
            value = tx.signed(value)
            if keep is not None:
                near = np.minimum(np.searchsorted(keep, value), len(keep) - 1)
                hit = np.nonzero(keep[near] == value)[0] if len(keep) else np.empty(0, np.int64)
            else:
                hit = np.arange(len(value))
            if not len(hit):
                continue
            row = np.repeat(np.arange(len(lengths)), runs)[hit]
            begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
            start = at[hit]
            fits = start + WINDOW <= (begin + lengths)[row]
            run = np.zeros(len(hit), U64)
            if fits.any():
                part = flat[start[fits]]
                for i in range(1, WINDOW):
                    part = tx.mix64(part * U64(0x9E3779B97F4A7C15) + flat[start[fits] + i])
                run[fits] = part
            # The hash stands for a window, the id for the text: ids are kept as given.
            yield pa.RecordBatch.from_arrays([batch.column(ids).take(pa.array(row)), pa.array((start - begin[row]).astype(np.int32)), pa.array(lengths[row].astype(np.int32)), pa.array(value[hit]), pa.array(tx.signed(run))], schema=_HIT)

    return rows


def leaked_windows(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, doc_start) of every item window of WINDOW words found in a document.

    NULL or shorter texts contain nothing; repeated rows of either table count
    once; an empty item table gives an empty result.
    """
    item_rows = items.select(F.col("item_id").cast("long").alias("id"), "text").where("id is not null").distinct().mapInArrow(_shingle_rows(None, "id", "text"), _HIT_SQL)
    item_rows = spill(item_rows, "p9-items")
    docs = documents.select(F.col("doc_id").cast("long").alias("id"), "text").where("id is not null")
    distinct = item_rows.select("shingle").distinct()
    if distinct.count() <= SENT_SHINGLES:
        keep = np.sort(np.array([r[0] for r in distinct.toLocalIterator()], dtype=np.int64))
        hits = docs.mapInArrow(_shingle_rows(keep, "id", "text"), _HIT_SQL)
    else:
        hits = docs.mapInArrow(_shingle_rows(None, "id", "text"), _HIT_SQL).join(distinct, "shingle", "left_semi").select("id", "pos", "words", "shingle", "run")
    hits = spill(hits, "p9-hits")
    rarity = hits.groupBy("shingle").agg(F.count("*").alias("seen"))
    # Each window of an item lists its shingles; the rarest one that occurs at all is the token to join on.
    windows = item_rows.where(F.col("pos") + WINDOW <= F.col("words")).select(F.col("id").alias("item_id"), F.col("pos").alias("start"), F.col("run").alias("window"))
    offsets = windows.withColumn("offset", F.explode(F.sequence(F.lit(0), F.lit(WINDOW - SHINGLE)))).withColumn("pos", F.col("start") + F.col("offset"))
    tokens = offsets.join(item_rows.select(F.col("id").alias("item_id"), "pos", "shingle"), ["item_id", "pos"]).join(rarity, "shingle", "left")
    rank = Window.partitionBy("item_id", "start").orderBy(F.coalesce("seen", F.lit(0)), "shingle", "offset")
    prefix = tokens.withColumn("rank", F.row_number().over(rank)).where("rank = 1 and seen is not null").select("item_id", "start", "window", "shingle", "offset")
    placed = hits.join(prefix, "shingle").select(F.col("id").alias("doc_id"), (F.col("pos") - F.col("offset")).alias("doc_start"), "words", "item_id", "start", "window")
    bounded = placed.where((F.col("doc_start") >= 0) & (F.col("doc_start") + WINDOW <= F.col("words"))).drop("words")
    verify = hits.select(F.col("id").alias("doc_id"), F.col("pos").alias("doc_start"), F.col("run").alias("window"))
    return bounded.join(verify, ["doc_id", "doc_start", "window"]).select("doc_id", "item_id", "start", "doc_start").distinct()


def leaked_items(documents: DataFrame, items: DataFrame) -> DataFrame:
    """p9: distinct (doc_id, item_id) with a leaked passage of at least WINDOW words."""
    return leaked_windows(documents, items).select("doc_id", "item_id").distinct()


def leak_report(documents: DataFrame, items: DataFrame) -> DataFrame:
    """p9: per affected document and item the number of leaked windows and of item words they cover."""
    found = leaked_windows(documents, items).select("doc_id", "item_id", "start").distinct()
    before = F.lag("start").over(Window.partitionBy("doc_id", "item_id").orderBy("start"))
    fresh = F.when(before.isNull(), WINDOW).otherwise(F.least(F.lit(WINDOW), F.col("start") - before))
    return found.withColumn("fresh", fresh).groupBy("doc_id", "item_id").agg(F.count("*").alias("windows"), F.sum("fresh").cast("long").alias("leaked_words"))
