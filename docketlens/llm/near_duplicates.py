"""Near-duplicate comments by Golay-coded fuzzy fingerprints.

The fingerprint of a text is ``WORDS`` segments of 23 bits, one-bit min-hashes of all
its words.  Each segment is decoded to the Golay codewords near it, which gives one to
six indices; two segments within two wrong bits always share one.  Edits flip bits all
over the fingerprint, and by the pigeonhole some segment of two near copies has few.
An index of 12 bits alone would meet a large part of a big collection, so it is joined
together with the least hash of the text's runs of ``ANCHOR`` words, of which there are
``SEGMENTS``, each with one of the fingerprint's segments.  What meets is filtered by a
256-bit sketch and then verified exactly on distinct runs of three words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketlens.llm import golay
from docketlens.llm import textops as tx
from docketlens.llm.graph import components
from docketlens.session import spill

#: Keys of a text, segments of its fingerprint, and words of an anchoring run.
SEGMENTS, WORDS, ANCHOR = 16, 8, 5
RUN, MIN_WORDS, THRESHOLD = 3, 25, 0.5
SKETCH_BITS = 256
#: How far the sketches of a pair at the threshold may lie apart, in standard deviations.
DEVIATIONS = 3.0
#: Texts of one component that are verified together; larger components are split into blocks of it.
GROUP_BLOCK = 10_000
#: Copies of one text that are named while pairs are verified; texts with more are spread by a join.
COPIES = 64
FIELDS = ("comment_text", "attachment_text")
U64 = np.uint64


def sketch_limit(threshold: float, deviations: float, bits: int = SKETCH_BITS) -> int:
    """Largest distance of two sketches that is still examined: mean at the threshold plus some standard deviations."""
    differ = (1 - threshold) / 2
    return int(np.ceil(bits * differ + deviations * np.sqrt(bits * differ * (1 - differ))))


def _seed(k: int) -> np.uint64:
    return U64((k + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)


def text_hash(flat: np.ndarray, lengths: np.ndarray, salt: int) -> np.ndarray:
    """64-bit hash of each text's word sequence."""
    place = np.arange(len(flat), dtype=np.int64) - np.repeat(np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths)
    each = tx.mix64(flat + tx.mix64(place.astype(U64) * U64(0xD6E8FEB86659FD93)))
    return tx.mix64(tx.segments_reduce(np.add, each, lengths, 0) + _seed(salt) + lengths.astype(U64))


def one_bit_hashes(hashes: np.ndarray, first: np.ndarray, number: int, salt: int) -> Iterator[np.ndarray]:
    """``number`` one-bit min-hashes of the consecutive groups of 64-bit hashes that begin at ``first``."""
    for lane in range(number):
        if lane % 8 == 0:
            base = (tx.mix64(hashes ^ _seed(lane + salt)) >> U64(32)).astype(np.uint32)
        # eight min-hashes from one hash: an odd multiplier permutes its values
        least = np.minimum.reduceat(base * np.uint32(2 * (lane % 8 * 977 + 3) + 1) if lane % 8 else base, first)
        yield tx.mix64(least.astype(U64)) & U64(1)


def fingerprints(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(least hash of word runs (texts, SEGMENTS), 23-bit segments (texts, WORDS)); texts shorter than ANCHOR words are not allowed."""
    runs_hash, _, runs = tx.shingles(flat, lengths, ANCHOR)
    first = np.concatenate(([0], np.cumsum(runs)[:-1]))
    anchors = np.empty((len(lengths), SEGMENTS), U64)
    for k in range(SEGMENTS):
        anchors[:, k] = tx.mix64(np.minimum.reduceat(tx.mix64(runs_hash ^ _seed(k)), first) + _seed(k + 101))
    words = np.zeros((len(lengths), WORDS), np.uint32)
    begin = np.concatenate(([0], np.cumsum(lengths)[:-1]))
    for lane, bit in enumerate(one_bit_hashes(flat, begin, golay.BITS * WORDS, 5007)):
        words[:, lane // golay.BITS] |= bit.astype(np.uint32) << np.uint32(lane % golay.BITS)
    return anchors, words


def sketches(run_hash: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """SKETCH_BITS one-bit min-hashes of each text's word runs as uint64; every text has runs."""
    out = np.zeros((len(runs), SKETCH_BITS // 64), U64)
    for lane, bit in enumerate(one_bit_hashes(run_hash, np.concatenate(([0], np.cumsum(runs)[:-1])), SKETCH_BITS, 307)):
        out[:, lane // 64] |= bit << U64(lane % 64)
    return out


_DOC = pa.schema([("field", pa.string()), ("comment_id", pa.string()), ("h", pa.int64()), ("sk", pa.binary()), ("fp", pa.binary()), ("sh", pa.binary())])
DOC_SCHEMA = "field string, comment_id string, h long, sk binary, fp binary, sh binary"


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    memo, seen = tx.WordIds(), set()
    for batch in batches:
        ids = batch.column("comment_id")
        for salt, field in enumerate(FIELDS):
            flat, lengths = tx.word_ids(batch.column(field).to_pylist(), memo)
            keep = np.nonzero(lengths >= MIN_WORDS)[0]
            if not len(keep):
                continue
            flat = flat[np.repeat(lengths >= MIN_WORDS, lengths)]
            lengths = lengths[keep]
            h = text_hash(flat, lengths, salt)
            if len(seen) > 4_000_000:
                seen.clear()
            fresh = np.zeros(len(h), bool)
            for i, value in enumerate(h.tolist()):
                if value not in seen:
                    seen.add(value)
                    fresh[i] = True
            n = len(keep)
            sk, fp, sh = [None] * n, [None] * n, [None] * n
            if fresh.any():
                flat, part = flat[np.repeat(fresh, lengths)], lengths[fresh]
                anchors, segments = fingerprints(flat, part)
                run_hash, _, runs = tx.shingles(flat, part, RUN)
                both = sketches(run_hash, runs)
                small = (run_hash >> U64(32)).astype(np.uint32)
                edge = np.concatenate(([0], np.cumsum(runs)))
                for j, i in enumerate(np.nonzero(fresh)[0]):
                    sk[i] = both[j].tobytes()
                    fp[i] = anchors[j].tobytes() + segments[j].tobytes()
                    sh[i] = np.unique(small[edge[j] : edge[j + 1]]).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([field] * n), ids.take(pa.array(keep)).cast(pa.string()), pa.array(tx.signed(h)), pa.array(sk, pa.binary()), pa.array(fp, pa.binary()), pa.array(sh, pa.binary())], schema=_DOC)


_SKETCH = [f"s{i}" for i in range(SKETCH_BITS // 64)]
_SKETCH_SQL = ", ".join(f"{s} long" for s in _SKETCH)
_SEG = pa.schema([("anchor", pa.int64()), ("word", pa.int32()), ("h", pa.int64()), *((s, pa.int64()) for s in _SKETCH)])


def _unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        fp = np.frombuffer(b"".join(batch.column("fp").to_pylist()), np.uint8).reshape(n, 8 * SEGMENTS + 4 * WORDS)
        anchors = np.ascontiguousarray(fp[:, : 8 * SEGMENTS]).view(np.int64).ravel()
        words = np.ascontiguousarray(fp[:, 8 * SEGMENTS :]).view(np.int32)[:, np.arange(SEGMENTS) % WORDS].ravel()
        sk = np.frombuffer(b"".join(batch.column("sk").to_pylist()), np.int64).reshape(n, len(_SKETCH))
        yield pa.RecordBatch.from_arrays([pa.array(anchors), pa.array(words), *(pa.array(np.repeat(c, SEGMENTS)) for c in (batch.column("h").to_numpy(), *sk.T))], schema=_SEG)


#: Rows that share a fuzzy key up to which they are paired where they meet; more are paired by a join.  Rows of one anchor that are looked at together.
KEY_ROWS, ANCHOR_ROWS = 128, 200_000
_MET = pa.schema([("key", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), *((s, pa.int64()) for s in _SKETCH)])
_MET_SQL = f"key long, a long, b long, {_SKETCH_SQL}"


def _pairs_within(start: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of all pairs within consecutive groups of a sorted array."""
    left, right = [], []
    for size in np.unique(rows):
        i, j = np.triu_indices(size, 1)
        at = start[rows == size][:, None]
        left.append((at + i).ravel())
        right.append((at + j).ravel())
    return np.concatenate(left), np.concatenate(right)


def _meet(limit: int, key_rows: int, anchor_rows: int):
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs (a, b) of texts that share a fuzzy key and have close sketches, from rows that come sorted by anchor.

        Keys of more than ``key_rows`` rows, and all keys of an anchor of more than
        ``anchor_rows`` rows (which comes in parts), are passed on as rows (key, a) for a join.
        """
        split: int | None = None

        def met(table: pa.Table, whole: bool) -> pa.RecordBatch:
            codes = golay.fuzzy_keys(table.column("word").to_numpy())
            some = codes >= 0
            times = some.sum(axis=1)
            anchor = np.repeat(table.column("anchor").to_numpy(), times)
            key = tx.mix64(anchor.view(U64) + codes[some].astype(U64))
            order = np.argsort(key, kind="stable")
            key, anchor = key[order], anchor[order]
            h, *sketch = (np.repeat(table.column(c).to_numpy(), times)[order] for c in ("h", *_SKETCH))
            _, start, rows = np.unique(key, return_index=True, return_counts=True)
            joined = np.full(len(rows), not whole) | (rows > key_rows)
            if split is not None:
                joined |= anchor[start] == split
            by_join = np.repeat(joined, rows)
            small = ~joined & (rows > 1)
            i, j = _pairs_within(start[small], rows[small]) if small.any() else (np.empty(0, np.int64),) * 2
            # Of signed numbers numpy would count the bits of the absolute value.
            apart = sum(np.bitwise_count((part[i] ^ part[j]).view(U64)).astype(np.int64) for part in sketch)
            near = (apart <= limit) & (h[i] != h[j])
            pair = np.unique(np.stack([np.minimum(h[i], h[j])[near], np.maximum(h[i], h[j])[near]]), axis=1)
            none = pa.nulls(pair.shape[1], pa.int64())
            rest = [tx.signed(key[by_join]), h[by_join], pa.nulls(int(by_join.sum()), pa.int64()), *(part[by_join] for part in sketch)]
            columns = [pa.concat_arrays([pa.array(x), pa.array(y)]) for x, y in zip((none, pair[0], pair[1], *[none] * len(sketch)), rest)]
            return pa.RecordBatch.from_arrays(columns, schema=_MET)

        waiting: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            waiting = table if waiting is None else pa.concat_tables([waiting, table])
            anchors = waiting.column("anchor").to_numpy()
            if len(anchors) < min(20_000, anchor_rows):
                continue
            last = int(np.searchsorted(anchors, anchors[-1], side="left"))
            if last:
                yield met(waiting.slice(0, last), True)
                waiting = waiting.slice(last)
            elif len(anchors) > anchor_rows:
                yield met(waiting, False)
                split, waiting = int(anchors[-1]), None
        if waiting is not None and waiting.num_rows:
            yield met(waiting, True)

    return meet


def _overlap(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    union = len(a) + len(b) - both
    return both / union if union else 0.0


_PAIR = pa.schema([("field", pa.string()), ("i", pa.string()), ("j", pa.string()), ("a", pa.int64()), ("b", pa.int64())])
_PAIR_SQL = "field string, i string, j string, a long, b long"


def _verifier(threshold: float, named: bool):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by group, texts (sh set) before pairs; a group holds at most two blocks of texts.

        A verified pair is named by the comments that carry the two texts; if
        one text has more than COPIES copies, or names are not wanted, only the texts are given.
        """
        group, texts = None, {}
        for batch in batches:
            out: tuple[list, ...] = ([], [], [], [], [])
            for g, a, b, sh, field, ids in zip(*(batch.column(c).to_pylist() for c in ("g", "a", "b", "sh", "field", "ids"))):
                if g != group:
                    group, texts = g, {}
                if sh is not None:
                    texts[a] = (np.frombuffer(sh, np.uint32), field, ids)
                    continue
                left, field, left_ids = texts[a]
                right, _, right_ids = texts[b]
                if _overlap(left, right) < threshold:
                    continue
                if not named or len(left_ids) > COPIES or len(right_ids) > COPIES:
                    found = [(None, None)]
                else:
                    found = [(min(i, j), max(i, j)) for i in left_ids for j in right_ids if i != j]
                for i, j in found:
                    for column, value in zip(out, (field, i, j, a, b)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, _PAIR.types)], schema=_PAIR)

    return verify


def fingerprint_table(comments: DataFrame) -> DataFrame:
    """One row per (field, comment_id) with at least MIN_WORDS words; spilled to the shared folder."""
    return spill(comments.select("comment_id", *FIELDS).where(F.col("comment_id").isNotNull()).mapInArrow(_fingerprint_batches, DOC_SCHEMA), "p1-texts")


def candidate_pairs(texts: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Pairs (a, b), a < b, of different texts that share a fuzzy key and have close sketches."""
    segments = texts.where("fp is not null").select("h", "sk", "fp").mapInArrow(_unpack, f"anchor long, word int, h long, {_SKETCH_SQL}")
    by_anchor = segments.repartition("anchor").dropDuplicates(["anchor", "h"]).sortWithinPartitions("anchor")
    limit = sketch_limit(threshold, DEVIATIONS)
    met = spill(by_anchor.mapInArrow(_meet(limit, KEY_ROWS, ANCHOR_ROWS), _MET_SQL), "p1-met")
    keys = met.where("key is not null").select("key", F.col("a").alias("h"), *_SKETCH)
    x, y = keys.alias("x"), keys.alias("y")
    apart = F.expr(" + ".join(f"bit_count(x.{s} ^ y.{s})" for s in _SKETCH))
    joined = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.h") < F.col("y.h")) & (apart <= limit)).select(F.col("x.h").alias("a"), F.col("y.h").alias("b"))
    return met.where("key is null").select("a", "b").unionAll(joined).distinct()


def contracted(pairs: DataFrame) -> DataFrame:
    """Far fewer edges with the same components: both ends of (a, b) are tied to the least partner of b."""
    least = Window.partitionBy("b")
    tied = pairs.withColumn("g", F.min("a").over(least))
    return tied.select(F.col("b").alias("a"), F.col("g").alias("b")).distinct().unionAll(tied.select("a", F.col("g").alias("b")).where("a <> b").distinct())


#: Bits of the sieve that keeps texts without candidates out of a shuffle: 2 MB at any size of input.
SIEVE_BITS = 1 << 24


def sieve(nodes: DataFrame) -> np.ndarray:
    """Bit set of the places of all nodes; of fixed size, so that it lets more through, but never loses a node, as nodes grow."""
    place = F.pmod(F.xxhash64("node"), F.lit(SIEVE_BITS))
    bits = nodes.select((place / 32).cast("int").alias("word"), F.expr(f"shiftleft(1L, cast(pmod(pmod(xxhash64(node), {SIEVE_BITS}), 32) as int))").alias("bit"))
    out = np.zeros(SIEVE_BITS // 32, np.int64)
    rows = bits.groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out[rows["word"].to_numpy(dtype=np.int64)] = rows["bits"].to_numpy(dtype=np.int64)
    return out


def _sifter(bits: np.ndarray):
    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            place = batch.column("place").to_numpy()
            yield batch.filter(pa.array((bits[place >> 5] >> (place & 31)) & 1 == 1)).drop_columns(["place"])

    return sift


def verified_pairs(texts: DataFrame, threshold: float = THRESHOLD, named: bool = True) -> DataFrame:
    """(field, i, j, a, b): text pairs (a, b) whose overlap reaches the threshold, with the comments i < j that carry them."""
    pairs = spill(candidate_pairs(texts, threshold), "p1-candidates")
    group = components(contracted(pairs), "p1-groups")
    size = group.groupBy("component").agg(F.count("*").alias("members"))
    blocks = F.greatest(F.lit(1), F.ceil(F.col("members") / GROUP_BLOCK)).cast("int")
    # A group of more than GROUP_BLOCK texts is split: a text goes to every pair of blocks that holds its block.
    placed = group.join(size, "component").withColumn("blocks", blocks).select("node", "component", "blocks", F.expr("pmod(node, blocks)").cast("int").alias("block"))
    placed = spill(placed, "p1-placed")
    cell = lambda low, high: F.xxhash64("component", low, high)
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    copies = placed.select("node", "component", "block", other.alias("other")).select("node", cell(F.least("block", "other"), F.greatest("block", "other")).alias("g"))
    # Texts without candidates are kept out of the shuffles by the sieve.
    sift = _sifter(sieve(placed.select("node")))
    placed_at = F.pmod(F.xxhash64("h"), F.lit(SIEVE_BITS)).alias("place")
    named_by = texts.select(F.col("h").alias("node"), "field", "comment_id", placed_at).mapInArrow(sift, "node long, field string, comment_id string").distinct()
    nth = F.row_number().over(Window.partitionBy("node").orderBy("comment_id"))
    ids = named_by.withColumn("nth", nth).where(F.col("nth") <= COPIES + 1).groupBy("node").agg(F.first("field").alias("field"), F.collect_list("comment_id").alias("ids"))
    stored = texts.where("sh is not null").select(F.col("h").alias("node"), "sh", placed_at).mapInArrow(sift, "node long, sh binary")
    text_rows = copies.join(ids, "node").join(stored, "node").select("g", F.col("node").alias("a"), F.lit(None).cast("long").alias("b"), "sh", "field", "ids")
    # Both ends of a pair are of one component, so that the component comes with one of them.
    left = placed.select(F.col("node").alias("a"), "component", "blocks", F.col("block").alias("x"))
    y = F.expr("pmod(b, blocks)").cast("int")
    pair_rows = pairs.join(left, "a").withColumn("y", y).select(cell(F.least("x", "y"), F.greatest("x", "y")).alias("g"), "a", "b")
    for name, kind in (("sh", "binary"), ("field", "string"), ("ids", "array<string>")):
        pair_rows = pair_rows.withColumn(name, F.lit(None).cast(kind))
    rows = text_rows.unionByName(pair_rows).repartition("g").sortWithinPartitions("g", F.col("sh").isNull())
    return rows.mapInArrow(_verifier(threshold, named), _PAIR_SQL)


def near_duplicate_pairs(comments: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """p1: (field, comment_id_a, comment_id_b) of all near copies, the smaller id first.

    NULL, empty and short texts (under 25 words) take part in no pair; a
    comment_id that repeats counts once; exact copies of one text are found by
    their hash and pass through the join once.
    """
    texts = fingerprint_table(comments)
    found = verified_pairs(texts, threshold)
    member = texts.select("field", "comment_id", "h")
    # Texts that several comments carry: few rows, found by one aggregate.
    shared = spill(member.groupBy("h").agg(F.min(F.xxhash64("comment_id")).alias("low"), F.max(F.xxhash64("comment_id")).alias("high"), F.count("*").alias("rows")).where("low < high").select("h", "rows"), "p1-shared")
    carried = member.join(shared, "h").select("field", "comment_id", "h").distinct()
    x, y = carried.alias("x"), carried.alias("y")
    copies = x.join(y, (F.col("x.h") == F.col("y.h")) & (F.col("x.comment_id") < F.col("y.comment_id"))).select("x.field", F.col("x.comment_id").alias("i"), F.col("y.comment_id").alias("j"))
    between = found
    if not shared.where(F.col("rows") > COPIES).isEmpty():
        member = member.distinct()
        between = spill(found, "p1-pairs")
        hot = between.where("i is null").select("a", "b").distinct()
        m1 = member.select(F.col("h").alias("a"), "field", F.col("comment_id").alias("p"))
        m2 = member.select(F.col("h").alias("b"), F.col("comment_id").alias("q"))
        spread = hot.join(m1, "a").join(m2, "b").where("p <> q").select("field", F.least("p", "q").alias("i"), F.greatest("p", "q").alias("j"))
        copies = copies.unionByName(spread)
        between = between.where("i is not null")
    both = between.select("field", "i", "j").unionByName(copies)
    # A comment whose repeats differ in text can meet another comment twice.
    repeated = texts.groupBy(F.xxhash64("field", "comment_id").alias("key")).agg(F.min("h").alias("low"), F.max("h").alias("high")).where("low < high")
    if not repeated.isEmpty():
        both = both.distinct()
    return both.select("field", F.col("i").alias("comment_id_a"), F.col("j").alias("comment_id_b"))


def near_duplicate_groups(comments: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """p1: one row per comment and field that has a near copy: its class, the class size and the number of links of its text to different texts."""
    texts = fingerprint_table(comments)
    pairs = spill(verified_pairs(texts, threshold, named=False).select("a", "b").distinct(), "p1-links")
    group = components(contracted(pairs), "p1-final")
    links = pairs.select(F.col("a").alias("h")).unionAll(pairs.select(F.col("b").alias("h"))).groupBy("h").agg(F.count("*").alias("links"))
    member = texts.select("field", "comment_id", "h").distinct()
    named = member.join(group.select(F.col("node").alias("h"), "component"), "h", "left").join(links, "h", "left")
    named = named.select("field", "comment_id", F.coalesce("component", "h").alias("class_id"), F.coalesce("links", F.lit(0)).alias("links"))
    sizes = named.groupBy("class_id").agg(F.countDistinct("comment_id").alias("class_size"))
    return named.join(sizes, "class_id").select("field", "comment_id", "class_id", "class_size", "links").where("class_size > 1")
