"""Density-aware sampling of vectors with cluster coverage, and document vectors."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlens.functions import exprs as X
from docketlens.operators.sampling import SEED, weighted_draw
from docketlens.session import discard, spill

#: Bytes of vectors that may be sent to every task for exact neighbours; beyond it blocks of so many bytes meet pairwise.
SENT_BYTES, BLOCK_BYTES = 64 << 20, 8 << 20


#: Parameters of word vectors that the reference leaves at their usual values: wrong words a right one is held against, their power of frequency, frequency above which words are thinned, first and last step.
NEGATIVE, NOISE, THIN, STEP, LAST_STEP = 5, 0.75, 1e-3, 0.025, 1e-4
#: Texts are trained in parts of so many words, at most PARTS of them, whose models are averaged after each round.
PART_WORDS, PARTS = 1_500_000, 64
#: Positions of one stretch, stretches whose steps are taken together, wrong words drawn for these, steps of one word that are added one by one, and words of one row of a model.
STRETCH, TOGETHER, DRAWN, ONE_BY_ONE, ROW_WORDS = 64, 4, 32, 4, 256


def _flat(lists: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column, and the number of each row's."""
    return np.asarray(pc.list_flatten(lists)), np.asarray(pc.fill_null(pc.list_value_length(lists), 0))


def _rows_added(target: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """target[at] += rows, where places repeat: a few of each place one after the other, the rest in sums."""
    order = np.argsort(at, kind="stable")
    places = at[order]
    first = np.flatnonzero(np.concatenate(([True], places[1:] != places[:-1])))
    rank = np.arange(len(places)) - np.repeat(first, np.diff(np.append(first, len(places))))
    for k in range(ONE_BY_ONE):
        chosen = rank == k
        target[places[chosen]] += rows[order[chosen]]
    often = rank >= ONE_BY_ONE
    if often.any():
        left = places[often]
        first = np.flatnonzero(np.concatenate(([True], left[1:] != left[:-1])))
        target[left[first]] += np.add.reduceat(rows[order[often]], first, axis=0)


def train_words(flat: np.ndarray, lengths: np.ndarray, counts: np.ndarray, inner: np.ndarray, outer: np.ndarray, window: int, steps: tuple[float, float], seed: list[int]) -> None:
    """One round of CBOW with negative sampling over texts of word numbers, in place.

    A word is told from the mean of its context (of one to ``window`` words either side,
    by chance) among words drawn by frequency; frequent words are thinned.  The steps of
    a few stretches are computed together and share the wrong words they are held against,
    each at such weight that a right word meets NEGATIVE of them.
    """
    rng, share = np.random.default_rng(seed), counts / counts.sum()
    text = np.repeat(np.arange(len(lengths)), lengths)
    kept = rng.random(len(flat)) < (np.sqrt(THIN / share) + THIN / share)[flat]
    flat, text = flat[kept], text[kept]
    noise = np.cumsum(counts.astype(np.float64) ** NOISE)
    chunk = STRETCH * TOGETHER
    filled = -(-len(flat) // chunk) * chunk
    # A margin on either side and the rest of the last chunk belong to no text.
    words = np.concatenate([np.zeros(window, np.int64), flat, np.zeros(filled - len(flat) + window, np.int64)])
    text = np.concatenate([np.full(window, -1), text, np.full(filled - len(text) + window, -1)])
    reach = rng.integers(1, window + 1, filled)
    centre, around = np.arange(chunk).reshape(TOGETHER, STRETCH), np.arange(0, chunk, STRETCH)[:, None] + np.arange(STRETCH + 2 * window)
    offset = np.abs(np.arange(STRETCH + 2 * window)[None, :] - window - np.arange(STRETCH)[:, None])
    for at in range(0, filled, chunk):
        step = np.float32(steps[0] + (steps[1] - steps[0]) * at / filled)
        own, of, near, near_of = words[at + window + centre], text[at + window + centre], words[at + around], text[at + around]
        linked = ((offset <= reach[at + centre][:, :, None]) & (offset > 0) & (of[:, :, None] == near_of[:, None, :]) & (of >= 0)[:, :, None]).astype(np.float32)
        number = linked.sum(axis=2)
        mean = (np.matmul(linked, inner[near]) / np.maximum(number, 1)[:, :, None]).reshape(chunk, -1)
        own, some = own.ravel(), (number > 0).ravel()
        right = outer[own]
        pull = np.where(some, step / (1 + np.exp(np.clip(np.einsum("ij,ij->i", mean, right), -30, 30))), 0).astype(np.float32)
        drawn = np.searchsorted(noise, rng.random(DRAWN) * noise[-1], side="right")
        wrong = outer[drawn]
        push = np.where((own[:, None] != drawn) & some[:, None], -step * NEGATIVE / DRAWN / (1 + np.exp(np.clip(-(mean @ wrong.T), -30, 30))), 0).astype(np.float32)
        move = pull[:, None] * right + push @ wrong
        _rows_added(outer, np.concatenate([own, drawn]), np.concatenate([pull[:, None] * mean, push.T @ mean]))
        _rows_added(inner, near.ravel(), np.matmul(linked.transpose(0, 2, 1), move.reshape(TOGETHER, STRETCH, -1)).reshape(near.size, -1))


_MODEL = pa.schema([("side", pa.int32()), ("row", pa.int32()), ("seen", pa.list_(pa.float32())), ("values", pa.binary())])
_MODEL_SQL = "side int, row int, seen array<float>, values binary"


def _trained(counts, model, window: int, number: int, rounds: int):
    """Trains a copy of the model on one part; rows hold ROW_WORDS words and how often the part has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        inner, outer = (x.copy() for x in model.value)
        part = pa.Table.from_batches(held).sort_by("place")
        flat, lengths = _flat(part.column("ids"))
        step = lambda k: STEP + (LAST_STEP - STEP) * k / rounds
        train_words(flat, lengths, counts.value, inner, outer, window, (step(number), step(number + 1)), [SEED, number, part.column("part")[0].as_py()])
        seen = np.bincount(flat, minlength=len(inner)).astype(np.float32)
        rows = [(side, k, seen[k : k + ROW_WORDS], x[k : k + ROW_WORDS].tobytes()) for side, x in enumerate((inner, outer)) for k in range(0, len(x), ROW_WORDS)]
        for k in range(0, len(rows), 16):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows[k : k + 16]), _MODEL.types)], schema=_MODEL)

    return run


def _averaged(size: int):
    """The mean of the parts' vectors of some words, by how often each part has the word."""

    def run(rows: pa.Table) -> pa.Table:
        total, seen = 0, 0
        for n, values in zip(rows.column("seen"), rows.column("values")):
            n = np.array(n.as_py(), np.float32) + 1e-3
            total, seen = total + n[:, None] * np.frombuffer(values.as_py(), np.float32).reshape(len(n), size), seen + n
        return pa.table([rows.column("side")[:1], rows.column("row")[:1], pa.array([[]], pa.list_(pa.float32())), pa.array([(total / seen[:, None]).astype(np.float32).tobytes()])], schema=_MODEL)

    return run


def word_vectors(ids: DataFrame, parts: int, counts: np.ndarray, size: int, window: int, rounds: int) -> np.ndarray:
    """Vectors of words 0, 1, ... trained on texts (part, place, ids), all parts at the same time, each in order of ``place``."""
    context = ids.sparkSession.sparkContext
    inner = (np.random.default_rng(SEED).random((len(counts), size), np.float32) - np.float32(0.5)) / size
    outer, sent = np.zeros_like(inner), context.broadcast(counts)
    for number in range(rounds):
        model = context.broadcast((inner, outer))
        trained = ids.repartitionById(parts, "part").mapInArrow(_trained(sent, model, window, number, rounds), _MODEL_SQL)
        mean = spill(trained.groupBy("side", "row").applyInArrow(_averaged(size), _MODEL_SQL), "words")
        inner, outer = np.empty_like(inner), np.empty_like(outer)
        for row in mean.select("side", "row", "values").toLocalIterator():
            values = np.frombuffer(row["values"], np.float32).reshape(-1, size)
            (inner, outer)[row["side"]][row["row"] : row["row"] + len(values)] = values
        discard(mean)
        model.destroy()
    return inner


def _mean_vectors(words, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 1000):
                batch = whole.slice(at, 1000)
                flat, lengths = _flat(batch.column("ids"))
                out, some = np.zeros((batch.num_rows, size)), lengths > 0
                if some.any():
                    first = np.concatenate(([0], np.cumsum(lengths)[:-1]))[some]
                    out[some] = np.add.reduceat(words.value[flat], first, axis=0)
                    out /= np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-30)
                vector = pa.ListArray.from_arrays(pa.array(np.arange(0, out.size + 1, size), pa.int32()), pa.array(out.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), vector], names=[batch.schema.names[0], "vector"])

    return run


def _numbered(vocabulary):
    """Tokens as numbers of words; other tokens are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = vocabulary.value
        for batch in batches:
            tokens = batch.column("tokens")
            lengths = np.asarray(pc.fill_null(pc.list_value_length(tokens), 0))
            found = pc.index_in(pc.list_flatten(tokens), value_set=known)
            ends = np.concatenate(([0], np.cumsum(np.asarray(pc.is_valid(found)))))[np.concatenate(([0], np.cumsum(lengths)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.ListArray.from_arrays(pa.array(ends, pa.int32()), found.drop_null())], names=[*batch.schema.names[:-1], "ids"])

    return run


def document_vectors(texts: DataFrame, key: str, text: str, size: int = 300, window: int = 5, min_count: int = 2, rounds: int = 5) -> DataFrame:
    """Mean word vectors of the texts at unit length; texts without known words get the zero vector.

    The driver holds the model: two vectors of each word that occurs ``min_count`` times.
    """
    spark = texts.sparkSession
    tokens = spill(texts.select(key, X.tokens(text).alias("tokens")), "tokens")
    known = tokens.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where(F.col("n") >= min_count).orderBy(F.desc("n"), "token").toArrow()
    counts = known.column("n").to_numpy()
    if not len(counts):
        return tokens.select(key, F.array_repeat(F.lit(0.0), size).alias("vector"))
    vocabulary, kind = spark.sparkContext.broadcast(known.column("token").combine_chunks()), dict(tokens.dtypes)[key]
    ids = spill(tokens.mapInArrow(_numbered(vocabulary), f"`{key}` {kind}, ids array<int>"), "ids")
    discard(tokens)
    parts = int(min(PARTS, -(-counts.sum() // PART_WORDS)))
    place = F.xxhash64(key, "ids")
    split = ids.select(F.pmod(place, F.lit(parts)).cast("int").alias("part"), place.alias("place"), "ids").where(F.size("ids") > 0)
    words = spark.sparkContext.broadcast(word_vectors(split, parts, counts, size, window, rounds))
    return ids.mapInArrow(_mean_vectors(words, size), f"`{key}` {kind}, vector array<double>")


def _neighbours(matrix: np.ndarray, k: int):
    unit = matrix / np.maximum(np.linalg.norm(matrix, axis=1, keepdims=True), 1e-12)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = np.array(batch.column("vector").to_pylist(), dtype=np.float32).reshape(batch.num_rows, unit.shape[1])
            rows /= np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)
            near = np.sort(1 - rows @ unit.T, axis=1)[:, 1 : k + 1]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(near.mean(axis=1).astype(np.float64))], names=["id", "distance"])

    return run


def _unit(table: pa.Table, d: int) -> np.ndarray:
    rows = np.array(table.column("vector").to_pylist(), dtype=np.float32).reshape(table.num_rows, d)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-12)


def _nearest_of_block(k: int, d: int):
    """The k + 1 least distances (one is the vector's own) of each left vector to the right block."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        near: list = []
        if left.num_rows and right.num_rows:
            unit, others = _unit(left, d), _unit(right, d)
            keep = min(k + 1, len(others))
            for at in range(0, len(unit), 256):
                near.extend(np.partition(1 - unit[at : at + 256] @ others.T, keep - 1, axis=1)[:, :keep].tolist())
        ids = left.column("id") if near else pa.array([], pa.int64())
        return pa.table({"id": ids, "near": pa.array(near, pa.list_(pa.float32()))})

    return run


def mean_neighbour_distance(vectors: DataFrame, k: int) -> DataFrame:
    """(id, distance): mean cosine distance to the k nearest others, exact at every size: against all vectors while they fit SENT_BYTES, else block by block."""
    dims = vectors.agg(F.count("*").alias("n"), F.max(F.size("vector")).alias("d")).first()
    if dims["n"] * (dims["d"] or 0) * 4 <= SENT_BYTES:
        matrix = np.array([r[0] for r in vectors.select("vector").toLocalIterator()], dtype=np.float32).reshape(dims["n"], dims["d"] or 0)
        return vectors.select("id", "vector").mapInArrow(_neighbours(matrix, min(k, dims["n"] - 1)), "id long, distance double")
    k, d = min(k, dims["n"] - 1), dims["d"]
    number = -(-dims["n"] * d * 4 // BLOCK_BYTES)
    every = F.explode(F.sequence(F.lit(0), F.lit(number - 1)))
    blocks = vectors.select("id", "vector", F.pmod(F.xxhash64("id"), F.lit(number)).cast("int").alias("block"))
    left = blocks.select("id", "vector", F.col("block").alias("a"), every.alias("b"))
    right = blocks.select("vector", F.col("block").alias("b"), every.alias("a"))
    near = left.groupBy("a", "b").cogroup(right.groupBy("a", "b")).applyInArrow(_nearest_of_block(k, d), "id long, near array<float>")
    least = near.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 2, k).alias("near"))
    return least.select("id", F.aggregate("near", F.lit(0.0), lambda s, x: s + x, lambda s: s / k).alias("distance"))


def density_sample(vectors: DataFrame, n: int, k: int = 50) -> DataFrame:
    """At most n ids, rare vectors first by chance; clusters without a pick take the place of the picks of highest weight."""
    rows = vectors.select("id", "vector").where("vector is not null")
    total = rows.count()
    if total == 0 or n >= total or total == 1:
        return rows.select("id", F.lit(False).alias("for_coverage"))
    clusters = max(1, min(max(10, int((total / 2) ** 0.5)), total))
    featured = rows.select("id", array_to_vector("vector").alias("features"))
    assigned = KMeans(k=clusters, seed=SEED, maxIter=10).fit(featured).transform(featured).select("id", F.col("prediction").alias("cluster"))
    distance = mean_neighbour_distance(rows, min(k, total - 1))
    weight = 1 / (1 / (F.col("distance") + 1e-6) + 1e-6)
    weighed = spill(distance.join(assigned, "id").withColumn("weight", weight), "density")
    picked = weighted_draw(weighed, "id", "weight", n)
    covered = picked.select("cluster").distinct()
    missing = weighed.join(covered, "cluster", "left_anti").groupBy("cluster").agg(F.min_by("id", X.draw_key(SEED, "id")).alias("id"))
    # Numbers of rows: at most n picks and one per cluster.
    gaps = missing.count()
    stay = picked.orderBy(F.col("weight"), "id").limit(max(0, n - gaps))
    return stay.select("id", F.lit(False).alias("for_coverage")).unionByName(missing.orderBy("cluster").limit(n).select("id", F.lit(True).alias("for_coverage")))
