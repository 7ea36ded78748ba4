"""Filling containers of fixed capacity with texts, by hierarchical residual packing.

Round 0 tokenizes every text and packs the items of each partition by
best-fit-decreasing.  Containers with almost no room left are final.  Underfull
containers become items themselves and are packed again, best fit, in fewer and
fewer partitions until one partition is left or a round stops helping.
A container row carries its members (at most ``capacity`` of them), so nothing
is joined back and only underfull containers are ever shuffled.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from math import ceil

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketlens.session import discard, spill

CAPACITY = 2048
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: The split of text into pieces that belongs to the vocabulary (published with it).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A container with at most this share of room left is final.
NEARLY_FULL = 0.005
#: Underfull containers that one task packs in a merge round.
MERGE_ROWS = 40_000
ROUNDS = 12

_MEMBER = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("tokens", pa.int32())])
_BIN = pa.schema([("container", pa.string()), ("fill", pa.int32()), ("members", pa.list_(_MEMBER))])
_BIN_SQL = "container string, fill int, members array<struct<doc_id:long,piece:int,tokens:int>>"


@lru_cache(maxsize=2)
def tokenizer(path: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit-decreasing: indices of the items in each container; every size is at most ``capacity``.

    Room is looked up in a bit set, so that an item costs one shift and one
    lowest-bit operation instead of a search over open containers.
    """
    containers: list[list[int]] = []
    open_by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms = 0
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        size = sizes[i]
        above = rooms >> size
        if above:
            room = size + (above & -above).bit_length() - 1
            slot = open_by_room[room]
            where = slot.pop()
            if not slot:
                rooms &= ~(1 << room)
            containers[where].append(i)
        else:
            room, where = capacity, len(containers)
            containers.append([i])
        left = room - size
        if left:
            open_by_room[left].append(where)
            rooms |= 1 << left
    return containers


def _task() -> int:
    from pyspark import TaskContext

    context = TaskContext.get()
    return context.partitionId() if context else 0


def _out(rows: list[tuple[str, int, list]]) -> pa.RecordBatch:
    names, fills, members = zip(*rows) if rows else ((), (), ())
    listed = [[{"doc_id": d, "piece": p, "tokens": t} for d, p, t in m] for m in members]
    return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(fills, pa.int32()), pa.array(listed, pa.list_(_MEMBER))], schema=_BIN)


def _first_round(capacity: int, vocabulary: str):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(vocabulary).encode_ordinary
        docs: list[tuple[int, int, int]] = []
        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                left, piece = (len(encode(text)) if text else 0), 0
                while left > 0:
                    size = min(left, capacity)
                    docs.append((doc_id, piece, size))
                    left -= size
                    piece += 1
        task = _task()
        rows = [(f"0-{task}-{n}", sum(docs[i][2] for i in members), [docs[i] for i in members]) for n, members in enumerate(best_fit([d[2] for d in docs], capacity))]
        for k in range(0, len(rows), 2000):
            yield _out(rows[k : k + 2000])

    return pack


def _merge_round(capacity: int, number: int):
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fills: list[int] = []
        members: list[list] = []
        names: list[str] = []
        for batch in batches:
            names += batch.column("container").to_pylist()
            fills += batch.column("fill").to_pylist()
            members += [[(m["doc_id"], m["piece"], m["tokens"]) for m in row] for row in batch.column("members").to_pylist()]
        task, rows = _task(), []
        for n, merged in enumerate(best_fit(fills, capacity)):
            name = names[merged[0]] if len(merged) == 1 else f"{number}-{task}-{n}"
            rows.append((name, sum(fills[i] for i in merged), [m for i in merged for m in members[i]]))
        for k in range(0, len(rows), 2000):
            yield _out(rows[k : k + 2000])

    return pack


def packed_containers(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """(container, fill, members) over all texts.

    A text of more tokens than ``capacity`` is cut into full pieces and a rest;
    no other text is split.  NULL and empty texts have no tokens and take no
    room.  Repeated rows are packed as often as they occur.
    """
    items = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    packed = spill(items.mapInArrow(_first_round(capacity, vocabulary), _BIN_SQL), "p8-round0")
    closed = F.col("fill") >= capacity * (1 - NEARLY_FULL)
    final, left = packed.where(closed), packed.where(~closed)
    rows = left.count()
    for number in range(1, ROUNDS):
        if rows <= 1:
            break
        tasks = ceil(rows / MERGE_ROWS)
        merged = spill(left.repartition(tasks, F.xxhash64("container", F.lit(number))).mapInArrow(_merge_round(capacity, number), _BIN_SQL), f"p8-round{number}")
        final, left = final.unionByName(merged.where(closed)), merged.where(~closed)
        before, rows = rows, left.count()
        # One task has seen all that is left, or mixing the rest anew no longer helps.
        if tasks == 1 or rows > 0.98 * before:
            break
    return final.unionByName(left)


def packed_items(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """p8: one row per text or piece of a text with its container, its place there and the container's fill."""
    each = packed_containers(documents, capacity, vocabulary).select("container", "fill", F.posexplode("members").alias("position", "m"))
    return each.select("container", "position", F.col("m.doc_id").alias("doc_id"), F.col("m.piece").alias("piece"), (F.col("m.piece").cast("long") * capacity).alias("first_token"), F.col("m.tokens").alias("tokens"), "fill")


def packing_summary(documents: DataFrame, capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """p8: containers, items, tokens, the least number of containers any packing needs, and the share of unused space."""
    totals = packed_containers(documents, capacity, vocabulary).agg(F.count("*").alias("containers"), F.coalesce(F.sum(F.size("members")), F.lit(0)).alias("items"), F.coalesce(F.sum("fill"), F.lit(0)).alias("tokens"))
    return totals.select("containers", "items", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"), F.expr(f"try_divide(containers * {capacity} - tokens, containers * {capacity})").alias("unused"))
