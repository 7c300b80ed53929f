"""Best-fit packing of token sequences by large-item matching.

Lengths are small integers, so the plan is made for their histogram (one row for each length up to the capacity) and
documents only look up their place in it. Pieces above a third of the capacity are matched first: at most two share a
bin, each large one taking the largest partner that fits. Shorter pieces then go, longest first, into the fullest bin
that still holds them. Places of a length are dealt by rank: a piece's rank among those of its length is its rank in
a hashed cell plus the counts of the cells before it, so no length and no document group meets in one task.

A document is its ids and one end id. Only a document longer than the capacity is cut, its first piece being the
shorter one. NULL and empty texts are the end id alone. Rows that repeat an id are packed each.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.llm import common
from matchspark.llm.merging import ByteCoder

CAPACITY = 2048
CELLS = 512
BIG = 1 << 40


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """doc_id, row (a number for each input row), piece, start, length, ids_crc32 and on demand the ids of every piece."""
    spec = docs.sparkSession.sparkContext.broadcast(common.read_file(tokenizer_path, text=True))

    def run(batch: pa.RecordBatch):
        if batch.num_rows:
            flat, counts = common.coder(ByteCoder, spec.value).encode(batch.column("text").to_pylist())
            edges = np.r_[0, np.cumsum(counts)].tolist()
            source, piece, start, length, crc, lists = [], [], [], [], [], []
            for k, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True)):
                ids = np.append(flat[a:b], end_id).astype("<u4")
                at = 0
                for number, size in enumerate(piece_sizes(len(ids), capacity)):
                    part = ids[at : at + size]
                    source.append(k)
                    piece.append(number)
                    start.append(at)
                    length.append(size)
                    crc.append(zlib.crc32(part.tobytes()))
                    lists.append(part.astype(np.int32) if with_ids else None)
                    at += size
            columns = [batch.column("doc_id").take(pa.array(source)), pa.array(piece, pa.int32())]
            columns += [pa.array(x, pa.int64()) for x in (start, length, crc)]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                columns, names = [*columns, pa.array(lists, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(columns, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return common.map_arrow(common.texts(docs), run, schema)


def piece_sizes(n: int, capacity: int) -> list[int]:
    if n <= capacity:
        return [n]
    full = -(-n // capacity) - 1
    return [n - full * capacity] + [capacity] * full


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Rows (length, first rank, bins, first bin, offset): pieces of a length with ranks from the first on lie at the
    offset of as many consecutive bins. Ranks of each length are covered once, bins number from 0 without gaps."""
    left = dict(histogram)
    used: dict[int, int] = defaultdict(int)
    out: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # free room -> (first bin, bins)
    bins = 0

    def place(length: int, count: int, first: int, offset: int) -> None:
        out.append((length, used[length], count, first, offset))
        used[length] += count
        left[length] -= count

    # large pieces: at most two in a bin
    large = sorted(x for x, n in left.items() if 3 * x > capacity and n > 0)
    while large:
        a = large[-1]
        if not left[a]:
            large.pop()
            continue
        fits = bisect_left(large, capacity - a + 1) - 1
        while fits >= 0 and (not left[large[fits]] or large[fits] == a and left[a] < 2):
            if not left[large[fits]]:
                large.pop(fits)
            fits -= 1
        b = large[fits] if fits >= 0 else 0
        count = left[a] if not b else left[a] // 2 if a == b else min(left[a], left[b])
        place(a, count, bins, 0)
        if b:
            place(b, count, bins, a)
        gaps[capacity - a - b].append((bins, count))
        bins += count
    rooms = sorted(r for r in gaps if r > 0)
    # small pieces: the fullest bin that holds them
    for x in sorted((x for x, n in left.items() if n > 0), reverse=True):
        while left[x]:
            k = bisect_left(rooms, x)
            if k == len(rooms):
                fresh = -(-left[x] // (capacity // x))
                gaps[capacity].append((bins, fresh))
                bins += fresh
                insort(rooms, capacity)
                continue
            room = rooms[k]
            first, count = gaps[room].pop()
            if not gaps[room]:
                rooms.pop(k)
            each = min(room // x, left[x])
            filled = min(count, left[x] // each)
            for t in range(each):
                place(x, filled, first, capacity - room + t * x)
            for start, n, rest in ((first, filled, room - each * x), (first + filled, count - filled, room)):
                if n and rest > 0:
                    if not gaps[rest]:
                        insort(rooms, rest)
                    gaps[rest].append((start, n))
    return out


def pack(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """The pieces with sequence_id and offset. Pieces of full length are sequences of their own."""
    cut = common.stored(cut.withColumn("_cell", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(CELLS)).cast("int")))
    cells = cut.groupBy("length", "_cell").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = common.stored(cells.withColumn("_before", F.coalesce(F.sum("n").over(before), F.lit(0))))
    counts = {r["length"]: r["n"] for r in cells.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    if max(counts, default=0) >= BIG:
        raise ValueError("more pieces of one length than a rank can number")
    rows = sorted(plan(counts, capacity))
    table = cut.sparkSession.sparkContext.broadcast([np.array(x, np.int64) for x in zip(*rows, strict=True)] if rows else [])

    order = Window.partitionBy("length", "_cell").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("_in_cell", F.row_number().over(order) - 1).join(cells.drop("n"), ["length", "_cell"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32"]
    ranked = ranked.select(*names, (F.col("_before") + F.col("_in_cell")).alias("rank"))

    def look_up(batches):
        length, rank, _, first, offset = table.value
        key = length * BIG + rank
        for batch in batches:
            own, at = (np.asarray(batch.column(c)) for c in ("length", "rank"))
            row = np.searchsorted(key, own * BIG + at, side="right") - 1
            sequence = first[row] + at - rank[row]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset[row])], [*names, "sequence_id", "offset"])

    kind = cut.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint"
    return ranked.mapInArrow(look_up, schema)
