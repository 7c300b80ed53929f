"""Token-id files: documents in ascending id order, range-coded in blocks that stand alone.

A folder of Parquet files holds one row for each block: part, block and blob. A blob is, little-endian: magic "TIDS1"
and a zero byte; u32 documents, u32 ids, u32 CRC-32 of the ids as u32; u64 ids and u64 documents of the part before the
block; for each document i64 doc_id, u8 flags (1: id is NULL, 2: began before this block, 4: goes on after it), u32
ids in this block; then the payload of ``range_coder``. A reader checks magic and CRC and raises on damage.

Parts are ranges of doc_id (ties by a hash of the text, then the text), so file order is document order; the ranges are
found on ids and hashes, texts stay where they are until they are dealt. NULL and empty texts are the end id alone; rows that repeat
an id are written each; an empty table gives an empty folder. A block is decoded once, also for documents that go on
from block to block: the report carries lengths and CRCs of their pieces, which add up to those of the whole.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from matchspark.llm import common, range_coder
from matchspark.llm.merging import ByteCoder

MAGIC = b"TIDS1\0"
HEAD = struct.Struct("<6sIIIQQ")
ENTRY = struct.Struct("<qBI")
BLOCK = 2048
LANES = 4096
NULL, BEGAN, GOES_ON = 1, 2, 4


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 1) -> None:
    spec = docs.sparkSession.sparkContext.broadcast(common.read_file(tokenizer_path, text=True))
    keyed = common.texts(docs).withColumn("_hash", F.xxhash64("text"))
    ordered = keyed.repartitionByRange("doc_id", "_hash").sortWithinPartitions("doc_id", "_hash", "text").drop("_hash")

    def run(batches):
        part, made = TaskContext.get().partitionId(), 0
        tokens, documents = 0, 0
        waiting: list[tuple[int | None, int, np.ndarray]] = []  # doc_id, flags so far, ids

        def blocks(last: bool):
            """Take full blocks off the waiting documents, the rest too if this is the end."""
            nonlocal tokens, documents, waiting
            out, entries, arrays, room, k = [], [], [], BLOCK, 0
            first = (tokens, documents)
            while k < len(waiting):
                doc, flags, ids = waiting[k]
                take = ids[:room]
                if len(take) == len(ids):
                    k += 1
                else:
                    waiting[k] = (doc, flags | BEGAN, ids[room:])
                    flags |= GOES_ON
                entries.append((doc, flags, len(take)))
                arrays.append(take)
                room -= len(take)
                tokens += len(take)
                documents += not flags & GOES_ON
                if room == 0 or last and k == len(waiting):
                    out.append((first, entries, np.concatenate(arrays)))
                    entries, arrays, room = [], [], BLOCK
                    first = (tokens, documents)
            if entries:  # not full: wait for more
                tokens, documents = first
                taken = sum(len(a) for a in arrays)
                back = [(d, f & ~GOES_ON, a) for (d, f, _), a in zip(entries, arrays, strict=True)]
                waiting = back + waiting[k:]
                assert taken < BLOCK
            else:
                waiting = waiting[k:]
            return out

        def batch_of(found):
            nonlocal made
            payloads = range_coder.encode([ids for _, _, ids in found])
            blobs = []
            for (first, entries, ids), payload in zip(found, payloads, strict=True):
                blobs.append(packed(first, entries, ids, payload))
            numbers = np.arange(made, made + len(blobs))
            made += len(blobs)
            columns = [pa.array(np.full(len(blobs), part), pa.int32()), pa.array(numbers, pa.int64()), pa.array(blobs, pa.binary())]
            return pa.RecordBatch.from_arrays(columns, ["part", "block", "blob"])

        ready = []
        for batch in (part for batch in batches for part in common.by_bytes(batch)):
            ids = batch.column("doc_id").to_pylist()
            flat, counts = common.coder(ByteCoder, spec.value).encode(batch.column("text").to_pylist())
            edges = np.r_[0, np.cumsum(counts)].tolist()
            waiting += [(d, 0, np.append(flat[a:b], end_id).astype(np.int64)) for d, a, b in zip(ids, edges[:-1], edges[1:], strict=True)]
            ready += blocks(False)
            while len(ready) >= LANES:
                yield batch_of(ready[:LANES])
                ready = ready[LANES:]
        ready += blocks(True)
        if ready:
            yield batch_of(ready)

    ordered.mapInArrow(run, "part int, block bigint, blob binary").write.parquet(path)


def packed(first: tuple[int, int], entries: list[tuple], ids: np.ndarray, payload: bytes) -> bytes:
    """A block; ``first``: ids and documents of the part before it."""
    head = HEAD.pack(MAGIC, len(entries), len(ids), zlib.crc32(ids.astype("<u4").tobytes()), *first)
    return head + b"".join(ENTRY.pack(0 if d is None else d, f | (NULL if d is None else 0), n) for d, f, n in entries) + payload


def unpack(blob: bytes) -> tuple[tuple, list[tuple], bytes]:
    """Head, document entries and payload of a block."""
    if len(blob) < HEAD.size:
        raise ValueError("block is too short")
    head = HEAD.unpack_from(blob)
    if head[0] != MAGIC:
        raise ValueError("not a block of token ids")
    end = HEAD.size + ENTRY.size * head[1]
    return head, list(ENTRY.iter_unpack(blob[HEAD.size : end])), blob[end:]


def pieces(spark: SparkSession, path: str, ids: bool = True) -> DataFrame:
    """What blocks hold of each document: part, document (its number in the part), doc_id, flags, at (ids of the part
    before), n and crc of its ids as u32, and the ids as bytes or, on wish, without them."""
    stored = spark.read.schema("part int, block bigint, blob binary").parquet(path)
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
    names = ["part", "document", "doc_id", "flags", "at", "n", "crc", "ids"]
    width = len(names) if ids else len(names) - 1

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, LANES):
                some = batch.slice(k, LANES)
                parsed = [unpack(b) for b in some.column("blob").to_pylist()]
                decoded = range_coder.decode([p for _, _, p in parsed], [h[2] for h, _, _ in parsed])
                rows = []
                for part, (head, entries, _), block in zip(some.column("part").to_pylist(), parsed, decoded, strict=True):
                    data = block.astype("<u4").tobytes()
                    if zlib.crc32(data) != head[3]:
                        raise ValueError("checksum of a block of token ids is wrong")
                    at, document = 0, head[5]
                    for doc, flags, n in entries:
                        own = data[4 * at : 4 * (at + n)]
                        rows.append((part, document, None if flags & NULL else doc, flags, head[4] + at, n, zlib.crc32(own), own)[:width])
                        at += n
                        document += not flags & GOES_ON
                columns = list(zip(*rows, strict=True)) or [()] * width
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=False)], names[:width])

    schema = "part int, document bigint, doc_id bigint, flags int, at bigint, n bigint, crc bigint" + (", ids binary" if ids else "")
    return stored.mapInArrow(run, schema)


def _alone() -> Column:
    """Whether a piece is its whole document."""
    return F.col("flags").bitwiseAND(BEGAN | GOES_ON) == 0


def _together(found: DataFrame, fields: list[str]) -> DataFrame:
    """part, doc_id and the pieces (``p``) in order of the documents that lie in several blocks."""
    return found.filter(~_alone()).groupBy("part", "document").agg(
        F.first("doc_id", ignorenulls=True).alias("doc_id"), F.array_sort(F.collect_list(F.struct("at", *fields))).alias("p")
    ).drop("document")


def read(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, at (ids of the part before) and ids (bytes, u32 little-endian) of every document."""
    found = common.stored(pieces(spark, path), "token-files")
    whole = found.filter(_alone()).select("doc_id", "part", "at", "ids")
    joined = F.aggregate("p", F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return whole.unionByName(_together(found, ["ids"]).select("doc_id", "part", F.col("p")[0]["at"].alias("at"), joined.alias("ids")))


def _shift_tables() -> list[list[list[int]]]:
    """What each byte of a CRC-32 becomes when 4, 8, 16, ... zero bytes follow: for each power, place and byte."""
    step = list(range(256))
    for _ in range(8):
        step = [(v >> 1) ^ 0xEDB88320 if v & 1 else v >> 1 for v in step]

    def four_more(v: int) -> int:
        for _ in range(4):
            v = step[v & 255] ^ (v >> 8)
        return v

    out = [[[four_more(b << (8 * k)) for b in range(256)] for k in range(4)]]
    for _ in range(40):
        last = out[-1]
        out.append([[_shifted(_shifted(b << (8 * k), last), last) for b in range(256)] for k in range(4)])
    return out


def _shifted(crc: int, table: list[list[int]]) -> int:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


@lru_cache(maxsize=1)
def _tables() -> list[list[list[int]]]:
    return _shift_tables()


def crc_of(parts: list[tuple[int, int]]) -> int:
    """CRC-32 of ids from the (number of ids, CRC) of their pieces in order."""
    crc = 0
    for n, own in parts:
        power = 0
        while n >> power:
            if n >> power & 1:
                crc = _shifted(crc, _tables()[power])
            power += 1
        crc ^= own
    return crc


def report(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document of the files."""
    found = common.stored(pieces(spark, path, ids=False), "token-files")
    columns = ["doc_id", "part", "at", "n_tokens", "ids_crc32"]

    def joined(batches):
        for batch in batches:
            lists = batch.column("p").to_pylist()
            crcs = [crc_of([(x["n"], x["crc"]) for x in p]) for p in lists]
            numbers = [[p[0]["at"] for p in lists], [sum(x["n"] for x in p) for p in lists], crcs]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("part"), *[pa.array(c, pa.int64()) for c in numbers]], columns)

    split = _together(found, ["n", "crc"]).select("doc_id", "part", "p").mapInArrow(
        joined, "doc_id bigint, part int, at bigint, n_tokens bigint, ids_crc32 bigint"
    )
    whole = found.filter(_alone()).select("doc_id", "part", "at", F.col("n").alias("n_tokens"), F.col("crc").alias("ids_crc32"))
    rows = whole.unionByName(split)
    parts = found.groupBy("part").agg(F.sum("n").alias("total"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each file
    starts = parts.select("part", F.coalesce(F.sum("total").over(before), F.lit(0)).alias("before"))
    return rows.join(starts, "part").select("doc_id", (F.col("before") + F.col("at")).alias("start"), "n_tokens", "ids_crc32")
