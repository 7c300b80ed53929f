"""Target-distribution importance resampling: documents that look like a target set are drawn without replacement.

1. Features of a text are all runs of one to three words, hashed into ``BUCKETS`` buckets by CRC-32. All texts of the
   corpus and of the target are counted; a bucket's gain is its scaled log ratio. CRCs of runs are put together from
   those of their words on flat arrays, so a feature is no Python object.
2. A document's weight is the sum of the gains of its features, looked up in one array; Gumbel noise from a hash of its id
   makes the highest scores a weighted draw without replacement.
3. The cutoff is found by weighted median-of-medians selection. Each partition reports the median of the keys that are
   left in it and their number; the median of these, weighted by those numbers, has at least a quarter of the keys on
   either side, so each round discards a quarter or more for certain. One pass over narrow keys a round; the driver
   sees a row for each partition, and the last ``FEW`` keys. Only the winners are sorted.

Keys are (score descending, doc_id ascending), rows of one key by n_features; a NULL id comes after all others and its noise
is that of the empty id. NULL and empty texts have no feature and weight 0. Rows that repeat an id are documents of
their own. Empty tables (corpus or target) give weights of the smoothed ratio, and no rows for an empty corpus.
"""

from __future__ import annotations

import hashlib
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from matchspark.llm import common

BUCKETS = 10_000
LONGEST = 3
SEED = 42
FEW = 4096
LONG_WORD = 64
LAST = (1 << 63) - 1


def _crc_steps() -> np.ndarray:
    """CRC-32 of a byte after any state, by the reflected polynomial."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_STEP = _crc_steps()


def _shifts(longest: int) -> np.ndarray:
    """What each byte of a CRC becomes when so many zero bytes follow: (length, place, byte)."""
    now = np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [now]
    for _ in range(longest):
        now = _STEP[now & 255] ^ (now >> 8)
        out.append(now)
    return np.array(out, np.uint32)


_SHIFT = _shifts(LONG_WORD + 1).reshape(-1)
_SPACE = np.uint32(zlib.crc32(b" "))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def _followed(crc: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRCs after so many zero bytes; with the CRC of what follows in their place (xor) they are those of the whole."""
    at = length.astype(np.int64) << 10
    out = _SHIFT[at + (crc & 255)]
    for k in (1, 2, 3):
        out ^= _SHIFT[at + (k << 8) + ((crc >> (8 * k)) & 255)]
    return out


def _word_crcs(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    order = np.argsort(-sizes, kind="stable")
    by_size, place = sizes[order], starts[order]
    state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    first = int(np.searchsorted(-by_size, -LONG_WORD, side="left"))
    for k in range(int(by_size[first]) if first < len(by_size) else 0):
        end = int(np.searchsorted(-by_size, -k, side="left"))
        own = state[first:end]
        state[first:end] = _STEP[(own ^ data[place[first:end] + k]) & 255] ^ (own >> 8)
    state ^= np.uint32(0xFFFFFFFF)
    for k in range(first):
        state[k] = zlib.crc32(data[place[k] : place[k] + by_size[k]])
    out = np.empty_like(state)
    out[order] = state
    return out


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
    """Words of each text, and for runs of one, two and three words their CRCs and which of them exist.

    ``data`` holds the texts as UTF-8 behind each other, ``offsets`` where each begins and the last ends. CRCs are listed
    by the first word of the run.
    """
    data = _LOWER[data]
    inside = _WORD[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside & np.r_[True, ~inside[:-1]] | inside & edge[:-1])
    ends = np.flatnonzero(inside & (np.r_[~inside[1:], True] | edge[1:])) + 1
    limits = np.searchsorted(starts, offsets)
    counts, n = np.diff(limits), len(starts)
    sizes = ends - starts
    one = _word_crcs(data, starts, sizes)
    behind = np.repeat(limits[1:], counts) - np.arange(n)  # words from here to the end of the text
    crcs, there = [one], [np.ones(n, bool)]
    clipped = np.minimum(sizes, LONG_WORD)
    spaced = _followed(np.full(n, _SPACE), clipped) ^ one
    long_words = np.flatnonzero(sizes > LONG_WORD)
    for more in range(1, LONGEST):
        have = max(n - more, 0)
        joined = np.zeros(n, np.uint32)
        joined[:have] = _followed(crcs[-1][:have], clipped[more:] + 1) ^ spaced[more:]
        for k in (long_words[long_words >= more] - more).tolist():
            word = data[starts[k + more] : ends[k + more]].tobytes()
            joined[k] = zlib.crc32(b" " + word, int(crcs[-1][k]))
        crcs.append(joined)
        there.append(behind > more)
    return counts, crcs, there


def _flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column of texts without NULLs."""
    texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.zeros(0, np.uint8) if held is None else np.frombuffer(held, np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket: tasks count for themselves, Spark adds up, a row for each bucket arrives."""

    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in common.by_bytes(batch):
                _, crcs, there = runs(*_flat(part.column("text")))
                for crc, some in zip(crcs, there, strict=True):
                    total += np.bincount(crc[some] % np.uint32(buckets), minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in texts.select("text").mapInArrow(run, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Scaled log ratio of each bucket, smoothed by one feature in every bucket."""
    s_all, t_all, buckets = float(corpus.sum()), float(target.sum()), float(len(corpus))
    ratio = lambda s, t: (t + 1.0) * (s_all + buckets) / ((s + 1.0) * (t_all + buckets))
    return np.array([math.floor(1000 * math.log(ratio(s, t))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def noise(doc_id: int | None, seed: int = SEED) -> int:
    """Scaled Gumbel noise of an id."""
    own = "" if doc_id is None else doc_id
    h = int(hashlib.sha256(f"{seed}:{own}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def score(docs: DataFrame, gain: np.ndarray, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight and score of every document."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(gain)

    def run(batch: pa.RecordBatch):
        held = shared.value
        counts, crcs, there = runs(*_flat(batch.column("text")))
        each = np.zeros(len(crcs[0]), np.int64)
        for crc, some in zip(crcs, there, strict=True):
            each += np.where(some, held[crc % np.uint32(len(held))], 0)
        limits = np.r_[0, np.cumsum(counts)]
        weight = np.diff(np.r_[0, np.cumsum(each)][limits])
        features = sum(np.maximum(counts - k, 0) for k in range(LONGEST))
        ids = batch.column("doc_id").to_pylist()
        total = weight + np.array([noise(i, seed) for i in ids], np.int64)
        columns = [pa.array(c, pa.int64()) for c in (ids, counts, features, weight, total)]
        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", "n_features", "weight", "score"])

    rows = common.texts(docs).withColumn("doc_id", F.col("doc_id").cast("long"))
    return common.map_arrow(rows, run, "doc_id bigint, n_words bigint, n_features bigint, weight bigint, score bigint")


Key = tuple[int, int]


def _halves(low: Key | None, high: Key | None, pivot: Key | None):
    """For each partition: number and median of the keys between the limits that lie below, at and above the pivot."""

    def run(batches):
        held = [np.zeros((2, 0), np.int64)]
        for batch in batches:
            a, b = (np.asarray(batch.column(c)) for c in ("a", "b"))
            keep = np.ones(len(a), bool)
            if low is not None:
                keep &= (a > low[0]) | ((a == low[0]) & (b > low[1]))
            if high is not None:
                keep &= (a < high[0]) | ((a == high[0]) & (b < high[1]))
            held.append(np.stack([a[keep], b[keep]]))
        a, b = np.concatenate(held, axis=1)
        side = np.full(len(a), 1) if pivot is None else np.where(a == pivot[0], np.sign(b - pivot[1]), np.where(a < pivot[0], -1, 1))
        rows = []
        for s in (-1, 0, 1):
            own = np.flatnonzero(side == s)
            if len(own):
                order = own[np.lexsort((b[own], a[own]))]
                middle = order[(len(own) - 1) // 2]
                rows.append((s, len(own), int(a[middle]), int(b[middle])))
        columns = list(zip(*rows, strict=True)) or [()] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["side", "n", "a", "b"])

    return run


def kth_key(keys: DataFrame, k: int, few: int = FEW) -> Key:
    """The k-th smallest (a, b) of a stored table of keys, by weighted medians of the partitions' medians."""
    low: Key | None = None
    high: Key | None = None
    pivot: Key | None = None
    held, wanted = None, k
    common.ship(keys.sparkSession)
    while True:
        found = keys.mapInArrow(_halves(low, high, pivot), "side bigint, n bigint, a bigint, b bigint").collect()
        number = {s: sum(r["n"] for r in found if r["side"] == s) for s in (-1, 0, 1)}
        if pivot is None or wanted > number[-1] + number[0]:
            wanted -= number[-1] + number[0]
            low, side = pivot, 1
        elif wanted > number[-1]:
            return pivot
        else:
            high, side = pivot, -1
        left = number[side]
        held = left if held is None else held
        if 4 * left < held or left <= few:
            keys, held = common.stored(_between(keys, low, high), "resampling"), left
        if left <= few:
            rows = sorted((r["a"], r["b"]) for r in keys.collect())
            return rows[wanted - 1]
        medians = sorted(((r["a"], r["b"]), r["n"]) for r in found if r["side"] == side)
        seen = 0
        for key, n in medians:
            seen += n
            if 2 * seen >= left:
                pivot = key
                break


def _between(keys: DataFrame, low: Key | None, high: Key | None) -> DataFrame:
    if low is not None:
        keys = keys.filter((F.col("a") > low[0]) | ((F.col("a") == low[0]) & (F.col("b") > low[1])))
    if high is not None:
        keys = keys.filter((F.col("a") < high[0]) | ((F.col("a") == high[0]) & (F.col("b") < high[1])))
    return keys


def ranked(rows: DataFrame, by: list[str]) -> DataFrame:
    """Rows with their place (``rank``) in the order of ``by``: sorted by ranges, numbered within and across them."""
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)

    def number(batches):
        part, at = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            columns = [*batch.columns, pa.array(np.full(n, part), pa.int32()), pa.array(np.arange(at + 1, at + n + 1), pa.int64())]
            at += n
            yield pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_part", "_place"])

    dealt = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = common.stored(dealt.mapInArrow(number, f"{kinds}, _part int, _place bigint"), "resampling")
    parts = placed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    first = parts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(first), "_part").select(*rows.columns, (F.col("_before") + F.col("_place")).alias("rank"))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, seed: int = SEED, buckets: int = BUCKETS) -> DataFrame:
    """Every document with doc_id, n_features, weight, score and rank: its place among those drawn, else NULL."""
    texts = common.texts(docs)
    goal = target.select(F.coalesce("text", F.lit("")).alias("text"))
    gain = gains(bucket_counts(texts, buckets), bucket_counts(goal, buckets))
    scored = common.stored(score(docs, gain, seed), "resampling")
    fit = scored.filter(F.col("n_words") >= least_words)
    wanted = percent * fit.count() // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if not wanted:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    keyed = scored.withColumns({"a": -F.col("score"), "b": F.coalesce("doc_id", F.lit(LAST))})
    keys = common.stored(keyed.filter(F.col("n_words") >= least_words).select("a", "b"), "resampling")
    a, b = kth_key(keys, wanted)
    wins = (F.col("n_words") >= least_words) & ((F.col("a") < a) | ((F.col("a") == a) & (F.col("b") <= b)))
    winners = ranked(keyed.filter(wins).select(*columns, "a", "b"), ["a", "b", "n_features"])
    drawn = winners.select(*columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))  # rows that share the cutoff key
    return drawn.unionByName(keyed.filter(~wins).select(*columns, F.lit(None).cast("long").alias("rank")))
