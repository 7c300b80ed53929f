"""Small helpers that several operators share."""

from __future__ import annotations

import os
import shutil
import tempfile
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from uuid import uuid4

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.session import scratch_dir

HOT_GROUPS = 1000
"""Groups that ``join_groups`` treats as hot: a bound on what it broadcasts."""


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package to the executors once, so that only the driver needs it installed."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        at = os.path.join(tempfile.mkdtemp(prefix="matchspark-code-"), "matchspark_llm")
        made = shutil.make_archive(at, "zip", os.path.dirname(root), os.path.basename(root))
        spark.sparkContext.addPyFile(made)
        _SHIPPED.add(app)


def texts(docs: DataFrame) -> DataFrame:
    """Id and text alone, so that other columns and their names don't matter; NULL text is empty."""
    ship(docs.sparkSession)
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def stored(df: DataFrame, *parts: str) -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage and survives lost executors."""
    path = scratch_dir(df.sparkSession, "llm", *parts, uuid4().hex)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def join_groups(rows: DataFrame, groups: DataFrame, key: str, size: Column | str, how: str = "inner") -> DataFrame:
    """Join rows with a table that has one row for each key, however many rows a key has.

    The ``HOT_GROUPS`` largest groups are broadcast (a fixed number of rows), so their rows stay where
    they are; no other key can hold more than a thousandth of the rows, and those are shuffled and merged at
    every size, so that a plan that holds for small tables does not give way to another for large ones. ``groups``
    should be stored, as it is read twice; columns of both sides must differ but for the key.
    """
    size = F.col(size) if isinstance(size, str) else size
    hot = groups.filter(size > 1).orderBy(size.desc(), key).limit(HOT_GROUPS)
    flagged = hot.select(key, F.struct(*[c for c in groups.columns if c != key]).alias("_hot"))
    marked = rows.join(F.broadcast(flagged), key, "left")
    others = [c for c in groups.columns if c != key]
    near = marked.filter("_hot IS NOT NULL").select(*rows.columns, *[F.col(f"_hot.{c}").alias(c) for c in others])
    far = marked.filter("_hot IS NULL").drop("_hot").join(groups.hint("merge"), key, how).select(*rows.columns, *others)
    return near.unionByName(far)


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], Iterable[pa.RecordBatch]], schema: str, column: str = "text") -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in by_bytes(batch, column):
                yield from fn(part)

    return df.mapInArrow(run, schema)


def by_bytes(batch: pa.RecordBatch, column: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices with about a million bytes of text each, so that what a task holds does not follow the batch size."""
    import numpy as np

    values = batch.column(column)
    width = pc.binary_length(values) if pa.types.is_string(values.type) else pc.multiply(pc.list_value_length(values), 4)
    sizes = np.cumsum(width.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = sizes[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(sizes, base + limit)))
        yield batch.slice(at, end - at)
        at = end


def list_array(flat, counts) -> pa.ListArray:
    import numpy as np

    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)], pa.int32()), pa.array(flat, pa.int32()))


@lru_cache(maxsize=6)
def coder(kind: type, model: bytes | str):
    """Encoder of a vocabulary or model, made once in each Python worker."""
    return kind(model)


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def read_file(path: str, text: bool = False) -> bytes | str:
    """A vocabulary on the driver; its content (a fixed few MB) travels to the tasks."""
    with open(path, "rb") as f:
        data = f.read()
    return data.decode("utf-8") if text else data
