"""Exact duplicates: groups by a 128-bit content hash, bytes compared inside the groups.

The hash is the first half of SHA-256. Groups are counted with partial sums, so copies shrink before the shuffle.
Texts of a group are compared by their least and greatest text, which partial aggregation also shrinks; a group
that holds two texts (a collision) is grouped again by the texts themselves. The largest groups are joined by
broadcast of a fixed number of rows (``join_groups``).

NULL text equals the empty text. Rows that repeat an id are counted each and reported each. NULL ids belong to
their group but are kept only where the whole group has none. An empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm import common


def _keyed(docs: DataFrame) -> DataFrame:
    sha = common.texts(docs).withColumn("text_sha256", F.sha2("text", 256))
    return sha.withColumn("_key", F.substring(F.unhex("text_sha256"), 1, 16))


def exact_duplicates(docs: DataFrame, keep: str = "smallest") -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; ``keep`` is "smallest" or "largest"."""
    best = {"smallest": F.min, "largest": F.max}[keep]
    rows = _keyed(docs)
    groups = common.stored(rows.groupBy("_key").agg(F.count(F.lit(1)).alias("group_size"), best("doc_id").alias("keep_id")))
    out = common.join_groups(rows.drop("text"), groups, "_key", "group_size")
    mixed = common.stored(collisions(rows, groups))
    if not mixed.isEmpty():
        apart = rows.join(mixed, "_key")
        exact = apart.groupBy("_key", "text").agg(F.count(F.lit(1)).alias("group_size"), best("doc_id").alias("keep_id"))
        out = out.join(mixed, "_key", "left_anti").unionByName(apart.join(exact, ["_key", "text"]).drop("text"))
    return out.select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def collisions(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Hashes of groups that hold different texts."""
    several = groups.filter("group_size > 1").select("_key", "group_size")
    members = common.join_groups(rows.select("_key", "text"), several, "_key", "group_size")
    ends = members.groupBy("_key").agg(F.min("text").alias("low"), F.max("text").alias("high"))
    return ends.filter("low <> high").select("_key")
