"""Sizes of nodes: one row for each member, alone or among many."""

from pyspark.sql import functions as F

from matchspark.llm import common, near


def test_a_large_node_does_not_multiply_rows(spark):
    """As many rows over 4,000 lone members as over one node of 4,000, and the size of each node."""
    alone = spark.range(4000).select(F.col("id").alias("node"), "id")
    one = spark.range(4000).select(F.lit(7).cast("long").alias("node"), "id")
    some = spark.range(3, 3003).select((F.col("id") - F.col("id") % 3).alias("node"), "id")
    for rows, size in ((alone, None), (one, 4000), (some, 3)):
        found = near.with_sizes(common.stored(rows, "test", "members"))
        got = {r.id: (r.node, r.n) for r in found.collect()}
        assert found.count() == rows.count() == len(got)
        assert got == {r.id: (r.node, size) for r in rows.collect()}
