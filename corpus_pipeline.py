"""The corpus pipeline: from documents to packed sequences, stage by stage.

Each stage works on all rows of the one before; all but the last return the columns of documents. ``run`` writes each
stage to the shared folder and reads it back. Words are compared, scored and packed over whole texts; a clean document
leaves only as a copy of another: of equal texts the largest id stays, of near ones the smallest.

Copies are decided row by row. Rows that repeat an id with different texts are different documents; of rows that repeat
id and text one stays. Among equal texts a NULL id stays only where none has an id; among near copies NULL ids, and all but
one text of a repeated id, count as larger than the other ids.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchspark.llm import common, exact, near, packing, secrets, toxicity

SIMILARITY = 85
SHA = "_text_sha256"


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below .5; the model learns from the labels of the training part."""
    return toxicity.without_toxic(docs, toxicity.fit(docs, common.table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts."""
    kept = exact.exact_duplicates(docs, keep="largest").filter("kept").select("doc_id", "text_sha256")
    kept = common.stored(kept.groupBy("doc_id", "text_sha256").agg(F.count(F.lit(1)).alias("n")))
    rows = _hashed(docs)
    once = _semi(rows, kept)
    several = kept.filter("n > 1")
    if not several.isEmpty():
        repeated = _semi(rows, several).dropDuplicates(["doc_id", SHA])
        once = _semi(rows, kept.filter("n = 1")).unionByName(repeated)
    return once.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near copies."""
    rows = _hashed(docs)
    ids = rows.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.min(SHA).alias("first"))
    ids = common.stored(ids)
    shared = ids.filter("n > 1")
    others = rows.filter("doc_id IS NULL").select("doc_id", SHA).unionByName(
        common.join_groups(rows.select("doc_id", SHA), shared, "doc_id", "n").filter(F.col(SHA) != F.col("first")).select("doc_id", SHA)
    )
    if others.isEmpty() and shared.isEmpty():
        kept = near.near_duplicates(docs, SIMILARITY).filter("kept").select("doc_id")
        return docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    top = ids.agg(F.coalesce(F.max("doc_id"), F.lit(-1)).cast("long")).first()[0]
    others = others.distinct().select(F.col("doc_id").alias("_id"), F.col(SHA).alias("_hash"), (F.lit(top + 1) + F.monotonically_increasing_id()).alias("_new"))
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(SHA) == F.col("_hash"))
    single = rows.dropDuplicates(["doc_id", SHA]).join(common.stored(others), same, "left")
    single = common.stored(single.withColumn("_row", F.coalesce("_new", "doc_id")).drop("_id", "_hash", "_new"))
    found = near.near_duplicates(single.select(F.col("_row").alias("doc_id"), "text"), SIMILARITY)
    return single.join(found.filter("kept").select(F.col("doc_id").alias("_row")), "_row", "left_semi").select(*docs.columns)


def _hashed(docs: DataFrame) -> DataFrame:
    return docs.withColumn(SHA, F.sha2(F.coalesce("text", F.lit("")), 256))


def _semi(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows whose id and text are among those kept; a NULL id is equal to NULL."""
    kept = kept.select(F.col("doc_id").alias("_id"), F.col("text_sha256").alias("_hash"))
    return rows.join(kept, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(SHA) == F.col("_hash")), "left_semi")


def hide_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The same documents, each secret replaced by a mark; n_chars follows the text."""
    return secrets.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents with their sequences."""
    return packing.pack(packing.pieces(docs, common.vocabulary("byte_bpe_50k.json")))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact_dedup", drop_copies),
    ("near_dedup", drop_near_copies),
    ("secrets", hide_secrets),
    ("packing", pack_sequences),
]

#: The stages can't be told in SQL; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.stored(stage(spark, docs, sf_dir), "pipeline", name)
    return docs
