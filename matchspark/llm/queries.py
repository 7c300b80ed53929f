"""The registered queries of this folder: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession

from matchspark.llm import (
    attribution, common, exact, fingerprints, id_files, near, packing, personal, pieces, resampling, secrets, toxicity, vector_codes, warc,
)
from matchspark.session import scratch_dir

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return add


@query("op1_sentencepiece")
def sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of every document and the text they decode to, as digests."""
    model = common.vocabulary("piece_bpe_32k.model")
    return pieces.digests(pieces.decode(pieces.encode(common.table(spark, folder, "documents"), model), model))


@query("op5_winnowing")
def winnowing(spark: SparkSession, folder: str) -> DataFrame:
    """Fingerprint of every document and of its edited text, and their likeness."""
    return fingerprints.compare_with_next(common.table(spark, folder, "documents"))


DEDUP_SQL = """SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
 sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""


@query("op7_exact_dedup", DEDUP_SQL)
def exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of equal texts; the largest id of each stays."""
    return exact.exact_duplicates(common.table(spark, folder, "documents"), keep="largest")


@query("op6_secrets")
def secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.digests(secrets.scan(common.table(spark, folder, "documents")))


@query("op4_toxicity")
def toxicity_scores(spark: SparkSession, folder: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels of the training part."""
    return toxicity.report(common.table(spark, folder, "documents"), common.table(spark, folder, "labels"))


@query("op9_packing")
def packing_plan(spark: SparkSession, folder: str) -> DataFrame:
    """All documents packed into sequences of 2048 tokens."""
    path = common.vocabulary("byte_bpe_50k.json")
    return packing.pack(packing.pieces(common.table(spark, folder, "documents"), path))


@query("op10_token_files")
def token_files(spark: SparkSession, folder: str) -> DataFrame:
    """Every document written as token-id files and read back."""
    path = scratch_dir(spark, "llm", "token-files", uuid4().hex)
    id_files.write(common.table(spark, folder, "documents"), path, common.vocabulary("word_bpe_49k.json"))
    return id_files.report(spark, path)


@query("op8_near_dedup")
def near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Components of documents that share 85 hundredths of their five-word shingles."""
    return near.near_duplicates(common.table(spark, folder, "documents"), 85)


@query("op2_warc_derivatives", warc.report_sql())
def warc_derivatives(spark: SparkSession, folder: str) -> DataFrame:
    """Metadata and conversion records of every page."""
    return warc.report(common.table(spark, folder, "pages"))


@query("op3_token_counts")
def token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of every line of every document."""
    return attribution.section_tokens(common.table(spark, folder, "documents"), common.vocabulary("byte_bpe_50k.json"))


@query("op11_pii", personal.report_sql())
def personal_data(spark: SparkSession, folder: str) -> DataFrame:
    """Personal data of every document."""
    return personal.digests(personal.find(common.table(spark, folder, "documents")))


@query("op12_vector_codes", vector_codes.report_sql())
def vector_code_table(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of every embedding after two rounds over the codebooks."""
    return vector_codes.report(common.table(spark, folder, "embeddings"))


@query("op13_resampling")
def importance_resampling(spark: SparkSession, folder: str) -> DataFrame:
    """Weight, score and draw of every document, with the benchmark as the target."""
    return resampling.resample(common.table(spark, folder, "documents"), common.table(spark, folder, "benchmark"))
