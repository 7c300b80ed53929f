"""SentencePiece encoding and decoding by vectorised merge rounds (see ``merging``).

NULL and empty texts have no ids and decode to the empty text. Repeated rows are encoded each. A very long
word is cut where no piece can reach across, and its parts are merged in the same rounds. Strings that look
like control pieces are ordinary text. An empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchspark.llm import common
from matchspark.llm.merging import PieceCoder


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids (array<int>) of every whole text."""
    model = docs.sparkSession.sparkContext.broadcast(common.read_file(model_path))

    def run(batch: pa.RecordBatch):
        flat, counts = common.coder(PieceCoder, model.value).encode(batch.column("text").to_pylist())
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), common.list_array(flat, counts)], ["doc_id", "ids"])

    return common.map_arrow(common.texts(docs), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids and the text that the ids decode to; a NULL list decodes to the empty text."""
    model = encoded.sparkSession.sparkContext.broadcast(common.read_file(model_path))

    def run(batch: pa.RecordBatch):
        ids = batch.column("ids")
        flat = ids.flatten().to_numpy(zero_copy_only=False)
        counts = np.asarray(pc.list_value_length(ids).fill_null(0))
        edges = np.r_[0, np.cumsum(counts)].tolist()
        decoder = common.coder(PieceCoder, model.value)
        out = [decoder.decode(flat[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), ids, pa.array(out, pa.string())], ["doc_id", "ids", "decoded"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return common.map_arrow(encoded.select("doc_id", "ids"), run, f"doc_id {kind}, ids array<int>, decoded string", column="ids")


def digests(decoded: DataFrame) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded text."""
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
