"""Token counts of sections: whole documents are encoded once, tokens are attributed by their spans.

Sections are the lines of a text, each with its line feed; sections and tokens cover the text without gaps, so the
interval join is a search of token spans in sorted section ends. A token that crosses a boundary counts for the
section that holds most of its bytes, the earlier one on ties; the counts of a document's sections add up to its
tokens. Spans are told in code points; a token that begins inside a character is placed by its bytes.

NULL and empty texts have one empty section without tokens. Repeated rows are counted each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from matchspark.llm import common
from matchspark.llm.merging import ByteCoder


def attribute(token_ends: np.ndarray, section_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Section of each token, and whether it crosses a boundary; both lists of ends are in bytes and ascend."""
    starts = np.r_[0, token_ends][:-1]
    first = np.searchsorted(section_ends, starts, side="right")
    last = np.searchsorted(section_ends, token_ends, side="left")
    crossing = last > first
    for k in np.flatnonzero(crossing).tolist():
        among = np.arange(first[k], last[k] + 1)
        begins = np.where(among > 0, section_ends[among - 1], 0)
        first[k] += np.argmax(np.minimum(section_ends[among], token_ends[k]) - np.maximum(begins, starts[k]))
    return first, crossing


def section_tokens(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """doc_id, section, start, end, n_tokens and n_crossing (tokens given to it that cross a boundary) of every line."""
    spec = docs.sparkSession.sparkContext.broadcast(common.read_file(tokenizer_path, text=True))

    def run(batch: pa.RecordBatch):
        if batch.num_rows:
            encoder = common.coder(ByteCoder, spec.value)
            texts = batch.column("text").to_pylist()
            flat, counts = encoder.encode(texts)
            edges = np.r_[0, np.cumsum(counts)].tolist()
            rows: list[list] = [[] for _ in range(6)]
            for k, (text, a, b) in enumerate(zip(texts, edges[:-1], edges[1:], strict=True)):
                data = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
                ends = np.flatnonzero(data == 10) + 1
                if not len(ends) or ends[-1] < len(data):
                    ends = np.r_[ends, len(data)]
                n = len(ends)
                token, crossing = attribute(np.cumsum(encoder.width[flat[a:b]]), ends)
                chars = np.r_[0, np.cumsum((data & 0xC0) != 0x80)][ends]
                of_section = [np.full(n, k), np.arange(n), np.r_[0, chars[:-1]], chars, np.bincount(token, minlength=n), np.bincount(token[crossing], minlength=n)]
                for out, new in zip(rows, of_section, strict=True):
                    out.append(new)
            source, *numbers = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in rows]
            columns = [batch.column("doc_id").take(pa.array(source)), *[pa.array(x.astype(np.int64)) for x in numbers]]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, section bigint, start bigint, end bigint, n_tokens bigint, n_crossing bigint"
    return common.map_arrow(common.texts(docs), run, schema)
