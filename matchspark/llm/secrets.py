"""Secrets: keyword prefilter, anchored patterns near the hits, checksums.

An Aho-Corasick automaton finds the keywords of all kinds in one pass over the text folded to ASCII lower case; a
pattern is tried only at a hit, with the place of the keyword as its anchor. Long runs of hexadecimal digits have no
keyword and are found by their own scan. Kinds with an embedded checksum (``github``, ``npm``: the last six
characters are the CRC-32 of the others in base 62) count only if it holds.

Spans are (kind, start, end) in code points, end exclusive; matches of a kind don't overlap, the leftmost counts.
NULL and empty texts have no span. Letters match in either case only where said, and only ASCII letters do.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.llm import common

#: Kinds, in the order of reports, and their patterns.
KINDS = ["assign", "access", "hex", "github", "npm"]
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
GITHUB = re.compile(r"gh[pousr]_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
NPM = re.compile(r"npm_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
KEYWORDS = {
    "password": "assign", "passwd": "assign", "secret": "assign", "token": "assign", "apikey": "assign", "api_key": "assign",
    "akia": "access", "ghp_": "github", "gho_": "github", "ghu_": "github", "ghs_": "github", "ghr_": "github", "npm_": "npm",
}
DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_FOLD = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


@lru_cache(maxsize=1)
def _automaton():
    import ahocorasick

    machine = ahocorasick.Automaton()
    for word, kind in KEYWORDS.items():
        machine.add_word(word, (kind, len(word)))
    machine.make_automaton()
    return machine


def checksum_holds(body: str, check: str) -> bool:
    """Whether six base-62 digits are the CRC-32 of the body."""
    value = zlib.crc32(body.encode())
    out = ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        out = DIGITS[digit] + out
    return out == check


def find(text: str) -> Iterator[tuple[str, int, int]]:
    """Spans of one text, by start, then kind."""
    found = []
    free = dict.fromkeys(KINDS, 0)
    low = text.lower() if text.isascii() else text.translate(_FOLD)
    for last, (kind, size) in _automaton().iter(low):
        start = last + 1 - size
        if start < free[kind]:
            continue
        if kind == "assign":
            m = ASSIGN.match(text, start)
            if m:
                free[kind] = m.end()
                good = len(m[2]) >= 12
        elif kind == "access":
            m = ACCESS.match(text, start)
            if m:
                free[kind] = m.end()
                good = m.end() - start >= 18
        else:
            m = (GITHUB if kind == "github" else NPM).match(text, start)
            good = bool(m) and checksum_holds(m[1], m[2])
            if good:
                free[kind] = m.end()
        if m and good:
            found.append((start, KINDS.index(kind), m.end()))
    found += [(m.start(), KINDS.index("hex"), m.end()) for m in HEX.finditer(text)]
    for start, kind, end in sorted(found):
        yield KINDS[kind], start, end


SPANS = "array<struct<kind:string,start:int,end:int>>"


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans of every whole text."""

    def run(batch: pa.RecordBatch):
        out = [[{"kind": k, "start": s, "end": e} for k, s, e in find(t)] for t in batch.column("text").to_pylist()]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, kind)], ["doc_id", "spans"])

    return common.map_arrow(common.texts(docs), run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, spans {SPANS}")


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digests(scanned: DataFrame) -> DataFrame:
    """Counts of the three base kinds, the digest of their spans, and all spans as text."""
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    base = F.filter("spans", lambda s: s["kind"].isin(KINDS[:3]))
    return scanned.select(
        "doc_id", *[of(k).alias(f"n_{k}") for k in KINDS[:3]], F.sha2(_listed(base), 256).alias("base_sha256"),
        _listed(F.col("spans")).alias("spans"), *[of(k).alias(f"n_{k}") for k in KINDS[3:]],
    )


def redact(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """The same rows and columns; each span, overlapping ones together, gives way to ``mark``; n_chars follows the text."""
    common.ship(docs.sparkSession)
    names = docs.columns
    place = names.index("text")

    def run(batch: pa.RecordBatch):
        values = batch.column(place).to_pylist()
        new = [clean(t, mark) if t else t for t in values]
        columns = batch.columns
        columns[place] = pa.array(new, pa.string())
        if "n_chars" in names:
            at = names.index("n_chars")
            kept = columns[at].to_pylist()
            counts = [k if a == b else len(b) for k, a, b in zip(kept, values, new, strict=True)]
            columns[at] = pa.array(counts, columns[at].type)
        yield pa.RecordBatch.from_arrays(columns, names)

    return docs.mapInArrow(lambda batches: (b for batch in batches for b in run(batch)), docs.schema)


def clean(text: str, mark: str) -> str:
    parts, at = [], 0
    for _, start, end in find(text):
        if start >= at:
            parts += [text[at:start], mark]
        at = max(at, end)
    return "".join([*parts, text[at:]])
