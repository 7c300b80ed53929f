"""WARC derivatives: metadata and plain-text conversion records of web responses.

``responses`` turns pages into response records (header, HTTP header block, payload); ``derive`` makes two records of
each: a metadata record (title, language, links, status and type told by the HTTP headers, size, digest of the source)
and a conversion record (the text). Both refer to the response by its record id, keep its target URI, date and digest
in their headers and carry a digest of their own block. Record ids are UUIDs made from the MD5 of the kind, page id and
URL, so a second run gives the same ids. Everything is DataFrame expressions; a record is one row and nothing is shuffled.

Text has every named reference of HTML that ends in a semicolon and every numeric one decoded, once: what a
reference stands for is not read again. ``&nbsp;`` becomes a blank, numbers that name no character U+FFFD, those
from 128 to 159 what Windows-1252 has there, as browsers do; an unknown name stays.

NULL html is an empty payload, NULL url an empty target, NULL page_id an empty part of the record id's source. Repeated
pages give repeated records. Pages without date or HTTP headers (no column named, or NULL in it) have ``DATE`` and
``HTTP``; other columns are not looked at. Markup that is never closed is text up to its end; a script or style that is
never closed stays as text.
"""

from __future__ import annotations

import json
from html.entities import html5

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DATE = "2024-01-01T00:00:00Z"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

#: What text extraction takes away or replaces, in this order.
CUTS = [
    (r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "),
    (r"(?s)<!--.*?-->", " "),
    (r"(?i)</?(p|div|br|h[1-6]|li|ul|ol|tr|table|article|nav|title|head|body|html)([ /][^>]*)?>", "\n"),
    (r"<[^>]*>", ""),
]
REFERENCE = "&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]+);"
FREQUENT = ["amp;", "nbsp;", "quot;", "lt;", "gt;", "copy;", "middot;", "apos;"]
SPACES = [(r"[ \t\r\f]+", " "), (r" ?\n[ \n]*", "\n"), (r"^[ \n]+", ""), (r"[ \n]+$", "")]


def entities() -> dict[str, str]:
    """Named references and what they stand for, the frequent ones first: a map is searched from its start."""
    names = [*FREQUENT, *sorted(n for n in html5 if n.endswith(";") and n not in FREQUENT)]
    return {n: " " if n == "nbsp;" else html5[n] for n in names}


def windows_1252() -> dict[int, str]:
    """What numbers from 128 to 159 stand for."""
    return {k: bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(128, 160)}


def character(number: Column) -> Column:
    """The character of a code point; U+FFFD where there is none."""
    wrong = number.isNull() | (number == 0) | number.between(0xD800, 0xDFFF) | (number > 0x10FFFF)
    old = F.array(*[F.lit(c) for c in windows_1252().values()])
    plain = F.decode(F.unhex(F.lpad(F.hex(F.when(wrong, 0xFFFD).otherwise(number)), 8, "0")), "UTF-32")
    return F.when(number.between(128, 159), F.get(old, number.cast("int") - 128)).otherwise(plain)


def decoded(text: Column) -> Column:
    """Text with its character references replaced, in one pass."""
    known = F.from_json(F.lit(json.dumps(entities())), "map<string,string>")

    def one(reference: Column) -> Column:
        inner = F.substring(reference, 2, 1 << 30)
        digits = F.ltrim(F.regexp_extract(reference, "[0-9a-fA-F]+(?=;)", 0), F.lit("0"))
        padded = F.concat(F.lit("0"), digits)
        number = F.when(inner.rlike("^#[xX]"), F.conv(padded, 16, 10)).otherwise(F.conv(padded, 10, 10)).cast("long")
        whole = F.when(F.length(digits) < 8, number)
        return F.when(inner.startswith("#"), character(F.coalesce(whole, F.lit(-1 + (1 << 31))))).otherwise(F.coalesce(F.try_element_at(known, inner), reference))

    def joined(parts: Column) -> Column:
        news = F.transform(parts["found"], one)
        return F.array_join(F.zip_with(parts["gaps"], news, lambda g, n: F.concat(g, F.coalesce(n, F.lit("")))), "")

    parts = F.struct(F.split(text, REFERENCE, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(REFERENCE), F.lit(0)).alias("found"))
    return F.transform(F.array(parts), joined)[0]


def plain_text(html: Column) -> Column:
    """Text of a page, one line for each block of it."""
    out = html
    for pattern, new in CUTS:
        out = F.regexp_replace(out, pattern, new)
    out = decoded(out)
    for pattern, new in SPACES:
        out = F.regexp_replace(out, pattern, new)
    return out


def record_id(*parts: Column | str) -> Column:
    h = F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]).cast("binary"))
    cut = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cut), F.lit(">"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def _header(fields: list[tuple[str, Column]]) -> Column:
    lines = [x for name, value in fields for x in (F.lit(f"{name}: "), value, F.lit("\r\n"))]
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, F.lit("\r\n"))


def responses(pages: DataFrame, date: str | None = None, http: str | None = None) -> DataFrame:
    """page_id, record_id, target_uri, date, http, payload, its digest, and header and block of every page's response.

    ``date`` and ``http`` name the columns that hold a page's date (as WARC writes it) and its HTTP header block.
    """
    url, html = F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))
    own = lambda column, default: F.lit(default) if column is None else F.coalesce(F.col(column).cast("string"), F.lit(default))
    rows = pages.select(
        "page_id", record_id("response", F.coalesce(F.col("page_id").cast("string"), F.lit("")), url).alias("record_id"), url.alias("target_uri"),
        own(date, DATE).alias("date"), own(http, HTTP).alias("http"), html.alias("payload"), digest(html).alias("payload_digest"),
    )
    block = F.concat("http", "payload")
    fields = [
        ("WARC-Type", F.lit("response")), ("WARC-Record-ID", F.col("record_id")), ("WARC-Target-URI", F.col("target_uri")), ("WARC-Date", F.col("date")),
        ("WARC-Payload-Digest", F.col("payload_digest")), ("WARC-Block-Digest", digest(block)),
        ("Content-Type", F.lit("application/http; msgtype=response")), ("Content-Length", F.octet_length(block).cast("string")),
    ]
    return rows.withColumns({"header": _header(fields), "block": block})


def derive(source: DataFrame) -> DataFrame:
    """Two rows for each response: page_id, record_type, record_id, refers_to, target_uri, header and block."""
    html = F.col("payload")
    title = F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)
    lang = F.regexp_extract(html, r'(?i)<html[^>]* lang="([^"]*)"', 1)
    links = F.size(F.regexp_extract_all(html, F.lit(r'(?i)<a href="([^"]*)"'), F.lit(1)))
    status = F.regexp_extract("http", r"^HTTP/[0-9.]+ ([0-9]{3})", 1)
    kind = F.regexp_extract("http", r"(?i)\r?\ncontent-type: *([^\r\n]*)", 1)
    told = F.concat(
        F.lit("title: "), title, F.lit("\r\nlang: "), lang, F.lit("\r\nlinks: "), links.cast("string"),
        F.lit("\r\nsource-status: "), status, F.lit("\r\nsource-content-type: "), kind,
        F.lit("\r\nsource-length: "), F.octet_length(html).cast("string"), F.lit("\r\nsource-digest: "), F.col("payload_digest"), F.lit("\r\n"),
    )
    kinds = F.array(
        F.struct(F.lit("metadata").alias("kind"), F.lit("application/warc-fields").alias("mime"), told.alias("block")),
        F.struct(F.lit("conversion").alias("kind"), F.lit("text/plain; charset=utf-8").alias("mime"), plain_text(html).alias("block")),
    )
    rows = source.select("page_id", F.col("record_id").alias("refers_to"), "target_uri", "date", "payload_digest", F.inline(kinds))
    own = record_id(F.col("kind"), F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.col("target_uri"))
    fields = [
        ("WARC-Type", F.col("kind")), ("WARC-Record-ID", own), ("WARC-Refers-To", F.col("refers_to")), ("WARC-Target-URI", F.col("target_uri")),
        ("WARC-Date", F.col("date")), ("WARC-Refers-To-Payload-Digest", F.col("payload_digest")), ("WARC-Block-Digest", digest(F.col("block"))),
        ("Content-Type", F.col("mime")), ("Content-Length", F.octet_length("block").cast("string")),
    ]
    return rows.select("page_id", F.col("kind").alias("record_type"), own.alias("record_id"), "refers_to", "target_uri", _header(fields).alias("header"), "block")


def record(header: Column | str = "header", block: Column | str = "block") -> Column:
    """A record as it stands in a file."""
    return F.concat(header, block, F.lit("\r\n\r\n"))


def report(pages: DataFrame) -> DataFrame:
    """The derived records with the digests of their blocks and of the whole record."""
    return derive(responses(pages)).select(
        "page_id", "record_type", "record_id", "refers_to", "target_uri", F.octet_length("block").cast("long").alias("length"),
        F.sha2("block", 256).alias("block_sha256"), F.sha2(record(), 256).alias("record_sha256"),
    )


def _quoted(text: str) -> str:
    out = text.replace("'", "''")
    for char, code in (("\r", 13), ("\n", 10)):
        out = out.replace(char, f"' || chr({code}) || '")
    return f"'{out}'"


def report_sql() -> str:
    """The same report in plain SQL."""
    text = "html"
    for pattern, new in CUTS:
        text = f"regexp_replace({text}, {_quoted(pattern)}, {_quoted(new)}, 'g')"
    known = ", ".join(f"{_quoted(n)}: {_quoted(v)}" for n, v in entities().items())
    old = ", ".join(f"{k}: {_quoted(v)}" for k, v in windows_1252().items())
    digits = "ltrim(regexp_extract(e, '[0-9a-fA-F]+;'), '0')"
    number = f"""CASE WHEN len({digits}) > 8 THEN 2147483647 WHEN e[3] IN ('x', 'X') THEN CAST('0x0' || replace({digits}, ';', '') AS BIGINT)
      ELSE CAST('0' || replace({digits}, ';', '') AS BIGINT) END"""
    char = f"list_transform([{number}], lambda n: CASE WHEN n = 0 OR n BETWEEN 55296 AND 57343 OR n > 1114111 THEN chr(65533) WHEN n BETWEEN 128 AND 159 THEN MAP {{{old}}}[n] ELSE chr(CAST(n AS INT)) END)[1]"
    new = f"CASE WHEN e[2] = '#' THEN {char} ELSE coalesce(MAP {{{known}}}[e[2:]], e) END"
    news = f"list_transform(regexp_extract_all(cut, {_quoted(REFERENCE)}), lambda e: {new})"
    gaps = f"string_split_regex(cut, {_quoted(REFERENCE)})"
    plain = f"array_to_string(list_transform(list_zip({gaps}, {news}), lambda z: z[1] || coalesce(z[2], '')), '')"
    spaced = "plain"
    for pattern, new in SPACES:
        spaced = f"regexp_replace({spaced}, {_quoted(pattern)}, {_quoted(new)}, 'g')"

    def uuid(kind: str) -> str:
        h = f"md5({kind} || '|' || coalesce(CAST(page_id AS VARCHAR), '') || '|' || url)"
        cut = " || '-' || ".join(f"substr({h}, {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
        return f"'<urn:uuid:' || {cut} || '>'"

    told = (
        "'title: ' || regexp_extract(html, '(?is)<title>(.*?)</title>', 1) || E'\\r\\nlang: ' || regexp_extract(html, '(?i)<html[^>]* lang=\"([^\"]*)\"', 1)"
        " || E'\\r\\nlinks: ' || len(regexp_extract_all(html, '(?i)<a href=\"([^\"]*)\"', 1)) || E'\\r\\nsource-status: 200\\r\\nsource-content-type: text/html; charset=utf-8'"
        " || E'\\r\\nsource-length: ' || strlen(html)"
        " || E'\\r\\nsource-digest: sha256:' || sha256(html) || E'\\r\\n'"
    )
    fields = [
        ("WARC-Type", "record_type"), ("WARC-Record-ID", "record_id"), ("WARC-Refers-To", "refers_to"), ("WARC-Target-URI", "url"),
        ("WARC-Date", f"'{DATE}'"), ("WARC-Refers-To-Payload-Digest", "'sha256:' || sha256(html)"), ("WARC-Block-Digest", "'sha256:' || sha256(block)"),
        ("Content-Type", "mime"), ("Content-Length", "strlen(block)"),
    ]
    header = "E'WARC/1.1\\r\\n' || " + " || ".join(f"'{n}: ' || {v} || E'\\r\\n'" for n, v in fields) + " || E'\\r\\n'"
    return f"""WITH p AS (SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages),
t AS (SELECT *, {plain} AS plain FROM (SELECT *, {text} AS cut FROM p)),
k AS (SELECT page_id, url, html, 'metadata' AS record_type, 'application/warc-fields' AS mime, {told} AS block FROM p
 UNION ALL SELECT page_id, url, html, 'conversion' AS record_type, 'text/plain; charset=utf-8' AS mime, {spaced} AS block FROM t),
r AS (SELECT *, {uuid('record_type')} AS record_id, {uuid("'response'")} AS refers_to FROM k)
SELECT page_id, record_type, record_id, refers_to, url AS target_uri, strlen(block) AS length, sha256(block) AS block_sha256,
 sha256({header} || block || E'\\r\\n\\r\\n') AS record_sha256 FROM r"""
