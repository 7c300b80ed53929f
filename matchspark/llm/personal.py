"""Personal data, in DataFrame expressions only: patterns propose, checksums confirm, words nearby adjust the score.

For each kind a pattern proposes spans, leftmost and without overlap. A proposal that fails its validator is dropped, and
what it covered is not tried again. Validators: numbers of at most 255 (``ip``), Luhn (``card``), a number of digits
(``phone``), mod-97 (``iban``), number ranges that are given out (``ssn``). Each span has a score: what its kind is worth
after validation, and ``BONUS`` more where a context word of the kind stands within ``BEFORE`` code points before or
``AFTER`` behind it, up to the neighbouring proposals of that kind. Spans of the base kinds are all reported; those of the
``ADDED`` kinds only with a score of ``ENOUGH`` or more, so that a social security number needs a context word.

Places are found without a search for each span: cutting a text at a pattern gives what lies between the proposals, and the
lengths of both lists add up to the starts. They are added in blocks, so a text full of spans costs little more than its
length. Patterns are possessive where that changes no match, and begin only where a run of their characters
does, so a word of a million letters is read once and no repeat is followed by recursion.

Spans are in code points, end exclusive. NULL and empty texts have none. Every row of the input gives one row; rows that
repeat an id and NULL ids stay as they are, other columns are not looked at, an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds in the order of reports, those added to the base kinds, and their patterns.
BASE = ["email", "ip", "card", "phone"]
ADDED = ["iban", "ssn"]
KINDS = [*BASE, *ADDED]
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9_])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)(?![A-Za-z0-9_])",
    "ssn": r"(?<![A-Za-z0-9_])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9_])",
}
#: A text without this has no span of the kind.
NEEDS = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
#: Score of a confirmed span, and words that raise it.
WORTH = {"email": 0.7, "ip": 0.5, "card": 0.6, "phone": 0.5, "iban": 0.8, "ssn": 0.3}
CONTEXT = {
    "email": "e-?mail|mail|contact|write",
    "ip": "ip|host|server|address",
    "card": "card|visa|mastercard|amex|credit|debit|payment",
    "phone": "phone|tel|telephone|mobile|call|fax",
    "iban": "iban|account|bank|transfer",
    "ssn": "ssn|social security|taxpayer",
}
BONUS = 0.3
ENOUGH = 0.5
BEFORE, AFTER = 40, 20
BLOCK = 128
SPAN = "struct<start:int,order:int,end:int,value:string,score:double>"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once for each row, also where lambdas use it many times."""
    return F.transform(F.array(value), body)[0]


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether 14 to 19 digits, apart from blanks and hyphens, have a Luhn sum that ends in 0."""
    padded = F.lpad(_digits(value), 20, "0")
    doubled = F.translate(padded, "0123456789", "0246813579")
    digit = lambda text, k: F.substring(text, k, 1).cast("int")
    total = sum((digit(doubled, k) + digit(padded, k + 1) for k in range(1, 20, 2)), F.lit(0))
    return F.length(_digits(value)).between(14, 19) & (total % 10 == 0)


def mod_97(value: Column) -> Column:
    """Whether an account number of 15 to 34 characters leaves 1 when divided by 97."""
    plain = F.replace(value, F.lit(" "), F.lit(""))
    moved = F.split(F.concat(F.substring(plain, 5, 34), F.substring(plain, 1, 4)), "")
    number = lambda c: F.instr(F.lit("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"), c) - 1
    left = F.aggregate(moved, F.lit(0), lambda a, c: (a * F.when(number(c) > 9, 100).otherwise(10) + number(c)) % 97)
    return F.length(plain).between(15, 34) & (left == 1)


def bytes_at_most_255(value: Column) -> Column:
    """Whether all numbers between dots are 255 or less; leading zeros don't count."""
    short = F.transform(F.split(value, r"\."), lambda p: F.ltrim(p, F.lit("0")))
    return F.forall(short, lambda p: (F.length(p) < 3) | ((F.length(p) == 3) & (p <= "255")))


def given_out(value: Column) -> Column:
    """Whether a social security number lies in the ranges that are given out."""
    area = F.substring(value, 1, 3)
    return ~area.isin("000", "666") & (area < "900") & (F.substring(value, 5, 2) != "00") & (F.substring(value, 8, 4) != "0000")


VALID: dict[str, Callable[[Column], Column]] = {
    "email": lambda v: F.lit(True),
    "ip": bytes_at_most_255,
    "card": luhn,
    "phone": lambda v: F.length(_digits(v)).between(10, 15),
    "iban": mod_97,
    "ssn": given_out,
}


def _placed(matches: Column, gaps: Column, make: Callable[[Column, Column, Column, Column], Column], kind: str) -> Column:
    """``make(value, start, gap before, gap after)`` of every match: its start is what lies before it, added up.

    Sums run within blocks of ``BLOCK`` matches; a block starts from the sum of the lists before it.
    """
    long_of = lambda items: F.aggregate(items, F.lit(0), lambda a, s: a + F.length(s))

    def block(first: Column) -> Column:
        before = long_of(F.slice(gaps, 1, first)) + long_of(F.slice(matches, 1, first))

        def add(state: Column, k: Column) -> Column:
            start = state["at"] + F.length(F.get(gaps, k))
            made = make(F.get(matches, k), start, F.get(gaps, k), F.get(gaps, k + 1))
            return F.struct((start + F.length(F.get(matches, k))).alias("at"), F.concat(state["made"], F.array(made)).alias("made"))

        none = F.array().cast(f"array<{kind}>")
        places = F.sequence(first, F.least(first + BLOCK, F.size(matches)) - 1)
        return F.aggregate(places, F.struct(before.alias("at"), none.alias("made")), add, lambda state: state["made"])

    return F.flatten(F.transform(F.sequence(F.lit(0), F.size(matches) - 1, F.lit(BLOCK)), block))


def spans_of(kind: str, text: str = "text") -> Column:
    """Confirmed spans of one kind, by start."""
    pattern, valid, none = PATTERNS[kind], VALID[kind], F.array().cast(f"array<{SPAN}>")
    words = rf"(?i)(?<![A-Za-z])({CONTEXT[kind]})(?![A-Za-z])"

    def make(value: Column, start: Column, before: Column, after: Column) -> Column:
        beside = F.concat(F.substring(before, -BEFORE, BEFORE), F.lit("\n"), F.substring(after, 1, AFTER))
        score = F.lit(WORTH[kind]) + F.when(beside.rlike(words), F.lit(BONUS)).otherwise(F.lit(0.0))
        fields = {"start": start, "order": F.lit(KINDS.index(kind)), "end": start + F.length(value), "value": value, "score": F.round(score, 2)}
        return F.struct(*[v.alias(k) for k, v in fields.items()]).cast(SPAN)

    def located(both: Column) -> Column:
        return F.filter(_placed(both["m"], both["g"], make, SPAN), lambda s: valid(s["value"]))

    def confirmed(matches: Column) -> Column:
        both = F.struct(matches.alias("m"), F.split(text, pattern, -1).alias("g"))
        return F.when(F.exists(matches, valid), _let(both, located)).otherwise(none)

    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if kind in NEEDS:
        found = F.when(F.contains(F.col(text), F.lit(NEEDS[kind])), found).otherwise(F.array().cast("array<string>"))
    spans = _let(found, confirmed)
    return spans if kind in BASE else F.filter(spans, lambda s: s["score"] >= ENOUGH)


def find(docs: DataFrame, kinds: list[str] | None = None) -> DataFrame:
    """doc_id and ``spans`` of every whole text: start, order (place of the kind in ``KINDS``), end, value, score."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    spans = F.concat(*[spans_of(k) for k in (KINDS if kinds is None else kinds)])
    return rows.select("doc_id", F.array_sort(spans).alias("spans"))


def _listed(spans: Column) -> Column:
    name = F.array(*[F.lit(k) for k in KINDS])
    one = lambda s: F.concat_ws(":", F.get(name, s["order"]), s["start"].cast("string"), s["end"].cast("string"))
    return F.array_join(F.transform(spans, one), ",")


def digests(found: DataFrame) -> DataFrame:
    """Counts of all kinds, the digest of the base spans, all spans as text, and their scores in the same order."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["order"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["order"] < len(BASE))
    scores = F.array_join(F.transform("spans", lambda s: F.format_number(s["score"], 2)), ",")
    return found.select(
        "doc_id", *[count(k) for k in BASE], F.sha2(_listed(base), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"),
        *[count(k) for k in ADDED], scores.alias("scores"),
    )


#: The same patterns without what SQL's expressions lack; a word boundary is that of ASCII there.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?:\x20[A-Z0-9]{4}){2,7}(?:\x20[A-Z0-9]{1,3})?)\b",
    "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
}


def report_sql() -> str:
    """The same report in DuckDB SQL: starts from the pieces between matches, checksums by folds over digits."""
    digits = "regexp_replace(v, '[^0-9]', '', 'g')"
    twice = f"CAST(substr({digits}, -j, 1) AS INT) * (2 - j % 2)"
    luhn_sum = f"list_sum(list_transform(range(1, len({digits}) + 1), lambda j: {twice} - 9 * CAST({twice} > 9 AS INT)))"
    plain = "replace(v, ' ', '')"
    code = f"list_transform(string_split(substr({plain}, 5) || substr({plain}, 1, 4), ''), lambda c: instr('0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ', c) - 1)"
    left = f"list_reduce(list_prepend(0, {code}), lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97)"
    big = "list_filter(string_split(v, '.'), lambda p: len(ltrim(p, '0')) > 3 OR (len(ltrim(p, '0')) = 3 AND ltrim(p, '0') > '255'))"
    valid = {
        "email": "TRUE", "ip": f"len({big}) = 0", "card": f"len({digits}) BETWEEN 14 AND 19 AND {luhn_sum} % 10 = 0",
        "phone": f"len({digits}) BETWEEN 10 AND 15", "iban": f"len({plain}) BETWEEN 15 AND 34 AND {left} = 1",
        "ssn": "v[:3] NOT IN ('000', '666') AND v[:3] < '900' AND v[5:6] <> '00' AND v[8:11] <> '0000'",
    }
    found = []
    for order, kind in enumerate(KINDS):
        rx = "'" + PLAIN[kind] + "'"
        words = f"regexp_matches(right(g[i], {BEFORE}) || chr(10) || left(g[i + 1], {AFTER}), '(?i)(?:^|[^A-Za-z])(?:{CONTEXT[kind]})(?:$|[^A-Za-z])')"
        sized = "list_sum(list_transform(g[:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[:i - 1], lambda x: len(x))), 0)"
        found.append(f"""SELECT rid, {order} AS ord, '{kind}' AS kind, v, CAST({sized} AS BIGINT) AS start,
          {WORTH[kind]} + CASE WHEN {words} THEN {BONUS} ELSE 0.0 END AS score FROM (SELECT rid, m, g, i, m[i] AS v FROM (
          SELECT rid, m, g, unnest(range(1, len(m) + 1)) AS i FROM (SELECT rid, regexp_extract_all(t, {rx}) AS m, string_split_regex(t, {rx}) AS g FROM d))) WHERE {valid[kind]}""")
    base, kept = len(BASE), f"ord < {len(BASE)} OR score >= {ENOUGH}"
    span, by = "kind || ':' || start || ':' || (start + len(v))", "',' ORDER BY start, ord"
    counts = {k: f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in KINDS}
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS (SELECT * FROM ({' UNION ALL '.join(found)}) WHERE {kept}),
a AS (SELECT rid, {', '.join(counts.values())}, string_agg({span}, {by}) FILTER (WHERE ord < {base}) AS base, string_agg({span}, {by}) AS spans,
  string_agg(printf('%.2f', CAST(score AS DOUBLE)), {by}) AS scores FROM s GROUP BY rid)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in KINDS)}, sha256(coalesce(base, '')) AS base_sha256,
 coalesce(spans, '') AS spans, coalesce(scores, '') AS scores FROM d LEFT JOIN a USING (rid)"""
