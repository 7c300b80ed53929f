"""Column functions for raw text: numbers, dates, weekday names, scores, form strings."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WEEKDAYS = {"Lun": 1, "Mar": 2, "Mié": 3, "Mie": 3, "Jue": 4, "Vie": 5, "Sáb": 6, "Sab": 6, "Dom": 7}
"""Fixed values: weekday abbreviations with and without accents."""

FORM_POINTS = {"PG": 3, "PE": 1, "PP": 0}
"""Fixed values: won, drawn, lost."""

ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüçñýÁÀÂÄÃÅÉÈÊËÍÌÎÏÓÒÔÖÕÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyAAAAAAEEEEIIIIOOOOOUUUUCNY"
DIGRAPHS = {"ß": "ss", "œ": "oe", "æ": "ae", "Œ": "OE", "Æ": "AE"}


def lookup(values: dict, key: Column) -> Column:
    """Value of a literal map, NULL for an unknown key."""
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(values.items())])[key]


def to_double(text: Column) -> Column:
    """Number from text with an optional percent sign and decimal comma; NULL when unreadable."""
    return F.translate(text, ",%", ".").try_cast("double")


def parse_date(text: Column) -> Column:
    """``dd/MM/yyyy``, then ``dd/MM/yy`` with 69-99 meaning 19xx; anything else NULL."""
    long = F.try_to_timestamp(text, F.lit("dd/MM/yyyy")).cast("date")
    short = F.try_to_timestamp(text, F.lit("dd/MM/yy")).cast("date")
    return F.coalesce(long, F.when(F.year(short) >= 2069, F.add_months(short, -1200)).otherwise(short))


def first_number(text: Column) -> Column:
    """First whole number that stands alone in the text."""
    return F.regexp_extract(text, r"\b(\d+)\b", 1).try_cast("double")


def form_points(text: Column) -> Column:
    """Sum of points in a string of results such as ``PG PE PP``; NULL counts as 0."""
    won = F.size(F.filter(F.split(text, " "), lambda t: t == "PG"))
    drawn = F.size(F.filter(F.split(text, " "), lambda t: t == "PE"))
    return F.when(text.isNull(), 0).otherwise(won * FORM_POINTS["PG"] + drawn * FORM_POINTS["PE"])


def score_part(text: Column, part: int) -> Column:
    return F.regexp_extract(text, r"(\d+).*?(\d+)", part).try_cast("int")


def ascii_fold(text: Column) -> Column:
    """Plain letters for accented ones; what is still not ASCII is dropped."""
    for source, target in DIGRAPHS.items():
        text = F.replace(text, F.lit(source), F.lit(target))
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"[^\x00-\x7F]", "")


def safe_ratio(a: Column, b: Column) -> Column:
    """a / b with a zero denominator read as 1."""
    return a / F.when(b == 0, 1).otherwise(b)


def flatten_names(levels: list[tuple[str, ...]]) -> list[str]:
    """Last named part of each header, made unique as ``c``, ``c_1``, ..."""
    out: list[str] = []
    taken: dict[str, int] = {}
    for level in levels:
        named = [p.strip() for p in level if p and not p.strip().startswith("Unnamed")]
        name = named[-1] if named else level[-1].strip()
        again = taken.get(name, 0)
        taken[name] = again + 1
        out.append(name if not again else f"{name}_{again}")
    return out


def missing_columns(df: DataFrame, required: list[str]) -> list[str]:
    return [c for c in required if c not in df.columns]


def require_columns(df: DataFrame, required: list[str], name: str) -> DataFrame:
    missing = missing_columns(df, required)
    if missing:
        raise ValueError(f"{name} lacks columns: {', '.join(missing)}")
    return df


def for_round(df: DataFrame, number: int, column: str = "matchday") -> DataFrame:
    """Rows of one round; rounds run from 1 to 38."""
    if not 1 <= int(number) <= 38:
        raise ValueError("round must be between 1 and 38")
    return df.filter(F.col(column) == int(number))
