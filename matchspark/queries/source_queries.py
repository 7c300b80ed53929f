"""Sources and sinks: each writes to a fresh folder of the shared scratch and reads back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from matchspark.queries.registry import query
from matchspark.queries.scalar_queries import EXC_CTE, match_exceptions
from matchspark.queries.sql_parts import fx_sql
from matchspark.session import scratch_dir
from matchspark.sources import files
from matchspark.sources.fixtures import fixtures
from matchspark.sources.tables import events, table


def fresh(spark, name):
    return scratch_dir(spark, name, uuid.uuid4().hex)


BASE = ["match_id", "season", "match_date", "home_team", "away_team", "fthg", "ftag", "ftr", "hs"]
ODDS = ["b1_h", "b1_d", "b1_a"]


@query(
    "scan_seasons",
    fx_sql(
        f"""SELECT {', '.join(c if c != 'match_date' else 'CAST(match_date AS VARCHAR) AS match_date' for c in BASE)}, """
        + ", ".join(f"CASE WHEN season >= '1998' THEN {c} END AS {c}" for c in ODDS) + " FROM fx"
    ),
)
def scan_seasons(spark, folder):
    df, path = fixtures(spark, folder), fresh(spark, "seasons")
    files.write_seasons(df.filter("season < '1998'").select(*BASE), path + "/old")
    files.write_seasons(df.filter("season >= '1998'").select(*BASE, *ODDS), path + "/new")
    return files.scan_seasons(spark, path + "/old", path + "/new").select(*BASE, *ODDS)


CANON = {"match_id": "bigint", "season": "string", "hs": "int", "hf": "int", "af": "int", "b1_h": "double", "b9_h": "double"}


@query("canonical_schema", fx_sql("SELECT match_id, season, hs, CAST(NULL AS INT) AS hf, CAST(NULL AS INT) AS af, b1_h, CAST(NULL AS DOUBLE) AS b9_h FROM fx"))
def canonical_schema(spark, folder):
    return files.canonical(fixtures(spark, folder), CANON)


@query(
    "page_tag_extract",
    r"""SELECT page_id, CAST(i - 1 AS INT) AS pos, regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1)[i] AS href,
    regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 2)[i] AS label
    FROM (SELECT page_id, html, unnest(range(1, len(regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a>', 1)) + 1)) AS i FROM pages)""",
)
def page_tag_extract(spark, folder):
    return files.list_links(table(spark, folder, "pages"))


@query("sink_roundtrip", fx_sql("SELECT match_id, league, season, match_date, fthg, b1_h FROM fx"))
def sink_roundtrip(spark, folder):
    df = fixtures(spark, folder).select("match_id", "league", "season", "match_date", "fthg", "b1_h")
    return files.roundtrip_parquet(df, fresh(spark, "sink"), "season")


@query("exceptions_json_roundtrip", fx_sql("SELECT * FROM exc", EXC_CTE))
def exceptions_json_roundtrip(spark, folder):
    return files.roundtrip_json(match_exceptions(spark, folder), fresh(spark, "exceptions"))


def _snapshots(spark, folder):
    path = fresh(spark, "snapshots")
    files.write_snapshots(events(spark, folder).select("event_id", "ts", "target", "predicted"), path, F.to_date("ts"))
    return files.read_snapshots(spark, path).select("event_id", "target", "predicted", "snapshot_day")


SNAP = "SELECT event_id, event_type AS target, value AS predicted, CAST(ts AS DATE) AS snapshot_day FROM events"


@query("snapshot_restore_latest", f"SELECT * FROM ({SNAP}) WHERE snapshot_day = (SELECT max(CAST(ts AS DATE)) FROM events)")
def snapshot_restore_latest(spark, folder):
    return files.restore_latest(_snapshots(spark, folder))


@query(
    "snapshot_nearest",
    f"""SELECT * FROM ({SNAP}) WHERE snapshot_day = (SELECT CAST(ts AS DATE) FROM events
    ORDER BY abs(date_diff('day', CAST(ts AS DATE), DATE '2024-01-10')), 1 LIMIT 1)""",
)
def snapshot_nearest(spark, folder):
    return files.restore_nearest(_snapshots(spark, folder), "2024-01-10")


@query("snapshot_retention", f"SELECT * FROM ({SNAP}) WHERE snapshot_day >= DATE '2024-01-20' - INTERVAL 7 DAY")
def snapshot_retention(spark, folder):
    return files.retain(_snapshots(spark, folder), "2024-01-20", 7)


@query("append_matchday", fx_sql("SELECT match_id, season, fthg FROM fx"))
def append_matchday(spark, folder):
    df = fixtures(spark, folder).select("match_id", "season", "fthg")
    return files.append_new(df.filter("season < '2000'"), df.filter("season >= '1999'"), "match_id")


@query("source_fallback", fx_sql("SELECT match_id, fthg, CASE WHEN match_id % 5 = 0 THEN 'backup' ELSE 'primary' END AS source FROM fx"))
def source_fallback(spark, folder):
    df = fixtures(spark, folder).select("match_id", "fthg")
    return files.with_fallback(df.filter("match_id % 5 <> 0"), df, "match_id")
