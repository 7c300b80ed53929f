"""Season files, reports, snapshots, history: what is written and how it is read back."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SEASON_SCHEMA = """match_id BIGINT, match_date STRING, home_team STRING, away_team STRING, fthg INT, ftag INT, ftr STRING,
hs INT, as_ INT, hst INT, ast INT, hc INT, ac INT, hy INT, ay INT, hr INT, ar INT, b1_h DOUBLE, b1_d DOUBLE, b1_a DOUBLE"""


def write_seasons(df: DataFrame, path: str) -> None:
    """One folder per season, named ``file=<prefix>_<season>``, as CSV with a header."""
    named = df.withColumn("file", F.concat(F.lit("SP_"), "season"))
    named.drop("season").write.mode("overwrite").partitionBy("file").csv(path, header=True)


def season_of(path: Column) -> Column:
    """Season from the file stem, what follows its last underscore; a file in a season's folder has that of the folder."""
    own = F.regexp_extract(path, r"_([^_/.]+)\.csv(?:\.gz)?$", 1)
    return F.when(own != "", own).otherwise(F.regexp_extract(path, r"_([^_/.]+)/[^/]*$", 1))


def headers(spark: SparkSession, *paths: str) -> dict[str, list[str]]:
    """Header line of each season file, without a byte order mark, and the files that have it: a row for each file."""
    lines = spark.read.text(list(paths), recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), "value",
        F.monotonically_increasing_id().alias("line"),
    )
    first = lines.filter("at = 0").groupBy("file").agg(F.min_by("value", "line").alias("header"))
    found: dict[str, list[str]] = {}
    for r in first.orderBy("file").collect():
        found.setdefault(r["header"].lstrip("﻿"), []).append(r["file"])
    return found


def scan_seasons(spark: SparkSession, *paths: str, schema: str = SEASON_SCHEMA) -> DataFrame:
    """Read season files that may differ in their columns and their order; absent columns become NULL.

    Files are read in groups of the same header, so each value lands in its own column. The schema is fixed and
    nothing is inferred; columns that it does not name are left out.
    """
    known = {f.split()[0]: f.strip() for f in schema.replace("\n", " ").split(",")}
    frames = []
    for header, names in headers(spark, *paths).items():
        columns = [c.strip().strip('"') for c in header.split(",")]
        read = spark.read.schema(", ".join(known.get(c, f"`{c}` STRING") for c in columns))
        df = read.csv(names, header=True, encoding="UTF-8").withColumn("season", season_of(F.col("_metadata.file_path")))
        frames.append(df.select("season", *[c for c in columns if c in known]))
    if not frames:
        raise ValueError("no season file found")
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return trimmed(out)


TEAMS = {"HomeTeam", "AwayTeam", "home_team", "away_team", "team", "opponent"}
"""Fixed values: columns that hold team names."""


def canonical(df: DataFrame, columns: Mapping[str, str]) -> DataFrame:
    """Project to the canonical list; absent columns are typed NULLs.

    Team names lose their outer blanks here, where matches enter, so that every operator behind sees one spelling.
    """
    def column(name: str, kind: str) -> Column:
        value = (F.col(name) if name in df.columns else F.lit(None)).cast(kind)
        return (F.trim(value) if name in TEAMS and kind == "string" else value).alias(name)

    return df.select(*[column(c, t) for c, t in columns.items()])


def trimmed(matches: DataFrame) -> DataFrame:
    """Matches from elsewhere with team names trimmed as ``canonical`` does; a side that meets itself stays a row."""
    return matches.withColumns({c: F.trim(c) for c in matches.columns if c in TEAMS})


def roundtrip_parquet(df: DataFrame, path: str, *partitions: str) -> DataFrame:
    df.write.mode("overwrite").partitionBy(*partitions).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


def roundtrip_json(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").json(path, compression="gzip")
    return df.sparkSession.read.schema(df.schema).json(path)


def write_snapshots(df: DataFrame, path: str, day: Column) -> None:
    """One partition per day; a restore reads only the partitions it needs."""
    df.withColumn("snapshot_day", day).write.mode("overwrite").partitionBy("snapshot_day").parquet(path, compression="gzip")


def read_snapshots(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).withColumn("snapshot_day", F.col("snapshot_day").cast("date"))


def restore_latest(snapshots: DataFrame) -> DataFrame:
    last = snapshots.agg(F.max("snapshot_day")).scalar()
    return snapshots.filter(F.col("snapshot_day") == last)


def restore_nearest(snapshots: DataFrame, wanted: str) -> DataFrame:
    """Snapshot closest in time to the wanted day, the earlier one on a tie."""
    gap = F.abs(F.datediff("snapshot_day", F.lit(wanted).cast("date")))
    near = snapshots.agg(F.min_by("snapshot_day", F.struct(gap, "snapshot_day"))).scalar()
    return snapshots.filter(F.col("snapshot_day") == near)


def retain(snapshots: DataFrame, as_of: str, days: int) -> DataFrame:
    return snapshots.filter(F.col("snapshot_day") >= F.date_sub(F.lit(as_of).cast("date"), days))


def append_new(existing: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Union; a key that is already there keeps its existing row."""
    return existing.unionByName(new.join(existing.select(key), key, "left_anti").dropDuplicates([key]))


def with_fallback(primary: DataFrame, backup: DataFrame, key: str) -> DataFrame:
    """Row of the primary source, else of the backup, per key."""
    extra = backup.join(primary.select(key), key, "left_anti")
    return primary.withColumn("source", F.lit("primary")).unionByName(extra.withColumn("source", F.lit("backup")))


def stat_cell(html: Column, row_text: str, stat: str) -> Column:
    """Number in the cell tagged ``data-stat`` of the first table row that names ``row_text``; 0 by default."""
    rows = F.filter(F.regexp_extract_all(html, F.lit(r"(?s)(<tr.*?</tr>)"), F.lit(1)), lambda t: t.contains(row_text))
    cell = F.regexp_extract(F.get(rows, F.lit(0)), rf'data-stat="{stat}"[^>]*>\s*(\d+)', 1)
    return F.coalesce(cell.try_cast("int"), F.lit(0))


def list_links(pages: DataFrame) -> DataFrame:
    """Links inside list items, one row each: target and text."""
    pattern = F.lit(r'<li><a href="([^"]*)">([^<]*)</a>')
    targets = F.regexp_extract_all("html", pattern, F.lit(1))
    texts = F.regexp_extract_all("html", pattern, F.lit(2))
    links = pages.select("page_id", F.posexplode(F.arrays_zip(targets.alias("href"), texts.alias("label"))).alias("pos", "l"))
    return links.select("page_id", "pos", "l.href", "l.label")
