"""Temporal splits and top-k selections."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.operators import splits as S
from matchspark.queries.registry import query
from matchspark.queries.sql_parts import KEY, fx_sql
from matchspark.sources.fixtures import contests

NUM_CTE = f"""num AS (SELECT *, row_number() OVER (PARTITION BY league ORDER BY {KEY}) - 1 AS position,
  count(*) OVER (PARTITION BY league) AS size FROM m)"""


@query("temporal_split", fx_sql("SELECT match_id, league, position, position < floor(size * 0.4e0) AS is_train FROM num", NUM_CTE))
def temporal_split(spark, folder):
    return S.temporal_split(contests(spark, folder), 0.4).select("match_id", "league", "position", "is_train")


CUT_CTE = f"""cuts AS (SELECT league, season, n AS matches, match_date AS split_date FROM (SELECT *,
  row_number() OVER (PARTITION BY league, season ORDER BY {KEY}) - 1 AS i, count(*) OVER (PARTITION BY league, season) AS n
  FROM m) WHERE i = least(greatest(120, CAST(floor(n * 0.4e0) AS BIGINT)), n - 1))"""


@query("season_cut", fx_sql("SELECT * FROM cuts", CUT_CTE))
def season_cut(spark, folder):
    return S.season_cut(contests(spark, folder))


@query(
    "season_split",
    fx_sql(
        """SELECT match_id, season = '1998' AND match_date >= split_date AS is_test FROM m
        JOIN (SELECT league, split_date FROM cuts WHERE season = '1998') USING (league)""",
        CUT_CTE,
    ),
)
def season_split(spark, folder):
    df = contests(spark, folder)
    return S.split_by_date(df, S.season_cut(df), "1998").select("match_id", "is_test")


@query(
    "early_cut",
    fx_sql(
        """SELECT league, CAST(COALESCE(min(c), max(least(hi, n - 1))) AS BIGINT) AS train_rows,
        CAST(max(n) - COALESCE(min(c), max(least(hi, n - 1))) AS BIGINT) AS test_rows FROM (
        SELECT b.league, n, hi, CASE WHEN need = 3 THEN c END AS c FROM (
          SELECT league, n, lo, hi, unnest(range(lo, hi + 1)) AS c FROM (SELECT league, n, lo,
            greatest(lo + 1, CAST(floor(n * 0.45e0) AS BIGINT)) AS hi FROM (SELECT league, count(*) AS n,
            greatest(8, CAST(floor(count(*) * 0.35e0) AS BIGINT)) AS lo FROM m GROUP BY league))) b,
          LATERAL (SELECT count(DISTINCT ftr) AS need FROM num WHERE num.league = b.league AND num.position < b.c)
        ) GROUP BY league""",
        NUM_CTE,
    ),
)
def early_cut(spark, folder):
    return S.early_cut(contests(spark, folder))


@query(
    "inner_split",
    fx_sql(
        """SELECT match_id, CASE WHEN position < c80 THEN 'train' ELSE 'validation' END AS part_80,
        CASE WHEN position < c82 THEN 'train' ELSE 'validation' END AS part_82, c82 >= 60 AND size - c82 >= 20 AS usable_82
        FROM (SELECT *, greatest(1, floor(size * 0.8e0)) AS c80, CASE WHEN least(greatest(60, floor(size * 0.82e0)), size - 20) > 0
          THEN least(greatest(60, floor(size * 0.82e0)), size - 20) ELSE floor(size * 0.75e0) END AS c82 FROM num)""",
        NUM_CTE,
    ),
)
def inner_split(spark, folder):
    df = contests(spark, folder)
    first = S.inner_split(df, 0.80).withColumn("part_80", F.col("part"))
    both = S.inner_split(df, 0.82, 60, 20, rows=first.drop("part", "usable"))
    return both.select("match_id", "part_80", F.col("part").alias("part_82"), F.col("usable").alias("usable_82"))


@query(
    "ts_folds",
    fx_sql(
        """SELECT match_id, CAST(CASE WHEN position < size - (size // 6) * 5 THEN 0
        ELSE (position - (size - (size // 6) * 5)) // (size // 6) + 1 END AS INT) AS fold FROM num""",
        NUM_CTE,
    ),
)
def ts_folds(spark, folder):
    return S.ts_folds(contests(spark, folder)).select("match_id", "fold")


MIXED = "(((match_id % 2147483648) * 2654435761) % 4294967296 >> 16)"


@query("random_folds", fx_sql(f"SELECT match_id, CAST({MIXED} % 5 AS INT) AS fold, {MIXED} % 1000 < 800 AS is_train FROM m"))
def random_folds(spark, folder):
    """Shuffled five folds and a random split of 80 to 20."""
    rows = contests(spark, folder).select("match_id")
    return S.random_split(rows.withColumn("fold", S.key_fold(F.col("match_id"), 5)), "match_id", 0.8)
