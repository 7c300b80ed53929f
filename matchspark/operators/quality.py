"""Data quality: missing values, gate, duplicates, imputation, scores, source manifest."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchspark.functions.clean import missing_columns
from matchspark.operators.team_view import team_view
from matchspark.plans.quantiles import exact_quantiles

FIXTURE = ["match_date", "home_team", "away_team"]


def is_missing(df: DataFrame, column: str) -> Column:
    """NULL, or NaN where the column can hold one."""
    if dict(df.dtypes)[column] in ("double", "float"):
        return F.col(column).isNull() | F.isnan(column)
    return F.col(column).isNull()


def nan_to_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: F.when(~is_missing(df, c), F.col(c)) for c in columns})


def null_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Missing values of all columns in one pass, one row per column."""
    counted = df.agg(*[F.count_if(is_missing(df, c)).alias(c) for c in columns])
    return counted.select(F.inline(F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(c).alias("missing")) for c in columns
    ])))


def duplicate_counts(df: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Fixtures that occur more than once: groups, rows after the first, all member rows."""
    groups = df.groupBy(*keys, *FIXTURE).agg(F.count("*").alias("n")).filter("n > 1")
    return groups.groupBy(*keys).agg(
        F.count("*").alias("duplicate_groups"),
        F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("rows_after_first"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("member_rows"),
    )


def quality_gate(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """One row: counts, list of issues, and whether the frame may be used.

    Missing values are only counted when there are rows and no column is missing.
    """
    lost = missing_columns(df, list(features))
    present = [c for c in features if c not in lost]
    checks = df.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("home_team") == F.col("away_team")).alias("self_matches"),
        *[F.count_if(is_missing(df, c)).alias(f"_n_{c}") for c in present],
    )
    nulls = F.lit(0).cast("bigint")
    if not lost:
        for c in present:
            nulls = nulls + F.col(f"_n_{c}")
    duplicates = duplicate_counts(df).select("duplicate_groups").scalar()
    counted = checks.select(
        "rows", "self_matches", nulls.alias("null_features"),
        F.coalesce(duplicates, F.lit(0)).alias("duplicate_fixtures"), F.lit(len(lost)).alias("missing_columns"),
    )
    issues = F.array_compact(F.array(
        F.when(F.col("missing_columns") > 0, "missing columns"),
        F.when(F.col("rows") == 0, "no rows"),
        F.when(F.col("rows") % 2 != 0, "odd row count"),
        F.when(F.col("null_features") > 0, "null features"),
        F.when(F.col("self_matches") > 0, "self matches"),
        F.when(F.col("duplicate_fixtures") > 0, "duplicate fixtures"),
    ))
    return counted.withColumn("is_valid", F.size(issues) == 0).withColumn("issues", F.array_join(issues, "; "))


def median_fills(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    """Lower median per column as a scalar subquery; 0.0 where a column has no value."""
    clean = nan_to_null(df, columns)
    out = {}
    for c in columns:
        found = exact_quantiles(clean.select(c), [], c, {"m": 0.5}, interpolate=False)
        out[c] = F.coalesce(found.select("m").scalar(), F.lit(0.0))
    return out


def impute(df: DataFrame, fills: Mapping[str, Column]) -> DataFrame:
    clean = nan_to_null(df, list(fills))
    return clean.withColumns({c: F.coalesce(F.col(c).cast("double"), f) for c, f in fills.items()})


def mean_fills(df: DataFrame, columns: Sequence[str]) -> dict[str, Column]:
    means = nan_to_null(df, columns).agg(*[F.avg(c).alias(c) for c in columns])
    return {c: means.select(c).scalar() for c in columns}


def impute_report(df: DataFrame, fills: Mapping[str, Column]) -> DataFrame:
    """Imputed cells and fill value per column."""
    return null_counts(df, list(fills)).withColumn(
        "fill_value", F.coalesce(*[F.when(F.col("column_name") == c, f) for c, f in fills.items()])
    )


def source_manifest(df: DataFrame, required: Sequence[str], odds: Sequence[str], closing: Sequence[str]) -> DataFrame:
    """Per season: rows, date range, duplicates, valid results, odds columns, closing-odds coverage."""
    lost = sorted(missing_columns(df, list(required)))
    have = [c for c in odds if c in df.columns]
    covered = F.lit(False)
    if all(c in df.columns for c in closing):
        covered = F.lit(True)
        for c in closing:
            covered = covered & F.col(c).isNotNull()
    per_fixture = df.groupBy("season", *FIXTURE).agg(
        F.count("*").alias("n"),
        F.count_if(F.col("ftr").isin("H", "D", "A")).alias("results"),
        F.count_if(covered).alias("covered"),
    )
    return per_fixture.groupBy("season").agg(
        F.sum("n").alias("rows"), F.min("match_date").alias("date_min"), F.max("match_date").alias("date_max"),
        F.lit(",".join(lost)).alias("missing_required"), F.sum(F.col("n") - 1).alias("duplicate_rows"),
        F.sum("results").alias("result_rows"), F.lit(len(have)).alias("odds_columns"),
        (F.sum("covered") / F.sum("n")).alias("closing_coverage"),
    )


def dq_scores(df: DataFrame, required: Sequence[str], non_negative: Sequence[str], as_of: str,
              keys: Sequence[str] = ("league",), wrong_types: int = 0) -> DataFrame:
    """Completeness, consistency, timeliness, validity and their weighted total per key; without keys one row."""
    if not keys:
        whole = df.withColumn("league", F.lit("all"))
        return dq_scores(whole, required, non_negative, as_of, ("league",), wrong_types).drop("league")
    keys = list(keys)
    lost = missing_columns(df, list(required))
    present = [c for c in required if c not in lost]
    today = F.lit(as_of).cast("date")
    missing = sum([F.count_if(is_missing(df, c)) for c in present], F.lit(0).cast("bigint"))
    base = df.groupBy(*keys).agg(
        F.count("*").alias("rows"), missing.alias("missing"),
        F.count_if(F.col("home_team") == F.col("away_team")).alias("self_matches"),
        F.count_if(F.col("match_date") > F.date_add(today, 7)).alias("future"),
        F.count_if(F.col("match_date") < F.date_sub(today, 730)).alias("old"),
        F.count_if(F.col("match_date").isNull()).alias("undated"),
        sum([F.when(F.min(c) < 0, 1).otherwise(0) for c in non_negative], F.lit(0)).alias("negative_columns"),
    )
    dup = duplicate_counts(df, keys).select(*keys, "duplicate_groups")
    # a side that meets itself plays once as host and once as guest
    busy = (
        team_view(df, stats=[]).groupBy(*keys, "team", "match_date").agg(F.count("*").alias("n")).filter("n > 1")
        .groupBy(*keys).agg(F.count("*").alias("busy_days"))
    )
    joined = base.join(dup, keys, "left").join(busy, keys, "left").fillna(0)
    cells = F.col("rows") * len(required)
    scored = joined.select(
        *keys, "rows", "self_matches", "duplicate_groups", "busy_days",
        (1 - (F.col("missing") + F.col("rows") * len(lost)) / cells).alias("completeness"),
        F.greatest(F.lit(0.0), 1.0 - F.when(F.col("duplicate_groups") > 0, 0.3).otherwise(0.0)
                   - F.when(F.col("self_matches") > 0, 0.3).otherwise(0.0) - F.col("busy_days") * 0.2).alias("consistency"),
        F.greatest(F.lit(0.0), 1.0 - F.when(F.col("future") > 0, 0.3).otherwise(0.0)
                   - F.when(F.col("old") > 0, 0.3).otherwise(0.0)
                   - F.when(F.col("undated") > 0, 0.4).otherwise(0.0)).alias("timeliness"),
        F.greatest(F.lit(0.0), F.lit(1.0 - (0.4 if lost else 0.0) - 0.2 * wrong_types)
                   - F.col("negative_columns") * 0.1).alias("validity"),
    )
    overall = F.expr("completeness * 0.3 + consistency * 0.3 + timeliness * 0.2 + validity * 0.2")
    return scored.withColumn("overall", overall).withColumn("passes", (overall >= 0.8) & (F.col("rows") >= 3))
