"""Cleaning, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from matchspark.functions import clean as C
from matchspark.operators import exceptions as X
from matchspark.operators import windows as W
from matchspark.operators.team_view import points, team_view
from matchspark.queries.registry import query, rounded
from matchspark.queries.sql_parts import KEY, fx_sql, r, tv_sql
from matchspark.sources.fixtures import contests, fixtures
from matchspark.sources.tables import events, table

REQUIRED = ["match_id", "match_date", "home_team", "away_team", "fthg", "ftag", "hs", "venue"]


@query(
    "schema_check",
    fx_sql(
        "SELECT 'venue' AS column_name, false AS present, CAST(0 AS BIGINT) AS filled UNION ALL "
        + " UNION ALL ".join(f"SELECT '{c}', true, count({c}) FROM fx" for c in REQUIRED[:-1])
    ),
)
def schema_check(spark, folder):
    df = fixtures(spark, folder)
    lost = C.missing_columns(df, REQUIRED)
    counts = df.agg(*[(F.lit(0).cast("bigint") if c in lost else F.count(c)).alias(c) for c in REQUIRED])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(c not in lost).alias("present"),
                     F.col(c).alias("filled")) for c in REQUIRED]
    return counts.select(F.inline(F.array(*rows)))


@query(
    "numeric_coerce",
    f"""SELECT l_orderkey, l_linenumber, {r("TRY_CAST(replace(replace(t, '%', ''), ',', '.') AS DOUBLE)")} AS number
    FROM (SELECT l_orderkey, l_linenumber, CASE l_linenumber % 4
      WHEN 0 THEN concat(CAST(l_partkey // 10 AS VARCHAR), ',', CAST(l_partkey % 10 AS VARCHAR))
      WHEN 1 THEN concat(CAST(l_suppkey AS VARCHAR), '%') WHEN 2 THEN concat('n/a ', l_returnflag)
      ELSE CAST(l_partkey AS VARCHAR) END AS t FROM lineitem)""",
)
def numeric_coerce(spark, folder):
    text = F.expr(
        """CASE l_linenumber % 4 WHEN 0 THEN concat(l_partkey div 10, ',', l_partkey % 10)
        WHEN 1 THEN concat(l_suppkey, '%') WHEN 2 THEN concat('n/a ', l_returnflag) ELSE string(l_partkey) END"""
    )
    return rounded(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", C.to_double(text).alias("number")))


@query(
    "parse_dates",
    """SELECT o_orderkey, CAST(CASE WHEN length(t) = 10 THEN try_strptime(t, '%d/%m/%Y') ELSE try_strptime(t, '%d/%m/%y') END AS DATE) AS parsed
    FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN strftime(o_orderdate, '%d/%m/%Y')
      WHEN 1 THEN strftime(o_orderdate, '%d/%m/%y') ELSE concat('tbd ', o_orderstatus) END AS t FROM orders)""",
)
def parse_dates(spark, folder):
    text = F.expr(
        """CASE o_orderkey % 3 WHEN 0 THEN date_format(o_orderdate, 'dd/MM/yyyy')
        WHEN 1 THEN date_format(o_orderdate, 'dd/MM/yy') ELSE concat('tbd ', o_orderstatus) END"""
    )
    return table(spark, folder, "orders").select("o_orderkey", C.parse_date(text).alias("parsed"))


@query(
    "weekday_map",
    fx_sql(
        """SELECT match_id, CASE WHEN match_id % 11 = 0 THEN NULL ELSE CAST(isodow(match_date) AS INT) END AS weekday
        FROM fx"""
    ),
)
def weekday_map(spark, folder):
    name = F.expr(
        """CASE WHEN match_id % 11 = 0 THEN 'XXX' WHEN match_id % 2 = 0
        THEN element_at(array('Lun', 'Mar', 'Mié', 'Jue', 'Vie', 'Sáb', 'Dom'), weekday(match_date) + 1)
        ELSE element_at(array('Lun', 'Mar', 'Mie', 'Jue', 'Vie', 'Sab', 'Dom'), weekday(match_date) + 1) END"""
    )
    return fixtures(spark, folder).select("match_id", C.lookup(C.WEEKDAYS, name).alias("weekday"))


@query(
    "matchday_filter",
    tv_sql(
        "SELECT * FROM (SELECT match_id, CAST(max(n) + 1 AS BIGINT) AS matchday FROM c GROUP BY match_id)"
        " WHERE matchday = 5",
        f"c AS (SELECT match_id, row_number() OVER (PARTITION BY league, season, team ORDER BY {KEY}) - 1 AS n FROM tv)",
    ),
)
def matchday_filter(spark, folder):
    return C.for_round(W.matchday(contests(spark, folder)), 5)


@query(
    "required_rows",
    fx_sql("SELECT match_id, ftr, hs, b1_h FROM fx WHERE hs IS NOT NULL AND b1_h IS NOT NULL AND ftr IN ('H', 'D', 'A')"),
)
def required_rows(spark, folder):
    df = fixtures(spark, folder).select("match_id", "ftr", "hs", "b1_h")
    return df.dropna(subset=["hs", "b1_h"]).filter(F.col("ftr").isin("H", "D", "A"))


@query(
    "result_points",
    fx_sql(
        """SELECT match_id, CASE WHEN fthg > ftag THEN 3 WHEN fthg = ftag THEN 2 ELSE 1 END AS result_code,
        CASE WHEN fthg > ftag THEN 3 WHEN fthg = ftag THEN 1 ELSE 0 END AS home_points,
        CASE WHEN fthg < ftag THEN 3 WHEN fthg = ftag THEN 1 ELSE 0 END AS away_points,
        CASE ftr WHEN 'H' THEN 'V' WHEN 'D' THEN 'E' ELSE 'D' END AS letter FROM fx"""
    ),
)
def result_points(spark, folder):
    hg, ag = F.col("fthg"), F.col("ftag")
    return fixtures(spark, folder).select(
        "match_id",
        F.when(hg > ag, 3).when(hg == ag, 2).otherwise(1).alias("result_code"),
        points(hg, ag).alias("home_points"),
        points(ag, hg).alias("away_points"),
        C.lookup({"H": "V", "D": "E", "A": "D"}, F.col("ftr")).alias("letter"),
    )


@query(
    "form_string_points",
    fx_sql(
        """SELECT match_id, CAST(CASE WHEN match_id % 10 = 0 THEN 0 ELSE
        CASE hc % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END + CASE ac % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END
        + CASE hy % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 0 END END AS INT) AS form_points FROM fx"""
    ),
)
def form_string_points(spark, folder):
    def token(c):
        return f"element_at(array('PG', 'PE', 'PP'), {c} % 3 + 1)"

    text = F.expr(f"CASE WHEN match_id % 10 <> 0 THEN concat_ws(' ', {token('hc')}, {token('ac')}, {token('hy')}) END")
    return fixtures(spark, folder).select("match_id", C.form_points(text).cast("int").alias("form_points"))


@query(
    "regex_first_int",
    r"""SELECT c_custkey, TRY_CAST(NULLIF(regexp_extract(c_name, '\b(\d+)\b', 1), '') AS DOUBLE) AS number,
    TRY_CAST(NULLIF(regexp_extract(concat(c_mktsegment, ' no_7'), '\b(\d+)\b', 1), '') AS DOUBLE) AS no_number
    FROM customer""",
)
def regex_first_int(spark, folder):
    return table(spark, folder, "customer").select(
        "c_custkey", C.first_number(F.col("c_name")).alias("number"),
        C.first_number(F.concat("c_mktsegment", F.lit(" no_7"))).alias("no_number"),
    )


@query("score_split", fx_sql("SELECT match_id, fthg AS home_goals, ftag AS away_goals FROM fx"))
def score_split(spark, folder):
    text = F.concat(F.col("fthg").cast("string"), F.lit("–"), F.col("ftag").cast("string"))
    return fixtures(spark, folder).select(
        "match_id", C.score_part(text, 1).alias("home_goals"), C.score_part(text, 2).alias("away_goals")
    )


def _fold_sql(text: str) -> str:
    for source, target in C.DIGRAPHS.items():
        text = f"replace({text}, '{source}', '{target}')"
    return f"regexp_replace(translate({text}, '{C.ACCENTED}', '{C.PLAIN}'), '[^\\x00-\\x7F]', '', 'g')"


@query("ascii_fold", f"SELECT doc_id, {_fold_sql('text')} AS folded FROM documents")
def ascii_fold(spark, folder):
    return table(spark, folder, "documents").select("doc_id", C.ascii_fold(F.col("text")).alias("folded"))


NUMERIC = ["fthg", "ftag", "hs", "hst", "hc", "hy", "b1_h", "ou_over"]


@query(
    "safe_features",
    fx_sql("SELECT match_id, " + ", ".join(f"CAST({c} AS DOUBLE) AS feature_{i:03d}" for i, c in enumerate(NUMERIC)) + " FROM fx"),
)
def safe_features(spark, folder):
    cols = [F.col(c).cast("double").alias(f"feature_{i:03d}") for i, c in enumerate(NUMERIC)]
    return fixtures(spark, folder).select("match_id", *cols)


@query(
    "label_decode",
    fx_sql(
        """SELECT match_id, CASE ftr WHEN 'D' THEN 0.0e0 WHEN 'A' THEN 1.0e0 ELSE 2.0e0 END AS label_index, ftr AS label,
        CASE ftr WHEN 'H' THEN 'Local' WHEN 'D' THEN 'Empate' ELSE 'Visitante' END AS words FROM fx"""
    ),
)
def label_decode(spark, folder):
    index = C.lookup({"D": 0.0, "A": 1.0, "H": 2.0}, F.col("ftr"))
    coded = fixtures(spark, folder).select("match_id", index.alias("label_index"))
    label = C.lookup({0.0: "D", 1.0: "A", 2.0: "H"}, F.col("label_index"))
    words = C.lookup({"H": "Local", "D": "Empate", "A": "Visitante"}, F.col("label"))
    return coded.withColumn("label", label).withColumn("words", words)


@query(
    "side_pick",
    tv_sql(
        """SELECT match_id, team, is_home, COALESCE(corners, 0) AS own_corners, corners_against AS other_corners,
        COALESCE(shots, 0) AS own_shots FROM tv"""
    ),
)
def side_pick(spark, folder):
    rows = contests(spark, folder).select(
        "match_id", "hc", "ac", "hs", "as_",
        F.explode(F.array(F.struct(F.lit(1).alias("is_home"), F.col("home_team").alias("team")),
                          F.struct(F.lit(0).alias("is_home"), F.col("away_team").alias("team")))).alias("s"),
    ).select("*", "s.*")

    def pick(own, other):
        return F.coalesce(F.when(F.col("is_home") == 1, F.col(own)).otherwise(F.col(other)), F.lit(0))

    return rows.select(
        "match_id", "team", "is_home", pick("hc", "ac").alias("own_corners"),
        pick("ac", "hc").alias("other_corners"), pick("hs", "as_").alias("own_shots"),
    )


@query(
    "safe_ratios",
    fx_sql(
        f"""SELECT match_id, {r("hst / CAST(CASE WHEN hs = 0 THEN 1 ELSE hs END AS DOUBLE)")} AS accuracy,
        {r("fthg / CAST(CASE WHEN hst = 0 THEN 1 ELSE hst END AS DOUBLE)")} AS conversion,
        {r("hc / CAST(CASE WHEN ac = 0 THEN 1 ELSE ac END AS DOUBLE)")} AS corner_ratio,
        {r("hy / CAST(greatest(ay, 1) AS DOUBLE)")} AS card_ratio FROM fx"""
    ),
)
def safe_ratios(spark, folder):
    c = F.col
    return rounded(fixtures(spark, folder).select(
        "match_id", C.safe_ratio(c("hst"), c("hs")).alias("accuracy"), C.safe_ratio(c("fthg"), c("hst")).alias("conversion"),
        C.safe_ratio(c("hc"), c("ac")).alias("corner_ratio"), (c("hy") / F.greatest(c("ay"), F.lit(1))).alias("card_ratio"),
    ))


@query(
    "match_key",
    fx_sql("SELECT match_id, concat_ws('_', CAST(match_date AS VARCHAR), home_team, away_team) AS match_key FROM fx"),
)
def match_key(spark, folder):
    return fixtures(spark, folder).select(
        "match_id", F.concat_ws("_", F.col("match_date").cast("string"), "home_team", "away_team").alias("match_key")
    )


@query(
    "calendar_flags",
    """SELECT event_id, CASE WHEN isodow(ts) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN hour(ts) >= 18 THEN 1 ELSE 0 END AS is_evening, strftime(ts, '%Y-%m') AS month, CAST(ts AS DATE) AS day
    FROM events""",
)
def calendar_flags(spark, folder):
    return events(spark, folder).select(
        "event_id",
        F.when(F.weekday("ts") >= 5, 1).otherwise(0).alias("is_weekend"),
        F.when(F.hour("ts") >= 18, 1).otherwise(0).alias("is_evening"),
        F.date_format("ts", "yyyy-MM").alias("month"),
        F.to_date("ts").alias("day"),
    )


@query("team_filter", fx_sql("SELECT match_id, home_team, away_team FROM fx WHERE home_team = 'NATION_3' OR away_team = 'NATION_3'"))
def team_filter(spark, folder):
    return X.of_team(fixtures(spark, folder), "NATION_3").select("match_id", "home_team", "away_team")


@query(
    "date_range_filter",
    fx_sql(
        """SELECT match_id, match_date, match_date > DATE '1998-08-01' - INTERVAL 30 DAY AS is_recent FROM fx
        WHERE match_date BETWEEN DATE '1998-01-01' AND DATE '1998-08-01'"""
    ),
)
def date_range_filter(spark, folder):
    as_of = F.lit("1998-08-01").cast("date")
    df = X.in_range(fixtures(spark, folder), "match_date", "1998-01-01", "1998-08-01")
    return df.select("match_id", "match_date", (F.col("match_date") > F.date_sub(as_of, 30)).alias("is_recent"))


@query(
    "zscore_outliers",
    """SELECT event_id, event_type AS target, value AS predicted FROM (SELECT *, avg(value) OVER w AS a,
    stddev_pop(value) OVER w AS s FROM events WINDOW w AS (PARTITION BY event_type)) WHERE abs((value - a) / s) > 3""",
)
def zscore_outliers(spark, folder):
    return X.outliers(events(spark, folder), ["target"], "predicted").select("event_id", "target", "predicted")


EXC_CTE = """dated AS (SELECT * REPLACE (CASE WHEN match_id % 50 = 0 THEN NULL ELSE match_date END AS match_date) FROM m),
exc AS (SELECT match_id, home_team, away_team, match_date AS original_date,
  CASE WHEN status = 'postponed' THEN 'postponed' ELSE 'scheduled' END AS status,
  CASE WHEN status = 'postponed' THEN 'postponed' ELSE 'no date' END AS reason FROM dated
  WHERE status = 'postponed' OR match_date IS NULL)"""


def _dated(spark, folder):
    date = F.when(F.col("match_id") % 50 != 0, F.col("match_date"))
    return contests(spark, folder).withColumn("match_date", date)


@query("match_exceptions", fx_sql("SELECT * FROM exc", EXC_CTE))
def match_exceptions(spark, folder):
    return X.split_exceptions(_dated(spark, folder))[1]


@query("good_matches", fx_sql("SELECT match_id FROM dated WHERE status <> 'postponed' AND match_date IS NOT NULL", EXC_CTE))
def good_matches(spark, folder):
    return X.split_exceptions(_dated(spark, folder))[0].select("match_id")


UPDATES_CTE = """upd AS (SELECT match_id, CASE WHEN match_id % 4 = 0 THEN CAST(original_date + INTERVAL 7 DAY AS DATE) END
  AS new_date, concat('moved ', reason) AS resolution FROM exc WHERE match_id % 2 = 0)"""


@query(
    "exceptions_resolve",
    fx_sql(
        """SELECT exc.match_id, exc.original_date, upd.new_date,
        CASE WHEN upd.new_date IS NOT NULL THEN 'scheduled' ELSE exc.status END AS status, upd.resolution
        FROM exc LEFT JOIN upd USING (match_id)""",
        EXC_CTE, UPDATES_CTE,
    ),
)
def exceptions_resolve(spark, folder):
    exc = match_exceptions(spark, folder)
    updates = exc.filter("match_id % 2 = 0").select(
        "match_id", F.when(F.col("match_id") % 4 == 0, F.date_add("original_date", 7)).alias("new_date"),
        F.concat(F.lit("moved "), "reason").alias("resolution"),
    )
    return X.resolve(exc, updates).select("match_id", "original_date", "new_date", "status", "resolution")


@query(
    "exceptions_unresolved",
    fx_sql("SELECT match_id, status FROM exc WHERE match_id NOT IN (SELECT match_id FROM upd)", EXC_CTE, UPDATES_CTE),
)
def exceptions_unresolved(spark, folder):
    return X.unresolved(exceptions_resolve(spark, folder)).select("match_id", "status")


RULES_SQL = {
    "corners_range": "hc NOT BETWEEN 0 AND 9",
    "cards_range": "hy NOT BETWEEN 0 AND 4",
    "goals_not_negative": "fthg < 0 OR ftag < 0",
    "shots_known": "hs IS NULL",
    "teams_named": "trim(home_team) = '' OR trim(away_team) = ''",
    "status_domain": "status NOT IN ('completed', 'scheduled')",
}


@query(
    "range_rules",
    fx_sql(" UNION ALL ".join(f"SELECT '{n}' AS rule, count(*) FILTER (WHERE {c}) AS violations FROM fx" for n, c in RULES_SQL.items())),
)
def range_rules(spark, folder):
    return X.rule_violations(fixtures(spark, folder), RULES_SQL)
