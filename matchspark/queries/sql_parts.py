"""SQL text shared by the twins: the match facts and the team view as common table expressions."""

from __future__ import annotations

FX = """
pick AS (
 SELECT o.o_orderkey, o.o_orderdate, o.o_orderstatus, c.c_mktsegment, c.c_nationkey, s.s_nationkey,
        l.l_partkey, l.l_suppkey, l.l_linenumber, l.l_quantity, l.l_extendedprice,
        row_number() OVER (PARTITION BY o.o_orderkey
          ORDER BY l.l_linenumber, l.l_partkey, l.l_suppkey, l.l_shipdate, l.l_extendedprice, l.l_quantity) rn
 FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
 JOIN lineitem l ON l.l_orderkey = o.o_orderkey JOIN supplier s ON l.l_suppkey = s.s_suppkey),
fx AS (
SELECT o_orderkey AS match_id, c_mktsegment AS league, CAST(year(o_orderdate) AS VARCHAR) AS season,
  CAST(o_orderdate AS DATE) AS match_date, h.n_name AS home_team, a.n_name AS away_team,
  CAST(CAST(l_quantity AS INT) % 5 AS INT) AS fthg, CAST(l_partkey % 4 AS INT) AS ftag,
  CASE WHEN CAST(l_quantity AS INT) % 5 > l_partkey % 4 THEN 'H'
       WHEN CAST(l_quantity AS INT) % 5 = l_partkey % 4 THEN 'D' ELSE 'A' END AS ftr,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(8 + l_partkey % 9 AS INT) END AS hs,
  CAST(6 + l_suppkey % 9 AS INT) AS as_, CAST(4 + l_partkey % 5 AS INT) AS hst, CAST(3 + l_suppkey % 5 AS INT) AS ast,
  CAST(l_partkey % 11 AS INT) AS hc, CAST(l_suppkey % 9 AS INT) AS ac,
  CAST(l_partkey % 6 AS INT) AS hy, CAST(l_suppkey % 5 AS INT) AS ay,
  CASE WHEN l_partkey % 13 = 0 THEN 1 ELSE 0 END AS hr, CASE WHEN l_suppkey % 17 = 0 THEN 1 ELSE 0 END AS ar,
  CASE WHEN l_partkey % 10 = 0 THEN NULL ELSE (12 + l_partkey % 40) / 10.0E0 END AS b1_h,
  (30 + l_suppkey % 20) / 10.0E0 AS b1_d, (15 + o_orderkey % 45) / 10.0E0 AS b1_a,
  CASE WHEN o_orderkey % 7 = 0 THEN 1.0E0 ELSE (13 + l_partkey % 40) / 10.0E0 END AS b2_h,
  (29 + l_suppkey % 20) / 10.0E0 AS b2_d, (16 + o_orderkey % 45) / 10.0E0 AS b2_a,
  (14 + l_partkey % 20) / 10.0E0 AS ou_over, (14 + l_suppkey % 20) / 10.0E0 AS ou_under,
  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'scheduled' ELSE 'postponed' END AS status,
  concat('REF_', CAST(l_suppkey % 12 AS VARCHAR)) AS referee
FROM pick JOIN nation h ON h.n_nationkey = c_nationkey JOIN nation a ON a.n_nationkey = s_nationkey
WHERE rn = 1),
m AS (SELECT * FROM fx WHERE home_team <> away_team)"""

TV = """
tv AS (
SELECT *, CASE WHEN gf > ga THEN 3 WHEN gf = ga THEN 1 ELSE 0 END AS points FROM (
 SELECT match_id, league, season, match_date, home_team, away_team, status, referee, 1 AS is_home,
  home_team AS team, away_team AS opponent, fthg AS gf, ftag AS ga, hs AS shots, hst AS sot, hc AS corners,
  ac AS corners_against, hy AS yellows, hr AS reds FROM m
 UNION ALL
 SELECT match_id, league, season, match_date, home_team, away_team, status, referee, 0,
  away_team, home_team, ftag, fthg, as_, ast, ac, hc, ay, ar FROM m))"""

KEY = "match_date, home_team, away_team, match_id"


def fx_sql(body: str, *ctes: str) -> str:
    """``body`` over fx and m (self-matches removed), with further CTEs before it."""
    return "WITH RECURSIVE " + ", ".join([FX, *ctes]) + "\n" + body


def tv_sql(body: str, *ctes: str) -> str:
    """``body`` over the team view ``tv``."""
    return fx_sql(body, TV, *ctes)


def sides(columns: dict[str, str], source: str, digits: int | None = 6, keep: str = "") -> str:
    """One row per match from per-side rows: home_<name>, away_<name>."""
    parts = []
    for side, flag in (("home", 1), ("away", 0)):
        for name, expr in columns.items():
            value = f"max(CASE WHEN is_home = {flag} THEN {expr} END)"
            parts.append(f"{value if digits is None else r(value, digits)} AS {side}_{name}")
    return f"SELECT match_id, {keep} {', '.join(parts)} FROM {source} GROUP BY match_id"


def r(expr: str, digits: int = 6) -> str:
    """Rounded double. The tiny shift keeps exact ties on one side in both engines."""
    return f"round(CAST({expr} AS DOUBLE) + 1e-9, {digits}) + 0.0e0"
