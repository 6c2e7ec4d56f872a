"""DuckDB SQL for each registered query, over the same parquet tables.

Written on its own terms (plain joins, plain windows, built-in quantiles), so
that it checks the rewrites the Spark side makes for scale.
"""

from __future__ import annotations

import datetime as dt

def _we(day: str) -> str:
    """Sunday on or after a day."""
    return f"(CAST({day} AS DATE) + CAST(7 - isodow(CAST({day} AS DATE)) AS INTEGER))"


def _sum(expr: str, scale: int = 2) -> str:
    return f"CAST(coalesce(sum(CAST({expr} AS DECIMAL(18,{scale}))), 0) AS DOUBLE)"


def _mean(expr: str, scale: int = 2, digits: int = 4) -> str:
    return f"round(CAST(sum(CAST({expr} AS DECIMAL(18,{scale}))) AS DOUBLE) / count({expr}), {digits})"


def _pct(part: str, whole: str, digits: int = 2) -> str:
    return f"CASE WHEN {whole} = 0 THEN 0.0 ELSE round({part} * CAST(100 AS DOUBLE) / {whole}, {digits}) END"


def _iso(*cols: str) -> str:
    return ", ".join(f"CAST({c} AS VARCHAR) AS {c}" for c in cols)


# name -> (names it needs, body)
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def _cte(name: str, needs: str, body: str) -> None:
    CTES[name] = (tuple(needs.split()), body)


def _half_up(sql: str) -> str:
    """Write `round(x, d)` as floor(x * 10^d + 0.5) / 10^d on doubles; `ROUND` stays as it is."""
    at = sql.find("round(")
    while at >= 0:
        depth, comma, end = 0, -1, at + 6
        while depth >= 0:
            ch = sql[end]
            depth += (ch == "(") - (ch == ")")
            if ch == "," and depth == 0:
                comma = end
            end += 1
        unit = f"CAST({10 ** int(sql[comma + 1 : end - 1])} AS DOUBLE)"
        sql = f"{sql[:at]}(floor(({sql[at + 6 : comma]}) * {unit} + CAST(0.5 AS DOUBLE)) / {unit}){sql[end:]}"
        at = sql.find("round(", at)
    return sql


def _with(needs: str, body: str) -> str:
    """The body after the common table expressions it needs, each after its own."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        if name not in ordered:
            for n in CTES[name][0]:
                if n != name:  # a recursive one
                    visit(n)
            ordered.append(name)

    for n in needs.split():
        visit(n)
    if not ordered:
        return _half_up(body)
    return _half_up("WITH RECURSIVE " + ",\n".join(f"{n} AS MATERIALIZED ({CTES[n][1]})" for n in ordered) + "\n" + body)


# -- the six tables -------------------------------------------------------

_cte("li", "", f"""
SELECT CAST(l_partkey AS VARCHAR) AS relay_id, l_partkey, {_we('l_shipdate')} AS wk_end_date,
       l_suppkey AS store_id, l_quantity, l_discount FROM lineitem""")

_cte("relays", "li", """
SELECT a.relay_id, a.wk_end_date, p.p_type AS dept_cat, a.change AS relay_change_perc, a.hours AS total_store_hours,
       CASE p.p_partkey % 10 WHEN 0 THEN 'Seasonal' WHEN 1 THEN 'Realignment' ELSE 'Standard' END AS short_desc,
       CAST(year(a.wk_end_date) AS INTEGER) AS relay_year,
       'REASON_' || CAST(p.p_size % 9 AS VARCHAR) AS request_reason,
       CAST(a.lines + p.p_size % 5 AS BIGINT) AS historical_moves_count,
       round(CAST(2 AS DOUBLE) + a.hours * CAST(0.1 AS DOUBLE), 2) AS associate_hours_impact,
       round(CAST(100 AS DOUBLE) + (p.p_retailprice - 900) * 4, 2) AS material_cost,
       1 + 3 * ((p.p_partkey * 7919) % 1000) / CAST(1000 AS DOUBLE) AS market_factor
FROM (SELECT relay_id, l_partkey, wk_end_date, round(max(l_discount) * 10, 2) AS change,
             sum(l_quantity) AS hours, count(*) AS lines FROM li GROUP BY ALL) a
JOIN part p ON p.p_partkey = a.l_partkey""")

_cte("stores", "", """
SELECT s_suppkey AS store_id,
       CASE WHEN (s_suppkey * 7) % 20 < 12 THEN 'Large' WHEN (s_suppkey * 7) % 20 < 17 THEN 'Neighborhood'
            WHEN (s_suppkey * 7) % 20 < 19 THEN 'Club' ELSE 'Express' END AS store_type, r_name AS region
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey""")

_cte("bridge", "li stores", """
SELECT b.relay_id, b.wk_end_date, b.store_id, s.store_type
FROM (SELECT DISTINCT relay_id, wk_end_date, store_id FROM li) b LEFT JOIN stores s USING (store_id)""")

_cte("requests", "", f"""
SELECT 'REQ_' || CAST(o_orderkey AS VARCHAR) AS request_id, CAST(l.part AS VARCHAR) AS relay_id, l.store_id,
       CASE WHEN o_orderkey % 5 < 3 THEN 'Business' ELSE 'Merchant' END AS request_type,
       CASE WHEN o_orderstatus = 'F' THEN 'Approved' WHEN o_orderstatus = 'O' THEN 'Pending'
            WHEN o_orderkey % 3 = 0 THEN 'In Progress' ELSE 'Rejected' END AS status,
       {_we('(CAST(o_orderdate AS DATE) + CAST((o_orderkey % 16 - 4) * 7 AS INTEGER))')} AS requested_move_wk,
       {_we('o_orderdate')} AS original_wk_end_date, c_mktsegment AS requested_by,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'Urgent' WHEN '2-HIGH' THEN 'High' WHEN '3-MEDIUM' THEN 'Medium'
            ELSE 'Low' END AS priority_level,
       o_totalprice AS expected_sales_impact, round(o_totalprice / 100, 2) AS cost_estimate, o_orderdate AS request_ts
FROM orders JOIN customer ON o_custkey = c_custkey
JOIN (SELECT l_orderkey, min(l_partkey) AS part, min(l_suppkey) AS store_id FROM lineitem GROUP BY 1) l
  ON l.l_orderkey = o_orderkey""")

_cte("groups", "", """
SELECT 'GROUP_' || CAST(p_partkey // 35 AS VARCHAR) AS adjustment_group_id, CAST(p_partkey AS VARCHAR) AS relay_id,
       p_size <= 6 AS sync_required FROM part WHERE p_size <= 10
UNION ALL
SELECT 'GROUPX_' || CAST(p_partkey // 125 AS VARCHAR), CAST(p_partkey AS VARCHAR), p_size <= 6
FROM part WHERE p_size BETWEEN 5 AND 6""")

_cte("bounds", "relays", "SELECT min(wk_end_date) AS first_week, max(wk_end_date) AS last_week FROM relays")

_cte("holidays", "bounds", f"""
SELECT {_we('day + CAST(shift AS INTEGER)')} AS wk_end_date, holiday_name, holiday_type, true AS is_holiday FROM (
  SELECT make_date(y, 1, 1) AS day, 'New Year' AS holiday_name, 'Standard' AS holiday_type FROM yrs
  UNION ALL SELECT make_date(y, 7, 4), 'Independence Day', 'Standard' FROM yrs
  UNION ALL SELECT make_date(y, 11, 1) + CAST((11 - isodow(make_date(y, 11, 1))) % 7 + 21 AS INTEGER), 'Thanksgiving', 'Major' FROM yrs
  UNION ALL SELECT make_date(y, 12, 25), 'Christmas', 'Major' FROM yrs) h
CROSS JOIN (VALUES (-7), (0), (7)) AS s(shift)""".replace("FROM yrs", "FROM (SELECT unnest(range(year(first_week), year(last_week) + 1)) AS y FROM bounds)"))

_cte("hweeks", "holidays", """
SELECT wk_end_date, arg_min(holiday_name, holiday_type || '|' || holiday_name) AS holiday_name, true AS is_holiday
FROM holidays GROUP BY wk_end_date""")

# -- the schedule ---------------------------------------------------------

_cte("placed", "relays bridge", """
SELECT r.*, b.store_id, coalesce(b.store_type, 'Unknown') AS store_type, r.wk_end_date AS original_wk_end_date,
       r.total_store_hours AS relay_hours, r.short_desc = 'Seasonal' AS is_seasonal,
       r.short_desc = 'Realignment' AS is_dc_realign,
       r.short_desc IN ('Seasonal', 'Realignment') AS cannot_move
FROM relays r JOIN bridge b USING (relay_id, wk_end_date)""")

_cte("grouped", "placed groups hweeks", """
SELECT p.*, coalesce(h.is_holiday, false) AS is_holiday, coalesce(g.adjustment_group_id, 'NO_GROUP') AS adjustment_group_id
FROM placed p LEFT JOIN hweeks h USING (wk_end_date) LEFT JOIN groups g USING (relay_id)""")

_cte("master", "grouped requests", """
SELECT p.*, coalesce(q.request_type, 'None') AS request_type, q.requested_move_wk, coalesce(q.status, 'None') AS status
FROM grouped p LEFT JOIN requests q USING (relay_id)""")

_cte("instances", "master", """
SELECT * EXCLUDE (rn) FROM (
  SELECT *, row_number() OVER (PARTITION BY relay_id, store_id, original_wk_end_date
    ORDER BY requested_move_wk DESC NULLS LAST, wk_end_date DESC NULLS LAST, relay_change_perc DESC NULLS LAST,
             relay_hours DESC NULLS LAST, adjustment_group_id, request_type, status) AS rn FROM master)
WHERE rn = 1""")

_cte("costed", "relays", """
SELECT *, round(labour_cost + setup_cost + material_cost, 2) AS total_cost FROM (
  SELECT *, round(associate_hours_impact * 15, 2) AS labour_cost, round(total_store_hours * 25, 2) AS setup_cost FROM relays)""")

_cte("scored_relays", "costed", """
SELECT *, CASE WHEN risk_score > 7 THEN 'High' WHEN risk_score > 4 THEN 'Medium' ELSE 'Low' END AS risk_category FROM (
  SELECT c.*, round(associate_hours_impact * CAST(3 AS DOUBLE) / CAST(16 AS DOUBLE) + market_factor
                    + total_cost * CAST(3 AS DOUBLE) / m.top, 4) AS risk_score
  FROM costed c, (SELECT max(total_cost) AS top FROM costed) m)""")

_cte("scored", "scored_relays bridge", """
SELECT r.*, b.store_id, r.total_store_hours AS relay_hours, r.wk_end_date AS original_wk_end_date
FROM scored_relays r JOIN bridge b USING (relay_id, wk_end_date)""")


def _load(source: str, week: str, extra: str = "") -> str:
    return f"""
SELECT {week} AS wk_end_date{extra}, {_sum('relay_hours')} AS total_hours,
       {_sum("CASE WHEN store_type = 'Neighborhood' THEN relay_hours END")} AS nm_hours,
       count(*) FILTER (WHERE store_type = 'Neighborhood') AS nm_rows
FROM {source} WHERE {week} IS NOT NULL GROUP BY ALL"""


_cte("load", "placed", _load("placed", "original_wk_end_date"))

_cte("caps", "load", """
SELECT total_cap, floor(total_cap * CAST(0.9 AS DOUBLE)) AS total_cap_holiday, nm_cap,
       floor(nm_cap * CAST(0.9 AS DOUBLE)) AS nm_cap_holiday FROM (
  SELECT floor(sum(total_hours) / count(*) * CAST(1.05 AS DOUBLE)) AS total_cap,
         floor(sum(nm_hours) / count(*) FILTER (WHERE nm_rows > 0) * CAST(1.05 AS DOUBLE)) AS nm_cap FROM load)""")

_cte("cal", "bounds", """
SELECT CAST(unnest(generate_series(first_week, last_week + 84, INTERVAL 7 DAY)) AS DATE) AS wk_end_date FROM bounds""")

_cte("thresholds", "cal hweeks caps", """
SELECT wk_end_date, coalesce(is_holiday, false) AS is_holiday,
       CASE WHEN is_holiday THEN total_cap_holiday ELSE total_cap END AS total_cap,
       CASE WHEN is_holiday THEN nm_cap_holiday ELSE nm_cap END AS nm_cap
FROM cal LEFT JOIN hweeks USING (wk_end_date), caps""")


def _over(load: str) -> str:
    return f"""
SELECT t.*, coalesce(l.total_hours, 0) AS total_hours, coalesce(l.nm_hours, 0) AS nm_hours,
       greatest(0, coalesce(l.total_hours, 0) - total_cap) AS total_over,
       greatest(0, coalesce(l.nm_hours, 0) - nm_cap) AS nm_over,
       greatest(0, total_cap - coalesce(l.total_hours, 0)) AS total_slack,
       greatest(0, nm_cap - coalesce(l.nm_hours, 0)) AS nm_slack
FROM thresholds t LEFT JOIN {load} l USING (wk_end_date)"""


_cte("overage", "thresholds load", _over("load"))
_cte("open_weeks", "thresholds bounds", f"""
SELECT t.* FROM thresholds t, bounds WHERE t.wk_end_date >= {_we('(last_week - 365)')}""")

# -- rebalance, three passes ----------------------------------------------

_cte("unit_rows", "instances", """
SELECT *, CASE WHEN adjustment_group_id <> 'NO_GROUP' THEN adjustment_group_id || '_' || CAST(original_wk_end_date AS VARCHAR)
               ELSE relay_id || '_' || CAST(store_id AS VARCHAR) || '_' || CAST(original_wk_end_date AS VARCHAR) END AS unit_key
FROM instances""")

_cte("units0", "unit_rows", """
SELECT unit_key, min(original_wk_end_date) AS week, sum(relay_hours) AS hours,
       coalesce(sum(relay_hours) FILTER (WHERE store_type = 'Neighborhood'), 0) AS nm_hours, count(*) AS size,
       NOT bool_or(cannot_move) AS movable
FROM unit_rows GROUP BY unit_key""")


def _phase(before: str, after: str, nm: bool, largest_first: bool) -> None:
    """Common table expressions that take one state of the units to the next."""
    tag = f"to_{after}"
    layout = "slack DESC, wk_end_date" if largest_first else "wk_end_date"
    band = "CASE WHEN hours < 1024 THEN CAST(floor(hours) AS BIGINT) ELSE 1013 + length(bin(CAST(floor(hours) AS BIGINT))) END"
    measure, over = ("nm_hours", "nm_over") if nm else ("hours", "total_over")
    slack = "least(total_slack, nm_slack)" if nm else "total_slack"
    others = "" if nm else "AND nm_hours = 0"
    order = f"PARTITION BY week ORDER BY {band} DESC, substr(md5(unit_key), 1, 2), hours DESC, md5(unit_key), unit_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
    _cte(f"state_{tag}", f"{before} open_weeks", f"""
SELECT t.wk_end_date, greatest(0, coalesce(h, 0) - total_cap) AS total_over, greatest(0, coalesce(n, 0) - nm_cap) AS nm_over,
       greatest(0, total_cap - coalesce(h, 0)) AS total_slack, greatest(0, nm_cap - coalesce(n, 0)) AS nm_slack
FROM open_weeks t LEFT JOIN (SELECT week, sum(hours) AS h, sum(nm_hours) AS n FROM {before} GROUP BY 1) l ON l.week = t.wk_end_date""")
    _cte(f"ranked_{tag}", f"{before} state_{tag}", f"""
SELECT u.*, s.{over} AS over_hours, coalesce(sum(hours) OVER w, 0) AS hours_before, coalesce(sum({measure}) OVER w, 0) AS measure_before
FROM {before} u JOIN state_{tag} s ON s.wk_end_date = u.week
WHERE s.{over} > 0 AND movable AND {measure} > 0 AND {measure} * 10 > size * CAST(0.1 AS DOUBLE) {others}
WINDOW w AS ({order})""")
    _cte(f"leaving_{tag}", f"ranked_{tag}", f"""
SELECT * FROM ranked_{tag} WHERE over_hours - measure_before > 0
  AND least({measure}, over_hours - measure_before) * 10 > size * CAST(0.1 AS DOUBLE)""")
    _cte(f"lines_{tag}", f"leaving_{tag}", f"""
SELECT week, coalesce(sum(span) OVER (ORDER BY week ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
FROM (SELECT week, max(hours_before + hours) AS span FROM leaving_{tag} GROUP BY 1)""")
    _cte(f"room_{tag}", f"state_{tag}", f"""
SELECT wk_end_date AS new_week, sum(slack) OVER (ORDER BY {layout}) - slack AS s0, sum(slack) OVER (ORDER BY {layout}) AS s1
FROM (SELECT wk_end_date, {slack} AS slack FROM state_{tag}) WHERE slack > 0""")
    _cte(f"moves_{tag}", f"leaving_{tag} lines_{tag} room_{tag}", f"""
SELECT l.unit_key, r.new_week FROM leaving_{tag} l JOIN lines_{tag} o USING (week)
JOIN room_{tag} r ON r.s0 <= o.start + l.hours_before AND o.start + l.hours_before + l.hours <= r.s1""")
    _cte(after, f"{before} moves_{tag}", f"""
SELECT u.unit_key, coalesce(m.new_week, u.week) AS week, u.hours, u.nm_hours, u.size, u.movable
FROM {before} u LEFT JOIN moves_{tag} m USING (unit_key)""")


for _i in range(3):
    _phase(f"units{2 * _i}", f"units{2 * _i + 1}", nm=True, largest_first=_i % 2 == 1)
    _phase(f"units{2 * _i + 1}", f"units{2 * _i + 2}", nm=False, largest_first=_i % 2 == 1)

# Groups with a common relay, tied together by all paths between them.
_cte("member", "groups", "SELECT DISTINCT adjustment_group_id, relay_id FROM groups")
_cte("group_links", "member", """
SELECT DISTINCT a.adjustment_group_id AS g, b.adjustment_group_id AS h FROM member a JOIN member b USING (relay_id)""")
_cte("group_reach", "group_links", """
SELECT g, h FROM group_links UNION SELECT r.g, l.h FROM group_reach r JOIN group_links l ON l.g = r.h""")
_cte("group_part", "group_reach member", """
SELECT relay_id, min(part) AS group_part FROM member JOIN (SELECT g, min(h) AS part FROM group_reach GROUP BY 1) ON g = adjustment_group_id
GROUP BY 1""")
_cte("sync_unit_rows", "unit_rows group_part", """
SELECT r.* REPLACE (CASE WHEN group_part IS NULL
         THEN r.relay_id || '_' || CAST(r.store_id AS VARCHAR) || '_' || CAST(original_wk_end_date AS VARCHAR)
         ELSE group_part || '_' || CAST(original_wk_end_date AS VARCHAR) END AS unit_key)
FROM unit_rows r LEFT JOIN group_part USING (relay_id)""")
_cte("sync_units0", "sync_unit_rows", CTES["units0"][1].replace("unit_rows", "sync_unit_rows"))
for _i in range(3):
    _phase(f"sync_units{2 * _i}", f"sync_units{2 * _i + 1}", nm=True, largest_first=_i % 2 == 1)
    _phase(f"sync_units{2 * _i + 1}", f"sync_units{2 * _i + 2}", nm=False, largest_first=_i % 2 == 1)
_cte("sync_suggested", "sync_unit_rows sync_units6", """
SELECT r.*, u.week AS suggested_wk_end_date FROM sync_unit_rows r JOIN sync_units6 u USING (unit_key)""")

# A lower bound on the objective: prices of market hours, then of all hours, from plain running sums.
_cte("bound_weeks", "units0 open_weeks", """
SELECT t.wk_end_date AS week, total_cap, nm_cap, coalesce(h, 0) AS hours, coalesce(n, 0) AS nm_hours
FROM open_weeks t LEFT JOIN (SELECT week, sum(hours) AS h, sum(nm_hours) AS n FROM units0 GROUP BY 1) l ON l.week = t.wk_end_date""")
_cte("market_price", "units0 bound_weeks", """
SELECT w.week, least(coalesce(min(ratio) FILTER (WHERE upto >= w.nm_hours - nm_cap), 10), 10) AS b
FROM bound_weeks w LEFT JOIN (
  SELECT week, ratio, sum(nm_hours) OVER (PARTITION BY week ORDER BY ratio) AS upto
  FROM (SELECT *, size * CAST(0.1 AS DOUBLE) / nm_hours AS ratio FROM units0 WHERE movable AND nm_hours > 0)) u ON u.week = w.week
WHERE w.nm_hours > nm_cap GROUP BY 1""")
_cte("market_priced", "units0 market_price", """
SELECT u.*, coalesce(b, 0) AS b, size * CAST(0.1 AS DOUBLE) AS cost FROM units0 u LEFT JOIN market_price USING (week)""")
_cte("hour_price", "market_priced bound_weeks", """
SELECT w.week, least(coalesce(min(ratio) FILTER (WHERE upto >= w.hours - total_cap), 10), 10) AS a
FROM bound_weeks w LEFT JOIN (
  SELECT week, ratio, sum(hours) OVER (PARTITION BY week ORDER BY ratio) AS upto
  FROM (SELECT *, greatest(0, cost - b * nm_hours) / hours AS ratio FROM market_priced WHERE movable AND hours > 0)) u ON u.week = w.week
WHERE w.hours > total_cap GROUP BY 1""")


def _paid(a: str, b: str) -> str:
    stay = f"({a} * u.hours + {b} * u.nm_hours)"
    return f"sum(CASE WHEN movable THEN least({stay}, cost) ELSE {stay} END)"


_cte("bound", "market_priced hour_price bound_weeks overage open_weeks", f"""
SELECT round(greatest(ab - ca - cb, a_only - ca + (nm - nm_cap) * 10, b_only - cb + (hours - cap) * 10,
                      (hours - cap) * 10 + (nm - nm_cap) * 10) + closed, 2) AS bound
FROM (SELECT {_paid('a', 'u.b')} AS ab, {_paid('a', '0')} AS a_only, {_paid('0', 'u.b')} AS b_only
      FROM (SELECT u.*, coalesce(p.a, 0) AS a FROM market_priced u JOIN bound_weeks w USING (week) LEFT JOIN hour_price p USING (week)) u),
     (SELECT sum(coalesce(a, 0) * total_cap) AS ca, sum(coalesce(b, 0) * nm_cap) AS cb, sum(total_cap) AS cap, sum(nm_cap) AS nm_cap,
             sum(hours) AS hours, sum(nm_hours) AS nm
      FROM bound_weeks LEFT JOIN hour_price USING (week) LEFT JOIN market_price USING (week)),
     (SELECT coalesce(sum(total_over * 10 + nm_over * 10), 0) AS closed FROM overage
      WHERE wk_end_date NOT IN (SELECT wk_end_date FROM open_weeks))""")

_cte("suggested", "unit_rows units6", """
SELECT r.*, u.week AS suggested_wk_end_date FROM unit_rows r JOIN units6 u USING (unit_key)""")
_cte("moved", "suggested", "SELECT * FROM suggested WHERE suggested_wk_end_date <> original_wk_end_date")
_cte("load_after", "suggested", _load("suggested", "suggested_wk_end_date"))
_cte("overage_after", "thresholds load_after", _over("load_after"))
_cte("both_loads", "load load_after", """
SELECT *, 'Current' AS schedule_type FROM load UNION ALL SELECT *, 'Suggested' FROM load_after""")
_cte("objectives", "overage overage_after moved", f"""
SELECT *, round(moves * CAST(0.1 AS DOUBLE) + total_over * 10 + nm_over * 10, 2) AS objective FROM (
  SELECT 'Current' AS schedule, CAST(0 AS BIGINT) AS moves, {_sum('total_over')} AS total_over, {_sum('nm_over')} AS nm_over FROM overage
  UNION ALL
  SELECT 'Suggested', (SELECT count(*) FROM moved), {_sum('total_over')}, {_sum('nm_over')} FROM overage_after)""")
_cte("benefit", "objectives cal", """
SELECT *, round(weekly_savings * 52, 2) AS annual_savings FROM (
  SELECT b.objective AS baseline_cost, a.objective AS optimized_cost, round(b.objective - a.objective, 2) AS savings,
         round(round(b.objective - a.objective, 2) / (SELECT count(*) FROM cal), 2) AS weekly_savings
  FROM objectives b, objectives a WHERE b.schedule = 'Current' AND a.schedule = 'Suggested')""")
_cte("asks", "requests", """
SELECT relay_id, request_id AS req_id, request_type AS req_type, status AS req_status, requested_move_wk AS req_week
FROM requests""")
_cte("matched", "moved asks", """
SELECT m.relay_id, m.store_id, m.store_type, m.relay_hours, m.original_wk_end_date, m.suggested_wk_end_date,
       a.req_id, a.req_type, a.req_status, a.req_week,
       coalesce(a.req_status = 'Pending' AND m.suggested_wk_end_date = a.req_week, false) AS matches_request
FROM moved m LEFT JOIN asks a USING (relay_id)""")


def _sync(source: str, week: str) -> str:
    """Group weeks whose members differ, from zero-filled counts."""
    return f"""
SELECT adjustment_group_id, wk_end_date, min(n) AS lowest, max(n) AS highest FROM (
  SELECT w.adjustment_group_id, w.wk_end_date, m.relay_id, coalesce(p.n, 0) AS n
  FROM (SELECT DISTINCT adjustment_group_id, {week} AS wk_end_date FROM {source} JOIN member USING (relay_id)) w
  JOIN member m USING (adjustment_group_id)
  LEFT JOIN (SELECT relay_id, {week} AS wk_end_date, count(*) AS n FROM {source} GROUP BY 1, 2) p
    ON p.relay_id = m.relay_id AND p.wk_end_date = w.wk_end_date)
GROUP BY 1, 2 HAVING min(n) <> max(n)"""


# The member table of the fan-out query carries its own group column.
_cte("placed_bare", "placed", "SELECT relay_id, store_id, original_wk_end_date FROM placed")
_cte("suggested_bare", "suggested", "SELECT relay_id, store_id, suggested_wk_end_date FROM suggested")
_cte("instances_bare", "instances", "SELECT relay_id, store_id, original_wk_end_date FROM instances")
_cte("tied_bare", "sync_suggested", "SELECT relay_id, store_id, suggested_wk_end_date FROM sync_suggested")
_cte("sync_before", "instances_bare member", _sync("instances_bare", "original_wk_end_date"))
_cte("sync_tied", "tied_bare member", _sync("tied_bare", "suggested_wk_end_date"))
_cte("sync_after", "suggested_bare member", _sync("suggested_bare", "suggested_wk_end_date"))

_cte("store_perf", "scored", f"""
SELECT store_id, {_sum('total_cost')} AS total_cost, {_mean('risk_score')} AS mean_risk, count(*) AS relay_count
FROM scored GROUP BY 1""".replace("risk_score AS DECIMAL(18,2)", "risk_score AS DECIMAL(18,4)"))
_cte("store_month", "scored store_perf", f"""
SELECT store_id, strftime(wk_end_date, '%Y-%m') AS month, {_sum('total_cost')} AS total_cost, {_sum('associate_hours_impact')} AS associate_hours
FROM scored WHERE store_id IN (SELECT store_id FROM store_perf ORDER BY total_cost DESC, store_id LIMIT 20) GROUP BY 1, 2""")
_cte("weekly_cost", "scored", f"""
SELECT wk_end_date, {_sum('total_cost')} AS total_cost, {_sum('relay_hours')} AS relay_hours FROM scored GROUP BY 1""")
_cte("overactive", "master", """
SELECT dept_cat, relay_year, count(DISTINCT relay_id) AS distinct_relays, count(relay_id) AS relay_rows
FROM master WHERE relay_change_perc >= 0.5 GROUP BY 1, 2""")
_cte("dept_counts", "scored", "SELECT dept_cat, count(*) AS n FROM scored GROUP BY 1")
_cte("imbalance", "dept_counts", """
SELECT count(*) AS departments, round(avg(n), 4) AS mean_count, round(stddev_samp(n), 4) AS std_count FROM dept_counts""")
_cte("busy_stores", "scored", f"""
SELECT store_id, {_mean('historical_moves_count', 0)} AS mean_prior_moves, count(*) AS relay_count
FROM scored GROUP BY 1 HAVING {_mean('historical_moves_count', 0)} > 3""")
_cte("year_relays", "relays", """
SELECT DISTINCT dept_cat, relay_id, relay_year - (SELECT max(relay_year) FROM relays) AS age FROM relays
WHERE relay_year >= (SELECT max(relay_year) FROM relays) - 1""")
_cte("linked_relays", "relays requests groups", """
SELECT r.relay_id, r.dept_cat, q.request_type, q.requested_move_wk, q.status, g.adjustment_group_id
FROM relays r
LEFT JOIN (SELECT * FROM requests QUALIFY row_number() OVER (PARTITION BY relay_id ORDER BY requested_move_wk DESC NULLS LAST, request_type, status) = 1) q USING (relay_id)
LEFT JOIN (SELECT relay_id, min(adjustment_group_id) AS adjustment_group_id FROM groups GROUP BY 1) g USING (relay_id)""")

ORACLE: dict[str, str] = {}


def _q(name: str, needs: str, body: str) -> None:
    ORACLE[name] = _with(needs, body)


TABLES = "relays stores bridge requests groups holidays"

_q("load_tables", TABLES, " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES.split()))
_q("sql_source", "relays", """
SELECT dept_cat, relay_year, count(*) AS relay_count, sum(total_store_hours) AS hours FROM relays GROUP BY 1, 2""")
_q("checkpoint_roundtrip", "placed", f"""
SELECT relay_id, store_id, {_iso('wk_end_date')}, dept_cat, relay_hours, cannot_move, relay_year FROM placed""")
_q("csv_export", "store_perf", "SELECT * FROM store_perf")
def _json(*pairs: str) -> str:
    """SQL of a JSON object from `name:sql` for numbers and `name=sql` for text; null stays null."""
    parts = []
    for pair in pairs:
        at = min(i for i in (pair.find(":"), pair.find("=")) if i >= 0)
        name, value = pair[:at], pair[at + 1 :] or pair[:at]
        value = f"CAST({value} AS VARCHAR)" if pair[at] == ":" else f"coalesce('\"' || CAST({value} AS VARCHAR) || '\"', 'null')"
        parts.append(f"'\"{name}\":' || {value}")
    return "'{' || " + " || ',' || ".join(parts) + " || '}'"


def _money(*names: str) -> list[str]:
    return [f"{n}=CAST({n} AS DECIMAL(20,2))" for n in names]


_cte("returns", "benefit", """
SELECT *, CASE WHEN weekly_savings > 0 THEN round(50000 / weekly_savings, 4) END AS payback_weeks,
       round(annual_savings * 100 / CAST(50000 AS DOUBLE), 2) AS roi_pct FROM benefit""")
_cte("plan_kpi", "scored returns", f"""
SELECT total_relays, total_cost, mean_cost, high_risk_count, annual_savings, roi_pct, payback_weeks
FROM (SELECT count(*) AS total_relays, {_sum('total_cost')} AS total_cost, {_mean('total_cost', 2, 2)} AS mean_cost,
             count(*) FILTER (WHERE risk_score > 7) AS high_risk_count FROM scored), returns""")
_cte("trend", "weekly_cost", f"""
SELECT month, total_cost, trend_pct, CASE WHEN trend_pct > 0 THEN 'up' WHEN trend_pct < 0 THEN 'down' ELSE 'flat' END AS direction
FROM (SELECT month, total_cost, coalesce({_pct('(total_cost - prior)', 'prior')}, 0) AS trend_pct
      FROM (SELECT month, total_cost, lag(total_cost) OVER (ORDER BY month) AS prior
            FROM (SELECT strftime(wk_end_date, '%Y-%m') AS month, {_sum('total_cost')} AS total_cost FROM weekly_cost GROUP BY 1)))""")
_cte("dept_totals", "scored", f"""
SELECT dept_cat, {_sum('total_cost')} AS total_cost, {_mean('risk_score', 4, 2)} AS mean_risk, count(*) AS relay_count FROM scored GROUP BY 1""")
_q("plan_kpis", "plan_kpi", "SELECT * FROM plan_kpi")
_PAYBACK = "payback_weeks=CAST(payback_weeks AS DECIMAL(20,4))"
_q("dashboard_document", "scored requests returns plan_kpi trend dept_totals bounds", f"""
SELECT '{{"data_timestamp":"' || (SELECT CAST(last_week AS VARCHAR) FROM bounds) || '","executive_summary":'
  || (SELECT {_json('total_relays:', *_money('total_cost'), 'high_risk_count:', 'pending_requests:')}
      FROM plan_kpi, (SELECT count(*) AS pending_requests FROM requests WHERE status = 'Pending'))
  || ',"cost_benefit":' || (SELECT {_json(*_money('baseline_cost', 'optimized_cost', 'savings', 'weekly_savings', 'annual_savings', 'roi_pct'), _PAYBACK)} FROM returns)
  || ',"kpi_metrics":' || (SELECT {_json('total_relays:', *_money('total_cost', 'mean_cost'), 'high_risk_count:', *_money('annual_savings', 'roi_pct'), _PAYBACK)} FROM plan_kpi)
  || ',"department_summary":[' || (SELECT string_agg({_json('dept_cat=', *_money('total_cost', 'mean_risk'), 'relay_count:')}, ',' ORDER BY dept_cat) FROM dept_totals)
  || '],"top_risk_relays":[' || (SELECT string_agg({_json('relay_id=', 'store_id:', 'risk_score=CAST(risk_score AS DECIMAL(10,4))', *_money('total_cost'), 'dept_cat=')},
       ',' ORDER BY risk_score DESC, relay_id, store_id, wk_end_date) FROM (SELECT * FROM scored ORDER BY risk_score DESC, relay_id, store_id, wk_end_date LIMIT 10))
  || '],"trends":[' || (SELECT string_agg({_json('month=', *_money('total_cost', 'trend_pct'), 'direction=')}, ',' ORDER BY month) FROM trend)
  || ']}}' AS document""")
_q("text_import", "requests", """
SELECT request_id, relay_id, store_id, CASE WHEN CAST(substr(request_id, 5) AS BIGINT) % 7 <> 0 THEN CAST(requested_move_wk AS VARCHAR) END AS requested_move_wk,
       status FROM requests""")
_q("resumed_stages", "instances load thresholds", "UNION ALL".join(f"""
SELECT '{stage}' AS stage, count(*) AS row_count, false AS first, true AS again, {same} AS dearer FROM {source}
""" for stage, source, same in (("instances", "instances", "true"), ("load", "load", "true"), ("thresholds", "thresholds", "true"), ("suggested", "instances", "false"))))

_q("relay_flags", "relays", f"""
SELECT relay_id, {_iso('wk_end_date')}, short_desc = 'Seasonal' AS is_seasonal, short_desc = 'Realignment' AS is_dc_realign,
       short_desc IN ('Seasonal', 'Realignment') AS cannot_move, relay_year FROM relays""")
_q("instance_key", "placed", """
SELECT relay_id || '_' || store_id || '_' || CAST(original_wk_end_date AS VARCHAR) AS instance_key, relay_hours FROM placed""")
_q("optim_scope", "placed bounds", f"""
SELECT relay_id, store_id, {_iso('original_wk_end_date')}, relay_hours FROM placed, bounds WHERE original_wk_end_date >= last_week - 365""")
_q("pending_requests", "requests", f"""
SELECT request_id, relay_id, store_id, request_type, {_iso('requested_move_wk', 'original_wk_end_date')}, priority_level
FROM requests WHERE status = 'Pending'""")

_q("relay_store_join", "placed", f"""
SELECT relay_id, {_iso('wk_end_date')}, store_id, store_type, dept_cat, relay_hours, cannot_move FROM placed""")
_q("holiday_flags", "placed hweeks", f"""
SELECT relay_id, store_id, {_iso('wk_end_date')}, coalesce(is_holiday, false) AS is_holiday, coalesce(holiday_name, 'None') AS holiday_name
FROM placed LEFT JOIN hweeks USING (wk_end_date)""")
_q("group_join", "grouped", f"SELECT relay_id, store_id, {_iso('wk_end_date')}, adjustment_group_id FROM grouped")
_q("request_join", "placed requests", f"""
SELECT store_type, coalesce(request_type, 'None') AS request_type, coalesce(status, 'None') AS status,
       CAST(requested_move_wk AS VARCHAR) AS requested_move_wk, count(*) AS row_count, sum(relay_hours) AS hours
FROM placed p LEFT JOIN (SELECT relay_id, request_type, status, requested_move_wk FROM requests) q USING (relay_id) GROUP BY 1, 2, 3, 4""")
_q("move_request_match", "matched", f"""
SELECT * REPLACE ({_iso('original_wk_end_date', 'suggested_wk_end_date', 'req_week')}) FROM matched""")
_q("dept_yoy", "year_relays", """
SELECT dept_cat, coalesce(a.n, 0) AS this_year, coalesce(b.n, 0) AS last_year, coalesce(a.n, 0) - coalesce(b.n, 0) AS change
FROM (SELECT dept_cat, count(DISTINCT relay_id) AS n FROM year_relays WHERE age = 0 GROUP BY 1) a
FULL JOIN (SELECT dept_cat, count(DISTINCT relay_id) AS n FROM year_relays WHERE age = -1 GROUP BY 1) b USING (dept_cat)""")
_q("new_relays", "relays", """
SELECT DISTINCT relay_id, dept_cat, CAST(wk_end_date AS VARCHAR) AS wk_end_date FROM relays
WHERE relay_year = (SELECT max(relay_year) FROM relays)
  AND relay_id NOT IN (SELECT relay_id FROM relays WHERE relay_year = (SELECT max(relay_year) FROM relays) - 1)""")
_q("store_month_cost", "store_month", "SELECT * FROM store_month")
_q("move_candidates", "instances overage", """
SELECT i.relay_id, i.store_id, CAST(i.original_wk_end_date AS VARCHAR) AS original_wk_end_date, count(w.wk_end_date) AS candidate_weeks,
       CAST(min(w.wk_end_date) AS VARCHAR) AS first_week, CAST(max(w.wk_end_date) AS VARCHAR) AS last_week,
       CAST(0 AS DOUBLE) AS stay_cost, CAST(0.1 AS DOUBLE) AS move_cost
FROM instances i
LEFT JOIN (SELECT * FROM overage WHERE total_slack > 0) w ON w.total_slack >= i.relay_hours
WHERE NOT i.cannot_move AND i.original_wk_end_date IN (SELECT wk_end_date FROM overage WHERE total_over > 0) GROUP BY 1, 2, 3""")
_q("master_schedule", "master", f"""
SELECT relay_id, store_id, {_iso('original_wk_end_date')}, store_type, dept_cat, relay_hours, relay_change_perc, is_holiday, cannot_move,
       adjustment_group_id, request_type, {_iso('requested_move_wk')}, status FROM master""")

_q("overactive_groups", "overactive", "SELECT * FROM overactive")
_q("overactive_measures", "overactive", """
SELECT count(DISTINCT dept_cat) FILTER (WHERE distinct_relays > 2) AS overactive_group_count,
       CAST(coalesce(sum(distinct_relays) FILTER (WHERE distinct_relays > 2), 0) AS BIGINT) AS overactive_relay_count,
       CASE WHEN coalesce(sum(relay_rows) FILTER (WHERE relay_rows > 2), 0) > 2 THEN 1 ELSE 0 END AS overactive_flag FROM overactive""")
_q("request_frequency", "requests", "SELECT requested_by, count(*) AS request_count FROM requests GROUP BY 1")


def _status(source: str) -> str:
    return f"""
SELECT status, row_count, {_pct('row_count', 'total', 4)} AS share_pct
FROM (SELECT status, count(*) AS row_count FROM {source} GROUP BY 1), (SELECT count(*) AS total FROM {source})"""


_q("status_breakdown", "requests", _status("requests"))
_q("master_status", "master", _status("master"))
_q("request_seasonality", "requests", """
SELECT CAST(month(request_ts) AS INTEGER) AS month, count(*) AS request_count FROM requests GROUP BY 1""")
_q("exec_summary", "scored requests", f"""
SELECT count(*) AS total_relays, {_sum('total_cost')} AS total_cost, count(*) FILTER (WHERE risk_score > 7) AS high_risk_count,
       (SELECT count(*) FROM requests WHERE status = 'Pending') AS pending_requests FROM scored""")
_q("store_performance", "store_perf", "SELECT * FROM store_perf")
_q("department_breakdown", "scored", f"""
SELECT dept_cat, total_cost, relay_count, is_total, {_pct('total_cost', 'grand')} AS share_pct
FROM (SELECT coalesce(dept_cat, 'TOTAL') AS dept_cat, {_sum('total_cost')} AS total_cost, count(*) AS relay_count, grouping(dept_cat) = 1 AS is_total
      FROM scored GROUP BY ROLLUP (dept_cat)), (SELECT {_sum('total_cost')} AS grand FROM scored)""")
_q("reason_summary", "scored", f"""
SELECT request_reason, {_sum('total_cost')} AS total_cost, count(*) AS relay_count, {_sum('associate_hours_impact')} AS associate_hours
FROM scored GROUP BY 1""")
_q("dept_month_moves", "scored", f"""
SELECT strftime(wk_end_date, '%Y-%m') AS month, dept_cat, {_mean('historical_moves_count', 0)} AS mean_prior_moves,
       {_sum('total_cost')} AS total_cost FROM scored GROUP BY 1, 2""")
_q("dept_risk_matrix", "scored", f"""
SELECT dept_cat, {_mean('risk_score', 4)} AS mean_risk, {_mean('total_cost')} AS mean_cost, count(*) AS relay_count FROM scored GROUP BY 1""")
_q("dept_summary", "scored", f"""
SELECT dept_cat, {_sum('total_cost')} AS total_cost, {_mean('total_cost', 2, 2)} AS mean_cost, {_mean('risk_score', 4, 2)} AS mean_risk,
       count(*) AS relay_count FROM scored GROUP BY 1""")
_q("kpi_metrics", "scored", f"""
SELECT total_relays, total_cost, mean_cost, high_risk_count, potential_savings,
       round(potential_savings / weeks * 52 * 100 / 50000, 2) AS roi_pct, round(50000 / (potential_savings / weeks), 4) AS payback_weeks
FROM (SELECT *, round(total_cost * CAST(0.3 AS DOUBLE), 2) AS potential_savings FROM (
  SELECT count(*) AS total_relays, {_sum('total_cost')} AS total_cost, {_mean('total_cost', 2, 2)} AS mean_cost,
         count(*) FILTER (WHERE risk_score > 7) AS high_risk_count, count(DISTINCT wk_end_date) AS weeks FROM scored))""")
_q("weekly_hours_compare", "both_loads thresholds", f"""
SELECT {_iso('wk_end_date')}, schedule_type, total_hours, total_cap FROM both_loads LEFT JOIN thresholds USING (wk_end_date)""")
_q("nm_weekly_hours", "both_loads thresholds", f"""
SELECT {_iso('wk_end_date')}, schedule_type, nm_hours, nm_cap FROM both_loads LEFT JOIN thresholds USING (wk_end_date) WHERE nm_rows > 0""")
_q("moves_by_dept", "moved", "SELECT dept_cat, count(*) AS moves FROM moved GROUP BY 1")
_q("merchant_scorecard", "requests", f"""
SELECT requested_by, count(*) AS request_count, {_pct("count(*) FILTER (WHERE status = 'Approved')", 'count(*)')} AS approval_rate,
       {_pct("count(*) FILTER (WHERE priority_level IN ('High', 'Urgent'))", 'count(*)')} AS high_priority_rate,
       {_sum('expected_sales_impact')} AS expected_sales, {_mean('expected_sales_impact', 2, 2)} AS mean_expected_sales
FROM requests GROUP BY 1""")
_q("seasonal_patterns", "requests", """
SELECT CAST(month(request_ts) AS INTEGER) AS month, request_type, count(*) AS request_count FROM requests GROUP BY 1, 2""")


def _scenario(name: str, cost: str) -> str:
    return f"""
SELECT '{name}' AS scenario, unnest(['total_cost', 'mean_cost', 'rows_above_p80']) AS metric,
       unnest([{_sum(cost)}, {_mean(cost)}, CAST(count(*) FILTER (WHERE {cost} > cut) AS DOUBLE)]) AS value
FROM pair, (SELECT round(quantile_cont({cost}, 0.8), 6) AS cut FROM pair)"""


_cte("pair", "suggested scored", """
SELECT s.total_cost AS baseline, round(s.total_cost + CASE WHEN g.suggested_wk_end_date <> g.original_wk_end_date
       THEN CAST(0.1 AS DOUBLE) ELSE 0 END, 2) AS optimized
FROM suggested g JOIN scored s USING (relay_id, store_id, original_wk_end_date)""")
_q("before_after", "pair", _scenario("Baseline", "baseline") + " UNION ALL " + _scenario("Optimized", "optimized"))
_q("high_frequency_stores", "busy_stores", "SELECT * FROM busy_stores")
_q("dept_imbalance", "imbalance", "SELECT *, std_count > mean_count * CAST(0.5 AS DOUBLE) AS is_uneven FROM imbalance")
_q("request_status_cards", "requests", "SELECT status, count(*) AS request_count, count(*) * 2500 AS impact FROM requests GROUP BY 1")

COLUMNS = {
    "relays": "relay_id wk_end_date dept_cat relay_change_perc total_store_hours short_desc relay_year request_reason "
    "historical_moves_count associate_hours_impact material_cost market_factor",
    "stores": "store_id store_type region",
    "bridge": "relay_id wk_end_date store_id store_type",
    "requests": "request_id relay_id store_id request_type status requested_move_wk original_wk_end_date requested_by "
    "priority_level expected_sales_impact cost_estimate request_ts",
    "groups": "adjustment_group_id relay_id sync_required",
    "holidays": "wk_end_date holiday_name holiday_type is_holiday",
    "linked_relays": "relay_id dept_cat request_type requested_move_wk status adjustment_group_id",
}
_q("dq_completeness", TABLES + " linked_relays", "SELECT *, completeness_pct < 95 AS below_target FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{col}' AS column_name, {_pct(f'count({col})', 'count(*)')} AS completeness_pct FROM {t}"
    for t, cols in COLUMNS.items() for col in cols.split()) + ")")
_q("dq_volume", "relays bridge requests holidays", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{col}' AS column_name, strftime({col}, '%Y-%m') AS month, count(*) AS row_count FROM {t} GROUP BY 3"
    for t, col in [("relays", "wk_end_date"), ("bridge", "wk_end_date"), ("requests", "original_wk_end_date"), ("holidays", "wk_end_date")]))


def _bin(value: str, lo: str, hi: str) -> str:
    return f"CASE WHEN {hi} = {lo} THEN 0 ELSE least(19, CAST(floor(({value} - {lo}) * CAST(20 AS DOUBLE) / ({hi} - {lo})) AS INTEGER)) END"


NUMERIC = {
    "relays": "relay_change_perc total_store_hours relay_year historical_moves_count associate_hours_impact material_cost market_factor",
    "stores": "store_id",
    "bridge": "store_id",
    "requests": "store_id expected_sales_impact cost_estimate",
}
_q("dq_histogram", "relays stores bridge requests", " UNION ALL ".join(
    f"SELECT '{table}' AS table_name, '{col}' AS column_name, {_bin(f'CAST({col} AS DOUBLE)', 'lo', 'hi')} AS bin, count(*) AS row_count "
    f"FROM {table}, (SELECT CAST(min({col}) AS DOUBLE) AS lo, CAST(max({col}) AS DOUBLE) AS hi FROM {table}) WHERE {col} IS NOT NULL GROUP BY 3"
    for table, columns in NUMERIC.items() for col in columns.split()))
_q("risk_histogram", "scored", f"""
SELECT risk_category, {_bin('risk_score', 'lo', 'hi')} AS bin, count(*) AS row_count
FROM scored, (SELECT min(risk_score) AS lo, max(risk_score) AS hi FROM scored) GROUP BY 1, 2""")
_q("dq_freshness", "relays bridge requests holidays bounds", "SELECT table_name, lag_hours, lag_hours <= 2 AS is_fresh FROM (" + " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, round((epoch(CAST(max(last_week) AS TIMESTAMP)) - epoch(CAST(max({col}) AS TIMESTAMP))) / 3600, 2) AS lag_hours FROM {t}, bounds"
    for t, col in [("relays", "wk_end_date"), ("bridge", "wk_end_date"), ("requests", "request_ts"), ("holidays", "wk_end_date")]) + ")")


def _orphan(name: str, child: str, parent: str, cond: str) -> str:
    return f"""SELECT '{name}' AS foreign_key, count(*) FILTER (WHERE NOT EXISTS (SELECT 1 FROM {parent} p WHERE {cond})) AS orphans,
  count(*) AS total_rows FROM {child} c"""


_q("dq_orphans", "relays bridge stores requests groups", f"SELECT *, {_pct('orphans', 'total_rows', 4)} AS orphan_pct FROM (" + " UNION ALL ".join([
    _orphan("bridge_relay_week", "bridge", "relays", "p.relay_id = c.relay_id AND p.wk_end_date = c.wk_end_date"),
    _orphan("bridge_store", "bridge", "stores", "p.store_id = c.store_id"),
    _orphan("request_relay", "requests", "relays", "p.relay_id = c.relay_id"),
    _orphan("request_target_week", "requests", "bridge", "p.relay_id = c.relay_id AND p.wk_end_date = c.requested_move_wk"),
    _orphan("group_relay", "groups", "relays", "p.relay_id = c.relay_id"),
]) + ")")
RULES = [
    ("relays", "change_in_range", "relay_change_perc BETWEEN 0 AND 1"),
    ("relays", "hours_positive", "total_store_hours > 0"),
    ("relays", "hours_below_nm_cap", "total_store_hours <= 100"),
    ("relays", "year_matches_week", "relay_year = year(wk_end_date)"),
    ("relays", "week_is_sunday", "isodow(wk_end_date) = 7"),
    ("requests", "status_in_domain", "status IN ('Approved', 'Pending', 'In Progress', 'Rejected')"),
    ("requests", "priority_in_domain", "priority_level IN ('Urgent', 'High', 'Medium', 'Low')"),
    ("requests", "sales_cover_cost", "expected_sales_impact >= cost_estimate"),
    ("requests", "move_is_later", "requested_move_wk >= original_wk_end_date"),
    ("bridge", "store_known", "store_id IS NOT NULL"),
]
_q("dq_rules", "relays requests bridge", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, '{n}' AS rule_name, count(*) FILTER (WHERE {r}) AS passed_rows, "
    f"{_pct(f'count(*) FILTER (WHERE {r})', 'count(*)', 4)} AS pass_pct FROM {t}" for t, n, r in RULES))

_q("move_cost", "costed bridge", f"""
SELECT relay_id, store_id, {_iso('wk_end_date')}, labour_cost, setup_cost, material_cost, total_cost
FROM costed JOIN bridge USING (relay_id, wk_end_date)""")
_q("risk_score", "scored", f"SELECT relay_id, store_id, {_iso('wk_end_date')}, total_cost, risk_score, risk_category FROM scored")
_q("cost_analysis", "scored", f"""
SELECT *, {_pct('savings', 'baseline_cost')} AS roi_pct FROM (
  SELECT baseline_cost, round(baseline_cost * CAST(0.7 AS DOUBLE), 2) AS optimized_cost, round(baseline_cost * CAST(0.3 AS DOUBLE), 2) AS savings
  FROM (SELECT {_sum('total_cost')} AS baseline_cost FROM scored))""")
_q("predictive_insights", "scored", f"""
SELECT count(*) FILTER (WHERE risk_score > 7) AS high_risk_count, {_sum('total_cost')} AS cost_forecast,
       round({_sum('total_cost')} * CAST(0.25 AS DOUBLE), 2) AS savings_potential FROM scored""")
_q("peak_weeks", "weekly_cost", f"""
SELECT {_iso('wk_end_date')}, relay_hours FROM weekly_cost
WHERE relay_hours > (SELECT round(avg(relay_hours) + stddev_samp(relay_hours), 4) FROM weekly_cost)""")
_q("opportunities", "scored busy_stores imbalance", """
SELECT 'Consolidate high-frequency stores' AS title,
       CAST(count(*) AS VARCHAR) || ' stores move their relays more often than the limit.' AS description, 'High' AS impact, CAST(count(*) * 5000 AS DOUBLE) AS estimated_savings, 'Medium' AS effort
FROM busy_stores HAVING count(*) > 0
UNION ALL SELECT 'Plan seasonal work ahead', CAST(count(*) AS VARCHAR) || ' relays are seasonal and can be planned together.', 'Medium', CAST(count(*) * 200 AS DOUBLE), 'Low' FROM scored
WHERE request_reason = 'REASON_0' HAVING count(*) > 10
UNION ALL SELECT 'Balance departments', 'Work is spread unevenly over ' || CAST(departments AS VARCHAR) || ' departments.', 'Medium', CAST(15000 AS DOUBLE), 'Medium' FROM imbalance WHERE std_count > mean_count * 0.5""")
_q("cost_waterfall", "benefit", """
SELECT CAST(unnest([1, 2, 3, 4, 5]) AS INTEGER) AS position, unnest(['Baseline', 'Overtime', 'Balancing', 'Compliance', 'Optimized']) AS step,
       unnest([baseline_cost, round(savings * CAST(-0.4 AS DOUBLE), 2), round(savings * CAST(-0.4 AS DOUBLE), 2),
               round(savings * CAST(-0.2 AS DOUBLE), 2), optimized_cost]) AS amount FROM benefit""")
_q("roi_timeline", "benefit", """
SELECT CAST(w AS INTEGER) AS week_number, round(weekly_savings * w, 2) AS cumulative_savings, round(weekly_savings * w - 50000, 2) AS net_benefit
FROM benefit, range(1, 53) AS r(w)""")
_q("weekly_forecast", "weekly_cost bounds", """
SELECT CAST(last_week + CAST(i * 7 AS INTEGER) AS VARCHAR) AS wk_end_date, forecast_cost, round(forecast_cost / 25, 2) AS forecast_hours,
       CAST(floor(forecast_cost / 1000) AS BIGINT) AS forecast_count,
       CASE WHEN forecast_cost > 50000 THEN 'High' WHEN forecast_cost > 30000 THEN 'Medium' ELSE 'Low' END AS risk_level
FROM (SELECT last_week, i, round(greatest(0, level + slope * (7 + i - centre)), 2) AS forecast_cost
      FROM bounds, range(1, 13) AS r(i),
           (SELECT sy / n AS level, coalesce((n * sxy - sx * sy) / nullif(n * sxx - sx * sx, 0), 0) AS slope, sx / n AS centre
            FROM (SELECT CAST(count(*) AS DOUBLE) AS n, sum(pos) AS sx, sum(pos * pos) AS sxx, {s} AS sy, {sxy} AS sxy
                  FROM (SELECT total_cost, CAST(7 - date_diff('day', wk_end_date, last_week) / 7 AS DOUBLE) AS pos
                        FROM weekly_cost, bounds WHERE wk_end_date > last_week - 56))))""".replace("{sxy}", _sum("pos * total_cost")).replace("{s}", _sum("total_cost")))
_q("kpi_trend", "weekly_cost", f"""
SELECT month, total_cost, trend_pct, CASE WHEN trend_pct > 0 THEN 'up' WHEN trend_pct < 0 THEN 'down' ELSE 'flat' END AS direction
FROM (SELECT month, total_cost, coalesce({_pct('(total_cost - prior)', 'prior')}, 0) AS trend_pct
      FROM (SELECT month, total_cost, lag(total_cost) OVER (ORDER BY month) AS prior
            FROM (SELECT strftime(wk_end_date, '%Y-%m') AS month, {_sum('total_cost')} AS total_cost FROM weekly_cost GROUP BY 1)))""")
_q("cost_roi_quadrants", "scored requests", f"""
SELECT CASE WHEN roi > 0 AND NOT dear THEN 'Quick win' WHEN roi > 0 THEN 'Strategic' WHEN NOT dear THEN 'Low value' ELSE 'Reconsider' END AS quadrant,
       count(*) AS relay_count, {_sum('relay_cost')} AS total_cost
FROM (SELECT relay_cost, round((coalesce(expected_sales, 0) - relay_cost) / relay_cost, 4) AS roi,
             relay_cost > (median(relay_cost) OVER ()) AS dear
      FROM (SELECT relay_id, {_sum('total_cost')} AS relay_cost FROM scored GROUP BY 1)
      LEFT JOIN (SELECT relay_id, {_sum('expected_sales_impact')} AS expected_sales FROM requests GROUP BY 1) USING (relay_id)) GROUP BY 1""")
_q("currency_label", "store_perf", """
SELECT store_id, total_cost, CASE
  WHEN total_cost >= 1000000 THEN '$' || CAST(CAST(ROUND(CAST(total_cost AS DECIMAL(18,2)) / 1000000, 1) AS DECIMAL(20,1)) AS VARCHAR) || 'M'
  WHEN total_cost >= 1000 THEN '$' || CAST(CAST(ROUND(CAST(total_cost AS DECIMAL(18,2)) / 1000, 1) AS DECIMAL(20,1)) AS VARCHAR) || 'K'
  ELSE '$' || CAST(CAST(ROUND(total_cost) AS BIGINT) AS VARCHAR) END AS label FROM store_perf""")
_q("what_if_thresholds", "overage", f"""
SELECT scenario, weeks_over, hours_over, round(hours_over * 10, 2) AS penalty FROM (
  SELECT scenario, count(*) FILTER (WHERE excess > 0) AS weeks_over, {_sum('excess')} AS hours_over
  FROM (SELECT scenario, greatest(0, total_hours - floor(total_cap * scale)) AS excess
        FROM overage, (VALUES ('tight', CAST(0.9 AS DOUBLE)), ('current', 1.0), ('loose', CAST(1.1 AS DOUBLE))) AS s(scenario, scale)) GROUP BY 1)""")

_q("dedupe_instances", "instances", f"""
SELECT relay_id, store_id, {_iso('original_wk_end_date')}, relay_hours, adjustment_group_id, request_type, {_iso('requested_move_wk')}, status
FROM instances""")
_cte("keyed", "grouped", """
SELECT relay_id || '_' || store_id || '_' || CAST(original_wk_end_date AS VARCHAR) AS instance_key, adjustment_group_id FROM grouped""")
_q("key_suffix", "keyed", """
SELECT instance_key, adjustment_group_id, counter,
       CASE WHEN counter = 0 THEN instance_key ELSE instance_key || '_' || counter END AS unique_key
FROM (SELECT *, row_number() OVER (PARTITION BY instance_key ORDER BY md5(instance_key || '|' || adjustment_group_id),
      instance_key || '|' || adjustment_group_id) - 1 AS counter FROM keyed)""")
_q("duplicate_keys", "keyed", "SELECT instance_key, count(*) AS n_rows FROM keyed GROUP BY 1 HAVING count(*) > 1")
_q("top_risk", "scored", f"""
SELECT relay_id, store_id, {_iso('wk_end_date')}, dept_cat, risk_score, total_cost
FROM (SELECT * FROM scored ORDER BY risk_score DESC, relay_id, store_id, wk_end_date LIMIT 10)""")
_q("top_stores", "store_perf", "SELECT * FROM store_perf ORDER BY total_cost DESC, store_id LIMIT 10")
# A pivot inside a view has to list its columns: the calendar of the test tables.
WEEKS = [dt.date(1995, 1, 8) + dt.timedelta(7 * i) for i in range(369)]
WEEK_LIST = ", ".join(f"'{w}'" for w in WEEKS)
MONTH_LIST = ", ".join(f"'{m}'" for m in sorted({f"{w:%Y-%m}" for w in WEEKS}))

_q("hours_heatmap", "placed cal", f"""
PIVOT (SELECT store_id, CAST(wk_end_date AS VARCHAR) AS week, relay_hours AS hours FROM placed
       UNION ALL SELECT store_id, CAST(wk_end_date AS VARCHAR), CAST(0 AS DOUBLE) FROM (SELECT DISTINCT store_id FROM placed), cal)
ON week IN ({WEEK_LIST}) USING sum(hours) GROUP BY store_id""")
_q("store_month_pivot", "store_month cal", f"""
PIVOT (SELECT store_id, month, total_cost FROM store_month
       UNION ALL SELECT store_id, strftime(wk_end_date, '%Y-%m'), CAST(0 AS DOUBLE) FROM (SELECT DISTINCT store_id FROM store_month), cal)
ON month IN ({MONTH_LIST}) USING sum(total_cost) GROUP BY store_id""")

_q("week_calendar", "cal", f"SELECT {_iso('wk_end_date')} FROM cal")
_q("holiday_calendar", "holidays", f"SELECT {_iso('wk_end_date')}, holiday_name, holiday_type, is_holiday FROM holidays")
_q("weekly_thresholds", "thresholds", f"SELECT * REPLACE ({_iso('wk_end_date')}) FROM thresholds")
_q("weekly_overage", "overage", f"SELECT * REPLACE ({_iso('wk_end_date')}) FROM overage")
_q("schedule_objective", "objectives", "SELECT * FROM objectives")
_q("assignment_violations", "placed requests", f"""
SELECT relay_id, store_id, {_iso('original_wk_end_date')}, assigned_weeks FROM (
  SELECT p.relay_id, p.store_id, p.original_wk_end_date, count(DISTINCT coalesce(q.requested_move_wk, p.original_wk_end_date)) AS assigned_weeks
  FROM placed p LEFT JOIN requests q USING (relay_id) GROUP BY 1, 2, 3) WHERE assigned_weeks <> 1""")
_q("cannot_move_violations", "instances", """
SELECT relay_id, store_id, CAST(original_wk_end_date AS VARCHAR) AS original_wk_end_date, CAST(requested_move_wk AS VARCHAR) AS suggested_wk_end_date
FROM instances WHERE status = 'Pending' AND requested_move_wk <> original_wk_end_date AND cannot_move""")
_q("group_sync_violations", "placed_bare member", f"SELECT * REPLACE ({_iso('wk_end_date')}) FROM ({_sync('placed_bare', 'original_wk_end_date')})")
_q("rebalance_bound", "objectives bound", """
SELECT objective, bound, round(objective - bound, 2) AS gap, round((objective - bound) * 100 / objective, 4) AS gap_pct
FROM objectives, bound WHERE schedule = 'Suggested'""")
_q("group_parts", "group_part", "SELECT * FROM group_part")
_q("synchronised_schedule", "sync_suggested", f"""
SELECT relay_id, store_id, {_iso('original_wk_end_date', 'suggested_wk_end_date')}, relay_hours FROM sync_suggested""")
_q("group_sync_after_plan", "sync_before sync_after sync_tied suggested sync_suggested member", "UNION ALL".join(f"""
SELECT '{label}' AS plan, (SELECT count(*) FROM sync_before) AS before, (SELECT count(*) FROM {after}) AS after, count(*) AS split_weeks
FROM (SELECT m.adjustment_group_id, original_wk_end_date FROM {plan} s JOIN member m ON m.relay_id = s.relay_id
      GROUP BY 1, 2 HAVING count(DISTINCT suggested_wk_end_date) > 1)
""" for label, after, plan in (("First group", "sync_after", "suggested"), ("Tied groups", "sync_tied", "sync_suggested"))))
_q("rebalance", "suggested", f"""
SELECT relay_id, store_id, {_iso('original_wk_end_date', 'suggested_wk_end_date')}, relay_hours, store_type, cannot_move FROM suggested""")
_q("fallback_schedule", "placed", """
SELECT relay_id, store_id, CAST(original_wk_end_date AS VARCHAR) AS original_wk_end_date,
       CAST(original_wk_end_date AS VARCHAR) AS suggested_wk_end_date, relay_hours, store_type, cannot_move FROM placed""")
_q("moved_relays", "moved", f"SELECT relay_id, store_id, store_type, relay_hours, {_iso('original_wk_end_date', 'suggested_wk_end_date')} FROM moved")
_q("moved_listing", "moved", f"""
SELECT relay_id, store_id, {_iso('original_wk_end_date', 'suggested_wk_end_date')}, relay_hours,
       row_number() OVER (ORDER BY moved.original_wk_end_date, relay_id, store_id) AS position FROM moved""")
_cte("report_weeks", "bounds suggested", """
SELECT CAST(unnest(generate_series(least(first_week, lo), greatest(last_week, hi) + 84, INTERVAL 7 DAY)) AS DATE) AS wk_end_date
FROM bounds, (SELECT min(suggested_wk_end_date) AS lo, max(suggested_wk_end_date) AS hi FROM suggested)""")
_q("report_thresholds", "report_weeks hweeks caps", """
SELECT CAST(wk_end_date AS VARCHAR) AS wk_end_date, coalesce(is_holiday, false) AS is_holiday,
       CASE WHEN is_holiday THEN total_cap_holiday ELSE total_cap END AS total_cap,
       CASE WHEN is_holiday THEN nm_cap_holiday ELSE nm_cap END AS nm_cap
FROM report_weeks LEFT JOIN hweeks USING (wk_end_date), caps""")
_q("request_compliance", "matched", f"""
SELECT request_type, requests, met, {_pct('met', 'requests')} AS compliance_pct
FROM (SELECT req_type AS request_type, count(*) AS requests, count(*) FILTER (WHERE matches_request) AS met
      FROM matched WHERE req_status = 'Pending' GROUP BY 1)""")
_q("compliance_summary", "suggested overage_after moved sync_after", """
SELECT 'weekly_hours' AS constraint_class, count(*) FILTER (WHERE total_over > 0) AS violations FROM overage_after
UNION ALL SELECT 'nm_weekly_hours', count(*) FILTER (WHERE nm_over > 0) FROM overage_after
UNION ALL SELECT 'assignment', count(*) FROM (SELECT 1 FROM suggested GROUP BY relay_id, store_id, original_wk_end_date
                                              HAVING count(DISTINCT suggested_wk_end_date) <> 1)
UNION ALL SELECT 'cannot_move', count(*) FROM moved WHERE cannot_move
UNION ALL SELECT 'group_sync', count(*) FROM sync_after""")
_q("dept_load", "placed", f"""
SELECT {_iso('wk_end_date')}, dept_cat, dept_hours, week_hours, {_pct('dept_hours', 'week_hours', 4)} AS share_pct
FROM (SELECT wk_end_date, dept_cat, {_sum('relay_hours')} AS dept_hours FROM placed GROUP BY 1, 2)
JOIN (SELECT wk_end_date, {_sum('relay_hours')} AS week_hours FROM placed GROUP BY 1) USING (wk_end_date)""")

_q("stream_counts", "", """
SELECT strftime(time_bucket(INTERVAL 5 MINUTE, ts), '%Y-%m-%d %H:%M:%S.%f') AS window_start, event_type, count(*) AS event_count
FROM events GROUP BY 1, 2""")
_q("stream_latest", "", """
SELECT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, event_id, event_type, value FROM events
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")

_cte("deliveries", "requests", """
SELECT *, unnest(CASE WHEN k % 17 = 0 THEN [span + 2] WHEN k % 10 = 0 THEN [span, span, span + 1] ELSE [span] END) AS delivery
FROM (SELECT *, CAST(substr(request_id, 5) AS BIGINT) AS k, CAST(year(request_ts) // 2 AS INTEGER) AS span FROM requests)""")
# What earlier deliveries have seen, less sixty days, is too late.
_cte("marks", "deliveries", """
SELECT delivery, max(max(request_ts)) OVER (ORDER BY delivery ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) - INTERVAL 60 DAY AS mark
FROM deliveries GROUP BY 1""")
_cte("arrivals", "deliveries marks", """
SELECT d.*, coalesce(request_ts <= mark, false) AS late,
       row_number() OVER (PARTITION BY request_id, coalesce(request_ts <= mark, false) ORDER BY d.delivery) AS nth
FROM deliveries d JOIN marks USING (delivery)""")
_q("stream_request_intake", "arrivals", """
SELECT delivery, count(*) AS arrived, count(*) FILTER (WHERE late) AS late, count(*) FILTER (WHERE NOT late AND nth > 1) AS repeated,
       count(*) FILTER (WHERE NOT late AND nth = 1) AS taken
FROM arrivals GROUP BY 1""")
_q("stream_requests", "arrivals bridge", """
SELECT request_type, status, count(*) AS requests, CAST(sum(coalesce(n_stores, 0)) AS BIGINT) AS stores,
       count(*) FILTER (WHERE w.relay_id IS NOT NULL) AS in_own_week
FROM (SELECT * FROM arrivals WHERE NOT late AND nth = 1) a
LEFT JOIN (SELECT relay_id, count(DISTINCT store_id) AS n_stores FROM bridge GROUP BY 1) b USING (relay_id)
LEFT JOIN (SELECT DISTINCT relay_id, wk_end_date FROM bridge) w ON w.relay_id = a.relay_id AND w.wk_end_date = a.requested_move_wk
GROUP BY 1, 2""")
