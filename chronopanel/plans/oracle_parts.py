"""Shared WITH clauses of the oracle queries (plain SQL over the given tables)."""

from __future__ import annotations

PARTS: dict[str, tuple[str, str]] = {}


def part(name: str, needs: str, sql: str) -> None:
    if name in PARTS:
        raise ValueError(f"duplicate part {name}")
    PARTS[name] = (needs, sql.strip())


def with_parts(names: list[str], body: str) -> str:
    order: list[str] = []

    def visit(name: str) -> None:
        if name in order:
            return
        for dependency in PARTS[name][0].split():
            visit(dependency)
        order.append(name)

    for name in names:
        visit(name)
    if not order:
        return body
    clauses = ",\n".join(f"{n} AS {'' if 'FROM ' + n + ' ' in PARTS[n][1] else 'MATERIALIZED '}(\n{PARTS[n][1]}\n)" for n in order)
    return f"WITH RECURSIVE {clauses}\n{body}"


def _bars(line_filter: str) -> str:
    return f"""
SELECT symbol, sector, asset_type, session,
       (min(packed) % 100000) / 100.0 * mult AS open, max(cents) / 100.0 * mult AS high,
       min(cents) / 100.0 * mult AS low, (max(packed) % 100000) / 100.0 * mult AS close,
       sum(l_quantity) AS volume, (max(packed) % 100000) / 100.0 AS adjusted_close,
       CASE WHEN day(session) = 15 AND month(session) % 3 = 0 THEN 0.25 ELSE 0.0 END AS dividend,
       CASE WHEN nationkey % 5 = 0 AND session = DATE '1998-06-01' THEN 2.0 ELSE 1.0 END AS split_factor
FROM (SELECT n_name AS symbol, 'S' || n_regionkey AS sector, n_nationkey AS nationkey,
             CASE WHEN n_nationkey % 7 = 0 THEN 'etf' ELSE 'equity' END AS asset_type,
             CAST(l_shipdate AS DATE) AS session, l_quantity, cents,
             (l_orderkey * 8 + l_linenumber) * 100000 + cents AS packed,
             CASE WHEN n_nationkey % 5 = 0 AND CAST(l_shipdate AS DATE) < DATE '1998-06-01' THEN 2.0 ELSE 1.0 END AS mult
      FROM (SELECT *, CAST(round(10000.0 * power(l_extendedprice / l_quantity / 1000.0, 0.05)) AS BIGINT) AS cents
            FROM lineitem WHERE l_quantity > 0 AND isodow(l_shipdate) <= 5 {line_filter})
      JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey)
GROUP BY symbol, sector, asset_type, nationkey, session, mult"""


part("bars", "", _bars(""))
part("bars_b", "", _bars("AND l_linenumber % 2 = 0"))
part("cal", "bars", "SELECT session, row_number() OVER (ORDER BY session) AS pos FROM (SELECT DISTINCT session FROM bars)")
part("syms", "bars", "SELECT DISTINCT symbol, sector, asset_type FROM bars")
# Dense panel: every symbol on every observed session; shifts count sessions, not a symbol's own rows.
part("grid", "cal syms bars", """
SELECT s.symbol, s.sector, s.asset_type, c.session, c.pos, b.open, b.high, b.low, b.close, b.volume,
       b.adjusted_close AS px, b.adjusted_close / b.close * b.open AS open_adj,
       b.adjusted_close / b.close * b.high AS high_adj, b.adjusted_close / b.close * b.low AS low_adj, b.dividend, b.split_factor
FROM syms s CROSS JOIN cal c LEFT JOIN bars b ON b.symbol = s.symbol AND b.session = c.session""")
part("rets", "grid", """
SELECT *, px / lag(px) OVER w - 1 AS ret, lag(px) OVER w AS px1, lag(close) OVER w AS close1
FROM grid WINDOW w AS (PARTITION BY symbol ORDER BY pos)""")
part("civil", "cal", """
SELECT d.day, c.session, c.pos, max(c.session) OVER (ORDER BY d.day ROWS UNBOUNDED PRECEDING) AS on_or_before,
  max(c.session) OVER (ORDER BY d.day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  min(c.session) OVER (ORDER BY d.day ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS on_or_after,
  min(c.session) OVER (ORDER BY d.day ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS after
FROM (SELECT CAST(unnest(generate_series((SELECT min(session) FROM cal) - INTERVAL 70 DAY, (SELECT max(session) FROM cal) + INTERVAL 70 DAY, INTERVAL 1 DAY)) AS DATE) AS day) d
LEFT JOIN cal c ON c.session = d.day""")
part("event_days", "", """
SELECT DISTINCT CAST(o_orderdate AS DATE) AS event_day FROM orders WHERE o_orderpriority = '1-URGENT' AND o_totalprice > 490000""")
part("holidays", "cal", """
SELECT CAST(y || '-' || md AS DATE) AS holiday FROM (SELECT DISTINCT year(session) AS y FROM cal) CROSS JOIN (VALUES ('01-01'),('07-04'),('12-25')) t(md)""")
part("third_fri", "cal", """
SELECT CAST(m + INTERVAL (((5 - isodow(m) + 7) % 7) + 14) DAY AS DATE) AS nominal FROM (SELECT DISTINCT date_trunc('month', session) AS m FROM cal)""")
part("flags", "cal event_days holidays third_fri", """
SELECT session, pos, isodow(session)-1 AS weekday, month(session) AS month,
 row_number() OVER (PARTITION BY date_trunc('month',session) ORDER BY session)-1 AS session_of_month,
 row_number() OVER (PARTITION BY date_trunc('month',session) ORDER BY session DESC)-1 AS to_month_end,
 row_number() OVER (PARTITION BY date_trunc('quarter',session) ORDER BY session DESC)-1 AS to_quarter_end,
 row_number() OVER (PARTITION BY date_trunc('month',session) ORDER BY session DESC) <= 5 AS month_end_window,
 row_number() OVER (PARTITION BY date_trunc('quarter',session) ORDER BY session DESC) <= 5 AS quarter_end_window,
 row_number() OVER (PARTITION BY date_trunc('month',session) ORDER BY session) <= 3
   OR row_number() OVER (PARTITION BY date_trunc('month',session) ORDER BY session DESC) = 1 AS turn_of_month,
 EXISTS (SELECT 1 FROM holidays h WHERE h.holiday > c.session AND NOT EXISTS (SELECT 1 FROM cal d WHERE d.session > c.session AND d.session < h.holiday)) AS pre_holiday,
 EXISTS (SELECT 1 FROM holidays h WHERE h.holiday < c.session AND NOT EXISTS (SELECT 1 FROM cal d WHERE d.session < c.session AND d.session > h.holiday)) AS post_holiday,
 EXISTS (SELECT 1 FROM event_days e WHERE e.event_day > c.session AND NOT EXISTS (SELECT 1 FROM cal d WHERE d.session > c.session AND d.session < e.event_day)
   AND e.event_day <= (SELECT max(session) FROM cal) + INTERVAL 70 DAY) AS event_day_before,
 session IN (SELECT event_day FROM event_days) AS event_day_of,
 isoyear(session)*100+week(session) IN (SELECT isoyear(event_day)*100+week(event_day) FROM event_days) AS event_week,
 isoyear(session)*100+week(session) IN (SELECT isoyear(nominal)*100+week(nominal) FROM third_fri) AS opex_week
FROM cal c""")
part("anns", "", """
SELECT o_orderkey AS event_id, n_name AS symbol, CAST(o_orderdate AS DATE) AS event_day,
 CASE o_orderpriority[1] WHEN '1' THEN 'EARNINGS' WHEN '2' THEN 'GUIDANCE_NEGATIVE' WHEN '3' THEN 'HALT' ELSE 'OTHER' END AS kind,
 o_totalprice AS value, CAST(o_orderdate AS DATE) + 1 AS available_day,
 CASE WHEN o_orderpriority[1] = '3' THEN CAST(o_orderdate AS DATE) + 3 END AS ended_day
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 440000""")
part("members", "bars", """
WITH s AS (SELECT symbol, CAST(substring(symbol,8) AS INTEGER) AS k, min(session) AS first FROM bars GROUP BY symbol),
 a AS (SELECT symbol, k, first + k*20 AS start, first + k*20 + 700 + k*13 AS "end" FROM s)
SELECT symbol, start, "end" FROM a UNION ALL
SELECT symbol, "end" + 100, CASE WHEN k % 3 <> 0 THEN "end" + 1000 END FROM a""")
part("venue", "bars", "SELECT session, row_number() OVER (ORDER BY session) AS pos FROM bars WHERE symbol = 'NATION_1'")
