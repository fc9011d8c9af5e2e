"""Streams, ledgers and paper positions."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import clock
from ..operators import paper as PA
from ..sources import panel as P
from ..sources.ticks import ticks
from ..streaming import runs as RN
from ..streaming import stateful as ST
from .catalog import query
from .joins import fills_with_exits, ledger
from .oracle_parts import part


@query("STR-02", "#user_id session", sql="SELECT DISTINCT user_id, CAST(ts AS DATE) AS session FROM events")
def captured_signals(spark, sf):
    x = RN.first_capture(RN.tick_stream(spark, sf), ["user_id", "session"], RN.lateness(spark, sf))
    return RN.drain(x.select("user_id", "session"), "captured")


MARKS = "SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS rec, event_id, ts, value AS price, event_id AS arrival FROM events WHERE event_type = 'click'"


def marks(t):
    return t.where("symbol = 'click'").select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("recommendation_id"), "event_id",
                                              F.col("ts").alias("at"), "price", F.col("event_id").alias("arrival"))


MARK_SQL = f"""
SELECT rec AS recommendation_id, event_id, accepted, min(CASE WHEN accepted THEN price END) OVER w AS low, max(CASE WHEN accepted THEN price END) OVER w AS high FROM (
SELECT *, coalesce(ts > max(ts) OVER (PARTITION BY rec ORDER BY arrival ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM ({MARKS})) WINDOW w AS (PARTITION BY rec ORDER BY arrival)"""


@query("STR-03", "recommendation_id #event_id accepted ~low ~high", sql=MARK_SQL)
def marks_batch(spark, sf):
    return PA.accepted_marks(marks(ticks(spark, sf)))


@query("STR-03 STR-04", "recommendation_id #event_id accepted ~low ~high", sql=MARK_SQL)
def marks_stream(spark, sf):
    return RN.drain_in_order(spark, sf, marks, "marks", fold=ST.MARKS)


STATES = {"view": "WAITING", "click": "CONFIRMED", "signup": "UPDATED", "purchase": "ENTERED", "error": "EXITED"}


@query("STR-06", "recommendation_id #event_id to_state accepted state #revision", sql="""
WITH RECURSIVE e AS (SELECT user_id || '-' || strftime(ts, '%Y%m%d') AS rec, event_id, CASE event_type WHEN 'view' THEN 'WAITING' WHEN 'click' THEN 'CONFIRMED' WHEN 'signup' THEN 'UPDATED' WHEN 'purchase' THEN 'ENTERED' ELSE 'EXITED' END AS s, CASE WHEN event_id % 3 = 0 THEN event_id % 2 END AS expected, row_number() OVER (PARTITION BY user_id, CAST(ts AS DATE) ORDER BY event_id) AS i FROM events),
 r AS (SELECT rec, CAST(NULL AS BIGINT) AS event_id, '' AS s, false AS ok, 'PROPOSED' AS state, 0 AS rev, CAST(0 AS BIGINT) AS i FROM (SELECT DISTINCT rec FROM e) UNION ALL
 SELECT e.rec, e.event_id, e.s, k.ok, CASE WHEN k.ok THEN e.s ELSE r.state END, r.rev + CASE WHEN k.ok THEN 1 ELSE 0 END, e.i FROM r JOIN e ON e.rec = r.rec AND e.i = r.i + 1,
  LATERAL (SELECT (r.state || '>' || e.s) IN ('PROPOSED>WAITING','PROPOSED>CONFIRMED','PROPOSED>CANCELLED','WAITING>CONFIRMED','WAITING>UPDATED','WAITING>CANCELLED','UPDATED>WAITING','UPDATED>CONFIRMED','UPDATED>CANCELLED','CONFIRMED>UPDATED','CONFIRMED>CANCELLED','CONFIRMED>ENTERED','ENTERED>EXITED') AND coalesce(e.expected = r.rev, true) AS ok) k)
SELECT rec AS recommendation_id, event_id, s AS to_state, ok AS accepted, state, rev AS revision FROM r WHERE i > 0""")
def state_machine(spark, sf):
    """Every third change expects a revision (0 or 1, by its id), as an operator's form would that was opened before."""
    to = F.create_map(*[F.lit(v) for kv in STATES.items() for v in kv])

    def changes(t):
        expected = F.when(F.col("event_id") % 3 == 0, F.col("event_id") % 2).cast("int").alias("expected")
        return t.select(F.concat_ws("-", F.col("user_id").cast("string"), F.date_format("ts", "yyyyMMdd")).alias("recommendation_id"), "event_id", to[F.col("symbol")].alias("to_state"), expected)

    return RN.drain_in_order(spark, sf, changes, "transitions", fold=ST.CHANGES)


@query("STR-09 SRC-20", "symbol minute ~open ~high ~low ~close ~volume ~vwap", sql="""
SELECT event_type AS symbol, strftime(m, '%Y-%m-%d %H:%M:%S') AS minute, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, sum(k) AS volume, sum(value*k)/nullif(sum(k),0) AS vwap FROM (
SELECT *, date_trunc('minute', ts) AS m, CAST(json_extract(props,'$.k') AS DOUBLE) AS k FROM events) GROUP BY event_type, m""")
def streamed_minute_bars(spark, sf):
    x = RN.minute_bars(RN.tick_stream(spark, sf), RN.lateness(spark, sf))
    return RN.drain_updates(x, "minute-bars", ["symbol", "ts"]).withColumn("minute", clock.stamp("ts"))


@query("STR-10", "#event_id #quote_id ~quote_price", sql="""
SELECT event_id, quote_id, quote_price FROM (SELECT s.event_id, q.event_id AS quote_id, q.value AS quote_price, row_number() OVER (PARTITION BY s.event_id ORDER BY q.ts DESC, q.event_id DESC) AS r
FROM events s JOIN events q ON q.user_id = s.user_id AND q.event_type = 'view' AND s.event_type = 'purchase' AND q.ts <= s.ts AND q.ts >= s.ts - INTERVAL 30 MINUTE) WHERE r = 1""")
def fresh_quote_pairs(spark, sf):
    late = RN.lateness(spark, sf)
    s = RN.tick_stream(spark, sf).where("symbol = 'purchase'").select("event_id", "user_id", F.col("ts").alias("signal_at"))
    q = RN.tick_stream(spark, sf).where("symbol = 'view'").select(F.col("event_id").alias("quote_id"), F.col("user_id").alias("quote_user"), F.col("ts").alias("quote_at"), F.col("price").alias("quote_price"))
    return RN.newest_quotes(RN.drain(RN.fresh_quotes(s, q, late), "fresh-quotes"))


LEVERAGES, HORIZONS = (1.0, 1.5, 2.0), (21, 252)


@query("STR-11", "run #event_id ~leverage #horizon kind", sql="""
WITH t AS (SELECT strftime(ts, '%Y-%m-%d-%H') AS run, event_id, CASE WHEN hour(ts) % 5 = 4 THEN 3.0 ELSE 1.0 + (hour(ts) % 3) * 0.5 END AS leverage, CASE hour(ts) % 4 WHEN 3 THEN 63 WHEN 0 THEN 21 ELSE 252 END AS horizon, CASE WHEN user_id % 3 = 0 THEN 'SKIP' ELSE 'CANDIDATE' END AS kind FROM events WHERE event_type = 'signup')
SELECT run, event_id, leverage, horizon, kind FROM t WHERE leverage IN (1.0, 1.5, 2.0) AND horizon IN (21, 252)""")
def inserted_runs(spark, sf):
    """A run's terms follow its hour; hours that give leverage 3 or horizon 63 make runs that are refused."""
    hour = F.hour("ts")

    def decisions(t):
        t = t.where("symbol = 'signup'")
        return t.select(F.date_format("ts", "yyyy-MM-dd-HH").alias("run"), "event_id", F.when(hour % 5 == 4, 3.0).otherwise(1.0 + (hour % 3) * 0.5).alias("leverage"),
                        F.when(hour % 4 == 3, 63).when(hour % 4 == 0, 21).otherwise(252).alias("horizon"), F.when(F.col("user_id") % 3 == 0, "SKIP").otherwise("CANDIDATE").alias("kind"))

    return RN.insert_new_runs(decisions(RN.whole_runs(spark, sf)), "run", ["leverage", "horizon"], {"leverage": LEVERAGES, "horizon": HORIZONS}, "runs")


@query("STR-12", "#event_id", sql="SELECT event_id FROM events e WHERE event_type = 'error' AND NOT EXISTS (SELECT 1 FROM events k WHERE k.event_id = e.event_id AND k.event_type = 'error' AND k.ts < TIMESTAMP '2024-01-05')")
def new_announcements(spark, sf):
    """Incoming filings whose own number is not among those already held."""
    known = ticks(spark, sf).where("symbol = 'error' and ts < '2024-01-05'").select("event_id").distinct()
    s = RN.tick_stream(spark, sf).where("symbol = 'error'").join(known, "event_id", "left_anti").select("event_id")
    return RN.drain(s, "new-announcements")


@query("FLT-13", "#event_id verdict", sql="""
WITH q AS (SELECT user_id, arg_max(value, (ts, event_id)) AS price, max(ts) AS at, arg_max(event_type, (ts, event_id)) = 'error' AS halted FROM events WHERE event_type IN ('view','error') GROUP BY user_id)
SELECT e.event_id, CASE WHEN q.price IS NULL THEN 'NO_QUOTE' WHEN q.price <= 0 THEN 'BAD_PRICE' WHEN age < 0 THEN 'FUTURE_QUOTE' WHEN age > 1800 THEN 'STALE_QUOTE' WHEN q.halted THEN 'HALTED' WHEN e.user_id % 3 = 0 THEN 'REGIME_OFF'
 WHEN abs(q.price-e.value) > 20 THEN 'MOVED_TOO_FAR' WHEN abs(q.price-e.value) > 5 THEN 'ADJUST_LIMIT' ELSE 'CONFIRMED' END AS verdict
FROM (SELECT * FROM events WHERE event_type = 'purchase') e LEFT JOIN q ON q.user_id = e.user_id, LATERAL (SELECT epoch(TIMESTAMP '2024-01-30 12:00:00') - floor(epoch(q.at)) AS age) a""")
def revalidated_plans(spark, sf):
    q = ticks(spark, sf).where("symbol in ('view', 'error')").groupBy("user_id").agg(
        F.max_by("price", F.struct("ts", "event_id")).alias("q"), F.max("ts").alias("quote_at"), (F.max_by("symbol", F.struct("ts", "event_id")) == "error").alias("halted"))
    plans = RN.tick_stream(spark, sf).where("symbol = 'purchase'").select("event_id", "user_id", F.col("price").alias("plan"))
    age = F.unix_timestamp(F.lit("2024-01-30 12:00:00").cast("timestamp")) - F.unix_timestamp("quote_at")
    x = plans.join(q, "user_id", "left")
    v = PA.revalidation(F.col("q"), F.col("plan"), age, F.col("halted"), F.col("user_id") % 3 != 0, F.lit(10.0))
    return RN.drain(x.select("event_id", v.alias("verdict")), "plans")


@query("STR-04", "recommendation_id #event_id ~mae ~mfe", parts="ledger", sql="""
WITH f AS (SELECT rec, arg_min(price, (ts, event_id)) AS fill FROM ledger WHERE event = 'FILL' GROUP BY rec)
SELECT rec AS recommendation_id, event_id, least(0, min(m) OVER w) AS mae, greatest(0, max(m) OVER w) AS mfe FROM (SELECT l.rec, l.event_id, l.ts, CASE WHEN CAST(split_part(l.rec,'-',1) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END*(l.price/f.fill-1) AS m FROM ledger l JOIN f USING (rec) WHERE l.event = 'MARK')
WINDOW w AS (PARTITION BY rec ORDER BY ts, event_id)""")
def running_excursions(spark, sf):
    led = ledger(spark, sf)
    entry = led.where("event = 'FILL'").groupBy("recommendation_id").agg(F.min_by("price", clock.arrival_key("at", "event_id")).alias("fill"))
    side = F.when(F.substring_index("recommendation_id", "-", 1).cast("bigint") % 2 == 0, "LONG").otherwise("SHORT")
    return PA.excursions(led.where("event = 'MARK'"), entry.withColumn("direction", side))


@query("STR-05", "recommendation_id ~ret ~net", parts="ledger", sql="""
WITH f AS (SELECT rec, arg_min(price, (ts, event_id)) AS fill, min(ts) AS at FROM ledger WHERE event = 'FILL' GROUP BY rec),
 m AS (SELECT rec, max(ts) AS seen FROM ledger WHERE event = 'MARK' GROUP BY rec)
SELECT x.rec AS recommendation_id, e/fill-1 AS ret, e/fill-1-0.001 AS net FROM (SELECT f.rec, any_value(f.fill) AS fill, arg_min(price, (ts, event_id)) AS e, min(ts) AS out FROM f JOIN ledger l ON l.rec = f.rec AND l.event = 'EXIT' AND l.ts > f.at GROUP BY f.rec) x LEFT JOIN m ON m.rec = x.rec WHERE seen IS NULL OR out >= seen""")
def immutable_outcomes(spark, sf):
    """Outcomes of recommendations that were not seen again after their exit."""
    from .joins import ledger

    seen = ledger(spark, sf).where("event = 'MARK'").groupBy("recommendation_id").agg(F.max("at").alias("seen_at"))
    return PA.outcomes(fills_with_exits(spark, sf), last_seen=seen)


@query("STR-07", "decision symbol ~fill ~exit_price reason", parts="grid cal", sql="""
WITH d AS (SELECT symbol || '@' || pos AS decision, symbol, pos+1 AS e, pos+11 AS x, px*0.9 AS stop FROM grid WHERE px IS NOT NULL AND session IN (SELECT max(session) FROM cal GROUP BY date_trunc('month', session))),
 j AS (SELECT d.*, g.pos, g.open_adj, g.low_adj, g.px FROM d JOIN grid g ON g.symbol = d.symbol AND g.pos BETWEEN d.e AND d.x AND g.px IS NOT NULL),
 a AS (SELECT decision, symbol, any_value(stop) AS stop, max(open_adj) FILTER (pos = e) AS fill, min(pos) FILTER (low_adj <= stop) AS b, arg_min(open_adj, pos) FILTER (low_adj <= stop) AS bo, max(px) FILTER (pos = x) AS sch FROM j GROUP BY decision, symbol)
SELECT decision, symbol, fill, CASE WHEN b IS NOT NULL THEN least(stop*(1-0.0015), bo) ELSE sch END AS exit_price, CASE WHEN b IS NOT NULL THEN 'STOP' WHEN sch IS NOT NULL THEN 'SCHEDULED' ELSE 'OPEN' END AS reason FROM a WHERE fill IS NOT NULL""")
def reconciled_positions(spark, sf):
    from ..operators.crosssec import month_end_rows

    d = month_end_rows(P.placed(spark, sf), P.calendar(spark, sf)).select(
        F.concat_ws("@", "symbol", F.col("pos").cast("string")).alias("decision"), "symbol", (F.col("pos") + 1).alias("entry_pos"), (F.col("pos") + 11).alias("exit_pos"), (F.col("px") * 0.9).alias("stop"))
    return PA.reconcile(d, P.placed(spark, sf))


@query("STR-08", "lane ~equity ~peak terminated", parts="", sql="""
WITH m AS (SELECT 'lane' || user_id % 5 AS lane, ts, event_id, value*10 + 500 AS equity FROM events WHERE event_type = 'click'), x AS (SELECT *, max(equity) OVER (PARTITION BY lane ORDER BY ts, event_id) AS peak FROM m)
SELECT lane, arg_max(equity, (ts, event_id)) AS equity, max(peak) AS peak, bool_or(equity/peak-1 <= -0.3 OR equity <= 0) AS terminated FROM x GROUP BY lane""")
def lane_states(spark, sf):
    m = ledger(spark, sf).where("event = 'MARK'").withColumn("equity", F.col("price") * 10 + 500)
    return PA.lanes(m)
