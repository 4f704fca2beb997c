"""Queries over signals, selection, execution and performance, each with the same in SQL.

Windows count hourly bars and floors fit them; results say nothing about markets. The protocol's own numbers are in the
unit tests.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import execution, inference, performance, signals, windows
from ..sources.staging import staged
from .catalog import _BY, _G, _TS, grid, query, rounded
from .catalog import stored as tape

#: The rule of the entry signals, in hourly bars.
RULE = {
    "w": 8, "long": 24, "deep": 72, "day": 24, "ttl": 48, "refs": 5, "median": 5000.0, "quote": 60000.0, "trades": 20, "step": 1.05,
    "t3_gain": 1.0, "t3_clock": 1.1, "t4_gain": 0.5, "t4_clock": 1.1, "t5_gain": 1.5, "t5_position": 0.75, "t5_runup": 8.0, "t5_drawdown": -4.0,
    "rise": 20.75, "long_clock": 1.02,
}
#: The rule of the late momentum signal.
FLOORS, LATE_REFS, LATE_LEAST, LATE_SHORT = {"gain": 2.0, "clock": 1.3, "position": 0.6, "quote": 10000.0, "runup": 3.3}, 5, 3, 2
HOUR = 3600
QUOTE, ENTRY, HOLD, EXIT = 20000.0, 6, 48, 12


def _whole(column: str, w: int, how: str = "sum") -> str:
    f = f"({_BY} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return f"CASE WHEN count({column}) OVER {f} = {w} THEN {how}({column}) OVER {f} END"


def _days_before(column: str) -> str:
    return f"list_filter([{', '.join(f'lag({column}, {24 * d}) OVER ({_BY})' for d in range(1, 8))}], lambda x: x IS NOT NULL)"


def _seen(w: int) -> str:
    return f"coalesce(sum(observed::INT) OVER ({_BY} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW) = {w}, false)"


_LIQUID = "ROWS BETWEEN 7 PRECEDING AND CURRENT ROW"


@query("o82_liquidity", f"""WITH {_G}, me AS (
    SELECT *, sum(observed::INT) OVER w AS o, quantile_cont(quote_volume, 0.5) OVER w AS m, sum(quote_volume) OVER w AS q,
    sum(trade_count) OVER w AS n FROM gr
    WINDOW w AS ({_BY} {_LIQUID}))
  SELECT symbol, {_TS.format('open_time')} AS open_time, coalesce(o = 8 AND m >= 5000 AND q >= 60000 AND n >= 20, false) AS liquid FROM me""")
def o82(spark, sf):
    return rounded(signals.liquidity_gate(grid(spark, sf), 8, 5000, 60000, 20).select("symbol", "open_time", "liquid"))


_TLAGS = ", ".join(f"lag(t8, {24 * d}) OVER ({_BY})" for d in range(1, 8))


@query("o83_acceleration", f"""WITH {_G}, s AS (
    SELECT symbol, open_time, close, lag(close, 8) OVER ({_BY}) AS c8, {_whole('trade_count::DOUBLE', 8)} AS t8,
    {_whole('trade_count::DOUBLE', 4)} AS t4 FROM gr),
  e AS (SELECT *, list_filter([{_TLAGS}], lambda x: x IS NOT NULL) AS e FROM s)
  SELECT symbol, {_TS.format('open_time')} AS open_time,
         coalesce((close / c8 - 1) * 100 >= 1 AND t4 >= 1.05 * nullif(t8 - t4, 0) AND t8 / nullif(list_median(e), 0) >= 1.1 AND len(e) >= 5,
    false) AS accelerating FROM e""")
def o83(spark, sf):
    return rounded(signals.acceleration(grid(spark, sf), 8, 24, 1.0, 1.05, 1.1, 5).select("symbol", "open_time", "accelerating"))


# Entry signals: arms, confirmations, edges


_ES = _G + f""", s AS (
  SELECT symbol, open_time, close, quote_volume, trade_count::DOUBLE AS tc, observed, row_number() OVER ({_BY}) AS i, lag(close,
    8) OVER ({_BY}) AS c8,
         {_whole('quote_volume', 8)} AS q, {_whole('quote_volume', 4)} AS ql, {_whole('trade_count::DOUBLE', 8)} AS t,
    {_whole('trade_count::DOUBLE', 4)} AS tl,
         {_whole('low', 8, 'min')} AS l8, {_whole('high', 8, 'max')} AS h8, {_whole('quote_volume', 24)} AS q24,
    (close / ({_whole('low', 72, 'min')}) - 1) * 100 AS rise,
         {_seen(8)} AS o8, {_seen(24)} AS o24, {_seen(72)} AS o72, quantile_cont(quote_volume, 0.5) OVER ({_BY} {_LIQUID}) AS med FROM gr
), e AS (SELECT *, {_days_before('q')} AS eq, {_days_before('t')} AS et, {_days_before('q24')} AS el FROM s
), r AS (
  SELECT *, q / nullif(list_median(eq), 0) AS qr, t / nullif(list_median(et), 0) AS tr_, q24 / nullif(list_median(el), 0) AS lr,
    (close / c8 - 1) * 100 AS ret,
         (close - l8) / nullif(h8 - l8, 0) AS pos, ql / nullif(q - ql, 0) AS qs, tl / nullif(t - tl, 0) AS ts_ FROM e
), a AS (
  SELECT *, coalesce(o8 AND med >= 5000 AND q >= 60000 AND t >= 20, false) AS liquid, coalesce(o72 AND rise >= 20.75 AND lr >= 1.02 AND len(el) >= 5,
    false) AS armed,
         coalesce(ret >= 1 AND tl >= 1.05 * nullif(t - tl, 0) AND tr_ >= 1.1 AND len(et) >= 5, false) AS t3,
         coalesce(ret >= 0.5 AND qr >= 1.1 AND ql >= 1.05 * nullif(q - ql, 0) AND len(eq) >= 5, false) AS t4, coalesce(ret >= 1.5 AND pos >= 0.75
    AND o24, false) AS asked FROM r
), pt AS (
  SELECT a.symbol, a.open_time, b.close / min(b.close) OVER p - 1 AS up, b.close / max(b.close) OVER p - 1 AS dn
  FROM a JOIN a b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 23 AND a.i WHERE a.asked WINDOW p AS (PARTITION BY a.symbol, a.open_time ORDER BY b.i)
), x AS (SELECT symbol, open_time, max(up) * 100 AS runup, min(dn) * 100 AS drawdown FROM pt GROUP BY 1, 2
), f AS (SELECT a.*, runup, drawdown, coalesce(runup >= 8 AND drawdown <= -4, false) AS t5 FROM a LEFT JOIN x USING (symbol, open_time)
), g AS (
  SELECT *, t3::INT + t4::INT + t5::INT AS components, liquid AND (t3 OR t4 OR t5) AS e1,
         coalesce(bool_or(armed) OVER ({_BY} ROWS BETWEEN 48 PRECEDING AND 1 PRECEDING), false) AS armed_recent, coalesce(round(greatest(qr, tr_), 6),
    0) AS activity FROM f
), es AS (
  SELECT *, e1 AND NOT lag(e1, 1, false) OVER ({_BY}) AS e1_edge, (e1 AND armed_recent) AND NOT lag(e1 AND armed_recent, 1,
    false) OVER ({_BY}) AS e2_edge FROM g
)"""


def _entry_signals(spark, sf) -> DataFrame:
    rows = windows.in_time_chunks(grid(spark, sf), lambda g: signals.entry_signals(g, RULE), signals.entry_reach(RULE), HOUR)
    return rows.withColumn("activity", F.round("activity", 6))


@query("o84_o85_entry_signals", f"""WITH {_ES} SELECT symbol, {_TS.format('open_time')} AS open_time, liquid, t3, t4, t5,
    components::INT AS components, e1_edge, e2_edge FROM es""")
def o84(spark, sf):
    return rounded(_entry_signals(spark, sf).select("symbol", "open_time", "liquid", "t3", "t4", "t5", "components", "e1_edge", "e2_edge"))


@query("o86_o87_armed_edges", f"""WITH {_ES} SELECT symbol, {_TS.format('open_time')} AS open_time, armed, armed_recent, armed AND NOT lag(armed, 1,
    false) OVER ({_BY}) AS edge,
  round(rise, 4) AS rise_from_low, round(lr, 4) AS long_ratio FROM es""")
def o86(spark, sf):
    rows = signals.armed_recently(grid(spark, sf), 72, 20.75, 24, 24, 1.02, 5, 48).withColumn("edge", signals.rising_edge(F.col("armed")))
    return rounded(rows.select("symbol", "open_time", "armed", "armed_recent", "edge", "rise_from_low", "long_ratio"), 4)


_CANDIDATE = (
    "e1_edge", "e2_edge", "armed_recent", "components", "t3", "t4", "t5", "return_w", "q", "q_ratio", "t", "t_ratio", "q_step", "t_step", "position", "runup",
    "drawdown", "rise_from_low", "long_ratio", "activity",
)


def entry_candidates(spark, sf) -> DataFrame:
    """The candidates of both signals, written once, for later steps ask for them several times."""
    rows = signals.candidates(_entry_signals(spark, sf), F.col("e1_edge") | F.col("e2_edge"), "1 hour", *_CANDIDATE)
    return staged(rows.withColumn("order_id", F.concat("symbol", F.lit("@"), F.unix_seconds("signal_bar").cast("string"))), "candidates")


_EC = _ES + f""", ca AS (
  SELECT symbol, open_time AS signal_bar, open_time + INTERVAL 1 HOUR AS decision_time, close AS signal_close, e1_edge, e2_edge, armed_recent,
    components::INT AS components, t3, t4, t5,
         ret AS return_w, q, qr AS q_ratio, t, tr_ AS t_ratio, qs AS q_step, ts_ AS t_step, pos AS position, runup, drawdown, rise AS rise_from_low,
    lr AS long_ratio, activity,
         symbol || '@' || epoch(open_time)::BIGINT AS order_id FROM es WHERE e1_edge OR e2_edge)"""
_ROUND = ("return_w", "q", "q_ratio", "t", "t_ratio", "q_step", "t_step", "position", "runup", "drawdown", "rise_from_low", "long_ratio", "activity", "signal_close")


@query("o88_entry_candidates", f"""WITH {_EC} SELECT symbol, {_TS.format('signal_bar')} AS signal_bar, {_TS.format('decision_time')} AS decision_time,
    order_id, e1_edge, e2_edge, armed_recent,
  components, t3, t4, t5, {', '.join(f'round({c}, 4) AS {c}' for c in _ROUND)} FROM ca""")
def o88(spark, sf):
    return rounded(entry_candidates(spark, sf), 4)


# Late momentum


_LM = _G + f""", s AS (
  SELECT *, row_number() OVER ({_BY}) AS i, lag(close, 4) OVER ({_BY}) AS c4, {_whole('quote_volume', 4)} AS q4, {_whole('quote_volume', 2)} AS q2,
         CASE WHEN count(high) OVER d >= 24 * 1430 / 1440.0 THEN min(low) OVER d END AS l, CASE
    WHEN count(high) OVER d >= 24 * 1430 / 1440.0 THEN max(high) OVER d END AS h,
         CASE WHEN count(close) OVER ({_BY} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW) = 4 THEN
           greatest({', '.join(f'lag(close, {a}) OVER ({_BY}) / lag(close, {b}) OVER ({_BY})' for b in range(4) for a in range(b + 1))}) END AS up
  FROM gr WINDOW d AS ({_BY} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)
), e AS (SELECT *, {_days_before('q4')} AS e FROM s
), m AS (SELECT *, (close / c4 - 1) * 100 AS ret, q4 / nullif(list_median(e), 0) AS clock, len(e) AS days, CASE
    WHEN h > l THEN (close - l) / (h - l) END AS pos, (up - 1) * 100 AS runup FROM e
), p AS (SELECT *, coalesce(ret >= 2, false) AS return_pass, coalesce(clock >= 1.3 AND days >= 5, false) AS volume_pass, coalesce(pos >= 0.6,
    false) AS range_pass, coalesce(runup >= 3.3, false) AS runup_pass FROM m
), la AS (SELECT *, return_pass::INT + volume_pass::INT + range_pass::INT + runup_pass::INT AS components FROM p
), ca AS (
  SELECT symbol, open_time AS signal_bar, open_time + INTERVAL 1 HOUR AS decision_time, close AS signal_close, components::INT AS components,
    ret AS return_w, clock AS clock_ratio, days::INT AS clock_days,
         pos AS position, runup, q2 AS quote_short, return_pass, volume_pass, range_pass, runup_pass, coalesce(round(clock, 6), 0) AS activity,
    symbol || '@' || epoch(open_time)::BIGINT AS order_id
  FROM la WHERE coalesce(components >= 3 AND observed AND q2 >= 10000, false))"""


def late_candidates(spark, sf) -> DataFrame:
    """Every bar that triggers: the late signal is a level, and the selection suppresses what follows too closely."""
    rows = signals.late_momentum(grid(spark, sf), 4, 24, FLOORS, LATE_REFS, LATE_LEAST, LATE_SHORT)
    columns = ("components", "return_w", "clock_ratio", "clock_days", "position", "runup", "quote_short", "return_pass", "volume_pass", "range_pass", "runup_pass")
    found = signals.candidates(rows, F.col("late"), "1 hour", *columns).withColumn("activity", F.coalesce(F.round("clock_ratio", 6), F.lit(0.0)))
    return staged(found.withColumn("order_id", F.concat("symbol", F.lit("@"), F.unix_seconds("signal_bar").cast("string"))), "candidates")


_LATE_ROUND = ("signal_close", "return_w", "clock_ratio", "position", "runup", "quote_short", "activity")


@query("o81_o88_candidates", f"""WITH {_LM} SELECT symbol, {_TS.format('signal_bar')} AS signal_bar, {_TS.format('decision_time')} AS decision_time,
    order_id, components, clock_days,
  return_pass, volume_pass, range_pass, runup_pass, {', '.join(f'round({c}, 4) AS {c}' for c in _LATE_ROUND)} FROM ca""")
def o81(spark, sf):
    return rounded(late_candidates(spark, sf), 4)


_LAST = "(SELECT date_trunc('day', max(open_time)) + INTERVAL 1 DAY FROM ba)"


@query("o89_outcome_cutoff", f"""WITH {_LM} SELECT symbol, {_TS.format('decision_time')} AS decision_time, components FROM ca
    WHERE decision_time <= {_LAST} - INTERVAL 72 HOUR""")
def o89(spark, sf):
    ends = grid(spark, sf).agg(F.date_trunc("day", F.max("open_time")).alias("day")).select((F.col("day") + F.expr("interval 1 day")).alias("end"))
    found = signals.before_outcome_cutoff(late_candidates(spark, sf).join(F.broadcast(ends)), F.col("end"), 72 * HOUR)
    return rounded(found.select("symbol", "decision_time", "components"))


# Selection


def _greedy_sql(name: str, source: str, trigger: str, rest: str, cap: int) -> str:
    """The fold as a recursion over the ordered candidates."""
    return f"""{name}_o AS (SELECT symbol, decision_time, components, activity, row_number() OVER (ORDER BY decision_time, components DESC,
    activity DESC, symbol) AS n FROM {source} WHERE {trigger}),
  {name} AS (
    SELECT 0::BIGINT AS n, NULL::VARCHAR AS symbol, NULL::TIMESTAMP AS decision_time, NULL::INT AS components, NULL::DOUBLE AS activity,
    NULL::VARCHAR AS decision,
           MAP([]::VARCHAR[], []::TIMESTAMP[]) AS rests, NULL::DATE AS day, 0 AS taken
    UNION ALL
    SELECT n, symbol, decision_time, components, activity, decision, CASE WHEN decision = 'selected' THEN map_concat(rests, MAP([symbol],
    [decision_time + {rest}])) ELSE rests END,
           decision_time::DATE, base + (decision = 'selected')::INT
    FROM (SELECT o.*, f.rests, CASE WHEN f.day = o.decision_time::DATE THEN f.taken ELSE 0 END AS base,
                 CASE WHEN o.decision_time < coalesce(f.rests[o.symbol], TIMESTAMP '1900-01-01') THEN 'suppressed_symbol_cooldown'
                      WHEN f.day = o.decision_time::DATE AND f.taken >= {cap} THEN 'suppressed_daily_cap' ELSE 'selected' END AS decision
          FROM {name} f JOIN {name}_o o ON o.n = f.n + 1))"""


_SELECTIONS = f"""{_EC}, {_greedy_sql('e1s', 'ca', 'e1_edge', 'INTERVAL 24 HOUR', 3)}, {_greedy_sql('e2s', 'ca', 'e2_edge', 'INTERVAL 24 HOUR', 3)},
  se AS (SELECT 'e1' AS strategy, symbol, decision_time, components, activity, decision FROM e1s WHERE n > 0 UNION ALL SELECT 'e2', symbol,
    decision_time, components, activity, decision FROM e2s WHERE n > 0)"""


def _audits(found: DataFrame) -> DataFrame:
    each = F.explode(F.array_compact(F.array(*(F.when(F.col(f"{s}_edge"), s) for s in ("e1", "e2")))))
    return signals.select_greedily(found.withColumn("strategy", each), 24 * HOUR, 3, ("strategy",))


@query("o90_greedy_selection", f"""WITH RECURSIVE {_SELECTIONS} SELECT strategy, symbol, {_TS.format('decision_time')} AS decision_time, components,
    round(activity, 6) AS activity, decision FROM se""")
def o90(spark, sf):
    return rounded(_audits(entry_candidates(spark, sf)))


# Execution


def _simulated_sql(source: str, quote: float, entry: int, hold: int, exit_: int, take: float, stop: float | None) -> str:
    """``source``: order_id, symbol, decision_time, signal_close."""
    stopped = f"WHEN price <= vwap * (1 - {stop}) THEN 'stop' " if stop is not None else ""
    before = "OVER (PARTITION BY order_id ORDER BY ts, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    return f"""en0 AS (
    SELECT order_id, o.symbol, ts, price, price * qty AS a, {quote} - coalesce(sum(price * qty) {before}, 0) AS rest
    FROM {source} o JOIN tr ON tr.symbol = o.symbol AND NOT is_buyer_maker AND price > 0 AND qty > 0 AND ts BETWEEN decision_time
    AND decision_time + INTERVAL {entry} HOUR
  ), en AS (
    SELECT order_id, any_value(symbol) AS symbol, sum(least(a, rest) / price) AS base_qty, sum(least(a, rest) / price * price) / sum(least(a,
    rest) / price) AS entry_vwap,
           max(ts) AS entry_time, count(*) AS entry_trades, sum(least(a, rest)) AS spent FROM en0 WHERE rest > 1e-12
    GROUP BY 1 HAVING spent >= {quote} - 1e-8
  ), pa AS (
    SELECT order_id, ts, trade_id, price, (price / entry_vwap - 1) * 100 AS gain,
    CASE {stopped.replace('vwap', 'entry_vwap')}WHEN price >= entry_vwap * (1 + {take}) THEN 'target' END AS reason
    FROM en JOIN tr ON tr.symbol = en.symbol AND price > 0 AND ts > entry_time AND ts <= entry_time + INTERVAL {hold} HOUR
  ), hi AS (
    SELECT order_id, first(ts ORDER BY ts, trade_id) AS hit, first(reason ORDER BY ts, trade_id) AS why, first(price ORDER BY ts,
    trade_id) AS trigger_price FROM pa WHERE reason IS NOT NULL GROUP BY 1
  ), ex AS (
    SELECT en.*, coalesce(hit, entry_time + INTERVAL {hold} HOUR) AS exit_trigger, coalesce(why, 'time') AS exit_reason, trigger_price FROM en LEFT
    JOIN hi USING (order_id)
  ), wk AS (SELECT order_id, max(gain) AS path_mfe, min(gain) AS path_mae FROM pa JOIN ex USING (order_id) WHERE ts <= exit_trigger GROUP BY 1
  ), xf0 AS (
    SELECT order_id, ts, price, qty, base_qty, base_qty - coalesce(sum(qty) {before}, 0) AS rest
    FROM ex JOIN tr ON tr.symbol = ex.symbol AND is_buyer_maker AND price > 0 AND qty > 0 AND ts BETWEEN exit_trigger
    AND exit_trigger + INTERVAL {exit_} HOUR
  ), xf AS (
    SELECT order_id, sum(least(qty, rest) * price) AS proceeds, sum(least(qty, rest) * price) / sum(least(qty, rest)) AS exit_vwap,
    max(ts) AS exit_time, count(*) AS exit_trades
    FROM xf0 WHERE rest > 1e-15 GROUP BY 1 HAVING sum(least(qty, rest)) >= any_value(base_qty) - 1e-12
  ), si AS (
    SELECT o.order_id, o.symbol, decision_time, signal_close, entry_time, entry_vwap, base_qty, entry_trades, exit_trigger, exit_reason,
    trigger_price,
           CASE WHEN entry_time IS NOT NULL THEN coalesce(path_mfe, 0) END AS path_mfe, CASE WHEN entry_time IS NOT NULL THEN coalesce(path_mae,
    0) END AS path_mae,
           exit_time, exit_vwap, proceeds, exit_trades, CASE WHEN entry_time IS NULL THEN 'entry_not_filled'
    WHEN exit_time IS NULL THEN 'exit_not_filled' ELSE 'completed' END AS status,
           (entry_vwap / signal_close - 1) * 100 AS entry_slippage, (exit_vwap / trigger_price - 1) * 100 AS exit_slippage,
    (proceeds / {quote} - 1) * 100 AS gross_return,
           proceeds * (1 - 0.001::DOUBLE) - {quote} * (1 + 0.001::DOUBLE) AS net_pnl,
    (proceeds * (1 - 0.001::DOUBLE) / ({quote} * (1 + 0.001::DOUBLE)) - 1) * 100 AS net_return,
           {quote} * 0.001::DOUBLE + proceeds * 0.001::DOUBLE AS fees, (epoch_us(exit_time) - epoch_us(entry_time)) / 60e6::DOUBLE AS holding_minutes
    FROM {source} o LEFT JOIN ex USING (order_id) LEFT JOIN wk USING (order_id) LEFT JOIN xf USING (order_id))"""


_SIM_NUMBERS = (
    "signal_close", "entry_vwap", "base_qty", "trigger_price", "path_mfe", "path_mae", "exit_vwap", "proceeds", "entry_slippage", "exit_slippage", "gross_return", "net_pnl",
    "net_return", "fees", "holding_minutes",
)
_SIM_TIMES = ("decision_time", "entry_time", "exit_trigger", "exit_time")
_SIM_SHOWN = (
    "order_id, symbol, entry_trades, exit_trades, exit_reason, status, " + ", ".join(f"{_TS.format(c)} AS {c}" for c in _SIM_TIMES)
    + ", " + ", ".join(f"round({c}, 4) AS {c}" for c in _SIM_NUMBERS)
)
_ORDERS = ("order_id", "symbol", "decision_time", "signal_close")
_ENTRY_SIM = _simulated_sql("ca", QUOTE, ENTRY, HOLD, EXIT, 0.15, None)
_LATE_SIM = _simulated_sql("ca", QUOTE, ENTRY, HOLD // 2, EXIT, 0.10, 0.05)


@query("o93_fills", f"""WITH {_EC}, {_ENTRY_SIM} SELECT order_id, round(sum(least(a, rest) / price), 6) AS filled_base, round(sum(least(a,
    rest) / price * price), 4) AS filled_quote,
  round(sum(least(a, rest) / price * price) / sum(least(a, rest) / price), 6) AS vwap, {_TS.format('max(ts)')} AS fill_time, count(*) AS fill_count,
    sum(least(a, rest)) >= {QUOTE} - 1e-8 AS complete
  FROM en0 WHERE rest > 1e-12 GROUP BY order_id""")
def o93(spark, sf):
    orders = entry_candidates(spark, sf).select(*_ORDERS).withColumn("until", F.expr(f"decision_time + interval {ENTRY} hours"))
    found = execution.fills(orders, tape(spark, sf), True, "decision_time", "until", quote=QUOTE)
    return rounded(found.withColumn("filled_quote", F.round("filled_quote", 4)))


def _entry_executions(spark, sf, found: DataFrame | None = None) -> DataFrame:
    orders = (entry_candidates(spark, sf) if found is None else found).select(*_ORDERS)
    return execution.simulated(orders, tape(spark, sf), QUOTE, ENTRY * HOUR, HOLD * HOUR, EXIT * HOUR, 0.15, 0.001)


def _late_executions(spark, sf, found: DataFrame | None = None) -> DataFrame:
    orders = (late_candidates(spark, sf) if found is None else found).select(*_ORDERS)
    return execution.simulated(orders, tape(spark, sf), QUOTE, ENTRY * HOUR, HOLD // 2 * HOUR, EXIT * HOUR, 0.10, 0.001, stop=0.05)


@query("o95_o98_o99_simulation", f"WITH {_EC}, {_ENTRY_SIM} SELECT {_SIM_SHOWN} FROM si")
def o95(spark, sf):
    return rounded(_entry_executions(spark, sf), 4)


@query("o96_stop_simulation", f"WITH {_LM}, {_LATE_SIM} SELECT {_SIM_SHOWN} FROM si")
def o96(spark, sf):
    return rounded(_late_executions(spark, sf), 4)


_LADDER = f"""la_ AS (
  SELECT en.order_id, h AS horizon, max((price / entry_vwap - 1) * 100) AS mfe, min((price / entry_vwap - 1) * 100) AS mae,
         {', '.join(f'min(CASE WHEN price >= entry_vwap * (1 + {t} / 100.0::DOUBLE) THEN ts END) AS touch_{t}' for t in (10, 15, 25, 50))}
  FROM en CROSS JOIN unnest([480, 1440, 1920]) AS u(h)
  LEFT JOIN tr ON tr.symbol = en.symbol AND price > 0 AND ts > entry_time AND ts <= entry_time + h * INTERVAL 1 MINUTE GROUP BY 1, 2)"""


@query("o94_o97_ladder", f"""WITH {_EC}, {_ENTRY_SIM}, {_LADDER} SELECT order_id, horizon::INT AS horizon, round(mfe, 4) AS mfe, round(mae, 4) AS mae,
  {', '.join(f"{_TS.format(f'touch_{t}')} AS touch_{t}" for t in (10, 15, 25, 50))} FROM la_""")
def o94(spark, sf):
    return rounded(_ladder(spark, sf, entry_candidates(spark, sf)), 4)


def _ladder(spark, sf, found: DataFrame) -> DataFrame:
    orders = found.select(*_ORDERS).withColumn("until", F.expr(f"decision_time + interval {ENTRY} hours"))
    filled = execution.fills(orders, tape(spark, sf), True, "decision_time", "until", quote=QUOTE).where("complete")
    entries = orders.select("order_id", "symbol").join(filled.select("order_id", "fill_time", "vwap"), "order_id")
    return execution.path_ladder(entries, tape(spark, sf), (480, 1440, 1920), (10, 15, 25, 50))


@query("o103_path_diagnostics", f"""WITH {_EC}, {_ENTRY_SIM}, {_LADDER} SELECT horizon::INT AS horizon, round(quantile_cont(mfe, 0.5),
    4) AS median_mfe, round(quantile_cont(mae, 0.5), 4) AS median_mae,
  round(quantile_cont(mae, 0.1), 4) AS mae_p10, round(min(mae), 4) AS worst_mae,
    {', '.join(f'round(avg((touch_{t} IS NOT NULL)::INT), 4) AS hit_{t}_rate' for t in (10, 15, 25, 50))}
  FROM la_ JOIN si USING (order_id) WHERE status = 'completed' GROUP BY 1""")
def o103(spark, sf):
    found = entry_candidates(spark, sf)
    done = _entry_executions(spark, sf, found).where("status = 'completed'").select("order_id")
    return rounded(performance.path_diagnostics(_ladder(spark, sf, found).join(done, "order_id", "left_semi"), ["horizon"], (10, 15, 25, 50)), 4)


@query("o91_feedback_selection", f"""WITH RECURSIVE {_LM}, {_LATE_SIM},
  od AS (SELECT si.symbol, si.decision_time, components, activity, status, exit_time, row_number() OVER (ORDER BY si.decision_time, components DESC,
    activity DESC, si.symbol) AS n FROM si JOIN ca USING (order_id)),
  fo AS (
    SELECT 0::BIGINT AS n, NULL::VARCHAR AS symbol, NULL::TIMESTAMP AS decision_time, NULL::INT AS components, NULL::VARCHAR AS decision,
    MAP([]::VARCHAR[], []::TIMESTAMP[]) AS rests, NULL::DATE AS day, 0 AS filled
    UNION ALL
    SELECT n, symbol, decision_time, components, decision,
           CASE WHEN decision LIKE 'suppressed%' THEN rests ELSE map_concat(rests, MAP([symbol], [(CASE
    WHEN decision = 'completed' THEN exit_time ELSE decision_time END) + INTERVAL 3 HOUR])) END,
           decision_time::DATE, base + (decision = 'completed')::INT
    FROM (SELECT o.*, f.rests, CASE WHEN f.day = o.decision_time::DATE THEN f.filled ELSE 0 END AS base,
                 CASE WHEN o.decision_time < coalesce(f.rests[o.symbol], TIMESTAMP '1900-01-01') THEN 'suppressed_symbol_cooldown'
                      WHEN f.day = o.decision_time::DATE AND f.filled >= 3 THEN 'suppressed_daily_trade_cap' ELSE o.status END AS decision
          FROM fo f JOIN od o ON o.n = f.n + 1))
  SELECT symbol, {_TS.format('decision_time')} AS decision_time, components, decision FROM fo WHERE n > 0""")
def o91(spark, sf):
    found = late_candidates(spark, sf)
    executed = _late_executions(spark, sf, found).join(found.select("order_id", "components", "activity"), "order_id")
    return rounded(signals.select_with_feedback(executed, 3 * HOUR, 3).select("symbol", "decision_time", "components", "decision"))


def _by_strategy(spark, sf) -> DataFrame:
    """Selections of both strategies, each symbol and time executed once, with what came of it."""
    found = entry_candidates(spark, sf)
    chosen = staged(_audits(found).where("decision = 'selected'").select("strategy", "symbol", "decision_time"), "selections")
    prices = found.select("symbol", "decision_time", "order_id", "signal_close")
    once = signals.executed_once(chosen.join(prices, ["symbol", "decision_time"]))
    executions = execution.simulated(once.select(*_ORDERS), tape(spark, sf), QUOTE, ENTRY * HOUR, HOLD * HOUR, EXIT * HOUR, 0.15, 0.001)
    return signals.executions_by_strategy(chosen, executions)


@query("o92_strategies", f"""WITH RECURSIVE {_SELECTIONS}, un AS (SELECT DISTINCT order_id, ca.symbol, ca.decision_time, signal_close FROM ca
    JOIN se USING (symbol, decision_time) WHERE decision = 'selected'),
  {_simulated_sql('un', QUOTE, ENTRY, HOLD, EXIT, 0.15, None)}
  SELECT strategy, se.symbol, {_TS.format('se.decision_time')} AS decision_time, coalesce(status, 'execution_missing') AS status, exit_reason,
    round(net_pnl, 4) AS net_pnl
  FROM se LEFT JOIN si ON si.symbol = se.symbol AND si.decision_time = se.decision_time WHERE decision = 'selected'""")
def o92(spark, sf):
    return rounded(_by_strategy(spark, sf).select("strategy", "symbol", "decision_time", "status", "exit_reason", "net_pnl"), 4)


# Performance


def _book(spark, sf) -> DataFrame:
    """Orders as trades with a result, for the performance operators."""
    rows, key = spark.read.parquet(f"{sf}/orders.parquet"), F.col("o_orderkey")
    made = (F.floor(F.col("o_totalprice")) % 1000 - 480).cast("double")
    status = F.when(key % 10 == 0, "exit_not_filled").when(key % 10 == 1, "entry_not_filled").when(key % 100 == 2, "execution_missing").otherwise("completed")
    return rows.select(
        F.col("o_orderpriority").alias("strategy"), (F.col("o_custkey") % 50).cast("string").alias("symbol"),
        F.expr("cast(o_orderdate as timestamp) + make_dt_interval(0, 0, 0, o_orderkey % 86400)").alias("entry_time"),
        F.expr("cast(o_orderdate as timestamp) + make_dt_interval(3, 0, 0, o_orderkey % 86400)").alias("exit_time"),
        made.alias("net_pnl"), (made / 10.0).alias("net_return"), status.alias("status"), "o_orderkey",
    )


_K = """bk AS (
  SELECT o_orderpriority AS strategy, (o_custkey % 50)::VARCHAR AS symbol, o_orderdate + to_seconds(o_orderkey % 86400) AS entry_time,
         o_orderdate + INTERVAL 3 DAY + to_seconds(o_orderkey % 86400) AS exit_time, (floor(o_totalprice)::BIGINT % 1000 - 480)::DOUBLE AS net_pnl,
         (floor(o_totalprice)::BIGINT % 1000 - 480)::DOUBLE / 10.0 AS net_return,
         CASE WHEN o_orderkey % 10 = 0 THEN 'exit_not_filled' WHEN o_orderkey % 10 = 1 THEN 'entry_not_filled' WHEN o_orderkey % 100 = 2 THEN 'execution_missing' ELSE 'completed' END AS status,
         o_orderkey FROM orders)"""


def _performance_sql(source: str, by: str, name: str = "pe") -> str:
    on = f"USING ({by})"
    order = f"PARTITION BY {by} ORDER BY entry_time, symbol ROWS UNBOUNDED PRECEDING"
    return f"""{name}_do AS (SELECT *, net_pnl <= 0 AS loss, sum(net_pnl) OVER ({order}) AS equity FROM {source} WHERE status = 'completed'),
  {name}_fa AS (SELECT *, max(equity) OVER ({order}) - equity AS fall, count(CASE WHEN NOT loss THEN 1 END) OVER ({order}) AS streak FROM {name}_do),
  {name}_ru AS (SELECT {by}, max(n) AS longest_losing_run FROM (SELECT {by}, streak, count(CASE WHEN loss THEN 1 END) AS n FROM {name}_fa
    GROUP BY {by}, streak) GROUP BY {by}),
  {name}_sh AS (SELECT {by}, max(n) / sum(n)::DOUBLE AS largest_symbol_share FROM (SELECT {by}, symbol AS sy_, count(*) AS n FROM {name}_fa
    GROUP BY {by}, sy_) GROUP BY {by}),
  {name}_st AS (SELECT {by}, count(*) AS trades, count(CASE WHEN NOT loss THEN 1 END) AS wins, avg(net_pnl) AS expectancy, sum(net_pnl) AS total_pnl,
    avg(net_return) AS mean_return,
    quantile_cont(net_return, 0.5) AS median_return, CASE WHEN sum(CASE WHEN loss THEN net_pnl ELSE 0 END) < 0 THEN sum(CASE
    WHEN NOT loss THEN net_pnl ELSE 0 END) / -sum(CASE WHEN loss THEN net_pnl ELSE 0 END)
    ELSE 'inf'::DOUBLE END AS profit_factor, max(fall) AS max_drawdown, count(DISTINCT symbol) AS symbols FROM {name}_fa GROUP BY {by}),
  {name}_le AS (SELECT {by}, count(*) FILTER (status <> 'completed') AS left_out, avg((status <> 'entry_not_filled')::INT) AS fill_rate,
    avg((status IN ('completed', 'exit_not_filled'))::INT) AS strict_fill_rate FROM {source} GROUP BY {by}),
  {name} AS (SELECT * REPLACE (coalesce(trades, 0) AS trades, coalesce(longest_losing_run, 0) AS longest_losing_run) FROM {name}_le LEFT
    JOIN {name}_st {on} LEFT JOIN {name}_ru {on} LEFT JOIN {name}_sh {on})"""


_MEASURES = ("fill_rate", "strict_fill_rate", "expectancy", "total_pnl", "mean_return", "median_return", "profit_factor", "max_drawdown", "largest_symbol_share")
_SHOWN = "left_out, trades, wins, symbols, longest_losing_run, " + ", ".join(f"round({c}, 6) AS {c}" for c in _MEASURES)


@query("o100_o101_performance", f"WITH {_K}, {_performance_sql('bk', 'strategy')} SELECT strategy, {_SHOWN} FROM pe")
def o100(spark, sf):
    return rounded(performance.performance(_book(spark, sf), ["strategy"]))


@query("o101_monthly", f"""WITH {_K}, mo AS (SELECT *, strftime(entry_time, '%Y-%m') AS month FROM bk), {_performance_sql('mo', 'strategy, month')}
    SELECT strategy, month, {_SHOWN} FROM pe""")
def o101_monthly(spark, sf):
    rows = _book(spark, sf).withColumn("month", F.date_format("entry_time", "yyyy-MM"))
    return rounded(performance.performance(rows, ["strategy", "month"]))


@query("o101_by_symbol", f"WITH {_K}, {_performance_sql('bk', 'symbol')} SELECT symbol, {_SHOWN} FROM pe")
def o101_symbols(spark, sf):
    return rounded(performance.performance(_book(spark, sf), ["symbol"]))


@query("o101_daily", f"""WITH {_K} SELECT strategy, entry_time::DATE::VARCHAR AS day, count(*) AS trades, round(sum(net_pnl), 6) AS net_pnl,
    count(*) FILTER (net_pnl > 0) AS won,
  count(*) FILTER (net_pnl <= 0) AS lost FROM bk WHERE status = 'completed' GROUP BY 1, 2""")
def o101_daily(spark, sf):
    return rounded(performance.daily_results(_book(spark, sf), ["strategy"]))


_BOUNDS = "bo AS (SELECT date_trunc('day', min(entry_time)) AS a, date_trunc('day', max(entry_time)) + INTERVAL 1 DAY AS b FROM bk)"


def _parts_sql(n: int) -> str:
    return f"th AS (SELECT bk.*, ((epoch_us(entry_time) - epoch_us(a)) * {n} // (epoch_us(b) - epoch_us(a)) + 1)::INT AS part FROM bk, bo)"


def _parts(spark, sf, n: int) -> DataFrame:
    rows = _book(spark, sf)
    day = lambda f: F.date_trunc("day", f("entry_time"))
    bounds = rows.agg(day(F.min).alias("a"), (day(F.max) + F.expr("interval 1 day")).alias("b"))
    return performance.chronological_parts(rows.join(F.broadcast(bounds)), F.col("a"), F.col("b"), n).drop("a", "b")


@query("o101_thirds", f"WITH {_K}, {_BOUNDS}, {_parts_sql(3)}, {_performance_sql('th', 'strategy, part')} SELECT strategy, part, {_SHOWN} FROM pe")
def o101_thirds(spark, sf):
    return rounded(performance.performance(_parts(spark, sf, 3), ["strategy", "part"]))


@query("o102_max_concurrency", f"""WITH {_K}, mo AS (SELECT strategy, entry_time AS t, 1 AS d FROM bk WHERE status = 'completed' UNION ALL
    SELECT strategy, exit_time, -1 FROM bk WHERE status = 'completed')
  SELECT strategy, CAST(max(h) AS BIGINT) AS max_concurrency FROM (SELECT strategy, sum(d) OVER (PARTITION BY strategy ORDER BY t,
    d ROWS UNBOUNDED PRECEDING) AS h FROM mo) GROUP BY 1""")
def o102(spark, sf):
    return performance.max_concurrency(_book(spark, sf), ["strategy"])


#: Floors of the two protocols: by halves with 14 checks, by thirds with 13. Coverage and failures come with the run.
HALVES = {
    "minimum_completed_trades": 100, "minimum_unique_symbols": 25, "positive_total_net_pnl": 0, "minimum_expectancy": 1.0, "minimum_profit_factor": 1.05, "maximum_drawdown": 50_000,
    "maximum_consecutive_losses": 30, "maximum_symbol_concentration": 0.15, "minimum_entry_fill_rate": 0.90, "minimum_trades_each_part": 30, "positive_expectancy_each_part": 0,
    "bootstrap_lower_expectancy_above_zero": 0, "minimum_archive_coverage": 0.95, "maximum_symbol_failure_fraction": 0.05,
}
THIRDS = {k: v for k, v in HALVES.items() if k != "minimum_entry_fill_rate"} | {"minimum_unique_symbols": 20, "minimum_trades_each_part": 20, "maximum_drawdown": 15_000}
_DRAWS = 200


def _graduation_sql(floors: dict, n: int, infinite_fails: bool) -> str:
    def check(name: str) -> str:
        measure, sign = performance.CHECKS[name]
        measure = "CASE WHEN profit_factor < 'inf'::DOUBLE THEN profit_factor END" if measure == "profit_factor" and infinite_fails else measure
        return f"coalesce({measure} {sign} {float(floors[name])}, false) AS {name}"

    names = [k for k in performance.CHECKS if k in floors]
    return f"""WITH {_K}, {_BOUNDS}, {_parts_sql(n)}, {_performance_sql('bk', 'strategy')}, {_performance_sql('th', 'strategy, part', 'pp')},
  lp AS (SELECT strategy, CASE WHEN count(*) FILTER (trades > 0) = {n} THEN min(trades) ELSE 0 END AS least_part_trades, CASE
    WHEN count(*) FILTER (trades > 0) = {n} THEN min(expectancy) END AS least_part_expectancy FROM pp GROUP BY 1),
  sy AS (SELECT strategy, symbol, sum(net_pnl) AS total, count(*) AS n, row_number() OVER (PARTITION BY strategy ORDER BY symbol) - 1 AS at_,
    count(*) OVER (PARTITION BY strategy) AS many FROM bk WHERE status = 'completed' GROUP BY 1, 2),
  dr AS (SELECT strategy, i, ('0x' || substr(md5('20260725:' || i || ':' || at_), 1, 8))::BIGINT % many AS at_ FROM sy, range(1,
    {_DRAWS + 1}) AS r(i)),
  lo AS (SELECT strategy, quantile_cont(m, 0.025) AS bootstrap_low FROM (SELECT strategy, i, sum(total) / sum(n) AS m FROM dr JOIN sy USING (strategy,
    at_) WHERE many > 1 GROUP BY 1, 2) GROUP BY 1),
  ch AS (SELECT strategy, {', '.join(map(check, names))} FROM (SELECT *, 0.97 AS coverage, 0.0 AS failure_fraction FROM pe LEFT
    JOIN lp USING (strategy) LEFT JOIN lo USING (strategy)))
  SELECT *, {' AND '.join(names)} AS passed, array_to_string(list_filter([{', '.join(f"CASE WHEN NOT {k} THEN '{k}' END" for k in names)}],
    lambda x: x IS NOT NULL), ',') AS failed, 5 AS strategies_tried FROM ch"""


def _graduated(spark, sf, floors: dict, n: int, infinite_fails: bool) -> DataFrame:
    book = _book(spark, sf)
    parts = performance.over_parts(performance.performance(_parts(spark, sf, n), ["strategy", "part"]), ["strategy"], n)
    low = inference.cluster_bootstrap(book.where("status = 'completed'"), _DRAWS, 20260725, ("strategy",)).select("strategy", F.col("low").alias("bootstrap_low"))
    stats = performance.performance(book, ["strategy"]).join(parts, "strategy", "left").join(low, "strategy", "left")
    stats = stats.withColumns({"coverage": F.lit(0.97), "failure_fraction": F.lit(0.0)})
    names = [k for k in performance.CHECKS if k in floors]
    return performance.graduation(stats, floors, 5, infinite_fails).select("strategy", *names, "passed", "failed", "strategies_tried")


@query("o104_graduation", _graduation_sql(HALVES, 2, True))
def o104(spark, sf):
    return _graduated(spark, sf, HALVES, 2, True)


@query("o104_graduation_thirds", _graduation_sql(THIRDS, 3, False))
def o104_thirds(spark, sf):
    return _graduated(spark, sf, THIRDS, 3, False)


@query("o105_coverage", f"""WITH {_G}, sp AS (SELECT symbol, min(CASE WHEN observed THEN open_time END) AS a, max(CASE
    WHEN observed THEN open_time END) AS b FROM gr GROUP BY 1)
  SELECT symbol, round(avg(CASE WHEN open_time BETWEEN a AND b THEN observed::INT END), 6) AS span_coverage, round(avg(observed::INT),
    6) AS grid_coverage FROM gr JOIN sp USING (symbol) GROUP BY 1""")
def o105(spark, sf):
    return rounded(performance.coverage(grid(spark, sf)))


_BOOT = f"""WITH {_K}, sy AS (SELECT symbol, sum(net_pnl) AS total, count(*) AS n, row_number() OVER (ORDER BY symbol) - 1 AS at_,
    count(*) OVER () AS many FROM bk WHERE status = 'completed' GROUP BY symbol),
  dr AS (SELECT i, ('0x' || substr(md5('20260725:' || i || ':' || at_), 1, 8))::BIGINT % many AS at_ FROM sy, range(1, 10001) AS r(i)),
    me AS (SELECT i, sum(total) / sum(n) AS m FROM dr JOIN sy USING (at_) GROUP BY i)
  SELECT round(quantile_cont(m, 0.025), 6) AS low, round(quantile_cont(m, 0.5), 6) AS middle, round(quantile_cont(m, 0.975), 6) AS high,
    count(*) AS iterations FROM me"""
#: Fixed value: draws of the bootstrap.
BOOTSTRAPS = 10_000


@query("o74_bootstrap", _BOOT)
def o74(spark, sf):
    return rounded(inference.cluster_bootstrap(_book(spark, sf).where("status = 'completed'"), BOOTSTRAPS, 20260725))
