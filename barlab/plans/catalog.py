"""Registered queries over the event-study operators, each with the same in SQL where SQL can say it.

The events table stands in for a trade tape with hourly bars; results say nothing about markets.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import rolling, splits, surge, windows
from ..sources import trades as src
from ..sources.staging import stored_tape

WINDOW, FACTOR = 8, 1.25
#: 2024-01-15, in milliseconds.
CUTOFF_MS = 1_705_276_800_000

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(f):
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return register


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def stamp(c: str | Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles rounded, times as text."""
    show = {"double": lambda c: F.round(c, places), "timestamp": stamp, "date": lambda c: F.col(c).cast("string")}
    return df.select(*(show[t](c).alias(c) if t in show else F.col(c) for c, t in df.dtypes))


def tape(spark: SparkSession, sf: str) -> DataFrame:
    return src.event_trades(spark, sf)


_STORED: dict[tuple[str, str], str] = {}


def stored(spark: SparkSession, sf: str) -> DataFrame:
    """The tape as a stored one, written once a session."""
    key = spark.sparkContext.applicationId, sf
    if key not in _STORED or not spark.catalog.tableExists(_STORED[key]):
        made = stored_tape(tape(spark, sf))
        _STORED[key] = made.tape_name
    return spark.table(_STORED[key])


def bars(spark: SparkSession, sf: str) -> DataFrame:
    return src.bars(tape(spark, sf))


def grid(spark: SparkSession, sf: str) -> DataFrame:
    return src.dense_grid(bars(spark, sf))


def first_surges(spark: SparkSession, sf: str) -> DataFrame:
    return surge.first_surges(bars(spark, sf), WINDOW * 3600, 3600, FACTOR)


_T = """tr AS (
  SELECT event_type AS symbol, event_id AS trade_id, ts, 400.0::DOUBLE + value AS price, (k + 1) / 10.0::DOUBLE AS qty, k % 2 = 0 AS is_buyer_maker
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events)
)"""
_B = _T + """, ba AS (
  SELECT symbol, date_trunc('hour', ts) AS open_time, first(price ORDER BY ts, trade_id) AS open, max(price) AS high, min(price) AS low,
         last(price ORDER BY ts, trade_id) AS close, sum(qty) AS volume, sum(price * qty) AS quote_volume, count(*) AS trade_count,
         sum(CASE WHEN NOT is_buyer_maker THEN price * qty ELSE 0 END) AS taker_buy_quote
  FROM tr GROUP BY 1, 2
)"""
_G = _B + """, gr AS (
  SELECT s.symbol, t.open_time, ba.* EXCLUDE (symbol, open_time), ba.close IS NOT NULL AS observed
  FROM (SELECT DISTINCT symbol FROM ba) s
  CROSS JOIN (SELECT unnest(generate_series(a, b + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS open_time
    FROM (SELECT date_trunc('day', min(open_time)) AS a, date_trunc('day', max(open_time)) AS b FROM ba)) t
  LEFT JOIN ba ON ba.symbol = s.symbol AND ba.open_time = t.open_time
)"""
_TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"
_BY = "PARTITION BY symbol ORDER BY open_time"
_S = _B + """, cr AS (
  SELECT symbol, open_time, high, CAST(open_time AS DATE) AS event_date, min(low) OVER w AS baseline_low,
         min(struct_pack(l := low, m := -epoch(open_time))) OVER w AS base
  FROM ba WINDOW w AS (PARTITION BY symbol ORDER BY open_time RANGE BETWEEN INTERVAL 7 HOUR PRECEDING AND INTERVAL 1 HOUR PRECEDING)
), su AS (
  SELECT symbol, event_date, open_time AS cross_time, high AS cross_high, make_timestamp(CAST(-base.m * 1000000 AS BIGINT)) AS baseline_time,
         baseline_low, (epoch(open_time) + base.m) / 60.0 AS minutes_to_cross
  FROM cr WHERE high + 1e-15 >= baseline_low * 1.25 QUALIFY row_number() OVER (PARTITION BY symbol, event_date ORDER BY open_time) = 1
)"""


# Sources


@query("o09_trade_reader", f"""WITH {_T} SELECT symbol, trade_id, {_TS.format('ts')} AS ts, round(price, 6) AS price, round(qty, 6) AS qty,
    is_buyer_maker FROM tr""")
def o09(spark, sf):
    raw = tape(spark, sf).select(
        "symbol", F.col("trade_id").cast("string").alias("id"), F.col("price").cast("string"), F.col("qty").cast("string").alias("quantity"),
        F.unix_micros("ts").cast("string").alias("time"), F.col("is_buyer_maker").cast("string").alias("maker"),
    )
    return rounded(src.normalised_trades(raw))


@query("o08_bars", f"""WITH {_B} SELECT symbol, {_TS.format('open_time')} AS open_time, round(open, 6) AS open, round(high, 6) AS high, round(low,
    6) AS low, round(close, 6) AS close, round(volume, 6) AS volume, round(quote_volume, 6) AS quote_volume, trade_count, round(taker_buy_quote,
    6) AS taker_buy_quote FROM ba""")
def o08(spark, sf):
    return rounded(bars(spark, sf))


@query("o05_cutoff", "SELECT event_id, epoch_us(ts) // 1000 AS timestamp_ms_normalized FROM events WHERE ts < TIMESTAMP '2024-01-15'")
def o05(spark, sf):
    time = F.when(F.col("event_id") % 2 == 0, F.unix_micros(F.col("ts").cast("timestamp"))).otherwise(F.unix_millis(F.col("ts").cast("timestamp")))
    raw = spark.read.parquet(f"{sf}/events.parquet").select("event_id", time.cast("string").alias("time"))
    header = spark.range(1).select(F.lit(-1).cast("long").alias("event_id"), F.lit("time").alias("time"))
    return src.before_cutoff(raw.unionByName(header), CUTOFF_MS).select("event_id", "timestamp_ms_normalized")


@query("o08_kline_reader", f"""WITH {_B} SELECT symbol, {_TS.format('open_time')} AS open_time, round(open, 6) AS open, round(high, 6) AS high,
    round(low, 6) AS low,
  round(close, 6) AS close, round(volume, 6) AS volume, {_TS.format("open_time + INTERVAL 59 MINUTE")} AS close_time, CASE
    WHEN hour(open_time) = 5 THEN NULL ELSE round(quote_volume, 4) END AS quote_volume,
  CASE WHEN hour(open_time) = 3 THEN 0 ELSE trade_count END AS trade_count, NULL::DOUBLE AS taker_buy_base, round(taker_buy_quote,
    4) AS taker_buy_quote FROM ba""")
def o08_klines(spark, sf):
    text = lambda c, name: F.col(c).cast("string").alias(name)
    hour = F.hour("open_time")
    raw = bars(spark, sf).select(
        "symbol", F.when(hour % 2 == 0, F.unix_micros("open_time")).otherwise(F.unix_millis("open_time")).cast("string").alias("open_time"),
        *(text(c, c) for c in ("open", "high", "low", "close", "volume")), F.unix_millis(F.expr("open_time + interval 59 minutes")).cast("string").alias("close_time"),
        F.when(hour == 5, "n/a").otherwise(F.col("quote_volume").cast("string")).alias("quote_volume"), F.when(hour != 3, F.col("trade_count")).cast("string").alias("trade_count"),
        F.lit(None).cast("string").alias("taker_buy_base"), text("taker_buy_quote", "taker_buy_quote"),
    )
    header = spark.range(1).select(F.lit("head").alias("symbol"), *(F.lit(c).alias(c) for c in src.BAR_COLUMNS))
    found = src.normalised_bars(raw.unionByName(header))
    return rounded(found.withColumns({c: F.round(c, 4) for c in ("quote_volume", "taker_buy_quote")}))


_PAIRS = """pa AS (SELECT p_partkey AS symbol, p_brand AS base, split_part(p_type, ' ', 1) AS quote, CASE WHEN p_size > 5 THEN 'TRADING' ELSE 'BREAK' END AS status,
  p_partkey % 3 <> 0 OR p_partkey % 5 = 0 AS spot, CASE WHEN p_partkey % 7 = 0 THEN false WHEN p_partkey % 2 = 0 THEN true ELSE p_partkey % 3 <> 0 OR p_partkey % 5 = 0 END AS trading,
  p_partkey % 11 <> 0 AS limit_, p_brand LIKE '%2' AS marked FROM part)"""


def _exchange(spark, sf) -> DataFrame:
    """The part table as an exchange lists its pairs: rows with an array of nested pairs."""
    key = F.col("p_partkey")
    pair = F.struct(
        key.cast("string").alias("symbol"), F.col("p_brand").alias("baseAsset"), F.split("p_type", " ")[0].alias("quoteAsset"),
        F.when(F.col("p_size") > 5, "TRADING").otherwise("BREAK").alias("status"), F.when(key % 3 != 0, F.array(F.lit("SPOT"))).alias("permissions"),
        F.when(key % 5 == 0, F.array(F.array(F.lit("OTHER")), F.array(F.lit("SPOT")))).alias("permissionSets"),
        F.when(key % 7 == 0, False).when(key % 2 == 0, True).alias("isSpotTradingAllowed"),
        F.when(key % 11 == 0, F.array(F.lit("MARKET"))).otherwise(F.array(F.lit("MARKET"), F.lit("LIMIT"))).alias("orderTypes"),
    )
    return spark.read.parquet(f"{sf}/part.parquet").groupBy((key % 20).alias("page")).agg(F.collect_list(pair).alias("symbols"))


@query("o03_exchange_symbols", f"WITH {_PAIRS} SELECT symbol::VARCHAR AS symbol, base, quote, status, spot, trading, limit_ AS \"limit\" FROM pa")
def o03(spark, sf):
    return src.exchange_symbols(_exchange(spark, sf)).drop("stable", "leveraged")


@query("o10_universe", f"""WITH {_PAIRS} SELECT base, symbol::VARCHAR AS symbol, quote, CAST(rank AS BIGINT) AS quote_rank FROM (SELECT *,
    list_position(['PROMO', 'ECONOMY', 'STANDARD'], quote) AS rank FROM pa)
  WHERE rank > 0 AND status = 'TRADING' AND spot AND trading AND limit_ QUALIFY row_number() OVER (PARTITION BY base ORDER BY rank,
    symbol::VARCHAR) = 1""")
def o10(spark, sf):
    found = splits.canonical_universe(src.exchange_symbols(_exchange(spark, sf)), ["PROMO", "ECONOMY", "STANDARD"])
    return found.select("base", "symbol", "quote", "quote_rank")


@query("o06_archive_paths", """SELECT DISTINCT event_type AS symbol, ts::DATE::VARCHAR AS day, 'store/daily/klines/' || event_type || '/1m/' || event_type || '-1m-' || strftime(ts, '%Y-%m-%d') || '.zip' AS path,
  'store/monthly/klines/' || event_type || '/1m/' || event_type || '-1m-' || strftime(ts, '%Y-%m') || '.zip' AS month_path, 'store/daily/aggTrades/' || event_type || '/' || event_type || '-aggTrades-' || strftime(ts, '%Y-%m-%d') || '.zip' AS trades_path FROM events""")
def o06(spark, sf):
    days = tape(spark, sf).select("symbol", F.to_date("ts").alias("day")).distinct()
    paths = src.archive_paths(days, "store", "aggTrades").withColumnRenamed("path", "trades_path")
    paths = src.archive_paths(paths, "store", "klines", "1m", monthly=True).withColumnRenamed("path", "month_path")
    return rounded(src.archive_paths(paths, "store", "klines", "1m"))


@query("o13_trade_range", f"""WITH {_T} SELECT symbol, trade_id, {_TS.format('ts')} AS ts, round(price, 6) AS price, round(qty, 6) AS qty,
    is_buyer_maker FROM tr WHERE ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-12'""")
def o13(spark, sf):
    return rounded(src.trade_range(stored(spark, sf), "2024-01-05", "2024-01-12"))


@query("o14_dense_grid", f"WITH {_G} SELECT symbol, {_TS.format('open_time')} AS open_time, observed, round(close, 6) AS close, trade_count FROM gr")
def o14(spark, sf):
    own = bars(spark, sf)
    return rounded(src.dense_grid(own.unionByName(own)).select("symbol", "open_time", "observed", "close", "trade_count"))


# Scalars


@query("o18_pct_change", "SELECT l_orderkey, l_linenumber, CASE WHEN l_tax > 0 THEN round((l_discount / l_tax - 1) * 100, 6) END AS pct FROM lineitem")
def o18(spark, sf):
    rows = spark.read.parquet(f"{sf}/lineitem.parquet")
    return rows.select("l_orderkey", "l_linenumber", F.round(scalars.pct_change(F.col("l_tax"), F.col("l_discount")), 6).alias("pct"))


@query("o26_tie_break", "SELECT o_orderkey, sha256(o_orderkey::VARCHAR || '|' || o_orderpriority) AS tie FROM orders")
def o26(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", scalars.tie_break(F.col("o_orderkey"), F.col("o_orderpriority")).alias("tie"))


@query("o28_stable_integer", "SELECT o_orderkey, ('0x' || substr(sha256(o_orderkey::VARCHAR || '|' || o_orderpriority), 1, 16))::UBIGINT::VARCHAR AS n FROM orders")
def o28(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", scalars.stable_integer(F.col("o_orderkey"), F.col("o_orderpriority")).cast("string").alias("n"))


@query("o27_uuid5")
def o27(spark, sf):
    return spark.read.parquet(f"{sf}/orders.parquet").select("o_orderkey", scalars.uuid5(F.col("o_orderkey"), F.col("o_orderpriority")).alias("id"))


_BAND = """CASE WHEN {0} IS NULL THEN 'unknown' WHEN ceil({0}) < 0 THEN 'outside_8h' WHEN ceil({0}) <= 180 THEN 'le_3h' WHEN ceil({0}) <= 360 THEN 'gt_3h_to_6h'
  WHEN ceil({0}) <= 420 THEN 'gt_6h_to_7h' WHEN ceil({0}) <= 480 THEN 'gt_7h_to_8h' ELSE 'outside_8h' END"""


@query("o29_duration_band", f"""SELECT event_id, {_BAND.format('m')} AS band FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN NULL
    WHEN event_id % 7 = 1 THEN 0 ELSE value END AS m FROM events)""")
def o29(spark, sf):
    key = F.col("event_id") % 7
    minutes = F.when(key == 0, F.when(F.col("event_id") % 2 == 0, float("nan"))).when(key == 1, 0.0).otherwise(F.col("value"))
    return spark.read.parquet(f"{sf}/events.parquet").select("event_id", scalars.duration_band(minutes).alias("band"))


@query("o61_safe_filename", """SELECT c_custkey, CASE WHEN clean = n AND clean <> '' THEN substr(clean, 1, 80) ELSE (CASE WHEN clean = '' THEN 'symbol' ELSE substr(clean, 1, 60) END) || '_' || substr(sha256(n), 1, 12) END AS file
  FROM (SELECT c_custkey, n, regexp_replace(regexp_replace(n, '[^A-Za-z0-9]+', '_', 'g'), '^_|_$', '', 'g') AS clean
    FROM (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN c_name || ' / ' || c_mktsegment WHEN 1 THEN replace(c_name, '#', '') WHEN 2 THEN '--' ELSE '__' || c_name || repeat('x', 90) END AS n FROM customer))""")
def o61(spark, sf):
    rows, key = spark.read.parquet(f"{sf}/customer.parquet"), F.col("c_custkey") % 4
    name = (
        F.when(key == 0, F.concat("c_name", F.lit(" / "), "c_mktsegment")).when(key == 1, F.replace("c_name", F.lit("#"), F.lit("")))
        .when(key == 2, "--").otherwise(F.concat(F.lit("__"), "c_name", F.lit("x" * 90)))
    )
    return rows.select("c_custkey", scalars.safe_filename(name).alias("file"))


@query("o62_o63_text_values", """SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'true' WHEN 1 THEN 'false' ELSE 'unknown' END AS flag, event_id % 4 IN (0, 2) AS maker,
  CASE WHEN event_id % 5 = 0 THEN NULL ELSE round(value, 6) END AS finite FROM events""")
def o62(spark, sf):
    rows = spark.read.parquet(f"{sf}/events.parquet")
    word = F.element_at(F.array(F.lit(" True "), F.lit("0"), F.lit("yes"), F.lit("f")), (F.col("event_id") % 4 + 1).cast("int"))
    wild = F.when(F.col("event_id") % 5 == 0, F.element_at(F.array(F.lit(float("nan")), F.lit(float("inf"))), (F.col("event_id") % 2 + 1).cast("int"))).otherwise(F.col("value"))
    flag = F.coalesce(src.parse_boolean(word).cast("string"), F.lit("unknown"))
    return rounded(rows.select("event_id", flag.alias("flag"), src.parse_flag(word).alias("maker"), scalars.finite_or_null(wild).alias("finite")))


@query("o19_times", f"""SELECT event_id, {_TS.format("date_trunc('minute', ts)")} AS minute, ts::DATE::VARCHAR AS day, {_TS.format('ts')} AS parsed,
    epoch_us(ts) // 1000 AS millis FROM events""")
def o19(spark, sf):
    ts = F.col("ts").cast("timestamp")
    text = F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), F.element_at(F.array(F.lit(""), F.lit("Z"), F.lit("+00:00")), (F.col("event_id") % 3 + 1).cast("int")))
    return rounded(spark.read.parquet(f"{sf}/events.parquet").select("event_id", scalars.minute_of(ts).alias("minute"), F.to_date(ts).alias("day"), scalars.iso_time(text).alias("parsed"), F.unix_millis(ts).alias("millis")))


# Surges


@query("o20_daily_prefilter", f"""WITH {_B}, da AS (SELECT symbol, date_trunc('day', open_time) AS d, max(high) AS high, min(low) AS low FROM ba
    GROUP BY 1, 2),
  pr AS (SELECT *, coalesce(date_diff('day', lag(d) OVER w, d) = 1, false) AS there, lag(low) OVER w AS before FROM da
    WINDOW w AS (PARTITION BY symbol ORDER BY d))
  SELECT symbol, d::DATE::VARCHAR AS event_date, there AS previous_day_bar_available, round(CASE WHEN there THEN least(low, before) ELSE low END,
    6) AS floor_low
  FROM pr WHERE high + 1e-15 >= (CASE WHEN there THEN least(low, before) ELSE low END) * 1.9""")
def o20(spark, sf):
    days = bars(spark, sf).groupBy("symbol", F.date_trunc("day", "open_time").alias("open_time")).agg(F.max("high").alias("high"), F.min("low").alias("low"))
    found = surge.daily_prefilter(days, 1.9)
    return rounded(found.select("symbol", F.to_date("open_time").alias("event_date"), "previous_day_bar_available", "floor_low"))


@query("o21_first_surge", f"""WITH {_S} SELECT symbol, event_date::VARCHAR AS event_date, {_TS.format('cross_time')} AS cross_time, round(cross_high,
    6) AS cross_high, {_TS.format('baseline_time')} AS baseline_time, round(baseline_low, 6) AS baseline_low, round(minutes_to_cross,
    6) AS minutes_to_cross FROM su""")
def o21(spark, sf):
    return rounded(first_surges(spark, sf))


@query("o22_crossing_mask", f"""WITH {_G} SELECT symbol, {_TS.format('open_time')} AS open_time,
  coalesce(sum(observed::INT) OVER w = 7 AND high >= min(low) OVER w * 1.25, false) AS crossing FROM gr WINDOW w AS ({_BY} ROWS BETWEEN 7 PRECEDING
    AND 1 PRECEDING)""")
def o22(spark, sf):
    return rounded(surge.crossing_mask(grid(spark, sf), WINDOW, FACTOR).select("symbol", "open_time", "crossing"))


_R = _S + """, bt AS (
  SELECT su.symbol, event_date, max(ts) AS baseline_trade_time FROM su JOIN tr ON tr.symbol = su.symbol AND ts >= baseline_time AND ts < baseline_time + INTERVAL 1 HOUR
  WHERE abs(price - baseline_low) <= greatest(abs(baseline_low) * 1e-12, 1e-15) GROUP BY 1, 2
), ct AS (
  SELECT su.symbol, event_date, first(ts ORDER BY ts, trade_id) AS cross_trade_time, first(price ORDER BY ts, trade_id) AS cross_trade_price
  FROM su JOIN tr ON tr.symbol = su.symbol AND ts >= cross_time AND ts < cross_time + INTERVAL 1 HOUR
  WHERE price + greatest(abs(baseline_low) * 1e-12, 1e-15) >= baseline_low * 1.25 GROUP BY 1, 2
), re AS (SELECT su.*, baseline_trade_time, cross_trade_time, cross_trade_price FROM su LEFT JOIN bt USING (symbol, event_date) LEFT JOIN ct USING (symbol, event_date))"""


@query("o23_o24_resolved_trades", f"""WITH {_R} SELECT symbol, event_date::VARCHAR AS event_date,
    {_TS.format('baseline_trade_time')} AS baseline_trade_time, {_TS.format('cross_trade_time')} AS cross_trade_time, round(cross_trade_price,
    6) AS cross_trade_price FROM re""")
def o23(spark, sf):
    found = surge.resolved_trades(first_surges(spark, sf), tape(spark, sf), "1 hour", FACTOR)
    return rounded(found.select("symbol", "event_date", "baseline_trade_time", "cross_trade_time", "cross_trade_price"))


@query("o25_saleability", f"""WITH {_R}, af AS (
  SELECT re.symbol, event_date, ts, trade_id, price, qty, price * qty AS notional, is_buyer_maker,
         price + greatest(abs(baseline_low) * 1e-12, 1e-15) >= baseline_low * {FACTOR} AS at_level
  FROM re JOIN tr ON tr.symbol = re.symbol AND ts BETWEEN cross_trade_time AND cross_trade_time + INTERVAL 6 HOUR
), se AS (
  SELECT *, coalesce(sum(notional) OVER (PARTITION BY symbol, event_date ORDER BY ts, trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
    0) AS before
  FROM af WHERE is_buyer_maker
), le AS (
  SELECT symbol, event_date, sum(CASE WHEN at_level THEN notional ELSE 0 END) AS level_notional,
         sum(CASE WHEN at_level AND is_buyer_maker THEN notional ELSE 0 END) AS sell_notional_at_level, sum(CASE
    WHEN is_buyer_maker THEN qty ELSE 0 END) AS sell_base
  FROM af GROUP BY 1, 2
), su2 AS (
  SELECT symbol, event_date, sum(notional) AS sell_notional, min(price) AS lowest_sell, max(price) AS highest_sell, min(ts) AS first_sell_time,
         min(CASE WHEN before + notional + 1e-12 >= 20000.0 THEN ts END) AS quote_reached_time,
         first(price ORDER BY ts, trade_id) FILTER (WHERE before + notional + 1e-12 >= 20000.0) AS quote_reached_price,
         sum(greatest(0.0, least(notional, 20000.0 - before)) / price) AS exit_base
  FROM se GROUP BY 1, 2)
SELECT symbol, event_date::VARCHAR AS event_date, {', '.join(f"CASE WHEN cross_trade_time IS NOT NULL THEN round(coalesce({c}, 0), 4) END AS {c}"
    for c in ("level_notional", "sell_notional_at_level", "sell_base", "sell_notional"))},
  round(lowest_sell, 4) AS lowest_sell, round(highest_sell, 4) AS highest_sell, {_TS.format('first_sell_time')} AS first_sell_time,
    {_TS.format('quote_reached_time')} AS quote_reached_time,
  round(quote_reached_price, 4) AS quote_reached_price, CASE WHEN quote_reached_time IS NOT NULL THEN round(20000.0 / exit_base, 4) END AS exit_vwap,
  coalesce(epoch_us(cross_trade_time) > epoch_us(baseline_trade_time)
    AND epoch_us(cross_trade_time) - epoch_us(baseline_trade_time) <= 480 * 60000000::BIGINT AND sell_notional + 1e-12 >= 20000.0, false) AS saleable
FROM re LEFT JOIN le USING (symbol, event_date) LEFT JOIN su2 USING (symbol, event_date)""")
def o25(spark, sf):
    """With a quote that some events' sellers don't reach."""
    resolved = surge.resolved_trades(first_surges(spark, sf), tape(spark, sf), "1 hour", FACTOR)
    found = surge.saleability(resolved, tape(spark, sf), 6 * 3600, 20000.0, WINDOW * 60, FACTOR)
    shown = (
        "level_notional", "sell_notional_at_level", "sell_base", "sell_notional", "lowest_sell", "highest_sell", "first_sell_time", "quote_reached_time",
        "quote_reached_price", "exit_vwap", "saleable",
    )
    return rounded(found.select("symbol", "event_date", *shown), 4)


_EVENT_NUMBERS = (
    "day_open", "day_high", "day_close", "day_quote", "first_close", "previous_close", "volume_before", "previous_close_to_high", "open_to_high", "first_close_to_high",
    "gain_at_cross", "exact_seconds",
)
_EVENT_COUNTS = ("day_trades", "bars", "bars_before", "missing_bars", "missing_window_bars", "day_minutes_to_cross", "day_minutes_to_peak")
_ER = _R + """, el AS (
  SELECT re.*, ba.* EXCLUDE (symbol), event_date::TIMESTAMP AS day, open_time >= event_date AS own, open_time >= event_date - INTERVAL 8 HOUR AS loaded
  FROM re JOIN ba ON ba.symbol = re.symbol AND open_time >= event_date - INTERVAL 1 DAY AND open_time < event_date + INTERVAL 1 DAY
), et AS (
  SELECT symbol, event_date, first(open ORDER BY open_time) FILTER (own) AS day_open, max(high) FILTER (own) AS day_high, last(close ORDER BY open_time) FILTER (own) AS day_close,
    sum(quote_volume) FILTER (own) AS day_quote, sum(trade_count) FILTER (own)::BIGINT AS day_trades, first(close ORDER BY open_time) FILTER (own) AS first_close,
    first(open_time ORDER BY high DESC, open_time) FILTER (own) AS peak_time, last(close ORDER BY open_time) FILTER (NOT own) AS before_close, count(*) FILTER (own) AS bars,
    count(*) FILTER (loaded AND open_time < cross_time) AS bars_before, coalesce(sum(quote_volume) FILTER (loaded AND open_time < cross_time), 0) AS volume_before,
    count(*) FILTER (loaded) AS n_loaded, count(*) FILTER (open_time BETWEEN baseline_time AND cross_time) AS n_window FROM el GROUP BY 1, 2
), eq AS (
  SELECT re.*, et.* EXCLUDE (symbol, event_date), coalesce(before_close, day_open) AS previous_close, (epoch_us(cross_trade_time) - epoch_us(baseline_trade_time)) / 1e6::DOUBLE AS exact_seconds,
    coalesce(exact_seconds > 0 AND exact_seconds <= 28800, false) AS exact_window, greatest(0, 32 - n_loaded) AS missing_bars,
    greatest(0, ((epoch(cross_time) - epoch(baseline_time)) / 3600)::BIGINT + 1 - n_window) AS missing_window_bars, cross_time = event_date AS crossed_in_first_bar,
    ((epoch(cross_time) - epoch(event_date::TIMESTAMP)) / 60)::BIGINT AS day_minutes_to_cross, ((epoch(peak_time) - epoch(event_date::TIMESTAMP)) / 60)::BIGINT AS day_minutes_to_peak,
    (day_high / coalesce(before_close, day_open) - 1) * 100 AS previous_close_to_high, (day_high / day_open - 1) * 100 AS open_to_high, (day_high / first_close - 1) * 100 AS first_close_to_high,
    (cross_trade_price / baseline_low - 1) * 100 AS gain_at_cross FROM re JOIN et USING (symbol, event_date)
), er AS (
  SELECT *, CASE WHEN missing_bars > 0 OR missing_window_bars > 0 OR baseline_trade_time IS NULL OR cross_trade_time IS NULL OR NOT exact_window THEN 'warning' ELSE 'pass' END AS quality FROM eq)"""


def event_records(spark: SparkSession, sf: str) -> DataFrame:
    resolved = surge.resolved_trades(first_surges(spark, sf), stored(spark, sf), "1 hour", FACTOR)
    return surge.event_records(resolved, bars(spark, sf), 3600, WINDOW * 3600)


@query("o64_event_record", f"""WITH {_ER} SELECT symbol, event_date::VARCHAR AS event_date, {_TS.format('peak_time')} AS peak_time, exact_window,
    crossed_in_first_bar, quality,
  {', '.join(f'{c}::BIGINT AS {c}' for c in _EVENT_COUNTS)}, {', '.join(f'round({c}, 4) AS {c}' for c in _EVENT_NUMBERS)} FROM er""")
def o64(spark, sf):
    found = event_records(spark, sf).select("symbol", "event_date", "peak_time", "exact_window", "crossed_in_first_bar", "quality", *_EVENT_COUNTS, *_EVENT_NUMBERS)
    return rounded(found.withColumns({c: F.col(c).cast("long") for c in _EVENT_COUNTS}), 4)


@query("o65_decisions", f"""WITH {_B}, mo AS (SELECT * REPLACE (open_time + INTERVAL 150 DAY AS open_time) FROM ba), al AS (SELECT * FROM ba UNION ALL
    SELECT * FROM mo),
  da AS (SELECT DISTINCT symbol, CAST(open_time AS DATE) AS event_date FROM al),
  tg AS (SELECT *, event_date + h * INTERVAL 1 HOUR - CASE WHEN month(event_date) BETWEEN 5
    AND 7 THEN INTERVAL 1 HOUR ELSE INTERVAL 0 HOUR END AS target FROM da, unnest([14, 17, 19]) AS u(h)),
  af AS (SELECT tg.*, open_time, close, high, min(open_time) OVER w + INTERVAL 1 HOUR AS entry_time, first(close) OVER w AS entry FROM tg
    JOIN al ON al.symbol = tg.symbol AND CAST(open_time AS DATE) = event_date AND open_time >= target
         WINDOW w AS (PARTITION BY tg.symbol, event_date, h ORDER BY open_time))
  SELECT symbol, event_date::VARCHAR AS event_date, h::INT AS hour, {_TS.format('min(target)')} AS decision_time,
    {_TS.format('min(entry_time)')} AS entry_time, round(min(entry), 6) AS entry_price, round(max(high), 6) AS peak,
         {_TS.format('first(open_time ORDER BY high DESC, open_time)')} AS peak_time, round((max(high) / min(entry) - 1) * 100, 6) AS max_gain FROM af
    WHERE open_time >= entry_time GROUP BY 1, 2, 3""")
def o65(spark, sf):
    """January keeps UTC in London; the same bars 150 days later fall into its summer time."""
    own = bars(spark, sf)
    all_ = own.unionByName(own.withColumn("open_time", F.expr("open_time + interval 150 days")))
    dates = all_.select("symbol", F.to_date("open_time").alias("event_date")).distinct()
    return rounded(surge.decision_observations(all_, dates, "1 hour"))


def _baselines_sql(factor: float) -> str:
    """ab: the algorithmic baseline of each bar taken as a crossing, over the grid gr."""
    gain = "(f.high_after / w.base.l - 1) * 100"
    return f"""nu AS (SELECT *, row_number() OVER ({_BY}) AS i FROM gr), wi AS (
  SELECT symbol, open_time, i, sum(observed::INT) OVER b = 7 AS whole, min(CASE WHEN observed THEN struct_pack(l := low, m := -i) END) OVER b AS base,
         CASE WHEN sum(observed::INT) OVER a = 7 THEN max(high) OVER a END AS high_after FROM nu
  WINDOW b AS ({_BY} ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING), a AS ({_BY} ROWS BETWEEN 1 FOLLOWING AND 7 FOLLOWING)
), ab AS (
  SELECT w.symbol, w.open_time, f.open_time AS baseline_time, w.base.l AS baseline_low, CAST(w.i + w.base.m AS BIGINT) AS duration,
    {gain} AS future_gain,
         coalesce({gain} + 1e-12 >= {(factor - 1) * 100}, false) AS contaminated
  FROM wi w JOIN wi f ON f.symbol = w.symbol AND f.i = -w.base.m WHERE w.whole AND f.high_after IS NOT NULL)"""


@query("o38_algorithmic_baseline", f"""WITH {_G}, {_baselines_sql(FACTOR)}
  SELECT symbol, {_TS.format('open_time')} AS open_time, {_TS.format('baseline_time')} AS baseline_time, round(baseline_low, 6) AS baseline_low,
    duration,
         round(future_gain, 6) AS future_gain, contaminated FROM ab""")
def o38(spark, sf):
    found = surge.algorithmic_baseline(grid(spark, sf), WINDOW, FACTOR)
    return rounded(found.withColumn("duration", F.col("duration").cast("long")))


@query("o38_first_future_cross", f"""WITH {_G}, {_baselines_sql(FACTOR)}
  SELECT ab.symbol, {_TS.format('ab.open_time')} AS open_time, {_TS.format('min(gr.open_time)')} AS first_future_cross
  FROM ab LEFT JOIN gr ON contaminated AND gr.symbol = ab.symbol AND gr.open_time > baseline_time AND gr.open_time <= baseline_time + INTERVAL 7 HOUR
    AND gr.high >= baseline_low * {FACTOR} GROUP BY 1, 2""")
def o38_crosses(spark, sf):
    bars_ = grid(spark, sf)
    found = surge.first_future_cross(surge.algorithmic_baseline(bars_, WINDOW, FACTOR), bars_, WINDOW, FACTOR, 3600)
    return rounded(found.select("symbol", "open_time", "first_future_cross"))


# Window features


def _agg_sql(w: int) -> str:
    f = f"OVER ({_BY} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"round((close / lag(close, {w}) OVER ({_BY}) - 1) * 100, 6) AS return_{w}, round(sum(observed::INT) {f} / {w}.0, 6) AS observed_{w}, "
        f"round((max(high) {f} / min(low) {f} - 1) * 100, 6) AS range_{w}, round(sum(quote_volume) {f}, 4) AS quote_{w}, CAST(sum(trade_count) {f} AS BIGINT) AS trades_{w}, "
        f"round(sum(quote_volume) {f} / nullif(sum(trade_count) {f}, 0) + 1e-9, 4) AS trade_quote_{w}, "
        f"round(sum(taker_buy_quote) {f} / nullif(sum(quote_volume) {f}, 0), 6) AS taker_{w}"
    )


_AGGREGATES = ("return", "observed", "range", "quote", "trades", "trade_quote", "taker")


@query("o44_o45_window_aggregates", f"WITH {_G} SELECT symbol, {_TS.format('open_time')} AS open_time, {_agg_sql(4)}, {_agg_sql(48)} FROM gr")
def o44(spark, sf):
    """A narrow window and a wide one. Averages that lie between two shown values go up in both engines."""
    out = rolling.window_aggregates(grid(spark, sf), [4, 48]).withColumns({
        f"{c}_{w}": F.round(F.col(f"{c}_{w}") + more, 4) for w in (4, 48) for c, more in (("quote", 0.0), ("trade_quote", 1e-9))
    })
    return rounded(out.select("symbol", "open_time", *(f"{m}_{w}" for w in (4, 48) for m in _AGGREGATES)))


_MINUTES = """gm AS (
  SELECT s.symbol, t.open_time, ba.* EXCLUDE (symbol, open_time), ba.close IS NOT NULL AS observed FROM (SELECT DISTINCT symbol FROM ba) s
  CROSS JOIN (SELECT unnest(generate_series(a, b + INTERVAL 1439 MINUTE, INTERVAL 1 MINUTE)) AS open_time
    FROM (SELECT date_trunc('day', min(open_time)) AS a, date_trunc('day', max(open_time)) AS b FROM ba)) t
  LEFT JOIN ba ON ba.symbol = s.symbol AND ba.open_time = t.open_time)"""


def _minute_sql(w: int) -> str:
    f = f"OVER ({_BY} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"round(sum(observed::INT) {f} / {w}.0, 6) AS observed_{w}, round((max(high) {f} / min(low) {f} - 1) * 100, 6) AS range_{w}, round(sum(quote_volume) {f}, 3) AS quote_{w}, "
        f"CAST(sum(trade_count) {f} AS BIGINT) AS trades_{w}"
    )


@query("o45_o49_minute_windows", f"""WITH {_B.replace("date_trunc('hour', ts)", "date_trunc('minute', ts)")}, {_MINUTES}, st AS (
    SELECT symbol, open_time, close, {_minute_sql(60)}, {_minute_sql(4320)}, min(low) OVER d AS l, max(high) OVER d AS h FROM gm
    WINDOW d AS ({_BY} ROWS BETWEEN 1439 PRECEDING AND CURRENT ROW))
  SELECT symbol, {_TS.format('open_time')} AS open_time, {', '.join(f'{c}_{w}' for w in (60, 4320) for c in ('observed', 'range', 'quote', 'trades'))},
         CASE WHEN h > l THEN round((close - l) / (h - l), 6) END AS position_1440 FROM st""")
def o45_minutes(spark, sf):
    """Minute bars and the protocol's widths: an hour, a day and three days; a symbol goes through several tasks."""
    def features(g: DataFrame) -> DataFrame:
        return rolling.range_position(rolling.window_aggregates(g, [60, 4320]), 1440)

    minutes = src.dense_grid(src.bars(tape(spark, sf), "minute"), step="1 minute")
    out = windows.in_time_chunks(minutes, features, 4320, 60).withColumns({f"quote_{w}": F.round(f"quote_{w}", 3) for w in (60, 4320)})
    columns = [f"{c}_{w}" for w in (60, 4320) for c in ("observed", "range", "quote", "trades")]
    return rounded(out.select("symbol", "open_time", *columns, F.col("position").alias("position_1440")))


@query("o47_o48_volatility", f"""WITH {_G}, cl AS (SELECT symbol, open_time,
    list(close) FILTER (close IS NOT NULL) OVER ({_BY} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS c FROM gr),
  lr AS (SELECT symbol, open_time, len(c) AS n, list_transform(range(2, len(c) + 1), lambda k: ln(c[k]) - ln(c[k - 1])) AS r FROM cl)
  SELECT symbol, {_TS.format('open_time')} AS open_time, CASE WHEN n >= 19 THEN round(list_aggregate(r, 'stddev_samp') * sqrt(24.0) * 100,
    6) END AS volatility,
  CASE WHEN n > 1 THEN round(len(list_filter(r, lambda x: x > 0)) / len(r)::DOUBLE, 6) END AS up_part FROM lr""")
def o47(spark, sf):
    return rounded(rolling.realized_volatility(grid(spark, sf), 24).select("symbol", "open_time", "volatility", "up_part"))


@query("o49_range_position", f"""WITH {_G}, nu AS (SELECT *, row_number() OVER ({_BY}) AS i FROM gr), ex AS (
  SELECT *, max(high) OVER w AS h, min(low) OVER w AS l, max(CASE WHEN observed THEN struct_pack(a := high, b := i) END) OVER w AS t, max(CASE
    WHEN observed THEN struct_pack(a := -low, b := i) END) OVER w AS o
  FROM nu WINDOW w AS ({_BY} ROWS BETWEEN 47 PRECEDING AND CURRENT ROW))
  SELECT symbol, {_TS.format('open_time')} AS open_time, CASE WHEN h > l THEN round((close - l) / (h - l), 6) END AS position, CASE
    WHEN h > l THEN round((close / h - 1) * 100, 6) END AS vs_high,
  CASE WHEN h > l THEN round((close / l - 1) * 100, 6) END AS vs_low, i - t.b AS bars_since_high, i - o.b AS bars_since_low FROM ex""")
def o49(spark, sf):
    out = rolling.range_position(grid(spark, sf), 48).select("symbol", "open_time", "position", "vs_high", "vs_low", "bars_since_high", "bars_since_low")
    return rounded(out.withColumns({c: F.col(c).cast("long") for c in ("bars_since_high", "bars_since_low")}))


@query("o46_drawdown_runup", f"""WITH {_G}, nu AS (SELECT symbol, open_time, close, row_number() OVER ({_BY}) AS i FROM gr),
  pt AS (SELECT a.symbol, a.open_time, b.close / max(b.close) OVER w - 1 AS dd, b.close / min(b.close) OVER w - 1 AS ru
    FROM nu a JOIN nu b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 7 AND a.i AND b.close IS NOT NULL WINDOW w AS (PARTITION BY a.symbol, a.open_time
    ORDER BY b.i))
  SELECT symbol, {_TS.format('open_time')} AS open_time, CASE WHEN count(dd) >= 2 THEN round(min(dd) * 100, 6) END AS drawdown, CASE
    WHEN count(dd) >= 2 THEN round(max(ru) * 100, 6) END AS runup
  FROM nu LEFT JOIN pt USING (symbol, open_time) GROUP BY symbol, open_time""")
def o46(spark, sf):
    return rounded(rolling.drawdown_runup(grid(spark, sf), 8).select("symbol", "open_time", "drawdown", "runup"))


@query("o50_log_trend", f"""WITH {_G}, nu AS (SELECT symbol, open_time, close, row_number() OVER ({_BY}) AS i FROM gr),
  pt AS (SELECT a.symbol, a.open_time, ln(b.close) AS y, row_number() OVER (PARTITION BY a.symbol, a.open_time ORDER BY b.i) - 1 AS k,
    count(*) OVER (PARTITION BY a.symbol, a.open_time) AS n
    FROM nu a JOIN nu b ON a.symbol = b.symbol AND b.i BETWEEN a.i - 23 AND a.i AND b.close IS NOT NULL),
  st AS (SELECT symbol, open_time, regr_slope(y, k::DOUBLE) AS s, CASE WHEN var_pop(y) > 0 THEN regr_r2(y, k::DOUBLE) END AS r FROM pt WHERE n >= 6
    AND k % greatest(1, ceil(n / 10.0)::INT) = 0 GROUP BY 1, 2)
  SELECT nu.symbol, {_TS.format('nu.open_time')} AS open_time, round((exp(s * 24) - 1) * 100, 4) AS trend, round(r, 4) AS trend_r2 FROM nu LEFT
    JOIN st USING (symbol, open_time)""")
def o50(spark, sf):
    return rounded(rolling.log_trend(grid(spark, sf), 24, 24, most=10).select("symbol", "open_time", "trend", "trend_r2"), 4)


#: Sums over four bars; every fifth day's are zero, which count as values.
_CLOCK_LAGS = ", ".join(f"lag(v, {24 * d}) OVER ({_BY})" for d in range(1, 8))


@query("o53_o80_same_clock", f"""WITH {_G}, z AS (SELECT symbol, open_time, CASE WHEN day(open_time) % 5 < 4 THEN quote_volume
    WHEN quote_volume IS NOT NULL THEN 0 END AS q FROM gr),
  v AS (SELECT symbol, open_time, CASE WHEN count(q) OVER w = 4 THEN sum(q) OVER w END AS v FROM z WINDOW w AS ({_BY} ROWS BETWEEN 3 PRECEDING
    AND CURRENT ROW)),
  e AS (SELECT *, list_filter([{_CLOCK_LAGS}], lambda x: x IS NOT NULL) AS e FROM v)
  SELECT symbol, {_TS.format('open_time')} AS open_time, len(e)::INT AS clock_days, CASE WHEN len(e) >= 1 THEN round(v / nullif(list_median(e), 0),
    6) END AS clock_ratio,
  CASE WHEN len(e) >= 5 THEN round(v / nullif(list_median(e), 0), 6) END AS clock_ratio_of_5 FROM e""")
def o53(spark, sf):
    """Zero sums are values of their days; a median of zero gives null."""
    zero = F.when(F.dayofmonth("open_time") % 5 < 4, F.col("quote_volume")).when(F.col("quote_volume").isNotNull(), 0.0)
    rows = windows.whole(grid(spark, sf).withColumn("q", zero), "v", "sum", F.col("q"), 4)
    out = rolling.whole_clock_ratio(rows, F.col("v"), 24).withColumn("clock_ratio_of_5", F.when(F.col("clock_days") >= 5, F.col("clock_ratio")))
    return rounded(out.select("symbol", "open_time", "clock_days", "clock_ratio", "clock_ratio_of_5"))


@query("o57_candle_shape", f"""WITH {_B} SELECT symbol, {_TS.format('open_time')} AS open_time, round(abs(close - open) / nullif(high - low, 0),
    6) AS body, round((high - greatest(open, close)) / nullif(high - low, 0), 6) AS upper, round((least(open, close) - low) / nullif(high - low, 0),
    6) AS lower FROM ba""")
def o57(spark, sf):
    return rounded(rolling.candle_shape(bars(spark, sf)).select("symbol", "open_time", "body", "upper", "lower"))


@query("o58_outcomes", f"""WITH {_G} SELECT symbol, {_TS.format('open_time')} AS open_time, round((max(high) OVER w / close - 1) * 100,
    6) AS outcome_gain, round((min(low) OVER w / close - 1) * 100, 6) AS outcome_drawdown,
  round(coalesce(avg(observed::INT) OVER w, 0), 6) AS outcome_coverage FROM gr WINDOW w AS ({_BY} ROWS BETWEEN 1 FOLLOWING AND 40 FOLLOWING)""")
def o58(spark, sf):
    return rounded(rolling.outcomes(grid(spark, sf), 40).select("symbol", "open_time", "outcome_gain", "outcome_drawdown", "outcome_coverage"))
