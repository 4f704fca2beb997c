"""Trade tapes and bars: readers, normalisers and the dense grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Integers above this are microseconds since the epoch, others milliseconds.
MICROSECONDS_ABOVE = 10_000_000_000_000


def epoch_millis(value: Column) -> Column:
    """Milliseconds from an epoch integer in milliseconds or microseconds."""
    return F.when(value > MICROSECONDS_ABOVE, F.floor(value / 1000)).otherwise(value).cast("long")


def parse_flag(value: Column) -> Column:
    """Whether a maker flag is set: true, 1, t or yes; anything else isn't."""
    return F.coalesce(F.lower(F.trim(value)).isin("true", "1", "t", "yes"), F.lit(False))


def parse_boolean(value: Column) -> Column:
    """True from true or 1, false from false or 0, null from anything else."""
    word = F.lower(F.trim(value))
    return F.when(word.isin("true", "1"), True).when(word.isin("false", "0"), False)


def event_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as a trade tape: symbol, trade_id, ts, price, qty, is_buyer_maker."""
    k = F.get_json_object("props", "$.k").cast("int")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_type").alias("symbol"), F.col("event_id").alias("trade_id"), F.col("ts").cast("timestamp").alias("ts"),
        (F.lit(400.0) + F.col("value")).alias("price"), ((k + 1) / F.lit(10.0)).alias("qty"), (k % 2 == 0).alias("is_buyer_maker"),
    )


def normalised_trades(raw: DataFrame) -> DataFrame:
    """From text columns symbol, id, price, quantity, time (ms or µs), maker: typed trades. Rows whose number fields
    don't parse (headers among them) are dropped."""
    typed = raw.select(
        "symbol", F.expr("try_cast(id AS BIGINT)").alias("trade_id"),
        F.timestamp_millis(epoch_millis(F.expr("try_cast(time AS BIGINT)"))).alias("ts"),
        F.expr("try_cast(price AS DOUBLE)").alias("price"), F.expr("try_cast(quantity AS DOUBLE)").alias("qty"),
        parse_flag(F.col("maker")).alias("is_buyer_maker"),
    )
    return typed.dropna(subset=["ts", "price", "qty"])


def trade_range(trades: DataFrame, start: str, end: str) -> DataFrame:
    """Trades in [start, end], both ends included, one row for each symbol and id (the latest). Of a stored tape only the
    range's days are read."""
    first, last = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    inside = trades.where(F.col("ts").between(first, last))
    if "day" in trades.columns:
        inside = inside.where(F.col("day").between(F.date_format(first, "yyyy-MM-dd"), F.date_format(last, "yyyy-MM-dd"))).drop("day", "slot")
    latest = Window.partitionBy("symbol", "trade_id").orderBy(F.desc("ts"))
    return inside.withColumn("n", F.row_number().over(latest)).where("n = 1").drop("n")


def before_cutoff(raw: DataFrame, cutoff_ms: int, column: str = "time") -> DataFrame:
    """Rows whose time lies before the cutoff, with timestamp_ms_normalized; rows whose time doesn't parse are dropped."""
    time = epoch_millis(F.expr(f"try_cast({column} AS BIGINT)"))
    return raw.withColumn("timestamp_ms_normalized", time).where(F.col("timestamp_ms_normalized") < cutoff_ms)


def bars(trades: DataFrame, unit: str = "hour") -> DataFrame:
    """Bars of one ``unit``: symbol, open_time, OHLC, volume, quote_volume, trade_count, taker_buy_quote."""
    order = F.struct("ts", "trade_id")
    quote = F.col("price") * F.col("qty")
    return trades.groupBy("symbol", F.date_trunc(unit, "ts").alias("open_time")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("qty").alias("volume"), F.sum(quote).alias("quote_volume"), F.count(F.lit(1)).alias("trade_count"),
        F.sum(F.when(~F.col("is_buyer_maker"), quote).otherwise(0.0)).alias("taker_buy_quote"),
    )


def dense_grid(bar: DataFrame, start: str | None = None, end: str | None = None, step: str = "1 hour") -> DataFrame:
    """Every step of [start, end) for every symbol; missing bars are null rows with observed = false. Without bounds the
    grid runs over the whole days of the data. Of bars with one symbol and time the one that comes last by its other
    columns stays. Only one row of bounds meets the symbols, so nothing is crossed."""
    first = F.lit(start).cast("timestamp") if start else F.date_trunc("day", F.min("open_time"))
    past = F.lit(end).cast("timestamp") if end else F.date_trunc("day", F.max("open_time")) + F.expr("interval 1 day")
    bounds = bar.agg(first.alias("first"), past.alias("past")).where("first < past")
    times = F.explode(F.expr(f"sequence(first, past - interval {step}, interval {step})")).alias("open_time")
    slots = bar.select("symbol").distinct().join(F.broadcast(bounds)).select("symbol", times)
    rest = [c for c in bar.columns if c not in ("symbol", "open_time")]
    one = bar.groupBy("symbol", "open_time").agg(F.max(F.struct(*rest)).alias("b")).select("symbol", "open_time", "b.*")
    return slots.join(one, ["symbol", "open_time"], "left").withColumn("observed", F.col("close").isNotNull())


#: Positions of a bar's columns in archive rows (fixed by the format).
BAR_COLUMNS = (
    "open_time", "open", "high", "low", "close", "volume", "close_time", "quote_volume", "trade_count", "taker_buy_base", "taker_buy_quote",
)


def normalised_bars(raw: DataFrame) -> DataFrame:
    """From text columns symbol and BAR_COLUMNS: typed bars. Rows whose open_time isn't a number (headers) are dropped;
    times are milliseconds or microseconds; a missing trade count is 0, other values that don't parse are null."""
    time = lambda c: F.timestamp_millis(F.coalesce(epoch_millis(F.expr(f"try_cast({c} AS BIGINT)")), F.lit(0)))
    number = lambda c: F.expr(f"try_cast({c} AS DOUBLE)").alias(c)
    kept = raw.where(F.expr("try_cast(open_time AS BIGINT)").isNotNull())
    return kept.select(
        "symbol", time("open_time").alias("open_time"), *map(number, BAR_COLUMNS[1:6]), time("close_time").alias("close_time"),
        number("quote_volume"), F.coalesce(F.expr("try_cast(try_cast(trade_count AS DOUBLE) AS BIGINT)"), F.lit(0)).alias("trade_count"),
        number("taker_buy_base"), number("taker_buy_quote"),
    )


def write_before_cutoff(raw: DataFrame, cutoff_ms: int, path: str, column: str = "time") -> DataFrame:
    """Writes the rows before the cutoff as zstd Parquet (typed even where none are left) and returns them as read."""
    before_cutoff(raw, cutoff_ms, column).write.option("compression", "zstd").parquet(path)
    return raw.sparkSession.read.parquet(path)


def exchange_symbols(info: DataFrame) -> DataFrame:
    """``info``: rows with an array ``symbols`` of pairs as an exchange lists them. One row a pair: symbol, base, quote,
    status, spot (permitted by either list), trading (allowed, or as spot where not said), limit (such orders exist),
    stable and leveraged (by the base's name)."""
    pair = info.select(F.explode("symbols").alias("s"))
    spot = F.coalesce(F.array_contains("s.permissions", "SPOT"), F.lit(False)) | F.coalesce(
        F.exists("s.permissionSets", lambda group: F.coalesce(F.array_contains(group, "SPOT"), F.lit(False))), F.lit(False)
    )
    return pair.select(
        "s.symbol", F.col("s.baseAsset").alias("base"), F.col("s.quoteAsset").alias("quote"), "s.status", spot.alias("spot"),
        F.coalesce("s.isSpotTradingAllowed", spot).alias("trading"), F.coalesce(F.array_contains("s.orderTypes", "LIMIT"), F.lit(False)).alias("limit"),
        F.col("s.baseAsset").isin(*STABLE_BASES).alias("stable"), F.col("s.baseAsset").rlike("(UP|DOWN|BULL|BEAR)$").alias("leveraged"),
    )


#: Bases that are currencies or stand for one.
STABLE_BASES = ("USDT", "USDC", "FDUSD", "TUSD", "USDP", "DAI", "EUR", "GBP", "TRY", "BRL", "AUD")


def archive_paths(days: DataFrame, root: str, kind: str, interval: str | None = None, monthly: bool = False) -> DataFrame:
    """``days``: symbol, day. Adds path, where an archive under ``root`` keeps that day (or month) of bars (klines, with
    their interval), aggTrades or trades."""
    if kind not in ("klines", "aggTrades", "trades"):
        raise ValueError(kind)
    if (kind == "klines") != (interval is not None):
        raise ValueError("bars, and they alone, have an interval")
    stamp = F.date_format("day", "yyyy-MM" if monthly else "yyyy-MM-dd")
    name = interval or kind
    folder = [F.lit(f"{root}/{'monthly' if monthly else 'daily'}/{kind}"), F.col("symbol"), *([F.lit(interval)] if interval else [])]
    return days.withColumn("path", F.concat_ws("/", *folder, F.concat_ws("-", "symbol", F.lit(name), F.concat(stamp, F.lit(".zip")))))
