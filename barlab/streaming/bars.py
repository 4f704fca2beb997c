"""Bars from a stream of trades."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def stream_bars(trades: DataFrame, unit: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """The bars of ``sources.trades.bars`` from a stream of trades. A bar is given out once the watermark, ``late`` behind
    the latest trade, has passed it; trades that come later still are dropped. State is one row a symbol and open bar."""
    order, quote = F.struct("ts", "trade_id"), F.col("price") * F.col("qty")
    bars = trades.withWatermark("ts", late).groupBy("symbol", F.window("ts", unit).alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        F.sum("qty").alias("volume"), F.sum(quote).alias("quote_volume"), F.count(F.lit(1)).alias("trade_count"),
        F.sum(F.when(~F.col("is_buyer_maker"), quote).otherwise(0.0)).alias("taker_buy_quote"),
    )
    return bars.select("symbol", F.col("w.start").alias("open_time"), *bars.columns[2:])
