"""Fills on the trade tape, exits, fees and what a trade made."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.staging import staged
from .surge import near_trades


def fills(orders: DataFrame, trades: DataFrame, buyer: bool, start: str, end: str, quote: float | None = None, base: str | None = None, bucket_seconds: int = 3600) -> DataFrame:
    """``orders``: order_id, symbol and times. Consumes trades of the aggressor's side in [start, end], in order of
    time and id, until ``quote`` units are spent or the order's ``base`` units are sold; the last trade in part.
    Returns order_id, filled_base, filled_quote, vwap, fill_time, fill_count, complete."""
    if (quote is None) == (base is None):
        raise ValueError("give one target: quote or base")
    side = trades.where((F.col("is_buyer_maker") != F.lit(buyer)) & (F.col("price") > 0) & (F.col("qty") > 0))
    tape = near_trades(orders, side, start, end, bucket_seconds).withColumn("amount", F.col("price") * F.col("qty") if base is None else F.col("qty"))
    goal = F.lit(quote) if base is None else F.col(base)
    before = Window.partitionBy("order_id").orderBy("ts", "trade_id").rowsBetween(Window.unboundedPreceding, -1)
    left = goal - F.coalesce(F.sum("amount").over(before), F.lit(0.0))
    used = tape.withColumn("left", left).where(F.col("left") > (1e-12 if base is None else 1e-15)).withColumn("part", F.least("amount", "left"))
    bought = F.col("part") / F.col("price") if base is None else F.col("part")
    done = F.sum("part") >= F.max(goal) - (1e-8 if base is None else 1e-12)
    return used.withColumns({"b": bought, "q": bought * F.col("price")}).groupBy("order_id").agg(
        F.sum("b").alias("filled_base"), F.sum("q").alias("filled_quote"), F.try_divide(F.sum("q"), F.sum("b")).alias("vwap"),
        F.max("ts").alias("fill_time"), F.count(F.lit(1)).alias("fill_count"), done.alias("complete"),
    )


def held_path(entries: DataFrame, trades: DataFrame, hold_seconds: int, bucket_seconds: int = 3600) -> DataFrame:
    """``entries``: order_id, symbol, fill_time, vwap. Trades of either side strictly after the entry and within the
    holding time, with their gain in percent."""
    held = entries.withColumns({"from_": F.expr("fill_time + interval 1 microsecond"), "to_": F.expr(f"fill_time + interval {hold_seconds} seconds")})
    path = near_trades(held, trades.where(F.col("price") > 0), "from_", "to_", bucket_seconds)
    return path.withColumn("gain", (F.col("price") / F.col("vwap") - 1) * 100)


def path_ladder(entries: DataFrame, trades: DataFrame, horizons: tuple[int, ...], targets: tuple[int, ...]) -> DataFrame:
    """Per order and horizon in minutes: mfe and mae, the best and worst percent (null without a trade), and for each
    target percent the first time it was reached. Orders without a trade after entry have every horizon too."""
    path = held_path(entries, trades, max(horizons) * 60)
    minutes = (F.unix_micros("ts") - F.unix_micros("fill_time")) / 60e6
    within = lambda h, c: F.when(minutes <= h, c)
    touch = lambda h, t: F.min(within(h, F.when(F.col("price") >= F.col("vwap") * (1 + t / 100), F.col("ts")))).alias(f"touch_{t}")
    # One pass over the trades gives all horizons; a row an order then opens into its horizons.
    rungs = [
        F.struct(F.lit(h).alias("horizon"), F.max(within(h, F.col("gain"))).alias("mfe"), F.min(within(h, F.col("gain"))).alias("mae"), *(touch(h, t) for t in targets))
        for h in horizons
    ]
    found = path.groupBy("order_id").agg(F.array(*rungs).alias("rungs")).select("order_id", F.explode("rungs").alias("r")).select("order_id", "r.*")
    every = entries.select("order_id", F.explode(F.array(*map(F.lit, horizons))).alias("horizon"))
    return every.join(found, ["order_id", "horizon"], "left")


def first_exit(entries: DataFrame, trades: DataFrame, hold_seconds: int, take: float, stop: float | None) -> DataFrame:
    """The first trade at the stop or the target after entry (the stop is asked first; there may be none), else the end of
    the holding time: order_id, exit_trigger, exit_reason, trigger_price, and path_mfe and path_mae up to the trigger (0
    without a trade)."""
    path = held_path(entries, trades, hold_seconds)
    target = F.when(F.col("price") >= F.col("vwap") * (1 + take), "target")
    reason = target if stop is None else F.when(F.col("price") <= F.col("vwap") * (1 - stop), "stop").otherwise(target)
    path = path.withColumn("reason", reason)
    hit = path.where("reason is not null").groupBy("order_id").agg(F.min_by(F.struct("ts", "reason", "price"), F.struct("ts", "trade_id")).alias("hit"))
    out = entries.withColumn("to_", F.expr(f"fill_time + interval {hold_seconds} seconds")).join(hit, "order_id", "left").select(
        "order_id", F.coalesce("hit.ts", "to_").alias("exit_trigger"), F.coalesce("hit.reason", F.lit("time")).alias("exit_reason"),
        F.col("hit.price").alias("trigger_price"),
    )
    walked = path.join(out.select("order_id", "exit_trigger"), "order_id").where("ts <= exit_trigger").groupBy("order_id").agg(
        F.max("gain").alias("path_mfe"), F.min("gain").alias("path_mae")
    )
    return out.join(walked, "order_id", "left").fillna(0.0, ["path_mfe", "path_mae"])


def simulated(
    candidates: DataFrame, trades: DataFrame, quote: float, entry_seconds: int, hold_seconds: int, exit_seconds: int, take: float, fee: float,
    stop: float | None = None,
) -> DataFrame:
    """``candidates``: order_id, symbol, decision_time, signal_close. Buys ``quote`` units, sells them at the target, the
    stop (where one is given) or the end of the holding time. Columns are null from the step that failed on; status names
    it: entry_not_filled, exit_not_filled, execution_error (a candidate without a symbol or a time), completed.
    Candidates don't depend on each other, so each step is one join over all of them; what steps share (the candidates,
    their entries, the triggers) is written once, for it is narrow and the tape is not."""
    candidates = staged(candidates, "orders")
    usable = candidates.where("symbol is not null and decision_time is not null")
    orders = usable.select("order_id", "symbol", "decision_time").withColumn("entry_end", F.expr(f"decision_time + interval {entry_seconds} seconds"))
    entry = fills(orders, trades, True, "decision_time", "entry_end", quote=quote).where("complete")
    held = orders.select("order_id", "symbol").join(entry, "order_id").select(
        "order_id", "symbol", "fill_time", "vwap", F.col("filled_base").alias("base_qty"), F.col("fill_count").alias("entry_trades")
    )
    held = staged(held, "entries")
    trigger = staged(first_exit(held.select("order_id", "symbol", "fill_time", "vwap"), trades, hold_seconds, take, stop), "triggers")
    selling = held.select("order_id", "symbol", "base_qty").join(trigger, "order_id").withColumn("exit_end", F.expr(f"exit_trigger + interval {exit_seconds} seconds"))
    exit_ = fills(selling.select("order_id", "symbol", "base_qty", "exit_trigger", "exit_end"), trades, False, "exit_trigger", "exit_end", base="base_qty").where("complete")
    out = (
        candidates.join(held.select("order_id", F.col("fill_time").alias("entry_time"), F.col("vwap").alias("entry_vwap"), "base_qty", "entry_trades"), "order_id", "left")
        .join(trigger, "order_id", "left")
        .join(exit_.select("order_id", F.col("fill_time").alias("exit_time"), F.col("vwap").alias("exit_vwap"), F.col("filled_quote").alias("proceeds"), F.col("fill_count").alias("exit_trades")), "order_id", "left")
    )
    cost = F.lit(quote * (1 + fee))
    status = F.when(F.col("symbol").isNull() | F.col("decision_time").isNull(), "execution_error").when(F.col("entry_time").isNull(), "entry_not_filled")
    return out.withColumns({
        "status": status.when(F.col("exit_time").isNull(), "exit_not_filled").otherwise("completed"),
        "entry_slippage": (F.try_divide("entry_vwap", F.col("signal_close")) - 1) * 100,
        "exit_slippage": (F.try_divide("exit_vwap", F.col("trigger_price")) - 1) * 100,
        "gross_return": (F.col("proceeds") / quote - 1) * 100,
        "net_pnl": F.col("proceeds") * (1 - fee) - cost,
        "net_return": (F.col("proceeds") * (1 - fee) / cost - 1) * 100,
        "fees": F.lit(quote * fee) + F.col("proceeds") * fee,
        "holding_minutes": (F.unix_micros("exit_time") - F.unix_micros("entry_time")) / 60e6,
    })
