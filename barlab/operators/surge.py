"""Rolling low-to-high surges, their trades, and how much could have been sold after them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import holds, pct_change
from ..sources.staging import SLOT_SECONDS
from .windows import Over, by_time, windowed

_EPS = 1e-15


def daily_prefilter(days: DataFrame, factor: float) -> DataFrame:
    """Symbol-days that can hold a surge: the high reaches ``factor`` times the lower of this and the previous low.
    Without a bar exactly one day earlier the day stands for itself. Adds previous_day_bar_available."""
    by_day = Window.partitionBy("symbol").orderBy("open_time")
    there = holds(F.datediff("open_time", F.lag("open_time").over(by_day)) == 1)
    low = F.when(there, F.least("low", F.lag("low").over(by_day))).otherwise(F.col("low"))
    return days.withColumns({"previous_day_bar_available": there, "floor_low": low}).where(F.col("high") + _EPS >= F.col("floor_low") * factor)


def crossings(bars: DataFrame, window_seconds: int, step_seconds: int, factor: float) -> DataFrame:
    """Bars whose high reaches ``factor`` times the least low of strictly earlier bars in the window (by time, gaps
    allowed), with that low's latest bar: symbol, open_time, cross_high, baseline_time, baseline_low."""
    rows = bars.where("low is not null").withColumn("epoch", F.unix_seconds("open_time"))
    frame = Window.partitionBy("symbol").orderBy("epoch").rangeBetween(-(window_seconds - step_seconds), -step_seconds)
    base = F.min(F.struct("low", (-F.col("epoch")).alias("minus"))).over(frame)
    return (
        rows.withColumn("base", base).where(F.col("high") + _EPS >= F.col("base.low") * factor)
        .select("symbol", "open_time", F.col("high").alias("cross_high"), F.timestamp_seconds(-F.col("base.minus")).alias("baseline_time"), F.col("base.low").alias("baseline_low"))
    )


def first_surges(bars: DataFrame, window_seconds: int, step_seconds: int, factor: float) -> DataFrame:
    """The earliest crossing of each symbol and UTC day. Adds event_date and minutes_to_cross."""
    found = crossings(bars, window_seconds, step_seconds, factor).withColumn("event_date", F.to_date("open_time"))
    first = F.min_by(F.struct("open_time", "cross_high", "baseline_time", "baseline_low"), "open_time").alias("c")
    return found.groupBy("symbol", "event_date").agg(first).select(
        "symbol", "event_date", F.col("c.open_time").alias("cross_time"), "c.cross_high", "c.baseline_time", "c.baseline_low",
        ((F.unix_seconds("c.open_time") - F.unix_seconds("c.baseline_time")) / 60).alias("minutes_to_cross"),
    )


def crossing_mask(grid: DataFrame, w: int, factor: float) -> DataFrame:
    """Adds crossing: the high reaches ``factor`` times the least low of the w-1 bars before, all of them observed."""
    rows = windowed(grid, {"__low": Over("min", F.col("low"), w - 1, 1), "__seen": Over("count", F.when(F.col("observed"), 1), w - 1, 1)})
    full = F.col("__seen") == w - 1
    return rows.withColumn("crossing", holds(full & (F.col("high") >= F.col("__low") * factor))).drop("__low", "__seen")


def near_trades(events: DataFrame, trades: DataFrame, start: str, end: str, bucket_seconds: int) -> DataFrame:
    """Events with each of their symbol's trades in [start, end] (columns of ``events``). The interval join is an
    equi-join on time buckets, so it shuffles by symbol and bucket instead of comparing everything; a stored tape
    (``staging.stored_tape``) has its slots for buckets and stays where it is."""
    stored = "slot" in trades.columns
    bucket = lambda c: F.floor(F.unix_seconds(c) / (SLOT_SECONDS if stored else bucket_seconds))
    spread = events.withColumn("slot", F.explode(F.sequence(bucket(F.col(start)), bucket(F.col(end)))))
    tape = trades.drop("day") if stored else trades.withColumn("slot", bucket(F.col("ts")))
    return spread.join(tape, ["symbol", "slot"]).where(F.col("ts").between(F.col(start), F.col(end))).drop("slot")


def resolved_trades(surges: DataFrame, trades: DataFrame, step: str, factor: float) -> DataFrame:
    """Adds to each surge baseline_trade_time (the latest trade at the low of the baseline bar, within 1e-12 of it),
    cross_trade_time and cross_trade_price (the first trade in the crossing bar at the threshold)."""
    keys = ["symbol", "event_date"]
    end = lambda c: F.expr(f"{c} + interval {step} - interval 1 microsecond")
    tolerance = F.greatest(F.abs("baseline_low") * 1e-12, F.lit(_EPS))
    lows = near_trades(surges.withColumn("until", end("baseline_time")), trades, "baseline_time", "until", 3600)
    base = lows.where(F.abs(F.col("price") - F.col("baseline_low")) <= tolerance).groupBy(*keys).agg(F.max("ts").alias("baseline_trade_time"))
    highs = near_trades(surges.withColumn("until", end("cross_time")), trades, "cross_time", "until", 3600)
    cross = highs.where(F.col("price") + tolerance >= F.col("baseline_low") * factor).groupBy(*keys).agg(
        F.min_by(F.struct("ts", "price"), F.struct("ts", "trade_id")).alias("t")
    ).select(*keys, F.col("t.ts").alias("cross_trade_time"), F.col("t.price").alias("cross_trade_price"))
    return surges.join(base, keys, "left").join(cross, keys, "left")


def saleability(resolved: DataFrame, trades: DataFrame, seconds: int, quote: float, window_minutes: int, factor: float) -> DataFrame:
    """What trades came to within ``seconds`` of the crossing trade: level_notional (of all that reach ``factor`` times the
    baseline) and, of sellers alone, that (sell_notional_at_level) and the notional and base quantity at any price, lowest
    and highest price, first time; the time and price of the trade that brings them to ``quote`` units, and exit_vwap of
    those units (the last fill in part), which are null where they aren't reached; and whether the event is saleable.
    Unresolved events aren't."""
    keys = ["symbol", "event_date"]
    ready = resolved.where("cross_trade_time is not null").withColumn("sell_end", F.expr(f"cross_trade_time + interval {seconds} seconds"))
    tolerance = F.greatest(F.abs("baseline_low") * 1e-12, F.lit(_EPS))
    after = near_trades(ready, trades, "cross_trade_time", "sell_end", seconds).withColumns({
        "notional": F.col("price") * F.col("qty"), "at_level": F.col("price") + tolerance >= F.col("baseline_low") * factor,
    })
    sold = lambda c, when=None: F.coalesce(F.sum(F.when(F.col("is_buyer_maker") if when is None else when, F.col(c))), F.lit(0.0))
    levels = after.groupBy(*keys).agg(
        sold("notional", F.col("at_level")).alias("level_notional"), sold("notional", F.col("at_level") & F.col("is_buyer_maker")).alias("sell_notional_at_level"),
        sold("qty").alias("sell_base"),
    )
    before = Window.partitionBy(*keys).orderBy("ts", "trade_id").rowsBetween(Window.unboundedPreceding, -1)
    sells = after.where("is_buyer_maker").withColumn("sold_before", F.coalesce(F.sum("notional").over(before), F.lit(0.0)))
    used, reached = F.greatest(F.lit(0.0), F.least("notional", quote - F.col("sold_before"))), F.col("sold_before") + F.col("notional") + 1e-12 >= quote
    sells = sells.withColumns({"used": F.when(F.col("price") > 0, used), "hit": F.when(reached, F.struct("ts", "trade_id", "price"))})
    totals = sells.groupBy(*keys).agg(
        F.sum("notional").alias("sell_notional"), F.min("price").alias("lowest_sell"), F.max("price").alias("highest_sell"), F.min("ts").alias("first_sell_time"),
        F.min("hit").alias("hit"), F.sum(F.col("used") / F.nullif("price", F.lit(0.0))).alias("exit_base"),
    )
    elapsed = F.unix_micros("cross_trade_time") - F.unix_micros("baseline_trade_time")
    passed = (elapsed > 0) & (elapsed <= window_minutes * 60_000_000) & (F.col("sell_notional") + 1e-12 >= quote)
    out = resolved.join(levels, keys, "left").join(totals, keys, "left").withColumn("saleable", holds(passed))
    nothing = F.when(F.col("cross_trade_time").isNotNull(), 0.0)
    return out.withColumns({
        **{c: F.coalesce(c, nothing) for c in ("level_notional", "sell_notional_at_level", "sell_base", "sell_notional")},
        "quote_reached_time": F.col("hit.ts"), "quote_reached_price": F.col("hit.price"),
        "exit_vwap": F.when(F.col("hit").isNotNull(), F.try_divide(F.lit(quote), F.col("exit_base"))),
    }).drop("hit", "exit_base")


def event_records(resolved: DataFrame, bars: DataFrame, step_seconds: int, window_seconds: int) -> DataFrame:
    """``resolved``: first surges with their trades. Adds what an event's record holds: of its day open, high, close, quote
    volume, trades, the close of its first bar, the time of its first highest bar; the close of the day before (its own open,
    where that has no bar); gains in percent up to the high (from the day before, the open and the first close) and of
    the crossing trade; minutes from the day's start to crossing and peak; of the bars from ``window_seconds`` before the day
    up to the crossing the number and the quote volume; how many bars are missing of the day with that time before it, and
    of the time from baseline to crossing; and quality: warning where a bar or a trade is missing or the trades lie further
    apart than the window, else pass."""
    keys = ["symbol", "event_date"]
    second, day = F.unix_seconds("open_time"), lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    # A bar counts for its own day and, in the time before the next one, for that as well; the day before gives its close.
    dates = F.array(F.to_date("open_time"), F.date_add(F.to_date("open_time"), 1))
    spread = bars.where("close is not null").withColumn("event_date", F.explode(dates))
    rows = resolved.select(*keys, "cross_time", "baseline_time").join(spread, keys)
    begin, at, cross = day("event_date"), second, F.unix_seconds("cross_time")
    own, loaded = at >= begin, at >= begin - window_seconds
    inside = lambda c: F.when(own, F.col(c))
    totals = rows.groupBy(*keys).agg(
        F.min_by(inside("open"), inside("open_time")).alias("day_open"), F.max(inside("high")).alias("day_high"), F.max_by(inside("close"), inside("open_time")).alias("day_close"),
        F.sum(inside("quote_volume")).alias("day_quote"), F.sum(inside("trade_count")).alias("day_trades"), F.min_by(inside("close"), inside("open_time")).alias("first_close"),
        F.min(F.when(own, F.struct((-F.col("high")).alias("h"), "open_time"))).alias("peak"), F.max_by(F.when(~own, F.col("close")), F.when(~own, F.col("open_time"))).alias("previous_close"),
        F.count_if(own).alias("bars"), F.count_if(loaded & (at < cross)).alias("bars_before"), F.sum(F.when(loaded & (at < cross), F.col("quote_volume")).otherwise(0.0)).alias("volume_before"),
        F.count_if(loaded).alias("loaded"), F.count_if((at >= F.unix_seconds("baseline_time")) & (at <= cross)).alias("window_bars"),
    )
    out = resolved.join(totals, keys, "left")
    elapsed = (F.unix_micros("cross_trade_time") - F.unix_micros("baseline_trade_time")) / 1e6
    expected = lambda seconds: F.floor(seconds / step_seconds)
    out = out.withColumns({
        "peak_time": F.col("peak.open_time"), "previous_close": F.coalesce("previous_close", "day_open"), "exact_seconds": elapsed,
        "exact_window": holds((elapsed > 0) & (elapsed <= window_seconds)),
        "missing_bars": F.greatest(F.lit(0), expected(F.lit(86_400 + window_seconds)) - F.coalesce("loaded", F.lit(0))).cast("long"),
        "missing_window_bars": F.greatest(F.lit(0), expected(F.unix_seconds("cross_time") - F.unix_seconds("baseline_time")) + 1 - F.coalesce("window_bars", F.lit(0))).cast("long"),
        "crossed_in_first_bar": F.col("cross_time") == F.col("event_date").cast("timestamp"),
        "day_minutes_to_cross": F.floor((F.unix_seconds("cross_time") - day("event_date")) / 60).cast("long"),
    })
    poor = (F.col("missing_bars") > 0) | (F.col("missing_window_bars") > 0) | F.col("baseline_trade_time").isNull() | F.col("cross_trade_time").isNull() | ~F.col("exact_window")
    return out.withColumns({
        "day_minutes_to_peak": F.floor((F.unix_seconds("peak_time") - day("event_date")) / 60).cast("long"), "previous_close_to_high": pct_change(F.col("previous_close"), F.col("day_high")),
        "open_to_high": pct_change(F.col("day_open"), F.col("day_high")), "first_close_to_high": pct_change(F.col("first_close"), F.col("day_high")),
        "gain_at_cross": pct_change(F.col("baseline_low"), F.col("cross_trade_price")), "quality": F.when(poor, "warning").otherwise("pass"),
    }).drop("peak", "loaded", "window_bars")


def decision_observations(
    bars: DataFrame, dates: DataFrame, step: str, hours: tuple[int, ...] = (14, 17, 19), zone: str = "Europe/London",
) -> DataFrame:
    """``dates``: symbol, event_date. At each local hour: the first bar of the day at or after it, entered at its close,
    and the best high (the first of equal ones) of the day's bars from then on, in percent. Decisions without a later bar
    are left out. Local hours follow the zone's summer time."""
    local = F.to_timestamp(F.concat_ws(" ", F.col("event_date").cast("string"), F.format_string("%02d:00:00", "hour")))
    targets = dates.withColumn("hour", F.explode(F.array(*map(F.lit, hours)))).withColumn("target", F.to_utc_timestamp(local, zone))
    day = bars.where("close is not null").withColumn("event_date", F.to_date("open_time"))
    after = targets.join(day, ["symbol", "event_date"]).where("open_time >= target")
    first = Window.partitionBy("symbol", "event_date", "hour").orderBy("open_time")
    rows = after.withColumns({"entry_time": F.expr(f"min(open_time) OVER (PARTITION BY symbol, event_date, hour) + interval {step}"), "entry": F.first("close").over(first)})
    later = rows.where("open_time >= entry_time").groupBy("symbol", "event_date", "hour").agg(
        F.min("target").alias("decision_time"), F.min("entry_time").alias("entry_time"), F.min("entry").alias("entry_price"),
        F.min(F.struct((-F.col("high")).alias("minus"), "open_time")).alias("peak"),
    )
    return later.select(
        "symbol", "event_date", "hour", "decision_time", "entry_time", "entry_price", (-F.col("peak.minus")).alias("peak"),
        F.col("peak.open_time").alias("peak_time"), pct_change(F.col("entry_price"), -F.col("peak.minus")).alias("max_gain"),
    )


def algorithmic_baseline(grid: DataFrame, w: int, factor: float) -> DataFrame:
    """For every bar taken as a crossing: the latest bar of the least low among the w-1 before it (all observed), the bars
    between, the best gain of the w-1 bars after the baseline (all observed), and whether that reaches
    the factor. Baselines without a whole window after them are left out."""
    seen, i = F.when(F.col("observed"), 1), F.col("i")
    rows = windowed(grid.withColumn("i", F.row_number().over(by_time())), {
        "__back": Over("count", seen, w - 1, 1), "__ahead": Over("count", seen, w - 1, 1, True), "future_high": Over("max", F.col("high"), w - 1, 1, True),
        "base": Over("min", F.when(F.col("observed"), F.struct("low", (-i).alias("minus"))), w - 1, 1),
    })
    rows = rows.withColumns({
        "base": F.when(F.col("__back") == w - 1, F.col("base")), "future_high": F.when(F.col("__ahead") == w - 1, F.col("future_high")),
    }).drop("__back", "__ahead")
    future = rows.select("symbol", F.col("i").alias("base_i"), F.col("future_high").alias("high_after"), F.col("open_time").alias("baseline_time"), F.col("low").alias("base_low"))
    chosen = rows.where("base is not null").withColumn("base_i", -F.col("base.minus"))
    gain = pct_change(F.col("baseline_low"), F.col("high_after"))
    return chosen.join(future, ["symbol", "base_i"]).where("high_after is not null").select(
        "symbol", "open_time", "baseline_time", F.col("base.low").alias("baseline_low"), (F.col("i") - F.col("base_i")).alias("duration"), "high_after",
    ).withColumns({"future_gain": gain, "contaminated": holds(gain + 1e-12 >= (factor - 1) * 100)}).drop("high_after")


def first_future_cross(baselines: DataFrame, grid: DataFrame, w: int, factor: float, step_seconds: int) -> DataFrame:
    """Adds to contaminated baselines first_future_cross, the first bar within w-1 of them at the factor."""
    near = baselines.where("contaminated").select("symbol", "open_time", "baseline_time", "baseline_low")
    bars = grid.select("symbol", F.col("open_time").alias("at"), "high")
    spread = near.withColumn("at", F.explode(F.transform(F.sequence(F.lit(1), F.lit(w - 1)), lambda k: F.timestamp_seconds(F.unix_seconds("baseline_time") + k * step_seconds))))
    hit = spread.join(bars, ["symbol", "at"]).where(F.col("high") >= F.col("baseline_low") * factor)
    return baselines.join(hit.groupBy("symbol", "open_time").agg(F.min("at").alias("first_future_cross")), ["symbol", "open_time"], "left")


def scan_issues(records: DataFrame) -> DataFrame:
    """``records`` of event_records. Per symbol its events, how many of them have no trade at the baseline or at the
    crossing, bars missing in their window, or trades too far apart, and how many pass: a scan keeps such rows and reports
    them."""
    return records.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("events"), F.count_if(F.col("baseline_trade_time").isNull()).alias("baseline_unresolved"),
        F.count_if(F.col("cross_trade_time").isNull()).alias("cross_unresolved"), F.count_if(F.col("missing_window_bars") > 0).alias("gaps_in_window"),
        F.count_if(~F.col("exact_window")).alias("outside_window"), F.count_if(F.col("quality") == "pass").alias("passed"),
    )


def scan_windows(scans: DataFrame, today: Column, longest: int = 240) -> DataFrame:
    """``scans``: start_date and end_date (days; the end isn't in the window; null both for the last days up to today) and
    lookback. Adds first_day, last_day, load_from (a day earlier, for the day before the first) and issues: one_bound_missing,
    order, incomplete_day (it reaches into today), length (not 1 to ``longest`` days)."""
    both, none = F.col("start_date").isNotNull() & F.col("end_date").isNotNull(), F.col("start_date").isNull() & F.col("end_date").isNull()
    end = F.when(none, today).otherwise(F.col("end_date"))
    start = F.when(none, F.date_sub(today, F.col("lookback"))).otherwise(F.col("start_date"))
    days = F.datediff("end_", "start_")
    found = {"one_bound_missing": ~both & ~none, "order": days <= 0, "incomplete_day": F.col("end_") > today, "length": (days < 1) | (days > longest)}
    issues = F.array_compact(F.array(*(F.when(holds(c), F.lit(k)) for k, c in found.items())))
    out = scans.withColumns({"start_": start, "end_": end}).withColumn("issues", issues)
    return out.withColumns({"first_day": F.col("start_"), "last_day": F.date_sub("end_", 1), "load_from": F.date_sub("start_", 1)}).drop("start_", "end_")
