"""Daily context, reference context, snapshots and raw windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import holds, pct_change, ratio
from .rolling import drawdown_runup, range_position, realized_volatility, whole_clock_ratio
from .windows import Over, by_time, whole, windowed
from .samples import continuation_trigger, daily_rate_ratio, hypotheses, interval_return


def daily_context(grid: DataFrame) -> DataFrame:
    """Per symbol and UTC day over observed bars: OHLC, quote volume, observed bars, range percent, whether it closed up."""
    days = grid.where("observed").groupBy("symbol", F.to_date("open_time").alias("day")).agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"),
        F.sum("quote_volume").alias("quote_volume"), F.count(F.lit(1)).alias("bars"),
    )
    return days.withColumns({"range_pct": pct_change(F.col("low"), F.col("high")), "up": F.col("close") > F.col("open")})


def sample_windows(samples: DataFrame, grid: DataFrame, bars: int, step_seconds: int) -> DataFrame:
    """``samples``: sample_id, symbol, at. The observed bars among the ``bars`` grid rows that end at ``at``."""
    times = F.sequence(F.unix_seconds("at") - (bars - 1) * step_seconds, F.unix_seconds("at"), F.lit(step_seconds).cast("long"))
    wanted = samples.select("sample_id", "symbol", F.explode(F.transform(times, F.timestamp_seconds)).alias("open_time"))
    return wanted.join(grid.where("observed"), ["symbol", "open_time"])


def daily_trends(windows: DataFrame, complete: int, most: int = 11) -> DataFrame:
    """``windows``: observed bars of samples. Per sample over the last ``most`` UTC days with a bar: days, complete days
    (of at least so many bars), and, from 3 days up, the part that closed up, the median taker ratio, and the trends of
    volume, close and range in percent a day with their R2 (from 6 days up, all values positive)."""
    days = windows.groupBy("sample_id", F.to_date("open_time").alias("day")).agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"),
        F.coalesce(F.sum("quote_volume"), F.lit(0.0)).alias("quote"), F.coalesce(F.sum("taker_buy_quote"), F.lit(0.0)).alias("taker"), F.count(F.lit(1)).alias("bars"),
    )
    late = Window.partitionBy("sample_id").orderBy(F.desc("day"))
    days = days.withColumn("back", F.row_number().over(late)).where(F.col("back") <= most).withColumn("x", -F.col("back").cast("double"))
    values = {"volume": F.col("quote"), "close": F.col("close"), "range": F.greatest((ratio(F.col("high"), F.col("low")) - 1) * 100, F.lit(1e-9)) + 1}
    days = days.withColumns({f"ln_{k}": F.when(v > 0, F.ln(v)) for k, v in values.items()})
    n = F.count(F.lit(1))

    def trend(k: str) -> list[Column]:
        whole = (n >= 6) & (F.count(f"ln_{k}") == n)
        slope = F.when(whole, F.expm1(F.regr_slope(f"ln_{k}", "x")) * 100)
        return [slope.alias(f"{k}_trend"), F.when(whole & (F.var_pop(f"ln_{k}") > 0), F.regr_r2(f"ln_{k}", "x")).alias(f"{k}_r2")]

    few = lambda c: F.when(n >= 3, c)
    return days.groupBy("sample_id").agg(
        n.alias("days"), F.count_if(F.col("bars") >= complete).alias("complete_days"), few(F.avg((F.col("close") > F.col("open")).cast("double"))).alias("up_part"),
        few(F.percentile(F.try_divide("taker", F.nullif("quote", F.lit(0.0))), F.lit(0.5))).alias("taker_median"), *(c for k in values for c in trend(k)),
    )


def episodes(windows: DataFrame, unit: str = "hour", prior: int = 24, least_prior: int = 18, follow_seconds: int = 6 * 3600) -> DataFrame:
    """``windows``: observed bars of samples. Per sample: moves between neighbouring bars of at least 2 and 5 percent up
    and 2 down; units (hours) with a volume of at least three medians, and the largest volume to the median; breakouts
    (the high begins to reach 1.005 times the best of the ``prior`` units before, of which ``least_prior`` must exist) and
    failed ones (a close within ``follow_seconds`` falls to 0.98 of the breakout's high)."""
    order = Window.partitionBy("sample_id").orderBy("open_time")
    moved = (ratio(F.col("close"), F.lag("close").over(order)) - 1) * 100
    moves = windows.withColumn("moved", moved).groupBy("sample_id").agg(
        F.count_if(F.col("moved") >= 2).alias("up_2"), F.count_if(F.col("moved") >= 5).alias("up_5"), F.count_if(F.col("moved") <= -2).alias("down_2")
    )
    hours = windows.groupBy("sample_id", F.date_trunc(unit, "open_time").alias("hour")).agg(
        F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"), F.coalesce(F.sum("quote_volume"), F.lit(0.0)).alias("quote"),
    ).withColumn("second", F.unix_seconds("hour"))
    by_hour = Window.partitionBy("sample_id").orderBy("second")
    before = by_hour.rowsBetween(-prior, -1)
    best = F.when(F.count("high").over(before) >= least_prior, F.max("high").over(before))
    hours = hours.withColumn("broke", holds(F.col("high") >= best * 1.005))
    hours = hours.withColumns({"edge": F.col("broke") & ~F.lag("broke", 1, False).over(by_hour), "lowest": F.min("close").over(by_hour.rangeBetween(0, follow_seconds))})
    middle = hours.groupBy("sample_id").agg(F.percentile("quote", F.lit(0.5)).alias("median"))
    found = hours.join(middle, "sample_id").groupBy("sample_id").agg(
        F.when(F.max("median") > 0, F.count_if(F.col("quote") >= 3 * F.col("median"))).alias("volume_spikes"),
        F.try_divide(F.max("quote"), F.nullif(F.max("median"), F.lit(0.0))).alias("largest_volume"),
        F.count_if("edge").alias("breakouts"), F.count_if(F.col("edge") & (F.col("lowest") <= F.col("high") * 0.98)).alias("failed_breakouts"),
    )
    return moves.join(found, "sample_id")


def reference_context(grid: DataFrame, references: list[str], windows: list[int], volatility: int | None = None) -> DataFrame:
    """Per bar and window w: own_w, each reference's return at the same time (NAME_w), the equal-weight mean of those there
    are (proxy_w) and the differences of own from both; and each reference's volatility over ``volatility`` bars. A
    reference without a close at the bar has none of them."""
    returns = {w: pct_change(F.lag("close", w).over(by_time()), F.col("close")) for w in windows}
    own = grid.select("symbol", "open_time", *(r.alias(f"own_{w}") for w, r in returns.items()))
    of = lambda r, c: F.max(F.when(F.col("symbol") == r, F.col(c)))
    known = own.where(F.col("symbol").isin(references)).groupBy("open_time").agg(
        *(of(r, f"own_{w}").alias(f"{r}_{w}") for r in references for w in windows), *(F.avg(f"own_{w}").alias(f"proxy_{w}") for w in windows),
    )
    out = own.join(known, "open_time", "left")
    if volatility:
        rv = realized_volatility(grid.where(F.col("symbol").isin(references)), volatility).where("close is not null")
        rv = rv.groupBy("open_time").agg(*(of(r, "volatility").alias(f"{r}_rv") for r in references))
        out = out.join(rv, "open_time", "left")
    return out.withColumns({f"own_minus_{r}_{w}": F.col(f"own_{w}") - F.col(f"{r}_{w}") for r in (*references, "proxy") for w in windows})


def offset_ratios(grid: DataFrame, short: int, before_short: int, long: int, before_long: int) -> DataFrame:
    """Adds, by bar: volume_step and trade_step (the last ``short`` bars to the ``before_short`` before them), long_volume_step
    (the last ``long`` to the ``before_long`` before them), return_step (the return over ``long`` bars less that over the
    ``long`` before) and taker_step (the taker ratio of the last ``long`` bars less that of the ``long`` before). A sum needs
    all of its bars, but for the taker ratio of the last ones, and a divisor must be positive."""
    sums = {
        "__q1": ("quote_volume", short, 0), "__q2": ("quote_volume", before_short, short), "__t1": ("trade_count", short, 0), "__t2": ("trade_count", before_short, short),
        "__l1": ("quote_volume", long, 0), "__l2": ("quote_volume", before_long, long), "__p": ("quote_volume", long, long), "__k": ("taker_buy_quote", long, long),
        "__now": ("taker_buy_quote", long, 0),
    }
    rows = windowed(grid, {n: Over("sum", F.col(c), w, skip) for n, (c, w, skip) in sums.items()} | {f"{n}_n": Over("count", F.col(c), w, skip) for n, (c, w, skip) in sums.items()})
    full = lambda n: F.when(F.col(f"{n}_n") == sums[n][1], F.col(n).cast("double"))
    per = lambda a, b: F.when(b > 0, ratio(a, b))
    rate = lambda a, b: per(full(a) / sums[a][1], full(b) / sums[b][1])
    lagged = lambda k: F.lag("close", k).over(by_time())
    return rows.withColumns({
        "volume_step": rate("__q1", "__q2"), "trade_step": rate("__t1", "__t2"), "long_volume_step": rate("__l1", "__l2"),
        "return_step": pct_change(lagged(long), F.col("close")) - pct_change(lagged(2 * long), lagged(long)),
        "taker_step": per(F.col("__now"), F.col("__l1")) - per(full("__k"), full("__p")),
    }).drop(*(c for n in sums for c in (n, f"{n}_n")))


def window_ratios(rows: DataFrame, day: int) -> DataFrame:
    """Adds seven shares and ratios of windows of 1, 3, 7 and 10 days (quote_w, volatility_w, range_w, trades_w) and three
    forms of a return's acceleration in points a day."""
    d1, d3, d7, d10 = (n * day for n in (1, 3, 7, 10))
    c = lambda name, w: F.col(f"{name}_{w}")
    safe = lambda a, b: ratio(a, F.nullif(b, F.lit(0.0)))
    size = lambda w: F.when(c("trades", w) > 0, c("quote", w) / c("trades", w))
    return rows.withColumns({
        "volume_share_1_of_3": safe(c("quote", d1), c("quote", d3)), "volume_share_1_of_7": safe(c("quote", d1), c("quote", d7)),
        "volume_share_3_of_10": safe(c("quote", d3), c("quote", d10)), "volatility_ratio": safe(c("volatility", d1), c("volatility", d7)),
        "volatility_3_to_10": safe(c("volatility", d3), c("volatility", d10)), "range_1_to_7": safe(c("range", d1), c("range", d7)),
        "trade_size_1_to_7": safe(size(d1), size(d7)),
        "acceleration": c("return", d1) - (c("return", d3) - c("return", d1)) / 2,
        "acceleration_3_of_10": c("return", d3) / 3 - (c("return", d10) - c("return", d3)) / 7,
        "strength_3_of_10": c("return", d3) / 3 - c("return", d10) / 10,
    })


def quality_status(has_bar: Column, observed: Column, liquid: Column, parts: tuple[float, float] = (0.995, 0.98)) -> Column:
    """missing_decision_bar, pass (the first of ``parts`` observed, and liquid), warning (the second) or
    insufficient_history."""
    return (
        F.when(~holds(has_bar), "missing_decision_bar").when((observed >= parts[0]) & holds(liquid), "pass").when(observed >= parts[1], "warning")
        .otherwise("insufficient_history")
    )


def context_features(
    grid: DataFrame, day: int, history: int, volume_bars: int, volume: float, references: list[str], parts: tuple[float, float] = (0.995, 0.98),
) -> DataFrame:
    """The features of every bar that the hypotheses and statuses need: windows of 1, 3, 7 and 10 days, their ratios, the
    return relative to the references (none, if the list is empty), liquidity and the observed part of the history."""
    rows, widths = grid, (day, 3 * day, 7 * day, 10 * day)
    for w in widths:
        rows = realized_volatility(rows, w).withColumnRenamed("volatility", f"volatility_{w}").drop("up_part", "log_return")
    measures = {"volume_seen": Over("sum", F.col("quote_volume"), volume_bars), "volume_known": Over("count", F.col("quote_volume"), volume_bars)}
    for w in widths:
        measures |= {
            f"low_{w}": Over("min", F.col("low"), w), f"high_{w}": Over("max", F.col("high"), w), f"quote_{w}": Over("sum", F.col("quote_volume"), w),
            f"trades_{w}": Over("sum", F.col("trade_count"), w),
        }
    rows = windowed(rows, measures | {"seen": Over("count", F.when(F.col("observed"), 1), history)})
    rows = rows.withColumns({
        **{f"return_{w}": pct_change(F.lag("close", w).over(by_time()), F.col("close")) for w in widths}, **{f"range_{w}": pct_change(F.col(f"low_{w}"), F.col(f"high_{w}")) for w in widths},
    }).drop(*(f"{c}_{w}" for c in ("low", "high") for w in widths))
    rows = window_ratios(rows, day).withColumns({
        "volume_now": F.when(F.col("volume_known") == volume_bars, F.col("volume_seen")), "observed_part": F.col("seen") / F.lit(float(history)),
        "prior_week": interval_return(F.col(f"return_{7 * day}"), F.col(f"return_{day}")), "return_day": F.col(f"return_{day}"),
        "volume_rate": daily_rate_ratio(F.col(f"quote_{day}"), F.col(f"quote_{3 * day}"), 2),
        "trade_rate": daily_rate_ratio(F.col(f"trades_{day}").cast("double"), F.col(f"trades_{3 * day}").cast("double"), 2),
    }).withColumn("liquid", holds(F.col("volume_now") >= volume)).drop("volume_seen", "volume_known", "seen")
    if references:
        relative = reference_context(grid, references, [day]).select("symbol", "open_time", F.col(f"own_minus_proxy_{day}").alias("relative_day"))
        rows = rows.join(relative, ["symbol", "open_time"], "left")
    else:
        rows = rows.withColumn("relative_day", F.lit(None).cast("double"))
    return rows.withColumn("quality", quality_status(F.col("close").isNotNull(), F.col("observed_part"), F.col("liquid"), parts))


def continuation_features(grid: DataFrame, short: int, day: int) -> DataFrame:
    """symbol, open_time and what the continuation trigger asks of a bar: return_short, clock_ratio (the volume of ``short`` bars
    over its median at that time on the days before), position in the range of ``day`` bars and runup over ``short`` ones."""
    rows = whole_clock_ratio(whole(grid, "__v", "sum", F.col("quote_volume"), short), F.col("__v"), day)
    rows = drawdown_runup(range_position(rows, day), short).withColumn("return_short", pct_change(F.lag("close", short).over(by_time()), F.col("close")))
    return rows.select("symbol", "open_time", "return_short", "clock_ratio", "position", "runup")


def baseline_rows(samples: DataFrame, features: DataFrame, audit: DataFrame, offsets: list[int], unit_seconds: int) -> DataFrame:
    """``samples``: sample_id, symbol, baseline_anchor and more. One row for each sample and offset (in bars before the
    baseline), with the features of the last whole bar before it, the hypotheses and the sample's audit, which overrides
    the quality of a contaminated control. A bar that isn't in ``features`` is a missing decision bar."""
    rows = samples.withColumn("offset", F.explode(F.array(*map(F.lit, offsets))))
    rows = rows.withColumn("open_time", F.timestamp_seconds(F.unix_seconds("baseline_anchor") - (F.col("offset") + 1) * unit_seconds))
    rows = rows.join(features, ["symbol", "open_time"], "left").join(audit.select("sample_id", "part", "crossed", "largest_gain", "contaminated"), "sample_id", "left")
    stage = F.when(F.col("offset") == 0, "baseline_start").otherwise("pre_baseline")
    quality = F.when(holds(F.col("contaminated")), "contaminated_control").otherwise(F.coalesce("quality", F.lit("missing_decision_bar")))
    return hypotheses(rows).withColumns({"stage": stage, "quality": quality})


def continuation_rows(samples: DataFrame, features: DataFrame, audit: DataFrame, horizon: int, unit_seconds: int) -> DataFrame:
    """As baseline_rows, once for each sample ``horizon`` bars before its crossing, with the continuation trigger in place
    of the hypotheses. ``features`` needs return_short, clock_ratio, position and runup as well."""
    rows = samples.withColumn("open_time", F.timestamp_seconds(F.unix_seconds("cross_anchor") - (horizon + 1) * unit_seconds))
    rows = rows.join(features, ["symbol", "open_time"], "left").join(audit.select("sample_id", "contaminated"), "sample_id", "left")
    quality = F.when(holds(F.col("contaminated")), "contaminated_control").otherwise(F.coalesce("quality", F.lit("missing_decision_bar")))
    return continuation_trigger(rows).withColumn("quality", quality)


def snapshots(samples: DataFrame, offsets: list[int], step: str) -> DataFrame:
    """One row for each sample (sample_id, symbol, anchor) and offset, at the anchor less so many steps."""
    spread = samples.withColumn("offset", F.explode(F.array(*map(F.lit, offsets))))
    return spread.withColumn("at", F.expr(f"anchor - offset * interval {step}"))


#: Seconds of the slots over which windows and bars are brought together.
_SLOT = 86_400


def _slots(first: Column, last: Column) -> Column:
    """The slots that a range of seconds, both ends included, touches."""
    return F.explode(F.sequence(F.floor(first / _SLOT), F.floor(last / _SLOT)))


def whole_windows(samples: DataFrame, grid: DataFrame, bars: int, step_seconds: int) -> DataFrame:
    """``samples`` (sample_id, symbol, anchor, ...) whose ``bars`` grid rows before the anchor are all there: two lookups
    in the numbered grid. Adds first and last, the seconds at which the window's first and last bar open."""
    at = F.unix_seconds("anchor")
    asked = samples.withColumns({"first": at - bars * step_seconds, "last": at - step_seconds})
    numbered = grid.select("symbol", F.unix_seconds("open_time").alias("second"), F.row_number().over(by_time()).alias("i"))
    for end in ("first", "last"):
        asked = asked.join(numbered.withColumnsRenamed({"second": end, "i": f"__{end}"}), ["symbol", end])
    return asked.where(F.col("__last") - F.col("__first") == bars - 1).drop("__first", "__last")


def covered(windows: DataFrame) -> DataFrame:
    """``windows``: symbol, first, last. Their union as disjoint ranges: symbol, first, last. A window that begins after the
    furthest end so far begins a new one."""
    order = Window.partitionBy("symbol").orderBy("first", "last")
    reach = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    islands = windows.withColumn("new", F.when(F.col("first") <= reach, 0).otherwise(1)).withColumn("island", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return islands.groupBy("symbol", "island").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("island")


def shared_store(windows: DataFrame, grid: DataFrame) -> DataFrame:
    """The bars that any of ``windows`` (of whole_windows) covers, once for each symbol and time: the union of the windows
    is taken before it meets the bars, so a bar meets at most one range and is read once."""
    ranges = covered(windows).withColumn("slot", _slots(F.col("first"), F.col("last")))
    second = F.unix_seconds("open_time")
    dated = grid.withColumn("slot", F.floor(second / _SLOT))
    return ranges.join(dated, ["symbol", "slot"]).where(second.between(F.col("first"), F.col("last"))).drop("slot", "first", "last")


def raw_windows(windows: DataFrame, store: DataFrame, step_seconds: int) -> DataFrame:
    """The bars of each of ``windows`` (of whole_windows) from a store that holds them, gaps kept, with relative_bar below
    zero. Windows meet bars by the day."""
    second, asked = F.unix_seconds("open_time"), windows.withColumn("slot", _slots(F.col("first"), F.col("last")))
    found = asked.join(store.withColumn("slot", F.floor(second / _SLOT)), ["symbol", "slot"]).where(second.between(F.col("first"), F.col("last")))
    return found.withColumn("relative_bar", F.expr(f"cast((unix_seconds(open_time) - unix_seconds(anchor)) div {step_seconds} as int)")).drop("slot", "first", "last")


def value_counts(rows: DataFrame, *columns: str) -> DataFrame:
    """How often each combination occurs, nulls included."""
    return rows.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))
