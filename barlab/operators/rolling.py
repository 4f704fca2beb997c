"""Gap-aware features over windows of a dense grid. Windows count bars; every frame is partitioned by symbol (or by chunks
of it, see ``windows.in_time_chunks``), and what is wide goes over ``windows.windowed``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import pct_change, ratio
from . import windows
from .windows import Over, by_time, windowed


def last(n: int):
    """The ``n`` bars that end here."""
    return by_time().rowsBetween(1 - n, 0)


def window_aggregates(grid: DataFrame, widths: list[int]) -> DataFrame:
    """For each width w: return_w, observed_w, range_w, quote_w, trades_w, trade_quote_w (the average trade), taker_w. Sums are
    null only where no bar is observed; a return needs both of its bars, a ratio a positive divisor."""
    seen = F.when(F.col("observed"), 1)
    measures = {}
    for w in widths:
        measures |= {
            f"observed_{w}": Over("count", seen, w), f"__low_{w}": Over("min", F.col("low"), w), f"__high_{w}": Over("max", F.col("high"), w),
            f"quote_{w}": Over("sum", F.col("quote_volume"), w), f"trades_{w}": Over("sum", F.col("trade_count"), w),
            f"__taker_{w}": Over("sum", F.col("taker_buy_quote"), w),
        }
    out = windowed(grid, measures)
    for w in widths:
        out = out.withColumns({
            f"return_{w}": pct_change(F.lag("close", w).over(by_time()), F.col("close")), f"observed_{w}": F.col(f"observed_{w}") / F.lit(float(w)),
            f"range_{w}": pct_change(F.col(f"__low_{w}"), F.col(f"__high_{w}")),
            f"trade_quote_{w}": F.when(F.col(f"trades_{w}") > 0, ratio(F.col(f"quote_{w}"), F.col(f"trades_{w}").cast("double"))),
            f"taker_{w}": F.when(F.col(f"quote_{w}") > 0, ratio(F.col(f"__taker_{w}"), F.col(f"quote_{w}"))),
        }).drop(f"__low_{w}", f"__high_{w}", f"__taker_{w}")
    return out


def log_returns(grid: DataFrame) -> DataFrame:
    """Adds log_return between a bar and the observed one before it, whatever lies between."""
    before = F.last("close", ignorenulls=True).over(by_time().rowsBetween(Window.unboundedPreceding, -1))
    return grid.withColumn("log_return", F.ln("close") - F.ln(before))


def realized_volatility(grid: DataFrame, w: int, least: int | None = None) -> DataFrame:
    """Adds volatility (sample deviation of the log returns between neighbouring closes of the last w bars, scaled to the
    window, in percent; from ``least`` closes up, by default max(5, 0.8 w)) and up_part (part of those returns above zero;
    from two closes up, or from ``least`` where it is given). The first close of a window has no return in it, so its own is
    taken off the window's sums. Null where a close isn't positive."""
    rows = log_returns(grid)
    r = F.col("log_return")
    edge = F.when(F.col("close").isNotNull(), F.struct(F.coalesce(r, F.lit(0.0)).alias("r"), r.isNotNull().cast("int").alias("n")))
    rows = windows.next_known(rows, "edge", edge, w)
    rows = windowed(rows, {
        "closes": Over("count", F.col("close"), w), "bad": Over("count", F.when(F.col("close") <= 0, 1), w), "n": Over("count", r, w), "total": Over("sum", r, w),
        "square": Over("sum", r * r, w), "up": Over("count", F.when(r > 0, 1), w),
    })
    ok = (F.col("closes") >= (max(5, int(0.8 * w)) if least is None else least)) & (F.col("bad") == 0)
    rows = rows.withColumns({
        "n": F.col("n") - F.col("edge.n"), "total": F.col("total") - F.col("edge.r"), "square": F.col("square") - F.col("edge.r") * F.col("edge.r"),
        "up": F.col("up") - (F.col("edge.r") > 0).cast("int"),
    })
    spread = F.sqrt(F.greatest(F.lit(0.0), F.col("square") - ratio(F.col("total") * F.col("total"), F.col("n"))) / F.nullif(F.col("n") - 1, F.lit(0)))
    enough = ok if least is not None else (F.col("closes") > 1) & (F.col("bad") == 0)
    return rows.withColumns({
        "volatility": F.when(ok & (F.col("n") >= 2), spread * F.sqrt(F.lit(float(w))) * 100), "up_part": F.when(enough, ratio(F.col("up").cast("double"), F.col("n"))),
    }).drop("edge", "closes", "bad", "n", "total", "square", "up")


def matched_volatility(grid: DataFrame, w: int) -> DataFrame:
    """As realized_volatility, as matched controls have it: windows of 5 bars or more, from max(3, 0.8 w) closes up."""
    if w < 5:
        return grid.withColumns({"volatility": F.lit(None).cast("double"), "up_part": F.lit(None).cast("double")})
    return realized_volatility(grid, w, max(3, int(0.8 * w))).drop("log_return")


def range_position(grid: DataFrame, w: int) -> DataFrame:
    """Adds position (0 at the window's low, 1 at its high), vs_high and vs_low (percent from them) and the bars since the last
    high and the last low."""
    i, seen = F.col("i"), F.col("observed")
    rows = windowed(grid.withColumn("i", F.row_number().over(by_time())), {
        "top": Over("max", F.when(seen, F.struct("high", i.alias("i"))), w), "bottom": Over("max", F.when(seen, F.struct((-F.col("low")).alias("low"), i.alias("i"))), w),
    })
    low, wide = -F.col("bottom.low"), F.col("top.high") > -F.col("bottom.low")
    return rows.withColumns({
        "position": F.when(wide, ratio(F.col("close") - low, F.col("top.high") - low)), "vs_high": F.when(wide, pct_change(F.col("top.high"), F.col("close"))),
        "vs_low": F.when(wide, pct_change(low, F.col("close"))), "bars_since_high": i - F.col("top.i"), "bars_since_low": i - F.col("bottom.i"),
    }).drop("i", "top", "bottom")


def drawdown_runup(grid: DataFrame, w: int) -> DataFrame:
    """Adds drawdown and runup in percent over the last w bars, gaps left out; both null below two closes, or where a close
    isn't positive."""
    rows, known = windows.path_extremes(grid, F.col("close"), w), F.col("path_known") >= 2
    return rows.withColumns({"drawdown": F.when(known, F.col("path_fall") * 100), "runup": F.when(known, F.col("path_rise") * 100)}).drop(
        "path_known", "path_low", "path_high", "path_rise", "path_fall"
    )


def whole_path(grid: DataFrame, w: int) -> DataFrame:
    """As drawdown_runup, but null where one of the w closes is missing."""
    rows, whole = windows.path_extremes(grid, F.col("close"), w), (F.col("path_known") == w) & F.lit(w > 1)
    return rows.withColumns({"drawdown": F.when(whole, F.col("path_fall") * 100), "runup": F.when(whole, F.col("path_rise") * 100)}).drop(
        "path_known", "path_low", "path_high", "path_rise", "path_fall"
    )


def log_trend(grid: DataFrame, w: int, bars_per_day: int, most: int = 600) -> DataFrame:
    """Adds trend (daily percent) and trend_r2 of the closes of the last w bars, as ``windows.log_trend`` says."""
    return windows.log_trend(grid, F.col("close"), w, bars_per_day, most)


def whole_sum(name: str, w: int) -> Column:
    """The sum over the last w bars where none of them is missing."""
    return F.when(F.count(name).over(last(w)) == w, F.sum(name).over(last(w)))


def whole_clock_ratio(grid: DataFrame, value: Column, day: int, days: int = 7, least: int = 0) -> DataFrame:
    """Adds clock_ratio: the value over the median of its values at the same time on the days before, null below ``least``
    known ones, and clock_days, their number. Zeros are values; a median of zero gives null."""
    earlier = F.sort_array(F.array_compact(F.array(*(F.lag("x", day * d).over(by_time()) for d in range(1, days + 1)))))
    n = F.size("earlier")
    at = lambda k: F.get("earlier", k.cast("int"))
    median = (at(F.floor((n - 1) / 2)) + at(F.floor(n / 2))) / 2
    return grid.withColumn("x", value).withColumn("earlier", earlier).withColumns({
        "clock_days": n, "clock_ratio": F.when(n >= least, ratio(F.col("x"), median)),
    }).drop("x", "earlier")


def outcomes(grid: DataFrame, w: int) -> DataFrame:
    """Adds outcome_gain and outcome_drawdown in percent of the close and outcome_coverage over the w bars that begin with
    the decision, at this bar's end: never inputs of a prediction."""
    rows = windowed(grid, {
        "__high": Over("max", F.col("high"), w, 1, True), "__low": Over("min", F.col("low"), w, 1, True),
        "__seen": Over("count", F.when(F.col("observed"), 1), w, 1, True),
    })
    there = F.least(F.row_number().over(by_time(ahead=True)) - 1, F.lit(w))
    return rows.withColumns({
        "outcome_gain": pct_change(F.col("close"), F.col("__high")), "outcome_drawdown": pct_change(F.col("close"), F.col("__low")),
        "outcome_coverage": F.coalesce(ratio(F.col("__seen").cast("double"), there), F.lit(0.0)),
    }).drop("__high", "__low", "__seen")


def candle_shape(grid: DataFrame) -> DataFrame:
    """Adds body, upper and lower: parts of the bar's range."""
    span = F.nullif(F.col("high") - F.col("low"), F.lit(0.0))
    return grid.withColumns({
        "body": F.try_divide(F.abs(F.col("close") - F.col("open")), span),
        "upper": F.try_divide(F.col("high") - F.greatest("open", "close"), span),
        "lower": F.try_divide(F.least("open", "close") - F.col("low"), span),
    })
