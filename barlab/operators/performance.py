"""Performance of completed trades, concurrency, coverage and graduation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def performance(trades: DataFrame, by: list[str], start_equity: float = 0.0) -> DataFrame:
    """``trades``: status, entry_time, net_pnl, net_return, symbol and the columns of ``by``. Over completed trades:
    count, wins, expectancy, mean and median return, profit factor (infinite without losses), the largest fall from a
    running peak of the equity after each trade, the longest run of losses, symbols and the largest one's share; and
    beside them how many trades were left out for not being completed, and the parts of all with an entry: fill_rate counts
    every status but entry_not_filled, strict_fill_rate also leaves out executions that failed or are missing."""
    done = F.col("status") == "completed"
    order = Window.partitionBy(*by).orderBy("entry_time", "symbol")
    so_far = order.rowsBetween(Window.unboundedPreceding, 0)
    trades = trades.withColumn("net_pnl", F.when(done, F.coalesce("net_pnl", F.lit(0.0))))
    rows = trades.where(done).withColumns({"equity": start_equity + F.sum("net_pnl").over(so_far), "loss": F.col("net_pnl") <= 0})
    rows = rows.withColumns({"fall": F.max("equity").over(so_far) - F.col("equity"), "streak": F.count(F.when(~F.col("loss"), 1)).over(so_far)})
    runs = rows.groupBy(*by, "streak").agg(F.count(F.when(F.col("loss"), 1)).alias("n")).groupBy(*by).agg(F.max("n").alias("longest_losing_run"))
    share = rows.groupBy(*by, "symbol").agg(F.count(F.lit(1)).alias("n")).groupBy(*by).agg((F.max("n") / F.sum("n")).alias("largest_symbol_share"))
    won, lost = F.sum(F.when(~F.col("loss"), F.col("net_pnl")).otherwise(0.0)), -F.sum(F.when(F.col("loss"), F.col("net_pnl")).otherwise(0.0))
    stats = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("trades"), F.count(F.when(~F.col("loss"), 1)).alias("wins"), F.avg("net_pnl").alias("expectancy"),
        F.sum("net_pnl").alias("total_pnl"), F.avg("net_return").alias("mean_return"), F.percentile("net_return", F.lit(0.5)).alias("median_return"),
        F.when(lost > 0, won / lost).otherwise(F.lit(float("inf"))).alias("profit_factor"), F.max("fall").alias("max_drawdown"),
        F.count_distinct("symbol").alias("symbols"),
    )
    part = lambda c: F.avg(c.cast("double"))
    left_out = trades.groupBy(*by).agg(
        F.count(F.when(~done, 1)).alias("left_out"), part(F.col("status") != "entry_not_filled").alias("fill_rate"),
        part(F.col("status").isin("completed", "exit_not_filled")).alias("strict_fill_rate"),
    )
    return left_out.join(stats, by, "left").join(runs, by, "left").join(share, by, "left").fillna(0, ["trades", "longest_losing_run"])


def max_concurrency(trades: DataFrame, by: list[str]) -> DataFrame:
    """The most trades held at once; at equal times exits come before entries."""
    legs = trades.where("status = 'completed'")
    moves = legs.select(*by, F.col("entry_time").alias("at"), F.lit(1).alias("d")).unionByName(legs.select(*by, F.col("exit_time").alias("at"), F.lit(-1).alias("d")))
    held = F.sum("d").over(Window.partitionBy(*by).orderBy("at", "d").rowsBetween(Window.unboundedPreceding, 0))
    return moves.withColumn("held", held).groupBy(*by).agg(F.max("held").alias("max_concurrency"))


def chronological_parts(trades: DataFrame, start: Column, end: Column, parts: int) -> DataFrame:
    """Trades that were entered in [start, end), with the equal part of it, from 1."""
    a, b, at = F.unix_micros(start), F.unix_micros(end), F.unix_micros("entry_time")
    inside = trades.where((at >= a) & (at < b))
    return inside.withColumn("part", (F.floor((at - a) * parts / (b - a)) + 1).cast("int"))


def daily_results(trades: DataFrame, by: list[str]) -> DataFrame:
    """Completed trades by the UTC day of their entry: how many, won and lost, and what they made."""
    done = trades.where("status = 'completed'").withColumn("day", F.to_date("entry_time"))
    pnl = F.coalesce("net_pnl", F.lit(0.0))
    return done.groupBy(*by, "day").agg(
        F.count(F.lit(1)).alias("trades"), F.sum(pnl).alias("net_pnl"), F.count_if(pnl > 0).alias("won"), F.count_if(pnl <= 0).alias("lost"),
    )


def path_diagnostics(paths: DataFrame, by: list[str], targets: tuple[int, ...] = ()) -> DataFrame:
    """Of mfe and mae: medians, the tenth percentile and the worst of mae; and the part that reached each target
    (touch_N isn't null)."""
    return paths.groupBy(*by).agg(
        F.percentile("mfe", F.lit(0.5)).alias("median_mfe"), F.percentile("mae", F.lit(0.5)).alias("median_mae"),
        F.percentile("mae", F.lit(0.1)).alias("mae_p10"), F.min("mae").alias("worst_mae"),
        *(F.avg(F.col(f"touch_{t}").isNotNull().cast("double")).alias(f"hit_{t}_rate") for t in targets),
    )


#: Checks by name: the measure, and how it must stand to its floor. Those on parts of the period stand for every part.
CHECKS = {
    "minimum_completed_trades": ("trades", ">="), "minimum_unique_symbols": ("symbols", ">="), "positive_total_net_pnl": ("total_pnl", ">"),
    "minimum_expectancy": ("expectancy", ">="), "minimum_profit_factor": ("profit_factor", ">="), "maximum_drawdown": ("max_drawdown", "<="),
    "maximum_consecutive_losses": ("longest_losing_run", "<="), "maximum_symbol_concentration": ("largest_symbol_share", "<="),
    "minimum_entry_fill_rate": ("fill_rate", ">="), "minimum_trades_each_part": ("least_part_trades", ">="),
    "positive_expectancy_each_part": ("least_part_expectancy", ">"), "bootstrap_lower_expectancy_above_zero": ("bootstrap_low", ">"),
    "minimum_archive_coverage": ("coverage", ">="), "maximum_symbol_failure_fraction": ("failure_fraction", "<="),
}


def graduation(stats: DataFrame, floors: dict[str, float], strategies: int, infinite_fails: bool = False) -> DataFrame:
    """``stats``: the measures of CHECKS. One boolean for each check that ``floors`` names, whether all hold, and the
    failed ones' names; a missing measure fails. With ``infinite_fails`` so does a profit factor without losses. Beside a
    pass stands the number of strategies tried, for a pass among many means less."""
    def check(name: str) -> Column:
        measure, sign = CHECKS[name]
        value = F.col(measure).cast("double")
        if measure == "profit_factor" and infinite_fails:
            value = F.when(value != float("inf"), value)
        floor = F.lit(float(floors[name]))
        return F.coalesce({">=": value >= floor, ">": value > floor, "<=": value <= floor}[sign], F.lit(False))

    known = {name: check(name) for name in CHECKS if name in floors}
    failed = F.array_compact(F.array(*(F.when(~c, F.lit(k)) for k, c in known.items())))
    return stats.select(
        "*", *(c.alias(k) for k, c in known.items()), (F.size(failed) == 0).alias("passed"), F.concat_ws(",", failed).alias("failed"),
        F.lit(strategies).alias("strategies_tried"),
    )


def over_parts(parts: DataFrame, by: list[str], many: int) -> DataFrame:
    """``parts``: performance by ``by`` and part. The least trades and the least expectancy of ``many`` parts; a part
    without completed trades has 0 of them and no expectancy, which makes the least null."""
    there = F.count(F.when(F.col("trades") > 0, 1)) == many
    return parts.groupBy(*by).agg(F.when(there, F.min("trades")).otherwise(0).alias("least_part_trades"), F.when(there, F.min("expectancy")).alias("least_part_expectancy"))


def coverage(grid: DataFrame) -> DataFrame:
    """Per symbol the observed part of its first to last observed bar, and of the whole grid."""
    seen = F.when(F.col("observed"), F.col("open_time"))
    span = grid.groupBy("symbol").agg(F.min(seen).alias("first_seen"), F.max(seen).alias("last_seen"))
    inside = (F.col("open_time") >= F.col("first_seen")) & (F.col("open_time") <= F.col("last_seen"))
    return grid.join(span, "symbol").groupBy("symbol").agg(
        F.avg(F.when(inside, F.col("observed").cast("double"))).alias("span_coverage"), F.avg(F.col("observed").cast("double")).alias("grid_coverage")
    )
