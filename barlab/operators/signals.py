"""Continuous signals on the grid, and the selection of candidates from them."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from ..functions.scalars import finite_or_null, holds, pct_change, ratio
from ..sources.staging import discard, staged
from .rolling import whole_clock_ratio, whole_path, whole_sum
from .windows import Over, by_time, rolling_median, whole, windowed


def liquidity_gate(grid: DataFrame, w: int, median: float, quote: float, trades: int) -> DataFrame:
    """Adds liquid: over the last w bars, all observed, the median and the sum of the quote volume and the number of
    trades reach their floors."""
    rows = rolling_median(grid, "__median", "quote_volume", w)
    rows = windowed(rows, {
        "__seen": Over("count", F.when(F.col("observed"), 1), w), "__quote": Over("sum", F.col("quote_volume"), w), "__trades": Over("sum", F.col("trade_count"), w),
    })
    good = (F.col("__seen") == w) & (F.col("__median") >= median) & (F.col("__quote") >= quote) & (F.col("__trades") >= trades)
    return rows.withColumn("liquid", holds(good)).drop("__median", "__seen", "__quote", "__trades")


def acceleration(grid: DataFrame, w: int, day: int, gain: float, step_up: float, clock: float, refs: int) -> DataFrame:
    """Adds accelerating: the return over w bars, the trades of the later half over the earlier half's, and the trades
    over those at the same time on earlier days (``refs`` of them known) reach their floors. Windows with a gap are
    unknown; days without trades are days."""
    rows = whole(grid.withColumn("__t", F.col("trade_count").cast("double")), "__whole", "sum", F.col("__t"), w)
    rows = whole_clock_ratio(whole(rows, "__late", "sum", F.col("__t"), w // 2), F.col("__whole"), day)
    early = F.nullif(F.col("__whole") - F.col("__late"), F.lit(0.0))
    return rows.withColumn("accelerating", holds(
        (pct_change(F.lag("close", w).over(by_time()), F.col("close")) >= gain) & (F.col("__late") >= step_up * early)
        & (F.col("clock_ratio") >= clock) & (F.col("clock_days") >= refs)
    )).drop("__t", "__whole", "__late")


def armed_recently(grid: DataFrame, w: int, gain: float, volume_w: int, day: int, clock: float, refs: int, ttl: int) -> DataFrame:
    """Adds rise_from_low, long_ratio (quote volume over ``volume_w`` bars to its median at the same time on the days
    before), armed (the rise from the least low of the last w bars, all observed, reaches ``gain`` percent, and the
    ratio ``clock`` with at least ``refs`` days known) and armed_recent: armed in one of the ``ttl`` bars before."""
    rows = whole_clock_ratio(whole(grid, "__long", "sum", F.col("quote_volume"), volume_w), F.col("__long"), day)
    rows = windowed(rows.withColumnsRenamed({"clock_ratio": "long_ratio", "clock_days": "long_days"}), {
        "__low": Over("min", F.col("low"), w), "__lows": Over("count", F.col("low"), w), "__seen": Over("count", F.when(F.col("observed"), 1), w),
    })
    rows = rows.withColumn("rise_from_low", F.when(F.col("__lows") == w, pct_change(F.col("__low"), F.col("close"))))
    rows = rows.withColumn("armed", holds((F.col("__seen") == w) & (F.col("rise_from_low") >= gain) & (F.col("long_ratio") >= clock) & (F.col("long_days") >= refs)))
    rows = windowed(rows, {"__armed": Over("count", F.when(F.col("armed"), 1), ttl, 1)})
    return rows.withColumn("armed_recent", F.col("__armed") > 0).drop("long_days", "__long", "__low", "__lows", "__seen", "__armed")


def late_momentum(grid: DataFrame, w: int, day: int, floors: dict[str, float], refs: int, least: int, short: int) -> DataFrame:
    """Adds components, how many of four hold (return, volume over the same clock time with ``refs`` days known, position
    in the day's range, run-up), each by itself, and late: at least ``least`` of them in an observed bar whose last
    ``short`` bars have volume. A window with a gap is unknown; the day's may lack 10 of 1440 parts."""
    rows = windowed(grid, {"__n": Over("count", F.col("high"), day), "__lo": Over("min", F.col("low"), day), "__hi": Over("max", F.col("high"), day)})
    full, low, high = F.col("__n") >= day * 1430 / 1440, F.col("__lo"), F.col("__hi")
    rows = whole_clock_ratio(rows.withColumns({"quote_w": whole_sum("quote_volume", w), "quote_short": whole_sum("quote_volume", short)}), F.col("quote_w"), day)
    rows = whole_path(rows, w).withColumns({
        "return_w": pct_change(F.lag("close", w).over(by_time()), F.col("close")), "position": F.when(full & (high > low), (F.col("close") - low) / (high - low)),
    }).drop("__n", "__lo", "__hi")
    rows = rows.withColumns({
        "return_pass": holds(F.col("return_w") >= floors["gain"]), "volume_pass": holds((F.col("clock_ratio") >= floors["clock"]) & (F.col("clock_days") >= refs)),
        "range_pass": holds(F.col("position") >= floors["position"]), "runup_pass": holds(F.col("runup") >= floors["runup"]),
    })
    count = sum((F.col(c).cast("int") for c in ("return_pass", "volume_pass", "range_pass", "runup_pass")), F.lit(0))
    return rows.withColumn("components", count).withColumn(
        "late", holds((F.col("components") >= least) & F.col("observed") & (F.col("quote_short") >= floors["quote"]))
    ).drop("quote_w", "drawdown")


def entry_signals(grid: DataFrame, rule: dict[str, float]) -> DataFrame:
    """The two entry signals at every bar, from bars up to it alone. ``rule`` has windows in bars (w, long, deep, day,
    ttl), floors and ``refs``, the days that a same-clock ratio needs. Adds liquid, three confirmations t3 (trades
    accelerate), t4 (volume accelerates) and t5 (a run-up and a fall on the way, asked only where the price is high in
    its range), components, e1_edge (liquid and one of them begins to hold), armed, armed_recent, e2_edge (that in an
    armed time) and the measures behind them."""
    w, half, day, refs = rule["w"], rule["w"] // 2, rule["day"], rule["refs"]
    rows = liquidity_gate(grid, w, rule["median"], rule["quote"], rule["trades"])
    rows, double = rows.withColumn("trade_count", F.col("trade_count").cast("double")), {"q": "quote_volume", "t": "trade_count"}
    sums = {f"{n}{part}": Over(how, F.col(c), width) for n, c in double.items() for part, how, width in (("", "sum", w), ("_n", "count", w), ("_late", "sum", half), ("_late_n", "count", half))}
    rows = windowed(rows, sums | {
        "low_w": Over("min", F.col("low"), w), "lows": Over("count", F.col("low"), w), "high_w": Over("max", F.col("high"), w), "highs": Over("count", F.col("high"), w),
        "seen_long": Over("count", F.when(F.col("observed"), 1), rule["long"]),
    })
    rows = rows.withColumns({
        **{c: F.when(F.col(f"{c}_n") == (half if c.endswith("late") else w), F.col(c)) for c in ("q", "t", "q_late", "t_late")},
        "return_w": pct_change(F.lag("close", w).over(by_time()), F.col("close")), "whole_long": F.col("seen_long") == rule["long"],
        "low_w": F.when(F.col("lows") == w, F.col("low_w")), "high_w": F.when(F.col("highs") == w, F.col("high_w")),
    }).drop("q_n", "t_n", "q_late_n", "t_late_n", "lows", "highs", "seen_long")
    rows = whole_clock_ratio(rows, F.col("q"), day).withColumnsRenamed({"clock_ratio": "q_ratio", "clock_days": "q_days"})
    rows = whole_clock_ratio(rows, F.col("t"), day).withColumnsRenamed({"clock_ratio": "t_ratio", "clock_days": "t_days"})
    step = lambda c: ratio(F.col(f"{c}_late"), F.nullif(F.col(c) - F.col(f"{c}_late"), F.lit(0.0)))
    rows = rows.withColumns({"q_step": step("q"), "t_step": step("t"), "position": ratio(F.col("close") - F.col("low_w"), F.nullif(F.col("high_w") - F.col("low_w"), F.lit(0.0)))})
    rows = armed_recently(rows, rule["deep"], rule["rise"], rule["long"], day, rule["long_clock"], refs, rule["ttl"])
    early = F.col("q") - F.col("q_late"), F.col("t") - F.col("t_late")
    rows = rows.withColumns({
        "t3": holds((F.col("return_w") >= rule["t3_gain"]) & (F.col("t_late") >= rule["step"] * F.nullif(early[1], F.lit(0.0))) & (F.col("t_ratio") >= rule["t3_clock"]) & (F.col("t_days") >= refs)),
        "t4": holds((F.col("return_w") >= rule["t4_gain"]) & (F.col("q_ratio") >= rule["t4_clock"]) & (F.col("q_late") >= rule["step"] * F.nullif(early[0], F.lit(0.0))) & (F.col("q_days") >= refs)),
        "asked": holds((F.col("return_w") >= rule["t5_gain"]) & (F.col("position") >= rule["t5_position"]) & F.col("whole_long")),
    })
    rows = whole_path(rows, rule["long"])
    rows = rows.withColumns({c: F.when(F.col("asked"), F.col(c)) for c in ("runup", "drawdown")})
    rows = rows.withColumn("t5", holds((F.col("runup") >= rule["t5_runup"]) & (F.col("drawdown") <= rule["t5_drawdown"])))
    rows = rows.withColumn("components", sum((F.col(c).cast("int") for c in ("t3", "t4", "t5")), F.lit(0)))
    rows = rows.withColumn("e1", F.col("liquid") & (F.col("components") > 0)).withColumn("e2", F.col("e1") & F.col("armed_recent"))
    return rows.withColumns({
        "e1_edge": rising_edge(F.col("e1")), "e2_edge": rising_edge(F.col("e2")), "activity": F.coalesce(F.greatest("q_ratio", "t_ratio"), F.lit(0.0)),
    }).drop("low_w", "high_w", "whole_long", "q_late", "t_late", "q_days", "t_days", "e1", "e2", "asked")


def entry_reach(rule: dict[str, float]) -> int:
    """How many bars entry_signals looks back from a bar: a bar armed before, its low or its volume's days, and an edge."""
    return rule["ttl"] + max(rule["deep"], 7 * rule["day"] + max(rule["w"], rule["long"])) + 2


def rising_edge(state: Column) -> Column:
    """The state holds here and did not hold one bar earlier; the first bar has no earlier one, so may be an edge."""
    return state & ~F.lag(state, 1, False).over(by_time())


def candidates(rows: DataFrame, trigger: Column, step: str, *columns: str) -> DataFrame:
    """Rows where the trigger holds; the decision falls at the bar's end. Not-a-numbers become null."""
    clean = [finite_or_null(F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in rows.select(*columns).dtypes]
    at = F.expr(f"open_time + interval {step}").alias("decision_time")
    return rows.where(trigger).select("symbol", F.col("open_time").alias("signal_bar"), at, F.col("close").alias("signal_close"), *clean)


def before_outcome_cutoff(found: DataFrame, end: Column, seconds: int) -> DataFrame:
    """Candidates early enough for their outcome to lie before ``end``."""
    return found.where(F.unix_micros("decision_time") <= F.unix_micros(end) - seconds * 1_000_000)


def select_greedily(found: DataFrame, cooldown_seconds: int, per_day: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``found``: symbol, decision_time, components, activity and the columns of ``by``, each value of which is a selection
    of its own. Takes candidates in order of time, then components and activity downwards, then symbol; a symbol rests
    after a selection, and a UTC day takes so many. Adds decision."""
    rests = F.timestamp_micros(F.unix_micros("decision_time") + cooldown_seconds * 1_000_000)
    rows = found.select(*by, "symbol", "decision_time", "components", "activity", rests.alias("rests"), F.lit(1).alias("counted"))
    label = F.when(F.col("rested"), "suppressed_symbol_cooldown").when(F.col("capped"), "suppressed_daily_cap").otherwise("selected")
    return _settled(rows, per_day, by).withColumn("decision", label).drop("rests", "counted", "rested", "capped")


def select_with_feedback(executed: DataFrame, rest_seconds: int, per_day: int) -> DataFrame:
    """``executed``: symbol, decision_time, components, activity, status, exit_time: every candidate with what it would
    have come to. Takes them in the order of select_greedily; a UTC day takes so many that complete, by the day of the
    decision, and a symbol rests after its exit, or after the decision where it failed. Adds decision: the status of
    those taken, else what suppressed them. Executions don't depend on the selection."""
    done = F.col("status") == "completed"
    rests = F.timestamp_micros(F.unix_micros(F.when(done, F.col("exit_time")).otherwise(F.col("decision_time"))) + rest_seconds * 1_000_000)
    rows = executed.select("symbol", "decision_time", "components", "activity", "status", "exit_time", rests.alias("rests"), done.cast("int").alias("counted"))
    label = F.when(F.col("rested"), "suppressed_symbol_cooldown").when(F.col("capped"), "suppressed_daily_trade_cap").otherwise(F.col("status"))
    return _settled(rows, per_day, ()).withColumn("decision", label).drop("rests", "counted", "rested", "capped")


def _settled(rows: DataFrame, per_day: int, by: tuple[str, ...]) -> DataFrame:
    """``rows``: symbol, decision_time, components, activity, rests (until when a symbol that is taken rests), counted (whether
    it fills a place of its day). Adds rested (the symbol rests) and capped (it doesn't, but its day is full).

    A day's cap couples symbols and a rest couples days, but neither needs one task. In a round every symbol goes through
    its own candidates in order, taking the day's full ones as the last round left them, and then every day counts its
    candidates that don't rest. What a round says of a candidate depends on earlier candidates alone, so each round
    settles more of the order's beginning, and where two rounds agree that is the fold in order. Most often the first
    round meets no full day, or the second agrees."""
    order = [F.asc("decision_time"), F.desc("components"), F.desc("activity"), F.asc("symbol"), F.asc("place")]
    rows = staged(rows.withColumns({"place": F.monotonically_increasing_id(), "capped": F.lit(False)}), "candidates")
    schema = StructType([*rows.schema.fields, StructField("rested", BooleanType())])

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, until = None, None
        for batch in batches:
            columns = [batch.column(c) for c in (*by, "symbol")]
            at, rests = (batch.column(c).cast(pa.int64()).to_pylist() for c in ("decision_time", "rests"))
            out = []
            for k, (now, then, capped) in enumerate(zip(at, rests, batch.column("capped").to_pylist())):
                mine = tuple(c[k].as_py() for c in columns)
                if mine != key:
                    key, until = mine, None
                rested = until is not None and now < until
                if not rested and not capped:
                    until = then
                out.append(rested)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.bool_())], schema.names)

    day = Window.partitionBy(*by, F.to_date("decision_time")).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    filled = F.coalesce(F.sum(F.when(~F.col("rested"), F.col("counted"))).over(day), F.lit(0))
    while True:
        walked = rows.repartition(*by, "symbol").sortWithinPartitions(*by, "symbol", *order).mapInArrow(own, schema)
        now = walked.withColumn("full", ~F.col("rested") & (filled >= per_day))
        now = staged(now.withColumn("changed", F.col("full") != F.col("capped")).drop("capped").withColumnRenamed("full", "capped"), "round")
        settled = not now.where("changed").limit(1).count()
        discard(rows)
        if settled:
            return now.drop("changed", "place")
        rows = now.select(*rows.columns)
        rows.staged_at = now.staged_at


def executed_once(selections: DataFrame) -> DataFrame:
    """``selections``: strategy, symbol, decision_time and what an execution needs. One row for each symbol and time that
    any strategy selected (of the first strategy by name)."""
    rest = [c for c in selections.columns if c not in ("symbol", "decision_time")]
    first = F.min_by(F.struct(*rest), "strategy").alias("r")
    return selections.groupBy("symbol", "decision_time").agg(first).select("symbol", "decision_time", *(F.col(f"r.{c}") for c in rest if c != "strategy"))


def executions_by_strategy(selections: DataFrame, executions: DataFrame) -> DataFrame:
    """Each strategy's selections with their execution; one that has none is execution_missing."""
    keys = ["symbol", "decision_time"]
    out = selections.select("strategy", *keys).join(executions, keys, "left")
    return out.withColumn("status", F.coalesce("status", F.lit("execution_missing")))
