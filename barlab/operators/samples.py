"""Candidate times for controls, their gates, selection with reuse counts, and samples of events and controls."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import duration_band, holds, pct_change, ratio, stable_integer, tie_break, uuid5
from .rolling import whole_sum
from .windows import Over, by_time, over_ranges, windowed

#: Minutes from an event's clock time at which controls of the first and of the local-low kind are tried.
CLOCK_OFFSETS = (0, -15, 15, -30, 30, -45, 45, -60, 60)
LOW_OFFSETS = (0, *(sign * d for d in (15, 30, 45, 60, 90, 120, 150, 180, 210, 240) for sign in (-1, 1)))
#: How well a control fits its event, the best first.
CLOCK_TIERS = ("exact_clock_same_weekday", "exact_clock", "within_15m_same_weekday", "within_15m", "within_30m", "within_60m")
LOW_TIERS = (
    "same_clock_same_duration_30m", "same_clock_same_band", "within_60m_same_duration_30m", "within_60m_same_band", "within_240m_same_band",
)


def named(rank: Column, names: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), rank + 1)


def clock_candidates(events: DataFrame, days: DataFrame, offsets: tuple[int, ...] = CLOCK_OFFSETS) -> DataFrame:
    """``events``: event_id, symbol, event_time, split; ``days``: day, split. Each event's clock time, moved by each offset
    in minutes, on every day of its split, where the result falls on a day of the split: event_id, symbol, event_time,
    split, day, at, offset, same_weekday, day_distance (of the moved time), base_distance (of the day), tier."""
    clock = F.unix_micros("event_time") % 86_400_000_000
    spread = events.withColumn("offset", F.explode(F.array(*map(F.lit, offsets)))).join(days, "split")
    rows = spread.withColumn("at", F.timestamp_micros(F.unix_micros(F.col("day").cast("timestamp")) + clock + F.col("offset").cast("long") * 60_000_000))
    there = days.select(F.col("day").alias("at_day"), F.col("split").alias("at_split"))
    rows = rows.withColumn("at_day", F.to_date("at")).join(there, "at_day").where("at_split = split")
    same = F.weekday("at") == F.weekday("event_time")
    far = F.abs("offset")
    tier = F.when((far == 0) & same, 0).when(far == 0, 1).when((far <= 15) & same, 2).when(far <= 15, 3).when(far <= 30, 4).otherwise(5)
    return rows.select(
        "event_id", "symbol", "event_time", "split", "day", "at", "offset", same.alias("same_weekday"),
        F.abs(F.datediff("at", "event_time")).alias("day_distance"), F.abs(F.datediff("day", "event_time")).alias("base_distance"), tier.alias("tier"),
    )


def quality_gate(
    grid: DataFrame, crossing: str, horizons: tuple[int, ...], history: int, before: int, after: int, volume_bars: int, volume: float, part: float = 0.98,
) -> DataFrame:
    """For every bar taken as an anchor, in bars: reason, the first that rejects it or ``pass``: outside_loaded_range (the
    grid doesn't reach max(horizons, before) back and ``after`` on), missing_local_bars and near_crossing between them,
    insufficient_prior_history (``history`` bars up to the earliest decision, ``part`` of them observed),
    missing_entry_liquidity and below_entry_liquidity_floor (volume of the bars up to each decision); with least_volume
    and observed_fraction. Counts come from running totals, so wide windows cost what narrow ones do."""
    far, back = max(horizons), max(*horizons, before)
    so_far = by_time().rowsBetween(Window.unboundedPreceding, 0)
    rows = grid.withColumns({
        "seen": F.sum(F.col("observed").cast("int")).over(so_far), "crossed": F.sum(F.col(crossing).cast("int")).over(so_far),
        "volume_now": whole_sum("quote_volume", volume_bars), "i": F.row_number().over(by_time()),
    })
    at = lambda c, k: (F.lag(c, k) if k >= 0 else F.lead(c, -k)).over(by_time())
    between = lambda c, a, b: at(c, b) - F.coalesce(at(c, a + 1), F.lit(0))
    local, end = back + after + 1, far + 1
    volumes = [at("volume_now", h + 1) for h in horizons]
    rows = rows.withColumns({
        "inside": (F.col("i") > back) & at("i", -after).isNotNull() if after else F.col("i") > back,
        "local_seen": between("seen", back, -after), "local_crossed": between("crossed", back, -after),
        "whole_history": F.col("i") > end + history - 1, "observed_fraction": between("seen", end + history - 1, end) / F.lit(float(history)),
        "least_volume": F.least(*volumes) if len(volumes) > 1 else volumes[0],
        "unknown_volume": F.lit(False) if not volumes else sum((v.isNull().cast("int") for v in volumes), F.lit(0)) > 0,
    })
    reason = (
        F.when(~F.col("inside"), "outside_loaded_range").when(F.col("local_seen") < local, "missing_local_bars").when(F.col("local_crossed") > 0, "near_crossing")
        .when(~F.col("whole_history") | (F.col("observed_fraction") < part), "insufficient_prior_history").when(F.col("unknown_volume"), "missing_entry_liquidity")
        .when(F.col("least_volume") < volume, "below_entry_liquidity_floor").otherwise("pass")
    )
    return rows.select("symbol", "open_time", reason.alias("reason"), "least_volume", "observed_fraction")


def baseline_gate(grid: DataFrame, history: int, volume_bars: int, volume: float | None, part: float = 0.995) -> DataFrame:
    """For every bar taken as a baseline: reason, from the ``history`` bars before it (all there, ``part`` of them observed)
    and the volume of the last ``volume_bars`` of them (no floor, if None): insufficient_prior_history,
    missing_entry_liquidity, below_entry_liquidity_floor or pass; with observed_fraction and volume_before."""
    rows = windowed(grid.withColumn("now", whole_sum("quote_volume", volume_bars)), {"seen_before": Over("count", F.when(F.col("observed"), 1), history, 1)})
    rows = rows.withColumns({
        "there": F.least(F.row_number().over(by_time()) - 1, F.lit(history)), "observed_fraction": F.col("seen_before") / F.lit(float(history)),
        "volume_before": F.lag("now", 1).over(by_time()),
    })
    reason = F.when((F.col("there") < history) | (F.col("observed_fraction") < part), "insufficient_prior_history")
    if volume is not None:
        reason = reason.when(F.col("volume_before").isNull(), "missing_entry_liquidity").when(F.col("volume_before") < volume, "below_entry_liquidity_floor")
    return rows.select("symbol", "open_time", reason.otherwise("pass").alias("reason"), "observed_fraction", "volume_before")


def near_known(candidates: DataFrame, known: DataFrame, at: str, seconds: int) -> DataFrame:
    """Adds near_event: a time of ``known`` (symbol, event_time) of the symbol lies within ``seconds`` of the column ``at``.
    The range join is an equi-join on time buckets."""
    bucket = lambda c: F.floor(F.unix_seconds(c) / seconds)
    asked = candidates.select("symbol", F.col(at).alias("at_")).distinct()
    asked = asked.withColumn("bucket", F.explode(F.array(*(bucket(F.col("at_")) + d for d in (-1, 0, 1)))))
    hit = asked.join(known.select("symbol", "event_time", bucket(F.col("event_time")).alias("bucket")), ["symbol", "bucket"])
    hit = hit.where(F.abs(F.unix_micros("at_") - F.unix_micros("event_time")) < seconds * 1_000_000).select("symbol", F.col("at_").alias(at)).distinct()
    return candidates.join(hit.withColumn("near_event", F.lit(True)), ["symbol", at], "left").fillna(False, ["near_event"])


def judged_clock_controls(candidates: DataFrame, known: DataFrame, gate: DataFrame, unit: str, seconds: int) -> DataFrame:
    """Clock candidates with reason (within_known_event first, then the gate's at the candidate's bar), key (its bar) and
    tie."""
    rows = near_known(candidates, known, "at", seconds).withColumn("key", F.date_trunc(unit, "at"))
    rows = rows.join(gate.withColumnsRenamed({"open_time": "key", "reason": "gated"}), ["symbol", "key"], "left")
    reason = F.when(F.col("near_event"), "within_known_event").otherwise(F.coalesce("gated", F.lit("outside_loaded_range")))
    return rows.withColumns({"reason": reason, "tie": tie_break(F.col("event_id"), iso(F.col("at")))}).drop("near_event", "gated")


def iso(at: Column) -> Column:
    """A UTC time as ISO text, with microseconds where there are any."""
    return F.concat(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss"), F.when(F.unix_micros(at) % 1_000_000 != 0, F.date_format(at, ".SSSSSS")).otherwise(""), F.lit("+00:00"))


def judged_low_controls(candidates: DataFrame, known: DataFrame, baselines: DataFrame, gate: DataFrame, seconds: int, minutes_per_bar: int, unit: str) -> DataFrame:
    """Candidates of LOW_OFFSETS (with event_duration in minutes) as pseudo crossings: their algorithmic baseline, and
    reason, the first of: within_known_event, incomplete_algorithm_window, future_contamination, duration_band_mismatch,
    baseline_within_known_event, what ``gate`` says of the baseline. Adds tier by clock distance and by how much the
    durations differ, key (the baseline) and tie."""
    rows = near_known(candidates, known, "at", seconds).withColumn("bar", F.date_trunc(unit, "at"))
    found = baselines.select("symbol", F.col("open_time").alias("bar"), "baseline_time", "baseline_low", "duration", "future_gain", "contaminated")
    rows = rows.join(found, ["symbol", "bar"], "left").withColumn("duration", F.col("duration") * minutes_per_bar)
    rows = near_known(rows.withColumnRenamed("near_event", "near_cross"), known, "baseline_time", seconds)
    rows = rows.join(gate.withColumnsRenamed({"open_time": "baseline_time", "reason": "gated"}), ["symbol", "baseline_time"], "left")
    band = duration_band(F.col("event_duration"))
    reason = (
        F.when(F.col("near_cross"), "within_known_event").when(F.col("baseline_time").isNull(), "incomplete_algorithm_window")
        .when(F.col("contaminated"), "future_contamination").when(duration_band(F.col("duration")) != band, "duration_band_mismatch")
        .when(F.col("near_event"), "baseline_within_known_event").otherwise(F.coalesce("gated", F.lit("insufficient_prior_history")))
    )
    differ, far = F.abs(F.col("duration") - F.col("event_duration")), F.abs("offset")
    tier = F.when((far == 0) & (differ <= 30), 0).when(far == 0, 1).when((far <= 60) & (differ <= 30), 2).when(far <= 60, 3).otherwise(4)
    return rows.withColumns({
        "reason": reason, "tier": tier, "key": F.col("baseline_time"), "duration_difference": differ, "band": band, "day_distance": F.col("base_distance"),
        "tie": tie_break(F.col("event_id"), iso(F.col("at")), iso(F.col("baseline_time"))),
    }).drop("bar", "near_cross", "near_event", "gated")


_SELECTED = (
    "event_id string, symbol string, at timestamp, key timestamp, tier int, control_rank int, prior_reuse int, quality_status string"
)


def select_controls(judged: DataFrame, k: int, reused: str = "reused_control_anchor") -> DataFrame:
    """``judged``: candidates with reason, key, event_time, tier, same_weekday, day_distance, tie (and duration_difference).
    For each event, in order of time and id, the best passing candidate of every UTC day and of those the best ``k``: by
    whether and how often the key was taken before, tier, the difference of durations, weekday, distance and tie. What an
    event takes counts as reuse for later events of its symbol.

    The count couples the events of a symbol but no two symbols, so a symbol's candidates go through in order, streamed
    from a sorted partition; state is the counts of its keys, and one event's candidates (days by offsets) are held at
    once."""
    differ = F.col("duration_difference") if "duration_difference" in judged.columns else F.lit(0)
    rows = judged.where("reason = 'pass'").select(
        "symbol", "event_time", "event_id", "at", "key", F.col("tier").cast("int").alias("tier"), differ.cast("long").alias("differ"),
        (~F.col("same_weekday")).cast("int").alias("other_weekday"), F.col("day_distance").cast("int").alias("day_distance"), "tie",
    )

    def taken(event: list[tuple], used: Counter) -> list[tuple]:
        order = lambda r: (used[r[4]], *r[5:10])
        best = {}
        for r in sorted(event, key=order):
            best.setdefault(r[3].date(), r)
        out = []
        for rank, r in enumerate(sorted(best.values(), key=order)[:k], 1):
            out.append((r[2], r[0], r[3], r[4], r[5], rank, used[r[4]], "pass" if not used[r[4]] else reused))
            used[r[4]] += 1
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [c.split()[0] for c in _SELECTED.split(", ")]
        symbol, event, held, used = None, None, [], Counter()
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False, name=None):
                if r[:3] != event:
                    out += taken(held, used)
                    held, event = [], r[:3]
                    if r[0] != symbol:
                        symbol, used = r[0], Counter()
                held.append(r)
            yield pd.DataFrame(out, columns=names)
        yield pd.DataFrame(taken(held, used), columns=names)

    return rows.repartition("symbol").sortWithinPartitions("symbol", "event_time", "event_id").mapInPandas(run, _SELECTED)


def control_ids(selected: DataFrame, kind: str, *times: str) -> DataFrame:
    """Adds control_id, a name-based UUID of the kind, the event and the times."""
    return selected.withColumn("control_id", uuid5(F.lit(kind), F.col("event_id"), *(iso(F.col(t)) for t in times)))


def background_times(symbols: DataFrame, protocol: str, first_day: str, last_day: str, count: int) -> DataFrame:
    """Deterministic times for ``count`` background samples of each symbol, chosen without looking at prices: sample_index,
    candidate_rank, at. A hash of protocol, symbol and index gives a middle day and a minute; days follow in the order 0,
    -1, +1, -2, ..., round the span, each once."""
    seed = stable_integer(F.lit(protocol), F.col("symbol"), F.col("sample_index"))
    span = F.datediff(F.lit(last_day).cast("date"), F.lit(first_day).cast("date")) + 1
    rows = symbols.select("symbol").distinct().withColumn("sample_index", F.explode(F.sequence(F.lit(0), F.lit(count - 1)))).withColumns({"seed": seed, "span": span}).where("span > 0")
    rows = rows.withColumns({"middle": (F.col("seed") % F.col("span")).cast("int"), "minute": F.expr("cast((seed - seed % span) / span % 1440 as int)")})
    steps = rows.withColumn("step", F.explode(F.expr("sequence(0, span - 1)")))
    # Step 0 is the middle, odd steps lie before it, even ones after.
    delta = F.when(F.col("step") % 2 == 1, -F.expr("(step + 1) div 2")).otherwise(F.expr("step div 2"))
    steps = steps.withColumn("index", F.pmod(F.col("middle") + delta, F.col("span")).cast("int"))
    day = F.date_add(F.lit(first_day).cast("date"), F.col("index"))
    at = F.timestamp_seconds(F.unix_seconds(day.cast("timestamp")) + F.col("minute") * 60)
    return steps.select("symbol", "sample_index", (F.col("step") + 1).cast("int").alias("candidate_rank"), at.alias("at"))


def background_samples(times: DataFrame, judged_baselines: DataFrame, unit: str) -> DataFrame:
    """``times`` of background_times; ``judged_baselines``: symbol, bar, baseline_time, reason. Per symbol and sample index,
    in order, the first candidate that passes and whose baseline no earlier sample of the symbol has. A symbol has few
    samples, and one symbol's passing candidates (days by samples) are held at once."""
    rows = times.withColumn("bar", F.date_trunc(unit, "at")).join(judged_baselines, ["symbol", "bar"]).where("reason = 'pass'")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        used, out = set(), []
        for index, own in group.sort_values(["sample_index", "candidate_rank"]).groupby("sample_index", sort=True):
            for r in own.itertuples(index=False):
                if r.baseline_time not in used:
                    used.add(r.baseline_time)
                    out.append((r.symbol, int(index), int(r.candidate_rank), r.at, r.baseline_time))
                    break
        return pd.DataFrame(out, columns=["symbol", "sample_index", "candidate_rank", "at", "baseline_time"])

    schema = "symbol string, sample_index int, candidate_rank int, at timestamp, baseline_time timestamp"
    return rows.select("symbol", "sample_index", "candidate_rank", "at", "baseline_time").groupBy("symbol").applyInPandas(pick, schema)


def event_samples(events: DataFrame, unit: str, most_minutes: int) -> tuple[DataFrame, DataFrame]:
    """``events``: event_id, symbol, split, baseline_trade_time, baseline_time, cross_trade_time, cross_time. Samples with
    label 1: their baseline (the resolved trade's bar, else the scanner's), crossing, minutes between and how the baseline
    was resolved; and, apart, the events without a baseline or with minutes outside 1 to ``most_minutes``."""
    rows = events.select(
        "event_id", "symbol", "split", F.date_trunc(unit, F.coalesce("baseline_trade_time", "baseline_time")).alias("baseline_anchor"),
        F.date_trunc(unit, F.coalesce("cross_trade_time", "cross_time")).alias("cross_anchor"),
        F.when(F.col("baseline_trade_time").isNotNull(), "resolved_trade_minute").when(F.col("baseline_time").isNotNull(), "scanner_minute_fallback").alias("baseline_resolution"),
    ).withColumn("minutes", F.floor((F.unix_seconds("cross_anchor") - F.unix_seconds("baseline_anchor")) / 60))
    good = holds(F.col("minutes").between(1, most_minutes))
    issue = F.when(F.col("baseline_anchor").isNull(), "no_baseline_time").otherwise("duration_outside_window")
    samples = rows.where(good).withColumns({
        "sample_id": F.concat(F.lit("event:"), "event_id"), "match_group": F.col("event_id"), "label": F.lit(1), "control_id": F.lit(None).cast("string"), "control_rank": F.lit(None).cast("int"),
    })
    return samples, rows.where(~good).select("event_id", "symbol", "minutes", issue.alias("issue"))


def matched_samples(events: DataFrame, controls: DataFrame, unit: str) -> DataFrame:
    """Event samples and, for controls (control_id, event_id, split, symbol, control_rank, at) of known events, samples with
    label 0 whose baseline lies the event's duration before."""
    own = events.select("event_id", "minutes")
    made = controls.join(own, "event_id").withColumn("cross_anchor", F.date_trunc(unit, "at")).select(
        "event_id", "symbol", "split", F.timestamp_seconds(F.unix_seconds("cross_anchor") - F.col("minutes") * 60).alias("baseline_anchor"), "cross_anchor",
        F.lit("pseudo_baseline_same_event_duration").alias("baseline_resolution"), "minutes", F.concat(F.lit("control:"), "control_id").alias("sample_id"),
        F.col("event_id").alias("match_group"), F.lit(0).alias("label"), "control_id", "control_rank",
    )
    return events.unionByName(made)


def interval_return(long: Column, short: Column) -> Column:
    """Percent over the older part of a long window whose newest part is the short one; null where either lost all."""
    a, b = 1 + long / 100, 1 + short / 100
    return F.when((a > 0) & (b > 0), (F.try_divide(a, b) - 1) * 100)


def daily_rate_ratio(recent: Column, total: Column, days: int) -> Column:
    """The last day's amount to the daily rate of the ``days`` before it, from the total of both."""
    before = total - recent
    return F.when(before > 0, recent / (before / days))


def three_valued(*conditions: Column) -> Column:
    """True or false where every condition is known, else null."""
    known, all_ = F.lit(True), F.lit(True)
    for c in conditions:
        known, all_ = known & c.isNotNull(), all_ & c
    return F.when(known, all_)


def hypotheses(rows: DataFrame) -> DataFrame:
    """Adds h1 (weak base, then ignition), h2 (relative acceleration) and h3 (volatility reversal), unknown where an input
    is: prior_week, return_day, volume_rate, relative_day, acceleration, volatility_ratio."""
    c = F.col
    return rows.withColumns({
        "h1": three_valued(c("prior_week") <= 5, c("return_day") >= 5, c("volume_rate") >= 1.5),
        "h2": three_valued(c("relative_day") >= 5, c("acceleration") >= 5),
        "h3": three_valued(c("volatility_ratio") >= 0.4, c("prior_week") <= 5),
    })


def continuation_trigger(rows: DataFrame) -> DataFrame:
    """Adds late_components, how many of four hold (what is unknown doesn't), and trigger: three of them and liquidity.
    Inputs: return_short, clock_ratio, position, runup, liquid."""
    parts = [F.col("return_short") >= 0.9, F.col("clock_ratio") >= 12.0, F.col("position") >= 0.74, F.col("runup") >= 3.3]
    rows = rows.withColumn("late_components", sum((holds(p).cast("int") for p in parts), F.lit(0)))
    return rows.withColumn("trigger", holds(F.col("liquid")) & (F.col("late_components") >= 3))


def numbered_bars(grid: DataFrame, step_seconds: int) -> DataFrame:
    """symbol, n (the bar's number since the epoch), low, high, close, observed."""
    return grid.select("symbol", F.floor(F.unix_seconds("open_time") / step_seconds).alias("n"), "low", "high", "close", "observed")


def bar_number(at: Column, step_seconds: int, up: bool = False) -> Column:
    """The number of the bar that holds a time (or of the first one that doesn't begin before it)."""
    return (F.ceil if up else F.floor)(F.unix_seconds(at) / step_seconds).cast("long")


def window_audit(samples: DataFrame, grid: DataFrame, step_seconds: int, percent: float) -> DataFrame:
    """``samples``: sample_id, symbol, label, baseline_anchor, cross_anchor. Over the bars from baseline to crossing, both
    included: the observed part, the largest percent from a low to a later bar's high, crossed (it reaches ``percent``),
    and contaminated: a control whose window crossed or is observed below 0.99, or has no bar. A gap's own least low is
    unknown, so the bar after it has nothing to be compared with. Windows meet summaries of runs of bars, not the bars."""
    asked = samples.select("sample_id", "symbol", bar_number(F.col("baseline_anchor"), step_seconds, True).alias("first"), bar_number(F.col("cross_anchor"), step_seconds).alias("last"))
    found = over_ranges(asked, numbered_bars(grid, step_seconds), ["sample_id"])
    out = samples.join(found.select("sample_id", (F.col("seen") / F.col("bars").cast("double")).alias("part"), ((F.col("rise") - 1) * 100).alias("largest_gain")), "sample_id", "left")
    crossed = F.when(F.col("part").isNotNull(), holds(F.col("largest_gain") >= percent))
    return out.withColumns({
        "crossed": crossed, "contaminated": (F.col("label") == 0) & F.coalesce(crossed | (F.col("part") < 0.99), F.lit(True)), "part": F.coalesce("part", F.lit(0.0)),
    })


def sample_outcomes(samples: DataFrame, grid: DataFrame, step_seconds: int, ahead: int) -> DataFrame:
    """``samples``: sample_id, symbol, at (the decision), anchor. Adds, never to be used as inputs of a prediction, for the bars
    from the decision to the anchor (to_anchor) and for ``ahead`` bars from the decision on (next): outcome_*_gain and
    outcome_*_drawdown, percent from the entry (the close of the bar before the decision) to the highest high and the lowest
    low, and outcome_*_observed, the observed part (0 without bars)."""
    first = bar_number(F.col("at"), step_seconds)
    ranges = {"to_anchor": bar_number(F.col("anchor"), step_seconds), "next": first + ahead - 1}
    bars = numbered_bars(grid, step_seconds)
    span = F.explode(F.array(*(F.struct(F.lit(n).alias("span"), last.alias("last")) for n, last in ranges.items()))).alias("s")
    asked = samples.select("sample_id", "symbol", first.alias("first"), span).select("sample_id", "symbol", "first", "s.*")
    found = over_ranges(asked, bars, ["sample_id", "span"])
    of = lambda n, c: F.max(F.when(F.col("span") == n, F.col(c))).alias(f"{n}_{c}")
    wide = found.groupBy("sample_id").agg(*(of(n, c) for n in ranges for c in ("bars", "seen", "low", "top")))
    entry = bars.select("symbol", F.col("n").alias("entry_bar"), F.col("close").alias("entry"))
    out = samples.withColumn("entry_bar", first - 1).join(entry, ["symbol", "entry_bar"], "left").join(wide, "sample_id", "left")
    return out.withColumns({
        **{f"outcome_{n}_gain": pct_change(F.col("entry"), F.col(f"{n}_top")) for n in ranges},
        **{f"outcome_{n}_drawdown": pct_change(F.col("entry"), F.col(f"{n}_low")) for n in ranges},
        **{f"outcome_{n}_observed": F.coalesce(ratio(F.col(f"{n}_seen").cast("double"), F.col(f"{n}_bars")), F.lit(0.0)) for n in ranges},
    }).drop("entry_bar", *(f"{n}_{c}" for n in ranges for c in ("bars", "seen", "low", "top")))


def baseline_outcomes(samples: DataFrame, grid: DataFrame, step_seconds: int, ahead: int) -> DataFrame:
    """``samples``: sample_id, symbol, baseline_anchor, cross_anchor. One row each with the outcomes of the bars from baseline to
    crossing (to_cross) and of ``ahead`` bars from the baseline on (next): outcome_*_gain from the baseline bar's low (its
    close, where the low isn't positive), outcome_*_drawdown from its close, outcome_*_observed, and to_cross_high."""
    first = bar_number(F.col("baseline_anchor"), step_seconds)
    ranges = {"to_cross": bar_number(F.col("cross_anchor"), step_seconds), "next": first + ahead - 1}
    bars = numbered_bars(grid, step_seconds)
    span = F.explode(F.array(*(F.struct(F.lit(n).alias("span"), last.alias("last")) for n, last in ranges.items()))).alias("s")
    asked = samples.select("sample_id", "symbol", first.alias("first"), span).select("sample_id", "symbol", "first", "s.*")
    of = lambda n, c: F.max(F.when(F.col("span") == n, F.col(c))).alias(f"{n}_{c}")
    wide = over_ranges(asked, bars, ["sample_id", "span"]).groupBy("sample_id").agg(*(of(n, c) for n in ranges for c in ("bars", "seen", "low", "top")))
    base = bars.select("symbol", "n", F.col("low").alias("base_low"), F.col("close").alias("base_close"))
    out = samples.select("sample_id", "symbol", first.alias("n")).join(base, ["symbol", "n"], "left").join(wide, "sample_id", "left")
    # Where the crossing comes before the baseline, the first window has no bar and the second none to be compared with.
    some = F.col("to_cross_bars").isNotNull()
    low, close = F.when(some, F.when(F.col("base_low") > 0, F.col("base_low")).otherwise(F.col("base_close"))), F.when(some, F.col("base_close"))
    return out.select(
        "sample_id", F.col("to_cross_top").alias("to_cross_high"), *(pct_change(low, F.col(f"{n}_top")).alias(f"outcome_{n}_gain") for n in ranges),
        *(pct_change(close, F.col(f"{n}_low")).alias(f"outcome_{n}_drawdown") for n in ranges),
        *(F.coalesce(ratio(F.col(f"{n}_seen").cast("double"), F.col(f"{n}_bars")), F.lit(0.0)).alias(f"outcome_{n}_observed") for n in ranges),
    )
