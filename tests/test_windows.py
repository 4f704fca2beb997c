"""Wide windows against frames and brute force."""

import math
import random
import time
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from barlab.operators import context, rolling, samples, signals, surge, windows
from barlab.operators.windows import Over, by_time
from barlab.plans import signals_study

T0 = datetime(2024, 1, 1)


def bars(spark, closes, symbol="A"):
    """A bar an hour from a list of closes; None is a gap."""
    rows = [
        (symbol, T0 + timedelta(hours=i), x, None if x is None else x + 1, None if x is None else x - 1, x, None if x is None else 10.0 + i % 7, None if x is None else 3 + i % 5,
         None if x is None else 4.0 + i % 3, x is not None) for i, x in enumerate(closes)
    ]
    schema = "symbol string, open_time timestamp, open double, high double, low double, close double, quote_volume double, trade_count long, taker_buy_quote double, observed boolean"
    return spark.createDataFrame(rows, schema).withColumn("volume", F.col("quote_volume"))


def walk(rng, n, gaps=0.1, zeros=0.0):
    x, out = 100.0, []
    for _ in range(n):
        x *= math.exp(rng.gauss(0, 0.02))
        out.append(None if rng.random() < gaps else 0.0 if rng.random() < zeros else x)
    return out


def by_bar(frame, *columns):
    return [tuple(r[c] for c in columns) for r in frame.orderBy("open_time").collect()]


def close(a, b, tolerance=1e-9):
    return (a is None) == (b is None) and (a is None or abs(a - b) <= tolerance * max(1, abs(b)))


@pytest.mark.parametrize("w", [1, 2, 5, 33, 40, 200])
@pytest.mark.parametrize("skip, ahead", [(0, False), (1, False), (3, True), (1, True)])
def test_windows_equal_frames(spark, monkeypatch, w, skip, ahead):
    monkeypatch.setattr(windows, "NARROW", 0)
    grid = bars(spark, walk(random.Random(w), 90, 0.3))
    near, far = (skip, skip + w - 1) if ahead else (1 - w - skip, -skip)
    f = by_time().rowsBetween(near, far)
    pair = F.when(F.col("observed"), F.struct("low", "open_time"))
    want = grid.select("open_time", F.min("low").over(f), F.max("high").over(f), F.sum("close").over(f), F.count("close").over(f), F.min(pair).over(f)).toDF("open_time", "a", "b", "c", "d", "e")
    measures = {"a": ("min", F.col("low")), "b": ("max", F.col("high")), "c": ("sum", F.col("close")), "d": ("count", F.col("close")), "e": ("min", pair)}
    got = windows.windowed(grid, {n: Over(how, v, w, skip, ahead) for n, (how, v) in measures.items()})
    for g, h in zip(by_bar(got, *"abde"), by_bar(want, *"abde")):
        assert g == h
    for (g,), (h,) in zip(by_bar(got, "c"), by_bar(want, "c")):
        assert close(g, h)


@pytest.mark.parametrize("w, zeros", [(2, 0.0), (7, 0.05), (33, 0.01), (150, 0.0)])
def test_paths_equal_a_walk(spark, w, zeros):
    values = walk(random.Random(w), 120, 0.2, zeros)
    found = by_bar(rolling.drawdown_runup(bars(spark, values), w), "drawdown", "runup")
    strict = by_bar(rolling.whole_path(bars(spark, values), w), "drawdown", "runup")
    for i, (got, whole) in enumerate(zip(found, strict)):
        own = values[max(0, i - w + 1) : i + 1]
        known = [x for x in own if x is not None]
        if len(known) < 2 or min(known) <= 0:
            want = None, None
        else:
            a = np.array(known)
            want = float((a / np.maximum.accumulate(a) - 1).min() * 100), float((a / np.minimum.accumulate(a) - 1).max() * 100)
        assert close(got[0], want[0]) and close(got[1], want[1])
        want = want if len(own) == len(known) == w else (None, None)
        assert close(whole[0], want[0]) and close(whole[1], want[1])


@pytest.mark.parametrize("w", [3, 4, 40, 41])
def test_median_of_ties_and_gaps(spark, w):
    rng = random.Random(w)
    values = [None if rng.random() < 0.02 else float(rng.randrange(6)) for _ in range(150)]
    grid = bars(spark, values).unionByName(bars(spark, values[::-1], "B"))
    got = windows.rolling_median(grid, "m", "close", w)
    assert set(got.columns) == {*grid.columns, "m"}
    for symbol, own in (("A", values), ("B", values[::-1])):
        for i, (m,) in enumerate(by_bar(got.where(F.col("symbol") == symbol), "m")):
            part = own[max(0, i - w + 1) : i + 1]
            assert m == (float(np.median(part)) if len(part) == w and None not in part else None)


@pytest.mark.parametrize("w, most", [(8, 600), (50, 20), (70, 9), (100, 100)])
def test_trend_equals_least_squares(spark, w, most):
    values = walk(random.Random(w), 160, 0.15, 0.004) + [5.0] * 20
    got = by_bar(rolling.log_trend(bars(spark, values), w, 24, most), "trend", "trend_r2")
    for i, (trend, r2) in enumerate(got):
        own = [x for x in values[max(0, i - w + 1) : i + 1] if x is not None]
        if len(own) < 6 or min(own) <= 0:
            assert trend is None and r2 is None
            continue
        stride = max(1, math.ceil(len(own) / most))
        y = np.log(own[::stride])
        x = np.arange(len(y)) * stride
        if len(y) < 2:
            assert trend is None
            continue
        slope = float(((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum())
        total = float(((y - y.mean()) ** 2).sum())
        assert trend == pytest.approx(math.expm1(slope * 24) * 100, rel=1e-7, abs=1e-7)
        if total > 1e-20:
            assert r2 == pytest.approx(1 - float(((y - y.mean() - slope * (x - x.mean())) ** 2).sum()) / total, abs=1e-6)
        else:
            assert r2 is None


def test_runs_make_up_any_window(spark):
    rng = random.Random(2)
    pairs = [(a, a + rng.randrange(0, 700)) for a in (rng.randrange(0, 2000) for _ in range(80))] + [(5, 4), (0, 0), (0, 511), (7, 8)]
    rows = spark.createDataFrame(pairs, "a long, b long")
    for levels in (0, 1, 3):
        for r in rows.select("a", "b", windows.run_cover(F.col("a"), F.col("b"), levels).alias("runs")).collect():
            covered = sorted(x for level, block in r.runs for x in range(block * 8**level, (block + 1) * 8**level))
            assert covered == list(range(r.a, r.b + 1))
            assert levels < 3 or len(r.runs) <= 2 * 7 * 3 + 2


def test_ranges_equal_a_walk(spark):
    """With gaps, and lows that aren't positive."""
    rng = random.Random(5)
    values = [None if rng.random() < 0.1 else (0.5 if rng.random() < 0.01 else 50 + rng.random() * 40) for _ in range(300)]
    grid = bars(spark, values)
    first = int((T0 - datetime(1970, 1, 1)).total_seconds()) // 3600
    asked = [(i, "A", first + a, first + a + rng.randrange(0, 250)) for i, a in enumerate(rng.randrange(0, 290) for _ in range(60))]
    found = windows.over_ranges(spark.createDataFrame(asked, "key int, symbol string, first long, last long"), samples.numbered_bars(grid, 3600), ["key"])
    got = {r.key: r for r in found.collect()}
    for key, _, a, b in asked:
        own = values[a - first : b - first + 1]
        lows, best, before, last_known = [None if x is None else x - 1 for x in own], None, None, False
        for x, low in zip(own, lows):
            if x is not None and last_known and before is not None and before > 0:
                best = max(best or 0, (x + 1) / before)
            last_known = low is not None
            if low is not None:
                before = low if before is None else min(before, low)
        r = got[key]
        assert (r.bars, r.seen) == (len(own), sum(x is not None for x in own))
        assert close(r.rise, best) and r.low == min((x for x in lows if x is not None), default=None)


def test_a_symbol_goes_through_many_tasks(spark):
    grid = bars(spark, walk(random.Random(1), 400, 0.05))
    rule = signals_study.RULE | {"deep": 9, "long": 9, "day": 5, "refs": 2, "median": 1, "quote": 1, "trades": 1, "ttl": 10, "rise": 3.0, "t5_runup": 2.0, "t5_drawdown": -1.0}
    want = signals.entry_signals(grid, rule)
    back = signals.entry_reach(rule)
    chunked = windows.in_time_chunks(grid, lambda g: signals.entry_signals(g, rule), back, 3600, 70)
    columns = ["open_time", "liquid", "t3", "t4", "t5", "armed", "armed_recent", "e1_edge", "e2_edge", "components"]
    a, b = by_bar(want, *columns), by_bar(chunked, *columns)
    assert a == b and any(r[-1] for r in a) and any(r[6] for r in a)
    plan = chunked._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(symbol" in plan
    spread = windows.in_time_chunks(grid, lambda g: g.repartition(8, "symbol").withColumn("task", F.spark_partition_id()), back, 3600, 20)
    assert spread.select("task").distinct().count() > 3 and spread.count() == 400


def test_rise_from_the_low_of_three_days_of_minutes(spark):
    """A window of 4320 bars over 100000."""
    grid = spark.range(100_000).select(
        F.lit("A").alias("symbol"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 60).alias("open_time"), (F.lit(100.0) + F.pmod(F.xxhash64("id"), F.lit(1000)) / 10).alias("close"),
    ).withColumns({"low": F.col("close") - 1, "high": F.col("close") + 1, "observed": F.lit(True), "quote_volume": F.col("close")}).cache()
    grid.count()
    out = lambda: windows.windowed(grid, {"low_w": Over("min", F.col("low"), 4320)})
    out().agg(F.sum("low_w")).collect()
    began = time.time()
    total = out().agg(F.sum("low_w")).first()[0]
    took = time.time() - began
    low = np.array([r.low for r in grid.orderBy("open_time").collect()])
    want = sum(np.minimum.accumulate(low[:4319])) + np.lib.stride_tricks.sliding_window_view(low, 4320).min(axis=1).sum()
    assert total == pytest.approx(float(want)) and took < 3
    grid.unpersist()


def test_zero_prices_do_not_fail(spark):
    grid = bars(spark, [0.0, 5.0, 0.0, None, 6.0, 7.0, 0.0] * 8)
    rolling.drawdown_runup(grid, 4).collect()
    own = grid.where("observed").withColumn("sample_id", F.lit("s"))
    own = own.withColumns({"low": F.lit(0.0), "close": F.when(F.hour("open_time") % 2 == 0, 0.0).otherwise(F.col("close"))})
    assert context.daily_trends(own, 24).count() == 1 and context.episodes(own).count() == 1


def test_short_fills_have_no_exit_price(spark):
    t = lambda s: T0 + timedelta(seconds=s)
    resolved = spark.createDataFrame([("A", T0.date(), 2.0, t(0), t(60), 3.0)], "symbol string, event_date date, baseline_low double, baseline_trade_time timestamp, cross_trade_time timestamp, cross_trade_price double")
    trades = spark.createDataFrame([("A", 1, t(60), 3.0, 10.0, False), ("A", 2, t(61), 2.0, 10.0, True), ("A", 3, t(62), 4.0, 5.0, True)], "symbol string, trade_id long, ts timestamp, price double, qty double, is_buyer_maker boolean")
    of = lambda quote: surge.saleability(resolved, trades, 300, quote, 480, 1.5).first()
    r = of(500.0)
    assert r.exit_vwap is None and r.quote_reached_time is None and not r.saleable and r.sell_notional == 40.0
    assert (r.sell_base, r.level_notional, r.sell_notional_at_level, r.first_sell_time) == (15.0, 50.0, 20.0, t(61))
    r = of(30.0)
    assert r.exit_vwap == pytest.approx(30 / (10 + 10 / 4)) and (r.quote_reached_time, r.quote_reached_price, r.saleable) == (t(62), 4.0, True)


def test_offset_ratios_need_whole_windows(spark):
    grid = bars(spark, [10.0, 11.0, 12.0])
    r = context.offset_ratios(grid, 2, 2, 2, 2).orderBy(F.desc("open_time")).first()
    assert r.volume_step is None and r.trade_step is None and r.return_step is None and r.taker_step is None


def test_clock_ratio_keeps_zero_days(spark):
    volume = F.when(F.hour("open_time") == 0, F.lit(0.0)).otherwise(F.col("quote_volume"))
    grid = bars(spark, [100.0] * 96).withColumn("quote_volume", volume)
    rows = {r.open_time: (r.clock_days, r.clock_ratio) for r in rolling.whole_clock_ratio(grid, F.col("quote_volume"), 24).collect()}
    assert rows[T0 + timedelta(hours=72)] == (3, None) and rows[T0 + timedelta(hours=73)][0] == 3


def test_matched_volatility_from_three_closes(spark):
    values = [100.0, 101.0, None, 99.0, 102.0, 103.0]
    rows = by_bar(rolling.matched_volatility(bars(spark, values), 5), "volatility", "up_part")
    own = np.diff(np.log([101.0, 99.0, 102.0, 103.0]))
    assert rows[5][0] == pytest.approx(float(np.std(own, ddof=1) * math.sqrt(5) * 100)) and rows[5][1] == pytest.approx(2 / 3)
    assert rows[2] == (None, None) and by_bar(rolling.matched_volatility(bars(spark, values), 4), "volatility")[5] == (None,)
