import hashlib
import itertools
import math
import random
import re
import uuid
from collections import Counter
from datetime import datetime, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from barlab.functions import scalars
from barlab.operators import confirmation, context, execution, inference, packaging, performance, rolling, samples, signals, splits, surge
from barlab.plans import registry as catalog
from barlab.plans import samples_study, signals_study
from barlab.sources import staging
from barlab.sources import trades as src

T0 = datetime(2024, 1, 1)


def hours(spark, lows, highs=None, symbol="A"):
    highs = highs or lows
    rows = [
        (symbol, T0 + timedelta(hours=i), l, h, l, h, 1.0, l, 1, 0.5) for i, (l, h) in enumerate(zip(lows, highs)) if l is not None
    ]
    names = ["symbol", "open_time", "open", "high", "low", "close", "volume", "quote_volume", "trade_count", "taker_buy_quote"]
    return spark.createDataFrame(rows, names)


def tape(spark, rows):
    return spark.createDataFrame(
        [("A", i, T0 + timedelta(seconds=s), p, q, m) for i, (s, p, q, m) in enumerate(rows)],
        ["symbol", "trade_id", "ts", "price", "qty", "is_buyer_maker"],
    )


def test_first_surge_takes_latest_of_equal_lows_and_not_its_own_bar(spark):
    bars = hours(spark, [100.0, 90.0, 90.0, 95.0], [100.0, 200.0, 91.0, 140.0])
    (row,) = surge.first_surges(bars, 8 * 3600, 3600, 1.5).collect()
    assert row.cross_time == T0 + timedelta(hours=1) and row.baseline_low == 100.0
    (row,) = surge.first_surges(hours(spark, [90.0, 90.0, 95.0], [90.0, 91.0, 140.0]), 8 * 3600, 3600, 1.5).collect()
    assert row.baseline_time == T0 + timedelta(hours=1)


def test_crossing_mask_needs_every_bar_before(spark):
    grid = src.dense_grid(hours(spark, [100.0, None, 100.0, 100.0], [100.0, None, 100.0, 200.0]), "2024-01-01 00:00:00", "2024-01-01 04:00:00")
    assert [r.crossing for r in surge.crossing_mask(grid, 4, 1.5).orderBy("open_time").collect()] == [False] * 4
    assert [r.crossing for r in surge.crossing_mask(grid, 2, 1.5).orderBy("open_time").collect()] == [False, False, False, True]


def test_features_do_not_look_ahead(spark):
    lows = [100.0 + (i * 7 % 13) for i in range(60)]
    changed = lows[:40] + [x * 3 for x in lows[40:]]

    def features(values):
        grid = src.dense_grid(hours(spark, values), "2024-01-01 00:00:00", "2024-01-03 12:00:00")
        out = rolling.window_aggregates(grid, [4])
        out = rolling.log_trend(rolling.range_position(rolling.realized_volatility(out, 8), 8), 8, 24)
        out = signals.entry_signals(context.offset_ratios(out, 2, 3, 3, 4), signals_study.RULE | {"deep": 9, "long": 9, "day": 5, "refs": 2, "median": 1, "quote": 1})
        rows = out.where(F.col("open_time") < F.lit("2024-01-02 16:00:00").cast("timestamp")).orderBy("open_time")
        return [r.asDict() for r in rows.collect()]

    assert features(lows) == features(changed)


def test_arming_and_momentum_need_volume_days_and_runup(spark):
    def found(days, volume):
        lows = [100.0] * (24 * days) + [100.0, 100.0, 100.0, 130.0]
        bars = hours(spark, lows).withColumn("quote_volume", F.when(F.col("low") > 100, F.lit(volume)).otherwise(F.lit(100.0)))
        end = (T0 + timedelta(hours=len(lows))).strftime("%Y-%m-%d %H:%M:%S")
        grid = src.dense_grid(bars, "2024-01-01 00:00:00", end)
        armed = signals.armed_recently(grid, 8, 20.75, 4, 24, 2.0, 5, 48).where("armed").count()
        late = signals.late_momentum(grid, 4, 24, {"gain": 500.0, "clock": 2.0, "position": 0.6, "quote": 1.0, "runup": 3.3}, 5, 3, 1)
        return armed, [(r.components, r.late) for r in late.where("low > 100").collect()]

    assert found(6, 900.0) == (1, [(3, True)])  # volume, position and run-up; the return isn't reached
    assert found(6, 100.0) == (0, [(2, False)])
    assert found(4, 900.0) == (0, [(2, False)])  # four days to compare with are too few


def test_volatility_takes_returns_inside_the_window_alone(spark):
    import numpy as np

    rng = random.Random(3)
    closes = [None if rng.random() < 0.2 else 100 + rng.random() * 5 for _ in range(48)]
    grid = src.dense_grid(hours(spark, closes), "2024-01-01 00:00:00", "2024-01-03 00:00:00")
    for r in rolling.realized_volatility(grid, 8).where("hour(open_time) >= 0").collect():
        i = int((r.open_time - T0).total_seconds() // 3600)
        own = [c for c in closes[max(0, i - 7) : i + 1] if c is not None]
        steps = np.diff(np.log(own))
        want = float(np.std(steps, ddof=1) * np.sqrt(8) * 100) if len(own) >= 6 else None
        assert (r.volatility is None) == (want is None) and (want is None or r.volatility == pytest.approx(want, abs=1e-7))
        assert r.up_part == (pytest.approx(float(np.mean(steps > 0))) if len(own) > 1 else None)


def test_continuation_trigger_and_hypotheses_at_their_floors(spark):
    rows = spark.createDataFrame(
        [(0.9, 12.0, 0.74, None, True), (0.9, 12.0, 0.73, 3.3, True), (0.9, 11.9, 0.73, 3.3, True), (0.9, 12.0, 0.74, 3.3, None)],
        "return_short double, clock_ratio double, position double, runup double, liquid boolean",
    )
    assert [(r.late_components, r.trigger) for r in samples.continuation_trigger(rows).collect()] == [(3, True), (3, True), (2, False), (4, False)]
    rows = spark.createDataFrame(
        [(5.0, 5.0, 1.5, 5.0, 5.0, 0.4), (5.1, 5.0, 1.5, 4.9, 5.0, 0.4), (None, 5.0, 1.5, None, 5.0, 0.4), (5.0, 5.0, None, 5.0, None, None)],
        "prior_week double, return_day double, volume_rate double, relative_day double, acceleration double, volatility_ratio double",
    )
    got = [(r.h1, r.h2, r.h3) for r in samples.hypotheses(rows).collect()]
    assert got == [(True, True, True), (False, False, False), (None, None, None), (None, None, None)]


def test_fill_takes_part_of_the_last_trade(spark):
    trades = tape(spark, [(10, 100.0, 1.0, False), (20, 100.0, 9.0, True), (30, 200.0, 5.0, False)])
    orders = spark.createDataFrame([("o", "A", T0, T0 + timedelta(minutes=5))], ["order_id", "symbol", "a", "b"])
    (row,) = execution.fills(orders, trades, True, "a", "b", quote=500.0).collect()
    assert row.complete and row.fill_count == 2 and row.filled_quote == pytest.approx(500) and row.filled_base == pytest.approx(3.0)
    (row,) = execution.fills(orders, trades, True, "a", "b", quote=5000.0).collect()
    assert not row.complete
    with pytest.raises(ValueError):
        execution.fills(orders, trades, True, "a", "b")


def test_greedy_selection_rests_and_caps(spark):
    at = lambda h: T0 + timedelta(hours=h)
    rows = [("B", at(1), 2, 5.0), ("A", at(1), 2, 5.0), ("C", at(1), 3, 1.0), ("A", at(2), 3, 9.0), ("D", at(3), 3, 9.0), ("A", at(26), 2, 1.0)]
    found = signals.select_greedily(spark.createDataFrame(rows, "symbol string, decision_time timestamp, components int, activity double"), 24 * 3600, 3)
    got = [(r.symbol, r.decision) for r in found.orderBy("decision_time", F.desc("components"), F.desc("activity"), "symbol").collect()]
    assert got == [
        ("C", "selected"), ("A", "selected"), ("B", "selected"), ("A", "suppressed_symbol_cooldown"), ("D", "suppressed_daily_cap"), ("A", "selected"),
    ]


def folded(rows, rest, cap, counted, taken):
    """The selection as one fold in order. ``rows``: symbol, time, components, activity, status, exit."""
    rests, day, n, out = {}, None, 0, []
    for symbol, at, components, activity, status, exit_ in sorted(rows, key=lambda r: (r[1], -r[2], -r[3], r[0])):
        if at.date() != day:
            day, n = at.date(), 0
        if symbol in rests and at < rests[symbol]:
            said = "suppressed_symbol_cooldown"
        elif n >= cap:
            said = counted[1]
        else:
            said, n = taken(status), n + counted[0](status)
            rests[symbol] = rest(at, status, exit_)
        out.append((symbol, at, components, activity, said))
    return sorted(out)


@pytest.mark.parametrize("symbols, cap, hours_", [(30, 3, 30), (4, 1, 9), (60, 5, 24), (3, 50, 3)])
def test_selection_in_rounds_equals_the_fold(spark, symbols, cap, hours_):
    """Full days that move rests, and rests that free places, over many days."""
    rng = random.Random(symbols)
    rows = []
    for _ in range(600):
        at = T0 + timedelta(minutes=30 * rng.randrange(48 * 20))
        rows.append((f"S{rng.randrange(symbols)}", at, rng.randrange(3), float(rng.randrange(4)), rng.choice(["completed", "completed", "exit_not_filled"]), at + timedelta(hours=rng.randrange(1, 40))))
    rows = list({r[:4]: r for r in rows}.values())
    frame = spark.createDataFrame(rows, "symbol string, decision_time timestamp, components int, activity double, status string, exit_time timestamp").repartition(4)
    found = signals.select_greedily(frame, hours_ * 3600, cap)
    want = folded(rows, lambda at, *_: at + timedelta(hours=hours_), cap, (lambda _: 1, "suppressed_daily_cap"), lambda _: "selected")
    assert sorted((r.symbol, r.decision_time, r.components, r.activity, r.decision) for r in found.collect()) == want
    found = signals.select_with_feedback(frame, hours_ * 3600, cap)
    rest = lambda at, status, exit_: (exit_ if status == "completed" else at) + timedelta(hours=hours_)
    want = folded(rows, rest, cap, (lambda s: s == "completed", "suppressed_daily_trade_cap"), lambda s: s)
    assert sorted((r.symbol, r.decision_time, r.components, r.activity, r.decision) for r in found.collect()) == want


def test_selections_side_by_side(spark):
    rows = [("x", "A", T0, 1, 1.0), ("y", "A", T0, 1, 1.0), ("y", "B", T0, 1, 2.0)]
    found = signals.select_greedily(spark.createDataFrame(rows, "strategy string, symbol string, decision_time timestamp, components int, activity double"), 3600, 1, ("strategy",))
    assert sorted((r.strategy, r.symbol, r.decision) for r in found.collect()) == [("x", "A", "selected"), ("y", "A", "suppressed_daily_cap"), ("y", "B", "selected")]


def test_stored_tape_stays_where_it_is(spark, tmp_path):
    """No join moves the tape, and a range of time reads its days alone."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        trades = spark.createDataFrame(
            [("AB"[i % 2], i, T0 + timedelta(minutes=40 * i), 10.0 + i % 9, 5.0, i % 3 == 0) for i in range(500)],
            "symbol string, trade_id long, ts timestamp, price double, qty double, is_buyer_maker boolean",
        )
        stored = staging.stored_tape(trades)
        orders = spark.createDataFrame([(f"o{i}", "AB"[i % 2], T0 + timedelta(hours=7 * i), 10.0) for i in range(40)], "order_id string, symbol string, decision_time timestamp, signal_close double")
        run = lambda tape_: execution.simulated(orders, tape_, 100.0, 6 * 3600, 48 * 3600, 12 * 3600, 0.15, 0.001)
        want, got = (sorted(map(tuple, run(t).collect()), key=str) for t in (trades, stored))
        assert got == want and any("completed" in r for r in got)
        joined = surge.near_trades(orders.withColumn("until", F.expr("decision_time + interval 30 hours")), stored, "decision_time", "until", 3600)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        below = plan[plan.index("FileScan") - 400 : plan.index("FileScan")] if "FileScan" in plan else ""
        assert "Bucketed: true" in plan and plan.count("Exchange hashpartitioning") == 1 and "Exchange" not in below.split("SortMergeJoin")[-1].split(":-")[-1].split("+- *")[-1]
        ranged = src.trade_range(stored, "2024-01-03", "2024-01-04")
        assert "PartitionFilters: [isnotnull(day" in ranged._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.trade_id for r in ranged.collect()) == sorted(r.trade_id for r in src.trade_range(trades, "2024-01-03", "2024-01-04").collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_binomial_steps_are_the_exact_distribution():
    for n, p in ((1, 0.5), (7, 1 / 3), (40, 0.9), (200_000, 0.25)):
        low, steps = inference.binomial_steps(n, p)
        for k in {low, low + len(steps) // 3, low + len(steps) // 2}:
            exact = [math.exp(math.lgamma(n + 1) - math.lgamma(j + 1) - math.lgamma(n - j + 1) + j * math.log(p) + (n - j) * math.log1p(-p)) for j in range(low, k + 1)]
            assert steps[k - low] == pytest.approx(sum(exact), abs=1e-9)
        assert steps[-1] == pytest.approx(1)


def test_union_of_windows_reads_each_bar_once(spark):
    grid = src.dense_grid(hours(spark, [float(i + 1) for i in range(96)]), "2024-01-01 00:00:00", "2024-01-05 00:00:00")
    anchors = [("a", 30), ("b", 33), ("c", 33), ("d", 80), ("e", 3), ("f", 96), ("g", 57)]
    own = spark.createDataFrame([(n, "A", T0 + timedelta(hours=h)) for n, h in anchors], "sample_id string, symbol string, anchor timestamp")
    whole = context.whole_windows(own, grid, 24, 3600)
    assert sorted(r.sample_id for r in whole.collect()) == ["a", "b", "c", "d", "f", "g"]
    store = context.shared_store(whole, grid)
    times = [int((r.open_time - T0).total_seconds() // 3600) for r in store.collect()]
    assert sorted(times) == sorted({t for n, h in anchors if n != "e" for t in range(h - 24, h)}) and len(context.covered(whole).collect()) == 2
    found = context.raw_windows(whole, store, 3600)
    assert sorted((r.sample_id, r.relative_bar, r.close) for r in found.collect()) == sorted((n, k, float(h + k + 1)) for n, h in anchors if n != "e" for k in range(-24, 0))


def test_outcomes_of_samples(spark):
    grid = src.dense_grid(hours(spark, [10.0, 11.0, None, 9.0, 14.0, 8.0, 20.0]), "2024-01-01 00:00:00", "2024-01-01 07:00:00")
    at = lambda h: T0 + timedelta(hours=h)
    own = spark.createDataFrame([("s", "A", at(2), at(4)), ("t", "A", at(3), at(1)), ("u", "B", at(2), at(4))], "sample_id string, symbol string, at timestamp, anchor timestamp")
    got = {r.sample_id: r for r in samples.sample_outcomes(own, grid, 3600, 5).collect()}
    s = got["s"]
    assert (s.entry, s.outcome_to_anchor_observed, s.outcome_next_observed) == (11.0, pytest.approx(2 / 3), pytest.approx(4 / 5))
    assert s.outcome_to_anchor_gain == pytest.approx((14 / 11 - 1) * 100) and s.outcome_to_anchor_drawdown == pytest.approx((9 / 11 - 1) * 100)
    assert s.outcome_next_gain == pytest.approx((20 / 11 - 1) * 100) and s.outcome_next_drawdown == pytest.approx((8 / 11 - 1) * 100)
    assert got["t"].outcome_to_anchor_observed == 0 and got["t"].outcome_next_gain is None and got["u"].outcome_next_observed == 0
    own = spark.createDataFrame([("s", "A", at(1), at(4)), ("t", "A", at(4), at(3))], "sample_id string, symbol string, baseline_anchor timestamp, cross_anchor timestamp")
    got = {r.sample_id: r for r in samples.baseline_outcomes(own, grid, 3600, 6).collect()}
    assert got["s"].outcome_to_cross_gain == pytest.approx((14 / 11 - 1) * 100) and got["s"].outcome_next_drawdown == pytest.approx((8 / 11 - 1) * 100)
    assert got["t"].outcome_to_cross_gain is None and got["t"].outcome_next_gain is None and got["t"].outcome_next_observed == 1


def test_performance_without_losses_and_left_out_trades(spark):
    rows = [("s", "A", T0, T0, 1.0, 1.0, "completed"), ("s", "A", T0 + timedelta(1), T0, 2.0, 2.0, "completed"), ("s", "B", T0, None, None, None, "exit_not_filled")]
    stats = performance.performance(
        spark.createDataFrame(rows, "strategy string, symbol string, entry_time timestamp, exit_time timestamp, net_pnl double, net_return double, status string"), ["strategy"]
    ).first()
    assert stats.profit_factor == float("inf") and stats.left_out == 1 and stats.longest_losing_run == 0 and stats.trades == 2


def test_permutations_equal_brute_force(spark):
    groups = {1: [1, 0, 0], 2: [0, 1], 3: [1, 1, 1], 4: [0, 0], 5: [0, 1, 1, 0]}  # the first of each is the event
    rows = [(g * 10 + k, g, int(k == 0), s) for g, own in groups.items() for k, s in enumerate(own)]
    frame = spark.createDataFrame(rows, "id long, match_group long, label int, signal int")
    hits, n, k = sum(map(sum, groups.values())), sum(map(len, groups.values())), len(groups)
    gap = lambda e: e / k - (hits - e) / (n - k)
    classes = Counter((sum(own), len(own)) for own in groups.values())

    def drawn(i, h, size, many):
        """Hits among ``many`` groups with h of size hits each, from the binomial's steps."""
        u = int(hashlib.md5(f"7:{i}:{h}:{size}".encode()).hexdigest()[:8], 16) / 2**32
        chance = [math.comb(many, j) * (h / size) ** j * (1 - h / size) ** (many - j) for j in range(many + 1)]
        return next(j for j in range(many + 1) if u < sum(chance[: j + 1]) or j == many)

    observed = gap(sum(own[0] for own in groups.values()))
    exceed = sum(gap(sum(many if h == size else drawn(i, h, size, many) for (h, size), many in classes.items() if h)) >= observed - 1e-12 for i in range(1, 1202))
    exact = list(itertools.product(*groups.values()))
    share = sum(gap(sum(pick)) >= observed - 1e-12 for pick in exact) / len(exact)
    assert exceed / 1201 == pytest.approx(share, abs=0.05)
    got = inference.permutation_test(frame, 1201, 7).first()
    assert (got.observed, got.exceed, got.iterations) == (pytest.approx(observed), exceed, 1201) and got.p_value == (exceed + 1) / 1202
    same = inference.permutation_test(frame.where("match_group in (3, 4)"), 20, 7).first()
    assert (same.exceed, same.iterations) == (20, 20)
    assert inference.permutation_test(frame.where("id < 0"), 20, 7).count() == 0


def test_a_member_of_every_group_is_drawn_in_every_iteration(spark):
    groups = {1: [1, 0, 0], 2: [0, 1], 3: [1, 1, 1], 4: [0, 0], 5: [0, 1, 1, 0], 6: [1, 0, 0]}  # the first of each is the event
    rows = [(g * 10 + k, g, int(k == 0), s) for g, own in groups.items() for k, s in enumerate(own)]
    frame = spark.createDataFrame(rows[::-1], "id long, match_group long, label int, signal int")
    _equals_member_draws(inference.member_permutation_test(frame, 1201, 7).first(), groups, 1201, 7)
    assert inference.member_permutation_test(frame.where("match_group in (3, 4)"), 20, 7).first().exceed == 20
    assert inference.member_permutation_test(frame.where("id < 0"), 20, 7).count() == 0


def _equals_member_draws(got, groups, iterations, seed):
    """``groups``: by group its signals, the event's first, or the event's and all in the order of ids."""
    groups = {g: own if isinstance(own, tuple) else (own[0], own) for g, own in groups.items()}
    hits, n, k = sum(sum(own) for _, own in groups.values()), sum(len(own) for _, own in groups.values()), len(groups)
    gap = lambda e: e / k - (hits - e) / (n - k)
    member = lambda i, g, own: own[int(hashlib.md5(f"{seed}:{i}:{g}".encode()).hexdigest()[:8], 16) % len(own)]
    observed = gap(sum(event for event, _ in groups.values()))
    exceed = sum(gap(sum(member(i, g, own) for g, (_, own) in groups.items())) >= observed - 1e-12 for i in range(1, iterations + 1))
    assert (got.observed, got.exceed, got.iterations) == (pytest.approx(observed, abs=1e-6), exceed, iterations)
    assert got.p_value == pytest.approx((exceed + 1) / (iterations + 1), abs=1e-6)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_the_permutation_query_draws_from_every_group(spark):
    sf = "/root/testdata/sf0.001"
    groups = {}
    for r in samples_study._population(spark, sf).orderBy("match_group", "id").collect():
        event, own = groups.setdefault(r.match_group, (0, []))
        groups[r.match_group] = (event or int(r.label == 1 and r.signal), own + [int(r.signal)])
    assert groups
    _equals_member_draws(catalog.queries()["o72_permutation"](spark, sf).first(), groups, 50_000, 805601)


@pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="no test tables")
def test_inference_runs_all_iterations_over_completed_trades(spark):
    sf = "/root/testdata/sf0.001"
    assert catalog.queries()["o72_permutation"](spark, sf).first().iterations == 50_000
    got = catalog.queries()["o74_bootstrap"](spark, sf).first()
    done = inference.cluster_bootstrap(signals_study._book(spark, sf).where("status = 'completed'"), 10_000, 20260725).first()
    assert got.iterations == 10_000 and got.low == pytest.approx(done.low, abs=1e-6)


def split_days(counts, discovery=70, validation=15):
    """The rule told day by day."""
    if len(counts) < 3:
        return ["discovery", "validation"][: len(counts)]
    total, so_far, out = sum(counts), 0, []
    for i, n in enumerate(counts):
        left = len(counts) - i
        first = so_far < total * discovery / 100 and left > 2
        out.append("discovery" if first else "validation" if so_far < total * (discovery + validation) / 100 and left > 1 else "sealed_test")
        so_far += n
    if "validation" not in out:
        out[-2] = "validation"
    return out


@pytest.mark.parametrize("counts", [[3], [2, 9], [10, 1, 1], [1, 1, 10], [1] * 30, [i % 5 + 1 for i in range(30)], [9, 1, 1, 1, 1, 1, 1], [90, 1, 1, 1, 1]])
def test_splits_are_chronological(spark, counts):
    days = spark.createDataFrame([(T0.date() + timedelta(d),) for d, n in enumerate(counts) for _ in range(n)], ["event_date"])
    got = [r.split for r in splits.temporal_split(days).orderBy("event_date").collect()]
    assert got == split_days(counts)
    if counts[0] != 90:  # with 90 of 94 events on the first day the repair makes the last date but one validation
        assert got == sorted(got, key=["discovery", "validation", "sealed_test"].index)


def test_controls_count_their_reuse_by_symbol(spark):
    rng = random.Random(5)
    rows = []
    for symbol in "AB":
        for e in range(6):
            for _ in range(25):
                key = T0 + timedelta(days=rng.randrange(5), hours=rng.randrange(3))
                rows.append((symbol, T0 + timedelta(days=20, hours=e), f"{symbol}{e}", key + timedelta(minutes=rng.choice([0, 5])), key, rng.randrange(3), bool(rng.randrange(2)),
                             rng.randrange(4), hashlib.sha256(str(rng.random()).encode()).hexdigest(), "pass" if rng.random() < 0.8 else "near_crossing"))
    names = "symbol string, event_time timestamp, event_id string, at timestamp, key timestamp, tier int, same_weekday boolean, day_distance int, tie string, reason string"
    want, used = [], Counter()
    for symbol, event in sorted({(r[0], r[2]) for r in rows}):
        order = lambda r: (used[symbol, r[4]] > 0, used[symbol, r[4]], r[5], not r[6], r[7], r[8])
        best = {}
        for r in sorted((r for r in rows if r[2] == event and r[9] == "pass"), key=order):
            best.setdefault(r[3].date(), r)
        for rank, r in enumerate(sorted(best.values(), key=order)[:3], 1):
            want.append((event, r[3], r[4], rank, used[symbol, r[4]], "reused" if used[symbol, r[4]] else "pass"))
            used[symbol, r[4]] += 1
    got = samples.select_controls(spark.createDataFrame(rows, names).repartition(5), 3, "reused").collect()
    assert sorted((r.event_id, r.at, r.key, r.control_rank, r.prior_reuse, r.quality_status) for r in got) == sorted(want)
    assert any(w[4] for w in want)
    assert samples.select_controls(spark.createDataFrame([], names), 3).count() == 0


def test_background_samples_take_each_baseline_once(spark):
    times = samples.background_times(spark.createDataFrame([("A",), ("B",)], ["symbol"]), "p", "2024-01-01", "2024-01-05", 3)
    rows = times.orderBy("symbol", "sample_index", "candidate_rank").collect()
    for symbol in "AB":
        for k in range(3):
            seed = int(hashlib.sha256(f"p|{symbol}|{k}".encode()).hexdigest()[:16], 16)
            order = [0]
            for d in range(1, 5):
                order += [-d, d]
            days = list(dict.fromkeys((seed % 5 + d) % 5 for d in order))
            want = [T0 + timedelta(days=d, minutes=(seed // 5) % 1440) for d in days]
            assert [r["at"] for r in rows if r.symbol == symbol and r.sample_index == k] == want
    judged = times.select("symbol", F.date_trunc("hour", "at").alias("bar")).distinct().withColumns({
        "baseline_time": F.date_trunc("day", "bar"), "reason": F.when(F.col("symbol") == "A", "pass").otherwise("insufficient_prior_history"),
    })
    got = samples.background_samples(times, judged, "hour").collect()
    assert len(got) == 3 and len({r.baseline_time for r in got}) == 3 and {r.symbol for r in got} == {"A"}


def test_event_samples_and_issues(spark):
    at = lambda m: T0 + timedelta(minutes=m)
    rows = [("e1", "A", "d", at(7), at(5), at(90), at(88)), ("e2", "A", "d", None, at(5), None, at(500)), ("e3", "A", "d", None, None, None, at(1)), ("e4", "A", "d", None, at(10), at(10), at(12))]
    frame = spark.createDataFrame(rows, "event_id string, symbol string, split string, baseline_trade_time timestamp, baseline_time timestamp, cross_trade_time timestamp, cross_time timestamp")
    good, issues = samples.event_samples(frame, "minute", 480)
    assert [(r.event_id, r.minutes, r.baseline_resolution) for r in good.collect()] == [("e1", 83, "resolved_trade_minute")]
    assert sorted((r.event_id, r.issue) for r in issues.collect()) == [("e2", "duration_outside_window"), ("e3", "no_baseline_time"), ("e4", "duration_outside_window")]
    controls = spark.createDataFrame([("c", "e1", "d", "A", 1, at(1000)), ("x", "gone", "d", "A", 1, at(1000))], "control_id string, event_id string, split string, symbol string, control_rank int, at timestamp")
    made = {r.sample_id: r for r in samples.matched_samples(good, controls, "minute").collect()}
    assert set(made) == {"event:e1", "control:c"} and made["control:c"].baseline_anchor == at(917)


def test_exits_ask_the_stop_first_and_the_ladder_keeps_horizons(spark):
    entries = spark.createDataFrame([("o", "A", T0, 100.0)], "order_id string, symbol string, fill_time timestamp, vwap double")
    trades = tape(spark, [(0, 80.0, 1.0, True), (30, 101.0, 1.0, True), (60, 94.0, 1.0, False), (90, 116.0, 1.0, True), (7200, 160.0, 1.0, True)])
    (row,) = execution.first_exit(entries, trades, 180 * 60, 0.10, 0.05).collect()
    assert (row.exit_reason, row.exit_trigger, row.trigger_price, row.path_mfe) == ("stop", T0 + timedelta(seconds=60), 94.0, pytest.approx(1.0))
    (row,) = execution.first_exit(entries, trades, 180 * 60, 0.15, None).collect()
    assert (row.exit_reason, row.exit_trigger) == ("target", T0 + timedelta(seconds=90))
    (row,) = execution.first_exit(entries, trades, 45, 0.15, 0.05).collect()
    assert (row.exit_reason, row.exit_trigger, row.trigger_price) == ("time", T0 + timedelta(seconds=45), None)
    got = {r.horizon: r for r in execution.path_ladder(entries, trades, (1, 60, 180), (10, 50)).collect()}
    assert got[1].mfe == pytest.approx(1.0) and got[1].mae == pytest.approx(-6.0) and got[1].touch_10 is None
    assert got[60].touch_10 == T0 + timedelta(seconds=90) and got[60].touch_50 is None and got[180].touch_50 == T0 + timedelta(seconds=7200)


def test_simulation_statuses(spark):
    at = lambda s: T0 + timedelta(seconds=s)
    trades = tape(spark, [(10, 100.0, 50.0, False), (40, 120.0, 5.0, True), (50, 118.0, 5.0, True)])
    orders = spark.createDataFrame([("a", "A", at(0), 100.0), ("b", "A", at(20), 100.0), ("c", None, at(0), 1.0)], "order_id string, symbol string, decision_time timestamp, signal_close double")
    got = {r.order_id: r for r in execution.simulated(orders, trades, 500.0, 15, 60, 30, 0.15, 0.001).collect()}
    assert got["a"].status == "completed" and got["a"].exit_vwap == pytest.approx(120.0) and got["a"].fees == pytest.approx(0.5 + 0.6)
    assert got["a"].net_pnl == pytest.approx(600 * 0.999 - 500 * 1.001)
    assert got["b"].status == "entry_not_filled" and got["c"].status == "execution_error"
    got = execution.simulated(orders.limit(1), trades, 4000.0, 15, 60, 30, 0.15, 0.001).first()
    assert got.status == "exit_not_filled" and got.net_pnl is None


def test_feedback_selection_counts_completed_trades(spark):
    at = lambda h: T0 + timedelta(hours=h)
    rows = [
        ("A", at(1), 3, 1.0, "entry_not_filled", None), ("A", at(2), 3, 1.0, "completed", at(3)), ("A", at(5), 3, 1.0, "completed", at(6)), ("B", at(5), 4, 1.0, "completed", at(7)),
        ("C", at(6), 3, 1.0, "completed", at(8)), ("A", at(12), 3, 1.0, "completed", at(13)), ("C", at(30), 3, 1.0, "exit_not_filled", None),
    ]
    frame = spark.createDataFrame(rows, "symbol string, decision_time timestamp, components int, activity double, status string, exit_time timestamp")
    got = [(r.symbol, r.decision) for r in signals.select_with_feedback(frame, 3 * 3600, 2).collect()]
    assert got == [
        ("A", "entry_not_filled"), ("A", "suppressed_symbol_cooldown"), ("B", "completed"), ("A", "completed"), ("C", "suppressed_daily_trade_cap"),
        ("A", "suppressed_daily_trade_cap"), ("C", "exit_not_filled"),
    ]


def test_executions_are_shared_between_strategies(spark):
    chosen = spark.createDataFrame([("e1", "A", T0, "o1"), ("e2", "A", T0, "o1"), ("e2", "B", T0, "o2")], "strategy string, symbol string, decision_time timestamp, order_id string")
    once = signals.executed_once(chosen)
    assert sorted(r.order_id for r in once.collect()) == ["o1", "o2"]
    done = once.where("symbol = 'A'").withColumn("status", F.lit("completed"))
    got = signals.executions_by_strategy(chosen, done).collect()
    assert sorted((r.strategy, r.symbol, r.status) for r in got) == [("e1", "A", "completed"), ("e2", "A", "completed"), ("e2", "B", "execution_missing")]


def test_graduation_without_losses_depends_on_the_protocol(spark):
    measures = dict(
        trades=150, symbols=30, total_pnl=500.0, expectancy=2.0, profit_factor=float("inf"), max_drawdown=10.0, longest_losing_run=0, largest_symbol_share=0.1, fill_rate=0.95,
        least_part_trades=40, least_part_expectancy=1.0, bootstrap_low=0.5, coverage=0.99, failure_fraction=0.0,
    )
    stats = spark.createDataFrame([tuple(measures.values())], list(measures))
    assert len(signals_study.HALVES) == 14 and len(signals_study.THIRDS) == 13
    row = performance.graduation(stats, signals_study.HALVES, 2, infinite_fails=True).first()
    assert (row.passed, row.failed) == (False, "minimum_profit_factor")
    assert performance.graduation(stats, signals_study.THIRDS, 2).first().passed
    row = performance.graduation(stats.withColumn("bootstrap_low", F.lit(None).cast("double")), signals_study.THIRDS, 2).first()
    assert row.failed == "bootstrap_lower_expectancy_above_zero"


def test_acceptance_fails_what_is_missing(spark):
    rows = [(i, i // 3, int(i % 3 == 0), i % 3 == 0, "AB"[i % 2], "discovery") for i in range(90)]
    frame = spark.createDataFrame(rows, "id long, match_group long, label int, signal boolean, symbol string, split string")
    p_value = spark.createDataFrame([(0.01,)], ["p_value"])
    row = confirmation.acceptance(confirmation.split_results(frame), p_value, confirmation.FIRST_FLOORS).first()
    assert not row.passed and set(row.failed.split(",")) == {"symbols_hit", "sealed_test"} and row.rate_ratio_ok  # an infinite ratio passes


def test_ratio_interval_drops_infinite_draws(spark):
    rows = [(s, label, int(s == "B" or label == 1)) for s in "ABCD" for label in (0, 1) for _ in range(3)]
    got = inference.cluster_ratio_interval(spark.createDataFrame(rows, "symbol string, label int, signal int"), 400, 7).first()
    assert got.infinite > 50 and got.finite + got.infinite == 400 and got.low >= 1
    few = inference.cluster_ratio_interval(spark.createDataFrame(rows[:3], "symbol string, label int, signal int"), 400, 7).first()
    assert few.low is None and few.finite == 0


def test_packages(spark, tmp_path):
    sizes = spark.createDataFrame([("c", 5), ("a", 6), ("b", 5), ("d", 50), ("e", 1)], "symbol string, bytes long")
    assert [(r.symbol, r.chunk) for r in packaging.first_fit_chunks(sizes, 11).orderBy("symbol").collect()] == [("a", 0), ("b", 0), ("c", 1), ("d", 2), ("e", 3)]
    rows = spark.createDataFrame([("x", "discovery"), ("y", "sealed_test")], "id string, split string")
    assert sorted((r.id, r.split, r.sealed) for r in packaging.write_by_split(rows, f"{tmp_path}/out").collect()) == [("x", "discovery", False), ("y", "sealed_test", True)]
    assert [tuple(r) for r in packaging.data_dictionary(spark.createDataFrame([], "symbol string, close double, odd int")).collect()] == [
        (0, "symbol", "string", "trading pair"), (1, "close", "double", "last price"), (2, "odd", "int", None),
    ]
    scans = spark.createDataFrame([(480, 480, 480, "2025-01-01", "2025-12-31"), (60, 480, 479, None, "2025-12-31"), (480, 480, 480, "2025-01-01", "2026-02-01"), (None, None, 480, None, None)],
                                  "window_minutes int, guard_before int, guard_after int, start_date string, end_date string")
    scans = scans.withColumns({c: F.col(c).cast("date") for c in ("start_date", "end_date")})
    assert [r.issues for r in packaging.evidence_issues(scans, "2026-01-01").collect()] == [
        [], ["guard_after", "window", "explicit_window"], ["cutoff"], ["guard_before", "window", "explicit_window"]
    ]
    asked = spark.createDataFrame([("2024-01-01", "2024-12-01"), (None, None), ("2024-03-01", None), ("2024-03-02", "2024-03-01")], "start_date string, end_date string")
    asked = asked.withColumns({c: F.col(c).cast("date") for c in ("start_date", "end_date")}).withColumn("lookback", F.lit(10))
    rows = surge.scan_windows(asked, F.lit("2024-11-01").cast("date")).collect()
    assert [r.issues for r in rows] == [["incomplete_day", "length"], [], ["one_bound_missing"], ["order", "length"]]
    assert (str(rows[1].first_day), str(rows[1].last_day), str(rows[1].load_from)) == ("2024-10-22", "2024-10-31", "2024-10-21")
    raw = spark.createDataFrame([("1704067199999",), ("1704067200000",), ("head",)], ["time"])
    assert src.write_before_cutoff(raw, 1704067200000, f"{tmp_path}/cut").count() == 1
    empty = src.write_before_cutoff(raw, 0, f"{tmp_path}/none")
    assert empty.count() == 0 and empty.columns == ["time", "timestamp_ms_normalized"]


def test_names_and_bands(spark):
    names = ["BTCUSDT", "a.b-c", "__x__", "//", "", "é", "A" * 90, "a b"]
    got = {r.n: r.f for r in spark.createDataFrame([(n,) for n in names], ["n"]).select("n", scalars.safe_filename(F.col("n")).alias("f")).collect()}
    for n in names:
        clean = "_".join(p for p in re.split("[^A-Za-z0-9]", n) if p)
        tail = hashlib.sha256(n.encode()).hexdigest()[:12]
        assert got[n] == (clean[:80] if clean and clean == n else f"{clean[:60] or 'symbol'}_{tail}")
    minutes = [None, float("nan"), 0.0, 180.0, 180.2, 360.0, 420.5, 480.0, 480.1, -3.0]
    bands = [r.b for r in spark.createDataFrame([(m,) for m in minutes], "m double").select(scalars.duration_band(F.col("m")).alias("b")).collect()]
    assert bands == ["unknown", "unknown", "le_3h", "le_3h", "gt_3h_to_6h", "gt_3h_to_6h", "gt_7h_to_8h", "gt_7h_to_8h", "outside_8h", "outside_8h"]


def test_uuid5_equals_the_standard_one(spark):
    frame = spark.createDataFrame([("a", 1), ("b", 22)], ["x", "y"])
    for r in frame.select("x", "y", scalars.uuid5(F.col("x"), F.col("y")).alias("u")).collect():
        assert r.u == str(uuid.uuid5(uuid.NAMESPACE_URL, f"{r.x}|{r.y}"))


def test_readers_drop_headers_and_read_both_time_units(spark):
    raw = spark.createDataFrame(
        [("A", "id", "price", "quantity", "time", "maker"), ("A", "1", "2.5", "3", "1704067200000", "True"), ("A", "2", "2.5", "3", "1704067200000000", "0")],
        ["symbol", "id", "price", "quantity", "time", "maker"],
    )
    rows = src.normalised_trades(raw).orderBy("trade_id").collect()
    assert [(r.ts, r.is_buyer_maker) for r in rows] == [(T0, True), (T0, False)]


def test_entry_points_import():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
