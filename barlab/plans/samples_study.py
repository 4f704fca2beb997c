"""Queries over splits, controls, samples, context features, confirmation and packaging, each with the same in SQL where
SQL can say it. Windows count hourly bars."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars
from ..operators import confirmation, context, inference, packaging, samples, splits, surge
from ..sources.staging import staged
from ..sources.staging import checkpoint_root
from .catalog import _B, _BAND, _BY, _ER, _G, _R, _S, _TS, _baselines_sql, bars, event_records, first_surges, grid, query, rounded, tape

HOUR, AWAY = 3600, 6 * 3600

# Splits and groups


_SP = _S + """, sda AS (SELECT event_date, count(*) AS events FROM su GROUP BY 1),
  scu AS (SELECT *, coalesce(sum(events) OVER (ORDER BY event_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(events) OVER () AS t,
    count(*) OVER (ORDER BY event_date ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lf, count(*) OVER () AS n FROM sda),
  sp0 AS (SELECT *, CASE WHEN n < 3 THEN CASE WHEN lf = n THEN 'discovery' ELSE 'validation' END WHEN b < t * 70 / 100.0 AND lf > 2 THEN 'discovery'
    WHEN b < t * 85 / 100.0 AND lf > 1 THEN 'validation' ELSE 'sealed_test' END AS s0 FROM scu),
  sp AS (SELECT event_date, events, CASE WHEN n >= 3 AND lf = 2 AND count(*) FILTER (s0 = 'validation') OVER () = 0 THEN 'validation' ELSE s0 END AS split FROM sp0)"""
_DY = _SP + """, dy AS (
  SELECT day::DATE AS day, CASE WHEN day <= coalesce(d, lo) THEN 'discovery' WHEN day <= coalesce(v, d, lo) THEN 'validation' ELSE 'sealed_test' END AS split
  FROM (SELECT unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS day, lo, d, v FROM (SELECT min(open_time)::DATE::TIMESTAMP AS lo, max(open_time)::DATE::TIMESTAMP AS hi FROM ba),
    (SELECT max(event_date) FILTER (split = 'discovery') AS d, max(event_date) FILTER (split = 'validation') AS v FROM sp)))"""


@query("o30_temporal_split", f"WITH {_SP} SELECT event_date::VARCHAR AS event_date, events, split FROM sp")
def o30(spark, sf):
    return rounded(splits.temporal_split(first_surges(spark, sf)))


@query("o30_split_summary", f"""WITH {_SP} SELECT split, min(event_date)::VARCHAR AS start_date, max(event_date)::VARCHAR AS end_date,
    count(*) AS event_dates, sum(events)::BIGINT AS events
  FROM sp GROUP BY 1""")
def o30_summary(spark, sf):
    return rounded(splits.split_summary(splits.temporal_split(first_surges(spark, sf))))


def _days(spark, sf) -> DataFrame:
    span = bars(spark, sf).agg(F.to_date(F.min("open_time")).alias("a"), F.to_date(F.max("open_time")).alias("b"))
    days = span.select(F.explode(F.expr("sequence(a, b, interval 1 day)")).alias("day"))
    return splits.calendar_splits(days, splits.temporal_split(first_surges(spark, sf)))


@query("o31_calendar_splits", f"WITH {_DY} SELECT day::VARCHAR AS day, split FROM dy")
def o31(spark, sf):
    return rounded(_days(spark, sf))


_OFFSETS = ", ".join(map(str, samples.CLOCK_OFFSETS))
_CC = _DY + f""", ev AS (SELECT symbol || '@' || event_date::VARCHAR AS event_id, su.symbol, cross_time AS event_time, split, minutes_to_cross FROM su
    JOIN sp USING (event_date)),
  c0 AS (SELECT event_id, symbol, event_time, ev.split, o::INT AS off_, day, day + (event_time - date_trunc('day',
    event_time)) + o * INTERVAL 1 MINUTE AS t FROM ev JOIN dy USING (split), unnest([{_OFFSETS}]) AS u(o)),
  cc AS (SELECT event_id, symbol, event_time, c0.split, c0.day, t, off_, isodow(t) = isodow(event_time) AS same_weekday, abs(date_diff('day',
    event_time, t))::INT AS day_distance FROM c0 JOIN dy ON dy.day = t::DATE AND dy.split = c0.split),
  ct AS (SELECT *, (CASE WHEN off_ = 0 THEN CASE WHEN same_weekday THEN 0 ELSE 1 END WHEN abs(off_) <= 15 THEN CASE
    WHEN same_weekday THEN 2 ELSE 3 END WHEN abs(off_) <= 30 THEN 4 ELSE 5 END)::INT AS tier FROM cc)"""


def _events(spark, sf) -> DataFrame:
    split = splits.temporal_split(first_surges(spark, sf)).select("event_date", "split")
    return first_surges(spark, sf).join(split, "event_date").select(
        F.concat_ws("@", "symbol", "event_date").alias("event_id"), "symbol", F.col("cross_time").alias("event_time"), "split", "baseline_time",
        F.col("minutes_to_cross").alias("event_duration"),
    )


def _clock_candidates(spark, sf) -> DataFrame:
    return samples.clock_candidates(_events(spark, sf).drop("baseline_time", "event_duration"), _days(spark, sf))


@query("o32_o35_clock_candidates", f"""WITH {_CC} SELECT event_id, symbol, {_TS.format('t')} AS "at", off_ AS "offset", same_weekday, day_distance,
    tier,
  ['exact_clock_same_weekday', 'exact_clock', 'within_15m_same_weekday', 'within_15m', 'within_30m', 'within_60m'][tier + 1] AS match_tier FROM ct""")
def o32(spark, sf):
    rows = _clock_candidates(spark, sf).withColumn("match_tier", samples.named(F.col("tier"), samples.CLOCK_TIERS))
    return rounded(rows.select("event_id", "symbol", "at", "offset", "same_weekday", "day_distance", "tier", "match_tier"))


@query("o33_known_event_exclusion", f"""WITH {_S} SELECT symbol, {_TS.format('open_time')} AS at FROM ba
  WHERE NOT EXISTS (SELECT 1 FROM su WHERE su.symbol = ba.symbol
    AND abs(epoch_us(ba.open_time) - epoch_us(cross_time)) < {AWAY} * 1000000::BIGINT)""")
def o33(spark, sf):
    at = bars(spark, sf).select("symbol", F.col("open_time").alias("at"))
    return rounded(splits.away_from_events(at, first_surges(spark, sf).withColumnRenamed("cross_time", "event_time"), AWAY))


# Gates and controls


_CR = """crg AS (SELECT *, coalesce(sum(observed::INT) OVER w = 7 AND high >= min(low) OVER w * 1.9, false) AS crossing, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS i,
  count(*) OVER (PARTITION BY symbol) AS n FROM gr WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING))"""
_GATE = f"""{_CR}, ga0 AS (
  SELECT *, sum(observed::INT) OVER lo AS ls, sum(crossing::INT) OVER lo AS lc, sum(observed::INT) OVER ({_BY} ROWS BETWEEN 76 PRECEDING
    AND 5 PRECEDING) / 72.0::DOUBLE AS part,
    {', '.join(f"CASE WHEN count(quote_volume) OVER ({_BY} ROWS BETWEEN {h + 3} PRECEDING AND {h + 1} PRECEDING) = 3 THEN sum(quote_volume) OVER ({_BY} ROWS BETWEEN {h + 3} PRECEDING AND {h + 1} PRECEDING) END AS v{h}" for h in (0, 2, 4))}
  FROM crg WINDOW lo AS ({_BY} ROWS BETWEEN 8 PRECEDING AND 8 FOLLOWING)
), ga AS (
  SELECT symbol, open_time, least(v0, v2, v4) AS least_volume, part,
    CASE WHEN i <= 8 OR i + 8 > n THEN 'outside_loaded_range' WHEN ls < 17 THEN 'missing_local_bars' WHEN lc > 0 THEN 'near_crossing'
    WHEN i <= 76 OR part < 0.9 THEN 'insufficient_prior_history'
         WHEN v0 IS NULL OR v2 IS NULL OR v4 IS NULL THEN 'missing_entry_liquidity' WHEN least(v0, v2,
    v4) < 25000 THEN 'below_entry_liquidity_floor' ELSE 'pass' END AS reason FROM ga0)"""


def _gate(spark, sf) -> DataFrame:
    crossed = surge.crossing_mask(grid(spark, sf), 8, 1.9)
    return samples.quality_gate(crossed, "crossing", (0, 2, 4), history=72, before=8, after=8, volume_bars=3, volume=25000.0, part=0.9)


@query("o34_quality_gate", f"WITH {_G}, {_GATE} SELECT symbol, {_TS.format('open_time')} AS open_time, reason FROM ga")
def o34(spark, sf):
    return rounded(_gate(spark, sf).select("symbol", "open_time", "reason"))


def _judged(spark, sf) -> DataFrame:
    known = _events(spark, sf).select("symbol", "event_time")
    return samples.judged_clock_controls(_clock_candidates(spark, sf), known, _gate(spark, sf), "hour", AWAY)


@query("o34_o41_rejections", f"""WITH {_CC}, gr AS {_G.split(', gr AS', 1)[1]}, {_GATE}, ju AS (
    SELECT CASE WHEN EXISTS (SELECT 1 FROM su WHERE su.symbol = ct.symbol
    AND abs(epoch_us(t) - epoch_us(cross_time)) < {AWAY} * 1000000::BIGINT) THEN 'within_known_event'
                ELSE coalesce(reason, 'outside_loaded_range') END AS reason
    FROM ct LEFT JOIN ga ON ga.symbol = ct.symbol AND ga.open_time = date_trunc('hour', t))
  SELECT reason, count(*) AS n FROM ju GROUP BY 1""")
def o41(spark, sf):
    return context.value_counts(_judged(spark, sf), "reason")


@query("o36_controls")
def o36(spark, sf):
    found = samples.control_ids(samples.select_controls(_judged(spark, sf), 3), "matched-control", "at")
    return rounded(found.withColumn("match_tier", samples.named(F.col("tier"), samples.CLOCK_TIERS)))


@query("o39_baseline_gate", f"""WITH {_G}, b0 AS (SELECT *, count(*) OVER w AS there, coalesce(sum(observed::INT) OVER w, 0) / 72.0::DOUBLE AS part,
    CASE WHEN count(quote_volume) OVER v = 3 THEN sum(quote_volume) OVER v END AS vol FROM gr
    WINDOW w AS ({_BY} ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING), v AS ({_BY} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING))
  SELECT symbol, {_TS.format('open_time')} AS open_time, round(part, 6) AS observed_fraction, round(vol, 4) AS volume_before,
    CASE WHEN there < 72 OR part < 0.95 THEN 'insufficient_prior_history' WHEN vol IS NULL THEN 'missing_entry_liquidity'
    WHEN vol < 25000 THEN 'below_entry_liquidity_floor' ELSE 'pass' END AS reason FROM b0""")
def o39(spark, sf):
    out = samples.baseline_gate(grid(spark, sf), 72, 3, 25000.0, part=0.95)
    return rounded(out.withColumn("volume_before", F.round("volume_before", 4)))


_LOW = ", ".join(map(str, samples.LOW_OFFSETS))
_KNOWN = "EXISTS (SELECT 1 FROM kn WHERE kn.symbol = {0}.symbol AND abs(epoch_us({1}) - epoch_us(kn.t)) < 7200 * 1000000::BIGINT)"
_LL = _CC.replace(_OFFSETS, _LOW) + f""", gr AS {_G.split(', gr AS', 1)[1]}, {_baselines_sql(1.6)}, kn AS (SELECT symbol, cross_time AS t FROM su
    UNION ALL SELECT symbol, baseline_time FROM su),
  lg AS (SELECT *, count(*) OVER w AS there, coalesce(sum(observed::INT) OVER w, 0) / 72.0::DOUBLE AS part, CASE
    WHEN count(quote_volume) OVER v = 3 THEN sum(quote_volume) OVER v END AS vol FROM gr
    WINDOW w AS ({_BY} ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING), v AS ({_BY} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING)),
  lb AS (SELECT cc.*, baseline_time, duration * 60 AS minutes, contaminated, (SELECT minutes_to_cross FROM ev
    WHERE ev.event_id = cc.event_id) AS event_minutes
    FROM cc LEFT JOIN ab ON ab.symbol = cc.symbol AND ab.open_time = date_trunc('hour', t)),
  lj AS (SELECT lb.*, abs(minutes - event_minutes) AS differ, CASE WHEN {_KNOWN.format('lb', 'lb.t')} THEN 'within_known_event'
    WHEN baseline_time IS NULL THEN 'incomplete_algorithm_window'
      WHEN contaminated THEN 'future_contamination' WHEN {_BAND.format('minutes')} <> {_BAND.format('event_minutes')} THEN 'duration_band_mismatch'
      WHEN {_KNOWN.format('lb', 'baseline_time')} THEN 'baseline_within_known_event' WHEN there < 72 OR part < 0.9 THEN 'insufficient_prior_history'
    WHEN vol IS NULL THEN 'missing_entry_liquidity'
      WHEN vol < 3000 THEN 'below_entry_liquidity_floor' ELSE 'pass' END AS reason
    FROM lb LEFT JOIN lg ON lg.symbol = lb.symbol AND lg.open_time = baseline_time),
  lt AS (SELECT *, (CASE WHEN off_ = 0 AND differ <= 30 THEN 0 WHEN off_ = 0 THEN 1 WHEN abs(off_) <= 60 AND differ <= 30 THEN 2
    WHEN abs(off_) <= 60 THEN 3 ELSE 4 END)::INT AS tier FROM lj)"""


def _low_judged(spark, sf) -> DataFrame:
    events = _events(spark, sf)
    found = samples.clock_candidates(events.drop("baseline_time", "event_duration"), _days(spark, sf), samples.LOW_OFFSETS)
    found = found.join(events.select("event_id", "event_duration"), "event_id")
    known = events.select("symbol", "event_time").unionByName(events.select("symbol", F.col("baseline_time").alias("event_time")))
    baselines = surge.algorithmic_baseline(grid(spark, sf), 8, 1.6)
    return samples.judged_low_controls(found, known, baselines, samples.baseline_gate(grid(spark, sf), 72, 3, 3000.0, part=0.9), 2 * HOUR, 60, "hour")


@query("o37_judged_low_controls", f"""WITH {_LL} SELECT event_id, {_TS.format('t')} AS at, off_ AS "offset", reason,
    {_TS.format('baseline_time')} AS baseline_time, minutes::BIGINT AS duration,
  round(differ, 6) AS duration_difference, CASE WHEN baseline_time IS NOT NULL THEN tier END AS tier FROM lt""")
def o37_judged(spark, sf):
    rows = _low_judged(spark, sf).withColumn("tier", F.when(F.col("baseline_time").isNotNull(), F.col("tier")))
    return rounded(rows.select("event_id", "at", "offset", "reason", "baseline_time", F.col("duration").cast("long").alias("duration"), "duration_difference", "tier"))


@query("o37_local_low_controls")
def o37(spark, sf):
    chosen = samples.select_controls(_low_judged(spark, sf), 3, "reused_control_baseline").withColumnRenamed("key", "baseline_time")
    return rounded(samples.control_ids(chosen, "local-low-control", "at", "baseline_time").withColumn("match_tier", samples.named(F.col("tier"), samples.LOW_TIERS)))


@query("o40_background_times", f"""WITH {_B}, sy AS (SELECT DISTINCT symbol FROM ba), se AS (
    SELECT symbol, i, ('0x' || substr(sha256('background|' || symbol || '|' || i), 1, 16))::UBIGINT::HUGEINT AS seed, 20 AS span FROM sy, range(0,
    3) AS r(i)),
  st AS (SELECT *, s, CASE WHEN s % 2 = 1 THEN -((s + 1) // 2) ELSE s // 2 END AS delta FROM se, range(0, 20) AS r(s))
  SELECT symbol, i::INT AS sample_index, (s + 1)::INT AS candidate_rank,
    {_TS.format("DATE '2024-01-08' + (((seed % span + delta) % span + span) % span)::INT * INTERVAL 1 DAY + ((seed // span) % 1440)::INT * INTERVAL 1 MINUTE")} AS "at" FROM st""")
def o40(spark, sf):
    return rounded(samples.background_times(bars(spark, sf), "background", "2024-01-08", "2024-01-27", 3))


@query("o40_background_samples")
def o40_samples(spark, sf):
    times = samples.background_times(bars(spark, sf), "background", "2024-01-08", "2024-01-27", 3)
    gate = samples.baseline_gate(grid(spark, sf), 72, 3, None, part=0.9).select("symbol", F.col("open_time").alias("baseline_time"), "reason")
    found = surge.algorithmic_baseline(grid(spark, sf), 8, 1.6).where("not contaminated").select("symbol", F.col("open_time").alias("bar"), "baseline_time")
    return rounded(samples.background_samples(times, found.join(gate, ["symbol", "baseline_time"]), "hour"))


@query("o43_valid_groups", """WITH s AS (SELECT l.doc_id, l.doc_id // 4 AS g, l.quality FROM labels l) SELECT doc_id, g::BIGINT AS match_group, quality::BIGINT AS label FROM s
  WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) FILTER (quality = 1) = 1 AND count(*) FILTER (quality = 0) >= 1)""")
def o43(spark, sf):
    rows = spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", F.floor(F.col("doc_id") / 4).alias("match_group"), F.col("quality").cast("long").alias("label"))
    return splits.valid_groups(rows, "match_group", "label")


# Samples and audits


_MS = _R + """, e0 AS (
  SELECT symbol || '@' || event_date::VARCHAR AS event_id, symbol, event_date, date_trunc('hour', coalesce(baseline_trade_time, baseline_time)) AS baseline_anchor,
    date_trunc('hour', coalesce(cross_trade_time, cross_time)) AS cross_anchor,
    CASE WHEN baseline_trade_time IS NOT NULL THEN 'resolved_trade_minute' ELSE 'scanner_minute_fallback' END AS baseline_resolution FROM re
), e1 AS (SELECT *, (epoch(cross_anchor) - epoch(baseline_anchor))::BIGINT // 60 AS minutes FROM e0
), ms AS (
  SELECT 'event:' || event_id AS sample_id, event_id AS match_group, symbol, 1 AS label, baseline_anchor, cross_anchor, baseline_resolution, minutes FROM e1 WHERE minutes BETWEEN 1 AND 480
  UNION ALL
  SELECT 'control:' || event_id || '@' || k, event_id, symbol, 0, cross_anchor + k * INTERVAL 1 DAY - minutes * INTERVAL 1 MINUTE, cross_anchor + k * INTERVAL 1 DAY, 'pseudo_baseline_same_event_duration', minutes
  FROM e1, unnest([1, 2]) AS u(k) WHERE minutes BETWEEN 1 AND 480)"""


def _matched(spark, sf) -> DataFrame:
    """Events with their crossings one and two days on as controls."""
    resolved = surge.resolved_trades(first_surges(spark, sf), tape(spark, sf), "1 hour", 1.25)
    named = resolved.select(
        F.concat_ws("@", "symbol", "event_date").alias("event_id"), "symbol", F.lit("discovery").alias("split"), "baseline_trade_time", "baseline_time", "cross_trade_time", "cross_time",
    )
    events = staged(samples.event_samples(named, "hour", 480)[0], "events")
    controls = events.select("event_id", "symbol", "split", "cross_anchor", F.explode(F.array(F.lit(1), F.lit(2))).alias("control_rank"))
    controls = controls.withColumns({
        "control_id": F.concat_ws("@", "event_id", F.col("control_rank").cast("string")), "at": F.expr("cross_anchor + make_dt_interval(control_rank)"),
    }).drop("cross_anchor")
    return staged(samples.matched_samples(events, controls, "hour"), "samples")


@query("o42_o79_samples", f"""WITH {_MS} SELECT sample_id, match_group, symbol, label, {_TS.format('baseline_anchor')} AS baseline_anchor,
    {_TS.format('cross_anchor')} AS cross_anchor,
  baseline_resolution, minutes FROM ms""")
def o42(spark, sf):
    out = _matched(spark, sf).select("sample_id", "match_group", "symbol", "label", "baseline_anchor", "cross_anchor", "baseline_resolution", "minutes")
    return rounded(out)


_AU = _MS + f""", gr AS {_G.split(', gr AS', 1)[1]}, a0 AS (
  SELECT sample_id, open_time, observed, high, low, lag(low) OVER (PARTITION BY sample_id ORDER BY open_time) AS pl,
    min(low) OVER (PARTITION BY sample_id ORDER BY open_time ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ml
  FROM ms JOIN gr ON gr.symbol = ms.symbol AND open_time BETWEEN baseline_anchor AND cross_anchor
), a1 AS (SELECT sample_id, avg(observed::INT) AS part, max(CASE WHEN pl IS NOT NULL AND ml > 0 THEN (high / ml - 1) * 100 END) AS gain FROM a0
    GROUP BY 1
), au AS (
  SELECT ms.*, coalesce(part, 0) AS part, gain AS largest_gain, CASE WHEN part IS NOT NULL THEN coalesce(gain >= 25, false) END AS crossed,
    label = 0 AND coalesce(coalesce(gain >= 25, false) OR part < 0.99, true) AS contaminated FROM ms LEFT JOIN a1 USING (sample_id))"""


@query("o69_window_audit", f"""WITH {_AU} SELECT sample_id, round(part, 6) AS part, round(largest_gain, 6) AS largest_gain, crossed, contaminated
    FROM au""")
def o69(spark, sf):
    return rounded(samples.window_audit(_matched(spark, sf), grid(spark, sf), HOUR, 25.0).select("sample_id", "part", "largest_gain", "crossed", "contaminated"))


# Context features


def _samples(spark, sf) -> DataFrame:
    return first_surges(spark, sf).select(F.concat_ws("@", "symbol", "event_date").alias("sample_id"), "symbol", F.col("cross_time").alias("anchor"))


_SA = _S + ", sa AS (SELECT symbol || '@' || event_date::VARCHAR AS sample_id, symbol, cross_time AS anchor FROM su)"
_WI = _SA + ", wi AS (SELECT sample_id, ba.* FROM sa JOIN ba ON ba.symbol = sa.symbol AND open_time > anchor - INTERVAL 241 HOUR AND open_time <= anchor - INTERVAL 1 HOUR)"


def _windows(spark, sf) -> DataFrame:
    ends = _samples(spark, sf).select("sample_id", "symbol", F.expr("anchor - interval 1 hour").alias("at"))
    return context.sample_windows(ends, grid(spark, sf), 240, HOUR)


def _trend_sql(name: str, value: str) -> str:
    whole = f"n >= 6 AND count(*) FILTER ({value} > 0) OVER p = n"
    return (
        f"""CASE WHEN {whole} THEN round((exp(regr_slope(CASE WHEN {value} > 0 THEN ln({value}) END, -k::DOUBLE) OVER p) - 1) * 100,
    4) END AS {name}_trend, """
        f"""CASE WHEN {whole} AND var_pop(CASE WHEN {value} > 0 THEN ln({value}) END) OVER p > 0 THEN round(regr_r2(CASE
    WHEN {value} > 0 THEN ln({value}) END, -k::DOUBLE) OVER p, 4) END AS {name}_r2"""
    )


@query("o51_daily_context", f"""WITH {_WI}, da AS (
    SELECT sample_id, open_time::DATE AS day, first(open ORDER BY open_time) AS open, max(high) AS high, min(low) AS low, last(close
    ORDER BY open_time) AS close, sum(quote_volume) AS q,
      sum(taker_buy_quote) AS tk, count(*) AS bars FROM wi GROUP BY 1, 2),
  dk AS (SELECT *, row_number() OVER (PARTITION BY sample_id ORDER BY day DESC) AS k FROM da QUALIFY k <= 11),
  dn AS (SELECT *, count(*) OVER (PARTITION BY sample_id) AS n, greatest((high / low - 1) * 100, 1e-9) + 1 AS rg FROM dk)
  SELECT DISTINCT sample_id, n AS days, count(*) FILTER (bars >= 23) OVER p AS complete_days, CASE
    WHEN n >= 3 THEN round(avg((close > open)::INT) OVER p, 4) END AS up_part,
    CASE WHEN n >= 3 THEN round(quantile_cont(tk / nullif(q, 0), 0.5) OVER p, 4) END AS taker_median,
    {_trend_sql('volume', 'q')}, {_trend_sql('close', 'close')}, {_trend_sql('range', 'rg')} FROM dn WINDOW p AS (PARTITION BY sample_id)""")
def o51(spark, sf):
    return rounded(context.daily_trends(_windows(spark, sf), 23), 4)


@query("o52_episodes", f"""WITH {_WI}, mv AS (SELECT sample_id, (close / lag(close) OVER (PARTITION BY sample_id ORDER BY open_time) - 1) * 100 AS m
    FROM wi),
  m1 AS (SELECT sample_id, count(*) FILTER (m >= 2) AS up_2, count(*) FILTER (m >= 5) AS up_5, count(*) FILTER (m <= -2) AS down_2 FROM mv
    GROUP BY 1),
  h0 AS (SELECT sample_id, open_time, high, close, quote_volume AS q, count(high) OVER b AS c, max(high) OVER b AS best,
    min(close) OVER (PARTITION BY sample_id ORDER BY open_time RANGE BETWEEN CURRENT ROW AND INTERVAL 6 HOUR FOLLOWING) AS low6
    FROM wi WINDOW b AS (PARTITION BY sample_id ORDER BY open_time ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING)),
  h1 AS (SELECT *, coalesce(c >= 18 AND high >= best * 1.005, false) AS broke FROM h0), h2 AS (SELECT *, broke AND NOT lag(broke, 1,
    false) OVER (PARTITION BY sample_id ORDER BY open_time) AS edge FROM h1),
  md AS (SELECT sample_id, quantile_cont(q, 0.5) AS med FROM h2 GROUP BY 1)
  SELECT sample_id, any_value(up_2) AS up_2, any_value(up_5) AS up_5, any_value(down_2) AS down_2, CASE
    WHEN max(med) > 0 THEN count(*) FILTER (q >= 3 * med) END AS volume_spikes,
    round(max(q) / nullif(max(med), 0), 4) AS largest_volume, count(*) FILTER (edge) AS breakouts, count(*) FILTER (edge
    AND low6 <= high * 0.98) AS failed_breakouts
  FROM h2 JOIN md USING (sample_id) JOIN m1 USING (sample_id) GROUP BY 1""")
def o52(spark, sf):
    return rounded(context.episodes(_windows(spark, sf)), 4)


_REFS, _REF_WINDOWS = ("click", "view"), (4, 24)


@query("o55_reference_context", f"""WITH {_G}, ow AS (SELECT symbol, open_time,
    {', '.join(f'(close / lag(close, {w}) OVER ({_BY}) - 1) * 100 AS own_{w}' for w in _REF_WINDOWS)} FROM gr),
  px AS (SELECT open_time, {', '.join(f"max(own_{w}) FILTER (symbol = '{r}') AS {r}_{w}" for r in _REFS for w in _REF_WINDOWS)},
    {', '.join(f"avg(own_{w}) FILTER (symbol IN ('click', 'view')) AS proxy_{w}" for w in _REF_WINDOWS)} FROM ow GROUP BY 1)
  SELECT symbol, {_TS.format('open_time')} AS open_time, {', '.join(f'round(own_{w}, 4) AS own_{w}' for w in _REF_WINDOWS)},
    {', '.join(f'round({r}_{w}, 4) AS {r}_{w}, round(own_{w} - {r}_{w}, 4) AS own_minus_{r}_{w}' for r in (*_REFS, 'proxy') for w in _REF_WINDOWS)}
  FROM ow LEFT JOIN px USING (open_time)""")
def o55(spark, sf):
    return rounded(context.reference_context(grid(spark, sf), list(_REFS), list(_REF_WINDOWS)), 4)


def _full(column: str, w: int, skip: int = 0) -> str:
    f = f"({_BY} ROWS BETWEEN {skip + w - 1} PRECEDING AND {f'{skip} PRECEDING' if skip else 'CURRENT ROW'})"
    return f"CASE WHEN count({column}) OVER {f} = {w} THEN sum({column}) OVER {f} END"


_LONG = f"({_BY} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"


@query("o56_offset_ratios", f"""WITH {_G}, s AS (
    SELECT *, {_full('quote_volume', 3)} AS q1, {_full('quote_volume', 8, 3)} AS q2, {_full('trade_count', 3)} AS t1,
    {_full('trade_count', 8, 3)} AS t2, {_full('quote_volume', 5)} AS l1,
           {_full('quote_volume', 12, 5)} AS l2, {_full('quote_volume', 5, 5)} AS p, {_full('taker_buy_quote', 5, 5)} AS k,
    sum(taker_buy_quote) OVER {_LONG} / nullif(sum(quote_volume) OVER {_LONG}, 0) AS tn,
           lag(close, 5) OVER ({_BY}) AS c5, lag(close, 10) OVER ({_BY}) AS c10 FROM gr)
  SELECT symbol, {_TS.format('open_time')} AS open_time, round(q1 / 3 / nullif(q2 / 8, 0), 4) AS volume_step, round(t1 / 3.0 / nullif(t2 / 8.0, 0),
    4) AS trade_step,
         round(l1 / 5 / nullif(l2 / 12, 0), 4) AS long_volume_step, round((close / c5 - 1) * 100 - (c5 / c10 - 1) * 100, 4) AS return_step,
    round(tn - k / nullif(p, 0), 4) AS taker_step FROM s""")
def o56(spark, sf):
    return rounded(context.offset_ratios(grid(spark, sf), 3, 8, 5, 12).select("symbol", "open_time", "volume_step", "trade_step", "long_volume_step", "return_step", "taker_step"), 4)


_DAYS_ = (24, 72, 168, 240)


def _window_columns(w: int) -> str:
    f = f"OVER ({_BY} ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)"
    return (
        f"""(close / lag(close, {w}) OVER ({_BY}) - 1) * 100 AS return_{w}, (max(high) {f} / min(low) {f} - 1) * 100 AS range_{w},
    sum(quote_volume) {f} AS quote_{w}, """
        f"sum(trade_count)::DOUBLE {f} AS trades_{w}, list(close) FILTER (close IS NOT NULL) {f} AS c_{w}"
    )


_CF = f"""w0 AS (SELECT symbol, open_time, close, {', '.join(map(_window_columns, _DAYS_)).replace('sum(trade_count)::DOUBLE', 'sum(trade_count::DOUBLE)')},
    CASE WHEN count(quote_volume) OVER ({_BY} ROWS BETWEEN 2 PRECEDING
    AND CURRENT ROW) = 3 THEN sum(quote_volume) OVER ({_BY} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS volume_now,
    sum(observed::INT) OVER ({_BY} ROWS BETWEEN 239 PRECEDING AND CURRENT ROW) / 240.0::DOUBLE AS observed_part FROM gr),
  w1 AS (SELECT * EXCLUDE ({', '.join(f'c_{w}' for w in _DAYS_)}),
    {', '.join(f"CASE WHEN len(c_{w}) >= {max(5, int(0.8 * w))} THEN list_aggregate(list_transform(range(2, len(c_{w}) + 1), lambda k: ln(c_{w}[k]) - ln(c_{w}[k - 1])), 'stddev_samp') * sqrt({float(w)}) * 100 END AS volatility_{w}" for w in _DAYS_)} FROM w0),
  rp AS (SELECT open_time, avg(return_24) FILTER (symbol IN ('click', 'view')) AS proxy FROM w1 GROUP BY 1),
  cf AS (SELECT w1.*, volatility_24 / nullif(volatility_168, 0) AS volatility_ratio, return_24 - (return_72 - return_24) / 2 AS acceleration,
    ((1 + return_168 / 100) / (1 + return_24 / 100) - 1) * 100 AS prior_week,
    CASE WHEN quote_72 - quote_24 > 0 THEN quote_24 / ((quote_72 - quote_24) / 2) END AS volume_rate, CASE
    WHEN trades_72 - trades_24 > 0 THEN trades_24 / ((trades_72 - trades_24) / 2) END AS trade_rate,
    return_24 - proxy AS relative_day, coalesce(volume_now >= 2000, false) AS liquid,
    CASE WHEN close IS NULL THEN 'missing_decision_bar' WHEN observed_part >= 0.9 AND coalesce(volume_now >= 2000, false) THEN 'pass'
    WHEN observed_part >= 0.8 THEN 'warning' ELSE 'insufficient_history' END AS quality
    FROM w1 LEFT JOIN rp USING (open_time))"""


def _features(spark, sf, references=_REFS) -> DataFrame:
    return context.context_features(grid(spark, sf), 24, 240, 3, 2000.0, list(references), (0.9, 0.8))


@query("o54_o59_context_features", f"""WITH {_G}, {_CF} SELECT symbol, {_TS.format('open_time')} AS open_time, quality, liquid,
    round(quote_24 / nullif(quote_72, 0), 4) AS volume_share_1_of_3, round(quote_24 / nullif(quote_168, 0), 4) AS volume_share_1_of_7,
  round(quote_72 / nullif(quote_240, 0), 4) AS volume_share_3_of_10, round(volatility_ratio, 4) AS volatility_ratio,
    round(volatility_72 / nullif(volatility_240, 0), 4) AS volatility_3_to_10, round(range_24 / nullif(range_168, 0), 4) AS range_1_to_7,
  round((quote_24 / nullif(trades_24, 0)) / nullif(quote_168 / nullif(trades_168, 0), 0), 4) AS trade_size_1_to_7, round(acceleration,
    4) AS acceleration,
  round(return_72 / 3 - (return_240 - return_72) / 7, 4) AS acceleration_3_of_10, round(return_72 / 3 - return_240 / 10, 4) AS strength_3_of_10,
    round(relative_day, 4) AS relative_day FROM cf""")
def o54(spark, sf):
    names = ("volume_share_1_of_3", "volume_share_1_of_7", "volume_share_3_of_10", "volatility_ratio", "volatility_3_to_10", "range_1_to_7", "trade_size_1_to_7", "acceleration", "acceleration_3_of_10", "strength_3_of_10", "relative_day")
    return rounded(_features(spark, sf).select("symbol", "open_time", "quality", "liquid", *names), 4)


_H = """CASE WHEN prior_week IS NOT NULL AND return_24 IS NOT NULL AND volume_rate IS NOT NULL THEN prior_week <= 5 AND return_24 >= 5 AND volume_rate >= 1.5 END AS h1,
  CASE WHEN relative_day IS NOT NULL AND acceleration IS NOT NULL THEN relative_day >= 5 AND acceleration >= 5 END AS h2, CASE WHEN volatility_ratio IS NOT NULL AND prior_week IS NOT NULL THEN volatility_ratio >= 0.4 AND prior_week <= 5 END AS h3"""


@query("o60_o67_hypotheses", f"""WITH {_G}, {_CF} SELECT symbol, {_TS.format('open_time')} AS open_time, round(prior_week, 4) AS prior_week,
    round(volume_rate, 4) AS volume_rate, round(trade_rate, 4) AS trade_rate, {_H} FROM cf""")
def o60(spark, sf):
    return rounded(samples.hypotheses(_features(spark, sf)).select("symbol", "open_time", "prior_week", "volume_rate", "trade_rate", "h1", "h2", "h3"), 4)


_BR = f"""{_AU}, {_CF}, br AS (
  SELECT sample_id, match_group, au.symbol, label, o AS off_, contaminated, CASE WHEN contaminated THEN 'contaminated_control' ELSE coalesce(quality,
    'missing_decision_bar') END AS quality, coalesce(liquid, false) AS liquid, {_H}
  FROM au CROSS JOIN unnest([0, 1, 24, 72]) AS u(o) LEFT JOIN cf ON cf.symbol = au.symbol
    AND cf.open_time = baseline_anchor - (o + 1) * INTERVAL 1 HOUR)"""


def _baseline_rows(spark, sf, references=_REFS) -> DataFrame:
    own = _matched(spark, sf)
    audit = samples.window_audit(own, grid(spark, sf), HOUR, 25.0)
    return context.baseline_rows(own, _features(spark, sf, references), audit, [0, 1, 24, 72], HOUR)


@query("o107_baseline_rows", f"""WITH {_BR} SELECT sample_id, label, off_::INT AS \"offset\", CASE
    WHEN off_ = 0 THEN 'baseline_start' ELSE 'pre_baseline' END AS stage, quality, contaminated, h1, h2, h3 FROM br""")
def o107(spark, sf):
    return _baseline_rows(spark, sf).select("sample_id", "label", "offset", "stage", "quality", "contaminated", "h1", "h2", "h3")


_OUT = f"""{_MS}, gr AS {_G.split(', gr AS', 1)[1]}, bo AS (SELECT ms.sample_id, ms.symbol, baseline_anchor, cross_anchor, low AS bl, close AS bc
    FROM ms LEFT JOIN gr ON gr.symbol = ms.symbol AND open_time = baseline_anchor),
  oc AS (SELECT sample_id, max(high) AS h, min(low) AS l, avg(observed::INT) AS o FROM ms JOIN gr ON gr.symbol = ms.symbol
    AND open_time BETWEEN baseline_anchor AND cross_anchor GROUP BY 1),
  ox AS (SELECT sample_id, max(high) AS h, min(low) AS l, avg(observed::INT) AS o FROM ms JOIN gr ON gr.symbol = ms.symbol
    AND open_time BETWEEN baseline_anchor AND baseline_anchor + INTERVAL 19 HOUR GROUP BY 1),
  oe AS (SELECT sample_id, close AS entry FROM ms JOIN gr ON gr.symbol = ms.symbol AND open_time = baseline_anchor - INTERVAL 1 HOUR)"""
_BASE = "CASE WHEN bl > 0 THEN bl ELSE bc END"


@query("o107_outcomes", f"""WITH {_OUT} SELECT bo.sample_id, round(oc.h, 6) AS to_cross_high,
    {', '.join(f"round(({a}.h / {_BASE} - 1) * 100, 4) AS outcome_{n}_gain, round(({a}.l / bc - 1) * 100, 4) AS outcome_{n}_drawdown, round(coalesce({a}.o, 0), 4) AS outcome_{n}_observed" for a, n in (('oc', 'to_cross'), ('ox', 'next')))}
  FROM bo LEFT JOIN oc USING (sample_id) LEFT JOIN ox USING (sample_id)""")
def o107_outcomes(spark, sf):
    found = samples.baseline_outcomes(_matched(spark, sf), grid(spark, sf), HOUR, 20).withColumn("to_cross_high", F.round("to_cross_high", 6))
    return rounded(found, 4)


@query("o58_sample_outcomes", f"""WITH {_OUT} SELECT bo.sample_id, round(entry, 4) AS entry,
    {', '.join(f"round(({a}.h / entry - 1) * 100, 4) AS outcome_{n}_gain, round(({a}.l / entry - 1) * 100, 4) AS outcome_{n}_drawdown, round(coalesce({a}.o, 0), 4) AS outcome_{n}_observed" for a, n in (('oc', 'to_anchor'), ('ox', 'next')))}
  FROM bo LEFT JOIN oe USING (sample_id) LEFT JOIN oc USING (sample_id) LEFT JOIN ox USING (sample_id)""")
def o58_samples(spark, sf):
    own = _matched(spark, sf).select("sample_id", "symbol", F.col("baseline_anchor").alias("at"), F.col("cross_anchor").alias("anchor"))
    return rounded(samples.sample_outcomes(own, grid(spark, sf), HOUR, 20).drop("symbol", "at", "anchor"), 4)


_CO = f"""{_AU}, {_CF}, k0 AS (SELECT *, row_number() OVER ({_BY}) AS i, CASE
    WHEN count(quote_volume) OVER w4 = 4 THEN sum(quote_volume) OVER w4 END AS v, min(low) OVER d AS l, max(high) OVER d AS h, lag(close,
    4) OVER ({_BY}) AS c4,
    [x for x in [lag(close, 3) OVER ({_BY}), lag(close, 2) OVER ({_BY}), lag(close, 1) OVER ({_BY}), close] if x IS NOT NULL] AS c FROM gr
    WINDOW w4 AS ({_BY} ROWS BETWEEN 3 PRECEDING AND CURRENT ROW), d AS ({_BY} ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)),
  k1 AS (SELECT *, list_filter([{', '.join(f'lag(v, {24 * d}) OVER ({_BY})' for d in range(1, 8))}], lambda x: x IS NOT NULL) AS e FROM k0),
  kf AS (SELECT symbol, open_time, (close / c4 - 1) * 100 AS return_short, v / nullif(list_median(e), 0) AS clock_ratio, CASE
    WHEN h > l THEN (close - l) / (h - l) END AS position,
    CASE WHEN len(c) > 1 THEN (list_max(flatten([[c[b] / c[a] for a in range(1, b + 1)] for b in range(1, len(c) + 1)])) - 1) * 100 END AS runup
    FROM k1),
  co AS (SELECT sample_id, label, contaminated, kf.*, coalesce(liquid, false) AS liquid, CASE
    WHEN contaminated THEN 'contaminated_control' ELSE coalesce(quality, 'missing_decision_bar') END AS quality,
    coalesce(return_short >= 0.9, false)::INT + coalesce(clock_ratio >= 12, false)::INT + coalesce(position >= 0.74,
    false)::INT + coalesce(runup >= 3.3, false)::INT AS late_components
    FROM au LEFT JOIN cf ON cf.symbol = au.symbol AND cf.open_time = cross_anchor - INTERVAL 2 HOUR LEFT JOIN kf ON kf.symbol = au.symbol
    AND kf.open_time = cross_anchor - INTERVAL 2 HOUR)"""


@query("o107_continuation_rows", f"""WITH {_CO} SELECT sample_id, label, quality, contaminated, round(return_short, 4) AS return_short,
    round(clock_ratio, 4) AS clock_ratio, round(position, 4) AS position, round(runup, 4) AS runup,
  late_components::INT AS late_components, liquid AND late_components >= 3 AS "trigger" FROM co""")
def o107_continuation(spark, sf):
    own, bars_ = _matched(spark, sf), grid(spark, sf)
    audit = samples.window_audit(own, bars_, HOUR, 25.0)
    features = _features(spark, sf).drop("position", "runup", "return_short", "clock_ratio").join(context.continuation_features(bars_, 4, 24), ["symbol", "open_time"])
    rows = context.continuation_rows(own, features, audit, 1, HOUR)
    return rounded(rows.select("sample_id", "label", "quality", "contaminated", "return_short", "clock_ratio", "position", "runup", "late_components", "trigger"), 4)


@query("o108_rows_without_references", f"""WITH {_BR} SELECT sample_id, label, off_::INT AS \"offset\", quality, NULL::BOOLEAN AS h2, h3 AS signal
    FROM br""")
def o108(spark, sf):
    return _baseline_rows(spark, sf, ()).select("sample_id", "label", "offset", "quality", "h2", F.col("h3").alias("signal"))


@query("o78_snapshots", f"""WITH {_SA} SELECT sample_id, symbol, {_TS.format('anchor')} AS anchor, o::INT AS offset,
    {_TS.format('anchor - o * INTERVAL 1 HOUR')} AS at FROM sa, unnest([0, 1, 2, 4, 8]) AS u(o)""")
def o78(spark, sf):
    return rounded(context.snapshots(_samples(spark, sf), [0, 1, 2, 4, 8], "1 hour"))


# Confirmation


_POP = """s AS (SELECT lang AS split, quality AS label, n_chars > 1500 AS signal, source AS symbol, doc_id, doc_id // 4 AS g, CASE WHEN n_chars % 600 < 10 THEN NULL ELSE n_chars % 600 END AS m FROM labels JOIN documents USING (doc_id)),
  v AS (SELECT * FROM s WHERE g IN (SELECT g FROM s GROUP BY g HAVING count(*) FILTER (label = 1) = 1 AND count(*) FILTER (label = 0) >= 1))"""


def _population(spark, sf) -> DataFrame:
    rows = spark.read.parquet(f"{sf}/labels.parquet").join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang", "n_chars", "source"), "doc_id")
    minutes = F.when(F.col("n_chars") % 600 >= 10, F.col("n_chars") % 600)
    rows = rows.select(
        "doc_id", F.col("doc_id").alias("id"), F.floor(F.col("doc_id") / 4).alias("match_group"), F.col("quality").alias("label"), (F.col("n_chars") > 1500).alias("signal"),
        F.col("lang").alias("split"), F.col("source").alias("symbol"), scalars.duration_band(minutes).alias("band"),
    )
    return splits.valid_groups(rows, "match_group", "label")


_RATES = """r AS (SELECT CASE WHEN grouping(split) = 1 THEN 'overall' ELSE split END AS split, count(*) FILTER (label = 1) AS events, count(*) FILTER (label = 0) AS controls, count(*) FILTER (label = 1 AND signal) AS event_hits,
    count(*) FILTER (label = 0 AND signal) AS control_hits, count(DISTINCT symbol) FILTER (label = 1 AND signal) AS symbols_hit FROM v GROUP BY GROUPING SETS ((split), ())),
  rr AS (SELECT *, event_hits / nullif(events, 0)::DOUBLE AS event_rate, control_hits / nullif(controls, 0)::DOUBLE AS control_rate, CASE WHEN control_hits = 0 AND controls > 0 AND event_hits > 0 THEN 'inf'::DOUBLE
    ELSE event_hits / nullif(events, 0)::DOUBLE / nullif(control_hits / nullif(controls, 0)::DOUBLE, 0) END AS rate_ratio FROM r)"""


@query("o70_rates", f"""WITH {_POP}, {_RATES} SELECT split, events, controls, event_hits, control_hits, symbols_hit, round(event_rate,
    6) AS event_rate,
    round(control_rate, 6) AS control_rate, round(rate_ratio, 6) AS rate_ratio FROM rr""")
def o70(spark, sf):
    return rounded(confirmation.split_results(_population(spark, sf)))


_BANDS = f"""bd AS (SELECT *, {_BAND.format('m')} AS band FROM v), br AS (SELECT b AS band, count(*) FILTER (label = 1) AS events,
    count(*) FILTER (label = 1 AND signal) AS event_hits, count(*) FILTER (label = 0) AS controls,
  count(*) FILTER (label = 0 AND signal) AS control_hits FROM unnest(['le_3h', 'gt_3h_to_6h', 'gt_6h_to_7h', 'gt_7h_to_8h']) AS u(b) LEFT
    JOIN bd ON bd.band = b GROUP BY 1)"""


@query("o71_band_rates", f"""WITH {_POP}, {_BANDS} SELECT *, round(event_hits / nullif(events, 0)::DOUBLE, 6) AS event_rate,
    round(control_hits / nullif(controls, 0)::DOUBLE, 6) AS control_rate,
  coalesce(event_hits / nullif(events, 0)::DOUBLE > control_hits / nullif(controls, 0)::DOUBLE, false) AS positive_direction FROM br""")
def o71(spark, sf):
    return rounded(confirmation.band_rates(_population(spark, sf)))


#: Draws of the permutation test and of the ratio's bootstrap.
PERMUTATIONS, RATIO_DRAWS = 50_000, 20_000


def _permutation_sql(n: int) -> str:
    """Binomial draws for classes of groups with equal hits and sizes."""
    chance = "exp(lgamma(many + 1) - lgamma(k + 1) - lgamma(many - k + 1) + k * ln(hits / size::DOUBLE) + (many - k) * ln(1 - hits / size::DOUBLE))"
    return f"""gs AS (SELECT g, max(CASE WHEN label = 1 THEN signal::INT END) AS event, sum(signal::INT)::BIGINT AS hits, count(*) AS size FROM v
    GROUP BY g),
  tt AS (SELECT sum(event) AS e0, sum((hits = size)::INT) AS fixed, sum(hits) AS h, sum(size) AS n, count(*) AS k FROM gs),
  cz AS (SELECT hits, size, count(*) AS many FROM gs WHERE hits BETWEEN 1 AND size - 1 GROUP BY ALL),
  cu AS (SELECT hits, size, k, sum({chance}) OVER (PARTITION BY hits, size ORDER BY k) AS upto FROM (SELECT *, unnest(range(0, many)) AS k FROM cz)),
  un AS (SELECT i, hits, size, ('0x' || substr(md5('805601:' || i || ':' || hits || ':' || size), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS u FROM cz,
    range(1, {n + 1}) AS r(i)),
  dw AS (SELECT i, count(*) AS drawn FROM un JOIN cu USING (hits, size) WHERE upto <= u GROUP BY i),
  it AS (SELECT r.i, CASE WHEN r.i = 0 THEN e0 ELSE fixed + coalesce(drawn, 0) END AS e, h, n, k FROM range(0, {n + 1}) AS r(i) CROSS JOIN tt LEFT
    JOIN dw USING (i)),
  pm AS (SELECT i, e / k::DOUBLE - (h - e) / (n - k)::DOUBLE AS d FROM it),
  pv AS (SELECT o.d AS observed, count(*) FILTER (pm.d >= o.d - 1e-12) AS exceed, count(*) AS iterations,
    (count(*) FILTER (pm.d >= o.d - 1e-12) + 1) / (count(*) + 1)::DOUBLE AS p_value FROM pm, (SELECT d FROM pm WHERE i = 0) o WHERE i > 0
    GROUP BY o.d)"""


def _member_permutation_sql(n: int) -> str:
    """A member of every group drawn in every iteration."""
    return f"""gs AS (SELECT g, list(signal::INT ORDER BY doc_id) AS signals, max(CASE WHEN label = 1 THEN signal::INT END) AS event,
    sum(signal::INT) AS hits, count(*) AS size FROM v GROUP BY g),
  it AS (SELECT i, sum(CASE WHEN i = 0 THEN event ELSE signals[1 + ('0x' || substr(md5('805601:' || i || ':' || g), 1, 8))::BIGINT % size] END) AS e,
    sum(hits) AS h, sum(size) AS n, count(*) AS k FROM gs, range(0, {n + 1}) AS r(i) GROUP BY i),
  pm AS (SELECT i, e / k::DOUBLE - (h - e) / (n - k)::DOUBLE AS d FROM it),
  pv AS (SELECT o.d AS observed, count(*) FILTER (pm.d >= o.d - 1e-12) AS exceed, count(*) AS iterations,
    (count(*) FILTER (pm.d >= o.d - 1e-12) + 1) / (count(*) + 1)::DOUBLE AS p_value FROM pm, (SELECT d FROM pm WHERE i = 0) o WHERE i > 0
    GROUP BY o.d)"""


def _p_value(spark, sf, iterations: int) -> DataFrame:
    return inference.permutation_test(_population(spark, sf).withColumn("signal", F.col("signal").cast("int")), iterations, 805601)


@query("o72_permutation", f"""WITH {_POP}, {_member_permutation_sql(PERMUTATIONS)} SELECT round(observed, 6) AS observed, exceed, iterations, round(p_value,
    6) AS p_value FROM pv""")
def o72(spark, sf):
    samples = _population(spark, sf).withColumn("signal", F.col("signal").cast("int"))
    return rounded(inference.member_permutation_test(samples, PERMUTATIONS, 805601))


def _ratio_sql(n: int) -> str:
    return f"""cl AS (SELECT symbol, sum((label = 1 AND signal)::INT) AS eh, sum((label = 1)::INT) AS e, sum((label = 0 AND signal)::INT) AS ch,
    sum((label = 0)::INT) AS c,
    row_number() OVER (ORDER BY symbol) - 1 AS at_, count(*) OVER () AS many FROM v WHERE symbol IS NOT NULL GROUP BY symbol),
  cd AS (SELECT i, ('0x' || substr(md5('805602:' || i || ':' || at_), 1, 8))::BIGINT % many AS at_ FROM cl, range(1, {n + 1}) AS r(i)),
  cp AS (SELECT i, sum(eh) AS eh, sum(e) AS e, sum(ch) AS ch, sum(c) AS c FROM cd JOIN cl USING (at_) WHERE many > 1 GROUP BY i HAVING sum(e) > 0
    AND sum(c) > 0),
  cv AS (SELECT CASE WHEN ch > 0 THEN (eh / e::DOUBLE) / (ch / c::DOUBLE) END AS r, ch = 0 AND eh > 0 AS infinite FROM cp),
  ci AS (SELECT CASE WHEN count(r) >= 100 THEN quantile_cont(r, 0.025) END AS low, CASE WHEN count(r) >= 100 THEN quantile_cont(r, 0.975) END AS high,
    count(r) AS finite, count(*) FILTER (infinite) AS infinite FROM cv)"""


def _interval(spark, sf, iterations: int) -> DataFrame:
    return inference.cluster_ratio_interval(_population(spark, sf).withColumn("signal", F.col("signal").cast("int")), iterations, 805602)


@query("o73_ratio_interval", f"WITH {_POP}, {_ratio_sql(RATIO_DRAWS)} SELECT round(low, 6) AS low, round(high, 6) AS high, finite, infinite FROM ci")
def o73(spark, sf):
    return rounded(_interval(spark, sf, RATIO_DRAWS))


def _acceptance_sql(floors: dict) -> str:
    sign = {"control_rate": "<=", "p_value": "<=", "interval_low": ">"}
    names = [k for k in floors if k != "band_events"]
    check = lambda k: f"coalesce({k}, false)" if floors[k] is True else f"coalesce({k} {sign.get(k, '>=')} {floors[k]}, false)"
    of = lambda s, c: f"max(CASE WHEN split = '{s}' THEN {c} END)"
    row = ", ".join(f"{of('overall', c)} AS {c}" for c in ("events", "event_rate", "control_rate", "rate_ratio", "symbols_hit"))
    parts = ", ".join(f"{of(s, 'event_rate')} > {of(s, 'control_rate')} AS {s}" for s in ("validation", "sealed_test"))
    bands = "(SELECT count(*) FILTER (events >= 5 AND event_hits / nullif(events, 0)::DOUBLE > control_hits / nullif(controls, 0)::DOUBLE) FROM br)"
    return f"""WITH {_POP_SPLIT}, {_RATES}, {_BANDS}, {_permutation_sql(500)}, {_ratio_sql(500)},
  ac AS (SELECT {row}, {parts}, (SELECT max(p_value) FROM pv) AS p_value, (SELECT max(low) FROM ci) AS interval_low, {bands} AS bands FROM rr),
    ck AS (SELECT {', '.join(f'{check(k)} AS {k}_ok' for k in names)} FROM ac)
  SELECT *, {' AND '.join(f'{k}_ok' for k in names)} AS passed,
    array_to_string(list_filter([{', '.join(f"CASE WHEN NOT {k}_ok THEN '{k}' END" for k in names)}], lambda x: x IS NOT NULL), ',') AS failed
    FROM ck"""


_POP_SPLIT = _POP.replace("lang AS split", "CASE lang WHEN 'en' THEN 'discovery' WHEN 'de' THEN 'validation' ELSE 'sealed_test' END AS split")


def _accepted(spark, sf, floors: dict) -> DataFrame:
    split = F.when(F.col("split") == "en", "discovery").when(F.col("split") == "de", "validation").otherwise("sealed_test")
    rows = _population(spark, sf).withColumn("split", split)
    extra = {"interval": _interval(spark, sf, 500), "bands": confirmation.band_rates(rows)} if "bands" in floors else {}
    return confirmation.acceptance(confirmation.split_results(rows), _p_value(spark, sf, 500), floors, **extra)


@query("o75_acceptance", _acceptance_sql(confirmation.FLOORS))
def o75(spark, sf):
    return _accepted(spark, sf, confirmation.FLOORS)


@query("o76_first_acceptance", _acceptance_sql(confirmation.FIRST_FLOORS))
def o76_accepted(spark, sf):
    return _accepted(spark, sf, confirmation.FIRST_FLOORS)


@query("o76_baseline_population", f"""WITH {_BR} SELECT sample_id, match_group, label, h1 AS signal FROM br WHERE off_ = 0 AND quality = 'pass'
    AND liquid AND NOT contaminated AND h1 IS NOT NULL""")
def o76(spark, sf):
    return confirmation.baseline_population(_baseline_rows(spark, sf), "h1").select("sample_id", "match_group", "label", "signal")


@query("o77_matched_population", f"""WITH {_BR}, ok AS (SELECT sample_id, match_group, label, h3 AS signal FROM br WHERE off_ = 0 AND quality = 'pass'
    AND h3 IS NOT NULL),
  kn AS (SELECT * FROM ok WHERE label = 1 OR match_group IN (SELECT match_group FROM ok WHERE label = 1))
  SELECT * FROM kn WHERE match_group IN (SELECT match_group FROM kn GROUP BY 1 HAVING count(*) FILTER (label = 1) = 1
    AND count(*) FILTER (label = 0) >= 1)""")
def o77(spark, sf):
    rows = _baseline_rows(spark, sf, ()).where("offset = 0").select("sample_id", "match_group", "label", "quality", F.col("h3").alias("signal"))
    rows = staged(rows, "baseline-rows")
    return confirmation.matched_population(rows.where("label = 1"), rows.where("label = 0")).select("sample_id", "match_group", "label", "signal")


# Packaging


_RW = _SA + f""", gr AS {_G.split(", gr AS", 1)[1]}, rw AS (SELECT sample_id, sa.symbol, gr.open_time,
    (epoch(gr.open_time) - epoch(anchor))::BIGINT // 3600 AS relative_bar, close, observed, count(*) OVER (PARTITION BY sample_id) AS n
  FROM sa JOIN gr ON gr.symbol = sa.symbol AND gr.open_time >= anchor - INTERVAL 24 HOUR AND gr.open_time < anchor QUALIFY n = 24)"""


def _stored_windows(spark, sf) -> tuple[DataFrame, DataFrame]:
    """Whole windows of the samples, and the store of their bars."""
    bars = grid(spark, sf)
    whole = context.whole_windows(_samples(spark, sf), bars, 24, HOUR)
    return whole, context.shared_store(whole, bars)


@query("o110_raw_windows", f"""WITH {_RW} SELECT sample_id, symbol, {_TS.format('open_time')} AS open_time, relative_bar::INT AS relative_bar,
    round(close, 6) AS close, observed FROM rw""")
def o110(spark, sf):
    return rounded(context.raw_windows(*_stored_windows(spark, sf), HOUR).select("sample_id", "symbol", "open_time", "relative_bar", "close", "observed"))


@query("o111_shared_store", f"WITH {_RW} SELECT DISTINCT symbol, {_TS.format('open_time')} AS open_time, round(close, 6) AS close, observed FROM rw")
def o111(spark, sf):
    return rounded(_stored_windows(spark, sf)[1].select("symbol", "open_time", "close", "observed"))


@query("o106_value_counts", "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ALL")
def o106(spark, sf):
    return context.value_counts(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderstatus", "o_orderpriority")


@query("o112_chunks", """WITH RECURSIVE sz AS (SELECT o_custkey::VARCHAR AS symbol, sum(o_orderkey % 5000)::BIGINT AS bytes, row_number() OVER (ORDER BY o_custkey::VARCHAR) AS n FROM orders GROUP BY 1), fo AS (
    SELECT 0::BIGINT AS n, NULL::VARCHAR AS symbol, 0::BIGINT AS bytes, 0 AS chunk, 0::BIGINT AS held UNION ALL
    SELECT s.n, s.symbol, s.bytes, CASE WHEN f.n > 0 AND f.held > 0 AND f.held + s.bytes > 200000 THEN f.chunk + 1 ELSE f.chunk END, CASE WHEN f.n > 0 AND f.held > 0 AND f.held + s.bytes > 200000 THEN s.bytes ELSE f.held + s.bytes END
    FROM fo f JOIN sz s ON s.n = f.n + 1) SELECT symbol, bytes, chunk FROM fo WHERE n > 0""")
def o112(spark, sf):
    sizes = spark.read.parquet(f"{sf}/orders.parquet").groupBy(F.col("o_custkey").cast("string").alias("symbol")).agg(F.sum(F.col("o_orderkey") % 5000).alias("bytes"))
    return packaging.first_fit_chunks(sizes, 200_000)


@query("o113_universe_audit", f"""WITH {_SA}, gr AS {_G.split(", gr AS", 1)[1]} SELECT symbol, count(*) AS bars,
    count(*) FILTER (observed) AS observed_bars, {_TS.format('min(CASE WHEN observed THEN open_time END)')} AS first_seen,
  {_TS.format('max(CASE WHEN observed THEN open_time END)')} AS last_seen, (SELECT count(*) FROM sa WHERE sa.symbol = gr.symbol) AS samples FROM gr
    GROUP BY symbol""")
def o113(spark, sf):
    return rounded(packaging.universe_audit(grid(spark, sf), _samples(spark, sf)))


@query("o114_sample_window", f"""WITH {_RW} SELECT sample_id, symbol, 1 AS label, relative_bar::INT AS relative_bar,
    {_TS.format('open_time')} AS open_time, round(close, 6) AS close FROM rw""")
def o114(spark, sf):
    """From a store that is written once."""
    whole, store = _stored_windows(spark, sf)
    found = context.raw_windows(whole.withColumn("label", F.lit(1)), staged(store, "store"), HOUR)
    return rounded(found.select("sample_id", "symbol", "label", "relative_bar", "open_time", "close"))


@query("o119_exports", f"""WITH {_R} SELECT symbol, event_date::VARCHAR AS event_date, {_TS.format('cross_trade_time')} AS cross_trade_time,
    round(cross_trade_price, 6) AS cross_trade_price FROM re WHERE cross_trade_time IS NOT NULL""")
def o119(spark, sf):
    resolved = surge.resolved_trades(first_surges(spark, sf), tape(spark, sf), "1 hour", 1.25)
    out = packaging.export(resolved, ["event_date", "symbol"], F.col("cross_trade_time").isNotNull())
    return rounded(out.select("symbol", "event_date", "cross_trade_time", "cross_trade_price"))


_BU = _S + """, be AS (SELECT symbol || '@' || event_date::VARCHAR AS event_id, su.symbol, event_date, cross_time FROM su)"""


@query("o120_bundle", f"""WITH {_BU}, bc AS (SELECT event_id, count(*) AS n FROM be JOIN ba ON ba.symbol = be.symbol
    AND ba.open_time::DATE = event_date AND open_time < cross_time GROUP BY 1),
  tc AS (SELECT event_id, count(*) AS n FROM be JOIN tr ON tr.symbol = be.symbol AND tr.ts::DATE = event_date AND ts < cross_time GROUP BY 1)
  SELECT event_id, 'event_day_bars' AS role, coalesce(n, 0) AS rows, 3 AS prior_days FROM be LEFT JOIN bc USING (event_id) UNION ALL SELECT event_id,
    'event_day_trades', coalesce(n, 0), 3 FROM be LEFT JOIN tc USING (event_id)
  UNION ALL SELECT event_id, 'prior_day_archives', 3, 3 FROM be""")
def o120(spark, sf):
    events = first_surges(spark, sf).select(F.concat_ws("@", "symbol", "event_date").alias("event_id"), "symbol", "event_date", "cross_time")
    tables = {
        "event_day_bars": packaging.pre_cross_rows(events, bars(spark, sf), "open_time"), "event_day_trades": packaging.pre_cross_rows(events, tape(spark, sf), "ts"),
        "prior_day_archives": packaging.prior_day_archives(events, 3),
    }
    return packaging.bundle_manifest(events, 3, tables)


@query("o121_reference_series", f"""WITH {_G} SELECT 'REF' AS symbol, {_TS.format('open_time')} AS open_time, round(close, 6) AS close,
    round(quote_volume, 4) AS quote_volume, NULL::DOUBLE AS taker_buy_base, observed FROM gr WHERE symbol = 'view'""")
def o121(spark, sf):
    own = packaging.normalised_reference(grid(spark, sf).where("symbol = 'view'"), "REF", ["close", "quote_volume", "taker_buy_base"])
    return rounded(own.withColumn("quote_volume", F.round("quote_volume", 4)))


@query("o66_scan", f"""WITH {_ER} SELECT symbol, count(*) AS events, count(*) FILTER (baseline_trade_time IS NULL) AS baseline_unresolved,
    count(*) FILTER (cross_trade_time IS NULL) AS cross_unresolved,
  count(*) FILTER (missing_window_bars > 0) AS gaps_in_window, count(*) FILTER (NOT exact_window) AS outside_window,
    count(*) FILTER (quality = 'pass') AS passed FROM er GROUP BY 1""")
def o66(spark, sf):
    return surge.scan_issues(event_records(spark, sf))


_SCANS = "sn AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 0 THEN o_orderdate::DATE END AS a, CASE WHEN o_orderkey % 5 > 0 AND o_orderkey % 7 > 0 THEN o_orderdate::DATE + (o_orderkey % 400 - 20)::INT END AS b FROM orders)"


def _scans(spark, sf) -> DataFrame:
    """Orders as scans asked for: with days, with one of them, or without."""
    key, day = F.col("o_orderkey"), F.to_date("o_orderdate")
    return spark.read.parquet(f"{sf}/orders.parquet").select(
        "o_orderkey", F.when(key % 7 > 0, day).alias("start_date"), F.when((key % 5 > 0) & (key % 7 > 0), F.date_add(day, (key % 400 - 20).cast("int"))).alias("end_date"),
    )


@query("o66_scan_windows", f"""WITH {_SCANS}, w AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL THEN DATE '1996-06-01' - 60 ELSE a END AS s, CASE
    WHEN a IS NULL AND b IS NULL THEN DATE '1996-06-01' ELSE b END AS e FROM sn)
  SELECT o_orderkey, s::DATE::VARCHAR AS first_day, (e - 1)::DATE::VARCHAR AS last_day, (s - 1)::DATE::VARCHAR AS load_from,
    array_to_string(list_filter([CASE WHEN (a IS NULL) <> (b IS NULL) THEN 'one_bound_missing' END,
    CASE WHEN e::DATE - s::DATE <= 0 THEN 'order' END, CASE WHEN e > DATE '1996-06-01' THEN 'incomplete_day' END, CASE
    WHEN e::DATE - s::DATE NOT BETWEEN 1 AND 240 THEN 'length' END], lambda x: x IS NOT NULL), ',') AS issues FROM w""")
def o66_windows(spark, sf):
    found = surge.scan_windows(_scans(spark, sf).withColumn("lookback", F.lit(60)), F.lit("1996-06-01").cast("date"))
    return rounded(found.withColumn("issues", F.concat_ws(",", "issues")).select("o_orderkey", "first_day", "last_day", "load_from", "issues"))


@query("o122_evidence", f"""WITH {_SCANS} SELECT o_orderkey, array_to_string(list_filter([CASE WHEN o_orderkey % 3 = 0 THEN 'guard_before' END, CASE
    WHEN o_orderkey % 4 = 0 THEN 'guard_after' END, CASE WHEN o_orderkey % 11 = 0 THEN 'window' END,
  CASE WHEN a IS NULL OR b IS NULL THEN 'explicit_window' END, CASE WHEN a IS NOT NULL AND b > DATE '1996-01-01' THEN 'cutoff' END],
    lambda x: x IS NOT NULL), ',') AS issues FROM sn""")
def o122(spark, sf):
    key = F.col("o_orderkey")
    guards = {"guard_before": F.when(key % 3 == 0, 479).otherwise(480), "guard_after": F.when(key % 4 != 0, 600), "window_minutes": F.when(key % 11 == 0, 60).otherwise(480)}
    found = packaging.evidence_issues(_scans(spark, sf).withColumns(guards), "1996-01-01")
    return found.select("o_orderkey", F.concat_ws(",", "issues").alias("issues"))


def _written(spark, name: str) -> str:
    return f"{checkpoint_root(spark)}/barlab/{name}-{uuid.uuid4().hex}"


@query("o113_reference_package", f"""WITH {_SA}, gr AS {_G.split(", gr AS", 1)[1]}, pk AS (SELECT 'reference_data' AS part, symbol FROM gr
    WHERE symbol IN ('click', 'view') UNION ALL
    SELECT 'universe_daily_data', symbol FROM (SELECT DISTINCT symbol, open_time::DATE FROM gr WHERE observed) UNION ALL
    SELECT DISTINCT 'universe_symbols', symbol FROM gr)
  SELECT part, symbol, count(*) AS rows FROM pk GROUP BY 1, 2""")
def o113_package(spark, sf):
    return packaging.reference_package(grid(spark, sf), _samples(spark, sf), list(_REFS), _written(spark, "reference"))


@query("o113_daily_bars", f"""WITH {_B} SELECT symbol, open_time::DATE::VARCHAR AS day, round(first(open ORDER BY open_time), 6) AS open,
    round(max(high), 6) AS high, round(min(low), 6) AS low, round(last(close ORDER BY open_time), 6) AS close,
  round(sum(quote_volume), 4) AS quote_volume, sum(trade_count)::BIGINT AS trade_count FROM ba GROUP BY 1, 2""")
def o113_daily(spark, sf):
    found = packaging.daily_bars(grid(spark, sf)).withColumn("quote_volume", F.round("quote_volume", 4))
    return rounded(found.select("symbol", "day", "open", "high", "low", "close", "quote_volume", "trade_count"))


@query("o116_split_packages", f"""WITH {_SP}, ev AS (SELECT symbol || '@' || su.event_date::VARCHAR AS event_id, split FROM su
    JOIN sp USING (event_date)) SELECT split, split = 'sealed_test' AS sealed, count(*) AS events, min(event_id) AS first_event FROM ev GROUP BY 1""")
def o116(spark, sf):
    read = packaging.write_by_split(_events(spark, sf), _written(spark, "splits"))
    return read.groupBy("split", "sealed").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"))
