"""Entry signals from a stream of bars, equal to those of ``operators.signals.entry_signals`` on the same bars."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

_INPUTS = ["close", "low", "high", "quote_volume", "trade_count"]
_STATE = "ring binary, last bigint, armed bigint, e1 boolean, e2 boolean, rests bigint"
_SHOWN = (
    "symbol string, open_time timestamp, close double, components int, t3 boolean, t4 boolean, t5 boolean, e1_edge boolean, e2_edge boolean, armed_recent boolean, "
    "activity double, rested boolean"
)


def _rolled(x: np.ndarray, w: int, how: str) -> np.ndarray:
    """Over the last w values, unknown where one of them is."""
    return getattr(pd.Series(x).rolling(w, min_periods=w), how)().to_numpy()


def _lagged(x: np.ndarray, n: int) -> np.ndarray:
    return np.concatenate([np.full(min(n, len(x)), np.nan), x[: max(0, len(x) - n)]])


def _clock(x: np.ndarray, day: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the last values: their ratio to the median of those at the same time on seven days before, and the known days."""
    own = np.arange(len(x) - last, len(x))
    at = own - day * np.arange(1, 8)[:, None]
    before = np.where(at >= 0, x[np.maximum(at, 0)], np.nan)
    known = (~np.isnan(before)).sum(axis=0)
    middle = np.full(last, np.nan)
    if known.any():
        middle[known > 0] = np.nanmedian(before[:, known > 0], axis=0)
    return np.divide(x[own], middle, out=np.full(last, np.nan), where=~np.isnan(middle) & (middle != 0)), known


def measures(ring: np.ndarray, last: int, rule: dict[str, float]) -> dict[str, np.ndarray]:
    """``ring``: a row a bar of _INPUTS, not-a-number in gaps; the signals of its ``last`` bars."""
    close, low, high, quote, trades = ring.T
    w, half, day, long, refs = rule["w"], rule["w"] // 2, rule["day"], rule["long"], rule["refs"]
    tail = slice(len(ring) - last, len(ring))
    sums = {n: (_rolled(x, w, "sum"), _rolled(x, half, "sum")) for n, x in (("q", quote), ("t", trades))}
    low_w, high_w = _rolled(low, w, "min")[tail], _rolled(high, w, "max")[tail]
    whole = lambda n: _rolled((~np.isnan(close)).astype(float), n, "sum")[tail] == n
    over = lambda a, b: np.divide(a, b, out=np.full(len(a), np.nan), where=~np.isnan(b) & (b != 0))
    before = _lagged(close, w)[tail]
    gain = np.where(before > 0, (over(close[tail], before) - 1) * 100, np.nan)
    position = over(close[tail] - low_w, high_w - low_w)
    ratio, days = zip(*(_clock(sums[n][0], day, last) for n in ("q", "t")))
    (q, q_late), (t, t_late) = ((a[tail], b[tail]) for a, b in sums.values())
    early = lambda a, b: np.where(a - b != 0, a - b, np.nan)
    liquid = whole(w) & (_rolled(quote, w, "median")[tail] >= rule["median"]) & (q >= rule["quote"]) & (t >= rule["trades"])
    t3 = (gain >= rule["t3_gain"]) & (t_late >= rule["step"] * early(t, t_late)) & (ratio[1] >= rule["t3_clock"]) & (days[1] >= refs)
    t4 = (gain >= rule["t4_gain"]) & (ratio[0] >= rule["t4_clock"]) & (q_late >= rule["step"] * early(q, q_late)) & (days[0] >= refs)
    t5 = (gain >= rule["t5_gain"]) & (position >= rule["t5_position"]) & whole(long)
    for k in np.flatnonzero(t5):
        end = tail.start + k + 1
        path = close[end - long : end]
        t5[k] = path.min() > 0 and len(path) > 1 and (
            (path / np.minimum.accumulate(path)).max() * 100 - 100 >= rule["t5_runup"] and (path / np.maximum.accumulate(path)).min() * 100 - 100 <= rule["t5_drawdown"]
        )
    deep = _rolled(low, rule["deep"], "min")[tail]
    rise = np.where(deep > 0, (over(close[tail], deep) - 1) * 100, np.nan)
    long_ratio, long_days = _clock(_rolled(quote, long, "sum"), day, last)
    armed = whole(rule["deep"]) & (rise >= rule["rise"]) & (long_ratio >= rule["long_clock"]) & (long_days >= refs)
    activity = np.fmax(np.fmax(ratio[0], ratio[1]), 0.0)
    return {"liquid": liquid, "t3": t3, "t4": t4, "t5": t5, "armed": armed, "activity": np.where(np.isnan(ratio[0]) & np.isnan(ratio[1]), 0.0, activity), "close": close[tail]}


class EntrySignals(StatefulProcessor):
    """Per symbol a ring of the bars that the windows reach, the last bar and the last armed one, whether the signals held there,
    and until when the symbol rests."""

    def __init__(self, rule: dict[str, float], step_seconds: int, cooldown_seconds: int):
        self.rule, self.step, self.cooldown = rule, step_seconds, cooldown_seconds
        self.reach = max(7 * rule["day"] + max(rule["w"], rule["long"]), rule["deep"], rule["w"] + 1)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("signals", _STATE)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        bars = pd.concat(list(rows), ignore_index=True)
        number = (bars["open_time"].astype("datetime64[us]").astype("int64") // (self.step * 1_000_000)).to_numpy()
        known = self.state.exists()
        ring, last, armed_at, e1, e2, rests = self.state.get() if known else (b"", None, None, False, False, None)
        ring = np.frombuffer(ring).reshape(-1, len(_INPUTS))
        last = int(number.min()) - 1 if last is None else last
        # Of bars with one time the last by its values counts; bars no later than the last one seen come too late.
        fresh = number > last
        if not fresh.any():
            return
        order = np.lexsort([*(bars[c].to_numpy(float)[fresh] for c in reversed(_INPUTS)), number[fresh]])
        n = int(number.max()) - last
        new = np.full((n, len(_INPUTS)), np.nan)
        new[number[fresh][order] - last - 1] = bars[_INPUTS].to_numpy(float)[fresh][order]
        held = np.concatenate([ring, new])
        found = measures(held, n, self.rule)
        out = []
        for k in range(n):
            at = last + 1 + k
            recent = armed_at is not None and at - armed_at <= self.rule["ttl"]
            components = int(found["t3"][k]) + int(found["t4"][k]) + int(found["t5"][k])
            now1 = bool(found["liquid"][k]) and components > 0
            now2 = now1 and recent
            if now1 and not e1 or now2 and not e2:
                decision = (at + 1) * self.step
                rested = rests is not None and decision < rests
                if not rested:
                    rests = decision + self.cooldown
                out.append((
                    key[0], pd.Timestamp(at * self.step, unit="s"), found["close"][k], components, bool(found["t3"][k]), bool(found["t4"][k]), bool(found["t5"][k]),
                    now1 and not e1, now2 and not e2, recent, float(found["activity"][k]), rested,
                ))
            e1, e2 = now1, now2
            if found["armed"][k]:
                armed_at = at
        self.state.update((held[-self.reach :].tobytes(), last + n, armed_at, e1, e2, rests))
        if out:
            yield pd.DataFrame(out, columns=[c.split()[0] for c in _SHOWN.split(", ")])

    def close(self) -> None:
        pass


def stream_entry_signals(bars: DataFrame, rule: dict[str, float], step_seconds: int, cooldown_seconds: int) -> DataFrame:
    """``bars``: a stream of symbol, open_time, close, low, high, quote_volume, trade_count. Gives out each bar at which an entry
    signal begins to hold, once: what ``entry_signals`` says there, armed_recent included, and rested, whether the symbol
    rests after an earlier one (a rest begins at an edge that doesn't fall into one).

    State is the bars of one reach a symbol (about a week of bars) and a few numbers; it needs a state store that holds
    several columns (RocksDB's). A bar that comes after a later one of its symbol was seen is dropped, so bars should come
    from ``stream_bars``, which holds them until the watermark has passed."""
    inputs = bars.select("symbol", "open_time", *(bars[c].cast("double").alias(c) for c in _INPUTS))
    return inputs.groupBy("symbol").transformWithStateInPandas(
        statefulProcessor=EntrySignals(rule, step_seconds, cooldown_seconds), outputStructType=_SHOWN, outputMode="Append", timeMode="None",
    )
