"""Wide windows over a symbol's bars that cost the same whatever their width.

Two levels. A symbol's bars are numbered and cut into blocks as long as the window; running values from each block's
first bar on (prefixes) and up to its last (suffixes) are native windows. A window that ends inside a block is the suffix
of the block before, from the window's first bar on, and the prefix of its own, so that it takes one lookup back. That
holds for whatever composes from left to right: sums, counts, extremes, and the rises and falls along a path.

Windows of any place and length take aligned runs instead: summaries of every run of 8^k bars, a few of which on each
level make up the window.

Time chunks. A window looks back a known number of bars, so a symbol's bars are dealt out in chunks of time, each with
the bars before (and after) it that its windows reach. Nothing but the chunk's own bars are given out.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..functions.scalars import ratio

#: Up to this width a frame's rows are read again for each bar, which sorts less.
NARROW = 32


@dataclass(frozen=True)
class Over:
    """min, max, sum or count of ``value`` over ``w`` bars: those that end ``skip`` bars before this one, or (``ahead``)
    those that begin ``skip`` bars after it. Only known values count; where none is, all but the count are null."""

    how: str
    value: Column
    w: int
    skip: int = 0
    ahead: bool = False

    def plain(self) -> Column:
        value = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}[self.how](self.value)
        near, far = self.skip, self.skip + self.w - 1
        return value.over(by_time().rowsBetween(near, far) if self.ahead else by_time().rowsBetween(-far, -near))


def by_time(ahead: bool = False) -> WindowSpec:
    """A symbol's bars in order of time, or backwards."""
    return Window.partitionBy("symbol").orderBy(F.desc("open_time") if ahead else F.asc("open_time"))


_BOTH: dict[str, Callable[[Column, Column], Column]] = {
    "min": lambda a, b: F.least(a, b), "max": lambda a, b: F.greatest(a, b), "count": lambda a, b: F.coalesce(a, F.lit(0)) + b,
    "sum": lambda a, b: F.when(a.isNull(), b).when(b.isNull(), a).otherwise(a + b),
}
_RUNNING = {"min": F.min, "max": F.max, "sum": F.sum, "count": F.count}


def _blocks(rows: DataFrame, widths: set[int], ahead: bool) -> DataFrame:
    """Adds __i, bars counted from 0 in the direction, and __b<w>, the number of each width's block."""
    rows = rows.withColumn("__i", F.row_number().over(by_time(ahead)) - 1)
    return rows.withColumns({f"__b{w}": F.floor(F.col("__i") / w) for w in widths})


def _in_block(w: int, ahead: bool, suffix: bool) -> WindowSpec:
    """From a block's first bar to this one, or (``suffix``) from its last bar back to this one."""
    order = F.desc("open_time") if ahead != suffix else F.asc("open_time")
    return Window.partitionBy("symbol", f"__b{w}").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)


def windowed(rows: DataFrame, measures: dict[str, Over]) -> DataFrame:
    """Adds each measure under its name."""
    narrow = {n: m for n, m in measures.items() if m.w <= NARROW}
    rows = rows.withColumns({n: m.plain() for n, m in narrow.items()}) if narrow else rows
    for ahead in (False, True):
        wide = {n: m for n, m in measures.items() if n not in narrow and m.ahead == ahead}
        if not wide:
            continue
        kept, widths = [c for c in rows.columns if c not in wide], {m.w for m in wide.values()}
        rows = _blocks(rows, widths, ahead)
        for w in sorted(widths):
            own = {n: m for n, m in wide.items() if m.w == w}
            for kind, suffix in (("p", False), ("s", True)):
                rows = rows.withColumns({f"__{kind}_{n}": _RUNNING[m.how](m.value).over(_in_block(w, ahead, suffix)) for n, m in own.items()})
        at = lambda c, k: F.lag(c, k).over(by_time(ahead)) if k else F.col(c)
        found = {}
        for n, m in wide.items():
            prefix, suffix = at(f"__p_{n}", m.skip), at(f"__s_{n}", m.skip + m.w - 1)
            # Where the window ends with its block, the prefix is all of it.
            found[n] = F.when((F.col("__i") - m.skip) % m.w == m.w - 1, prefix).otherwise(_BOTH[m.how](suffix, prefix))
            if m.how == "count":
                found[n] = F.coalesce(found[n], F.lit(0))
        rows = rows.withColumns(found).select(*kept, *wide)
    return rows


def whole(rows: DataFrame, name: str, how: str, value: Column, w: int, least: int | None = None) -> DataFrame:
    """Adds ``name``: the measure over the last w bars where at least ``least`` (all) of its values are known."""
    rows = windowed(rows, {name: Over(how, value, w), "__known": Over("count", value, w)})
    return rows.withColumn(name, F.when(F.col("__known") >= (w if least is None else least), F.col(name))).drop("__known")


def next_known(rows: DataFrame, name: str, value: Column, w: int) -> DataFrame:
    """Adds ``name``: the first known ``value`` among the last w bars; one running pass backwards and one lookup."""
    from_here = by_time(ahead=True).rowsBetween(Window.unboundedPreceding, 0)
    known = F.when(value.isNotNull(), F.struct(value.alias("v"), F.col("open_time").alias("t")))
    rows = rows.withColumn("__next", F.last(known, ignorenulls=True).over(from_here))
    begin = F.first("__next").over(by_time().rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__first", F.when(F.row_number().over(by_time()) >= w, F.lag("__next", w - 1).over(by_time())).otherwise(begin))
    return rows.withColumn(name, F.when(F.col("__first.t") <= F.col("open_time"), F.col("__first.v"))).drop("__next", "__first")


# Paths


def path_extremes(rows: DataFrame, value: Column, w: int) -> DataFrame:
    """Adds over the last w bars, gaps left out: path_known (values), path_low and path_high, path_rise and path_fall (the
    largest rise from a value to a later one and the deepest fall, as parts, 0 for a single value), all from summaries
    that compose. Rise and fall are null where a value isn't positive."""
    kept = rows.columns
    rows = _blocks(rows.withColumn("__x", F.when(value > 0, value)), {w}, False).withColumn("__bad", value <= 0)
    before, after = _in_block(w, False, False), _in_block(w, False, True)
    x = F.col("__x")
    for kind, f in (("p", before), ("s", after)):
        rows = rows.withColumns({
            f"__{kind}_low": F.min(x).over(f), f"__{kind}_high": F.max(x).over(f), f"__{kind}_n": F.count("__bad").over(f),
            f"__{kind}_bad": F.count_if("__bad").over(f),
        })
        # In a prefix a bar ends a rise from the least before it; in a suffix it begins one to the highest after it.
        rise, fall = (ratio(x, F.col("__p_low")), ratio(x, F.col("__p_high"))) if kind == "p" else (ratio(F.col("__s_high"), x), ratio(F.col("__s_low"), x))
        rows = rows.withColumns({f"__{kind}_rise": F.max(rise).over(f), f"__{kind}_fall": F.min(fall).over(f)})
    names = ("low", "high", "n", "bad", "rise", "fall")
    earlier = {f"__e_{c}": F.lag(f"__s_{c}", w - 1).over(by_time()) for c in names}
    rows = rows.withColumns(earlier)
    alone = F.col("__i") % w == w - 1
    e, p = (lambda c: F.when(~alone, F.col(f"__e_{c}"))), (lambda c: F.col(f"__p_{c}"))
    bad = F.coalesce(e("bad"), F.lit(0)) + p("bad")
    return rows.withColumns({
        "path_known": F.coalesce(e("n"), F.lit(0)) + p("n"), "path_low": F.least(e("low"), p("low")), "path_high": F.greatest(e("high"), p("high")),
        "path_rise": F.when(bad == 0, F.greatest(e("rise"), p("rise"), ratio(p("high"), e("low"))) - 1),
        "path_fall": F.when(bad == 0, F.least(e("fall"), p("fall"), ratio(p("low"), e("high"))) - 1),
    }).select(*kept, "path_known", "path_low", "path_high", "path_rise", "path_fall")


#: Bars (or runs) of one level that make up a run of the next.
FAN = 8


def _composed(rows: DataFrame, by: list[str], order: Column) -> DataFrame:
    """Neighbouring runs (seen, low, top, high, rise) as one for each ``by``. Lows before a run count for its highs; after a
    low that isn't positive nothing is compared any more."""
    before = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__least", F.min("low").over(before))
    open_ = F.col("__least").isNull() | (F.col("__least") > 0)
    rows = rows.withColumns({
        "high": F.when(open_, F.col("high")), "rise": F.when(open_, F.greatest("rise", ratio(F.col("high"), F.col("__least")))),
    })
    return rows.groupBy(*by).agg(*(f(c).alias(c) for f, c in ((F.sum, "bars"), (F.sum, "seen"), (F.min, "low"), (F.max, "top"), (F.max, "high"), (F.max, "rise"))))


def run_summaries(bars: DataFrame, levels: int) -> DataFrame:
    """``bars``: symbol, n (bars counted without gaps), low, high, observed. Summaries of the aligned runs of FAN^level bars:
    symbol, level, block, bars, seen, low (the least), top (the greatest high), high (the greatest that may be compared with
    lows before the run) and rise (the greatest such high over the least low before it in the run). A bar's high is compared
    with the lows before it where the bar before it has a low, and until a low isn't positive."""
    before = Window.partitionBy("symbol").orderBy("n")
    comparable = F.when((F.lag("n").over(before) == F.col("n") - 1) & F.lag("low").over(before).isNotNull(), F.col("high"))
    level = bars.select(
        "symbol", F.col("n").alias("block"), F.lit(1).cast("long").alias("bars"), F.col("observed").cast("long").alias("seen"), "low",
        F.col("high").alias("top"), comparable.alias("high"), F.lit(None).cast("double").alias("rise"),
    )
    found = [level.withColumn("level", F.lit(0))]
    for k in range(1, levels + 1):
        children = level.withColumn("parent", F.floor(F.col("block") / FAN))
        level = _composed(children, ["symbol", "parent"], F.col("block")).withColumnRenamed("parent", "block")
        found.append(level.withColumn("level", F.lit(k)))
    return reduce(DataFrame.unionByName, found)


def run_cover(first: Column, last: Column, levels: int) -> Column:
    """An array of (level, block): the aligned runs of up to FAN^levels bars that make up [first, last], in any order. Level by
    level from single bars up, what lies outside whole runs of the next level is taken."""
    empty = F.array().cast("array<struct<level:int,block:bigint>>")

    def runs(k: Column, a: Column, b: Column) -> Column:
        one = lambda x: F.struct(k.cast("int").alias("level"), x.cast("bigint").alias("block"))
        return F.when(a < b, F.transform(F.sequence(a, F.greatest(a, b - 1)), one)).otherwise(empty)

    def climb(s: Column, k: Column) -> Column:
        low, high = s["low"], s["high"]
        up, down = (F.ceil(low / FAN) * FAN).cast("bigint"), (F.floor(high / FAN) * FAN).cast("bigint")
        inner = up < down
        taken = F.concat(s["taken"], runs(k, low, F.when(inner, up).otherwise(high)), F.when(inner, runs(k, down, high)).otherwise(empty))
        to = lambda c: F.when(inner, F.floor(c / FAN)).otherwise(0).cast("bigint")
        return F.struct(to(up).alias("low"), to(down).alias("high"), taken.alias("taken"))

    start = F.struct(first.cast("bigint").alias("low"), (last + 1).cast("bigint").alias("high"), empty.alias("taken"))
    done = F.aggregate(F.array(*(F.lit(k) for k in range(levels))), start, climb) if levels else start
    return F.concat(done["taken"], runs(F.lit(levels), done["low"], done["high"]))


def over_ranges(asked: DataFrame, bars: DataFrame, key: list[str], levels: int = 3) -> DataFrame:
    """``asked``: ``key``, symbol, first, last (bar numbers, both included); ``bars`` as run_summaries takes them. For each range
    with a bar: bars, seen, low, top, high and rise (see there), from up to 2 FAN runs a level (and, at the last one, as many
    as the range is long in them)."""
    run = F.explode(run_cover(F.col("first"), F.col("last"), levels)).alias("run")
    parts = asked.where("first <= last").select(*key, "symbol", run).select(*key, "symbol", "run.*")
    parts = parts.join(run_summaries(bars, levels), ["symbol", "level", "block"])
    return _composed(parts, key, F.col("block") * F.pow(F.lit(float(FAN)), F.col("level")))


# Order statistics


def rolling_median(rows: DataFrame, name: str, column: str, w: int) -> DataFrame:
    """Adds ``name``: the median of ``column`` over the last w bars where all of them are known. Up to NARROW bars a native
    frame; beyond, one pass over each symbol's bars in order keeps the window's values sorted, so that a bar costs a search
    and a short move of memory."""
    if w <= NARROW:
        f = by_time().rowsBetween(1 - w, 0)
        return rows.withColumn(name, F.when(F.count(column).over(f) == w, F.percentile(column, F.lit(0.5)).over(f)))
    kept = [f for f in rows.schema.fields if f.name != name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        symbol, held, ordered = None, deque(), []
        for batch in batches:
            out = []
            for s, x in zip(batch.column("symbol").to_pylist(), batch.column(column).to_pylist()):
                if s != symbol:
                    symbol, held, ordered = s, deque(), []
                held.append(x)
                if x is not None:
                    insort(ordered, x)
                if len(held) > w:
                    gone = held.popleft()
                    if gone is not None:
                        del ordered[bisect_left(ordered, gone)]
                out.append((ordered[(w - 1) // 2] + ordered[w // 2]) / 2 if len(ordered) == w else None)
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in kept), pa.array(out, pa.float64())], [*(f.name for f in kept), name])

    ordered_rows = rows.select(*(f.name for f in kept)).repartition("symbol").sortWithinPartitions("symbol", "open_time")
    return ordered_rows.mapInArrow(run, StructType([*kept, StructField(name, DoubleType())]))


# Trends


def log_trend(rows: DataFrame, value: Column, w: int, bars_per_day: int, most: int) -> DataFrame:
    """Adds trend and trend_r2: the least-squares line through the logs of the known values of the last w bars, counted one
    apart; of n > ``most`` values every ceil(n / most)-th, the first one on. Null below 6 values, where one isn't
    positive, or the fit isn't defined; the first in percent a day.

    Running sums over a symbol's values (of the log, its square, and its product with the value's number), kept apart for
    each stride and phase, make every fit a difference of two of them."""
    kept = rows.columns
    so_far = by_time().rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("__x", value).withColumn("__y", F.when(F.col("__x") > 0, F.ln("__x")))
    # Less the first log, so that the sums stay small.
    rows = rows.withColumn("__y", F.col("__y") - F.first("__y", ignorenulls=True).over(so_far))
    rows = rows.withColumns({"__rank": F.count("__x").over(so_far), "__bad": F.count_if(F.col("__x") <= 0).over(so_far)})
    y, rank = F.coalesce(F.when(F.col("__x").isNotNull(), F.col("__y")), F.lit(0.0)), F.col("__rank").cast("double")
    sums = {"__sy": y, "__syy": y * y, "__sry": y * rank}
    rows = rows.withColumns({c: F.sum(v).over(so_far) for c, v in sums.items()})
    rows = rows.withColumns({f"{c}0": F.coalesce(F.lag(c, w).over(by_time()), F.lit(0)) for c in ("__rank", "__bad", *sums)})
    n = F.col("__rank") - F.col("__rank0")
    rows = rows.withColumn("__n", n).withColumn("__stride", F.greatest(F.lit(1), F.ceil(F.col("__n") / most).cast("int")))
    rows = rows.withColumns({"__m": F.ceil(F.col("__n") / F.col("__stride")).cast("double"), **{f"{c}1": F.col(c) - F.col(f"{c}0") for c in sums}})
    if w > most:
        strided = F.when(F.col("__stride") > 1, F.col("__stride"))
        first = F.col("__rank0") + 1
        rows = rows.withColumns({
            "__asked": strided, "__low": first - F.col("__stride"), "__high": first + F.col("__stride") * (F.col("__m").cast("long") - 1),
        })
        # One row a stride, of which there are at most w / most.
        strides = rows.select(F.col("__asked").alias("stride")).where("stride is not null").distinct()
        values = rows.where("__x is not null").select("symbol", F.col("__rank").alias("rank"), "__y", F.explode(F.sequence(F.lit(2), F.lit(-(-w // most)))).alias("stride"))
        values = values.join(F.broadcast(strides), "stride", "left_semi")
        phase = Window.partitionBy("symbol", "stride", F.col("rank") % F.col("stride")).orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
        r = F.col("rank").cast("double")
        kept_sums = values.select(
            "symbol", "stride", "rank", F.sum("__y").over(phase).alias("__sy"), F.sum(F.col("__y") * F.col("__y")).over(phase).alias("__syy"),
            F.sum(F.col("__y") * r).over(phase).alias("__sry"),
        )
        for end in ("high", "low"):
            known = kept_sums.select(F.col("symbol").alias("__of"), F.col("stride").alias("__as"), F.col("rank").alias("__at"), *(F.col(c).alias(f"{c}_{end}") for c in sums))
            met = rows["symbol"].eqNullSafe(known["__of"]) & (rows["__asked"] == known["__as"]) & (rows[f"__{end}"] == known["__at"])
            rows = rows.join(known, met, "left").drop("__of", "__as", "__at")
        rows = rows.withColumns({
            f"{c}1": F.when(F.col("__asked").isNull(), F.col(f"{c}1")).otherwise(F.coalesce(f"{c}_high", F.lit(0.0)) - F.coalesce(f"{c}_low", F.lit(0.0))) for c in sums
        })
    m, stride = F.col("__m"), F.col("__stride")
    ok = (F.col("__n") >= 6) & (F.col("__bad") == F.col("__bad0")) & (m > 1)
    # A value's place in the fit is (its number - the first's) / stride.
    places = (F.col("__sry1") - (F.col("__rank0") + 1) * F.col("__sy1")) / stride
    rows = rows.withColumns({
        "__xy": F.when(ok, places - (m - 1) / 2 * F.col("__sy1")), "__xx": m * (m * m - 1) / 12,
        "__yy": F.when(ok, F.col("__syy1") - ratio(F.col("__sy1") * F.col("__sy1"), m)),
    })
    # What is left of equal values by rounding is no spread.
    spread = F.col("__yy") > F.greatest(F.lit(1e-18), F.col("__syy1") * 1e-13)
    return rows.withColumns({
        "trend": F.expm1(ratio(F.col("__xy"), F.col("__xx")) / stride * bars_per_day) * 100,
        "trend_r2": F.when(spread, F.least(F.lit(1.0), ratio(F.col("__xy") * F.col("__xy"), F.col("__xx") * F.col("__yy")))),
    }).select(*kept, "trend", "trend_r2")


# Chunks


def in_time_chunks(rows: DataFrame, compute: Callable[[DataFrame], DataFrame], back: int, step_seconds: int, bars: int | None = None, ahead: int = 0) -> DataFrame:
    """``compute`` of ``rows`` (symbol, open_time, ...), where its windows reach ``back`` bars back and ``ahead`` on, and
    it works symbol by symbol. Each chunk of ``bars`` bars (four times the reach) is a symbol of its own to it, with the
    bars it reaches besides, so that bars shuffle by symbol and chunk and no task holds a whole symbol. ``compute``
    must keep the columns symbol, open_time and __own."""
    bars = bars or 4 * max(1, back + ahead)
    number = F.floor(F.unix_seconds("open_time") / step_seconds)
    chunk = lambda n: F.floor(n / bars)
    reached = F.sequence(chunk(number - ahead), chunk(number + back))
    dealt = rows.withColumn("__chunk", F.explode(reached)).withColumn("__own", F.col("__chunk") == chunk(number))
    dealt = dealt.withColumn("symbol", F.struct(F.col("symbol").alias("name"), F.col("__chunk").alias("chunk"))).drop("__chunk")
    out = compute(dealt)
    return out.where("__own").withColumn("symbol", F.col("symbol.name")).drop("__own")
