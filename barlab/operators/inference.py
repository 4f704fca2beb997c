"""Seeded permutation and bootstrap inference. Every draw is a hash of seed, iteration and place, so draws need no state,
run on any task and repeat after a retry."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio


#: So many iterations of a class are drawn in one row's turn.
_BLOCK = 500


def draw(n: Column, *names: Column | int) -> Column:
    """A number from 0 to n - 1."""
    name = F.md5(F.concat_ws(":", *(F.lit(x) if isinstance(x, int) else x.cast("string") for x in names)))
    return F.conv(F.substring(name, 1, 8), 16, 10).cast("long") % n


def binomial_steps(n: int, p: float) -> tuple[int, np.ndarray]:
    """The least number of hits worth a thought and the cumulative chances from there on: all of them, or, of many groups,
    those within 40 deviations of the mean (what lies beyond is less than a double can add)."""
    spread = 40 * math.sqrt(n * p * (1 - p)) + 1
    low, high = max(0, math.floor(n * p - spread)), min(n, math.ceil(n * p + spread))
    k = np.arange(low, high, dtype=float)
    steps = np.concatenate([[0.0], np.cumsum(np.log((n - k) / (k + 1)) + math.log(p / (1 - p)))])
    chances = np.exp(steps - steps.max())
    return low, np.cumsum(chances) / chances.sum()


#: Where all signals of a group are equal, every draw gives the same.
_MIXED = "hits > 0 and hits < size"


def _groups(samples: DataFrame, *more: Column) -> DataFrame:
    event = F.max(F.when(F.col("label") == 1, F.col("signal"))).alias("event")
    return samples.groupBy("match_group").agg(event, F.sum("signal").alias("hits"), F.count(F.lit(1)).alias("size"), *more)


def _tested(groups: DataFrame, sums: DataFrame, iterations: int) -> DataFrame:
    """``sums``: i, drawn (hits that iteration i drew from the groups whose signals differ)."""
    same = F.when((F.col("hits") > 0) & (F.col("hits") == F.col("size")), 1).otherwise(0)
    totals = groups.agg(F.sum("event").alias("e0"), F.sum(same).alias("fixed"), F.sum("hits").alias("h"), F.sum("size").alias("n"), F.count(F.lit(1)).alias("g")).where("g > 0")
    every = groups.sparkSession.range(iterations + 1).select(F.col("id").cast("int").alias("i")).join(sums, "i", "left").crossJoin(F.broadcast(totals))
    every = every.withColumn("e", F.when(F.col("i") == 0, F.col("e0")).otherwise(F.col("fixed") + F.coalesce("drawn", F.lit(0))))
    stats = every.select("i", (ratio(F.col("e"), F.col("g")) - ratio(F.col("h") - F.col("e"), F.col("n") - F.col("g"))).alias("d"))
    observed = stats.where("i = 0").select(F.col("d").alias("observed"))
    return stats.where("i > 0").crossJoin(F.broadcast(observed)).groupBy("observed").agg(
        F.count_if(F.col("d") >= F.col("observed") - 1e-12).alias("exceed"), F.count(F.lit(1)).alias("iterations")
    ).withColumn("p_value", (F.col("exceed") + 1) / (F.col("iterations") + 1))


def permutation_test(samples: DataFrame, iterations: int, seed: int) -> DataFrame:
    """``samples``: match_group, label (one event, 1, in each group), signal (0 or 1), id. The event label moves to a
    drawn member of each group; one row: observed difference of event and control rates, the number of iterations that
    reach it, and p = (that + 1) / (iterations + 1).

    The statistic asks only in how many groups the label falls on a hit. Groups with as many hits of as many members are
    alike, and how many of them hit is binomial, so an iteration takes one number for each class of groups (a hash of seed,
    iteration and class, through the binomial's steps), however many groups there are."""
    groups = _groups(samples)
    classes = groups.where(_MIXED).groupBy(F.col("hits").cast("long").alias("hits"), F.col("size").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("many"))
    blocks = classes.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((iterations - 1) // _BLOCK)))).repartition("hits", "size", "block")

    def draws(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for hits, size, many, block in zip(*(c.to_pylist() for c in batch.columns)):
                low, steps = binomial_steps(many, hits / size)
                own = range(block * _BLOCK + 1, min((block + 1) * _BLOCK, iterations) + 1)
                at = [int(hashlib.md5(f"{seed}:{i}:{hits}:{size}".encode()).hexdigest()[:8], 16) / 4294967296 for i in own]
                drawn = low + np.minimum(np.searchsorted(steps, at, side="right"), len(steps) - 1)
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int32()), pa.array(drawn, pa.int64())], ["i", "drawn"])

    sums = blocks.mapInArrow(draws, "i int, drawn long").groupBy("i").agg(F.sum("drawn").alias("drawn"))
    return _tested(groups, sums, iterations)


def member_permutation_test(samples: DataFrame, iterations: int, seed: int) -> DataFrame:
    """As ``permutation_test``, drawing a member of every group in every iteration (a hash of seed, iteration and group, in
    the order of ids), so its work is groups by iterations."""
    signals = F.transform(F.sort_array(F.collect_list(F.struct("id", "signal"))), lambda s: s["signal"]).alias("signals")
    groups = _groups(samples, signals)
    # Dealt out by number, as few groups are much work.
    dealt = groups.where(_MIXED).select("match_group", "signals", "size").repartition(int(samples.sparkSession.conf.get("spark.sql.shuffle.partitions")), "match_group")
    rows = dealt.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(iterations))))
    chosen = F.get("signals", draw(F.col("size"), seed, F.col("i"), F.col("match_group")).cast("int"))
    return _tested(groups, rows.groupBy("i").agg(F.sum(chosen).alias("drawn")), iterations)


def cluster_bootstrap(trades: DataFrame, iterations: int, seed: int, by: tuple[str, ...] = ()) -> DataFrame:
    """``trades``: symbol, net_pnl and the columns of ``by``. Resamples symbols; 2.5, 50 and 97.5 % quantiles of the pooled
    mean (for each group of ``by``; with fewer than two symbols it has none)."""
    sums = trades.groupBy(*by, "symbol").agg(F.sum("net_pnl").alias("total"), F.count("net_pnl").alias("n"))
    placed, draws = _resampled(sums, iterations, seed, by)
    means = draws.join(placed, [*by, "at"]).where("many > 1").groupBy(*by, "i").agg(ratio(F.sum("total"), F.sum("n").cast("double")).alias("m"))
    quantile = lambda q: F.percentile("m", F.lit(q))
    return means.groupBy(*by).agg(quantile(0.025).alias("low"), quantile(0.5).alias("middle"), quantile(0.975).alias("high"), F.count("m").alias("iterations"))


def _resampled(clusters: DataFrame, iterations: int, seed: int, by: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """One row a symbol with its place, and the places drawn in each iteration, as many as there are symbols."""
    own = Window.partitionBy(*by)
    placed = clusters.withColumns({"at": F.row_number().over(own.orderBy("symbol")) - 1, "many": F.count(F.lit(1)).over(own)})
    draws = placed.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(iterations)))).select(*by, "i", draw(F.col("many"), seed, F.col("i"), F.col("at")).alias("at"))
    return placed, draws


def cluster_ratio_interval(samples: DataFrame, iterations: int, seed: int, least: int = 100) -> DataFrame:
    """``samples``: symbol, label, signal (0 or 1). Resamples symbols; 2.5 and 97.5 % quantiles of the pooled ratio of
    event and control rates. Draws without events or controls are skipped, and so are infinite ratios, which pulls both
    bounds down; their number stands beside. Null below two symbols or ``least`` finite ratios."""
    of = lambda label, value: F.sum(F.when(F.col("label") == label, value).otherwise(0))
    clusters = samples.where("symbol is not null").groupBy("symbol").agg(
        of(1, F.col("signal")).alias("eh"), of(1, F.lit(1)).alias("e"), of(0, F.col("signal")).alias("ch"), of(0, F.lit(1)).alias("c")
    )
    placed, draws = _resampled(clusters, iterations, seed)
    pooled = draws.join(placed, "at").where("many > 1").groupBy("i").agg(*(F.sum(c).alias(c) for c in ("eh", "e", "ch", "c"))).where("e > 0 and c > 0")
    value = F.when(F.col("ch") > 0, (F.col("eh") / F.col("e")) / (F.col("ch") / F.col("c")))
    found = pooled.select(value.alias("r"), ((F.col("ch") == 0) & (F.col("eh") > 0)).alias("infinite"))
    enough = F.count("r") >= least
    return found.agg(
        F.when(enough, F.percentile("r", F.lit(0.025))).alias("low"), F.when(enough, F.percentile("r", F.lit(0.975))).alias("high"),
        F.count("r").alias("finite"), F.count_if("infinite").alias("infinite"),
    )
