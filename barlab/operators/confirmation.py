"""Populations of matched groups, and the checks that a hypothesis must pass on them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import DURATION_BANDS, holds, ratio
from .splits import rates, valid_groups


def baseline_population(rows: DataFrame, hypothesis: str) -> DataFrame:
    """Baseline rows that count for a hypothesis: offset 0, quality pass, liquid, not contaminated, the hypothesis known,
    which becomes the signal."""
    kept = (F.col("offset") == 0) & (F.col("quality") == "pass") & holds(F.col("liquid")) & ~holds(F.col("contaminated")) & F.col(hypothesis).isNotNull()
    return rows.where(kept).withColumn("signal", F.col(hypothesis))


def matched_population(events: DataFrame, controls: DataFrame) -> DataFrame:
    """``events`` and ``controls``: match_group, label, quality, signal and more, in the same columns. Rows of quality pass
    with a known signal, controls of such events alone, in groups of one event and at least one control."""
    good = lambda rows: rows.where((F.col("quality") == "pass") & F.col("signal").isNotNull())
    known = good(events)
    own = good(controls).join(known.select("match_group").distinct(), "match_group", "left_semi")
    return valid_groups(known.unionByName(own), "match_group", "label")


def band_rates(samples: DataFrame, band: str = "band", label: str = "label", signal: str = "signal") -> DataFrame:
    """Events, controls, hits and rates of every duration band (with 0 where it has none), and whether the events' rate is
    above the controls'."""
    of = lambda v, c: F.count_if((F.col(label) == v) & c)
    found = samples.groupBy(F.col(band).alias("band")).agg(
        of(1, F.lit(True)).alias("events"), of(1, F.col(signal)).alias("event_hits"), of(0, F.lit(True)).alias("controls"), of(0, F.col(signal)).alias("control_hits"),
    )
    every = samples.sparkSession.createDataFrame([(name,) for name, _ in DURATION_BANDS], "band string")
    out = every.join(found, "band", "left").fillna(0)
    out = out.withColumns({"event_rate": ratio(F.col("event_hits"), F.col("events")), "control_rate": ratio(F.col("control_hits"), F.col("controls"))})
    return out.withColumn("positive_direction", holds(F.col("event_rate") > F.col("control_rate")))


def split_results(samples: DataFrame) -> DataFrame:
    """Rates by split and overall, and how many symbols have an event that hit."""
    hit = samples.where((F.col("label") == 1) & F.col("signal"))
    symbols = hit.groupingSets([["split"], []], "split").agg(F.grouping("split").alias("g"), F.count_distinct("symbol").alias("symbols_hit"))
    symbols = symbols.select(F.when(F.col("g") == 1, "overall").otherwise(F.col("split")).alias("split"), "symbols_hit")
    return rates(samples, "split", "label", "signal").join(symbols, "split", "left").fillna(0, ["symbols_hit"])


#: What a hypothesis must reach.
FLOORS = {
    "events": 25, "event_rate": 0.30, "control_rate": 0.30, "rate_ratio": 1.5, "p_value": 0.05, "symbols_hit": 8, "interval_low": 1.0,
    "validation": True, "sealed_test": True, "bands": 2, "band_events": 5,
}
#: The same for the first hypothesis alone, without interval, validation and bands.
FIRST_FLOORS = {"events": 15, "event_rate": 0.25, "control_rate": 0.15, "rate_ratio": 2.0, "p_value": 0.05, "symbols_hit": 5, "sealed_test": True}


def acceptance(results: DataFrame, p_value: DataFrame, floors: dict, interval: DataFrame | None = None, bands: DataFrame | None = None) -> DataFrame:
    """One row: a boolean for each check that ``floors`` names, passed and the failed ones' names. ``results`` of
    split_results, ``p_value`` (p_value) of a permutation test, ``interval`` (low) of a bootstrap, ``bands`` of
    band_rates. What is missing fails. All inputs are single rows or a few, so they meet in one."""
    of = lambda split, c: F.max(F.when(F.col("split") == split, F.col(c)))
    row = results.agg(
        *(of("overall", c).alias(c) for c in ("events", "event_rate", "control_rate", "rate_ratio", "symbols_hit")),
        *((of(split, "event_rate") > of(split, "control_rate")).alias(split) for split in ("validation", "sealed_test")),
    ).join(F.broadcast(p_value.agg(F.max("p_value").alias("p_value"))))
    if interval is not None:
        row = row.join(F.broadcast(interval.agg(F.max("low").alias("interval_low"))))
    if bands is not None:
        row = row.join(F.broadcast(bands.agg(F.count_if(F.col("positive_direction") & (F.col("events") >= floors["band_events"])).alias("bands"))))

    def check(name: str) -> Column:
        floor = floors[name]
        if floor is True:
            return holds(F.col(name))
        if name in ("control_rate", "p_value"):
            return holds(F.col(name) <= floor)
        return holds(F.col(name) > floor if name == "interval_low" else F.col(name) >= floor)

    known = {name: check(name) for name in floors if name != "band_events"}
    failed = F.array_compact(F.array(*(F.when(~c, F.lit(k)) for k, c in known.items())))
    return row.select(*(c.alias(f"{k}_ok") for k, c in known.items()), (F.size(failed) == 0).alias("passed"), F.concat_ws(",", failed).alias("failed"))
