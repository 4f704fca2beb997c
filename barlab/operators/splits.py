"""Universes, temporal splits, matched groups and rates."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ratio


def canonical_universe(pairs: DataFrame, quotes: list[str]) -> DataFrame:
    """``pairs``: symbol, base, quote, status, spot, trading, limit. Of the pairs that trade spot and take limit orders
    one for each base: the earliest quote of the list, then the symbol. Other columns stay, stable and leveraged bases
    too."""
    rank = F.array_position(F.array(*map(F.lit, quotes)), F.col("quote"))
    open_ = pairs.where((F.col("status") == "TRADING") & F.col("spot") & F.col("trading") & F.col("limit"))
    best = Window.partitionBy("base").orderBy("quote_rank", "symbol")
    return open_.withColumn("quote_rank", rank).where("quote_rank > 0").withColumn("n", F.row_number().over(best)).where("n = 1").drop("n")


def temporal_split(events: DataFrame, discovery: float = 70, validation: float = 15) -> DataFrame:
    """``events``: event_date. Whole dates go to discovery, validation or sealed_test by the number of events before the
    day against percents of all, the last two dates being kept for the later splits. With one or two dates these are
    discovery and validation. Where a day with very many events leaves no validation date, the last but one becomes it.
    Returns event_date, events, split."""
    if discovery <= 0 or validation <= 0 or discovery + validation >= 100:
        raise ValueError("percents must be positive and leave room for sealed_test")
    days = events.groupBy("event_date").agg(F.count(F.lit(1)).alias("events"))
    order, every = Window.orderBy("event_date"), Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rows = days.withColumns({
        "before": F.coalesce(F.sum("events").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
        "total": F.sum("events").over(every), "left": F.count(F.lit(1)).over(order.rowsBetween(0, Window.unboundedFollowing)),
        "n": F.count(F.lit(1)).over(every),
    })
    few = F.when(F.col("left") == F.col("n"), "discovery").otherwise("validation")
    many = (
        F.when((F.col("before") < F.col("total") * discovery / 100.0) & (F.col("left") > 2), "discovery")
        .when((F.col("before") < F.col("total") * (discovery + validation) / 100.0) & (F.col("left") > 1), "validation").otherwise("sealed_test")
    )
    rows = rows.withColumn("split", F.when(F.col("n") < 3, few).otherwise(many))
    none = F.max((F.col("split") == "validation").cast("int")).over(every) == 0
    repaired = F.when((F.col("n") >= 3) & none & (F.col("left") == 2), "validation").otherwise(F.col("split"))
    return rows.select("event_date", "events", repaired.alias("split"))


def split_summary(assigned: DataFrame) -> DataFrame:
    """Per split its first and last date, dates and events."""
    return assigned.groupBy("split").agg(
        F.min("event_date").alias("start_date"), F.max("event_date").alias("end_date"), F.count(F.lit(1)).alias("event_dates"), F.sum("events").alias("events"),
    )


def calendar_splits(days: DataFrame, assigned: DataFrame) -> DataFrame:
    """Every day with its split: up to the last date of discovery (the first day, without one), up to that of validation
    (as discovery's, without one), the rest. ``assigned``: event_date, split; one row of bounds meets the days."""
    last = lambda split: F.max(F.when(F.col("split") == split, F.col("event_date")))
    bounds = assigned.agg(last("discovery").alias("d"), last("validation").alias("v"))
    first = days.agg(F.min("day").alias("first"))
    ends = F.broadcast(bounds.join(F.broadcast(first)).select(F.coalesce("d", "first").alias("d"), F.coalesce("v", "d", "first").alias("v")))
    return days.join(ends).select(
        "day", F.when(F.col("day") <= F.col("d"), "discovery").when(F.col("day") <= F.col("v"), "validation").otherwise("sealed_test").alias("split")
    )


def valid_groups(samples: DataFrame, group: str, label: str) -> DataFrame:
    """Samples of groups with exactly one event and at least one control."""
    good = samples.groupBy(group).agg(F.count_if(F.col(label) == 1).alias("e"), F.count_if(F.col(label) == 0).alias("c")).where("e = 1 and c >= 1")
    return samples.join(good.select(group), group, "left_semi")


def rates(samples: DataFrame, split: str, label: str, signal: str) -> DataFrame:
    """Hits and rates of events and controls for each split and over all, and their ratio (infinite where only events
    hit)."""
    hit = lambda v: F.count_if((F.col(label) == v) & F.col(signal))
    size = lambda v: F.count_if(F.col(label) == v)
    out = samples.groupingSets([[split], []], split).agg(
        F.grouping(split).alias("overall"), size(1).alias("events"), size(0).alias("controls"), hit(1).alias("event_hits"), hit(0).alias("control_hits"),
    )
    out = out.withColumns({"event_rate": ratio(F.col("event_hits"), F.col("events")), "control_rate": ratio(F.col("control_hits"), F.col("controls"))})
    return out.withColumns({
        split: F.when(F.col("overall") == 1, "overall").otherwise(F.col(split)),
        "rate_ratio": F.when((F.col("control_rate") == 0) & (F.col("event_rate") > 0), F.lit(float("inf"))).otherwise(ratio(F.col("event_rate"), F.col("control_rate"))),
    }).drop("overall")


def away_from_events(candidates: DataFrame, events: DataFrame, seconds: int) -> DataFrame:
    """Candidates (symbol, at) that no known event (symbol, event_time) of the symbol is within ``seconds`` of: an anti
    join on time buckets, each candidate asking its own and both neighbours."""
    bucket = lambda c: F.floor(F.unix_seconds(c) / seconds)
    near = F.explode(F.array(*(bucket(F.col("at")) + d for d in (-1, 0, 1)))).alias("bucket")
    hit = candidates.select("symbol", "at", near).join(events.select("symbol", "event_time", bucket(F.col("event_time")).alias("bucket")), ["symbol", "bucket"])
    hit = hit.where(F.abs(F.unix_micros("at") - F.unix_micros("event_time")) < seconds * 1_000_000).select("symbol", "at").distinct()
    return candidates.join(hit, ["symbol", "at"], "left_anti")
