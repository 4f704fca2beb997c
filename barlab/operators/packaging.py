"""What goes out: windows cut before a moment, packages by size or split, exports in order."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import holds


def first_fit_chunks(sizes: DataFrame, target_bytes: int) -> DataFrame:
    """``sizes``: symbol, bytes. Symbols in order go into one chunk until the next would take it over the target; a larger
    symbol has a chunk of its own. Adds chunk, from 0. One ordered fold over a row a symbol."""
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chunk, held, any_ = 0, 0, False
        for batch in batches:
            out = []
            for n in batch["bytes"]:
                if any_ and held + n > target_bytes:
                    chunk, held = chunk + 1, 0
                out.append(chunk)
                held, any_ = held + n, True
            yield batch.assign(chunk=out)

    rows = sizes.select("symbol", F.col("bytes").cast("long").alias("bytes")).repartition(1).sortWithinPartitions("symbol")
    return rows.mapInPandas(fold, "symbol string, bytes long, chunk int")


def pre_cross_rows(events: DataFrame, rows: DataFrame, time: str) -> DataFrame:
    """``events``: event_id, symbol, event_date, cross_time. Rows of the event's symbol and UTC day strictly before its
    crossing: an equi-join on symbol and day."""
    own = events.select("event_id", "symbol", F.col("event_date").alias("day_"), "cross_time")
    dated = rows.withColumn("day_", F.to_date(time))
    return own.join(dated, ["symbol", "day_"]).where(F.col(time) < F.col("cross_time")).drop("day_")


def prior_day_archives(events: DataFrame, days: int) -> DataFrame:
    """The days before each event's whose archives go with it: event_id, symbol, day."""
    return events.select("event_id", "symbol", F.explode(F.expr(f"sequence(date_sub(event_date, {days}), date_sub(event_date, 1))")).alias("day"))


def bundle_manifest(events: DataFrame, days: int, tables: dict[str, DataFrame]) -> DataFrame:
    """Per event and role the rows that its bundle holds; a role without rows stands with 0."""
    wanted = events.select("event_id", F.explode(F.array(*(F.lit(r) for r in tables))).alias("role"))
    counts = None
    for role, rows in tables.items():
        own = rows.groupBy("event_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("role", F.lit(role))
        counts = own if counts is None else counts.unionByName(own)
    return wanted.join(counts, ["event_id", "role"], "left").fillna(0, ["rows"]).withColumn("prior_days", F.lit(days))


def normalised_reference(frame: DataFrame, symbol: str | None, columns: list[str]) -> DataFrame:
    """A reference series with its symbol first, whatever it was, and the columns in a fixed order; missing ones null."""
    named = frame.withColumn("symbol", F.lit(symbol)) if symbol is not None else frame
    return named.select("symbol", "open_time", *(F.col(c) if c in frame.columns else F.lit(None).cast("double").alias(c) for c in columns), "observed")


#: What the columns of bar packages mean.
MEANINGS = {
    "symbol": "trading pair", "open_time": "start of the bar, UTC", "open": "first price", "high": "highest price", "low": "lowest price", "close": "last price",
    "volume": "base units traded", "quote_volume": "quote units traded", "trade_count": "number of trades", "taker_buy_base": "base units bought by takers",
    "taker_buy_quote": "quote units bought by takers", "observed": "false where the bar is missing: its values are null, never filled in",
    "relative_bar": "bars from the anchor, below zero before it", "label": "1 for an event, 0 for a control",
}


def data_dictionary(rows: DataFrame) -> DataFrame:
    """A row a column of ``rows``, in order: position, column, type and what it means (null where that isn't known)."""
    found = [(i, f.name, f.dataType.simpleString(), MEANINGS.get(f.name)) for i, f in enumerate(rows.schema.fields)]
    return rows.sparkSession.createDataFrame(found, "position int, column string, type string, meaning string")


def universe_audit(grid: DataFrame, samples: DataFrame) -> DataFrame:
    """Per symbol of the grid: bars, observed bars, first and last of them, and its samples."""
    bars = grid.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.count_if("observed").alias("observed_bars"), F.min(F.when(F.col("observed"), F.col("open_time"))).alias("first_seen"),
        F.max(F.when(F.col("observed"), F.col("open_time"))).alias("last_seen"),
    )
    return bars.join(samples.groupBy("symbol").agg(F.count(F.lit(1)).alias("samples")), "symbol", "left").fillna(0, ["samples"])


def write_by_split(rows: DataFrame, path: str) -> DataFrame:
    """Writes one folder a split, with sealed marking the one that isn't to be opened, and returns the rows as read."""
    rows.withColumn("sealed", F.col("split") == "sealed_test").write.option("compression", "zstd").partitionBy("split").parquet(path)
    return rows.sparkSession.read.parquet(path)


def export(rows: DataFrame, order: list[str], condition: Column | None = None) -> DataFrame:
    """Rows for a CSV export: those that meet the condition, columns by name, in order."""
    kept = rows if condition is None else rows.where(condition)
    return kept.select(*sorted(kept.columns)).orderBy(*order)


def daily_bars(bars: DataFrame) -> DataFrame:
    """Bars of UTC days from finer ones: OHLC, volume, quote volume, trades, taker quote."""
    known = bars.where("close is not null")
    return known.groupBy("symbol", F.to_date("open_time").alias("day")).agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"),
        F.sum("volume").alias("volume"), F.sum("quote_volume").alias("quote_volume"), F.sum("trade_count").alias("trade_count"), F.sum("taker_buy_quote").alias("taker_buy_quote"),
    )


def reference_package(grid: DataFrame, samples: DataFrame, references: list[str], path: str) -> DataFrame:
    """Writes a reference package below ``path``: reference_data (the references' bars, a folder a symbol), universe_daily_data
    (daily bars of all symbols) and universe_symbols (their audit). Returns part, symbol and rows of what is there."""
    columns = ["open", "high", "low", "close", "volume", "quote_volume", "trade_count", "taker_buy_quote"]
    parts = {
        "reference_data": normalised_reference(grid.where(F.col("symbol").isin(references)), None, columns), "universe_daily_data": daily_bars(grid),
        "universe_symbols": universe_audit(grid, samples),
    }
    found = None
    for name, rows in parts.items():
        by = ["symbol"] if name == "reference_data" else []
        rows.write.option("compression", "zstd").partitionBy(*by).parquet(f"{path}/{name}")
        read = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/{name}")
        own = read.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("part"), "symbol", "rows")
        found = own if found is None else found.unionByName(own)
    return found


def evidence_issues(scans: DataFrame, cutoff: str, least: int = 480) -> DataFrame:
    """``scans``: window_minutes, guard_before, guard_after, start_date, end_date (days). Adds issues, what keeps each from being
    fresh evidence: guards below ``least`` minutes, another window than that, no explicit days, an end after the cutoff."""
    short = lambda c: ~holds(F.col(c) >= least)
    explicit = F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
    found = {
        "guard_before": short("guard_before"), "guard_after": short("guard_after"), "window": ~holds(F.col("window_minutes") == least), "explicit_window": ~explicit,
        "cutoff": explicit & (F.col("end_date") > F.lit(cutoff).cast("date")),
    }
    return scans.withColumn("issues", F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in found.items()))))
