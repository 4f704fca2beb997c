import math
import random
import time
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from barlab.operators import signals
from barlab.plans import signals_study
from barlab.sources import trades as src
from barlab.streaming.bars import stream_bars
from barlab.streaming.signals import stream_entry_signals


def test_streamed_bars_equal_batch_bars(spark, tmp_path):
    t0 = datetime(2024, 1, 1)
    rows = [("AB"[i % 2], i, t0 + timedelta(seconds=17 * i), 100.0 + i % 7, 1.0 + i % 3, i % 4 == 0) for i in range(300)]
    tape = spark.createDataFrame(rows, "symbol string, trade_id long, ts timestamp, price double, qty double, is_buyer_maker boolean")
    tape.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = stream_bars(spark.readStream.schema(tape.schema).parquet(f"{tmp_path}/in"), late="5 minutes")
    query = stream.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination(120)
    last = max(r[2] for r in rows) - timedelta(minutes=5)
    want = {tuple(r) for r in src.bars(tape, "minute").collect() if r.open_time + timedelta(minutes=1) <= last}
    assert want and {tuple(r) for r in spark.read.parquet(f"{tmp_path}/out").collect()} == want


def test_streamed_signals_equal_batch_signals(spark, tmp_path):
    """Bars of three symbols with gaps, some of them long, in several batches of unequal length."""
    rng = random.Random(3)
    t0, rows = datetime(2024, 1, 1), []
    for symbol in "ABC":
        price, gone = 100.0, 0
        for i in range(500):
            price *= math.exp(rng.gauss(0, 0.02))
            gone = 30 if symbol == "B" and i in (200, 330) else max(0, gone - 1)
            if gone or rng.random() < 0.03:
                continue
            rows.append((symbol, t0 + timedelta(hours=i), price * 0.999, price * (1 + rng.random() / 100), price * (1 - rng.random() / 100), price, 10.0, 50.0 + rng.random() * 60, rng.randrange(3, 12), 5.0))
    schema = "symbol string, open_time timestamp, open double, high double, low double, close double, volume double, quote_volume double, trade_count long, taker_buy_quote double"
    bars = spark.createDataFrame(rows, schema)
    rule = signals_study.RULE | {
        "deep": 9, "long": 9, "day": 24, "refs": 5, "median": 10.0, "quote": 100.0, "trades": 10, "ttl": 10, "rise": 3.0, "long_clock": 0.9, "t5_runup": 2.0, "t5_drawdown": -1.0,
    }
    for k, (a, b) in enumerate([(0, 10), (10, 205), (205, 206), (206, 360), (360, 500)]):
        part = bars.where((F.col("open_time") >= F.lit(t0 + timedelta(hours=a))) & (F.col("open_time") < F.lit(t0 + timedelta(hours=b))))
        part.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        time.sleep(0.05 * (k < 4))
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        found = stream_entry_signals(stream, rule, 3600, 5 * 3600)
        query = found.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start()
        query.awaitTermination(200)
        assert query.exception() is None
    finally:
        spark.conf.unset(name)
    batch = signals.entry_signals(src.dense_grid(bars), rule).where("e1_edge or e2_edge")
    columns = ["symbol", "open_time", "close", "components", "t3", "t4", "t5", "e1_edge", "e2_edge", "armed_recent"]
    want = sorted(tuple(r[c] for c in columns) for r in batch.collect())
    got = spark.read.parquet(f"{tmp_path}/out").collect()
    assert sorted(tuple(r[c] for c in columns) for r in got) == want and len(want) > 20 and any(r[8] for r in want) and any(not r[7] for r in want)
    activity = {(r.symbol, r.open_time): r.activity for r in batch.collect()}
    assert all(abs(r.activity - activity[r.symbol, r.open_time]) < 1e-9 for r in got)
    chosen = signals.select_greedily(batch.withColumn("decision_time", F.expr("open_time + interval 1 hour")), 5 * 3600, 10_000).collect()
    assert {(r.symbol, r.decision_time - timedelta(hours=1), r.decision != "selected") for r in chosen} == {(r.symbol, r.open_time, r.rested) for r in got}
