"""Streams in several micro-batches against the same operators in batch."""

import numpy as np
import pandas as pd

from tickforge.operators import bars, labeling
from tickforge.operators.bars import InfoRule
from tickforge.streaming import events


def streamed(spark, frame, order, run, at):
    """The rows of run() over a stream that gets the frame in three files."""
    for k, part in enumerate(np.array_split(frame.sort_values(order), 3)):
        spark.createDataFrame(part).coalesce(1).write.mode("append").parquet(f"{at}/in/{k}")
    schema = spark.read.parquet(f"{at}/in/0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{at}/in")
    query = run(stream).writeStream.format("memory").queryName(at.name.replace("-", "_")).option("checkpointLocation", f"{at}/state").trigger(availableNow=True).start()
    query.awaitTermination(120)
    return sorted(map(tuple, spark.table(at.name.replace("-", "_")).collect()))


def test_information_bars(spark, tmp_path):
    r = np.random.default_rng(4)
    n = 600
    frame = pd.DataFrame({"symbol": "s", "seq": np.arange(1, n + 1), "us": np.arange(n) * 1000, "price": 100 + np.cumsum(r.integers(-1, 2, n)) * 0.5, "volume": r.integers(1, 9, n)})
    frame["dollar"] = frame["price"] * frame["volume"]
    rule = InfoRule("imbalance", "volume", warm_up=20, length_span=10, flow_span=20, least=3, most=60)
    want = bars.imbalance_bars(spark.createDataFrame(frame), "volume", warm_up=20, length_span=10, flow_span=20, least=3, most=60).select("symbol", "bar_seq", "us")
    assert streamed(spark, frame, "seq", lambda t: events.information_bars(t, rule), tmp_path) == sorted(map(tuple, want.collect())) != []


def test_cusum_events(spark, tmp_path):
    r = np.random.default_rng(5)
    n = 300
    frame = pd.DataFrame({"symbol": "s", "bar_seq": np.arange(n), "us": np.arange(n) * 1000, "close": np.exp(np.cumsum(r.normal(0, 0.01, n)))})
    want = labeling.cusum_filter(spark.createDataFrame(frame), 0.03).select("symbol", "bar_seq", "us")
    assert streamed(spark, frame, "bar_seq", lambda b: events.cusum_events(b, 0.03), tmp_path) == sorted(map(tuple, want.collect())) != []
