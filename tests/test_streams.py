import random

import pytest

from rippleframe.functions.adaptive import capped_step
from rippleframe.streaming import running


@pytest.mark.parametrize("provider", ["RocksDBStateStoreProvider", "HDFSBackedStateStoreProvider"])
def test_counts_go_on_from_batch_to_batch(spark, tmp_path, provider):
    rng = random.Random(3)
    rows = [(k % 7, k // 7, rng.choice([0, 1, 2, None]) if k % 7 else 1, rng.choice([0, 0, 0, 1, 2])) for k in range(900)]
    counts, expected = {}, {}
    for stream, seq, ctx, sym in rows:
        expected[stream, seq] = capped_step(counts.setdefault((stream, ctx), [1] * 3), sym, 16)
    kinds = "stream int, seq long, ctx int, sym int"
    for part in range(3):  # three batches, each upside down
        own = [r for r in rows if r[1] * 3 // 130 == part]
        spark.createDataFrame(own[::-1], kinds).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    name = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(name, f"org.apache.spark.sql.execution.streaming.state.{provider}")
    try:
        out = running.stream_adaptive_cost(spark.readStream.schema(kinds).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), 3, 16)
        run = out.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "state")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        run.awaitTermination()
    finally:
        spark.conf.unset(name)
    assert len([p for p in run.recentProgress if p.numInputRows]) == 3
    got = {(r.stream, r.seq): r.bits for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == expected
