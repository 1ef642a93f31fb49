"""The streaming monitor equals the batch computation on the same rows."""

import datetime as dt

from probity.streaming import monitor


def test_stream_equals_batch(spark, tmp_path):
    base = dt.datetime(2024, 1, 1)
    rows = [(i, base + dt.timedelta(hours=5 * i), float(i % 17), i % 2, (i // 2) % 2, (i % 10) / 10.0)
            for i in range(120)]
    df = spark.createDataFrame(rows, "id long, ts timestamp, f1 double, y int, yh int, p double")
    src = tmp_path / "src"
    df.write.parquet(str(src))
    edges, shares = monitor.reference_profile(df, "f1")
    batch = {r["slice"]: tuple(r) for r in monitor.slice_metrics(df, "ts", "f1", edges, shares).collect()}
    name = monitor.run_monitor(spark, str(src), df.schema, lambda s: s, "ts", "f1", edges, shares,
                               checkpoint=str(tmp_path / "ckpt"))
    stream = {r["slice"]: tuple(r) for r in spark.table(name).collect()}
    assert stream == batch
    assert sum(v[1] for v in batch.values()) == 120
