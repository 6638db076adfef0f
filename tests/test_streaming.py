"""Live positions: state across micro-batches, and streams that end."""

from __future__ import annotations

from routeloom.streaming import live

BATCHES = [
    [(1, "2026-07-01 12:00:00", 0.0, 0.0), (1, "2026-07-01 12:00:10", 0.001, 0.0), (2, "2026-07-01 12:00:05", 1.0, 1.0)],
    [(1, "2026-07-01 12:01:20", 0.002, 0.0)],
    [(2, "2026-07-01 15:00:00", 1.0, 1.0)],
    [(1, "2026-07-01 15:30:00", 0.002, 0.0), (1, "2026-07-01 11:00:00", 9.0, 9.0)],
]


def _source(spark, tmp_path):
    src = str(tmp_path / "in")
    for part in BATCHES:
        df = spark.createDataFrame(part, "file_id long, t string, lat double, lon double")
        df.withColumn("t", df.t.cast("timestamp")).coalesce(1).write.mode("append").parquet(src)
    schema = spark.read.parquet(src).schema
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(src)


def test_hops_and_lost_state(spark, tmp_path):
    """The hop crosses batches; a device that was silent for over an hour starts anew; a late position is dropped."""
    stream = _source(spark, tmp_path)
    q = live.write(live.latest_hops(stream()), str(tmp_path / "hops"), str(tmp_path / "c1"), every=None)
    try:
        assert q.awaitTermination(180), "the stream has to end by itself"
    finally:
        q.stop()
    got = {(r["file_id"], str(r["t"])[11:]): r for r in spark.read.parquet(str(tmp_path / "hops")).collect()}
    assert len(got) == 6 and (1, "11:00:00") not in got
    assert abs(got[1, "12:00:10"]["dist_prev_m"] - 111.19) < 0.1 and abs(got[1, "12:00:10"]["speed_kmh"] - 40.03) < 0.1
    assert abs(got[1, "12:01:20"]["dist_prev_m"] - 111.19) < 0.1
    assert got[2, "12:00:05"]["dist_prev_m"] == 0 and got[2, "12:00:05"]["speed_kmh"] != got[2, "12:00:05"]["speed_kmh"] or got[2, "12:00:05"]["speed_kmh"] is None


def test_windows(spark, tmp_path):
    stream = _source(spark, tmp_path)
    q = live.activity(stream()).writeStream.outputMode("update").format("memory").queryName("activity").option("checkpointLocation", str(tmp_path / "c2")).trigger(availableNow=True).start()
    try:
        assert q.awaitTermination(180)
        assert sum(r["n_points"] for r in spark.table("activity").collect()) >= 5
    finally:
        q.stop()
