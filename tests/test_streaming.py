"""The streaming reducer gives what the batch reducer gives."""

from __future__ import annotations

from quirework.streaming import events as E


def test_reducer(spark, tmp_path):  # noqa: ANN001, ANN201
    rows = [(1, 10, 1, 1.0, "delta"), (1, 11, 2, 2.0, "delta"), (1, 11, 2, 2.0, "delta"), (1, 12, 3, 4.0, "final"), (1, 13, 4, 8.0, "delta"), (2, 20, 1, 1.0, "delta")]
    schema = "key long, event_id long, sequence long, value double, event_type string"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = E.reduce_stream(stream, "final").writeStream.format("memory").queryName("reduced").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {(r.key, r.event_id, r.total) for r in spark.table("reduced").collect()}
    assert got == {(1, 10, 1.0), (1, 11, 3.0), (1, 12, 7.0), (2, 20, 1.0)}


def test_late_rows_are_dropped_as_in_batch(spark, tmp_path):  # noqa: ANN001, ANN201
    """Sequence 1 arrives after 2 within one batch: neither reducer takes it."""
    rows = [(1, 11, 2, 2.0, "delta", 1), (1, 10, 1, 1.0, "delta", 2), (1, 12, 3, 4.0, "delta", 3), (2, 20, 5, 1.0, "delta", 4)]
    schema = "key long, event_id long, sequence long, value double, event_type string, arrival long"
    given = spark.createDataFrame(rows, schema).coalesce(1)
    given.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = E.reduce_stream(stream, "final").writeStream.format("memory").queryName("late").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    ends: dict[int, float] = {}
    for r in spark.table("late").collect():
        ends[r.key] = max(ends.get(r.key, 0.0), r.total)
    assert ends == {r["key"]: r["total"] for r in E.reduce_batch(given, "key", "sequence", "value").collect()} == {1: 6.0, 2: 1.0}
