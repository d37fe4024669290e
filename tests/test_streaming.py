"""Streams over folders of JSON lines, run to their present end."""

import json

import pandas as pd

from loamwork.streaming import log

SCHEMA = "batch_digest string, status string, ts timestamp, value double"


def write(folder, name, rows):
    folder.mkdir(exist_ok=True)
    text = "\n".join(json.dumps(dict(zip(("batch_digest", "status", "ts", "value"), r, strict=True))) for r in rows)
    (folder / name).write_text(text, encoding="utf-8")


def test_ingest_is_repeatable_and_keeps_last_entries(spark, tmp_path):
    source, out, marks = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "marks")
    stream = lambda: spark.readStream.schema(SCHEMA).json(str(source))
    write(source, "1.json", [("a", "error", "2024-01-01T00:00:00", 1.0), ("a", "ok", "2024-01-01T01:00:00", 2.0), ("b", "error", "2024-01-01T00:00:00", 3.0)])
    log.ingest(stream(), out, marks).awaitTermination()
    write(source, "2.json", [("b", "ok", "2024-01-02T00:00:00", 4.0)])
    for _ in range(2):  # the second run has nothing new
        log.ingest(stream(), out, marks).awaitTermination()
    rows = spark.read.parquet(out)
    assert sorted((r.batch_digest, r.status, r.value) for r in rows.collect()) == [("a", "ok", 2.0), ("b", "error", 3.0), ("b", "ok", 4.0)]
    assert sorted((r.batch_digest, r.value) for r in log.latest(rows).collect()) == [("a", 2.0), ("b", 4.0)]
    batches = spark.createDataFrame([("a",), ("c",)], "batch_digest string")
    assert [r.batch_digest for r in log.pending(batches, rows).collect()] == ["c"]


def test_a_batch_that_runs_again_replaces_its_folder(spark, tmp_path):
    sink = log.upsert_sink(str(tmp_path / "out"), "batch_digest", "ts")
    for value in (1.0, 5.0):
        sink(spark.createDataFrame([("a", value, 1)], "batch_digest string, value double, ts int"), 7)
    assert [(r.value, r.batch) for r in spark.read.parquet(str(tmp_path / "out")).collect()] == [(5.0, 7)]


def test_stream_without_repeats_and_its_windows(spark, tmp_path):
    source = tmp_path / "in"
    write(source, "1.json", [("a", "ok", "2024-01-01T00:00:00", 1.0), ("a", "ok", "2024-01-01T00:10:00", 9.0), ("b", "ok", "2024-01-01T05:00:00", 3.0), ("z", "ok", "2024-02-01T00:00:00", 0.0)])
    stream = spark.readStream.schema(SCHEMA).json(str(source))
    once = log.deduplicated(stream, "batch_digest", "ts").writeStream.format("memory").queryName("once_rows").trigger(availableNow=True).start()
    once.awaitTermination()
    assert sorted(r.batch_digest for r in spark.table("once_rows").collect()) == ["a", "b", "z"]
    counts = log.windowed_counts(stream, "ts", "status", "value").writeStream.format("memory").queryName("count_rows").outputMode("append").trigger(availableNow=True).start()
    counts.awaitTermination()
    assert [(r.status, r.n, round(r["mean"], 6)) for r in spark.table("count_rows").collect()] == [("ok", 3, round(13 / 3, 6))]


def test_an_injected_scorer(spark):
    def score(frames):
        for frame in frames:
            yield pd.DataFrame({"batch_digest": frame.batch_digest, "value": frame.value * 2})

    rows = spark.createDataFrame([("a", 1.5)], "batch_digest string, value double")
    assert [tuple(r) for r in log.scored(rows, score, "batch_digest string, value double").collect()] == [("a", 3.0)]
