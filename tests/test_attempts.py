"""Attempts with backoff against a scorer that fails, and a log with several writers."""

import threading

from loamwork.streaming import attempts


def scorer():
    """Batches ending in 9 never succeed, those ending in 7 do not in the first run."""

    def failing(row):
        if row["batch_digest"].endswith("9") or (row["batch_digest"].endswith("7") and row["first"]):
            raise RuntimeError("no answer")
        return {"label": row["batch_digest"].upper()}

    return failing


def batches(spark, first):
    rows = [(f"b{i}", first) for i in range(20)] + [("b3", first)]
    return spark.createDataFrame(rows, "batch_digest string, first boolean").repartition(4)


def test_pauses_grow_to_the_longest():
    assert [attempts.pause(k) for k in range(1, 6)] == [2, 4, 8, 12, 12]


def test_no_entry_is_lost_or_doubled(spark, tmp_path):
    path = str(tmp_path / "log")
    quick = {"longest": 0.0}
    attempts.resumed(batches(spark, True), path, scorer(), **quick)
    first = {r.batch_digest: r for r in attempts.entries(spark, path).collect()}
    assert len(first) == 20 and {d for d, r in first.items() if r.status == "failed"} == {"b9", "b19", "b7", "b17"}
    assert all(r.attempts == (5 if r.status == "failed" else 1) and (r.error is None) == (r.status == "ok") for r in first.values())
    writers = [threading.Thread(target=attempts.resumed, args=(batches(spark, False), path, scorer()), kwargs=quick) for _ in range(3)]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    after = {r.batch_digest: r for r in attempts.entries(spark, path).collect()}
    assert len(after) == 20 and {d for d, r in after.items() if r.status == "failed"} == {"b9", "b19"}
    assert all(after[d].run == r.run for d, r in first.items() if r.status == "ok")  # a success is never scored again
    assert spark.read.schema(f"{attempts.ENTRY}, run string").json(path).where("run > ''").select("run").distinct().count() == 4


def test_attempts_wait_between_failures_alone(spark):
    seen = attempts.attempted(batches(spark, False).where("batch_digest = 'b9'"), scorer(), attempts=3, longest=0.0).collect()
    assert [(r.status, r.attempts, r.error) for r in seen] == [("failed", 3, "RuntimeError: no answer")]
