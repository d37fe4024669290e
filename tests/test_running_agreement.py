"""Running kappa on a stream of files: equal to the batch kappa after every batch, also after a restart from the checkpoint."""

import random
import time

import pytest

from loamwork.operators import agreement
from loamwork.streaming.agreement import agreement_of, running_kappa

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SCHEMA = "lang string, a string, b string"


@pytest.fixture
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    yield spark
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


def rows_of(seed, n=120):
    rng = random.Random(seed)
    return [(rng.choice(["en", "de", None]), rng.choice(["yes", "no", "unsure"]), rng.choice(["yes", "yes", "no", None])) for _ in range(n)]


def test_equal_to_the_batch_kappa_over_restarts(rocks, tmp_path):
    held, last = [], {}
    for nth in range(3):
        held += rows_of(nth)
        rocks.createDataFrame(rows_of(nth), SCHEMA).coalesce(2).write.mode("append").json(f"{tmp_path}/in")
        seen = []
        stream = running_kappa(rocks.readStream.schema(SCHEMA).json(f"{tmp_path}/in"), "lang", "a", "b")
        query = stream.writeStream.foreachBatch(lambda df, _, seen=seen: seen.extend(df.collect())).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
        query.awaitTermination()
        for r in seen:
            last[r.key] = r
        rated = rocks.createDataFrame([r for r in held if r[2] is not None], SCHEMA)
        for key in ("en", "de", None):
            want = agreement.kappa(rated.where(f"lang <=> {'null' if key is None else repr(key)}"), "a", "b").first()
            got = last[key]
            assert got.n == want.n and abs(got.kappa - want.kappa) < 1e-12 and abs(got.expected - want.expected) < 1e-12 and not got.closed


def test_a_silent_key_is_closed(rocks, tmp_path):
    rocks.createDataFrame([("en", "yes", "yes"), ("en", "no", "yes")], SCHEMA).write.json(f"{tmp_path}/in")
    seen = []
    stream = running_kappa(rocks.readStream.schema(SCHEMA).json(f"{tmp_path}/in"), "lang", "a", "b", silence_s=1)
    query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).outputMode("update").option("checkpointLocation", f"{tmp_path}/state").start()
    began = time.time()
    while not any(r.closed for r in seen) and time.time() - began < 90:
        time.sleep(0.5)
    query.stop()
    assert [(r.key, r.n, r.closed) for r in seen][:2] == [("en", 2, False), ("en", 2, True)]


def test_degenerate_agreement():
    assert agreement_of({("yes", "yes"): 4}) == (4, 1.0, 1.0, 1.0) and agreement_of({("yes", "yes"): 4}, None)[3] is None
    assert agreement_of({("yes", "no"): 2, ("no", "yes"): 2}) == (4, 0.0, 0.5, -1.0)
