import heapq
import random
import zlib

from pyspark.sql import functions as F

from loamwork.llm import sharding


def plain_lpt(groups, shards):
    heap = [(0, i) for i in range(shards)]
    for size in sorted(groups, reverse=True):
        load, i = heapq.heappop(heap)
        heapq.heappush(heap, (load + size, i))
    return sorted((i, load) for load, i in heap)


def test_schedule_equals_plain_lpt():
    random.seed(1)
    groups = [random.choice([16, 17, 40, 400, 401, 9000]) for _ in range(3000)] + [100_000, 50_000]
    sizes = {}
    for g in groups:
        sizes[g] = sizes.get(g, 0) + 1
    plan, loads = sharding.schedule(list(sizes.items()), 7).to_pylist(), [0] * 7
    for row in plan:
        before = 0
        for till, shard in zip(row["till"], row["takes"], strict=True):
            loads[shard] += (till - before) * row["group_bytes"]
            before = till
        assert before == sizes[row["group_bytes"]]
    assert sorted(enumerate(loads)) == plain_lpt(groups, 7)


def test_rows_keep_together_and_slots_are_gapless(docs_of):
    rows = [(i, random.Random(i % 40).choice(["é", "ab", "xyz "]) * (i % 40)) for i in range(300)] + [(300, None), (301, None), (302, ""), (5, "again"), (5, "again"), (None, "no id")]
    out = sharding.shard_documents(docs_of(rows), 6).collect()
    assert len(out) == len(rows)
    by_text = {}
    for (i, text), r in zip(sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, zlib.crc32((x[1] or "").encode()))), sorted(out, key=lambda r: (r.doc_id is not None, r.doc_id or 0, r.text_crc32)), strict=True):
        raw = (text or "").encode()
        assert (r.doc_id, r.size, r.text_crc32, r.law, r.grown_shard) == (i, len(raw) + 16, zlib.crc32(raw), "bytes", None)
        by_text.setdefault(text, set()).add(r.shard)
    assert all(len(s) == 1 for s in by_text.values())
    for shard in range(6):
        slots = sorted(r.slot for r in out if r.shard == shard)
        assert slots == list(range(len(slots)))


def test_empty_table(docs_of):
    assert sharding.shard_documents(docs_of([])).count() == 0


def test_shards_of_a_whole_table_have_the_sums_of_plain_lpt(spark, docs_of):
    random.seed(6)
    rows = [(i, "x" * random.choice([0, 1, 5, 5, 5, 40, 41, 300, 2000]) + random.choice(["", "a", "é"])) for i in range(500)] + [(900, "y" * 1_000_000), (901, "y" * 1_000_000)]
    docs = docs_of(rows)
    for name in ("key", "salt", "size", "shard", "bucket"):
        docs = docs.withColumn(name, docs.lang)
    out = sharding.shard_documents(docs, 7).collect()
    groups, sums = {}, dict.fromkeys(range(7), 0)
    for _, text in rows:
        groups[text] = groups.get(text, 0) + len(text.encode()) + 16
    for r in out:
        sums[r.shard] += r.size
    assert sorted(sums.items()) == plain_lpt(groups.values(), 7)


def test_sizes_fall_into_a_bounded_number_of_classes(spark):
    """Sizes up to 15 bits are their own class; larger ones differ by less than one in 2**14 within theirs."""
    rng = random.Random(3)
    sizes = [1, 16, 32_767, 32_768, 32_769, 32_770] + [rng.randrange(1 << rng.randrange(16, 45)) + 1 for _ in range(3000)]
    rows = spark.createDataFrame([(x,) for x in sizes], "size long").select("size", sharding.size_class(F.col("size")).alias("kind")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.kind, []).append(r.size)
        if r.size < 1 << 15:
            assert r.kind == r.size
    assert all(max(v) - min(v) < min(v) / (1 << 14) + 1 for v in by.values())
    assert len({r.kind for r in rows if r.size in (32_768, 32_769)}) == 1 and len({r.kind for r in rows if r.size in (32_769, 32_770)}) == 2


def test_very_long_texts_and_one_common_size(docs_of):
    """Long texts of nearly one size share classes; the shards' sums stay within a hundredth of plain scheduling's greatest."""
    rng = random.Random(7)
    rows = [(i, chr(97 + i % 26) * (400_000 + rng.randrange(3000)) + str(i)) for i in range(40)] + [(100 + i, f"{i:06d}") for i in range(3000)]
    out = sharding.shard_documents(docs_of(rows), 6).collect()
    sums = dict.fromkeys(range(6), 0)
    for r in out:
        sums[r.shard] += r.size
    want = plain_lpt([len(t) + 16 for _, t in rows], 6)
    assert sum(sums.values()) == sum(x for _, x in want) and max(sums.values()) <= 1.01 * max(x for _, x in want)
