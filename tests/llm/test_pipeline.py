"""The pipeline against a plain version of what each stage must do, over odd rows."""

import random
import re

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loamwork.llm import decontamination, jaccard_join, quality_classifier, secret_scan, sentencepiece_codec

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall(text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of a hundred rows with null and repeated ids, near copies, leaks and secrets."""
    random.seed(8)
    good = [f"w{i}" for i in range(300)] + ["the", "of", "and"] * 40
    item = "In the morning Anna bought 12 apples and then Anna sold 3 pears for 5 dollars and kept all of the rest"
    rows = []
    for i in range(60):
        text = " ".join(random.choice(good) for _ in range(random.randint(30, 80)))
        rows.append((i, text))
        if i % 5 == 0:
            rows.append((200 + i, text + " w1"))
        if i % 7 == 0:
            rows += [(i, text), (None, text.replace("w2", "w3"))]
        if i % 11 == 0:
            rows.append((i, f"{text} token=abc{i}defgh and password=widely.used1"))
        if i % 13 == 0:
            rows.append((300 + i, f"{text[: len(text) // 2]} {item.replace('12', str(i + 20)).replace('Anna', 'Ingrid')} {text[::-1]}"))
    rows += [(None, item + " " + rows[3][1][::-1]), (None, None), (None, None), (400, ""), (400, ""), (401, "zx!! qq## vv%% " * 20), (402, "zx!! qq## vv%% buy9 " * 9)]
    path = tmp_path_factory.mktemp("pipeline")
    docs = spark.createDataFrame([(i, t, "en", f"s{n % 4}", len(t or "")) for n, (i, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(i, int(i < 400), 0) for i in range(500)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item), (2, "short")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return str(path)


def rows_of(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def test_near_duplicates_keep_one_row_of_each_class(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    rows = rows_of(docs)
    distinct = sorted(set(rows), key=str)
    sets = {r: shingles(r[1]) for r in distinct}
    links = {a: [b for b in distinct if b != a and sets[a] and sets[b] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])] for a in distinct}
    want, done = [], set()
    for a in sorted(distinct, key=lambda r: (r[0] is not None, r[0] or 0)):
        if a in done:
            continue
        reached, todo = {a}, [a]
        while todo:
            for b in links[todo.pop()]:
                if b not in reached:
                    reached.add(b)
                    todo.append(b)
        done |= reached
        want.append((a[0], len(reached)))
    out = rows_of(corpus_pipeline.near_duplicates(spark, docs, folder))
    assert sorted((i for i, _ in want), key=str) == sorted((r[0] for r in out), key=str)
    assert set(out) <= set(distinct) and len(set(out)) == len(out)
    classes = [frozenset([a, *links[a]]) for a in out]
    assert all(len(c & set(out)) == 1 for c in classes)


def test_decontamination_takes_rows_whatever_their_id(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = rows_of(corpus_pipeline.benchmark_free(spark, docs, folder))
    assert out == sorted((r for r in rows_of(docs) if "pears for 5 dollars and" not in (r[1] or "")), key=str)


def test_run_is_the_plain_version(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    model = quality_classifier.trained_model(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    good = quality_classifier.keep_good(docs, model)
    assert good.columns == docs.columns and 0 < good.count() < docs.count()
    once = jaccard_join.one_of_each(good)
    free = decontamination.benchmark_free(once, spark.read.parquet(f"{folder}/benchmark.parquet"))
    texts = rows_of(free)
    owners = {}
    for r in free.collect():
        for v in re.findall(r"(?:token|password)=([\w.]+)", r.text or ""):
            owners.setdefault(v, set()).add(r.source)
    hidden = lambda m: m[0] if len(owners[m[2]]) >= 3 else "<secret>"
    want = sorted(((i, None if t is None else re.sub(r"(token|password)=([\w.]+)", hidden, t)) for i, t in texts), key=str)
    out = corpus_pipeline.run(spark, folder)
    assert rows_of(sentencepiece_codec.decode(out)) == want and out.where(~F.col("round_trip")).count() == 0
    assert "<secret>" in str(want)


def test_no_documents(spark, folder):
    none = spark.read.parquet(f"{folder}/documents.parquet").where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0


def test_clashing_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name in ("doc", "text_key", "stays", "key", "id", "real", "row"):
        docs = docs.withColumn(name, docs.lang)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, folder)
    assert docs.count() > 0 and "stays" in docs.columns and secret_scan.MASK == "<secret>"
