from loamwork.operators import learning

LABELS = ("SUPPORTED", "NOT_SUPPORTED", "INSUFFICIENT_CONTEXT", "ENTITY_OR_TYPE_ERROR")


def test_models_learn_separable_labels(spark):
    rows = spark.createDataFrame([(LABELS[i % 4], f"t{i % 4}", float(i % 4) if i % 9 else None) for i in range(120)], "label string, kind string, x double")
    ready = learning.fit_frame(rows, ["kind"], ["x"]).transform(rows)
    for method in (learning.one_against_rest, learning.cascade):
        for r in method(ready, ready, "label", LABELS).select("label", "probs").collect():
            assert abs(sum(r.probs) - 1) < 1e-9 and LABELS[r.probs.index(max(r.probs))] == r.label


def test_text_features(spark):
    rows = spark.createDataFrame([("ab",), (None,)], "t string")
    assert [r.features.numNonzeros() for r in learning.text_features(rows, "t").collect()] == [3, 0]
