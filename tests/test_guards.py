"""Guarded scans and the raters' join."""

import pytest

from loamwork.operators import agreement
from loamwork.sources import contracts, files


def test_guarded_scans(spark, tmp_path):
    """Labels of a test split may not be read, labelled items need a label, and path records may hold none."""
    spark.createDataFrame([("i1", "yes"), ("i2", "no")], "item_id string, label string").write.json(str(tmp_path / "items"))
    assert {r.label for r in files.read_labelled_items(spark, str(tmp_path / "items"), "dev").collect()} == {"yes", "no"}
    with pytest.raises(contracts.ContractError):
        files.read_labelled_items(spark, str(tmp_path / "items"), "test")
    spark.createDataFrame([("i1", None)], "item_id string, label string").write.json(str(tmp_path / "bare"))
    with pytest.raises(Exception, match="label is required"):
        files.read_labelled_items(spark, str(tmp_path / "bare"), "train").collect()
    spark.createDataFrame([("i1", False)], "item_id string, label_fields_present boolean").write.json(str(tmp_path / "paths"))
    assert files.read_path_records(spark, str(tmp_path / "paths")).count() == 1
    spark.createDataFrame([("i1", True)], "item_id string, label_fields_present boolean").write.json(str(tmp_path / "marked"))
    with pytest.raises(Exception, match="label_fields_present"):
        files.read_path_records(spark, str(tmp_path / "marked")).collect()


def test_raters_match_one_to_one(spark):
    one, two = (spark.createDataFrame([(i, name) for i in ids], f"item int, {name} string") for name, ids in (("a", (1, 2)), ("b", (2, 1))))
    assert {(r.item, r.a, r.b) for r in agreement.matched(one, two, ["item"]).collect()} == {(1, "a", "b"), (2, "a", "b")}
    with pytest.raises(Exception, match="ids of the two sides differ"):
        agreement.matched(one, two.where("item = 1"), ["item"]).collect()
