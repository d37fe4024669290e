"""Data contracts: checks before a plan is made, and checks inside it that stop the job."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORBIDDEN = ("label", "gold_label", "gold", "decision")
LABELLED_SPLITS = ("train", "dev", "calibration")


class ContractError(ValueError):
    """A table that breaks its contract."""


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ContractError(f"missing columns: {missing}")
    return df


def label_free(df: DataFrame, forbidden: Sequence[str] = FORBIDDEN) -> DataFrame:
    """Fails on label columns at once, and at run time on rows not marked as free of labels."""
    found = [c for c in df.columns if c in forbidden]
    if found:
        raise ContractError(f"label columns are not allowed here: {found}")
    if "label_fields_present" not in df.columns:
        raise ContractError("label_fields_present is required")
    return holds(df, F.col("label_fields_present").eqNullSafe(False), "label_fields_present must be false")


def labelled_split(name: str) -> str:
    if name not in LABELLED_SPLITS:
        raise ContractError(f"labels of split {name!r} may not be loaded")
    return name


def holds(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df``; a row for which the condition isn't true stops the job that reads it."""
    return df.where(F.assert_true(F.coalesce(condition, F.lit(False)), F.lit(message)).isNull())


def one_of(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    return holds(df, F.col(column).isin(*values), f"{column} has a value outside its domain")


def duplicates(df: DataFrame, key: Sequence[str]) -> DataFrame:
    return df.groupBy(*key).count().where("count > 1")


def unique(df: DataFrame, key: Sequence[str]) -> DataFrame:
    if not duplicates(df, key).isEmpty():
        raise ContractError(f"{list(key)} is not unique")
    return df


def same_keys(left: DataFrame, right: DataFrame, key: Sequence[str]) -> None:
    one, two = left.join(right, list(key), "left_anti").limit(1), right.join(left, list(key), "left_anti").limit(1)
    if not one.isEmpty() or not two.isEmpty():
        raise ContractError(f"the sides differ in {list(key)}")


def disjoint_and_whole(parts: Sequence[DataFrame], whole: DataFrame, key: str) -> None:
    """Each key of ``whole`` stands in exactly one part, and no other does."""
    union = parts[0].select(key)
    for p in parts[1:]:
        union = union.unionByName(p.select(key))
    unique(union, [key])
    same_keys(union, whole.select(key), [key])
