"""Folds and searches: one partial and one final aggregation, each with its defined result on an empty range."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Folds by name: the aggregate, and how init joins it. All are associative and commutative.
FOLDS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "product": (F.product, lambda a, b: a * b),
    "and": (F.bit_and, lambda a, b: a.bitwiseAND(b)),
    "or": (F.bit_or, lambda a, b: a.bitwiseOR(b)),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "all": (F.bool_and, lambda a, b: a & b),
    "any": (F.bool_or, lambda a, b: a | b),
}


def folded(value: Column, init, fold: str = "sum") -> Column:
    """init folded once with all values; init itself where there are none."""
    aggregate, join = FOLDS[fold]
    init = init if isinstance(init, Column) else F.lit(init)
    total = aggregate(value)
    return F.when(total.isNull(), init).otherwise(join(init, total))


def reduce(df: DataFrame, value: Column, init, fold: str = "sum", out: str = "value") -> DataFrame:
    """One row: init folded with the values of all rows."""
    return df.agg(folded(value, init, fold).alias(out))


def transform_reduce(df: DataFrame, value: Column, init, fold: str = "sum", out: str = "value") -> DataFrame:
    """Map, then fold: `value` is the mapped expression, of one range or of two zipped ones."""
    return reduce(df, value, init, fold, out)


def uninitialized_reduce(df: DataFrame, value: Column, fold: str = "sum", out: str = "value") -> DataFrame:
    """The fold without init: null on an empty range."""
    return df.agg(FOLDS[fold][0](value).alias(out))


def reduce_by_index(df: DataFrame, box: Column, local: Column, combine: Callable[[Column], Column], out: str = "value") -> DataFrame:
    """Two different folds: `local` aggregates each box, `combine` aggregates the boxes' partials."""
    return df.groupBy(box.alias("_box")).agg(local.alias("_part")).agg(combine(F.col("_part")).alias(out))


def reduce_custom(df: DataFrame, local: Callable, schema: str, combine: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """For folds without a built-in aggregate: `local` (an iterator of pandas frames to one) runs in each partition, `combine` on the partials."""
    return combine(df.mapInPandas(local, schema))


def _position(order: list[str]) -> Column:
    return F.struct(*(F.col(c) for c in order))


def find_if(df: DataFrame, predicate: Column, order: list[str]) -> DataFrame:
    """The order columns of the first match, null if none: the minimum over matches, with the filter pushed down."""
    return df.where(predicate).agg(F.min(_position(order)).alias("_at")).select(*(F.col(f"_at.{c}").alias(c) for c in order))


def find_if_not(df: DataFrame, predicate: Column, order: list[str]) -> DataFrame:
    """The first row where the predicate isn't true; null counts as not true."""
    return find_if(df, ~F.coalesce(predicate, F.lit(False)), order)


def min_element(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """value and order columns of the smallest element, the first of equal ones; nulls take no part, none gives null."""
    found = df.where(F.col(value).isNotNull()).agg(F.min(F.struct(F.col(value).alias("_v"), *(F.col(c) for c in order))).alias("_at"))
    return found.select(F.col("_at._v").alias(value), *(F.col(f"_at.{c}").alias(c) for c in order))


def max_element(df: DataFrame, value: str, order: list[str]) -> DataFrame:
    """As min_element for the largest; of equal ones the first."""
    present = df.where(F.col(value).isNotNull())
    found = present.groupBy(value).agg(F.min(_position(order)).alias("_first")).agg(F.max_by("_first", value).alias("_at"), F.max(value).alias(value))
    return found.select(value, *(F.col(f"_at.{c}").alias(c) for c in order))
