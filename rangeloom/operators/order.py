"""Sorting and stable merging. A sort is a range-partitioned sort; positions come from the block plan of the scans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scan import with_position


def sort(df: DataFrame, keys: list, ties: list[str] | None = None) -> DataFrame:
    """Rows by keys (names or sort expressions), then by the tie columns, which make it deterministic."""
    return df.orderBy(*keys, *(ties or []))


def sort_by(df: DataFrame, key: Column, ties: list[str], descending: bool = False) -> DataFrame:
    """Rows by a derived key, as a comparator on it would put them."""
    return df.orderBy(key.desc() if descending else key.asc(), *ties)


def sorted_positions(df: DataFrame, keys: list, ties: list) -> DataFrame:
    """The rows with their position pos in the sorted order; keys are names or sort expressions."""
    return with_position(df, [*keys, *ties])


def sort_by_key(df: DataFrame, key: str, values: list[str], ties: list[str] | None = None) -> DataFrame:
    """Keys in order, values following them, with pos."""
    return sorted_positions(df.select(key, *values, *(ties or [])), [key], ties or values).select("pos", key, *values)


def sort_array(column: Column, before) -> Column:
    """An array sorted by a strict weak order: before(a, b) is true where a comes first. Nulls come last."""
    return F.array_sort(column, lambda a, b: F.when(a.isNull(), F.when(b.isNull(), F.lit(0)).otherwise(F.lit(1))).when(b.isNull() | before(a, b), F.lit(-1)).when(before(b, a), F.lit(1)).otherwise(F.lit(0)))


def _keyed(key: str, descending: bool, rank) -> list[Column]:
    """The sort expression of a key: itself, or what `rank` makes of it, either way round."""
    by = rank(F.col(key)) if rank else F.col(key)
    return [by.desc() if descending else by.asc()]


def merge(first: DataFrame, second: DataFrame, key: str, first_order: list[str], second_order: list[str], descending: bool = False, rank=None) -> DataFrame:
    """Two ranges sorted by key as one: pos, key, src (1 or 2). Stable: equal keys of the first range come first, each side in its order.

    A comparator comes as `descending`, or as `rank`: keys are then ordered by what it makes of them, and those of one rank are equal.
    """
    a, b = (
        df.select(F.col(key), F.lit(src).alias("src"), F.struct(*(F.col(c).alias(f"_{i}") for i, c in enumerate(order))).alias("_order"))
        for src, df, order in ((1, first, first_order), (2, second, second_order))
    )
    return with_position(a.unionByName(b), [*_keyed(key, descending, rank), "src", "_order"]).select("pos", key, "src")


def merge_by_key(first: DataFrame, second: DataFrame, key: str, value: str, descending: bool = False, rank=None) -> DataFrame:
    """As merge, values following their keys; each side's rows are ordered by key and value."""
    rows = first.select(key, value, F.lit(1).alias("src")).unionByName(second.select(key, value, F.lit(2).alias("src")))
    return with_position(rows, [*_keyed(key, descending, rank), "src", value]).select("pos", key, value, "src")
