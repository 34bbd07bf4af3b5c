"""Element-wise operators over ordered ranges.

A range is a DataFrame plus the columns that order it; nothing here relies on physical row order. All
functions are narrow projections unless they say otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .scan import with_position


def distance(begin: int, end: int, step: int) -> int:
    """Elements of the index range; 0 for an empty or invalid one (a step of 0, or of the wrong sign)."""
    if begin == end or step == 0 or (step > 0) != (end > begin):
        return 0
    return -(-(end - begin) // step)


def is_invalid(begin: int, end: int, step: int) -> bool:
    """Whether the step can't lead from begin to end; an empty range is valid with any step."""
    return begin != end and (step == 0 or (step > 0) != (end > begin))


def index_range(spark: SparkSession, begin: int, end: int, step: int = 1, name: str = "i") -> DataFrame:
    """The indexes from begin to end by step, either way; an invalid range has none."""
    if not distance(begin, end, step):
        return spark.range(0).select(F.col("id").alias(name))
    return spark.range(begin, end, step).select(F.col("id").alias(name))


def unravel(begin: int, step: int, first: Column | int, last: Column | int) -> Callable[[DataFrame], DataFrame]:
    """The part [first, last) of an index range, by flat position: (frame of column pos) -> with index i."""
    return lambda flat: flat.where((F.col("pos") >= first) & (F.col("pos") < last)).withColumn("i", F.lit(begin) + F.col("pos") * step)


def nd_size(sizes: list[int]) -> int:
    """Elements of a product of index ranges: an empty dimension ends the product, the ones before it count; an empty first one gives 0."""
    total = 0
    for d, n in enumerate(sizes):
        if n == 0:
            break
        total = n if d == 0 else total * n
    return total


def nd_range(spark: SparkSession, dims: list[tuple[int, int, int]], names: list[str] | None = None) -> DataFrame:
    """Row-major product of index ranges with its flat position pos; one distributed range, no join.

    Dimensions from the first empty one on take no part; their columns hold their begin.
    """
    names = names or [f"i{d}" for d in range(len(dims))]
    sizes = [distance(*d) for d in dims]
    out = spark.range(nd_size(sizes)).withColumnRenamed("id", "pos")
    live = sizes.index(0) if 0 in sizes else len(sizes)
    stride, columns = 1, {}
    for d in reversed(range(len(dims))):
        begin, _, step = dims[d]
        if d < live:
            columns[names[d]] = (F.lit(begin) + F.floor(F.col("pos") / F.lit(stride)) % sizes[d] * step).cast("long")
            stride *= sizes[d]
        else:
            columns[names[d]] = F.lit(begin).cast("long")
    return out.select("pos", *(columns[n].alias(n) for n in names))


def for_each(df: DataFrame, **updates: Column) -> DataFrame:
    """Each element changed by pure expressions of its own row."""
    return df.withColumns(updates)


def for_each_partition(df: DataFrame, effect: Callable[[Iterator], None]) -> None:
    """Side effects, once per partition; at least once per row when tasks are retried."""
    df.foreachPartition(effect)


def for_each_index(spark: SparkSession, begin: int, end: int, step: int, **columns: Column) -> DataFrame:
    """Expressions of each index i."""
    return index_range(spark, begin, end, step).select("i", *(c.alias(n) for n, c in columns.items()))


def for_each_by_index(spark: SparkSession, dims: list[tuple[int, int, int]], box: Callable, schema: str) -> DataFrame:
    """A callable over sub-boxes: it gets batches (pandas) of an N-D range and yields frames of the schema."""
    return nd_range(spark, dims).mapInPandas(box, schema)


def transform(df: DataFrame, out: str, value: Column) -> DataFrame:
    """out[i] = f(in[i])."""
    return df.withColumn(out, value)


def transform_binary(first: DataFrame, second: DataFrame, first_order: list[str], second_order: list[str], out: str, value: Callable[[Callable, Callable], Column]) -> DataFrame:
    """out[i] = f(first[i], second[i]) for every i of the first range; past the second range's end its side is null.

    Positions come from the distributed numbering, then one equi-join on them. `value` gets
    two functions that name columns of the sides.
    """
    a = with_position(first, first_order).select("pos", *(F.col(c).alias(f"a_{c}") for c in first.columns))
    b = with_position(second, second_order).select("pos", *(F.col(c).alias(f"b_{c}") for c in second.columns))
    joined = a.join(b, "pos", "left")
    return joined.withColumn(out, value(lambda c: F.col(f"a_{c}"), lambda c: F.col(f"b_{c}")))


def fill(df: DataFrame, column: str, value) -> DataFrame:
    """The constant in every row."""
    return df.withColumn(column, F.lit(value))


def fill_n(df: DataFrame, column: str, count: int, value, order: list[str]) -> DataFrame:
    """The constant in the first count rows by order; the others keep what they have."""
    return with_position(df, order).withColumn(column, F.when(F.col("pos") < count, F.lit(value)).otherwise(F.col(column)))


def generate(df: DataFrame, column: str, generator: Column) -> DataFrame:
    """A generated value in every row: an expression, of pos if it depends on the place."""
    return df.withColumn(column, generator)


def generate_n(spark: SparkSession, count: int, column: str, generator: Column) -> DataFrame:
    """count rows with pos and the generated value."""
    return spark.range(max(count, 0)).select(F.col("id").alias("pos")).withColumn(column, generator)


def with_partition_hooks(df: DataFrame, body: Callable, schema: str, prologue: Callable[[], object] = lambda: None, epilogue: Callable[[object], None] = lambda state: None) -> DataFrame:
    """body(state, batches) within each partition, between a prologue that makes the state and an epilogue that gets it."""

    def run(batches):
        state = prologue()
        try:
            yield from body(state, batches)
        finally:
            epilogue(state)

    return df.mapInPandas(run, schema)
