"""Prefix scans in order, and the numbering of rows, without one task for all rows.

An unpartitioned window would move everything to a single task. Here the rows go through one range exchange on all keys and
order columns into blocks that follow one another, are written once with the number of their block, and
each block is scanned by itself; the totals of the blocks before it are then carried in. Blocks follow the table's size. Rows
that are equal in every order column are told apart by their place in the input, so they are spread over blocks too. With
keys (`by`) the keys come first in the exchange, and only the keys that run across a block's end need a carry. Column names
that begin with one underscore are the plan's own.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from rangeloom.plans.lineage import cut

#: Bytes of a block; blocks are one for each core at least, and WAVES times as many at most, as sizes of plans are estimates.
BLOCK_BYTES, WAVES = 128 << 20, 64
#: Tables of carries with so many rows at most are broadcast.
SMALL = 1 << 16
_UP = Window.unboundedPreceding

#: Scans by name: the window aggregate, how two values join, and the identity of an exclusive scan without init.
SCANS: dict[str, tuple[Callable[[Column], Column], Callable[[Column, Column], Column]]] = {
    "sum": (F.sum, lambda a, b: a + b),
    "min": (F.min, F.least),
    "max": (F.max, F.greatest),
    "and": (F.bit_and, lambda a, b: a.bitwiseAND(b)),
    "or": (F.bit_or, lambda a, b: a.bitwiseOR(b)),
    "xor": (F.bit_xor, lambda a, b: a.bitwiseXOR(b)),
    "concat": (F.collect_list, lambda a, b: F.concat(a, b)),
}


def _over(op: str, value: Column, window) -> Column:
    """The fold over a window; null over an empty one."""
    found = SCANS[op][0](value).over(window)
    if op == "concat":
        return F.when(F.count(F.lit(1)).over(window) > 0, F.concat_ws("", found))
    return found


def _joined(join, *values: Column) -> Column:
    """The values that aren't null, joined from the left; null if all are."""
    out = values[0]
    for v in values[1:]:
        out = F.when(out.isNull(), v).when(v.isNull(), out).otherwise(join(out, v))
    return out


def block_count(df: DataFrame) -> int:
    """Blocks for a frame of the size that its plan is estimated to have."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(max(cores, size // BLOCK_BYTES), WAVES * cores)


def _spread(df: DataFrame, order: list, blocks: int) -> DataFrame:
    """The rows with _tie, their place in the input, over range partitions of the order."""
    return df.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(blocks, *order, "_tie")


def in_blocks(df: DataFrame, order: list, blocks: int) -> DataFrame:
    """The rows, written once, with _tie and _block: blocks follow one another in order. Order: names or sort expressions."""
    return cut(_spread(df, order, blocks).withColumn("_block", F.spark_partition_id()))


def _small(df: DataFrame, rows: int) -> DataFrame:
    return F.broadcast(df) if rows <= SMALL else df


def scan(df: DataFrame, value: Column, order: list, out: str = "scan", op: str = "sum", init=None, exclusive: bool = False, by: list[str] | None = None, blocks: int | None = None) -> DataFrame:
    """The rows with the prefix fold of value in order (names or sort expressions), for each key of `by` anew; rows must have distinct
    order columns for a defined result.

    inclusive: up to this row; exclusive: before this row, the first having init. Null values take no part, null keys are one key.
    """
    _, join = SCANS[op]
    first = None if init is None else (init if isinstance(init, Column) else F.lit(init))
    by, n = by or [], blocks or block_count(df)
    rows = in_blocks(df.withColumn("_v", value), [*by, *order], n)
    local = Window.partitionBy("_block", *by).orderBy(*order, "_tie")
    scanned = rows.withColumn("_here", _over(op, F.col("_v"), local.rowsBetween(_UP, -1 if exclusive else 0)))
    crossing = rows
    if by:  # keys in more than one block: each is the last of its first block and the first of its last one
        ends = rows.groupBy("_block").agg(F.min(F.struct(*by)).alias("a"), F.max(F.struct(*by)).alias("z"))
        keys = ends.select("_block", F.explode(F.array_distinct(F.array("a", "z"))).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*(F.col(f"k.{c}").alias(f"_k{i}") for i, c in enumerate(by)))
        crossing = rows.join(_small(keys, n), _same(by), "left_semi")
    if op == "concat":
        total = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", "_v"))), lambda x: x["_v"]), "")
        crossing = crossing.withColumn("_n", F.row_number().over(local))
    else:
        total = SCANS[op][0](F.col("_v"))
    totals = crossing.groupBy("_block", *by).agg(total.alias("_total"))
    # one row for each block, or for each key and block of those that cross
    before = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_block").rowsBetween(_UP, -1)
    carries = totals.select(F.col("_block").alias("_of"), *(F.col(c).alias(f"_k{i}") for i, c in enumerate(by)), _over(op, F.col("_total"), before).alias("_carry"))
    parts = [F.col("_carry"), F.col("_here")] if first is None else [first, F.col("_carry"), F.col("_here")]
    placed = scanned.join(_small(carries, 2 * n), _same(by) & (F.col("_block") == F.col("_of")), "left")
    return placed.withColumn(out, _joined(join, *parts)).select(*dict.fromkeys([*df.columns, out]))


def _same(by: list[str]) -> Column:
    """Whether the keys equal _k0, _k1 and so on; null equals null."""
    out = F.lit(True)
    for i, c in enumerate(by):
        out = out & F.col(c).eqNullSafe(F.col(f"_k{i}"))
    return out


def inclusive_scan(df: DataFrame, value: str, order: list, out: str = "scan", op: str = "sum", init=None, **more) -> DataFrame:
    return scan(df, F.col(value), order, out, op, init, **more)


def exclusive_scan(df: DataFrame, value: str, order: list, init, out: str = "scan", op: str = "sum", **more) -> DataFrame:
    return scan(df, F.col(value), order, out, op, init, exclusive=True, **more)


def transform_inclusive_scan(df: DataFrame, mapped: Column, order: list, out: str = "scan", op: str = "sum", init=None, **more) -> DataFrame:
    return scan(df, mapped, order, out, op, init, **more)


def transform_exclusive_scan(df: DataFrame, mapped: Column, order: list, init, out: str = "scan", op: str = "sum", **more) -> DataFrame:
    return scan(df, mapped, order, out, op, init, exclusive=True, **more)


def with_position(df: DataFrame, order: list, name: str = "pos", blocks: int | None = None) -> DataFrame:
    """The rows with their position in order (names or sort expressions), from 0: local ranks plus the sizes of the blocks before. Equal rows have neighbouring positions."""
    n = blocks or block_count(df)
    rows = in_blocks(df, order, n)
    sizes = rows.groupBy("_block").agg(F.count(F.lit(1)).alias("_n"))
    carry = F.coalesce(F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_block").rowsBetween(_UP, -1)), F.lit(0))
    carries = sizes.select(F.col("_block").alias("_of"), carry.alias("_base"))
    placed = rows.withColumn("_rank", F.row_number().over(Window.partitionBy("_block").orderBy(*order, "_tie"))).join(_small(carries, n), F.col("_block") == F.col("_of"))
    return placed.withColumn(name, F.col("_base") + F.col("_rank") - 1).drop("_rank", "_base", "_of", "_block", "_tie")


def scan_custom(df: DataFrame, value: str, order: list, op: Callable, out: str = "scan", init=None, out_type: str = "double", blocks: int | None = None) -> DataFrame:
    """An inclusive scan by any associative Python function of two values, init in front. Sorted blocks stream through the
    function and are written with their local scan; the blocks' totals are folded, and a narrow pass carries them in."""
    n = blocks or block_count(df)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name != out)

    def local(frames):
        block, so_far, seen = TaskContext.get().partitionId(), None, 0
        for f in frames:
            if len(f):
                done = list(itertools.accumulate(f[value], op, initial=so_far))
                done = done if so_far is None else done[1:]
                so_far = done[-1]
                yield f.drop(columns="_tie").assign(**{out: done, "_block": block, "_n": range(seen, seen + len(f))})
                seen += len(f)

    rows = cut(_spread(df, order, n).sortWithinPartitions(*order, "_tie").mapInPandas(local, f"{fields}, `{out}` {out_type}, _block int, _n long"))
    totals = rows.groupBy("_block").agg(F.max_by(out, "_n").alias("total")).orderBy("_block").collect()  # one row for each block
    carries, so_far = {}, init
    for r in totals:
        carries[r["_block"]] = so_far
        so_far = r["total"] if so_far is None else op(so_far, r["total"])

    def carried(frames):
        for f in frames:
            f[out] = [x if (carry := carries[b]) is None else op(carry, x) for b, x in zip(f["_block"], f[out], strict=True)]
            yield f.drop(columns=["_block", "_n"])

    return rows.mapInPandas(carried, f"{fields}, `{out}` {out_type}")
