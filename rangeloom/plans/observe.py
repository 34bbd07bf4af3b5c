"""Analytics over execution segments (uid, worker, level, name, type, beg_us, end_us): half-open intervals in microseconds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

SEGMENT = "uid long, worker long, level int, name string, type string, beg_us long, end_us long"


def type_stats(segments: DataFrame) -> DataFrame:
    """count, total, avg, min and max of the durations by type."""
    d = F.col("end_us") - F.col("beg_us")
    return segments.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.sum(d).alias("total_us"), F.avg(d).alias("avg_us"), F.min(d).alias("min_us"), F.max(d).alias("max_us"))


def wall_time(segments: DataFrame) -> DataFrame:
    """From the first begin to the last end; 1 where that is 0."""
    return segments.agg(F.greatest(F.max("end_us") - F.min("beg_us"), F.lit(1)).cast("long").alias("wall_us"))


def merged_intervals(segments: DataFrame, by: list[str]) -> DataFrame:
    """Unions of overlapping or touching intervals per key: gaps and islands by a running maximum of the ends."""
    order = Window.partitionBy(*by).orderBy("beg_us", "end_us")
    before = F.max("end_us").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = segments.withColumn("_new", F.coalesce((F.col("beg_us") > before).cast("int"), F.lit(1)))
    island = marked.withColumn("_island", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return island.groupBy(*by, "_island").agg(F.min("beg_us").alias("beg_us"), F.max("end_us").alias("end_us")).drop("_island")


def busy_time(segments: DataFrame) -> DataFrame:
    """busy_us per worker: the union of its intervals."""
    return merged_intervals(segments, ["worker"]).groupBy("worker").agg(F.sum(F.col("end_us") - F.col("beg_us")).alias("busy_us"))


def utilization(segments: DataFrame, workers: DataFrame | None = None) -> DataFrame:
    """busy_us, idle_us and utilization in percent of the wall time for every worker, those without segments included."""
    busy = busy_time(segments)
    if workers is not None:
        busy = workers.select("worker").distinct().join(busy, "worker", "left").withColumn("busy_us", F.coalesce("busy_us", F.lit(0)))
    wall = F.lit((wall_time(segments).first()[0]) or 1)  # one number
    return busy.select("worker", "busy_us", F.greatest(wall - F.col("busy_us"), F.lit(0)).cast("long").alias("idle_us"), (F.col("busy_us") / wall * 100).alias("utilization"))


def average_utilization(segments: DataFrame, workers: DataFrame) -> DataFrame:
    return utilization(segments, workers).agg(F.avg("utilization").alias("avg_utilization"))


def _bins(segments: DataFrame, bins: int) -> DataFrame:
    origin, last = segments.agg(F.min("beg_us"), F.max("end_us")).first()  # two numbers
    if origin is None:
        return segments.withColumn("bin", F.lit(0)).where("false")
    width = max(1, -(-max(last - origin, 1) // bins))
    place = lambda t: F.least(F.greatest(F.floor((t - origin) / width), F.lit(0)), F.lit(bins - 1))
    first, end = place(F.col("beg_us")), place(F.col("end_us") - 1)
    return segments.withColumn("bin", F.explode(F.sequence(first, F.greatest(first, end))))


def concurrency_histogram(segments: DataFrame, bins: int) -> DataFrame:
    """Segments active in each of the bins of equal width; bins without any are not listed."""
    return _bins(segments, bins).groupBy("bin").agg(F.count(F.lit(1)).alias("tasks"))


def worker_histogram(segments: DataFrame, bins: int) -> DataFrame:
    """Distinct workers active in each bin."""
    return _bins(segments, bins).groupBy("bin").agg(F.countDistinct("worker").alias("workers"))


def scaled_time(us: Column) -> Column:
    """A duration with its unit: each step of us, ms, s and min at 10,000."""
    text = lambda x, unit: F.concat(F.floor(x).cast("string"), F.lit(" " + unit))
    ms, s = us / 1000, us / 1_000_000
    return F.when(us < 10_000, text(us, "us")).when(ms < 10_000, text(ms, "ms")).when(s < 10_000, text(s, "s")).otherwise(text(s / 60, "min"))


def chrome_trace(segments: DataFrame) -> DataFrame:
    """Rows of a trace viewer's events: cat, name, ph, pid, tid, ts, dur; a segment without a name gets its worker and index."""
    nth = F.row_number().over(Window.partitionBy("worker").orderBy("beg_us", "end_us", "name")) - 1
    name = F.when(F.coalesce(F.col("name"), F.lit("")) == "", F.concat_ws("_", F.col("worker").cast("string"), nth.cast("string"))).otherwise(F.col("name"))
    return segments.select(F.lit("task").alias("cat"), name.alias("name"), F.lit("X").alias("ph"), F.lit(1).alias("pid"), F.col("worker").alias("tid"), F.col("beg_us").alias("ts"), (F.col("end_us") - F.col("beg_us")).alias("dur"))


def summary(segments: DataFrame, workers: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a text summary."""
    return {"types": type_stats(segments), "wall": wall_time(segments), "workers": utilization(segments, workers)}
