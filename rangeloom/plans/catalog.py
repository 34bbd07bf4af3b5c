"""The registry of queries over the driver's tables, each with its SQL oracle where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.functions import scalars
from rangeloom.operators import linalg, order, ranges, reduce, scan
from rangeloom.plans import dag, observe, workloads
from rangeloom.plans.lineage import cut
from rangeloom.sources import traces
from rangeloom.streaming.pipeline import PARALLEL, SERIAL, DataPipeline, Pipe, Pipeline, ScalablePipeline, data_pipe

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _query(oracle: str | None = None):
    def register(fn):
        _QUERIES[fn.__name__] = fn
        if oracle:
            _ORACLES[fn.__name__] = oracle
        return fn

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _money(column: str) -> Column:
    return F.col(column).cast("decimal(18,2)")


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, ts, user_id, event_type and value in cents."""
    return _table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", F.round(F.col("value") * 100).cast("long").alias("v"))


EVENTS = "(SELECT event_id, ts, user_id, event_type, CAST(round(value * 100) AS BIGINT) AS v FROM events)"
ORDER = ["ts", "event_id"]


@_query("SELECT CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(38,4)) AS value FROM lineitem")
def q_transform_reduce(spark, sf_dir):
    rows = _table(spark, sf_dir, "lineitem")
    found = reduce.transform_reduce(rows, _money("l_extendedprice") * _money("l_discount"), F.lit(0).cast("decimal(36,4)"))
    return found.select(F.col("value").cast("decimal(38,4)"))


@_query(f"SELECT CAST(100 + coalesce(sum(v), 0) AS BIGINT) AS value FROM {EVENTS}")
def q_reduce_init(spark, sf_dir):
    return reduce.reduce(_events(spark, sf_dir), F.col("v"), F.lit(100).cast("long"))


@_query("SELECT CAST(7 AS BIGINT) AS value")
def q_reduce_empty(spark, sf_dir):
    return reduce.reduce(_events(spark, sf_dir).where("v < -1000000000"), F.col("v"), F.lit(7).cast("long"))


@_query(f"SELECT CAST(least(50, min(v)) AS BIGINT) AS lo, CAST(greatest(50, max(v)) AS BIGINT) AS hi, CAST(xor(5, bit_xor(v)) AS BIGINT) AS x FROM {EVENTS}")
def q_reduce_folds(spark, sf_dir):
    v, of = F.col("v"), reduce.folded
    return _events(spark, sf_dir).agg(of(v, F.lit(50).cast("long"), "min").alias("lo"), of(v, F.lit(50).cast("long"), "max").alias("hi"), of(v, F.lit(5).cast("long"), "xor").alias("x"))


@_query(f"SELECT CAST(max(v) AS BIGINT) AS value FROM {EVENTS}")
def q_uninitialized_reduce(spark, sf_dir):
    return reduce.uninitialized_reduce(_events(spark, sf_dir), F.col("v"), "max")


@_query(f"SELECT CAST(10 + 2 * sum(part) AS BIGINT) AS value FROM (SELECT event_id // 64 AS box, max(v) AS part FROM {EVENTS} GROUP BY 1)")
def q_reduce_by_index(spark, sf_dir):
    return reduce.reduce_by_index(_events(spark, sf_dir), F.floor(F.col("event_id") / 64), F.max("v"), lambda part: (F.lit(10) + 2 * F.sum(part)).cast("long"))


@_query("SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(28,2)) AS total, count(*) AS n FROM lineitem GROUP BY l_returnflag")
def q_reduce_by_key(spark, sf_dir):
    return _table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(_money("l_extendedprice")).alias("total"), F.count(F.lit(1)).alias("n"))


@_query(f"SELECT count(*) AS n, CAST(sum(v % 97) AS BIGINT) AS s FROM {EVENTS}")
def q_reduce_custom(spark, sf_dir):
    import numpy as np
    import pandas as pd

    def local(frames):
        """Remainders have the sign of the value, as in SQL; nulls are counted and add nothing, and the sum of none is null."""
        n, s, some = 0, 0, False
        for f in frames:
            n, s, some = n + len(f), s + int(np.fmod(f["v"], 97).sum()), some or bool(f["some"].any())
        yield pd.DataFrame({"n": [n], "s": pd.array([s if some else None], "Int64")})

    v = F.col("v")
    rows = _events(spark, sf_dir).select(F.coalesce(v, F.lit(0)).alias("v"), v.isNotNull().alias("some"))
    return reduce.reduce_custom(rows, local, "n long, s long", lambda d: d.agg(F.sum("n").alias("n"), F.sum("s").alias("s")))


@_query(f"SELECT min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM {EVENTS} WHERE v > 20000")
def q_find_if(spark, sf_dir):
    return reduce.find_if(_events(spark, sf_dir), F.col("v") > 20000, ORDER)


@_query(f"SELECT min(ts) AS ts, arg_min(event_id, (ts, event_id)) AS event_id FROM {EVENTS} WHERE NOT event_type IN ('view', 'click')")
def q_find_if_not(spark, sf_dir):
    return reduce.find_if_not(_events(spark, sf_dir), F.col("event_type").isin("view", "click"), ORDER)


@_query("SELECT CAST(NULL AS BIGINT) AS event_id")
def q_find_none(spark, sf_dir):
    return reduce.find_if(_events(spark, sf_dir), F.col("event_id") < 0, ["event_id"])


@_query(f"SELECT v, ts, event_id FROM {EVENTS} ORDER BY v, ts, event_id LIMIT 1")
def q_min_element(spark, sf_dir):
    return reduce.min_element(_events(spark, sf_dir), "v", ORDER)


@_query(f"SELECT v, ts, event_id FROM {EVENTS} ORDER BY v DESC, ts, event_id LIMIT 1")
def q_max_element(spark, sf_dir):
    return reduce.max_element(_events(spark, sf_dir), "v", ORDER)


def _scanned(df: DataFrame) -> DataFrame:
    return df.select("event_id", F.col("scan").cast("long"))


_OVER = "OVER (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)"
_BEFORE = "OVER (ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"


@_query(f"SELECT event_id, CAST(sum(v) {_OVER} AS BIGINT) AS scan FROM {EVENTS}")
def q_inclusive_scan(spark, sf_dir):
    return _scanned(scan.inclusive_scan(_events(spark, sf_dir), "v", ORDER))


@_query(f"SELECT event_id, CAST(1000 + sum(v) {_OVER} AS BIGINT) AS scan FROM {EVENTS}")
def q_inclusive_scan_init(spark, sf_dir):
    return _scanned(scan.inclusive_scan(_events(spark, sf_dir), "v", ORDER, init=1000))


@_query(f"SELECT event_id, CAST(sum(v * 3 - 1) {_OVER} AS BIGINT) AS scan FROM {EVENTS}")
def q_transform_inclusive_scan(spark, sf_dir):
    return _scanned(scan.transform_inclusive_scan(_events(spark, sf_dir), F.col("v") * 3 - 1, ORDER))


@_query(f"SELECT event_id, CAST(-5 + sum(v * 3 - 1) {_OVER} AS BIGINT) AS scan FROM {EVENTS}")
def q_transform_inclusive_scan_init(spark, sf_dir):
    return _scanned(scan.transform_inclusive_scan(_events(spark, sf_dir), F.col("v") * 3 - 1, ORDER, init=-5))


@_query(f"SELECT event_id, CAST(-1 + coalesce(sum(v) {_BEFORE}, 0) AS BIGINT) AS scan FROM {EVENTS}")
def q_exclusive_scan(spark, sf_dir):
    return _scanned(scan.exclusive_scan(_events(spark, sf_dir), "v", ORDER, -1))


@_query(f"SELECT event_id, CAST(7 + coalesce(sum(-v) {_BEFORE}, 0) AS BIGINT) AS scan FROM {EVENTS}")
def q_transform_exclusive_scan(spark, sf_dir):
    return _scanned(scan.transform_exclusive_scan(_events(spark, sf_dir), -F.col("v"), ORDER, 7))


@_query(f"SELECT event_id, CAST(3 + coalesce(sum(v) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS scan FROM {EVENTS}")
def q_scan_by_key(spark, sf_dir):
    return _scanned(scan.exclusive_scan(_events(spark, sf_dir), "v", ORDER, 3, by=["user_id"]))


@_query(f"SELECT event_id, CAST(max(v) {_OVER} AS BIGINT) AS scan FROM {EVENTS}")
def q_scan_max(spark, sf_dir):
    return _scanned(scan.inclusive_scan(_events(spark, sf_dir), "v", ORDER, op="max"))


@_query(f"SELECT event_id, CAST(bit_xor(v) {_OVER} AS BIGINT) AS scan FROM {EVENTS}")
def q_scan_xor(spark, sf_dir):
    return _scanned(scan.inclusive_scan(_events(spark, sf_dir), "v", ORDER, op="xor"))


@_query(f"SELECT event_id, string_agg(substr(event_type, 1, 1), '') OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS scan FROM {EVENTS}")
def q_scan_string(spark, sf_dir):
    rows = _events(spark, sf_dir).withColumn("c", F.substring("event_type", 1, 1))
    return scan.inclusive_scan(rows, "c", ORDER, op="concat", by=["user_id"]).select("event_id", "scan")


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cents"]


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "lineitem").select(*_LINE[:-1], F.round(F.col("l_extendedprice") * 100).cast("long").alias("cents"))


LINES = "(SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cents FROM lineitem)"


@_query(f"SELECT l_orderkey, cents, CAST(sum(cents) OVER (ORDER BY {', '.join(_LINE)} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS scan FROM {LINES}")
def q_scan_two_phase(spark, sf_dir):
    return scan.inclusive_scan(_lines(spark, sf_dir), "cents", _LINE).select("l_orderkey", "cents", F.col("scan").cast("long"))


@_query(f"SELECT event_id, CAST(min(v) {_OVER} AS BIGINT) AS scan FROM {EVENTS}")
def q_scan_custom(spark, sf_dir):
    return _scanned(scan.scan_custom(_events(spark, sf_dir).select("event_id", "ts", "v"), "v", ORDER, min, out_type="long"))


@_query("SELECT row_number() OVER (ORDER BY CAST(o_totalprice AS DECIMAL(18,2)), o_orderkey) - 1 AS pos, o_orderkey FROM orders")
def q_sort(spark, sf_dir):
    rows = _table(spark, sf_dir, "orders").select("o_orderkey", _money("o_totalprice").cast("double").alias("price"))
    return order.sorted_positions(rows, ["price"], ["o_orderkey"]).select("pos", "o_orderkey")


@_query("SELECT row_number() OVER (ORDER BY o_orderpriority, o_orderkey) - 1 AS pos, o_orderpriority, o_orderkey FROM orders")
def q_sort_by_key(spark, sf_dir):
    return order.sort_by_key(_table(spark, sf_dir, "orders"), "o_orderpriority", ["o_orderkey"])


@_query("SELECT vec_id, list_sort([CAST(round(x * 1000) AS BIGINT) for x in embedding], 'DESC') AS sorted FROM embeddings")
def q_sort_comparator(spark, sf_dir):
    values = F.transform("embedding", lambda x: F.round(x * F.lit(1000).cast("float")).cast("long"))  # in single precision, as in SQL
    return _table(spark, sf_dir, "embeddings").select("vec_id", order.sort_array(values, lambda a, b: a > b).alias("sorted"))


_SIDES = "SELECT CAST(round(o_totalprice) AS BIGINT) AS k, 1 AS src, o_orderkey AS id FROM orders UNION ALL SELECT CAST(round(c_acctbal) AS BIGINT), 2, c_custkey FROM customer"


def _merge_sides(spark, sf_dir):
    first = _table(spark, sf_dir, "orders").select(F.round("o_totalprice").cast("long").alias("k"), F.col("o_orderkey").alias("id"))
    second = _table(spark, sf_dir, "customer").select(F.round("c_acctbal").cast("long").alias("k"), F.col("c_custkey").alias("id"))
    return first, second


@_query(f"SELECT row_number() OVER (ORDER BY k, src, id) - 1 AS pos, k, src FROM ({_SIDES})")
def q_merge(spark, sf_dir):
    return order.merge(*_merge_sides(spark, sf_dir), "k", ["id"], ["id"])


@_query(f"SELECT row_number() OVER (ORDER BY k DESC, src, id) - 1 AS pos, k, src FROM ({_SIDES})")
def q_merge_desc(spark, sf_dir):
    return order.merge(*_merge_sides(spark, sf_dir), "k", ["id"], ["id"], descending=True)


@_query(f"SELECT row_number() OVER (ORDER BY floor(k / 1000), src, id) - 1 AS pos, k, src FROM ({_SIDES})")
def q_merge_comparator(spark, sf_dir):
    """Keys are compared by their thousands."""
    return order.merge(*_merge_sides(spark, sf_dir), "k", ["id"], ["id"], rank=lambda k: F.floor(k / 1000))


@_query(f"SELECT row_number() OVER (ORDER BY k, src, id) - 1 AS pos, k, id, src FROM ({_SIDES})")
def q_merge_by_key(spark, sf_dir):
    return order.merge_by_key(*_merge_sides(spark, sf_dir), "k", "id")


@_query(f"SELECT event_id, CAST(v + 10 AS VARCHAR) AS out FROM {EVENTS}")
def q_transform_unary(spark, sf_dir):
    return ranges.transform(_events(spark, sf_dir), "out", (F.col("v") + 10).cast("string")).select("event_id", "out")


@_query(
    "SELECT a.pos, a.o_orderkey, coalesce(CAST(a.o_orderkey + b.c_custkey AS BIGINT), -1) AS out FROM "
    "(SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS pos, o_orderkey FROM orders) a LEFT JOIN "
    "(SELECT row_number() OVER (ORDER BY c_custkey DESC) - 1 AS pos, c_custkey FROM customer) b ON a.pos = b.pos"
)
def q_transform_binary(spark, sf_dir):
    second = _table(spark, sf_dir, "customer").select("c_custkey", (-F.col("c_custkey")).alias("down"))
    both = ranges.transform_binary(_table(spark, sf_dir, "orders").select("o_orderkey"), second, ["o_orderkey"], ["down"], "out", lambda a, b: F.coalesce(a("o_orderkey") + b("c_custkey"), F.lit(-1)))
    return both.select("pos", F.col("a_o_orderkey").alias("o_orderkey"), "out")


@_query(f"SELECT event_id, v * 2 AS w, v > 100 AS large FROM {EVENTS}")
def q_for_each(spark, sf_dir):
    return ranges.for_each(_events(spark, sf_dir), w=F.col("v") * 2, large=F.col("v") > 100).select("event_id", "w", "large")


@_query("SELECT CAST(i AS BIGINT) AS i, CAST(i * i AS BIGINT) AS square FROM range(1000, 10, -7) t(i)")
def q_for_each_index(spark, sf_dir):
    return ranges.for_each_index(spark, 1000, 10, -7, square=F.col("i") * F.col("i"))


@_query("SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, 1 AS visits FROM range(0, 20) a(i), range(5, 45, 4) b(j)")
def q_for_each_by_index(spark, sf_dir):
    def box(frames):
        for f in frames:
            yield f.assign(i=f["i0"], j=f["i1"], visits=1)[["i", "j", "visits"]]

    return ranges.for_each_by_index(spark, [(0, 20, 1), (5, 45, 4)], box, "i long, j long, visits int")


@_query(f"SELECT event_id, 42 AS v FROM {EVENTS}")
def q_fill(spark, sf_dir):
    return ranges.fill(_events(spark, sf_dir), "v", 42).select("event_id", "v")


@_query(f"SELECT event_id, CASE WHEN row_number() OVER (ORDER BY ts, event_id) <= 100 THEN CAST(-9 AS BIGINT) ELSE v END AS v FROM {EVENTS}")
def q_fill_n(spark, sf_dir):
    return ranges.fill_n(_events(spark, sf_dir), "v", 100, F.lit(-9).cast("long"), ORDER).select("event_id", "v")


@_query(f"SELECT event_id, event_id * 7 % 13 AS g FROM {EVENTS}")
def q_generate(spark, sf_dir):
    return ranges.generate(_events(spark, sf_dir), "g", F.col("event_id") * 7 % 13).select("event_id", "g")


@_query("SELECT CAST(i AS BIGINT) AS pos, CAST(i * 3 + 1 AS BIGINT) AS g FROM range(0, 500) t(i)")
def q_generate_n(spark, sf_dir):
    return ranges.generate_n(spark, 500, "g", F.col("pos") * 3 + 1)


@_query("SELECT CAST(i AS BIGINT) AS i FROM range(10, 0, -3) t(i)")
def q_index_range_neg(spark, sf_dir):
    return ranges.index_range(spark, 10, 0, -3)


@_query("SELECT count(*) AS n FROM range(0) t(i)")
def q_index_range_invalid(spark, sf_dir):
    both = ranges.index_range(spark, 0, 10, -1).unionByName(ranges.index_range(spark, 10, 0, 1)).unionByName(ranges.index_range(spark, 0, 10, 0))
    return both.agg(F.count(F.lit(1)).alias("n"))


@_query("SELECT CAST(p AS BIGINT) AS pos, CAST(100 - p * 5 AS BIGINT) AS i FROM range(3, 9) t(p)")
def q_unravel(spark, sf_dir):
    flat = spark.range(ranges.distance(100, 0, -5)).withColumnRenamed("id", "pos")
    return ranges.unravel(100, -5, 3, 9)(flat).select("pos", F.col("i").cast("long"))


@_query("SELECT CAST(i * 48 + j * 8 + k AS BIGINT) AS pos, CAST(i AS BIGINT) AS i, CAST(j * 2 AS BIGINT) AS j, CAST(7 - k AS BIGINT) AS k FROM range(4) a(i), range(6) b(j), range(8) c(k)")
def q_nd_range(spark, sf_dir):
    return ranges.nd_range(spark, [(0, 4, 1), (0, 12, 2), (7, -1, -1)], ["i", "j", "k"])


@_query("SELECT CAST(4 AS BIGINT) AS inner_zero, CAST(0 AS BIGINT) AS outer_zero")
def q_nd_range_zero_inner(spark, sf_dir):
    inner = ranges.nd_range(spark, [(0, 4, 1), (0, 0, 1), (0, 8, 1)]).agg(F.count(F.lit(1)).alias("inner_zero"))
    outer = ranges.nd_range(spark, [(0, 0, 1), (0, 4, 1)]).agg(F.count(F.lit(1)).alias("outer_zero"))
    return inner.withColumn("k", F.lit(1)).join(outer.withColumn("k", F.lit(1)), "k").drop("k")


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    beg = F.unix_micros(F.col("ts").cast("timestamp"))
    return _table(spark, sf_dir, "events").select(
        F.lit(0).cast("long").alias("uid"), F.col("user_id").alias("worker"), F.lit(0).alias("level"), F.lit("").alias("name"), F.col("event_type").alias("type"), beg.alias("beg_us"), (beg + 600_000_000).alias("end_us")
    )


SEGMENTS = "(SELECT user_id AS worker, event_type AS type, epoch_us(ts) AS b, epoch_us(ts) + 600000000 AS e FROM events)"
MERGED = f"""(SELECT worker, min(b) AS b, max(e) AS e FROM (
  SELECT *, sum(n) OVER (PARTITION BY worker ORDER BY b, e ROWS UNBOUNDED PRECEDING) AS island FROM (
    SELECT *, CASE WHEN b > max(e) OVER (PARTITION BY worker ORDER BY b, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) THEN 1 ELSE 0 END AS n FROM {SEGMENTS}))
  GROUP BY worker, island)"""


@_query(f"SELECT type, count(*) AS n, CAST(sum(e - b) AS BIGINT) AS total_us, avg(e - b) AS avg_us, min(e - b) AS min_us, max(e - b) AS max_us FROM {SEGMENTS} GROUP BY type")
def q_type_stats(spark, sf_dir):
    return observe.type_stats(_segments(spark, sf_dir))


@_query(f"SELECT CAST(greatest(max(e) - min(b), 1) AS BIGINT) AS wall_us FROM {SEGMENTS}")
def q_wall_time(spark, sf_dir):
    return observe.wall_time(_segments(spark, sf_dir))


@_query(f"SELECT worker, b AS beg_us, e AS end_us FROM {MERGED}")
def q_interval_merge(spark, sf_dir):
    return observe.merged_intervals(_segments(spark, sf_dir), ["worker"])


_WORKERS = "(SELECT c_custkey AS worker FROM customer)"
_BUSY = f"SELECT w.worker, CAST(coalesce(sum(m.e - m.b), 0) AS BIGINT) AS busy_us FROM {_WORKERS} w LEFT JOIN {MERGED} m ON w.worker = m.worker GROUP BY w.worker"
_UTIL = f"SELECT worker, busy_us, CAST(greatest(wall - busy_us, 0) AS BIGINT) AS idle_us, busy_us / wall * 100 AS u FROM ({_BUSY}), (SELECT greatest(max(e) - min(b), 1) AS wall FROM {SEGMENTS})"


def _workers(spark, sf_dir):
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("worker"))


@_query(f"SELECT worker, busy_us, idle_us, CAST(round(u * 1000000) AS BIGINT) AS micro FROM ({_UTIL})")
def q_busy_util(spark, sf_dir):
    found = observe.utilization(_segments(spark, sf_dir), _workers(spark, sf_dir))
    return found.select("worker", "busy_us", "idle_us", F.round(F.col("utilization") * 1_000_000).cast("long").alias("micro"))


@_query(f"SELECT CAST(round(avg(u) * 10000) AS BIGINT) AS basis FROM ({_UTIL})")
def q_avg_utilization(spark, sf_dir):
    return observe.average_utilization(_segments(spark, sf_dir), _workers(spark, sf_dir)).select(F.round(F.col("avg_utilization") * 10_000).cast("long").alias("basis"))


_BINS = f"""(SELECT worker, CAST(unnest(range(least((b - o) // w, 63), least((e - 1 - o) // w, 63) + 1)) AS BIGINT) AS bin FROM {SEGMENTS},
  (SELECT min(b) AS o, greatest(1, (greatest(max(e) - min(b), 1) + 63) // 64) AS w FROM {SEGMENTS}))"""


@_query(f"SELECT bin, count(*) AS tasks FROM {_BINS} GROUP BY bin")
def q_concurrency_hist(spark, sf_dir):
    return observe.concurrency_histogram(_segments(spark, sf_dir), 64).select(F.col("bin").cast("long"), "tasks")


@_query(f"SELECT bin, count(DISTINCT worker) AS workers FROM {_BINS} GROUP BY bin")
def q_worker_hist(spark, sf_dir):
    return observe.worker_histogram(_segments(spark, sf_dir), 64).select(F.col("bin").cast("long"), "workers")


_US = "(SELECT CAST(i AS BIGINT) * i * i * 1000 AS us FROM range(1, 1000) t(i))"


@_query(f"SELECT us, CASE WHEN us < 10000 THEN us || ' us' WHEN us < 10000000 THEN us // 1000 || ' ms' WHEN us < 10000000000 THEN us // 1000000 || ' s' ELSE us // 60000000 || ' min' END AS said FROM {_US}")
def q_time_scale(spark, sf_dir):
    us = spark.range(1, 1000).select((F.col("id") * F.col("id") * F.col("id") * 1000).alias("us"))
    return us.select("us", observe.scaled_time(F.col("us")).alias("said"))


@_query(f"SELECT 'task' AS cat, CAST(worker AS VARCHAR) || '_' || CAST(row_number() OVER (PARTITION BY worker ORDER BY b, e) - 1 AS VARCHAR) AS name, 'X' AS ph, 1 AS pid, worker AS tid, b AS ts, e - b AS dur FROM {SEGMENTS}")
def q_chrome_trace(spark, sf_dir):
    return observe.chrome_trace(_segments(spark, sf_dir))


@_query(f"SELECT worker, type, b AS beg_us, e AS end_us FROM {SEGMENTS}")
def q_trace_round_trip(spark, sf_dir):
    return traces.decoded_traces(traces.encoded_traces(_segments(spark, sf_dir), ["worker"])).select("worker", "type", "beg_us", "end_us")


@_query(
    "SELECT doc_id, arg_min(ch, (-n, ch)) AS ch, max(n) AS n FROM (SELECT doc_id, ch, count(*) AS n FROM "
    "(SELECT doc_id, unnest(string_split(text, '')) AS ch FROM documents) WHERE ch <> '' GROUP BY doc_id, ch) GROUP BY doc_id"
)
def q_text_mode_char(spark, sf_dir):
    return workloads.mode_char(_table(spark, sf_dir, "documents"), "doc_id", "text")


_A = "CASE WHEN s // 2 = 0 THEN s ELSE s + 8 END"
_B = f"(SELECT s, CASE WHEN a > 4897 THEN a - 1834 ELSE a + 3 END AS b FROM (SELECT s, {_A} AS a FROM (SELECT event_id AS s FROM events)))"


def _if_else() -> list[Pipe]:
    a, b = F.col("a"), F.col("b")
    return [
        Pipe(SERIAL, lambda d: d.withColumn("a", F.when(F.floor(F.col("token") / 2) == 0, F.col("token")).otherwise(F.col("token") + 8))),
        Pipe(PARALLEL, lambda d: d.withColumn("b", F.when(a > 4897, a - 1834).otherwise(a + 3))),
        Pipe(SERIAL, lambda d: d.select("token", F.when(F.floor((b + 9) / 4) < 50, b + 1).otherwise(b + 17).alias("result"))),
    ]


@_query(f"SELECT s AS token, CASE WHEN (b + 9) // 4 < 50 THEN b + 1 ELSE b + 17 END AS result FROM {_B}")
def q_pipeline_ifelse(spark, sf_dir):
    tokens = _table(spark, sf_dir, "events").select(F.col("event_id").alias("token"))
    return ScalablePipeline(8, _if_else()).apply(tokens)


@_query("SELECT CAST(i AS BIGINT) AS token, CAST(i % 5 AS INTEGER) AS line, CAST(i * 4 + 3 AS BIGINT) AS value FROM range(0, 1111) t(i)")
def q_pipeline_counter(spark, sf_dir):
    def pipe(p: int) -> Pipe:
        return Pipe(SERIAL, lambda d: d.withColumn("value", F.col("token") * 4 + p))

    tokens = spark.range(2000).withColumnRenamed("id", "token")
    return Pipeline(5, *(pipe(p) for p in range(4))).run(tokens, stop=F.col("token") >= 1111).select("token", "line", "value")


@_query("SELECT doc_id, CAST(length(text) * 2 AS BIGINT) AS twice FROM documents")
def q_data_pipeline(spark, sf_dir):
    tokens = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("token"), "text")
    pipeline = DataPipeline(
        4,
        data_pipe(SERIAL, lambda d: d, None, "token long, text string"),
        data_pipe(PARALLEL, lambda d: d.select("token", F.length("text").alias("n")), "text string", "token long, n int"),
        data_pipe(SERIAL, lambda d: d.select(F.col("token").alias("doc_id"), (F.col("n") * 2).cast("long").alias("twice")), "n int", None),
    )
    return pipeline.apply(tokens)


#: Customers, orders and parts as one graph of whole ids: customer to order to part.
_ORDER_AT, _PART_AT = 1 << 40, 1 << 41
EDGES = f"(SELECT o_custkey AS src, {_ORDER_AT} + o_orderkey AS dst FROM orders UNION SELECT {_ORDER_AT} + l_orderkey, {_PART_AT} + l_partkey FROM lineitem)"


def _listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The edges as the tables list them: several lines of an order for one part list an edge several times."""
    first = _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("long").alias("src"), (F.lit(_ORDER_AT) + F.col("o_orderkey")).alias("dst"))
    second = _table(spark, sf_dir, "lineitem").select((F.lit(_ORDER_AT) + F.col("l_orderkey")).alias("src"), (F.lit(_PART_AT) + F.col("l_partkey")).alias("dst"))
    return first.union(second)


def _edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workloads.distinct_edges(_listed(spark, sf_dir))


#: Orders as a hierarchy of whole keys with short cuts: each follows those at a half and at a third of its key.
_CHAIN = "(SELECT o_orderkey // 2 AS src, o_orderkey AS dst FROM orders WHERE o_orderkey > 0 UNION SELECT o_orderkey // 3, o_orderkey FROM orders WHERE o_orderkey > 0)"


def _chain(spark, sf_dir):
    """Key 0 is the root and follows nothing."""
    of = _table(spark, sf_dir, "orders").where("o_orderkey > 0").select(F.col("o_orderkey").cast("long").alias("dst"))
    return workloads.distinct_edges(of.select(F.explode(F.array(*(F.floor(F.col("dst") / n) for n in (2, 3)))).alias("src"), "dst"))


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("node")).distinct()


@_query(f"SELECT node, CAST(sum(o) AS BIGINT) AS n_out, CAST(sum(i) AS BIGINT) AS n_in FROM (SELECT src AS node, 1 AS o, 0 AS i FROM {EDGES} UNION ALL SELECT dst, 0, 1 FROM {EDGES}) GROUP BY node")
def q_graph_degrees(spark, sf_dir):
    return workloads.degrees(_listed(spark, sf_dir), once=True)


@_query(f"WITH RECURSIVE t(node, level) AS (SELECT CAST(0 AS BIGINT), 0 UNION SELECT dst, level + 1 FROM t JOIN {_CHAIN} e ON e.src = t.node) SELECT node, CAST(min(level) AS INTEGER) AS level FROM t GROUP BY node")
def q_bfs_levels(spark, sf_dir):
    return workloads.levels_from(_chain(spark, sf_dir), spark.range(1).withColumnRenamed("id", "node"))


_REACH = f"WITH RECURSIVE t(node) AS (SELECT CAST(7 AS BIGINT) UNION SELECT dst FROM t JOIN {_CHAIN} e ON e.src = t.node) SELECT node FROM t"


@_query(_REACH)
def q_stale_targets(spark, sf_dir):
    return workloads.stale_targets(_chain(spark, sf_dir), spark.range(7, 8).withColumnRenamed("id", "node"))


@_query(f"WITH RECURSIVE t(node, level) AS (SELECT node, 0 FROM (SELECT src AS node FROM {EDGES} EXCEPT SELECT dst FROM {EDGES}) UNION SELECT dst, level + 1 FROM t JOIN {EDGES} e ON e.src = t.node) SELECT node, CAST(max(level) AS BIGINT) AS value FROM t GROUP BY node")
def q_topo_levels(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return workloads.longest_paths(_nodes(edges), edges)


@_query(f"""WITH RECURSIVE e AS (SELECT * FROM {EDGES}), t(node, cost) AS (
  SELECT node, node % 11 + 1 FROM (SELECT src AS node FROM e EXCEPT SELECT dst FROM e)
  UNION SELECT dst, cost + dst % 11 + 1 FROM t JOIN e ON e.src = t.node) SELECT node, CAST(max(cost) AS BIGINT) AS value FROM t GROUP BY node""")
def q_pert(spark, sf_dir):
    edges = _edges(spark, sf_dir)
    return workloads.longest_paths(_nodes(edges).withColumn("w", F.col("node") % 11 + 1), edges, "w")


#: Quantities by supplier and part: a sparse matrix of whole keys. It is square over the parts' keys, its rows beyond the suppliers are zero.
_M = "(SELECT l_suppkey AS i, l_partkey AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2)"


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), F.col("l_partkey").alias("j"), F.col("l_quantity").cast("long").alias("v"))
    return rows.groupBy("i", "j").agg(F.sum("v").alias("v"))


#: A vector over the parts' keys.
_ONES = "(SELECT p_partkey AS i, p_partkey + 1 AS x FROM part)"


def _ones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("i"), (F.col("p_partkey") + 1).alias("v"))


@_query(f"SELECT a.i, b.i AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM {_M} a JOIN {_M} b ON a.k = b.k GROUP BY a.i, b.i")
def q_matmul(spark, sf_dir):
    a = _matrix(spark, sf_dir)
    return linalg.gemm(a, linalg.transpose(a))


@_query(f"SELECT m.i, CAST(sum(m.v * o.x) AS BIGINT) AS v FROM {_M} m JOIN {_ONES} o ON m.k = o.i GROUP BY m.i")
def q_spmv(spark, sf_dir):
    return linalg.gemv(_matrix(spark, sf_dir), _ones(spark, sf_dir))


@_query(f"SELECT k AS i, i AS j, CAST(v AS BIGINT) AS v FROM {_M}")
def q_transpose(spark, sf_dir):
    return linalg.transpose(_matrix(spark, sf_dir))


_VX = f"(SELECT i, CAST(sum(v) AS BIGINT) - 15000 AS x FROM {_M} GROUP BY i)"


def _vector(spark, sf_dir):
    return _matrix(spark, sf_dir).groupBy("i").agg((F.sum("v") - 15000).alias("v"))


@_query(f"SELECT CAST(sum(abs(x)) AS BIGINT) AS asum, CAST(sum(x * x) AS BIGINT) AS dot, CAST(round(sqrt(sum(x * x)) * 1000) AS BIGINT) AS nrm2, arg_min(i, (-abs(x), i)) AS amax, arg_min(i, (abs(x), i)) AS amin FROM {_VX}")
def q_blas1(spark, sf_dir):
    x = _vector(spark, sf_dir)
    one = lambda df, name, c="v": df.select(F.lit(1).alias("k"), F.col(c).alias(name))
    parts = [one(linalg.asum(x), "asum"), one(linalg.dot(x, x), "dot"), one(linalg.nrm2(x).select(F.round(F.col("v") * 1000).cast("long").alias("v")), "nrm2"), one(linalg.amax(x), "amax", "i"), one(linalg.amin(x), "amin", "i")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, "k")
    return out.drop("k")


@_query(f"SELECT i, CAST(3 * x + 5 * (i + 1) AS BIGINT) AS v FROM {_VX}")
def q_axpy(spark, sf_dir):
    x = _vector(spark, sf_dir)
    return linalg.geam(x, x.select("i", (F.col("i") + 1).alias("v")), 3, 5)


@_query(f"WITH m AS (SELECT i, k AS j, v FROM {_M} WHERE k <= i), s AS (SELECT * FROM m UNION ALL SELECT j, i, v FROM m WHERE i <> j) SELECT s.i, CAST(sum(s.v * o.x) AS BIGINT) AS v FROM s JOIN {_ONES} o ON s.j = o.i GROUP BY s.i")
def q_symv(spark, sf_dir):
    return linalg.symv(_matrix(spark, sf_dir), _ones(spark, sf_dir))


def _lower(spark, sf_dir):
    """The part of the matrix below its diagonal, which is set to 2000 for each supplier: twice what a row holds, so solutions are stable."""
    below = _matrix(spark, sf_dir).where("j < i").withColumn("v", F.col("v").cast("double"))
    key = F.col("s_suppkey")
    return below.unionByName(_table(spark, sf_dir, "supplier").select(key.alias("i"), key.alias("j"), F.lit(2000.0).alias("v")))


@_query("SELECT s_suppkey AS i, CAST(s_suppkey * 3 + 1 AS BIGINT) AS v FROM supplier")
def q_trsv(spark, sf_dir):
    """A triangular product with a vector, solved for that vector again; the solution is unique."""
    lower, x = cut(_lower(spark, sf_dir)), _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("i"), (F.col("s_suppkey") * 3 + 1).alias("v"))
    return linalg.trsv(lower, linalg.trmv(lower, x)).select("i", F.round("v").cast("long").alias("v"))


_SQUARE = f"(SELECT i, k AS j, v FROM {_M})"
_LOWER = f"(SELECT * FROM {_SQUARE} WHERE j <= i)"
_FULL = f"(SELECT * FROM {_LOWER} UNION ALL SELECT j, i, v FROM {_LOWER} WHERE i <> j)"
_X, _Y = (f"(SELECT CAST({c}_nationkey AS BIGINT) AS i, count(*) AS v FROM {t} GROUP BY 1)" for c, t in (("s", "supplier"), ("c", "customer")))


def _xy(spark, sf_dir):
    """Two short vectors for dense products: suppliers and customers by nation."""
    of = lambda t, c: _table(spark, sf_dir, t).groupBy(F.col(c).cast("long").alias("i")).agg(F.count(F.lit(1)).alias("v"))
    return of("supplier", "s_nationkey"), of("customer", "c_nationkey")


@_query(f"SELECT i, CAST(7 * x AS BIGINT) AS v FROM {_VX}")
def q_scal(spark, sf_dir):
    return linalg.scal(_vector(spark, sf_dir), 7)


@_query(f"SELECT i, CAST(x AS BIGINT) AS first, CAST(i AS BIGINT) AS second FROM {_VX}")
def q_swap(spark, sf_dir):
    x = _vector(spark, sf_dir)
    first, second = linalg.swap(linalg.vcopy(x.select("i", F.col("i").alias("v"))), x)
    return first.withColumnRenamed("v", "first").join(second.withColumnRenamed("v", "second"), "i")


@_query(f"SELECT a.i, CAST(sum(a.v * o.x) AS BIGINT) AS v FROM {_LOWER} a JOIN {_ONES} o ON a.j = o.i GROUP BY a.i")
def q_trmv(spark, sf_dir):
    return linalg.trmv(_matrix(spark, sf_dir), _ones(spark, sf_dir))


@_query(f"SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM (SELECT * FROM {_SQUARE} UNION ALL SELECT a.i, b.i, 3 * a.v * b.v FROM {_X} a, {_X} b) GROUP BY i, j")
def q_syr(spark, sf_dir):
    return linalg.syr(_matrix(spark, sf_dir), _xy(spark, sf_dir)[0], 3)


@_query(f"SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM (SELECT * FROM {_SQUARE} UNION ALL SELECT a.i, b.i, 2 * a.v * b.v FROM {_X} a, {_Y} b UNION ALL SELECT b.i, a.i, 2 * a.v * b.v FROM {_X} a, {_Y} b) GROUP BY i, j")
def q_syr2(spark, sf_dir):
    return linalg.syr2(_matrix(spark, sf_dir), *_xy(spark, sf_dir), 2)


def _times(a: str, b: str, factor: int = 1) -> str:
    return f"SELECT a.i, b.j, {factor} * a.v * b.v AS v FROM {a} a JOIN {b} b ON a.j = b.i"


def _summed(*products: str) -> str:
    return f"SELECT i, j, CAST(sum(v) AS BIGINT) AS v FROM ({' UNION ALL '.join(products)}) GROUP BY i, j"


_TURNED = f"(SELECT j AS i, i AS j, v FROM {_SQUARE})"


@_query(_summed(_times(_FULL, _SQUARE)))
def q_symm(spark, sf_dir):
    a = _matrix(spark, sf_dir)
    return linalg.symm(a, a)


@_query(_summed(_times(_SQUARE, _TURNED, 2)))
def q_syrk(spark, sf_dir):
    return linalg.syrk(_matrix(spark, sf_dir), 2)


@_query(_summed(_times(_SQUARE, _SQUARE, 2), _times(_TURNED, _TURNED, 2)))
def q_syr2k(spark, sf_dir):
    a = _matrix(spark, sf_dir)
    return linalg.syr2k(a, linalg.transpose(a), 2)


@_query(_summed(_times(_SQUARE, _SQUARE, 3)))
def q_syrkx(spark, sf_dir):
    a = _matrix(spark, sf_dir)
    return linalg.syrkx(a, linalg.transpose(a), 3)


@_query(_summed(_times(_LOWER, _SQUARE)))
def q_trmm(spark, sf_dir):
    a = _matrix(spark, sf_dir)
    return linalg.trmm(a, a)


_MONTHLY = "(SELECT l_suppkey AS i, CAST(year(l_shipdate) * 12 + month(l_shipdate) AS BIGINT) AS j, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS v FROM lineitem GROUP BY 1, 2)"


@_query(f"SELECT i, j, v FROM {_MONTHLY}")
def q_trsm(spark, sf_dir):
    """A triangular product with quantities by supplier and month, solved for these again; the solution is unique."""
    month = (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long")
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("i"), month.alias("j"), F.col("l_quantity").cast("long").alias("v"))
    lower, x = cut(_lower(spark, sf_dir)), rows.groupBy("i", "j").agg(F.sum("v").alias("v"))
    return linalg.trsm(lower, linalg.gemm(lower, x)).select("i", "j", F.round("v").cast("long").alias("v")).where("v <> 0")


@_query(f"SELECT a.i % 2 AS g, a.i, b.i AS j, CAST(sum(a.v * b.v) AS BIGINT) AS v FROM {_M} a JOIN {_M} b ON a.k = b.k AND a.i % 2 = b.i % 2 GROUP BY a.i, b.i")
def q_gemm_batched(spark, sf_dir):
    a = _matrix(spark, sf_dir).withColumn("g", F.col("i") % 2)
    t = a.select("g", F.col("j").alias("i"), F.col("i").alias("j"), "v")
    return linalg.gemm(a, t, ["g"])


@_query("""WITH c AS (SELECT vec_id AS c, [round(CAST(x AS DOUBLE), 3) for x in embedding] AS e FROM embeddings ORDER BY vec_id LIMIT 4),
d AS (SELECT v.vec_id, c.c, round(list_sum([(CAST(v.embedding[i] AS DOUBLE) - c.e[i]) ** 2 for i in range(1, 65)]), 6) AS d FROM embeddings v, c)
SELECT vec_id, CAST(arg_min(c, (d, c)) AS INTEGER) AS center FROM d GROUP BY vec_id""")
def q_kmeans_iter(spark, sf_dir):
    points = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    centers = [[float(v) for v in r[0]] for r in points.orderBy("vec_id").limit(4).select(F.transform("embedding", lambda x: F.round(x, 3))).collect()]  # k rows
    return workloads.kmeans_assign(points, centers).select("vec_id", "center")


def _kmeans_sql(k: int, rounds: int) -> str:
    """Rounds of nearest centers and means, one after another; centers: c, i, v."""
    steps = [f"p AS (SELECT vec_id, i, CAST(embedding[i] AS DOUBLE) AS v FROM embeddings, range(1, 65) t(i)), c0 AS (SELECT dense_rank() OVER (ORDER BY vec_id) - 1 AS c, i, v FROM p WHERE vec_id IN (SELECT vec_id FROM embeddings ORDER BY vec_id LIMIT {k}))"]
    for r in range(rounds):
        steps.append(f"d{r} AS (SELECT vec_id, c, round(sum((p.v - c.v) * (p.v - c.v)), 6) AS d FROM p JOIN c{r} c ON p.i = c.i GROUP BY vec_id, c)")
        steps.append(f"a{r} AS (SELECT vec_id, arg_min(c, (d, c)) AS c FROM d{r} GROUP BY vec_id)")
        steps.append(f"m{r} AS (SELECT c, i, avg(v) AS v FROM p JOIN a{r} USING (vec_id) GROUP BY c, i)")
        steps.append(f"c{r + 1} AS (SELECT o.c, o.i, coalesce(m.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} m ON o.c = m.c AND o.i = m.i)")
    return f"WITH {', '.join(steps)} SELECT CAST(c AS INTEGER) AS center, CAST(i - 1 AS INTEGER) AS i, CAST(round(v * 100000) AS BIGINT) AS v FROM c{rounds}"


@_query(_kmeans_sql(4, 3))
def q_kmeans_rounds(spark, sf_dir):
    points = _table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double")).alias("embedding"))
    centers = workloads.kmeans(points, 4, 3, "vec_id")
    rows = [(c, i, v) for c, center in enumerate(centers) for i, v in enumerate(center)]  # the model
    return spark.createDataFrame(rows, "center int, i int, v double").select("center", "i", F.round(F.col("v") * 100_000).cast("long").alias("v"))


@_query("SELECT CAST(count(*) AS BIGINT) AS primes FROM (SELECT i FROM range(2, 5000) t(i) WHERE NOT EXISTS (SELECT 1 FROM range(2, 71) d(d) WHERE d * d <= i AND i % d = 0))")
def q_primes(spark, sf_dir):
    return ranges.index_range(spark, 0, 5000).where(workloads.is_prime(F.col("i"), 5000)).agg(F.count(F.lit(1)).alias("primes"))


@_query("""WITH RECURSIVE t(i, a, b) AS (SELECT 0, CAST(0 AS BIGINT), CAST(1 AS BIGINT) UNION ALL SELECT i + 1, b, a + b FROM t WHERE i < 60)
SELECT CAST(i AS BIGINT) AS i, a AS f FROM t""")
def q_fibonacci(spark, sf_dir):
    return workloads.fibonacci(spark, 60)


@_query("SELECT CAST(499999500000 AS BIGINT) AS value")
def q_skynet(spark, sf_dir):
    return workloads.skynet(spark, 6)


@_query("SELECT CAST(round(sum(CASE WHEN i IN (0, 1000) THEN 0.5 ELSE 1 END * (i * 0.001) * (i * 0.001)) * 0.001 * 1000000000) AS BIGINT) AS nano FROM range(0, 1001) t(i)")
def q_integrate(spark, sf_dir):
    return workloads.integrate(spark, lambda x: x * x, 0.0, 1.0, 1000).select(F.round(F.col("value") * 1_000_000_000).cast("long").alias("nano"))


_D1 = "((ln(s / 100.0) + (0.03 + 0.02) * t) / (0.2 * sqrt(t)))"


def _normal(x: str) -> str:
    z = f"(1 / (1 + 0.2316419 * abs({x})))"
    tail = f"(exp(-({x}) * ({x}) / 2) * 0.3989422804014327 * {z} * (0.319381530 + {z} * (-0.356563782 + {z} * (1.781477937 + {z} * (-1.821255978 + {z} * 1.330274429)))))"
    return f"(CASE WHEN {x} < 0 THEN {tail} ELSE 1 - {tail} END)"


@_query(f"SELECT i, CAST(round((s * {_normal('d')} - 100.0 * exp(-0.03 * t) * {_normal('(d - 0.2 * sqrt(t))')}) * 10000) AS BIGINT) AS price FROM (SELECT i, s, t, {_D1} AS d FROM (SELECT CAST(i AS BIGINT) AS i, CAST(50 + i AS DOUBLE) AS s, CAST(1 AS DOUBLE) AS t FROM range(0, 100) r(i)))")
def q_black_scholes(spark, sf_dir):
    s = (F.col("i") + 50).cast("double")
    call = workloads.black_scholes_call(s, F.lit(100.0), F.lit(0.03), F.lit(0.2), F.lit(1.0))
    return ranges.index_range(spark, 0, 100).select("i", F.round(call * 10_000).cast("long").alias("price"))


@_query("""WITH RECURSIVE g AS (SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, j * CAST(0.125 AS DOUBLE) - 2 AS cx, i * CAST(0.125 AS DOUBLE) - 2 AS cy FROM range(32) a(i), range(32) b(j)),
t(i, j, cx, cy, x, y, n) AS (SELECT i, j, cx, cy, CAST(0 AS DOUBLE), CAST(0 AS DOUBLE), 0 FROM g UNION ALL SELECT i, j, cx, cy, x * x - y * y + cx, 2 * x * y + cy, n + 1 FROM t WHERE x * x + y * y <= 4 AND n < 20)
SELECT i, j, CAST(max(n) AS INTEGER) AS n FROM t GROUP BY i, j""")
def q_mandelbrot(spark, sf_dir):
    return workloads.mandelbrot(spark, 32, 20)


@_query("SELECT CAST(92 AS BIGINT) AS solutions")
def q_n_queens(spark, sf_dir):
    return workloads.n_queens(spark, 8).agg(F.count(F.lit(1)).alias("solutions"))


def _grid(spark, n):
    return ranges.nd_range(spark, [(0, n, 1), (0, n, 1)], ["i", "j"]).select("i", "j", ((F.col("i") * 7 + F.col("j") * 13) % 17).cast("double").alias("v"))


_GRID = "(SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, (i * 7 + j * 13) % 17 AS v FROM range({n}) a(i), range({n}) b(j))"


@_query(f"SELECT a.i, a.j, CAST(sum(b.v * CASE WHEN a.i = b.i AND a.j = b.j THEN 4 ELSE 1 END) AS DOUBLE) AS v FROM {_GRID.format(n=24)} a JOIN {_GRID.format(n=24)} b ON abs(a.i - b.i) <= 1 AND abs(a.j - b.j) <= 1 GROUP BY a.i, a.j")
def q_conv2d(spark, sf_dir):
    kernel = [((di, dj), 4.0 if di == dj == 0 else 1.0) for di in (-1, 0, 1) for dj in (-1, 0, 1)]
    return workloads.stencil(_grid(spark, 24), kernel, ["i", "j"])


_CUBE = "(SELECT CAST(i AS BIGINT) AS i, CAST(j AS BIGINT) AS j, CAST(k AS BIGINT) AS k, (i + 2 * j + 3 * k) % 5 AS v FROM range(8) a(i), range(8) b(j), range(8) c(k))"


@_query(f"SELECT a.i, a.j, a.k, CAST(sum(b.v) AS DOUBLE) AS v FROM {_CUBE} a JOIN {_CUBE} b ON abs(a.i - b.i) + abs(a.j - b.j) + abs(a.k - b.k) <= 1 GROUP BY a.i, a.j, a.k")
def q_stencil3d(spark, sf_dir):
    cube = ranges.nd_range(spark, [(0, 8, 1)] * 3, ["i", "j", "k"]).select("i", "j", "k", ((F.col("i") + 2 * F.col("j") + 3 * F.col("k")) % 5).cast("double").alias("v"))
    star = [((0, 0, 0), 1.0), *(((a, b, c), 1.0) for a, b, c in ((1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0), (0, 0, 1), (0, 0, -1)))]
    return workloads.stencil(cube, star, ["i", "j", "k"])


@_query(f"""WITH RECURSIVE g AS (SELECT * FROM {_GRID.format(n=8)}), t(i, j, v) AS (SELECT i, j, v FROM g WHERE i = 0 AND j = 0
UNION SELECT g.i, g.j, t.v + g.v FROM t JOIN g ON (g.i = t.i + 1 AND g.j = t.j) OR (g.i = t.i AND g.j = t.j + 1)) SELECT i, j, CAST(min(v) AS DOUBLE) AS v FROM t GROUP BY i, j""")
def q_wavefront(spark, sf_dir):
    return workloads.wavefront(spark, _grid(spark, 8), 8)


_CITIES = [[0 if a == b else (a * 5 + b * 5 + a * b * 3) % 23 + 1 for b in range(7)] for a in range(7)]


_LEGS = "(VALUES " + ", ".join(f"({a}, {b}, {d})" for a, row in enumerate(_CITIES) for b, d in enumerate(row)) + ") l(a, b, d)"


@_query(f"""WITH RECURSIVE l(a, b, d) AS (SELECT * FROM {_LEGS}), p(path, last, cost) AS (SELECT [0], 0, 0 UNION ALL
SELECT list_append(path, b), b, cost + d FROM p JOIN l ON l.a = p.last WHERE NOT list_contains(path, b))
SELECT CAST(cost + d AS INTEGER) AS cost, path FROM p JOIN l ON l.a = p.last AND l.b = 0 WHERE len(path) = 7 ORDER BY cost + d, path LIMIT 1""")
def q_tsp(spark, sf_dir):
    return workloads.shortest_tour(spark, _CITIES)


@_query(f"SELECT (SELECT count(*) FROM (SELECT src FROM {_CHAIN} UNION SELECT dst FROM {_CHAIN})) AS nodes, CAST(0 AS BIGINT) AS clashes, true AS few")
def q_graph_coloring(spark, sf_dir):
    """Whether the coloring is one: its nodes, edges whose ends have one color, and that a node's color is at most its number of neighbours."""
    edges = _chain(spark, sf_dir)
    colors = cut(workloads.greedy_coloring(_nodes(edges), edges))
    of = lambda c: colors.select(F.col("node").alias(c), F.col("color").alias(f"{c}_color"))
    ends = edges.where("src <> dst").join(of("src"), "src").join(of("dst"), "dst")
    clashes = ends.agg(F.count_if(F.col("src_color") == F.col("dst_color")).alias("clashes"))
    near = edges.select("src", "dst").union(edges.select("dst", "src")).where("src <> dst").distinct().groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("n"))
    few = colors.join(near, "node", "left").agg(F.count(F.lit(1)).alias("nodes"), F.bool_and(F.col("color") <= F.coalesce("n", F.lit(0))).alias("few"))
    return few.withColumn("k", F.lit(1)).join(clashes.withColumn("k", F.lit(1)), "k").select("nodes", "clashes", "few")


@_query("""SELECT run, CAST(coalesce(min(i) FILTER (('0x' || substr(md5('42:' || run || ':' || i), 1, 1))::INTEGER % 2 = 1), 64) AS BIGINT) AS flips
FROM range(1000) r(run), range(1, 65) t(i) GROUP BY run""")
def q_coin_flips(spark, sf_dir):
    return workloads.coin_flips(spark, 1000, 42)


@_query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')")
def q_bloom_lookup(spark, sf_dir):
    known = _table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"))
    return workloads.may_be_known(_table(spark, sf_dir, "orders"), known, "o_custkey").select("o_orderkey")


@_query(
    f"SELECT event_id, v > 0 AND v & (v - 1) = 0 AS p2, CASE WHEN v >= 1 THEN CAST(length(bin(v)) - 1 AS INTEGER) END AS lg, "
    f"CASE WHEN v <= 0 THEN 0 WHEN v = 1 THEN 1 ELSE CAST(1 AS BIGINT) << length(bin(v - 1)) END AS np, greatest(least(v, event_id), least(greatest(v, event_id), 5000)) AS m3, 'e' || event_id || ':' || v AS s FROM {EVENTS}"
)
def q_scalars(spark, sf_dir):
    v, e = F.col("v"), F.col("event_id")
    return _events(spark, sf_dir).select("event_id", scalars.is_pow2(v).alias("p2"), scalars.floor_log2(v).alias("lg"), scalars.next_pow2(v).alias("np"), scalars.median3(v, e, F.lit(5000).cast("long")).alias("m3"), scalars.stringify("e", e, ":", v).alias("s"))


@_query("SELECT CAST(1 - 65536 AS BIGINT) AS sum1, CAST(1 + 14 * 65536 AS BIGINT) AS sum2, CAST(65536 AS BIGINT) AS good1, CAST(65536 AS BIGINT) AS good2, CAST(65536 AS BIGINT) AS good3, CAST(65536 AS BIGINT) AS good4")
def q_mixed_dag(spark, sf_dir):
    """Many operators as one graph of tasks, checked against closed forms."""
    n, graph, pos = 65536, dag.TaskGraph("mixed"), ["pos"]
    data = spark.range(n).select(F.col("id").alias("pos"), F.lit(10).cast("long").alias("d"))
    up, down = data.withColumn("d", F.col("d") + 1), data.withColumn("d", F.lit(13).cast("long"))
    count = lambda df, want: df.agg(F.count_if(F.col("scan") == want).alias("n"))
    tasks = {
        "sum1": lambda: reduce.transform_reduce(up, F.col("d") - 12, F.lit(1).cast("long")),
        "sum2": lambda: reduce.transform_reduce(up, F.lit(14).cast("long"), F.lit(1).cast("long")),
        "good1": lambda: count(scan.inclusive_scan(up, "d", pos), (F.col("pos") + 1) * 11),
        "good2": lambda: count(scan.exclusive_scan(up.withColumn("d", F.lit(12).cast("long")), "d", pos, -1), F.col("pos") * 12 - 1),
        "good3": lambda: count(scan.transform_inclusive_scan(down, -F.col("d"), pos), (F.col("pos") + 1) * -13),
        "good4": lambda: count(
            scan.with_position(scan.transform_exclusive_scan(data, F.lit(-1).cast("long"), pos, 7).select(F.col("scan").alias("x")), ["x"], "at").withColumn("scan", F.col("x")), 7 - (n - 1 - F.col("at"))
        ),
    }
    for name, task in tasks.items():
        graph.emplace(lambda task=task: task().first()[0], name=name)
    dag.Executor(spark).run(graph).get()
    return spark.createDataFrame([tuple(int(t.data) for t in graph.nodes)], ", ".join(f"{t.name} long" for t in graph.nodes))


@_query("SELECT CAST(5 AS BIGINT) AS rounds")
def q_condition_loop(spark, sf_dir):
    """A loop through a condition task: the body runs until the condition leaves it."""
    graph, seen = dag.TaskGraph("loop"), []
    start, body, done = graph.emplace(lambda: None, lambda: seen.append(spark.range(3).count()), lambda: None)
    again = graph.condition(lambda: 0 if len(seen) < 5 else 1)
    start.precede(body)
    body.precede(again)
    again.precede(body, done)
    dag.Executor(spark).run(graph).get()
    return spark.createDataFrame([(len(seen),)], "rounds long")


@_query("SELECT CAST(40 AS BIGINT) AS ran, true AS within")
def q_semaphore(spark, sf_dir):
    """Forty tasks of which at most three run at a time, and three do: the first ones wait until all three are there."""
    import threading

    graph, limit, lock, full = dag.TaskGraph(), dag.Semaphore(3), threading.Lock(), threading.Event()
    now, most, ran = [0], [0], [0]

    def body() -> None:
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
            if now[0] == 3:
                full.set()
        full.wait(30)
        with lock:
            now[0] -= 1
            ran[0] += 1

    for _ in range(40):
        graph.emplace(body).acquire(limit).release(limit)
    dag.Executor().run(graph).get()
    return spark.createDataFrame([(ran[0], most[0] == 3)], "ran long, within boolean")


@_query(f"SELECT CAST(sum(v) AS BIGINT) AS a, CAST(max(v) AS BIGINT) AS b FROM {EVENTS}")
def q_async(spark, sf_dir):
    """Two asynchronous actions and one that depends on both."""
    executor, events = dag.Executor(spark), _events(spark, sf_dir)
    total = executor.async_(lambda: events.agg(F.sum("v")).first()[0])
    largest = executor.async_(lambda: events.agg(F.max("v")).first()[0])
    both = executor.dependent_async(lambda: (int(total.result()), int(largest.result())), total, largest, None)
    return spark.createDataFrame([both.result()], "a long, b long")


@_query("SELECT false AS finished")
def q_cancel(spark, sf_dir):
    """A run that is cancelled while its first task runs never begins the second."""
    import threading

    graph, started, go, finished = dag.TaskGraph(), threading.Event(), threading.Event(), []
    first, second = graph.emplace(lambda: (started.set(), go.wait(10)), lambda: finished.append(1))
    first.precede(second)
    future = dag.Executor().run(graph)
    started.wait(10)
    future.cancel()
    go.set()
    try:
        future.get()
    except BaseException:  # noqa: BLE001  cancelled
        pass
    return spark.createDataFrame([(bool(finished),)], "finished boolean")


@_query("SELECT * FROM (VALUES (CAST(0 AS BIGINT), 'load', 'static'), (1, 'check', 'condition'), (2, 'fix', 'static'), (3, 'save', 'static')) t(id, name, type)")
def q_graph_nodes(spark, sf_dir):
    graph = dag.TaskGraph("flow")
    load = graph.emplace(lambda: None, name="load")
    check = graph.condition(lambda: 1, name="check")
    fix, save = graph.emplace(lambda: None, name="fix"), graph.emplace(lambda: None, name="save")
    load.precede(check)
    check.precede(fix, save)
    fix.precede(check)
    return graph.as_frames(spark)[0]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
