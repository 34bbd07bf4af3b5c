import threading
import time

import pytest
from pyspark.sql import functions as F

from rangeloom.plans import dag, workloads
from rangeloom.sources import traces
from rangeloom.streaming.pipeline import PARALLEL, SERIAL, DataPipeline, Pipe, Pipeline, data_pipe, deferred_order


def test_order_and_join():
    graph, seen = dag.TaskGraph(), []
    a, b, c, d = graph.emplace(*(lambda x=x: seen.append(x) for x in "abcd"))
    a.precede(b, c)
    d.succeed(b, c)
    dag.Executor().run_n(graph, 3).get()
    assert len(seen) == 12 and seen[0] == "a" and seen[3] == "d" and set(seen[1:3]) == {"b", "c"}


def test_multi_condition_ignores_what_is_out_of_range():
    graph, hits = dag.TaskGraph(), []
    pick = graph.multi_condition(lambda: [0, 2, 7, -1])
    pick.precede(*graph.emplace(*(lambda x=x: hits.append(x) for x in range(3))))
    dag.Executor().run(graph).get()
    assert sorted(hits) == [0, 2]
    assert graph.nodes[1].num_weak_dependencies == 1 and graph.nodes[1].num_strong_dependencies == 0


def test_subflow_module_runtime_and_adopt():
    seen = []
    inner = dag.TaskGraph("inner")
    inner.emplace(lambda: seen.append("inner"))
    graph = dag.TaskGraph()

    def flow(sub):
        sub.linearize(list(sub.emplace(lambda: seen.append("s1"), lambda: seen.append("s2"))))
        sub.join()
        seen.append("joined")
        with pytest.raises(RuntimeError):
            sub.join()

    graph.linearize([graph.composed_of(inner), graph.subflow(flow), graph.runtime(lambda rt: [rt.async_(lambda: seen.append("child")) for _ in range(3)]), graph.emplace(lambda: seen.append("end"))])
    dag.Executor().run(graph).get()
    assert seen == ["inner", "s1", "s2", "joined", "child", "child", "child", "end"]
    outer = dag.TaskGraph()
    outer.adopt(inner)
    assert len(inner) == 0 and len(outer) == 1


def test_errors_stop_the_run():
    graph, seen = dag.TaskGraph(), []
    bad, after = graph.emplace(lambda: 1 / 0, lambda: seen.append(1))
    bad.precede(after)
    with pytest.raises(ZeroDivisionError):
        dag.Executor().run(graph).get()
    assert not seen


def test_semaphore():
    s = dag.Semaphore(2)
    with pytest.raises(RuntimeError):
        s.release()
    graph, now, most, lock = dag.TaskGraph(), [0], [0], threading.Lock()

    def body():
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.002)
        with lock:
            now[0] -= 1

    for _ in range(20):
        graph.emplace(body).acquire(s).release(s)
    dag.Executor().run(graph).get()
    assert 1 <= most[0] <= 2 and s.value == 2


def test_async_dependencies_and_groups():
    executor, seen = dag.Executor(), []
    a = executor.async_(lambda: seen.append("a"))
    b = executor.dependent_async(lambda: seen.append("b"), a, None)
    b.result()
    group = executor.task_group()
    for i in range(3):
        group.async_(lambda i=i: seen.append(i))
    group.corun()
    executor.wait_for_all()
    assert seen[:2] == ["a", "b"] and sorted(seen[2:]) == [0, 1, 2]
    assert executor.run_until(dag.TaskGraph(), lambda: False).get() is None


def test_edges_can_be_removed():
    graph = dag.TaskGraph("g")
    a, b = graph.emplace(lambda: None, lambda: None)
    a.precede(b)
    assert "->" in graph.dump()
    a.remove_successors(b)
    assert a.num_successors == b.num_predecessors == 0 and "->" not in graph.dump()


def test_pipeline_rules(spark):
    with pytest.raises(ValueError):
        Pipeline(0, Pipe(SERIAL, lambda d: d))
    with pytest.raises(ValueError):
        Pipeline(2, Pipe(PARALLEL, lambda d: d))
    p = Pipeline(4, Pipe(SERIAL, lambda d: d))
    tokens = spark.range(10).withColumnRenamed("id", "token")
    assert p.run(tokens, stop=F.col("token") == 7).count() == 7 and p.run(tokens).count() == 10
    assert p.num_tokens == 17 and p.reset().num_tokens == 0
    with pytest.raises(TypeError):
        DataPipeline(1, data_pipe(SERIAL, lambda d: d, None, "x int"), data_pipe(SERIAL, lambda d: d, "x string", None))


def test_pipeline_over_a_stream(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(20).withColumnRenamed("id", "v").write.parquet(source)
    out = []
    p = Pipeline(3, Pipe(SERIAL, lambda d: d), Pipe(PARALLEL, lambda d: d.withColumn("w", F.col("v") * 2)))
    stream = spark.readStream.schema("v long").parquet(source)
    p.stream(stream, lambda df, _: out.extend(df.orderBy("token").collect()), str(tmp_path / "check"), ["v"]).awaitTermination(60)
    assert sorted(r.token for r in out) == list(range(20)) and all(r.w == 2 * r.v and r.line == r.token % 3 for r in out)
    assert p.num_tokens == 20


def test_trace_bytes():
    rows = [(1, 2, 0, "näme", "static", 1000, 1500), (1, 3, 0, "", "static", 1000, 1000), (2, 2, 1, "näme", "condition", 5000, 10**12)]
    assert sorted(traces.decode_trace(traces.encode_trace(rows))) == sorted(rows)
    with pytest.raises(ValueError):
        list(traces.decode_trace(b"nope"))


def test_table_round_trip(spark, tmp_path):
    schema = "a boolean, b array<int>, c map<string,double>, d decimal(20,0), e struct<x:int,y:string>, f timestamp_ntz"
    df = spark.sql("SELECT true AS a, array(1, 2) AS b, map('k', 1.5D) AS c, CAST(18446744073709551615 AS DECIMAL(20,0)) AS d, named_struct('x', 1, 'y', 'z') AS e, TIMESTAMP_NTZ '2020-01-01 00:00:00' AS f")
    traces.serialize(df, str(tmp_path / "t"))
    assert traces.deserialize(spark, str(tmp_path / "t"), schema).collect() == df.collect()


def test_deferred_tokens_come_after_what_they_wait_for(spark):
    tokens = spark.range(1, 8).withColumnRenamed("id", "token")
    waits = spark.createDataFrame([(1, 3), (3, 5), (2, 99), (6, 1)], "token long, on long")
    got = [r.token for r in deferred_order(tokens, waits).orderBy("pos").collect()]
    assert got == [2, 4, 5, 7, 3, 1, 6]


def test_workers_bound_the_threads():
    executor, now, most, threads, lock = dag.Executor(workers=3), [0], [0], [0], threading.Lock()
    before = threading.active_count()

    def body():
        with lock:
            now[0] += 1
            most[0], threads[0] = max(most[0], now[0]), max(threads[0], threading.active_count() - before)
        time.sleep(0.0005)
        with lock:
            now[0] -= 1

    graph = dag.TaskGraph()
    for _ in range(1000):
        graph.emplace(body)
    executor.run(graph).get()
    assert 2 <= most[0] <= 3 and threads[0] <= 16 and executor.num_waiting == 0
    executor.wait_for_all()


@pytest.mark.parametrize("workers", [1, 2])
def test_waiting_tasks_give_their_place_away(workers):
    executor, seen = dag.Executor(workers=workers), []
    inner = dag.TaskGraph()
    inner.emplace(*(lambda x=x: seen.append(x) for x in range(5)))
    graph = dag.TaskGraph()
    limit = dag.Semaphore(1)
    for _ in range(4):
        graph.runtime(lambda rt: (rt.async_(lambda: seen.append("child")).result(), rt.corun(inner))).acquire(limit).release(limit)
        graph.composed_of(inner)
    executor.run(graph).get(60)
    assert len(seen) == 4 * (1 + 5) + 4 * 5
    done = []
    executor.async_(lambda: executor.corun_until(lambda: bool(done)))
    executor.async_(lambda: done.append(1)).result(30)
    executor.wait_for_all()


def test_runtime_schedules_a_task_and_dependencies_go():
    graph, seen = dag.TaskGraph(), []
    a, c = graph.emplace(lambda: None), graph.condition(lambda: 7)
    target = graph.emplace(lambda: seen.append("target"))
    late = graph.emplace(lambda: seen.append("late"))
    c.precede(target)  # never picked
    a.precede(c)
    target.precede(late)
    run = graph.runtime(lambda rt: rt.schedule(target))
    graph.remove_dependency(a, c)
    assert a.num_successors == 0 and c.num_predecessors == 0
    visited = []
    target.for_each_successor(visited.append)
    target.for_each_predecessor(visited.append)
    assert visited == [late, c] and run.num_predecessors == 0
    dag.Executor().run(graph).get(30)
    assert seen == ["target", "late"]


def test_recorded_runs_feed_the_analytics(spark):
    from rangeloom.plans import observe

    executor, graph = dag.Executor(workers=2), dag.TaskGraph()
    seen = executor.observe(dag.Recorder(uid=5))
    for i in range(6):
        graph.emplace(lambda: time.sleep(0.003), name=f"task{i}")
    executor.run(graph).get()
    segments = seen.as_frame(spark)
    assert seen.num_workers == 2 and {r.name for r in segments.collect()} == {f"task{i}" for i in range(6)}
    assert observe.type_stats(segments).first().n == 6 and observe.wall_time(segments).first()[0] >= 9000
    assert all(0 < r.utilization <= 100 for r in observe.utilization(segments).collect())


def test_serial_stages_see_ranges_in_order(spark):
    def watched(frames):
        for f in frames:
            yield f.assign(sorted_=f["token"].is_monotonic_increasing, lo=f["token"].min(), hi=f["token"].max())

    stage = lambda d: d.select("token").mapInPandas(watched, "token long, sorted_ boolean, lo long, hi long")
    tokens = spark.range(1000).select((F.lit(999) - F.col("id")).alias("token")).repartition(8)
    for pipes in ([Pipe(SERIAL, stage)], [Pipe(SERIAL, lambda d: d), Pipe(PARALLEL, lambda d: d), Pipe(SERIAL, stage)]):
        rows = Pipeline(4, *pipes).apply(tokens).collect()
        assert len(rows) == 1000 and all(r.sorted_ for r in rows)
        ranges = sorted({(r.lo, r.hi) for r in rows})
        assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:], strict=False))


def test_tokens_go_on_after_a_restart(spark, tmp_path):
    source, check = str(tmp_path / "in"), str(tmp_path / "check")
    out = []
    for part in range(3):
        spark.range(part * 10, part * 10 + 10).withColumnRenamed("id", "v").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("v long").parquet(source)
        p = Pipeline(3, Pipe(SERIAL, lambda d: d))  # a new process knows no tokens
        p.stream(stream, lambda df, _: out.extend(df.collect()), check, ["v"]).awaitTermination(60)
        assert p.num_tokens == 10 * (part + 1)
    assert sorted((r.token, r.v) for r in out) == [(i, i) for i in range(30)]


@pytest.mark.parametrize("last", [0, 300, 100_000])
def test_coloring_is_greedy_by_rank_and_its_edges_grow_fewer(spark, last, monkeypatch):
    """The colors are those of one pass in order of rank, wherever the driver takes over; what rounds write shrinks."""
    edges = spark.range(1500).select((F.col("id") * 7 % 601).alias("src"), (F.col("id") * F.col("id") % 599).alias("dst"))
    nodes = spark.range(700).select(F.col("id").alias("node"))
    ranks = sorted((r.h, r.node) for r in nodes.select("node", F.xxhash64(F.lit(0), "node").alias("h")).collect())
    near, want = {}, {}
    for r in edges.collect():
        if r.src != r.dst:
            near.setdefault(r.src, set()).add(r.dst)
            near.setdefault(r.dst, set()).add(r.src)
    for _, n in ranks:
        used = {want[m] for m in near.get(n, ()) if m in want}
        want[n] = next(c for c in range(700) if c not in used)
    written, whole = [], workloads.cut

    def counted(df):
        out = whole(df)
        if out.columns == ["u", "v", "color"]:
            written.append(out.count())
        return out

    monkeypatch.setattr(workloads, "cut", counted)
    monkeypatch.setattr(workloads, "LAST", last, raising=False)
    got = [(r.node, r.color) for r in workloads.greedy_coloring(nodes, edges).collect()]
    assert len(got) == 700 and dict(got) == want
    assert written and written == sorted(written, reverse=True) and written[-1] <= last


def sizes(df):
    """Rows by partition, as the plan leaves them."""
    return [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]


@pytest.mark.parametrize("once", [True, False])
def test_degrees_hold_a_block_at_a_time(spark, once, monkeypatch):
    """A node of a large degree, loops, repeated edges and nulls; partitions follow the number of edges, not the session."""
    monkeypatch.setattr(workloads, "BLOCK", 1000, raising=False)
    rows = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id") * 11 % 9001).alias("src"), F.when(F.col("id") % 500 != 1, F.col("id") % 6000).alias("dst"))
    edges = rows.union(rows.where("dst % 10 = 0"))
    listed = [(r.src, r.dst) for r in edges.collect()]
    want = {}
    for src, dst in set(listed) if once else listed:
        want.setdefault(src, [0, 0])[0] += 1
        want.setdefault(dst, [0, 0])[1] += 1
    found = workloads.degrees(edges, once=once)
    got = found.collect()
    assert len(got) == len(want) and {r.node: [r.n_out, r.n_in] for r in got} == want
    assert max(sizes(found)) < 1000 < 8000 < len(want)
    blocks = sizes(workloads.distinct_edges(edges))
    assert sum(blocks) == len(set(listed)) and max(blocks) < 1500
