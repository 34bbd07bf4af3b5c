"""Composite workloads on the operators: graphs, clustering, grids, number crunching."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rangeloom.operators.ranges import index_range, nd_range
from rangeloom.plans.lineage import cut


def mode_char(docs: DataFrame, key: str, text: str) -> DataFrame:
    """The most frequent character of each text, the smallest of equally frequent ones: key, ch, n. Texts without characters have no row.

    Narrow, on Arrow batches: built-in array functions take several times as long, and a row for each character would be shuffled.
    """
    kind = dict(docs.dtypes)[key]
    return docs.where(F.length(text) > 0).select(F.col(key), F.col(text)).mapInArrow(_mode_chars(key), f"`{key}` {kind}, ch string, n long")


def _mode_chars(key: str):
    def best(text: str) -> tuple[str, int]:
        points = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        kinds, counts = np.unique(points, return_counts=True)
        top = int(counts.argmax())  # the first of equals is the smallest
        return chr(kinds[top]), int(counts[top])

    def run(batches):
        for batch in batches:
            found = [best(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([c for c, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], names=[key, "ch", "n"])

    return run


#: Levels that one job expands while the frontier has at most so many nodes.
SEVERAL, NARROW = 6, 1000
#: Tables that the nodes seen so far are spread over at most.
PARTS = 16


def levels_from(edges: DataFrame, start: DataFrame) -> DataFrame:
    """Breadth-first levels (node, level): a frontier loop over edges that are written once. A round joins them on the frontier
    only; while that is small and grows slowly, a round expands several levels, of which each new node gets its lowest."""
    edges = cut(edges.select("src", "dst").distinct())
    frontier = cut(start.select("node", F.lit(0).alias("level")).distinct())
    parts, level, size, last = [frontier], 0, frontier.count(), 0
    while size:
        steps = SEVERAL if size <= NARROW and (not last or size <= 2 * last) else 1
        reached, near = [], frontier.select("node")
        for step in range(1, steps + 1):
            near = edges.join(near.select(F.col("node").alias("src")), "src").select(F.col("dst").alias("node")).distinct()
            reached.append(near.withColumn("level", F.lit(level + step)))
        lowest = reduce(DataFrame.unionByName, reached)
        if steps > 1:
            lowest = lowest.groupBy("node").agg(F.min("level").alias("level"))
        seen = reduce(DataFrame.unionByName, parts)
        found = cut(lowest.join(seen, "node", "left_anti").select("node", "level"))
        parts.append(found)
        if len(parts) > PARTS:
            parts = [cut(reduce(DataFrame.unionByName, parts))]
        level += steps
        # what was found below the round's last level has been expanded
        frontier, last = found.where(F.col("level") == level), size
        size = frontier.count()
    return reduce(DataFrame.unionByName, parts)


def longest_paths(nodes: DataFrame, edges: DataFrame, weight: str | None = None) -> DataFrame:
    """Of an acyclic graph: node, value: the heaviest path into the node by node weights (its own included), or the topological level without weights.

    Rounds relax the nodes whose value changed until none does; a cycle would not end, so rounds are bounded by the number of nodes.
    """
    edges = cut(edges.select("src", "dst"))
    own = nodes.select("node", (F.col(weight) if weight else F.lit(0)).cast("long").alias("own"))
    step = F.col("own") if weight else F.lit(1)
    value = cut(own.select("node", "own", F.col("own").alias("value")))
    changed, bound = value.select("node", "value"), nodes.count()
    for _ in range(bound + 1):
        if changed.isEmpty():
            return value.select("node", "value")
        into = edges.join(changed.select(F.col("node").alias("src"), "value"), "src").groupBy(F.col("dst").alias("node")).agg(F.max("value").alias("best"))
        new = value.join(into, "node", "left").withColumn("next", F.greatest("value", F.col("best") + step))
        new = cut(new.select("node", "own", F.coalesce("next", "value").alias("value"), F.coalesce(F.col("next") > F.col("value"), F.lit(False)).alias("moved")))
        value, changed = new.select("node", "own", "value"), new.where("moved").select("node", "value")
    raise ValueError("the graph has a cycle")


#: Edges of a block, about: what a task holds at a time, however many edges there are.
BLOCK = 1 << 18


def _blocks(edges: DataFrame) -> int:
    """Blocks for the edges, one for each core at least. They are counted, as sizes of plans are estimates."""
    return max(edges.sparkSession.sparkContext.defaultParallelism, -(-edges.count() // BLOCK))


def distinct_edges(edges: DataFrame) -> DataFrame:
    """src, dst: each edge once, by blocks. Edges are mostly distinct already, so that combining them before they are shuffled would hold a whole input split."""
    return edges.select("src", "dst").repartition(_blocks(edges), "src", "dst").distinct()


def degrees(edges: DataFrame, once: bool = False) -> DataFrame:
    """node, n_out, n_in; once: equal edges count as one.

    Edges go to blocks by a hash of both ends, and ends are counted in a block before they are shuffled, so that a node of any degree comes in one row a block.
    """
    n = _blocks(edges)
    rows = edges.select(F.pmod(F.xxhash64("src", "dst"), F.lit(n)).cast("int").alias("_block"), "src", "dst").repartitionById(n, "_block")
    end = lambda c: F.struct(F.col(c).alias("node"), F.lit(int(c == "src")).alias("o"), F.lit(int(c == "dst")).alias("i"))
    ends = (rows.distinct() if once else rows).select("_block", F.explode(F.array(end("src"), end("dst"))).alias("e")).select("_block", "e.*")
    counts = ends.groupBy("_block", "node").agg(F.sum("o").alias("o"), F.sum("i").alias("i"))
    return counts.repartition(n, "node").groupBy("node").agg(F.sum("o").alias("n_out"), F.sum("i").alias("n_in"))


def stale_targets(edges: DataFrame, touched: DataFrame) -> DataFrame:
    """What has to be rebuilt: everything reachable from the touched nodes."""
    return levels_from(edges, touched).select("node")


def kmeans_assign(points: DataFrame, centers: list[list[float]], vector: str = "embedding") -> DataFrame:
    """The points with the nearest center (the first of equally near ones). centers: a bounded list of the model."""
    x = F.col(vector)
    scored = [
        F.struct(F.round(F.aggregate(F.zip_with(x, F.array(*map(F.lit, c)), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v), 6).alias("d"), F.lit(i).alias("c"))
        for i, c in enumerate(centers)
    ]
    return points.withColumn("center", F.array_min(F.array(*scored))["c"])


def kmeans(points: DataFrame, k: int, rounds: int, order: str, vector: str = "embedding") -> list[list[float]]:
    """Lloyd's rounds from the first k points by order; each round is one aggregation."""
    centers = [[float(v) for v in r[0]] for r in points.orderBy(order).select(vector).limit(k).collect()]
    for _ in range(rounds):
        flat = kmeans_assign(points, centers, vector).select("center", F.posexplode(vector).alias("i", "v"))
        means = flat.groupBy("center", "i").agg(F.avg("v").alias("v")).groupBy("center").agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("m")).collect()
        for r in means:
            centers[r["center"]] = [float(x["v"]) for x in r["m"]]
    return centers


def stencil(grid: DataFrame, offsets: list[tuple[tuple[int, ...], float]], axes: list[str]) -> DataFrame:
    """Weighted sums of neighbours (convolution, stencils): every cell is sent to those it reaches, then one sum."""
    moves = F.explode(F.array(*(F.struct(*(F.lit(d).alias(a) for a, d in zip(axes, off, strict=True)), F.lit(float(w)).alias("w")) for off, w in offsets))).alias("m")
    sent = grid.select(*axes, "v", moves).select(*((F.col(a) - F.col(f"m.{a}")).alias(a) for a in axes), (F.col("v") * F.col("m.w")).alias("v"))
    sums = sent.groupBy(*axes).agg(F.sum("v").alias("sum"))
    return grid.select(*axes).join(sums, axes, "left").select(*axes, F.coalesce("sum", F.lit(0.0)).alias("v"))


def is_prime(n: Column, limit: int) -> Column:
    """Whether n, up to limit, has no divisor up to its root."""
    root = int(limit**0.5) + 1
    return (n > 1) & ~F.exists(F.sequence(F.lit(2), F.lit(root)), lambda d: (d * d <= n) & (n % d == 0))


def black_scholes_call(s: Column, k: Column, r: Column, v: Column, t: Column) -> Column:
    """Price of a European call, the normal distribution by its rational approximation (coefficients of Abramowitz and Stegun 26.2.17)."""

    def normal(x: Column) -> Column:
        a = (0.319381530, -0.356563782, 1.781477937, -1.821255978, 1.330274429)  # fixed values
        z = 1 / (1 + 0.2316419 * F.abs(x))
        tail = F.exp(-x * x / 2) * 0.3989422804014327 * z * (a[0] + z * (a[1] + z * (a[2] + z * (a[3] + z * a[4]))))
        return F.when(x < 0, tail).otherwise(1 - tail)

    d1 = (F.log(s / k) + (r + v * v / 2) * t) / (v * F.sqrt(t))
    return s * normal(d1) - k * F.exp(-r * t) * normal(d1 - v * F.sqrt(t))


def mandelbrot(spark: SparkSession, size: int, rounds: int) -> DataFrame:
    """i, j, n: rounds until the point escapes, at most `rounds`, over the square from -2 to 2."""
    grid = nd_range(spark, [(0, size, 1), (0, size, 1)], ["i", "j"])
    cx, cy = F.col("j") * (4.0 / size) - 2.0, F.col("i") * (4.0 / size) - 2.0

    def turn(state, _):
        x, y = state["x"], state["y"]
        go = x * x + y * y <= 4
        return F.struct(F.when(go, x * x - y * y + cx).otherwise(x).alias("x"), F.when(go, 2 * x * y + cy).otherwise(y).alias("y"), (state["n"] + F.when(go, 1).otherwise(0)).alias("n"))

    start = F.struct(F.lit(0.0).alias("x"), F.lit(0.0).alias("y"), F.lit(0).alias("n"))
    return grid.select("i", "j", F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), start, turn, lambda s: s["n"]).alias("n"))


def integrate(spark: SparkSession, f: Callable[[Column], Column], low: float, high: float, n: int) -> DataFrame:
    """The trapezoid sum over n strips, as value."""
    h = (high - low) / n
    x = F.lit(low) + F.col("i") * F.lit(h)
    w = F.when((F.col("i") == 0) | (F.col("i") == n), 0.5).otherwise(1.0)
    return index_range(spark, 0, n + 1).agg((F.sum(f(x) * w) * h).alias("value"))


def fibonacci(spark: SparkSession, n: int) -> DataFrame:
    """i and f(i) up to n by a recursive query."""
    return spark.sql(f"WITH RECURSIVE t(i, a, b) AS (SELECT 0, 0L, 1L UNION ALL SELECT i + 1, b, a + b FROM t WHERE i < {int(n)}) SELECT CAST(i AS BIGINT) AS i, a AS f FROM t")


def skynet(spark: SparkSession, depth: int) -> DataFrame:
    """The sum of a ten-way tree's leaf numbers."""
    return spark.range(10**depth).agg(F.sum("id").alias("value"))


def n_queens(spark: SparkSession, n: int) -> DataFrame:
    """Solutions as arrays of columns by row: partial boards are expanded and cut row by row."""
    boards = spark.createDataFrame([([],)], "q array<int>")
    for row in range(n):
        free = lambda q, c, row=row: ~F.exists(F.transform(q, lambda x, i: (x == c) | (F.abs(x - c) == row - i)), lambda hit: hit)
        boards = boards.select("q", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias("c")).where(free(F.col("q"), F.col("c"))).select(F.concat("q", F.array("c")).alias("q"))
    return boards


def shortest_tour(spark: SparkSession, distance: list[list[int]]) -> DataFrame:
    """The shortest round trip from city 0 over a small table of distances: paths are expanded and only the best for each set of visited cities and last city stays."""
    n = len(distance)
    if n > 12:
        raise ValueError("at most 12 cities")
    table = F.array(*(F.array(*map(F.lit, row)) for row in distance))
    paths = spark.createDataFrame([(1, 0, 0, [0])], "seen int, last int, cost int, path array<int>")
    for _ in range(n - 1):
        step = paths.select("*", F.explode(F.sequence(F.lit(1), F.lit(n - 1))).alias("c")).where(F.expr("(shiftright(seen, c) & 1) = 0"))
        grown = step.select(F.expr("CAST(seen | shiftleft(1, c) AS INT)").alias("seen"), F.col("c").alias("last"), (F.col("cost") + table[F.col("last")][F.col("c")]).alias("cost"), F.concat("path", F.array("c")).alias("path"))
        paths = grown.groupBy("seen", "last").agg(F.min(F.struct("cost", "path")).alias("b")).select("seen", "last", "b.cost", "b.path")
    return paths.select((F.col("cost") + table[F.col("last")][0]).alias("cost"), "path").orderBy("cost", "path").limit(1)


#: Waiting edges up to which the coloring ends on the driver.
LAST = 100_000


def greedy_coloring(nodes: DataFrame, edges: DataFrame, seed: int = 0) -> DataFrame:
    """node, color: in rounds, every uncolored node whose rank, a seeded hash, is the smallest among its uncolored neighbours
    takes the smallest color its neighbours lack. Hashed ranks keep the rounds few.

    Edges go from the smaller rank to the larger and are kept until their larger end is colored, so rounds read and write
    ever fewer; the last ones (at most LAST edges) are done in order of rank on the driver.
    """
    rank = lambda c: F.struct(F.xxhash64(F.lit(seed), c), F.col(c))
    nodes = cut(nodes.select("node").distinct())
    first = rank("src") < rank("dst")
    way = edges.where("src <> dst").select(F.when(first, F.col("src")).otherwise(F.col("dst")).alias("u"), F.when(first, F.col("dst")).otherwise(F.col("src")).alias("v")).distinct()
    for end in ("u", "v"):
        way = way.join(nodes.select(F.col("node").alias(end)), end, "left_semi")
    waits = cut(way.select("u", "v", F.lit(None).cast("int").alias("color")))
    found = cut(nodes.join(waits.select(F.col("v").alias("node")), "node", "left_anti").withColumn("color", F.lit(0)))
    parts = [found]
    while True:
        done = lambda c, d=found: d.select(F.col("node").alias(c), F.col("color").alias("new"))
        left = waits.join(done("v"), "v", "left_anti").join(done("u"), "u", "left")
        waits = cut(left.select("u", "v", F.coalesce("color", "new").alias("color")))
        if waits.count() <= LAST:
            break
        ready = waits.groupBy(F.col("v").alias("node")).agg(F.count_if(F.col("color").isNull()).alias("open"), F.collect_set("color").alias("used")).where("open = 0")
        free = F.array_min(F.array_except(F.sequence(F.lit(0), F.size("used")), F.col("used")))
        found = cut(ready.select("node", free.alias("color")))
        parts.append(found)
        if len(parts) > PARTS:
            parts = [cut(reduce(DataFrame.unionByName, parts))]
    rows = waits.select("u", "v", "color", F.xxhash64(F.lit(seed), "v").alias("rank")).collect()  # at most LAST
    near: dict = {}
    for r in rows:
        near.setdefault((r["rank"], r["v"]), []).append((r["u"], r["color"]))
    color: dict = {}
    for (_, v), before in sorted(near.items()):
        used = {color[u] if c is None else c for u, c in before}
        color[v] = next(c for c in range(len(used) + 1) if c not in used)
    parts.append(nodes.sparkSession.createDataFrame(list(color.items()), nodes.withColumn("color", F.lit(0)).schema))
    return reduce(DataFrame.unionByName, parts)


def wavefront(spark: SparkSession, cost: DataFrame, n: int) -> DataFrame:
    """i, j, v: cheapest path from the corner by steps right and down over an n x n grid, diagonal by diagonal."""
    done = cut(cost.where("i = 0 and j = 0").select("i", "j", "v"))
    last = done
    for d in range(1, 2 * n - 1):
        came = last.select((F.col("i") + 1).alias("i"), "j", "v").unionByName(last.select("i", (F.col("j") + 1).alias("j"), "v")).groupBy("i", "j").agg(F.min("v").alias("before"))
        last = cost.where(F.col("i") + F.col("j") == d).join(came, ["i", "j"]).select("i", "j", (F.col("v") + F.col("before")).alias("v"))
        last = cut(last)
        done = done.unionByName(last)
    return done


def cholesky(a: list[list[float]]) -> list[list[float]]:
    """The lower factor of a small positive-definite matrix, on the driver."""
    n = len(a)
    low = [[0.0] * n for _ in range(n)]
    for j in range(n):
        rest = a[j][j] - sum(x * x for x in low[j][:j])
        if rest <= 0:
            raise ValueError("the matrix is not positive definite")
        low[j][j] = rest**0.5
        for i in range(j + 1, n):
            low[i][j] = (a[i][j] - sum(x * y for x, y in zip(low[i][:j], low[j][:j], strict=True))) / low[j][j]
    return low


def coin_flips(spark: SparkSession, runs: int, seed: int) -> DataFrame:
    """How many flips each of the runs needs for its first head, 64 at most: run, flips. Flip i is the lowest bit of a digest's first digit, of seed, run and i."""
    head = lambda i: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed).cast("string"), F.col("run").cast("string"), i.cast("string"))), 1, 1), 16, 10).cast("int") % 2 == 1
    first = F.array_position(F.transform(F.sequence(F.lit(1), F.lit(64)), head), True)
    return spark.range(runs).withColumnRenamed("id", "run").select("run", F.when(first > 0, first).otherwise(64).alias("flips"))


def may_be_known(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """The rows whose key is in the other frame: a semi-join, which Spark backs with a runtime Bloom filter where it pays."""
    return rows.join(known.select(key).distinct(), key, "left_semi")


