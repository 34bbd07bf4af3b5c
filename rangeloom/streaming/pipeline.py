"""Typed token pipelines over DataFrames: chained transforms for bounded inputs, foreachBatch for streams.

A token is a row with columns token and line (token mod lines). PARALLEL stages are narrow maps. A SERIAL stage gets its
tokens by ranges: each partition holds a range of tokens in order, and the partitions follow one another, so a stage that works
partition by partition sees a stretch of the stream; one that needs all tokens before a token uses the prefix scans. The first stage must be SERIAL.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

PARALLEL, SERIAL = "parallel", "serial"


@dataclass
class Pipe:
    """A stage: DataFrame to DataFrame. `takes` and `gives` declare schemas (DDL) of a data pipe; None leaves them open."""

    kind: str
    fn: Callable[[DataFrame], DataFrame]
    takes: str | None = None
    gives: str | None = None


def data_pipe(kind: str, fn: Callable[[DataFrame], DataFrame], takes: str | None, gives: str | None) -> Pipe:
    return Pipe(kind, fn, takes, gives)


def _checked(df: DataFrame, schema: str | None, what: str) -> DataFrame:
    if schema is not None:
        want: StructType = _parse_datatype_string(schema)
        have = {f.name: f.dataType for f in df.schema}
        for f in want:
            if have.get(f.name) != f.dataType:
                raise TypeError(f"{what}: {f.name} is {have.get(f.name)}, not {f.dataType}")
    return df


class Pipeline:
    """Stages over `lines` lines. Tokens are counted over runs until reset."""

    def __init__(self, lines: int, *pipes: Pipe):
        self.reset(lines, *pipes)

    def reset(self, lines: int | None = None, *pipes: Pipe) -> Pipeline:
        lines, pipes = lines if lines is not None else self.lines, list(pipes) or self.pipes
        if lines < 1:
            raise ValueError("a pipeline needs a line")
        if not pipes or pipes[0].kind != SERIAL:
            raise ValueError("the first pipe must be serial")
        self.lines, self.pipes, self.num_tokens = lines, pipes, 0
        return self

    @property
    def num_lines(self) -> int:
        return self.lines

    @property
    def num_pipes(self) -> int:
        return len(self.pipes)

    def apply(self, tokens: DataFrame) -> DataFrame:
        """All stages over a frame with a column token.

        The tokens are dealt into ranges once, before the first stage, and sorted there; later serial stages sort their
        partitions again, which are still ranges as long as the stages before are narrow. The lines bound nothing here: a token
        is a row, and Spark pulls rows through the stages one batch at a time, which is the back-pressure of a bounded run."""
        df = tokens.withColumn("line", (F.col("token") % self.lines).cast("int")).repartitionByRange("token")
        for i, pipe in enumerate(self.pipes):
            df = _checked(df, pipe.takes, f"input of pipe {i}")
            if pipe.kind == SERIAL and "token" in df.columns:
                df = df.sortWithinPartitions("token")
            df = _checked(pipe.fn(df), pipe.gives, f"output of pipe {i}")
        return df

    def run(self, tokens: DataFrame, stop: F.Column | None = None) -> DataFrame:
        """A bounded run: tokens before the first where `stop` is true."""
        if stop is not None:
            first = tokens.where(stop).agg(F.min("token")).first()[0]
            tokens = tokens if first is None else tokens.where(F.col("token") < first)
        self.num_tokens += tokens.count()
        return self.apply(tokens)

    def stream(self, source: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, order: list[str] | None = None):
        """An unbounded run by micro-batches that follow one another; tokens go on from batch to batch, in `order` within each.

        The first token of each batch is kept beside the query's checkpoint: a restarted query goes on where it was, and a
        batch that is run again gets the tokens it had. At most one batch is in flight; readStream's maxFilesPerTrigger and the like bound it.
        """
        from rangeloom.operators.scan import with_position

        bases = f"{checkpoint.rstrip('/')}/token-bases"

        def batch(df: DataFrame, batch_id: int) -> None:
            spark = df.sparkSession
            kept = _kept_bases(spark, bases)
            base = kept.get(batch_id, self.num_tokens if batch_id == 0 else None)
            if base is None:
                raise ValueError(f"the first token of batch {batch_id} is not in {bases}")
            rows = with_position(df, order, "token").withColumn("token", F.col("token") + base) if order else df
            sink(self.apply(rows), batch_id)
            self.num_tokens = base + df.count()
            spark.createDataFrame([(batch_id + 1, self.num_tokens)], "batch long, base long").coalesce(1).write.mode("overwrite").parquet(f"{bases}/batch={batch_id + 1}")

        return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _kept_bases(spark, path: str) -> dict[int, int]:
    """The first tokens of the batches begun so far, of the last two of them."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not files.exists(at):
        return {}
    numbers = sorted(int(x.getPath().getName().split("=")[1]) for x in files.listStatus(at))[-2:]
    return {n: spark.read.schema("batch long, base long").parquet(f"{path}/batch={n}").first()["base"] for n in numbers}


class ScalablePipeline(Pipeline):
    """A pipeline whose stages come as a list that may change between runs."""

    def __init__(self, lines: int, pipes: list[Pipe]):
        super().__init__(lines, *pipes)


class DataPipeline(Pipeline):
    """A pipeline of typed stages: what one gives must have what the next takes."""

    def __init__(self, lines: int, *pipes: Pipe):
        for a, b in zip(pipes, pipes[1:], strict=False):
            if a.gives and b.takes:
                have = {f.name: f.dataType for f in _parse_datatype_string(a.gives)}
                for f in _parse_datatype_string(b.takes):
                    if have.get(f.name) != f.dataType:
                        raise TypeError(f"{f.name}: a stage takes {f.dataType}, the one before gives {have.get(f.name)}")
        super().__init__(lines, *pipes)


def deferred_order(tokens: DataFrame, waits: DataFrame) -> DataFrame:
    """The tokens with pos, the order in which a serial stage may take them when some are deferred until others are done.

    waits: token, on. Tokens are taken by the longest chain of deferrals before them, then by number; deferrals in a cycle are an
    error, those on tokens that are not there are ignored.
    """
    from rangeloom.operators.scan import with_position
    from rangeloom.plans.workloads import longest_paths

    nodes = tokens.select(F.col("token").alias("node"))
    edges = waits.select(F.col("on").alias("src"), F.col("token").alias("dst")).distinct()
    edges = edges.join(nodes.select(F.col("node").alias("src")), "src", "left_semi").join(nodes.select(F.col("node").alias("dst")), "dst", "left_semi")
    level = longest_paths(nodes, edges).select(F.col("node").alias("token"), F.col("value").alias("level"))
    return with_position(tokens.join(level, "token"), ["level", "token"]).drop("level")
