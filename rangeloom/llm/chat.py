"""Chat formatting of reply trees.

Iterative self-joins double the known distance to an ancestor each round, so a path of
depth d takes log2(d) rounds; the pairs (leaf, node) they yield are the root-to-leaf
paths. Branches are ranked by the mean score of their nodes, and each chosen path is
formatted as one conversation whose control strings are escaped reversibly.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, saved, tidy

# The template's control strings.
OPEN, CLOSE, ROLE, TEXT = "<s>", "</s>", "[INST]", "[/INST]"
_CONTROL = re.compile(r"(?<=<)(?=/?s>)|(?<=\[)(?=/?INST\])")


def escape(text: str) -> str:
    """Doubles backslashes, then puts one after the first character of each control string, so none is left."""
    return _CONTROL.sub(lambda _: "\\", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    """A doubled backslash is one; a single one goes."""
    return re.sub(r"\\(\\?)", r"\1", text)


def format_turns(turns: list[tuple[str, str]], trained: str = "assistant") -> tuple[str, list[int]]:
    """The conversation's text and the loss mask: flat [start, end) code points of the trained role's texts."""
    out, at, mask = [], 0, []
    for role, text in turns:
        head, body = f"{OPEN}{ROLE}{escape(role)}{TEXT}", escape(text)
        if role == trained:
            mask += [at + len(head), at + len(head) + len(body)]
        out.append(f"{head}{body}{CLOSE}")
        at += len(head) + len(body) + len(CLOSE)
    return "".join(out), mask


_TURN = re.compile(rf"{re.escape(OPEN)}{re.escape(ROLE)}(.*?){re.escape(TEXT)}(.*?){re.escape(CLOSE)}", re.DOTALL)


def parse_turns(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted conversation."""
    found, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"text outside turns at {at}")
        found.append((unescape(m[1]), unescape(m[2])))
        at = m.end()
    if at != len(formatted):
        raise ValueError(f"text outside turns at {at}")
    return found


def paths(nodes: DataFrame) -> DataFrame:
    """Root-to-leaf paths of the reply trees: leaf, node, up (the node's steps above the leaf).

    `nodes` is a table with unique node and its parent (null, or a node that isn't there:
    a root). What replies to itself, around a cycle or from below one, has no root and is in no path.
    """
    with Scratch() as scratch:
        known = scratch.saved(nodes.select("node", "parent"), "nodes")
        alone = known.select(F.col("node").alias("parent"))
        jumps, most = [scratch.saved(known.join(alone, "parent", "left_semi").select("node", "parent"), "jump")], known.count()
        while not jumps[-1].isEmpty() and 1 << (len(jumps) - 1) <= most:  # each row a node and its ancestor of 1, 2, 4, ... steps
            last = jumps[-1]
            far = last.select(F.col("node").alias("parent"), F.col("parent").alias("far"))
            jumps.append(scratch.saved(last.join(far, "parent").select("node", F.col("far").alias("parent")), "jump"))
        leaves = known.join(known.select(F.col("parent").alias("node")), "node", "left_anti")
        if not jumps[-1].isEmpty():  # more steps than nodes
            leaves = leaves.join(jumps[-1], "node", "left_anti")
        found = scratch.saved(leaves.select(F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "paths")
        for i, jump in enumerate(jumps[:-1]):
            ahead = found.join(jump, "node").select("leaf", F.col("parent").alias("node"), (F.col("up") + (1 << i)).alias("up"))
            found = scratch.saved(found.unionByName(ahead), "paths", instead=found)
        return saved(found, "paths")


FORMATTED = pa.schema([("formatted", pa.string()), ("loss_mask", pa.list_(pa.int32()))])


def _formatted(keys: list[str], trained: str):
    def run(batches):
        for batch in batches:
            rows = [format_turns([(t["role"] or "", t["text"] or "") for t in turns], trained) for turns in batch["turns"].to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*(batch[k] for k in keys), pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.list_(pa.int32()))],
                names=[*keys, *FORMATTED.names],
            )

    return run


def format_trees(nodes: DataFrame, branches: int | None = None, trained: str = "assistant") -> DataFrame:
    """One conversation per chosen path: tree, leaf, branch (rank from 1), score, formatted, loss_mask.

    nodes: tree, node (unique), parent, role, text, score (null: 0). Paths of a tree are ranked by mean score
    downwards, then by leaf; `branches` keeps that many of each tree, all by default. No nodes give no conversations.
    """
    steps = paths(nodes)
    scored = steps.join(nodes.select("node", "tree", F.coalesce("score", F.lit(0.0)).alias("score")), "node")
    whole = scored.groupBy("leaf").agg(F.first("tree").alias("tree"), F.avg("score").alias("score"))
    ranked = whole.withColumn("branch", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("score"), "leaf")).cast("int"))
    if branches:
        ranked = ranked.where(F.col("branch") <= branches)
    ranked = saved(ranked.select("leaf", "tree", "score", "branch"), "branches")
    # Texts come in last: once to their nodes' steps, once to their leaves.
    chosen = steps.join(ranked.select("leaf"), "leaf", "left_semi") if branches else steps
    turns = chosen.join(nodes.select("node", "role", "text"), "node").groupBy("leaf").agg(F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))).alias("turns"))
    ranked = turns.join(ranked, "leaf")
    keys = ["tree", "leaf", "branch", "score"]
    of = dict(ranked.dtypes)
    return ranked.mapInArrow(tidy(_formatted(keys, trained)), ", ".join(f"{k} {of[k]}" for k in keys) + ", formatted string, loss_mask array<int>")


def as_trees(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: each row replies to the one before it by turn, then role and text; nulls come first."""
    key = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    of = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(of)
    rows = conversations.select("conv_id", "role", "text", key.alias("key"), at.alias("at"))
    node = lambda i: F.concat_ws(":", "key", i)
    return rows.select(
        F.col("conv_id").alias("tree"), node(F.col("at")).alias("node"), F.when(F.col("at") > 1, node(F.col("at") - 1)).alias("parent"), "role", "text", F.lit(None).cast("double").alias("score")
    )


DIGEST_COLUMNS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _digests(batches):
    def digest(formatted: str, mask: list[int]) -> tuple:
        turns = parse_turns(formatted)
        loss = "".join(unescape(formatted[a:b]) for a, b in zip(mask[::2], mask[1::2], strict=True))
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss), len(formatted)

    for batch in batches:
        rows = [digest(f, m) for f, m in zip(batch["formatted"].to_pylist(), batch["loss_mask"].to_pylist(), strict=True)]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        cols = list(zip(*rows, strict=True)) or [[]] * 5
        names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        yield pa.RecordBatch.from_arrays([batch["tree"].cast(pa.int64()), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))], names=["conv_id", *names])


def conversation_digests(conversations: DataFrame) -> DataFrame:
    """Format the conversations and read digests back from the output. Null texts and roles are empty; rows with a null conv_id are one conversation."""
    trees = saved(as_trees(conversations.select(F.col("conv_id").cast("long"), "turn", "role", "text")), "trees")
    return format_trees(trees).select("tree", "formatted", "loss_mask").mapInArrow(_digests, DIGEST_COLUMNS)
