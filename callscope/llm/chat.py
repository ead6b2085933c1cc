"""Chat formatting: root-to-leaf branches of reply trees, ranked, and written with a loss mask.

Branches come from iterative self-joins: every node points to its ancestor 1, 2, 4, ... steps up, and
a leaf's path doubles in length with each join, so a tree of depth d takes log2(d) rounds.  Branches
are ranked by their nodes' mean score, ties to the smaller leaf; the best ones are formatted.

Control strings inside texts get a backslash after their first character (one more if there are
some already), which the reader takes out again; so no text can open or close a turn.

Null texts, roles and scores count as '', '' and 0.  A node whose parent is missing is a root.  Repeated
nodes (equal tree and node id) count once, with the smallest (role, text).  A row without a
node id is left out.  Cycles have no root and give no branch.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from callscope.session import scratch_dir

BRANCHES = 1
#: Start and end of a turn by role; other roles are written out.
MARKS = {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
OTHER = ("[ROLE] ", " [/ROLE] ", " [/TURN]")
LOSS_ROLE = "assistant"
_CONTROL = r"(?:<(?=\\{n}(?:/?s>|</?SYS>>))|\[(?=\\{n}(?:/?INST\]|/?ROLE\]|/TURN\])))"
_PLAIN = re.compile(_CONTROL.replace("{n}", "*"))
_ESCAPED = re.compile(_CONTROL.replace("{n}", "+") + r"\\")


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][0], text)


def write_turns(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The conversation's text, and the spans of it that count in the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        if role in MARKS:
            start, end = MARKS[role]
        else:
            start, end = OTHER[0] + escape(role) + OTHER[1], OTHER[2]
        body = escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(start), at + len(start) + len(body)))
        parts += [start, body, end]
        at += len(start) + len(body) + len(end)
    return "".join(parts), spans


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts from the written form."""
    turns, at = [], 0
    while at < len(formatted):
        for role, (start, end) in MARKS.items():  # noqa: B007
            if formatted.startswith(start, at):
                at += len(start)
                break
        else:
            if not formatted.startswith(OTHER[0], at):
                raise ValueError(f"no turn starts at {at}")
            stop = formatted.index(OTHER[1], at)
            role, end = unescape(formatted[at + len(OTHER[0]) : stop]), OTHER[2]
            at = stop + len(OTHER[1])
        stop = formatted.index(end, at)
        turns.append((role, unescape(formatted[at:stop])))
        at = stop + len(end)
    return turns


def branches(nodes: DataFrame) -> DataFrame:
    """tree, leaf, up (steps above the leaf), node of every root-to-leaf path.

    `nodes` has tree, node and parent (strings, ids unique within a tree).
    """
    spark = nodes.sparkSession
    root = scratch_dir(spark, "branches")

    def keep(frame: DataFrame, name: str) -> DataFrame:
        frame.write.parquet(f"{root}/{name}")
        return spark.read.parquet(f"{root}/{name}")

    ids = nodes.select("tree", F.col("node").alias("parent"))
    jumps = [keep(nodes.join(ids, ["tree", "parent"]).select("tree", "node", F.col("parent").alias("above")), "jumps-0")]
    most = nodes.count()
    while not (ended := jumps[-1].isEmpty()) and 1 << (len(jumps) - 1) <= most:
        then = jumps[-1].select("tree", F.col("node").alias("above"), F.col("above").alias("next"))
        jumps.append(keep(jumps[-1].join(then, ["tree", "above"]).select("tree", "node", F.col("next").alias("above")), f"jumps-{len(jumps)}"))
    inner = jumps[0].select("tree", F.col("above").alias("node")).distinct()
    leaves = nodes.select("tree", "node").join(inner, ["tree", "node"], "left_anti")
    if not ended:  # more steps up than there are nodes: these lead into a cycle
        leaves = leaves.join(jumps.pop().select("tree", "node"), ["tree", "node"], "left_anti")
    paths = keep(leaves.select("tree", F.col("node").alias("leaf"), F.lit(0).cast("long").alias("up"), "node"), "paths-0")
    for n, step in enumerate(jumps[: len(jumps) - ended]):
        longer = paths.join(step, ["tree", "node"]).select("tree", "leaf", (F.col("up") + (1 << n)).alias("up"), F.col("above").alias("node"))
        paths = keep(paths.union(longer), f"paths-{n + 1}")
    return paths


FORMATTED = "tree string, leaf string, rank int, score double, n_turns long, formatted string, loss array<struct<start: long, stop: long>>"


def _write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
    for batch in batches:
        turns = batch.column("turns").to_pylist()
        done = [write_turns([(t["role"], t["text"]) for t in x]) for x in turns]
        columns = [batch.column(n) for n in ("tree", "leaf", "rank", "score")]
        columns += [pa.array([len(x) for x in turns], pa.int64()), pa.array([d[0] for d in done]), pa.array([[{"start": a, "stop": b} for a, b in d[1]] for d in done], kind)]
        yield pa.RecordBatch.from_arrays(columns, ["tree", "leaf", "rank", "score", "n_turns", "formatted", "loss"])


def format_trees(replies: DataFrame, best: int = BRANCHES) -> DataFrame:
    """The best branches of each tree, formatted; `replies` has tree, node, parent, role, text, score."""
    spark = replies.sparkSession
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    nodes = (
        replies.where("node is not null")
        .select("tree", "node", "parent", blank("role").alias("role"), blank("text").alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
        .groupBy("tree", "node")
        .agg(F.min(F.struct("role", "text", "parent", "score")).alias("x"))
        .select("tree", "node", "x.*")
    )
    path = scratch_dir(spark, "chat-nodes")
    nodes.write.parquet(path)
    nodes = spark.read.parquet(path)
    paths = branches(nodes.select("tree", "node", "parent"))
    scored = paths.join(nodes.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("score"))
    order = Window.partitionBy("tree").orderBy(F.col("score").desc(), "leaf")
    chosen = scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    turns = F.transform(F.sort_array(F.collect_list(F.struct((-F.col("up")).alias("at"), "role", "text"))), lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return (
        paths.join(chosen, ["tree", "leaf"])
        .join(nodes.select("tree", "node", "role", "text"), ["tree", "node"])
        .groupBy("tree", "leaf", "rank", "score")
        .agg(turns.alias("turns"))
        .mapInArrow(_write, FORMATTED)
    )


def as_replies(conversations: DataFrame) -> DataFrame:
    """Linear conversations (conv_id, turn, role, text) as trees in which each row answers the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    at = F.row_number().over(order)
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit(""))
    return conversations.select("conv_id", "turn", "role", "text", at.alias("at")).select(
        tree.alias("tree"), F.col("at").cast("string").alias("node"), F.when(F.col("at") > 1, (F.col("at") - 1).cast("string")).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )


_DIGESTS = "tree string, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def digests(formatted: DataFrame) -> DataFrame:
    """What the written conversations hold, read back from text and mask alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                turns = read_turns(text)
                whole = hashlib.sha256("".join(f"{role}\n{said}\n" for role, said in turns).encode()).hexdigest()
                loss = "".join(unescape(text[s["start"] : s["stop"]]) for s in spans)
                rows.append((len(turns), whole, len(loss), hashlib.sha256(loss.encode()).hexdigest(), len(text)))
            kinds = pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()
            names = [f.split()[0] for f in _DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds))], names)

    return formatted.select("tree", "formatted", "loss").mapInArrow(run, _DIGESTS)
