"""Chat formatting from reply trees.

Iterative self-joins double the distance of every message to an ancestor, so
paths from root to leaf take a logarithmic number of joins. Branches are ranked
by the scores on their path, and each chosen path becomes one conversation with
its loss mask. Control strings inside texts are escaped, and reading a
formatted conversation gives back the turns exactly.
"""

from __future__ import annotations

import re
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, per_batch

OPEN, CLOSE = "### ", " </turn>\n"
_TEXT = re.compile(r"\\|###|</turn>")
_ROLE = re.compile(r"\\|###|</turn>|:")
_ESCAPED = re.compile(r"\\(\\|###|</turn>|:)")
_END = re.compile(r"\\(?:\\|###|</turn>|:)|( </turn>\n)")
_HEAD = re.compile(r"### ((?:\\(?:\\|###|</turn>|:)|[^\\:])*): ", re.S)


def render(turns: list[tuple[str, str]], learn: str = "assistant") -> tuple[str, list[int], list[int]]:
    """The formatted conversation, and starts and ends of the texts of role ``learn``, in code points."""
    parts: list[str] = []
    starts: list[int] = []
    ends: list[int] = []
    at = 0
    for role, text in turns:
        head = f"{OPEN}{_ROLE.sub(r'\\\g<0>', role)}: "
        body = _TEXT.sub(r"\\\g<0>", text)
        parts += (head, body, CLOSE)
        if role == learn:
            starts.append(at + len(head))
            ends.append(at + len(head) + len(body))
        at += len(head) + len(body) + len(CLOSE)
    return "".join(parts), starts, ends


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted conversation."""
    out, start = [], 0
    for m in _END.finditer(formatted):
        if m[1] is not None:
            head = _HEAD.match(formatted, start)
            if head is None:
                raise ValueError(f"no turn at {start}")
            out.append((unescape(head[1]), unescape(formatted[head.end() : m.start()])))
            start = m.end()
    if start != len(formatted):
        raise ValueError(f"an open turn at {start}")
    return out


def chains(conversations: DataFrame) -> DataFrame:
    """Linear conversations as trees: each row replies to the one before it by turn.

    Rows of one turn go by role and text, null turns come first, and repeated
    rows each stay a turn. Rows without conv_id are left out.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    rows = conversations.where("conv_id IS NOT NULL").select("conv_id", "turn", "role", "text")
    rows = rows.withColumn("msg_id", F.row_number().over(order).cast("long"))
    parent = F.when(F.col("msg_id") > 1, F.col("msg_id") - 1)
    return rows.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        "msg_id",
        parent.alias("parent_id"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
        F.lit(1.0).alias("score"),
    )


def paths(messages: DataFrame, branches: int = 1) -> DataFrame:
    """conv_id, leaf, branch, msg_id and depth of every message on the ``branches`` best paths of a conversation.

    A parent that is missing makes its replies roots. Messages in a circle of
    replies, or below one, reach no root and are left out. A path's score is the
    mean of its messages' scores (null ones count zero), ties go to the smaller
    leaf. (conv_id, msg_id) must be unique.
    """
    nodes = messages.select("conv_id", "msg_id", "parent_id", F.coalesce("score", F.lit(0.0)).alias("score"))
    ids = nodes.select("conv_id", F.col("msg_id").alias("parent_id"), F.lit(True).alias("there"))
    sizes = cut(nodes.groupBy("conv_id").agg(F.count("*").alias("size")))
    up = nodes.join(ids, ["conv_id", "parent_id"], "left").join(sizes, "conv_id").select(
        "conv_id", "msg_id", "size", F.when(F.col("there"), F.col("parent_id")).alias("above"), F.lit(1).cast("long").alias("steps"), F.col("score").alias("total")
    )
    steps, ended = [cut(up)], []
    # 2 ** k messages up after k joins; a tree is at most as deep as its conversation is long, so longer ones alone go on
    longest = sizes.agg(F.max("size")).first()[0] or 0
    while (reach := 1 << (len(steps) - 1)) < longest and not steps[-1].where("above IS NOT NULL").isEmpty():
        ended.append(steps[-1].where(F.col("size") <= reach))
        now = steps[-1].where(F.col("size") > reach)
        far = now.select("conv_id", F.col("msg_id").alias("above"), F.col("above").alias("next"), F.col("steps").alias("more"), F.col("total").alias("add"))
        joined = now.where("above IS NOT NULL").join(far, ["conv_id", "above"]).select(
            "conv_id",
            "msg_id",
            "size",
            F.col("next").alias("above"),
            (F.col("steps") + F.col("more")).alias("steps"),
            (F.col("total") + F.col("add")).alias("total"),
        )
        steps.append(cut(joined.unionByName(now.where("above IS NULL"))))
    rooted = reduce(DataFrame.unionByName, [*ended, steps[-1]]).where("above IS NULL")
    parents = nodes.where("parent_id IS NOT NULL").select("conv_id", F.col("parent_id").alias("msg_id")).distinct()
    leaves = rooted.join(parents, ["conv_id", "msg_id"], "left_anti")
    order = Window.partitionBy("conv_id").orderBy((F.col("total") / F.col("steps")).desc(), "msg_id")
    chosen = leaves.withColumn("branch", F.row_number().over(order)).where(F.col("branch") <= branches)
    found = cut(chosen.select("conv_id", F.col("msg_id").alias("leaf"), "branch", "msg_id", F.col("steps").alias("depth")))
    # the same distances again, the longest first: each join doubles what is known of a path
    for k in reversed(range(len(steps))):
        hop = steps[k].where("above IS NOT NULL").select("conv_id", "msg_id", "above")
        more = found.join(hop, ["conv_id", "msg_id"]).select(
            "conv_id", "leaf", "branch", F.col("above").alias("msg_id"), (F.col("depth") - (1 << k)).alias("depth")
        )
        found = cut(found.union(more))
    return found


SCHEMA = "conv_id long, branch int, formatted string, loss_start array<long>, loss_end array<long>"


def format_trees(messages: DataFrame, branches: int = 1, learn: str = "assistant") -> DataFrame:
    """One row for each chosen path: conv_id, branch, formatted, loss_start and loss_end.

    ``messages`` has conv_id, msg_id, parent_id, role, text and score. Null
    roles and texts are written as empty ones.
    """
    on = paths(messages, branches).join(messages.select("conv_id", "msg_id", "role", "text"), ["conv_id", "msg_id"])
    turns = F.array_sort(F.collect_list(F.struct("depth", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))))
    rows = on.groupBy("conv_id", "branch").agg(turns.alias("turns"))
    rows = rows.select("conv_id", "branch", F.col("turns.role").alias("roles"), F.col("turns.text").alias("texts"))

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [render(list(zip(r, t, strict=True)), learn) for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            columns = [batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.string())]
            columns += [pa.array([m[k] for m in made], pa.list_(pa.int64())) for k in (1, 2)]
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in SCHEMA.split(", ")])

        return step

    return per_batch(rows, make, SCHEMA)


READ = "conv_id long, branch int, roles array<string>, texts array<string>, learnt array<string>, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Roles and texts of each formatted conversation, and the unescaped texts under its loss mask."""

    def make():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [x or "" for x in batch.column(2).to_pylist()]
            turns = [parse(x) for x in texts]
            spans = zip(texts, batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True)
            learnt = [[unescape(x[a:b]) for a, b in zip(starts or [], ends or [], strict=True)] for x, starts, ends in spans]
            lists = [[[t[k] for t in ts] for ts in turns] for k in (0, 1)]
            columns = [batch.column(0), batch.column(1), *[pa.array(x, pa.list_(pa.string())) for x in (*lists, learnt)]]
            columns.append(pa.array([len(x) for x in texts], pa.int64()))
            return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in READ.split(", ")])

        return step

    rows = formatted.select(*[x.split()[0] for x in SCHEMA.split(", ")])
    return per_batch(rows, make, READ)
