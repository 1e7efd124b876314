"""Operator 3: chat formatting of reply trees.

Messages (tree, node, parent, role, text, score) form trees; a branch is the
path from a root to a leaf. Paths are followed by iterative self-joins that
double their reach: after round k a node knows its ancestor 2^k steps up and the
score, summed, of the steps between, so the rounds follow the logarithm of the
depth. Branches are ranked within their tree by summed score, then length, then
leaf; the chosen ones are walked back to the root with the same tables, bit by
bit of the distance, which gives each (branch, message) once. Every chosen
branch becomes one conversation string with the spans of its assistant texts.

A turn is ``<turn:ROLE>\\nTEXT\\n</turn>\\n``. Inside roles and texts ``&``, ``<``
and ``>`` are written ``&amp;``, ``&lt;`` and ``&gt;``, so no text can make a
control string, and reading back is exact.

Null texts and roles are empty, null scores 0. A message whose parent is null,
missing in its tree or itself is a root. Messages without a node id are branches
of their own; of rows that repeat a node id the least (parent, role, text) counts.
Null tree ids form one tree. Parents that go round in a circle are an error. An
empty table gives an empty result. DataFrame functions only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import materialize

HEAD, MIDDLE, TAIL = "<turn:", ">\n", "\n</turn>\n"
MAX_ROUNDS = 64


def escape(c: Column) -> Column:
    for plain, coded in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(plain), F.lit(coded))
    return c


def unescape(c: Column) -> Column:
    for plain, coded in ((">", "&gt;"), ("<", "&lt;"), ("&", "&amp;")):
        c = F.replace(c, F.lit(coded), F.lit(plain))
    return c


def _key(c: Column) -> Column:
    """Join key that tells null from any value."""
    return F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("null"))


def nodes(messages: DataFrame, tree: str, node: str, parent: str, role: str, text: str, score: str | None) -> DataFrame:
    """One row for each node: keys t, v and p (null for a root) beside role, text and score."""
    rows = messages.select(
        F.col(tree).alias("tree"), F.col(node).alias("node"), _key(F.col(tree)).alias("t"),
        F.when(F.col(node).isNull(), F.concat(F.lit("#"), F.monotonically_increasing_id())).otherwise(_key(F.col(node))).alias("v"),
        F.when(F.col(parent) != F.col(node), _key(F.col(parent))).alias("p"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        (F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)).alias("score"))
    one = rows.groupBy("t", "v").agg(F.min_by(F.struct("tree", "node", "p", "role", "text", "score"),
                                              F.struct("p", "role", "text", "score")).alias("m")).select("t", "v", "m.*")
    here = one.select("t", F.col("v").alias("p"), F.lit(True).alias("there"))
    return (one.join(here, ["t", "p"], "left")
            .select("t", "v", F.when(F.col("there"), F.col("p")).alias("p"), "tree", "node", "role", "text", "score"))


def branches(msgs: DataFrame, top: int | None = 1) -> DataFrame:
    """(t, leaf, rank, v, up): the messages of the chosen branches of
    ``nodes``, ``up`` steps above the leaf; ``top`` branches of a tree (None: all)."""
    # reach 2^k: up is the ancestor (null beyond the root), gained the score of the 2^k nodes from v on, seen their number
    step, _ = materialize(msgs.select("t", "v", F.col("p").alias("up"), F.col("score").alias("gained"),
                                      F.lit(1).cast("long").alias("seen")), "tree-lift")
    lifts, done = [], []  # by round: nodes that go on, and nodes whose reach has passed the root
    for _ in range(MAX_ROUNDS):
        live = step.where("up is not null")
        if live.isEmpty():
            break
        lifts.append(live)
        below = [*done, step]
        done.append(step.where("up is null"))
        above = reduce(DataFrame.unionByName, below).select("t", F.col("v").alias("up"), F.col("up").alias("up2"),
                                                            F.col("gained").alias("g2"), F.col("seen").alias("s2"))
        step, _ = materialize(live.join(above, ["t", "up"]).select(
            "t", "v", F.col("up2").alias("up"), (F.col("gained") + F.col("g2")).alias("gained"),
            (F.col("seen") + F.col("s2")).alias("seen")), "tree-lift")
    else:
        raise ValueError("parents go round in a circle")
    ends = reduce(DataFrame.unionByName, [*done, step])
    inner = msgs.where("p is not null").select("t", F.col("p").alias("v")).distinct()
    leaves = ends.join(inner, ["t", "v"], "left_anti")
    order = [F.desc("gained"), F.desc("seen"), F.asc("v")]
    ranked = leaves.withColumn("rank", F.row_number().over(Window.partitionBy("t").orderBy(*order)))
    if top is not None:
        ranked = ranked.where(F.col("rank") <= top)
    walk = ranked.select("t", F.col("v").alias("leaf"), "rank", "v", F.lit(0).cast("long").alias("up"))
    for k in reversed(range(len(lifts))):
        jump = lifts[k].select("t", "v", F.col("up").alias("to"))
        both = F.array(F.struct("v", "up"), F.struct(F.col("to").alias("v"), (F.col("up") + 2 ** k).alias("up")))
        walk = (walk.join(jump, ["t", "v"], "left").select("t", "leaf", "rank", F.explode(both).alias("x"))
                .select("t", "leaf", "rank", "x.v", "x.up").where("v is not null"))
    return walk


def format_trees(messages: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent", role: str = "role",
                 text: str = "text", score: str | None = "score", top: int | None = 1,
                 learn_role: str = "assistant") -> DataFrame:
    """(tree, rank, leaf, n_turns, formatted, loss): one row for each chosen
    branch. ``loss`` has the spans (start, length, in characters of
    ``formatted``) of the texts of ``learn_role``, in order."""
    msgs, _ = materialize(nodes(messages, tree, node, parent, role, text, score), "tree-nodes")
    rows = branches(msgs, top).join(msgs, ["t", "v"])
    head = F.concat(F.lit(HEAD), escape(F.col("role")), F.lit(MIDDLE))
    body = escape(F.col("text"))
    rows = rows.select("t", "leaf", "rank", "tree", "up", "role", head.alias("head"), body.alias("body"),
                       F.when(F.col("up") == 0, F.col("node")).alias("leaf_node"))
    size = F.length("head") + F.length("body") + len(TAIL)
    before = Window.partitionBy("t", "leaf", "rank").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("at", F.coalesce(F.sum(size).over(before), F.lit(0)) + F.length("head"))
    turn = F.struct((-F.col("up")).alias("place"), F.concat("head", "body", F.lit(TAIL)).alias("said"),
                    (F.col("role") == learn_role).alias("learn"), F.col("at").alias("start"), F.length("body").alias("length"))
    conv = rows.groupBy("t", "leaf", "rank").agg(F.first("tree").alias("tree"), F.max("leaf_node").alias("leaf_node"),
                                                 F.sort_array(F.collect_list(turn)).alias("turns"))
    spans = F.transform(F.filter("turns", lambda x: x["learn"]), lambda x: F.struct(x["start"], x["length"]))
    return conv.select("tree", "rank", F.col("leaf_node").alias("leaf"), F.size("turns").alias("n_turns"),
                       F.array_join(F.transform("turns", lambda x: x["said"]), "").alias("formatted"), spans.alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text) read back from a formatted conversation."""
    # the last piece is what follows the last turn: nothing
    said = F.filter(F.split(formatted, TAIL), lambda x: x.startswith(HEAD))
    role = lambda x: F.regexp_extract(x, f"^{HEAD}([^>]*)>", 1)
    skip = len(HEAD) + len(MIDDLE)
    return F.transform(said, lambda x: F.struct(
        unescape(role(x)).alias("role"), unescape(F.substring(x, F.length(role(x)) + skip + 1, F.length(x))).alias("text")))


def read_loss(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.transform(loss, lambda s: unescape(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"]))), "")
