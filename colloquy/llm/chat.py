"""Chat formatting of reply trees, in DataFrame functions only.

Iterative self-joins enumerate the path from each leaf up to its root: round k
joins the paths found so far with the ancestors 2**k steps up, so a path of n
messages takes about log2(n) rounds. Branches are ranked by score and each
chosen path becomes one conversation.

The template writes a message as ``<|role|>text<|end|>``. Inside roles and texts
``%``, ``<``, ``[`` and ``|`` are written as ``%25``, ``%3C``, ``%5B`` and
``%7C``, so that no control string, of this template or of others that use
angle or square brackets, can occur there; ``unescape`` undoes it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Scratch

ESCAPES = (("%", "%25"), ("<", "%3C"), ("[", "%5B"), ("|", "%7C"))
END = "<|end|>"


def escape(c: Column) -> Column:
    for plain, written in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescape(c: Column) -> Column:
    for plain, written in reversed(ESCAPES):
        c = F.replace(c, F.lit(written), F.lit(plain))
    return c


def message(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), escape(role), F.lit("|>"), escape(text), F.lit(END))


def _jumps(own: DataFrame, scratch: Scratch) -> tuple[list[DataFrame], bool]:
    """Tables (tree, node, parent) of the ancestors 1, 2, 4, ... steps up; and whether parents run in a circle.

    In a tree of n nodes nobody has an ancestor n steps up, unless there is a circle.
    """
    most = own.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    known = own.select("tree", F.col("node").alias("parent"))
    found = [scratch.table(own.where("parent is not null").join(known, ["tree", "parent"], "left_semi").select("tree", "node", "parent"), "jump0")]
    while not found[-1].isEmpty():
        if 1 << (len(found) - 1) >= most:
            return found, True
        higher = found[-1].select("tree", F.col("node").alias("parent"), F.col("parent").alias("top"))
        found.append(scratch.table(found[-1].join(higher, ["tree", "parent"]).select("tree", "node", F.col("top").alias("parent")), f"jump{len(found)}"))
    return found, False


def _opened(own: DataFrame, jumps: list[DataFrame], scratch: Scratch) -> DataFrame:
    """``own`` with each circle of parents opened: the smallest node of a circle becomes a root."""
    # so many steps up everyone is in a circle, and everyone in a circle is reached
    inside = scratch.table(jumps[-1].select("tree", F.col("parent").alias("node")).distinct(), "circles")
    least = inside.select("tree", "node", F.col("node").alias("least"))
    for k, jump in enumerate(jumps):  # the least of the next 2, 4, 8, ... nodes
        ahead = least.select("tree", F.col("node").alias("parent"), F.col("least").alias("other"))
        least = scratch.table(least.join(jump, ["tree", "node"]).join(ahead, ["tree", "parent"]).select("tree", "node", F.least("least", "other").alias("least")), f"least{k}")
    roots = least.where("node = least").select("tree", "node", F.lit(True).alias("root"))
    return scratch.table(own.join(roots, ["tree", "node"], "left").select("tree", "node", F.when(F.col("root").isNull(), F.col("parent")).alias("parent")), "opened")


def paths(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """(tree, leaf, node, up): the messages on the way from each leaf to its root, ``up`` steps above the leaf.

    ``nodes``: tree, node, parent (null: a root), (tree, node) once each. A parent
    that does not exist makes its child a root; so does a circle of parents, for
    its smallest node. Each message of a path is a row, so the rows are as many as
    the paths are long; what a round adds is written once.
    """
    own = nodes.select("tree", "node", "parent")
    jumps, circle = _jumps(own, scratch)
    if circle:
        own = _opened(own, jumps, scratch)
        scratch.drop(*jumps)
        jumps, _ = _jumps(own, scratch)
    leaves = own.select("tree", "node").join(jumps[0].select("tree", F.col("parent").alias("node")), ["tree", "node"], "left_anti")
    so_far = scratch.table(leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")), "path0")
    for k, jump in enumerate(jumps[:-1]):  # the last is empty
        above = jump.select("tree", "node", F.col("parent").alias("above"))
        more = scratch.table(so_far.join(above, ["tree", "node"]).select("tree", "leaf", F.col("above").alias("node"), (F.col("up") + (1 << k)).alias("up")), f"path{k + 1}")
        so_far = so_far.unionByName(more)
    scratch.drop(*jumps)
    return so_far


def _once(nodes: DataFrame, scratch: Scratch) -> DataFrame:
    """``nodes`` with each (tree, node) once: of repeated ones the first by parent, role, text and score, nulls first."""
    twice = scratch.table(nodes.groupBy("tree", "node").count().where("count > 1").select("tree", "node"), "repeated", "snappy")
    if twice.isEmpty():
        return nodes
    rest = [c for c in nodes.columns if c not in ("tree", "node")]
    first = nodes.join(twice, ["tree", "node"], "left_semi").groupBy("tree", "node").agg(F.min(F.struct(*rest)).alias("x")).select("tree", "node", "x.*")
    return nodes.join(twice, ["tree", "node"], "left_anti").unionByName(first)


def format_trees(nodes: DataFrame, best: int = 1, loss_role: str = "assistant") -> DataFrame:
    """tree, leaf, rank, n_turns, formatted, mask: the ``best`` branches of each tree as conversations.

    ``nodes``: tree, node, parent, role, text, score; other columns are not looked
    at. A branch's score is the sum over its messages (null: 0), ties go to the
    smaller leaf. Null roles and texts are empty. Repeated nodes count once, the
    first by parent, role, text and score. A lost parent makes a root, and so does
    a circle of parents, for its smallest node. ``mask`` has the byte ranges
    (start, n) of ``formatted`` in UTF-8 that count for the loss: the texts of
    ``loss_role``, without marks.
    """
    scratch = Scratch(nodes.sparkSession, "chat")
    nodes = _once(nodes.select("tree", "node", "parent", "role", "text", "score"), scratch)
    chain = paths(nodes, scratch)
    said = nodes.select("tree", "node", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    scores = chain.join(said.select("tree", "node", "score"), ["tree", "node"]).groupBy("tree", "leaf").agg(F.sum("score").alias("score"))
    chosen = scores.withColumn("rank", F.row_number().over(W.partitionBy("tree").orderBy(F.col("score").desc(), "leaf"))).where(F.col("rank") <= best).select("tree", "leaf", "rank")
    turns = chain.join(chosen, ["tree", "leaf"]).join(said.drop("score"), ["tree", "node"])
    turns = turns.select("tree", "leaf", "rank", "up", (F.col("role") == loss_role).alias("loss"), message(F.col("role"), F.col("text")).alias("piece"), F.octet_length(escape(F.col("text"))).alias("n"))
    ahead = W.partitionBy("tree", "leaf").orderBy(F.col("up").desc()).rowsBetween(W.unboundedPreceding, 0)
    turns = turns.withColumn("start", F.sum(F.octet_length("piece").cast("long")).over(ahead) - F.lit(len(END)) - F.col("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("up")).alias("at"), "piece", "start", "n", "loss")))
    rows = turns.groupBy("tree", "leaf", "rank").agg(order.alias("t"))
    mask = F.transform(F.filter("t", lambda x: x["loss"]), lambda x: F.struct(x["start"].alias("start"), x["n"].alias("n")))
    return rows.select("tree", "leaf", "rank", F.size("t").cast("long").alias("n_turns"), F.concat_ws("", F.col("t.piece")).alias("formatted"), mask.alias("mask"))


def turn_trees(rows: DataFrame, id_col: str = "conv_id", order_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """Nodes for ``format_trees`` of a table of turns: each row replies to the row before it in its conversation.

    Rows that tie in the order follow by role, then text, nulls first. A null id
    is a conversation of its own.
    """
    flat = rows.select(F.col(id_col).cast("long").alias("tree"), F.col(order_col).alias("o"), F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    flat = flat.withColumn("tree", F.struct(F.coalesce("tree", F.lit(0)).alias("id"), F.col("tree").isNull().alias("none")))
    place = F.row_number().over(W.partitionBy("tree").orderBy("o", "role", "text")).cast("long")
    return flat.withColumn("node", place).select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(1.0).alias("score"))


def digests(formatted: DataFrame) -> DataFrame:
    """What op10 returns, read back from ``formatted`` and ``mask`` alone."""
    parts = F.filter(F.split("formatted", r"<\|end\|>", -1), lambda p: p != "")
    said = F.transform(parts, lambda p: F.concat(unescape(F.regexp_extract(p, r"^<\|([^|]*)\|>", 1)), F.lit("\n"), unescape(F.regexp_replace(p, r"^<\|[^|]*\|>", "")), F.lit("\n")))
    whole = F.encode("formatted", "utf-8")
    loss = F.concat_ws("", F.transform("mask", lambda m: unescape(F.decode(F.substring(F.col("whole"), (m["start"] + 1).cast("int"), m["n"].cast("int")), "utf-8"))))
    rows = formatted.withColumn("whole", whole).withColumn("loss", loss)
    return rows.select(
        F.when(~F.col("tree.none"), F.col("tree.id")).alias("conv_id"),
        F.size(parts).cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", said), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
