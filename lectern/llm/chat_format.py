"""Chat formatting of reply trees, with DataFrame operations only.

Messages (tree, node, parent, role, text, score) form reply trees. Root-to-leaf paths are
enumerated by self-joins with pointer doubling: after round k every node knows its 2^k-th
ancestor, and every path holds its last 2^k nodes, so a tree of depth d takes log2(d)
rounds and the rows made equal the summed path lengths. Paths are ranked by the mean score
of their nodes within each tree; the best ``branches`` are formatted as one conversation
each.

Template: ``<|turn|>role\\ntext<|end|>`` per turn. Control strings that occur inside a role
or a text are made harmless by one backslash before their last character; existing
backslashes at that place are kept by adding one more, so removing one restores the text.
A role's line feeds are written as a control string of their own.

Edge cases: a null text or role is an empty string; a node whose parent is missing is a
root; nodes on a cycle, or below one, reach no root and belong to no path; rows with a null
tree form a tree of their own; node ids must be given and unique in their tree. A linear
conversation gets such ids from chain_parents: its rows are ordered by turn, null turns
last, then by role and text, and a repeated turn is one more message. A null score counts
as 0; ties in score are broken by leaf id; an empty table gives an empty result; extra
columns are ignored. A formatted conversation is one row, so one conversation must fit into
a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import shared_dir

TURN, END, LINE = "<|turn|>", "<|end|>", "<|line|>"
#: Strings that mark structure in this or in other common templates; never left bare in a text.
CONTROL = r"(<\|(?:turn|end|line)\|\\*|</?s\\*|\[/?INST\\*)([>\]])"
GUARDED = r"(<\|(?:turn|end|line)\|\\*|</?s\\*|\[/?INST\\*)\\([>\]])"


def escape(c: Column) -> Column:
    return F.regexp_replace(c, CONTROL, r"$1\\$2")


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, GUARDED, "$1$2")


def chain_parents(messages: DataFrame, tree: str, order: str, ties: tuple[str, ...] = ("role", "text")) -> DataFrame:
    """Linear conversations as trees: adds node, a message's place, and parent, the place before it."""
    w = Window.partitionBy(tree).orderBy(F.asc_nulls_last(order), *ties)
    placed = messages.withColumn("node", F.row_number().over(w).cast("long"))
    return placed.withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))


def _tree_key(tree: str) -> Column:
    """Joins match a struct that holds a null, unlike a null."""
    return F.struct(F.col(tree).alias("id")).alias("tree")


def root_to_leaf_paths(messages: DataFrame, tree: str = "tree", node: str = "node", parent: str = "parent") -> DataFrame:
    """(tree, leaf, node, up): every node of every root-to-leaf path, up = steps above the leaf."""
    paths = _paths(messages.select(_tree_key(tree), F.col(node).alias("node"), F.col(parent).alias("parent")))
    return paths.withColumn("tree", F.col("tree.id"))


def _paths(messages: DataFrame) -> DataFrame:
    """root_to_leaf_paths of (tree key, node, parent), with the tree's key."""
    shared_dir(messages.sparkSession)
    ids = messages.distinct()
    known = ids.select("tree", F.col("node").alias("parent")).distinct().withColumn("there", F.lit(True))
    jump = ids.join(known, ["tree", "parent"], "left").select(
        "tree", "node", F.when(F.col("there"), F.col("parent")).alias("to")
    ).checkpoint()
    inner = jump.where("to is not null").select("tree", F.col("to").alias("node")).distinct()
    leaves = jump.join(inner, ["tree", "node"], "left_anti")
    paths = leaves.select("tree", F.col("node").alias("leaf"), "node", F.lit(0).cast("long").alias("up")).checkpoint()
    # no path is longer than the largest tree
    reach, limit = 1, jump.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while not (step := jump.where("to is not null")).isEmpty():
        if reach > limit:  # what still leads on leads into a cycle
            return paths.join(step.select("tree", F.col("node").alias("leaf")), ["tree", "leaf"], "left_anti")
        more = paths.join(step, ["tree", "node"]).select("tree", "leaf", F.col("to").alias("node"), (F.col("up") + reach).alias("up"))
        paths = paths.unionByName(more).checkpoint()
        far = step.select("tree", F.col("node").alias("to"), F.col("to").alias("farther"))
        jump = step.join(far, ["tree", "to"], "left").select("tree", "node", F.col("farther").alias("to")).checkpoint()
        reach *= 2
    return paths


def format_conversations(
    messages: DataFrame,
    tree: str = "tree",
    node: str = "node",
    parent: str = "parent",
    role: str = "role",
    text: str = "text",
    score: str | None = None,
    branches: int | None = None,
    learn_roles: tuple[str, ...] = ("assistant",),
) -> DataFrame:
    """One row per chosen path: tree, leaf, branch_rank, branch_score, formatted, loss_spans.

    loss_spans are [start, length) pairs in code points of ``formatted``: the texts of the
    roles in ``learn_roles``, and nothing between them.
    """
    value = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    own = messages.select(
        _tree_key(tree),
        F.col(node).alias("node"),
        F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
        value.alias("score"),
    )
    paths = _paths(messages.select(_tree_key(tree), F.col(node).alias("node"), F.col(parent).alias("parent")))
    chosen = paths
    if branches is not None:
        scored = paths.join(own, ["tree", "node"]).groupBy("tree", "leaf").agg(F.avg("score").alias("branch_score"))
        best = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
        ranked = scored.withColumn("branch_rank", F.row_number().over(best)).where(F.col("branch_rank") <= branches)
        chosen = paths.join(ranked.select("tree", "leaf"), ["tree", "leaf"], "left_semi")
    head = F.concat(F.lit(TURN), F.regexp_replace(escape(F.col("role")), "\n", LINE), F.lit("\n"))
    turns = chosen.join(own, ["tree", "node"]).select(
        "tree",
        "leaf",
        (-F.col("up")).alias("at"),
        "score",
        head.alias("head"),
        escape(F.col("text")).alias("body"),
        F.col("role").isin(*learn_roles).alias("learn"),
    )
    joined = (
        turns.groupBy("tree", "leaf")
        .agg(
            F.array_sort(F.collect_list(F.struct("at", "head", "body", "learn"))).alias("turns"),
            F.avg("score").alias("branch_score"),
        )
        .withColumn("formatted", F.array_join(F.transform("turns", lambda t: F.concat(t.head, t.body, F.lit(END))), ""))
    )
    # where each text begins: lengths of all turns before it, and of its own head
    begun = F.aggregate(
        "turns",
        F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:long,length:long>>").alias("spans")),
        lambda acc, t: F.struct(
            (acc.at + F.length(t.head) + F.length(t.body) + len(END)).cast("long").alias("at"),
            F.when(
                t.learn,
                F.concat(
                    acc.spans,
                    F.array(F.struct((acc.at + F.length(t.head)).cast("long").alias("start"), F.length(t.body).cast("long").alias("length"))),
                ),
            )
            .otherwise(acc.spans)
            .alias("spans"),
        ),
    )
    rank = Window.partitionBy("tree").orderBy(F.desc("branch_score"), "leaf")
    return joined.select(
        F.col("tree.id").alias("tree"), "leaf", F.row_number().over(rank).alias("branch_rank"), "branch_score", "formatted", begun.spans.alias("loss_spans")
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role,text>> parsed from a formatted conversation."""
    parts = F.filter(F.split(formatted, r"<\|turn\|>", -1), lambda x: F.length(x) > 0)
    body = lambda x: F.substr(x, F.lit(1), F.length(x) - len(END))
    cut = lambda x: F.instr(x, "\n")
    return F.transform(
        F.transform(parts, body),
        lambda x: F.struct(
            unescape(F.regexp_replace(F.substr(x, F.lit(1), F.locate("\n", x) - 1), r"<\|line\|>", "\n")).alias("role"),
            unescape(F.substr(x, F.locate("\n", x) + 1)).alias("text"),
        ),
    )


def conversation_digest(conversations: DataFrame) -> DataFrame:
    """What the formatted output holds, read back from it: one row per conversation."""
    spark = conversations.sparkSession
    extra = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("</s>[INST] ok [/INST]").alias("text"),
    )
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").unionByName(extra)
    out = format_conversations(chain_parents(rows, "conv_id", "turn"), "conv_id")
    back = out.select("tree", "formatted", "loss_spans", read_back(F.col("formatted")).alias("turns"))
    spelled = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    learned = F.array_join(
        F.transform("loss_spans", lambda s: unescape(F.substr(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int")))), ""
    )
    return back.select(
        F.col("tree").alias("conv_id"),
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spelled, 256).alias("turns_sha256"),
        F.length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
