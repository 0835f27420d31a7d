"""Chat formatting over reply trees, with DataFrame functions only.

Messages form trees: each has a parent or is a root. Paths from root to leaf
are found by self-joins that double their reach: after k joins every message
knows its 2^k-th ancestor and the score of the messages up to there, so a
path of n messages takes log2(n) joins each way. Leaves give the branches of
a tree; they are ranked by the summed score of their path, the best
`branches` are kept, and their messages are gathered by walking the same
jumps from the longest to the shortest. Each path becomes one conversation.

Template: `### <role>: <text></turn>` per message, joined by a newline. In
texts and roles `\\`, `<`, `#` (and `:` in roles) are written as `\\b`, `\\l`,
`\\h`, `\\c`, so no text can contain a control string, and reading back is exact.

Defined cases: null role and text are empty. A parent that does not exist
makes its message a root. Messages on a cycle, or below one, have no root
and are left out. Equal scores: the smaller leaf id first. Rows of a
conversation table are ordered by turn, then role, then text, nulls first;
a null conv_id is one conversation. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickfold.llm.common import scratch

# --- fixed values: the template ------------------------------------------------
TURN_START, ROLE_END, TURN_END, BETWEEN = "### ", ": ", "</turn>", "\n"
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))
TURN_PATTERN = r"(?s)^\n?### ([^:]*): (.*)$"
# ---------------------------------------------------------------------------------


def escape(text: Column, escapes: tuple = ESCAPES) -> Column:
    for plain, written in escapes:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column, escapes: tuple = ESCAPES) -> Column:
    for plain, written in reversed(escapes):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def replies_of(conversations: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as reply trees without forks:
    each turn replies to the one before."""
    order = Window.partitionBy("tree").orderBy(F.asc_nulls_first("turn"), F.asc_nulls_first("role"), F.asc_nulls_first("text"))
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", "role", "text")
    node = rows.withColumn("node", F.row_number().over(order).cast("long"))
    return node.select("tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def _step(a: DataFrame, key: str, jumps: DataFrame) -> DataFrame:
    """`a` left-joined with `jumps` (tree, node, up, score, far) at a[key]."""
    b = jumps.select(F.col("tree").alias("t"), F.col("node").alias("n"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("far").alias("far2"))
    return a.join(b, F.col("tree").eqNullSafe(F.col("t")) & (F.col(key) == F.col("n")), "left").drop("t", "n")


def best_paths(messages: DataFrame, *, branches: int = 1) -> DataFrame:
    """(tree, branch, leaf, place, node): the messages of the `branches` best
    root-to-leaf paths of each tree; place counts from 0 at the root.

    `messages`: tree, node, parent (null for roots), score."""
    own = messages.select("tree", "node", F.col("parent").alias("up"), F.coalesce("score", F.lit(0.0)).alias("score"), F.lit(1).cast("long").alias("far"))
    replies = _step(own.where("up is not null"), "up", own).withColumn("up", F.when(F.col("far2").isNotNull(), F.col("up")))
    level = own.where("up is null").unionByName(replies.select(own.columns))
    level = scratch(level, "reply-jumps")
    levels, total = [level], level.count()
    parents = level.where("up is not null").select(F.col("tree").alias("t"), F.col("up").alias("n")).distinct()
    leaves = level.join(parents, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")), "left_anti").select("tree", "node")
    leaves = scratch(leaves, "reply-leaves")
    # up: 2^k messages further; score and far: summed over the messages passed
    while 1 << (len(levels) - 1) < total and not levels[-1].where("up is not null").isEmpty():
        # only messages that have not reached their root yet are joined again
        last = levels[-1]
        further = _step(last.where("up is not null"), "up", last).select(
            "tree", "node", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), (F.col("far") + F.col("far2")).alias("far")
        )
        levels.append(scratch(last.where("up is null").unionByName(further), "reply-jumps"))
    rooted = levels[-1].where("up is null").select("tree", "node", "score", F.col("far").alias("length"))
    ends = leaves.join(
        rooted.select(F.col("tree").alias("t"), F.col("node").alias("n"), "score", "length"),
        F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")),
    )
    best = Window.partitionBy("tree").orderBy(F.desc("score"), "node")
    chosen = ends.withColumn("branch", F.row_number().over(best)).where(F.col("branch") <= branches)
    path = scratch(chosen.select("tree", "branch", F.col("node").alias("leaf"), "node", (F.col("length") - 1).alias("place")), "reply-paths")
    for k in range(len(levels) - 1, -1, -1):
        jumps = levels[k].where("up is not null")
        if k == len(levels) - 1 and jumps.isEmpty():
            continue
        b = jumps.select(F.col("tree").alias("t"), F.col("node").alias("n"), "up")
        passed = path.join(b, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n")))
        passed = passed.select("tree", "branch", "leaf", F.col("up").alias("node"), (F.col("place") - (1 << k)).alias("place"))
        path = scratch(path.unionByName(passed), "reply-paths")
    return path


def format_paths(messages: DataFrame, paths: DataFrame) -> DataFrame:
    """(tree, branch, formatted, loss_spans): one conversation per path.
    loss_spans: start and end (code points of `formatted`, end exclusive) of
    each assistant text, in order."""
    texts = messages.select(
        F.col("tree").alias("t"), F.col("node").alias("n"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    turns = paths.join(texts, F.col("tree").eqNullSafe(F.col("t")) & (F.col("node") == F.col("n"))).select(
        "tree", "branch", "place", "role",
        F.concat(F.lit(TURN_START), escape(F.col("role"), ROLE_ESCAPES), F.lit(ROLE_END)).alias("head"), escape(F.col("text")).alias("body"),
    )
    written = F.char_length("head") + F.char_length("body") + len(TURN_END) + len(BETWEEN)
    before = Window.partitionBy("tree", "branch").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(written).over(before), F.lit(0)) + F.char_length("head"))
    mask = F.when(F.col("role") == "assistant", F.struct(F.col("start"), (F.col("start") + F.char_length("body")).alias("end")))
    turn = F.struct("place", F.concat("head", "body", F.lit(TURN_END)).alias("turn"), mask.alias("mask"))
    whole = turns.groupBy("tree", "branch").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    return whole.select(
        "tree", "branch", F.array_join("turns.turn", BETWEEN).alias("formatted"),
        F.filter("turns.mask", lambda m: m.isNotNull()).alias("loss_spans"),
    )


def _pieces(formatted: Column) -> Column:
    """The written turns without their ends."""
    pieces = F.split(formatted, TURN_END)
    return F.slice(pieces, F.lit(1), F.size(pieces) - 1)


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>> read back from a formatted conversation."""
    pieces = _pieces(formatted)
    part = lambda p, g: F.regexp_extract(p, TURN_PATTERN, g)
    return F.transform(pieces, lambda p: F.struct(unescape(part(p, 1), ROLE_ESCAPES).alias("role"), unescape(part(p, 2)).alias("text")))


def read_loss(formatted: Column, loss_spans: Column) -> Column:
    """The text under the loss mask, unescaped. A span ends with its turn, so
    it is cut off the end of that turn: counting characters from the start of
    the whole text for every span would take quadratic time."""
    masked = F.filter(_pieces(formatted), lambda p: F.regexp_extract(p, TURN_PATTERN, 1) == "assistant")
    length = lambda s: (s["end"] - s["start"]).cast("int")
    cut = F.zip_with(masked, loss_spans, lambda p, s: unescape(F.substring(p, F.char_length(p) - length(s) + 1, length(s))))
    return F.array_join(cut, "")
