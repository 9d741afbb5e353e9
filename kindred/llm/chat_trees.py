"""Chat formatting of reply trees.

Messages name their parent. Iterative self-joins that double their reach find for
each message how far it is from its root, and the sum of scores on the way: after
k joins it knows its 2**k nearest ancestors, so a thread of n messages takes
log2(n) rounds and no array grows. Leaves that reach a root end a root-to-leaf
path; the paths of a tree are ranked by mean score, then by leaf, and the best
are chosen before any path is written out. Only the chosen paths are then
enumerated, by joins with the same doubling tables, and each becomes one text.

Template, a turn: ``### {role}: {text}</turn>`` and a new line. In roles and
texts ``\\``, ``#``, ``<`` and ``:`` (roles only) are written as ``\\b``,
``\\h``, ``\\l`` and ``\\c``, so no turn mark can occur inside, and the reverse
gives the exact text. The loss mask is a list of [start, end) ranges, in code
points of the formatted text, of what assistants say.

Defined cases: null text and role are empty. Messages whose parent does not
exist, or is null, are roots; messages on a cycle, and all that hang from one,
belong to no path. A null score counts as 0. Paths of one mean score are ranked by
leaf. Among rows of one turn the order is by role, then text, and repeated rows are
each a turn. Rows with a null conversation form one conversation. Texts of any
length are formatted whole. An empty table gives no rows. Other columns than those
named are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from kindred.llm.scratch import Scratch

OPEN, SAID, CLOSE = "### ", ": ", "</turn>\n"


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for plain, code in (("<", "\\l"), ("#", "\\h"), ("\\", "\\b")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def chain(conversations: DataFrame) -> DataFrame:
    """Messages of linear conversations: each turn replies to the one before."""
    scratch = Scratch(conversations.sparkSession, "chat")
    rows = conversations.select(F.col("conv_id").alias("tree"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = scratch.save(rows.withColumn("node", F.monotonically_increasing_id()), "messages")
    w = Window.partitionBy("tree").orderBy("turn", "role", "text", "node")
    return scratch.save(rows.select("tree", "node", F.lag("node").over(w).alias("parent"), "role", "text", F.lit(0.0).alias("score")), "messages")


def ranked_leaves(messages: DataFrame, scratch: Scratch, best: int) -> tuple[DataFrame, list[DataFrame]]:
    """leaf, branch_rank and path_score of the best paths of each tree; and tables (node, far) of ancestors 1, 2, 4, .. up."""
    links = messages.select("node", "parent", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("total"), F.lit(1).cast("long").alias("n"))
    known = links.select(F.col("node").alias("far"))
    now = links.join(known, links.parent == known.far, "left").select("node", "far", "total", "n")
    now = scratch.save(now, "reach")
    jumps, left = [], None
    while True:
        open_ = now.where("far is not null").count()
        # Each round ends the way of some message, unless all that are left hang from cycles.
        if not open_ or open_ == left:
            break
        left = open_
        jumps.append(now.where("far is not null").select("node", "far"))
        then = now.select(F.col("node").alias("far"), F.col("far").alias("farther"), F.col("total").alias("more"), F.col("n").alias("m"))
        joined = now.join(then, "far", "left")
        now = scratch.save(joined.select("node", F.col("farther").alias("far"), (F.col("total") + F.coalesce("more", F.lit(0.0))).alias("total"), (F.col("n") + F.coalesce("m", F.lit(0))).alias("n")), "reach")
    parents = jumps[0].select(F.col("far").alias("node")).distinct() if jumps else known.select(F.col("far").alias("node")).where("false")
    leaves = now.where("far is null").join(parents, "node", "left_anti").join(messages.select("node", "tree"), "node")
    w = Window.partitionBy("tree").orderBy(F.desc("path_score"), "leaf")
    ranked = leaves.select("tree", F.col("node").alias("leaf"), (F.col("total") / F.col("n")).alias("path_score")).withColumn("branch_rank", F.row_number().over(w))
    return scratch.save(ranked.where(F.col("branch_rank") <= best).drop("tree"), "leaves"), jumps


def paths(leaves: DataFrame, jumps: list[DataFrame], scratch: Scratch) -> DataFrame:
    """Rows (leaf, node, up): the messages from each leaf to its root, ``up`` steps above the leaf."""
    found = leaves.select("leaf", F.col("leaf").alias("node"), F.lit(0).alias("up"))
    for k, jump in enumerate(jumps):
        new = found.join(jump, "node").select("leaf", F.col("far").alias("node"), (F.col("up") + (1 << k)).alias("up"))
        found = scratch.save(found.unionByName(new), "paths")
    return found


def format_paths(messages: DataFrame, best: int = 1) -> DataFrame:
    """tree, leaf, branch_rank, path_score, n_turns, formatted and loss_mask of the best paths of each tree."""
    scratch = Scratch(messages.sparkSession, "chat-paths")
    leaves, jumps = ranked_leaves(messages, scratch, best)
    chosen = paths(leaves, jumps, scratch).join(messages.select("node", "tree", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")), "node").join(leaves, "leaf")
    head = F.concat(F.lit(OPEN), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(SAID))
    body = escape(F.col("text"))
    chosen = chosen.select("tree", "leaf", "branch_rank", "path_score", F.col("up"), (F.col("role") == "assistant").alias("learn"), F.length(head).alias("h"), F.length(body).alias("b"), F.concat(head, body, F.lit(CLOSE)).alias("piece"))
    w = Window.partitionBy("tree", "leaf").orderBy(F.desc("up")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = chosen.withColumn("end", F.sum(F.length("piece")).over(w)).withColumn("start", F.col("end") - F.length("piece") + F.col("h"))
    turns = placed.groupBy("tree", "leaf", "branch_rank", "path_score").agg(
        F.sort_array(F.collect_list(F.struct(F.negative("up").alias("at"), "piece", F.struct("start", (F.col("start") + F.col("b")).alias("end")).alias("range"), "learn"))).alias("turns")
    )
    return turns.select(
        "tree", "leaf", "branch_rank", "path_score",
        F.size("turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("turns", lambda t: t.piece), "").alias("formatted"),
        F.transform(F.filter("turns", lambda t: t.learn), lambda t: t["range"]).alias("loss_mask"),
    )


def read_turns(formatted: Column) -> Column:
    """(role, text) of each turn of a formatted text."""
    pieces = F.filter(F.split(formatted, "(?<=</turn>\n)"), lambda p: p != "")

    def turn(p: Column) -> Column:
        inner = F.substring(p, F.lit(len(OPEN) + 1), F.length(p) - len(OPEN) - len(CLOSE))
        at = F.instr(inner, SAID)
        role = F.replace(F.substring(inner, F.lit(1), at - 1), F.lit("\\c"), F.lit(":"))
        return F.struct(unescape(role).alias("role"), unescape(F.substring(inner, at + len(SAID), F.length(inner))).alias("text"))

    return F.transform(pieces, turn)


def read_loss(formatted: Column, mask: Column) -> Column:
    """The unescaped text under the loss mask."""
    return F.array_join(F.transform(mask, lambda r: unescape(F.substring(formatted, (r.start + 1).cast("int"), (r.end - r.start).cast("int")))), "")
