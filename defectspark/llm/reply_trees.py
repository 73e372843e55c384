"""Chat formatting of reply trees: every chosen root-to-leaf path becomes one conversation.

Paths are enumerated by self-joins that double the reach of every message: after round ``k`` a row
holds the message ``2**k`` steps above it and the sums over the steps between, so a chain of ``n``
messages takes ``log2(n)`` rounds over thin rows. Leaves carry the score of their path; the branches
of a tree are ranked by it, and only chosen leaves are unrolled, again by doubling, into the messages
of their path. Only built-in functions are used.

The template writes a turn as ``### role: text</turn>`` and a line feed. Texts and roles are escaped
so that neither ``###`` nor ``</turn>`` nor, in a role, a colon can come up inside them; every escape
is a backslash and one more character, so reading back is exact.

Defined cases: a null or empty text is an empty turn; a null role is an empty role. A message whose
parent is null or absent is a root. Messages on a cycle have no root, so they are on no path. Rows
that repeat a message's id count once: the smallest row by parent, role, text and score. A row
without an id is dropped, for nothing can reply to it. A null tree id is a tree of its own. A null
score is 0. Ties between branches go to the smaller leaf. An empty table gives no rows. One path is
one row, as one string is its format.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from defectspark.llm.common import store
from defectspark.operators.ranking import Balanced, exact_rank

OPEN, CLOSE = "### ", "</turn>\n"
# Literal replacements, in this order; reading back undoes them.
_ESCAPES = [("\\", "\\\\"), ("##", "#\\#"), ("</turn>", "<\\/turn>")]
_COLON = (":", "\\c")


def _replaced(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for old, new in pairs:
        text = F.replace(text, F.lit(old), F.lit(new))
    return text


def escape(text: Column, role: bool = False) -> Column:
    return _replaced(F.coalesce(text, F.lit("")), _ESCAPES + ([_COLON] if role else []))


def unescape(text: Column) -> Column:
    """Exact inverse of ``escape``; doubled backslashes are set apart first, so that no pair is read across them."""
    parts = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: _replaced(p, [("\\#", "#"), ("\\/", "/"), ("\\c", ":")])), "\\")


def reply_paths(messages: DataFrame, tree: str, node: str, parent: str, role: str, text: str, score: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The messages, one per id, and the leaves with their path's length, mean score and rank in the tree.

    Messages: ``tree`` (a struct, so that null ids are equal), ``node``, ``role``, ``text``, ``up``
    (the parent, null at roots). Leaves: ``tree``, ``leaf``, ``steps``, ``path_score``, ``path_rank``
    from 1, best score first.
    """
    points = F.coalesce(F.col(score).cast("double"), F.lit(0.0)) if score else F.lit(0.0)
    rows = messages.select(
        F.struct(F.col(tree).alias("id")).alias("tree"), F.col(node).alias("node"), F.col(parent).alias("up"),
        F.col(role).alias("role"), F.col(text).alias("text"), F.when(F.isnan(points), 0.0).otherwise(points).alias("score"),
    ).where("node IS NOT NULL")
    first = Window.partitionBy("tree", "node").orderBy("up", "role", "text", "score")
    nodes = store(rows.withColumn("__no", F.row_number().over(first)).where("__no = 1").drop("__no"), "chat-messages")
    known = nodes.select("tree", F.col("node").alias("up"), F.lit(True).alias("known"))
    links = nodes.select("tree", "node", "up", "score").join(known, ["tree", "up"], "left")
    links = links.select("tree", "node", F.when(F.col("known"), F.col("up")).alias("up"), "score")
    # steps and total hold what lies between a message (included) and the message it points to.
    jumps = store(links.select("tree", "node", "up", F.lit(1).cast("long").alias("steps"), F.col("score").alias("total")), "chat-jumps")
    inner = jumps.where("up IS NOT NULL").select("tree", F.col("up").alias("node")).distinct()
    ends = jumps.where("up IS NULL")
    open_rows, reach, count = jumps.where("up IS NOT NULL"), 1, nodes.count()
    stored = jumps
    while reach <= count and not open_rows.isEmpty():
        over = stored.select("tree", F.col("node").alias("up"), F.col("up").alias("next"), F.col("steps").alias("more"), F.col("total").alias("add"))
        moved = open_rows.join(over, ["tree", "up"]).select(
            "tree", "node", F.col("next").alias("up"), (F.col("steps") + F.col("more")).alias("steps"), (F.col("total") + F.col("add")).alias("total")
        )
        stored = store(moved.unionByName(ends), "chat-jumps")
        ends, open_rows, reach = stored.where("up IS NULL"), stored.where("up IS NOT NULL"), 2 * reach
    leaves = ends.join(inner, ["tree", "node"], "left_anti").select("tree", F.col("node").alias("leaf"), "steps", (F.col("total") / F.col("steps")).alias("path_score"))
    # Ranked in pieces of bounded size, also where one tree has most of the leaves and they tie on the score.
    worst, leaves = -F.col("path_score"), store(leaves, "chat-leaves")
    keys = [worst, F.col("leaf")] if isinstance(leaves.schema["leaf"].dataType, NumericType) else [worst]
    return nodes, exact_rank(leaves, ["tree"], [worst, F.col("leaf")], Balanced(*keys), "path_rank")


def path_messages(nodes: DataFrame, leaves: DataFrame) -> DataFrame:
    """(``tree``, ``leaf``, ``path_rank``, ``path_score``, ``place`` from 0, ``node``): every message of the given leaves' paths.

    Round ``k`` adds to each known message of a path the one ``2**k`` steps above it.
    """
    jumps = nodes.select("tree", "node", "up")
    found = leaves.select("tree", "leaf", "path_rank", "path_score", "steps", (F.col("steps") - 1).alias("place"), F.col("leaf").alias("node"))
    found = store(found, "chat-paths")
    reach, longest = 1, found.agg(F.max("steps")).first()[0] or 0
    while reach < longest:
        above = jumps.where("up IS NOT NULL")
        higher = found.where(F.col("place") >= reach).join(above, ["tree", "node"]).select(
            "tree", "leaf", "path_rank", "path_score", "steps", (F.col("place") - reach).alias("place"), F.col("up").alias("node")
        )
        found = store(found.unionByName(higher), "chat-paths")
        reach *= 2
        if reach < longest:
            over = above.select("tree", F.col("node").alias("up"), F.col("up").alias("next"))
            jumps = store(above.join(over, ["tree", "up"]).select("tree", "node", F.col("next").alias("up")), "chat-reach")
    return found


def format_paths(messages: DataFrame, tree: str, node: str, parent: str, role: str, text: str, score: str | None = None, best: int | None = None, learn: str = "assistant") -> DataFrame:
    """One conversation per chosen path: the ``best`` branches of each tree, or all.

    Returns ``tree``, ``path_rank``, ``path_score``, ``formatted`` and ``turns``, which has for every
    turn ``start`` and ``end`` of its escaped text in ``formatted`` (code points, end exclusive) and
    ``loss``. Only texts of the role ``learn`` are under the loss, and a message that several chosen
    paths share is under it in the best-ranked of them only, so nothing is learned twice.
    """
    nodes, leaves = reply_paths(messages, tree, node, parent, role, text, score)
    chosen = leaves if best is None else leaves.where(F.col("path_rank") <= best)
    members = path_messages(nodes, chosen)
    firsts = members.groupBy("tree", "node").agg(F.min("path_rank").alias("__first"))
    said = nodes.select("tree", "node", "role", "text").join(firsts, ["tree", "node"])
    turns = members.join(said, ["tree", "node"])
    head = F.concat(F.lit(OPEN), escape(F.col("role"), role=True), F.lit(": "))
    turns = turns.select("tree", "leaf", "path_rank", "path_score", "place", head.alias("head"), escape(F.col("text")).alias("body"), ((F.col("path_rank") == F.col("__first")) & F.coalesce(F.col("role") == learn, F.lit(False))).alias("loss"))
    size = F.char_length("head") + F.char_length("body") + len(CLOSE)
    before = Window.partitionBy("tree", "leaf").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(size).over(before), F.lit(0)) + F.char_length("head")
    turns = turns.withColumn("start", start.cast("long")).withColumn("end", F.col("start") + F.char_length("body"))
    whole = turns.groupBy("tree", "leaf", "path_rank", "path_score").agg(
        F.sort_array(F.collect_list(F.struct("place", "head", "body", "start", "end", "loss"))).alias("__turns")
    )
    return whole.select(
        F.col("tree.id").alias(tree), "path_rank", "path_score",
        F.array_join(F.transform("__turns", lambda t: F.concat(t["head"], t["body"], F.lit(CLOSE))), "").alias("formatted"),
        F.transform("__turns", lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end"), t["loss"].alias("loss"))).alias("turns"),
    )


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation as an array of ``role`` and ``text``, unescaped."""
    turns = F.filter(F.split(formatted, CLOSE, -1), lambda t: t != "")
    header = lambda t: F.substring_index(t, ": ", 1)
    return F.transform(
        turns,
        lambda t: F.struct(
            unescape(F.substring(header(t), F.lit(len(OPEN) + 1), F.char_length(t))).alias("role"),
            unescape(F.substring(t, F.char_length(header(t)) + 3, F.char_length(t))).alias("text"),
        ),
    )


def learned_text(formatted: Column, turns: Column) -> Column:
    """All text under the loss mask, unescaped, in order, read from the formatted string."""
    pairs = F.arrays_zip(read_back(formatted).alias("said"), turns.alias("spot"))
    return F.array_join(F.transform(F.filter(pairs, lambda p: p["spot"]["loss"]), lambda p: p["said"]["text"]), "")


def thread_messages(rows: DataFrame, tree: str, turn: str, role: str, text: str) -> DataFrame:
    """Linear threads as trees: adds ``node`` (from 1, in the order of turn, role and text) and its ``parent``, the turn before it."""
    order = Window.partitionBy(tree).orderBy(turn, role, text)
    return rows.withColumn("node", F.row_number().over(order).cast("long")).withColumn("parent", F.when(F.col("node") > 1, F.col("node") - 1))
