"""Chat formatting over reply trees, in DataFrame operations only.

`paths` enumerates root-to-leaf paths by self-joins whose reach doubles: after k joins each message
knows its ancestor 2**k steps up and the score gathered on the way, so a thread of d messages takes
log2(d) joins and not d. Branches (leaves) are ranked by the score of their whole path. Only the
messages of the chosen branches are then spelled out, by the same jumps from the leaf downwards in
step size; each chosen path is formatted as one conversation.

Template: each message is `<s>[INST] role [/INST] text</s>`. Control strings inside roles and texts get
a backslash after their first character (one more, if they have some), which `unescape` takes away, so
that formatting is reversible. The loss mask is the texts of the roles that are learnt.

Defined cases: a null role or text is an empty one; a message whose parent is null or not there is a
root; ties of score go to the smaller leaf id; messages on a cycle have no root and raise an error;
repeated messages stay, each in its place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .frames import stored

OPEN, MIDDLE, MARK, CLOSE = "<s>", "[INST] ", " [/INST] ", "</s>"
_CONTROL = r"(/?s>|/?INST\])"


def escape(x: Column) -> Column:
    return F.regexp_replace(x, r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")


def unescape(x: Column) -> Column:
    return F.regexp_replace(x, r"([<\[])\\(\\*)" + _CONTROL, r"$1$2$3")


def message(role: Column, text: Column) -> Column:
    return F.concat(F.lit(OPEN + MIDDLE), escape(role), F.lit(MARK), escape(text), F.lit(CLOSE))


def parse(formatted: Column) -> Column:
    """array<struct<role, text>> of a formatted conversation."""
    pattern = r"(?s)<s>\[INST\] (.*?) \[/INST\] (.*?)</s>"
    roles, texts = (F.regexp_extract_all(formatted, F.lit(pattern), F.lit(i)) for i in (1, 2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))


def paths(nodes: DataFrame, top: int | None = 1) -> DataFrame:
    """nodes (tree, id, parent, score) to (tree, leaf, rank, id, depth): the messages of the `top` best branches of each tree (all, if None), depth 0 at the root.

    ids are unique over all trees.
    """
    known = nodes.select("tree", "id", "parent", F.coalesce("score", F.lit(0.0)).cast("double").alias("score"))
    there = known.select(F.col("id").alias("parent"), F.lit(True).alias("there"))
    step = stored(known.join(there, "parent", "left").select("tree", "id", F.when(F.col("there"), F.col("parent")).alias("up"), "score", F.lit(1).cast("long").alias("steps")))
    done, going, jumps = step.where("up is null"), step.where("up is not null"), []
    n = step.count()
    while not going.isEmpty():
        jumps.append(going)
        if 1 << (len(jumps) - 1) > 2 * n:
            raise ValueError("the messages' parents form a cycle")
        above = done.unionAll(going).select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("score").alias("score2"), F.col("steps").alias("steps2"))
        # only what has not met its root yet is joined on
        further = stored(going.join(above, "up").select("tree", "id", F.col("up2").alias("up"), (F.col("score") + F.col("score2")).alias("score"), (F.col("steps") + F.col("steps2")).alias("steps")))
        done, going = done.unionAll(further.where("up is null")), further.where("up is not null")
    step = done
    # now score and steps are of the whole path; leaves are no one's parent
    parents = known.select(F.col("parent").alias("id")).where("id is not null").distinct()
    leaves = step.join(parents, "id", "left_anti")
    best = W.partitionBy("tree").orderBy(F.desc("score"), "id")
    ranked = leaves.withColumn("rank", F.row_number().over(best))
    chosen = ranked if top is None else ranked.where(F.col("rank") <= top)
    found = chosen.select("tree", F.col("id").alias("leaf"), "rank", "id", (F.col("steps") - 1).alias("depth"))
    for k in range(len(jumps) - 1, -1, -1):
        hop = jumps[k].select("id", "up")
        found = stored(found.unionAll(found.join(hop, "id").select("tree", "leaf", "rank", F.col("up").alias("id"), (F.col("depth") - (1 << k)).alias("depth"))))
    return found


def format_paths(chosen: DataFrame, messages: DataFrame, learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(tree, leaf, rank) with `formatted` and `loss_spans`: code points [start, end) of the learnt texts in it."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    rows = chosen.join(messages.select("id", role.alias("role"), text.alias("text")), "id")
    parts = rows.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list(F.struct("depth", message(F.col("role"), F.col("text")).alias("out"), F.char_length(F.concat(F.lit(OPEN + MIDDLE), escape(F.col("role")), F.lit(MARK))).alias("head"), F.col("role").isin(*learnt).alias("learnt")))).alias("parts"))
    spans = F.aggregate(
        "parts",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda a, p: F.struct(
            (a["at"] + F.char_length(p["out"])).alias("at"),
            F.when(p["learnt"], F.array_append(a["spans"], F.struct((a["at"] + p["head"]).alias("start"), (a["at"] + F.char_length(p["out"]) - len(CLOSE)).alias("end")))).otherwise(a["spans"]).alias("spans"),
        ),
        lambda a: a["spans"],
    )
    return parts.select("tree", "leaf", "rank", F.array_join(F.transform("parts", lambda p: p["out"]), "").alias("formatted"), spans.alias("loss_spans"))


def format_conversations(rows: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text), each the reply to the one before it, to conv_id and what `format_paths` returns."""
    order = W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn("place", F.row_number().over(order))
    node = lambda place: F.struct(F.col("conv_id"), place.cast("int").alias("place"))
    named = numbered.select(F.struct("conv_id").alias("tree"), node(F.col("place")).alias("id"), F.when(F.col("place") > 1, node(F.col("place") - 1)).alias("parent"), F.lit(0.0).alias("score"), "role", "text")
    named = stored(named)
    out = format_paths(paths(named, top=1), named)
    return out.select(F.col("tree.conv_id").alias("conv_id"), "formatted", "loss_spans")
