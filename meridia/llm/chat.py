"""Chat formatting: reply trees to conversations, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import drop, materialize

#: The template.  A turn is OPEN + role + BREAK + text + CLOSE; texts escape what could be read as control.
OPEN, BREAK, CLOSE = "<|turn|>", "\n", "<|end|>"
#: Strings that other templates use as control.
CONTROL = ("<|turn|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escape(text: Column) -> Column:
    """Put a backslash inside each control string and double backslashes; reversible by ``unescape``."""
    inner = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(inner, r"([<\[])(?=(?:\|turn\|>|\|end\|>|\|im_start\|>|\|im_end\|>|\|endoftext\|>|/?s>|/?INST\]|</?SYS>>))", r"$1\\")


def unescape(text: Column) -> Column:
    """Undo ``escape``."""
    return F.regexp_replace(text, r"\\(\\)|\\", "$1")


def escape_role(role: Column) -> Column:
    """``escape``, and no line break either: it ends the role."""
    return F.regexp_replace(escape(role), "\n", r"\\n")


def unescape_role(role: Column) -> Column:
    """Undo ``escape_role``: a backslash before n that no other one escapes was a line break."""
    return unescape(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"))


def _boxed(*names: str) -> list[Column]:
    """Keys in structs, which are never null, so that a null key joins with itself."""
    return [F.struct(F.col(n).alias("v")).alias(n) for n in names]


def _unboxed(*names: str) -> list[Column]:
    return [F.col(f"{n}.v").alias(n) for n in names]


def reply_paths(messages: DataFrame) -> DataFrame:
    """Root-to-leaf paths of reply trees.

    ``messages``: ``tree``, ``id`` (unique in its tree), ``parent`` (null: a
    root).  Iterative self-joins double the distance to the known ancestor, so
    a path of n messages takes log2(n) rounds.  A message whose parent is missing
    is a root.  Messages on a cycle belong to no path.  A null tree is a tree like
    others, and so is a null id an id, but no reply names it.  Of rows with the
    same tree and id the one with the smallest parent counts (null first).  No
    messages: an empty table.

    Returns a row for each message of each path: ``tree, leaf, id, depth`` (0 for the root).
    """
    parent = F.col("parent").try_cast(messages.schema["id"].dataType)
    messages = messages.select(*_boxed("tree", "id"), F.when(parent.isNotNull(), F.struct(parent.alias("v"))).alias("parent"))
    messages = messages.groupBy("tree", "id").agg(F.min(F.struct("parent")).alias("first")).select("tree", "id", "first.parent")
    known = messages.select("tree", F.col("id").alias("parent"), F.lit(True).alias("there")).distinct()
    nodes = messages.join(known, ["tree", "parent"], "left")
    nodes = nodes.select("tree", "id", F.when(F.col("there"), F.col("parent")).alias("parent"))
    inner = nodes.where("parent is not null").select("tree", F.col("parent").alias("id")).distinct()
    # reach: pairs (leaf, ancestor, distance); hops: each message's ancestor 2**k above
    paths = materialize(nodes.join(inner, ["tree", "id"], "left_anti").select("tree", F.col("id").alias("leaf"), "id", F.lit(0).cast("long").alias("up")))
    hops = materialize(nodes.where("parent is not null").select("tree", "id", F.col("parent").alias("to")))
    span, most = 1, nodes.groupBy("tree").count().agg(F.max("count")).first()[0] or 0
    while span <= most and not hops.isEmpty():
        further = paths.join(hops, ["tree", "id"]).select("tree", "leaf", F.col("to").alias("id"), (F.col("up") + span).alias("up"))
        more = materialize(paths.union(further))
        doubled = materialize(hops.join(hops.select("tree", F.col("id").alias("to"), F.col("to").alias("next")), ["tree", "to"]).select("tree", "id", F.col("next").alias("to")))
        drop(paths)
        drop(hops)
        paths, hops, span = more, doubled, span * 2
    rooted = nodes.where("parent is null").select("tree", "id")
    paths = paths.join(paths.join(rooted, ["tree", "id"]).select("tree", "leaf").distinct(), ["tree", "leaf"], "left_semi")  # none from a cycle
    top = Window.partitionBy("tree", "leaf")
    return paths.select(*_unboxed("tree", "leaf", "id"), (F.max("up").over(top) - F.col("up")).alias("depth"))


def format_conversations(messages: DataFrame, best: int = 1) -> DataFrame:
    """Format the best branches of each reply tree, one conversation each.

    ``messages``: ``tree, id, parent, role, text`` and ``score`` (null: 0).  A
    branch is a root-to-leaf path; branches rank by the sum of their scores,
    then by length (longer first), then by the smaller leaf.  ``best`` branches
    of each tree are kept (null: all).  Null texts and roles are empty.  Messages
    of a null tree are one tree, as SQL groups them; a null id is an id.  Of rows
    with the same tree and id the smallest (parent, role, text, score) counts.
    Roles and texts may hold anything, control strings and line breaks too.  An
    empty table gives an empty one.

    Returns ``tree, leaf, rank, n_turns, formatted`` and ``loss``, the spans
    (start from 0, length, in characters) of assistants' texts in ``formatted``.
    """
    row = F.struct("parent", "role", "text", "score")
    messages = messages.groupBy("tree", "id").agg(F.min(row).alias("row")).select("tree", "id", "row.*")
    paths = reply_paths(messages).select(*_boxed("tree", "leaf", "id"), "depth")
    texts = messages.select(
        *_boxed("tree", "id"), F.coalesce("role", F.lit("")).alias("role"), escape(F.coalesce("text", F.lit(""))).alias("text"), F.coalesce("score", F.lit(0)).cast("double").alias("score")
    )
    scored = paths.join(texts.select("tree", "id", "score"), ["tree", "id"]).groupBy("tree", "leaf").agg(F.sum("score").alias("total"), F.count("*").alias("length"))
    scored = scored.withColumn("rank", F.row_number().over(Window.partitionBy("tree").orderBy(F.desc("total"), F.desc("length"), "leaf")))
    if best is not None:
        scored = scored.where(F.col("rank") <= best)
    turns = paths.join(scored.select("tree", "leaf", "rank"), ["tree", "leaf"]).join(texts, ["tree", "id"])
    name = escape_role(F.col("role"))
    turn = F.concat(F.lit(OPEN), name, F.lit(BREAK), "text", F.lit(CLOSE))
    turns = turns.select("tree", "leaf", "rank", F.struct("depth", "role", turn.alias("turn"), F.char_length(name).alias("name"), F.char_length("text").alias("chars")).alias("t"))
    whole = turns.groupBy("tree", "leaf", "rank").agg(F.array_sort(F.collect_list("t")).alias("t")).withColumn("n_turns", F.size("t").cast("long"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("loss"))
    head = len(OPEN) + len(BREAK)
    step = lambda acc, t: F.struct(
        (acc["at"] + F.char_length(t["turn"])).alias("at"),
        F.when(t["role"] == "assistant", F.array_append(acc["loss"], F.struct((acc["at"] + head + t["name"]).alias("start"), t["chars"].alias("length")))).otherwise(acc["loss"]).alias("loss"),
    )
    return whole.select(*_unboxed("tree", "leaf"), "rank", "n_turns", F.array_join(F.transform("t", lambda t: t["turn"]), "").alias("formatted"), F.aggregate("t", start, step, lambda a: a["loss"]).alias("loss"))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text), unescaped."""
    pieces = F.slice(F.split(formatted, r"<\|turn\|>"), 2, 1 << 30)
    body = lambda p: F.substring(p, F.lit(1), F.char_length(p) - len(CLOSE))
    return F.transform(pieces, lambda p: F.struct(unescape_role(F.substring_index(p, BREAK, 1)).alias("role"), unescape(F.substring(body(p), F.instr(p, BREAK) + 1, F.char_length(p))).alias("text")))
