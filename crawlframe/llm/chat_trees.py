"""Chat formatting: root-to-leaf paths of reply trees, ranked by score, each formatted as one conversation.

Paths come from iterative self-joins with doubling: the k-th table jumps 2^k messages up, so a tree of depth d takes
log2(d) joins to build the jumps and as many to list every path. A template marks the turns:

    ### role: text </turn>

Roles are percent-encoded and ``\\``, ``#`` and ``<`` in texts are escaped by a backslash, so no text can hold a mark and
reading back gives what was written. The loss mask lists the spans of assistant texts, as code points of the formatted text.

A conversation's paths are listed and formatted by its key, so one conversation must fit a task; it is one text in the end.

Defined cases: a null text or role is empty; all messages with a null conversation id are one conversation, whatever other
ids there are; a parent that is not there makes a
message a root; messages whose parents run in a circle are left out; paths with equal scores rank by the leaf's id; a null
score counts 0; an empty table gives no rows; other columns are ignored. Message ids must be unique in a conversation;
``by_turn`` numbers the rows, so repeated rows become turns of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.llm.common import save

START, MIDDLE, END = "### ", ": ", " </turn>\n"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\#<])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def conversation() -> Column:
    """A key that tells a null id from every other."""
    return F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("null"))


def by_turn(rows: DataFrame) -> DataFrame:
    """Rows ``(conv_id, turn, role, text)`` as trees without branches: each turn replies to the one before."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    numbered = rows.select("conv_id", "turn", "role", "text").withColumn("id", F.row_number().over(order).cast("long"))
    return numbered.select("conv_id", "id", F.when(F.col("id") > 1, F.col("id") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score"))


def paths(messages: DataFrame) -> DataFrame:
    """``(conv, leaf, id, up)``: the messages of every root-to-leaf path, up steps above its leaf."""
    nodes = save(messages.select(conversation().alias("conv"), "id", "parent"), "nodes")
    longest = nodes.groupBy("conv").count().agg(F.max("count")).first()[0] or 0
    known = nodes.select("conv", F.col("id").alias("parent"))
    jump = nodes.join(known, ["conv", "parent"]).select("conv", "id", F.col("parent").alias("to"))
    jumps = [save(jump, "jump-0")]
    while 2 ** len(jumps) < longest:
        on = jumps[-1].select("conv", F.col("id").alias("to"), F.col("to").alias("further"))
        jumps.append(save(jumps[-1].join(on, ["conv", "to"]).select("conv", "id", F.col("further").alias("to")), f"jump-{len(jumps)}"))
    leaves = nodes.join(jumps[0].select("conv", F.col("to").alias("id")).distinct(), ["conv", "id"], "left_anti")
    found = leaves.select("conv", F.col("id").alias("leaf"), "id", F.lit(0).alias("up"))
    for k in range(len(jumps) - 1, -1, -1):
        higher = found.join(jumps[k], ["conv", "id"]).select("conv", "leaf", F.col("to").alias("id"), (F.col("up") + 2**k).alias("up"))
        found = save(found.unionAll(higher), f"paths-{k}")
    roots = nodes.join(jumps[0], ["conv", "id"], "left_anti").select("conv", "id")
    ended = found.join(roots, ["conv", "id"], "left_semi").select("conv", "leaf").distinct()
    return found.join(ended, ["conv", "leaf"], "left_semi")


def format_branches(messages: DataFrame, branches: int | None = 1) -> DataFrame:
    """``messages(conv_id, id, parent, role, text, score)`` -> ``(conv_id, leaf, rank, path_score, formatted, loss)``.

    The best branches of each conversation by the sum of their messages' scores; all if branches is None.
    """
    messages = save(messages, "messages")
    keyed = messages.select(conversation().alias("conv"), "conv_id", "id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("score", F.lit(0.0)).alias("score"))
    steps = paths(messages).join(keyed.select("conv", "id", "score"), ["conv", "id"])
    ranks = steps.groupBy("conv", "leaf").agg(F.sum("score").alias("path_score"))
    ranks = ranks.withColumn("rank", F.row_number().over(Window.partitionBy("conv").orderBy(F.desc("path_score"), "leaf")))
    if branches is not None:
        ranks = ranks.where(F.col("rank") <= branches)
    chosen = steps.drop("score").join(ranks, ["conv", "leaf"]).join(keyed.drop("score"), ["conv", "id"])
    turn = F.struct((-F.col("up")).alias("at"), F.concat(F.lit(START), F.url_encode("role"), F.lit(MIDDLE)).alias("head"), escape(F.col("text")).alias("body"), (F.col("role") == LOSS_ROLE).alias("loss"))
    one = chosen.groupBy("conv", "leaf").agg(F.first("conv_id").alias("conv_id"), F.first("rank").alias("rank"), F.first("path_score").alias("path_score"), F.array_sort(F.collect_list(turn)).alias("turns"))
    formatted = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))))
    spans = F.aggregate(
        "turns",
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans")),
        lambda s, t: F.struct(
            (s["at"] + F.length(t["head"]) + F.length(t["body"]) + len(END)).alias("at"),
            F.when(t["loss"], F.array_append(s["spans"], F.struct((s["at"] + F.length(t["head"])).alias("start"), (s["at"] + F.length(t["head"]) + F.length(t["body"])).alias("end")))).otherwise(s["spans"]).alias("spans"),
        ),
    )
    return one.select("conv_id", "leaf", "rank", "path_score", formatted.alias("formatted"), spans["spans"].alias("loss"))


def read_turns(formatted: Column) -> Column:
    """Array of (role, text), read back from a formatted text."""
    pieces = F.filter(F.split(formatted, END), lambda p: p != "")
    return F.transform(
        pieces,
        lambda p: F.struct(
            F.url_decode(p.substr(F.lit(len(START) + 1), F.instr(p, MIDDLE) - len(START) - 1)).alias("role"),
            unescape(p.substr(F.instr(p, MIDDLE) + len(MIDDLE), F.length(p))).alias("text"),
        ),
    )


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, joined."""
    return F.concat_ws("", F.transform(loss, lambda s: unescape(formatted.substr(s["start"] + 1, s["end"] - s["start"]))))


def report(rows: DataFrame) -> DataFrame:
    """``(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars)``, read back from the output."""
    out = save(format_branches(by_turn(rows)), "formatted")
    turns = read_turns(F.col("formatted"))
    out = out.select("conv_id", "formatted", turns.alias("turns"), read_loss(F.col("formatted"), F.col("loss")).alias("under_loss"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))), 256).alias("turns_sha256"),
        F.length("under_loss").cast("long").alias("loss_chars"),
        F.sha2("under_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
