"""A prefix trie of conversations from vertical bitmaps.

Conversations are ranked by id and dealt to shards of SHARD_CONVERSATIONS consecutive ones, and their turns to blocks of
BLOCK_TURNS positions, so that what a task holds is bounded however many conversations there are and however long one is. A
shard indexes each (position, turn) as a bitset of its conversations, a number of as many bits as it has conversations. A
depth-first walk starts with the conversations that share a prefix before the block; the posting of the turn that the lowest
conversation of a node has next, intersected with the node's bitset, is a child: its population count, its least conversation
and the list of those that end there follow from the bits. What is left of the node's bitset gives the next child.

A node's key is its depth and a sum: each turn at its position has a 96-bit number (of the digest of position, role and text),
and a prefix the sum of its turns' numbers, so that a block can begin anywhere with what the blocks before it add up to.
Shards see the same node apart, and their counts, least conversations and lists of ends are put together by key. A list of
ends may be as long as the table: it is hashed as a stream of the shards' parts, in their order.

Sums over subtrees climb by doubling: after round i every node has the sum over its descendants fewer than 2^i levels below,
so a trie of depth d takes log2(d) rounds, each written to the shared folder.

Defined cases: a null conversation id has no conversation; null roles and texts are empty; turns with equal numbers go by
role, by the first 64 characters and by the digest of the text, null numbers first; repeated rows are turns of their own; an
empty table has no node; other columns play no part. Numbers of prefixes are exact for up to 10^9 turns of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from crawlframe.llm.common import save
from crawlframe.operators.sampling import ranked

SHARD_CONVERSATIONS = 1024
BLOCK_TURNS = 64

_NODE = "key string, depth long, parent string, n_convs long, conv_id long, chars long, ends string, shard long"


def turn_rows(conversations: DataFrame) -> DataFrame:
    """``(conv_id, pos, turn_key, chars)``: turns in order, from 1, the texts replaced by a digest and their lengths."""
    role, text = (F.coalesce(conversations[c], F.lit("")) for c in ("role", "text"))
    turns = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"),
        conversations["turn"].alias("turn"),
        F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("turn_key"),
        F.length(text).cast("long").alias("chars"),
        role.alias("role"),
        F.md5(text).alias("text_key"),
        F.substring(text, 1, 64).alias("begins"),
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "begins", "text_key")
    return turns.withColumn("pos", F.row_number().over(order).cast("long")).select("conv_id", "pos", "turn_key", "chars")


def rebuilt(turns: DataFrame, heads: int = 6, every: int = 100) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with the first turns of a common one: ids ``(conv_id)``, and their turns as ``turn_rows``.

    Conversation c takes the first crc32(c) % heads turns of conversation c - c % every, then its own after as many.
    """
    number = F.col("conv_id")
    ids = turns.groupBy("conv_id").agg(F.lit(True).alias("there")).select("conv_id")
    ids = ids.select("conv_id", (number - number % every).alias("base"), F.pmod(F.crc32(number.cast("string").cast("binary")), F.lit(heads)).alias("head"))
    opening = turns.where((number % every == 0) & (F.col("pos") < heads)).select(number.alias("base"), "pos", "turn_key", "chars")
    size = opening.groupBy("base").agg(F.count("*").alias("there"))
    ids = save(ids.join(size, "base", "left").withColumn("taken", F.least("head", F.coalesce("there", F.lit(0)))), "rebuilt")
    first = ids.where("taken > 0").join(opening, "base").where("pos <= taken").select("conv_id", "pos", "turn_key", "chars")
    own = turns.join(ids, "conv_id").where("pos > head").select("conv_id", (F.col("pos") - F.col("head") + F.col("taken")).alias("pos"), "turn_key", "chars")
    return ids.select("conv_id"), first.union(own)


def _number(key: Column) -> Column:
    """The first 96 bits of a digest as a number."""
    half = lambda start: F.conv(F.substring(key, start, 12), 16, 10).cast("decimal(20,0)")
    return (half(1) * F.lit(1 << 48).cast("decimal(16,0)") + half(13)).cast("decimal(38,0)")


def _blocks(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """``(shard, conv_id, block, start, turns)``: a row for each block of a conversation, the first one even if it has no turn."""
    placed = ranked(ids, [F.asc("conv_id")], "rank").select("conv_id", F.floor((F.col("rank") - 1) / SHARD_CONVERSATIONS).alias("shard"))
    number = _number(F.md5(F.concat(F.col("pos").cast("string"), F.lit(":"), "turn_key")))
    rows = turns.select("conv_id", F.floor((F.col("pos") - 1) / BLOCK_TURNS).alias("block"), F.struct("pos", number.cast("string").alias("number"), "chars").alias("turn"), number.alias("number"))
    blocks = rows.groupBy("conv_id", "block").agg(F.array_sort(F.collect_list("turn")).alias("turns"), F.sum("number").cast("decimal(38,0)").alias("sum"))
    of = Window.partitionBy("conv_id").orderBy("block")
    start = F.coalesce(F.sum("sum").over(of.rowsBetween(Window.unboundedPreceding, -1)).cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)"))
    blocks = blocks.withColumns({"start": start.cast("string"), "last": F.lead("block").over(of).isNull()})
    whole = placed.join(blocks.drop("sum"), "conv_id", "left")
    return whole.withColumns({"block": F.coalesce("block", F.lit(0)), "start": F.coalesce("start", F.lit("0")), "last": F.coalesce("last", F.lit(True))})


def shard_nodes(rows: pd.DataFrame, block_turns: int) -> pd.DataFrame:
    """The nodes of one shard in one block of positions: ``rows(shard, conv_id, block, start, last, turns)``."""
    rows = rows.sort_values("conv_id")
    ids = [int(c) for c in rows["conv_id"]]
    shard, first = int(rows["shard"].iloc[0]), int(rows["block"].iloc[0]) * block_turns
    turns = [[(t["number"], t["chars"]) for t in own] if own is not None else [] for own in rows["turns"]]
    starts: dict[str, int] = {}
    postings: dict[tuple[int, str], int] = {}
    chars: dict[tuple[int, str], int] = {}
    ends: dict[int, int] = {}
    for i, (start, last, own) in enumerate(zip(rows["start"], rows["last"], turns, strict=True)):
        bit = 1 << i
        starts[start] = starts.get(start, 0) | bit
        for at, (number, size) in enumerate(own):
            postings[at, number] = postings.get((at, number), 0) | bit
            chars[at, number] = size
        if last:
            ends[len(own)] = ends.get(len(own), 0) | bit

    def listed(bits: int) -> str:
        out = []
        while bits:
            low = bits & -bits
            out.append(str(ids[low.bit_length() - 1]))
            bits ^= low
        return ",".join(out)

    found = []

    def node(members: int, key: int, parent: int | None, at: int, size: int) -> None:
        done = members & ends.get(at, 0)
        least = ids[(members & -members).bit_length() - 1]
        name = f"{first + at}:{key}"
        above = None if parent is None else f"{first + at - 1}:{parent}"
        found.append((name, first + at, above, members.bit_count(), least, size, listed(done) if done else None, shard))

    # Walks of the nodes before the block, which themselves belong to the block before (the root to the first).
    stack = [(members, int(start), 0) for start, members in starts.items()]
    if first == 0:
        for start, members in starts.items():
            node(members, int(start), None, 0, 0)
    while stack:
        members, key, at = stack.pop()
        left = members & ~ends.get(at, 0)
        while left:
            low = (left & -left).bit_length() - 1
            if at >= len(turns[low]):  # goes on in the next block
                left &= ~(1 << low)
                continue
            number = turns[low][at][0]
            child = left & postings[at, number]
            left &= ~child
            sum_ = key + int(number)
            node(child, sum_, key, at + 1, int(chars[at, number]))
            stack.append((child, sum_, at + 1))
    return pd.DataFrame(found, columns=[c.split()[0] for c in _NODE.split(", ")])


def _ends_digest(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``(key, ends)`` sorted by key and shard -> ``(key, ends_sha256)``; a key's parts may be spread over batches."""
    key, digest = None, hashlib.sha256()
    for part in parts:
        out = []
        for own, ends in zip(part["key"], part["ends"], strict=True):
            if own == key:
                digest.update(b",")
            else:
                if key is not None:
                    out.append((key, digest.hexdigest()))
                key, digest = own, hashlib.sha256()
            digest.update(ends.encode())
        yield pd.DataFrame(out, columns=["key", "ends_sha256"])
    if key is not None:
        yield pd.DataFrame([(key, digest.hexdigest())], columns=["key", "ends_sha256"])


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``nodes(key, parent, values)`` -> ``(key, values)`` summed over each node and all below it."""
    state = save(nodes.select("key", F.col("parent").alias("up"), *values), "subtree-0")
    turn = 0
    while state.where("up is not null").limit(1).count():
        turn += 1
        more = state.where("up is not null").groupBy(F.col("up").alias("key")).agg(*[F.sum(v).alias(f"more_{v}") for v in values])
        jump = state.select(F.col("key").alias("up"), F.col("up").alias("further"))
        summed = state.join(more, "key", "left").join(jump, "up", "left")
        state = save(summed.select("key", F.col("further").alias("up"), *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).cast("long").alias(v) for v in values]), f"subtree-{turn}")
    return state.drop("up")


def trie(ids: DataFrame, turns: DataFrame) -> DataFrame:
    """Nodes of the conversations ``ids(conv_id)`` with ``turns(conv_id, pos, turn_key, chars)``.

    ``(key, parent, conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256)``.
    """
    block_turns = BLOCK_TURNS
    parts = _blocks(ids, turns).groupBy("shard", "block").applyInPandas(lambda rows: shard_nodes(rows, block_turns), _NODE)
    parts = save(parts, "shard-nodes")
    nodes = parts.groupBy("key").agg(F.first("depth").alias("depth"), F.first("parent").alias("parent"), F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.first("chars").alias("chars"))
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    nodes = save(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "nodes")
    sums = subtree_sums(nodes.select("key", "parent", (F.col("n_children") == 0).cast("long").alias("n_leaves"), ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens")), ["n_leaves", "saved_tokens"])
    ends = parts.where("ends is not null").select("key", "shard", "ends").repartition("key").sortWithinPartitions("key", "shard")
    ends = ends.select("key", "ends").mapInPandas(_ends_digest, "key string, ends_sha256 string")
    above = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(sums, "key").join(ends, "key", "left").join(above, "parent", "left")
    return found.select("key", "parent", "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))


def report(conversations: DataFrame) -> DataFrame:
    """The trie of the rebuilt conversations, a row for each node."""
    ids, turns = rebuilt(save(turn_rows(conversations), "turns"))
    return trie(ids, turns).drop("key", "parent")
