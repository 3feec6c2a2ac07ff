"""The prefix trie of conversations, with subtree totals by leaf-peeling messages.

A node is a distinct sequence of first turns. Its name is the depth and two XORs
of hashes of (position, turn), so a node's parent is named without looking at it
(take the last turn's hash out), and sums of prefixes need no long chain: XORs of
blocks of turns are put together. Totals go from the leaves up in rounds: nodes
count the children that have not reported yet; a node without any is complete and
sends its totals to its parent. A conversation that shares nothing below some node
is a path: its nodes are complete from the start. What is still deep after a few
rounds is shortened by pointer jumping along nodes with one open child, so even a
very long shared conversation takes a logarithmic number of rounds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from netloom.llm import common

#: Turns of a conversation whose hashes one window puts together.
BLOCK = 1 << 16
#: Rounds that only peel leaves; later ones also shorten chains.
PLAIN_ROUNDS = 6
#: The query's rebuilding: conversations of one group share a head of fewer than MOST turns.
GROUP, MOST = 20, 4

NODE = ["depth", "a", "b"]
PARENT = ["up", "up_a", "up_b"]


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, length, digest, words): the turns in order from 0, with their conversation's number of turns.

    A null turn comes first; equal turns go by the digest of role and text; a null
    role or text is empty. Turns without a conv_id belong to no conversation and go.
    Range partitions hold any part of a conversation, so a hot one is spread too.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text).cast("binary")))
    rows = turns.filter(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), digest.alias("digest"), F.size(common.words_of(text)).cast("long").alias("words"), F.monotonically_increasing_id().alias("row")
    )
    # Equal rows may change places, so the row number only spreads them.
    order = [F.col("conv_id").asc(), F.col("turn").asc_nulls_first(), F.col("digest").asc(), F.col("row").asc()]
    rows = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "digest", "words", F.monotonically_increasing_id().alias("place"))
    rows = common.materialize(rows, "turns").withColumn("part", F.shiftright("place", 33))
    parts = rows.groupBy("conv_id", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    # One row for each conversation and partition that holds some of it.
    own = Window.partitionBy("conv_id").orderBy("part")
    before = F.coalesce(F.sum("n").over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    every = F.sum("n").over(Window.partitionBy("conv_id"))
    parts = parts.select("conv_id", "part", "first", before.alias("before"), every.alias("length"))
    rows = rows.join(parts, ["conv_id", "part"])
    return common.materialize(rows.select("conv_id", (F.col("place") - F.col("first") + F.col("before")).alias("pos"), "length", "digest", "words"), "numbered")


def branched(rows: DataFrame, group: int = GROUP, most: int = MOST) -> tuple[DataFrame, DataFrame]:
    """The query's rebuilt conversations: (turns, conversations) as ``prefix_trie`` takes them.

    Conversation c begins with the first h turns of conversation c - c % group (all
    if it has fewer, none if there is none), h = crc32(c) % most; its own turns
    behind its first h follow.
    """
    h = lambda c: F.pmod(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(most))
    base = F.col("conv_id") - F.col("conv_id") % group
    turn = F.struct("pos", "digest", "words")
    heads = rows.filter((base == F.col("conv_id")) & (F.col("pos") < most - 1)).groupBy(F.col("conv_id").alias("base")).agg(F.sort_array(F.collect_list(turn)).alias("head"))
    convs = rows.filter("pos = 0").select("conv_id", "length", base.alias("base"), h("conv_id").alias("h")).join(heads, "base", "left")
    convs = convs.withColumn("head", F.slice(F.coalesce("head", F.array().cast("array<struct<pos: bigint, digest: binary, words: bigint>>")), F.lit(1), F.col("h").cast("int")))
    convs = convs.select("conv_id", "h", "length", "head", (F.size("head") + F.greatest(F.col("length") - F.col("h"), F.lit(0))).cast("long").alias("rebuilt"))
    convs = common.materialize(convs, "conversations")
    taken = convs.select("conv_id", "rebuilt", F.explode("head").alias("t")).select("conv_id", F.col("t.pos").alias("pos"), F.col("rebuilt").alias("length"), "t.digest", "t.words")
    # A head shorter than h moves the turns behind it up; most conversations have a whole one.
    moved = convs.filter((F.size("head") < F.col("h")) & (F.col("length") > F.col("h"))).select("conv_id", (F.size("head") - F.col("h")).alias("by"))
    own = rows.filter(F.col("pos") >= h("conv_id")).join(common.maybe_broadcast(common.materialize(moved, "moved")), "conv_id", "left").withColumn("by", F.coalesce("by", F.lit(0)))
    own = own.select("conv_id", (F.col("pos") + F.col("by")).alias("pos"), F.col("length"), "digest", "words", "by")
    # As many turns are missing behind as in front, unless the head is shorter.
    own = own.select("conv_id", "pos", (F.col("length") + F.col("by")).alias("length"), "digest", "words")
    return taken.unionByName(own), convs.select("conv_id", F.col("rebuilt").alias("length"))


def _prefixes(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, up, up_a, up_b, words, last): the path of nodes of each conversation, its root included."""
    term = lambda seed: F.xxhash64(F.lit(seed), F.col("pos"), F.col("digest"))
    rows = rows.withColumns({"block": F.floor(F.col("pos") / BLOCK), "own_a": term("first"), "own_b": term("second")})
    window = Window.partitionBy("conv_id", "block").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = rows.select("conv_id", "pos", "block", "length", "words", "own_a", "own_b", F.expr("bit_xor(own_a)").over(window).alias("in_a"), F.expr("bit_xor(own_b)").over(window).alias("in_b"))
    # What stands before a later block; few conversations have any.
    blocks = rows.filter(F.col("length") > BLOCK).groupBy("conv_id", "block").agg(F.expr("bit_xor(own_a)").alias("x"), F.expr("bit_xor(own_b)").alias("y"))
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("conv_id", "block", F.expr("bit_xor(x)").over(before).alias("x"), F.expr("bit_xor(y)").over(before).alias("y")).filter("block > 0")
    blocks = common.maybe_broadcast(common.materialize(blocks, "blocks"))
    sums = sums.join(blocks, ["conv_id", "block"], "left")
    a, b = F.col("in_a").bitwiseXOR(F.coalesce("x", F.lit(0))), F.col("in_b").bitwiseXOR(F.coalesce("y", F.lit(0)))
    nodes = sums.select(
        "conv_id", (F.col("pos") + 1).alias("depth"), a.alias("a"), b.alias("b"), F.col("pos").alias("up"), a.bitwiseXOR(F.col("own_a")).alias("up_a"), b.bitwiseXOR(F.col("own_b")).alias("up_b"),
        "words", (F.col("pos") + 1 == F.col("length")).alias("last"),
    )
    zero, none = F.lit(0).cast("long"), F.lit(None).cast("long")
    root = convs.select("conv_id", zero.alias("depth"), zero.alias("a"), zero.alias("b"), none.alias("up"), none.alias("up_a"), none.alias("up_b"), zero.alias("words"), (F.col("length") == 0).alias("last"))
    return common.materialize(nodes.unionByName(root), "prefixes")


def _peel(open_: DataFrame, plain: int) -> DataFrame:
    """(depth, a, b, leaves, saved): the totals of all nodes of ``open_``.

    open_: NODE, PARENT, remaining (children in ``open_``), leaves, saved (what the
    node has and has been told so far).
    """
    state = open_.select(*NODE, *PARENT, "remaining", "leaves", "saved", F.lit(0).cast("long").alias("on_leaves"), F.lit(0).cast("long").alias("on_saved"))
    done, waiting, number = [], [], 0
    while True:
        number += 1
        full = state.filter("remaining = 0")
        done.append(full.select(*NODE, "leaves", "saved"))
        rest = state.filter("remaining > 0")
        # What a complete node tells its parent: its own totals, and those of a shortened chain above it.
        told = full.groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("leaves") + F.col("on_leaves")).alias("l"), F.sum(F.col("saved") + F.col("on_saved")).alias("s"))
        told = told.toDF(*NODE, "n", "l", "s")
        zero = F.lit(0)
        state = rest.join(told, NODE, "left").select(
            *NODE, *PARENT, (F.col("remaining") - F.coalesce("n", zero)).alias("remaining"), (F.col("leaves") + F.coalesce("l", zero)).alias("leaves"), (F.col("saved") + F.coalesce("s", zero)).alias("saved"), "on_leaves", "on_saved",
        )
        state = common.materialize(state, "open")
        if state.isEmpty():
            break
        if number > plain:
            state, chains = _shorten(state)
            waiting.append(chains)
    totals = done[0]
    for x in done[1:]:
        totals = totals.unionByName(x)
    # Nodes of chains know their totals from the node at the chain's lower end; those shortened last first.
    for chains in reversed(waiting):
        ends = totals.toDF("to", "to_a", "to_b", "l", "s")
        found = chains.join(ends, ["to", "to_a", "to_b"]).select(*NODE, (F.col("leaves") + F.col("l")).alias("leaves"), (F.col("saved") + F.col("s")).alias("saved"))
        totals = common.materialize(totals.unionByName(found), "totals")
    return totals


def _shorten(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(state, chains): open nodes with one open child leave the state and wait for the first node below that has none or several.

    chains: NODE, (to, to_a, to_b) that node, and the chain's own leaves and saved.
    The node at the lower end gets the parent of the chain's top, and what the
    chain adds to its message.
    """
    to = ["to", "to_a", "to_b"]
    single = F.col("remaining") == 1
    below = state.select(F.col("up").alias("depth"), F.col("up_a").alias("a"), F.col("up_b").alias("b"), F.col("depth").alias("to"), F.col("a").alias("to_a"), F.col("b").alias("to_b"), F.col("on_leaves").alias("l"), F.col("on_saved").alias("s"))
    # An edge that was shortened before carries what its chain adds.
    chains = state.filter(single).select(*NODE, "leaves", "saved").join(below, NODE).select(*NODE, *to, (F.col("leaves") + F.col("l")).alias("leaves"), (F.col("saved") + F.col("s")).alias("saved"))
    chains = common.materialize(chains, "chains")
    while True:
        on = chains.toDF(*to, "next", "next_a", "next_b", "l", "s")
        step = chains.join(on, to, "left").select(
            *NODE, F.coalesce("next", "to").alias("to"), F.coalesce("next_a", "to_a").alias("to_a"), F.coalesce("next_b", "to_b").alias("to_b"),
            (F.col("leaves") + F.coalesce("l", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("s", F.lit(0))).alias("saved"), F.col("next").isNotNull().alias("went"),
        )
        step = common.materialize(step, "chains")
        chains = step.drop("went")
        if step.filter("went").isEmpty():
            break
    # The tops: chain nodes whose parent is not in a chain itself.
    above = state.filter(single).select(*[F.col(c).alias(p) for c, p in zip(NODE, PARENT, strict=True)])
    singles = state.filter(single).select(*NODE, *PARENT, "on_leaves", "on_saved")
    tops = singles.join(above, PARENT, "left_anti")
    tops = tops.join(chains, NODE).select(*to, *[F.col(p).alias(f"new_{p}") for p in PARENT], (F.col("leaves") + F.col("on_leaves")).alias("l"), (F.col("saved") + F.col("on_saved")).alias("s"))
    tops = tops.toDF(*NODE, *[f"new_{p}" for p in PARENT], "l", "s").withColumn("topped", F.lit(True))
    left = state.filter(~single).join(tops, NODE, "left")
    pick = lambda new, old: F.when(F.col("topped"), F.col(new)).otherwise(F.col(old)).alias(old)
    left = left.select(*NODE, *[pick(f"new_{p}", p) for p in PARENT], "remaining", "leaves", "saved", pick("l", "on_leaves"), pick("s", "on_saved"))
    return common.materialize(left, "open"), chains


def prefix_trie(rows: DataFrame, convs: DataFrame, plain_rounds: int = PLAIN_ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(nodes, ends) of conversations.

    rows: (conv_id, pos, length, digest, words), pos from 0 without gaps; convs:
    (conv_id, length), also those without turns. nodes: NODE names each, then
    conv_id (the smallest member), parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (over the subtree: words of a node's last turn times members less
    one), n_ends. ends: (NODE, conv_id), the node at which a conversation ends. No
    conversations: no nodes, not even the root.
    """
    paths = _prefixes(rows, convs)
    nodes = paths.groupBy(*NODE).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), *[F.min(c).alias(c) for c in PARENT], F.min("words").alias("words"), F.sum(F.col("last").cast("long")).alias("n_ends"),
    )
    nodes = common.materialize(nodes, "nodes")
    # Nodes of one conversation below which there is nothing else are complete: one leaf, nothing saved. The others are open.
    shared = (F.col("n_convs") > 1) | (F.col("depth") == 0)
    open_ = common.materialize(nodes.filter(shared), "shared")
    ids = open_.select(*[F.col(c).alias(p) for c, p in zip(NODE, PARENT, strict=True)], F.col("conv_id").alias("parent_conv_id"))
    known = common.maybe_broadcast(common.materialize(ids, "parents"))
    linked = nodes.join(known, PARENT, "left")
    told = linked.filter(F.col("parent_conv_id").isNotNull()).groupBy(*PARENT).agg(F.count(F.lit(1)).alias("n_children"), F.sum(shared.cast("long")).alias("remaining"), F.sum((~shared).cast("long")).alias("leaves"))
    told = told.toDF(*NODE, "n_children", "remaining", "leaves")
    counted = open_.join(told, NODE, "left").select(
        *NODE, *PARENT, F.coalesce("n_children", F.lit(0)).alias("n_children"), F.coalesce("remaining", F.lit(0)).alias("remaining"),
        F.when(F.col("n_children").isNull(), F.lit(1)).otherwise(F.col("leaves")).cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"),
    )
    counted = common.materialize(counted, "counted")
    totals = counted.select(*NODE, "n_children").join(_peel(counted, plain_rounds), NODE)
    totals = common.maybe_broadcast(common.materialize(totals, "totals"))
    alone = F.col("leaves").isNull()
    result = linked.join(totals, NODE, "left").select(
        *NODE, "conv_id", F.when(F.col("depth") > 0, F.coalesce("parent_conv_id", "conv_id")).alias("parent_conv_id"), "n_convs",
        F.when(alone, 1 - F.col("n_ends")).otherwise(F.col("n_children")).cast("long").alias("n_children"),
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"), F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"), "n_ends",
    )
    return result, paths.filter("last").select(*NODE, "conv_id")


def ends_digest(ends: DataFrame) -> DataFrame:
    """(NODE, ends_sha256): the SHA-256 of a node's conversations that end there, ascending and comma-joined.

    Ids are sorted and joined in pieces by range, whatever the node; a node's
    digest then reads its pieces one after another, as a SHA-256 must.
    """
    order = [*NODE, "conv_id"]

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            rows = list(zip(*(c.to_pylist() for c in batch.columns), strict=True))
            cuts = [0, *(i for i in range(1, len(rows)) if rows[i][:3] != rows[i - 1][:3]), len(rows)]
            out = [(*rows[i], ",".join(str(r[3]) for r in rows[i:j])) for i, j in zip(cuts, cuts[1:], strict=False)]
            yield pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in out], pa.int64()) for k in range(4)), pa.array([r[4] for r in out])], [*NODE, "first", "ids"])

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, None
        for batch in batches:
            out = []
            for *own, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != node:
                    if node:
                        out.append((*node, sha.hexdigest()))
                    node, sha = own, hashlib.sha256(ids.encode())
                else:
                    sha.update(b"," + ids.encode())
            yield _digests(out)
        yield _digests([(*node, sha.hexdigest())] if node else [])

    pieces = ends.select(*order).repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(join, "depth long, a long, b long, first long, ids string")
    pieces = common.materialize(pieces, "ends")
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "first").mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")


def _digests(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*(pa.array([r[k] for r in rows], pa.int64()) for k in range(3)), pa.array([r[3] for r in rows], pa.string())], [*NODE, "ends_sha256"])


def report(turns: DataFrame) -> DataFrame:
    """A row for each node of the rebuilt conversations' trie: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    Other columns than conv_id, turn, role and text are not read; repeated rows are
    turns of their own. See ``numbered``, ``branched`` and ``prefix_trie``.
    """
    nodes, ends = prefix_trie(*branched(numbered(turns)))
    nodes = common.materialize(nodes, "trie")
    crowded = common.maybe_broadcast(common.materialize(nodes.filter((F.col("n_convs") > 1) & (F.col("n_ends") > 0)).select(*NODE), "crowded"))
    digests = common.materialize(ends_digest(ends.join(crowded, NODE, "left_semi")), "digests")
    nobody, alone = F.col("n_ends") == 0, common.sha256_hex(F.col("conv_id").cast("string"))
    sha = F.when(nobody, common.sha256_hex(F.lit(""))).otherwise(F.coalesce("ends_sha256", alone))
    out = nodes.join(common.maybe_broadcast(digests), NODE, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", sha.alias("ends_sha256"))
