"""The prefix trie of conversations: which openings are shared, by how many, and what storing them once would save.

A burst trie. A container holds the suffixes of the conversations below one trie head; at first all hang below the root.
A container of more turns than the bound bursts: the next turns of its suffixes become heads with containers of
their own, one level at first and twice as many in every later round, so the rounds are as many as the depth has
bits. What is left are containers of bounded size: each is sorted by its turn ids and swept once with a stack, which
yields its nodes. Rows of the shards' tables are single turns: no conversation, head or group of copies is ever gathered whole,
but for a container within its bound.

A turn id is a 128-bit hash of role and text; a head is known by the exclusive or of the ids of its turns, each hashed
with its place. Nodes above the containers are grouped by that key; their subtree sums come from the smallest member of
each node, whose path holds all nodes above it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.order import row_numbers, running_sums, running_xors
from ..operators.skew import join_skewed
from ..session import settle

# Turns that a container may hold: the bound of what one task sorts at once.
CONTAINER = 4096
NODE = ("depth long, conv_id long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
        "ends_sha256 string")
HEAD = "struct<d:long,ka:long,kb:long>"


def number_turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, a, b, size): every turn with its place from 1, its id and the code points of its text.

    Null turns come first; turns of one number are ordered by their ids. Null roles and texts are empty. Repeated rows are
    turns of their own. Rows without a conversation id belong to no conversation and are left out.
    """
    said, by = F.coalesce(F.col(text), F.lit("")), F.coalesce(F.col(role), F.lit(""))
    turns = conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("conv"), F.col(turn).alias("_turn"),
        F.xxhash64(F.lit(1), by, said).alias("a"), F.xxhash64(F.lit(2), by, said).alias("b"),
        F.length(said).cast("long").alias("size"))
    placed = turns.select("conv", F.struct("_turn", "a", "b").alias("_order"), "a", "b", "size")
    return row_numbers(placed, ["conv"], "_order", "pos").select("conv", F.col("pos").cast("long").alias("pos"), "a", "b", "size")


def lengths(turns: DataFrame) -> DataFrame:
    """(conv, n): the number of turns of every conversation."""
    return turns.groupBy("conv").agg(F.count(F.lit(1)).alias("n"))


def reopened(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations with a shared opening: turns and lengths, from a written table of turns.

    Conversation c begins with the first h turns of conversation c - c % 100, or as many as that has, and goes on with its own
    turns after its first h; h is the checksum of c modulo 6. Conversations without any turn remain, with length 0.
    """
    own = lengths(turns).withColumns({
        "h": F.pmod(F.crc32(F.col("conv").cast("string").cast("binary")), F.lit(6)),
        "base": F.col("conv") - F.col("conv") % 100})
    base = own.select(F.col("conv").alias("base"), F.col("n").alias("n_base"))
    convs = settle(own.join(base, "base", "left").select(
        "conv", "h", "base", F.least("h", F.coalesce("n_base", F.lit(0))).alias("lent"), F.greatest(F.col("n") - F.col("h"), F.lit(0)).alias("kept")))
    first = turns.where("pos <= 5").withColumnRenamed("conv", "base")
    lent = convs.join(first, "base").where("pos <= h").select("conv", "pos", "a", "b", "size")
    rest = join_skewed(turns, convs.select("conv", "h", "lent"), "conv", F.col("pos")).where("pos > h").select(
        "conv", (F.col("pos") - F.col("h") + F.col("lent")).alias("pos"), "a", "b", "size")
    return lent.unionByName(rest), convs.select("conv", (F.col("lent") + F.col("kept")).alias("n"))


def _keyed(turns: DataFrame) -> DataFrame:
    """(conv, d, a, b, size, ka, kb, pa, pb): each turn with the key of its node and of the node above."""
    own = turns.withColumns({"xa": F.xxhash64("a", "b", "pos", F.lit(1)), "xb": F.xxhash64("a", "b", "pos", F.lit(2))})
    keys = running_xors(own, ["conv"], "pos", {"ka": "xa", "kb": "xb"})
    return keys.select("conv", F.col("pos").alias("d"), "a", "b", "size", "ka", "kb",
                       F.col("ka").bitwiseXOR(F.col("xa")).alias("pa"), F.col("kb").bitwiseXOR(F.col("xb")).alias("pb"))


def _key(d: str | int, a: str, b: str) -> Column:
    depth = F.col(d) if isinstance(d, str) else F.lit(d)
    return F.struct(depth.cast("long").alias("d"), F.col(a).alias("ka"), F.col(b).alias("kb"))


def burst(keyed: DataFrame, sizes: DataFrame, bound: int) -> DataFrame:
    """(conv, n, head): the head below which each conversation's suffix stays; written tables in and out."""
    root = F.struct(F.lit(0).cast("long").alias("d"), F.lit(0).cast("long").alias("ka"), F.lit(0).cast("long").alias("kb"))
    held, step = settle(sizes.select("conv", "n", root.alias("head"))), 1
    while True:
        load = F.sum(F.col("n") - F.col("head.d"))
        over = settle(held.groupBy("head").agg(load.alias("load")).where(F.col("load") > bound))
        if over.isEmpty():
            return held
        marked = join_skewed(held, over, "head", F.col("conv"), "left")
        goes = F.col("load").isNotNull() & (F.col("n") > F.col("head.d"))
        moved = marked.where(goes).select("conv", "n", F.least(F.col("head.d") + step, F.col("n")).alias("d")).join(keyed, ["conv", "d"])
        stays = marked.where(~goes).select("conv", "n", "head")
        held, step = settle(stays.unionByName(moved.select("conv", "n", _key("d", "ka", "kb").alias("head")))), 2 * step


def _digest(convs: list[int]) -> str:
    return hashlib.sha256(",".join(map(str, sorted(convs))).encode()).hexdigest()


class _Node:
    __slots__ = ("above", "depth", "size", "conv", "convs", "children", "leaves", "saved", "ends")

    def __init__(self, above: _Node | None, depth: int, size: int):
        self.above, self.depth, self.size = above, depth, size
        self.conv, self.convs, self.children, self.leaves, self.saved, self.ends = None, 0, 0, 0, 0, []

    def add(self, conv: int, convs: int) -> None:
        self.conv = conv if self.conv is None else min(self.conv, conv)
        self.convs += convs

    def close(self) -> None:
        """All below is known: hand the sums on."""
        self.leaves += not self.children
        self.saved += (self.convs - 1) * self.size
        if self.above:
            self.above.add(self.conv, self.convs)
            self.above.children += 1
            self.above.leaves += self.leaves
            self.above.saved += self.saved


def swept(suffixes: list[tuple[list, list, int]], depth: int) -> list[_Node]:
    """Nodes of a container below a head of this depth; a suffix is its turn ids, sizes and conversation."""
    nodes: list[_Node] = []
    path: list[_Node] = []
    before: list = []
    for ids, sizes, conv in sorted(suffixes, key=lambda s: (s[0], s[2])):
        same = next((k for k, (x, y) in enumerate(zip(before, ids)) if x != y), min(len(before), len(ids)))
        while len(path) > same:
            path.pop().close()
        for k in range(same, len(ids)):
            path.append(_Node(path[-1] if path else None, depth + k + 1, sizes[k]))
            nodes.append(path[-1])
        path[-1].ends.append(conv)
        path[-1].add(conv, 1)
        before = ids
    while path:
        path.pop().close()
    return nodes


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by head, conversation and depth into the nodes of each container."""
    out = pa.schema([("d", pa.int64()), ("ka", pa.int64()), ("kb", pa.int64()), *[(c.split()[0], pa.int64()) for c in NODE.split(", ")[:-1]],
                     ("ends_sha256", pa.string())])
    head, suffixes, found = None, [], []

    def done() -> None:
        for n in swept(suffixes, head[0]):
            found.append((*head, n.depth, n.conv, n.above.conv if n.above else None, n.convs, n.children, n.leaves, n.saved, _digest(n.ends)))

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), out)], schema=out)

    for rows in batches:
        for d, ka, kb, conv, a, b, size in zip(*(c.to_pylist() for c in rows.columns)):
            if (d, ka, kb) != head:
                if suffixes:
                    done()
                head, suffixes = (d, ka, kb), []
            if not suffixes or suffixes[-1][2] != conv:
                suffixes.append(([], [], conv))
            suffixes[-1][0].append((a, b))
            suffixes[-1][1].append(size)
        if found:
            yield batch()
            found.clear()
    if suffixes:
        done()
    if found:
        yield batch()


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by node and conversation into one digest per node, in constant memory however many end there."""
    kind = pa.schema([("d", pa.int64()), ("ka", pa.int64()), ("kb", pa.int64()), ("ends", pa.string())])
    node, digest = None, None
    found: list[tuple] = []

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found), kind)], schema=kind)

    for rows in batches:
        for d, ka, kb, conv in zip(*(c.to_pylist() for c in rows.columns)):
            if (d, ka, kb) != node:
                if node:
                    found.append((*node, digest.hexdigest()))
                node, digest = (d, ka, kb), hashlib.sha256(str(conv).encode())
            else:
                digest.update(b",%d" % conv)
        if found:
            yield batch()
            found.clear()
    if node:
        found.append((*node, digest.hexdigest()))
        yield batch()


def nodes(turns: DataFrame, sizes: DataFrame, container: int = CONTAINER) -> DataFrame:
    """One row per node: each distinct sequence of first turns, the empty one too, with what hangs below it.

    ``turns`` and ``sizes`` as from :func:`number_turns` and :func:`lengths`; conversations of length 0 are members of
    the root. Without conversations there are no nodes.
    """
    keyed = settle(_keyed(turns))
    held = burst(keyed, sizes, container)
    placed = settle(join_skewed(keyed, held, "conv", F.col("d")))

    # Below the heads: containers, each in one task.
    inside = placed.where(F.col("d") > F.col("head.d")).select("head.*", "conv", F.col("d").alias("depth"), "a", "b", "size")
    order = ["d", "ka", "kb"]
    sorted_rows = inside.repartition(*order).sortWithinPartitions(*order, "conv", "depth").drop("depth")
    low = settle(sorted_rows.mapInArrow(_sweep, f"d long, ka long, kb long, {NODE}").withColumn("head", F.struct(*order)).drop(*order))
    tops = low.where(F.col("depth") == F.col("head.d") + 1).groupBy(F.col("head").alias("key")).agg(
        F.count(F.lit(1)).alias("low_children"), F.sum("n_leaves").alias("low_leaves"), F.sum("saved_tokens").alias("low_saved"))

    # The heads and all above them: grouped by key.
    zero = F.lit(0).cast("long")
    above = placed.where(F.col("d") <= F.col("head.d")).select(
        "conv", "n", "d", _key("d", "ka", "kb").alias("key"), F.struct((F.col("d") - 1).alias("d"), F.col("pa").alias("ka"), F.col("pb").alias("kb")).alias("up"), "size"
    ).unionByName(held.select(
        "conv", "n", zero.alias("d"), F.struct(zero.alias("d"), zero.alias("ka"), zero.alias("kb")).alias("key"), F.lit(None).cast(HEAD).alias("up"), zero.alias("size")))
    heads = settle(above.groupBy("key").agg(
        F.count(F.lit(1)).alias("n_convs"), F.min("conv").alias("conv"), F.min("size").alias("size"), F.min("up").alias("up")))
    children = heads.where(F.col("up").isNotNull()).groupBy(F.col("up").alias("key")).agg(F.count(F.lit(1)).alias("high_children"))
    ends = above.where("n = d").select("key.*", "conv").repartition(*order).sortWithinPartitions(*order, "conv").mapInArrow(
        _ends, "d long, ka long, kb long, ends string").select(F.struct(*order).alias("key"), "ends")
    known = heads.join(tops, "key", "left").join(children, "key", "left").join(ends, "key", "left")
    n_children = F.coalesce("low_children", F.lit(0)) + F.coalesce("high_children", F.lit(0))
    known = settle(known.select(
        "key", "conv", "up", "n_convs", n_children.alias("n_children"),
        ((n_children == 0).cast("long") + F.coalesce("low_leaves", F.lit(0))).alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("size") + F.coalesce("low_saved", F.lit(0))).alias("saved"),
        F.coalesce("ends", F.lit(_digest([]))).alias("ends_sha256")))

    # Sums over subtrees: the smallest member of a node owns it, and its path holds the nodes above.
    owned = known.select("conv", F.col("key.d").alias("d"), "leaves", "saved")
    owners = owned.groupBy("conv").agg(F.max("d").alias("deepest"))
    path = join_skewed(above.select("conv", "d", "key"), settle(owners), "conv", F.col("d")).where(F.col("d") <= F.col("deepest"))
    path = path.join(owned, ["conv", "d"], "left").fillna(0, ["leaves", "saved"]).withColumn("_up", -F.col("d"))
    sums = running_sums(path, ["conv"], "_up", {"_leaves": "leaves", "_saved": "saved"}).groupBy("key").agg(
        F.sum("_leaves").alias("n_leaves"), F.sum("_saved").alias("saved_tokens"))
    parents = known.select(F.col("key").alias("up"), F.col("conv").alias("parent_conv_id"))
    high = join_skewed(known, settle(parents), "up", F.col("conv"), "left").join(sums, "key").select(
        F.col("key.d").alias("depth"), F.col("conv").alias("conv_id"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
    names = known.select(F.col("key").alias("head"), F.col("conv").alias("_head_conv"))
    below = low.join(names, "head").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "_head_conv"))
    return high.unionByName(below.select(*high.columns))


def trie(conversations: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The nodes of the conversations as they are; see :func:`number_turns` and :func:`nodes` for nulls, ties and repeats."""
    turns = settle(number_turns(conversations))
    return nodes(turns, lengths(turns), container)


def report(conversations: DataFrame) -> DataFrame:
    """The nodes of the conversations with shared openings."""
    found = nodes(*reopened(settle(number_turns(conversations))))
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")
