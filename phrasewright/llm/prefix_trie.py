"""A trie of the beginnings that conversations share, merged family by family first.

Conversations whose ids have the same base are a family. They meet in one place in order, the base's own turns before the
others', each is rebuilt from the base's first turns and its own rest, and the family's small trie is built from them. Only
the nodes of these tries are shuffled for the global merge, where the same beginnings in different families become one node.

A node is known by a hash over its turns. After the merge it is also known by its smallest member and its depth, and the
nodes with the same smallest member are one path, the last part of that conversation. So subtrees are summed over a tree of
paths, which is shallow, with joins that double the distance; within a path a running sum from its end does the rest.
"""

from __future__ import annotations

from hashlib import sha256

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

#: Ids of a family differ by less than FAMILY; a conversation takes fewer than SHARED turns of its base.
FAMILY, SHARED = 5, 9
#: Nodes that a family's trie may have in memory; beyond these it is passed on in parts. Rows of a batch, characters of a piece.
NODES, ROWS, PIECE = 50_000, 5_000, 4096
ROOT = bytes(16)
_NODE = "k1 long, k2 long, p1 long, p2 long, depth long, size long, conv_id long, n_convs long, ends array<long>"
_NODE_TYPE = pa.schema([(c, pa.int64()) for c in ("k1", "k2", "p1", "p2", "depth", "size", "conv_id", "n_convs")] + [("ends", pa.list_(pa.int64()))])


def turns(conversations: DataFrame) -> DataFrame:
    """(base, other, conv_id, shared, turn, said, size): turns by the digest of role and text, and their text's bytes."""
    c = F.col("conv_id").cast("long")
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    said = F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256))
    base = c - c % FAMILY
    kept = conversations.where("conv_id is not null")
    return kept.select(base.alias("base"), (c != base).alias("other"), c.alias("conv_id"), (F.crc32(c.cast("string")) % SHARED).cast("int").alias("shared"), F.col("turn").cast("long").alias("turn"), said.alias("said"), F.octet_length(text).cast("long").alias("size"))


class Family:
    """The trie of a family: node by key as [parent, depth, size, smallest member, members, ends]."""

    def __init__(self):
        self.nodes, self.out = {}, []

    def visit(self, key: bytes, parent: bytes | None, depth: int, size: int, conv: int) -> None:
        node = self.nodes.get(key)
        if node is None:
            if len(self.nodes) >= NODES:
                self.pass_on()
            self.nodes[key] = [parent, depth, size, conv, 1, []]
        else:
            node[4] += 1
            if conv < node[3]:
                node[3] = conv

    def end(self, key: bytes, conv: int) -> None:
        # The node was visited last, so it is there.
        self.nodes[key][5].append(conv)

    def pass_on(self) -> None:
        self.out += [(key, *node) for key, node in self.nodes.items()]
        self.nodes = {}

    def batch(self) -> pa.RecordBatch:
        halves = lambda keys, a: [None if k is None else int.from_bytes(k[a : a + 8], "big", signed=True) for k in keys]
        key, parent, depth, size, conv, n, ends = zip(*self.out, strict=True) if self.out else [[]] * 7
        self.out = []
        columns = [halves(key, 0), halves(key, 8), halves(parent, 0), halves(parent, 8), depth, size, conv, n, ends]
        return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(columns, _NODE_TYPE, strict=True)], schema=_NODE_TYPE)


def _families(batches):
    """The nodes of each family's trie. Rows come family by family and turn by turn, the base's first, so of what is read only
    the base's first turns and the family's nodes are kept."""
    family, base, conv, first = Family(), None, None, []
    key, depth, skipped, shared = ROOT, 0, 0, 0

    def step(said, size):
        nonlocal key, depth
        parent, key, depth = key, sha256(key + said).digest()[:16], depth + 1
        family.visit(key, parent, depth, size, conv)

    for batch in batches:
        for b, c, h, said, size in zip(*(batch.column(x).to_pylist() for x in ("base", "conv_id", "shared", "said", "size")), strict=True):
            if c != conv:
                if conv is not None:
                    family.end(key, conv)
                if b != base:
                    family.pass_on()
                    base, first = b, []
                conv, shared, key, depth, skipped = c, h, ROOT, 0, 0
                family.visit(ROOT, None, 0, 0, conv)
                if c != base:
                    for x in first[:shared]:
                        step(*x)
            if c == base:
                if len(first) < SHARED:
                    first.append((said, size))
                step(said, size)
            elif skipped < shared:
                skipped += 1
            else:
                step(said, size)
            if len(family.out) >= ROWS:
                yield family.batch()
    if conv is not None:
        family.end(key, conv)
    family.pass_on()
    yield family.batch()


def _pieces(batches):
    """(k1, k2, first, text): ids in order, comma-joined, some at a time."""
    for batch in batches:
        rows, last = [], None
        for k1, k2, c in zip(*(batch.column(x).to_pylist() for x in ("k1", "k2", "conv_id")), strict=True):
            if last == (k1, k2) and len(rows[-1][3]) < PIECE:
                rows[-1][3] += f",{c}"
            else:
                rows.append([k1, k2, c, str(c)])
                last = (k1, k2)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 4
        yield pa.RecordBatch.from_arrays([*(pa.array(list(x), pa.int64()) for x in columns[:3]), pa.array(list(columns[3]), pa.string())], names=["k1", "k2", "first", "text"])


def _digests(batches):
    """(k1, k2, ends_sha256) from pieces in order."""
    key, digest = None, None

    def batch(done):
        columns = list(zip(*done, strict=True)) if done else [[]] * 3
        return pa.RecordBatch.from_arrays([*(pa.array(list(x), pa.int64()) for x in columns[:2]), pa.array(list(columns[2]), pa.string())], names=["k1", "k2", "ends_sha256"])

    for pieces in batches:
        done = []
        for k1, k2, text in zip(*(pieces.column(x).to_pylist() for x in ("k1", "k2", "text")), strict=True):
            if key == (k1, k2):
                digest.update(f",{text}".encode())
            else:
                if key:
                    done.append((*key, digest.hexdigest()))
                key, digest = (k1, k2), sha256(text.encode())
        yield batch(done)
    yield batch([(*key, digest.hexdigest())] if key else [])


def family_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of all families' tries, settled."""
    order = ("base", "other", "conv_id", F.col("turn").asc_nulls_first(), "said")
    return settle(turns(conversations).repartition("base").sortWithinPartitions(*order).mapInArrow(_families, _NODE), "family-nodes")


def _digests_of(nodes: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256): the ids are put in order over all tasks and joined to pieces; a node's pieces then meet in order."""
    ends = nodes.select("k1", "k2", F.explode("ends").alias("conv_id"))
    pieces = ends.repartitionByRange("k1", "k2", "conv_id").sortWithinPartitions("k1", "k2", "conv_id").mapInArrow(_pieces, "k1 long, k2 long, first long, text string")
    return pieces.repartition("k1", "k2").sortWithinPartitions("k1", "k2", "first").mapInArrow(_digests, "k1 long, k2 long, ends_sha256 string")


def path_sums(paths: DataFrame) -> DataFrame:
    """(conv_id, saved, leaves) of each path with all that hangs below it, from (conv_id, saved, leaves, above); above is the path
    that it hangs on. Each round adds what hangs as far below again as is summed already."""
    found = settle(paths, "paths")
    while found.where("above is not null").limit(1).count():
        more = found.where("above is not null").groupBy(F.col("above").alias("conv_id")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
        further = found.select(F.col("conv_id").alias("above"), F.col("above").alias("further"))
        joined = found.join(further, "above", "left").join(more, "conv_id", "left")
        none = F.lit(0).cast("long")
        found = settle(joined.select("conv_id", (F.col("saved") + F.coalesce("s", none)).alias("saved"), (F.col("leaves") + F.coalesce("l", none)).alias("leaves"), F.col("further").alias("above")), "paths")
    return found.drop("above")


def trie(conversations: DataFrame) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of each node.

    A conversation c is rebuilt from the first crc32(c) % 9 turns of conversation c - c % 5, where there is one, and its own
    turns after as many; turns go by number (null first) and equal numbers by the SHA-256 of role and text. Null roles and
    texts are empty. Rows without conv_id take no part. Repeated rows are turns of their own. An empty table has no node, not
    even the root; other columns are ignored. A conversation of very many turns is one path, which is read turn by turn and
    passed on in parts.
    """
    nodes = family_nodes(conversations)
    same = [F.first(c).alias(c) for c in ("p1", "p2", "depth", "size")]
    merged = settle(nodes.groupBy("k1", "k2").agg(*same, F.min("conv_id").alias("conv_id"), F.sum("n_convs").alias("n_convs")), "nodes")
    children = merged.where("p1 is not null").groupBy(F.col("p1").alias("k1"), F.col("p2").alias("k2")).agg(F.count("*").alias("n_children"))
    parents = merged.select(F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    none = F.lit(0).cast("long")
    joined = merged.join(parents, ["p1", "p2"], "left").join(children, ["k1", "k2"], "left").join(_digests_of(nodes), ["k1", "k2"], "left")
    every = joined.select(
        "conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", none).alias("n_children"),
        ((F.col("n_convs") - 1) * F.col("size")).alias("saved"), F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("leaves"),
        F.coalesce("ends_sha256", F.lit(sha256(b"").hexdigest())).alias("ends_sha256"),
    )
    every = settle(every, "trie")
    hangs = F.col("parent_conv_id") != F.col("conv_id")
    paths = settle(every.groupBy("conv_id").agg(F.sum("saved").alias("saved"), F.sum("leaves").alias("leaves"), F.max(F.when(hangs, F.col("parent_conv_id"))).alias("above"), F.max(F.when(hangs, F.col("depth") - 1)).alias("at")), "paths")
    whole = path_sums(paths.drop("at"))
    below = paths.where("above is not null").select("conv_id", "above", "at").join(whole, "conv_id").groupBy(F.col("above").alias("conv_id"), F.col("at").alias("depth")).agg(F.sum("saved").alias("s"), F.sum("leaves").alias("l"))
    up = Window.partitionBy("conv_id").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    total = lambda own, more: F.sum(F.col(own) + F.coalesce(more, none)).over(up)
    return every.join(below, ["conv_id", "depth"], "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", total("leaves", "l").alias("n_leaves"), total("saved", "s").alias("saved_tokens"), "ends_sha256")
