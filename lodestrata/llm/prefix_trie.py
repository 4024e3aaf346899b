r"""Prefix trie of conversations: which first turns conversations share, and what sharing them saves.

A conversation is a path of turns; each of its prefixes has a 128-bit hash, chained over the turns. Every task puts the
conversations of its partitions, a batch at a time (equal ones as one), into a z-fast trie. Its nodes are compacted: a node
stands for the depths (a, b] of an edge without branches. A dictionary finds a node by the hash of its prefix at the two-fattest
depth of (a, b], the one that more powers of two divide than any other; a fat binary search over a conversation's depths asks it
at two-fattest depths of what is left, and so ends after log(turns) look-ups at the node where the conversation leaves
the trie. There the edge is split and a leaf hung on. Then edges are expanded to one row a depth, with sums over the task's
members, and rows of one prefix are added up over all tasks.

What counts distinct nodes below a node can't be added up over tasks. But every node belongs to its smallest member, and what one
conversation owns is the end of its path, as deeper nodes have fewer members. So each conversation counts, for all of its
depths, the nodes that it owns from there on; these numbers add up.

Scale. Turns are exchanged once, by conversation; after that rows hold hashes and counts, no texts. A row a turn is exchanged at most
twice, added up before; how many members or children a node has doesn't matter to any task: sums are partial, parents' names go
to children over salted keys, and lists of members are packed by ranges and hashed as a stream. A task's trie is handed on and
begun anew at LIMIT turns. One conversation's hashes have to fit in a task.

Defined results: null role or text is empty; a null turn comes first, equal turns by role and text; repeated rows are turns of
their own; rows without conv_id belong to no conversation and are left out; a conversation without turns is a member of the root;
texts of any length count whole; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestrata.llm.shared import stored

#: Turns that a task's trie holds before it is handed on, and members whose ids are packed into one row.
LIMIT, PACK = 500_000, 10_000
#: Parts that a node's children are dealt to when they learn its name.
SALTS = 64
ROOT = b""

SEQUENCES = "conv_id long, path array<binary>, sizes array<long>"
NODES = "node binary, parent binary, depth long, size long, least long, n long, total long"


def turns(conversations: DataFrame) -> DataFrame:
    """conv_id, digest of role and text, size (bytes of the text), in the partitions and order of conversations."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    whole = F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)
    rows = conversations.where("conv_id is not null").select(
        F.expr("conv_id - pmod(conv_id, 5)").alias("family"),
        F.col("conv_id").cast("long").alias("conv_id"),
        "turn",
        role.alias("role"),
        text.alias("text"),
        F.unhex(F.substring(F.sha2(whole, 256), 1, 32)).alias("digest"),
        F.octet_length(text).cast("long").alias("size"),
    )
    return rows.repartition("family").sortWithinPartitions("family", "conv_id", "turn", "role", "text").select("conv_id", "digest", "size")


def head_turns(conv_id: int) -> int:
    """How many first turns a conversation takes from the first one of its five."""
    return zlib.crc32(str(conv_id).encode()) % 9


def _rebuilt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations with the first turns of their family's first one in place of their own, from sorted turns."""
    out: list[tuple] = []
    family, heads = None, []  # the first turns of conversation `family`, if it exists
    here, own = None, []

    def close() -> None:
        nonlocal heads
        if here is None:
            return
        if here % 5 == 0:
            heads = own[:8]
        n = head_turns(here)
        path, sizes, h = [], [], ROOT
        for digest, size in heads[:n] + own[n:]:
            h = hashlib.blake2b(h + digest, digest_size=16).digest()
            path.append(h)
            sizes.append(size)
        out.append((here, path, sizes))

    for batch in batches:
        for conv_id, digest, size in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "digest", "size")), strict=True):
            if conv_id != here:
                close()
                here, own = conv_id, []
                if conv_id - conv_id % 5 != family:
                    family, heads = conv_id - conv_id % 5, []
            own.append((digest, size))
        if len(out) >= 1000:
            yield _sequences(out)
            out = []
    close()
    yield _sequences(out)


def _sequences(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 3
    kinds = [pa.int64(), pa.list_(pa.binary()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["conv_id", "path", "sizes"])


def rebuilt_sequences(conversations: DataFrame) -> DataFrame:
    """conv_id, path (hashes of all prefixes) and sizes (bytes of the turns' texts) of every conversation, rebuilt."""
    return turns(conversations).mapInArrow(_rebuilt, SEQUENCES)


class Node:
    """The depths (a, b] of `path`; n members below or at b, of which the least; total: bytes of their turns beyond b."""

    __slots__ = ("a", "b", "path", "sizes", "parent", "n", "least", "total")

    def __init__(self, a: int, b: int, path: list[bytes], sizes: list[int], parent: Node | None):
        self.a, self.b, self.path, self.sizes, self.parent = a, b, path, sizes, parent
        self.n, self.least, self.total = 0, None, 0


def two_fattest(a: int, b: int) -> int:
    """The number in (a, b] that the largest power of two divides."""
    return b & (-1 << ((a ^ b).bit_length() - 1))


class Trie:
    """A z-fast trie of paths of prefix hashes."""

    def __init__(self):
        self.root = Node(0, 0, [], [], None)
        self.nodes: list[Node] = []
        self.handles: dict[bytes, Node] = {}  # by the prefix at the two-fattest depth of the node
        self.starts: dict[bytes, Node] = {}  # by the first prefix of the node
        self.turns = 0

    def exit(self, path: list[bytes]) -> Node:
        """The deepest node that shares a prefix of its own with path; the root if there is none."""
        node, low, high = self.root, 0, len(path)
        while low < high:
            at = two_fattest(low, high)
            found = self.handles.get(path[at - 1])
            if found is None:
                high = at - 1
            elif found.b > len(path) or found.path[found.b - 1] != path[found.b - 1]:
                return found  # path leaves inside its edge
            else:
                node, low = found, found.b
        return self.starts.get(path[node.b], node) if node.b < len(path) else node

    def _place(self, node: Node) -> None:
        self.handles[node.path[two_fattest(node.a, node.b) - 1]] = node
        self.starts[node.path[node.a]] = node

    def _split(self, node: Node, at: int) -> Node:
        upper = Node(node.a, at, node.path, node.sizes, node.parent)
        del self.handles[node.path[two_fattest(node.a, node.b) - 1]]
        node.a, node.parent = at, upper
        self._place(upper)
        self._place(node)
        self.nodes.append(upper)
        return upper

    def insert(self, path: list[bytes], sizes: list[int], n: int, least: int) -> None:
        """Adds n members with this path, of which the least is given."""
        node = self.exit(path)
        low, high = node.a, min(node.b, len(path))  # how deep path follows the node's edge
        while low < high:
            middle = (low + high + 1) // 2
            if node.path[middle - 1] == path[middle - 1]:
                low = middle
            else:
                high = middle - 1
        if low < node.b:
            node = self._split(node, low)
        if low < len(path):
            node = Node(low, len(path), path, sizes, node)
            self._place(node)
            self.nodes.append(node)
            self.turns += len(path)
        node.n += n
        node.least = least if node.least is None else min(node.least, least)

    def insert_batch(self, conv_ids: list[int], paths: list[list[bytes]], sizes: list[list[int]]) -> None:
        """Adds conversations, equal ones at once."""
        ends: dict[bytes, list] = {}
        for conv_id, path, size in zip(conv_ids, paths, sizes, strict=True):
            held = ends.setdefault(path[-1] if path else ROOT, [path, size, 0, conv_id])
            held[2] += 1
            held[3] = min(held[3], conv_id)
        for path, size, n, least in ends.values():
            self.insert(path, size, n, least)

    def expanded(self) -> Iterator[tuple]:
        """A row of NODES for every depth of every node."""
        for node in sorted(self.nodes, key=lambda x: -x.b):  # members count for all nodes above
            n, total = node.n, node.total
            for d in range(node.b, node.a, -1):
                total += n * node.sizes[d - 1]
                yield node.path[d - 1], node.path[d - 2] if d > 1 else ROOT, d, node.sizes[d - 1], node.least, n, total
            up = node.parent
            up.n += n
            up.least = node.least if up.least is None else min(up.least, node.least)
            up.total += total
        root = self.root
        if root.n:
            yield ROOT, None, 0, 0, root.least, root.n, root.total


def _columns(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 7
    kinds = [pa.binary()] * 2 + [pa.int64()] * 5
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["node", "parent", "depth", "size", "least", "n", "total"])


def _handed_on(trie: Trie) -> Iterator[pa.RecordBatch]:
    rows: list[tuple] = []
    for row in trie.expanded():
        rows.append(row)
        if len(rows) == PACK:
            yield _columns(rows)
            rows = []
    yield _columns(rows)


def _tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    trie = Trie()
    for batch in batches:
        for at in range(0, len(batch), 1000):
            trie.insert_batch(*(batch.column(c).slice(at, 1000).to_pylist() for c in ("conv_id", "path", "sizes")))
            if trie.turns > LIMIT:
                yield from _handed_on(trie)
                trie = Trie()
    yield from _handed_on(trie)


def _owned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For every depth of a conversation what it owns from there on: bytes, and 1 if it owns a node without children."""
    for batch in batches:
        for at in range(0, len(batch), 1000):
            rows = batch.slice(at, 1000)
            nodes, owned, leaves = [], [], []
            for path, sizes, first, leaf in zip(*(rows.column(c).to_pylist() for c in ("path", "sizes", "first", "leaf")), strict=True):
                beyond = np.r_[0, np.cumsum(np.array(sizes[::-1], np.int64))][::-1]  # bytes of turns after each depth
                from_here = np.r_[beyond[0], beyond[:-1]]  # with the depth's own turn
                from_here[:first] = from_here[first]
                nodes += [ROOT, *path]
                owned.append(from_here)
                leaves += [leaf] * (len(path) + 1)
            columns = [pa.array(nodes, pa.binary()), pa.array(np.concatenate(owned) if owned else [], pa.int64()), pa.array(leaves, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["node", "owned", "leaf"])


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of one node in sorted rows (node, conv_id) as one row each, of PACK ids at most."""
    node, ids, out = None, [], []

    def close() -> None:
        if ids:
            out.append((node, ids[0], ",".join(map(str, ids))))

    def given() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 3
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.binary(), pa.int64(), pa.string()), strict=True)], ["node", "first", "ids"])

    for batch in batches:
        for x, conv_id in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if x != node or len(ids) == PACK:
                close()
                node, ids = x, []
            ids.append(conv_id)
        if len(out) >= 1000:
            yield given()
    close()
    yield given()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One digest a node of its ids, from sorted rows (node, first, ids), as a stream."""
    node, state, out = None, None, []

    def given() -> pa.RecordBatch:
        columns = list(zip(*out, strict=True)) or [()] * 2
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.binary()), pa.array(columns[1], pa.string())], ["node", "ends_sha256"])

    for batch in batches:
        for x, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if state is None or x != node:
                if state is not None:
                    out.append((node, state.hexdigest()))
                node, state = x, hashlib.sha256(ids.encode())
            else:
                state.update(b"," + ids.encode())
        yield given()
    if state is not None:
        out.append((node, state.hexdigest()))
    yield given()


def members(sequences: DataFrame) -> DataFrame:
    """node, ends_sha256: the digest of the ids of all conversations that end at a node."""
    ends = sequences.select(F.coalesce(F.try_element_at("path", F.lit(-1)), F.lit(ROOT)).alias("node"), "conv_id")
    runs = ends.repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id").mapInArrow(_packed, "node binary, first long, ids string")
    return runs.repartition("node").sortWithinPartitions("node", "first").select("node", "ids").mapInArrow(_digests, "node binary, ends_sha256 string")


def prefix_trie(sequences: DataFrame) -> DataFrame:
    """A row a node of the trie over sequences (conv_id, path, sizes): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    sequences = stored(sequences, "sequences")
    parts = sequences.mapInArrow(_tries, NODES)
    # A node's hash fixes its parent, depth and size; as keys they keep the aggregation one of plain numbers.
    summed = parts.groupBy("node", "parent", "depth", "size").agg(F.min("least").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("total").alias("total"))
    nodes = stored(summed, "nodes")
    children = nodes.where("parent is not null").groupBy(F.col("parent").alias("of")).agg(F.count("*").alias("n_children"))
    nodes = nodes.join(children, F.col("node") == F.col("of"), "left").drop("of").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    nodes = stored(nodes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS))), "nodes")
    # From `first` on a conversation owns its path; only its last node can be without children.
    owners = nodes.groupBy(F.col("conv_id").alias("owner")).agg(F.min("depth").alias("first"), F.max((F.col("n_children") == 0).cast("long")).alias("leaf"))
    paths = sequences.join(owners, F.col("conv_id") == F.col("owner")).select("path", "sizes", "first", "leaf")
    below = paths.mapInArrow(_owned, "node binary, owned long, leaf long").groupBy("node").agg(F.sum("owned").alias("owned"), F.sum("leaf").alias("n_leaves"))
    names = nodes.select(F.col("node").alias("above"), F.col("conv_id").alias("parent_conv_id"))
    asked = nodes.where("parent is not null").select("parent", "salt").distinct()
    parents = asked.join(names, F.col("parent") == F.col("above")).drop("above")
    found = nodes.join(below, "node").join(members(sequences), "node", "left").join(parents, ["parent", "salt"], "left")
    return found.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        "n_leaves",
        (F.col("total") - F.col("owned")).alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
