"""The trie of shared conversation beginnings, built from adaptive radix trees.

A turn is a fixed-width id: the first 16 bytes of the SHA-256 of its role and text, most
significant byte first. A conversation is the string of its turns' ids; its beginnings are
the prefixes at multiples of 16 bytes. Equal conversations are one key that carries its number of
conversations, their least id and the hash of all their ids.

Keys are dealt by ranges and sorted, so a first turn that a third of all conversations share is
spread like any other. A task builds one adaptive radix tree for each block of ``BLOCK`` keys.
Inside a block every beginning is counted whole, but for those on the paths of its first and last
key, which neighbouring blocks may share: these few (two paths a block) are rows of partial counts.
One pass in key order merges them with a stack of one path, and their least ids are joined back
as the parents of the beginnings below them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch, cut

#: Bytes of a turn's id.
WIDTH = 16
#: Keys of one radix tree.
BLOCK = 1 << 16
#: Ids of one class are gathered by their value without the last so many bits, so a group has
#: no more than 4,096.
BITS = 12
EMPTY = hashlib.sha256(b"").hexdigest()
_PARTS = "block bigint, at int, up int, turn binary, words bigint, conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
_MERGED = "no bigint, parent_no bigint, block bigint, at int, conv_id bigint, depth bigint, n_convs bigint, n_children bigint, n_leaves bigint, saved_tokens bigint, ends_sha256 string"
NODE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


class Node:
    """A radix tree node: the bytes behind its branching byte up to where its children
    branch, its children in the smallest layout that holds them, and the key that ends here.

    Layouts by capacity: 4 and 16 keep sorted bytes beside their children, 48 an index of
    256 bytes into its children, 256 a child for every byte.
    """

    __slots__ = ("prefix", "room", "index", "kids", "key", "members", "least", "below", "tops", "leaves", "saved", "words", "open")

    def __init__(self, prefix: bytes, key=None) -> None:
        self.prefix, self.key = prefix, key
        self.room, self.index, self.kids = 4, bytearray(), []
        self.open = False

    def find(self, byte: int) -> Node | None:
        if self.room <= 16:
            i = self.index.find(byte)
            return self.kids[i] if i >= 0 else None
        if self.room == 48:
            i = self.index[byte]
            return self.kids[i - 1] if i else None
        return self.kids[byte]

    def put(self, byte: int, kid: Node) -> None:
        """Adds a child, or replaces that of the same byte."""
        if self.room == 256:
            self.kids[byte] = kid
            return
        at = self.index.find(byte) if self.room <= 16 else self.index[byte] - 1
        if at >= 0:
            self.kids[at] = kid
            return
        if len(self.kids) == self.room:
            self._grow()
            self.put(byte, kid)
        elif self.room <= 16:
            at = next((i for i, b in enumerate(self.index) if b > byte), len(self.kids))
            self.index.insert(at, byte)
            self.kids.insert(at, kid)
        else:
            self.kids.append(kid)
            self.index[byte] = len(self.kids)

    def _grow(self) -> None:
        if self.room == 4:
            self.room = 16
        elif self.room == 16:
            index = bytearray(256)
            for i, byte in enumerate(self.index):
                index[byte] = i + 1
            self.room, self.index = 48, index
        else:
            kids = [self.kids[i - 1] if i else None for i in self.index]
            self.room, self.index, self.kids = 256, bytearray(), kids

    def children(self) -> list[Node]:
        """In the order of their bytes."""
        if self.room <= 16:
            return self.kids
        if self.room == 48:
            return [self.kids[i - 1] for i in self.index if i]
        return [k for k in self.kids if k is not None]


class RadixTree:
    """Byte strings with a value each; one may be the beginning of another."""

    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, key: bytes, value) -> None:
        node, depth, over = self.root, 0, None
        while True:
            prefix = node.prefix
            if not key.startswith(prefix, depth):
                c = next((i for i, (x, y) in enumerate(zip(prefix, key[depth : depth + len(prefix)], strict=False)) if x != y), min(len(prefix), len(key) - depth))
                fork = Node(prefix[:c])
                over.put(key[depth - 1], fork)
                node.prefix = prefix[c + 1 :]
                fork.put(prefix[c], node)
                if depth + c == len(key):
                    fork.key = value
                else:
                    fork.put(key[depth + c], Node(key[depth + c + 1 :], value))
                return
            depth += len(prefix)
            if depth == len(key):
                node.key = value
                return
            kid = node.find(key[depth])
            if kid is None:
                node.put(key[depth], Node(key[depth + 1 :], value))
                return
            over, node, depth = node, kid, depth + 1

    def path(self, key: bytes) -> list[Node]:
        """The nodes down to ``key``, which is in the tree."""
        node, depth, out = self.root, 0, []
        while True:
            out.append(node)
            depth += len(node.prefix)
            if depth == len(key):
                return out
            node, depth = node.find(key[depth]), depth + 1


def _count(root: Node, width: int) -> None:
    """From the leaves up: conversations, least id, and what closed beginnings below add."""
    order, stack = [], [(root, -1)]
    while stack:
        node, over = stack.pop()
        end = over + 1 + len(node.prefix)
        order.append((node, over, end))
        stack.extend((k, end) for k in node.children())
    for node, over, end in reversed(order):
        kids = node.children()
        ended = node.key
        node.members = sum(k.members for k in kids) + (ended[1] if ended else 0)
        node.least = min([k.least for k in kids] + ([ended[2]] if ended else []), default=None)
        node.words = ended[0] if ended else kids[0].words if kids else []
        node.below = sum(k.tops for k in kids)
        leaves, saved = sum(k.leaves for k in kids), sum(k.saved for k in kids)
        first, last = over // width + 1, end // width
        if over < 0:
            first = 0
        if first > last:  # no turn ends within this node
            node.tops, node.leaves, node.saved = node.below, leaves, saved
        elif node.open:  # counted at its place on the open path, nothing passes on
            node.tops, node.leaves, node.saved = 0, 0, 0
            node.below = (node.below, leaves, saved)
        else:
            node.tops, node.leaves = 1, leaves if node.below else 1
            node.saved = saved + (node.members - 1) * sum(node.words[d - 1] for d in range(max(first, 1), last + 1))


def block_rows(keys: list[tuple], block: int, width: int = WIDTH) -> Iterator[tuple]:
    """Rows of ``_PARTS`` for (key, words of each turn, n, least id, hash of ids) in key order."""
    tree = RadixTree()
    for key, *value in keys:
        tree.insert(key, value)
    first, last = keys[0][0], keys[-1][0]
    common = 0
    while common < len(first) and first[common : common + width] == last[common : common + width]:
        common += width
    common //= width
    turns = len(first) // width
    paths = (tree.path(first), tree.path(last))
    for node in (*paths[0], *paths[1]):
        node.open = True
    on_first = {id(n) for n in paths[0]}
    _count(tree.root, width)

    # From the root down: an open beginning above is known by its place, a closed one by its id.
    stack = [(tree.root, -1, None, None)]
    while stack:
        node, over, up, parent = stack.pop()
        end = over + 1 + len(node.prefix)
        low, high = (0 if over < 0 else over // width + 1), end // width
        left = node.saved
        for d in range(low, high + 1):
            bottom = d == high
            ended = node.key if d * width == end else None
            words = node.words[d - 1] if d else 0
            ends = ended[3] if ended else None
            if node.open:
                at = d if id(node) in on_first and d <= turns else turns + d - common
                kids, leaves, saved = node.below if bottom else (0, 0, 0)
                key = first if at == d and d <= turns and id(node) in on_first else last
                yield block, at, None, key[(d - 1) * width : d * width] if d else b"", words, node.least, d, None, node.members, kids, leaves, saved, ends
                up, parent = at, None
            else:
                yield block, None, up, None, None, node.least, d, parent, node.members, node.below if bottom else 1, node.leaves, left, ends
                left -= (node.members - 1) * words
                up, parent = None, node.least
        stack.extend((k, end, up, parent) for k in node.children())


class Merged:
    """Partial counts of open beginnings, in the order of keys, merged along one path."""

    def __init__(self) -> None:
        self.path: list[dict] = []
        self.n = 0

    def add(self, row: dict) -> Iterator[tuple]:
        """Rows of ``_MERGED``: the place of ``row``, and beginnings that are complete."""
        d = row["depth"]
        if d >= len(self.path) or self.path[d]["turn"] != row["turn"]:
            yield from self.close(d)
            self.path.append({**row, "no": self.n})
            self.n += 1
        else:
            own = self.path[d]
            own["conv_id"] = min(own["conv_id"], row["conv_id"])
            for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                own[name] += row[name]
            own["ends_sha256"] = own["ends_sha256"] or row["ends_sha256"]
        yield self.path[d]["no"], None, row["block"], row["at"], *[None] * 7

    def close(self, depth: int = 0) -> Iterator[tuple]:
        """Ends the path above ``depth``."""
        while len(self.path) > depth:
            own = self.path.pop()
            if not own["n_children"]:
                own["n_leaves"] = 1
            own["saved_tokens"] += (own["n_convs"] - 1) * own["words"]
            if self.path:
                over = self.path[-1]
                over["n_children"] += 1
                over["n_leaves"] += own["n_leaves"]
                over["saved_tokens"] += own["saved_tokens"]
            yield (
                own["no"], self.path[-1]["no"] if self.path else None, None, None, own["conv_id"], own["depth"],
                own["n_convs"], own["n_children"], own["n_leaves"], own["saved_tokens"], own["ends_sha256"],
            )


def _columns(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return batch(schema, *(list(c) for c in (zip(*rows, strict=True) if rows else [[]] * len(schema))))


def _arrow(ddl: str) -> pa.Schema:
    kinds = {"bigint": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "string": pa.string()}
    return pa.schema([(name, kinds[kind]) for name, kind in (part.split() for part in ddl.split(", "))])


def _trees(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    schema, part = _arrow(_PARTS), TaskContext.get().partitionId()
    keys, done = [], 0

    def built() -> Iterator[pa.RecordBatch]:
        rows = []
        for row in block_rows(keys, part << 32 | done):
            rows.append(row)
            if len(rows) >= 20_000:
                yield _columns(schema, rows)
                rows = []
        yield _columns(schema, rows)

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            keys.append(row)
            if len(keys) >= size:
                yield from built()
                keys, done = [], done + 1
    if keys:
        yield from built()


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema, merged, rows = _arrow(_MERGED), Merged(), []
    for b in batches:
        for row in b.to_pylist():
            rows.extend(merged.add(row))
        if len(rows) >= 20_000:
            yield _columns(schema, rows)
            rows = []
    rows.extend(merged.close())
    yield _columns(schema, rows)


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each class's number of ids, least id and hash of all ids, from parts in order."""
    schema = _arrow("n_convs bigint, least bigint, ends_sha256 string")
    now, state, out = None, None, []
    for b in batches:
        for name, ids, n, least in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if name != now:
                if state:
                    out.append((state[1], state[2], state[0].hexdigest()))
                now, state = name, [hashlib.sha256(ids.encode()), n, least]
            else:
                state[0].update(b"," + ids.encode())
                state[1] += n
        yield _columns(schema, out)
        out = []
    if state:
        yield _columns(schema, [(state[1], state[2], state[0].hexdigest())])


def sequences(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id and turns (array of id, words) of every conversation, by turn, null first; ties
    by role, then id. A null role or text is empty; rows without a conversation are left out.

    Only ids (32 hexadecimal digits) and word counts travel, never a text. A conversation's ids
    have to fit in a task: 16 bytes a turn.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    name = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256), 1, 2 * WIDTH)
    rows = turns.filter(F.col(conv_col).isNotNull()).select(
        F.col(conv_col).cast("bigint").alias("conv_id"), F.col(turn_col).alias("turn"), role.alias("role"), name.alias("id"),
        F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("bigint").alias("words"),
    )
    ordered = F.array_sort(F.collect_list(F.struct(F.col("turn").isNotNull().alias("later"), "turn", "role", "id", "words")))
    gathered = rows.groupBy("conv_id").agg(ordered.alias("turns"))
    return gathered.select("conv_id", F.transform("turns", lambda t: F.struct(t["id"].alias("id"), t["words"].alias("words"))).alias("turns"))


def classes(keys: DataFrame) -> DataFrame:
    """n_convs, least and ends_sha256 (SHA-256 of the ids in ascending order, joined by commas) of
    the conversations of each ``name``.

    Ids are sorted and joined in groups of at most 4,096 first; SHA-256 then reads a
    class's groups in order, one at a time.
    """
    parts = keys.groupBy("name", F.shiftright("conv_id", BITS).alias("part")).agg(F.sort_array(F.collect_list("conv_id")).alias("ids"))
    parts = parts.select("name", F.array_join(F.col("ids").cast("array<string>"), ",").alias("ids"), F.size("ids").cast("bigint").alias("n"), F.col("ids")[0].alias("least"))
    ordered = parts.repartition("name").sortWithinPartitions("name", "least")
    return ordered.mapInArrow(_hashes, "n_convs bigint, least bigint, ends_sha256 string")


def trie(conversations: DataFrame, block: int = BLOCK) -> DataFrame:
    """The nodes of the trie of ``conversations`` (conv_id, unique and not null, and turns, as of
    ``sequences``).

    Each distinct sequence of first d turns is a node of depth d, from the root of depth 0; its
    members are the conversations that begin so. Per node: conv_id (smallest member), depth,
    parent_conv_id (the parent's; null at the root), n_convs, n_children, n_leaves (nodes
    without children in its subtree, itself included), saved_tokens (over its subtree, each
    node's (n_convs - 1) times the words of its last turn) and ends_sha256 of the members
    that end here. (conv_id, depth) names a node. A conversation without turns, or null ones,
    ends at the root; other columns are left out; no conversations, no rows.
    """
    turns = F.coalesce("turns", F.array().cast("array<struct<id: string, words: bigint>>"))
    keys = conversations.select(
        "conv_id", F.unhex(F.array_join(F.transform(turns, lambda t: t["id"]), "")).alias("key"), F.transform(turns, lambda t: t["words"]).alias("words")
    )
    keys = cut(keys.withColumn("name", F.unhex(F.sha2("key", 256))), "trie-keys")
    found = classes(keys.select("name", "conv_id"))
    distinct = cut(found.join(keys, found["least"] == keys["conv_id"]).select("key", "words", "n_convs", "least", "ends_sha256"), "trie-distinct")
    ordered = distinct.repartitionByRange("key").sortWithinPartitions("key")
    parts = cut(ordered.mapInArrow(lambda batches: _trees(batches, block), _PARTS), "trie-parts")

    spine = parts.filter("at IS NOT NULL").repartition(1).sortWithinPartitions("block", "at")
    merged = cut(spine.mapInArrow(_merge, _MERGED), "trie-spine")
    nodes = merged.filter("block IS NULL")
    above = nodes.select(F.col("no").alias("parent_no"), F.col("conv_id").alias("parent_conv_id"))
    places = merged.filter("block IS NOT NULL").select("no", "block", F.col("at").alias("up")).join(nodes.select("no", F.col("conv_id").alias("parent_conv_id")), "no").drop("no")
    opened = nodes.join(above, "parent_no", "left").select(*NODE)
    below = parts.filter("up IS NOT NULL").drop("parent_conv_id").join(places, ["block", "up"]).select(*NODE)
    closed = parts.filter("at IS NULL AND up IS NULL").select(*NODE)
    return closed.unionByName(below).unionByName(opened).withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(EMPTY)))
