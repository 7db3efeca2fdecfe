"""The trie of conversation beginnings against plain Python."""

import hashlib
import random
import zlib

import brute
import pytest
from loadaudit.llm import prefix_trie, queries
from loadaudit.llm.prefix_trie import EMPTY, Merged, Node, RadixTree, block_rows

SF = "/root/testdata/sf0.001"
PARTS = [p.split()[0] for p in prefix_trie._PARTS.split(", ")]
MERGED = [p.split()[0] for p in prefix_trie._MERGED.split(", ")]


def test_layouts_grow_and_keep_their_children():
    r = random.Random(1)
    for n in (1, 4, 5, 16, 17, 48, 49, 256):
        node, kids = Node(b""), {}
        for byte in r.sample(range(256), n):
            kids[byte] = Node(bytes([byte]))
            node.put(byte, kids[byte])
        assert node.room == next(c for c in (4, 16, 48, 256) if n <= c)
        assert [node.find(b) for b in range(256)] == [kids.get(b) for b in range(256)]
        assert node.children() == [kids[b] for b in sorted(kids)]
        again = Node(b"other")
        node.put(next(iter(kids)), again)
        assert node.find(next(iter(kids))) is again and len(node.children()) == n


def test_tree_holds_keys_that_begin_others():
    r = random.Random(2)
    for _ in range(200):
        keys = {bytes(r.randrange(r.choice([2, 256])) for _ in range(r.randrange(9))) for _ in range(r.randrange(1, 80))}
        tree = RadixTree()
        for k in r.sample(sorted(keys), len(keys)):
            tree.insert(k, k)
        for k in keys:
            path = tree.path(k)
            assert path[-1].key == k


def by_blocks(convs, words, block, width):
    same = {}
    for c, turns in convs.items():
        same.setdefault(turns, []).append(c)
    digest = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    keys = sorted((b"".join(t), [words[x] for x in t], len(ids), min(ids), digest(ids)) for t, ids in same.items())
    rows = [dict(zip(PARTS, r, strict=True)) for i in range(0, len(keys), block) for r in block_rows(keys[i : i + block], i, width)]
    merged, got = Merged(), []
    for r in sorted((r for r in rows if r["at"] is not None), key=lambda r: (r["block"], r["at"])):
        got += merged.add(r)
    got = [dict(zip(MERGED, r, strict=True)) for r in [*got, *merged.close()]]
    nodes = {r["no"]: r for r in got if r["block"] is None}
    place = {(r["block"], r["at"]): nodes[r["no"]]["conv_id"] for r in got if r["block"] is not None}
    out = [{**n, "parent_conv_id": nodes[n["parent_no"]]["conv_id"] if n["depth"] else None} for n in nodes.values()]
    out += [r if r["up"] is None else {**r, "parent_conv_id": place[r["block"], r["up"]]} for r in rows if r["at"] is None]
    return sorted((tuple({**r, "ends_sha256": r["ends_sha256"] or EMPTY}[c] for c in prefix_trie.NODE) for r in out), key=lambda r: (r[1], r[0]))


@pytest.mark.parametrize("block", [1, 2, 7, 10**6])
def test_blocks_of_any_size_give_the_same_nodes(block):
    r = random.Random(block)
    for _ in range(300):
        width = r.choice([1, 2, 4])
        turns = [bytes(r.randrange(r.choice([2, 256])) for _ in range(width)) for _ in range(r.choice([1, 2, 3, 10, 300]))]
        words = {t: r.randrange(5) for t in turns}
        convs = {c: tuple(r.choice(turns) for _ in range(r.randrange(5))) for c in r.sample(range(1000), r.choice([1, 2, 5, 40, 200]))}
        assert by_blocks(convs, words, block, width) == brute.trie(convs, words)


def test_a_long_conversation_needs_no_recursion():
    turns = [i.to_bytes(4, "big") for i in range(5000)]
    convs = {1: tuple(turns), 2: tuple(turns[:4000]), 3: tuple([*turns[:4500], b"\xff\xff\xff\xff"])}
    assert len(by_blocks(convs, dict.fromkeys([*turns, b"\xff\xff\xff\xff"], 1), 2, 4)) == 5002


def rebuilt(rows):
    convs = {}
    for c, _, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((role or "", text or ""))
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in convs}
    return {c: tuple(convs.get(c - c % 20, [])[: h[c]] + turns[h[c] :]) for c, turns in convs.items()}


def same(got, convs):
    words = {t: len(brute.words(t[1])) for turns in convs.values() for t in turns}
    assert sorted((tuple(r) for r in got.select(*prefix_trie.NODE).collect()), key=lambda r: (r[1], r[0])) == brute.trie(convs, words)


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    same(queries.QUERIES["op12_prefix_trie"](spark, SF), rebuilt(rows))


def test_odd_conversations(spark):
    long = "word " * 50_000
    rows = [
        (20, 0, "user", "hello  there"), (20, None, None, "first"), (20, 5, "user", None), (21, 0, "user", "hello  there"), (22, 3, None, None), (23, 1, "", ""),
        (None, 0, "user", "of nobody"), (40, 0, "user", long), (41, 0, "user", long), (41, 1, "user", " \n"), (61, 0, "user", "only"), (62, 0, "user", "only"), (2**60, 0, "user", "日本"),
    ]
    rows += [(c, t, "system" if t == 0 else "user", f"text {t * (c % 3)}") for c in range(100, 400) for t in range(c % 5)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string")
    for name in ("turns", "block", "name", "key", "least", "no", "up", "at", "base", "a.b"):
        frame = frame.withColumn(name, frame["text"])
    got = prefix_trie.trie(queries._rebuilt(frame), block=16)
    convs = rebuilt(rows)
    assert () in convs.values()  # conversations without turns
    same(got, convs)
    again = frame.unionByName(frame.filter("conv_id = 20"))  # a turn twice is two turns
    plain = prefix_trie.sequences(again).filter("conv_id = 20").first()
    assert len(plain.turns) == 6
    assert prefix_trie.trie(queries._rebuilt(frame.filter("conv_id < 0"))).collect() == []


def test_one_beginning_in_every_range(spark):
    """A third of all conversations share their first turns; 800 are equal."""
    r = random.Random(4)
    convs = {}
    for c in range(3000):
        head = [("user", "hot"), ("assistant", "answer")] if c % 3 == 0 else []
        convs[c] = tuple(head + [("user", f"t{r.randrange(40)} x") for _ in range(r.randrange(4))]) if c < 2200 else (("user", "hot"), ("user", "equal"))
    rows = [(c, t, *turn) for c, turns in convs.items() for t, turn in enumerate(turns)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn int, role string, text string").repartition(13)
    same(prefix_trie.trie(prefix_trie.sequences(frame), block=50), {c: t for c, t in convs.items() if t})
