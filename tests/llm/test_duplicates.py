"""Near duplicates, repeated strings and lines, benchmark items and licences against brute force."""

import random
import re

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from loadaudit.llm import common, decontaminate, license_scan, line_dedup, ngram_join, suffix_dedup
from loadaudit.llm.graph import components
from loadaudit.llm.license_templates import TEMPLATES


def corpus(seed=1, n=160):
    """Texts with exact and near copies, a chain of edits, and a large group of copies."""
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(1, 5)))
    texts = [" ".join(word() for _ in range(draw.randint(0, 120))) for _ in range(n)]
    hot = texts[3] + " " + " ".join(word() for _ in range(90))
    for _ in range(n):
        t = draw.choice([hot, hot, draw.choice(texts)]).split(" ")
        for _ in range(draw.randint(0, 4)):
            t[draw.randrange(len(t))] = word()
        texts.append(" ".join(t))
    return {i: t for i, t in enumerate(texts)}


@pytest.mark.parametrize("block", [7, 96])
def test_links_and_classes(spark, monkeypatch, block):
    docs = corpus(block)
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()}
    linked = brute.links(docs)
    top = brute.classes(docs, linked)
    assert got == {i: (top[i], len(linked[i])) for i in docs}


@pytest.mark.parametrize("block", [3, 96])
def test_chains_stay_whole(spark, monkeypatch, block):
    """Windows of one text, each linked with its neighbours only."""
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = {100 * c + k: " ".join(f"c{c}w{x}" for x in range(10 * k, 10 * k + 104)) for c in range(40) for k in range(4 + c % 5)}
    got = {r.doc_id: (r.class_id, r.n_links) for r in ngram_join.join(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()}
    linked = brute.links(docs)
    top = brute.classes(docs, linked)
    assert set(top.values()) == {100 * c for c in range(40)} and max(map(len, linked.values())) == 2
    assert got == {i: (top[i], len(linked[i])) for i in docs}


def test_odd_rows_of_the_join(odd, none):
    joined = ngram_join.join(odd)
    got = sorted((str(r.doc_id), r.class_id, r.n_links) for r in joined.collect() if r.doc_id in (1, 2, 3, 4, 5))
    assert got == [("1", 1, 3), ("1", 1, 3), ("2", 1, 3), ("3", 3, 0), ("4", 4, 0), ("5", 5, 0)]
    assert joined.count() == odd.count() and ngram_join.join(none).count() == 0
    assert 1 in {r.doc_id for r in ngram_join.representatives(joined).collect()}


def test_rows_keep_their_columns_of_any_name(spark):
    names = ["doc_id", "text", "__row", "__id", "__kept", "a.b", "row_hash", "whole_row", "kept_id", "_kept_id", "KEPT_HASH", "_right", "_row", "`q`"]
    rows = [(i // 2, "same", *[f"{n}{i}" for n in names[2:]]) for i in range(6)] + [(None, "none", *names[2:])]
    quoted = ", ".join("`" + n.replace("`", "``") + "` " + ("bigint" if n == "doc_id" else "string") for n in names)
    docs = spark.createDataFrame(rows, quoted)
    kept = docs.where("doc_id = 1 OR doc_id IS NULL").select("doc_id", F.xxhash64("text", "doc_id").alias("_row"))
    whole = common.keep_rows(docs, kept)
    assert whole.columns == names and sorted(map(str, map(tuple, whole.collect()))) == sorted(str(r) for r in rows if r[0] in (1, None))
    once = [tuple(r) for r in common.keep_rows(docs, kept, once=True).collect()]
    assert len(once) == 2 and all(r in rows for r in once)
    assert once == [tuple(r) for r in common.keep_rows(docs.orderBy(F.desc("`a.b`")), kept, once=True).collect()]


def test_bands_reach_their_recall():
    for s in (0.2, 0.5, 0.8, 0.95):
        bands, rows = ngram_join.bands_for(s, 0.999)
        assert 1 - (1 - s**rows) ** bands >= 0.999 and bands * rows <= 256


def test_components_of_a_path_a_star_and_loops(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, k) for k in range(20, 60)] + [(5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{k: 7 for k in range(20, 60)}}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def with_passages(seed, n=40):
    draw = random.Random(seed)
    word = lambda: "".join(draw.choice("aeimnté") for _ in range(draw.randint(1, 6)))
    passages = [" ".join(word() for _ in range(k)) for k in (5, 30, 60, 90)]
    out = []
    for _ in range(n):
        parts = [" ".join(word() for _ in range(draw.randint(0, 40))) for _ in range(3)]
        for _ in range(draw.randint(0, 2)):
            p = draw.choice(passages)
            a = draw.randrange(len(p) // 2)
            parts.insert(draw.randrange(4), p[a : a + draw.randint(20, len(p))])
        out.append("".join(parts))
    return out + ["ab" * 300, "xab" + "ab" * 200, "x" * 150, "y" * 64, None, "", out[0], out[1][5:]]


@pytest.mark.parametrize("length", [64, 101, 200])
def test_repeated_strings(spark, length):
    texts = with_passages(length)
    rows = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0])]
    out = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), length).collect()
    want = sorted((i, d[~gone].tobytes().hex()) for (i, _), (d, gone) in zip(rows, brute.repeats([t for _, t in rows], length)))
    assert sorted((r.carried.doc_id, bytes(r.kept).hex()) for r in out) == want
    masks = {i: gone for (i, _), (_, gone) in zip(rows, brute.repeats([t for _, t in rows], length))}
    for r in out:
        own = np.zeros(r.n_bytes, bool)
        for a, b in zip(r.starts, r.ends):
            own[a:b] = True
        assert (own == masks[r.carried.doc_id]).all()


def test_odd_rows_of_repeated_strings(odd, none):
    out = suffix_dedup.cleaned(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    text = {r.doc_id: r.text for r in out.collect() if r.doc_id in (3, 4, 8, 10)}
    assert text == {3: "", 4: "", 8: "a", 10: ""} and suffix_dedup.cleaned(none).count() == 0


def test_lines(odd, none, spark):
    rows = [(2, "B  b\nkeep\n\na"), (1, "A\nb B\n a "), (3, "é x\nA\nÉ X"), (4, None), (5, ""), (None, "keep")]
    got = {r.doc_id: (r.n_units, list(zip(r.starts, r.ends)), r.kept) for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), least=1).collect()}
    assert got == {2: (4, [(0, 4), (11, 12)], "keep\n"), 1: (3, [(6, 9)], "A\nb B"), 3: (3, [(4, 5), (6, 9)], "é x"), 4: (1, [], ""), 5: (1, [], ""), None: (1, [(0, 4)], "")}
    assert line_dedup.dedup(odd).count() == odd.count() and line_dedup.dedup(none).count() == 0


def test_least_size_of_a_unit(spark):
    rows = [(1, "one two three\nfour five"), (2, "One two  three\nfour five\nsix"), (3, "four five")]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for least, want in ((2, {1: [], 2: [(0, 14), (15, 24)], 3: [(0, 9)]}), (3, {1: [], 2: [(0, 14)], 3: []}), (4, {1: [], 2: [], 3: []})):
        got = line_dedup.dedup(frame, least).collect()
        assert {r.doc_id: list(zip(r.starts, r.ends)) for r in got} == want
        assert {r.doc_id: r.n_repeated for r in got} == {2: {1: 2, 2: 2, 3: 1}, 3: {1: 1, 2: 1, 3: 0}, 4: {1: 0, 2: 0, 3: 0}}[least]


def test_passages_that_span_lines(spark):
    """Lines too short to go by themselves go with a paragraph that repeats."""
    rows = [(1, "start\n\np q\nr s\n \nend"), (2, "P  q\nr s\n\n\nother"), (3, "p q\nr s t"), (4, "r s\n\np q"), (5, "x\n\np q\nr s")]
    got = {r.doc_id: r for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id bigint, text string"), least=4).collect()}
    assert {i: (list(zip(r.starts, r.ends)), r.kept, r.n_repeated) for i, r in got.items()} == {
        1: ([], rows[0][1], 1), 2: ([(0, 4), (5, 8)], "\n\nother", 1), 3: ([], "p q\nr s t", 0), 4: ([], "r s\n\np q", 0), 5: ([(3, 6), (7, 10)], "x\n", 1),
    }


def test_a_frequent_line(spark, monkeypatch):
    """Frequent digests are broadcast, all others shuffled; both ways give the same rows."""
    rows = [(i, f"hot line here\nown line {i}\nshared line {i // 2}") for i in range(300)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    want = {i: ([] if i == 0 else [0]) + ([2] if i % 2 else []) for i in range(300)}
    for bound in (5, 5000):
        monkeypatch.setattr(common, "FREQUENT", bound)
        got = line_dedup.dedup(frame, least=2).collect()
        lines = {r.doc_id: [rows[r.doc_id][1][:s].count("\n") for s in r.starts] for r in got}
        assert lines == want


def test_items_in_documents(spark, odd, none, monkeypatch):
    draw = random.Random(4)
    word = lambda: draw.choice("abcdefghijklmnop") * draw.randint(1, 4)
    items = {k: " ".join(word() for _ in range(draw.choice([0, 2, 4, 7, 12, 30, 60, 130]))) for k in range(60)}
    docs = {}
    for i in range(120):
        parts = [word() for _ in range(draw.choice([0, 3, 40, 900]))]
        if i % 2:
            own = items[draw.randrange(60)].split(" ")
            for _ in range(draw.randint(0, 2)):
                own[draw.randrange(len(own))] = word()
            at = draw.randrange(len(parts) + 1)
            parts[at:at] = own
        docs[i] = " ".join(parts)
    monkeypatch.setattr(decontaminate, "BLOCK_GRAMS", 500)  # several passes
    frame, known = spark.createDataFrame(list(docs.items()), "doc_id bigint, text string"), spark.createDataFrame([*items.items(), (99, None)], "item_id bigint, text string")
    got = {(r.doc_id, r.item_id, r.n_grams, r.n_found) for r in decontaminate.search(frame, known).collect()}
    assert got == brute.contained(docs, items) and len(got) > 20
    left = {r.doc_id for r in decontaminate.clean(frame, known).collect()}
    assert left == set(docs) - {g[0] for g in got}
    assert decontaminate.search(odd, known).count() == 0 and decontaminate.clean(odd, known).count() == odd.count()
    assert decontaminate.search(none, known).count() == 0 and decontaminate.search(odd, known.limit(0)).count() == 0


def test_licences(spark, odd, none):
    draw = random.Random(2)
    filler = lambda n: " ".join("".join(draw.choice("eaiést") for _ in range(4)) for _ in range(n))
    docs, want = {}, set()
    for i, (name, text) in enumerate(TEMPLATES.items()):
        docs[2 * i] = f"{filler(9)}\n{text} {filler(5)}"
        docs[2 * i + 1] = filler(3) + "\n  " + re.sub(r"\s", "\n * ", text.upper()) + "\n" + filler(3)
        want |= {(2 * i, name, 1.0), (2 * i + 1, name, 1.0)}
    docs[900] = "Permission is hereby granted to nobody, free of nothing."
    long = TEMPLATES["mit"].split(" ")
    docs[901] = " ".join(w for k, w in enumerate(long) if k % 12)  # one word of twelve is missing
    got = license_scan.scan(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()
    assert want <= {(r.doc_id, r.template, r.coverage) for r in got}
    for r in got:
        plain = lambda t: re.sub(r"[\W_]+", " ", t.lower()).split()
        span, own = plain(docs[r.doc_id][r.start : r.end]), plain(TEMPLATES[r.template])
        assert r.coverage == r.n_matched / len(own) >= 0.8
        if r.coverage == 1:
            assert span == own
    edited = [r for r in got if r.doc_id == 901]
    assert [r.template for r in edited] == ["mit"] and edited[0].coverage < 1 and not [r for r in got if r.doc_id == 900]
    assert license_scan.scan(odd).count() == 0 and license_scan.scan(none).count() == 0
    with pytest.raises(ValueError):
        license_scan.scan(odd, {"x": "short"})


def test_licences_on_successive_lines(spark):
    """Every copy of a notice is a place of its own, however near the next one is."""
    docs, want = {}, set()
    for i, name in enumerate(sorted(TEMPLATES)):
        docs[i] = "\n".join([TEMPLATES[name]] * 30)
        want |= {(i, name, 1.0, k * (len(TEMPLATES[name]) + 1)) for k in range(30)}
    docs[50] = "\n".join(f"lib{k}\nReleased under the MIT License." if k % 3 else "Released under the new MIT License" for k in range(1000))
    want |= {(50, "mit-notice", 1.0, m.start()) for m in re.finditer("Released", docs[50])}
    words = TEMPLATES["mit"].split(" ")
    docs[51] = " ".join([*words, *words[:60], *words, *(w for k, w in enumerate(words) if k % 12), *words])
    found = license_scan.scan(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()
    got = [(r.doc_id, r.template, r.coverage, r.start) for r in found]
    assert len(got) == len(set(got))
    assert want == {g for g in got if g[0] == 50 or g[0] < 50 and g[1] == sorted(TEMPLATES)[g[0]]}
    assert [g[2] < 1 for g in sorted(got, key=lambda g: g[3]) if g[0] == 51] == [False, False, True, False]
    for i in docs:
        for name in TEMPLATES:
            spans = sorted((r.start, r.end) for r in found if (r.doc_id, r.template) == (i, name))
            assert all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))


def test_licences_are_whole(spark):
    ends = {"mit": "OTHER DEALINGS IN THE SOFTWARE.", "isc": "PERFORMANCE OF THIS SOFTWARE.", "bsd-2-clause": "POSSIBILITY OF SUCH DAMAGE."}
    docs = {}
    for i, (name, end) in enumerate(ends.items()):
        assert TEMPLATES[name].endswith(end)
        docs[2 * i], docs[2 * i + 1] = TEMPLATES[name] + " code", re.split('THE SOFTWARE IS|THIS SOFTWARE IS', TEMPLATES[name])[0] + "code"
    got = license_scan.scan(spark.createDataFrame(list(docs.items()), "doc_id bigint, text string")).collect()
    assert {(r.doc_id, r.template, r.coverage) for r in got} == {(2 * i, name, 1.0) for i, name in enumerate(ends)}
    assert all(docs[r.doc_id][r.end :] == ". code" for r in got)
    assert {n for n in TEMPLATES if n.startswith(("apache", "gpl", "mpl")) and not n.endswith(("-notice", "-header"))} == set()


def test_a_row_that_is_there_many_times(spark):
    """Its copies share one set of spans: time grows with the rows, not with their square."""
    import time

    text = " ".join(f"word{i * 7919 % 10007}" for i in range(3000))
    took = {}
    for n in (250, 2000):
        frame = spark.createDataFrame([(1, text)] * n + [(2, "short")], "doc_id bigint, text string")
        began = time.time()
        rows = suffix_dedup.remove_repeats(frame).select("n_bytes", F.size("starts").alias("spans"), F.length("kept").alias("kept")).collect()
        took[n] = time.time() - began
        assert sorted(map(tuple, rows)) == [(5, 0, 5)] + [(len(text), 1, 0)] * n
    assert took[2000] < 12 * took[250] + 10
