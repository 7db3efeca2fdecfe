"""Periodic runs against trying every period."""

import hashlib
import random
import zlib

import brute
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from loadaudit.llm import periodic_runs, queries

SF = "/root/testdata/sf0.001"


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=60), st.sampled_from([2, 4, 12]))
def test_every_run_of_small_alphabets(words, least):
    assert periodic_runs.runs_of(words, least) == brute.runs(words, least)


@pytest.mark.parametrize("period", [1, 2, 7, 40])
def test_one_long_run(period):
    words = [-1, *[i % period for i in range(400)], -2]
    assert periodic_runs.runs_of(words) == [(1, 400, period)]


def test_runs_that_overlap_share_words():
    words = list("ab" * 8) + list("bc" * 8) + list("abcabd" * 3)
    assert periodic_runs.runs_of(words) == brute.runs(words)


def test_strings_of_fibonacci_hold_many_runs():
    a, b = "0", "01"
    while len(b) < 900:
        a, b = b, b + a
    found = periodic_runs.runs_of(list(b), 2)
    assert found == brute.runs(b, 2) and len(found) > 200


def check(rows, texts):
    for row, text in zip(rows, texts, strict=True):
        words = brute.words(text)
        runs = brute.runs(words)
        assert row.n_words == len(words)
        assert [tuple(r) for r in row.runs] == runs
        assert row.collapsed == brute.collapsed(words, runs)


def test_random_texts_with_repeats(spark):
    r = random.Random(5)
    texts = []
    for _ in range(120):
        words = [r.choice("one two three vier fünf six".split()) for _ in range(r.randrange(80))]
        for _ in range(r.randrange(3)):
            i = r.randrange(len(words) + 1)
            words[i:i] = words[i : i + r.randrange(1, 9)] * r.randrange(1, 9)
        texts.append(r.choice([" ", "\n", " \t"]).join(words))
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    check(periodic_runs.find(frame).orderBy("doc_id").collect(), texts)


def test_odd_tables(odd, none):
    rows = periodic_runs.find(odd).collect()
    assert len(rows) == odd.count()
    by_id = {}
    for r in rows:
        by_id.setdefault(r.doc_id, []).append(r)
    assert by_id[3][0].n_words == 0 and by_id[3][0].runs == [] and by_id[3][0].collapsed == ""
    assert by_id[1][0] == by_id[1][1]
    assert [tuple(x) for x in by_id[10][0].runs] == [(0, 3000, 1)] and by_id[10][0].collapsed == "ab"
    assert len(by_id[None]) == 2
    assert [tuple(x) for x in by_id[6][0].runs] == []  # 977 * 131 words apart before it repeats
    assert periodic_runs.find(none).collect() == []


def test_columns_of_any_name(spark):
    frame = spark.createDataFrame([(1, "a b " * 10, "x")], "`my.id` bigint, `the.text` string, doc_id string")
    row = periodic_runs.find(frame, id_col="`my.id`", text_col="`the.text`").first()
    assert (row.doc_id, [tuple(r) for r in row.runs], row.collapsed) == (1, [(0, 20, 2)], "a b")


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.QUERIES["op11_periodic_runs"](spark, SF).collect()}
    assert len(got) == len(docs)
    for doc_id, text in docs:
        words = brute.words(text)
        n, h = len(words), zlib.crc32(str(doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute.runs(words)
        top = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None, None, None))
        r = got[doc_id]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *top)
        assert r.exponent_milli == (1000 * top[1] // top[2] if runs else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(brute.collapsed(words, runs).encode()).hexdigest()
