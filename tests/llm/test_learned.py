"""Quality rules against brute force; classifiers by held-out accuracy; the pipeline."""

import math
from collections import Counter

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from loadaudit.llm import language_id, ngram_join, quality_crf, quality_rules
from loadaudit.llm.queries import QUERIES

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SMALL}/documents.parquet")


def test_rules_against_brute_force(spark, docs):
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    rows = {r.doc_id: r.text for r in docs.collect()}
    good = {r.doc_id for r in labels.filter("quality = 1").collect()} - {r.doc_id for r in labels.filter("quality = 0").collect()}
    size = quality_rules.BUCKETS
    raw, trusted = Counter(), Counter()
    own = {i: brute.buckets(t, size) for i, t in rows.items()}
    for i, b in own.items():
        raw.update(b)
        trusted.update(b if i in good else ())
    total = (sum(raw.values()) + size) / (sum(trusted.values()) + size)
    weight = [round(1e6 * (math.log(trusted[k] + 1) - math.log(raw[k] + 1) + math.log(total))) for k in range(size)]
    for r in quality_rules.judge(docs, labels).collect():
        counts = brute.base_counts(rows[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 20 or 100 * counts[4] > 30 * counts[0])
        score = sum(weight[b] for b in own[r.doc_id]) / len(own[r.doc_id]) / 1e6 if own[r.doc_id] else 0
        assert abs(r.score - score) < 1e-5 and r.kept == (not r.base_failed and r.score >= quality_rules.THRESHOLD)


def test_rules_have_no_python_in_their_plan(docs, spark):
    plan = quality_rules.judge(docs, spark.read.parquet(f"{SMALL}/labels.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Arrow", "Python", "Pandas"))


def test_odd_rows_of_the_rules(spark, odd, none):
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, None), (2, None, 0)], "doc_id bigint, quality int, toxic int")
    out = {r.doc_id: r for r in quality_rules.judge(odd, labels).collect()}
    assert out[3].base_failed and out[3].n_words == 0 and out[10].base_failed and not out[1].base_failed
    kept = quality_rules.keep(odd, labels)
    assert kept.columns == odd.columns and kept.filter("doc_id = 1").count() == 2
    assert quality_rules.judge(none, labels.limit(0)).count() == 0


def test_quality_on_held_out_documents(spark):
    out = QUERIES["op3_quality_crf"](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/labels.parquet"), "doc_id").filter("held_out")
    assert out.filter("predicted = quality").count() >= 0.97 * out.count() > 50


def test_field_marginals_equal_enumeration():
    draw = np.random.default_rng(1)
    at, e, move, begin = np.array([0, 4, 5, 8]), draw.normal(size=8), draw.normal(size=(2, 2)), draw.normal(size=2)
    a, b = quality_crf.forward_backward(e, at, move, begin)
    got = 1 / (1 + np.exp((a + b)[:, 0] - (a + b)[:, 1]))
    for x, y in zip(at[:-1], at[1:]):
        n, p = y - x, np.zeros(y - x)
        total = 0
        for k in range(1 << n):
            s = [k >> t & 1 for t in range(n)]
            w = math.exp(begin[s[0]] + sum(e[x + t] * s[t] for t in range(n)) + sum(move[s[t], s[t + 1]] for t in range(n - 1)))
            total += w
            p += w * np.array(s)
        assert np.allclose(got[x:y], p / total)


def test_odd_rows_of_the_classifiers(spark, odd, none):
    field = quality_crf.train(odd, spark.createDataFrame([(1, 1), (10, 0), (None, 1), (8, None)], "doc_id bigint, quality int"), F.lit(True))
    out = quality_crf.score(odd, field)
    assert out.count() == odd.count() and out.filter("score is null or score < 0 or score > 1").count() == 0
    assert quality_crf.score(none, field).count() == 0
    empty = quality_crf.train(none, spark.createDataFrame([], "doc_id bigint, quality int"), F.lit(True))
    assert quality_crf.score(odd, empty).count() == odd.count()
    learned = language_id.dictionaries(odd, F.lit(True))
    assert set(learned) == {"en", "de", "fr"}
    got = {(r.doc_id, r.lang_pred) for r in language_id.predict(odd, learned).collect()}
    assert {(3, "und"), (4, "und"), (5, "und"), (9, "und")} <= got and language_id.predict(none, learned).count() == 0
    assert {r.lang_pred for r in language_id.predict(odd, {}).collect()} == {"und"}


def test_language_of_held_out_documents(spark):
    out = QUERIES["op6_language_id"](spark, MIDDLE).join(spark.read.parquet(f"{MIDDLE}/documents.parquet"), "doc_id").filter("held_out")
    assert out.filter("lang_pred = lang").count() >= 0.97 * out.count()


def test_pipeline_against_brute_force(spark, docs):
    """Every stage is replayed in Python on what the stage before it kept."""
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    kept = {r.doc_id for r in quality_rules.judge(docs, labels).filter("kept").collect()}
    now = {r.doc_id: r.text for r in docs.collect() if r.doc_id in kept}
    top = brute.classes(now, brute.links(now))
    now = {i: t for i, t in now.items() if top[i] == i}
    now = {i: d[~gone].tobytes().decode(errors="ignore") for i, (d, gone) in zip(now, brute.repeats(now.values(), 200))}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()}
    dirty = {h[0] for h in brute.contained(now, items)}
    now = {i: t for i, t in now.items() if i not in dirty}
    frame = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = corpus_pipeline.cut(stage(spark, frame, SMALL), name)
        assert frame.columns == docs.columns
    assert {r.doc_id: r.text for r in frame.collect()} == now
    out = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id for r in out} == set(now) and all(r.length == len(r.ids) // 4 for r in out)


def test_one_row_of_repeated_rows_stays(spark, odd):
    out = corpus_pipeline.one_of_each(spark, odd, SMALL)
    assert out.columns == odd.columns
    assert sorted(str(r.doc_id) for r in out.collect()) == sorted("1 3 4 5 6 7 7 8 9 10 11 12 None".split())
    assert ngram_join.join(odd).filter("class_id is null").count() == 0


def test_languages_behind_the_same_header(spark):
    """Dictionaries hold more of a text than its beginning, and whole characters."""
    draw = np.random.default_rng(3)
    header = " ".join(f"header{k} of every document" for k in range(80)) + "\n"
    known = {lang: ["".join(draw.choice(list(letters), draw.integers(3, 8))) for _ in range(60)] for lang, letters in (("aa", "abcdeé"), ("bb", "uvwxyü"))}
    text = lambda lang: " ".join(draw.choice(known[lang], 400))
    rows = [(k, header + text(lang), lang) for k, lang in enumerate(["aa", "aa", "bb"] * 40)]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    learned = language_id.dictionaries(frame, F.lit(True))
    assert all(len(d) <= language_id.DICTIONARY_BYTES and d.decode() for d in learned.values())
    asked = spark.createDataFrame([(k, text(lang), lang) for k, lang in enumerate(["aa", "bb"] * 10)], "doc_id bigint, text string, lang string")
    got = language_id.predict(asked, learned).join(asked, "doc_id").collect()
    assert len(got) == 20 and all(r.accepted and r.lang_pred == r.lang for r in got)
