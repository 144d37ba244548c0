"""The conditional random field against enumeration, numeric slopes and held-out accuracy."""

import itertools
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigil.llm import language_crf as lc
from vigil.llm import textbuf as tb

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    return lc.train(docs, may_learn=F.crc32(F.col("doc_id").cast("string")) % 3 != 1)


def by_enumeration(e, start, moves):
    n, k = e.shape
    p = np.zeros((n, k))
    for y in itertools.product(range(k), repeat=n):
        score = start[y[0]] + sum(e[i, y[i]] for i in range(n)) + sum(moves[y[i], y[i + 1]] for i in range(n - 1))
        for i in range(n):
            p[i, y[i]] += np.exp(score)
    return p / p.sum(1, keepdims=True)


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(1)
    start, moves = rng.standard_normal(3), rng.standard_normal((3, 3))
    lengths = [0, 5, 1, 0, 7, 2]
    firsts = np.cumsum([0, *lengths])
    e = 2 * rng.standard_normal((firsts[-1], 3))
    got = lc.marginals(e, firsts, start, moves)
    for a, b in zip(firsts, firsts[1:]):
        if b > a:
            assert np.abs(got[a:b] - by_enumeration(e[a:b], start, moves)).max() < 1e-12


def test_long_chains_go_on_over_blocks():
    rng = np.random.default_rng(2)
    start, moves = rng.standard_normal(2), np.array([[3.0, -3.0], [-3.0, 3.0]])
    lengths = [200, 33, 32, 31, 1, 3000]
    firsts = np.cumsum([0, *lengths])
    e = rng.standard_normal((firsts[-1], 2))
    got = lc.marginals(e, firsts, start, moves)
    for a, b in zip(firsts, firsts[1:]):
        ahead, behind = np.zeros((b - a, 2)), np.zeros((b - a, 2))
        ahead[0] = start + e[a]
        for t in range(1, b - a):
            ahead[t] = np.logaddexp(*(ahead[t - 1][:, None] + moves)) + e[a + t]
        for t in range(b - a - 2, -1, -1):
            behind[t] = np.logaddexp(*(moves + e[a + t + 1] + behind[t + 1]).T)
        both = ahead + behind
        want = np.exp(both - both.max(1, keepdims=True))
        assert np.abs(got[a:b] - want / want.sum(1, keepdims=True)).max() < 1e-9


def test_slopes_of_the_likelihood():
    rng = np.random.default_rng(3)
    e, y, start, moves = rng.standard_normal((4, 6, 3)), rng.integers(0, 3, (4, 6)), rng.standard_normal(3), rng.standard_normal((3, 3))
    _, by_word, by_start, by_move = lc.chain_loss(e, y, start, moves)
    for values, slopes in ((e, by_word), (start, by_start), (moves, by_move)):
        for at in np.ndindex(values.shape):
            old = values[at]
            values[at] = old + 1e-6
            up = lc.chain_loss(e, y, start, moves)[0]
            values[at] = old - 1e-6
            down = lc.chain_loss(e, y, start, moves)[0]
            values[at] = old
            assert abs((up - down) / 2e-6 - slopes[at]) < 1e-6


def test_words_are_runs_of_letters():
    text = "Don't ÀB ét 42 x" + "y" * 60 + " 日本"
    raw = text.encode()
    w = lc.words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
    got = ["".join(map(chr, w.points[a:b])) for a, b in zip(w.starts, w.ends)]
    assert got == ["don", "t", "àb", "ét", "x" + "y" * 23, "y" * 24, "y" * 13, "日本"]


def test_held_out_accuracy(spark, model):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = lc.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.lang is not None and crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(held) > 200 and sum(r.lang == r.lang_pred for r in held) / len(held) > 0.98
    assert all(0 <= r.score <= 1 for r in rows)


def test_labels_switch_inside_a_text(spark, model):
    """Stretches of two languages joined in one text are told apart word by word."""
    by = {}
    for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("crc32(cast(doc_id as string)) % 3 = 1 and length(text) > 400").orderBy("doc_id").collect():
        by.setdefault(r.lang, " ".join(r.text.split()[:40]))
    first, second = sorted(k for k in by if k)[:2]
    text = f"{by[first]} {by[second]} {by[first]}"
    spans = lc.language_spans(spark.createDataFrame([(1, text), (2, "12 !"), (3, None)], "doc_id long, text string"), model).collect()
    got = {r.doc_id: r.spans for r in spans}
    truth = np.array([first] * len(by[first]) + [None] + [second] * len(by[second]) + [None] + [first] * len(by[first]))
    right = sum(sum(truth[x.start : x.end] == x.lang) for x in got[1])
    assert right / len(text) > 0.95 and len(got[1]) >= 3 and got[2] == [] and got[3] == []
    assert [x.start for x in got[1]] == sorted(x.start for x in got[1]) and sum(x.words for x in got[1]) > 60


def test_rows_edges_and_repeats(spark, model):
    rows = [(1, None, "x"), (2, "", "x"), (3, "1 2 ,", "x"), (None, "the and of thing", "x"), (4, "the and of thing", None), (4, "the and of thing", None), (5, "́", "x")]
    got = lc.predict(spark.createDataFrame(rows, "doc_id long, text string, score string").repartition(3), model).collect()
    assert len(got) == len(rows)
    assert {r.lang_pred for r in got if r.doc_id in (1, 2, 3, 5)} == {"und"} and {r.score for r in got if r.doc_id in (1, 2, 3, 5)} == {0.0}
    assert len({(r.lang_pred, r.score) for r in got if r.doc_id in (None, 4)}) == 1
    assert lc.predict(spark.createDataFrame([], "doc_id long, text string"), model).count() == 0


def test_nothing_or_one_language_to_learn(spark):
    schema = "doc_id long, text string, lang string, score int"
    none = spark.createDataFrame([(1, "abc", None, 1), (2, None, "en", 1)], schema)
    texts = spark.createDataFrame([(1, "abc"), (2, "7")], "doc_id long, text string")
    assert {r.lang_pred for r in lc.predict(texts, lc.train(none)).collect()} == {"und"}
    one = spark.createDataFrame([(1, "abc def", "en", 1), (1, "abc def", "en", 1), (2, "", "fr", 1)], schema)
    assert {(r.doc_id, r.lang_pred, r.score) for r in lc.predict(texts, lc.train(one)).collect()} == {(1, "en", 1.0), (2, "und", 0.0)}


def test_a_long_text_in_panels_has_the_same_language(spark, model, monkeypatch):
    text = " ".join(r.text for r in spark.read.parquet(f"{DIR}/documents.parquet").where("lang = 'fr'").limit(20).collect())
    data = np.frombuffer(text.encode(), np.uint8)
    whole = lc._posteriors(model, data, np.array([0, len(data)]))
    monkeypatch.setattr(tb, "SLICE_BYTES", 4096)
    parts = lc._posteriors(model, data, np.array([0, len(data)]))
    for a, b in zip(whole, parts):
        assert np.allclose(a, b, atol=1e-9)
