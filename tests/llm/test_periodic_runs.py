"""Periodic runs against brute force over all periods."""

import hashlib
import random
from fractions import Fraction
from zlib import crc32

import numpy as np
import pytest

from vigil.llm import periodic_runs as pr

DIR = "/root/testdata/sf0.001"


def all_runs(words, least=6, exponent=4):
    out = {}
    for q in range(1, len(words) // exponent + 1):
        i = 0
        while i + q < len(words):
            s = i
            while i + q < len(words) and words[i] == words[i + q]:
                i += 1
            if i - s + q >= max(least, exponent * q):
                out.setdefault((s, i - s + q), q)
            i += 1
    return sorted((s, q, n) for (s, n), q in out.items())


def collapsed(words, runs):
    gone = {i for s, q, n in runs for i in range(s + q, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic(seed):
    rng, words = random.Random(seed), []
    for _ in range(rng.randint(1, 6)):
        unit = [f"w{rng.randint(0, rng.choice([1, 2, 50]))}" for _ in range(rng.randint(1, rng.choice([2, 5, 40])))]
        words += unit * rng.randint(1, 9) + unit[: rng.randint(0, len(unit))]
    return words


def test_z_function():
    assert pr.z_function([]) == []
    for seed in range(50):
        s = [random.Random(seed * 99 + i).randint(0, 1) for i in range(30)]
        want = [next((k for k in range(30 - i) if s[k] != s[i + k]), 30 - i) for i in range(30)]
        assert pr.z_function(s) == want


@pytest.mark.parametrize("least, exponent", [(6, 4), (6, 3), (20, 5), (2, 3)])
def test_tiles_hold_every_run(least, exponent):
    """Tiles, Z-functions and stitching of single texts without Spark."""
    for seed in range(200):
        words = periodic(seed)
        hashes = np.array([hash((w, 3)) & (2**63 - 1) for w in words], np.uint64)
        pieces = {}
        for _, lo, first, numbers, at in pr.tiles(hashes, np.array([0, len(words)]), least, exponent):
            octave = next(o for o in pr.octaves(10**6, least, exponent) if o.lo == lo)
            assert len(numbers) <= octave.core + octave.grid + octave.reach
            for q, s, e in pr.solve(numbers.tolist(), at.tolist(), octave):
                pieces.setdefault(q, []).append((s + first, e + first))
        found = {}
        for q in sorted(pieces):
            whole = []
            for s, e in sorted(pieces[q]):
                if whole and s <= whole[-1][1]:
                    whole[-1][1] = max(whole[-1][1], e)
                else:
                    whole.append([s, e])
            for s, e in whole:
                if e - s + q >= max(least, exponent * q):
                    found.setdefault((s, e - s + q), q)
        assert sorted((s, q, n) for (s, n), q in found.items()) == all_runs(words, least, exponent)


def test_query_equals_brute_force(spark):
    got = {r.doc_id: r for r in pr.op13_periodic_runs(spark, DIR).collect()}
    docs = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    assert len(got) == len(docs)
    some = 0
    for d in docs:
        words = (d.text or "").encode().split()
        n, h = len(words), crc32(str(d.doc_id).encode())
        if n and h % 10 == 0:
            a, g = h // 10 % n, h // 10
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i if i < a else a + (i - a) % p] for i in range(n)]
        words = [w.decode() for w in words]
        runs, r = all_runs(words), got[d.doc_id]
        best = min(runs, key=lambda x: (-Fraction(x[2], x[1]), x[0], x[1]), default=None)
        some += len(runs)
        assert (r.n_words, r.n_runs) == (n, len(runs))
        assert (r.start, r.period, r.length) == (best or (None,) * 3)
        assert r.exponent_milli == (best and 1000 * best[2] // best[1])
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, q, m in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(collapsed(words, runs).encode()).hexdigest()
    assert some > 5


def test_rows_edges_and_general_form(spark):
    texts = [None, "", " \n\t", "a", " ".join(periodic(5)), "b " * 5, "b " * 6, "x\ty\n" * 40, "日本 語\x0b" * 9, " ".join(str(i) for i in range(500)) + " z" * 7, "c " * 30_000,
             " ".join(f"{i}" for i in range(4000)) * 1 + " " + " ".join(f"u{i}" for i in range(3000)) + (" " + " ".join(f"v{i}" for i in range(1500))) * 5]
    rows = [(i, t, "clash", 1) for i, t in enumerate(texts)] + [(None, "b " * 6, "clash", 1), (None, None, None, None), (4, texts[4], "clash", 1), (4, "b " * 7, "clash", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, row string, period long").repartition(3)
    got = sorted(((r.doc_id if r.doc_id is not None else -1, r.n_words, [(x.start, x.period, x.length) for x in r.runs], r.collapsed) for r in pr.find_runs(df).collect()))
    want = []
    for i, t, *_ in rows:
        words = (t or "").encode().split()
        words = [w.decode() for w in words]
        runs = all_runs(words) if len(words) < 5000 else ([(0, 1, 30_000)] if t[0] == "c" else [(7000, 1500, 7500)])
        want.append((-1 if i is None else i, len(words), runs, collapsed(words, runs)))
    assert got == sorted(want)
    assert pr.find_runs(df.limit(0)).count() == 0


def test_one_text_of_megabytes(spark):
    """A long text goes through panels and tiles of every octave."""
    unit = " ".join(f"word{i * 7919 % 100_003}" for i in range(40_000))
    text = "head " * 3 + " ".join([unit] * 5) + " tail"
    got = pr.find_runs(spark.createDataFrame([(1, text)], "doc_id long, text string"), want_text=False).collect()
    assert [(x.start, x.period, x.length) for x in got[0].runs] == [(3, 40_000, 200_000)]
    assert got[0].collapsed == hashlib.sha256(f"head head head {unit} tail".encode()).hexdigest()
