"""Rows at ranks and medians against sorted lists, with buckets refined over several rounds."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from vigil.operators.evaluation import chrono_split
from vigil.operators.ranks import medians, rows_at


def table(spark, rows):
    return spark.createDataFrame(rows, "k string, v long, t string").repartition(4)


@pytest.mark.parametrize("most", [5, 100_000])
def test_rows_at_equals_sorting(spark, most):
    rng = random.Random(4)
    rows = [("hot", int(10 ** rng.uniform(0, 15)), f"t{i:04d}") for i in range(500)] + [("same", 7, f"t{i:03d}") for i in range(60)]
    rows += [("one", 3, "x"), ("null", None, "x"), ("few", 2, "b"), ("few", 2, "a"), ("few", 1, "c")]
    ranks = {"low": lambda n: F.floor(n * 0.1), "mid": lambda n: F.floor(n / 2), "last": lambda n: n - 1, "none": lambda n: n}
    got = {(r.k, r.name): (r.v, r.t, r.total) for r in rows_at(table(spark, rows), ["k"], "v", ranks, "t", most).collect()}
    want = {}
    for k in ("hot", "same", "one", "few"):
        own = sorted((v, t) for g, v, t in rows if g == k)
        n = len(own)
        for name, at in (("low", n // 10), ("mid", n // 2), ("last", n - 1)):
            want[k, name] = (*own[at], n)
    assert got == want


@pytest.mark.parametrize("most", [4, 100_000])
def test_medians(spark, most):
    rng = random.Random(5)
    rows = [(rng.choice("ab"), rng.choice([rng.random() * 1000, 5.0, -3.0])) for _ in range(300)] + [("c", 1.0), ("d", None), ("e", 1.0), ("e", 2.0)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r.k: (r.median, r.mad, r.samples) for r in medians(df, ["k"], "v", most).collect()}
    want = {}
    for k in "abce":
        own = [v for g, v in rows if g == k]
        centre = statistics.median(own)
        want[k] = (centre, statistics.median(abs(v - centre) for v in own), len(own))
    assert got == want
    assert medians(df.limit(0), ["k"], "v").count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 7, 100])
def test_split_by_time_keeps_its_shares(spark, n):
    rows = [("x", i // 3, f"t{i:03d}") for i in range(n)]
    got = {r.t: r.split for r in chrono_split(table(spark, rows), "v", "t").collect()}
    order = sorted(got)
    train, dev = int(n * 0.65 // 1), int(n * 0.82 // 1)
    assert [got[t] for t in order] == ["train"] * train + ["validation"] * (dev - train) + ["test"] * (n - dev)
