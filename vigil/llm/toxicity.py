"""Toxicity by a linear model over character n-grams scaled with naive Bayes log-count ratios.

A text is the set of its 3- to 6-character n-grams (A-Z lower-cased, white space as one space), hashed to
buckets.  Counts over the labelled sample give each bucket the ratio r = log(share among toxic / share among clean);
the buckets that separate the labels best stay, and a logistic regression is fitted on presence * r.  A text's
score is the logistic function of its weights' sum.  Scoring is vectorised over the Arrow buffer.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.storage import cut
from vigil.llm import textbuf as tb

SIZES = (3, 4, 5, 6)
BITS = 20
SPACED = np.where(tb.NOT_SPACE, tb.LOWER, np.uint8(32)).astype(np.uint8)


def buckets(data: np.ndarray, offsets: np.ndarray):
    """For each n-gram size (bucket of each position, last position + 1 allowed) over code points, and the texts' offsets."""
    leads = np.zeros(len(data) + 1, np.int64)
    np.cumsum(tb.LEADS[data], out=leads[1:])
    at = leads[offsets]
    points = np.frombuffer(SPACED[data].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) != leads[-1]:  # broken bytes: fall back to the bytes themselves
        points, at = SPACED[data].astype(np.uint32), offsets
    found = []
    h = np.zeros(len(points), np.uint32)
    for n in range(1, max(SIZES) + 1):
        if len(points) < n:
            break
        h = h[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] + np.uint32(0x9E37)
        if n in SIZES:
            found.append((n, (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA6B) >> np.uint32(32 - BITS)))
    return found, at


def present(data: np.ndarray, offsets: np.ndarray, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) pairs, each once, of the buckets for which ``wanted`` holds (all, if None)."""
    found, at = buckets(data, offsets)
    pairs = []
    for n, values in found:
        pos = np.arange(len(values)) if wanted is None else np.flatnonzero(wanted[values])
        own = np.searchsorted(at, pos, "right") - 1
        inside = pos + n <= at[own + 1]
        pairs.append((own[inside] << BITS) | values[pos[inside]])
    pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
    return pairs >> BITS, pairs & ((1 << BITS) - 1)


@dataclass(frozen=True)
class Model:
    """Weights of the chosen buckets and the intercept."""

    chosen: np.ndarray
    weights: np.ndarray
    intercept: float

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        dense = np.zeros(1 << BITS)
        dense[self.chosen] = self.weights
        return self.scores_with(dense, data, offsets)

    def scores_with(self, dense: np.ndarray, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        text, bucket = present(data, offsets, dense != 0)
        z = self.intercept + np.bincount(text, dense[bucket], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def _lbfgs(loss, x: np.ndarray, rounds: int = 200, memory: int = 10) -> np.ndarray:
    """Minimises a smooth convex loss (value and gradient) with limited-memory quasi-Newton steps."""
    f, g = loss(x)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        if np.abs(g).max() < 1e-6:
            break
        q, kept = g.copy(), []
        for s, y in reversed(past):
            a = s @ q / (y @ s)
            q -= a * y
            kept.append(a)
        if past:
            s, y = past[-1]
            q *= (s @ y) / (y @ y)
        for (s, y), a in zip(past, reversed(kept)):
            q += s * (a - y @ q / (y @ s))
        step = 1.0
        while True:
            new = x - step * q
            f_new, g_new = loss(new)
            if f_new <= f - 1e-4 * step * (g @ q) or step < 1e-10:
                break
            step /= 2
        if step < 1e-10:
            break
        s, y = new - x, g_new - g
        if s @ y > 1e-12:
            past = [*past[-memory + 1 :], (s, y)]
        x, f, g = new, f_new, g_new
    return x


def fit(rows: np.ndarray, columns: np.ndarray, y: np.ndarray, ratio: np.ndarray, penalty: float) -> tuple[np.ndarray, float]:
    """Weights (times ratio) and intercept of a logistic regression on presence * ratio; classes weigh the same."""
    value = ratio[columns]
    share = np.where(y, 0.5 / max(y.sum(), 1), 0.5 / max((~y).sum(), 1)) * len(y)

    def loss(w):
        z = np.bincount(rows, value * w[columns], len(y)) + w[-1]
        p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
        f = (share * (np.logaddexp(0, z) - y * z)).sum() + penalty / 2 * (w[:-1] @ w[:-1])
        e = share * (p - y)
        g = np.append(np.bincount(columns, e[rows] * value, len(ratio)) + penalty * w[:-1], e.sum())
        return f / len(y), g / len(y)

    w = _lbfgs(loss, np.append(np.ones(len(ratio)), 0.0))
    return w[:-1] * ratio, float(w[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", id: str = "doc_id", text: str = "text", may_learn: Column | None = None,
          rows_each: int = 4_000, features: int = 4_000, smoothing: float = 1.0, penalty: float = 10.0) -> Model:
    """Learns from a bounded sample of labels: of each class the ``rows_each`` keys with the smallest hash.

    Null keys and labels, keys without a document and keys for which ``may_learn`` (a condition on ``id``) fails are left
    out.  With only one class the model is that class's constant prior.
    """
    own = labels.where(F.col(id).isNotNull() & F.col(label).isNotNull())
    own = own if may_learn is None else own.where(may_learn)
    own = own.groupBy(F.col(id).alias("__id")).agg(F.max((F.col(label) > 0).cast("int")).alias("__y"))
    parts = [own.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(rows_each) for y in (0, 1)]
    sample = F.broadcast(parts[0].union(parts[1]))
    rows = docs.select(F.col(id).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__t")).join(sample, "__id")
    rows = rows.groupBy("__id", "__y").agg(F.min("__t").alias("__t")).select("__y", "__t", "__id")

    def count(batches):
        total = np.zeros((2, 1 << BITS), np.int64)
        seen = np.zeros(2, np.int64)
        for batch in batches:
            y = batch.column(0).to_numpy()
            for lo, hi, data, offsets in tb.slices(batch.column(1)):
                text_of, bucket = present(data, offsets, None)
                np.add.at(total, (y[lo:hi][text_of], bucket), 1)
                seen += np.bincount(y[lo:hi], minlength=2)
        at = np.flatnonzero(total.sum(0))
        yield pa.RecordBatch.from_arrays([
            pa.array(np.append(at, -1)), pa.array(np.append(total[0, at], seen[0])), pa.array(np.append(total[1, at], seen[1]))], names=["bucket", "clean", "toxic"])

    counts = cut(rows.mapInArrow(count, "bucket long, clean long, toxic long").groupBy("bucket").agg(F.sum("clean").alias("q"), F.sum("toxic").alias("p")), "grams")
    seen = counts.where("bucket < 0").agg(F.coalesce(F.sum("q"), F.lit(0)).alias("q"), F.coalesce(F.sum("p"), F.lit(0)).alias("p")).first()
    n_clean, n_toxic = int(seen.q), int(seen.p)
    if not n_clean or not n_toxic:
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log((n_toxic + 1) / (n_clean + 1))))
    share_p, share_q = F.col("p") / float(n_toxic), F.col("q") / float(n_clean)
    pooled = (share_p + share_q) / 2
    worth = F.pow(share_p - share_q, 2) / F.greatest(pooled * (1 - pooled), F.lit(1e-6))
    best = counts.where("bucket >= 0").orderBy(worth.desc(), "bucket").limit(features).toPandas()
    p, q = best.p.to_numpy(float), best.q.to_numpy(float)
    ratio = np.log((p + smoothing) / (n_toxic + 2 * smoothing)) - np.log((q + smoothing) / (n_clean + 2 * smoothing))
    chosen = best.bucket.to_numpy()
    wanted = np.zeros(1 << BITS, bool)
    wanted[chosen] = True
    slot = np.zeros(1 << BITS, np.int32)
    slot[chosen] = np.arange(len(chosen), dtype=np.int32)

    def select(batches):
        for batch in batches:
            for lo, hi, data, offsets in tb.slices(batch.column(1)):
                text_of, bucket = present(data, offsets, wanted)
                ends = np.searchsorted(text_of, np.arange(hi - lo + 1))
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(lo, hi - lo), batch.column(2).slice(lo, hi - lo),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(slot[bucket]))], names=["y", "id", "x"])

    data = rows.mapInArrow(select, "y int, id long, x array<int>").toPandas().sort_values("id", ignore_index=True)
    lengths = data.x.map(len).to_numpy()
    columns = np.concatenate([np.asarray(x, np.int32) for x in data.x]).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
    weights, intercept = fit(np.repeat(np.arange(len(data)), lengths), columns, data.y.to_numpy() == 1, ratio, penalty)
    return Model(chosen, weights, intercept)


def score(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and score (0 to 1) of every row; a null or empty text gets the intercept's score, equal texts equal scores."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        dense = np.zeros(1 << BITS)
        dense[own.chosen] = own.weights
        for batch in batches:
            for lo, hi, data, offsets in tb.slices(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(own.scores_with(dense, data, offsets))], names=["id", "score"])

    return docs.select(F.col(id).cast("long"), text).mapInArrow(run, "id long, score double").withColumnRenamed("id", id)


def fold(id: str, parts: int) -> Column:
    return F.coalesce(F.crc32(F.col(id).cast("string")) % parts, F.lit(0))


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), may_learn=fold("doc_id", 3) != 1)
    return score(docs, model).select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))
