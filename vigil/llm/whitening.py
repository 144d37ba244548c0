"""Whitening of embeddings by the leading eigenvectors of their covariance, found by FEAST contour integration.

Entries become integers floor(scale * c) + shift, so counts and sums over all rows are exact.  The covariance (divisor n) is summed in
tasks from centred rows, one matrix a task, and added up by entry.

The spectrum is then cut into intervals.  The inertia of V - sI (signs of a pivoted LDL' factorisation) counts the eigenvalues
below s; shifts are refined until the intervals hold the leading components, a few each.  For each interval the resolvent
(zI - V)^-1 is integrated over a circle through the interval's ends by Gauss-Legendre quadrature, which
projects a block of vectors on the interval's eigenspace; Rayleigh-Ritz on the projected block gives eigenpairs, and rounds
go on until they settle.  An interval with other than its counted eigenvalues is solved anew with a larger block, so none is missed.
Shifts, and solves at the quadrature's nodes, are rows of Spark tables: tasks factor them, each from the broadcast matrix, whose
size depends on the dimension alone; only counts and blocks of a few columns return.

Defined results: rows with a null vector or with null, NaN or infinite entries are left out, and so are entries beyond 2**52 / scale, which no
exact integer holds.  Of vectors of different lengths those with the most frequent length stay (of ties the longer), as one
covariance needs one dimension; an empty vector never stays.  Repeated rows and ids count as often as they occur.  Eigenvalues that rounding cannot tell from 0 have no component
(constant dimensions, fewer rows than dimensions), so an empty table, a single row and equal rows give no rows.  Equal eigenvalues leave
their vectors' rotation open; signs are made unique by the largest entry.  A deviation beyond a long is null.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.storage import cut
from vigil.llm import textbuf as tb

#: Quadrature nodes on the upper half circle (the lower half is their conjugate), and eigenvalues that one interval holds, about.
NODES = 8
IN_INTERVAL = 6
#: Shifts of one round of counting.
SHIFTS = 32


def inertia(a: np.ndarray) -> tuple[int, int, int]:
    """Numbers of negative, zero and positive eigenvalues of a symmetric matrix, by LDL' with pivots of one or two rows."""
    a = np.array(a, float)
    n, k, count = len(a), 0, [0, 0, 0]
    grow = (1 + 17**0.5) / 8
    while k < n:
        own = a[k:, k:]
        diagonal = np.abs(np.diagonal(own))
        d = int(np.argmax(diagonal))
        off = np.abs(np.tril(own, -1))
        r, s = np.unravel_index(int(np.argmax(off)), off.shape)
        if max(diagonal[d], off[r, s]) == 0:
            count[1] += n - k
            break
        if diagonal[d] >= grow * off[r, s]:
            order = [d]
        else:
            order = [int(s), int(r)]
        for to, at in enumerate(order):
            if at != to:
                own[[to, at]] = own[[at, to]]
                own[:, [to, at]] = own[:, [at, to]]
                order = [at if x == to else x for x in order]
        m = len(order)
        pivot = own[:m, :m].copy()
        if m == 1:
            count[2 if pivot[0, 0] > 0 else 0] += 1
        else:  # off the diagonal the entry is the largest, so the pivot's determinant is negative
            count[0] += 1
            count[2] += 1
        lower = np.linalg.solve(pivot, own[:m, m:]).T
        own[m:, m:] -= lower @ own[:m, m:]
        k += m
    return count[0], count[1], count[2]


def _tasks(spark, matrix, rows: list[tuple], run, schema: str):
    """Rows of work dealt one a task, each answered by ``run(matrix, row)`` in the cluster."""
    work = spark.createDataFrame(rows, ", ".join(f"c{i} {'long' if isinstance(v, int) else 'double' if isinstance(v, float) else 'binary'}" for i, v in enumerate(rows[0])))
    spread = work.repartition(min(len(rows), SHIFTS), *[c for c in work.columns if not isinstance(rows[0][int(c[1:])], bytes | bytearray)])

    def answer(batches):
        own = matrix.value
        for batch in batches:
            columns = list(zip(*(run(own, row) for row in zip(*(c.to_pylist() for c in batch.columns)))))
            if columns:
                yield pa.RecordBatch.from_arrays([pa.array(list(c)) for c in columns], names=[x.split()[0] for x in schema.split(", ")])

    return tb.mapped(spread, answer, schema).collect()


def above(spark, matrix, shifts: list[float]) -> dict[float, int]:
    """For each shift, the number of eigenvalues greater than it."""
    def count(v, row):
        return row[0], inertia(v - row[0] * np.eye(len(v)))[2]

    return {r.shift: r.n for r in _tasks(spark, matrix, [(float(s),) for s in shifts], count, "shift double, n long")}


@dataclass(frozen=True)
class Interval:
    """lo < eigenvalue <= hi for ``count`` eigenvalues."""

    lo: float
    hi: float
    count: int


def intervals(spark, matrix, top: float, least: float, wanted: int) -> list[Interval]:
    """Intervals of at most ``IN_INTERVAL`` eigenvalues (more only where they cannot be told apart) that hold the ``wanted`` largest ones above ``least``.

    Counted, not searched for: every round splits all intervals that hold too many at once.
    """
    ends = [least, top]
    known = above(spark, matrix, ends)
    for _ in range(60):
        ends = sorted(known)
        crowded = []
        for lo, hi in zip(ends, ends[1:]):
            held = known[lo] - known[hi]
            useful = known[hi] < wanted
            if useful and held > IN_INTERVAL and hi - lo > 1e-13 * top:
                crowded.append((lo, hi, held))
        if not crowded:
            break
        each = max(1, SHIFTS // len(crowded))
        fresh: list[float] = []
        for lo, hi, held in crowded:
            low = max(lo, 1e-300)
            # Spectra fall by powers, so an interval is cut in ratio where it spans one.
            steps = np.geomspace(low, hi, each + 2) if hi / low > 4 and lo > 0 else np.linspace(lo, hi, each + 2)
            fresh += [float(s) for s in steps[1:-1] if lo < s < hi]
        fresh = [s for s in dict.fromkeys(fresh) if s not in known]
        if not fresh:
            break
        known |= above(spark, matrix, fresh)
    ends = sorted(known)
    found = [Interval(lo, hi, known[lo] - known[hi]) for lo, hi in zip(ends, ends[1:]) if known[hi] < wanted and known[lo] > known[hi]]
    joined: list[Interval] = []
    for x in found:  # neighbours that hold little are one interval
        if joined and joined[-1].hi == x.lo and joined[-1].count + x.count <= IN_INTERVAL:
            joined[-1] = Interval(joined[-1].lo, x.hi, joined[-1].count + x.count)
        else:
            joined.append(x)
    return joined


def _nodes() -> tuple[np.ndarray, np.ndarray]:
    x, w = np.polynomial.legendre.leggauss(NODES)
    return np.pi / 2 * (1 - x), w


def feast(spark, v: np.ndarray, found: list[Interval], rounds: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors (columns) of all intervals; as many as counted, or an error."""
    d, scale = len(v), float(np.abs(v).sum(1).max())
    matrix = spark.sparkContext.broadcast(v)
    angles, weights = _nodes()
    random = np.random.Generator(np.random.PCG64(12))
    width = {k: min(d, x.count + max(4, x.count // 2)) for k, x in enumerate(found)}
    block = {k: random.standard_normal((d, width[k])) for k in width}
    done: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    for turn_of in range(rounds):
        open_ = [k for k in width if k not in done]
        if not open_:
            break
        work = []
        for k in open_:
            # A circle that reaches a little past the interval keeps its end points inside.
            middle, radius = (found[k].lo + found[k].hi) / 2, (found[k].hi - found[k].lo) / 2 * (1 + 1e-6) + 1e-14 * scale
            for j in range(NODES):
                z = radius * np.exp(1j * angles[j])
                work.append((k, j, float(middle + z.real), float(z.imag), float(weights[j] / 2 * z.real), float(weights[j] / 2 * z.imag), block[k].tobytes()))

        def solve(m, row):
            k, _, x, y, a, b, held = row
            rhs = np.frombuffer(held).reshape(len(m), -1)
            out = np.linalg.solve((x + 1j * y) * np.eye(len(m)) - m, rhs.astype(complex))
            return k, row[1], ((a + 1j * b) * out).real.tobytes()

        parts: dict[int, list] = {k: [] for k in open_}
        for r in _tasks(spark, matrix, work, solve, "k long, node long, part binary"):
            parts[r.k].append((r.node, np.frombuffer(r.part).reshape(d, -1)))
        for k in open_:
            projected = sum(p for _, p in sorted(parts[k], key=lambda x: x[0]))
            q, _ = np.linalg.qr(projected)
            values, vectors = np.linalg.eigh(q.T @ v @ q)
            vectors = q @ vectors
            error = np.linalg.norm(v @ vectors - vectors * values, axis=0)
            for edge in (0.0, 1e-13 * scale):  # a value on an end may round to its other side
                inside = (values > found[k].lo - edge) & (values <= found[k].hi + edge)
                if inside.sum() >= found[k].count:
                    break
            good = inside & (error <= 1e-12 * scale)
            if good.sum() == found[k].count and inside.sum() == good.sum():
                done[k] = values[inside], vectors[:, inside]
            elif (values[inside].size >= vectors.shape[1]) or inside.sum() > found[k].count or turn_of >= rounds // 2:
                width[k] = min(d, 2 * width[k])
                block[k] = np.hstack([vectors, random.standard_normal((d, width[k] - vectors.shape[1]))]) if width[k] > vectors.shape[1] else vectors
            else:
                block[k] = vectors
    matrix.unpersist()
    if len(done) < len(found):
        raise ArithmeticError(f"{len(found) - len(done)} intervals did not give their counted eigenvalues in {rounds} rounds")
    if not done:
        return np.zeros(0), np.zeros((d, 0))
    # One more Rayleigh-Ritz step over all of them makes vectors of neighbouring intervals orthogonal to rounding.
    values = np.concatenate([done[k][0] for k in sorted(done)])
    vectors = np.hstack([done[k][1] for k in sorted(done)])
    order = np.argsort(-values, kind="stable")
    q, _ = np.linalg.qr(vectors[:, order])
    values, turn = np.linalg.eigh(q.T @ v @ q)
    vectors = (q @ turn)[:, ::-1]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])
    return values[::-1], vectors * signs


@dataclass(frozen=True)
class Whitening:
    """n rows with integer sums; eigenvalues, unit eigenvectors (columns) and the trace of their covariance."""

    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float


def integers(rows: DataFrame, vector: str, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """The rows that stay, with ``x`` (array of long) in place of the vector."""
    entries = F.col(vector).cast("array<double>")
    fit = F.forall(entries, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= F.lit(2.0**52 / scale)))
    usable = rows.where(F.col(vector).isNotNull() & (F.size(vector) > 0) & fit)
    usual = usable.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    length = usual["d"] if usual else 0
    x = F.transform(entries, lambda c: F.floor(c * scale).cast("long") + shift)
    return usable.where(F.size(vector) == length).withColumn(vector, x).withColumnRenamed(vector, "x")


def _matrix(batch: pa.Array) -> np.ndarray:
    return batch.flatten().to_numpy().reshape(len(batch), -1) if len(batch) else np.zeros((0, 1), np.int64)


def _added(rows: DataFrame, run, width: int) -> np.ndarray:
    """Sum over tasks of the square matrix that each makes of its rows, added up by entry."""
    def own(batches):
        total = np.zeros((width, width))
        for batch in batches:
            total += run(_matrix(batch.column(0)))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["at", "value"])

    cells = tb.mapped(rows, own, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).toArrow()
    out = np.zeros(width * width)
    out[cells["at"].to_numpy()] = cells["value"].to_numpy()
    return out.reshape(width, width)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n in double, from the exact difference n * x - sums."""
    low = max((abs(s) for s in sums), default=0)
    if n * max(int(np.abs(x).max()) if x.size else 0, 1) + low < 2**62:
        return (x * np.int64(n) - np.array(sums, np.int64)) / n
    whole = x.astype(object) * n - np.array(sums, object)
    return (whole / n).astype(float)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Exact sums over dimensions of (n * x - sums) squared; None beyond a long."""
    far = n * max(int(np.abs(x).max()) if x.size else 0, 1) + max((abs(s) for s in sums), default=0)
    if far < 2**62:
        diff = x * np.int64(n) - np.array(sums, np.int64)
        most = int(np.abs(diff).max()) if diff.size else 0
        if most * most * max(x.shape[1], 1) < 2**63:
            return (diff * diff).sum(1).tolist()
        diff = diff.astype(object)
    else:
        diff = x.astype(object) * n - np.array(sums, object)
    return [v if v < 2**63 else None for v in (int(sum(int(c) * int(c) for c in row)) for row in diff)]


def fit(x: DataFrame, components: int = 32) -> Whitening:
    """Leading components of the rows of ``x`` (a table that ``integers`` made and that is stored)."""
    spark = x.sparkSession
    first = x.select("x").first()
    if first is None:
        return Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    d = len(first["x"])
    at = x.select(F.posexplode("x").alias("k", "v")).groupBy("k").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("s"), F.count(F.lit(1)).alias("n")).collect()
    sums = [int(r["s"]) for r in sorted(at, key=lambda r: r["k"])]
    n = int(at[0]["n"])

    def products(rows):
        y = centred(rows, n, sums) if len(rows) else np.zeros((0, d))
        return y.T @ y

    v = _added(x.select("x"), products, d) / n
    v = (v + v.T) / 2
    trace = float(np.trace(v))
    if trace <= 0:
        return Whitening(n, sums, np.zeros(0), np.zeros((d, 0)), trace)
    top = float(np.abs(v).sum(1).max()) * (1 + 1e-12)
    matrix = spark.sparkContext.broadcast(v)
    found = intervals(spark, matrix, top, top * d * 1e-14, components)
    matrix.unpersist()
    values, vectors = feast(spark, v, found)
    return Whitening(n, sums, values[:components], vectors[:, :components], trace)


def whiten(embeddings: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = 32, scale: int = 64, shift: int = 1_000_000) -> DataFrame:
    """id, component, n, deviation, whitened, explained and identity_error of every remaining row and component.

    ``identity_error`` is measured on the whitened values of all rows.
    """
    x = cut(integers(embeddings.select(id, vector), vector, scale, shift), "integers")
    model = fit(x, components)
    shared = x.sparkSession.sparkContext.broadcast(model)
    r = len(model.values)

    def project(rows, own):
        return centred(rows, own.n, own.sums) @ own.vectors / np.sqrt(own.values)

    def products(rows):
        w = project(rows, shared.value) if len(rows) else np.zeros((0, r))
        return w.T @ w

    def means(batches):
        own, total = shared.value, np.zeros(r)
        for batch in batches:
            if batch.num_rows:
                total += project(_matrix(batch.column(0)), own).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(r)), pa.array(total)], names=["at", "value"])

    error = 0.0
    if r:
        got = tb.mapped(x.select("x"), means, "at long, value double").groupBy("at").agg(F.sum("value").alias("value")).collect()
        mean = np.array([c["value"] for c in sorted(got, key=lambda c: c["at"])]) / model.n
        error = float(np.abs(_added(x.select("x"), products, r) / model.n - np.outer(mean, mean) - np.eye(r)).max())
    explained = model.values / model.trace if r else model.values
    schema = T.StructType([x.schema[id], *(T.StructField(c, t) for c, t in (
        ("component", T.IntegerType()), ("n", T.LongType()), ("deviation", T.LongType()), ("whitened", T.DoubleType()), ("explained", T.DoubleType()), ("identity_error", T.DoubleType())))])

    def spread(batches):
        own = shared.value
        for batch in batches:
            k = batch.num_rows
            if not k or not r:
                continue
            rows = _matrix(batch.column(1))
            far = pa.array(deviations(rows, own.n, own.sums), pa.int64())
            each = pa.array(np.repeat(np.arange(k), r))
            yield pa.RecordBatch.from_arrays([
                batch.column(0).take(each), pa.array(np.tile(np.arange(1, r + 1, dtype=np.int32), k)), pa.array(np.full(k * r, own.n)), far.take(each),
                pa.array(project(rows, own).ravel()), pa.array(np.tile(explained, k)), pa.array(np.full(k * r, error))], names=schema.names)

    return tb.mapped(x.select(id, "x"), spread, schema)


def op12_embedding_whitening(spark, sf_dir: str) -> DataFrame:
    """The 32 leading whitened components of every embedding."""
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
