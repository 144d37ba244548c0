"""Periodic stretches of words: every maximal run of a text, found in tiles of each period octave.

A run is a maximal stretch of words with smallest period q that repeats ``exponent`` times or more and is ``least`` words
or longer.  Its words at equal distance q agree on an interval of places, the run without its last q words.

1. *Explode.*  A text becomes overlapping tiles for each octave of periods.  The octave of periods lo to hi - 1 has a grid of boundaries that
   is so narrow that every run holds one near its start, followed by a gram that comes again one period later.  Only
   tiles with such a boundary leave the task, as small word numbers with their boundaries.
2. *Solve.*  Tiles are dealt evenly over the cluster.  At each boundary one Z-function of the words after it, and one of the
   reversed words before it, tell for all periods of the octave how far the words agree to either side.
3. *Stitch.*  The intervals go by (document, period); those that overlap become one run, and of runs over the same stretch the
   smallest period stays (all others are its multiples).

Words are `[^\\x20\\x09-\\x0D]+` and equal if their 64-bit hashes are.  Rows are told apart by a number of their own, so ids may be
null or repeat and each row has its own result.  A null or empty text has no words and no runs.  Texts of any length are taken whole: words are
hashed in panels, and a tile holds a few times its octave's longest period.  An empty table gives no rows.  Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cmp_to_key
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.storage import Scratch
from vigil.llm import textbuf as tb

#: Words of a tile's own part, at least; and words that one task solves, about.
CORE_WORDS = 256
TASK_WORDS = 250_000


@dataclass(frozen=True)
class Octave:
    """Periods lo to hi - 1, the spacing of their boundaries and the gram that must come again."""

    lo: int
    hi: int
    grid: int
    gram: int

    @property
    def reach(self) -> int:
        """Words a boundary needs after itself: no fragment ends before the next boundary's begins, or the run does."""
        return self.hi - 1 + self.gram + self.grid

    @property
    def core(self) -> int:
        return self.grid * max(8, CORE_WORDS // self.grid)


def octaves(longest: int, least: int, exponent: int) -> list[Octave]:
    """The octaves of all periods that fit a text of ``longest`` words."""
    out, lo = [], 1
    while max(least, exponent * lo) <= longest:
        hi = 2 * lo
        # The shortest interval of agreeing places; it falls with q until exponent * q passes least.
        agree = min(max(least, exponent * q) - q for q in {lo, hi - 1, min(max(least // exponent, lo), hi - 1), min(max(-(-least // exponent), lo), hi - 1)})
        grid = min(lo, (agree + 2) // 3)
        out.append(Octave(lo, hi, grid, agree - grid + 1))
        lo = hi
    return out


def z_function(s: list[int]) -> list[int]:
    """For each place, how many items from there on equal the first items of the list."""
    n = len(s)
    z = [n] + [0] * (n - 1) if n else []
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[i + k] == s[k]:
            k += 1
        if i + k > right:
            left, right = i, i + k
        z[i] = k
    return z


def flagged(grams: np.ndarray, octave: Octave) -> tuple[np.ndarray, np.ndarray]:
    """(boundary, period) pairs whose grams are equal, over all boundaries of the grid."""
    if len(grams) <= octave.lo:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    padded = np.concatenate([grams, np.arange(octave.hi, dtype=np.uint64)])
    later = np.lib.stride_tricks.sliding_window_view(padded, octave.hi - octave.lo)[octave.lo : octave.lo + len(grams) : octave.grid]
    row, step = np.nonzero(later == grams[:: octave.grid][: len(later), None])
    return row * octave.grid, step + octave.lo


def tiles(hashes: np.ndarray, firsts: np.ndarray, least: int, exponent: int) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
    """(text, period octave's lo, tile's first word, word numbers, boundaries in the tile) of the texts whose words lie back to back."""
    lengths = np.diff(firsts)
    if not len(lengths) or not lengths.max():
        return
    n = len(hashes)
    up, down = tb.powers(tb.BASE, n), tb.powers(tb.INVERSE, n)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(hashes * up, out=total[1:])
    for octave in octaves(int(lengths.max()), least, exponent):
        if n < octave.gram + octave.lo:
            break
        at, period = flagged((total[octave.gram :] - total[: n + 1 - octave.gram]) * down[: n + 1 - octave.gram], octave)
        own = np.searchsorted(firsts, at, "right") - 1
        inside = at + period + octave.gram <= firsts[own + 1]
        at, own = at[inside], own[inside]
        if not len(at):
            continue
        cell = at // octave.core
        keep = np.append(True, at[1:] != at[:-1])
        at, own, cell = at[keep], own[keep], cell[keep]
        edges = np.flatnonzero(np.append(True, (own[1:] != own[:-1]) | (cell[1:] != cell[:-1])))
        for lo, hi in zip(edges, np.append(edges[1:], len(at))):
            text = int(own[lo])
            begin = max(int(firsts[text]), int(at[lo]) - octave.grid)
            end = min(int(firsts[text + 1]), int(at[hi - 1]) + octave.reach)
            numbers = np.unique(hashes[begin:end], return_inverse=True)[1].astype(np.int32)
            yield text, octave.lo, begin - int(firsts[text]), numbers, (at[lo:hi] - begin).astype(np.int32)


def solve(words: list[int], boundaries: list[int], octave: Octave) -> list[tuple[int, int, int]]:
    """(period, start, end) of intervals of places that agree with the place one period on, each as far as the tile shows."""
    done: list[tuple[int, int, int]] = []
    live: dict[int, list[int]] = {}
    for b in boundaries:
        ahead = z_function(words[b : b + octave.reach])
        found = [(q, ahead[q]) for q in range(octave.lo, min(octave.hi, len(ahead))) if ahead[q] >= octave.gram]
        fresh = [q for q, _ in found if q not in live or live[q][1] < b]
        behind: list[int] = []
        if fresh:
            low = max(0, b - octave.grid)
            before, width = words[low:b][::-1], b - low
            behind = z_function([*before, -1, *words[low : b + octave.hi - 1][::-1]])
            last = len(words[low : b + octave.hi - 1]) + low - 1  # the word that the reversed part begins with
        for q, f in found:
            if q in live and live[q][1] >= b:
                live[q][1] = max(live[q][1], b + f)
                continue
            if q in live:
                done.append((q, *live[q]))
            place = width + 1 + last - (b + q - 1)
            live[q] = [b - (behind[place] if width else 0), b + f]
    return done + [(q, *x) for q, x in live.items()]


#: Turns ids and texts of a batch into the texts that are searched.
Prepare = Callable[[pa.Array, pa.Array], pa.Array]


def _joined(words: list[bytes], want_text: bool) -> str:
    whole = b" ".join(words)
    return whole.decode("utf-8", "replace") if want_text else hashlib.sha256(whole).hexdigest()


def explode(docs: DataFrame, id: str, text: str, least: int, exponent: int, want_text: bool, prepare: Prepare | None) -> DataFrame:
    """Rows of two kinds: a document (lo null; ``collapsed`` where it has no tile, else its text) and a tile (lo of its octave)."""
    kind = docs.schema[id].dataType
    schema = T.StructType([T.StructField("row", T.LongType()), T.StructField("id", kind), T.StructField("n_words", T.LongType()), T.StructField("lo", T.LongType()),
                           T.StructField("first", T.LongType()), T.StructField("words", T.BinaryType()), T.StructField("boundaries", T.BinaryType()),
                           T.StructField("text", T.StringType()), T.StructField("collapsed", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_schema

    names = to_arrow_schema(schema)

    def run(batches):
        for batch in batches:
            rows, ids = batch.column(0), batch.column(1)
            texts = batch.column(2) if prepare is None else prepare(ids, batch.column(2))
            for lo, hi, data, offsets in tb.slices(texts):
                hashes, firsts = tb.word_hashes(data, offsets)
                own, cells, held = rows.slice(lo, hi - lo).to_numpy(), [], 0
                kept = np.zeros(hi - lo, bool)

                def table(cells):
                    columns = zip(*cells)
                    row, octave, first, words, at = (list(c) for c in columns)
                    k = len(cells)
                    return pa.RecordBatch.from_arrays([
                        pa.array(row, pa.int64()), pa.nulls(k, names.field("id").type), pa.nulls(k, pa.int64()), pa.array(octave, pa.int64()), pa.array(first, pa.int64()),
                        pa.array(words, pa.binary()), pa.array(at, pa.binary()), pa.nulls(k, pa.string()), pa.nulls(k, pa.string())], schema=names)

                for i, octave, first, numbers, at in tiles(hashes, firsts, least, exponent):
                    kept[i] = True
                    cells.append((int(own[i]), octave, first, numbers.tobytes(), at.tobytes()))
                    held += numbers.nbytes + at.nbytes
                    if held > tb.SLICE_BYTES:
                        yield table(cells)
                        cells, held = [], 0
                if cells:
                    yield table(cells)
                raw, k = data.tobytes(), hi - lo
                whole = [raw[offsets[i] : offsets[i + 1]] for i in range(k)]
                yield pa.RecordBatch.from_arrays([
                    rows.slice(lo, k), ids.slice(lo, k), pa.array(np.diff(firsts), pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.int64()), pa.nulls(k, pa.binary()), pa.nulls(k, pa.binary()),
                    pa.array([w.decode("utf-8", "replace") if y else None for w, y in zip(whole, kept)], pa.string()),
                    pa.array([None if y else _joined(w.split(), want_text) for w, y in zip(whole, kept)], pa.string())], schema=names)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.col(text).cast("string").alias("text"))
    return tb.mapped(rows, run, schema)


def fragments(found: DataFrame, least: int, exponent: int) -> DataFrame:
    """row, period, start and end of the agreeing intervals of the tiles in ``found``."""
    words = found.where("lo is not null").agg(F.coalesce(F.sum(F.length("words")), F.lit(0)).alias("bytes")).first()["bytes"] // 4
    parts = int(min(65_536, max(1, -(-words // TASK_WORDS))))

    def run(batches):
        for batch in batches:
            out: list[tuple[int, int, int, int]] = []
            row, lo, first, words, at = (c.to_pylist() for c in batch.columns)
            for r, low, start, w, b in zip(row, lo, first, words, at):
                octave = next(o for o in octaves(2 * exponent * low + least, least, exponent) if o.lo == low)
                out += [(r, q, s + start, e + start) for q, s, e in solve(np.frombuffer(w, np.int32).tolist(), np.frombuffer(b, np.int32).tolist(), octave)]
            columns = zip(*out) if out else ([], [], [], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["row", "period", "start", "end"])

    spread = found.where("lo is not null").select("row", "lo", "first", "words", "boundaries").repartition(parts, "row", "lo", "first")
    return tb.mapped(spread, run, "row long, period long, start long, end long")


def stitch(pieces: DataFrame, least: int, exponent: int) -> DataFrame:
    """row and runs (sorted array of start, period, length) from the fragments, each run with its smallest period."""
    line = Window.partitionBy("row", "period").orderBy("start", "end")
    before = F.max("end").over(line.rowsBetween(Window.unboundedPreceding, -1))
    cut_at = pieces.select("*", F.when(before >= F.col("start"), 0).otherwise(1).alias("fresh"))
    whole = (cut_at.select("*", F.sum("fresh").over(line).alias("run"))
             .groupBy("row", "period", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
             .select("row", "start", "period", (F.col("end") - F.col("start") + F.col("period")).alias("length")))
    long = whole.where((F.col("length") >= least) & (F.col("length") >= exponent * F.col("period")))
    single = long.groupBy("row", "start", "length").agg(F.min("period").alias("period"))
    return single.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))


def find_runs(docs: DataFrame, id: str = "doc_id", text: str = "text", least: int = 6, exponent: int = 4, want_text: bool = True, prepare: Prepare | None = None) -> DataFrame:
    """id, n_words, runs (array of start, period, length in words, by start then period) and collapsed of each row.

    ``collapsed`` is the text without the words that any run holds after its first period, one space between words; with
    ``want_text`` false, its sha256.  ``exponent`` is 3 or more.
    """
    if exponent < 3 or least < 2:
        raise ValueError("runs need an exponent of 3 and a length of 2 words, at least")
    scratch = Scratch(docs.sparkSession)
    found = scratch.cut(explode(docs, id, text, least, exponent, want_text, prepare), "run_tiles")
    runs = scratch.cut(stitch(fragments(found, least, exponent), least, exponent), "runs")
    none = F.array().cast(runs.schema["runs"].dataType)
    single = found.where("lo is null and text is null").select("id", "n_words", none.alias("runs"), "collapsed")
    several = found.where("lo is null and text is not null").select("row", "id", "n_words", "text").join(runs, "row", "left").select(
        "id", "n_words", F.coalesce("runs", none).alias("runs"), "text")
    schema = T.StructType([*several.schema.fields[:3], T.StructField("collapsed", T.StringType())])

    def collapse(batches):
        for batch in batches:
            out = []
            for runs, whole in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                words = whole.encode().split()
                stay = np.ones(len(words), bool)
                for x in runs:
                    stay[x["start"] + x["period"] : x["start"] + x["length"]] = False
                out.append(_joined([w for w, y in zip(words, stay) if y], want_text))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], names=schema.names)

    return scratch.last(single.unionByName(tb.mapped(several, collapse, schema)), "periodic_runs").withColumnRenamed("id", id)


def unrolled(ids: pa.Array, texts: pa.Array) -> pa.Array:
    """The texts of the contract: where crc32 of the id is a multiple of 10, the words from some place on repeat a stretch."""
    out = texts.to_pylist()
    for k, (key, whole) in enumerate(zip(ids.to_pylist(), out)):
        h = crc32(str(key).encode()) if key is not None else 1
        if h % 10 or not whole:
            continue
        words = whole.encode().split()
        n, g = len(words), h // 10
        if n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            out[k] = b" ".join(words[i if i < a else a + (i - a) % p] for i in range(n)).decode()
    return pa.array(out, pa.string())


def best_of(runs: list[dict]) -> dict | None:
    """The run with the greatest length / period; of equals the first start, then the smallest period."""
    def order(x, y):
        return y["length"] * x["period"] - x["length"] * y["period"] or x["start"] - y["start"] or x["period"] - y["period"]

    return min(runs, key=cmp_to_key(order), default=None)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_runs, the greatest run and the digests of all runs and of the collapsed words of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    found = find_runs(docs, want_text=False, prepare=unrolled)
    schema = ("doc_id long, n_words long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string")

    def digest(batches):
        for batch in batches:
            rows = []
            for runs in batch.column(2).to_pylist():
                best = best_of(runs)
                lines = "".join(f"{x['start']},{x['length']},{x['period']}\n" for x in runs)
                rows.append((len(runs), *((best["start"], best["length"], best["period"], 1000 * best["length"] // best["period"]) if best else (None,) * 4),
                             hashlib.sha256(lines.encode()).hexdigest()))
            columns = list(zip(*rows)) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([
                batch.column(0), batch.column(1), *(pa.array(c, pa.int64()) for c in columns[:5]), pa.array(columns[5], pa.string()), batch.column(3)],
                names=[c.split()[0] for c in schema.split(", ")])

    return tb.mapped(found.select("doc_id", "n_words", "runs", "collapsed"), digest, schema)
