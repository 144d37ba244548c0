"""Vectorised work on the UTF-8 buffer of an Arrow string column.

An Arrow batch holds its texts back to back, so words, hashes and counts of many documents come out of a few
numpy passes.  ``slices`` bounds the bytes one pass holds; a single longer text is one slice of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Bytes of text in one numpy pass.
SLICE_BYTES = 2 << 20

#: Bytes of rows in one Arrow batch, and the setting that bounds them.
BATCH_BYTES = 8 << 20
BATCH_BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _table(test) -> np.ndarray:
    return np.fromiter((test(c) for c in range(256)), bool, 256)


#: Words `[^\x20\x09-\x0D]+`; and `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` (digits, a-z, everything beyond ASCII).
NOT_SPACE = _table(lambda c: c != 32 and not 9 <= c <= 13)
LETTERS = _table(lambda c: 48 <= c <= 57 or 97 <= c <= 122 or c >= 128)
LOWER = np.fromiter((c + 32 if 65 <= c <= 90 else c for c in range(256)), np.uint8, 256)
#: First bytes of code points.
LEADS = _table(lambda c: c & 0xC0 != 0x80)
#: A random 64-bit value for each byte.
BYTES = np.random.Generator(np.random.PCG64(20260726)).integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


@lru_cache(maxsize=4)
def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; lengths are rounded up so that few arrays are kept."""
    return _powers(int(base), max(SLICE_BYTES, 1 << (max(n, 1) - 1).bit_length()))[:n]


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.fill_null("") if texts.null_count else texts
    texts = texts.cast(pa.large_string())
    _, where, data = texts.buffers()
    offsets = np.frombuffer(where, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end


def runs(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of true bytes inside each text, and each text's first run (n + 1)."""
    n = len(inside)
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.empty(n, bool)
    after = np.empty(n, bool)
    if n:
        before[0], before[1:] = False, inside[:-1]
        after[-1], after[:-1] = False, inside[1:]
        before[first[:n]] = False
        after[first[1:]] = False
    starts = np.flatnonzero(inside & ~before)
    ends = np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of byte spans, the same wherever the span lies."""
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * powers(BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[starts]) * powers(INVERSE, len(data) + 1)[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


def per_text(values: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Sums of a per-run value over each text."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[firsts[1:]] - total[firsts[:-1]]


def panels(data: np.ndarray, at: int, end: int, inside: np.ndarray = NOT_SPACE) -> Iterator[tuple[int, int]]:
    """Byte ranges of about ``SLICE_BYTES`` of one text that end between words, however long a word is."""
    while at < end:
        to = min(end, at + SLICE_BYTES)
        while to < end and inside[data[to]] and inside[data[to - 1]]:  # a word goes on: end the panel at its next gap
            gap = np.flatnonzero(~inside[data[to : to + SLICE_BYTES]])
            to = to + int(gap[0]) if len(gap) else min(end, to + SLICE_BYTES)
        yield at, to
        at = to


def word_hashes(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and each text's first word (n + 1).

    A buffer longer than a slice (one long text) is read in panels, so only its hashes are whole.
    """
    if len(data) <= 2 * SLICE_BYTES:
        starts, ends, firsts = runs(inside[data], offsets)
        return span_hashes(data, starts, ends), firsts
    parts, counts = [], np.zeros(len(offsets), np.int64)
    for k in range(len(offsets) - 1):
        for at, to in panels(data, int(offsets[k]), int(offsets[k + 1]), inside):
            panel = data[at:to]
            starts, ends, _ = runs(inside[panel], np.array([0, to - at]))
            parts.append(span_hashes(panel, starts, ends))
            counts[k + 1] += len(starts)
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64), np.cumsum(counts)


def mapped(rows: DataFrame, run, schema) -> DataFrame:
    """``mapInArrow`` with batches bounded by ``BATCH_BYTES`` as well as by rows; a smaller bound of the session stays."""
    spark = rows.sparkSession
    if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH_BOUND)) > BATCH_BYTES:
        spark.conf.set(BATCH_BOUND, BATCH_BYTES)
    return rows.mapInArrow(run, schema)
