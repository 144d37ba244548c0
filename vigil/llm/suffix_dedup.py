"""Removal of repeated byte strings with a logarithmic family of suffix arrays.

A byte goes if a string of ``length`` bytes covers it that also starts earlier (in a document of smaller id, or earlier
in the same one).  Suffixes are indexed where a repeat is possible: every window of ``length`` bytes has an anchor, its
leftmost smallest gram hash, so equal windows have equal anchors, and an anchor that the corpus has once belongs to
windows without a repeat.  A bit table of the anchors found twice or more (of fixed size, so a false positive costs
time alone) picks the rest, which are dealt out by anchor.

An anchor found very often is not dealt whole: each of its windows is dealt by its own hash, so that equal windows meet
and different ones spread.  The number of partitions follows the number of places.

In each partition the windows' suffixes come in document order in batches.  A batch is sorted into a suffix array, scanned
in merge order against the arrays of earlier batches for matches of ``length`` bytes, and its new suffixes become the
smallest level; levels of like size merge, so a suffix is moved a logarithmic number of times.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigil.llm import textbuf as tb
from vigil.llm.token_counts import _pieces

#: Low bits of a selection key that hold the position, so that of equal hashes the leftmost is smallest.
POSITION_BITS = 31
#: Suffixes of one batch.
BATCH = 1 << 15
#: Anchors found more often are dealt window by window; a place's suffixes take up to 7 KB.
HOT = 8192
#: Places of one partition, on average at most.
PART_PLACES = 1 << 16
#: Places of one Arrow batch, whose bytes have 32-bit offsets.
PLACES_OUT = 1 << 15
#: Places of hot anchors that are taken apart at a time.
SPLIT = 1 << 10


def anchors(data: np.ndarray, offsets: np.ndarray, length: int, gram: int):
    """(gram hash, first window start, last window start + 1, text) of each anchor of the texts in a buffer."""
    none = (np.zeros(0, np.uint64), *(np.zeros(0, np.int64) for _ in range(3)))
    n, span = len(data), length - gram + 1
    if n < length:
        return none
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(tb.BYTES[data] * tb.powers(tb.BASE, n), out=total[1:])
    hashes = tb.mix((total[gram:] - total[:-gram]) * tb.powers(tb.INVERSE, n + 1)[: n - gram + 1])
    low = np.uint64((1 << POSITION_BITS) - 1)
    least = (hashes & ~low) | np.arange(len(hashes), dtype=np.uint64)
    size = 1
    while size * 2 <= span:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if span > size:
        least = np.minimum(least[: len(least) - (span - size)], least[span - size :])
    sizes = np.diff(offsets)
    # Windows that cross a text's end.
    step = np.zeros(n + 1, np.int64)
    first_bad = np.maximum(offsets[1:] - length + 1, offsets[:-1])
    np.add.at(step, first_bad, 1)
    np.add.at(step, offsets[1:], -1)
    good = np.flatnonzero(np.cumsum(step)[: len(least)] == 0)
    if not len(good):
        return none
    at = (least[good] & low).astype(np.int64)
    text = np.repeat(np.arange(len(sizes)), np.maximum(sizes - length + 1, 0))
    fresh = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (text[1:] != text[:-1])])
    ends = np.r_[fresh[1:], len(good)]
    return hashes[at[fresh]], good[fresh], good[ends - 1] + 1, text[fresh]


def gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many spans back to back, and their offsets."""
    offsets = np.zeros(len(sizes) + 1, np.int64)
    np.cumsum(sizes, out=offsets[1:])
    at = np.ones(offsets[-1], np.int64)
    if len(starts):
        at[0] = starts[0]
        at[offsets[1:-1]] = starts[1:] - (starts[:-1] + sizes[:-1]) + 1
    return data[np.cumsum(at)], offsets


def _held(ordered: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Which values a sorted array holds."""
    if not len(ordered):
        return np.zeros(len(values), bool)
    at = np.searchsorted(ordered, values)
    at[at == len(ordered)] = 0
    return ordered[at] == values


class Levels:
    """A family of sorted arrays of distinct suffixes, each at least twice as large as the next."""

    def __init__(self):
        self.levels: list[np.ndarray] = []

    def known(self, suffixes: np.ndarray) -> np.ndarray:
        """Which of the sorted suffixes some level holds."""
        out = np.zeros(len(suffixes), bool)
        for level in self.levels:
            out |= _held(level, suffixes)
        return out

    def add(self, suffixes: np.ndarray) -> None:
        if len(suffixes):
            self.levels.append(suffixes)
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            last = self.levels.pop()
            self.levels[-1] = np.sort(np.concatenate([self.levels[-1], last]), kind="stable")  # merges two sorted runs

    def batch(self, suffixes: np.ndarray) -> np.ndarray:
        """Marks the suffixes, given in document order, that are in a level or earlier in the batch, and adds the others."""
        order = np.argsort(suffixes, kind="stable")
        ordered = suffixes[order]
        first = np.r_[True, ordered[1:] != ordered[:-1]]
        distinct = ordered[first]
        known = self.known(distinct)
        self.add(distinct[~known])
        out = np.ones(len(suffixes), bool)
        out[order[first]] = known
        return out


#: Bits of one page of the table.
PAGE_BITS = 18


def _bit_table(hashes: DataFrame, bits: int, hot: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(a table of 2**bits bits with the bits of the hashes set, the sorted hashes found over ``hot`` times, the sum of the counts).

    Tasks fill the table page by page.
    """
    low, words = PAGE_BITS, 1 << (PAGE_BITS - 6)
    # Anchors are minima, so their high bits crowd near zero; the low bits are even.
    slots = hashes.select(F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).alias("slot"), "n", F.when(F.col("n") > hot, F.col("h")).alias("hot"))

    def fill(batches):
        pages: dict[int, np.ndarray] = {}
        often, total = [], 0
        for batch in batches:
            often.append(batch.column(2).drop_null().to_numpy())
            total += int(batch.column(1).to_numpy().sum())
            slot = np.sort(batch.column(0).to_numpy())
            for own in np.split(slot, np.flatnonzero(np.diff(slot >> low)) + 1):
                if len(own):
                    page = pages.setdefault(int(own[0] >> low), np.zeros(words, np.uint64))
                    at = own & ((1 << low) - 1)
                    np.bitwise_or.at(page, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
        # Page -1 has the hot hashes and the sum of counts.
        last = np.concatenate([*often, [total]]).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([*pages, -1], pa.int64()), pa.array([*(x.tobytes() for x in pages.values()), last.tobytes()], pa.binary())], names=["page", "bits"])

    table = np.zeros(1 << max(bits - 6, 0), np.uint64)
    often, total = [np.zeros(0, np.int64)], 0
    for row in slots.repartition(F.shiftright("slot", low)).mapInArrow(fill, "page long, bits binary").toLocalIterator():
        if row.page < 0:
            *own, n = np.split(np.frombuffer(row.bits, np.int64), [-1])
            often += own
            total += int(n[0])
            continue
        table[row.page * words : (row.page + 1) * words] = np.frombuffer(row.bits, np.uint64)
    return table, np.sort(np.concatenate(often).view(np.uint64)), total


PLACES = "h long, id long, name long, start long, n long, bytes binary"
SPANS = "id long, name long, start long, stop long"


def repeated_spans(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 100, gram: int = 32, table_bits: int = 27, hot: int = HOT) -> DataFrame:
    """id, name (hash of the text), start, stop: byte spans to remove, which may touch or overlap."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("name"), F.col(text).alias("text"))

    def count(batches):
        for batch in batches:
            for _, _, data, offsets in tb.slices(batch.column(0)):
                found, n = np.unique(anchors(data, offsets, length, gram)[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n.astype(np.int64))], names=["h", "n"])

    seen = rows.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 1")
    bits, often, total = _bit_table(seen, table_bits, hot)
    table = spark.sparkContext.broadcast((bits, often))

    def places(batches):
        bits, often = table.value
        first: dict[int, tuple] = {}

        def repeats(contexts: np.ndarray, key: list[tuple]) -> np.ndarray:
            """Contexts that this task has seen at an earlier place: the map-side combine of copies."""
            again = np.zeros(len(key), bool)
            for i, c in enumerate(contexts.tolist()):
                if c not in first:
                    first[c] = key[i]
                elif first[c] < key[i]:
                    again[i] = True
                elif key[i] < first[c]:
                    first[c] = key[i]
            if len(first) > 300_000:
                first.clear()
            return again

        for batch in batches:
            ids, names = batch.column(0), batch.column(1).to_numpy()
            order = np.where(ids.is_null().to_numpy(zero_copy_only=False), np.iinfo(np.int64).min, ids.fill_null(0).to_numpy())
            for lo, _, data, offsets in tb.slices(batch.column(2)):
                h, start, stop, own = anchors(data, offsets, length, gram)
                slot = h & np.uint64((1 << table_bits) - 1)
                keep = np.flatnonzero(bits[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63)) & np.uint64(1))
                h, start, stop, own = h[keep], start[keep], stop[keep], own[keep]

                def keys(own: np.ndarray, start: np.ndarray) -> list[tuple]:
                    return list(zip(order[lo + own].tolist(), names[lo + own].tolist(), (start - offsets[own]).tolist()))

                again = repeats(tb.span_hashes(data, start, stop - 1 + length), keys(own, start))
                split = ~again & _held(often, h)
                for part in np.array_split(np.flatnonzero(~split), -(-len(h) // PLACES_OUT) or 1):
                    yield place_rows(h[part], start[part], stop[part], own[part], again[part], lo, ids, names, data, offsets)
                # Each window of a hot anchor is a place of its own, with its hash for an anchor.
                for at in range(0, int(split.sum()), SPLIT):
                    part = np.flatnonzero(split)[at : at + SPLIT]
                    n = stop[part] - start[part]
                    begin = np.repeat(start[part], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    owner = np.repeat(own[part], n)
                    window = tb.span_hashes(data, begin, begin + length)
                    known = repeats(window, keys(owner, begin))
                    yield place_rows(window, begin, begin + 1, owner, known, lo, ids, names, data, offsets)

    def place_rows(h, start, stop, own, again, lo, ids, names, data, offsets):
        left = np.flatnonzero(~again)
        raw, at = gather(data, start[left], stop[left] - 1 + length - start[left])
        sizes = np.zeros(len(h), np.int64)
        sizes[left] = np.diff(at)
        ends = np.zeros(len(h) + 1, np.int64)
        np.cumsum(sizes, out=ends[1:])
        value = pa.Array.from_buffers(pa.binary(), len(h), [pa.py_buffer(np.packbits(~again, bitorder="little").tobytes()),
                                      pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(raw.tobytes())])
        return pa.RecordBatch.from_arrays([
            pa.array(h.view(np.int64)), ids.take(pa.array(lo + own)), pa.array(names[lo + own]),
            pa.array(start - offsets[own]), pa.array(stop - start), value], names=["h", "id", "name", "start", "n", "bytes"])

    # A place without bytes is decided already; it travels with the others, spread by its own position.
    found = rows.mapInArrow(places, PLACES)
    deal = F.when(F.col("bytes").isNull(), F.xxhash64("name", "start")).otherwise(F.col("h"))
    # A task holds its partition's suffixes, hence more and smaller partitions than a shuffle has by default.
    parts = max(3 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // PART_PLACES))
    found = found.repartition(parts, deal).sortWithinPartitions("id", "name", "start")

    def match(batches):
        held = []
        for batch in batches:
            done = batch.filter(batch.column("bytes").is_null())
            start, n = done.column("start").to_numpy(), done.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays([done.column("id"), done.column("name"), done.column("start"), pa.array(start + n - 1 + length)], names=["id", "name", "start", "stop"])
            held.append(batch.filter(batch.column("bytes").is_valid()))
        if sum(b.num_rows for b in held):
            yield from _matches(_one_batch(held), length)

    return found.mapInArrow(match, SPANS)


def _one_batch(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    """All rows in one batch; 64-bit offsets, as 32-bit ones would cut it at 2 GB."""
    table = pa.Table.from_batches(batches)
    at = table.schema.get_field_index("bytes")
    (out,) = table.set_column(at, "bytes", table.column(at).cast(pa.large_binary())).combine_chunks().to_batches()
    return out


def _fresh(rows: pa.RecordBatch) -> np.ndarray:
    """False where a place is that of the row before: rows that repeat id and text send theirs once each, but are one document."""
    ids = rows.column("id")
    order = [ids.is_null().to_numpy(zero_copy_only=False), ids.fill_null(0).to_numpy(), rows.column("name").to_numpy(), rows.column("start").to_numpy()]
    out = np.ones(rows.num_rows, bool)
    out[1:] = np.any([x[1:] != x[:-1] for x in order], axis=0)
    return out


def _matches(rows: pa.RecordBatch, length: int):
    """Spans of one partition's places, which come in document order."""
    rows = rows.filter(pa.array(_fresh(rows)))
    h, start, n = (rows.column(x).to_numpy() for x in ("h", "start", "n"))
    values = rows.column("bytes")
    _, where, raw = values.buffers()
    offsets = np.frombuffer(where, np.int64)[values.offset : values.offset + len(values) + 1]
    data = np.frombuffer(raw, np.uint8)
    contexts = tb.span_hashes(data[offsets[0] : offsets[-1]], offsets[:-1] - offsets[0], offsets[1:] - offsets[0])
    _, first, inverse = np.unique(contexts, return_index=True, return_inverse=True)
    earliest = first[inverse] == np.arange(len(h))
    # An anchor with one context only repeats it whole; suffixes matter where an anchor has several contexts.
    kinds, kind = np.unique(h[first], return_inverse=True)
    several = np.zeros(len(h), bool)
    several[first] = np.bincount(kind, minlength=len(kinds))[kind] > 1

    def spans(place, a, b):
        own = pa.array(place)
        return pa.RecordBatch.from_arrays([
            rows.column("id").take(own), rows.column("name").take(own), pa.array(start[place] + a), pa.array(start[place] + b - 1 + length)], names=["id", "name", "start", "stop"])

    again = np.flatnonzero(~earliest)
    yield spans(again, np.zeros(len(again), np.int64), n[again])
    chosen = np.flatnonzero(several)
    family = Levels()
    at = 0
    ends = np.cumsum(n[chosen])
    while at < len(chosen):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + BATCH, "right")))
        part = chosen[at:to]
        place = np.repeat(part, n[part])
        step = np.arange(len(place)) - np.repeat(np.cumsum(n[part]) - n[part], n[part])
        suffixes = np.empty((len(place), length + 1), np.uint8)
        suffixes[:, :length] = np.lib.stride_tricks.sliding_window_view(data, length)[offsets[place] + step]
        suffixes[:, length] = 1  # a closing byte, as fixed-width strings drop zero bytes at their end
        marked = family.batch(suffixes.reshape(-1).view(f"S{length + 1}"))
        if marked.any():
            begins = np.flatnonzero(marked & ~np.r_[False, marked[:-1] & (place[1:] == place[:-1])])
            stops = np.flatnonzero(marked & ~np.r_[marked[1:] & (place[1:] == place[:-1]), False])
            yield spans(place[begins], step[begins], step[stops] + 1)
        at = to


def remove_repeats(docs: DataFrame, id: str = "doc_id", text: str = "text", length: int = 100, keep_bytes: bool = True) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 and, with ``keep_bytes``, kept (the remaining bytes) of every row.

    Texts are UTF-8 bytes (null: empty); matches never cross documents.  Documents stand in order of id, null
    first; rows with one id and different texts in order of the texts' hash; rows that repeat id and text are one
    document and get one result.  Strings are judged on the input.  Contexts are told apart by 64-bit hashes,
    suffixes by their bytes.
    """
    spans = repeated_spans(docs, id, text, length)
    spans = spans.groupBy("id", "name").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    rows = docs.select(F.col(id).cast("long").alias("id"), F.xxhash64(text).alias("name"), F.coalesce(text, F.lit("")).alias("text"))
    joined = rows.join(spans, rows["id"].eqNullSafe(spans["id"]) & (rows["name"] == spans["name"]), "left").select(rows["id"], "text", F.col("spans.start").alias("a"), F.col("spans.stop").alias("b"))

    def cut_out(batches):
        for batch in _pieces(batches, 500):
            out: list[tuple] = []
            for value, a, b in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                raw = value.encode("utf-8", "surrogatepass")
                if not a:
                    out.append((len(raw), 0, 0, hashlib.sha256(raw).hexdigest(), raw))
                    continue
                step = np.zeros(len(raw) + 1, np.int64)
                np.add.at(step, a, 1)
                np.add.at(step, b, -1)
                gone = np.cumsum(step)[:-1] > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                runs = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                out.append((len(raw), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest(), kept))
            columns = [batch.column(0), *(pa.array([r[k] for r in out], pa.int64()) for k in range(3)), pa.array([r[3] for r in out], pa.string())]
            if keep_bytes:
                columns.append(pa.array([r[4] for r in out], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"][: len(columns)])

    schema = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep_bytes else "")
    return joined.mapInArrow(cut_out, schema).withColumnRenamed("id", id)


def op8_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and kept_sha256 of every document."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep_bytes=False)
