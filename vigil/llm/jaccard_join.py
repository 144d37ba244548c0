"""N-gram Jaccard self-join by universe partition and the pigeonhole principle.

The universe of shingle hashes is cut into m equal ranges (segments).  Two sets that may link differ in at most H
shingles, and sum(t_i + 1) > H over the segments means that at least one segment i differs in at most t_i.
So it is enough to index each segment's subset (t = 0), or its subset and its one-deletion neighbourhood
(t = 1), and to compare the sets that share an entry.  m and H belong to a size band; a set near the top of a
band is entered in the next band too, so that every pair that may link meets in one band.  ``allocation`` picks
the t_i of a band by cost.

Work follows classes, not copies: documents with the same set are one node.  The pairs of classes that share an index entry are
pruned by sizes and by parity bitmaps, both exact bounds, and every remaining pair is verified on the texts themselves.
Entries with the same list of classes are one.  For components, pairs with an entry's smallest class come first and what
these links connect is not compared again.  The links inside a component are counted by blocks of its texts, so a dense
component makes no row for each of its pairs.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.functions.storage import Scratch, cut, small
from vigil.llm import textbuf as tb
from vigil.llm.graph import components
from vigil.llm.token_counts import _pieces

#: 64-bit words of a parity bitmap.
BITMAP = 8
#: Band borders grow by this factor.
BAND_GROWTH = 1.35
#: Class ids that may be broadcast, counted before.
BROADCAST_ROWS = 1_000_000
#: Shingles of about one block of a component's texts.
BLOCK_SHINGLES = 200_000


def most_difference(total: int, num: int, den: int) -> int:
    """Largest symmetric difference of two sets with ``total`` elements together and Jaccard >= num / den."""
    return total - 2 * -(-num * total // (num + den))


@dataclass(frozen=True)
class Band:
    """A size band: ``segments`` with t = 0, of which the first ``near`` have t = 1."""

    number: int
    low: int
    high: int
    difference: int
    segments: int
    near: int


def _at_least(mean: float, least: int) -> float:
    """Chance that a Poisson number reaches ``least``."""
    if least > mean + 12 * math.sqrt(mean) + 12:
        return 0.0
    term = total = math.exp(-mean)
    for k in range(1, least):
        term *= mean / k
        total += term
    return max(0.0, 1.0 - total) if least > 0 else 1.0


def allocation(difference: int, low: int, high: int, smallest: int, common: float) -> tuple[int, int]:
    """(segments, how many of them with t = 1) of the least cost for the sets of a band.

    A set of s shingles makes one entry for each segment with t = 0 and 1 + s / m entries for one with t = 1.
    Fewer, larger segments meet by chance less: with a share ``common`` of shingles that other sets have too, a subset
    of k shingles is shared with a chance of about common ** k.  A meeting costs as much as 50 entries.  Segments that are
    empty in both sets say nothing, so some are added to spare; a set (the ``smallest`` has the most) with so many
    empty ones that it must enter those too costs as much as 10,000 entries.
    """
    best, size = None, (low + high) / 2
    for near in range(0, min((difference + 1) // 2, 3) + 1):
        needed = max(0, difference + 1 - 2 * near)
        for spare in range(0, 1 if needed + near <= 1 else difference // 3 + 12):
            plain = needed + spare
            m = plain + near
            if not m:
                continue
            each = size / m
            empty = _at_least(plain * math.exp(-smallest / m), max(1, m + near - difference)) if m > 1 else 0.0
            cost = m + near * each + 50 * plain * common ** max(each, 1) + 50 * near * common ** max(each - 1, 1) + 10_000 * empty
            if best is None or cost < best[0]:
                best = (cost, m, near)
    return best[1], best[2]


@lru_cache(maxsize=4096)
def _band(number: int, low: int, num: int, den: int, common: float) -> Band:
    high = max(low, int(low * BAND_GROWTH))
    difference = max((most_difference(s, num, den) for s in range(max(1, 2 * high - 2 * den), 2 * high + 1)), default=0)
    m, near = allocation(max(difference, 0), low, high, -(-num * low // den), common)
    return Band(number, low, high, max(difference, 0), m, near)


@lru_cache(maxsize=256)
def bands(num: int, den: int, largest: int, common: float) -> tuple[Band, ...]:
    """The bands of sets of up to ``largest`` shingles at least."""
    out, low = [], 1
    while not out or low <= largest:
        out.append(_band(len(out), low, num, den, common))
        low = out[-1].high + 1
    return tuple(out)


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the ``size``-word windows of one text, or of the whole shorter text."""
    if not len(words):
        return words
    n = max(1, len(words) - size + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(size, len(words))):
        out = tb.mix(out * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return tb.mix(out + np.uint64(min(size, len(words))))


def entries(found: np.ndarray, band: Band) -> np.ndarray:
    """Index entries of a sorted set of hashes in a band."""
    edges = np.searchsorted(found, _edges(band.segments))
    mixed = tb.mix(found ^ np.uint64(0xA0761D6478BD642F))
    total = np.zeros(len(found) + 1, np.uint64)
    np.cumsum(mixed, out=total[1:])
    sums = total[edges[1:]] - total[edges[:-1]]
    sizes = np.diff(edges)
    salt = np.arange(band.segments, dtype=np.uint64) + np.uint64(band.number << 32)
    filled = sizes > 0
    # A pair has segments - difference near enough segments at least (t = 1 counts twice).  If both sets may have so
    # many empty ones with t = 0, those are entries as well.
    if (~filled)[band.near :].sum() >= max(1, band.segments + band.near - band.difference):
        filled[band.near :] = True
    out = [tb.mix(sums[filled] ^ tb.mix(salt[filled]))]
    for i in range(band.near):
        own = mixed[edges[i] : edges[i + 1]]
        out.append(tb.mix((sums[i : i + 1] - own) ^ tb.mix(salt[i : i + 1])))
        if not filled[i]:
            out.append(tb.mix(sums[i : i + 1] ^ tb.mix(salt[i : i + 1])))
    return np.unique(np.concatenate(out))


@lru_cache(maxsize=256)
def _edges(segments: int) -> np.ndarray:
    return np.array([(i << 64) // segments for i in range(segments)] + [2**64 - 1], dtype=np.uint64)


def bitmaps(found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parities of the set's hashes over as many bits as the set has elements, rounded up to a power of two, over half as
    many, and over 64 * BITMAP.  Two sets differ in at least as many elements as their bitmaps in bits.
    """
    width = max(64 * BITMAP, 1 << (len(found) - 1).bit_length())
    at = tb.mix(found ^ np.uint64(0xE7037ED1A0B428DB)) % np.uint64(width)
    odd = (np.bincount(at.astype(np.int64), minlength=width) & 1).astype(np.uint8)
    half = odd[: width // 2] ^ odd[width // 2 :]
    least = odd.reshape(-1, 64 * BITMAP).sum(0, dtype=np.int64) & 1
    return tuple(np.packbits(x.astype(np.uint8)).view(np.int64) for x in (odd, half, least))


SKETCH = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("n", T.LongType()), T.StructField("class", T.LongType()),
    *(T.StructField(x, T.ArrayType(T.LongType())) for x in ("bits", "half", "least")), T.StructField("entries", T.ArrayType(T.LongType()))])


def _class_of(found: np.ndarray) -> int:
    return int(tb.mix(np.array([np.sum(tb.mix(found)) + np.uint64(len(found))], np.uint64)).view(np.int64)[0])


def _sets(texts: pa.Array, size: int, lower: bool):
    """The sorted shingle hashes of each text, in slices: (first row, end row, sets)."""
    for lo, hi, data, offsets in tb.slices(texts):
        data = tb.LOWER[data] if lower else data
        starts, ends, firsts = tb.runs(tb.NOT_SPACE[data], offsets)
        words = tb.span_hashes(data, starts, ends)
        yield lo, hi, (np.unique(shingles(words[firsts[i] : firsts[i + 1]], size)) for i in range(hi - lo))


def sketches(docs: DataFrame, id: str, text: str, size: int, num: int, den: int, common: float, lower: bool = True) -> DataFrame:
    """id, n (set size), class (hash of the set), bitmap and index entries of each document.

    A task leaves bitmap and entries of a set empty where it has given them before; that is the map-side combine of
    copies.  Its memory of sets is bounded and starts anew when full.
    """
    def sketch(batches):
        seen: set[int] = set()
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, sets in _sets(batch.column(1), size, lower):
                sizes, classes, bits, keys = [], [], ([], [], []), []
                for found in sets:
                    sizes.append(len(found))
                    name = _class_of(found)
                    classes.append(name)
                    if not len(found) or name in seen:
                        for x in bits:
                            x.append(None)
                        keys.append(None)
                        continue
                    if len(seen) > 2_000_000:
                        seen.clear()
                    seen.add(name)
                    for x, own in zip(bits, bitmaps(found)):
                        x.append(own)
                    own = [b for b in bands(num, den, 2 << len(found).bit_length(), common)
                           if b.low <= len(found) <= b.high or (len(found) < b.low and den * len(found) >= num * b.low)]
                    keys.append(np.concatenate([entries(found, b) for b in own]).view(np.int64))
                yield pa.RecordBatch.from_arrays([
                    ids.slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(classes, pa.int64()),
                    *(pa.array(x, pa.list_(pa.int64())) for x in bits), pa.array(keys, pa.list_(pa.int64()))], names=SKETCH.names)

    return tb.mapped(docs.select(F.col(id).cast("long"), text), sketch, SKETCH)


def _meetings(batches):
    """(entry, class, first): rows of each entry with two or more classes, from rows sorted by entry.

    The entry given is the hash of its list of classes, so entries that bring the same classes together become equal rows;
    were two lists to share a hash, their classes would meet all the same.
    """
    def give(entry, name):
        order = np.lexsort((name, entry))
        entry, name = entry[order], name[order]
        fresh = np.r_[True, (entry[1:] != entry[:-1]) | (name[1:] != name[:-1])]
        entry, name = entry[fresh], name[fresh]
        start = np.flatnonzero(np.r_[True, entry[1:] != entry[:-1]])
        n = np.diff(np.r_[start, len(entry)])
        keep = np.repeat(n > 1, n)
        if len(entry):
            lists = np.add.reduceat(tb.mix(name.view(np.uint64)), start)
            entry = np.repeat(tb.mix(lists + n.astype(np.uint64)).view(np.int64), n)
        return pa.RecordBatch.from_arrays([pa.array(entry[keep]), pa.array(name[keep]), pa.array(np.repeat(name[start], n)[keep])], names=["entry", "class", "first"])

    held_e, held_c = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        entry = np.concatenate([held_e, batch.column(0).to_numpy()])
        name = np.concatenate([held_c, batch.column(1).to_numpy()])
        cut_at = int(np.searchsorted(entry, entry[-1])) if len(entry) else 0
        if cut_at:
            yield give(entry[:cut_at], name[:cut_at])
        held_e, held_c = entry[cut_at:], name[cut_at:]
    if len(held_e):
        yield give(held_e, held_c)


def _size_may_link(a: str, b: str, num: int, den: int):
    low, high = F.least(a, b), F.greatest(a, b)
    return den * low >= num * high


def _apart(x, y):
    """Bits in which two bitmaps of one width differ."""
    return F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, n: total + n)


def _apart_least(x: str, y: str):
    apart = F.lit(0)
    for i in range(BITMAP):
        apart = apart + F.bit_count(F.col(x)[i].bitwiseXOR(F.col(y)[i]))
    return apart


def _may_differ(apart, a: str, b: str, num: int, den: int):
    return apart * (num + den) <= (den - num) * (F.col(a) + F.col(b))


def class_texts(wanted: DataFrame, docs: DataFrame, id: str, text: str, size: int, lower: bool) -> DataFrame:
    """class and text of the stored rows (class, rep); rows that repeat an id may repeat a class."""
    wanted, _ = small(wanted, BROADCAST_ROWS)
    texts = docs.select(F.col(id).cast("long").alias("rep"), F.col(text).alias("text"))

    def own_class(batches):
        # Rows may repeat an id with another text; only the text of the class stays.
        for batch in batches:
            names = batch.column(0).to_numpy()
            same = np.zeros(batch.num_rows, bool)
            for lo, _, found in _sets(batch.column(1), size, lower):
                for i, x in enumerate(found, lo):
                    same[i] = _class_of(x) == names[i]
            yield batch.filter(pa.array(same))

    return tb.mapped(texts.join(wanted, "rep").select("class", "text"), own_class, "class long, text string")


def _shingle_set(value: str, size: int, lower: bool) -> set:
    data = value.encode("utf-8", "surrogatepass")
    words = (data.lower() if lower else data).split()
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def linked(pairs: DataFrame, docs: DataFrame, members: DataFrame, id: str, text: str, size: int, num: int, den: int,
           lower: bool = True, per_group: int = 200, cut=cut) -> DataFrame:
    """The pairs (a, b) of classes whose word shingles, compared as text, reach the Jaccard of num / den.

    Each pair brings the text of b to the group of a; a popular a is split into groups of about ``per_group`` pairs
    with a copy of its text each.
    """
    wanted = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(members, "class").select("class", "rep")
    texts = cut(class_texts(cut(wanted, "wanted"), docs, id, text, size, lower), "texts")
    load = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / per_group).alias("parts"))
    heads = load.select(F.col("a").alias("class"), F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("part"))
    tails = pairs.join(load, "a").select("a", F.pmod(F.xxhash64("b"), F.col("parts")).cast("int").alias("part"), F.col("b").alias("class"))
    head_rows = texts.join(heads, "class").select(F.col("class").alias("a"), "part", F.lit(None).cast("long").alias("b"), "text")
    tail_rows = texts.join(tails, "class").select("a", "part", F.col("class").alias("b"), "text")

    def verify(batches):
        at, own = None, []

        for batch in _pieces(batches, 500):
            out_a, out_b = [], []
            for a, part, b, value in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if (a, part) != at:
                    at, own = (a, part), []
                found = _shingle_set(value or "", size, lower)
                if b is None:
                    own.append(found)
                    continue
                for head in own:
                    both = len(head & found)
                    if den * both >= num * (len(head) + len(found) - both) and both:
                        out_a.append(a)
                        out_b.append(b)
                        break
            yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], names=["a", "b"])

    rows = head_rows.union(tail_rows).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    # A repeated row brings a text twice.
    return tb.mapped(rows, verify, "a long, b long").distinct()


def _links_of(left: list[np.ndarray], right: list[np.ndarray] | None, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """How many sets of ``right`` each set of ``left`` links with, and the other way round; None: ``left`` with itself."""
    other = left if right is None else right
    sizes = np.fromiter(map(len, other), np.int64, len(other))
    owner, value = np.repeat(np.arange(len(other)), sizes), np.concatenate([*other, np.zeros(0, np.int64)])
    order = np.argsort(value, kind="stable")
    owner, value = owner[order], value[order]
    mine, theirs = np.zeros(len(left), np.int64), np.zeros(len(other), np.int64)
    for k, found in enumerate(left):
        lo, hi = np.searchsorted(value, found), np.searchsorted(value, found, "right")
        n = hi - lo
        both = np.bincount(owner[np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(other))
        link = (both > 0) & (den * both >= num * (len(found) + sizes - both))
        if right is None:
            link[k] = False
        mine[k] = link.sum()
        theirs += link
    return mine, theirs


def links_inside(groups: DataFrame, texts: DataFrame, size: int, num: int, den: int, lower: bool) -> DataFrame:
    """class and n_links of the rows (class, component, parts): links with other classes of the component.

    A component's classes are dealt to ``parts`` blocks, and each two blocks, or one with itself, are compared together on the
    texts: a class makes ``parts`` rows, and a task holds two blocks.
    """
    own = F.pmod(F.xxhash64("class"), "parts").cast("int")
    dealt = groups.select("class", "component", own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts").cast("int") - 1)).alias("to"))
    dealt = dealt.select("class", "component", F.least("block", "to").alias("i"), F.greatest("block", "to").alias("j"), "block")
    rows = texts.join(dealt, "class").select("component", "i", "j", "block", "class", "text")
    rows = rows.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j")

    def count(batches):
        at, held, numbers = None, ({}, {}), {}

        def done():
            left, right = (list(x.values()) for x in held)
            mine, theirs = _links_of(left, right if at[1] < at[2] else None, num, den)
            names = [*held[0], *held[1]]
            n = np.concatenate([mine, theirs]) if at[1] < at[2] else mine
            return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(n, pa.int64())], names=["class", "n_links"])

        for batch in _pieces(batches, 500):
            for component, i, j, block, name, value in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if (component, i, j) != at:
                    if at:
                        yield done()
                    at, held, numbers = (component, i, j), ({}, {}), {}
                side = held[0 if block == i else 1]
                if name not in side:  # a repeated row brings a text twice
                    found = _shingle_set(value or "", size, lower)
                    side[name] = np.fromiter((numbers.setdefault(x, len(numbers)) for x in found), np.int64, len(found))
        if at:
            yield done()

    return tb.mapped(rows, count, "class long, n_links long").groupBy("class").agg(F.sum("n_links").alias("n_links"))


def jaccard_components(docs: DataFrame, id: str = "doc_id", text: str = "text", size: int = 4, num: int = 85, den: int = 100,
                       common: float = 0.3, lower: bool = True, every_link: bool = True) -> DataFrame:
    """id, n_shingles, class, n_links and component_id of every document.

    Words are `[^\\x20\\x09-\\x0D]+` of the text (A-Z lower-cased); a set holds the distinct ``size``-word shingles, of a
    shorter text its whole word sequence, of a null, empty or blank text nothing, and then it links with nothing.
    Documents link when ``den`` * intersection >= ``num`` * union; ``component_id`` is the smallest id that links
    reach, ``n_links`` counts the other sets that the document's set links with.  Without ``every_link`` only links
    enough to span the components are looked for, which gives the same components and no ``n_links``.
    Rows that repeat an id each give a row; other columns are not carried.
    """
    scratch = Scratch(docs.sparkSession)
    cut = scratch.cut
    stored = cut(sketches(docs, id, text, size, num, den, common, lower), "sketches")
    members = cut(stored.where("n > 0").groupBy("class").agg(F.min("id").alias("rep"), F.first("n").alias("n"), *(F.first(x, ignorenulls=True).alias(x) for x in ("bits", "half", "least"))), "classes")
    rows = stored.where("entries is not null").select(F.explode("entries").alias("entry"), "class")
    rows = rows.repartition("entry").sortWithinPartitions("entry")
    met = cut(rows.mapInArrow(_meetings, "entry long, class long, first long").distinct(), "meetings")

    # Bits in which the widest bitmaps of one width differ; 0, which prunes nothing, where two classes have none.
    apart = (F.when(F.size("xa") == F.size("xb"), _apart("xa", "xb")).when(F.size("xa") == F.size("hb"), _apart("xa", "hb"))
             .when(F.size("ha") == F.size("xb"), _apart("ha", "xb")).otherwise(0))

    def pruned(pairs: DataFrame) -> DataFrame:
        a = members.select(F.col("class").alias("a"), F.col("n").alias("na"), F.col("bits").alias("xa"), F.col("half").alias("ha"))
        b = members.select(F.col("class").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("xb"), F.col("half").alias("hb"))
        out = pairs.join(a, "a").join(b, "b").where(_size_may_link("na", "nb", num, den)).where(_may_differ(apart, "na", "nb", num, den))
        return out.select("a", "b")

    def verified(pairs: DataFrame) -> DataFrame:
        return cut(linked(pairs, docs, members, id, text, size, num, den, lower, cut=cut), "links")

    def parts(joined: DataFrame) -> DataFrame:
        return met.join(joined.select(F.col("node").alias("class"), "component"), "class", "left").select(
            "entry", "class", F.coalesce("component", "class").alias("component"))

    def spanning() -> tuple[DataFrame, DataFrame, DataFrame]:
        """Links between near classes of an entry, the pairs that were compared for them, and their components."""
        first = cut(pruned(met.where(F.col("first") != F.col("class")).select(F.col("first").alias("a"), F.col("class").alias("b")).distinct()), "pairs")
        links = verified(first)
        joined = components(links, cut=cut)

        # Entries that these links leave apart compare their classes with another one of them, twice; one order of all
        # classes names it, so a large group of near copies meets few of them and grows together by a row for each class.
        tried = first
        for again in range(2):
            part = parts(joined)
            named = part.groupBy("entry").agg(F.min("component").alias("x"), F.max("component").alias("y"), F.min_by(
                F.struct("class", "component"), F.struct(F.xxhash64("class", F.lit(again)), "class")).alias("head")).where("x <> y")
            ahead = part.join(named.select("entry", "head"), "entry").where(F.col("component") != F.col("head.component"))
            ahead = ahead.select(F.least("head.class", "class").alias("a"), F.greatest("head.class", "class").alias("b")).distinct()
            more = cut(pruned(cut(ahead, "ahead").join(tried, ["a", "b"], "left_anti")), "pairs")
            links = cut(links.union(verified(more)), "links")
            tried = cut(tried.union(more), "tried")
            joined = components(links, cut=cut)
        return links, tried, joined

    def across(part: DataFrame) -> DataFrame:
        """The pairs of an entry's classes from different components that may link.

        The bitmaps are compared inside the join, the narrow ones first, so that of a large group only such pairs leave it.
        """
        sized = part.join(members.select("class", "n", "least", "bits", "half"), "class")
        a = sized.select("entry", F.col("class").alias("a"), F.col("component").alias("ca"), F.col("n").alias("na"), F.col("least").alias("la"), F.col("bits").alias("xa"), F.col("half").alias("ha"))
        b = sized.select("entry", F.col("class").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("least").alias("lb"), F.col("bits").alias("xb"), F.col("half").alias("hb"))
        pairs = a.join(b, (a["entry"] == b["entry"]) & (F.col("a") < F.col("b")) & (F.col("ca") != F.col("cb"))
                       & _size_may_link("na", "nb", num, den) & _may_differ(_apart_least("la", "lb"), "na", "nb", num, den) & _may_differ(apart, "na", "nb", num, den))
        return cut(pairs.select("a", "b").distinct(), "across")

    links, tried, joined = spanning()
    part = parts(joined)
    open_entries = part.groupBy("entry").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y").select("entry")
    second = across(part.join(open_entries, "entry"))
    links = cut(links.union(verified(cut(second.join(tried, ["a", "b"], "left_anti"), "pairs"))), "links")
    joined = components(links, cut=cut)

    def degrees() -> DataFrame:
        """class and n_links: by blocks where a component's entries pair its classes more often than blocks copy them, by pairs in others."""
        inside = cut(joined.select(F.col("node").alias("class"), "component").join(members.select("class", "rep", "n"), "class"), "inside")
        shared = met.join(inside.select("class", "component"), "class")
        paired = shared.groupBy("entry", "component").agg(F.count(F.lit(1)).alias("k")).groupBy("component").agg(F.sum(F.col("k") * (F.col("k") - 1)).alias("paired"))
        sizes = inside.groupBy("component").agg(F.count(F.lit(1)).alias("g"), F.ceil(F.sum("n") / BLOCK_SHINGLES).alias("parts"))
        sizes = cut(sizes.join(paired, "component").withColumn("dense", F.col("g") * F.col("parts") <= F.col("paired")), "sizes")
        groups = cut(inside.join(sizes.where("dense").select("component", "parts"), "component"), "groups")
        out = links_inside(groups.select("class", "component", "parts"), class_texts(groups.select("class", "rep"), docs, id, text, size, lower), size, num, den, lower)
        sparse = sizes.where("not dense").select("component")
        if not sparse.isEmpty():
            apart_rows = shared.join(sparse, "component").select(F.xxhash64("entry", "component").alias("entry"), "class", F.col("class").alias("component"))
            found = verified(across(apart_rows))
            out = out.union(found.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count(F.lit(1)).alias("n_links")))
        return out

    named = members.join(joined.select(F.col("node").alias("class"), "component"), "class", "left").select(
        "class", "rep", F.coalesce("component", "class").alias("component"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    named = named.join(least, "component").select("class", "component_id")
    if every_link:
        named = named.join(degrees(), "class", "left")
    counted = [F.coalesce("n_links", F.lit(0)).alias("n_links")] if every_link else []
    out = stored.select("id", F.col("n").alias("n_shingles"), "class").join(named, "class", "left").select(
        F.col("id").alias(id), "n_shingles", "class", *counted, F.coalesce("component_id", "id").alias("component_id"))
    return scratch.last(out, "near-duplicates")


def op9_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    out = jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "n_shingles", "component_id", "n_links")
