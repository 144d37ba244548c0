"""Language of every word and text by a linear-chain conditional random field.

The words of a text (runs of letters and marks, simple lower case; a run of over 24 code points counts as several) are a chain of
labels, the languages.  A word speaks for a label by the weights of its features: itself, its prefixes and suffixes of 1 to 4
code points, its n-grams of 1 to 3 with marks for its ends (all hashed to buckets), and its lexicon values, the log ratios of
its counts in each language.  Learned transitions say how often a text switches.  Forward-backward gives each word the
probability of each label; a text's language is the label with the largest sum, its score that label's share.

Training: the lexicon counts all words of all texts that may be learned from.  The chain's weights come from a bounded sample, of each language
the ``texts_each`` distinct texts with the smallest hash and of each of these ``stretch`` words from a place that the hash
names; stretches of all languages are dealt in turn into chains that switch, and L-BFGS raises the chains' likelihood.

Defined results: a null, empty or letterless text is ``und`` with score 0, and so is every text when nothing could be learned; with one language
all others are that language with score 1.  Equal texts have equal results, whatever their ids or copies; of equal sums the first label
in code point order wins.  Rows with a null language or text, or a null key where a condition on the key decides, are not learned from.
Texts of any length are taken whole: emissions are made in panels, and the chain runs in blocks whose transfer matrices are combined,
exactly, so no recursion is longer than the square root of a text in Python.  Columns beside the named ones are not read.
"""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.storage import cut, small
from vigil.llm import textbuf as tb
from vigil.llm.toxicity import _lbfgs

#: Longest word in code points; hashed features; hashed words of the lexicon, at most, and its cells over all languages.
LONGEST = 24
BITS = 16
WORD_BITS, WORD_CELLS = 17, 1 << 23
AFFIXES, GRAMS = 4, 3
CHAIN = 48
UNKNOWN = "und"


@lru_cache(maxsize=1)
def _alphabet() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point: is it a letter, is it a letter or mark, and its simple lower case."""
    known = 0x32400  # no letters are assigned beyond
    letter = np.zeros(0x110000, bool)
    inside = np.zeros(0x110000, bool)
    lower = np.arange(0x110000, dtype=np.uint32)
    for c in range(known):
        kind = unicodedata.category(chr(c))
        if kind[0] == "L":
            letter[c] = inside[c] = True
            small = chr(c).lower()
            if len(small) == 1:
                lower[c] = ord(small)
        elif kind[0] == "M":
            inside[c] = True
    return letter, inside, lower


def code_points(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Code points of texts that lie back to back, and each text's first (n + 1); broken bytes become U+FFFD."""
    leads = np.zeros(len(data) + 1, np.int64)
    np.cumsum(tb.LEADS[data], out=leads[1:])
    points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    if len(points) == leads[-1]:
        return points, leads[offsets]
    parts = [np.frombuffer(data[a:b].tobytes().decode("utf-8", "replace").encode("utf-32-le"), np.uint32) for a, b in zip(offsets, offsets[1:])]
    at = np.zeros(len(offsets), np.int64)
    np.cumsum([len(p) for p in parts], out=at[1:])
    return np.concatenate(parts) if parts else points, at


@dataclass(frozen=True)
class Words:
    """Words of texts back to back: places in ``points``, each text's first word, and the distinct words."""

    points: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    firsts: np.ndarray
    #: first place of each distinct word, the distinct word of each word, and the distinct words' hashes
    where: np.ndarray
    number: np.ndarray
    hashes: np.ndarray


def words_of(data: np.ndarray, offsets: np.ndarray) -> Words:
    letter, inside, lower = _alphabet()
    points, at = code_points(data, offsets)
    starts, ends, _ = tb.runs(inside[points], at)
    letters = np.zeros(len(points) + 1, np.int64)
    np.cumsum(letter[points], out=letters[1:])
    some = letters[ends] > letters[starts]
    starts, ends = starts[some], ends[some]
    pieces = -(-(ends - starts) // LONGEST)
    if len(pieces) and pieces.max() > 1:
        step = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        starts, ends = np.repeat(starts, pieces) + step * LONGEST, np.repeat(ends, pieces)
        ends = np.minimum(ends, starts + LONGEST)
    points = lower[points]
    total = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(tb.mix(points.astype(np.uint64) + np.uint64(1)) * tb.powers(tb.BASE, len(points)), out=total[1:])
    hashes = tb.mix((total[ends] - total[starts]) * tb.powers(tb.INVERSE, len(points) + 1)[starts] + (ends - starts).astype(np.uint64))
    hashes, where, number = np.unique(hashes, return_index=True, return_inverse=True)
    return Words(points, starts, ends, np.searchsorted(starts, at), where, number, hashes)


def features(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(distinct word, bucket) of the hashed features, ordered by word."""
    starts, lengths = w.starts[w.where], (w.ends - w.starts)[w.where]
    count = len(starts)
    own, buckets = [np.arange(count)], [w.hashes >> np.uint64(64 - BITS)]

    def add(words, kind: int, h: np.ndarray):
        h = tb.mix(h * np.uint64(0x9E3779B1) + np.uint64(kind))
        own.append(words)
        buckets.append(h >> np.uint64(64 - BITS))

    for side, kind in ((1, 100), (-1, 200)):
        h = np.zeros(count, np.uint64)
        for n in range(1, AFFIXES + 1):
            live = np.flatnonzero(lengths >= n)
            if not len(live):
                break
            place = starts[live] + n - 1 if side > 0 else starts[live] + lengths[live] - n
            h[live] = h[live] * np.uint64(0x100000001B3) + w.points[place].astype(np.uint64) + np.uint64(1)
            add(live, kind + n, h[live])
    # Each distinct word between two end marks, back to back.
    wide = lengths + 2
    ends = np.cumsum(wide)
    word = np.repeat(np.arange(count), wide)
    step = np.arange(len(word)) - np.repeat(ends - wide, wide)
    last = step == np.repeat(wide, wide) - 1
    marked = np.where((step == 0) | last, np.uint64(1), w.points[np.clip(np.repeat(starts, wide) + step - 1, 0, max(len(w.points) - 1, 0))].astype(np.uint64) + np.uint64(2))
    h = np.zeros(len(marked), np.uint64)
    for n in range(1, GRAMS + 1):
        h = h[: max(len(marked) - n + 1, 0)] * np.uint64(0x100000001B3) + marked[n - 1 :]
        live = np.flatnonzero(step[: len(h)] + n <= np.repeat(wide, wide)[: len(h)])
        add(word[live], 300 + n, h[live])
    own, buckets = np.concatenate(own), np.concatenate(buckets).astype(np.int64)
    order = np.argsort(own, kind="stable")
    return own[order], buckets[order]


@dataclass(frozen=True)
class Model:
    """Weights by bucket and label, lexicon values by word bucket and language, their weights by language and label, start and transition weights."""

    labels: tuple[str, ...]
    weights: np.ndarray
    lexicon: np.ndarray
    lexicon_weights: np.ndarray
    start: np.ndarray
    moves: np.ndarray

    def emissions(self, w: Words) -> np.ndarray:
        """Weights of every distinct word for every label."""
        if not len(w.where):
            return np.zeros((0, len(self.labels)))
        own, bucket = features(w)
        out = np.add.reduceat(self.weights[bucket], np.searchsorted(own, np.arange(len(w.where))), axis=0)
        return out + self.lexicon[lexicon_bucket(w.hashes, len(self.lexicon))] @ self.lexicon_weights


def lexicon_bucket(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes & np.uint64(size - 1)).astype(np.int64)


def marginals(emissions: np.ndarray, firsts: np.ndarray, start: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """Probability of each label for each word of chains that lie back to back, by forward-backward.

    Chains are cut into blocks; all blocks step together, first as transfer matrices, then as vectors that
    enter from the blocks before and after.  Every product is scaled, so lengths do not matter.
    """
    n, k = emissions.shape
    lengths = np.diff(firsts)
    if not n:
        return np.zeros((0, k))
    width = max(32, n * k * k // (1 << 22) + 1)
    per = -(-lengths // width)
    base = np.cumsum(per) - per
    blocks = int(per.sum())
    chain = np.repeat(np.arange(len(lengths)), per)
    inner = np.arange(blocks) - base[chain]
    begin = firsts[chain] + inner * width
    size = np.minimum(lengths[chain] - inner * width, width)
    width = int(size.max())
    word = np.exp(emissions - emissions.max(1, keepdims=True))
    move, enter = np.exp(moves - moves.max()), np.exp(start - start.max())
    first = inner == 0

    def scaled(x):
        return x / np.maximum(x.reshape(len(x), -1).max(1), 1e-300).reshape(-1, *[1] * (x.ndim - 1))

    matrix = np.broadcast_to(np.eye(k), (blocks, k, k)).copy()
    for j in range(width):
        live = np.flatnonzero(size > j)
        moved = (matrix[live].reshape(-1, k) @ move).reshape(-1, k, k)
        if j == 0:
            moved[first[live]] = matrix[live[first[live]]]
        matrix[live] = scaled(moved * word[begin[live] + j][:, None, :])
    into, out = np.zeros((blocks, k)), np.zeros((blocks, k))
    vector, order = np.tile(enter, (len(lengths), 1)), np.argsort(-per, kind="stable")
    alive = np.searchsorted(-per[order], -np.arange(int(per.max())), "left")  # chains with more than j blocks
    for j in range(int(per.max())):
        c = order[: alive[j]]
        into[base[c] + j] = vector[c]
        vector[c] = scaled(np.einsum("ck,ckl->cl", vector[c], matrix[base[c] + j]))
    vector = np.ones((len(lengths), k))
    for j in range(int(per.max()) - 1, -1, -1):
        c = order[: alive[j]]
        out[base[c] + j] = vector[c]
        vector[c] = scaled(np.einsum("ckl,cl->ck", matrix[base[c] + j], vector[c]))
    del matrix
    ahead = np.zeros((n, k))
    vector = into
    for j in range(width):
        live = np.flatnonzero(size > j)
        moved = vector[live] @ move
        if j == 0:
            moved[first[live]] = vector[live[first[live]]]
        vector[live] = scaled(moved * word[begin[live] + j])
        ahead[begin[live] + j] = vector[live]
    vector = out
    for j in range(width - 1, -1, -1):
        live = np.flatnonzero(size > j)
        at = begin[live] + j
        ahead[at] *= vector[live]
        vector[live] = scaled((word[at] * vector[live]) @ move.T)
    return ahead / ahead.sum(1, keepdims=True)


def chain_loss(emissions: np.ndarray, labels: np.ndarray, start: np.ndarray, moves: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
    """Negative log likelihood of chains of one length (chain, place, label) and its slopes by emission, start and transition."""
    c, length, k = emissions.shape
    top = emissions.max(2)
    word = np.exp(emissions - top[:, :, None])
    move, enter = np.exp(moves), np.exp(start)
    ahead, scale = np.zeros_like(emissions), np.zeros((c, length))
    vector = enter * word[:, 0]
    for t in range(length):
        if t:
            vector = (vector @ move) * word[:, t]
        scale[:, t] = vector.sum(1)
        vector = vector / scale[:, t, None]
        ahead[:, t] = vector
    rows = np.arange(c)
    right = np.take_along_axis(emissions, labels[:, :, None], 2).sum() + start[labels[:, 0]].sum() + moves[labels[:, :-1], labels[:, 1:]].sum()
    loss = float(np.log(scale).sum() + top.sum() - right)
    behind, by_move = np.ones((c, k)), np.zeros((k, k))
    by_word = np.empty_like(emissions)
    for t in range(length - 1, -1, -1):
        own = ahead[:, t] * behind
        by_word[:, t] = own / own.sum(1, keepdims=True)
        if t:
            later = word[:, t] * behind
            pair = ahead[:, t - 1, :, None] * move * later[:, None, :]
            by_move += (pair / pair.sum((1, 2), keepdims=True)).sum(0)
            behind = later @ move.T
            behind = behind / behind.max(1, keepdims=True)
    by_start = by_word[:, 0].sum(0) - np.bincount(labels[:, 0], minlength=k)
    by_move -= np.bincount((labels[:, :-1] * k + labels[:, 1:]).ravel(), minlength=k * k).reshape(k, k)
    by_word[rows[:, None], np.arange(length), labels] -= 1
    return loss, by_word, by_start, by_move


def learn_chain(stretches: dict[str, list[list[str]]], labels: tuple[str, ...], lexicon: np.ndarray, penalty: float, rounds: int) -> Model:
    """Weights by L-BFGS from stretches of words in each language, dealt into chains of ``CHAIN`` words that switch."""
    k = len(labels)
    random = np.random.Generator(np.random.PCG64(11))
    pools = [[s for s in stretches[x] if s] for x in labels]
    words, y = [], []
    for i in range(max(len(p) for p in pools)):
        for label in random.permutation(k):
            own = pools[label][i % len(pools[label])]
            at = 0
            while at < len(own):
                take = int(random.integers(4, 2 * CHAIN))
                words.append(own[at : at + take])
                y.append(int(label))
                at += take
    order = random.permutation(len(words))
    flat = [w for i in order for w in words[i]]
    gold = np.repeat(np.array(y)[order], [len(words[i]) for i in order])
    short = -len(flat) % CHAIN
    flat, gold = flat + flat[:1] * short, np.append(gold, np.repeat(gold[:1], short))
    gold = gold.reshape(-1, CHAIN)
    # One word a text, so a word is never split or joined.
    raw = [w.encode() for w in flat]
    offsets = np.cumsum([0, *map(len, raw)])
    w = words_of(np.frombuffer(b"".join(raw), np.uint8), offsets)
    own, bucket = features(w)
    used, slot = np.unique(bucket, return_inverse=True)
    edges = np.searchsorted(own, np.arange(len(w.where)))
    values = lexicon[lexicon_bucket(w.hashes, len(lexicon))]
    cuts = np.cumsum([len(used) * k, k * k, k])

    def parts(x):
        a, b, c, d = np.split(x, cuts)
        return a.reshape(-1, k), b.reshape(k, k), c, d.reshape(k, k)

    def loss(x):
        a, b, start, moves = parts(x)
        each = np.add.reduceat(a[slot], edges, axis=0) + values @ b
        f, by_word, by_start, by_move = chain_loss(each[w.number].reshape(-1, CHAIN, k), gold, start, moves)
        by_word = by_word.reshape(-1, k)
        summed = np.stack([np.bincount(w.number, by_word[:, i], len(w.where)) for i in range(k)], 1)
        by_a = np.stack([np.bincount(slot, summed[own, i], len(used)) for i in range(k)], 1)
        g = np.concatenate([by_a.ravel(), (values.T @ summed).ravel(), by_start, by_move.ravel()])
        return (f + penalty / 2 * (x @ x)) / len(flat), (g + penalty * x) / len(flat)

    a, b, start, moves = parts(_lbfgs(loss, np.zeros(cuts[-1] + k * k), rounds=rounds))
    weights = np.zeros((1 << BITS, k), np.float32)
    weights[used] = a
    return Model(labels, weights, lexicon, b, start, moves)


def _counted(rows: DataFrame, labels: tuple[str, ...], size: int) -> np.ndarray:
    """Counts of all words of all ``rows`` (lang, text) by word bucket and language."""
    number = {x: i for i, x in enumerate(labels)}
    k = len(labels)

    def count(batches):
        total = np.zeros(size * k, np.int64)
        for batch in batches:
            own = np.array([number.get(x, -1) for x in batch.column(0).to_pylist()], np.int64)
            for lo, hi, data, offsets in tb.slices(batch.column(1)):
                for d, o, which in _in_panels(data, offsets):
                    w = words_of(d, o)
                    text = own[lo + which][np.repeat(np.arange(len(o) - 1), np.diff(w.firsts))]
                    cell = lexicon_bucket(w.hashes, size)[w.number] * k + text
                    total += np.bincount(cell[text >= 0], minlength=size * k)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["cell", "n"])

    cells = tb.mapped(rows, count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(size * k)
    out[cells["cell"].to_numpy()] = cells["n"].to_numpy()
    return out.reshape(size, k)


def _in_panels(data: np.ndarray, offsets: np.ndarray):
    """(bytes, offsets, number of each text) of a slice; a text longer than two slices comes in panels."""
    if len(data) <= 2 * tb.SLICE_BYTES or len(offsets) != 2:
        yield data, offsets, np.arange(len(offsets) - 1)
        return
    for at, to in tb.panels(data, 0, len(data)):
        yield data[at:to], np.array([0, to - at]), np.zeros(1, np.int64)


def train(docs: DataFrame, lang: str = "lang", text: str = "text", may_learn: Column | None = None,
          texts_each: int = 400, stretch: int = 64, smoothing: float = 0.5, penalty: float = 1.0, rounds: int = 60) -> Model:
    """Learns from the rows of ``docs`` with a language and a text for which ``may_learn`` holds.

    The sample of the chain is bounded by ``texts_each`` distinct texts of a language and ``stretch`` words of each.
    """
    rows = docs.where(F.col(lang).isNotNull() & F.col(text).isNotNull())
    rows = (rows if may_learn is None else rows.where(may_learn)).select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"))
    # Distinct texts by hash; a language's smallest hashes lie below a bound that follows from its count.
    texts = rows.select("lang", F.xxhash64("text").alias("h")).distinct()
    texts = cut(texts, "language_texts")
    sizes, _ = small(cut(texts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")), "language_sizes"), 10_000)
    place = (F.shiftrightunsigned(F.col("h"), 1).cast("double") / F.lit(2.0**63))
    near = texts.join(sizes, "lang").where(place * F.col("n") <= F.lit(4.0 * texts_each + 50))
    order = Window.partitionBy("lang").orderBy(F.shiftrightunsigned(F.col("h"), 1), "h")
    chosen = cut(near.select("lang", "h", F.row_number().over(order).alias("k")).where(F.col("k") <= texts_each).select("lang", "h"), "language_sample")

    def take(batches):
        for batch in batches:
            out = []
            for lo, hi, data, offsets in tb.slices(batch.column(2)):
                for d, o, which in _in_panels(data, offsets):
                    w = words_of(d, o)
                    for i, (a, b) in enumerate(zip(w.firsts, w.firsts[1:])):
                        if b > a:
                            row = lo + int(which[i])
                            h = batch.column(1)[row].as_py()
                            at = int(a) + (h & (2**63 - 1)) % max(1, int(b - a) - stretch + 1)
                            spans = [w.points[s:e].tobytes().decode("utf-32-le") for s, e in zip(w.starts[at : min(at + stretch, b)], w.ends[at : min(at + stretch, b)])]
                            out.append((batch.column(0)[row].as_py(), h, spans))
            columns = list(zip(*out)) if out else [[], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.string()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.string()))], names=["lang", "h", "words"])

    picked = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(chosen), ["lang", "h"], "left_semi").select("lang", "h", "text")
    one = tb.mapped(picked, take, "lang string, h long, words array<string>").groupBy("lang", "h").agg(F.max("words").alias("words"))
    stretches: dict[str, list[list[str]]] = {}
    for r in sorted(one.collect(), key=lambda r: (r["lang"], r["h"])):
        stretches.setdefault(r["lang"], []).append(r["words"])
    labels = tuple(sorted(stretches))
    if len(labels) < 2:
        k = len(labels)
        return Model(labels, np.zeros((1 << BITS, k), np.float32), np.zeros((1, k)), np.zeros((k, k)), np.zeros(k), np.zeros((k, k)))
    size = 1 << min(WORD_BITS, (WORD_CELLS // len(labels)).bit_length() - 1)
    counts = _counted(rows, labels, size)
    share = np.log((counts + smoothing) / (counts.sum(0) + smoothing * size))
    lexicon = (np.clip(share - share.mean(1, keepdims=True), -6, 6) / 3).astype(np.float32)
    return learn_chain(stretches, labels, lexicon, penalty, rounds)


def _posteriors(model: Model, data: np.ndarray, offsets: np.ndarray):
    """Marginals of all words of a slice, each text's first word, and words' starts and ends in code points of the text."""
    each, counts = [], np.zeros(len(offsets) - 1, np.int64)
    starts, ends, shift = [], [], 0
    for d, o, which in _in_panels(data, offsets):
        w = words_of(d, o)
        each.append(model.emissions(w)[w.number])
        counts[which] += np.diff(w.firsts)
        long = len(offsets) == 2
        base = np.zeros(len(w.starts), np.int64) + shift if long else np.repeat(code_points(d, o)[1][:-1], np.diff(w.firsts))
        starts.append(w.starts + base if long else w.starts - base)
        ends.append(w.ends + base if long else w.ends - base)
        shift += len(w.points)
    firsts = np.concatenate([[0], np.cumsum(counts)])
    return marginals(np.concatenate(each), firsts, model.start, model.moves), firsts, np.concatenate(starts), np.concatenate(ends)


def predict(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, lang_pred and score (0 to 1) of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        own = shared.value
        names = np.array([*own.labels, UNKNOWN], object)
        for batch in batches:
            for lo, hi, data, offsets in tb.slices(batch.column(1)):
                n = hi - lo
                pick, share = np.full(n, len(own.labels)), np.zeros(n)
                if own.labels:
                    p, firsts, _, _ = _posteriors(own, data, offsets)
                    total = np.zeros((len(p) + 1, len(own.labels)))
                    np.cumsum(p, axis=0, out=total[1:])
                    mass, count = total[firsts[1:]] - total[firsts[:-1]], np.diff(firsts)
                    some = count > 0
                    # Rounded, so that sums which differ by their place in the slice alone do not part equal texts.
                    mass = np.round(mass[some] / count[some, None], 9)
                    pick[some], share[some] = mass.argmax(1), np.clip(mass.max(1), 0, 1)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, n), pa.array(names[pick].tolist(), pa.string()), pa.array(share)], names=["id", "lang_pred", "score"])

    kind = docs.schema[id].dataType.simpleString()
    return tb.mapped(docs.select(F.col(id), F.col(text).cast("string")), run, f"id {kind}, lang_pred string, score double").withColumnRenamed("id", id)


def language_spans(docs: DataFrame, model: Model, id: str = "doc_id", text: str = "text") -> DataFrame:
    """id and spans of every row: language, first and end code point, words and mean probability of each stretch of words with one language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema[id].dataType.simpleString()

    def run(batches):
        own = shared.value
        spans = pa.list_(pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("words", pa.int64()), ("score", pa.float64())]))
        for batch in batches:
            for lo, hi, data, offsets in tb.slices(batch.column(1)):
                out: list[list[dict]] = [[] for _ in range(hi - lo)]
                if own.labels:
                    p, firsts, starts, ends = _posteriors(own, data, offsets)
                    label, best = p.argmax(1), p.max(1)
                    text_of = np.repeat(np.arange(hi - lo), np.diff(firsts))
                    edge = np.flatnonzero(np.append(True, (label[1:] != label[:-1]) | (text_of[1:] != text_of[:-1]))) if len(label) else np.zeros(0, int)
                    for a, b in zip(edge, np.append(edge[1:], len(label))):
                        out[text_of[a]].append({"lang": own.labels[label[a]], "start": int(starts[a]), "end": int(ends[b - 1]), "words": int(b - a), "score": float(best[a:b].mean())})
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(out, spans)], names=["id", "spans"])

    return tb.mapped(docs.select(F.col(id), F.col(text).cast("string")), run, f"id {kind}, spans array<struct<lang:string,start:bigint,end:bigint,words:bigint,score:double>>").withColumnRenamed("id", id)


def op11_language_crf(spark, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    third = F.crc32(F.col("doc_id").cast("string")) % 3
    model = train(docs, may_learn=third != 1)
    return predict(docs, model).select("doc_id", F.coalesce(third == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")
