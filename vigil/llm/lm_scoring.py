"""Language-model scores by a subword lattice: the marginal over all segmentations of each word.

The pieces of an existing vocabulary, and every single byte so that all words can be spelled, get unigram
probabilities that expectation maximisation learns from the training texts' word counts (starting from the
vocabulary's own scores).  A word's probability is the sum over all ways to cut it into pieces, computed by a
log-space forward recursion over its bytes, for many words at once; a long word (text without spaces) takes time
in proportion to its bytes.  A text is its words and one end, so its log-probability is the sum of theirs.

Counts of words, and the lattice of each distinct word, are computed once for the corpus.  Texts look up frequent
words in a bounded broadcast table; only rarer words are joined by a shuffle, one row for each text and word.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigil.functions.storage import cut
from vigil.llm.token_counts import _pieces

#: Bytes of words, padding included, in one lattice pass.
LATTICE_CELLS = 320_000
LOG10 = np.log(10.0)
#: Longer words have a lattice pass each, in panels of so many starts, and are looked up by the join alone.
LONG_BYTES = 64
PANEL = 1 << 16
#: Fills the matrix of a batch after a shorter word; no piece holds it.
PAD = 256
#: A task hands its word counts on after so many words or bytes of text.
COUNT_WORDS, COUNT_BYTES = 400_000, 128 << 20
NAMES = ["row", "id", "held_out", "word", "n", "known", "base", "score"]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> tuple[tuple[bytes, ...], tuple[float, ...]]:
    """Pieces as bytes (a space for the word start) and starting weights, from a sentencepiece file.

    Pieces with a word start inside cannot occur in a word and are left out.  The file's scores are negative
    ranks; 1 / rank is the starting weight.  Single bytes that no piece spells get the weight of the last rank.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found: dict[bytes, float] = {}
    n = model.get_piece_size()
    for i in range(n):
        if model.is_control(i) or model.is_unknown(i) or model.is_byte(i):
            continue
        raw = model.id_to_piece(i).replace("▁", " ").encode()
        if b" " not in raw[1:]:
            found[raw] = 1.0 / (1.0 - min(0.0, model.get_score(i)))
    for byte in range(256):
        found.setdefault(bytes([byte]), 1.0 / n)
    pieces = sorted(found)
    return tuple(pieces), tuple(found[x] for x in pieces)


@lru_cache(maxsize=4)
def _trie(pieces: tuple[bytes, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Steps (node, byte) -> node of a trie of the pieces, -1 where no piece continues, and each node's piece or -1.

    Nodes that some piece continues come first and have a row of steps; byte ``PAD`` continues none.
    """
    parents = {b""}
    for piece in pieces:
        parents.update(piece[:k] for k in range(1, len(piece)))
    inner = sorted(parents, key=lambda x: (len(x), x))
    number = {x: i for i, x in enumerate(inner)}
    for piece in pieces:
        number.setdefault(piece, len(number))
    steps = np.full((len(inner), PAD + 1), -1, np.int32)
    for prefix, i in number.items():
        if prefix:
            steps[number[prefix[:-1]], prefix[-1]] = i
    held = np.full(len(number), -1, np.int32)
    held[[number[x] for x in pieces]] = np.arange(len(pieces))
    return steps, held


class Lattice:
    """Forward and backward recursions over the pieces of a vocabulary.

    Spans are found along a trie, so a start is left as soon as no piece continues it.  Words of a batch go
    together; a longer word goes alone, its spans found for all starts of a panel at once.
    """

    def __init__(self, pieces: tuple[bytes, ...], log_p: np.ndarray):
        self.log_p = log_p
        self.longest = max(map(len, pieces))
        self.steps, self.held = _trie(pieces)

    def _spans(self, words: np.ndarray):
        """(start, end, rows, pieces) of the spans of a byte matrix that are pieces; starts ascend."""
        columns = np.ascontiguousarray(words.T)
        every = np.arange(words.shape[0])
        for start in range(len(columns)):
            rows, node = every, self.steps[0, columns[start]]
            for end in range(start + 1, len(columns) + 1):
                if (node < 0).any():
                    live = node >= 0
                    rows, node = rows[live], node[live]
                piece = self.held[node]
                if (piece < 0).any():
                    hit = piece >= 0
                    if hit.any():
                        yield start, end, rows[hit], piece[hit]
                elif len(rows):
                    yield start, end, rows, piece
                if end == len(columns):
                    break
                further = node < len(self.steps)
                rows, node = rows[further], node[further]
                if not len(rows):
                    break
                node = self.steps[node, columns[end][rows]]

    def forward(self, words: np.ndarray) -> np.ndarray:
        """Natural log-probability of each row of a byte matrix (``PAD`` after a shorter word)."""
        n, length = words.shape
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0.0
        for start, end, rows, piece in self._spans(words):  # alpha[start] is complete: all earlier starts are done
            alpha[end, rows] = np.logaddexp(alpha[end, rows], alpha[start, rows] + self.log_p[piece])
        return alpha[(words != PAD).sum(1), np.arange(n)]

    def expected(self, words: np.ndarray, counts: np.ndarray, total: np.ndarray) -> None:
        """Adds the expected piece counts of a byte matrix of words, seen ``counts`` times, to ``total``.

        No logarithms: the words of a batch are short.  A word whose probability leaves the range of a double goes alone.
        """
        n, length = words.shape
        p = np.exp(self.log_p)
        spans = list(self._spans(words))
        alpha, beta = np.zeros((length + 1, n)), np.zeros((length + 1, n))
        alpha[0] = beta[(words != PAD).sum(1), np.arange(n)] = 1.0
        for start, end, rows, piece in spans:
            alpha[end, rows] += alpha[start, rows] * p[piece]
        for start, end, rows, piece in reversed(spans):
            beta[start, rows] += p[piece] * beta[end, rows]
        whole = beta[0]
        low = whole < 1e-250
        weight = np.where(low, 0.0, counts / np.where(low, 1.0, whole))
        shares = [alpha[start, rows] * p[piece] * beta[end, rows] * weight[rows] for start, end, rows, piece in spans]
        if spans:
            total += np.bincount(np.concatenate([x[3] for x in spans]), np.concatenate(shares), len(total))
        for i in np.flatnonzero(low):
            own = words[i]
            self.expected_alone(own[own != PAD].astype(np.uint8).tobytes(), float(counts[i]), total)

    def _panel(self, data: np.ndarray, at: int, to: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts in [at, to), ends and pieces of the spans of one word; starts ascend."""
        found, starts = [], np.arange(at, to)
        node, end = self.steps[0, data[starts]], starts + 1
        while len(starts):
            live = node >= 0
            starts, node, end = starts[live], node[live], end[live]
            piece = self.held[node]
            hit = piece >= 0
            found.append((starts[hit], end[hit], piece[hit]))
            go = (node < len(self.steps)) & (end < len(data))
            starts, node, end = starts[go], node[go], end[go]
            node = self.steps[node, data[end]]
            end = end + 1
        starts, ends, pieces = (np.concatenate([x[k] for x in found]) for k in range(3))
        order = np.argsort(starts, kind="stable")
        return starts[order], ends[order], pieces[order]

    def _forward_alone(self, data: np.ndarray) -> np.ndarray:
        """log-probability of every prefix of one word."""
        out = np.full(len(data) + 1, -np.inf)
        out[0] = 0.0
        for at in range(0, len(data), PANEL):
            to = min(len(data), at + PANEL)
            alpha = out[at : to + self.longest].tolist()
            starts, ends, pieces = self._panel(data, at, to)
            for start, end, log_p in zip((starts - at).tolist(), (ends - at).tolist(), self.log_p[pieces].tolist()):
                alpha[end] = _log_add(alpha[end], alpha[start] + log_p)
            out[at : at + len(alpha)] = alpha
        return out

    def forward_alone(self, word: bytes) -> float:
        """Natural log-probability of one word of any length (the word start included)."""
        return float(self._forward_alone(np.frombuffer(word, np.uint8))[-1])

    def expected_alone(self, word: bytes, count: float, total: np.ndarray) -> None:
        """``expected`` for one word of any length, panel by panel from its end."""
        data = np.frombuffer(word, np.uint8)
        alpha, n = self._forward_alone(data), len(data)
        beyond = [0.0]  # beta from the end of a panel on
        for at in reversed(range(0, n, PANEL)):
            to = min(n, at + PANEL)
            starts, ends, pieces = self._panel(data, at, to)
            beta = [-math.inf] * (to - at) + beyond
            log_p = self.log_p[pieces]
            for start, end, own in zip((starts - at)[::-1].tolist(), (ends - at)[::-1].tolist(), log_p[::-1].tolist()):
                beta[start] = _log_add(beta[start], own + beta[end])
            share = np.exp(alpha[starts] + log_p + np.array(beta)[ends - at] - alpha[n])
            total += np.bincount(pieces, share * count, len(total))
            beyond = beta[: self.longest + 1]


def _log_add(x: float, y: float) -> float:
    low, high = (x, y) if x < y else (y, x)
    return high if low == -math.inf else high + math.log1p(math.exp(low - high))


def in_batches(words: list[bytes]):
    """(row numbers, byte matrix with the word start in front) of the words up to ``LONG_BYTES``, by length, in bounded parts."""
    lengths = np.array([len(x) for x in words], np.int64)
    order = np.argsort(lengths, kind="stable")
    order = order[: np.searchsorted(lengths[order], LONG_BYTES, "right")]
    at = 0
    while at < len(order):
        # Cells of the part that ends before each word; lengths ascend, so they do too.
        cells = np.arange(1, len(order) - at + 1) * (lengths[order[at:]] + 1)
        part = order[at : at + max(1, int(np.searchsorted(cells, LATTICE_CELLS, "right")))]
        width = int(lengths[part[-1]]) + 1
        matrix = np.full((len(part), width), PAD, np.int16)
        matrix[:, 0] = 32
        inside = np.arange(1, width) <= lengths[part][:, None]
        matrix[:, 1:][inside] = np.frombuffer(b"".join([words[i] for i in part]), np.uint8)
        yield part, matrix
        at += len(part)


def log_probability(lattice: Lattice, words: list[bytes]) -> np.ndarray:
    """Natural log-probability of each (non-empty) word."""
    out = np.zeros(len(words))
    for rows, matrix in in_batches(words):
        out[rows] = lattice.forward(matrix)
    for i, word in enumerate(words):
        if len(word) > LONG_BYTES:
            out[i] = lattice.forward_alone(b" " + word)
    return out


def expected_pieces(lattice: Lattice, words: list[bytes], counts: np.ndarray, total: np.ndarray) -> None:
    """Adds the expected piece counts of all words, seen ``counts`` times, to ``total``."""
    for rows, matrix in in_batches(words):
        lattice.expected(matrix, counts[rows], total)
    for i, word in enumerate(words):
        if len(word) > LONG_BYTES:
            lattice.expected_alone(b" " + word, float(counts[i]), total)


def split(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lower-cased; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def word_counts(texts: DataFrame) -> DataFrame:
    """word (binary), n: how often each word of (text, training) occurs in training texts; 0 for words of other texts alone."""
    def count(batches):
        seen: Counter = Counter()
        held = 0

        def give():
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], names=["word", "n"])
            seen.clear()
            return out

        for batch in _pieces(batches, 500):
            for text, training in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if training:
                    seen.update(split(text))
                else:
                    for word in split(text):
                        seen[word] += 0
                held += len(text or "")
                if len(seen) > COUNT_WORDS or held > COUNT_BYTES:
                    yield give()
                    held = 0
        if seen:
            yield give()

    return texts.mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def learn(counts: DataFrame, ends: int, path: str, rounds: int) -> tuple[np.ndarray, float]:
    """Natural log-probabilities of the pieces and of the end after ``rounds`` of expectation maximisation."""
    spark = counts.sparkSession
    pieces, start = vocabulary(path)
    p = np.array(start)
    p_end = max(ends, 1) / (max(ends, 1) + 10.0 * max(ends, 1))
    p = p / p.sum() * (1 - p_end)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(np.log(p))

        def expect(batches):
            names = vocabulary(path)[0]
            lattice, total = Lattice(names, shared.value), np.zeros(len(names))
            for batch in batches:
                n = batch.column(1).to_numpy()
                expected_pieces(lattice, batch.column(0).to_pylist(), n.astype(float), total)
            at = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["piece", "n"])

        found = counts.where("n > 0").mapInArrow(expect, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).toPandas()
        total = np.full(len(pieces), 0.01)
        total[found.piece.to_numpy()] += found.n.to_numpy()
        p = total / (total.sum() + max(ends, 1))
        p_end = max(ends, 1) / (total.sum() + max(ends, 1))
    return np.log(p), float(np.log(p_end))


def lm_scores(docs: DataFrame, training: Column, path: str, id: str = "doc_id", text: str = "text", rounds: int = 3, frequent: int = 100_000) -> DataFrame:
    """id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row.

    ``training`` marks the rows to learn from.  A text's tokens are its words and one end.  base_score is the
    add-one unigram score of the tokens, score the lattice model's log10 probability.  A null or empty text is its end
    alone; without training rows every count is 0.  Rows that repeat an id each give a row.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id).alias("id"), F.col(text).alias("text"), F.coalesce(training, F.lit(False)).alias("training"))
    counts = cut(word_counts(rows.select("text", "training")), "counts")
    ends = rows.where("training").count()
    seen = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count_if(F.col("n") > 0).alias("v")).first()
    n_all, n_distinct = seen.n + ends, seen.v + (1 if ends else 0)
    bottom = n_all + n_distinct + 1
    log_p, log_end = learn(counts, ends, path, rounds)
    shared = spark.sparkContext.broadcast(log_p)

    def weigh(batches):
        lattice = Lattice(vocabulary(path)[0], shared.value)
        for batch in _pieces(batches, 100_000):
            own = log_probability(lattice, batch.column(0).to_pylist()) / LOG10
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own)], names=["word", "n", "p"])

    weights = cut(counts.mapInArrow(weigh, "word binary, n long, p double"), "weights")
    top = weights.where(F.octet_length("word") <= LONG_BYTES).orderBy(F.desc("n"), "word").limit(frequent).toPandas()
    table = spark.sparkContext.broadcast((
        {bytes(w): i for i, w in enumerate(top.word)}, np.log10((top.n.to_numpy(float) + 1) / bottom), (top.n.to_numpy() > 0).astype(np.int64), top.p.to_numpy(float)))
    end = (float(np.log10((ends + 1) / bottom)), int(ends > 0), log_end / LOG10)

    def look(batches):
        where, base, known, score = table.value
        find = where.get
        for batch in _pieces(batches, 500):
            out: list[list] = [[] for _ in range(4)]
            rare: list[tuple] = []
            for i, value in enumerate(batch.column(2).to_pylist()):
                words = split(value)
                at = np.fromiter((find(w, -1) for w in words), np.int64, len(words))
                hit = at[at >= 0]
                for slot, x in zip(out, (len(words) + 1, int(known[hit].sum()) + end[1], float(base[hit].sum()) + end[0], float(score[hit].sum()) + end[2])):
                    slot.append(x)
                if len(hit) < len(words):
                    rare += [(i, w, k) for w, k in Counter(words[j] for j in np.flatnonzero(at < 0)).items()]
            more = pa.array([r[0] for r in rare], pa.int64())
            heads = [*(batch.column(k) for k in (0, 1, 3)), pa.nulls(batch.num_rows, pa.binary()), *(pa.array(x) for x in out)]
            yield pa.RecordBatch.from_arrays(heads, names=NAMES)
            if rare:
                none = [pa.nulls(len(rare), x.type) for x in heads]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(more), *none[1:3], pa.array([r[1] for r in rare], pa.binary()), pa.array([r[2] for r in rare], pa.int64()), *none[5:]], names=NAMES)

    named = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id).cast("long").alias("id"), F.col(text).alias("text"),
                        (~F.coalesce(training, F.lit(False))).alias("held_out"))
    parts = cut(named.mapInArrow(look, "row long, id long, held_out boolean, word binary, n long, known long, base double, score double"), "parts")
    heads = parts.where("word is null")
    rare = parts.where("word is not null").select("row", "word", F.col("n").alias("k")).join(weights, "word")
    rare = rare.groupBy("row").agg(
        F.sum(F.when(F.col("n") > 0, F.col("k")).otherwise(0)).alias("more_known"),
        F.sum(F.col("k") * F.log10((F.col("n") + 1) / F.lit(float(bottom)))).alias("more_base"), F.sum(F.col("k") * F.col("p")).alias("more_score"))
    joined = heads.join(rare, "row", "left")
    return joined.select(
        F.col("id").alias(id), "held_out", F.col("n").alias("n_tokens"), (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        F.lit(n_all).cast("long").alias("train_tokens"), (F.col("base") + F.coalesce("more_base", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("more_score", F.lit(0.0))).alias("score"))


def op3_lm_scores(spark, sf_dir: str) -> DataFrame:
    """Scores of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    fold = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 7, F.lit(0))
    return lm_scores(docs, fold != 2, public_tokenizers.path("piece_bpe_32k.model"))
