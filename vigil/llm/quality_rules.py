"""Quality rules as a learned decision list over text statistics.

Statistics come from one vectorised pass over the texts.  A list of rules is then learned from labelled
statistics by sequential covering: a rule is a conjunction of thresholds, grown by information gain on one part of
the labelled rows and pruned on the other; the rows it covers leave, and the next rule is learned.  The list
is emitted as one ordered Spark conditional expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigil.llm import textbuf as tb

SYMBOLS = tb._table(lambda c: chr(c) in "#*$%&|<>")
UPPER = tb._table(lambda c: 65 <= c <= 90)
LINE = tb._table(lambda c: c != 10)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_punct"]
PUNCT = tb._table(lambda c: chr(c) in "!?.,;:")

#: Interpretable features of a rule, each a ratio of two statistics.
FEATURES = {
    "symbols_per_word": "n_symbols / greatest(n_words, 1)",
    "punctuation_per_word": "n_punct / greatest(n_words, 1)",
    "upper_share": "n_upper / greatest(word_chars, 1)",
    "chars_per_word": "word_chars / greatest(n_words, 1)",
    "repeat_share": "n_repeat_words / greatest(n_words, 1)",
    "dup_line_share": "n_dup_lines / greatest(n_lines, 1)",
    "words_per_line": "n_words / greatest(n_lines, 1)",
    "words": "n_words / 1",
}


def _repeated_words(words: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Words of each text that lie in a 3-word window found twice or more in that text."""
    out = np.zeros(len(firsts) - 1, np.int64)
    for i in np.flatnonzero(np.diff(firsts) >= 4):
        own = words[firsts[i] : firsts[i + 1]]
        windows = tb.mix(own[:-2] + tb.mix(own[1:-1] + tb.mix(own[2:])))
        order = np.argsort(windows)
        ordered = windows[order]
        same = ordered[1:] == ordered[:-1]
        if same.any():
            twice = np.zeros(len(windows), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            hit = np.zeros(len(own), bool)
            hit[:-2] |= twice
            hit[1:-1] |= twice
            hit[2:] |= twice
            out[i] = hit.sum()
    return out


def _line_stats(data: np.ndarray, offsets: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Lines with a word, and those of them equal to an earlier line of the same text."""
    at, to, firsts = tb.runs(LINE[data], offsets)
    has_word = np.searchsorted(starts, to) > np.searchsorted(starts, at)
    n_lines = tb.per_text(has_word, firsts)
    text_of = np.repeat(np.arange(len(offsets) - 1), np.diff(firsts))[has_word]
    hashes = tb.span_hashes(data, at[has_word], to[has_word])
    dup = np.zeros(len(offsets) - 1, np.int64)
    if len(hashes):
        order = np.lexsort((hashes, text_of))
        same = (hashes[order][1:] == hashes[order][:-1]) & (text_of[order][1:] == text_of[order][:-1])
        dup = np.bincount(text_of[order][1:][same], minlength=len(offsets) - 1)
    return n_lines, dup


def statistics(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The columns COUNTS of the texts in a buffer."""
    starts, ends, firsts = tb.runs(tb.NOT_SPACE[data], offsets)

    def total(mask: np.ndarray) -> np.ndarray:
        running = np.zeros(len(data) + 1, np.int64)
        np.cumsum(mask, out=running[1:])
        return running[offsets[1:]] - running[offsets[:-1]]

    n_lines, dup = _line_stats(data, offsets, starts)
    return [np.diff(firsts), total(tb.NOT_SPACE[data] & tb.LEADS[data]), total(SYMBOLS[data]), dup,
            _repeated_words(tb.span_hashes(data, starts, ends), firsts), n_lines, total(UPPER[data]), total(PUNCT[data])]


def text_statistics(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Adds COUNTS (long) to ``docs``, or to its columns ``keep`` only.

    Words are `[^\\x20\\x09-\\x0D]+`; equality of words, windows and lines is that of 64-bit hashes.  A null text
    has no words (all counts 0); existing columns of the same names are replaced.
    """
    names = [c for c in (docs.columns if keep is None else keep) if c not in COUNTS]
    inside = text in names
    rows = docs.select(*names) if inside else docs.select(*names, F.col(text).alias("__text"))
    at = names.index(text) if inside else len(names)
    schema = T.StructType([*rows.select(*names).schema.fields, *(T.StructField(c, T.LongType()) for c in COUNTS)])

    def count(batches):
        for batch in batches:
            for lo, hi, data, offsets in tb.slices(batch.column(at)):
                own = batch.slice(lo, hi - lo)
                found = [pa.array(x.astype(np.int64)) for x in statistics(data, offsets)]
                yield pa.RecordBatch.from_arrays([*own.columns[: len(names)], *found], names=[*names, *COUNTS])

    return tb.mapped(rows, count, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction of (feature, above, threshold); rejects the rows that meet all of it."""

    tests: tuple[tuple[str, bool, float], ...]
    precision: float
    covered: int

    def sql(self) -> str:
        return " AND ".join(f"{FEATURES[f]} {'>=' if above else '<='} {t!r}D" for f, above, t in self.tests)

    def mask(self, x: dict[str, np.ndarray]) -> np.ndarray:
        out = np.ones(len(next(iter(x.values()))), bool)
        for f, above, t in self.tests:
            out &= x[f] >= t if above else x[f] <= t
        return out


def _gain(p: np.ndarray, n: np.ndarray, p0: float, n0: float) -> np.ndarray:
    """Information gain of a refinement that keeps p positives and n negatives of p0 and n0."""
    with np.errstate(divide="ignore", invalid="ignore"):
        return np.where(p > 0, p * (np.log2(p / np.maximum(p + n, 1e-9)) - np.log2(p0 / (p0 + n0))), -np.inf)


def _grow(x: dict[str, np.ndarray], y: np.ndarray, most_tests: int) -> list[tuple[str, bool, float]]:
    tests: list[tuple[str, bool, float]] = []
    live = np.ones(len(y), bool)
    while len(tests) < most_tests and live.any() and not y[live].all():
        best, chosen = 1e-9, None
        p0, n0 = float(y[live].sum()), float((~y[live]).sum())
        if not p0:
            break
        for f, values in x.items():
            v, own = values[live], y[live]
            order = np.argsort(v, kind="stable")
            v, own = v[order], own[order]
            edge = np.flatnonzero(v[1:] != v[:-1])
            if not len(edge):
                continue
            p, n = np.cumsum(own)[edge].astype(float), np.cumsum(~own)[edge].astype(float)
            middle = (v[edge] + v[edge + 1]) / 2
            for above, gain in ((False, _gain(p, n, p0, n0)), (True, _gain(p0 - p, n0 - n, p0, n0))):
                at = int(np.argmax(gain))
                if gain[at] > best:
                    best, chosen = gain[at], (f, above, float(middle[at]))
        if chosen is None:
            break
        tests.append(chosen)
        live &= x[chosen[0]] >= chosen[2] if chosen[1] else x[chosen[0]] <= chosen[2]
    return tests


def _worth(tests, x, y) -> tuple[float, float, int]:
    hit = Rule(tuple(tests), 0, 0).mask(x) if tests else np.ones(len(y), bool)
    p, n = float(y[hit].sum()), float((~y[hit]).sum())
    return (p - n) / (p + n) if p + n else -1.0, p / (p + n) if p + n else 0.0, int(p + n)


def learn_rules(x: dict[str, np.ndarray], bad: np.ndarray, part: np.ndarray, precision: float = 0.9,
                most_rules: int = 12, most_tests: int = 4, least: int = 8) -> list[Rule]:
    """An ordered decision list for ``bad`` rows by sequential covering.

    ``part`` (0 to 2) deals rows to growing (0, 1) and pruning (2).  Pruning drops final tests while that raises
    (p - n) / (p + n) on the pruning part.  A rule is kept if its precision on all remaining rows and on the
    pruning part reaches ``precision`` and it covers ``least`` rows; otherwise the list ends.
    """
    rules: list[Rule] = []
    left = np.ones(len(bad), bool)
    while len(rules) < most_rules and bad[left].any():
        grow, prune = left & (part != 2), left & (part == 2)
        pick = lambda m: {f: v[m] for f, v in x.items()}
        tests = _grow(pick(grow), bad[grow], most_tests)
        held = pick(prune)
        while len(tests) > 1 and _worth(tests[:-1], held, bad[prune])[0] >= _worth(tests, held, bad[prune])[0]:
            tests = tests[:-1]
        if not tests:
            break
        _, all_right, n = _worth(tests, pick(left), bad[left])
        _, held_right, held_n = _worth(tests, held, bad[prune])
        if all_right < precision or n < least or (held_n and held_right < precision):
            break
        rules.append(Rule(tuple(tests), round(all_right, 4), n))
        left &= ~rules[-1].mask(x)
    return rules


def labelled(labels: DataFrame, key: str, label: str, most_rows: int) -> DataFrame:
    """The bounded sample of labels: the ``most_rows`` with the smallest hash of their key, as __k and __y."""
    own = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    return own.select(F.col(key).alias("__k"), F.col(label).cast("int").alias("__y")).distinct().orderBy(F.xxhash64("__k"), "__y").limit(most_rows)


def learned(docs: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", most_rows: int = 20_000, **options) -> list[Rule]:
    """Rules from the labelled documents; statistics are computed for the bounded sample alone."""
    ids = labelled(labels, key, label, most_rows).select(F.col("__k").alias(key)).distinct()
    return fit_rules(text_statistics(docs.join(F.broadcast(ids), key, "left_semi"), keep=[key]), labels, key, label, most_rows, **options)


def fit_rules(stats: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality",
              most_rows: int = 20_000, **options) -> list[Rule]:
    """Learns from a bounded sample of labelled rows: the ``most_rows`` with the smallest hash of their key.

    Rows without a key or label are left out; the label 0 is bad.  Conflicting labels of a key all count.
    """
    own = labelled(labels, key, label, most_rows)
    data = stats.join(F.broadcast(own), F.col(key) == F.col("__k")).select(
        F.xxhash64(key).alias("h"), "__y", *(F.expr(v).cast("double").alias(k) for k, v in FEATURES.items()))
    # One row for each key and label, whatever the number of its copies, so that the sample stays bounded.
    data = data.groupBy("h", "__y").agg(F.min(F.struct(*FEATURES)).alias("x")).select("h", "__y", "x.*").toPandas()
    data = data.sort_values(["h", "__y", *FEATURES], kind="stable", ignore_index=True)
    if data.empty:
        return []
    part = (data["h"].to_numpy().view(np.uint64) >> np.uint64(7)) % np.uint64(3)
    return learn_rules({f: data[f].to_numpy() for f in FEATURES}, data["__y"].to_numpy() == 0, part, **options)


def verdict(rules: list[Rule]) -> Column:
    """Null for a kept row, else the number of the first rule (from 1) that rejects it."""
    out = F.lit(None).cast("int")
    for i, rule in reversed(list(enumerate(rules, 1))):
        out = F.when(F.expr(rule.sql()), F.lit(i)).otherwise(out)
    return out


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def decide(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, COUNTS, base_failed, rule and kept for each row of ``docs``."""
    stats = text_statistics(docs, keep=["doc_id"])
    rules = learned(docs, labels)
    return stats.select("*", base_failed().alias("base_failed"), verdict(rules).alias("rule")).withColumn(
        "kept", ~F.col("base_failed") & F.col("rule").isNull())


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """The statistics of every document, whether the base rules fail it and whether it is kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = decide(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule")
