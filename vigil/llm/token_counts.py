"""Exact token counts by a map-side two-tier lookup, without a shuffle of pre-tokens.

A byte-level tokenizer splits text before it merges, and a single space always starts a new pre-token.  A text
is therefore cut at single spaces and line ends into units whose token counts add up.  Tier one is a broadcast
hash table of the units that are frequent in the whole corpus; tier two is a cache in each worker, which
the library fills for the units that the table misses.

A run of three white-space characters, or of two at the end of a text, can be one pre-token that spans a
cut, and a special string ends the text before it; such a text goes to the library as a whole.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Runs of white space that may join across a cut.
JOINS = re.compile(r"\s\s\s|\s\s\Z")

_LIBRARY: dict[str, object] = {}


def library(path: str):
    """The tokenizer of a file, loaded once in a process."""
    if path not in _LIBRARY:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark already runs a task on each core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.no_padding()
        tokenizer.no_truncation()
        _LIBRARY[path] = tokenizer
    return _LIBRARY[path]


def counts_of(path: str, texts: list[str]) -> list[int]:
    return [len(e.ids) for e in library(path).encode_batch_fast(texts, add_special_tokens=False)]


def units_of(text: str) -> tuple[list[str], list[str]]:
    """Units at a line's start, and units after a single space (without it)."""
    heads, rest = [], []
    for line in text.split("\n"):
        words = line.split(" ")
        heads.append(words[0])
        del words[0]
        rest += words
    return heads, rest


class Lookup:
    """Token counts of units: the broadcast table first, then this worker's cache, then the library."""

    def __init__(self, path: str, table: dict[str, int], cache_units: int):
        self.path, self.known, self.cache_units = path, dict(table), cache_units
        self.room = len(table) + cache_units
        self.table = table
        self.newline = counts_of(path, ["\n"])[0]
        self.special = [x.content for x in library(path).get_added_tokens_decoder().values()]

    def learn(self, units: set[str]) -> None:
        """Encode the units that neither tier has; a full cache starts anew from the table."""
        missing = [x for x in units if x not in self.known]
        if len(self.known) + len(missing) > self.room:
            self.known = dict(self.table)
            missing = [x for x in units if x not in self.known]
        if missing:
            self.known.update(zip(missing, counts_of(self.path, missing)))

    def batch(self, texts: list[str]) -> list[int]:
        out: list[int] = [0] * len(texts)
        whole = [i for i, text in enumerate(texts) if JOINS.search(text) or any(x in text for x in self.special)]
        for i, n in zip(whole, counts_of(self.path, [texts[i] for i in whole])):
            out[i] = n
        skip = set(whole)
        split = {i: units_of(text) for i, text in enumerate(texts) if i not in skip}
        wanted: set[str] = set()
        for heads, rest in split.values():
            wanted.update(heads)
            wanted.update(map(" ".__add__, rest))
        self.learn(wanted)
        find = self.known.__getitem__
        for i, (heads, rest) in split.items():
            out[i] = sum(map(find, heads)) + sum(map(find, map(" ".__add__, rest))) + (len(heads) - 1) * self.newline
        return out


def _pieces(batches, rows: int):
    """Record batches of at most ``rows`` rows, so that few Python texts live at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def frequent_units(texts: DataFrame, units: int, per_task: int = 200_000) -> dict[str, int]:
    """The most frequent units of all texts with their counts, at most ``units``.

    Each task counts its units and, when it holds more than twice ``per_task``, keeps the most frequent
    ``per_task`` (the rest of a summary is rare by definition); tasks hand over only their first ``units``
    rows, which Spark sums.  The summary steers speed alone: every unit outside it is still encoded exactly.
    """
    def count(batches):
        seen: Counter = Counter()
        for batch in _pieces(batches, 500):
            for text in batch.column(0).to_pylist():
                heads, rest = units_of(text or "")
                seen.update(heads)
                seen.update(map(" ".__add__, rest))
            if len(seen) > 2 * per_task:
                seen = Counter(dict(seen.most_common(per_task)))
        top = seen.most_common(units)
        yield pa.RecordBatch.from_pydict({"unit": pa.array([x for x, _ in top], pa.string()), "n": pa.array([n for _, n in top], pa.int64())})

    summed = texts.mapInArrow(count, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("n"))
    return {r.unit: r.n for r in summed.orderBy(F.desc("n"), "unit").limit(units).collect()}


def token_counts(docs: DataFrame, path: str, text: str = "text", frequent: int = 16_384, cache_units: int = 400_000) -> DataFrame:
    """Adds ``n_tokens`` (long), the library's count for each whole text without special tokens.

    ``path`` names a byte-level tokenizer file.  Memory of a worker is bounded by ``frequent`` and
    ``cache_units``; the counts depend on neither.  A null text counts as empty (0 tokens); special strings
    inside a text are counted as the library does by default; repeated rows keep their own counts; an
    existing column ``n_tokens`` is replaced; other columns pass through.
    """
    spark = docs.sparkSession
    top = list(frequent_units(docs.select(F.col(text).alias("text")), frequent))
    table = spark.sparkContext.broadcast(dict(zip(top, counts_of(path, top)) if top else ()))
    kept = docs.drop("n_tokens")
    schema = T.StructType([*kept.schema.fields, T.StructField("n_tokens", T.LongType())])
    names = kept.columns

    def count(batches):
        look = Lookup(path, table.value, cache_units)
        at = names.index(text)
        for batch in _pieces(batches, 500):
            n = look.batch([x or "" for x in batch.column(at).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(n, pa.int64())], names=[*names, "n_tokens"])

    return kept.mapInArrow(count, schema)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    counted = token_counts(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return counted.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > 512).alias("over_limit"))
