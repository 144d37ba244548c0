"""Token ids in a compressed block format with a shared dictionary.

A store is a folder with two tables.  ``blocks``: a row is a block of consecutive documents in ascending id order, with
the documents' ids, token counts, the byte offsets of their frames, the sha-256 of the dictionary and the frames.
``dictionary``: that hash, the dictionary itself, the width of an id in bytes and the end id.  Each frame is one
document's little-endian ids, compressed alone with the shared zstandard dictionary, so one short document is
read without its neighbours.

Texts are cut at white space, where this kind of tokenizer (white space dropped, units lower-cased) never joins
ids, and each worker keeps the ids of the units that it has seen.
"""

from __future__ import annotations

import hashlib
import re
import sys
import zlib
from array import array

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.storage import new_path
from vigil.llm import textbuf as tb
from vigil.llm.token_counts import _pieces, library

#: Separators that Python splits at and the tokenizer keeps.
KEPT_SEPARATORS = re.compile("[\x1c-\x1f]")
BLOCKS = ("shard int, block int, first_id long, last_id long, ids array<long>, n array<int>, ends array<long>, "
          "before long, n_ids long, dictionary string, payload binary")


class Encoder:
    """Serialised ids of texts, with a bounded cache of white-space units."""

    def __init__(self, path: str, end: int, width: int, cache_units: int):
        self.key = (path, end, width, cache_units)
        self.path, self.cache_units, self.kind = path, cache_units, np.dtype(f"<u{width}")
        self.code = "H" if width == 2 else "I"
        self.end = np.array([end], self.kind).tobytes()
        self.known: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        found = library(self.path).encode_batch_fast(texts, add_special_tokens=False)
        if sys.byteorder == "little" and array(self.code).itemsize == self.kind.itemsize:
            return [array(self.code, x.ids).tobytes() for x in found]
        return [np.array(x.ids, self.kind).tobytes() for x in found]

    def encode(self, texts: list[str]) -> list[bytes]:
        whole = {i for i, x in enumerate(texts) if KEPT_SEPARATORS.search(x)}
        units = [[] if i in whole else x.split() for i, x in enumerate(texts)]
        wanted = set().union(*units) if units else set()
        missing = list(wanted.difference(self.known))
        if len(self.known) + len(missing) > self.cache_units:
            self.known = {}
            missing = list(wanted)
        self.known.update(zip(missing, self.library(missing)))
        find = self.known.__getitem__
        out = [b"".join(map(find, x)) + self.end for x in units]
        for i in whole:
            out[i] = self.library([texts[i]])[0] + self.end
        return out


#: Encoders of this process; a worker keeps its units from task to task.
_ENCODERS: dict[tuple, Encoder] = {}


def encoder_of(path: str, end: int, width: int, cache_units: int) -> Encoder:
    key = (path, end, width, cache_units)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(*key)
    return _ENCODERS[key]


def spread(raw: bytes, size: int, width: int, chunks: int = 8) -> bytes:
    """About ``size`` bytes of an id array: all of it, or chunks at equal distances from its start to its end."""
    if len(raw) <= size:
        return raw
    own = max(width, size // chunks // width * width)
    last = (len(raw) - own) // width
    return b"".join(raw[last * k // (chunks - 1) * width :][:own] for k in range(chunks))


def train_dictionary(docs: DataFrame, encoder: Encoder, id: str, text: str, rows: int, bytes_each: int, size: int) -> bytes:
    """A zstandard dictionary from the ``rows`` documents with the smallest hash of their id.

    Their whole texts are encoded in tasks; chunks spread over each id array, ``bytes_each`` in all, train.  That bounds
    the driver's share and steers compression alone.
    """
    import zstandard

    key, width = encoder.key, encoder.kind.itemsize

    def sample(batches):
        own = encoder_of(*key)
        for batch in _pieces(batches, 50):
            raw = own.encode([x or "" for x in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([spread(x, bytes_each, width) for x in raw], pa.binary())], names=["id", "t"])

    rows_of = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text"))
    chosen = rows_of.select("id").distinct().orderBy(F.xxhash64("id")).limit(rows)
    found = tb.mapped(rows_of.join(F.broadcast(chosen), "id"), sample, "id long, t binary")
    samples = [bytes(r.t) for r in found.groupBy("id").agg(F.min("t").alias("t")).orderBy("id").collect()]
    if sum(map(len, samples)) < 8 * size or len(samples) < 16:
        return b"".join(samples)[:size]
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:  # too few repeats among the samples
        return b"".join(samples)[:size]


def write_store(docs: DataFrame, path: str, tokenizer: str, end: int = 2, id: str = "doc_id", text: str = "text", level: int = 3,
                block_bytes: int = 1 << 20, dictionary_rows: int = 2_000, dictionary_bytes: int = 32 << 10, cache_units: int = 800_000) -> None:
    """Encodes every text (null: empty) and writes the store; rows that repeat an id follow one another."""
    spark = docs.sparkSession
    width = 2 if max(library(tokenizer).get_vocab_size(True) - 1, end) < 1 << 16 else 4
    trained = train_dictionary(docs, Encoder(tokenizer, end, width, cache_units), id, text, dictionary_rows, 4096, dictionary_bytes)
    name = hashlib.sha256(trained).hexdigest()
    shared = spark.sparkContext.broadcast(trained)

    def pack(batches):
        import zstandard

        encoder = encoder_of(tokenizer, end, width, cache_units)
        frames = zstandard.ZstdCompressor(level, dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None)
        shard, block, before = TaskContext.get().partitionId(), 0, 0
        ids, counts, held, size = [], [], [], 0

        def give():
            total = sum(counts)
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "block": block, "first_id": ids[0], "last_id": ids[-1], "ids": ids, "n": counts,
                "ends": np.cumsum([len(x) for x in held]).tolist(), "before": before, "n_ids": total, "dictionary": name,
                "payload": b"".join(held)}], pa.schema([
                    ("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("ids", pa.list_(pa.int64())),
                    ("n", pa.list_(pa.int32())), ("ends", pa.list_(pa.int64())), ("before", pa.int64()), ("n_ids", pa.int64()),
                    ("dictionary", pa.string()), ("payload", pa.binary())]))

        for batch in _pieces(batches, 250):
            for own, raw in zip(batch.column(0).to_pylist(), encoder.encode([x or "" for x in batch.column(1).to_pylist()])):
                frame = frames.compress(raw)
                ids.append(own)
                counts.append(len(raw) // width)
                held.append(frame)
                size += len(frame)
                if size >= block_bytes or len(ids) >= 20_000:
                    yield give()
                    before += sum(counts)
                    block += 1
                    ids, counts, held, size = [], [], [], 0
        if ids:
            yield give()

    rows = docs.select(F.col(id).cast("long").alias("id"), F.col(text).alias("text")).repartitionByRange("id").sortWithinPartitions("id")
    tb.mapped(rows, pack, BLOCKS).write.parquet(f"{path}/blocks")
    meta = spark.createDataFrame([(name, bytearray(trained), width, end)], "dictionary string, data binary, width int, end_id int")
    meta.coalesce(1).write.parquet(f"{path}/dictionary")


def _dictionary(spark, path: str):
    """The one row of the dictionary table, its hash verified."""
    row = spark.read.parquet(f"{path}/dictionary").first()
    if hashlib.sha256(row.data).hexdigest() != row.dictionary:
        raise ValueError("the dictionary does not have the hash that names it")
    return row.dictionary, bytes(row.data), row.width


def _frames(batch, name: str, inflate):
    """(id, start within the shard, raw ids) of each document of a batch of blocks."""
    for row in batch.to_pylist():
        if row["dictionary"] != name:
            raise ValueError("a block was written with another dictionary")
        at, start = 0, row["before"]
        for own, n, to in zip(row["ids"], row["n"], row["ends"]):
            yield own, start, n, inflate(row["payload"][at:to])
            at, start = to, start + n


def read_digests(spark, path: str, id: str = "doc_id") -> DataFrame:
    """id, start, n_tokens and ids_crc32 of each document, computed from the decoded files."""
    name, data, width = _dictionary(spark, path)
    shared = spark.sparkContext.broadcast(data)
    kind = np.dtype(f"<u{width}")

    def digest(batches):
        import zstandard

        inflate = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(shared.value) if shared.value else None).decompress
        for batch in _pieces(batches, 4):
            shards = {r["shard"] for r in batch.select(["shard"]).to_pylist()}
            for shard in shards:
                own = batch.filter(pa.array([x == shard for x in batch.column("shard").to_pylist()]))
                rows = [(i, s, len(x) // width, zlib.crc32(np.frombuffer(x, kind).astype("<u4").tobytes())) for i, s, n, x in _frames(own, name, inflate)]
                yield pa.RecordBatch.from_arrays([
                    pa.array([shard] * len(rows), pa.int32()), *(pa.array([r[k] for r in rows], pa.int64()) for k in range(4))],
                    names=["shard", "id", "start", "n_tokens", "ids_crc32"])

    blocks = spark.read.parquet(f"{path}/blocks")
    # Shards are as many as write tasks; one task orders their totals.
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    shards = shards.select("shard", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("shard_start"))
    rows = blocks.mapInArrow(digest, "shard int, id long, start long, n_tokens long, ids_crc32 long")
    return rows.join(F.broadcast(shards), "shard").select(
        F.col("id").alias(id), (F.col("shard_start") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")


def fetch(spark, path: str, ids: list[int]) -> dict[int, list[list[int]]]:
    """Token ids of a few documents: only blocks whose range holds one are read, only their frames are inflated."""
    import zstandard

    name, data, width = _dictionary(spark, path)
    inflate = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data) if data else None).decompress
    hit = F.lit(False)
    for x in ids:
        hit = hit | ((F.col("first_id") <= x) & (F.col("last_id") >= x))
    out: dict[int, list[list[int]]] = {x: [] for x in ids}
    for row in spark.read.parquet(f"{path}/blocks").where(hit).orderBy("shard", "block").toLocalIterator():
        for k, own in enumerate(row.ids):
            if own in out:
                frame = bytes(row.payload)[row.ends[k - 1] if k else 0 : row.ends[k]]
                out[own].append(np.frombuffer(inflate(frame), np.dtype(f"<u{width}")).tolist())
    return out


def store_and_digest(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes ``docs`` to a new store in the shared folder and returns the digests read back from it."""
    spark = docs.sparkSession
    path = new_path(spark, "tokens")
    write_store(docs, path, tokenizer, **options)
    return read_digests(spark, path)


def op7_token_store(spark, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of every document, from the written files."""
    import public_tokenizers

    return store_and_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
