"""Benchmark decontamination with a distributed positional inverted index.

The index holds a posting (term, document, position) for every token of the training texts, sorted by term inside each
of its files, so that a file is an index shard of its own documents and building it needs no shuffle.  A test
item's windows are looked up from their rarest terms: the rarest term's list, shifted by its offset, gives
candidate alignments; the second rarest list thins them; all terms of the item confirm what is left.
Only DataFrame functions run here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigil.functions.storage import Scratch, cut, small

#: Digits, letters and everything beyond ASCII.
WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of a counted table that may be broadcast.
BROADCAST_ROWS = 500_000


def words(text: str) -> Column:
    """Words of a text as they are written; null has none."""
    return F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(WORD), F.lit(0))


def lowered(word: str) -> Column:
    """A-Z lower-cased; the built-in function does that alone where a word is plain ASCII."""
    return F.when(F.octet_length(word) == F.length(word), F.lower(word)).otherwise(F.translate(F.col(word), UPPER, LOWER))


def build_index(docs: DataFrame, id: str = "doc_id", text: str = "text", cut=cut) -> DataFrame:
    """The stored index: doc (row number), term (64-bit hash of the word), pos, and id.

    Each document also has one row without a term: its ``pos`` is the number of words, its ``id`` the document's id.
    Rows that repeat an id are documents of their own.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("doc"), F.col(id).alias("id"), F.array_append(words(text), F.lit(None)).alias("w"))
    tokens = rows.select("doc", "id", F.posexplode("w").alias("pos", "word"))
    own = tokens.select(
        "doc", F.when(F.col("word").isNotNull(), F.xxhash64(lowered("word"))).alias("term"), "pos",
        F.when(F.col("word").isNull(), F.col("id")).alias("id"))
    return cut(own.sortWithinPartitions("term", "doc", "pos"), "index")


def test_terms(items: DataFrame, id: str = "item_id", text: str = "text") -> DataFrame:
    """item, off, term and n (words of the item) of each word of each distinct item with words."""
    rows = items.select(F.col(id).cast("string").alias("item"), words(text).alias("w")).where(F.size("w") > 0).distinct()
    # The same id may come with several texts: each is an item of its own here.
    rows = rows.select("item", F.xxhash64("item", "w").alias("key"), "w", F.size("w").alias("n"))
    return rows.select("item", "key", "n", F.posexplode("w").alias("off", "word")).select("item", "key", "n", "off", F.xxhash64(lowered("word")).alias("term"))


def _anchors(terms: DataFrame, frequency: DataFrame, window: int) -> DataFrame:
    """key, n, off1, term1, off2, term2: for each window its two rarest terms; windows with an absent term are left out."""
    counted = terms.join(frequency, "term", "left").withColumn("df", F.coalesce("df", F.lit(0)))
    n_terms = F.least(F.lit(window), F.col("n"))
    spread = counted.select("key", "n", "off", "term", "df", F.explode(F.sequence(
        F.greatest(F.lit(0), F.col("off") - n_terms + 1), F.least(F.col("off"), F.col("n") - n_terms))).alias("start"))
    ranked = spread.groupBy("key", "n", "start").agg(F.sort_array(F.collect_list(F.struct("df", "off", "term"))).alias("t"))
    ranked = ranked.where(F.col("t")[0]["df"] > 0)
    second = F.coalesce(F.try_element_at("t", F.lit(2)), F.col("t")[0])
    return ranked.select("key", "n", F.col("t")[0]["off"].alias("off1"), F.col("t")[0]["term"].alias("term1"),
                         second["off"].alias("off2"), second["term"].alias("term2")).distinct()


def phrase_matches(index: DataFrame, terms: DataFrame, window: int = 13, cut=cut) -> DataFrame:
    """doc, item, first, last: maximal runs of positions that match an item word for word over ``window`` words or more.

    An item of fewer words matches as a whole.
    """
    known, _ = small(cut(terms.select("term").distinct(), "terms"), BROADCAST_ROWS)
    frequency = cut(index.join(known, "term").groupBy("term").agg(F.count(F.lit(1)).alias("df")), "frequency")
    anchors = cut(_anchors(terms, frequency, window), "anchors")

    first, _ = small(anchors.select("key", "n", "off1", F.col("term1").alias("term")).distinct(), BROADCAST_ROWS)
    found = index.join(first, "term").select("doc", "key", "off1", (F.col("pos") - F.col("off1")).alias("at"))
    found = found.where(F.col("at") > -F.lit(1 << 30))
    second = anchors.select("key", "off1", "off2", F.col("term2").alias("term")).distinct()
    second_rows, _ = small(second, BROADCAST_ROWS)
    asked = found.join(second_rows, ["key", "off1"]).select("doc", "key", "at", "term", (F.col("at") + F.col("off2")).alias("pos"))
    rare, _ = small(second.select("term").distinct(), BROADCAST_ROWS)
    thinned = asked.join(index.join(rare, "term").select("doc", "term", "pos"), ["doc", "term", "pos"]).select("doc", "key", "at").distinct()
    thinned = cut(thinned, "aligned")

    documents, _ = small(thinned.select("doc").distinct(), BROADCAST_ROWS)
    postings = index.where(F.col("term").isNotNull()).join(documents, "doc").select("doc", "term", "pos")
    asked = thinned.join(small(terms, BROADCAST_ROWS)[0], "key").select(
        "doc", "key", "item", "n", "at", "off", "term", (F.col("at") + F.col("off")).alias("pos"))
    same = asked.join(postings, ["doc", "term", "pos"])
    line = Window.partitionBy("doc", "key", "at").orderBy("off")
    islands = same.withColumn("island", F.col("off") - F.row_number().over(line))
    runs = islands.groupBy("doc", "key", "item", "n", "at", "island").agg(F.min("pos").alias("first"), F.max("pos").alias("last"))
    return runs.where(F.col("last") - F.col("first") + 1 >= F.least(F.lit(window), F.col("n"))).select("doc", "item", "first", "last")


def proximity_matches(index: DataFrame, terms: DataFrame, rarest: int = 3, within: int = 20) -> DataFrame:
    """doc, item, pos: places of an item's rarest term with its next ``rarest`` - 1 rarest terms at most ``within`` words away.

    Terms that no training text has are passed over; an item with a single known term matches wherever it stands.
    """
    frequency = index.join(terms.select("term").distinct(), "term").groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    own = terms.select("item", "key", "term").distinct().join(frequency, "term")
    rank = F.row_number().over(Window.partitionBy("key").orderBy("df", "term"))
    own = cut(own.withColumn("rank", rank).where(F.col("rank") <= rarest), "rarest")
    chosen = own.groupBy("key").agg(F.count(F.lit(1)).alias("wanted"))
    places = index.join(own, "term").select("doc", "item", "key", "rank", "pos", F.floor(F.col("pos") / (within + 1)).alias("cell"))
    heads = places.where("rank = 1").select("doc", "item", "key", F.col("pos").alias("at"), F.explode(
        F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    near = heads.join(places.where("rank > 1").select("doc", "key", "rank", "pos", "cell"), ["doc", "key", "cell"]).where(F.abs(F.col("pos") - F.col("at")) <= within)
    met = near.groupBy("doc", "item", "key", "at").agg(F.countDistinct("rank").alias("others"))
    full = met.join(chosen, "key").where(F.col("others") + 1 == F.col("wanted")).select("doc", "item", "at")
    alone = places.where("rank = 1").join(chosen.where("wanted = 1"), "key").select("doc", "item", F.col("pos").alias("at"))
    return full.union(alone).select("doc", "item", F.col("at").alias("pos")).distinct()


def contamination(docs: DataFrame, items: DataFrame, id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                  item_text: str = "text", window: int = 13) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    Words are digits, ASCII letters (lower-cased) and everything beyond ASCII.  A word is hit inside an occurrence of
    ``window`` consecutive words of an item, or of a whole shorter item.  A null or empty text or item has no
    words: nothing is hit, the digest is that of an empty string.  Equal items under one id count once.
    """
    scratch = Scratch(docs.sparkSession)
    index = build_index(docs, id, text, scratch.cut)
    matches = scratch.cut(phrase_matches(index, test_terms(items, item_id, item_text), window, scratch.cut), "matches")
    hit = matches.select("doc", F.explode(F.sequence("first", "last")).alias("pos")).distinct().groupBy("doc").agg(F.count(F.lit(1)).alias("n_hit"))
    named = matches.groupBy("doc").agg(F.sort_array(F.collect_set("item")).alias("items"))
    heads = index.where(F.col("term").isNull()).select("doc", F.col("id").alias(id), F.col("pos").cast("long").alias("n_words"))
    out = heads.join(hit.join(named, "doc"), "doc", "left")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    out = out.select(
        id, "n_words", n_hit.alias("n_hit"), F.coalesce(F.size("items"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("items", ","), F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (20 * n_hit >= F.col("n_words"))).alias("contaminated"))
    return scratch.last(out, "contamination")


def op5_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark."""
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
bw AS (
  SELECT item_id, least(13, len(w)) AS k, array_to_string(w[i:i + least(13, len(w)) - 1], ' ') AS p
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(13, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (
  SELECT doc_id, i, k, array_to_string(w[i:i + k - 1], ' ') AS p
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
m AS (SELECT DISTINCT dw.doc_id, dw.i, dw.k, bw.item_id FROM dw JOIN bw USING (k, p)),
h AS (
  SELECT doc_id, count(DISTINCT q) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + k)) AS q FROM m) GROUP BY doc_id),
s AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names
  FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM m) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN s USING (doc_id)
"""
