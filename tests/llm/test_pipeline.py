"""The pipeline's stages against brute force on the smallest tables, and its edge rows."""

import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from vigil.functions.storage import cut, new_path
from vigil.llm import decontamination, mixing, quality_rules
from vigil.llm.token_counts import library

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    text = docs.where("doc_id = 5").first().text
    rows = [(9000, None, None, None, None), (9001, "", "en", "src0", 0), (9003, text, None, None, 1), (9005, text + " and more", "en", "src1", 1)]
    docs = cut(docs.unionByName(spark.createDataFrame(rows, docs.schema)))
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(cut(stage(spark, out[-1], DIR), name))
    return out


def test_all_but_the_last_return_documents(stages):
    for df in stages[1:-1]:
        assert df.columns == stages[0].columns
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "ngram_jaccard_join", "benchmark_decontamination", "mix_sources", "token_store"]


def test_quality_keeps_what_no_rule_rejects(spark, stages):
    found = quality_rules.decide(stages[0], spark.read.parquet(f"{DIR}/labels.parquet"))
    want = {r.doc_id for r in found.where("kept").collect()}
    assert {r.doc_id for r in stages[1].collect()} == want and 9000 not in want and 9001 not in want


def test_one_document_of_each_group_stays(stages):
    sets = {}
    for r in stages[1].collect():
        w = (r.text or "").encode().lower().split()
        sets[r.doc_id] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 80 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert sorted(r.doc_id for r in stages[2].collect()) == sorted(i for i in sets if find(i) == i)


def test_contaminated_documents_go(stages):
    con = duckdb.connect()
    con.register("documents", stages[2].toPandas())
    con.sql(f"CREATE VIEW benchmark AS SELECT * FROM '{DIR}/benchmark.parquet'")
    clean = con.sql(f"SELECT doc_id FROM ({decontamination.OP5_SQL}) WHERE NOT contaminated").fetchall()
    assert sorted(r.doc_id for r in stages[3].collect()) == sorted(x for x, in clean)


def test_mix_repeats_whole_documents(stages):
    con = duckdb.connect()
    con.register("documents", stages[3].toPandas())
    want = {i: taken // size for i, size, taken in con.sql(f"SELECT doc_id, size, taken FROM ({mixing.OP4_SQL}) WHERE taken > 0").fetchall()}
    assert Counter(r.doc_id for r in stages[4].collect()) == want


def test_token_store_holds_the_mix(stages):
    encode, start, want = library(public_tokenizers.path("word_bpe_49k.json")).encode, 0, []
    for r in sorted(stages[4].collect(), key=lambda r: r.doc_id):
        ids = [*encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, stages[5].collect())) == sorted(want)


def test_rows_that_share_an_id_are_judged_alone(spark, stages):
    item = " ".join(f"bench{k}" for k in range(40))
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    rows = [(1, a), (1, b), (2, a + " end"), (None, c), (None, c + " end"), (3, item), (3, b + " own"), (None, item)]
    docs = cut(spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], stages[0].schema))
    got = [(r.doc_id, r.text[:6]) for r in corpus_pipeline.near_duplicates(spark, docs, DIR).collect()]
    assert Counter(got) == Counter([(1, a[:6]), (1, b[:6]), (None, c[:6]), (3, item[:6])])
    items = spark.createDataFrame([(1, item)], spark.read.parquet(f"{DIR}/benchmark.parquet").schema)
    folder = new_path(spark, "bench")
    items.write.parquet(f"{folder}/benchmark.parquet")
    got = [(r.doc_id, r.text) for r in corpus_pipeline.decontaminated(spark, docs, folder).collect()]
    assert Counter(got) == Counter((i, t) for i, t in rows if t != item)


def test_stages_take_empty_tables(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, DIR).count() == 0
