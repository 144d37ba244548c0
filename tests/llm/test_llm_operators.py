"""Each corpus operator against a brute-force version on a small fixture with awkward rows."""

import hashlib
import math
import re
import time
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import types as T

from vigil.llm import (decontamination, html_text, jaccard_join, lm_scoring, mixing, quality_rules, suffix_dedup, token_counts, token_store,
                       toxicity)

DIR = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    """The small table with nulls, empty and very long texts, copies, periodic texts and zero bytes."""
    base = spark.read.parquet(f"{DIR}/documents.parquet")
    text = base.where("doc_id = 5").first().text
    rows = [(9000, None, None, None, None), (9001, "", "en", "src0", 0), (9002, " \n\t", "en", "", 3), (9003, text, None, None, 1), (9004, text, "xx", "src1", 1),
            (9005, re.sub("[a-z]", lambda m: m[0].upper(), text), "en", "src1", 1), (9006, "ab " * 9000, "en", "src2", 1), (9007, "x" * 250, "en", "src2", 1), (9008, "\0" * 150, "en", "src2", 1),
            (9009, "a<|endoftext|>  \n b \x1c c　d", "en", "src2", 1), (9010, text + " one more word", "en", "src3", 1), (9011, "two words", "en", "src3", 1),
            (9012, "two words", "en", "src3", 1), (9013, "日本 語 Ünï", "ja", "src3", 1)]
    return base.unionByName(spark.createDataFrame(rows, SCHEMA)).repartition(5).cache()


@pytest.fixture(scope="module")
def plain(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def words(text):
    return (text or "").encode().lower().split()


def test_html_text(spark):
    table = "<table><caption>Cap</caption><tr><th>Name<th>Qty<tr><td>apple<td>3<tr><td colspan=2>long <b>name</b></table>"
    page = f"<head><title>t</title></head><p>one  two<p>three<br>four<ul><li>a<li>b<ol start=3><li>x</ol></ul><div hidden>no</div>{table}<pre>\n a\n  b</pre>&lt;end"
    want = "one two\n\nthree\nfour\n\n- a\n- b\n  3. x\n\nCap\n\nName   Qty\napple  3\nlong name\n\n a\n  b\n\n<end"
    assert html_text.render(page)[0] == want
    deep = "<div>" * 30000 + "x" + "<table><tr><td>" * 60 + "y"
    rows = [(1, page, "clash"), (1, page, "clash"), (2, None, None), (3, "", ""), (4, "<", "a"), (5, deep, "a")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = [(r.page_id, r.text) for r in html_text.extract_text(df).collect()]
    assert sorted(got) == [(1, want), (1, want), (2, ""), (3, ""), (4, "<"), (5, "x\n\ny")]
    assert html_text.extract_text(df.limit(0)).count() == 0


def test_html_hides_what_a_browser_hides():
    page = "<script>var t='</p>'</script><details><summary>s</summary>no</details><span style='display: none'>no</span><noscript>no</noscript><select><option>a<option selected>b</select>"
    assert html_text.render(page)[0] == "s\nb" or html_text.render(page)[0] == "s\n\nb"


def test_dictionary_samples_reach_the_end_of_a_text():
    raw = np.arange(60_000, dtype="<u2").tobytes()
    ids = np.frombuffer(token_store.spread(raw, 4096, 2), "<u2")
    assert len(ids) == 2048 and ids[0] == 0 and ids[-1] == 59_999 and len(set(ids.tolist())) == 2048
    assert (np.diff(ids.reshape(8, 256), axis=1) == 1).all() and np.ptp(np.diff(ids.reshape(8, 256)[:, 0].astype(int))) <= 1
    assert token_store.spread(raw[:4096], 4096, 2) == raw[:4096] and token_store.spread(b"", 4096, 2) == b""


@pytest.mark.parametrize("page, want", [
    ("a<svg viewBox='0 0 1 1'><title>no</title><defs><text>no</text></defs><g><circle r=1 /><text x=1>One</text><text>T<tspan>wo</tspan></text></g>no</svg>b", "a One Two b"),
    ("<svg><path d=x><text><![CDATA[1 > 0]]></text><foreignObject><p>in</p></foreignObject></svg>after", "1 > 0\n\nin\n\nafter"),
    ("<svg><style/><text display=none>no</text><g><text>A</text><p>out</p>", "A\n\nout"),
    ("x = <math><semantics><mfrac><mn>1</mn><mi>n</mi></mfrac><annotation>no</annotation></semantics><mspace/><mo>+</mo><mtext>is <b>so</b></mtext></math>!", "x = 1 n +is so!"),
    ("<head><title>T</title>Hello <b>x</b>", "Hello x"),
    ("<head> <meta charset=utf-8>\n<title>T</title> <body>y", "y"),
    (" ".join(f"<input type={t} value={t}1>" for t in "email number search tel url date time month week datetime-local text submit odd".split()),
     "email1 number1 search1 tel1 url1 date1 time1 month1 week1 datetime-local1 text1 submit1 odd1"),
    ("".join(f"<input type={t} value=no>" for t in "hidden checkbox radio password file image color range".split()), ""),
])
def test_html_shows_what_a_browser_shows(page, want):
    assert html_text.render(page)[0] == want


def test_toxicity_learns_without_the_held_out(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{x}.parquet") for x in ("documents", "labels"))
    out = toxicity.op2_toxicity(spark, "/root/testdata/sf0.01").toPandas()
    assert len(out) == docs.count() and out.score.between(0, 1).all() and ((out.score >= 0.7) == (out.predicted == 1)).all()
    assert (out.held_out == out.doc_id.map(lambda x: zlib.crc32(str(x).encode()) % 3 == 1)).all()
    known = out.merge(labels.toPandas(), on="doc_id")
    held = known[known.held_out]
    rank, n1 = held.score.rank(), (held.toxic == 1).sum()
    assert (rank[held.toxic == 1].sum() - n1 * (n1 + 1) / 2) / (n1 * (len(held) - n1)) > 0.85
    flipped = labels.withColumn("toxic", (toxicity.fold("doc_id", 3) == 1).cast("int") * (1 - labels.toxic) + (toxicity.fold("doc_id", 3) != 1).cast("int") * labels.toxic)
    one, two = (toxicity.train(docs, x, may_learn=toxicity.fold("doc_id", 3) != 1) for x in (labels, flipped))
    assert (one.weights == two.weights).all() and one.intercept == two.intercept


def test_toxicity_edges(spark, docs, nothing):
    labels = spark.createDataFrame([(9003, 1), (9011, 0), (None, 1), (9004, None)], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    got = by_id(toxicity.score(docs, model))
    assert got[9000].score == got[9001].score and got[9003].score == got[9004].score > got[9011].score
    assert len(toxicity.train(docs, labels.limit(0)).chosen) == 0
    assert toxicity.score(nothing, model).count() == 0


def test_lm_scores(spark, docs, plain, nothing):
    from pyspark.sql import functions as F

    path = public_tokenizers.path("piece_bpe_32k.model")
    fold = F.crc32(F.col("doc_id").cast("string")) % 7 != 2
    got = by_id(lm_scoring.lm_scores(docs, fold, path, frequent=500))
    training = Counter()
    for i, text in plain.items():
        if zlib.crc32(str(i).encode()) % 7 != 2:
            training.update([*words(text), None])
    n, v = sum(training.values()), len(training)
    for i, text in plain.items():
        own = [*words(text), None]
        base = sum(math.log10((training[w] + 1) / (n + v + 1)) for w in own)
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(own), sum(training[w] > 0 for w in own), n)
        assert got[i].base_score == pytest.approx(base) and got[i].score < 0 and math.isfinite(got[i].score)
    assert got[9003].score == pytest.approx(got[9005].score) and got[9000].score == got[9001].score
    assert lm_scoring.lm_scores(nothing, fold, path).count() == 0


def test_lattice_sums_all_segmentations():
    pieces = (b" ", b" a", b"a", b"aa", b"ab", b"b", *(bytes([x]) for x in (120, 255)))
    p = np.array([0.05, 0.2, 0.1, 0.15, 0.2, 0.1, 0.1, 0.1])
    lattice = lm_scoring.Lattice(pieces, np.log(p))

    def brute(word):
        return 1.0 if not word else sum(q * brute(word[len(x):]) for x, q in zip(pieces, p) if word.startswith(x))

    own = [b"a", b"aab", b"aaaa", b"bx\xff", b"abab"]
    assert np.exp(lm_scoring.log_probability(lattice, own)) == pytest.approx([brute(b" " + w) for w in own])
    total = np.zeros(len(pieces))
    lattice.expected(np.array([[32, 97, 97]], np.uint8), np.array([3.0]), total)
    assert total @ [len(x) for x in pieces] == pytest.approx(9.0)  # expected pieces spell the word


@pytest.mark.parametrize("page, want", [
    ('<div style="visibility:hidden">no<span style="visibility:visible">yes</span>no</div>z', "yes\nz"),
    ('<div style="display:none">no<span style="visibility:visible">no</span></div>z', "z"),
    ('<table style="visibility:hidden"><tr><td>n<td style="visibility:visible">y<tr style="visibility:collapse"><td style="visibility:visible">z</table>', "y"),
    ('<svg><g visibility="hidden"><text>n</text><text visibility="visible">y</text></g><text>z</text></svg>e', "y z e"),
    ('<ul><li style="visibility:hidden">n<li>k</ul>', "- k"),
    ("<select size=3><option>a<option>b</select>", "a\nb"), ("<select><option>a<option>b</select>", "a"),
    ("a<!-- x --!>b<!-->c<!--->d<!-- e", "abcd"), ("<ruby>x<rp>(</rp><rt>y</rt><rp>)</rp></ruby>", "xy"),
    ("<span title='a>b'>c</span> 1 < 2 <a href=\"x", "c 1 < 2 <a href=\"x"), ('<a"b">c', "c"),
])
def test_html_visible_text(page, want):
    assert html_text.render(page)[0] == want


@pytest.mark.parametrize("page", ["<a " * 100_000, "<a" * 100_000, '<a "' * 50_001 + ">", "<a '\"" * 50_001 + ">", "<div>" * 50_000, "<p><button>" + "<div>" * 50_000,
                                  "<!--" * 50_000, "<svg>" + "<g>" * 50_000, "<table><tr><td>" + "<b>" * 50_000 + "<tr>" * 1_000])
def test_html_of_broken_pages_takes_linear_time(page):
    start = time.process_time()
    html_text.render(page)
    assert time.process_time() - start < 10  # a scan for each tag would take minutes


def test_lattice_of_long_words(monkeypatch):
    """Words of any length, alone or in a batch and in panels of any size, have the probabilities of a plain recursion."""
    pieces = (b" ", b" a", b"a", b"aa", b"ab", b"abab", b"b", b"x", b"xab")
    p = np.array([0.05, 0.2, 0.1, 0.15, 0.2, 0.1, 0.1, 0.05, 0.05])
    lattice = lm_scoring.Lattice(pieces, np.log(p))

    def brute(word):
        alpha = [0.0] + [-math.inf] * len(word)
        for end in range(1, len(word) + 1):
            parts = [alpha[end - len(x)] + math.log(q) for x, q in zip(pieces, p) if len(x) <= end and word[:end].endswith(x)]
            alpha[end] = max(parts) + math.log(sum(math.exp(y - max(parts)) for y in parts))
        return alpha[-1]

    own = [b"a", b"b", b"xabab", b"ab" * 31, b"ab" * 32, b"xab" * 22, b"xaabb" * 300, b"x"]
    want = [brute(b" " + w) for w in own]
    for panel in (1, 5, 1 << 16):
        monkeypatch.setattr(lm_scoring, "PANEL", panel)
        assert lm_scoring.log_probability(lattice, own) == pytest.approx(want)
        total, alone = np.zeros(len(pieces)), np.zeros(len(pieces))
        counts = np.arange(1.0, len(own) + 1)
        lm_scoring.expected_pieces(lattice, own, counts, total)
        for w, n in zip(own, counts):
            lattice.expected_alone(b" " + w, n, alone)
        assert total == pytest.approx(alone)
        assert total @ [len(x) for x in pieces] == pytest.approx(counts @ [len(w) + 1 for w in own])
    # A probability below the range of a double, inside a batch.
    rare = lm_scoring.Lattice((b" ", b"a", b"b"), np.log(np.array([1e-9, 1e-9, 1.0])))
    total = np.zeros(3)
    lm_scoring.expected_pieces(rare, [b"a" * 40, b"b"], np.array([2.0, 3.0]), total)
    assert total == pytest.approx([5.0, 80.0, 3.0])


def test_lm_scores_of_odd_rows(spark):
    """Repeated ids, null ids, a text without spaces, words beyond the broadcast table and extra columns that clash."""
    from pyspark.sql import functions as F

    path = public_tokenizers.path("piece_bpe_32k.model")
    long = "日本語" * 40
    rows = [(1, "a b a", 1, 2.0), (1, "a b a", 1, 2.0), (None, "a", 1, 2.0), (2, long, 1, 2.0), (3, f"{long} {long} b", 1, 2.0), (4, None, 1, 2.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n long, score double")
    got = lm_scoring.lm_scores(docs, F.lit(True), path).collect()
    assert sorted(r.n_tokens for r in got) == [1, 2, 2, 4, 4, 4] and {r.train_tokens for r in got} == {17}
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((r.n_known, r.base_score, r.score))
    assert by[1][0] == by[1][1] and len(by) == 5
    end, a, b, whole = by[4][0][2], by[None][0][2] - by[4][0][2], None, by[2][0][2] - by[4][0][2]
    b = by[1][0][2] - 2 * a - end
    assert by[3][0][2] == pytest.approx(2 * whole + b + end) and whole < 0
    base = {"a": 5, "b": 3, long: 3, None: 6}
    assert by[3][0][1] == pytest.approx(sum(math.log10((base[w] + 1) / (17 + 4 + 1)) for w in (long, long, "b", None)))


def test_mixing_matches_sql(spark, docs, tmp_path, nothing):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = mixing.op4_mix_sources(spark, str(tmp_path)).toPandas().sort_values("doc_id", ignore_index=True)
    want = con.sql(mixing.OP4_SQL).fetchdf().sort_values("doc_id", ignore_index=True)[list(got.columns)]
    assert got.equals(want.astype(got.dtypes))
    assert (got.taken <= 3 * got["size"]).all()
    mixed = mixing.mix(docs, keep=docs.columns)
    assert mixing.emit(mixed).columns == docs.columns and mixing.emit(mixed).count() == mixed.agg({"__copies": "sum"}).first()[0]
    assert mixing.mix(nothing).count() == 0


def test_targets_stop_at_the_cap(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 20), ("d", 0)], "key string, source_size long")
    got = {r.key: r.target for r in mixing.targets(sizes).collect()}
    assert got == {"a": 30.0, "b": pytest.approx(940.0), "c": 60.0, "d": 0.0}


def test_decontamination_matches_sql(spark, docs, tmp_path, nothing):
    items = spark.read.parquet(f"{DIR}/benchmark.parquet")
    text = items.first().text
    extra = docs.union(spark.createDataFrame([(9100, f"before {text.upper()} after", "en", "s", 1), (9101, " ".join(text.split()[:12]), "en", "s", 1), (9102, f"{text} {text}", "en", "s", 1)], SCHEMA))
    more = items.union(spark.createDataFrame([(900, None), (901, ""), (902, "two words"), (903, "words, two"), (902, "two words"), (904, text)], items.schema))
    extra.write.parquet(f"{tmp_path}/documents.parquet")
    more.write.parquet(f"{tmp_path}/benchmark.parquet")
    con = duckdb.connect()
    for x in ("documents", "benchmark"):
        con.sql(f"CREATE VIEW {x} AS SELECT * FROM '{tmp_path}/{x}.parquet/*.parquet'")
    got = decontamination.op5_benchmark_decontamination(spark, str(tmp_path)).toPandas().sort_values("doc_id", ignore_index=True)
    want = con.sql(decontamination.OP5_SQL).fetchdf().sort_values("doc_id", ignore_index=True)[list(got.columns)]
    assert got.equals(want.astype(got.dtypes))
    assert got.set_index("doc_id").contaminated[[9011, 9100, 9102]].all()
    assert decontamination.contamination(nothing, more).count() == 0
    assert decontamination.contamination(docs, more.limit(0)).where("n_hit > 0").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "x x alpha y beta y gamma"), (2, "alpha " + "y " * 40 + "beta gamma"), (3, None)], "doc_id long, text string")
    index = decontamination.build_index(docs)
    terms = decontamination.test_terms(spark.createDataFrame([(7, "gamma alpha beta")], "item_id long, text string"))
    got = decontamination.proximity_matches(index, terms, 3, 5).collect()
    assert len(got) == 1 and got[0].item == "7"


def test_token_counts(docs, plain, nothing):
    path = public_tokenizers.path("byte_bpe_50k.json")
    want = dict(zip(plain, token_counts.counts_of(path, [x or "" for x in plain.values()])))
    for frequent, cache in ((100, 50), (5000, 100_000)):
        got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(docs, path, frequent=frequent, cache_units=cache).collect()}
        assert got == want
    assert token_counts.token_counts(nothing, path).count() == 0


def test_token_store_round_trip(spark, docs, plain, nothing):
    from vigil.functions.storage import new_path

    tokenizer = public_tokenizers.path("word_bpe_49k.json")
    path = new_path(spark, "test-tokens")
    token_store.write_store(docs, path, tokenizer, block_bytes=20_000)
    got, start = by_id(token_store.read_digests(spark, path)), 0
    library = token_counts.library(tokenizer)
    for i in sorted(plain):
        ids = [*library.encode(plain[i] or "", add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    few = token_store.fetch(spark, path, [9000, 9011, 123456])
    assert few[9000] == [[2]] and few[9011] == [[*library.encode("two words", add_special_tokens=False).ids, 2]] and few[123456] == []
    assert token_store.store_and_digest(nothing, tokenizer).count() == 0


def test_suffix_dedup(docs, plain, nothing):
    got, seen = by_id(suffix_dedup.remove_repeats(docs)), set()
    for i in sorted(plain):
        raw = (plain[i] or "").encode()
        gone = np.zeros(len(raw), bool)
        for p in range(len(raw) - 99):
            if raw[p : p + 100] in seen:
                gone[p : p + 100] = True
            seen.add(raw[p : p + 100])
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(raw) else 0
        assert (got[i].n_bytes, got[i].n_removed, got[i].n_spans, got[i].kept_sha256) == (len(raw), gone.sum(), spans, hashlib.sha256(kept).hexdigest()), i
    assert suffix_dedup.remove_repeats(nothing).count() == 0


def test_suffix_dedup_repeated_rows(spark):
    rng = np.random.default_rng(3)
    a, b, c = ("".join(rng.choice(list("abcdefgh "), 300)) for _ in range(3))
    rows = [(1, a), (1, a), (1, a), (2, b + a), (2, b + a), (None, c), (None, c), (3, c), (4, a[:150] + a[:150]), (4, a[:150] + a[:150])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()
    # The first document of each text keeps it, in every copy of its row.
    assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in got) == [(-1, 0), (-1, 0), (1, 0), (1, 0), (1, 0), (2, 300), (2, 300), (3, 300), (4, 300), (4, 300)]


@pytest.mark.parametrize("hot", [1, 3])
def test_suffix_dedup_hot_anchors(docs, hot):
    covered = lambda df: {(r.id, r.name, p) for r in df.collect() for p in range(r.start, r.stop)}
    assert covered(suffix_dedup.repeated_spans(docs, hot=hot)) == covered(suffix_dedup.repeated_spans(docs, hot=10**9))


def test_suffix_dedup_keeps_places_beyond_two_gigabytes():
    big = pa.array([b"x" * (150 << 20)], pa.binary())
    held = [pa.RecordBatch.from_arrays([pa.array([i]), big], names=["h", "bytes"]) for i in range(15)]
    assert suffix_dedup._one_batch(held).column("h").to_pylist() == list(range(15))


def test_levels_stay_geometric():
    rng = np.random.default_rng(1)
    family, seen = suffix_dedup.Levels(), set()
    for _ in range(40):
        batch = np.array([f"{x:04d}" for x in rng.integers(0, 3000, 50)], "S4")
        want = []
        for x in batch:
            want.append(x in seen)
            seen.add(x)
        assert family.batch(batch).tolist() == want
        sizes = [len(x) for x in family.levels]
        assert all(a >= 2 * b for a, b in zip(sizes, sizes[1:]))


@pytest.mark.parametrize("size, num", [(4, 85), (5, 80)])
def test_jaccard_components(docs, plain, nothing, size, num):
    got = by_id(jaccard_join.jaccard_components(docs, size=size, num=num))
    sets = {}
    for i, text in plain.items():
        w = words(text)
        sets[i] = {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    order = sorted(sets)
    for k, a in enumerate(order):
        for b in order[:k]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert {i: (len(s), find(i)) for i, s in sets.items()} == {i: (r.n_shingles, r.component_id) for i, r in got.items()}
    assert jaccard_join.jaccard_components(nothing).count() == 0


def test_every_link_of_a_group_of_near_copies_is_counted(spark):
    """Copies are one class, linked texts of one component count each other, and a repeated row counts once."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:5 * k], f"other{k}", *base[5 * k + 1:]]) for k in range(8)] + ["alone " * 3]
    rows = [*enumerate(texts), (20, texts[0]), (3, texts[3])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = {t: {tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} for t in texts for w in [t.split()]}
    links = {t: sum(o != t and 100 * len(sets[o] & sets[t]) >= 85 * len(sets[o] | sets[t]) for o in texts) for t in texts}
    assert set(links.values()) == {0, 7}
    got = jaccard_join.jaccard_components(docs).collect()
    assert sorted((r.doc_id, r.n_links) for r in got) == sorted((i, links[t]) for i, t in rows)
    spanned = jaccard_join.jaccard_components(docs, every_link=False).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == sorted((r.doc_id, r.component_id) for r in spanned)


def test_entries_with_the_same_classes_are_one():
    entry, name = np.repeat(np.arange(4), 2), np.array([5, 9, 9, 5, 5, 7, 8, 8])
    batch = pa.RecordBatch.from_arrays([pa.array(entry), pa.array(name)], names=["entry", "class"])
    got = [r for x in jaccard_join._meetings(iter([batch])) for r in x.to_pylist()]
    lists = {}
    for r in got:
        lists.setdefault(r["entry"], []).append((r["class"], r["first"]))
    assert sorted(sorted(x) for x in lists.values()) == [[(5, 5), (5, 5), (9, 5), (9, 5)], [(5, 5), (7, 5)]]


def test_links_of_a_large_group_are_counted_without_its_pairs(spark, monkeypatch):
    """A dense group is counted by blocks of its texts, one or several; the pairs that are verified one by one grow with its classes."""
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join([*base[:5 * k], f"other{k}", *base[5 * k + 1:]]) for k in range(40)]
    docs = spark.createDataFrame([*enumerate(texts), (7, texts[7]), (90, texts[0]), (91, "alone")], "doc_id long, text string")
    sizes, linked = [], jaccard_join.linked

    def counted(pairs, *args, **kwargs):
        sizes.append(pairs.count())
        return linked(pairs, *args, **kwargs)

    monkeypatch.setattr(jaccard_join, "linked", counted)
    for block in (200_000, 2000):
        monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", block)
        sizes.clear()
        got = jaccard_join.jaccard_components(docs).collect()
        assert sorted((r.doc_id, r.component_id, r.n_links) for r in got) == sorted([(i, 0, 39) for i in [*range(40), 7, 90]] + [(91, 91, 0)])
        assert sum(sizes) < 5 * 40 < 40 * 39 / 2


def test_links_of_a_sparse_component_are_counted(spark, monkeypatch):
    """A chain, where each text links with a few others; blocks of one text each would copy every text to all others."""
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 100)
    line = [f"w{i}" for i in range(600)]
    texts = [" ".join(line[10 * k : 10 * k + 200]) for k in range(30)]
    sets = [{tuple(w[k : k + 4]) for k in range(len(w) - 3)} for w in map(str.split, texts)]
    links = [sum(a is not b and 100 * len(a & b) >= 85 * len(a | b) for b in sets) for a in sets]
    assert set(links) == {1, 2}
    got = jaccard_join.jaccard_components(spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.n_links) for r in got) == [(i, 0, n) for i, n in enumerate(links)]


def test_pigeonhole_loses_no_pair():
    """Random pairs at the threshold meet in an index entry, for sets of all band sizes and with every allocation."""
    rng = np.random.default_rng(2)
    for common in (0.0, 0.9):
        for _ in range(300):
            n = int(rng.integers(1, 400))
            base = np.unique(rng.integers(0, 2**64, n, dtype=np.uint64))
            most = int(len(base) * 15 / 85)
            other = np.unique(np.concatenate([base[: len(base) - int(rng.integers(0, max(1, len(base) * 15 // 100 + 1)))], rng.integers(0, 2**64, int(rng.integers(0, most + 1)), dtype=np.uint64)]))
            both = len(np.intersect1d(base, other))
            if 100 * both < 85 * (len(base) + len(other) - both):
                continue
            found = []
            for s in (base, other):
                own = [b for b in jaccard_join.bands(85, 100, 2 << len(s).bit_length(), common) if b.low <= len(s) <= b.high or (len(s) < b.low and 100 * len(s) >= 85 * b.low)]
                found.append(set(np.concatenate([jaccard_join.entries(s, b) for b in own]).tolist()))
            assert found[0] & found[1]
            for a, b in zip(jaccard_join.bitmaps(base)[2:], jaccard_join.bitmaps(other)[2:]):
                apart = sum(int(x).bit_count() for x in a.view(np.uint64) ^ b.view(np.uint64))
                assert apart <= len(base) + len(other) - 2 * both


def test_quality_statistics(docs, plain, nothing):
    got = by_id(quality_rules.text_statistics(docs, keep=["doc_id"]))
    word = re.compile("[^\x20\x09-\x0d]+")
    for i, text in plain.items():
        w = word.findall(text or "")
        windows = list(zip(w, w[1:], w[2:]))
        n, hit = Counter(windows), set()
        for k, x in enumerate(windows):
            hit |= {k, k + 1, k + 2} if n[x] > 1 else set()
        lines = Counter(x for x in (text or "").split("\n") if word.search(x))
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), sum(lines.values()) - len(lines), len(hit))
        assert tuple(got[i][1:6]) == want, i
    clash = quality_rules.text_statistics(docs.withColumnRenamed("n_chars", "n_words"))
    assert clash.columns.count("n_words") == 1
    assert quality_rules.text_statistics(nothing).count() == 0


def test_rules_cover_and_prune():
    rng = np.random.default_rng(3)
    x = {"a": rng.random(3000), "b": rng.random(3000)}
    bad = (x["a"] > 0.8) | ((x["b"] < 0.2) & (x["a"] > 0.4))
    rules = quality_rules.learn_rules(x, bad, np.arange(3000) % 3)
    hit = np.zeros(3000, bool)
    for rule in rules:
        hit |= rule.mask(x)
    assert 2 <= len(rules) <= 8 and (hit == bad).mean() > 0.98
    assert quality_rules.learn_rules(x, np.zeros(3000, bool), np.arange(3000) % 3) == []


def test_quality_verdict(spark, docs, nothing):
    labels = spark.read.parquet(f"{DIR}/labels.parquet")
    out = quality_rules.decide(docs, labels)
    assert out.where("kept and base_failed").count() == 0 and out.count() == docs.count()
    assert out.where("doc_id = 9000 and not kept").count() == 1
    assert quality_rules.decide(docs, labels.limit(0)).where("kept = base_failed").count() == 0
    assert quality_rules.decide(nothing, labels).count() == 0
    assert T.BooleanType() == out.schema["kept"].dataType
