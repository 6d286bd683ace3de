"""Jaccard join, top-k, URL filter, language-model scores, WARC and components against brute force."""

import datetime as dt
import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from anomalytics import session
from anomalytics.llm import common, components, jaccard_join, lm_score, topk, url_filter, warc, words

DOCS = "doc_id bigint, text string, node string"


# ---- components ------------------------------------------------------------------

def test_components_chain_star_and_pair(spark):
    edges = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1100)] + [(7000, 6000), (7000, 6000), (5, 5)]
    table = spark.createDataFrame(edges, "a bigint, b bigint")
    got = {r.node: r.component for r in components.components(table).collect()}
    assert got == {r.node: r.component for r in components.components(table, block=7).collect()}      # several blocks
    assert all(got[i] == 0 for i in range(61)) and all(got[i] == 1000 for i in range(1000, 1100))
    assert got[6000] == got[7000] == 6000
    assert components.components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ---- Jaccard join ----------------------------------------------------------------

def brute_components(texts):
    sets = []
    for _, t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set()))
    group = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                group = [group[b] if g == group[a] else g for g in group]
    out = []
    for i, (doc, _) in enumerate(texts):
        ids = [texts[j][0] for j in range(len(texts)) if group[j] == group[i] and texts[j][0] is not None]
        out.append((str(doc), len(sets[i]), (doc if not sets[i] else min(ids) if ids else None)))
    return sorted(out, key=str)


def joined(spark, texts, **more):
    rows = jaccard_join.jaccard_join(spark.createDataFrame([(i, t, "x") for i, t in texts], DOCS), **more).collect()
    return sorted(((str(r.id), r.n_shingles, r.component_id) for r in rows), key=str)


def test_jaccard_edges(spark):
    base = " ".join(f"w{i}" for i in range(40))
    texts = [(5, base), (3, base.upper()), (9, base + " tail one"), (2, "one two"), (1, "One  TWO\t"), (4, None), (6, ""), (7, " \n"),
             (None, base), (None, "lonely text of a row without id here"), (8, "É b c d e f"), (10, "é b c d e f"), (2, "one two"),
             (11, "a b c d e"), (12, "a b c d"), (13, " ".join(f"v{i}" for i in range(30_000)))]
    assert joined(spark, texts) == brute_components(texts)
    assert joined(spark, []) == []


def test_jaccard_families_equal_brute_force(spark):
    """Families of near copies around the threshold, shared passages, and chains that only link through others."""
    rng = random.Random(3)
    passage = [f"p{i}" for i in range(30)]
    texts, doc = [], 0
    for family in range(4):
        words = [f"f{family}x{i}" for i in range(60)]
        for _ in range(25):
            own = [w if rng.random() > 0.025 else f"r{rng.randrange(10 ** 6)}" for w in words]
            texts.append((doc, " ".join(own + (passage if rng.random() < 0.5 else []))))
            doc += 1
    chain = [f"c{i}" for i in range(60)]
    for step in range(30):
        chain[step * 2 % 60] = f"z{step}"
        texts.append((doc, " ".join(chain)))
        doc += 1
    rng.shuffle(texts)
    assert joined(spark, texts, pivots=3) == brute_components(texts)


def test_jaccard_sets_that_share_a_number(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "NODE_BITS", 2)                     # 14 different sets, four numbers
    texts = [(i, " ".join(f"g{i % 7}w{j}" for j in range(40)) + " end" * (i % 2)) for i in range(30)]
    assert joined(spark, texts) == brute_components(texts)


def test_jaccard_writes_no_whole_sets_and_deletes_its_steps(spark, monkeypatch):
    written = []
    monkeypatch.setattr(jaccard_join, "materialize", lambda df, name: written.append(common.materialize(df, name)) or written[-1])
    texts = [(i, " ".join(f"g{i % 7}w{j}" for j in range(40)) + " end" * (i % 2)) for i in range(30)]
    assert joined(spark, texts) == brute_components(texts)
    assert not any("shingles" in t.columns for t in written)
    kept = {t._written_to.rsplit("/", 1)[1].rsplit("-", 1)[0] for t in written if session.is_written(spark, t._written_to)}
    assert kept == {f"jaccard-{k}" for k in ("shared", "rows", "classes", "labels", "named", "components", "names")}


def test_jaccard_filter_takes_prefixes_evenly():
    """A prefix holds the smallest hashes of a set; the filter's segments go by the first bits of what it is given."""
    rng = np.random.default_rng(2)
    prefix = rng.integers(0, 1 << 62, 20_000, dtype=np.uint64)
    segments = np.bincount((jaccard_join.spread(prefix) >> np.uint64(58)).astype(int), minlength=64)
    assert len(np.unique(jaccard_join.spread(prefix))) == len(prefix) and segments.min() > 200


def test_jaccard_asks_no_pairs_of_sets_that_cannot_link(spark, monkeypatch):
    """Sets whose shingles are mostly their own meet in the cells of a passage; they are not compared with each other."""
    asked = []

    def count(df, name):
        table = common.materialize(df, name)
        if name == "jaccard-asked":
            asked.append(table.count())
        return table

    monkeypatch.setattr(jaccard_join, "materialize", count)
    monkeypatch.setattr(jaccard_join, "BLOCK_SHINGLES", 100)              # several blocks a task
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [(i, f"{passage} " + " ".join(f"own{i}w{j}" for j in range(20))) for i in range(30)]
    texts += [(100 + i, f"{passage} " + " ".join(f"both{i // 2}w{j}" for j in range(20)) + " end" * (i % 2)) for i in range(6)]
    assert joined(spark, texts) == brute_components(texts)
    assert 3 <= sum(asked) <= 15                                          # sets 100 to 105; 30 more shared cells with them


def test_jaccard_group_of_near_copies_asks_few_pairs(spark, monkeypatch):
    """Pairs of texts that link with each other only, each 30 shingles of 146 apart from a group of near copies: the places
    of the shingles that they share with the group rule it out, so that they are not compared with all of it."""
    asked = []

    def count(df, name):
        table = common.materialize(df, name)
        if name == "jaccard-asked":
            asked.append(table.count())
        return table

    monkeypatch.setattr(jaccard_join, "materialize", count)
    rng = random.Random(8)
    words, texts = [f"w{i}" for i in range(150)], []
    for doc in range(300):
        own = list(words)
        for at in rng.sample(range(8, 140, 6), 6 if doc % 6 == 0 else doc % 3):
            own[at] = f"own{doc}x{at}"
        texts += [(doc, " ".join(own)), (1000 + doc, " ".join(own + ["end"]))][:1 + (doc % 6 == 0)]
    assert joined(spark, texts) == brute_components(texts)
    assert sum(asked) <= 20 * len(texts)


def test_sketch_is_a_lower_bound():
    rng = np.random.default_rng(1)
    for n, m in ((5, 6), (100, 130), (3000, 2500)):
        a = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[: n // 2], rng.integers(0, 1 << 63, m, dtype=np.uint64)]))
        differ = len(np.setxor1d(a, b))
        assert jaccard_join.least_difference(jaccard_join.parity_sketch(a), jaccard_join.parity_sketch(b)) <= differ


# ---- top-k -----------------------------------------------------------------------

def test_top_k_equals_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", 16)
    monkeypatch.setattr(topk, "SHARD_ROWS", 40)
    monkeypatch.setattr(topk, "QUERY_ROWS", 3)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.normal(0, 0.2, 12)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(10)]                    # ties
    bad = [(300, None), (301, [1.0, None]), (302, [float("nan")] * 12), (303, [float("inf")] * 12), (None, rows[1][1]), (304, []), (0, rows[0][1])]
    df = spark.createDataFrame(rows + bad, "vec_id bigint, embedding array<float>").withColumn("score", F.lit("x"))
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 50 = 0"), k=5).collect()]
    ok = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in rows} | {304: np.zeros(12, int)}
    want = []
    for q in (0, 50, 100, 200):
        scores = sorted(((-int(ok[q] @ v), i) for i, v in ok.items() if i != q))[:5]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores)]
    assert sorted(got) == sorted(want)
    assert topk.top_k(df.where("vec_id < 0"), df, k=5).count() == 0
    assert topk.top_k(df, df.where("vec_id < 0"), k=5).count() == 0


def test_top_k_with_fewer_candidates_and_large_values(spark):
    df = spark.createDataFrame([(1, [1e12, 2.0]), (2, [3.0, 4e12]), (3, [1.0, 1.0])], "vec_id bigint, embedding array<double>")
    got = [(r.query_id, r["rank"], r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id = 3"), k=5).collect()]
    assert sorted(got) == [(3, 1, 2, 65536 * (3 + 4 * 10 ** 12)), (3, 2, 1, 65536 * (10 ** 12 + 2))]


# ---- URL filter ------------------------------------------------------------------

def day(n):
    return dt.datetime(2024, 1, 1) + dt.timedelta(days=n)


def test_url_filter_as_of(spark):
    changes = [("Bad.example", "host", "add", day(10)), ("bad.example", "host", "remove", day(20)), ("bad.example", "host", "add", day(30)),
               ("ok.example/x", "path", "add", day(5)), ("tie.example", "host", "add", day(3)), ("tie.example", "host", "remove", day(3)),
               ("bad.example", "host", "add", day(10)), (None, "host", "add", day(1)), ("nul.example", "host", "add", None),
               ("example", "tld", "add", day(40))]
    urls = ["http://www.BAD.example:80/a?q=http://ok.example/x", "https://notbad.example/", "http://u:p@ok.example/x/y#f", "http://ok.example/xy",
            "http://tie.example", "http://nul.example/", "mailto:a@bad.example", "", None]
    captures = [(i, u, day(d)) for i, u in enumerate(urls) for d in (0, 10, 19, 20, 35, 50)] + [(99, urls[0], None), (0, urls[0], day(10)), (None, urls[0], day(10))]
    df = spark.createDataFrame(captures, "page_id bigint, url string, fetched_at timestamp_ntz").withColumn("pattern", F.lit("x"))
    lists = spark.createDataFrame(changes, "pattern string, category string, action string, listed_at timestamp_ntz")
    got = {(r.page_id, r.fetched_at): (r.blocked, r.n_active, r.categories) for r in url_filter.url_filter(df, lists).collect()}
    spans = {0: [(10, 20, "host"), (30, 999, "host")], 2: [(5, 999, "path")]}
    for i, u in enumerate(urls):
        for d in (0, 10, 19, 20, 35, 50):
            active = {c for a, b, c in spans.get(i, []) if a <= d < b} | ({"tld"} if d >= 40 and u and "://" in u else set())
            assert got[i, day(d)] == (bool(active), len(active), ",".join(sorted(active))), (u, d)
    assert got[99, None] == (False, 0, "") and got[None, day(10)][0]
    assert url_filter.url_filter(df.limit(0), lists).count() == 0
    assert not any(r.blocked for r in url_filter.url_filter(df, lists.limit(0)).collect())


def test_url_filter_keeps_the_case_of_paths(spark):
    lists = spark.createDataFrame([("Ok.Example/Docs/A", "path", "add", day(1)), ("HOST.example", "host", "add", day(1))],
                                  "pattern string, category string, action string, listed_at timestamp_ntz")
    urls = ["http://OK.example/Docs/A/b", "http://ok.example/docs/a/b", "http://ok.example/Docs", "http://www.host.EXAMPLE/X"]
    df = spark.createDataFrame([(i, u, day(2)) for i, u in enumerate(urls)], "page_id bigint, url string, fetched_at timestamp_ntz")
    got = {r.page_id: (r.blocked, r.patterns) for r in url_filter.url_filter(df, lists).collect()}
    assert got == {0: (True, "ok.example/Docs/A"), 1: (False, ""), 2: (False, ""), 3: (True, "host.example")}


# ---- language-model scores -------------------------------------------------------

def brute_base(texts, training):
    tokens = [[*(t or "").encode().lower().split(), None] for _, t in texts]
    counts = Counter(w for own, (i, _) in zip(tokens, texts, strict=True) if training(i) for w in own)
    n, v = sum(counts.values()), len(counts)
    return [(len(own), sum(counts[w] > 0 for w in own), n, sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in own)) for own in tokens]


@pytest.mark.parametrize("head", [0, 3, 1000])
def test_lm_base_scores(spark, head, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_CHARS", 50)
    texts = [(i, " ".join(random.Random(i).choices(["The", "the", "cat", "sat", "é", "on", "mat"], k=i))) for i in range(25)]
    texts += [(30, None), (31, ""), (32, "unknown words only"), (1, "The cat"), (None, "cat"), (33, "cat " * 50_000)]
    df = spark.createDataFrame([(i, t, 1) for i, t in texts], "doc_id bigint, text string, row int")
    training = lambda i: i is None or i % 3 > 0
    got = lm_score.lm_score(df, F.coalesce(F.col("doc_id") % 3 > 0, F.lit(True)), head_words=head, filter_bits=1 << 18).collect()
    want = [(str(i), *row) for (i, _), row in zip(texts, brute_base(texts, training), strict=True)]
    key = lambda r: (r[0], r[1], r[2], round(r[4], 6))
    for r, w in zip(sorted(((str(r.id), r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in got), key=key), sorted(want, key=key), strict=True):
        assert r[:4] == w[:4] and r[4] == pytest.approx(w[4], rel=1e-9)
    assert all(r.score <= 0 for r in got)


def test_lm_filter_counts_and_held_out_gain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    rows = lm_score.lm_score(docs, ~held, filter_bits=1 << 24).collect()
    unseen = [r for r in rows if zlib.crc32(str(r.id).encode()) % 10 == 0]
    per_token = lambda field: sum(r[field] for r in unseen) / sum(r.n_tokens for r in unseen)
    assert per_token("score") > per_token("base_score")                  # bigrams help on texts that were not learned from


def test_lm_filter_holds_every_ngram(spark):
    df = spark.createDataFrame([(1, "a b a b a b a b c")], "doc_id bigint, text string")
    model = lm_score.build_filter(df, "text", 10, 1 << 20, 6.0)
    model["bits"] = np.frombuffer(model["bits"], np.uint8)
    known = lm_score.WordHashes()
    a, b, c, z = (np.array([known[w]], np.uint64) for w in (b"a", b"b", b"c", b"z"))
    got = [lm_score.probe_counts(model, h)[0] for h in (lm_score._mix(a), lm_score._mix(c), lm_score.bigram_hashes(a, b), lm_score.bigram_hashes(b, c), lm_score._mix(z))]
    assert got == [6.0, 1.0, 6.0, 1.0, 0.0]                              # 4 -> level 3, which stands for 1.5 * 4


def test_lm_scores_are_the_same_in_slices(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_CHARS", 5_000)
    texts = [" ".join(random.Random(i).choices([f"w{n}" for n in range(5_000)], k=300)) for i in range(40)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None, "w1 nowhere"])], "doc_id bigint, text string")
    train = F.col("doc_id") < 40
    broadcast, sliced = ({r.id: r for r in lm_score.lm_score(df, train, head_words=100, filter_bits=bits).collect()} for bits in (1 << 28, 1 << 14))
    assert sliced == broadcast and len(sliced) == 42


def brute_scores(texts, training, weight=10.0):
    """The model by its definition: every word's and bigram's count is rounded as the filter rounds it."""
    stands = lambda c: c if c < 2 else 1.5 * 2 ** (c.bit_length() - 1)
    tokens = {i: [*(t or "").encode().lower().split(), None] for i, t in texts}
    learned = [own for i, own in tokens.items() if training(i)]
    words = Counter(w for own in learned for w in own)
    pairs = Counter(p for own in learned for p in zip(["start", *own], own))
    n, v = sum(words.values()), len(words)
    below, count = n + 0.1 * (v + 1), lambda w: len(learned) if w in (None, "start") else stands(words[w])
    out = {}
    for i, own in tokens.items():
        out[i] = 0.0
        for before, w in zip(["start", *own], own):
            both = min(stands(pairs[before, w]), count(w), count(before))
            out[i] += math.log10(min(1.0, (both + weight * (count(w) + 0.1) / below) / (count(before) + weight)))
    return out


def test_lm_scores_equal_brute_force_at_every_size(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "CHUNK_CHARS", 500)
    texts = [(i, " ".join(random.Random(i).choices([f"W{n}" for n in range(60)], weights=range(1, 61), k=3 * i))) for i in range(60)]
    texts += [(61, None), (62, ""), (63, "nowhere W1 seen"), (64, "w59 " * 2_000)]
    df = spark.createDataFrame(texts, "doc_id bigint, text string")
    want = brute_scores(texts, lambda i: i % 3 > 0)
    for head, bits in ((0, 1 << 28), (7, 1 << 28), (10_000, 1 << 28), (0, 1 << 10), (10_000, 1 << 10)):   # broadcast, slices
        rows = lm_score.lm_score(df, F.col("doc_id") % 3 > 0, head_words=head, filter_bits=bits, bits_per_entry=4_000.0).collect()
        got = {r.id: r.score for r in rows}
        assert got.keys() == want.keys() and all(got[i] == pytest.approx(want[i], rel=1e-9) for i in want), (head, bits)


def test_lm_scores_do_not_depend_on_head_words(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    few, many = ({r.id: r.score for r in lm_score.lm_score(docs, F.col("doc_id") % 10 > 0, head_words=head).collect()} for head in (0, 200_000))
    assert few == many


def test_lm_slices_hold_every_counted_ngram(spark):
    texts = [" ".join(random.Random(i).choices([f"w{n}" for n in range(5_000)], k=300)) for i in range(40)]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    model = lm_score.build_filter(df, "text", 40 * 301, 1 << 28, 6.0)
    small = lm_score.build_filter(df, "text", 40 * 301, 1 << 14, 6.0)
    model["bits"], known = np.frombuffer(model["bits"], np.uint8), lm_score.WordHashes()
    for t in texts:
        tokens = np.array([known[w] for w in t.encode().split()], np.uint64)
        assert (lm_score.probe_counts(model, lm_score._mix(tokens)) > 0).all()
        assert (lm_score.probe_counts(model, lm_score.bigram_hashes(tokens[:-1], tokens[1:])) > 0).all()
    assert small["slices"].agg(F.sum("size")).first()[0] == 8 * len(model["bits"]) > 1 << 14


def test_lm_sliced_filter_is_filled_by_what_the_chunks_send(spark, monkeypatch):
    def no_filter(*args):
        raise AssertionError("the n-grams would be sent twice: to fill the slices and to be looked up")

    monkeypatch.setattr(lm_score, "build_filter", no_filter)
    monkeypatch.setattr(lm_score, "CHUNK_CHARS", 500)
    written = []
    monkeypatch.setattr(lm_score, "materialize", lambda df, name: written.append(common.materialize(df, name)) or written[-1])
    df = spark.createDataFrame([(i, f"the cat W{i} sat") for i in range(300)], "doc_id bigint, text string")
    rows = lm_score.lm_score(df, F.col("doc_id") % 3 > 0, filter_bits=1 << 10).collect()
    assert len(rows) == 300 and all(r.n_known == 4 + (r.id % 3 > 0) for r in rows)          # the cat sat, the end, W{i} if it was learned
    gone = [t._written_to.rsplit("/", 1)[1].rsplit("-", 1)[0] for t in written if not session.is_written(spark, t._written_to)]
    assert gone == ["lm-chunks", "lm-answers"]


def test_words_of_a_column_equal_bytes_split():
    texts = [None, "", " ", " a", "Ab  aB\tab\x0bx", "é Éa\x85b", "x" * 70 + " " + "X" * 70, "ab", "cd ", *(f"W{i}é" * (i % 12) for i in range(99))]
    for column in (pa.array(texts), pa.array(texts).slice(3), pa.array(texts, pa.large_string()), pa.array([], pa.string())):
        found, want = words.words_in(column), [(t or "").encode().lower().split() for t in column.to_pylist()]
        flat = [w for own in want for w in own]
        assert found.counts.tolist() == [len(own) for own in want]
        assert found.texts(np.arange(len(flat))).to_pylist() == [w.decode() for w in flat]
        assert found.hashes.tolist() == [words.hash_word(w) for w in flat] and len({*found.hashes.tolist()}) == len({*flat})


def test_lm_empty_and_untrained(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    assert lm_score.lm_score(df.limit(0), F.lit(True), filter_bits=1 << 18).count() == 0
    row = lm_score.lm_score(df, F.lit(False), filter_bits=1 << 18).first()
    assert (row.n_tokens, row.n_known, row.train_tokens, row.base_score, row.score) == (3, 0, 0, 0.0, 0.0)


# ---- WARC ------------------------------------------------------------------------

def test_warc_round_trip(spark, tmp_dir):
    big, copy = "<p>é" + "x" * 600_000, "<html>" + "same " * 40
    pages = [(5, "http://a/1", copy), (3, "http://a/2", copy), (9, None, copy), (1, "http://a/3", "short"), (2, "http://a/4", "short"),
             (4, "http://a/\r\n5", None), (6, "", ""), (7, "http://a/7", big), (8, "http://a/8", big), (None, "http://a/9", copy),
             (3, "http://a/2", copy), (10, "http://a/10", "WARC/1.1\r\n\r\nContent-Length: 5\r\n\r\n" * 9)]
    df = spark.createDataFrame([(i, u, h, "x") for i, u, h in pages], "page_id bigint, url string, html string, payload string").repartition(3)
    got = warc.warc_round_trip(df, f"{tmp_dir}/warc").collect()
    assert len(got) == len(pages)
    first = {}
    for i, _, h in pages:
        if i is not None and len((h or "").encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    want = []
    for i, u, h in pages:
        data = (h or "").encode()
        refers = first.get(h) if len(data) >= 100 and first.get(h) != i else None
        want.append((str(i), len(data), hashlib.sha256(data).hexdigest(), "revisit" if refers is not None else "response", refers))
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == sorted(want, key=str) or sorted(
        map(str, ((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got))) == sorted(map(str, want))
    assert all(bytes(r.payload).decode() == next(h or "" for i, _, h in pages if i == r.page_id) for r in got if r.record_type == "response" and r.page_id)
    assert warc.warc_round_trip(df.limit(0)).count() == 0


def test_warc_archives_are_monolithic_then_one_member_a_record(spark, tmp_dir):
    import gzip
    import zlib as z

    df = spark.range(200).selectExpr("id as page_id", "concat('http://h/', id) as url", "repeat(cast(id as string), 50) as html").coalesce(1)
    archives = warc.write_archives(df, f"{tmp_dir}/mono", archive_bytes=20_000)
    rows = archives.collect()
    assert len(rows) > 1 and sum(r.n_records for r in rows) == 200
    data = open(rows[0].path, "rb").read()
    whole = z.decompressobj(31)
    whole.decompress(data)
    assert whole.eof and not whole.unused_data                           # a single gzip stream
    index = warc.normalise(archives, f"{tmp_dir}/members").collect()
    assert len(index) == 200
    for r in index[:20]:
        with open(r.path, "rb") as f:
            f.seek(r.offset)
            assert gzip.decompress(f.read(r.length)).startswith(b"WARC/1.1\r\n")
    side = open(f"{index[0].path}.idx").read().splitlines()
    assert [tuple(map(int, x.split("\t")[:2])) for x in side] == sorted((r.offset, r.length) for r in index if r.path == index[0].path)


def test_records_of_reads_in_small_pieces(tmp_path):
    import zlib as z

    records = [warc.record(i, f"http://h/{i}", b"x" * (i * 37 % 500), "d", None) for i in range(40)]
    path = tmp_path / "a.gz"
    for members in (1, 40):                                              # one stream, or a member for each record
        step = 40 // members
        path.write_bytes(b"".join((c := z.compressobj(6, z.DEFLATED, 31)).compress(b"".join(records[i:i + step])) + c.flush() for i in range(0, 40, step)))
        with open(path, "rb") as f:
            assert list(warc.records_of(f, piece=64)) == records
    path.write_bytes(z.compress(b"".join(records)[:-10], wbits=31))
    with open(path, "rb") as f, pytest.raises(ValueError):
        list(warc.records_of(f))
