"""Mixing, whitening and collocations against brute force, and their edge cases."""

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from anomalytics.llm import collocations, mixing, whitening

MIX_DOCS = "doc_id bigint, text string, source string, size string, key string, target string"


# ---- mixing ----------------------------------------------------------------------

def fill(sizes, weights, share=1.5, most=2):
    """Water filling by its definition: deal out, stop full sources, deal out the rest."""
    left, open_, target = share * sum(sizes), list(range(len(sizes))), [0.0] * len(sizes)
    while open_:
        total = sum(weights[i] for i in open_)
        full = [i for i in open_ if left * weights[i] / total >= most * sizes[i]]
        if not full:
            for i in open_:
                target[i] = left * weights[i] / total
            break
        for i in full:
            target[i] = most * sizes[i]
            left -= target[i]
        open_ = [i for i in open_ if i not in full]
    return target


def mix_rows(n=300, seed=3):
    rng = random.Random(seed)
    sources = ["b"] * 100 + ["a", "é", "Z", "zz", "q1", "q2", "q3"] * 10 + [None] * 5
    return [(i, " ".join("w" for _ in range(rng.choice([1, 3, 20, 200]))), rng.choice(sources), "x", "y", "z") for i in range(n)]


def check_mix(rows, got, weights=(3, 1, 2)):
    sources = sorted({s for _, _, s, *_ in rows if s is not None}, key=lambda s: [ord(c) for c in s]) + (
        [None] if any(s is None for _, _, s, *_ in rows) else [])
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = {s: sum(count(t) for _, t, own, *_ in rows if own == s) for s in sources}
    target = dict(zip(sources, fill([sizes[s] for s in sources], [weights[i % len(weights)] for i in range(len(sources))]), strict=True))
    taken = Counter()
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
    return target, taken


def test_mix_targets_and_reruns(spark):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, MIX_DOCS)
    got = mixing.mix(docs).collect()
    assert sorted((r.id, r.size) for r in got) == sorted((i, len(t.split())) for i, t, *_ in rows)
    target, taken = check_mix(rows, got)
    assert all(taken[s] == int(target[s]) for s in target)
    again = mixing.mix(docs.repartition(13, "text")).collect()
    assert sorted(got, key=str) == sorted(again, key=str)
    other = mixing.mix(docs, seed=1).collect()
    assert {(r.id, r.taken) for r in other} != {(r.id, r.taken) for r in got}


def test_mix_small_ranges_agree(spark, monkeypatch):
    docs = spark.createDataFrame(mix_rows(), MIX_DOCS)
    whole = sorted(mixing.mix(docs).collect(), key=str)
    monkeypatch.setattr(mixing, "RANGE_ROWS", 7)
    assert sorted(mixing.mix(docs).collect(), key=str) == whole


def test_mix_order_is_fair(spark):
    docs = spark.createDataFrame(mix_rows(600), MIX_DOCS)
    rows = sorted((r for r in mixing.fair_queue(docs).collect() if r.words), key=lambda r: r.position)
    assert all(a.position + a.words == b.position and a.finish <= b.finish for a, b in zip(rows, rows[1:], strict=False))
    total, budget, seen, largest = rows[-1].position + rows[-1].words, sum({r.source: r.target for r in rows}.values()), Counter(), 200
    assert budget - len({r.source for r in rows}) <= total <= budget
    target = {r.source: r.target for r in rows}
    for r in rows:                                      # every source keeps its share at every moment, but for a document or two
        seen[r.source] += r.words
        assert abs(seen[r.source] - r.finish * target[r.source]) <= largest
        done = (r.position + r.words) / budget
        assert all(abs(seen[s] - done * target[s]) <= largest * len(target) for s in target)


def test_mix_edges(spark):
    rows = [(1, None, "a", "", "", ""), (2, "", "a", "", "", ""), (3, " \n\t", None, "", "", ""), (None, "x y", "a", "", "", ""),
            (None, "x y", "a", "", "", ""), (None, "p q", "a", "", "", ""), (7, "x y z", "b", "", "", ""), (7, "one", "b", "", "", "")]
    got = mixing.mix(spark.createDataFrame(rows, MIX_DOCS)).collect()
    assert sorted((str(r.id), r.size) for r in got) == sorted([("1", 0), ("2", 0), ("3", 0), *[("None", 2)] * 3, ("7", 2), ("7", 1)])
    check_mix(rows, got)
    assert len({r.taken for r in got if r.id is None}) == 1           # equal rows share alike
    assert mixing.mix(spark.createDataFrame([], MIX_DOCS)).count() == 0
    empty = mixing.mix(spark.createDataFrame([(1, None, None, "", "", "")], MIX_DOCS)).collect()
    assert [(r.id, r.size, r.target, r.taken) for r in empty] == [(1, 0, 0.0, 0)]


def test_mix_hot_equal_rows_and_native_plan(spark):
    rows = [(None, "a b c", "hot", "", "", "")] * 9000 + mix_rows(50)
    mixed = mixing.mix(spark.createDataFrame(rows, MIX_DOCS))
    assert not re.search("Python|Arrow|Pandas", mixed._jdf.queryExecution().executedPlan().toString())
    got = mixed.collect()
    assert len(got) == len(rows)
    target, taken = check_mix(rows, got)
    assert abs(taken["hot"] - target["hot"]) <= 9000                  # what the division by the copies leaves


# ---- whitening -------------------------------------------------------------------

VECTORS = "vec_id bigint, embedding array<float>, n string, component string"


def brute_whitening(vectors, k):
    x = np.floor(64 * np.asarray(vectors, dtype=np.float64)).astype(np.int64) + 1_000_000
    n, sums = len(x), x.sum(axis=0)
    exact = [[int(n * v - s) for v, s in zip(row, sums, strict=True)] for row in x.tolist()]
    d = x.shape[1]
    cov = np.array([[sum(r[a] * r[b] for r in exact) / n ** 3 for b in range(d)] for a in range(d)])
    values, vecs = np.linalg.eigh(cov)
    values, vecs = values[::-1][:k], vecs[:, ::-1][:, :k]
    return [sum(c * c for c in r) for r in exact], (np.array(exact) / n) @ vecs / np.sqrt(values), values / np.trace(cov), cov


def whitened(got):
    out = defaultdict(dict)
    for r in got:
        out[r.vec_id][r.component] = r.whitened
    return out


def test_whitening_equals_brute_force(spark):
    rng = np.random.default_rng(5)
    data = (rng.normal(size=(400, 9)) @ rng.normal(size=(9, 9)) * 3).astype(np.float32)
    table = spark.createDataFrame([(i, v.tolist(), "x", "y") for i, v in enumerate(data)], VECTORS)
    got = whitening.whiten(table, components=6).withColumnRenamed("id", "vec_id").collect()
    deviation, z, shares, cov = brute_whitening(data, 6)
    model = whitening.fit(whitening.usable(table, "embedding", 64), "embedding", 6)
    assert np.allclose(model.covariance, cov, rtol=1e-13)
    assert len(got) == 400 * 6 and all(int(r.deviation) == deviation[r.vec_id] and r.n == 400 for r in got)
    own = whitened(got)
    own = np.array([[own[i][c + 1] for c in range(6)] for i in range(400)])
    signs = np.sign((own * z).sum(axis=0))
    assert np.abs(own - z * signs).max() < 1e-8
    assert all(r.explained == pytest.approx(shares[r.component - 1], rel=1e-9) and r.identity_error < 1e-9 for r in got)
    assert np.abs(np.cov(own.T, bias=True) - np.eye(6)).max() < 1e-9


def test_whitening_large_values_stay_exact(spark):
    rng = np.random.default_rng(6)
    data = (rng.normal(size=(50, 3)) * 1e9).astype(np.float32)
    got = whitening.whiten(spark.createDataFrame([(i, v.tolist(), "x", "y") for i, v in enumerate(data)], VECTORS)).collect()
    deviation, *_ = brute_whitening(data, 3)
    assert {r.id: int(r.deviation) for r in got} == dict(enumerate(deviation))


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0], "", ""), (2, [2.0, 1.0], "", ""), (3, [0.5, 0.0], "", ""), (3, [0.5, 0.0], "", ""), (None, [4.0, 4.0], "", ""),
            (4, None, "", ""), (5, [1.0, None], "", ""), (6, [nan, 1.0], "", ""), (7, [inf, 1.0], "", ""), (8, [], "", ""),
            (9, [1.0], "", ""), (10, [1e30, 0.0], "", "")]
    got = whitening.whiten(spark.createDataFrame(rows, VECTORS)).collect()
    assert sorted(str(r.id) for r in got) == sorted(["1", "2", "3", "3", "None"] * 2) and {r.n for r in got} == {5}
    same = [(i, [1.0, 2.0, 3.0], "", "") for i in range(4)]
    for rows in ([], same, same[:1], [(1, None, "", "")]):
        assert whitening.whiten(spark.createDataFrame(rows, VECTORS)).count() == 0
    flat = whitening.whiten(spark.createDataFrame([(i, [float(i), 2.0 * i, 7.0], "", "") for i in range(5)], VECTORS)).collect()
    assert {r.component for r in flat} == {1} and all(r.explained == pytest.approx(1.0) for r in flat)


# ---- collocations ----------------------------------------------------------------

LANG_DOCS = "text string, lang string, phrase string, n string"


def brute_collocations(rows, least, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    f, n = defaultdict(Counter), Counter()
    for text, lang, *_ in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(lower)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang or "und"][tuple(w[i:i + k])] += 1
    out = []
    for lang, count in f.items():
        found = []
        for p, a in count.items():
            if len(p) < 2 or a < least:
                continue
            if any(len(q) > len(p) and b >= least and 100 * b >= 80 * a and any(q[i:i + len(p)] == p for i in range(len(q) - len(p) + 1))
                   for q, b in count.items() if b >= least):
                continue
            score, k = min((2_000_000 * a // (count[p[:k]] + count[p[k:]]), k) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), a, count[p[:k]], count[p[k:]]))
        out += [(lang, r + 1, p.decode(), a, left, right, n[lang], -s) for r, (s, _, p, a, left, right) in enumerate(sorted(found)[:top])]
    return sorted(out)


def mined(spark, rows, **more):
    got = collocations.collocations(spark.createDataFrame(rows, LANG_DOCS), **more).collect()
    return sorted((r.lang, r["rank"], r.phrase, r.a, r.l, r.r, r.n, r.score) for r in got)


def phrase_rows(n=400, seed=1):
    rng = random.Random(seed)
    words = ["a", "B", "cc", "é", " x", "d-d", "\U0001f600", "e"]
    text = lambda: "".join(rng.choice(words) + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"])
                           for _ in range(rng.randrange(30)))
    return [(text() + rng.choice(["New York City", "new york", ""]), rng.choice(["en", "en", "de", None, "und"]), "x", "y") for _ in range(n)]


def test_collocations_equal_brute_force(spark, monkeypatch):
    rows = phrase_rows()
    want = brute_collocations(rows, 5, 40)
    assert len(want) > 50 and mined(spark, rows, least=5, top=40) == want
    monkeypatch.setattr(collocations, "SMALL", 4)
    monkeypatch.setattr(collocations, "BLOCK", 300)
    monkeypatch.setattr(collocations, "GROUP", 3)
    assert mined(spark, rows, least=5, top=40) == want                 # many blocks, partitions down to a few pointers
    monkeypatch.setattr(collocations, "pair_filter", lambda found, n: b"\xff" * 128)
    assert mined(spark, rows, least=5, top=40) == want                 # a filter that lets all through


def test_collocations_edges(spark):
    assert mined(spark, []) == [] and mined(spark, [(None, "en", "", ""), ("", None, "", ""), (" \n.,", "en", "", "")], least=1) == []
    assert mined(spark, [("one two", "en", "", "")] * 3, least=3) == [("en", 1, "one two", 3, 3, 3, 6, 1_000_000)]
    assert mined(spark, [("one. two", "en", "", "")] * 3, least=1) == []
    long = "alpha beta gamma " * 30_000
    assert mined(spark, [(long, "en", "", "")], least=1000) == brute_collocations([(long, "en")], 1000, 2000)


def test_multikey_sort_orders_and_counts():
    rng = np.random.default_rng(2)
    keys = [rng.integers(1, 6, 5000), rng.integers(0, 5, 5000), rng.integers(0, 9, 5000)]
    for k in (1, 2):
        keys[k][(keys[k - 1] == 0)] = 0
    for small in (1, 10, 10_000):
        order = collocations.multikey_sort(keys, small)
        assert sorted(order) == list(range(5000))
        for depth in (1, 2, 3):
            rows, n = collocations.equal_parts(keys, order, None, depth)
            want = Counter(t for t in zip(*(k.tolist() for k in keys[:depth]), strict=True) if t[-1])
            assert dict(zip(zip(*(k[rows].tolist() for k in keys[:depth]), strict=True), n.tolist(), strict=True)) == want
