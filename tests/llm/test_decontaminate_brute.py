"""Benchmark decontamination against brute force over every document, item and offset."""

import random

from anomalytics.llm import decontaminate


def brute(docs, items, min_run=13, min_share=0.6):
    out = {}
    for d, text in docs:
        b = text.split()
        for i, item in items:
            a = item.split()
            best = None
            for offset in range(1 - len(a), len(b)):
                same = [0 <= offset + j < len(b) and a[j] == b[offset + j] for j in range(len(a))]
                runs = "".join("x" if s else " " for s in same).split()
                found = (sum(same), max(map(len, runs), default=0))
                if a and (found[1] >= min(min_run, len(a)) or found[0] >= min_share * len(a)):
                    best = max(best or found, found)
            if best:
                out[d, i] = (len(a), *best)
    return out


def test_rows_equal_brute_force(spark):
    rng = random.Random(8)
    common, rare = ["of", "the", "in", "to"], [f"word{chr(97 + i)}{chr(97 + j)}" for i in range(6) for j in range(6)]
    words = lambda n: [rng.choice(common if rng.random() < 0.5 else rare) for _ in range(n)]
    items = [(i, " ".join(words(n))) for i, n in enumerate([1, 2, 3, 4, 5, 7, 9, 12, 13, 14, 20, 31, 50, 50])]
    docs = []
    for d in range(160):
        own = rng.choice(items)[1].split()
        start = rng.randrange(len(own))
        part = own[start:start + rng.randrange(1, len(own) + 1)] if d % 2 else list(own)
        changed = [w if rng.random() > rng.choice([0, 0.2, 0.4, 0.5]) else rng.choice(common + rare) for w in part]
        docs.append((d, " ".join(words(rng.randrange(30)) + changed + words(rng.randrange(30)))))
    docs += [(1000, ""), (1001, "of the"), (1002, " ".join(words(4000)) + " " + items[-1][1])]
    got = decontaminate.contaminated(spark.createDataFrame(docs, "doc_id bigint, text string"),
                                     spark.createDataFrame(items, "item_id bigint, text string")).collect()
    want = brute(docs, items)
    assert len(want) > 100 and {(r.id, r.item_id): (r.n_tokens, r.n_match, r.longest_run) for r in got} == want
