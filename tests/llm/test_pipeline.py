"""Stages of the corpus pipeline on small tables: what goes, what stays, and the columns that come back."""

from __future__ import annotations

import random
import sys

import corpus_pipeline

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id string"


def table(spark, texts):
    return spark.createDataFrame([(i, t, "x", "s", len(t or ""), "clash") for i, t in texts], SCHEMA)


def test_near_duplicates_keep_the_least_id(spark):
    words = [f"w{i}" for i in range(60)]
    near = [*words[:59], "other"]                                   # 55 of 57 shingles
    half = [*words[:30], *(f"z{i}" for i in range(30))]             # 26 of 86 shingles
    texts = [(7, " ".join(words)), (3, " ".join(near)), (9, " ".join(words).upper()), (4, " ".join(half)),
             (11, None), (12, ""), (13, " \n"), (None, " ".join(words)), (4, " ".join(half))]
    docs = table(spark, texts)
    kept = corpus_pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    got = sorted((r.doc_id if r.doc_id is not None else -1) for r in kept.collect())
    assert got == [-1, 3, 4, 11, 12, 13]
    assert corpus_pipeline.drop_near_duplicates(spark, docs.limit(0), "").count() == 0


def test_shared_lines_go_but_documents_stay(spark):
    line = "a line of more than forty characters that many documents share"
    docs = table(spark, [(i, f"own text {i}\n{line}") for i in range(6)] + [(6, None), (7, "clean")])
    kept = corpus_pipeline.dedup_lines(spark, docs, "")
    assert kept.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in kept.collect()}
    assert set(got) == set(range(8)) and got[5][0] == f"own text 5\n{line}" and got[7] == ("clean", 5)
    assert all(got[i] == (f"own text {i}", 10) for i in range(5))


def test_rows_that_share_an_id_are_judged_by_their_texts(spark):
    b, other = "b " + " ".join(f"w{i}" for i in range(30)), "a z " + " ".join(f"v{i}" for i in range(30))
    near = b + " more"
    for rows in ([(3, b), (5, other), (5, b)], [(5, b), (5, other), (3, b)], [(3, near), (5, other), (5, b), (5, other)]):
        docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id bigint, text string, lang string, source string, n_chars bigint")
        left = sorted((r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect())
        assert left == sorted([(3, near if (3, near) in rows else b), (5, other)])


def test_texts_without_words_and_ids_stay(spark):
    rows = [(1, None), (1, None), (2, " \n"), (None, "one two"), (None, "one two"), (4, "one two"), (7, "ONE two")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, _pl_note string")
    left = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in left) == sorted((str(i), str(t)) for i, t in rows[:-1])
    assert corpus_pipeline.drop_near_duplicates(spark, docs.where("false"), "").count() == 0


def test_language_stage_rejects_only_what_no_language_explains(spark):
    rng = random.Random(2)
    words = {lang: ["".join(rng.choices(letters, k=rng.randint(3, 7))) for _ in range(60)]
             for lang, letters in (("aa", "abcdefghij"), ("zz", "klmnopqrst"))}
    rows = [(i, " ".join(rng.choices(words[lang], k=40)), lang) for i, lang in enumerate(["aa", "zz"] * 40)]
    clean = [*rows, (200, rows[0][1], None), (200, rows[0][1], None), (None, rows[1][1], "zz"), (201, rows[1][1] * 200, "zz")]
    gone = [(300, None, "aa"), (301, "", "aa"), (302, "123 -- 456", "aa"), (303, "".join(chr(0xAC00 + i) for i in range(80)), None)]
    docs = spark.createDataFrame([(i, t, lang, "s", len(t or ""), "clash") for i, t, lang in [*clean, *gone]], SCHEMA)
    kept = corpus_pipeline.identify_language(spark, docs, "")
    assert kept.columns == docs.columns
    key = lambda r: (str(r[0]), r[1], str(r[2]))
    assert sorted((tuple(r) for r in kept.collect()), key=key) == sorted(
        ((i, t, lang, "s", len(t), "clash") for i, t, lang in clean), key=key)
    assert corpus_pipeline.identify_language(spark, docs.limit(0), "").count() == 0


def test_encode_stage_returns_every_document(spark):
    docs = table(spark, [(1, "The cat sat."), (2, None), (3, ""), (None, "naïve 北京 🙂"), (1, "The cat sat.")])
    got = corpus_pipeline.encode(spark, docs, "").collect()
    assert sorted(str(r.doc_id) for r in got) == ["1", "1", "2", "3", "None"]
    by_id = {r.doc_id: r for r in got}
    assert len(by_id[2].ids) == len(by_id[3].ids) == 0 < len(by_id[None].ids)


def test_decontamination_stage_drops_planted_items_only(spark):
    folder = "/root/testdata/sf0.001"
    items = [r.text for r in spark.read.parquet(f"{folder}/benchmark.parquet").orderBy("item_id").limit(6).collect()]
    own = lambda seed: " ".join(f"p{random.Random(seed).randrange(10 ** 6)}x{i}y" for i in range(80))
    planted = [(i, f"{own(i)} {text} {own(-i)}") for i, text in enumerate(items)]
    clean = [(100 + i, own(100 + i)) for i in range(6)] + [(200, None), (201, ""), (None, planted[0][1]), (100, own(100))]
    docs = table(spark, [*planted, *clean])
    kept = corpus_pipeline.drop_contaminated(spark, docs, folder)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _ in clean)


def test_run_over_a_folder(spark):
    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    ids = [r.doc_id for r in corpus_pipeline.run(spark, folder).select("doc_id").collect()]
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_duplicates", "decontamination", "bpe"]
    known = {r.doc_id for r in docs.select("doc_id").collect()}
    assert len(ids) == len(set(ids)) and 0 < len(ids) <= len(known) and set(ids) <= known


def test_a_language_task_gives_back_the_encoder_that_its_worker_kept(spark, monkeypatch):
    from anomalytics.llm import bpe, common, language_id

    tasks = {}
    kind = type(table(spark, []))
    plain = kind.mapInArrow
    for module in (bpe, language_id):
        monkeypatch.setattr(kind, "mapInArrow", lambda df, run, schema, at=module: tasks.setdefault(at, run) and plain(df, run, schema))
        if module is bpe:
            corpus_pipeline.encode(spark, table(spark, [(1, "The cat sat.")]), "")
        else:
            language_id.identify(table(spark, [(1, "The cat sat.")]), {"langs": [], "alphabet": [], "singles": 62, "tables": [], "bits": []})
    try:
        assert list(tasks[bpe](iter([]))) == [] and hasattr(sys.modules[common.KEPT], "value")      # kept for its next task
        assert list(tasks[language_id](iter([]))) == [] and common.KEPT not in sys.modules
    finally:
        sys.modules.pop(common.KEPT, None)


def test_every_stage_releases_what_the_ones_before_left(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(corpus_pipeline, "release", calls.append)
    docs = spark.createDataFrame([(1, "The cat sat.", "en", "s", 12, "clash")], SCHEMA)
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES, 1):
        stage(spark, docs, "/root/testdata/sf0.001")
        assert calls == [spark] * n
