"""The pipeline's stages against brute force, each on its own input."""

import numpy as np

import corpus_pipeline
from arborspark.llm import decontamination, pii, quality, simhash
from arborspark.llm.common import materialize
from test_operators import brute_components, brute_fingerprint, no_docs, odd_docs


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    inputs = [docs]
    for name, stage in corpus_pipeline.STAGES:
        inputs.append(materialize(stage(spark, inputs[-1], sf), name))
    held = [{r.doc_id: r for r in df.collect()} for df in inputs[:-1]]
    # 1: the ranker's own scores decide
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    ranker = quality.train_on(docs, labels.filter(~quality.held_out(labels.doc_id)))
    assert set(held[1]) == {i for i, r in held[0].items() if ranker.score(np.array([quality.features(r.text)]))[0] >= 0.7}
    marked = {r.doc_id: r.quality for r in labels.collect()}
    assert np.mean([marked[i] for i in held[1] if i in marked]) > 0.95
    # 2: the smallest of each component
    ids = sorted(held[1])
    fps = np.array([brute_fingerprint(held[1][i].text) for i in ids], np.uint64)
    assert set(held[2]) == {c for c in brute_components(fps, ids)}
    # 3: nothing that holds a benchmark item
    items = [b" ".join(decontamination.bare_words(r.text)) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = lambda t: any(b" " + i + b" " in b" " + b" ".join(decontamination.bare_words(t)) + b" " for i in items)
    assert set(held[3]) == {i for i, r in held[2].items() if not leaks(r.text)}
    # 4: every text by the pseudonymizer
    assert {i: r.text for i, r in held[4].items()} == {i: pii.pseudonymize(r.text, pii.key_of(spark))[0] for i, r in held[3].items()}
    assert all(df.columns == docs.columns for df in inputs[:-1])
    # 5: whole rows, in order, one and a half times the words
    mixed = inputs[-1].collect()
    assert all(r.text == held[4][r.doc_id].text for r in mixed)
    words = sum(len(r.text.encode().split()) for r in held[4].values())
    assert abs(sum(r.taken_words for r in mixed) - 1.5 * words) <= 20
    assert corpus_pipeline.run(spark, sf).count() == len(mixed)


def test_stages_on_odd_rows(spark, sf):
    for docs in (odd_docs(spark), no_docs(spark)):
        df = docs
        for name, stage in corpus_pipeline.STAGES:
            df = materialize(stage(spark, df, sf), name)
        assert df.count() >= 0


def test_run_on_odd_rows(spark, sf, tmp_path):
    for n, docs in enumerate((odd_docs(spark).drop("a.b"), no_docs(spark))):
        docs.write.parquet(f"{tmp_path}/{n}/documents.parquet")
        for name in ("labels", "benchmark"):
            spark.read.parquet(f"{sf}/{name}.parquet").write.parquet(f"{tmp_path}/{n}/{name}.parquet")
        assert bool(corpus_pipeline.run(spark, f"{tmp_path}/{n}").count()) == (n == 0)


def test_near_dedup_keeps_one(spark, sf):
    docs = spark.createDataFrame([(2, "same words in here", "en", "a", 1), (1, "same words in here", "en", "b", 2), (1, "same words in here", "en", "b", 2)], "doc_id long, text string, lang string, source string, n_chars int")
    assert [(r.doc_id, r.source) for r in simhash.keep_first(docs).collect()] == [(1, "b")]


def test_near_dedup_drops_only_members_of_a_component(spark):
    one, two, three = ("alpha beta gamma delta epsilon", "red green blue white black brown", "north south east west up down")
    rows = [(1, one), (2, two), (2, one), (3, two), (3, three), (None, "a b c d e"), (None, "a b c d e"), (None, "f g h i j k"), (None, three)]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars int")
    assert len({simhash.fingerprint(t) for _, t in rows}) == 5
    kept = simhash.keep_first(docs)
    assert {(r.doc_id, r.text) for r in kept.collect()} == {(1, one), (2, two), (3, three), (None, "a b c d e"), (None, "f g h i j k")}
    assert kept.count() == 5 and kept.columns == docs.columns
