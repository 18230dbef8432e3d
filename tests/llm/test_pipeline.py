"""The pipeline against brute force, stage by stage."""

import random

import corpus_pipeline
import public_tokenizers
from tideline.llm import bpe, language

from .test_llm import WORDS, base_spans, prose, reference_encoding, shingle_set, slow_components, slow_fingerprint


def test_pipeline(spark, tmp_path):
    rng = random.Random(12)
    names = WORDS + [f"{a}{b}" for a in WORDS[:20] for b in WORDS[:20]]
    items = [(i, prose(rng, 30, names)) for i in range(5)]
    rows = [(i, prose(rng, rng.randint(40, 200), names)) for i in range(60)]
    rows += [(100 + i, rows[i][1]) for i in range(5)] + [(200, rows[20][1] + " " + items[0][1]), (201, "token = 'abcdef123456' " + prose(rng, 80, names)), (300, "12 34 !!"), (301, None), (302, "")]
    table = [(i, t, "en" if i % 2 else None, "s", len(t or "")) for i, t in rows]
    spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    kept = [(i, t) for i, t in rows if t and any(c.isalpha() for c in t)]
    component = slow_components([i for i, _ in kept], [slow_fingerprint(t) for _, t in kept])
    kept = [x for x, c in zip(kept, component) if x[0] == c]
    kept = [(i, t) for i, t in kept if not any(len(shingle_set(t) & shingle_set(x)) >= 0.8 * len(shingle_set(x)) for _, x in items)]
    want = {}
    encoding = reference_encoding()
    for i, t in kept:
        for a, _, b, _ in reversed(base_spans(t)):
            t = t[:a] + "[secret]" + t[b:]
        want[i] = encoding.encode_ordinary(t)
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == want and 200 not in got and 100 not in got and 201 in got
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language_id", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "byte_level_bpe"]
    assert language.LEAST_SCORE <= 0.5


def test_pipeline_edges(spark, tmp_path):
    """No rows at all; repeated rows, null ids and texts, very long texts, and columns whose names the stages use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, tag int, score string"
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    spark.createDataFrame([], schema).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    rng = random.Random(14)
    long_ = prose(rng, 150_000)
    rows = [(1, "alpha beta gamma delta epsilon zeta")] * 3 + [(2, None), (3, ""), (None, "quite another text without an id"), (5, long_)]
    table = [(i, t, None, "s", len(t or ""), 7, "x") for i, t in rows]
    spark.createDataFrame(table, schema).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    found = corpus_pipeline.run(spark, str(tmp_path))
    encoding = reference_encoding()
    assert {r["doc_id"]: r["ids"] for r in found.collect()} == {i: encoding.encode_ordinary(t) for i, t in rows if t}
    assert found.count() == 3 and found.columns == ["doc_id", "lang", "source", "n_chars", "tag", "score", "ids", "n_tokens"]


def test_pipeline_folds_words(spark, monkeypatch):
    """The last stage folds the distinct words of all texts, and Spark keeps no description with the rank map in it."""
    folds, fold = [], bpe.fold
    monkeypatch.setattr(bpe, "fold", lambda *a, **b: folds.append(fold(*a, **b)) or folds[-1])
    store = spark._jsparkSession.sharedState().statusStore()
    before = store.executionsCount()
    texts = ["thererhly zqxjk", "zqxjk straßenbahnhaltestelle 漢字漢", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["ids"] for r in corpus_pipeline.encode_tokens(spark, docs, "").collect()}
    encoding, ranks = reference_encoding(), bpe.load_ranks(corpus_pipeline.VOCABULARY)
    assert got == {i: encoding.encode_ordinary(t or "") for i, t in enumerate(texts)}
    assert len(folds) == 1
    codec = bpe.Codec(ranks, bpe.Splitter(public_tokenizers.PATTERN, True), folds[0])
    for word in ("thererhly", " zqxjk", "zqxjk", " straßenbahnhaltestelle", " 漢字漢"):
        assert codec.looked_up(word.encode()) == encoding._encode_single_piece(word.encode())
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    kept = [store.executionsList(k, 1).apply(0) for k in range(before, store.executionsCount())]
    assert kept and all(len(x.physicalPlanDescription()) < 100_000 for x in kept)
    assert all(len(node.desc()) < 100_000 for x in kept for node in nodes(store.planGraph(x.executionId())))


def nodes(graph):
    found = graph.allNodes()
    return [found.apply(k) for k in range(found.size())]
