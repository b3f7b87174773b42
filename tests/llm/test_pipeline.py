"""The stages one after another, and run(), against brute force on the same documents."""
import numpy as np
import pytest

from test_text_operators import base_spans, cut_repeats, linked

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def test_stages_and_run(spark, messy, folder):
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language", "near_duplicates", "substrings", "secrets", "packing"]
    docs, seen = spark.read.parquet(f"{folder}/documents.parquet"), {}
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, folder)
        docs.write.parquet(f"{folder}/stages/{name}")
        docs = spark.read.parquet(f"{folder}/stages/{name}")
        assert k == 4 or docs.columns == columns
        seen[name] = docs.collect()
    texts = {r[0]: r[1] for r in messy}
    left = {r.doc_id: r.text for r in seen["language"]}
    assert left == {i: t for i, t in texts.items() if i not in (0, 1, 2, 11)} and all(r.lang for r in seen["language"])
    first = {i for i, (_, c) in linked(left).items() if c == i}
    assert sorted(r.doc_id for r in seen["near_duplicates"]) == sorted(first)
    left = {i: left[i] for i in first}
    cut = cut_repeats(left)
    left = {i: cut[i][2] if cut[i][1] else t for i, t in left.items()}
    assert {r.doc_id: r.text for r in seen["substrings"]} == left
    assert all(r.n_chars == len(r.text) for r in seen["substrings"])
    assert {r.doc_id: r.text for r in seen["secrets"]} == {i: t for i, t in left.items() if not base_spans(t)} | {r.doc_id: r.text for r in seen["secrets"] if base_spans(left[r.doc_id])}
    key = lambda rs: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in rs)
    tokens = lambda rs: sorted((r.doc_id, r.doc_tokens) for r in rs if r.start == 0)
    ran = corpus_pipeline.run(spark, folder).collect()
    assert tokens(ran) == tokens(seen["packing"]) and {r.doc_id for r in ran} == set(left)
    assert sum(r.length for r in ran) == sum(r.length for r in seen["packing"]) == sum(n for _, n in tokens(ran))
    assert len(key(ran)) > 0 and np.all([r.length > 0 for r in ran])
