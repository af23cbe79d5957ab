"""The pipeline against its stages by brute force, and each stage's columns."""

import importlib

import pandas as pd
import pytest

from test_text_operators import brute_components, brute_fingerprint, words

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pipeline():
    return importlib.import_module("corpus_pipeline")


def test_stages_in_order(spark, pipeline, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, SF)
        if name != pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs.toPandas()
    src = pd.read_parquet(f"{SF}/documents.parquet")
    first = seen["language_id"]
    assert set(first.doc_id) <= set(src.doc_id) and len(first) >= 0.95 * src.text.notna().sum()
    fps = [brute_fingerprint(t) for t in first.text]
    assert set(seen["simhash_near_dedup"].doc_id) == set(brute_components(first.doc_id.tolist(), fps))
    bench = pd.read_parquet(f"{SF}/benchmark.parquet")
    windows = set()
    for t in bench.text:
        w = words(t)
        windows |= {" " + " ".join(w[i : i + 10]) + " " for i in range(len(w) - 9)} if len(w) >= 10 else ({" " + " ".join(w) + " "} if w else set())
    clean = {i for i, t in zip(seen["simhash_near_dedup"].doc_id, seen["simhash_near_dedup"].text) if not any(x in f" {' '.join(words(t))} " for x in windows)}
    assert set(seen["benchmark_decontamination"].doc_id) == clean
    assert set(seen["best_fit_packing"].doc_id) == clean
    whole = pipeline.run(spark, SF).toPandas()
    assert set(whole.doc_id) == clean and whole.length.sum() == seen["best_fit_packing"].length.sum()


def test_queries_are_registered():
    import __spark_entry__ as e

    names = set(e.queries())
    for n in range(1, 11):
        assert sum(x.startswith(f"op{n}_") for x in names) == 1
    assert "pipeline" in names
