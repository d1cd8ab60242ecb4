import re
from collections import defaultdict

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from tests_llm_helpers import brute_components, brute_print  # noqa: E402


def test_stages_against_brute_force(spark):
    path = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{path}/documents.parquet")
    kept, columns = docs, docs.columns
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        kept = corpus_pipeline.materialize(stage(spark, kept, path), name)
        assert kept.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in kept.collect()}
    every = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert seen["language_id"] == {d: t for d, t in every.items() if re.search(r"[^\W\d_]", t or "")}
    prints = {d: brute_print(t) for d, t in seen["language_id"].items()}
    assert set(seen["near_duplicates"]) == {d for d, c in brute_components(prints).items() if d == c}
    plain = lambda t: re.sub(r"\W+", "", t.lower())
    items = [plain(r["text"]) for r in spark.read.parquet(f"{path}/benchmark.parquet").collect()]
    assert set(seen["decontamination"]) == {d for d, t in seen["near_duplicates"].items() if not any(x in plain(t) for x in items)}
    assert set(seen["personal_data"]) == set(seen["decontamination"])
    pieces = corpus_pipeline.run(spark, path).collect()
    by = defaultdict(int)
    for r in pieces:
        by[r["doc_id"]] += r["length"]
    assert {r["doc_id"]: r["doc_tokens"] for r in pieces} == dict(by) and set(by) == set(seen["personal_data"])
    used = defaultdict(int)
    for r in pieces:
        used[r["sequence_id"]] += r["length"]
    assert max(used.values()) <= 2048 and np.mean(list(used.values())) > 2000


def test_edges(spark, tmp_path):
    rows = [(1, None, "en"), (2, "", None), (3, "the cat sat on the mat and slept", "en"), (3, "the cat sat on the mat and slept", "en"), (None, "the dog ran", "en"), (4, "mail x.y@z.org the cat", "en")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert got == {3, 4, None}
    empty = tmp_path / "none"
    spark.createDataFrame([], "doc_id long, text string, lang string").write.parquet(f"{empty}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{empty}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(empty)).count() == 0
