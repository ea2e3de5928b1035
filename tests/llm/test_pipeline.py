"""The stages on a small table, each against a brute-force version of what it decides."""

import re

import corpus_pipeline
from tidemark.llm import quality

from . import brute

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    seen = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF)
        if k < 4:
            assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{k}")
        before, docs = docs, spark.read.parquet(f"{tmp_path}/{k}")
        a, b = {r.doc_id: r.text for r in before.collect()} if k < 5 else {}, docs
        rows = {r.doc_id: r.text for r in b.collect()} if k < 4 else None
        if k == 0:
            good = {r.doc_id for r in quality.classify(before, labels).where("predicted = 1").collect()}
            assert set(rows) == good
        elif k == 1:
            assert set(rows) == {i for i, (_, c) in brute.jaccard(list(a.items())).items() if i == c}
        elif k == 2:
            assert rows == {i: x[3].decode("utf-8", "ignore") for i, x in brute.substrings(list(a.items())).items()}
        elif k == 3:
            assert set(rows) == set(a)
            assert not any(re.search(r"AKIA[A-Z0-9]{16,}|[0-9a-f]{24,}", t) for t in rows.values())
        else:
            assert {r.doc_id for r in b.collect()} == set(a)
        seen.append(name)
    assert len(seen) == 5


def test_run_gives_the_last_stage(spark):
    out = corpus_pipeline.run(spark, SF)
    assert {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns) and out.count() > 0


def test_stages_on_odd_rows(spark, docs):
    rows = docs([(1, None), (None, "a b c d e f g"), (2, ""), (2, ""), (3, "token = abcdef123456 and more")], extra=True).withColumnsRenamed({"kept": "row", "node": "findings"})
    for table in (rows, rows.limit(0)):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, table, SF)
            assert out.columns == table.columns
            out.collect()
