"""The stages one by one, each against what it must do to its own input."""

import hashlib
import os

import corpus_pipeline as pipeline
import edge
from conftest import SF
from test_native import kept_lines
from test_near import brute_components

from riskweft.scratch import shared_dir


def test_stages(spark, tmp_path):
    docs = raw = spark.read.parquet(f"{SF}/documents.parquet")
    outs = []
    for k, (_, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        outs.append(docs)
    assert all(o.columns == raw.columns for o in outs[:-1])
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in outs[0].collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.98 * len(good) and not any(i in kept for i, q in labels.items() if q == 0)
    rows = sorted((r["doc_id"], r["text"]) for r in outs[0].collect())
    want = [(i, "\n".join(k)) for i, k in kept_lines(rows)]
    assert sorted((r["doc_id"], r["text"]) for r in outs[1].collect()) == want
    comps = brute_components(want, 5, 80)
    assert sorted(r["doc_id"] for r in outs[2].collect()) == sorted(i for i, (_, c) in comps.items() if c == i)
    assert {r["doc_id"] for r in outs[3].collect()} <= {r["doc_id"] for r in outs[2].collect()}
    texts = {r["doc_id"]: r["text"] for r in outs[3].collect()}
    got = outs[4].collect()
    assert len(got) == outs[3].count() and all(r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest() for r in got)


def test_stages_on_odd_documents(spark, tmp_path):
    """Nulls, empty and very long texts, ties, repeated rows and other columns; and a table without rows."""
    for k, docs in enumerate((edge.docs(spark), edge.none(spark))):
        given = docs
        for j, (_, stage) in enumerate(pipeline.STAGES):
            # odd documents are hardly of quality, so the later stages get them all
            out = stage(spark, given if j == 0 else docs, SF)
            out.write.parquet(str(tmp_path / f"{k}-{j}"))
            back = spark.read.parquet(str(tmp_path / f"{k}-{j}"))
            if j < len(pipeline.STAGES) - 1:
                assert back.columns == docs.columns
            if k:
                assert back.count() == 0
            elif j in (1, 4):
                assert back.count() == docs.count()


def test_run_leaves_its_last_table_only(spark):
    """Folders of the stages are removed as soon as nothing reads them."""
    root = shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(root))
    pipeline.run(spark, SF)
    made = set(os.listdir(root)) - before
    assert len(made) == 1 and len(os.listdir(f"{root}/{made.pop()}")) == 1


def test_run_gives_the_last_stage(spark):
    out = pipeline.run(spark, SF)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 0
