"""The two classifiers on held-out rows of the test tables, and on odd documents."""

import re

import edge
import numpy as np
from conftest import SF
from pyspark.sql import functions as F

from riskweft.llm import hashed, ordinal, toxicity

BIG = SF.replace("0.001", "0.01")


def test_quality_on_held_out(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    held = F.col("doc_id") % 4 == 0
    model = ordinal.fit(docs, labels.where(~held))
    got = ordinal.score(docs, model).join(labels.where(held), "doc_id").select("quality", "tail_prob", "expected_grade").collect()
    right = sum((r["tail_prob"] >= 0.5) == (r["quality"] == 1) for r in got)
    assert right >= 0.95 * len(got) and all(0 <= r["expected_grade"] <= 1 for r in got)


def test_three_grades(spark):
    texts = {0: "bad worse " * 5, 1: "fair medium " * 5, 2: "good better " * 5}
    rows = [(i, texts[i % 3] + f" word{i % 17}") for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 3) for i in range(60)] + [(5000, 1), (None, 1), (61, None)], "doc_id long, quality int")
    model = ordinal.fit(docs, labels)
    assert model.grades == [0, 1, 2] and model.thresholds[0] < model.thresholds[1]
    got = {r["doc_id"]: r for r in ordinal.score(docs, model, grade=2).collect()}
    assert [round(got[i]["expected_grade"]) for i in (60, 61, 62)] == [0, 1, 2] and got[62]["tail_prob"] > 0.5 > got[61]["tail_prob"]
    tails = model.tails(np.array([-1.0, 0.0, 1.0]))
    assert (np.diff(tails, axis=1) <= 0).all()


def test_quality_edges(spark):
    docs = edge.docs(spark)
    empty = ordinal.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    assert ordinal.select_documents(docs, empty).count() == docs.count()
    labels = spark.createDataFrame([(i, int(i < 20)) for i in range(30)], "doc_id long, quality int")
    model = ordinal.fit(docs, labels)
    scored = ordinal.score(docs, model)
    assert scored.count() == docs.count() and scored.where("tail_prob IS NULL OR isnan(tail_prob)").count() == 0
    kept = ordinal.select_documents(docs, model)
    assert kept.columns == docs.columns and kept.count() == scored.where("tail_prob >= 0.5").count()
    assert ordinal.score(edge.none(spark), model).count() == 0
    twice = scored.where("doc_id = 6").select("tail_prob").distinct()
    assert twice.count() == 1


def test_scores_are_the_plain_sum(spark):
    """Every whole text, odd ones too: the score is that of its features, taken one by one."""
    docs = edge.docs(spark)
    model = ordinal.fit(docs, spark.createDataFrame([(i, i % 3) for i in range(30)], "doc_id long, quality int"))
    got = sorted(map(tuple, ordinal.score(docs, model, grade=2).collect()), key=str)
    want = []
    for i, text, *_ in edge.rows():
        (slots, values), z = ordinal.extract(text or "")[0], 0.0
        for s, v in zip(slots, values, strict=True):
            z += model.weights[s] * v
        p = [1 / (1 + np.exp(t - z)) for t in model.thresholds]
        want.append((i, sum(p), p[1]))
    assert len(p) == 2 and [g[0] for g in got] == [w[0] for w in sorted(want, key=str)]
    assert np.allclose([g[1:] for g in got], [w[1:] for w in sorted(want, key=str)], atol=1e-9)


def test_fit_is_the_most_likely(spark):
    """No parameters near the fitted ones make the graded sample likelier, under the same penalty."""
    r = np.random.default_rng(2)
    words = [f"w{i}" for i in range(6)]
    rows = [(i, " ".join(r.choice(words, 8, p=np.roll([0.4, 0.2, 0.1, 0.1, 0.1, 0.1], i % 3)))) for i in range(120)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    grades = {i: int(np.clip(i % 3 + r.integers(-1, 2), 0, 2)) for i, _ in rows}
    model = ordinal.fit(docs, spark.createDataFrame(list(grades.items()), "doc_id long, quality int"), rounds=3000, l2=1e-2)
    x = np.zeros((len(rows), ordinal.DIMS))
    for i, text in rows:
        for s, v in zip(*ordinal.extract(text)[0], strict=True):
            x[i, s] += v
    used = np.flatnonzero(x.any(0))
    y = np.array([grades[i] for i, _ in rows])

    def loss(w, t):
        above = 1 / (1 + np.exp(t[None, :] - (x[:, used] @ w)[:, None]))
        p = np.hstack([np.ones((len(y), 1)), above]) - np.hstack([above, np.zeros((len(y), 1))])
        return -np.log(p[np.arange(len(y)), y]).mean() + 0.5e-2 * (w * w).sum()

    w, t = model.weights[used], model.thresholds
    best = loss(w, t)
    assert all(loss(w + 0.02 * r.normal(size=len(w)), t + 0.02 * r.normal(size=2)) > best - 1e-5 for _ in range(200))


def test_features_to_the_driver_are_bounded(spark):
    docs = spark.createDataFrame([(i, f"some words {i} " * (i + 1)) for i in range(50)] + [(7, "another text of the seventh")] * 30, "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)], "doc_id long, quality int")
    sample = hashed.labelled_sample(docs, labels, "quality", 40, "doc_id", "text")
    y, parts, entries, slots, values = hashed.collected(sample, ordinal.extract)
    assert len(y) == 40 and parts.tolist() == list(range(40)) and len(entries) == len(slots) == len(values)
    few, *_, some, _ = hashed.collected(sample, ordinal.extract, max_entries=len(slots) // 2)
    assert 0 < len(few) < 40 and len(some) <= len(slots) // 2


def test_a_long_document_does_not_end_the_sample(spark):
    """The document that comes first in the order of hashes has more entries than fit: it alone is passed over."""
    ids = [r["id"] for r in spark.range(60).orderBy(F.xxhash64("id")).collect()]
    long = " ".join(f"w{i}" for i in range(4000))
    docs = spark.createDataFrame([(i, long if i in (ids[0], ids[20]) else f"some few words {i}") for i in ids], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2) for i in ids], "doc_id long, quality int")
    sample = hashed.labelled_sample(docs, labels, "quality", 60, "doc_id", "text")
    y, parts, entries, slots, _ = hashed.collected(sample, ordinal.extract, max_entries=3000)
    assert y == [i % 2 for i in sorted(set(ids) - {ids[0], ids[20]})] and 0 < len(slots) <= 3000 and len(parts) == 58


def test_toxicity_on_held_out(spark):
    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet"), spark.read.parquet(f"{BIG}/labels.parquet")
    model = toxicity.fit(docs, labels.where(~toxicity.held_out("doc_id")))
    got = toxicity.score(docs, model).join(labels.where(toxicity.held_out("doc_id")), "doc_id").select("toxic", "score").collect()
    pos, neg = [r["score"] for r in got if r["toxic"]], [r["score"] for r in got if not r["toxic"]]
    auc = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    assert auc > 0.9 and all(0 <= r["score"] <= 1 for r in got)


def test_sentences_are_found(spark):
    rows = [(i, f"A calm sentence here. {'You utter moron.' if i % 3 == 0 else 'You fine person.'}\nAnother calm one{i}") for i in range(150)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.fit(docs, spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(120)], "doc_id long, toxic int"))
    got = toxicity.locate(docs, model).collect()
    assert {r["doc_id"] for r in got} == set(range(0, 150, 3))
    assert all("moron" in r["sentence"] and rows[r["doc_id"]][1][r["start"] : r["stop"]] == r["sentence"] for r in got)


def test_noisy_or():
    scorer = toxicity.Scorer(toxicity.ToxicityModel(-2.0, {toxicity.word_slots("bad")[0]: 0.0} | {s: 1.5 for s in toxicity.word_slots("awful")}))
    p = 1 / (1 + np.exp(-scorer.sentences(["fine", "awful awful day"])))
    assert np.isclose(scorer.document("fine. awful awful day"), 1 - (1 - p[0]) * (1 - p[1])) and p[1] > p[0]
    assert scorer.document("") == 0.0


def test_documents_are_the_plain_noisy_or(spark):
    docs = edge.docs(spark)
    weights = {s: 0.1 * (k + 1) for k, w in enumerate(["this", "very", "word", "copy", "🙂", "éclair"]) for s in toxicity.word_slots(w)}
    model = toxicity.ToxicityModel(-3.0, weights)
    want = []
    for i, text, *_ in edge.rows():
        clean = 1.0
        for sentence in re.split(r"[.!?\n]", text or ""):
            if sentence.strip():
                slots = {s for w in sentence.split() for s in toxicity.word_slots(w)}
                clean *= 1 - 1 / (1 + np.exp(3.0 - sum(weights.get(s, 0.0) for s in slots)))
        want.append((i, 1 - clean))
    got = sorted(map(tuple, toxicity.score(docs, model).collect()), key=lambda r: (str(r[0]), r[1]))
    want.sort(key=lambda r: (str(r[0]), r[1]))
    assert [g[0] for g in got] == [w[0] for w in want] and np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-9)


def test_toxicity_edges(spark):
    docs = edge.docs(spark)
    none = toxicity.fit(docs, spark.createDataFrame([(1, 0)], "doc_id long, toxic int"))
    out = toxicity.score(docs, none)
    assert out.count() == docs.count() and out.where("score > 0.01 OR score IS NULL").count() == 0
    assert toxicity.score(edge.none(spark), none).count() == 0 and toxicity.locate(docs, none).count() == 0
