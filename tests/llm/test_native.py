"""Quality rules, line dedup and mixing against brute force on odd documents."""

import hashlib
import re
from collections import Counter, defaultdict

import edge
import pytest
from pyspark.sql import functions as F

from riskweft.llm import common, lines, mixing, quality
from riskweft.llm.common import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


def signals(text):
    ws = WORD.findall(text or "")
    windows = defaultdict(list)
    for i in range(len(ws) - 7):
        windows[tuple(ws[i : i + 8])].append(i)
    covered = {p for at in windows.values() if len(at) > 1 for i in at for p in range(i, i + 8)}
    full = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(ws), sum(map(len, ws)), sum(c in "#*$%&|<>" for c in text or ""), len(full) - len(set(full)), len(covered)


def test_quality_rules(spark):
    out = quality.quality_rules(edge.docs(spark), max_docs=1, min_left=0.6)
    got = sorted(map(tuple, out.collect()), key=str)
    rows = [r[:4] for r in edge.rows()]
    key = lambda line: " ".join(WORD.findall(line)).lower()
    holders = defaultdict(set)
    for i, t, _, s in rows:
        for line in (t or "").split("\n"):
            if WORD.search(line):
                holders[s, key(line)].add((i, t))
    want = []
    for i, t, _, s in rows:
        x = signals(t)
        failed = x[0] < 20 or 100 * x[4] > 30 * x[0]
        left = sum(len(WORD.findall(line)) for line in (t or "").split("\n") if WORD.search(line) and len(holders[s, key(line)]) <= 1)
        want.append((i, *x, failed, not failed and left >= 0.6 * x[0]))
    assert got == sorted(want, key=str)
    assert any(not w[6] and not w[7] for w in want)
    assert quality.quality_rules(edge.none(spark)).count() == 0


def line_key(line):
    return re.sub("[A-Z]", lambda m: m[0].lower(), line.strip(SPACE))


def kept_lines(rows, min_chars=40, min_docs=5):
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(line_key(line)) >= min_chars:
                holders[line_key(line)].add(i)
    last = {k: max(v, key=lambda x: (x is not None, x or 0)) for k, v in holders.items() if len(v) >= min_docs}
    return [(i, [x for x in (t or "").split("\n") if line_key(x) not in last or last[line_key(x)] == i]) for i, t in rows]


def test_line_report(spark):
    rows = [r[:2] for r in edge.rows()]
    got = sorted(map(tuple, lines.line_report(edge.docs(spark)).collect()), key=str)
    want = []
    for (i, t), (_, kept) in zip(rows, kept_lines(rows), strict=True):
        n = len((t or "").split("\n"))
        want.append((i, n, n - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    assert got == sorted(want, key=str) and any(w[2] for w in want)
    assert lines.line_report(edge.none(spark)).count() == 0


def test_dedup_lines_keeps_columns(spark):
    docs = edge.docs(spark)
    out = lines.dedup_lines(docs)
    assert out.columns == docs.columns
    rows = [r[:2] for r in edge.rows()]
    want = sorted(((i, None if t is None else "\n".join(k)) for (i, t), (_, k) in zip(rows, kept_lines(rows), strict=True)), key=str)
    assert sorted(map(tuple, out.select("doc_id", "text").collect()), key=str) == want


def test_keys_fold_only_ascii(spark):
    pairs = [("ÉCLAIR abc", "éclair ABC"), ("Éclair ABC", "Éclair abc"), ("KELVIN K", "kelvin k"), ("abc", "ABC")]
    df = spark.createDataFrame(pairs, "a string, b string").select((lines.line_hashes(F.col("a")) == lines.line_hashes(F.col("b"))).alias("x"))
    assert [r["x"] for r in df.collect()] == [False, True, False, True]


@pytest.mark.parametrize("group", [[], ["g"]])
def test_prefix_sums(spark, monkeypatch, group):
    """In order of bin and key, in groups that may be null, with few bins in a run."""
    monkeypatch.setattr(common, "WIDE", 3)
    rows = [(None if i % 5 == 0 else i % 3, (i * 7) % 40 - 20, i, i % 11) for i in range(500)]
    df = spark.createDataFrame(rows, "g int, b long, i long, v long").repartition(5)
    got = {r["i"]: r["s"] for r in common.prefix_sum(df, group, ["i"], "b", "v", "s").collect()}
    want, sums = {}, Counter()
    for g, _, i, v in sorted(rows, key=lambda r: (r[1], r[2])):
        key = g if group else 0
        want[i], sums[key] = sums[key], sums[key] + v
    assert got == want


def batch(spark, b):
    return spark.range(20).select((F.col("id") % (4 + b)).alias("h1"), F.lit(0).cast("long").alias("h2"), (F.col("id") + 100 * b).alias("__doc"))


def test_runs(spark):
    """Runs stay few, a line has one entry, recurrences are added to it; without telling fresh lines from known ones counts would be wrong."""
    runs = lines.LineRuns(spark, Scratch(spark, "test"))
    for b in range(6):
        name = runs.add(batch(spark, b))
        fresh = {r["h1"] for r in spark.table(name).where("fresh").collect()}
        assert fresh == (set(range(4)) if b == 0 else {3 + b}) and spark.table(name).count() == 4 + b
        runs.compact()
    assert len(runs.names()) <= 3
    entries = [r["h1"] for name in runs.names() for r in spark.table(name).where("fresh").collect()]
    assert sorted(entries) == list(range(9))
    got = {r["h1"]: (r["n_docs"], r["last_doc"]) for r in runs.counted().collect()}
    want = Counter(i % (4 + b) for b in range(6) for i in range(20))
    assert got == {h: (n, max(i + 100 * b for b in range(6) for i in range(20) if i % (4 + b) == h)) for h, n in want.items()}
    names = runs.names()
    runs.close()
    assert not any(spark.catalog.tableExists(n) for n in names)


def test_runs_are_not_dealt_or_sorted_again(spark):
    runs = lines.LineRuns(spark, Scratch(spark, "test"))
    a, b = runs.add(batch(spark, 0)), runs.add(batch(spark, 1))
    with lines._sorted_scans(spark):
        plan = runs._merged(spark.table(a).where("fresh"), spark.table(b).where("fresh"))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan and "Sort [" not in plan
    runs.close()


def water(sizes, weights):
    total, target, open_ = sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while open_:
        w = sum(weights[i] for i in open_)
        over = [i for i in open_ if left * weights[i] / w > 3 * sizes[i]]
        if not over:
            for i in open_:
                target[i] = left * weights[i] / w
            break
        for i in over:
            target[i] = 3.0 * sizes[i]
        left -= sum(target[i] for i in over)
        open_ -= set(over)
    return target


def test_mixing(spark):
    docs = edge.docs(spark)
    got = mixing.mix_report(docs).collect()
    rows = edge.rows()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    sizes = Counter()
    for r in rows:
        sizes[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s))
    want = dict(zip(names, water([sizes[n] for n in names], [i % 3 + 1 for i in range(len(names))]), strict=True))
    source, taken, largest = {r[0]: r[3] for r in rows}, Counter(), Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["source_size"] == sizes[s] and r["target"] == pytest.approx(want[s]) and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
        largest[s] = max(largest[s], r["size"])
    assert all(abs(taken[s] - want[s]) <= largest[s] for s in names)
    assert sorted(map(str, mixing.mix_report(docs.repartition(7)).collect())) == sorted(map(str, got))
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.select("source", "text").collect():
        words[r["source"]] += len(WORD.findall(r["text"] or ""))
    assert words == taken
    assert mixing.mix_report(edge.none(spark)).count() == 0


def test_heavier_documents_come_first(spark):
    """With weights far apart, the light documents of a source are hardly taken."""
    rows = [(i, "w " * 50 + ("#" * 100 if i % 2 else ""), "a") for i in range(400)] + [(1000 + i, "w " * 50, "b") for i in range(400)] + [(2000 + i, "w " * 50, "c") for i in range(400)]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id long, text string, source string")).where("doc_id < 400").collect()
    share = [sum(r["taken"] for r in got if r["doc_id"] % 2 == k) for k in (0, 1)]
    assert share[0] > share[1] > 0


def test_cleaned_removes_lines_above_the_limit(spark):
    own = lambda i: " ".join(f"w{i}x{k}" for k in range(30))
    rows = [(i, f"Shared  LINE\n{own(i)}\n\nshared line\nend{i}", "a", i) for i in range(5)]
    rows += [(10 + i, f"shared line\n{own(10 + i)}", "b", 0) for i in range(2)] + [(20, "too short", "a", 0), (21, None, "a", 0)]
    rows += [(30 + i, "\n".join(["common " * 3 + own(99)] * 2 + [f"rest{i}"]), "c", 0) for i in range(5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, extra int")
    out = quality.cleaned(df, max_docs=3)
    assert out.columns == df.columns
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert got == {**{i: f"{own(i)}\n\nend{i}" for i in range(5)}, **{10 + i: f"shared line\n{own(10 + i)}" for i in range(2)}}
    assert set(got) == {r["doc_id"] for r in quality.quality_rules(df, max_docs=3).where("kept").collect()}
