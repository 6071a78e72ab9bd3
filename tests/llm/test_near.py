"""Near-duplicates, neighbours, shards and URL lists against brute force."""

import datetime as dt
import random
import zlib
from collections import Counter, defaultdict

import edge
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from riskweft.llm import components, minhash, neighbours, q_neighbours, sharding, urls
from riskweft.llm.common import Scratch


def brute_components(rows, k, percent):
    """rows of (id, text) with distinct ids; component id by full comparison."""

    def shingles(t):
        ws = (t or "").encode().lower().split()
        return {tuple(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()

    sets = {i: shingles(t) for i, t in rows}
    comp = {i: i for i in sets}
    ids = sorted(sets)
    find = lambda x: x if comp[x] == x else find(comp[x])
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            inter = len(sets[a] & sets[b])
            if inter and 100 * inter >= percent * (len(sets[a]) + len(sets[b]) - inter):
                x, y = find(a), find(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_near_copies(spark, k, percent):
    """Groups whose members are around the threshold, so that links and their absence both decide."""
    r = random.Random(k)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(6):
        base = [r.choice(vocabulary) for _ in range(r.choice([12, 60, 150]))]
        for _ in range(30):
            t = list(base)
            for _ in range(r.randint(0, max(1, len(base) // 20))):
                t[r.randrange(len(t))] = r.choice(vocabulary)
            rows.append((len(rows), " ".join(t).upper() if r.random() < 0.2 else " ".join(t)))
    rows += [(len(rows) + i, " ".join(r.choice(vocabulary) for _ in range(80))) for i in range(60)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent).collect()
    want = brute_components(rows, k, percent)
    assert {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in got} == want
    assert all(x["kept"] == (x["doc_id"] == x["component_id"]) for x in got)
    assert 1 < len({c for _, c in want.values()}) < len(rows)


def template_documents(n, seed=1):
    """Texts of 100 words, 8 of which are one of 10 values each."""
    r = np.random.default_rng(seed)
    base = [f"w{i}" for i in range(100)]
    out = []
    for i in range(n):
        words = list(base)
        for slot, value in enumerate(r.integers(0, 10, 8)):
            words[6 + 12 * slot] = f"s{slot}v{value}"
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("exact", [False, True])
def test_templates_make_few_candidates(spark, monkeypatch, exact):
    """Documents of one template, few of which are links: the links are those of brute force, from candidates far fewer than pairs."""
    tried, plain = [], minhash._linked

    def counting(pairs, sets, percent, cand=None, t=0):
        if cand is None:
            tried.append(pairs.count())
        return plain(pairs, sets, percent, cand, t)

    monkeypatch.setattr(minhash, "_linked", counting)
    rows = template_documents(1200)
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85, exact=exact).collect()}
    slots = np.array([[int(w.split("v")[1]) for w in t.split() if w.startswith("s")] for _, t in rows])
    near = (slots[:, None, :] == slots[None, :, :]).sum(2) >= 6  # 92 of 104 shingles are common if two slots differ, 89 of 107 if three do
    label = np.arange(len(rows))
    while True:
        low = np.where(near, label[None, :], len(rows)).min(1)
        if (low == label).all():
            break
        label = low
    assert [got[i] for i in range(len(rows))] == label.tolist() and len(set(label.tolist())) < len(rows)
    assert tried[-1] < 12 * len(rows)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 40), st.integers(1, 6)), min_size=1, max_size=9), st.data())
def test_linked_sets_share_a_key(tokens, data):
    """Whatever the weights: two sets over the threshold meet in a list of the lower of their tops, with room there."""
    names, often = np.arange(1, len(tokens) + 1, dtype=np.uint64), np.array([o for o, _ in tokens])
    weights = np.array([w for _, w in tokens])
    pick = [data.draw(st.lists(st.booleans(), min_size=len(tokens), max_size=len(tokens))) for _ in "ab"]
    own = [data.draw(st.integers(0, 3)) for _ in "ab"]
    sides = []
    for chosen, alone in zip(pick, own, strict=True):
        at = np.array([i for i, c in enumerate(chosen) if c], int)
        at = at[np.lexsort((names[at], often[at]))]
        n = int(weights[at].sum()) + alone
        sides.append((n, *minhash.rare_keys(names[at], often[at], weights[at], n, 80)) if len(at) else (n, 0, []))
    common = sum(int(w) for w, a, b in zip(weights, *pick, strict=True) if a and b)
    (n, top, levels), (m, top2, levels2) = sides
    if common and 100 * common >= 80 * (n + m - common):
        level = min(top, top2)
        (_, *one), (_, *two) = levels[level - 1], levels2[level - 1]
        room = lambda w, v, r, q: 180 * (min(w, v) + min(r, q)) >= 80 * (n + m)
        assert any(a == b and room(w, v, r, q) and (s or n > m) and (z or m > n) for a, w, r, s in zip(*one, strict=True) for b, v, q, z in zip(*two, strict=True))


def test_large_groups_make_no_pairs(spark):
    """Copies and near copies of one text: what is compared stays near the number of documents."""
    base = [f"t{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(300)]
    rows += [(1000 + i, " ".join([*base[:i], f"x{i}", *base[i + 1 :]])) for i in range(119)]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert {r["component_id"] for r in got.collect()} == {0}


def test_an_id_with_several_texts(spark):
    """It is one document: its groups are one."""
    a, b = ("alpha beta gamma delta epsilon zeta " * 3), ("one two three four five six seven " * 3)
    rows = [(5, a), (5, b), (6, a), (7, b), (8, "something else that stands for itself alone")]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(5, 5, True), (5, 5, True), (6, 5, False), (7, 5, False), (8, 8, True)]


def test_near_edges(spark):
    docs = edge.docs(spark)
    got = minhash.near_duplicates(docs).collect()
    assert len(got) == len(edge.rows())
    by = {r["doc_id"]: r for r in got if r["doc_id"] is not None}
    unique = {r[0]: r[1] for r in edge.rows() if r[0] is not None}
    assert {i: (r["n_shingles"], r["component_id"]) for i, r in by.items()} == brute_components(sorted(unique.items()), 5, 80)
    assert all(r["kept"] and r["component_id"] is None for r in got if r["doc_id"] is None)
    out = minhash.dedup_documents(docs)
    assert out.columns == docs.columns and out.count() == sum(r["kept"] for r in got)
    assert minhash.near_duplicates(edge.none(spark)).count() == 0 and minhash.dedup_documents(edge.none(spark)).count() == 0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 201)]
    got = {r["node"]: r["comp"] for r in components.components(spark.createDataFrame(chain, "a long, b long"), Scratch(spark, "test")).collect()}
    assert got == {**dict.fromkeys(range(41), 0), **dict.fromkeys((100, 101, 102), 100), 200: 200, 201: 200}


def vectors(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, id long, v string")


def test_neighbours_against_brute_force(spark):
    r = np.random.default_rng(3)
    m = r.normal(size=(1500, 16)).astype(np.float32)
    m[300:700] = m[300]  # many equal vectors, ids of which tie
    rows = [(i, list(map(float, x)), 0, 0, "x") for i, x in enumerate(m)]
    rows += [(5000, None, 0, 0, ""), (5100, [0.0] * 16, 0, 0, ""), (5200, [float("nan")] * 16, 0, 0, ""), (5300, [1.0], 0, 0, ""), (None, rows[0][1], 0, 0, ""), (5400, [None] * 16, 0, 0, "")]
    got = defaultdict(list)
    for x in neighbours.nearest(vectors(spark, rows), 100, 10).orderBy("query_id", "rank").collect():
        got[x["query_id"]].append((x["rank"], x["vec_id"], x["score"]))
    assert sorted(got) == list(range(0, 1500, 100))
    hits, x = 0, m.astype(np.float64)
    for q, found in got.items():
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        best = np.lexsort((np.arange(1500), d))[:10]
        hits += len({v for _, v, _ in found} & set(best.tolist()))
        assert [a for a, _, _ in found] == list(range(1, 11)) and [(s, v) for _, v, s in found] == sorted((s, v) for _, v, s in found)
        assert np.allclose([s for _, _, s in found], d[[v for _, v, _ in found]])
    assert hits >= 0.9 * 150
    assert [v for _, v, _ in got[400]][:9] == list(range(300, 309))


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01", "sf0.1"])
def test_recall_on_the_given_tables(spark, sf):
    """The registered query, against exact search."""
    folder = f"/root/testdata/{sf}"
    table = spark.read.parquet(f"{folder}/embeddings.parquet").toPandas()
    ids, x = table["vec_id"].to_numpy(), np.array(table["embedding"].tolist(), np.float64)
    got = defaultdict(set)
    for r in q_neighbours.query(spark, folder).collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = 0
    for q in ids[ids % 100 == 0]:
        d = ((x - x[ids == q][0]) ** 2).sum(1)
        d[ids == q] = np.inf
        hits += len(got[q] & set(ids[np.lexsort((ids, d))[:10]].tolist()))
    assert len(got) == (ids % 100 == 0).sum() and hits >= 0.9 * 10 * len(got)


def test_the_share_follows_structure():
    """Grouped vectors need a small share for the same recall, vectors without structure a large one; few queries all leaves."""
    r = np.random.default_rng(4)
    loose = r.normal(size=(4000, 32))
    grouped = 20 * r.normal(size=(80, 32)).repeat(50, axis=0) + loose
    shares = []
    for points in (loose, grouped):
        forest = neighbours.Forest([neighbours.Tree.grow(points, neighbours.LEAF_SAMPLE, r) for _ in range(8)])
        shares.append(neighbours.share_for(forest, points, 10, 0.9, 100_000, r))
        assert neighbours.share_for(forest, points, 10, 0.9, 10, r) == 1.0
    assert shares[1] < 0.05 < 0.15 < shares[0] < 0.6


def test_few_vectors(spark):
    got = neighbours.nearest(vectors(spark, [(0, [1.0, 0.0], 0, 0, ""), (7, [0.0, 1.0], 0, 0, ""), (9, [1.0, 0.0], 0, 0, "")])).collect()
    assert [tuple(x) for x in sorted(got)] == [(0, 1, 9, 0.0), (0, 2, 7, pytest.approx(2**0.5))]
    assert neighbours.nearest(vectors(spark, [])).count() == 0
    assert neighbours.nearest(vectors(spark, [(0, [0.0], 0, 0, "")])).count() == 0


@pytest.mark.parametrize("odd", [[], [1.0], [1.0, 2.0, 3.0], [None, 1.0], [0.0, 0.0], [float("inf"), 1.0], None])
def test_an_odd_vector_takes_no_part(spark, odd):
    """Wherever it stands: what is left is as if it weren't there."""
    good = [(100, [1.0, 0.0], 0, 0, ""), (7, [0.0, 1.0], 0, 0, ""), (9, [3.0, 0.0], 0, 0, "")]
    for at in (0, 200):
        got = neighbours.nearest(vectors(spark, [(at, odd, 0, 0, ""), *good])).collect()
        assert sorted(map(tuple, got)) == [(100, 1, 7, pytest.approx(2**0.5)), (100, 2, 9, 2.0)]


def test_ids_that_repeat(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (0, [5.0, 0.0]), (7, [1.0, 1.0]), (7, [1.0, 1.0]), (7, [1.0, 3.0]), (8, [9.0, 0.0])]
    got = neighbours.nearest(vectors(spark, [(i, v, 0, 0, "") for i, v in rows])).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 7, 1.0), (0, 2, 7, 3.0), (0, 3, 8, 8.0)]


@pytest.mark.parametrize("share", [1.0, 0.999])
def test_blocks_and_chunks(spark, monkeypatch, share):
    """Small blocks, so cells, blocks of a leaf and chunks of queries all split; each candidate is met once."""
    monkeypatch.setattr(neighbours, "BLOCK_QUERIES", 10)
    m = np.random.default_rng(5).normal(size=(600, 4))
    rows = [(i, list(map(float, x)), 0, 0, "") for i, x in enumerate(m)]
    got = neighbours.nearest(vectors(spark, rows), 20, 5, 3, share=share, block_rows=20).collect()
    x = np.array([r[1] for r in rows], np.float32).astype(np.float64)
    want = []
    for q in range(0, 600, 20):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        want += [(q, n + 1, int(v), pytest.approx(d[v])) for n, v in enumerate(np.lexsort((np.arange(600), d))[:5])]
    assert sorted(map(tuple, got)) == want


def test_search_opens_leaves_by_margin():
    r = np.random.default_rng(0)
    rows = r.normal(size=(400, 5))
    trees = [neighbours.Tree.grow(rows, 20, r) for _ in range(3)]
    forest = neighbours.Forest(trees)
    assert all(sorted(np.concatenate(t.members)) == list(range(400)) for t in trees)
    leaves, passed = forest.leaves(rows), forest.passed(rows[:7])
    assert all(i in forest.members[x] for i in range(400) for x in leaves[i])
    for i in range(7):
        assert (passed[i][leaves[i]] == 0).all()  # its own leaves are passed without a margin
        for share in (0.01, 0.3, 0.9):
            opened = passed[i] <= forest.search(rows[i], share)
            seen = set().union(*(forest.members[x] for x in np.flatnonzero(opened)))
            assert share * 400 <= len(seen) <= share * 400 + 60
        assert forest.search(rows[i], 1.0) == float("inf")
    cells = trees[0].cells(100)
    held = Counter(int(c) for c, m in zip(cells, trees[0].members, strict=True) for _ in m)
    assert set(held) == set(range(len(held))) and max(held.values()) <= 100 and len(held) < len(cells)


def test_shards(spark):
    r = random.Random(2)
    texts = [f"text {i} " * r.randint(1, 40) for i in range(600)] + ["one text that many share"] * 500 + [f"group {i % 20}" for i in range(200)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sharding.shard_documents(df, 8).collect()
    load, slots, group = Counter(), defaultdict(list), defaultdict(set)
    for x in got:
        t = texts[x["doc_id"]]
        assert x["size"] == len(t.encode()) + 1 and x["text_crc32"] == zlib.crc32(t.encode()) and x["law"] == "bytes" and x["grown_shard"] is None
        load[x["shard"]] += x["size"]
        slots[x["shard"]].append(x["slot"])
        group[t].add(x["shard"])
    assert set(load) == set(range(8)) and max(load.values()) - min(load.values()) <= 2 * max(len(t) for t in texts)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert sum(len(group[f"group {i}"]) for i in range(20)) <= 24 and len(group["one text that many share"]) <= 4
    assert sorted(map(str, sharding.shard_documents(df.repartition(5), 8).collect())) == sorted(map(str, got))


def test_shards_with_a_hot_text(spark):
    texts = ["x" * 99] * 3000 + [f"{i:099d}" for i in range(3000)] + [f"group {i % 1000:093d}" for i in range(3000)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    load, shards = Counter(), defaultdict(set)
    for x in sharding.shard_documents(df, 16).collect():
        load[x["shard"]] += x["size"]
        shards[texts[x["doc_id"]]].add(x["shard"])
    assert len(shards.pop(texts[0])) <= 6 and max(map(len, shards.values())) == 1  # a third of 16 shards are 5.3
    assert len(load) == 16 and max(load.values()) - min(load.values()) <= 400


def test_shard_edges(spark):
    got = sharding.shard_documents(edge.docs(spark), 4).collect()
    assert Counter(x["doc_id"] for x in got) == Counter(r[0] for r in edge.rows())
    assert {x["size"] for x in got if x["doc_id"] in (0, 1)} == {1}
    assert sharding.shard_documents(edge.none(spark)).count() == 0
    huge = spark.createDataFrame([(i, "same") for i in range(64)], "doc_id long, text string")
    assert set(Counter(x["shard"] for x in sharding.shard_documents(huge, 4).collect()).values()) == {16}


def test_url_lists(spark):
    d = lambda x: dt.date(2024, 1, x)
    entries = spark.createDataFrame(
        [
            ("a", "host", "bad.org", "add", d(5)), ("a", "host", "bad.org", "add", d(7)), ("a", "host", "bad.org", "remove", d(10)), ("a", "host", "bad.org", "add", d(20)),
            ("b", "prefix", "site.com/x/", "add", d(1)), ("c", "host", None, "add", d(1)), ("c", "host", "other.net", "remove", d(1)), ("d", "host", "tie.net", "remove", d(3)), ("d", "host", "tie.net", "add", d(3)),
        ],
        "list string, kind string, value string, action string, at date",
    )
    assert sorted(tuple(r)[2:] for r in urls.intervals(entries).where("list = 'a'").collect()) == [("bad.org", d(5), d(10)), ("bad.org", d(20), None)]
    cases = [
        ("http://bad.org/", 4, 0), ("http://bad.org/", 5, 1), ("https://Sub.BAD.org:80/q?x", 9, 1), ("http://bad.org", 10, 0), ("http://u:p@bad.org/", 25, 1), ("http://notbad.org/", 6, 0),
        ("http://site.com/x/y", 2, 1), ("http://site.com/x", 2, 0), ("http://site.com/", 2, 0), ("http://sub.site.com/x/", 2, 0), ("nonsense", 6, 0), (None, 6, 0), ("", 6, 0), ("http://tie.net", 3, 1), ("http://other.net", 9, 0),
    ]
    captures = spark.createDataFrame([(i, u, d(x), "z", 1) for i, (u, x, _) in enumerate(cases)] + [(99, "http://bad.org/", None, "z", 1)], "page_id long, url string, fetched_at date, list string, value int")
    got = {r["page_id"]: r["n_matches"] for r in urls.report(captures, entries, "page_id").collect()}
    assert got == {**{i: n for i, (_, _, n) in enumerate(cases)}, 99: 0}
    kept = urls.filter_captures(captures, entries, "page_id")
    assert kept.columns == captures.columns and {r["page_id"] for r in kept.collect()} == {i for i, n in got.items() if not n}
    assert urls.report(captures.limit(0), entries, "page_id").count() == 0
    assert urls.report(captures, entries.limit(0), "page_id").agg(F.sum("n_matches")).first()[0] == 0


def test_url_prefixes_end_anywhere(spark):
    d = dt.date(2024, 1, 1)
    values = ["site.com/de", "site.com/en/78", "site.com/en/7817", "other.o", "third.org"]
    entries = spark.createDataFrame([("a", "prefix", v, "add", d) for v in values], "list string, kind string, value string, action string, at date")
    pages = ["site.com/de/x", "site.com/deep", "site.com/d", "site.com/en/78", "SITE.com/EN/7817?q", "sub.site.com/de", "other.org/x", "third.org", "third.org/y", "third.com/", "site.com./de", "third.org:80/z"]
    captures = spark.createDataFrame([(i, f"http://{u}", d) for i, u in enumerate(pages)], "page_id long, url string, fetched_at date")
    got = {r["page_id"]: r["n_matches"] for r in urls.report(captures, entries, "page_id").collect()}
    assert got == {i: sum(u.lower().split("?")[0].replace("com./", "com/").replace(":80", "").startswith(v) for v in values) for i, u in enumerate(pages)}


@pytest.mark.parametrize(("limit", "most"), [(0, 1 << 29), (0, 64), (1 << 20, 1 << 29)])
def test_captures_against_brute_force(spark, monkeypatch, limit, most):
    """Pages captured many times, under ids that repeat or are null, against lists that come and go; every row is judged by itself."""
    for name, value in (("BROADCAST_BYTES", limit), ("LEAST_BITS", 8), ("MOST_BITS", most)):
        monkeypatch.setattr(urls, name, value)
    r, day = random.Random(8), lambda x: dt.date(2024, 1, x)
    hosts = ["a.org", "b.a.org", "x.net", "y.x.net.", "com", "z.com"]
    entries = []
    for _ in range(60):
        kind = r.choice(["host", "prefix"])
        value = r.choice(hosts) if kind == "host" else r.choice(["a.org/p", "x.net/", "z.co", "b.a.org/p/q", "y.x.net/pq"])
        entries.append((r.choice("kl"), kind, value, r.choice(["add", "remove"]), day(r.randint(1, 28))))
    captures = [(r.choice([1, 2, 3, None]), f"http://{r.choice(hosts)}{r.choice(['', '/', '/p', '/p/q', '/pq', '/x'])}", r.choice([None, *map(day, range(1, 29))])) for _ in range(400)]
    spans = []
    for name, kind, value in {e[:3] for e in entries}:
        state = {}
        for e in entries:
            if e[:3] == (name, kind, value):
                state[e[4]] = state.get(e[4], False) or e[3] == "add"
        on = None
        for at in sorted(state):
            if state[at] and on is None:
                on = at
            elif not state[at] and on is not None:
                spans.append((name, kind, value.rstrip("."), on, at))
                on = None
        if on is not None:
            spans.append((name, kind, value.rstrip("."), on, None))
    spans = set(spans)  # of "y.x.net." there is one form only

    def found(url, at):
        rest = url.removeprefix("http://")
        h, _, p = rest.partition("/")
        h = h.rstrip(".")
        page = h + ("/" + p if "/" in rest else "")
        return [s for s in spans if at and s[3] <= at and (s[4] is None or at < s[4]) and (h == s[2] or h.endswith("." + s[2]) if s[1] == "host" else page.startswith(s[2]))]

    df = spark.createDataFrame([(*c, i % 2) for i, c in enumerate(captures)], "page_id long, url string, fetched_at date, list int").repartition(5)
    lists = spark.createDataFrame(entries, "list string, kind string, value string, action string, at date")
    want = Counter((i, len(f := found(u, at)), ",".join(sorted({s[0] for s in f}))) for i, u, at in captures)
    assert Counter(tuple(x) for x in urls.report(df, lists, "page_id").select("page_id", "n_matches", "lists").collect()) == want
    assert 0 < sum(n for (_, m, _), n in want.items() if m) < 400
    kept = Counter(tuple(x) for x in urls.filter_captures(df, lists, "page_id").select("page_id", "url", "fetched_at").collect())
    assert kept == Counter(c for c in captures if not found(*c[1:]))


def test_plain_propagation(spark):
    """With room for all, a group ends as a whole where most of it began; with little room no shard is overfilled, and links are cut only then."""
    r = random.Random(4)
    rows = [(g, g, s, r.randint(1, 9)) for g in range(200) for s in r.sample(range(6), r.randint(1, 4))]
    chunks = spark.createDataFrame(rows, "g1 long, g2 long, born int, bytes long")
    home = lambda g: max((b, -s) for x, _, s, b in rows if x == g)
    free = {(x["g1"], x["shard"]) for x in sharding._propagate(chunks, Scratch(spark, "test"), 6, 1e9).collect()}
    assert free == {(g, -home(g)[1]) for g in range(200)}
    room, tight = sum(x[3] for x in rows) / 6 * 1.02, sharding._propagate(chunks, Scratch(spark, "test"), 6, sum(x[3] for x in rows) / 6 * 1.02).collect()
    load, at = Counter(), defaultdict(set)
    began = Counter()
    for x in rows:
        began[x[2]] += x[3]
    for x in tight:
        load[x["shard"]] += x["bytes"]
        at[x["g1"]].add(x["shard"])
    assert sum(load.values()) == sum(x[3] for x in rows) and all(load[s] <= max(room, began[s]) for s in load)
    assert sum(map(len, at.values())) < len(rows)


def test_links_that_shards_cut(spark):
    texts = [f"group {i % 50} " * 5 for i in range(400)] + [f"own {i} " * 5 for i in range(2000)]
    got = sharding.cut_links(sharding.shard_documents(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), 8)).first()
    assert (got["links"], got["cut"]) == (350, 0)
