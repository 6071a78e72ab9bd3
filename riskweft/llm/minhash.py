"""MinHash near-dedup by a join of inverted signature coordinates.

Documents become sets of word shingles; equal sets become one class. A class has M signature coordinates; it is posted
under its coordinate-value pairs. Two sets at the very threshold agree in fewer than T of M coordinates with a chance of
a few in a million, and more similar ones with less, so:

- counting: a class with fewer than T pairs that others have too has no partner;
- prefix: with pairs ordered rare first, partners share one among all but their last T - 1 pairs, so only those are
  posted, and the frequent pairs of passages that many documents share are skipped;
- merging: in a posting list everyone meets the list's most central class, not everyone; classes that are linked are in
  one component and need not meet again; the members of lists that still hold several components then meet under the
  rare shingles of their full sets, by the same prefix rule, now without slack and without asking for coordinates.

Under rare shingles, those that the same documents hold count as one token with a weight. Partners share a token among
all but the last of what may differ, two tokens if one more is taken in, and so on. Documents without a frequent token
there meet under single ones; the others, as those that fill the slots of one template, under the sets of as many tokens
as POSTS allows, and only where the weight of the set and of what follows it can reach the threshold.

Every candidate pair is decided by exact comparison of the full sets. Nothing is capped: a list of any length is a join
that the engine may split. With `exact`, the documents of all lists meet under rare shingles, also those whose
signatures agree by no chance at all: no pair depends on signatures then.

Edge cases: a text with fewer words than a shingle is one shingle; null texts and texts without words have the empty
set and are linked with nothing; a null id is linked with nothing; rows that share id and text are alike; an id with
several texts is one document, so the groups of its texts are one; the shingles of a very long text are made block by
block; an empty table gives an empty one; other columns pass through dedup_documents and are not read otherwise.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest, xxh3_128_digest

from .common import Scratch, ship
from .components import components
from .hashed import MEMO_WORDS
from .quality import row_key

#: Coordinates of a signature; those counted first.
M, FIRST = 64, 32
#: Standard deviations below the mean agreement at the threshold at which pairs are let go.
SLACK = 4.75
#: A token that more documents have is frequent; tokens of a list's name, at most; names of one document, about.
LIST, LEVELS, POSTS = 16, 4, 128
#: Rows that a task gives at once, about.
ROWS_OUT = 100_000
_MIX = np.uint64(0x9E3779B97F4A7C15)


def min_matches(percent: int) -> int:
    """T for a threshold in percent."""
    p = percent / 100
    return int(M * p - SLACK * (M * p * (1 - p)) ** 0.5)


def _finish(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


class Shingler:
    """Sets of shingle hashes, and signatures of them."""

    def __init__(self, k: int):
        self.k, self.memo = k, {}
        random = np.random.default_rng(2024)
        self.a = random.integers(0, 2**63, M, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = random.integers(0, 2**63, M, np.uint64)
        self.place = _finish(np.arange(1, M + 1, dtype=np.uint64) * _MIX)

    def shingles(self, text: str) -> np.ndarray:
        """Sorted distinct hashes of the runs of k words, A-Z lower-cased; of the whole text if it is shorter."""
        words = text.encode().lower().split()  # of bytes: these fold and split ASCII only
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        for w in set(words).difference(self.memo):
            self.memo[w] = xxh3_64_intdigest(w)
        h = np.fromiter(map(self.memo.__getitem__, words), np.uint64, len(words))
        k = min(self.k, len(h))
        n = len(h) - k + 1
        out = _finish(h[:n] + np.uint64(k))
        for i in range(1, k):
            out = _finish(out * _MIX + h[i : i + n])
        return np.unique(out)

    def signature(self, shingles: np.ndarray) -> np.ndarray:
        """M coordinate-value pairs, each as one number."""
        low = np.full(M, np.iinfo(np.uint64).max, np.uint64)
        for i in range(0, len(shingles), 1024):
            np.minimum(low, (shingles[i : i + 1024, None] * self.a + self.b).min(axis=0), out=low)
        return _finish(low + self.place).view(np.int64)


def _signed(docs: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(__k1, __k2, __id, n, s1, s2, sig) of every document; s1, s2 name the set, and are null for the empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            sizes, names, signatures = [], [], []
            for text in batch.column(3):
                s = shingler.shingles(text.as_py() or "")
                sizes.append(len(s))
                names.append(np.frombuffer(xxh3_128_digest(s.tobytes()), np.int64) if len(s) else None)
                signatures.append(shingler.signature(s) if len(s) else np.zeros(0, np.int64))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in signatures])]), pa.int32())
            name = lambda j: pa.array([None if x is None else int(x[j]) for x in names], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(sizes, pa.int64()), name(0), name(1), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(signatures), pa.int64()))],
                ["__k1", "__k2", "__id", "n", "s1", "s2", "sig"],
            )

    given = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("__id"), F.col(text_col).alias("__text"))
    return given.mapInArrow(run, "__k1 long, __k2 long, __id long, n long, s1 long, s2 long, sig array<long>")


def _sets(docs: DataFrame, wanted: DataFrame, k: int, id_col: str, text_col: str) -> DataFrame:
    """(id, set) of the documents in wanted (id, s1, s2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler(k)
        for batch in batches:
            sets = [shingler.shingles(x.as_py() or "").view(np.int64) for x in batch.column(1)]
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(x) for x in sets])]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(sets), pa.int64()))], ["id", "set"])

    given = docs.select(*row_key(id_col, text_col), F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("__text"))
    some = wanted.select(F.col("__k1").alias("__w1"), F.col("__k2").alias("__w2"))
    given = given.join(some, (F.col("__k1") == F.col("__w1")) & (F.col("__k2") == F.col("__w2")), "left_semi")
    return given.dropDuplicates(["__k1", "__k2"]).select("id", "__text").mapInArrow(run, "id long, set array<long>")


def _candidates(classes: DataFrame, t: int) -> DataFrame:
    """(id, __k1, __k2, n, pairs, posted, central) of the classes that may have a partner.

    pairs: those that others have too, rare first; posted: how many of them are posted; central: how common they are.
    """
    first = classes.select("id", F.explode(F.slice("sig", 1, FIRST)).alias("pair"))
    shared = first.groupBy("pair").count().where("count > 1").select("pair")
    may = first.join(shared, "pair").groupBy("id").count().where(F.col("count") >= FIRST - (M - t)).select("id")
    left = classes.join(may, "id", "left_semi")
    every = left.select("id", F.explode("sig").alias("pair"))
    often = every.groupBy("pair").count().where("count > 1")
    of = every.join(often, "pair").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("count", "pair"))).alias("found"))  # M at most
    of = of.where(F.size("found") >= t)
    return of.join(left.select("id", "__k1", "__k2", "n"), "id").select("id", "__k1", "__k2", "n", F.col("found.pair").alias("pairs"), (F.size("found") - (t - 1)).alias("posted"), F.aggregate("found.count", F.lit(0).cast("long"), lambda a, x: a + x).alias("central"))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, cand: DataFrame | None = None, t: int = 0) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold; given cand, of those that agree in t coordinates."""
    if cand is not None:
        sig = lambda x: cand.select(F.col("id").alias(x), F.col("pairs").alias(f"{x}_pairs"))
        pairs = pairs.join(sig("a"), "a").join(sig("b"), "b").where(F.size(F.array_intersect("a_pairs", "b_pairs")) >= t).select("a", "b")
    whole = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"{x}_set"))
    both = pairs.join(whole("a"), "a").join(whole("b"), "b")
    common = F.size(F.array_intersect("a_set", "b_set")).cast("long")
    return both.withColumn("common", common).where(100 * F.col("common") >= percent * (F.size("a_set") + F.size("b_set") - F.col("common"))).select("a", "b")


def rare_keys(tokens: np.ndarray, often: np.ndarray, weights: np.ndarray, n: int, percent: int) -> tuple[int, list[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]]:
    """(top, [(level, keys, weight, rest, short)]): what a set of n shingles is posted under, given its tokens, rare first.

    A partner shares t of the n shingles, at least. If all tokens behind the first k, with the level - 1 heaviest of the
    first k, weigh less than t, then it shares `level` tokens of the first k, at least; so the set is posted under all
    sets of so many of these, at every level up to its top. Those of the first tokens shared with a partner weigh t
    together with what follows them (rest), so other sets are left out. A partner that is no smaller shares more, so
    with it fewer of the first tokens do: these are short.
    """
    t, more = -(-percent * n // 100), -(-2 * percent * n // (100 + percent))
    upto = np.concatenate([[0], np.cumsum(weights)])
    behind = upto[-1] - upto  # weight of the tokens from each place on
    first, short = [], []
    for level in range(1, LEVELS + 1):
        left = lambda k: behind[k] + np.sort(weights[:k])[k - level + 1 :].sum()  # noqa: B023, E731
        k = next((k for k in range(level, len(tokens) + 1) if left(k) < t), None)
        if k is None:
            break
        first.append(k)
        short.append(next(k for k in range(level, len(tokens) + 1) if left(k) < more))
    top = 1
    if first and often[: first[0]].max() > LIST:
        posts = np.cumsum([comb(k, level) for level, k in enumerate(first, 1)])
        top = max(1, int((posts <= POSTS).sum()))
    out = []
    for level, k in enumerate(first[:top], 1):
        some = np.array(list(combinations(range(k), level)), np.int64).reshape(-1, level)
        weight, rest = weights[some].sum(1), behind[some[:, -1] + 1]
        some, weight, rest = (x[weight + rest >= t] for x in (some, weight, rest))
        shorter = some[:, -1] < short[level - 1]
        key = np.full(len(some), level, np.uint64)
        for place in some.T:
            key = _finish(key * _MIX + tokens[place])
        out.append((level, key.view(np.int64), weight, rest, shorter))
    return top, out


_POSTED = {"key": pa.int64(), "level": pa.int32(), "top": pa.int32(), "weight": pa.int64(), "rest": pa.int64(), "short": pa.bool_()}


def _rare_posts(sets: DataFrame, left: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(key, level, top, id, n, comp, main, weight, rest): the classes of `left` posted under the rare tokens of their full
    sets, in the lists that hold several components and somebody who has no deeper lists. Shingles that one of these classes alone has come before all tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, rows, columns, made = batch.select(["id", "n", "comp", "central"]), [], [[] for _ in _POSTED], 0
            for i, (n, found) in enumerate(zip(batch.column("n").to_pylist(), batch.column("found"), strict=True)):
                often, names = (found.values.field(x).to_numpy(zero_copy_only=False) for x in ("often", "token"))
                names, at, weights = np.unique(names.view(np.uint64), return_index=True, return_counts=True)
                order = np.lexsort((names, often[at]))
                top, levels = rare_keys(names[order], often[at][order], weights[order], n, percent)
                for level, key, weight, rest, short in levels:
                    rows.append(np.full(len(key), i))
                    made += len(key)
                    for column, values in zip(columns, (key, np.full(len(key), level), np.full(len(key), top), weight, rest, short), strict=True):
                        column.append(values)
                if made >= ROWS_OUT or rows and i == batch.num_rows - 1:
                    arrays = [pa.array(np.concatenate(c), kind) for c, kind in zip(columns, _POSTED.values(), strict=True)]
                    yield pa.RecordBatch.from_arrays([*arrays, *own.take(pa.array(np.concatenate(rows))).columns], [*_POSTED, "id", "n", "comp", "central"])
                    rows, columns, made = [], [[] for _ in _POSTED], 0

    some = sets.join(left.select("id"), "id", "left_semi")
    each = some.select("id", F.explode("set").alias("shingle"))
    held = each.groupBy("shingle").agg(F.count("*").alias("often"), F.bit_xor(F.xxhash64("id")).alias("x1"), F.bit_xor(F.xxhash64(F.lit(1), "id")).alias("x2")).where("often > 1")
    held = held.select("shingle", "often", F.xxhash64("often", "x1", "x2").alias("token"))  # one for all shingles of the same documents
    found = each.join(held, "shingle").groupBy("id").agg(F.collect_list(F.struct("often", "token")).alias("found"))  # of one document
    posts = found.join(left, "id").select("id", "n", "comp", "central", "found").mapInArrow(run, "key long, level int, top int, weight long, rest long, short boolean, id long, n long, comp long, central long")
    posts = scratch.keep(posts, "rare-posts")
    lists = posts.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.max(F.struct("central", "comp")).alias("x"), F.max(F.col("level") == F.col("top")).alias("last")).where("low <> high AND last")
    return posts.join(scratch.keep(lists.select("key", F.col("x.comp").alias("main")), "rare-lists"), "key")  # so a long list may be split


def _unmet(posts: DataFrame, percent: int) -> DataFrame:
    """(a, b): members of a list in different components that may be linked; one is outside the list's main component,
    and one has no deeper lists. Where the tokens of the list are the first that two sets share, they can't overlap in
    more than these and what follows in either; the smaller one has them among its short ones."""
    side = lambda x, rows: rows.select("key", *[F.col(c).alias(x if c == "id" else f"{x}_{c}") for c in ("id", "n", "comp", "weight", "rest", "short")])
    outside, last = F.col("comp") != F.col("main"), F.col("level") == F.col("top")
    total = F.col("a_n") + F.col("b_n")
    room = (100 + percent) * (F.least("a_weight", "b_weight") + F.least("a_rest", "b_rest")) >= percent * total
    may = room & (F.col("a_short") | (F.col("a_n") > F.col("b_n"))) & (F.col("b_short") | (F.col("b_n") > F.col("a_n"))) & (100 * F.least("a_n", "b_n") >= percent * F.greatest("a_n", "b_n")) & (F.col("a_comp") != F.col("b_comp"))
    one = side("a", posts.where(last & outside)).join(side("b", posts), "key").where(may)
    two = side("a", posts.where(last & ~outside)).join(side("b", posts.where(outside)), "key").where(may)
    return one.unionAll(two).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _joined(comps: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, comp) with further links: these join components, which are few and are settled among themselves."""
    for end in ("a", "b"):
        of = comps.select(F.col("node").alias("__n"), F.col("comp").alias("__c"))
        links = links.join(of, F.col(end) == F.col("__n"), "left").withColumn(end, F.coalesce("__c", end)).select("a", "b")
    top = scratch.keep(components(links.where("a <> b").distinct(), scratch), "top")
    moved = comps.join(top.toDF("__n", "__c"), F.col("comp") == F.col("__n"), "left").select("node", F.coalesce("__c", "comp").alias("comp"))
    return scratch.keep(moved.unionByName(top.join(comps.select("node"), "node", "left_anti")), "joined")


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", exact: bool = False) -> DataFrame:
    """(__k1, __k2, id_col, n_shingles, component_id, kept) of every row; __k1, __k2 name its contents. exact: signatures
    only find links early; every class is posted under the rare shingles of its full set."""
    ship(docs.sparkSession)
    t = min_matches(percent)
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.keep(_signed(docs, k, id_col, text_col), "rows")
    named = rows.where("s1 IS NOT NULL AND __id IS NOT NULL")
    least = F.min(F.struct("__id", "__k1", "__k2", "n"))
    classes = named.groupBy("s1", "s2").agg(least.alias("x"), F.first("sig").alias("sig")).select("s1", "s2", F.col("x.__id").alias("id"), "x.__k1", "x.__k2", "x.n", "sig")
    classes = scratch.keep(classes, "classes")
    cand = scratch.keep(_candidates(classes, t), "candidates")
    sets = scratch.keep(_sets(docs, classes if exact else cand, k, id_col, text_col), "sets")

    posts = scratch.keep(cand.select(F.explode(F.slice("pairs", F.lit(1), F.col("posted"))).alias("pair"), "id", "n", "central"), "posts")
    near = (F.least("a_n", "b_n") * 100 >= percent * F.greatest("a_n", "b_n")) & (F.col("a") != F.col("b"))
    centres = posts.groupBy("pair").agg(F.max(F.struct("central", (-F.col("id")).alias("minus"), "n")).alias("c"), F.count("*").alias("members")).where("members > 1")
    centres = scratch.keep(centres.select("pair", (-F.col("c.minus")).alias("b"), F.col("c.n").alias("b_n")), "centres")  # so a long list may be split
    stars = posts.select("pair", F.col("id").alias("a"), F.col("n").alias("a_n")).join(centres, "pair").where(near).select("a", "b").distinct()
    links = scratch.keep(_linked(stars, sets, percent, cand, t), "links")
    comps = components(links, scratch)

    own = comps.withColumnRenamed("node", "id")
    if exact:
        central = cand.select("id", "central")
        left = classes.join(own, "id", "left").join(central, "id", "left").select("id", "n", F.coalesce("comp", "id").alias("comp"), F.coalesce("central", F.lit(0)).alias("central"))
    else:
        members = posts.join(own, "id", "left").withColumn("comp", F.coalesce("comp", "id")).select("pair", "id", "n", "comp", "central")
        members = scratch.keep(members, "members")
        mixed = scratch.keep(members.groupBy("pair").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low <> high").select("pair"), "mixed")
        left = members.join(mixed, "pair", "left_semi").select("id", "n", "comp", "central").distinct()
    rest = _unmet(scratch.keep(_rare_posts(sets, scratch.keep(left, "left"), percent, scratch), "rare"), percent)
    more = scratch.keep(_linked(rest, sets, percent), "more")
    if more.limit(1).count():
        comps = _joined(comps, more, scratch)

    of_class = classes.select("s1", "s2", "id").join(comps.withColumnRenamed("node", "id"), "id", "left").select("s1", "s2", F.coalesce("comp", "id").alias("comp"))
    out = rows.drop("sig").join(of_class.withColumnsRenamed({"s1": "c1", "s2": "c2"}), (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")), "left")
    component = F.when(F.col("__id").isNotNull(), F.coalesce("comp", "__id"))
    return out.select("__k1", "__k2", F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("__id") == component, F.lit(True)).alias("kept"))


def dedup_documents(docs: DataFrame, k: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents, all columns, with the smallest id of each group only."""
    gone = near_duplicates(docs, k, percent, id_col, text_col).where(~F.col("kept")).select(F.col("__k1").alias("__g1"), F.col("__k2").alias("__g2"))
    keyed = docs.select("*", *row_key(id_col, text_col))
    return keyed.join(gone, (F.col("__k1") == F.col("__g1")) & (F.col("__k2") == F.col("__g2")), "left_anti").select(*[f"`{c}`" for c in docs.columns])
