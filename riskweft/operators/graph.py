"""The account graph as node and edge frames, and per-transaction graph features.

Sharing pairs are made only where pairs are asked for. Counts of neighbours come from bitmaps: accounts are numbered so
that those of a device stand together, a device's accounts are set bits, and the neighbours of an account are the bits of
all its devices. Accounts with the same devices have the same bits, so these are joined once for each set of devices: a
device that a hundred thousand accounts share is a few bitmaps, however many pairs it has. Sets and bitmaps meet in cells,
where the unions are counted and left. Only devices whose accounts are too scattered for bitmaps to pay still meet in
pairs, beside those that are small.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskweft.functions.scalars import node_id
from riskweft.operators.prepare import with_rank
from riskweft.schema import tables
from riskweft.scratch import kept
from riskweft.session import ship


#: Accounts of a device that one task pairs with as many others, about. A row is shuffled once for each block of its device and
#: once more, so small blocks cost disk; a cell holds some 150 bytes an account.
BLOCK = 20_000
#: Devices of an account that its rows carry; pairs with an account of more are told apart by a shuffle.
WIDE = 256
#: A device has bitmaps if it has more accounts than this, and in the mean as many in each of its bitmaps.
DENSE = 64
#: Bitmaps of 4 KB, and sets of devices, that meet in one task, about.
MAPS, SETS = 8192, 50_000


def _pairs(links: DataFrame, marked: DataFrame | None = None, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """(account_a, account_b, device_id, a_marked, b_marked): pairs of accounts on a device under their smallest shared device.

    The accounts of a device are dealt into blocks, and each two blocks meet in a cell of their own, so a task never
    holds a whole hot device; a device with fewer accounts than a block is one cell. A row carries the account's smaller
    devices, so a pair can tell in its cell whether it meets on one of them too, and no pair is shuffled: 64 bits rule
    nearly all out. With accounts in `marked`, only pairs with one of these are made.
    """
    ad = kept(links.select("account_id", "device_id").where("account_id IS NOT NULL AND device_id IS NOT NULL").distinct(), "links")
    sizes = kept(ad.groupBy("device_id").agg((1 + F.floor(F.count("*") / block)).cast("int").alias("blocks")).where("blocks > 1"), "sizes")
    many = kept(ad.groupBy("account_id").agg(F.count("*").alias("n")).where(F.col("n") > wide).select("account_id", F.lit(True).alias("many")), "many")
    few = ad.join(many, "account_id", "left_anti").groupBy("account_id").agg(F.collect_list("device_id").alias("devices"))  # WIDE at most
    dealt = ad.join(sizes, "device_id", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).join(few, "account_id", "left")
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("account_id"), F.col("blocks")).cast("int")).withColumn("less", F.filter("devices", lambda x: x < F.col("device_id")))
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(F.xxhash64(x), F.lit(64)).cast("int"))
    dealt = dealt.withColumn("bits", F.aggregate("less", F.lit(0).cast("long"), lambda bits, x: bits.bitwiseOR(bit(x)))).drop("devices")
    mark = marked.select("account_id", F.lit(True).alias("marked")).distinct() if marked is not None else None
    dealt = kept(dealt.join(mark, "account_id", "left").withColumn("marked", F.coalesce("marked", F.lit(False))) if marked is not None else dealt.withColumn("marked", F.lit(False)), "dealt")
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("less", "bits", "marked")]
    first = dealt.select("device_id", F.col("account_id").alias("account_a"), *side("a"), F.col("block").alias("row"), F.explode(F.sequence("block", F.col("blocks") - 1)).alias("column"))
    second = dealt.select("device_id", F.col("account_id").alias("account_b"), *side("b"), F.col("block").alias("column"), F.explode(F.sequence(F.lit(0), "block")).alias("row"))
    met = first.join(second, ["device_id", "row", "column"]).where((F.col("row") < F.col("column")) | (F.col("account_a") < F.col("account_b")))
    if marked is not None:
        met = met.where("a_marked OR b_marked")
    swap = F.col("account_a") > F.col("account_b")
    ends = [F.when(swap, F.col(x)).otherwise(F.col(y)).alias(y) for x, y in (("account_b", "account_a"), ("account_a", "account_b"), ("b_marked", "a_marked"), ("a_marked", "b_marked"))]
    known = F.col("a_less").isNotNull() & F.col("b_less").isNotNull()
    out = met.where(known & ((F.col("a_bits").bitwiseAND(F.col("b_bits")) == 0) | ~F.arrays_overlap("a_less", "b_less"))).select(*ends, "device_id")
    if many.limit(1).count():
        names = ["account_a", "account_b", "a_marked", "b_marked"]
        out = out.unionByName(met.where(~known).select(*ends, "device_id").groupBy(*names).agg(F.min("device_id").alias("device_id")))
    return out.select("account_a", "account_b", "device_id", "a_marked", "b_marked")


def device_share_pairs(links: DataFrame, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """(account_a, account_b, device_id): pairs of accounts on a device, a < b, under their smallest shared device."""
    return _pairs(links, None, block, wide).select("account_a", "account_b", "device_id")


def _plain_edges(env: Mapping[str, DataFrame]) -> DataFrame:
    """The edges but for those of sharing."""
    users, accounts, links, tx = tables(env, "users", "accounts", "account_devices", "transactions")
    owner = accounts.join(users.select("user_id"), "user_id", "left_semi").select(node_id("user", "user_id").alias("src"), node_id("account", "account_id").alias("dst"), F.lit("owns").alias("kind"))
    uses = links.select("account_id", "device_id").distinct().select(node_id("account", "account_id").alias("src"), node_id("device", "device_id").alias("dst"), F.lit("uses").alias("kind"))
    pays = tx.where("merchant_id IS NOT NULL").select("account_id", "merchant_id").distinct().select(node_id("account", "account_id").alias("src"), node_id("merchant", "merchant_id").alias("dst"), F.lit("transacts").alias("kind"))
    return owner.distinct().unionByName(uses).unionByName(pays)


def edges(env: Mapping[str, DataFrame]) -> DataFrame:
    """(src, dst, kind): owner, uses, transacts and shares edges, each once."""
    shares = device_share_pairs(env["account_devices"]).select(node_id("account", "account_a").alias("src"), node_id("account", "account_b").alias("dst"), F.lit("shares").alias("kind"))
    return _plain_edges(env).unionByName(shares)


def degrees(edge_frame: DataFrame) -> DataFrame:
    """(node, degree)."""
    ends = edge_frame.select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree"))


def sharing_neighbours(links: DataFrame) -> DataFrame:
    """(account_id, other): both directions of the sharing pairs."""
    both = F.explode(F.array(F.struct(F.col("account_a").alias("account_id"), F.col("account_b").alias("other")), F.struct(F.col("account_b").alias("account_id"), F.col("account_a").alias("other"))))
    return device_share_pairs(links).select(both.alias("x")).select("x.*")


def marked_neighbours(links: DataFrame, marked: DataFrame, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """(account_id, other): as sharing_neighbours, where other is one of the marked accounts."""
    one = lambda a, b, on: F.when(F.col(on), F.struct(F.col(a).alias("account_id"), F.col(b).alias("other")))
    both = F.array_compact(F.array(one("account_a", "account_b", "b_marked"), one("account_b", "account_a", "a_marked")))
    return _pairs(links, marked, block, wide).select(F.explode(both).alias("x")).select("x.*")


def fraud_accounts(tx: DataFrame) -> DataFrame:
    return tx.where("label_fraud = 1").select("account_id").distinct()


def _numbered(ad: DataFrame, bad: DataFrame) -> DataFrame:
    """(account_id, number, bad) from 0 on: accounts in order of their devices, largest first, so a device's stand together."""
    sizes = kept(ad.groupBy("device_id").agg(F.count("*").alias("size")), "sizes")
    order = ad.join(sizes, "device_id").groupBy("account_id").agg(F.array_sort(F.collect_list(F.struct((-F.col("size")).alias("size"), "device_id"))).alias("order"))  # an account's devices
    ranked = with_rank(order, ["order", "account_id"], "number").select("account_id", (F.col("number") - 1).alias("number"))
    return ranked.join(bad, "account_id", "left").select("account_id", "number", F.coalesce("bad", F.lit(0)).alias("bad"))


def _unions(sets: pa.Table, maps: pa.Table) -> pa.Table:
    """(class, n, bad_ones): set bits of the union of each set's maps, and those that the map without a device has too."""
    named = maps.filter(pc.is_valid(maps["device_id"]))
    names, code = np.unique(named["device_id"].to_numpy(), return_inverse=True)
    size = np.asarray(pc.list_value_length(sets["devices"]))
    order = np.argsort(size, kind="stable")
    given = pc.list_flatten(sets["devices"]).to_numpy()
    place = np.minimum(np.searchsorted(names, given), max(0, len(names) - 1))
    place = np.where(names[place] == given, place, len(names)) if len(names) else np.zeros(len(given), np.int64)
    starts, n, bad = np.cumsum(size) - size, np.zeros(len(size), np.int64), np.zeros(len(size), np.int64)
    words = lambda table: np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(table.num_rows, 512)
    bits, bucket, rest = words(named), named["bucket"].to_numpy(), maps.filter(pc.is_null(maps["device_id"]))
    marks = dict(zip(rest["bucket"].to_pylist(), words(rest), strict=True))
    for b in np.unique(bucket):
        here = np.flatnonzero(bucket == b)
        held = np.concatenate([np.zeros((1, 512), np.uint64), bits[here]])  # row 0 for devices without a map here
        row = np.zeros(len(names) + 1, np.int64)
        row[code[here]] = np.arange(1, len(here) + 1)
        for low in range(0, len(order), 256):
            some = order[low : low + 256]
            most = int(size[some].max())
            at = np.arange(most)[None, :]
            inside = at < size[some][:, None]
            rows = np.where(inside, row[place[np.where(inside, starts[some][:, None] + at, 0)]], 0)
            union = held[rows[:, 0]]
            for j in range(1, most):
                union |= held[rows[:, j]]
            n[some] += np.bitwise_count(union).sum(1, dtype=np.int64)
            if b in marks:
                bad[some] += np.bitwise_count(union & marks[b]).sum(1, dtype=np.int64)
    return pa.table({"class": sets["class"], "n": n, "bad_ones": bad})


def _counted(classes: DataFrame, maps: DataFrame, marks: DataFrame, most_maps: int = MAPS, most_sets: int = SETS) -> DataFrame:
    """(class, n, bad_ones): accounts on any device of a set, and those among them that are marked.

    Maps are dealt by bucket into groups, sets into parts, and each two meet in a cell that holds both: the unions never
    leave it, so only maps times parts and sets times groups are shuffled.
    """
    cores = 2 * classes.sparkSession.sparkContext.defaultParallelism
    n = classes.count()
    groups = max(1, -(-maps.count() // most_maps))
    parts = max(1, min(-(-n // most_sets), max(cores, -(-n // (10 * most_sets)))))
    every = maps.unionByName(marks.withColumn("device_id", F.lit(None).cast(maps.schema["device_id"].dataType)))
    held = every.withColumn("group", F.pmod("bucket", F.lit(groups)).cast("int")).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    asked = classes.withColumn("part", F.pmod(F.xxhash64("class"), F.lit(parts)).cast("int")).withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    ship(classes.sparkSession)
    schema = f"class {classes.schema['class'].dataType.simpleString()}, n long, bad_ones long"
    cells = asked.groupBy("group", "part").cogroup(held.groupBy("group", "part")).applyInArrow(_unions, schema)
    return cells.groupBy("class").agg(F.sum("n").alias("n"), F.sum("bad_ones").alias("bad_ones"))


def neighbour_counts(links: DataFrame, tx: DataFrame, dense: int = DENSE) -> DataFrame:
    """(account_id, n, suspicious): sharing neighbours, and those with a labelled transaction.

    Uses labels of all times: for analysis, not for training.
    """
    ad = kept(links.select("account_id", "device_id").where("account_id IS NOT NULL AND device_id IS NOT NULL").distinct(), "links")
    bad = fraud_accounts(tx).where("account_id IS NOT NULL").withColumn("bad", F.lit(1))
    accounts = kept(_numbered(ad, bad), "accounts")
    bits = ad.join(accounts, "account_id").withColumn("bucket", F.bitmap_bucket_number("number")).select("device_id", "bucket", "number")
    at = F.bitmap_bit_position("number")
    maps = bits.repartition("device_id", "bucket").groupBy("device_id", "bucket").agg(F.bitmap_construct_agg(at).alias("bits"))
    maps = kept(maps.withColumn("size", F.bitmap_count("bits")), "maps")
    use = maps.groupBy("device_id").agg(F.sum("size").alias("size"), F.count("*").alias("maps")).where((F.col("size") > dense) & (F.col("size") >= dense * F.col("maps")))
    use = kept(use.select("device_id", F.lit(True).alias("dense")), "dense")
    marked = kept(ad.join(use, "device_id", "left"), "marked")

    # by bitmaps: once for each set of dense devices
    sets = marked.where("dense").groupBy("account_id").agg(F.array_sort(F.collect_list("device_id")).alias("devices"))  # an account's devices
    sets = kept(sets, "sets")
    classes = kept(sets.groupBy("devices").agg(F.min("account_id").alias("class")), "classes")
    marks = accounts.where("bad = 1").withColumn("bucket", F.bitmap_bucket_number("number")).groupBy("bucket").agg(F.bitmap_construct_agg(at).alias("bits"))
    counts = _counted(classes, maps.join(use, "device_id", "left_semi").select("device_id", "bucket", "bits"), marks).join(classes, "class").drop("class")
    by_maps = sets.join(counts, "devices").join(accounts, "account_id").select("account_id", (F.col("n") - 1).alias("n"), (F.col("bad_ones") - F.col("bad")).alias("suspicious"))  # less the account itself

    # in pairs: over the other devices, unless the two also meet on a dense one
    ends = device_share_pairs(marked.where("dense IS NULL"))
    side = lambda x: sets.select(F.col("account_id").alias(f"account_{x}"), F.col("devices").alias(f"{x}_devices"))
    met = ends.join(side("a"), "account_a", "left").join(side("b"), "account_b", "left")
    met = met.where(~F.coalesce(F.arrays_overlap("a_devices", "b_devices"), F.lit(False)))
    both = met.select(F.explode(F.array(F.struct(F.col("account_a").alias("account_id"), F.col("account_b").alias("other")), F.struct(F.col("account_b").alias("account_id"), F.col("account_a").alias("other")))).alias("x")).select("x.*")
    marks = accounts.where("bad = 1").select(F.col("account_id").alias("other"), F.lit(1).cast("long").alias("mark"))
    in_pairs = both.join(marks, "other", "left").groupBy("account_id").agg(F.count("*").alias("n"), F.coalesce(F.sum("mark"), F.lit(0)).alias("suspicious"))
    return by_maps.unionByName(in_pairs).groupBy("account_id").agg(F.sum("n").alias("n"), F.sum("suspicious").alias("suspicious")).where("n > 0")


def node_degrees(env: Mapping[str, DataFrame]) -> DataFrame:
    """(node, degree) as `degrees` of `edges` gives, without the sharing pairs."""
    links, tx = tables(env, "account_devices", "transactions")
    shares = neighbour_counts(links, tx).select(node_id("account", "account_id").alias("node"), F.col("n").alias("degree"))
    ends = _plain_edges(env).select(F.explode(F.array("src", "dst")).alias("node"))
    return ends.groupBy("node").agg(F.count("*").alias("degree")).unionByName(shares).groupBy("node").agg(F.sum("degree").alias("degree"))


def edge_counts(env: Mapping[str, DataFrame]) -> DataFrame:
    """(kind, n): edges of each kind, without the sharing pairs."""
    links, tx = tables(env, "account_devices", "transactions")
    shares = neighbour_counts(links, tx).agg((F.sum("n") / 2).cast("long").alias("n")).where("n > 0").select(F.lit("shares").alias("kind"), "n")
    return _plain_edges(env).groupBy("kind").agg(F.count("*").alias("n")).unionByName(shares)


def suspicious_neighbours(links: DataFrame, tx: DataFrame) -> DataFrame:
    """(account_id, n): sharing neighbours with a labelled transaction, where there are any."""
    return neighbour_counts(links, tx).where("suspicious > 0").select("account_id", F.col("suspicious").alias("n"))


GRAPH_COLUMNS = ["account_degree", "device_degree", "merchant_degree", "shared_device_count", "account_suspicious_neighbor_count"]


def graph_features(env: Mapping[str, DataFrame]) -> DataFrame:
    """txn_id and GRAPH_COLUMNS."""
    users, accounts, links, tx = tables(env, "users", "accounts", "account_devices", "transactions")
    owned = accounts.join(users.select("user_id"), "user_id", "left_semi").select("account_id").distinct().withColumn("n", F.lit(1).cast("long"))
    ad = links.select("account_id", "device_id").distinct()
    am = tx.where("merchant_id IS NOT NULL").select("account_id", "merchant_id").distinct()
    shared = kept(neighbour_counts(links, tx), "neighbours")
    parts = owned.unionAll(ad.groupBy("account_id").agg(F.count("*").alias("n"))).unionAll(am.groupBy("account_id").agg(F.count("*").alias("n"))).unionAll(shared.select("account_id", "n"))
    account = parts.groupBy("account_id").agg(F.sum("n").alias("account_degree"))
    dev = ad.groupBy("device_id").agg(F.count("*").alias("device_degree"))
    mer = am.groupBy("merchant_id").agg(F.count("*").alias("merchant_degree"))
    sus = shared.select("account_id", F.col("suspicious").alias("sus"))
    out = tx.select("txn_id", "account_id", "device_id", "merchant_id").join(account, "account_id", "left").join(dev, "device_id", "left").join(mer, "merchant_id", "left").join(sus, "account_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("int")
    return out.select("txn_id", zero("account_degree").alias("account_degree"), zero("device_degree").alias("device_degree"), zero("merchant_degree").alias("merchant_degree"), F.greatest(zero("device_degree") - 1, F.lit(0)).alias("shared_device_count"), zero("sus").alias("account_suspicious_neighbor_count"))
