"""Sharding by balanced label propagation.

Documents with equal texts are linked (to their group, not pair by pair). Every document starts in a shard of equal
bytes; in each round the documents of a group that lie in one shard move, as one chunk, to the shard that holds most of
their group, while that shard has room, until no chunk may move. A group that is still split then moves as a whole to any shard with room for
it; one that no shard has room for is laid along the free room, so it takes few shards. Documents without links are
placed last and level the shards exactly.

Edge cases: a null text counts as an empty one (size 1, crc32 0) and is linked with empty ones; a group larger than a
shard is spread over several; repeated rows are placed one by one; a very long text is placed like any other; with fewer bytes than shards some shards are
empty; an empty table gives an empty one; columns other than the two named ones are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, prefix_sum

#: Rows of a bin, about.
BIN_ROWS = 4096


def _binned(df: DataFrame, rows: int) -> DataFrame:
    """Adds __bin, rising with __order (a hash), for bins of about BIN_ROWS of the given number of rows."""
    bins = 1 + rows // BIN_ROWS
    return df.withColumn("__bin", F.floor((F.col("__order") / float(2**64) + 0.5) * bins))


def _propagate(chunks: DataFrame, scratch: Scratch, n_shards: int, room: float) -> DataFrame:
    """(g1, g2, born, shard, bytes): where the chunk of a group that began in shard born ends up.

    A granted move leaves a group in fewer shards, so the rounds come to an end.
    """
    chunks = scratch.keep(chunks.withColumn("shard", F.col("born")), "chunks")
    while True:
        mass = chunks.groupBy("g1", "g2", "shard").agg(F.sum("bytes").alias("mass"))
        loads = {r["shard"]: r["load"] for r in mass.groupBy("shard").agg(F.sum("mass").alias("load")).collect()}  # n_shards rows
        free = [max(0.0, room - (loads.get(s) or 0)) for s in range(n_shards)]
        open_shards = [s for s in range(n_shards) if free[s] > 0.01 * room]
        best = mass.where(F.col("shard").isin(open_shards)).groupBy("g1", "g2").agg(F.max(F.struct("mass", (-F.col("shard")).alias("minus"))).alias("x"))
        best = best.select("g1", "g2", F.col("x.mass").alias("to_mass"), (-F.col("x.minus")).alias("to"))
        moves = mass.join(best, ["g1", "g2"]).where((F.col("to_mass") > F.col("mass")) | ((F.col("to_mass") == F.col("mass")) & (F.col("to") < F.col("shard"))))
        quota = F.element_at(F.array(*[F.lit(x) for x in free]), (F.col("to") + 1).cast("int"))
        moves = moves.where(F.col("mass") <= quota).select("g1", "g2", "shard", "to", "mass", F.xxhash64("g1", "g2", "shard").alias("__order"))
        moves = scratch.keep(moves, "moves")
        if not (n := moves.count()):
            return chunks
        moves = prefix_sum(_binned(moves, n), ["to"], ["__order", "g1", "g2", "shard"], "__bin", "mass", "before")
        granted = scratch.keep(moves.where(F.col("before") + F.col("mass") <= quota).select("g1", "g2", "shard", "to"), "granted")
        if not granted.limit(1).count():
            return chunks
        chunks = chunks.join(granted, ["g1", "g2", "shard"], "left").select("g1", "g2", "born", F.coalesce("to", "shard").alias("shard"), "bytes")
        chunks = scratch.keep(chunks, "chunks")


def _line(free: list[float]) -> tuple[list[int], list[float]]:
    """The shards, the one with most room first, and where each ends if their free rooms lie end to end."""
    order, ends = sorted(range(len(free)), key=lambda s: (-free[s], s)), []
    for s in order:
        ends.append((ends[-1] if ends else 0.0) + free[s])
    return order, ends


def _index(at: Column, ends: list[float]) -> Column:
    """Place on the line of the shard that the position lies in."""
    return F.aggregate(F.array(*[F.lit(float(e)) for e in ends[:-1]]).cast("array<double>"), F.lit(0), lambda a, e: a + (at >= e).cast("int"))


def _at(values: list, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in values]), (index + 1).cast("int"))


def _homes(chunks: DataFrame, large: DataFrame, scratch: Scratch, n_shards: int, room: float) -> tuple[DataFrame, list[float]]:
    """(g1, g2, shard, offset), and the free room of each shard: the shard of each group, or for a group that fits in none where it begins on the line."""
    per = scratch.keep(chunks.groupBy("g1", "g2").agg(F.sum("bytes").alias("mass"), F.count_distinct("shard").alias("n"), F.min("shard").alias("shard")), "per")
    homes, split = per.where("n = 1").select("g1", "g2", "shard", "mass"), per.where("n > 1").select("g1", "g2", "mass")
    held = {r["shard"]: r["load"] for r in homes.groupBy("shard").agg(F.sum("mass").alias("load")).collect()}  # n_shards rows
    free = [max(0.0, room - held.get(s, 0)) for s in range(n_shards)]
    while n := split.where(F.col("mass") <= max(free)).count():
        # the groups lie end to end along the free room; those that cross no border are placed, so each round leaves few
        order, ends = _line(free)
        fitting = _binned(split.where(F.col("mass") <= max(free)).withColumn("__order", F.xxhash64("g1", "g2")), n)
        laid = prefix_sum(fitting, [], ["__order", "g1", "g2"], "__bin", "mass", "__before").withColumn("__i", _index(F.col("__before"), ends))
        placed = laid.where(F.col("__before") + F.col("mass") <= _at(ends, F.col("__i"))).select("g1", "g2", _at(order, F.col("__i")).alias("shard"), "mass")
        placed = scratch.keep(placed, "placed")
        for r in placed.groupBy("shard").agg(F.sum("mass").alias("load")).collect():  # n_shards rows
            free[r["shard"]] = max(0.0, free[r["shard"]] - r["load"])
        homes, split = homes.union(placed), scratch.keep(split.join(placed.select("g1", "g2"), ["g1", "g2"], "left_anti"), "split")
    rest = split.union(large).withColumn("__order", F.xxhash64("g1", "g2"))
    rest = prefix_sum(_binned(rest, 1), [], ["__order", "g1", "g2"], "__bin", "mass", "offset")  # fewer than shards, about
    return scratch.keep(homes.select("g1", "g2", "shard", F.lit(None).cast("long").alias("offset")).union(rest.select("g1", "g2", F.lit(None).cast("int"), "offset")), "homes"), free


def shard_documents(docs: DataFrame, n_shards: int = 16, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, size, text_crc32, law, shard, slot, grown_shard) of every row, under the law `bytes`."""
    scratch = Scratch(docs.sparkSession, "sharding")
    raw = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    nodes = docs.select(F.col(id_col).alias("__id"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"), F.xxhash64(raw).alias("g1"), F.xxhash64(F.lit(1), raw).alias("g2"), F.xxhash64(id_col, raw).alias("__order"))
    nodes = scratch.keep(nodes, "nodes")
    total = nodes.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    room = total["bytes"] / n_shards
    linked = nodes.groupBy("g1", "g2").agg(F.count("*").alias("count"), F.sum("size").alias("mass")).where("count > 1").select("g1", "g2", "mass")
    linked = scratch.keep(linked, "linked")  # so the join has no aggregate below it and may split a hot text
    nodes = prefix_sum(_binned(nodes, total["n"]), [], ["__order", "__id"], "__bin", "size", "__before")
    born = F.least(F.floor(F.col("__before") / max(room, 1e-9)), F.lit(n_shards - 1)).cast("int")
    nodes = nodes.withColumn("born", born).drop("__before", "__bin")
    nodes = scratch.keep(nodes.join(linked, ["g1", "g2"], "left").withColumn("__linked", F.col("mass").isNotNull()), "born")

    large = nodes.where(F.col("mass") > room).select("g1", "g2", "mass").distinct()  # in no shard as a whole, so not in the way of the others
    chunks = nodes.where(F.col("mass") <= room).groupBy("g1", "g2", "born").agg(F.sum("size").alias("bytes"))
    homes, free = _homes(_propagate(chunks, scratch, n_shards, room), large, scratch, n_shards, room)
    moved = scratch.keep(nodes.where("__linked").select("g1", "g2", "__id", "size", "text_crc32", "__order").join(homes, ["g1", "g2"]), "moved")
    spread = moved.where("shard IS NULL")
    order, ends = _line(free)
    spread = prefix_sum(_binned(spread, spread.count()), ["g1", "g2"], ["__order", "__id"], "__bin", "size", "__before")
    at = F.col("offset") + F.col("__before") + F.col("size") / 2
    spread = scratch.keep(spread.select("__id", "size", "text_crc32", "__order", _at(order, _index(at, ends)).alias("shard")), "spread")
    for r in spread.groupBy("shard").agg(F.sum("size").alias("load")).collect():  # n_shards rows
        free[r["shard"]] = max(0.0, free[r["shard"]] - r["load"])
    single = nodes.where(~F.col("__linked")).drop("g1", "g2", "born", "mass")
    left = single.agg(F.count("*").alias("n"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes")).first()
    scale, ends = left["bytes"] / max(sum(free), 1e-9), []
    for x in free:
        ends.append((ends[-1] if ends else 0.0) + x * scale)
    single = prefix_sum(_binned(single, left["n"]), [], ["__order", "__id"], "__bin", "size", "__before")
    place = F.aggregate(F.array(*[F.lit(float(e)) for e in ends[:-1]]), F.lit(0), lambda a, e: a + (F.col("__before") + F.col("size") / 2 >= e).cast("int"))
    single = single.select("__id", "size", "text_crc32", "__order", place.alias("shard"))
    moved = moved.where("shard IS NOT NULL").select("__id", "size", "text_crc32", "__order", "shard")
    placed = scratch.keep(single.union(moved).union(spread), "placed")

    numbered = _binned(placed.withColumn("__one", F.lit(1)), total["n"] // n_shards)
    numbered = prefix_sum(numbered, ["shard"], ["__order", "__id"], "__bin", "__one", "__slot")
    return numbered.select(F.col("__id").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), F.col("__slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def cut_links(sharded: DataFrame) -> DataFrame:
    """One row: links between equal texts (each text's documents in a chain), and those that two shards cut, by crc32."""
    per = sharded.groupBy("text_crc32").agg(F.count("*").alias("n"), F.count_distinct("shard").alias("shards"))
    return per.agg(F.sum(F.col("n") - 1).alias("links"), F.sum(F.col("shards") - 1).alias("cut"))
