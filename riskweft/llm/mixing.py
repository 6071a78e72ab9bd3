"""Mixing sources to target weights by Efraimidis-Spirakis sampling, in DataFrame functions only.

Each document gets an exponential key whose rate is its quality weight. A source takes as many complete epochs of its
documents as fit its target, then documents in order of their keys until the prefix sum of their sizes reaches the rest
of the budget. Keys come from a hash of the id, so reruns agree.

Edge cases: a null text has size 0, and a very long one counts whole; of equal keys the smaller id comes first, then the
smaller hash of the row; null is a source of its own, ordered last; rows equal in id, source and text are taken together; sources without words get no words; an empty table gives an empty one; other columns pass through
mix_documents and are not read by mix_plan.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, n_words, prefix_sum
from .quality import row_key

#: A source gives at most so many times its size.
MAX_EPOCHS = 3
#: Rows of a bin of keys, about.
BIN_ROWS = 4096


def quality_weight(text: Column) -> Column:
    """0.5 to 1: less for documents with many of the symbols #*$%&|<>."""
    text = F.coalesce(text, F.lit(""))
    return 1 - 0.5 * F.regexp_count(text, F.lit(r"[#*$%&|<>]")) / F.greatest(F.length(text), F.lit(1))


def uniform(id_col: Column, seed: int) -> Column:
    """In (0, 1), from 52 bits of a hash of the id."""
    digits = F.substring(F.md5(F.concat(F.coalesce(id_col.cast("string"), F.lit("")), F.lit(f"|{seed}")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, n_rows, target) from (source, size, m): the shares by weight 1, 2, 3, repeating, filled up to the caps.

    Raising one level for all until the sizes are spent gives what resharing the excess again and again ends with: in
    order of cap over weight, the level is what is left over the weights left, at the first source that it doesn't cap.
    A source is one row here, so the windows without a partition see no documents.
    """
    per = sizes.groupBy("__source").agg(F.sum(F.col("__size") * F.col("__m")).alias("__s"), F.sum("__m").alias("__n"))
    by_name, by_cap = Window.orderBy(F.col("__source").asc_nulls_last()), Window.orderBy("__ratio", F.col("__source").asc_nulls_last())
    per = per.withColumn("__w", (F.row_number().over(by_name) - 1) % 3 + 1).withColumn("__cap", F.col("__s").cast("double") * MAX_EPOCHS).withColumn("__ratio", F.col("__cap") / F.col("__w"))
    every = Window.partitionBy(F.lit(0))
    spent = F.coalesce(F.sum("__cap").over(by_cap.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    per = per.withColumn("__level", (F.sum("__s").over(every) - spent) / F.sum("__w").over(by_cap.rowsBetween(0, Window.unboundedFollowing)))
    per = per.withColumn("__level", F.min(F.when(F.col("__level") <= F.col("__ratio"), F.struct("__ratio", "__level"))).over(every)["__level"])
    return per.select("__source", F.col("__s").alias("source_size"), F.col("__n").alias("__rows"), F.least(F.col("__cap"), F.col("__level") * F.col("__w")).alias("target"))


def mix_plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """(__k1, __k2, __id, __m, size, source_size, target, copies) for each distinct row, of which there are __m."""
    scratch = Scratch(docs.sparkSession, "mix")
    sizes = docs.select(*row_key(id_col, source_col, text_col), F.col(id_col).alias("__id"), F.col(source_col).alias("__source"), n_words(F.col(text_col)).alias("__size"), quality_weight(F.col(text_col)).alias("__q"))
    sizes = sizes.groupBy("__k1", "__k2").agg(F.first("__id").alias("__id"), F.first("__source").alias("__source"), F.first("__size").alias("__size"), F.first("__q").alias("__q"), F.count("*").alias("__m"))
    sizes = scratch.keep(sizes, "sizes")
    per = scratch.keep(targets(sizes), "targets").withColumnRenamed("__source", "__t")
    rows = sizes.join(per, F.col("__source").eqNullSafe(F.col("__t"))).drop("__t")
    rows = rows.withColumn("__key", -F.log(uniform(F.col("__id"), seed)) / F.col("__q"))
    rows = rows.withColumn("__bin", F.floor((1 - F.exp(-F.col("__key"))) * (1 + F.floor(F.col("__rows") / BIN_ROWS))))
    rows = rows.withColumn("__all", F.col("__size") * F.col("__m"))
    rows = prefix_sum(rows, ["__source"], ["__key", "__id", "__k1", "__k2"], "__bin", "__all", "__before")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    rows = rows.withColumn("__epochs", F.least(epochs, F.lit(MAX_EPOCHS)))
    rest = F.col("target") - F.col("__epochs") * F.col("source_size")
    one_more = (F.col("__epochs") < MAX_EPOCHS) & (F.col("__before") + F.col("__all") / 2 <= rest)  # the nearest that whole documents allow
    return rows.select("__k1", "__k2", "__id", "__m", F.col("__size").alias("size"), "source_size", "target", (F.col("__epochs") + one_more.cast("long")).alias("copies"))


def mix_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """Per document: size, source_size, target, taken (words that the mix takes, repeats counted)."""
    plan = mix_plan(docs, id_col, text_col, source_col, seed).withColumn("__row", F.explode(F.sequence(F.lit(1), F.col("__m"))))
    return plan.select(F.col("__id").alias(id_col), "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 17) -> DataFrame:
    """The documents of the mix, all columns, each as often as it is taken."""
    plan = mix_plan(docs, id_col, text_col, source_col, seed).where("copies > 0").select(F.col("__k1").alias("__p1"), F.col("__k2").alias("__p2"), "copies")
    keyed = docs.select("*", *row_key(id_col, source_col, text_col))
    out = keyed.join(plan.withColumnRenamed("copies", "__copies"), (F.col("__k1") == F.col("__p1")) & (F.col("__k2") == F.col("__p2")))
    return out.withColumn("__row", F.explode(F.sequence(F.lit(1), F.col("__copies")))).select(*[f"`{c}`" for c in docs.columns])
