"""Quality rules with cross-document line frequency, in DataFrame functions only.

Per document: word, symbol, repeated-line and repeated-window counts. Across documents: lines are normalised and hashed,
distinct documents are counted per host and line, documents that would lose most of their words with the lines above the
limit are rejected, and `cleaned` gives the others without these lines.

Edge cases: a null text has no words and fails the base rules; a very long text is taken whole, its windows as hashes in
arrays of its own row; a null host is a host of its own; rows equal in id, host
and text count as one document and get the same verdict; an empty table gives an empty one; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import WORD, Scratch, let, words

WINDOW = 8
SYMBOLS = r"[#*$%&|<>]"


def repeated_words(ws: Column) -> Column:
    """Words that lie in a window of WINDOW words found twice or more in the text, the first one included."""

    def covered(places: Column) -> Column:
        steps = F.transform(places, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(places, k + 1) - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0), lambda a, x: a + x)

    def found_twice(rows: Column) -> Column:
        """Places, in order, of hashes that have an equal neighbour in the sorted rows."""
        same = lambda x, k: x["h"] == F.get(rows, k)["h"]
        return F.array_sort(F.filter(F.transform(rows, lambda x, k: F.when(same(x, k - 1) | same(x, k + 1), x["i"])), lambda i: i.isNotNull()))

    def of_hashes(hs: Column) -> Column:
        ordered = F.array_sort(F.transform(hs, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hs)) == F.size(hs), F.lit(0)).otherwise(let(let(ordered, found_twice), covered))

    starts = F.sequence(F.lit(1), F.greatest(F.size(ws) - (WINDOW - 1), F.lit(1)))
    hashes = F.transform(starts, lambda i: F.xxhash64(F.slice(ws, i, WINDOW)))
    return F.when(F.size(ws) <= WINDOW, F.lit(0)).otherwise(let(hashes, of_hashes))


def base_signals(text: Column) -> Column:
    """Struct of n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, all long."""
    text = F.coalesce(text, F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(WORD))
    of_words = let(
        words(text),
        lambda ws: F.struct(F.size(ws).cast("long").alias("n_words"), F.length(F.array_join(ws, "")).cast("long").alias("word_chars"), repeated_words(ws).cast("long").alias("n_repeat_words")),
    )
    repeated = let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("long"))
    return let(
        of_words,
        lambda w: F.struct(w["n_words"].alias("n_words"), w["word_chars"].alias("word_chars"), F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"), repeated.alias("n_dup_lines"), w["n_repeat_words"].alias("n_repeat_words")),
    )


def row_key(id_col: str, *cols: str) -> list[Column]:
    """Two hashes that name a row by its contents."""
    return [F.xxhash64(id_col, *cols).alias("__k1"), F.xxhash64(F.lit(1), id_col, *cols).alias("__k2")]


def line_key(line: Column) -> Column:
    """Normalised line: lower case, one blank between words."""
    return F.lower(F.array_join(words(line), " "))


def _lines_marked(docs: DataFrame, scratch: Scratch, keys: list[Column], text_col: str, host_col: str, max_docs: int, with_places: bool) -> DataFrame:
    """(__k1, __k2, __n, __often) of each document's different lines: its words, and whether it is above the limit; __places of it in the text if asked."""
    place = ["__place"] if with_places else []
    cut = F.split(text_col, "\n")
    lines = docs.select(*keys, F.col(host_col).alias("__host"), F.posexplode(cut).alias("__place", "__line") if with_places else F.explode(cut).alias("__line")).where(F.col("__line").rlike(WORD))
    per_doc = (
        lines.select("__k1", "__k2", "__host", *place, let(line_key(F.col("__line")), lambda k: F.struct(F.xxhash64(k).alias("h1"), F.xxhash64(F.lit(1), k).alias("h2"), (F.length(k) - F.length(F.replace(k, F.lit(" "), F.lit(""))) + 1).alias("n"))).alias("__x"))
        .groupBy("__host", F.col("__x.h1").alias("__h1"), F.col("__x.h2").alias("__h2"), "__k1", "__k2")
        .agg(F.sum("__x.n").alias("__n"), *[F.collect_set(p).alias("__places") for p in place])  # no more than the lines of a document
    )
    per_doc = scratch.keep(per_doc, "lines")
    often = per_doc.groupBy("__host", "__h1", "__h2").count().where(F.col("count") > max_docs).select(F.col("__host").alias("__o"), F.col("__h1").alias("__o1"), F.col("__h2").alias("__o2"), F.lit(True).alias("__often"))
    often = scratch.keep(often, "often")  # so the join has no aggregate below it and may split a hot line
    return per_doc.join(often, F.col("__host").eqNullSafe(F.col("__o")) & (F.col("__h1") == F.col("__o1")) & (F.col("__h2") == F.col("__o2")), "left")


def _judged(docs: DataFrame, keys: list[Column], id_col: str, text_col: str, host_col: str, max_docs: int, min_left: float, with_places: bool = False) -> DataFrame:
    """All columns, __k1, __k2, the signals __b, the verdicts base_failed and kept, and, if asked, __gone: the places of the lines above the limit."""
    left = _lines_marked(docs, Scratch(docs.sparkSession, "quality"), keys, text_col, host_col, max_docs, with_places)
    gone = [F.flatten(F.collect_list(F.when(F.col("__often"), F.col("__places")))).alias("__gone")] if with_places else []
    shares = left.groupBy(F.col("__k1").alias("__s1"), F.col("__k2").alias("__s2")).agg((F.sum(F.when(F.col("__often"), 0).otherwise(F.col("__n"))) / F.sum("__n")).alias("__left_share"), *gone)
    base = docs.select("*", *keys, base_signals(F.col(text_col)).alias("__b"))
    out = base.join(shares, (F.col("__k1") == F.col("__s1")) & (F.col("__k2") == F.col("__s2")), "left")
    failed = (F.col("__b.n_words") < 20) | (100 * F.col("__b.n_repeat_words") > 30 * F.col("__b.n_words"))
    return out.withColumns({"__failed": failed, "__kept": ~failed & (F.coalesce("__left_share", F.lit(1.0)) >= min_left)})


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 20, min_left: float = 0.3) -> DataFrame:
    """Signals and verdict of each document.

    A line found in more than max_docs documents of a host is to be removed from them (cleaned does so); a document is
    kept if the base rules pass and at least min_left of its words stay.
    """
    keys = row_key(id_col, host_col, text_col)
    out = _judged(docs.select(id_col, host_col, text_col), keys, id_col, text_col, host_col, max_docs, min_left)
    signals = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return out.select(id_col, *[F.col(f"__b.{c}").alias(c) for c in signals], F.col("__failed").alias("base_failed"), F.col("__kept").alias("kept"))


def cleaned(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_docs: int = 20, min_left: float = 0.3) -> DataFrame:
    """The documents that quality_rules keeps, all columns, without the lines found in more than max_docs documents of their host."""
    out = _judged(docs, row_key(id_col, host_col, text_col), id_col, text_col, host_col, max_docs, min_left, True).where("__kept")
    stays = F.filter(F.transform(F.split(text_col, "\n"), lambda x, i: F.when(~F.array_contains("__gone", i), x)), lambda x: x.isNotNull())
    text = F.when(F.coalesce(F.size("__gone"), F.lit(0)) > 0, F.array_join(stays, "\n")).otherwise(F.col(text_col))
    return out.withColumn(text_col, text).select(*[f"`{c}`" for c in docs.columns])
