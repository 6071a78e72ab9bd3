"""Line dedup by levelled sorted runs of line hashes, in DataFrame functions only.

A run is a table of (h1, h2, n_docs, last_doc, fresh), bucketed and sorted by hash, so it is merge-joined without being
dealt or sorted again. A new batch of lines is counted and merge-joined with the runs: lines that no run holds are fresh
and enter as entries of the batch's own run; known ones are written beside them as recurrences of an entry that stands
elsewhere. So a line has one entry over all runs, most lines are counted once and never touched again, and the result
is every entry with its recurrences added. When a level holds FAN_IN runs their entries are merged into one run of the
next level, so a hash meets few runs and an entry is rewritten once a level.

Edge cases: a null or empty text is one empty line; a null id orders before all others; rows that share an id are one
document; a very long text is split within its row; an empty table gives an empty one; columns of the documents other
than the named ones pass through dedup_lines untouched and are not read by line_report.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, Scratch, let
from .quality import row_key

FAN_IN = 2
#: Batches in which line_report feeds documents to the runs.
BATCHES = 3


def line_hashes(key: Column) -> Column:
    """Struct h1, h2: equal for keys that are equal once A-Z are lower-cased, and only for those.

    lower() also folds other letters; where a key has some, they are hashed as they stand, in their places.
    """
    other = F.when(F.octet_length(key) == F.length(key), F.lit("")).otherwise(F.regexp_replace(key, r"[\x00-\x7F]", "."))
    return let(F.lower(key), lambda low: F.struct(F.xxhash64(low, other).alias("h1"), F.xxhash64(F.lit(1), low, other).alias("h2")))


def stripped(line: Column) -> Column:
    return F.btrim(line, F.lit(SPACE_CHARS))


def long_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(__k1, __k2, __doc, __pos, h1, h2): the lines whose key has min_chars code points or more."""
    lines = docs.select(*row_key(id_col, text_col), F.col(id_col).alias("__doc"), F.posexplode(F.split(F.coalesce(text_col, F.lit("")), "\n")).alias("__pos", "__line"))
    keyed = lines.where(F.length("__line") >= min_chars).withColumn("__key", stripped(F.col("__line"))).where(F.length("__key") >= min_chars)
    return keyed.select("__k1", "__k2", "__doc", "__pos", line_hashes(F.col("__key")).alias("__h")).select("__k1", "__k2", "__doc", "__pos", "__h.*")


@contextmanager
def _sorted_scans(spark: SparkSession) -> Iterator[None]:
    """Lets scans of runs be known as sorted."""
    name = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


class LineRuns:
    """The levelled runs. levels[i] holds the names of the runs of level i, past the recurrences of merged ones."""

    def __init__(self, spark: SparkSession, scratch: Scratch | None = None):
        self.spark, self.scratch = spark, scratch or Scratch(spark, "lines")
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[str]] = []
        self.past: list[DataFrame] = []

    def _store(self, run: DataFrame, level: int) -> str:
        name = f"line_run_{uuid.uuid4().hex}"
        writer = run.select("h1", "h2", "n_docs", "last_doc", "fresh").write.option("compression", "zstd").option("path", self.scratch.path(f"run-{level}"))
        writer.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").saveAsTable(name)
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)
        return name

    def names(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> str:
        """Adds a batch of (h1, h2, __doc), whose documents are in no other batch; returns the name of its own run."""
        own = lines.groupBy("h1", "h2", "__doc").agg(F.lit(1).alias("one")).groupBy("h1", "h2").agg(F.count("one").alias("n_docs"), F.max("__doc").alias("last_doc"))
        known = F.lit(False)
        for i, name in enumerate(self.names()):
            entries = self.spark.table(name).where("fresh").select(F.col("h1").alias(f"r{i}"), F.col("h2").alias(f"s{i}")).hint("merge")
            own = own.join(entries, (F.col("h1") == F.col(f"r{i}")) & (F.col("h2") == F.col(f"s{i}")), "left")
            known = known | F.col(f"r{i}").isNotNull()
        with _sorted_scans(self.spark):
            name = self._store(own.withColumn("fresh", ~known), 0)
        return name

    def compact(self) -> None:
        """Merges the runs of every full level into one of the next."""
        level = 0
        while level < len(self.levels):
            if len(old := self.levels[level]) >= FAN_IN:
                self.levels[level] = []
                self.past += [self.scratch.keep(self.spark.table(name).where("NOT fresh"), "past") for name in old]
                with _sorted_scans(self.spark):
                    self._store(reduce(self._merged, (self.spark.table(name).where("fresh") for name in old)), level + 1)
                self._forget(old)
            level += 1

    @staticmethod
    def _merged(a: DataFrame, b: DataFrame) -> DataFrame:
        """The entries of both; no line is in both."""
        b = b.withColumnsRenamed({c: f"b_{c}" for c in b.columns})
        both = a.join(b.hint("merge"), (F.col("h1") == F.col("b_h1")) & (F.col("h2") == F.col("b_h2")), "full")
        return both.select(*[F.coalesce(c, f"b_{c}").alias(c) for c in a.columns])

    def counted(self) -> DataFrame:
        """(h1, h2, n_docs, last_doc) of every line: its entry, with its recurrences added."""
        names = self.names()
        again = [self.spark.table(name).where("NOT fresh") for name in names] + self.past
        more = reduce(DataFrame.unionByName, again).groupBy("h1", "h2").agg(F.sum("n_docs").alias("more"), F.max("last_doc").alias("later")).withColumnsRenamed({"h1": "m1", "h2": "m2"})
        more = self.scratch.keep(more, "recurrences")
        added = lambda e: e.join(more, (F.col("h1") == F.col("m1")) & (F.col("h2") == F.col("m2")), "left")
        parts = [added(self.spark.table(name).where("fresh")) for name in names]
        return reduce(DataFrame.unionByName, parts).select("h1", "h2", (F.col("n_docs") + F.coalesce("more", F.lit(0))).alias("n_docs"), F.greatest("last_doc", "later").alias("last_doc"))

    def _forget(self, names: list[str]) -> None:
        for name in names:
            path = self.spark.sql(f"DESCRIBE FORMATTED {name}").where("col_name = 'Location'").first()["data_type"]
            self.spark.sql(f"DROP TABLE {name}")
            self.scratch.drop(path)

    def close(self) -> None:
        """Drops the runs."""
        self._forget(self.names())
        self.levels = []


def repeated_lines(lines: DataFrame, scratch: Scratch, min_docs: int) -> DataFrame:
    """(h1, h2, last_doc) of the lines that min_docs documents or more hold, batch by batch through the runs."""
    runs = LineRuns(lines.sparkSession, scratch)
    try:
        for b in range(BATCHES):
            runs.add(lines.where(F.col("__batch") == b))
            runs.compact()
        with _sorted_scans(lines.sparkSession):
            return scratch.keep(runs.counted().where(F.col("n_docs") >= min_docs).select("h1", "h2", "last_doc"), "often")
    finally:
        runs.close()  # so a failed call leaves no tables in the catalog


def _marked(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int) -> DataFrame:
    """The documents with __lines, their lines, and __kept, the places of the lines that stay."""
    scratch = Scratch(docs.sparkSession, "lines")
    batched = long_lines(docs, id_col, text_col, min_chars).withColumn("__batch", F.pmod(F.xxhash64("__doc"), F.lit(BATCHES)).cast("int"))
    lines = scratch.keep(batched, "long", ["__batch"])  # a batch reads its own files
    often = repeated_lines(lines, scratch, min_docs)  # written, so the join has no aggregate below it and may split a hot line
    gone = lines.drop("__batch").join(often, ["h1", "h2"]).where(~F.col("__doc").eqNullSafe(F.col("last_doc")))
    gone = gone.groupBy(F.col("__k1").alias("__g1"), F.col("__k2").alias("__g2")).agg(F.collect_set("__pos").alias("__gone"))  # no more than the lines of a document
    keyed = docs.select("*", *row_key(id_col, text_col))
    out = keyed.join(gone, (F.col("__k1") == F.col("__g1")) & (F.col("__k2") == F.col("__g2")), "left").drop("__k1", "__k2", "__g1", "__g2")
    out = out.withColumn("__lines", F.split(F.coalesce(text_col, F.lit("")), "\n"))
    places = F.sequence(F.lit(0), F.size("__lines") - 1)
    return out.withColumn("__kept", F.when(F.col("__gone").isNull(), places).otherwise(F.array_except(places, "__gone")))


def _joined(text: Column) -> Column:
    rest = let(F.col("__lines"), lambda ls: F.array_join(F.transform("__kept", lambda p: F.get(ls, p)), "\n"))
    return F.when(F.col("__gone").isNull(), F.coalesce(text, F.lit(""))).otherwise(rest)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """The documents, all columns, without the lines that min_docs documents hold, except in the largest id holding it."""
    marked = _marked(docs, id_col, text_col, min_chars, min_docs)
    return marked.withColumn(text_col, F.when(F.col(text_col).isNotNull(), _joined(F.col(text_col)))).select(*[f"`{c}`" for c in docs.columns])


def line_report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Per document: n_lines before dropping, n_dropped, kept_sha256 of what stays."""
    marked = _marked(docs.select(id_col, text_col), id_col, text_col, min_chars, min_docs)
    return marked.select(
        id_col,
        F.size("__lines").cast("long").alias("n_lines"),
        (F.size("__lines") - F.size("__kept")).cast("long").alias("n_dropped"),
        F.sha2(_joined(F.col(text_col)).cast("binary"), 256).alias("kept_sha256"),
    )
