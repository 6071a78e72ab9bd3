"""Readers with explicit schemas."""

from __future__ import annotations

import json
from pathlib import Path
from typing import Any

import pandas as pd
import yaml
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType
from pyspark.sql.utils import AnalysisException

from riskweft.schema import FLAT, FLAT_COLUMNS, TABLES, schema, validate
from riskweft.scratch import kept
from riskweft.session import ship

EXAMPLE = schema("instruction string, input string, output string, split string")


def exists(spark: SparkSession, path: str) -> bool:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)


def config(*paths: str) -> dict[str, Any]:
    """The first YAML file among paths that there is, else {}."""
    for p in paths:
        if Path(p).is_file():
            return yaml.safe_load(Path(p).read_text()) or {}
    return {}


def read_flat(spark: SparkSession, path: str, expected: list[str] | None = None, target: str = "Class") -> DataFrame:
    """The flat card table from CSV: validated, rows with nulls dropped."""
    if not exists(spark, path):
        raise FileNotFoundError(path)
    header = spark.read.option("header", True).csv(path).columns
    kinds = {f.name: f for f in FLAT.fields}
    fields = StructType([kinds.get(c, StructField(c, StringType())) for c in header])
    df = spark.read.option("header", True).schema(fields).csv(path)
    validate(df, expected or FLAT_COLUMNS, target)
    return df.na.drop("any")


def profile_flat(df: DataFrame, target: str = "Class") -> DataFrame:
    """(value, n, share) of the target, with the table's duplicates and nulls."""
    n = df.agg(F.count("*").alias("rows"), F.count_distinct(F.struct(*df.columns)).alias("distinct_rows"))
    per = df.groupBy(F.col(target).alias("value")).agg(F.count("*").alias("n"))
    return per.join(F.broadcast(n)).select("value", "n", (F.col("n") / F.col("rows")).alias("share"), (F.col("rows") - F.col("distinct_rows")).alias("duplicates"))  # n is one row


def read_environment(spark: SparkSession, folder: str, fmt: str = "parquet") -> dict[str, DataFrame]:
    """The seven tables from `<folder>/<table>.<fmt>`."""
    reader = lambda s: spark.read.schema(s).option("header", True) if fmt == "csv" else spark.read.schema(s)
    return {name: getattr(reader(fields), fmt)(f"{folder}/{name}.{fmt}") for name, fields in TABLES.items()}


def read_examples(spark: SparkSession, path: str, schema: StructType = EXAMPLE) -> DataFrame:
    """JSON lines from a file or a folder; blank lines are skipped, a bad one fails the read."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def _standard(text: str) -> list[str] | None:
    """[text] if it is a JSON value, with the last of repeated keys and NaN and infinities as Python writes them; else None."""
    odd = []

    def members(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
        found = dict(pairs)
        if len(found) < len(pairs):
            odd.append(1)
        return found

    def constant(name: str) -> float:
        odd.append(1)
        return float(name)

    try:
        value = json.loads(text, object_pairs_hook=members, parse_constant=constant)
    except (ValueError, RecursionError):
        return None
    return [json.dumps(value) if odd else text]


@F.pandas_udf(StringType())
def _value(lines: pd.Series) -> pd.Series:
    """Each line as a JSON value, null if it is none."""
    return lines.map(lambda x: (_standard(x) or [None])[0])


@F.pandas_udf(ArrayType(StringType()))
def _items(texts: pd.Series, of_array: pd.Series, first: pd.Series, last: pd.Series) -> pd.Series:
    """The values in one cut of a file; null if the file can't be what it seemed to be."""

    def one(text: str, of_array: bool, first: bool, last: bool) -> list[str] | None:
        body = text.strip(" \t\r\n")
        if not of_array:
            return _standard(body) if first else [] if not body else None
        if last:
            if not body.endswith("]"):
                return None
            body = body[:-1].rstrip(" \t\r\n")
        if first or body:
            if body[:1] != ("[" if first else ","):
                return None
            body = body[1:].strip(" \t\r\n")
            if not body and not (first and last):
                return None
        if _standard(f"[{body}]") is None:
            return None
        out, at, read = [], 0, json.JSONDecoder()
        while at < len(body):
            end = read.raw_decode(body, at)[1]
            out += _standard(body[at:end])
            at = end + len(body[end:]) - len(body[end:].lstrip(" \t\r\n,"))
        return out

    return pd.Series([one(*row) for row in zip(texts, of_array, first, last, strict=True)])


def _depth(text: Column) -> Column:
    """Brackets that the text opens less those that it closes, outside strings; it has no escapes and begins outside."""
    clean = F.regexp_replace(F.regexp_replace(text, '"[^"]*"', ""), '"[^"]*$', "")
    return F.length(F.translate(clean, "]}", "")) - F.length(F.translate(clean, "[{", ""))


def _before(total: Column, by: list[str], order: str) -> Column:
    return F.coalesce(F.sum(total).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def _cut(spark: SparkSession, files: list[str]) -> DataFrame:
    """(__file, values array<string>): the cuts of files that are one array or one object, null where a file is neither.

    A file is read in splits, as the texts between closing braces. Whether such a piece begins within a string, and how
    deep its end lies, follows from prefix sums over the pieces of a split, for either beginning, and over the splits; so
    no task reads a whole file. A cut ends at each brace that closes an item of the array, or the object.
    """
    pieces = spark.read.option("lineSep", "}").text(files)
    pieces = pieces.select("value", F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("block"), F.col("_metadata.file_size").alias("bytes"), F.monotonically_increasing_id().alias("id"))
    pieces = kept(pieces, "pieces")
    of_file = pieces.groupBy("__file").agg(F.max_by("id", F.struct("block", "id")).alias("last"), (F.sum(F.octet_length("value") + 1) == F.max("bytes")).alias("closed"), F.min_by(F.substring(F.ltrim("value"), 1, 1), F.struct("block", "id")).alias("opens"))
    of_file = kept(of_file.withColumn("base", (F.col("opens") == "[").cast("int")), "files").withColumnRenamed("__file", "__f")
    p = pieces.join(of_file, F.col("__file") == F.col("__f")).drop("__f").withColumn("brace", (F.col("id") != F.col("last")) | F.col("closed"))
    bare = F.regexp_replace("value", r"(?s)\\.", "")
    p = p.withColumn("quotes", F.length(bare) - F.length(F.replace(bare, F.lit('"'), F.lit(""))))
    even, closing = F.col("quotes") % 2 == 0, F.col("brace").cast("int")
    outside = _depth(bare) - F.when(even, closing).otherwise(0)
    inside = F.when(F.col("quotes") == 0, 0).otherwise(_depth(F.regexp_replace(bare, '^[^"]*"', "")) - F.when(even, 0).otherwise(closing))
    p = p.withColumns({"outside": outside, "inside": inside}).withColumn("turn", _before(F.col("quotes"), ["__file", "block"], "id") % 2)
    a, b = F.when(F.col("turn") == 0, F.col("outside")).otherwise(F.col("inside")), F.when(F.col("turn") == 0, F.col("inside")).otherwise(F.col("outside"))
    own = ["__file", "block"]
    p = kept(p.withColumns({"a": _before(a, own, "id") + a, "b": _before(b, own, "id") + b, "step_a": a, "step_b": b}), "pieces")

    on = lambda left, right: left.join(right.withColumnsRenamed({"__file": "__f", "block": "__b"}), (F.col("__file") == F.col("__f")) & (F.col("block") == F.col("__b"))).drop("__f", "__b")
    splits = p.groupBy(*own).agg(F.sum("quotes").alias("q"), F.sum("step_a").alias("sa"), F.sum("step_b").alias("sb"))
    splits = splits.withColumn("begins", _before(F.col("q"), ["__file"], "block") % 2)  # a row a split
    splits = splits.withColumn("under", _before(F.when(F.col("begins") == 0, F.col("sa")).otherwise(F.col("sb")), ["__file"], "block"))
    p = on(p, splits.select(*own, "begins", "under"))
    p = p.withColumns({"depth": F.col("under") + F.when(F.col("begins") == 0, F.col("a")).otherwise(F.col("b")), "in_string": (F.col("begins") + F.col("turn") + F.col("quotes")) % 2 == 1})
    p = p.withColumn("ends", (F.col("brace") & ~F.col("in_string") & (F.col("depth") == F.col("base"))).cast("int"))
    p = kept(p.select("__file", "block", "id", "value", "brace", "base", "last", "depth", "in_string", "ends", _before(F.col("ends"), own, "id").alias("cut")), "pieces")

    final = F.col("id") == F.col("last")
    sound = p.groupBy("__file").agg(F.max(F.when(final, (F.col("depth") == 0) & ~F.col("in_string"))).alias("whole"), F.min(F.when(~final, F.col("depth"))).alias("least"), F.sum("ends").alias("cuts"), F.max("base").alias("base"))
    sound = sound.select("__file", (F.col("whole") & F.when(F.col("base") == 1, F.coalesce(F.col("least") >= 1, F.lit(True))).otherwise(F.col("cuts") == 1)).alias("sound"))
    sound = kept(sound, "sound").withColumnRenamed("__file", "__g")
    counts = p.groupBy(*own).agg(F.sum("ends").alias("n"))
    p = on(p, counts.select(*own, _before(F.col("n"), ["__file"], "block").alias("cuts_before"))).join(sound, F.col("__file") == F.col("__g")).drop("__g")
    piece = F.struct("block", "id", F.concat("value", F.when(F.col("brace"), "}").otherwise("")).alias("text"))
    cuts = p.where("sound").groupBy("__file", "base", (F.col("cuts_before") + F.col("cut")).alias("number")).agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.max(final).alias("last"))  # of one item
    items = _items(F.array_join("pieces.text", ""), F.col("base") == 1, F.col("number") == 0, "last")
    # a file whose last piece closes the last item ends without its bracket, which the depth tells, or is an object
    return cuts.select("__file", items.alias("values")).unionByName(p.where("NOT sound").select("__file").distinct().withColumn("values", F.lit(None).cast("array<string>")))


def read_records(spark: SparkSession, path: str, limit: int | None = None, any_value: bool = False) -> DataFrame:
    """(record): the JSON objects of a file or of each file in a folder and below it; none if the path is missing.

    Each file is taken for itself: as an array of objects, as a single object, or else as lines, bad ones skipped. What
    counts as JSON is what Python's parser takes: of repeated keys the last holds, NaN and infinities are numbers; such
    records are written anew, the others keep their text. Records stay JSON, since their fields differ. Files that begin
    with `[`, or with a `{` that its line doesn't close, are cut at the borders of their items, in splits; all others are
    read line by line. any_value: items and lines that are no objects count, too.
    """
    empty, trimmed = spark.createDataFrame([], "record string"), F.btrim("value", F.lit(" \t\r\n"))
    ship(spark)
    try:
        if not exists(spark, path):
            return empty
        lines = spark.read.option("recursiveFileLookup", True).text(path).where(trimmed != "").select(trimmed.alias("value"), F.col("_metadata.file_path").alias("__file"), F.col("_metadata.file_block_start").alias("__start"))
        first = lines.where("__start = 0").withColumn("__at", F.monotonically_increasing_id()).groupBy("__file").agg(F.min_by("value", "__at").alias("value"))
        begins = F.col("value").startswith("[") | (F.col("value").startswith("{") & F.col("parsed").isNull())
        large = [r["__file"] for r in first.withColumn("parsed", _value("value")).where(begins).select("__file").collect()]  # names of files
    except AnalysisException:
        return empty
    wanted = F.col("record").isNotNull() if any_value else F.ltrim("record").startswith("{")
    if large:
        cuts = kept(_cut(spark, large), "cuts")
        whole = kept(cuts.groupBy("__file").agg(F.bool_and(F.col("values").isNotNull()).alias("whole")).where("whole").select("__file"), "whole")
        of_whole = cuts.join(whole, "__file", "left_semi").select(F.explode("values").alias("record"))
        out = lines.join(whole, "__file", "left_anti").select(_value("value").alias("record")).unionByName(of_whole)
    else:
        out = lines.select(_value("value").alias("record"))
    out = out.where(wanted)
    return out.limit(limit) if limit is not None else out
