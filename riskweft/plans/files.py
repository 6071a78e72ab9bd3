"""Readers and sinks: flat CSV, lenient JSON, schema checks, metrics files, reports, datasets in single files."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from riskweft.operators import instruct, metrics
from riskweft.plans.risk import scored_with_text
from riskweft.plans.sql import sql
from riskweft.schema import FLAT_COLUMNS, TABLES, required, validate
from riskweft.scratch import scratch_path
from riskweft.sources import readers, writers
from riskweft.sources.adapters import environment as env
from riskweft.sources.adapters import table


def flat(s, d):
    """Line items as a flat card table, with an empty amount in some rows and a column of its own."""
    t = table(s, d, "lineitem")
    v = [(F.col("l_partkey") * i % 1000 / 1000.0).alias(f"V{i}") for i in range(1, 29)]
    amount = F.when(F.col("l_linenumber") != 7, F.col("l_extendedprice"))
    return t.select(F.col("l_orderkey").cast("double").alias("Time"), *v, amount.alias("Amount"), (F.col("l_returnflag") == "R").cast("int").alias("Class"), F.col("l_linestatus").alias("note"))


def _flat_csv(s, d):
    folder = f"{scratch_path(s, 'flat')}/csv"
    flat(s, d).write.option("header", True).csv(folder)
    back = readers.read_flat(s, folder)
    return back.groupBy("Class").agg(F.count("*").alias("n"), F.round(F.sum("Amount"), 2).alias("amount"), F.round(F.sum("V28"), 3).alias("v28"), F.min("note").alias("note"))


def _flat_profile(s, d):
    p = readers.profile_flat(flat(s, d).select("Class", "note"))
    return p.select("value", "n", F.round("share", 9).alias("share"), "duplicates")


def _lenient(s, d):
    """Orders as files of all kinds: lines after a bad one, arrays, single objects over several lines; some repeat a key or hold NaN."""
    folder = scratch_path(s, "lenient")
    o = table(s, d, "orders")
    body = F.to_json(F.struct(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s")))
    at = F.pmod(F.col("o_orderkey"), F.lit(20))
    rest = F.expr("substring(body, 2)")
    odd = F.when(F.col("at").isin(3, 13), F.concat(F.lit('{"k": -1, "s": "}", '), rest)).when(F.col("at").isin(5, 14), F.concat(F.lit('{"x": [NaN, -Infinity], '), rest)).otherwise(F.col("body"))
    texts = o.select(at.alias("at"), "o_orderkey", body.alias("body")).withColumn("body", odd).repartition(20, "at")
    lines = texts.where("at < 12").sortWithinPartitions("at", "o_orderkey")
    first = F.row_number().over(Window.partitionBy("at").orderBy("o_orderkey")) == 1
    lines.select("at", F.when(first, F.concat(F.lit("not json\n\n"), F.col("body"))).otherwise(F.col("body")).alias("value")).write.partitionBy("at").text(f"{folder}/lines")
    arrays = texts.where("at BETWEEN 12 AND 18").groupBy("at").agg(F.concat(F.lit("[\n"), F.array_join(F.array_sort(F.collect_list("body")), ",\n"), F.lit("\n]")).alias("value"))
    arrays.write.partitionBy("at").text(f"{folder}/arrays")
    single = texts.where("at = 19").agg(F.concat(F.lit('{\n"orders":'), F.to_json(F.array_sort(F.collect_list("o_orderkey"))), F.lit("\n}")).alias("value"))
    single.coalesce(1).write.text(f"{folder}/single")
    records = readers.read_records(s, folder).select("record")
    read = records.select(F.from_json("record", "k long, s string, orders array<long>").alias("r"))  # takes NaN, as Python does
    return read.select(F.explode(F.coalesce("r.orders", F.array("r.k"))).alias("o_orderkey"), F.coalesce("r.s", F.lit("?")).alias("status"))


def _required(s, d):
    return required(env(s, d)["transactions"], ["txn_id", "amount", "channel"])


def _validated(s, d):
    """Every table passes its check; the columns beyond the contract are named."""
    out = []
    tables = env(s, d)
    for name, fields in TABLES.items():
        extra = validate(tables[name].withColumn("note", F.lit(1)), fields.fieldNames(), "label_fraud" if name == "transactions" else None)
        out.append((name, ",".join(extra)))
    extra = validate(flat(s, d), FLAT_COLUMNS)
    return s.createDataFrame([*out, ("flat", ",".join(extra))], "name string, extra string")


def _counts(s, d):
    labels = table(s, d, "labels").withColumns({"label": F.col("toxic"), "predicted": F.lit(1) - F.col("quality")})
    return metrics.confusion(labels)


def _metrics_file(s, d):
    path = f"{scratch_path(s, 'metrics')}/metrics.json"
    writers.write_metrics(_counts(s, d), path)
    return s.read.schema("tn long, fp long, fn long, tp long").json(path, multiLine=True)


def _report(s, d):
    path = f"{scratch_path(s, 'report')}/report.md"
    writers.write_text(s, path, writers.report("Labels", _counts(s, d).first().asDict()))
    return s.read.text(path).where("value <> ''").select(F.col("value").alias("line"))


def _dataset_sizes(s, d):
    return instruct.build_dataset(scored_with_text(s, d), 50).groupBy("scenario_tag", "split").agg(F.count("*").alias("n"))


def _single_files(s, d):
    folder = scratch_path(s, "dataset")
    o = table(s, d, "part").select("p_partkey", "p_name", F.element_at(F.array(F.lit("train"), F.lit("val"), F.lit("test")), (F.col("p_partkey") % 3 + 1).cast("int")).alias("split"), F.lit(1).alias("_hidden"))
    writers.save_dataset(o, folder, single=True)
    back = s.read.schema("p_partkey long, p_name string, split string, _hidden int").json([f"{folder}/{n}.jsonl" for n in ("train", "val", "test")])
    return back.select("p_partkey", "p_name", "split", F.col("_hidden").isNull().alias("left_out"))


QUERIES = {
    "flat_csv_read": (_flat_csv, "SELECT (l_returnflag = 'R')::INTEGER AS \"Class\", count(*) AS n, round(sum(l_extendedprice), 2) AS amount, round(sum(l_partkey * 28 % 1000 / 1000.0::DOUBLE), 3) AS v28, min(l_linestatus) AS note FROM lineitem WHERE l_linenumber <> 7 GROUP BY ALL"),
    "flat_profile": (
        _flat_profile,
        """SELECT (l_returnflag = 'R')::INTEGER AS value, count(*) AS n, round(count(*)::DOUBLE / sum(count(*)) OVER (), 9) AS share, (sum(count(*)) OVER ())::BIGINT - (SELECT count(*) FROM (SELECT DISTINCT l_returnflag = 'R', l_linestatus FROM lineitem)) AS duplicates FROM lineitem GROUP BY 1""",
    ),
    "lenient_records": (_lenient, "SELECT o_orderkey, CASE WHEN o_orderkey % 20 = 19 THEN '?' ELSE o_orderstatus END AS status FROM orders"),
    "required_columns": (_required, sql("SELECT txn_id, amount, channel FROM tx")),
    "validated_tables": (_validated, "SELECT unnest(['users', 'accounts', 'devices', 'merchants', 'locations', 'account_devices', 'transactions', 'flat']) AS name, 'note' AS extra"),
    "metrics_file": (_metrics_file, "SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tn, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS tp FROM labels"),
    "metrics_report": (
        _report,
        """SELECT unnest(['# Labels', '| metric | value |', '| --- | --- |', '| tn | ' || tn || ' |', '| fp | ' || fp || ' |', '| fn | ' || fn || ' |', '| tp | ' || tp || ' |']) AS line FROM
        (SELECT count(*) FILTER (quality = 1 AND toxic = 0) AS tn, count(*) FILTER (quality = 0 AND toxic = 0) AS fp, count(*) FILTER (quality = 1 AND toxic = 1) AS fn, count(*) FILTER (quality = 0 AND toxic = 1) AS tp FROM labels)""",
    ),
    "instruction_dataset_sizes": (_dataset_sizes, sql("SELECT scenario_tag, unnest(['train', 'val', 'test']) AS split, unnest([40, 5, 5])::BIGINT AS n FROM (SELECT DISTINCT scenario_tag FROM tx)")),
    "dataset_single_files": (_single_files, "SELECT p_partkey, p_name, ['train', 'val', 'test'][p_partkey % 3 + 1] AS split, true AS left_out FROM part"),
}
