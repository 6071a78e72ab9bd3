"""Instruction examples from scored transactions, and the evaluation of answers against them."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskweft.functions import scalars as S
from riskweft.functions.text import lenient_json, rules_of_evidence
from riskweft.operators.prepare import tagged_sample, tagged_split

#: The instruction, types of the scenarios, actions of the decisions, answer keys.
INSTRUCTION = "You are a fraud investigation copilot. Given the structured transaction evidence, assess risk, identify fraud type, summarize findings, and recommend an action. Respond with valid JSON containing risk_level, fraud_type, summary, evidence, and recommended_action. Be grounded in the provided evidence and do not invent facts."
LEGITIMATE_TAGS = ("background", "legitimate", "legit")
ACTIONS = {
    "APPROVE": "Approve transaction – no further action required.",
    "STEP_UP": "Require step-up authentication (OTP/biometric).",
    "INVESTIGATE": "Flag for manual investigation.",
    "BLOCK": "Block transaction and freeze account pending review.",
}
EXPECTED_KEYS = ("output", "expected", "response", "label", "target", "ground_truth")
INPUT_KEYS = ("input", "prompt", "instruction", "evidence", "query", "context")
AMOUNT_KEYS = ("transaction_amount", "amount", "amount_x", "amount_y")
MEAN_KEYS = ("historical_average", "historical_avg", "prior_mean_amount", "mean_amount", "avg_amount")
VELOCITY_KEYS = ("recent_transaction_count", "vel_count_300s", "vel_count_3600s", "velocity", "tx_count")
SHARED_KEYS = ("shared_device_accounts", "device_account_count", "shared_device_count")


def fraud_type(tag: Column) -> Column:
    t = F.lower(F.trim(F.coalesce(tag, F.lit("background"))))
    return F.when(t.isin(*LEGITIMATE_TAGS) | (t == ""), "LEGITIMATE").otherwise(F.upper(t))


def action(decision: Column) -> Column:
    return F.when(decision.isNull(), "Review manually.").otherwise(S.mapped(F.upper(decision), ACTIONS, F.concat(F.lit("Decision: "), decision)))


def _n(name: str, digits: int) -> Column:
    return F.round(F.coalesce(S.finite(name), F.lit(0.0)), digits)


def build_examples(scored: DataFrame, evidence: str = "evidence_text") -> DataFrame:
    """(txn_id, scenario_tag, instruction, input, output) from fused rows; input and output are JSON."""
    proof = F.array_distinct(F.when(F.size(evidence) > 0, F.col(evidence)).otherwise(F.col("evidence")))
    count, device = F.coalesce("vel_count_300s", F.lit(0)).cast("int"), F.coalesce("device_account_count", F.lit(1)).cast("int")
    graph = F.struct(device.alias("shared_device_accounts"), _n("graph_score", 4).alias("graph_score"), F.coalesce("prior_unique_countries", F.lit(0)).cast("int").alias("prior_unique_countries"), F.when(count >= 5, count).alias("velocity_5min"))
    given = F.struct(
        _n("amount", 2).alias("transaction_amount"), _n("prior_mean_amount", 2).alias("historical_average"), (F.coalesce("is_new_device", F.lit(0)) == 1).alias("new_device"),
        _n("distance_to_prev_km", 1).alias("location_distance"), count.alias("recent_count"), _n("xgb_score", 4).alias("xgboost_score"), _n("anomaly_score", 4).alias("anomaly_score"),
        rules_of_evidence(F.col("evidence")).alias("triggered_rules"), graph.alias("graph_signals"),
    )
    d = scored.withColumns({"__in": given, "__proof": proof, "__type": fraud_type(F.col("scenario_tag"))})
    x = F.col("__in")
    money, score = lambda c: S.fixed(x[c], 2), lambda c: S.fixed(x[c], 2)
    # fixed values: the two summaries
    legit = F.concat(
        F.lit("Legitimate transaction of $"), money("transaction_amount"), F.lit(" (historical avg $"), money("historical_average"), F.lit("). No strong fraud indicators; recent_count="), x["recent_count"].cast("string"),
        F.lit(", new_device="), F.initcap(x["new_device"].cast("string")), F.lit(", distance="), S.fixed(x["location_distance"], 0), F.lit("km. Scores xgb="), score("xgboost_score"), F.lit(" anomaly="), score("anomaly_score"), F.lit(". Risk "), F.col("risk_level"), F.lit("."),
    )
    snippet = F.when(F.size("__proof") > 0, F.array_join(F.slice("__proof", 1, 3), "; ")).otherwise("no additional evidence")
    suspected = F.concat(
        F.initcap(F.replace("__type", F.lit("_"), F.lit(" "))), F.lit(" suspected: amount $"), money("transaction_amount"), F.lit(" vs avg $"), money("historical_average"), F.lit(", new_device="), F.initcap(x["new_device"].cast("string")),
        F.lit(", distance "), S.fixed(x["location_distance"], 0), F.lit("km, recent_count "), x["recent_count"].cast("string"), F.lit(", xgb "), score("xgboost_score"), F.lit(" anomaly "), score("anomaly_score"), F.lit(". Evidence: "), snippet, F.lit(". Risk "), F.col("risk_level"), F.lit("."),
    )
    answer = F.struct(F.col("risk_level"), F.col("__type").alias("fraud_type"), F.when(F.col("__type") == "LEGITIMATE", legit).otherwise(suspected).alias("summary"), F.col("__proof").alias("evidence"), action(F.col("decision")).alias("recommended_action"))
    return d.select("txn_id", "scenario_tag", F.lit(INSTRUCTION).alias("instruction"), F.to_json("__in").alias("input"), F.to_json(answer).alias("output"))


def build_dataset(scored: DataFrame, per_tag: int, seed: int = 42, evidence: str = "evidence_text") -> DataFrame:
    """per_tag examples of each scenario tag, split 80/10/10 by tag."""
    examples = tagged_sample(build_examples(scored, evidence), "scenario_tag", "txn_id", per_tag, seed)
    keyed = examples.withColumn("__key", F.concat_ws("-", "txn_id", "copy"))
    return tagged_split(keyed, "scenario_tag", "__key", seed).drop("__key", "copy")


def json_field(record: Column, names: tuple[str, ...]) -> Column:
    """The first of the named fields that a JSON record has, as text."""
    return F.coalesce(*[F.get_json_object(record, f"$.{n}") for n in names])


def resolve(records: DataFrame, record: str = "record") -> DataFrame:
    """Adds input and expected, found under any of their names in a JSON record."""
    whole = F.when(json_field(F.col(record), ("risk_level", "fraud_type")).isNotNull(), F.col(record)).otherwise("{}")
    return records.withColumns({"input": F.coalesce(json_field(F.col(record), INPUT_KEYS), F.col(record)), "expected": F.coalesce(json_field(F.col(record), EXPECTED_KEYS), whole)})


def mock_answer(given: Column) -> Column:
    """Struct risk_level, fraud_type: what an ordered list of simple tests makes of JSON evidence."""
    number = lambda *names: F.coalesce(*[F.get_json_object(given, f"$.{n}").try_cast("double") for n in names], F.lit(0.0))
    truth = lambda *names: F.coalesce(*[F.get_json_object(given, f"$.{n}").isin("true", "1", "1.0") for n in names], F.lit(False))
    amount, mean, velocity = number(*AMOUNT_KEYS), number(*MEAN_KEYS), number(*VELOCITY_KEYS)
    shared = F.greatest(number("graph_signals.shared_device_accounts", "graph_signals.shared_device_count"), *[number(k) for k in SHARED_KEYS])
    xgb, anomaly, distance = number("xgboost_score", "xgb_score"), number("anomaly_score"), number("location_distance_km", "distance_km")
    rules = F.upper(F.coalesce(F.get_json_object(given, "$.triggered_rules"), F.get_json_object(given, "$.rules"), F.lit("")))
    verdict = lambda level, kind: F.struct(F.lit(level).alias("risk_level"), F.lit(kind).alias("fraud_type"))
    return (
        F.when((shared >= 3) | rules.contains("SHARED") | rules.contains("DEVICE_SHARING"), verdict("HIGH", "DEVICE_COMPROMISE"))
        .when(truth("new_device", "is_new_device") & (amount > 1000), verdict("HIGH", "ACCOUNT_TAKEOVER"))
        .when((mean > 0) & (amount > 3 * mean), verdict("HIGH", "UNUSUAL_AMOUNT"))
        .when((velocity >= 5) | rules.contains("VELOCITY"), verdict("HIGH", "VELOCITY_ABUSE"))
        .when((xgb > 0.7) | (anomaly > 0.7), verdict("HIGH", "ACCOUNT_TAKEOVER"))
        .when((distance > 300) | truth("unusual_location"), verdict("MEDIUM", "UNUSUAL_LOCATION"))
        .when((velocity >= 2) | (xgb > 0.4), verdict("MEDIUM", "VELOCITY_ABUSE"))
        .when((mean > 0) & (amount > 1.5 * mean), verdict("MEDIUM", "UNUSUAL_AMOUNT"))
        .otherwise(verdict("LOW", "LEGITIMATE"))
    )


def _rates(levels: Mapping[str, str] | None = None, answer: str = "answer") -> dict[str, Column]:
    """The aggregates of accuracy by name."""
    want = lambda c: F.upper(F.trim(F.coalesce(F.get_json_object("expected", f"$.{c}"), F.lit(""))))
    risk = S.mapped(want("risk_level"), levels or {}, want("risk_level")) if levels else want("risk_level")
    kind = want("fraud_type")
    right = lambda c, x: F.coalesce(F.col(f"{answer}.{c}") == x, F.lit(False))
    risk_ok, kind_ok = right("risk_level", risk), right("fraud_type", kind)
    rate = lambda c: F.coalesce(F.avg(c.cast("double")), F.lit(0.0))
    return {
        "n_total": F.count("*"),
        "n_valid": F.count(answer),
        "json_valid_rate": rate(F.col(answer).isNotNull()),
        "risk_level_accuracy": rate((risk == "") | risk_ok),
        "fraud_type_accuracy": rate((kind == "") | kind_ok),
        "exact_match_rate": rate((risk != "") & (kind != "") & risk_ok & kind_ok),
    }


def accuracy(df: DataFrame, levels: Mapping[str, str] | None = None) -> DataFrame:
    """One row of rates from expected (JSON) and answer (struct). levels maps other level names to the answer's.

    A value that is not expected counts as right, a null answer as wrong where one is; an exact match needs both values
    expected and right.
    """
    return df.agg(*[c.alias(n) for n, c in _rates(levels).items()])


RATES = ("json_valid_rate", "risk_level_accuracy", "fraud_type_accuracy", "exact_match_rate")


def compare(base: DataFrame, tuned: DataFrame) -> DataFrame:
    """(metric, base, tuned, delta) of two rows of rates. Both must be measured."""
    long = lambda df, out: df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).alias(out)) for n in RATES])).alias("x")).select("x.*")
    return long(base, "base").join(long(tuned, "tuned"), "metric").withColumn("delta", F.col("tuned") - F.col("base"))


def compare_answers(df: DataFrame, base: str, tuned: str, levels: Mapping[str, str] | None = None) -> DataFrame:
    """What compare gives of the rates of two answers (structs) to the same records, which are read and parsed once."""
    one = df.agg(*[_rates(levels, answer)[n].alias(f"{side}_{n}") for side, answer in (("base", base), ("tuned", tuned)) for n in RATES])
    rows = F.array(*[F.struct(F.lit(n).alias("metric"), F.col(f"base_{n}").alias("base"), F.col(f"tuned_{n}").alias("tuned")) for n in RATES])
    return one.select(F.explode(rows).alias("x")).select("x.*").withColumn("delta", F.col("tuned") - F.col("base"))


def model_answers(records: DataFrame, answer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Records with the answers of a language model, which the caller gives: it adds `text`. Without one, the row
    (skipped, reason) says so; nothing is made up."""
    if answer is None:
        return records.sparkSession.createDataFrame([(True, "no model is given")], "skipped boolean, reason string")
    text = lenient_json(F.col("text"))
    found = F.struct(F.upper(F.get_json_object(text, "$.risk_level")).alias("risk_level"), F.upper(F.get_json_object(text, "$.fraud_type")).alias("fraud_type"))
    return answer(records).withColumn("answer", F.when(text.isNotNull(), found))
