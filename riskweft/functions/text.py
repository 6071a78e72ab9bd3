"""Text and JSON expressions: lenient JSON, chat records, evidence prefixes."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Beginnings of evidence entries and the rules that they stand for, in order of precedence.
EVIDENCE_RULES = {
    "high_velocity": "HIGH_VELOCITY", "burst_velocity": "BURST_VELOCITY", "shared_device": "SHARED_DEVICE", "new_device": "NEW_DEVICE",
    "unusual_location": "UNUSUAL_LOCATION", "country_switch": "COUNTRY_SWITCH", "unusual_amount": "UNUSUAL_AMOUNT",
    "offhours": "OFFHOURS_HIGH_VALUE", "graph_risk": "GRAPH_RISK", "ml_flagged": "ML_FLAGGED", "anomalous": "ANOMALOUS_PATTERN",
    "elevated_risk": "ELEVATED_RISK", "new_user": "NEW_USER",
}


def rules_of_evidence(evidence: Column) -> Column:
    """Sorted distinct rule names behind evidence entries."""

    def name(e: Column) -> Column:
        out = F.when(e.startswith("rule:"), F.upper(F.trim(F.substr(e, F.lit(6)))))
        for start, rule in EVIDENCE_RULES.items():
            out = out.when(F.lower(e).startswith(start), rule)
        return out

    return F.array_sort(F.array_distinct(F.array_compact(F.transform(evidence, name))))


def valid_json(text: Column) -> Column:
    """The text if it is a JSON object, else null."""
    return F.when(F.try_parse_json(text).isNotNull() & F.ltrim(text).startswith("{"), text)


def lenient_json(text: Column) -> Column:
    """The JSON object in an answer: as it is, within a fence, from the first to the last brace, or so without trailing commas."""
    fenced = F.regexp_extract(text, r"(?is)```(?:json)?\s*(.*?)\s*```", 1)
    braced = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    return F.coalesce(valid_json(text), valid_json(fenced), valid_json(braced), valid_json(F.regexp_replace(braced, r",\s*([}\]])", "$1")))


#: The prompt around evidence.
PROMPT = (
    "You are a fraud investigation copilot. Given the structured fraud evidence below, output ONLY valid JSON with keys: risk_level, fraud_type, summary, evidence, recommended_action.\n"
    "risk_level must be one of LOW, MEDIUM, HIGH (or GREEN, YELLOW, RED).\n"
    "fraud_type examples: LEGITIMATE, ACCOUNT_TAKEOVER, VELOCITY_ABUSE, UNUSUAL_LOCATION, UNUSUAL_AMOUNT, DEVICE_COMPROMISE, MULE_ACCOUNT, MERCHANT_ANOMALY, COORDINATED_ACTIVITY.\n"
    "Evidence:\n",
    "\nRespond with JSON only:",
)


def prompt(evidence: Column) -> Column:
    return F.concat(F.lit(PROMPT[0]), evidence, F.lit(PROMPT[1]))


def chat_text(messages: Column) -> Column:
    """`role: content` lines of an array of (role, content)."""
    return F.array_join(F.transform(messages, lambda m: F.concat(F.coalesce(m["role"], F.lit("user")), F.lit(": "), F.coalesce(m["content"], F.lit("")))), "\n")


def record_text(fields: Mapping[str, Column], max_len: int | None = 512) -> Column:
    """A training record as text: the first pair of fields that it has, else its text, else its messages; 4 max_len characters, or all if max_len is None."""
    options = []
    for a, b in (("prompt", "completion"), ("instruction", "output"), ("input", "output"), ("question", "answer")):
        if a in fields and b in fields:
            options.append(F.when(fields[a].isNotNull() & fields[b].isNotNull(), F.concat(fields[a], F.lit("\n"), fields[b])))
    if "text" in fields:
        options.append(fields["text"])
    if "messages" in fields:
        options.append(F.when(fields["messages"].isNotNull(), chat_text(fields["messages"])))
    whole = F.coalesce(*options, F.lit(""))
    return whole if max_len is None else F.substring(whole, 1, 4 * max_len)


def checkpoint_step(name: Column) -> Column:
    """Number of a `checkpoint-N` folder, null for other names."""
    return F.regexp_extract(name, r"checkpoint-(\d+)$", 1).try_cast("long")
