"""The registered queries of this subpackage, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Query name to the module that applies it; each module has query(spark, sf_dir) and, if SQL can express it, ORACLE_SQL.
MODULES = {
    "op1_bpe": "q_bpe",
    "op2_quality_rules": "q_quality",
    "op3_line_dedup": "q_lines",
    "op4_quality_classifier": "q_ordinal",
    "op5_url_filters": "q_urls",
    "op6_mixing": "q_mixing",
    "op7_minhash": "q_minhash",
    "op8_sharding": "q_sharding",
    "op9_neighbours": "q_neighbours",
    "op10_toxicity": "q_toxicity",
    "op11_centroids": "q_centroids",
    "op12_whitening": "q_whitening",
    "op13_packing": "q_packing",
}


def _call(module: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return importlib.import_module(f"{__package__}.{module}").query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _call(module) for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    loaded = {name: importlib.import_module(f"{__package__}.{module}") for name, module in MODULES.items()}
    return {name: module.ORACLE_SQL for name, module in loaded.items() if getattr(module, "ORACLE_SQL", None)}
