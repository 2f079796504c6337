"""The queries of this subpackage: name to (query, oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

#: Query name to the module of this package that holds ``query(spark, sf_dir)`` and ``SQL``.
MODULES = {
    "op1_toxicity": "toxicity_query",
    "op2_licenses": "licenses_query",
    "op3_packing": "packing_query",
    "op4_langid": "langid_query",
    "op5_media": "media_query",
    "op6_warc": "warc_query",
    "op7_jaccard": "jaccard_query",
    "op8_decontaminate": "decontaminate_query",
    "op9_pii": "pii_query",
    "op10_render": "render_query",
    "op11_whitening": "whitening_query",
    "op12_minhash": "minhash_query",
    "op13_vectorcodes": "vectorcodes_query",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: import_module(f"{__package__}.{module}").query for name, module in MODULES.items()}


def oracle_sql() -> dict[str, str]:
    found = {name: import_module(f"{__package__}.{module}").SQL for name, module in MODULES.items()}
    return {name: sql for name, sql in found.items() if sql}
