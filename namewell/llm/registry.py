"""Queries of the corpus operators, and the SQL of those that SQL expresses."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

_OPS = [
    ("packing", "op1_packing"),
    ("private", "op2_private"),
    ("licences", "op3_licences"),
    ("neighbours", "op4_neighbours"),
    ("piece_bpe", "op5_byte_bpe"),
    ("language", "op6_language"),
    ("near_dup", "op7_near_duplicates"),
    ("media", "op8_media"),
    ("url_filter", "op9_url_filter"),
    ("toxicity", "op10_toxicity"),
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: getattr(import_module(f"{__package__}.{module}"), name) for module, name in _OPS}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module, name in _OPS if (sql := getattr(import_module(f"{__package__}.{module}"), "ORACLE_SQL", None))}
