"""Helpers shared by the operators."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickscope.session import materialize

__all__ = ["broadcast_checked", "fresh", "materialize", "once_per_worker", "ship", "table", "word_separators"]

#: Rows up to which a side may be broadcast (a few long columns each: tens of MB at most).
BROADCAST_ROWS = 1_000_000


def ship(module_name: str) -> None:
    """Pickle a module's functions by value, so executors need not have this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module_name])


def once_per_worker(key: tuple, make: Callable[[], object]):
    """``make()``, kept under ``key`` for all later tasks of this Python worker.  (A module
    pickled by value is a new one in each task, so its own globals don't last.)"""
    kept = sys.modules.setdefault("_llm_worker", types.ModuleType("_llm_worker")).__dict__
    if key not in kept:
        kept[key] = make()
    return kept[key]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def broadcast_checked(df: DataFrame, limit: int = BROADCAST_ROWS, weight: Column | None = None) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows; beyond that without,
    and Spark shuffles the join.  ``df`` should be stored or cheap: it is counted.  Rows
    that hold arrays count as 1 + ``weight`` (their elements)."""
    rows = df.count() if weight is None else df.agg(F.sum(1 + F.coalesce(weight, F.lit(0)))).first()[0] or 0
    return F.broadcast(df) if rows <= limit else df


def word_separators(text: Column, pattern: str) -> Column:
    """Words between runs of ``pattern`` (a Java character class), A-Z lower-cased;
    null has none."""
    lowered = F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.array_remove(F.split(lowered, pattern), "")


ship(__name__)
