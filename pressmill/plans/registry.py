"""The core's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_MODULES = ("pressmill.plans.timestamp_queries", "pressmill.plans.graph_queries", "pressmill.plans.frame_queries", "pressmill.plans.text_queries", "pressmill.plans.topic_queries", "pressmill.plans.stream_queries")


def _all(name: str) -> dict:
    out: dict = {}
    for module in _MODULES:
        try:
            found = import_module(module)
        except ModuleNotFoundError as e:
            if e.name != module:
                raise
            continue
        part = getattr(found, name)()
        if out.keys() & part.keys():
            raise ValueError(f"registered twice: {sorted(out.keys() & part.keys())}")
        out |= part
    return out


def queries() -> dict[str, Query]:
    return _all("queries")


def oracle_sql() -> dict[str, str]:
    return _all("oracle_sql")
