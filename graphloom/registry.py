"""All registered queries of the engine's own operators, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Modules with QUERIES (name: function of (spark, sf_dir)) and ORACLES (name: DuckDB SQL).
MODULES: tuple[str, ...] = tuple(f"graphloom.plans.q_{n}" for n in ("filters", "joins", "sets", "aggregates", "windows", "text", "training", "retrieval", "graph", "sources", "pipeline"))


def _merged(what: str) -> dict:
    out: dict = {}
    for name in MODULES:
        for k, v in getattr(importlib.import_module(name), what).items():
            if k in out:
                raise ValueError(f"{k} is registered twice")
            out[k] = v
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return _merged("QUERIES")


def oracle_sql() -> dict[str, str]:
    return _merged("ORACLES")
