"""The registered queries over the supplied tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .plans import composites, extras, sequences, streams, texts, timed, tracks

_PLANS = (timed, sequences, texts, tracks, composites, streams, extras)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for plan in _PLANS for k, f in plan.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for plan in _PLANS for k, q in plan.SQL.items()}
