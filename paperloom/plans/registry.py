"""All registered queries: name -> (spark, sf_dir) -> DataFrame, and name -> DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paperloom.plans import aggregates, evaluation, joining, ranking, rows, scoring, sqltext, texts, windows
from paperloom.plans.base import ORACLE, QUERIES

__all__ = ["ORACLE", "QUERIES", "entry"]
_MODULES = (aggregates, evaluation, joining, ranking, rows, scoring, sqltext, texts, windows)


def entry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["h4_related_papers"](spark, sf_dir)
