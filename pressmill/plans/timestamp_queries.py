"""Query of the timestamp operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from pressmill.operators.timestamps import normalise_timestamps
from pressmill.sources.tables import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    known = normalise_timestamps(table(spark, d, "article_raw"), table(spark, d, "feed_sources"))
    return known.where("raw_id IS NOT NULL AND utc_ms IS NOT NULL").select("raw_id", "utc_ms").distinct()


def queries() -> dict:
    return {"p3_found": p3_found}


def oracle_sql() -> dict[str, str]:
    return {}
