"""Sessions for the engine: ANSI arithmetic, UTC, adaptive execution."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that results depend on; the rest is the cluster's choice.
SEMANTICS = {"spark.sql.ansi.enabled": "true", "spark.sql.session.timeZone": "UTC"}
#: Settings that let Spark re-plan by what it measures: partition counts, skewed joins, join kinds.
ADAPTIVE = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def session(master: str | None = None, name: str = "cairn", **conf: str) -> SparkSession:
    """A session with the engine's settings; ``conf`` keys use underscores for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    for key, value in {**SEMANTICS, **ADAPTIVE, **{k.replace("_", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
