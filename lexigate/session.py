"""Session factory with the settings that the engine's plans expect."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def session(name: str = "lexigate", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; shuffle partitions follow the environment."""
    builder = (
        SparkSession.builder.appName(name)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.shuffle.partitions", os.environ.get("LEXIGATE_SHUFFLE_PARTITIONS", "200"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
