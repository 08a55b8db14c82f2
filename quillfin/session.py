"""Session settings that the operators assume."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "quillfin", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by name."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        b = b.config(k, v)
    return b.getOrCreate()
