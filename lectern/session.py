"""A session with the settings the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession

from .shipping import ship


def session(app: str = "lectern", **settings: str) -> SparkSession:
    """The current session or a new one; UTC, adaptive plans, skewed joins split."""
    b = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for k, v in settings.items():
        b = b.config(k.replace("__", "."), v)
    return ship(b.getOrCreate())
