"""A session with the settings that the library assumes."""

from pyspark.sql import SparkSession


def session(name: str = "harrow", **more: str) -> SparkSession:
    """UTC everywhere, adaptive plans; `more` adds or replaces settings (dots written as __)."""
    b = SparkSession.builder.appName(name).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in more.items():
        b = b.config(k.replace("__", "."), v)
    return b.getOrCreate()
