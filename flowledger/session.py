"""A session with the settings the operators assume: UTC, adaptive execution."""

from pyspark.sql import SparkSession


def session(name: str = "flowledger", **conf: str) -> SparkSession:
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    return SparkSession.builder.appName(name).config(map=base | conf).getOrCreate()
