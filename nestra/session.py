"""A session with the settings the array operators assume."""

from pyspark.sql import SparkSession


def session(app: str = "nestra", **conf: str) -> SparkSession:
    """ANSI mode is off, as 64-bit integers wrap and division follows IEEE; AQE splits skewed joins."""
    build = SparkSession.builder.appName(app).config("spark.sql.ansi.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")
    for k, v in conf.items():
        build = build.config(k.replace("__", "."), v)
    return build.getOrCreate()
