"""Session settings that the engine's semantics rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Settings that change results; the rest is left to the cluster.
SEMANTICS = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true"}
#: Settings that change plans only.
PLANNING = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def build_session(app: str = "quillon", master: str | None = None, case_sensitive: bool = False, **conf: str) -> SparkSession:
    """A session with the engine's settings; keyword arguments give further Spark settings with ``__`` for dots."""
    builder = SparkSession.builder.appName(app).config(map=SEMANTICS | PLANNING)
    if master:
        builder = builder.master(master)
    if case_sensitive:
        builder = builder.config("spark.sql.caseSensitive", "true")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
