"""A session with the settings this engine expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "sparkmend", master: str | None = None, shared: str | None = None, **conf: str) -> SparkSession:
    """Adaptive plans with skew joins, Arrow transfer and UTC; other settings by keyword, dots written as two underscores.

    `shared` is a folder that driver and executors share, for tables in between (spark.checkpoint.dir).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.showConsoleProgress": "false",
    } | ({"spark.checkpoint.dir": shared} if shared else {}) | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()
