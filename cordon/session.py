"""Session settings that the operators count on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: UTC throughout (local hours are derived by name of zone), adaptive plans with skew handling, Arrow for grouped pandas functions.
CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str = "local[*]", app: str = "cordon", **more: str) -> SparkSession:
    return SparkSession.builder.master(master).appName(app).config(map=CONF | more).getOrCreate()
