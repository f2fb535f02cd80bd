"""A session with the settings that the plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Calls cost money: no speculative second run of a task that makes them.
CONF = {
    "spark.speculation": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(name: str = "tagmill", **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for k, v in (CONF | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()
