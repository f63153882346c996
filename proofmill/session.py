"""Session settings the library relies on; a cluster's own settings are kept."""

from __future__ import annotations

from pyspark.sql import SparkSession


def configure(spark: SparkSession) -> SparkSession:
    for key, value in {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        # A union of differently partitioned parts must not be taken for one partitioning (it fails at run time when parts are coalesced).
        "spark.sql.unionOutputPartitioning": "false",
    }.items():
        spark.conf.set(key, value)
    return spark
