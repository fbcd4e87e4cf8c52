"""Sessions for the command line and scripts; on a cluster, its own settings win."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "vertexloom", **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in settings.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()
