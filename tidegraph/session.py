"""Session helpers: settings for graph loops, and shipping this package to Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def session(app: str = "tidegraph", **conf: str) -> SparkSession:
    """A session with the settings this package is written for; a cluster's own settings are kept."""
    builder = SparkSession.builder.appName(app).config("spark.sql.adaptive.enabled", "true").config("spark.sql.session.timeZone", "UTC")
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, wherever the driver has it from. Once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="tidegraph-")
    target = os.path.join(folder, "tidegraph_package.zip")
    with zipfile.ZipFile(target, "w") as z:
        for root, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(root, name)
                    z.write(full, os.path.join("tidegraph", os.path.relpath(full, here)))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)
