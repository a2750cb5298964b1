"""Session helper for scripts, tests and benchmarks; on a cluster the caller brings its own session."""

from __future__ import annotations

import os
import sys

from pyspark.sql import SparkSession


def local_session(cores: int | str = "*", name: str = "siftwork", **conf: str) -> SparkSession:
    """A UTC session in local mode with adaptive execution; conf overrides single settings."""
    os.environ.setdefault("PYSPARK_PYTHON", sys.executable)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": "8",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    builder = SparkSession.builder.master(f"local[{cores}]").appName(name)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()
