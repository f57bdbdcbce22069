"""Session helpers."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: dict[str, str] = {}


def local_session(cores: str = "*", partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benchmarks; a cluster's session comes from its own submit."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("helixframe")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Give the workers this package, once per application, as ``--py-files`` would."""
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    _SHIPPED[app] = os.path.join(tempfile.mkdtemp(prefix="helixframe-py-"), "helixframe_package.zip")
    with zipfile.ZipFile(_SHIPPED[app], "w") as out:
        for folder, _, names in os.walk(here):
            for name in sorted(names):
                if name.endswith(".py"):
                    at = os.path.join(folder, name)
                    out.write(at, os.path.join("helixframe", os.path.relpath(at, here)))
    spark.sparkContext.addPyFile(_SHIPPED[app])
