"""Spark sessions, and the package's way to the executors."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def build_session(master: str = "local[*]", partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings that the package is tested with."""
    builder = SparkSession.builder.master(master).appName("ledgerloom")
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
    }
    for k, v in (settings | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> SparkSession:
    """Give the executors' Python workers this package, once for each application."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        here = pathlib.Path(__file__).parent
        path = pathlib.Path(tempfile.mkdtemp()) / "ledgerloom.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in here.rglob("*.py"):
                z.write(p, p.relative_to(here.parent))
        context.addPyFile(str(path))
        _SHIPPED.add(context.applicationId)
    return spark
