"""Session helpers: a local session for tests and benches, and the package on every worker."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable on the workers: once an application, as a zip file."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parent
    fd, name = tempfile.mkstemp(prefix=f"{root.name}-", suffix=".zip")
    os.close(fd)
    with zipfile.ZipFile(name, "w") as out:
        for p in sorted(root.rglob("*.py")):
            out.write(p, str(p.relative_to(root.parent)))
    spark.sparkContext.addPyFile(name)
    _shipped.add(app)


def local(cpus: int | str = "*", partitions: int = 8, memory: str = "8g", **conf: str) -> SparkSession:
    """A local session with this library's defaults."""
    build = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", partitions)
    settings = {
        "spark.driver.memory": memory, "spark.ui.enabled": "false", "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.ui.showConsoleProgress": "false",
    }
    spark = build.config(map=settings | conf).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    return spark
