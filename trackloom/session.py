"""Session construction for local runs; on a cluster the caller's own session is used as it is."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def local_session(cores: int | None = None, **extra: str) -> SparkSession:
    """A local session with the settings every query expects: UTC, AQE, few shuffle partitions."""
    n = cores or int(os.environ.get("BENCH_CPUS", "8"))
    builder = (
        SparkSession.builder.master(f"local[{n}]")
        .appName("trackloom")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call site captured per column expression
        .config("spark.driver.memory", os.environ.get("TRACKLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    for key, value in extra.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Give executors this package, once an application: they needn't have it installed or see the driver's folders."""
    app = spark.sparkContext.applicationId
    if app not in _SHIPPED:
        _SHIPPED.add(app)
        root = Path(__file__).parent
        path = Path(tempfile.mkdtemp(prefix="trackloom-code-"), "trackloom.zip")
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f"{root.name}/{f.relative_to(root)}")
        spark.sparkContext.addPyFile(str(path))
        # Workers that the driver starts for itself, such as those that prepare stateful processors, get no files but this path.
        environment = spark.sparkContext.environment
        environment["PYTHONPATH"] = os.pathsep.join(x for x in (str(path), environment.get("PYTHONPATH")) if x)
    return spark
