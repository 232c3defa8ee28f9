"""Sessions, and getting this package to the executors."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def session(app: str = "raterlake", cores: int | None = None, memory: str = "8g") -> SparkSession:
    """A local session with the settings that the queries expect (UTC, adaptive execution)."""
    cores = cores or os.cpu_count() or 4
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(cores))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once a context."""
    context = spark.sparkContext
    if getattr(context, "_raterlake_shipped", False):
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="raterlake-"), "raterlake.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    file = os.path.join(folder, name)
                    out.write(file, os.path.join("raterlake", os.path.relpath(file, here)))
    context.addPyFile(path)
    context._raterlake_shipped = True


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share: the one that the cluster names in spark.checkpoint.dir, or, where that is unset, as in tests on one machine, a temporary one."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir is not set: tables that grow in place need a folder that all executors share")
    return tempfile.mkdtemp(prefix="raterlake-")
