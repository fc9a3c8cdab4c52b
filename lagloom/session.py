"""Shipping of the package, settled intermediate state, and a local session for
the tests and the benchmark."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import zipfile

from pyspark.sql import DataFrame, SparkSession

_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the Python workers this package, once per application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    # The driver serves the archive for as long as it lives; executors may join late.
    folder = tempfile.mkdtemp(prefix="lagloom-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = os.path.join(folder, "lagloom.zip")
    with zipfile.ZipFile(target, "w") as z:
        for at, _, files in os.walk(package):
            for f in files:
                if f.endswith(".py"):
                    path = os.path.join(at, f)
                    z.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(target)
    _shipped.add(app)


def settled(df: DataFrame) -> DataFrame:
    """`df` written to the checkpoint folder and read back: an iteration's state
    without its history. The folder is spark.checkpoint.dir; where that is
    unset, a temporary one, which only a local session can share with itself."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        base = spark.conf.get("spark.checkpoint.dir", None)
        if base is None:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            base = tempfile.mkdtemp(prefix="lagloom-state-")
        context.setCheckpointDir(base)
    return df.checkpoint()


def local_session(cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lagloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
