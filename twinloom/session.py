"""Session builder with the settings the engine is designed for."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

#: Settings that hold on a laptop and on a large cluster alike: AQE sizes shuffles and splits skewed joins at run time.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.executorEnv.OMP_NUM_THREADS": "1",
}


def build(app: str = "twinloom", master: str | None = None, **conf: str) -> SparkSession:
    """A session; on a cluster, master and sizes come from spark-submit and are left alone."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master).config("spark.driver.memory", os.environ.get("TWINLOOM_DRIVER_MEMORY", "8g"))
    for key, value in {**DEFAULTS, **{k.replace("__", "."): v for k, v in conf.items()}}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes this package importable in Python workers. Where PYTHONPATH has it, nothing is to do; else a zip of the package goes
    with the application, once."""
    context = spark.sparkContext
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    known = {os.path.realpath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p}
    if os.path.realpath(root) in known or context.applicationId in _shipped:
        return
    _shipped.add(context.applicationId)
    folder = tempfile.mkdtemp(prefix="twinloom-zip-")
    context.addPyFile(shutil.make_archive(os.path.join(folder, "twinloom"), "zip", root, "twinloom"))
