"""Sessions, and shipping of this package to the executors."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

HERE = Path(__file__).resolve().parent


def local_session(app: str = "tesserae", cpus: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the benchmark; a cluster brings its own."""
    settings = {
        "spark.master": f"local[{cpus}]",
        "spark.app.name": app,
        "spark.driver.memory": "8g",
        "spark.sql.shuffle.partitions": str(cpus),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
    } | conf
    spark = SparkSession.builder.config(map=settings).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to every executor, once a session.

    Functions that run in Python workers are pickled by reference, so the workers must be able to import the package
    whatever their own path is. Spark's file server hands out the archive; nothing is read from a shared folder.
    """
    context = spark.sparkContext
    if getattr(context, "_tesserae_shipped", False):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="tesserae-"), "tesserae.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for path in sorted(HERE.rglob("*.py")):
            z.write(path, path.relative_to(HERE.parent).as_posix())
    context.addPyFile(archive)
    context._tesserae_shipped = True


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Use the folder that the cluster names; a local one only where all runs on this machine, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", "") or context.getConf().get("spark.checkpoint.dir", "")
        if not named and not context.master.startswith("local"):
            raise ValueError("name a folder that the driver and all executors share in spark.checkpoint.dir")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="tesserae-checkpoint-"))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder that the driver and all executors see."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"
