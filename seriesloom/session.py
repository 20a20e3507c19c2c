"""Session factory and the shared folder used for checkpoints and intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "seriesloom", cpus: int | str = 8, shuffle_partitions: int = 8) -> SparkSession:
    """Local session for tests and the bench; on a cluster the submitting side supplies the session and calls ``ship_package``."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SERIESLOOM_DRIVER_MEMORY", "8g"))
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors, whose Python workers load its functions by module name.

    Needed wherever the package is not installed on the workers; does nothing the second time.
    """
    context = spark.sparkContext
    if getattr(context, "_seriesloom_sent", False):
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="seriesloom-package-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    context.addPyFile(shutil.make_archive(f"{folder}/seriesloom", "zip", root.parent, root.name))
    context._seriesloom_sent = True


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by the cluster in ``spark.checkpoint.dir``.

    Only a local session may fall back to a temporary folder: on a cluster a machine-local
    folder would vanish with the machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
    path = tempfile.mkdtemp(prefix="seriesloom-")
    spark.conf.set("spark.checkpoint.dir", path)
    return path


def checkpointed(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably: the result survives lost executors and cuts the lineage."""
    if getattr(df, "_materialised", False):
        return df
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    done = df.checkpoint(eager=True)
    done._materialised = True  # a second operator that needs it materialised takes it as it is
    return done


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; never reused, so a rerun cannot read a half-written table."""
    return f"{shared_dir(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, *columns: str) -> DataFrame:
    """Hash rows over all shuffle partitions before work that costs far more than its bytes suggest.

    Adaptive execution merges partitions by size, which would run thousands of small model fits in one task; an
    explicit partition count is kept as it is.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *columns)
