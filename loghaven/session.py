"""Session helpers shared by every part of the package."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "LOGHAVEN_SHIPPED"
_LOCAL_SHARED: dict[str, str] = {}


def build_session(app: str = "loghaven", cpus: str | int = "*", **conf: str) -> SparkSession:
    """A local session with the settings every query assumes (UTC, AQE on)."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.parquet.filterPushdown", "true")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Make this package importable in Python workers on every executor.

    Spark's own file server carries the zip, so nothing needs to be installed on
    the executors. Done once per Spark context.
    """
    app = spark.sparkContext.applicationId
    if os.environ.get(_SHIPPED) == app:
        return
    root = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="loghaven-zip-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder, "loghaven_package.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for path in sorted(root.rglob("*.py")):
            out.write(path, Path(root.name) / path.relative_to(root))
    spark.sparkContext.addPyFile(str(target))
    os.environ[_SHIPPED] = app


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (``spark.checkpoint.dir``).

    It is read from the session; only where it is unset in
    local mode (as in tests) a folder of this machine is made.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or _LOCAL_SHARED.get(spark.sparkContext.applicationId)
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("spark.checkpoint.dir must name a folder shared by driver and executors")
        base = tempfile.mkdtemp(prefix="loghaven-shared-")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        _LOCAL_SHARED[spark.sparkContext.applicationId] = base
    return base.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder, deleted when the driver's JVM ends."""
    path = f"{shared_dir(spark)}/loghaven/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(target)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared folder and read it back: cuts the lineage.

    A written table survives the loss of any executor.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
