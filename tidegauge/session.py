"""Session, shared folder and size-checked broadcasting."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only if it was counted and has at most this many rows.
MAX_BROADCAST_ROWS = 200_000

_shipped: set[str] = set()


def get_spark(app: str = "tidegauge", cpus: int | str = "*", partitions: int | None = None) -> SparkSession:
    """A local session with the settings that the engine expects (UTC, AQE)."""
    n = partitions or (os.cpu_count() or 8 if cpus == "*" else int(cpus))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(n))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    ship_package(spark)
    return spark


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that Python workers can import it anywhere."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="tidegauge-")) / "tidegauge_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` where it is set, else, in a local session (tests), a fresh local one.

    RuntimeError on a cluster that names none: a folder of one machine would lose what others wrote.
    """
    sc = spark.sparkContext
    conf = sc.getConf().get("spark.checkpoint.dir", None)
    if conf:
        if sc._jsc.sc().getCheckpointDir().isEmpty():
            sc.setCheckpointDir(conf)
        return conf.rstrip("/")
    held = sc._jsc.sc().getCheckpointDir()
    if held.isEmpty():
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="tidegauge-shared-"))
        held = sc._jsc.sc().getCheckpointDir()
    return held.get().rstrip("/")


_runs: set[str] = set()


def run_dir(spark: SparkSession) -> str:
    """The part of the shared folder that belongs to this application; removed with it."""
    path = f"{shared_dir(spark)}/run-{spark.sparkContext.applicationId}"
    if path not in _runs:
        _runs.add(path)
        atexit.register(_release_quietly, spark)
    return path


def release(spark: SparkSession) -> bool:
    """Remove all that :func:`written` wrote in this application; frames that read it can't be used any more."""
    sc = spark.sparkContext
    p = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark)}/run-{sc.applicationId}")
    return p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def _release_quietly(spark: SparkSession) -> None:
    try:
        if spark.sparkContext._jsc is not None:
            release(spark)
    except Exception:  # the session is gone: nothing left to ask
        pass


def written(df: DataFrame, name: str = "step") -> DataFrame:
    """``df`` written to the run's own part of the shared folder and read again: computed once, without lineage, safe against
    lost executors. It stays until :func:`release`, or the end of the driver."""
    spark = df.sparkSession
    path = f"{run_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has at most ``limit`` rows, else as it is (a shuffle join follows).

    ``df`` should be cheap to count: a table from :func:`written` or a small source.
    """
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the provided parquet tables."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
