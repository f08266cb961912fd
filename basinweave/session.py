"""Session, table and checkpoint helpers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "basinweave", cores: str | int = "*", shuffle_partitions: int = 8) -> SparkSession:
    """A local session with the settings the tests and the bench use. Clusters bring their own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the data folder; filters and columns chosen on it reach the Parquet scan."""
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Makes ``DataFrame.checkpoint`` usable and returns its folder.

    A cluster names a folder that all executors share in ``spark.checkpoint.dir``; it is used as it is. Where it is unset, a session
    on one machine gets a temporary folder, which is removed at its end; on a cluster, whose executors could not read such a folder,
    that is an error.
    """
    sc = spark.sparkContext
    current = sc._jsc.sc().getCheckpointDir()
    if current.isDefined():
        return current.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="basinweave-checkpoint-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
    sc.setCheckpointDir(folder)
    return folder


def stable(df: DataFrame) -> DataFrame:
    """The table, written once to the checkpoint folder: several later steps read it, and lost executors don't undo it."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ship_package(spark: SparkSession) -> None:
    """Gives the executors this package, once for each Spark context, so that Python functions can be unpickled there."""
    sc = spark.sparkContext
    if getattr(sc, "_basinweave_shipped", False):
        return
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    build = tempfile.mkdtemp(prefix="basinweave-")
    stage = os.path.join(build, "stage")
    shutil.copytree(
        os.path.join(root, "basinweave"), os.path.join(stage, "basinweave"), ignore=shutil.ignore_patterns("__pycache__")
    )
    sc.addPyFile(shutil.make_archive(os.path.join(build, "basinweave"), "zip", stage))
    shutil.rmtree(stage, ignore_errors=True)
    sc._basinweave_shipped = True
