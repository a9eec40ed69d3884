"""Session helpers: table reading, the shared folder, lineage cuts."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the setting is missing, a temporary folder serves local mode; on a
    cluster a machine-local folder would be wrong, so that is an error.
    """
    set_dir = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    known = getattr(spark.sparkContext, "_artefold_dir", None)
    if known:
        return known
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    own = "file://" + tempfile.mkdtemp(prefix="artefold-")
    spark.sparkContext._artefold_dir = own
    return own


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; the caller writes it once."""
    return f"{shared_dir(spark)}/artefold/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Cuts the lineage and lets several branches read one result; lost
    executors cost no recomputation.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.mode("overwrite").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ship(spark: SparkSession) -> None:
    """Let the Python workers of all executors import this package, once per context.

    Nothing is done where ``PYTHONPATH`` already names the folder it lies in.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if getattr(spark.sparkContext, "_artefold_shipped", False) or root in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    spark.sparkContext._artefold_shipped = True
    folder = tempfile.mkdtemp(prefix="artefold-package-")
    skip = shutil.ignore_patterns("__pycache__")
    shutil.copytree(os.path.join(root, "artefold"), os.path.join(folder, "in", "artefold"), ignore=skip)
    spark.sparkContext.addPyFile(shutil.make_archive(os.path.join(folder, "artefold_package"), "zip", os.path.join(folder, "in")))
