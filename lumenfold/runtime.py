"""Session helpers shared by all operators: the shared folder, staged tables and bounded driver reads."""

from __future__ import annotations

import atexit
import contextlib
import os
import shutil
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder that every executor can reach, from ``spark.checkpoint.dir``.

    Only where the setting is missing and Spark runs on this machine alone (tests) a folder is made here and removed when
    the process ends; on a cluster the missing setting is an error, as executors have no folder in common.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where.rstrip("/")
    known = sc.getCheckpointDir()
    if known:
        return known.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    made = tempfile.mkdtemp(prefix="lumenfold-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    sc.setCheckpointDir(f"file://{made}")
    return (sc.getCheckpointDir() or f"file://{made}").rstrip("/")


_FOLDERS: set[str] = set()


def new_path(spark: SparkSession, name: str) -> str:
    """Unused path below the shared folder, in a folder of this application. What stands there can be read as long as the
    driver lives: it is deleted when the driver's process ends, or by ``clear``."""
    folder = f"{shared_dir(spark)}/lumenfold/{spark.sparkContext.applicationId}"
    if folder not in _FOLDERS:
        _FOLDERS.add(folder)
        atexit.register(_leave, spark, folder)
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def _leave(spark: SparkSession, folder: str) -> None:
    """Delete the folder of an application that ends, if its file system can still be reached."""
    if folder.startswith(("file:", "/")):
        shutil.rmtree(folder.removeprefix("file:").replace("//", "/"), ignore_errors=True)
        return
    with contextlib.suppress(Exception):  # the session may be gone
        delete_path(spark, folder)


def clear(spark: SparkSession) -> None:
    """Delete what this application has staged; results not yet written can't be read afterwards."""
    delete_path(spark, f"{shared_dir(spark)}/lumenfold/{spark.sparkContext.applicationId}")


def delete_path(spark: SparkSession, path: str) -> None:
    """Remove a folder through Hadoop's file system, whatever its scheme."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write ``df`` once as Parquet in the shared folder and read it back: cuts the lineage, survives executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def sizes(spark: SparkSession, path: str) -> dict[str, int]:
    """Bytes below each direct subfolder of ``path``."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return {}
    return {s.getPath().toString(): fs.getContentSummary(s.getPath()).getLength() for s in fs.listStatus(p) if s.isDirectory()}


def collect_bounded(df: DataFrame, rows: int, what: str) -> list:
    """Rows of a table that is small by its nature; an error instead of an unbounded collect."""
    got = df.limit(rows + 1).collect()
    if len(got) > rows:
        raise ValueError(f"{what} has more than {rows} rows")
    return got


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the Python workers, once an application, wherever they run."""
    sc = spark.sparkContext
    if sc.applicationId in _SHIPPED:
        return
    _SHIPPED.add(sc.applicationId)
    here = os.path.dirname(os.path.abspath(__file__))
    made = tempfile.mkdtemp(prefix="lumenfold-code-")
    atexit.register(shutil.rmtree, made, ignore_errors=True)
    with zipfile.ZipFile(f"{made}/lumenfold.zip", "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(here):
            for f in files:
                if f.endswith(".py"):
                    z.write(os.path.join(folder, f), os.path.relpath(os.path.join(folder, f), os.path.dirname(here)))
    sc.addPyFile(f"{made}/lumenfold.zip")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables, all columns; Catalyst prunes them."""
    ship(spark)
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))
