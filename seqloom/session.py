"""What every query needs of its session: shipped code, shared folders, tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import weakref
import zipfile

from pyspark.sql import DataFrame, SparkSession

#: Spark's setting for shuffle files of a query that is done.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_SHIPPED: set[str] = set()
_PATHS: dict[int, tuple[weakref.ref, str]] = {}


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once per application.

    Arrow functions are pickled by reference, so workers must be able to
    import the package whatever folder the driver was started from.
    """
    app = spark.sparkContext.applicationId
    if app in _SHIPPED:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="seqloom-"), "seqloom_code.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, dirs, names in os.walk(top):
            dirs[:] = [d for d in dirs if d != "__pycache__"]
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.join("seqloom", os.path.relpath(full, top)))
    spark.sparkContext.addPyFile(path)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset, a temporary folder takes its place on a local master
    only; a cluster must name one, as no machine's own folder is shared.
    """
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        path = os.path.join(tempfile.gettempdir(), "seqloom-shared")
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def table(df: DataFrame, name: str) -> DataFrame:
    """Write df in the shared folder and return it as read from there.

    This ends the lineage: a lost executor costs a re-read, not a re-run. What was
    shuffled for it goes from the disk as soon as it is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tables/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        # a plan takes the setting from when it was made
        df.select("*").write.parquet(path)
    finally:
        if was is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, was)
    out = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(out)] = (weakref.ref(out), path)
    return out


def drop(*tables: DataFrame) -> None:
    """Delete tables written by table(); all that was made of them must be written itself."""
    for t in tables:
        ref, path = _PATHS.pop(id(t), (None, None))
        if ref is not None and ref() is t:
            where = t.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(t.sparkSession._jsc.hadoopConfiguration()).delete(where, True)


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
