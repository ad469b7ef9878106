"""Session helpers: the shared folder, staged tables and shipping this package to executors."""

from __future__ import annotations

import io
import os
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: Used on one machine only, where no shared folder is named, as in tests.
LOCAL_SHARED = "/tmp/checkpoints/matchloom"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors see: ``spark.checkpoint.dir``, or a local one where it is unset and all run on this machine."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "local").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (named or LOCAL_SHARED).rstrip("/")


def own_dir(spark: SparkSession) -> str:
    """This application's part of the shared folder."""
    return f"{shared_dir(spark)}/matchloom-{spark.sparkContext.applicationId}"


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the application's part of the shared folder."""
    return f"{own_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear(spark: SparkSession) -> bool:
    """Deletes all that this application has staged, once none of its frames is needed any more; whether there was anything."""
    path = spark._jvm.org.apache.hadoop.fs.Path(own_dir(spark))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again.

    This cuts the lineage: an executor that is lost later costs a read, not a
    recomputation, and what follows may read the table more than once.
    """
    path = fresh_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Has the driver's JVM collect, so that Spark deletes the shuffle files of all frames that nothing refers to.

    Spark does that only after a collection, which a large heap may not need before the disks are full.
    """
    spark._jvm.System.gc()


@contextmanager
def counted_broadcasts(spark: SparkSession) -> Iterator[None]:
    """Within it only sides that are marked for broadcast, after a count, are broadcast.

    Staged tables and shuffles are compressed, so that the planner takes sides of many rows for small ones, which the driver would hold whole.
    """
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    before = {name: spark.conf.get(name, None) for name in names}
    for name in names:
        spark.conf.set(name, "-1")
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once for each application, so that functions in tasks can be imported there."""
    sc = spark.sparkContext
    name = f"matchloom-{sc.applicationId}.zip"
    if any(f.endswith(name) for f in sc._python_includes):
        return
    root = Path(__file__).resolve().parent
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    folder = Path(os.environ.get("TMPDIR", "/tmp"))
    path = folder.resolve() / name
    path.write_bytes(data.getvalue())
    sc.addPyFile(str(path))  # served from this place, so the file stays
