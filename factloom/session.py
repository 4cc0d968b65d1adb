"""What every operator needs from a session: shared storage and shipped code."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_SHIPPED = "_factloom_shipped"


def prepare(spark: SparkSession) -> SparkSession:
    """Set the checkpoint folder of ``spark.checkpoint.dir``, and send this package to the executors once a context.

    Without that setting a local session takes a temporary folder; a cluster, whose machines share none, raises.
    """
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.split("[")[0] == "local":
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="factloom-checkpoint-"))
    if not getattr(sc, _SHIPPED, False):
        setattr(sc, _SHIPPED, True)
        root = Path(__file__).resolve().parent
        target = os.path.join(tempfile.mkdtemp(prefix="factloom-"), "factloom.zip")
        with zipfile.ZipFile(target, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, f"factloom/{p.relative_to(root)}")
        sc.addPyFile(target)
    return spark


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below the folder that the driver and all executors share."""
    prepare(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext._jsc.sc().getCheckpointDir().get()
    return f"{base.rstrip('/')}/factloom/{name}-{uuid.uuid4().hex}"


def delete_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder through Hadoop's file system, so any shared store works."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    prepare(df.sparkSession)
    return df.checkpoint(eager=True)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
