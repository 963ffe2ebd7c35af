"""The folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession

from tidelog.plans.errors import UsageError


def shared_root(spark: SparkSession) -> str:
    """What the cluster names in spark.checkpoint.dir; a temporary folder only where that is unset and the master is local, as in tests."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise UsageError("name a folder that all machines share in spark.checkpoint.dir")
        root = "file://" + tempfile.mkdtemp(prefix="tidelog-shared-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"


def write_new(store, path: str, body: bytes) -> bool:
    """Writes a small file unless there is one of that name: of several writers one wins.

    Atomic on local disks (a hard link) and where a rename onto a file fails, as on HDFS; object stores
    without such a rename need a lock of their own.
    """
    from pyarrow import fs

    temp = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(temp) as out:
        out.write(body)
    try:
        if isinstance(store, fs.LocalFileSystem):
            os.link(temp, path)
            store.delete_file(temp)
        elif store.get_file_info(path).type != fs.FileType.NotFound:
            raise FileExistsError(path)
        else:
            store.move(temp, path)
    except OSError:
        store.delete_file(temp)
        if store.get_file_info(path).type == fs.FileType.NotFound:
            raise
        return False
    return True
