"""Where intermediate results go, and how workers get this package.

Lineage is cut through the folder named in ``spark.checkpoint.dir``, which driver and executors share.  Only a
local session (one process, as in tests) that names none gets a local folder; on a cluster that is an error.
Tables of one application lie in one folder, which ``clear`` removes.
"""

from __future__ import annotations

import os
import re
import shutil
import tempfile
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

#: Folders of local sessions that name none, and applications that have the package, by application.
_LOCAL: dict[str, str] = {}
_SHIPPED: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """This application's folder in the shared one."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _LOCAL:
            _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="spark-shared-")
        folder = _LOCAL[context.applicationId]
    return f"{folder.rstrip('/')}/millwatch-{context.applicationId}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later plans start from files that survive lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Remove what this application saved. Results that still read it are lost: write them first."""
    folder = shared_dir(spark)
    store, path = fs.FileSystem.from_uri(folder if ":/" in folder else f"file://{os.path.abspath(folder)}")
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send this package to the workers, once for an application."""
    name = spark.sparkContext.applicationId
    if name not in _SHIPPED:
        package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        archive = os.path.join(tempfile.mkdtemp(prefix="package-"), os.path.basename(package))
        spark.sparkContext.addPyFile(shutil.make_archive(archive, "zip", os.path.dirname(package), os.path.basename(package)))
        _SHIPPED.add(name)
