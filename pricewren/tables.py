"""Tables between the steps of a job: written once as Parquet into the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Where a session without spark.checkpoint.dir keeps the name of its own folder.
OWN_FOLDER = "pricewren.tables.dir"


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local session gets a temporary folder; any other has to name one."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get(OWN_FOLDER, None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        folder = tempfile.mkdtemp(prefix="pricewren-")
        spark.conf.set(OWN_FOLDER, folder)
    return f"{folder.rstrip('/')}/tables-{spark.sparkContext.applicationId}"


def written(df: DataFrame, tag: str) -> DataFrame:
    """df as a table in the shared folder: later steps read it instead of computing it anew, and it outlives executors."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove_written(spark: SparkSession) -> None:
    """Remove what written() has left in this application; call it when no DataFrame that it returned is needed any more."""
    path, system = hadoop_path(spark, shared_folder(spark))
    system.delete(path, True)


def hadoop_path(spark: SparkSession, path: str):
    """The path and its file system, as Spark resolves them."""
    found = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return found, found.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
