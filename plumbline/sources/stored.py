"""Tables written once to the folder that all machines share, so that what is derived from them does not make them anew."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder; only on one machine may that be a folder of our own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        sc.setCheckpointDir(shared or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def stored(df: DataFrame) -> DataFrame:
    """df, written to the checkpoint folder as rows: for small tables of which all columns are read."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame, *by: str) -> DataFrame:
    """df, written there as Parquet, a folder for each value of `by`: later reads take the columns and folders they need.

    The columns keep their types; those of `by` are strings and come last.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/table-{uuid.uuid4().hex}"
    df.write.partitionBy(*by).parquet(path)
    rest = df.drop(*by).schema
    for c in by:
        rest = rest.add(c, "string")
    return spark.read.schema(rest).parquet(path)


def remove(spark: SparkSession, table: DataFrame) -> None:
    """Delete a table that `written` gave, when nothing that is still to run reads it."""
    files = table.select(F.input_file_name().alias("f")).where("f <> ''").limit(1).collect()
    if files:
        jvm = spark.sparkContext._jvm
        folder = jvm.org.apache.hadoop.fs.Path(files[0].f)
        while folder is not None and not folder.getName().startswith("table-"):
            folder = folder.getParent()
        if folder is not None:
            folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
