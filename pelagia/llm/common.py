"""Session helpers shared by the operators: table reading and lineage cuts in the shared folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The white space that separates words everywhere in this subpackage.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The named Parquet table of a data folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; where that is unset, one in the warehouse, which executors share too."""
    return spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir() or f"{spark.conf.get('spark.sql.warehouse.dir')}/pelagia-work"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet under the shared folder and read it back: lineage ends there and lost
    executors re-read files instead of recomputing the chain before them."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/pelagia-{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.written_to = path
    return written


def discard(*written: DataFrame) -> None:
    """Delete the files of frames that ``materialise`` gave and that nothing reads any more; other frames are left alone."""
    for df in written:
        path = getattr(df, "written_to", None)
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def text_of(df: DataFrame, column: str = "text") -> Column:
    """The text column, null as the empty text."""
    return F.coalesce(df[column].cast("string"), F.lit(""))
