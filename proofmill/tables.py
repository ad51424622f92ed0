"""Reading the given tables and cutting lineage through tables in shared storage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The Parquet table ``name`` of the folder ``sf_dir`` (any store that Spark reads)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where the session names none, a local folder is set for the session if Spark runs in this
    process alone (tests, a laptop); on a cluster that is an error, as executors would not share it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        master = spark.sparkContext.master
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise ValueError(f"spark.checkpoint.dir is unset: on {master} it must name a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="proofmill-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def cut(df: DataFrame, *partition_by: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    This ends the lineage: a lost executor costs a reread of the table, never the work before it.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/cut-{uuid.uuid4().hex}"
    df.write.partitionBy(*partition_by).parquet(path) if partition_by else df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._cut_path = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the table behind a frame that ``cut`` returned; nothing may read it later."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._cut_path)
    conf = df.sparkSession._jsc.hadoopConfiguration()
    path.getFileSystem(conf).delete(path, True)


#: Rows of a table that is sent to all workers at most.
FEW = 100_000


def few(df: DataFrame) -> DataFrame:
    """``df`` written once, and marked to be broadcast if it has few rows; a larger one is shuffled like any other."""
    out = cut(df)
    return F.broadcast(out) if out.count() <= FEW else out


def bounded(df: DataFrame, most: int, what: str) -> DataFrame:
    """``df`` written once; an error if it has more than ``most`` rows, as what follows orders them in one task."""
    out = cut(df)
    n = out.count()
    if n > most:
        raise ValueError(f"{n} {what}, at most {most} can be ordered in one task")
    return out


class Scratch(list):
    """Tables that ``cut`` has written for one job, to be deleted together once its result is written."""

    def cut(self, df: DataFrame) -> DataFrame:
        self.append(cut(df))
        return self[-1]

    def held(self, df: DataFrame) -> DataFrame:
        """A frame that ``cut`` returned elsewhere, to be deleted with the others."""
        self.append(df)
        return df

    def clear(self) -> None:
        while self:
            drop(self.pop())
