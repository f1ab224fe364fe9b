"""Tables written to the folder that driver and executors share, and read again."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where none is set, a local session gets a temporary folder; a cluster is told, as its
    executors would not see one."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='spark-shared-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as Parquet in the shared folder, read again: lineage ends here, and what was computed outlives an executor."""
    spark = df.sparkSession
    at = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def state_of(spark: SparkSession, folder: str) -> tuple:
    """Names, sizes and times of what lies in a folder: another state after any change there."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in found))


#: Beyond so many rows a written table is joined by sorting, however small its files are.
BROADCAST_ROWS = 100_000


def sized(table: DataFrame) -> DataFrame:
    """A written table as joins should take it. Spark judges it by the bytes of its files, in which a column of few
    values takes next to nothing, and would broadcast tens of millions of such rows; their number is in the footers."""
    return table.hint("merge") if table.count() > BROADCAST_ROWS else table


#: A table of so many rows, one for each different graph, goes to all tasks.
FEW_ROWS = 20_000


def few(table: DataFrame) -> DataFrame:
    """A written table of one row a key, as the many rows that share its keys should take it: whole in each task while it
    is small, so that a key that most of them share does not put them into one task."""
    return F.broadcast(table) if table.count() <= FEW_ROWS else table.hint("merge")


_STAGED: dict[tuple, DataFrame] = {}


def staged(spark, source: str, name: str, build) -> DataFrame:
    """The intermediate table `name` over the tables in source, built and written once in an application for each state
    of that folder, as an indexing run writes its tables; what follows reads it instead of deriving it again."""
    key = (spark.sparkContext.applicationId, source, state_of(spark, source), name)
    if key not in _STAGED:
        _STAGED[key] = sized(written(build(), name))
    return _STAGED[key]
