"""Where work tables go, and how plan lineage is cut."""

from __future__ import annotations

import functools
import os
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_dirs: dict[str, str] = {}
_bucketed: dict[int, str] = {}


def work_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``.

    Only a local session without that setting gets a folder of its own.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if named:
        return named
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="pagemill-")
    return _local_dirs[app]


def new_folder(spark: SparkSession, name: str) -> str:
    return os.path.join(work_dir(spark), f"{name}-{uuid.uuid4().hex}")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as parquet to the shared folder and read it back: lineage ends at files that
    outlive any executor."""
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``stored`` or ``bucketed`` wrote; nothing may read them any more."""
    for df in tables:
        hadoop = df.sparkSession._jsc.hadoopConfiguration()
        folders = {os.path.dirname(f) for f in df.inputFiles()}
        for folder in folders:
            path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(hadoop).delete(path, True)
        if id(df) in _bucketed:
            df.sparkSession.sql(f"drop table {_bucketed.pop(id(df))}")


def bucketed(df: DataFrame, name: str, *keys: str) -> DataFrame:
    """As ``stored``, one file for each hash bucket of the keys: a join on all of them reads this side where
    it lies and shuffles only the other.  There are as many buckets as shuffle partitions."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path, table = new_folder(spark, name), f"{name.replace('-', '_')}_{uuid.uuid4().hex}"
    dealt = df.repartition(n, *[F.col(k) for k in keys])
    dealt.write.bucketBy(n, *keys).sortBy(*keys).option("path", path).saveAsTable(table)
    found = spark.table(table)
    _bucketed[id(found)] = table
    return found


def reused(build):
    """Keep the Columns a function returns and hand them out again for the same arguments.

    A Column of a thousand nodes takes seconds to put together, because each node is a call into
    the JVM; the finished Column can be used in any number of plans.
    """
    kept: dict = {}

    @functools.wraps(build)
    def wrapper(*args):
        key = (SparkContext.getOrCreate().applicationId, *args)
        if key not in kept:
            kept[key] = build(*args)
        return kept[key]

    return wrapper
