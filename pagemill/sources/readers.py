"""Readers for pages, payloads and exported reports."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

READ_BYTES = 4 << 20  # of files that a task hands on at a time

def spread(df: DataFrame) -> DataFrame:
    """Deal rows over all cores when a scan gives fewer splits than there are cores.

    Reading pages is work for the processor, and a few small files would leave most cores idle.  A
    large table has more splits than cores and stays as it is: no shuffle.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    """Fetched pages: ``page_id, url, html``."""
    return spread(spark.read.parquet(path).select("page_id", "url", "html"))


def read_html_files(spark: SparkSession, path: str | DataFrame) -> DataFrame:
    """Local HTML files, one page per file; the URL is the file's URI, and the id a hash of it.

    Spark lists a path on the driver and opens a few files in each task.  A table of names (``source``), as
    ``write_html_files`` gives it, is dealt over the tasks, which open the files by those names."""
    if isinstance(path, DataFrame):
        named = F.regexp_replace("source", "%(?=[^/]*$)", "%25").alias("file_path")
        files = read_payload_files(path).select(F.col("body").alias("value"), named)
    else:
        files = spark.read.text(path, wholetext=True).select("value", "_metadata.file_path")
    url = F.regexp_replace("file_path", "^file:/+", "file:///")
    return files.select(
        F.xxhash64(url).alias("page_id"),
        url.alias("url"),
        F.col("value").alias("html"),
        F.lit("local-file").alias("method"),
    )


def read_json_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Whole response texts: ``source, body``; ``items_from_json`` parses them."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("body"))


def read_payload_files(sources: DataFrame) -> DataFrame:
    """``source, body`` of the files that ``write_payload_files`` wrote; tasks open them by name and nothing is listed."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roots, names, data, size = {}, [], [], 0
        for batch in batches:
            for name in batch.column("source").to_pylist():
                root, folder, file = name.rsplit("/", 2)
                if root not in roots:
                    roots[root] = fs.FileSystem.from_uri(root)
                system, plain = roots[root]
                with system.open_input_stream(f"{plain}/{folder}/{file}", compression=None) as opened:
                    data.append(opened.read())
                names.append(name)
                size += len(data[-1])
                if size >= READ_BYTES:
                    yield pa.record_batch({"source": names, "body": pa.array(data, pa.binary())})
                    names, data, size = [], [], 0
        if names:
            yield pa.record_batch({"source": names, "body": pa.array(data, pa.binary())})

    files = spread(sources.select("source")).mapInArrow(read, "source string, body binary")
    return files.withColumn("body", F.col("body").cast("string"))


def parsed_payloads(payloads: DataFrame) -> DataFrame:
    """``source, body`` with the body as VARIANT; payloads that are no JSON are left out."""
    parsed = payloads.select("source", F.try_parse_json("body").alias("body"))
    return parsed.where("body is not null")


def read_report_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An exported CSV file with header; a missing path gives no rows."""
    as_struct = T._parse_datatype_string(schema)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        return spark.createDataFrame([], as_struct)
    read = spark.read.csv(path, header=True, multiLine=True, escape='"', enforceSchema=False)
    columns = [
        F.coalesce(F.col(f"`{f.name}`"), F.lit("")).try_cast(f.dataType).alias(f.name)
        if f.name in read.columns
        else F.lit("").try_cast(f.dataType).alias(f.name)
        for f in as_struct.fields
    ]
    return read.select(*columns)
