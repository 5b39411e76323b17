"""Writers for row families and whole runs.  Spark writes a folder of part files per table; any
URI that Spark can write to will do, an object store included."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from pathlib import Path
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedupe import with_fingerprint
from ..operators.pages import family
from ..operators.records import table_cells
from ..schemas import SCHEMA_VERSION
from ..session import new_folder, stored
from . import sink

FORMATS = ["csv", "json", "jsonl", "tables"]
FOLDER_FILES = 1_000
MANIFEST_FILE = "file string, bytes bigint"
RENAMED = {
    "page_id": "page", "index": "idx", "check": "check_name", "where": "where_clause", "when": "when_ts",
}


def _text_only(df: DataFrame) -> DataFrame:
    """CSV holds no arrays: they are written as JSON text."""
    nested = {n for n, t in df.dtypes if t.startswith(("array", "map", "struct"))}
    return df.select(
        *[F.to_json(F.col(f"`{c}`")).alias(c) if c in nested else F.col(f"`{c}`") for c in df.columns]
    )


def write_csv(df: DataFrame, path: str) -> None:
    _text_only(df).write.mode("overwrite").csv(path, header=True, escape='"', quoteAll=False)


def write_jsonl(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path, ignoreNullFields=False)


def write_payload_files(payloads: DataFrame, path: str, key: str, body: str = "body", kind: str = "json") -> DataFrame:
    """A file for each payload, named ``key=value.json`` with what stands under its key, and ``source`` of all of them.

    Tasks write the files, ``FOLDER_FILES`` to a folder at most, so their number costs the driver nothing; repeated keys
    have a file each. What a failed task leaves is not among the sources. Null bodies are empty files."""
    folder = path.rstrip("/")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, n = TaskContext.get(), 0
        own = f"{folder}/part-{task.partitionId():06d}-{task.taskAttemptId()}"
        system, plain = fs.FileSystem.from_uri(own)
        for batch in batches:
            names = [quote(k or "", safe="") for k in batch.column("key").to_pylist()]
            files = [f"{i // FOLDER_FILES:04d}/{i:08d}-{quote(key)}={k}.{kind}" for i, k in enumerate(names, n)]
            for i, (file, data) in enumerate(zip(files, batch.column("body").to_pylist(), strict=True), n):
                if i % FOLDER_FILES == 0:
                    system.create_dir(f"{plain}/{file.partition('/')[0]}", recursive=True)
                with system.open_output_stream(f"{plain}/{file}", compression=None) as out:
                    out.write(data or b"")
            n += batch.num_rows
            yield pa.record_batch({"source": [f"{own}/{f}" for f in files]})

    rows = payloads.select(F.col(key).cast("string").alias("key"), F.col(body).cast("binary").alias("body"))
    return stored(rows.mapInArrow(write, "source string"), "sources")


def write_html_files(pages: DataFrame, path: str, key: str, html: str = "html") -> DataFrame:
    """A file for each page, named ``key=value.html``, and ``source`` of all of them, as ``write_payload_files`` does it.

    Each text ends its line. Texts under one key are one file; texts without a key have a file each. Keys are
    counted first; tasks then write the pages that they read, and there is a shuffle only where some key comes twice."""
    text = F.concat(F.coalesce(F.col(html), F.lit("")), F.lit("\n")).alias("body")
    texts, known = pages.select(F.col(key), text), F.col(key).isNotNull()
    if not texts.where(known).groupBy(key).count().where("count > 1").isEmpty():
        whole = F.array_join(F.array_sort(F.collect_list("body")), "").alias("body")
        together = texts.where(known).repartition(key).groupBy(key).agg(whole)
        texts = together.unionByName(texts.where(~known))
    folder = path if ":/" in path else Path(path).absolute().as_uri()
    return write_payload_files(texts, folder, key, kind="html")


def run_documents(extracted: DataFrame) -> DataFrame:
    """One JSON document per page with all its families; a document never grows past its page."""
    parts = [F.col(c) for c in ("items", "links", "images", "headings", "issues", "tables")]
    meta = F.struct("url", "title", "description", "lang", "selector", "next_url").alias("meta")
    return extracted.select("page_id", F.to_json(F.struct(meta, *parts)).alias("document"))


def write_html_tables(tables: DataFrame, path: str) -> None:
    """Cells in long form, in one folder of CSV files."""
    table_cells(tables).write.mode("overwrite").csv(path, header=True, escape='"')


def save_extracted(extracted: DataFrame, path: str) -> DataFrame:
    """Store the page rows once and read them back: the families are then column reads."""
    extracted.write.mode("overwrite").parquet(path)
    return extracted.sparkSession.read.parquet(path)


def run_tables(stored: DataFrame, meta: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables of a run with the names and columns of its database form."""
    tables = {
        "items": with_fingerprint(family(stored, "items")),
        "links": family(stored, "links"),
        "images": family(stored, "images"),
        "headings": family(stored, "headings"),
        "qa_issues": family(stored, "issues"),
    }
    if meta is not None:
        tables["run_meta"] = meta
    return {
        name: df.select(*[F.col(f"`{c}`").alias(RENAMED.get(c, c)) for c in df.columns])
        for name, df in tables.items()
    }


def save_tables(stored: DataFrame, meta: DataFrame | None = None, database: str = "") -> None:
    """Save the run's tables in the catalog, in place of earlier ones."""
    prefix = f"{database}." if database else ""
    for name, df in run_tables(stored, meta).items():
        df.write.mode("overwrite").saveAsTable(prefix + name)


def export_all(
    stored: DataFrame, path: str, formats: set[str], meta: DataFrame | None = None
) -> list[str]:
    """Write the run in the asked formats and give the folders written.

    ``stored`` should come from ``save_extracted``.  csv and jsonl write one folder per family,
    json one document per page, tables parquet folders with the database's columns.
    """
    unknown = set(formats) - set(FORMATS)
    if unknown:
        raise ValueError(f"Unknown format(s): {', '.join(sorted(unknown))}")
    written = []

    def put(write, df: DataFrame, name: str) -> None:
        write(df, f"{path}/{name}")
        written.append(f"{path}/{name}")

    named = {"items": "items", "links": "links", "images": "images", "headings": "headings", "issues": "qa_issues"}
    if "csv" in formats:
        for name, out in named.items():
            put(write_csv, family(stored, name), f"{out}.csv")
        put(write_html_tables, family(stored, "tables"), "tables.csv")
    if "jsonl" in formats:
        for name, out in named.items():
            put(write_jsonl, family(stored, name), f"{out}.jsonl")
    if "json" in formats:
        put(write_jsonl, run_documents(stored), "run.json")
    if "tables" in formats:
        for name, df in run_tables(stored, meta).items():
            put(lambda d, p: d.write.mode("overwrite").parquet(p), df, f"data/{name}")
    return written


def manifest_files(spark: SparkSession, path: str, at_once: int = 10_000) -> DataFrame:
    """``file, bytes``: every file below ``path``, by its place relative to it: empty ones too, and those whose
    names begin with ``_`` or a dot, which Spark's own readers pass over.

    Hadoop's file system lists the folder, so any store will do that Spark writes to.  The listing is an iterator,
    and the driver holds ``at_once`` names of it before they are written as rows."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    root = system.makeQualified(folder).toUri().getPath().rstrip("/")
    listed, out, rows = system.listFiles(folder, True), new_folder(spark, "manifest"), []

    def write() -> None:
        spark.createDataFrame(rows, MANIFEST_FILE).coalesce(1).write.mode("append").parquet(out)
        rows.clear()

    while listed.hasNext():
        status = listed.next()
        rows.append((status.getPath().toUri().getPath()[len(root) + 1 :], status.getLen()))
        if len(rows) == at_once:
            write()
    write()
    return spark.read.schema(MANIFEST_FILE).parquet(out)


def manifest(meta: DataFrame, counts: DataFrame, files: DataFrame) -> DataFrame:
    """One row: the run's meta, its counts as a map, the number and size of its files, and the schema
    version.  The files themselves are rows of ``manifest_files``."""
    totals = counts.agg(F.map_from_entries(F.collect_list(F.struct("what", "n"))).alias("counts"))
    sizes = files.agg(F.struct(F.count("*").alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).alias("files"))
    rows = meta.select(F.struct("*").alias("meta"))
    rows = rows.unionByName(totals, allowMissingColumns=True).unionByName(sizes, allowMissingColumns=True)
    first = [F.first(c, ignorenulls=True).alias(c) for c in ("meta", "counts", "files")]
    return rows.agg(*first).withColumn("schema_version", F.lit(SCHEMA_VERSION))


def sink_row(items: DataFrame) -> DataFrame:
    """Items as eight text columns in the order of the sink's header."""
    def text(c: str) -> Column:
        return F.coalesce(F.col(f"`{c}`").cast("string"), F.lit(""))

    columns = [text("page_id").alias("page")]
    for c in ("index", "title", "price", "link", "image", "text"):
        columns.append(text(c).alias(c))
    fp = text("fingerprint") if "fingerprint" in items.columns else F.lit("")
    return items.select(*columns, fp.alias("fingerprint"))


def push(items: DataFrame, path: str, mode: str = "replace") -> int:
    """Write the sink's rows and give their number.  Replace writes anew, append adds; no items
    leave the target as it is.

    The rows go through ``sink.RowSink``: they count once whatever tasks were run again, and the
    number comes from the commit."""
    if mode not in ("replace", "append"):
        raise ValueError(f"unknown mode {mode!r}")
    rows = sink_row(items)
    if rows.isEmpty():
        return 0
    spark = items.sparkSession
    spark.dataSource.register(sink.RowSink)
    push_id = uuid.uuid4().hex
    writer = rows.write.format(sink.RowSink.name()).option("path", path).option("push", push_id)
    writer.mode("overwrite" if mode == "replace" else "append").save()
    done = sink.read_commits(spark, path).where(F.col("push") == push_id)
    return done.agg(F.sum("rows")).first()[0]


def pushed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of all pushes that were committed."""
    return sink.read_rows(spark, path)
