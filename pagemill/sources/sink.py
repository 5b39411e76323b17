"""A sink of text rows whose pushes are all there or not at all, as a Python data source.

Every task attempt writes files of its own under ``data``, and sends their names and row counts as
its commit message.  The commit writes one manifest file under ``commits``, with the files that count; readers
read what manifests name.  So files of a failed or repeated attempt are never read; an abort
deletes those it knows of.  A replacing commit names the manifests it supersedes and then removes them with their files.

Files are JSON lines, written through ``pyarrow.fs``: the target must be a store that it knows (local or
shared disk, HDFS, S3, GCS).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

ROWS_PER_FILE = 1_000_000
COMMIT = "push string, files array<struct<file: string, rows: bigint>>, replaces array<string>"


def _store(path: str) -> tuple[fs.FileSystem, str]:
    system, folder = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system, folder.rstrip("/")


@dataclass
class Written(WriterCommitMessage):
    """The files of one task attempt, with their numbers of rows."""

    files: list[tuple[str, int]]


class RowWriter(DataSourceWriter):
    def __init__(self, columns: list[str], path: str, push: str, overwrite: bool):
        self.columns, self.path, self.push, self.overwrite = columns, path, push, overwrite

    def write(self, iterator: Iterator) -> Written:
        system, folder = _store(self.path)
        system.create_dir(f"{folder}/data", recursive=True)
        files, out, n = [], None, 0
        name = ""
        for row in iterator:
            if out is None:
                name, n = f"{uuid.uuid4().hex}.json", 0
                out = system.open_output_stream(f"{folder}/data/{name}")
            line = json.dumps(dict(zip(self.columns, row)), ensure_ascii=False)
            out.write(line.encode() + b"\n")
            n += 1
            if n == ROWS_PER_FILE:
                out.close()
                files, out = [*files, (name, n)], None
        if out is not None:
            out.close()
            files.append((name, n))
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = _store(self.path)
        system.create_dir(f"{folder}/commits", recursive=True)
        old = []
        if self.overwrite:
            found = system.get_file_info(fs.FileSelector(f"{folder}/commits"))
            old = [f for f in found if f.base_name.endswith(".json")]
        manifest = {
            "push": self.push,
            "files": [{"file": name, "rows": n} for m in messages if m for name, n in m.files],
            "replaces": [f.base_name.removesuffix(".json") for f in old],
        }
        # Written beside its place and moved there: a manifest is whole or not there.
        with system.open_output_stream(f"{folder}/commits/{self.push}.part") as out:
            out.write(json.dumps(manifest).encode() + b"\n")
        system.move(f"{folder}/commits/{self.push}.part", f"{folder}/commits/{self.push}.json")
        for info in old:
            with system.open_input_stream(info.path) as past:
                names = [f["file"] for f in json.loads(past.read())["files"]]
            system.delete_file(info.path)
            self._delete(system, folder, names)

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = _store(self.path)
        self._delete(system, folder, [name for m in messages if m for name, _ in m.files])

    @staticmethod
    def _delete(system: fs.FileSystem, folder: str, names: list[str]) -> None:
        for name in names:
            try:
                system.delete_file(f"{folder}/data/{name}")
            except FileNotFoundError:
                pass


class RowSink(DataSource):
    """``df.write.format("pagemill_rows").option("path", ...).option("push", id)``."""

    @classmethod
    def name(cls) -> str:
        return "pagemill_rows"

    def writer(self, schema: StructType, overwrite: bool) -> RowWriter:
        push = self.options.get("push") or uuid.uuid4().hex
        return RowWriter(schema.names, self.options["path"], push, overwrite)


def read_commits(spark: SparkSession, path: str) -> DataFrame:
    """``push, file, rows``: the files that count."""
    commits = spark.read.schema(COMMIT).option("pathGlobFilter", "*.json").json(f"{path}/commits")
    gone = commits.select(F.explode("replaces").alias("push"))
    return commits.join(gone, "push", "left_anti").select("push", F.inline("files"))


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of the files that count; a file that no commit names isn't read as rows."""
    rows = spark.read.option("pathGlobFilter", "*.json").json(f"{path}/data").withColumn("_file", F.element_at(F.split("_metadata.file_path", "/"), -1))
    return rows.join(read_commits(spark, path).select(F.col("file").alias("_file")), "_file", "left_semi").drop("_file")
