"""Files of given names as a transactional sink.

`df.write.format("named_files").mode("append").save(folder)` takes rows (name, content) and writes each content under its
name in the folder.  A task writes to a folder of its own attempt; the driver moves what the attempts that
count have written into place when all tasks have ended, and drops everything else.  A task that fails or is
killed, or a job that is aborted, leaves nothing under the folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

FILES = "name string, content binary"


def file_system(folder: str):
    """(file system, path) of a folder that is a URI or a plain path."""
    import pyarrow.fs as pafs

    if "://" in folder:
        return pafs.FileSystem.from_uri(folder)
    return pafs.LocalFileSystem(), folder.removeprefix("file:")


@dataclass
class Written(WriterCommitMessage):
    """attempt: the folder of the attempt; names: of its files."""

    attempt: str
    names: list[str]


class _Writer(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder
        self.job = f"_job-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> Written:
        fs, root = file_system(self.folder)
        attempt, names = f"{self.job}/{uuid.uuid4().hex}", []
        for row in iterator:
            if not row.name or row.content is None or ".." in row.name.split("/"):
                raise ValueError(f"no file name or no content: {row.name!r}")
            path = f"{root}/{attempt}/{row.name}"
            fs.create_dir(path.rpartition("/")[0], recursive=True)
            with fs.open_output_stream(path) as out:
                out.write(bytes(row.content))
            names.append(row.name)
        return Written(attempt, names)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        fs, root = file_system(self.folder)
        for m in messages:
            for name in m.names if m else []:
                fs.create_dir(f"{root}/{name}".rpartition("/")[0], recursive=True)
                fs.move(f"{root}/{m.attempt}/{name}", f"{root}/{name}")
        self._drop()

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        self._drop()

    def _drop(self) -> None:
        import pyarrow.fs as pafs

        fs, root = file_system(self.folder)
        if fs.get_file_info(f"{root}/{self.job}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.job}")


class NamedFiles(DataSource):
    """Rows (name, content) as files."""

    @classmethod
    def name(cls) -> str:
        return "named_files"

    def schema(self) -> str:
        return FILES

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options["path"])


def write(files: DataFrame, folder: str) -> None:
    """files(name, content) under folder, all or none."""
    files.sparkSession.dataSource.register(NamedFiles)
    files.select(F.col("name").cast("string").alias("name"), F.col("content").cast("binary").alias("content")).write.format("named_files").mode("append").save(folder)


def copied(spark: SparkSession, names: DataFrame, folder: str) -> None:
    """Copies files(source, name): the bytes at each source path under its name in folder, all or none; the sources
    must be files that Spark can read."""
    paths = [r[0] for r in names.select(F.regexp_replace("source", "/[^/]*$", "").alias("parent")).distinct().collect()]  # folders, not files
    if not paths:
        return
    plain = F.regexp_replace("path", "^file:/*", "/")
    content = spark.read.format("binaryFile").load(paths).select(plain.alias("at_"), "content")
    wanted = names.select(F.regexp_replace("source", "^file:/*", "/").alias("at_"), "name")
    write(content.join(wanted, "at_").select("name", "content"), folder)
