"""A sink for image files: format("image_tree") writes column data of each row to <folder>/<job_id>/<path>.

A task writes a file beside its place under a name of its own and then moves it there, so that a task that runs
twice leaves each file once and whole, and no reader sees half of one. If the write fails, what its
tasks wrote is removed. Files of other jobs, and those of other names, stay.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "job_id string, path string, data binary"


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ImageTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "image_tree"

    def schema(self) -> str:
        return SCHEMA

    def writer(self, schema: StructType, overwrite: bool) -> ImageTreeWriter:
        return ImageTreeWriter(self.options["path"])


class ImageTreeWriter(DataSourceWriter):
    def __init__(self, folder: str):
        self.folder = folder

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.folder) if "://" in self.folder or self.folder.startswith("file:") else (fs.LocalFileSystem(), self.folder)

    def write(self, rows: Iterator[Row]) -> Written:
        store, root = self._store()
        files = []
        for row in rows:
            place = f"{root}/{row.job_id}/{row.path}"
            folder, _, name = place.rpartition("/")
            store.create_dir(folder, recursive=True)
            draft = f"{folder}/.{name}.{uuid.uuid4().hex}"
            with store.open_output_stream(draft) as out:
                out.write(row.data)
            store.move(draft, place)
            files.append(place)
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Files are in their places already."""

    def abort(self, messages: list[Written | None]) -> None:
        store, _ = self._store()
        for message in messages:
            for place in message.files if message else ():
                if store.get_file_info(place).type == fs.FileType.File:
                    store.delete_file(place)


def write(rows: DataFrame, folder: str) -> None:
    """Writes rows (job_id, path, data) as files; rows without data give none."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(ImageTree)
    kept = rows.where("data is not null").selectExpr("cast(job_id AS string) AS job_id", "path", "data")
    kept.write.format("image_tree").mode("append").save(folder)
