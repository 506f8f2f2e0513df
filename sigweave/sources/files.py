"""Small files written one a row, through Arrow's file systems, by tasks."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.common import shipped


def open_path(path: str) -> tuple[fs.FileSystem, str]:
    """File system and name there of a Hadoop path (its characters as they are) or a plain local one."""
    m = re.match(r"([a-z][a-z0-9+.-]*):(//[^/]*)?(/.*)?$", path)
    if not m or m[1] == "file":
        return fs.LocalFileSystem(), (m[3] or "/") if m else path
    where, root = fs.FileSystem.from_uri(f"{m[1].replace('s3a', 's3')}:{m[2] or '//'}")
    return where, root.rstrip("/") + (m[3] or "/")


class Staged(WriterCommitMessage):
    def __init__(self, files: list[tuple[str, str]]):
        self.files = files


class StagedWriter(DataSourceWriter):
    """Files below the path, one a row: tasks write under names of their own; the commit gives the files of the tasks that
    succeeded their names, so a repeated task leaves nothing twice. A subclass says what a row's file holds."""

    def __init__(self, options: dict, schema):
        self.path, self.options = options["path"].rstrip("/"), dict(options)

    def content(self, row) -> bytes:
        return bytes(row.content)

    def write(self, rows: Iterator) -> WriterCommitMessage:
        where, folder = open_path(self.path)
        files, made = [], set()
        for r in rows:
            target = f"{folder}/{r.file}"
            parent = target.rsplit("/", 1)[0]
            if parent not in made:
                where.create_dir(parent, recursive=True)
                made.add(parent)
            staged = f"{parent}/_{uuid.uuid4().hex}.part"
            with where.open_output_stream(staged) as f:
                f.write(self.content(r))
            files.append((staged, target))
        return Staged(files)

    def commit(self, messages) -> None:
        where, _ = open_path(self.path)
        for m in messages:
            for staged, target in m.files if m else []:
                where.move(staged, target)

    def abort(self, messages) -> None:
        where, _ = open_path(self.path)
        for m in messages:
            for staged, _target in m.files if m else []:
                where.delete_file(staged)


class FileSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "files"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return StagedWriter(self.options, schema)


def write_files(rows: DataFrame, path: str) -> None:
    """rows: file (name below path, folders allowed) and content (binary)."""
    rows.sparkSession.dataSource.register(FileSink)
    shipped(rows).select("file", "content").write.format("files").mode("append").save(path)
