"""A sink whose rows are files: the tasks write them, and a commit gives them their names."""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage


@dataclass
class Written(WriterCommitMessage):
    """Folder of a task's attempt and the names of its files."""

    folder: str
    names: list[str]


class FilesWriter(DataSourceWriter):
    """Every attempt of a task writes into a folder of its own, so a lost or repeated one leaves nothing in the result.

    The folders lie in a hidden one, ``_temporary-<job>``, which commit and abort delete. A task that is still running when its
    job fails may make it again; readers pass over it, and it can be deleted at any time after the job.
    """

    def __init__(self, path: str):
        self.path, self.job = path.rstrip("/"), uuid.uuid4().hex

    def _open(self) -> tuple[pafs.FileSystem, str]:
        if "://" not in self.path and not self.path.startswith("file:"):
            return pafs.LocalFileSystem(), self.path
        return pafs.FileSystem.from_uri(self.path if "://" in self.path else "file://" + self.path[5:])

    def write(self, iterator: Iterator) -> Written:
        store, base = self._open()
        folder, names = posixpath.join("_temporary-" + self.job, uuid.uuid4().hex), []
        store.create_dir(posixpath.join(base, folder), recursive=True)
        for row in iterator:
            if not row.name or "/" in row.name or row.name.startswith("_temporary-"):
                raise ValueError(f"file name {row.name!r}")
            with store.open_output_stream(posixpath.join(base, folder, row.name)) as out:
                out.write(bytes(row.content or b""))
            names.append(row.name)
        return Written(folder, names)

    def commit(self, messages: list) -> None:
        store, base = self._open()
        names = [n for m in messages if m for n in m.names]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same file name")
        for m in messages:
            for n in m.names if m else ():
                store.move(posixpath.join(base, m.folder, n), posixpath.join(base, n))
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, base = self._open()
        rest = posixpath.join(base, "_temporary-" + self.job)
        if store.get_file_info(rest).type == pafs.FileType.Directory:
            store.delete_dir(rest)


class FilesSource(DataSource):
    """Rows (name string, content binary) into files of the folder ``path``, which all machines share."""

    @classmethod
    def name(cls) -> str:
        return "velonet_files"

    def schema(self) -> str:
        return "name string, content binary"

    def writer(self, schema, overwrite: bool) -> FilesWriter:
        return FilesWriter(self.options["path"])


def write_files(files: DataFrame, path: str) -> None:
    """Write rows (name, content) as files of the folder ``path``. Names are to be unique; files of the same name are replaced.

    The driver moves the finished files to their names and sees no content. Null content makes an empty file. A path without
    a scheme belongs to the session's default file system.
    """
    spark = files.sparkSession
    spark.dataSource.register(FilesSource)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(folder)
    files.select("name", "content").write.format(FilesSource.name()).mode("append").save(store.makeQualified(folder).toString())
