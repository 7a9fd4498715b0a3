"""Files of a folder and their first lines, by one small read a file."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Bytes of a first read; a longer first line takes further ones, four times as long each.
FIRST_READ = 8 << 10
#: A first line without an end up to here is an error.
LONGEST_LINE = 1 << 20
#: Files that one task looks at.
FILES_PER_TASK = 64


def _location(spark: SparkSession, path: str) -> str | None:
    """The path as pyarrow takes it (a plain path is local), or None where pyarrow can't open it."""
    import pyarrow as pa
    from pyarrow import fs

    home = spark._jsc.hadoopConfiguration().get("fs.defaultFS") or "file:///"
    scheme = urlsplit(path).scheme if "://" in path or path.startswith("file:") else urlsplit(home).scheme
    if scheme == "file":
        return unquote(urlsplit(path).path) if path.startswith("file:") else path
    try:
        fs.FileSystem.from_uri(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError, OSError, ValueError, TypeError):
        return None
    return path


def _source() -> type[DataSource]:
    # Local classes travel to the workers by value, so these need not have the package.
    first_read, longest, per_task = FIRST_READ, LONGEST_LINE, FILES_PER_TASK

    class Files(InputPartition):
        def __init__(self, files: list[tuple[str, str, int, object]]) -> None:
            self.files = files

    class Reader(DataSourceReader):
        def __init__(self, options: dict) -> None:
            self.path, self.suffix, self.heads = options["path"], options["suffix"], options["heads"] == "true"
            self.only = options.get("only")

        def _opened(self):
            from pyarrow import fs

            return (fs.LocalFileSystem(), self.path) if "://" not in self.path else fs.FileSystem.from_uri(self.path)

        def partitions(self) -> list[InputPartition]:
            from pyarrow import fs

            system, path = self._opened()
            top = system.get_file_info(path)
            found = [top] if top.type == fs.FileType.File else system.get_file_info(fs.FileSelector(path))
            only = set(self.only.split("/")) if self.only is not None else None
            # Names that start so are hidden from Spark's readers, too.
            files = sorted(
                (f.path, f.base_name, f.size, f.mtime) for f in found
                if f.type == fs.FileType.File and f.base_name.endswith(self.suffix) and not f.base_name.startswith(("_", ".")) and (only is None or f.base_name in only)
            )
            return [Files(files[k : k + per_task]) for k in range(0, len(files), per_task)]

        def read(self, partition: InputPartition):
            if partition is None:  # a folder without such files
                return
            system, _ = self._opened()
            for path, name, size, modified in partition.files:
                head, n = b"", first_read
                if self.heads:
                    with system.open_input_file(path) as f:
                        while b"\n" not in head and len(head) < size:
                            if len(head) >= longest:
                                raise ValueError(f"no line end in the first {longest} bytes of {path}")
                            head += f.read(min(n, longest - len(head)))
                            n *= 4
                line = head.split(b"\n", 1)[0].decode("utf-8", "replace").removeprefix("﻿").rstrip("\r")
                yield name, size, modified, line if self.heads else None, len(head)

    class FileHeads(DataSource):
        @classmethod
        def name(cls) -> str:
            return "file_heads"

        def schema(self) -> str:
            return "file string, size long, modified timestamp, head string, bytes_read long"

        def reader(self, schema) -> DataSourceReader:
            return Reader(self.options)

    return FileHeads


def list_files(spark: SparkSession, path: str, suffix: str = ".csv", heads: bool = False, only: list[str] | None = None) -> DataFrame | None:
    """Rows ``file`` (name), ``size``, ``modified``, ``head``, ``bytes_read`` for the files of a folder, or one file.

    With ``heads`` the first line of each is read, by a first read of ``FIRST_READ`` bytes; ``only`` names the files to look at. A missing
    path is Spark's error. None where the storage opens to Spark's readers alone.
    """
    spark.read.text(path)  # raises PATH_NOT_FOUND
    location = _location(spark, path)
    if location is None:
        return None
    spark.dataSource.register(_source())
    reader = spark.read.format("file_heads").option("suffix", suffix).option("heads", str(heads).lower())
    if only is not None:
        reader = reader.option("only", "/".join(only))  # no name holds a slash
    return reader.load(location)
