"""A stream of wire messages out of a folder of logs: register(spark), then format("finscan_frames").

Each file of the folder, in the order of names, holds one message a line; files are added, never
changed. An offset is the number of files taken, and every file is a partition of its batch, read by
an executor. So a batch that is run again reads the same lines.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def _files(folder: str) -> list[str]:
    fs, at = pafs.FileSystem.from_uri(folder)
    found = fs.get_file_info(pafs.FileSelector(at, allow_not_found=True))
    return sorted(f.path for f in found if f.type == pafs.FileType.File and not f.base_name.startswith((".", "_")))


class _File(InputPartition):
    def __init__(self, number: int, path: str):
        self.number, self.path = number, path


class _Lines:
    def __init__(self, folder: str):
        self.folder = folder

    def read(self, partition: _File) -> Iterator[tuple[int, str]]:
        fs, _ = pafs.FileSystem.from_uri(self.folder)
        with fs.open_input_stream(partition.path) as f:
            rest, line = b"", 0
            while data := f.read(1 << 20):
                *whole, rest = (rest + data).split(b"\n")
                for text in whole:
                    yield (partition.number << 32) + line, text.decode("utf-8", "replace")
                    line += 1
            if rest:
                yield (partition.number << 32) + line, rest.decode("utf-8", "replace")


class _Batch(_Lines, DataSourceReader):
    def partitions(self) -> list[_File]:
        return [_File(i, p) for i, p in enumerate(_files(self.folder))]


class _Stream(_Lines, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {"files": 0}

    def latestOffset(self) -> dict:
        return {"files": len(_files(self.folder))}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [_File(i, p) for i, p in enumerate(_files(self.folder)) if start["files"] <= i < end["files"]]


class FrameLog(DataSource):
    """(seq long, message string); option path: the folder's URI."""

    @classmethod
    def name(cls) -> str:
        return "finscan_frames"

    def schema(self) -> str:
        return "seq long, message string"

    def reader(self, schema) -> _Batch:
        return _Batch(self.options["path"])

    def streamReader(self, schema) -> _Stream:
        return _Stream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameLog)
