"""Heartbeat files as tables and streams: only the time of change of device_<n>.heartbeat matters.

The files are empty, and Spark's own file sources pass over empty files, so each
folder is listed by one task of a Python source.
"""

from __future__ import annotations

import datetime as dt
import re
from collections.abc import Iterator, Sequence

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition


def _beats(folder: str) -> Iterator[tuple[int, int]]:
    """(device, milliseconds) of a folder's files; a folder that is missing has none. A URI names its own file system."""
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder) if re.match(r"\w+:/", folder) else (fs.LocalFileSystem(), folder)
    for info in store.get_file_info(fs.FileSelector(path, allow_not_found=True)):
        if m := re.fullmatch(r"device_(\d+)\.heartbeat", info.base_name):
            yield int(m[1]), info.mtime_ns // 1_000_000


class Folder(InputPartition):
    """A folder, and the times after which and up to which its heartbeats count."""

    def __init__(self, path: str, after: int, upto: int):
        super().__init__(path)
        self.path, self.after, self.upto = path, after, upto

    def rows(self) -> Iterator[tuple]:
        for device, ms in sorted(_beats(self.path)):
            if self.after < ms <= self.upto:
                yield device, dt.datetime.fromtimestamp(ms / 1000, dt.timezone.utc)


class HeartbeatReader(DataSourceReader):
    def __init__(self, folders: Sequence[str]):
        self.folders = folders

    def partitions(self) -> list[InputPartition]:
        return [Folder(f, -(2**63), 2**63) for f in self.folders]

    def read(self, partition: Folder) -> Iterator[tuple]:
        yield from partition.rows()


class HeartbeatStreamReader(DataSourceStreamReader):
    """Offsets are times: a batch has the files that changed after the last one's latest time, up to the latest now.

    A file holds its latest beat alone: one that changes again before it is read comes
    with the next batch. A change within the very millisecond of an offset is seen
    with the device's next beat.
    """

    def __init__(self, folders: Sequence[str]):
        self.folders, self.latest = folders, 0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"ms": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        self.latest = max([self.latest, *(ms for f in self.folders for _, ms in _beats(f))])
        return {"ms": self.latest}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Folder(f, start["ms"], end["ms"]) for f in self.folders]

    def read(self, partition: Folder) -> Iterator[tuple]:
        yield from partition.rows()


class HeartbeatSource(DataSource):
    """``spark.read`` or ``spark.readStream``, ``.format("heartbeat").load(folders)``: (device, seen_at); a partition for each of the comma-separated folders."""

    @classmethod
    def name(cls) -> str:
        return "heartbeat"

    def schema(self) -> str:
        return "device int, seen_at timestamp"

    def _folders(self) -> list[str]:
        return [f.strip() for f in self.options["path"].split(",") if f.strip()]

    def reader(self, schema) -> HeartbeatReader:  # noqa: ANN001, ARG002
        return HeartbeatReader(self._folders())

    def streamReader(self, schema) -> HeartbeatStreamReader:  # noqa: ANN001, ARG002, N802
        return HeartbeatStreamReader(self._folders())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(HeartbeatSource)
