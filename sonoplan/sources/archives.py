"""Tar archives as a data source: spark.dataSource.register(TarMembers), then spark.read.format("tar_members").option("suffix", ".wav").load(path)."""

from __future__ import annotations

import tarfile
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sonoplan.sources.metadata import open_file


class TarMembers(DataSource):
    """archive, member, content of the files in tar archives, compressed ones too, one partition per archive; a member at a time is in memory.

    Options: path (archives, separated by commas), suffix (of the members wanted, any case), most_bytes (a larger member is an error)."""

    @classmethod
    def name(cls) -> str:
        return "tar_members"

    def schema(self) -> str:
        return "archive string, member string, content binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


class _Archive(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.paths = [p for p in options.get("path", "").split(",") if p]
        self.suffix, self.most = options.get("suffix", "").lower(), int(options.get("most_bytes", str(1 << 30)))
        if not self.paths:
            raise ValueError("no archive is named")

    def partitions(self) -> list[InputPartition]:
        return [_Archive(p) for p in self.paths]

    def read(self, partition: _Archive) -> Iterator[tuple[str, str, bytes]]:
        with open_file(partition.path) as handle, tarfile.open(fileobj=handle, mode="r|*") as tar:
            for m in tar:
                if m.isfile() and m.name.lower().endswith(self.suffix):
                    if m.size > self.most:
                        raise ValueError(f"{m.name} has {m.size} bytes, at most {self.most} are read")
                    yield partition.path, m.name, tar.extractfile(m).read()
