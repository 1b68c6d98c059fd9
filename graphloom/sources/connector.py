"""The connector interface: a data source for listings of files, and texts of service records."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class _Folder(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)


class ListingReader(DataSourceReader):
    """One partition for each folder below the root, and one for the root's own files."""

    def __init__(self, root: str):
        self.root = root

    def _fs(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def partitions(self) -> list[InputPartition]:
        from pyarrow import fs

        f, at = self._fs()
        below = f.get_file_info(fs.FileSelector(at, recursive=True))
        return [_Folder(p) for p in [at, *(x.path for x in below if x.type == fs.FileType.Directory)]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        from pyarrow import fs

        f, _ = self._fs()
        for x in f.get_file_info(fs.FileSelector(partition.value)):
            if x.type == fs.FileType.File:
                yield x.path, x.size, x.mtime.replace(tzinfo=None) if x.mtime else None


class ListingSource(DataSource):
    """spark.read.format("file_listing").load(folder): path, size, modified. What a connector syncs from."""

    @classmethod
    def name(cls) -> str:
        return "file_listing"

    def schema(self) -> str:
        return "path string, size long, modified timestamp_ntz"

    def reader(self, schema) -> DataSourceReader:
        return ListingReader(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ListingSource)


def record_text(kind: str, title: Column, body: Column, who: Column) -> Column:
    """A record of a service (issue, page, message, contact) as text."""
    return F.concat_ws("\n", F.concat(F.lit(f"[{kind}] "), title), F.concat(F.lit("by "), who), body)
