"""Keyed feeds as a Spark source of their own: `spark.read.format("feed")` and `spark.readStream.format("feed")`.

A feed folder has a folder for each delivery, in order of their names, with JSON lines of external_id
and title. The option `source_type` names the feed. A file is a partition; a stream's offset is the
last delivery that it has read, so that a restart goes on behind it. Folders may be in any store that
pyarrow's file systems know.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "source_type string, external_id string, title string, delivery string"


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Folder:
    """What both readers know: the files of the deliveries and the rows of a file."""

    def __init__(self, options: dict) -> None:
        self.kind, self.uri = options["source_type"], options["path"]

    def files(self) -> list[tuple[str, str]]:
        """(delivery, path) in order; names that begin with _ or . are no data."""
        store, root = fs.FileSystem.from_uri(self.uri)
        found = store.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
        own = [(f.path[len(root) :].strip("/").split("/"), f.path) for f in found if f.is_file]
        return sorted((parts[0], path) for parts, path in own if len(parts) > 1 and not any(p[0] in "_." for p in parts))

    def rows(self, path: str) -> Iterator[tuple]:
        store, root = fs.FileSystem.from_uri(self.uri)
        delivery = path[len(root) :].strip("/").split("/")[0]
        with store.open_input_stream(path) as source:
            rest = b""
            while block := source.read(1 << 20):
                *lines, rest = (rest + block).split(b"\n")
                for line in lines:
                    yield from self._row(line, delivery)
            yield from self._row(rest, delivery)

    def _row(self, line: bytes, delivery: str) -> Iterator[tuple]:
        if line.strip():
            item = json.loads(line)
            if item.get("external_id") is not None:  # an item without a key is none
                yield self.kind, str(item["external_id"]), item.get("title"), delivery


class _Batch(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.folder = _Folder(options)

    def partitions(self) -> list[InputPartition]:
        return [_File(path) for _, path in self.folder.files()]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.folder.rows(partition.path) if isinstance(partition, _File) else iter(())


class _Stream(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.folder = _Folder(options)

    def initialOffset(self) -> dict:
        return {"delivery": ""}

    def latestOffset(self) -> dict:
        return {"delivery": max((d for d, _ in self.folder.files()), default="")}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(path) for d, path in self.folder.files() if start["delivery"] < d <= end["delivery"]]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.folder.rows(partition.path)

    def commit(self, end: dict) -> None:
        pass


class Feed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers need no copy of this package
    spark.dataSource.register(Feed)


def deliver(items: DataFrame, folder: str, number: int, key: str, title: str) -> None:
    """One delivery of a feed: items as JSON lines below folder."""
    items.select(F.col(key).cast("string").alias("external_id"), F.col(title).alias("title")).write.mode("overwrite").json(f"{folder}/{number:06d}")


def items(spark: SparkSession, folder: str, source_type: str) -> DataFrame:
    register(spark)
    return spark.read.format("feed").option("source_type", source_type).load(folder)


def item_stream(spark: SparkSession, folder: str, source_type: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("feed").option("source_type", source_type).load(folder)
