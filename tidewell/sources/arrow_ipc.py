"""Arrow IPC and Feather files as a Spark data source: one partition per file, one file per task."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType


def _files(path: str) -> tuple[object, list[str]]:
    from pyarrow import fs

    system, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))
    info = system.get_file_info(root)
    if info.is_file:
        return system, [root]
    inside = system.get_file_info(fs.FileSelector(root, recursive=True))
    data = [i.path for i in inside if i.is_file and i.path.endswith((".arrow", ".feather"))]
    return system, sorted(data)


def _open(system, path: str):
    from pyarrow import ipc

    source = system.open_input_file(path)
    try:
        return ipc.open_file(source)
    except Exception:
        source.seek(0)
        return ipc.open_stream(source)


def schema_of(path: str) -> StructType:
    """The schema of the first file."""
    from pyspark.sql.pandas.types import from_arrow_schema

    system, paths = _files(path)
    if not paths:
        raise FileNotFoundError(path)
    return from_arrow_schema(_open(system, paths[0]).schema)


class ArrowFile(InputPartition):
    def __init__(self, path: str):
        super().__init__(path)
        self.path = path


class Written(WriterCommitMessage):
    pass


class ArrowReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [ArrowFile(p) for p in _files(self.path)[1]]

    def read(self, partition: ArrowFile) -> Iterator:
        from pyarrow import ipc

        system, _ = _files(self.path)
        opened = _open(system, partition.path)
        if isinstance(opened, ipc.RecordBatchFileReader):
            for i in range(opened.num_record_batches):
                yield opened.get_batch(i)
        else:
            yield from opened


class ArrowWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path = path.removeprefix("file:")

    def write(self, batches: Iterator) -> WriterCommitMessage:
        from pyarrow import fs, ipc

        system, root = (
            fs.FileSystem.from_uri(self.path) if "://" in self.path else (fs.LocalFileSystem(), self.path)
        )
        system.create_dir(root, recursive=True)
        name = f"{root}/part-{uuid.uuid4().hex}"
        writer = None
        for batch in batches:
            if writer is None:
                # written under a name readers skip, so a lost task leaves nothing behind
                out = system.open_output_stream(f"{name}.partial")
                writer = ipc.new_file(out, batch.schema)
            writer.write_batch(batch)
        if writer is not None:
            writer.close()
            out.close()
            system.move(f"{name}.partial", f"{name}.arrow")
        return Written()


class ArrowIpc(DataSource):
    """``spark.read.format("arrow_ipc").load(path)`` and ``df.write.format("arrow_ipc").save(path)``."""

    @classmethod
    def name(cls) -> str:
        return "arrow_ipc"

    def schema(self) -> StructType:
        return schema_of(self.options["path"])

    def reader(self, schema: StructType) -> ArrowReader:
        return ArrowReader(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> ArrowWriter:
        return ArrowWriter(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ArrowIpc)


def read(spark: SparkSession, path: str) -> DataFrame:
    """Looking up the schema here saves Spark a Python process for it."""
    register(spark)
    return spark.read.format("arrow_ipc").schema(schema_of(path)).load(path)
