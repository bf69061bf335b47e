"""Sending export records on."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

#: Records that a print shows at most; delivery has no such bound.
PRINTED = 20


def as_messages(records: DataFrame) -> DataFrame:
    """Records as one JSON ``value`` each."""
    return records.select(F.to_json(F.struct(*records.columns)).alias("value"))


@dataclass
class Written(WriterCommitMessage):
    """What one task attempt has written: its open file, and how many messages it holds."""

    name: str
    messages: int


class MessageWriter(DataSourceWriter):
    """One file per task attempt, under a name of its own; the driver makes those of the winners visible.

    A task that runs again writes another file, and only the attempt whose message
    reaches the driver counts, so each message is delivered once.
    """

    def __init__(self, path: str) -> None:
        self.path = path

    def _folder(self):
        from pyarrow import fs

        if "://" in self.path or self.path.startswith("file:"):
            return fs.FileSystem.from_uri(self.path)
        return fs.LocalFileSystem(), self.path

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = self._folder()
        files.create_dir(f"{root}/_open", recursive=True)
        name, n = f"{uuid.uuid4().hex}.jsonl", 0
        with files.open_output_stream(f"{root}/_open/{name}") as out:
            for row in iterator:
                out.write(row.value.encode() + b"\n")
                n += 1
        return Written(name, n)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = self._folder()
        files.create_dir(root, recursive=True)
        for done in messages:
            if done is not None and done.messages:
                files.move(f"{root}/_open/{done.name}", f"{root}/{done.name}")
        self._drop_open(files, root)
        with files.open_output_stream(f"{root}/_SUCCESS"):
            pass

    def abort(self, messages: list[Written | None]) -> None:
        self._drop_open(*self._folder())

    @staticmethod
    def _drop_open(files, root: str) -> None:
        from pyarrow import fs

        if files.get_file_info(f"{root}/_open").type == fs.FileType.Directory:
            files.delete_dir(f"{root}/_open")


class MessageFolder(DataSource):
    """``df.write.format("messages")``: the column ``value`` as lines in a folder."""

    @classmethod
    def name(cls) -> str:
        return "messages"

    def schema(self) -> str:
        return "value string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return MessageWriter(self.options["path"])


def event_export_sink(records: DataFrame, url: str, topic: str) -> None:
    """Sends records to a Kafka topic, to the folder ``url/topic``, or shows some of them.

    ``url`` is a list of brokers (``host:port``), a path or address of a file system with
    ``/`` in it, or ``print``. Tasks deliver their own records; none go through the driver
    but those that are printed, ``PRINTED`` at most.
    """
    messages = as_messages(records)
    if url == "print":
        for line in messages.limit(PRINTED).collect():
            print(line.value)
        return
    if "/" in url:
        records.sparkSession.dataSource.register(MessageFolder)
        messages.write.format("messages").mode("append").save(f"{url.rstrip('/')}/{topic}")
        return
    messages.write.format("kafka").option("kafka.bootstrap.servers", url).option("topic", topic).save()


def read_messages(records: DataFrame, path: str) -> DataFrame:
    """Messages of a folder as rows with the schema of ``records``."""
    lines = records.sparkSession.read.text(path, pathGlobFilter="*.jsonl")
    return lines.select(F.from_json("value", records.schema).alias("r")).select("r.*")
