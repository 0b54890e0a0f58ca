"""Delivery in two steps: stream.writeStream.format("outbox").

Tasks only stage their messages. When all tasks of a micro-batch have succeeded, the driver publishes the batch by
one small file that names the staged ones; until then no reader sees any of them. A batch that was published
before, as when the query stops between publishing and its own checkpoint, publishes nothing again, and
what a failed or repeated task left behind is never named. Messages have a chat, an issue and a part; the
parts of an issue are read in order, also if several tasks staged them.

The driver handles file names, one per task, and never messages.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamWriter, WriterCommitMessage

MESSAGE = "chat string, issue long, part int, body string"


@dataclass
class _Staged(WriterCommitMessage):
    name: str | None


class _Store:
    """A folder that pyarrow opens by its path."""

    def __init__(self, path: str):
        from pyarrow import fs

        self.fs, self.root = fs.FileSystem.from_uri(path if "://" in path else f"file://{path.removeprefix('file:')}")

    def put(self, name: str, lines: Iterable[str]) -> None:
        at = f"{self.root}/{name}"
        self.fs.create_dir(at.rpartition("/")[0], recursive=True)
        draft = f"{at.rpartition('/')[0]}/.{uuid.uuid4().hex}"
        with self.fs.open_output_stream(draft) as out:
            for line in lines:
                out.write(f"{line}\n".encode())
        self.fs.move(draft, at)  # whole or absent

    def has(self, name: str) -> bool:
        from pyarrow import fs

        return self.fs.get_file_info(f"{self.root}/{name}").type != fs.FileType.NotFound

    def delete(self, name: str) -> None:
        if self.has(name):
            self.fs.delete_file(f"{self.root}/{name}")

    def names(self, folder: str) -> list[str]:
        from pyarrow import fs

        found = self.fs.get_file_info(fs.FileSelector(f"{self.root}/{folder}", allow_not_found=True))
        return sorted(f.base_name for f in found if not f.base_name.startswith("."))

    def get(self, name: str) -> str:
        with self.fs.open_input_stream(f"{self.root}/{name}") as f:
            return f.read().decode()


class OutboxWriter(DataSourceStreamWriter):
    def __init__(self, path: str):
        self.path = path

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        first = next(iterator, None)
        if first is None:
            return _Staged(None)
        name = f"staged/{uuid.uuid4().hex}.json"
        _Store(self.path).put(name, (json.dumps(r.asDict(), ensure_ascii=False) for r in chain([first], iterator)))
        return _Staged(name)

    def commit(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        store, names = _Store(self.path), [m.name for m in messages if m and m.name]
        if store.has(f"published/{batchId:012d}.json"):
            for n in names:
                store.delete(n)
            return
        store.put(f"published/{batchId:012d}.json", [json.dumps(names)])

    def abort(self, messages: list[WriterCommitMessage | None], batchId: int) -> None:
        store = _Store(self.path)
        for m in messages:
            if m and m.name:
                store.delete(m.name)


class Outbox(DataSource):
    """Option: path."""

    @classmethod
    def name(cls) -> str:
        return "outbox"

    def schema(self) -> str:
        return MESSAGE

    def streamWriter(self, schema, overwrite: bool) -> DataSourceStreamWriter:
        return OutboxWriter(self.options["path"])


def deliver(messages: DataFrame, path: str, checkpoint: str):
    """Start a query that publishes all messages that are there (columns of MESSAGE), and ends."""
    messages.sparkSession.dataSource.register(Outbox)
    rows = messages.selectExpr(*(f"CAST({c} AS {k}) AS {c}" for c, k in (x.split() for x in MESSAGE.split(", "))))
    return rows.writeStream.format("outbox").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def published(spark: SparkSession, path: str) -> DataFrame:
    """Every published message once, with its batch; order by chat, issue and part to read them."""
    store = _Store(path)
    batches = [(n.rpartition("/")[2], int(b.removesuffix(".json"))) for b in store.names("published") for n in json.loads(store.get(f"published/{b}"))]
    if not batches:
        return spark.createDataFrame([], f"{MESSAGE}, batch long")
    named = spark.createDataFrame(batches, "_file string, batch long")
    rows = spark.read.schema(MESSAGE).json([f"{path}/staged/{n}" for n, _ in batches]).select("*", F.col("_metadata.file_name").alias("_file"))
    return rows.join(named, "_file").drop("_file")
