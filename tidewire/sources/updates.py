"""Updates of a bot as a stream: spark.readStream.format("updates").

The offset is the number after the largest update_id that was taken, as the channel itself counts. A
micro-batch is the range of numbers between two offsets, cut into tasks; the checkpoint holds the offset, so
a restart goes on with the next number, neither losing an update nor taking one twice, however
often a batch is planned or run again. Numbers may have gaps, and updates may stand in any order.

The updates wait as JSON lines in folders named by their block of numbers, block=<update_id div size>, as
write_updates leaves them; the store is any that pyarrow opens by its path. Only the folder with the largest
number is read to find the newest offset, and a task reads the folders of its own range.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

UPDATE = "update_id long, at timestamp, user_id string, action string, data string"
BLOCK = 10_000


class UpdateFolder:
    """The waiting updates of one folder."""

    def __init__(self, path: str, block: int = BLOCK):
        self.path, self.block = path, block

    def _files(self, block: int | None = None) -> tuple:
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path if "://" in self.path else f"file://{self.path.removeprefix('file:')}")
        at = at if block is None else f"{at}/block={block}"
        found = store.get_file_info(fs.FileSelector(at, allow_not_found=True))
        return store, found

    def _rows(self, block: int) -> Iterator[dict]:
        store, found = self._files(block)
        for f in found:
            if f.base_name.startswith("part-"):
                with store.open_input_stream(f.path) as lines:
                    yield from map(json.loads, lines.read().splitlines())

    def next_offset(self) -> int:
        """One more than the largest number there is, 0 for none."""
        blocks = [int(f.base_name.partition("=")[2]) for f in self._files()[1] if f.base_name.startswith("block=")]
        for b in sorted(blocks, reverse=True):
            if (last := max((r["update_id"] for r in self._rows(b)), default=None)) is not None:
                return last + 1
        return 0

    def between(self, start: int, end: int) -> Iterator[tuple]:
        """The updates with start <= update_id < end."""
        for b in range(start // self.block, (end - 1) // self.block + 1):
            for r in self._rows(b):
                if start <= r["update_id"] < end:
                    at = r.get("at")
                    yield (r["update_id"], at and datetime.fromisoformat(at).astimezone(timezone.utc), r.get("user_id"), r.get("action"), r.get("data"))


class UpdateStream(DataSourceStreamReader):
    def __init__(self, folder: UpdateFolder, start: int):
        self.folder, self.start = folder, start

    def initialOffset(self) -> dict:
        return {"next": self.start}

    def latestOffset(self) -> dict:
        return {"next": max(self.start, self.folder.next_offset())}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        cuts = [*range(start["next"], end["next"], self.folder.block), end["next"]]
        return [InputPartition(pair) for pair in zip(cuts, cuts[1:])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        return self.folder.between(*partition.value)

    def commit(self, end: dict) -> None:
        """Nothing to confirm: what was taken stays in the folder until somebody clears it."""


class Updates(DataSource):
    """Options: path; block, the numbers of a folder; startingOffset, the first number of a new query."""

    @classmethod
    def name(cls) -> str:
        return "updates"

    def schema(self) -> str:
        return UPDATE

    def streamReader(self, schema) -> DataSourceStreamReader:
        folder = UpdateFolder(self.options["path"], int(self.options.get("block", BLOCK)))
        return UpdateStream(folder, int(self.options.get("startingOffset", 0)))


def write_updates(updates: DataFrame, path: str, block: int = BLOCK) -> None:
    """Add updates (columns of UPDATE) to a folder."""
    rows = updates.select("update_id", F.col("at").cast("timestamp").alias("at"), F.col("user_id").cast("string"), F.col("action").cast("string"), F.col("data").cast("string"))
    rows = rows.withColumn("block", F.floor(F.col("update_id") / block)).repartition("block")
    rows.write.mode("append").option("timestampFormat", "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX").partitionBy("block").json(path)


def read_updates(spark: SparkSession, path: str, **options) -> DataFrame:
    """The stream of a folder's updates."""
    spark.dataSource.register(Updates)
    return spark.readStream.format("updates").options(path=path, **options).load()
