"""A keyed table on plain Parquet that takes upserts from micro-batches.

Keys are dealt into buckets. A batch is reduced to the latest row of each of its keys and written as a
delta, one file per bucket it touches; nothing that is already there is rewritten. Compaction merges the
buckets that have deltas into new base files and leaves the others alone. A manifest, a small JSON document
of which every version is a file of its own, says what belongs to the table, so readers see whole batches
only and a failed write leaves nothing but files that no manifest names.

The last batch of every writer is part of the manifest: a batch that is run again after a restart changes
nothing. Rows are compared by their order columns and not by when they come, so repeated and late
batches are harmless: the latest row of a key wins, and rows that tie in all order columns are told apart
by a hash of the row. Deleted rows stay as markers, so that a late older row doesn't bring a key back.

One writer works on a table at a time; any number may read.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_MARK = "_mark"  # a hash of the row, the last order column


class StateTable:
    """A table of this path; keys and order are needed where it is new, and otherwise come from its manifest."""

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str] = (), order: Sequence[str] = (), buckets: int = 16, deleted: str | None = None, compact_after: int = 8):
        self.spark, self.path, self.compact_after = spark, path.rstrip("/"), compact_after
        self._fs = self._hadoop(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        if not self._versions() and not keys:
            raise ValueError(f"no table in {path}")
        if keys and not self._versions():
            self._commit({"version": 0, "keys": list(keys), "order": list(order), "buckets": buckets, "deleted": deleted, "schema": None, "base": {}, "deltas": [], "done": {}})

    def _hadoop(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _versions(self) -> list[int]:
        folder = self._hadoop(f"{self.path}/manifest")
        if not self._fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self) -> dict:
        """The newest version of what belongs to the table."""
        stream = self._fs.open(self._hadoop(f"{self.path}/manifest/{self._versions()[-1]:012d}.json"))
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _commit(self, manifest: dict) -> None:
        """Write the manifest beside its place and move it there, so that it is whole or absent."""
        final, draft = (self._hadoop(f"{self.path}/manifest/{n}") for n in (f"{manifest['version']:012d}.json", f"draft-{uuid.uuid4().hex}"))
        if self._fs.exists(final):
            raise RuntimeError("another writer changed the table")
        out = self._fs.create(draft, False)
        out.write(json.dumps(manifest).encode())
        out.close()
        if not self._fs.rename(draft, final):
            raise RuntimeError("another writer changed the table")

    def _latest(self, rows: DataFrame, m: dict) -> DataFrame:
        rest = [F.col(f"`{c}`") for c in rows.columns if c not in m["keys"]]
        last = F.max_by(F.struct(*rest), F.struct(*m["order"], _MARK)).alias("_last")
        return rows.groupBy(*m["keys"]).agg(last).select(*m["keys"], "_last.*")

    def _write(self, rows: DataFrame, m: dict) -> tuple[str, list[int]]:
        """Write rows by bucket; the folder and the buckets that have rows."""
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        bucket = F.pmod(F.xxhash64(*m["keys"]), F.lit(m["buckets"]))
        rows.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(folder)
        found = [s.getPath().getName() for s in self._fs.listStatus(self._hadoop(folder))]
        return folder, sorted(int(n.partition("=")[2]) for n in found if n.startswith("_bucket="))

    def _scan(self, m: dict, base: dict[str, str], deltas: list[dict]) -> DataFrame:
        """The rows of some base buckets and of the given buckets of deltas."""
        paths = [f"{folder}/_bucket={b}" for b, folder in base.items()] + [f"{d['folder']}/_bucket={b}" for d in deltas for b in d["buckets"]]
        schema = StructType.fromJson(m["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def upsert(self, rows: DataFrame, batch: int, writer: str = "") -> bool:
        """Take a batch in; False if this writer's batch, or a later one, is in the table already."""
        m = self.manifest()
        if m["done"].get(writer, -1) >= batch:
            return False
        rows = rows.withColumn(_MARK, F.xxhash64(*(F.col(f"`{f.name}`") for f in rows.schema.fields if "map<" not in f.dataType.simpleString())))
        if m["schema"] is None:
            m["schema"] = self._latest(rows, m).schema.jsonValue()
        folder, buckets = self._write(self._latest(rows, m).select(StructType.fromJson(m["schema"]).names), m)
        m["deltas"] += [{"folder": folder, "buckets": buckets}] if buckets else []
        m["done"][writer] = batch
        m["version"] += 1
        self._commit(m)
        if len(m["deltas"]) >= self.compact_after:
            self.compact()
        return True

    def compact(self) -> None:
        """Merge the deltas into the base of the buckets that they touch, and delete what is no longer read."""
        m = self.manifest()
        touched = {b for d in m["deltas"] for b in d["buckets"]}
        if not touched:
            return
        rows = self._scan(m, {b: f for b, f in m["base"].items() if int(b) in touched}, m["deltas"])
        folder, buckets = self._write(self._latest(rows, m), m)
        m["base"] |= {str(b): folder for b in buckets}
        m["deltas"] = []
        m["version"] += 1
        self._commit(m)
        self.vacuum()

    def vacuum(self, keep: int = 2) -> None:
        """Delete files that the last `keep` versions don't name; readers of older versions are then lost."""
        versions = self._versions()
        named = set()
        for v in versions[-keep:]:
            stream = self._fs.open(self._hadoop(f"{self.path}/manifest/{v:012d}.json"))
            m = json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
            stream.close()
            named |= {*m["base"].values(), *(d["folder"] for d in m["deltas"])}
        data = self._hadoop(f"{self.path}/data")
        for s in self._fs.listStatus(data) if self._fs.exists(data) else ():
            if s.getPath().getName() not in {n.rpartition("/")[2] for n in named}:
                self._fs.delete(s.getPath(), True)
        for v in versions[:-keep]:
            self._fs.delete(self._hadoop(f"{self.path}/manifest/{v:012d}.json"), False)

    def read(self, where: Column | None = None) -> DataFrame:
        """The latest row of every key that isn't deleted; buckets without deltas are only scanned, not merged."""
        m = self.manifest()
        if m["schema"] is None:
            raise ValueError("no batch has come yet")
        touched = {b for d in m["deltas"] for b in d["buckets"]}
        still = {b: f for b, f in m["base"].items() if int(b) not in touched}
        rows = self._scan(m, still, [])
        if touched:
            rows = rows.unionByName(self._latest(self._scan(m, {b: f for b, f in m["base"].items() if int(b) in touched}, m["deltas"]), m))
        if m["deleted"]:
            rows = rows.where(f"NOT coalesce({m['deleted']}, false)")
        return (rows if where is None else rows.where(where)).drop(_MARK)

    def sink(self, writer: str = ""):
        """A foreachBatch function that takes every micro-batch in."""
        return lambda rows, batch: self.upsert(rows, batch, writer) and None
