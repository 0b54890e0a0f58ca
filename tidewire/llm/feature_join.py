"""Point-in-time join: for each ask the latest version that was known and not expired, by interval trees.

A version is usable at t if start <= t < expiry, where start is the later of its event and its arrival.
Time is cut into chunks and a version goes into each chunk of its source that it overlaps; versions
that would overlap more than `reach` chunks go to a level of chunks twice, four times, ... as long, so no
version is copied more than reach + 1 times. An ask goes to the one chunk of each level that holds its t.

A chunk of a source with many rows is cut into a grid: `block` versions by `block` asks at most, in
expectation, dealt by hashes, so a hot source or moment is many bounded groups. Each group builds a
balanced tree over its versions: sorted by start, node i of height h being the middle of its
2^(h+1) - 1 neighbours, each with the largest expiry below it. A walk from the root prunes subtrees that
have expired and right sides that start after t, so it meets exactly the stabbed intervals; all of
them are enumerated and the lexicographic maximum (latest event, earliest arrival, largest id) stays.
The winners of the groups of an ask are then compared by an ordinary aggregation.

Nothing that grows with the input goes to the driver, into a broadcast or into one task: the driver
reads only which levels exist, at most one per doubling of a length.

Defined cases: versions with a null source, id or time, or that end before they start, are never used;
asks about a document without a source, or without an id or any document, have no winner; a label whose
document stands in several rows asks about the least of their sources; equal labels are answered each;
versions that tie in event, arrival and id are told apart by n_chars, then lang, the larger first, nulls
last; texts are never read; empty tables give no rows or no winners; other columns are ignored,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.llm.shingles import release
from tidewire.runtime import settle

CHUNK = 256  # seconds of a chunk on the lowest level
REACH = 4  # chunks that a version may be as long as
BLOCK = 32_768  # versions, and asks, of a group
STALE = 120
_WALK = 1 << 21  # nodes that a walk may hold at once


class IntervalTree:
    """Balanced tree over intervals [start, expiry) that are sorted by start."""

    def __init__(self, start: np.ndarray, expiry: np.ndarray):
        self.start, self.expiry, n = start, expiry, len(start)
        self.height = max(0, n.bit_length() - 1)
        self.latest = expiry.copy()  # of the node and all below it
        for h in range(1, self.height + 1):
            at = np.arange((1 << h) - 1, n, 1 << (h + 1))
            half = 1 << (h - 1)
            best = np.maximum(self.latest[at], self.latest[at - half])
            self.latest[at] = np.maximum(best, self._right(at + half, h - 1))

    def _right(self, at: np.ndarray, h: int) -> np.ndarray:
        """Largest expiry below the right children; where the child itself is past the end, its left part counts."""
        out = np.full(len(at), np.iinfo(np.int64).min)
        todo = np.arange(len(at))
        while len(todo):
            inside = at[todo] < len(self.start)
            out[todo[inside]] = self.latest[at[todo[inside]]]
            todo = todo[~inside]
            if h == 0:
                break
            h -= 1
            at = at.copy()
            at[todo] -= 1 << h
        return out

    def stabbed(self, t: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (number of the ask, number of the interval) of all intervals that hold t, level by level."""
        if not len(self.start):
            return
        ask, node = np.arange(len(t)), np.full(len(t), (1 << self.height) - 1)
        for h in range(self.height, -1, -1):
            real = node < len(self.start)
            live = ~real
            live[real] = self.latest[node[real]] > t[ask[real]]
            ask, node, real = ask[live], node[live], real[live]
            started = np.zeros(len(node), bool)
            started[real] = self.start[node[real]] <= t[ask[real]]
            hit = np.flatnonzero(started)
            hit = hit[self.expiry[node[hit]] > t[ask[hit]]]
            yield ask[hit], node[hit]
            if h == 0:
                return
            half = 1 << (h - 1)
            # a node past the end stands for its left part only
            ask, node = np.concatenate((ask, ask[started])), np.concatenate((node - half, node[started] + half))


def latest_of(tree: IntervalTree, order: np.ndarray, t: np.ndarray) -> np.ndarray:
    """For each t the stabbed interval of the largest order, or -1; asks go through in blocks of bounded size."""
    best = np.full(len(t), -1, np.int64)
    step = max(1, _WALK // max(1, len(order)))
    for begin in range(0, len(t), step):
        mine = best[begin : begin + step]
        for ask, node in tree.stabbed(t[begin : begin + step]):
            np.maximum.at(mine, ask, order[node])
    return best


ANSWER = "ask_id long, event long, arrival long, version_id long, n_chars long, lang string"
_ANSWER = pa.schema([("ask_id", pa.int64()), ("event", pa.int64()), ("arrival", pa.int64()), ("version_id", pa.int64()), ("n_chars", pa.int64()), ("lang", pa.string())])


def _answer(versions: pa.Table, asks: pa.Table) -> pa.Table:
    """The winner of each ask of one group; asks without one are left out."""
    if not versions.num_rows or not asks.num_rows:
        return _ANSWER.empty_table()
    keys = [("event", "ascending"), ("arrival", "descending"), ("version_id", "ascending"), ("n_chars", "ascending"), ("lang", "ascending")]
    ranked = versions.take(pc.sort_indices(versions, keys, null_placement="at_start"))
    start = np.maximum(ranked["event"].to_numpy(), ranked["arrival"].to_numpy())
    by_start = np.argsort(start, kind="stable")  # the place in `ranked` is the order among versions
    tree = IntervalTree(start[by_start], ranked["expiry"].to_numpy()[by_start])
    best = latest_of(tree, by_start, asks["t"].to_numpy())
    has = np.flatnonzero(best >= 0)
    won = ranked.take(pa.array(best[has]))
    columns = [asks["ask_id"].take(pa.array(has)), *(won[c] for c in _ANSWER.names[1:])]
    out = pa.Table.from_arrays([c.cast(f.type) for c, f in zip(columns, _ANSWER)], schema=_ANSWER)
    release()
    return out


def _copies(rows: Column, block: int) -> Column:
    return F.greatest(F.ceil(rows / block), F.lit(1)).cast("int")


def latest_versions(versions: DataFrame, asks: DataFrame, chunk: int = CHUNK, reach: int = REACH, block: int = BLOCK) -> DataFrame:
    """ask_id with event, arrival, version_id, n_chars and lang of its winner; asks without one are left out.

    versions: source, version_id, event, arrival, expiry, n_chars, lang. asks: source, t and ask_id, which tells them apart.
    """
    start = F.greatest("event", "arrival")
    known = versions.where("source IS NOT NULL AND version_id IS NOT NULL AND event IS NOT NULL AND arrival IS NOT NULL").where(start < F.col("expiry"))
    # the lowest level at which the length is `reach` chunks at most
    level = F.greatest(F.lit(0), F.ceil(F.log2((F.col("expiry") - start).cast("double") / (chunk * reach)))).cast("int")
    width = F.call_function("shiftleft", F.lit(chunk).cast("long"), F.col("level"))
    known = known.withColumn("level", level)
    spread = known.select("*", F.explode(F.sequence(F.floor(start / width), F.floor((F.col("expiry") - 1) / width))).alias("chunk"))
    spread = settle(spread.withColumn("salt", F.pmod(F.xxhash64("version_id", "event", "n_chars"), F.lit(1 << 30))))
    levels = sorted(r["level"] for r in spread.select("level").distinct().collect())
    mine = asks.where("source IS NOT NULL AND t IS NOT NULL").select("source", "t", "ask_id", F.explode(F.array(*map(F.lit, levels)) if levels else F.array().cast("array<int>")).alias("level"))
    mine = mine.withColumn("chunk", F.floor(F.col("t") / width)).withColumn("salt", F.pmod(F.xxhash64("ask_id"), F.lit(1 << 30)))

    cell = ["source", "level", "chunk"]
    nv = spread.groupBy(*cell).agg(F.count(F.lit(1)).alias("nv"))
    na = mine.groupBy(*cell).agg(F.count(F.lit(1)).alias("na"))
    grid = settle(nv.join(na, cell).select(*cell, _copies(F.col("nv"), block).alias("rows"), _copies(F.col("na"), block).alias("cols")))
    # chunks without asks or without versions meet nobody and end here; both sides' row and col are ints, as
    # Spark deals an int and a long of the same value out to different tasks
    place = lambda n: F.pmod("salt", n).cast("int")
    left = spread.join(grid, cell).select(
        *cell, place("rows").alias("row"), F.explode(F.sequence(F.lit(0), F.col("cols") - 1)).alias("col"), "version_id", "event", "arrival", "expiry", "n_chars", "lang"
    )
    right = mine.join(grid, cell).select(*cell, F.explode(F.sequence(F.lit(0), F.col("rows") - 1)).alias("row"), place("cols").alias("col"), "ask_id", "t")
    group = [*cell, "row", "col"]
    found = left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(_answer, ANSWER)
    # structs compare field by field, nulls first; the earliest arrival is the largest of its negatives
    best = F.max(F.struct("event", (-F.col("arrival")).alias("late"), "version_id", "n_chars", "lang")).alias("b")
    return found.groupBy("ask_id").agg(best).select("ask_id", "b.event", (-F.col("b.late")).alias("arrival"), "b.version_id", "b.n_chars", "b.lang")


def _part(k: int) -> Column:
    """The k-th group of eight hex digits of the digest of doc_id, as a number."""
    return F.conv(F.substring(F.sha2(F.col("doc_id").cast("string"), 256), 8 * k + 1, 8), 16, 10).cast("long")


def versions_of(documents: DataFrame) -> DataFrame:
    """Each document as a version of its source, in whole seconds."""
    rows = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.col("n_chars").cast("long"), F.col("lang").cast("string"))
    rows = rows.where("doc_id IS NOT NULL AND source IS NOT NULL").withColumn("event", _part(0) % 50_000)
    return rows.select(
        "source", F.col("doc_id").alias("version_id"), "event", (F.col("event") - 60 + _part(1) % 600).alias("arrival"), (F.col("event") + _part(2) % 900).alias("expiry"), "n_chars", "lang"
    )


def features(documents: DataFrame, labels: DataFrame, stale: int = STALE, **options) -> DataFrame:
    """doc_id, t, version_id, age, status, n_chars and lang of every label."""
    ids = labels.select(F.col("doc_id").cast("long"))
    asked = ids.where("doc_id IS NOT NULL").distinct()  # equal labels have equal answers
    sources = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string")).where("doc_id IS NOT NULL AND source IS NOT NULL")
    asks = settle(asked.join(sources, "doc_id").groupBy("doc_id").agg(F.min("source").alias("source")).select("source", (_part(3) % 50_000).alias("t"), F.col("doc_id").alias("ask_id")))
    won = latest_versions(versions_of(documents), asks, **options)
    each = ids.where("doc_id IS NOT NULL").alias("l").join(won.alias("w"), F.expr("l.doc_id = w.ask_id"), "left")
    each = each.select("l.doc_id", "w.version_id", "w.event", "w.n_chars", "w.lang")
    # labels without an id never meet a key, so they aren't sent to one task
    each = each.unionByName(ids.where("doc_id IS NULL").select("doc_id", *(F.lit(None).cast(k).alias(c) for c, k in (("version_id", "long"), ("event", "long"), ("n_chars", "long"), ("lang", "string")))))
    age = F.col("t") - F.col("event")
    status = F.when(F.col("version_id").isNull(), "none").when(age > stale, "stale").otherwise("fresh")
    fresh = F.col("status") == "fresh"
    return (
        each.withColumn("t", _part(3) % 50_000)
        .withColumn("age", age)
        .withColumn("status", status)
        .select("doc_id", "t", "version_id", "age", "status", F.when(fresh, F.col("n_chars")).alias("n_chars"), F.when(fresh, F.col("lang")).alias("lang"))
    )
