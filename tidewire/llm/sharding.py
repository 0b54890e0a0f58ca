"""Shards of near equal bytes by a histogram sort, with DataFrame operations only.

Rows are ordered by a key of three numbers: the hash of the text, the hash of the id, and a number of
the row. The order is random over the corpus, and equal texts stand next to each other. A splitter is a
key with as near to k / shards of all bytes below it as asked for. Every round counts the exact bytes
of each part of the key ranges that still hold a splitter, over all partitions at once; the driver gets at most
`fan` sums for each such range, picks the part that the splitter lies in, and the next round probes
inside that part only. A part of a single hash goes on with the next number of the key, so a group
of equal texts, or of equal rows, of any size is cut where the bytes ask for it, and only there. A
splitter is settled when its bytes meet the tolerance, or when it stands next to a single row.

Then the rows are exchanged once: to `shards` times as many buckets as their number asks for, by the
shard and a hash of the key. Each bucket numbers its rows, and the counts of the buckets before it in its
shard are added, so slots have no gaps and no shard is ever one task.

Defined cases: a null text has no bytes, size 1 and the CRC of nothing, 0; null and repeated ids and
equal rows are rows like any others; a row is never cut, so shards differ by what one row and the
tolerance allow, and with fewer rows than shards some stay empty; an empty table gives no rows; columns in
`keep` pass through with the row, whatever their names, and all others are never read.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.runtime import settle, unused

SHARDS = 16
TOLERANCE = 0.001  # of a shard's bytes
FAN = 1024  # probes of a key range and round
BUCKET_ROWS, BUCKET_BYTES = 16_384, 64 << 20
KEYS = ("_k0", "_k1", "_k2")
SLOT, SHARD, BUCKET = "slot", "shard", "_bucket"


@dataclass(frozen=True)
class _Range:
    """Keys with these first numbers and the next one from low to high."""

    head: tuple[int, ...]
    low: int
    high: int

    def step(self, fan: int) -> int:
        return max(1, -(-(self.high - self.low + 1) // fan))

    def holds(self) -> Column:
        here = F.col(KEYS[len(self.head)]).between(self.low, self.high)
        for k, x in zip(KEYS, self.head):
            here = here & (F.col(k) == x)
        return here


@dataclass
class _Splitter:
    """Where bytes up to `aim` end: key is the first key above it once it is known."""

    aim: float
    at: _Range
    below: int = 0
    key: tuple[int, ...] | None = field(default=None)


def keyed(documents: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """doc_id, size, text_crc32 and the numbers of the key, settled, with the columns in keep."""
    text = F.col("text").cast("string")
    hashes = (F.xxhash64(text), F.xxhash64(F.col("doc_id").cast("string")))
    return settle(
        documents.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"),
            *(F.shiftrightunsigned(h, 2).alias(k) for h, k in zip(hashes, KEYS)),
            F.monotonically_increasing_id().alias(KEYS[2]),
            *(F.col(f"`{c}`") for c in keep),
        )
    )


def _counted(rows: DataFrame, ranges: list[_Range], fan: int) -> dict[int, list[tuple]]:
    """For each range its parts that hold rows, ascending: bytes, rows, and the least and largest number in them."""
    which, part, number = F.lit(None).cast("int"), F.lit(None).cast("long"), F.lit(None).cast("long")
    for i, r in enumerate(ranges):
        k = F.col(KEYS[len(r.head)])
        which = F.when(r.holds(), F.lit(i)).otherwise(which)
        part = F.when(r.holds(), F.floor((k - r.low) / F.lit(r.step(fan)))).otherwise(part)
        number = F.when(r.holds(), k).otherwise(number)
    found = rows.select(which.alias("which"), part.alias("part"), number.alias("number"), "size").where("which IS NOT NULL")
    sums = found.groupBy("which", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"), F.min("number").alias("least"), F.max("number").alias("most"))
    out: dict[int, list[tuple]] = {i: [] for i in range(len(ranges))}
    for r in sums.collect():  # at most fan rows for each of at most shards - 1 ranges
        out[r["which"]].append((r["least"], r["most"], r["bytes"], r["n"]))
    return {i: sorted(x) for i, x in out.items()}


def _refine(s: _Splitter, parts: list[tuple], tolerance: float) -> None:
    """Settle the splitter at an edge of a part, or aim it at the part that it lies in."""
    below = s.below
    for i, (least, most, size, n) in enumerate(parts):
        if below + size < s.aim and i + 1 < len(parts):
            below += size
            continue
        # the edges of this part: before its least number, or before the next part
        before, after = s.aim - below, below + size - s.aim
        if min(before, after) <= tolerance or n == 1:
            first = before <= after
            s.key = (*s.at.head, least if first else most + 1)
            return
        whole = least == most
        if whole and len(s.at.head) + 1 == len(KEYS):
            raise RuntimeError("rows of one key")
        s.at = _Range((*s.at.head, least), 0, (1 << 63) - 1) if whole else _Range(s.at.head, least, most)
        s.below = below
        return


def splitters(rows: DataFrame, shards: int, tolerance: float = TOLERANCE, fan: int = FAN) -> list[tuple[int, ...]]:
    """The shards - 1 keys at which a new shard begins, ascending; a key may be cut short."""
    total = rows.agg(F.sum("size")).first()[0] or 0
    if not total:
        return []
    all_ = _Range((), 0, (1 << 62) - 1)
    found = [_Splitter(total * k / shards, all_) for k in range(1, shards)]
    while open_ := [s for s in found if s.key is None]:
        ranges = list(dict.fromkeys(s.at for s in open_))
        parts = _counted(rows, ranges, fan)
        for s in open_:
            _refine(s, parts[ranges.index(s.at)], tolerance * total / shards)
    return sorted(s.key for s in found)


def _not_below(key: tuple[int, ...]) -> Column:
    """Whether the row's key is the given one or above it."""
    out = F.lit(True)
    for k, x in reversed(list(zip(KEYS, key))):
        out = (F.col(k) > x) | ((F.col(k) == x) & out)
    return out


def assign_shards(documents: DataFrame, shards: int = SHARDS, keep: Sequence[str] = (), tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of every document, and the columns in keep."""
    rows = keyed(documents, keep)
    shard = F.lit(0)
    for key in splitters(rows, shards, tolerance):
        shard = shard + _not_below(key).cast("int")
    whole = rows.agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes")).first()
    spark = documents.sparkSession
    wanted = max(-(-whole["n"] // BUCKET_ROWS), -(-(whole["bytes"] or 0) // BUCKET_BYTES), 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    # by all three numbers: the row's own number deals out equal rows as well
    dealt = rows.withColumn(SHARD, shard.cast("int")).withColumn(BUCKET, F.pmod(F.xxhash64(*KEYS), F.lit(max(1, -(-wanted // shards)))))
    counts = dealt.groupBy(SHARD, BUCKET).agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(SHARD).orderBy(BUCKET)) - F.col("_n")
    offsets = counts.select(F.col(SHARD).alias("_s"), F.col(BUCKET).alias("_b"), before.alias("_before"))
    numbered = dealt.withColumn("_at", F.row_number().over(Window.partitionBy(SHARD, BUCKET).orderBy(*KEYS)) - 1)
    placed = numbered.join(offsets, (F.col(SHARD) == F.col("_s")) & (F.col(BUCKET) == F.col("_b")))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), SHARD, (F.col("_before") + F.col("_at")).cast("long").alias(SLOT), F.lit(None).cast("int").alias("grown_shard"), *(F.col(f"`{c}`") for c in keep)
    )


def write_shards(documents: DataFrame, path: str, shards: int = SHARDS, **options) -> None:
    """Write documents with their slots as Parquet, one folder for each shard, all columns included."""
    shard, slot = unused(documents, SHARD), unused(documents, SLOT)
    whole = documents.select("doc_id", "text", F.struct("*").alias("_document"))
    assigned = assign_shards(whole, shards, ["_document"], **options)
    assigned.select("_document.*", F.col(SHARD).alias(shard), F.col(SLOT).alias(slot)).write.partitionBy(shard).parquet(path)
