"""Exact top-k inner products with a bit-sliced index.

A block holds up to `block_rows` rows. Every quantised attribute, made non-negative by its
block minimum, is stored as slices: bit b of all rows is one bitmap. A query adds the slices of
its attributes with bitmap arithmetic: digit by digit of the query's coefficients, carry-save
adders (full adders over whole bitmaps) reduce the bitmaps of each weight until the score of all
rows is itself bit-sliced. Going from the most significant slice down, the bitmap of rows that
can still be among the best k narrows. The `low` lowest attribute bits are left out of the sum;
the rows within the bound of what they can add are the boundary rows, and their scores are then
computed exactly.

A block's index is built once for each chunk of queries, and a chunk is as large as memory allows, so
rows are copied once per many thousand queries; all rows meet each query. Each pair of chunk and block
is one group of bounded size and yields k rows per query, of which a window keeps the best.

Defined cases: null vectors, and vectors with null or non-finite components, take no part; neither do
rows without a vec_id; shorter vectors count as filled up with zeros; ties go to the smaller id; empty
tables give no rows; other columns of the input are ignored, whatever their names. No row of the
query's own vec_id is among its k, however many there are. Rows of one vec_id count one by one, as in
the query's SQL: several of them may hold ranks of a query, and if a query stands in r rows, the
scores of all r are ranked together. Scores are 64-bit integers: a component is cut to that range,
and a table whose largest possible score leaves it is an error, never a wrong score.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.shingles import release

BLOCK_VALUES = 1 << 22  # components of a block's rows, 8 bytes each
QUERY_VALUES = 1 << 20  # components of a chunk's queries


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id and v, the array of floor(scale * x); only rows that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull() & F.col("vec_id").isNotNull()).where(finite)
    return rows.select(
        F.col("vec_id").cast("long"), F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")
    )


def _full_add(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum and carry of three bitmaps."""
    u = a ^ b
    carry = a & b
    carry |= u & c
    u ^= c
    return u, carry


class BitSlicedIndex:
    """Bit-sliced attributes of the rows of one block."""

    def __init__(self, values: np.ndarray, low: int = 2):
        self.values = values
        n, d = values.shape
        self.base = values.min(axis=0) if n else np.zeros(d, np.int64)
        lifted = values - self.base
        most = int(lifted.max()) if lifted.size else 0
        self.low = min(low, max(0, most.bit_length() - 1))
        self.rest = (1 << self.low) - 1  # what the slices left out can hold at most
        self.words = -(-n // 64)
        self.all = self._bitmap(np.ones(n, bool))
        self.slices: list[list[tuple[int, np.ndarray]]] = []
        for j in range(d):
            column = lifted[:, j]
            top = int(column.max()).bit_length() if n else 0
            self.slices.append([(b, self._bitmap((column >> b) & 1)) for b in range(self.low, top)])

    def _bitmap(self, bits: np.ndarray) -> np.ndarray:
        packed = np.packbits(bits.astype(bool), bitorder="little")
        return np.pad(packed, (0, 8 * self.words - len(packed))).view(np.uint64)

    def _digits(self, q: int) -> list[tuple[int, int]]:
        """Signed digits of q, no two neighbours, as (bit, sign)."""
        out, bit = [], 0
        while q:
            if q & 1:
                sign = 2 - (q & 3)
                out.append((bit, sign))
                q -= sign
            q >>= 1
            bit += 1
        return out

    def sums(self, query: np.ndarray) -> tuple[list[np.ndarray], int]:
        """Slices, least significant first, of the sum over attributes, and the constant to add.

        A bitmap that counts negatively enters as its complement; the constant makes up for it.
        """
        columns: dict[int, list[np.ndarray]] = {}
        constant = int(np.dot(query, self.base))
        for q, slices in zip(query.tolist(), self.slices):
            for shift, sign in self._digits(q):
                for b, bitmap in slices:
                    if sign > 0:
                        columns.setdefault(b + shift, []).append(bitmap)
                    else:
                        columns.setdefault(b + shift, []).append(self.all & ~bitmap)
                        constant -= 1 << (b + shift)
        out, weight = [], 0
        while columns:
            column = columns.pop(weight, [])
            carries = columns.get(weight + 1, [])
            while len(column) > 2:
                u, carry = _full_add(column.pop(), column.pop(), column.pop())
                column.insert(0, u) if len(column) > 64 else column.append(u)
                carries.append(carry)
            if len(column) == 2:
                carries.append(column[0] & column[1])
                column = [column[0] ^ column[1]]
            out.append(column[0] if column else np.zeros(self.words, np.uint64))
            if carries:
                columns[weight + 1] = carries
            weight += 1
        return out, constant

    def _least_of_best(self, slices: list[np.ndarray], k: int) -> int:
        """The k-th largest of the sliced sums, read from the most significant slice down."""
        chosen, value, need = self.all.copy(), 0, k
        for b in range(len(slices) - 1, -1, -1):
            ones = chosen & slices[b]
            n = int(np.bitwise_count(ones).sum())
            if n >= need:
                chosen, value = ones, value | (1 << b)
            else:
                need -= n
                chosen &= ~slices[b]
        return value

    def _at_least(self, slices: list[np.ndarray], bound: int) -> np.ndarray:
        """Bitmap of the rows whose sliced sum is at least bound."""
        if bound <= 0:
            return self.all
        if bound.bit_length() > len(slices):
            return np.zeros(self.words, np.uint64)
        above, equal = np.zeros(self.words, np.uint64), self.all.copy()
        for b in range(len(slices) - 1, -1, -1):
            if bound >> b & 1:
                equal &= slices[b]
            else:
                above |= equal & slices[b]
                equal &= ~slices[b]
        return above | equal

    def top(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows that hold the k best exact scores (all rows tied with them too) and the scores."""
        n = len(self.values)
        if n > k:
            slices, _ = self.sums(query)
            up = self.rest * int(query[query > 0].sum())
            down = self.rest * int(query[query < 0].sum())
            # a row's exact sum lies between its sliced sum + down and + up
            kept = self._at_least(slices, self._least_of_best(slices, k) + down - up)
            rows = np.flatnonzero(np.unpackbits(kept.view(np.uint8), bitorder="little")[:n])
        else:
            rows = np.arange(n)
        return rows, self.values[rows] @ query


def _matrix(column: pa.ChunkedArray | pa.Array, width: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    sizes = column.value_lengths().to_numpy(zero_copy_only=False).astype(int)
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(sizes), width), np.int64)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out[np.repeat(np.arange(len(sizes)), sizes), at] = flat
    return out


def top_k(
    vectors: DataFrame, every: int = 50, k: int = 5, scale: int = 256, block_rows: int | None = None, query_chunk: int | None = None, low: int = 2
) -> DataFrame:
    """query_id, rank, vec_id and score: the k best of all other rows for every query.

    A group has about block_rows rows and query_chunk queries, by default as many as have BLOCK_VALUES
    and QUERY_VALUES components.
    """
    rows = quantised(vectors, scale)
    most = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    sizes = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("v")).alias("d"), most.alias("most")).first()
    n, width = sizes["n"], max(1, sizes["d"] or 1)
    if width * (sizes["most"] or 0.0) ** 2 >= 2.0**62:
        raise ValueError("scores of these vectors do not fit into 64 bits; use a smaller scale")
    blocks = max(1, math.ceil(n / (block_rows or max(64, BLOCK_VALUES // width))))
    chunks = max(1, math.ceil(n / every / (query_chunk or max(1, QUERY_VALUES // width))))
    if not query_chunk:  # few blocks are searched by several tasks each, so that every core has work
        cores = vectors.sparkSession.sparkContext.defaultParallelism
        chunks = max(chunks, min(math.ceil(cores / blocks), math.ceil(n / every / 64)))
    queries = rows.where(F.col("vec_id") % every == 0)
    left = rows.select(
        F.pmod(F.xxhash64("vec_id", "v"), F.lit(blocks)).cast("int").alias("block"),
        F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(False).alias("is_query"), "vec_id", "v"
    )
    right = queries.select(
        F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
        F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(chunks)).cast("int").alias("chunk"), F.lit(True).alias("is_query"), "vec_id", "v"
    )

    def search(group: pa.Table) -> pa.Table:
        mine = group.column("is_query").to_numpy(zero_copy_only=False).astype(bool)
        ids, values = group.column("vec_id").to_numpy(), _matrix(group.column("v"), width)
        index, row_ids = BitSlicedIndex(values[~mine], low), ids[~mine]
        in_order = np.sort(row_ids)
        out: list[tuple[np.ndarray, ...]] = []
        for query_id, query in zip(ids[mine], values[mine]):
            # all rows of the query's own id may be among the best, so as many more
            own = np.searchsorted(in_order, query_id, "right") - np.searchsorted(in_order, query_id)
            found, score = index.top(query, k + int(own))
            found_ids = row_ids[found]
            other = found_ids != query_id
            found_ids, score = found_ids[other], score[other]
            best = np.lexsort((found_ids, -score))[:k]
            out.append((np.full(len(best), query_id), found_ids[best], score[best]))
        release()
        cols = [np.concatenate(c) if out else np.zeros(0, np.int64) for c in (zip(*out) if out else [()] * 3)]
        return pa.table({"query_id": cols[0].astype(np.int64), "vec_id": cols[1].astype(np.int64), "score": cols[2].astype(np.int64)})

    part = left.unionByName(right).groupBy("block", "chunk").applyInArrow(search, "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = part.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
