"""Words and word n-grams of many texts at once as 64-bit codes, in numpy.

A word's code is a keyed hash that is not linear in its bytes: eight bytes at a time are stirred into
a state, for all words of a batch side by side, so words of up to eight bytes and one length never share a code
and no structure of longer ones can cancel out. Long words go through a cryptographic hash. Nothing is
cached between batches, and memory follows the batch. Batches are cut into slices of a few MB before that.
"""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_MIX = np.uint64(0x9E3779B97F4A7C15)
_LONG = 256  # bytes; longer words are hashed one by one
_KEY = 0x2545F4914F6CDD1B
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_TAIL = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)  # the first k of eight bytes


def _stir(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def codes_at(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, key: int = _KEY) -> np.ndarray:
    """64-bit code of the bytes of each word, A-Z lower-cased if `lower`; another key gives codes that are independent."""
    data = np.append(_LOWER[data] if lower else data, np.zeros(8, np.uint8))
    eight = np.ndarray((len(data) - 7,), "<u8", data, strides=(1,))  # the eight bytes from each place on
    sizes = ends - starts
    with np.errstate(over="ignore"):
        out = _stir(sizes.astype(np.uint64) * _MIX + np.uint64(key))
        open_ = np.flatnonzero((sizes > 0) & (sizes <= _LONG))
        done = 0
        while len(open_):
            left = sizes[open_] - done
            block = eight[starts[open_] + done] & _TAIL[np.minimum(left, 8)]
            out[open_] = _stir(_stir(out[open_] ^ block) * _MIX + np.uint64(key))
            open_, done = open_[left > 8], done + 8
    secret = key.to_bytes(8, "little")
    for k in np.flatnonzero(sizes > _LONG).tolist():
        out[k] = int.from_bytes(hashlib.blake2b(data[starts[k] : ends[k]], digest_size=8, key=secret).digest(), "little")
    return out


class Words:
    """Places and codes of the words of some texts, which stand one after the other in `data`."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        column = pc.fill_null(texts.cast(pa.large_binary()), b"")
        edges = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
        raw = column.buffers()[2]
        self.data = np.frombuffer(raw, np.uint8)[edges[0] : edges[-1]] if raw is not None else np.zeros(0, np.uint8)
        edges = edges - edges[0]
        inside = np.zeros(len(self.data) + 2, bool)
        inside[1:-1] = ~_SPACE[self.data]
        # a text's first byte begins a word whatever stands before it
        first = inside[1:-1] & ~inside[:-2]
        last = inside[1:-1] & ~inside[2:]
        at = edges[1:-1][(edges[1:-1] > 0) & (edges[1:-1] < len(self.data))]
        first[at] = inside[1:-1][at]
        last[at - 1] = inside[1:-1][at - 1]
        self.starts, self.ends = np.flatnonzero(first), np.flatnonzero(last) + 1
        cuts = np.searchsorted(self.starts, edges)
        self.begins, self.sizes = cuts[:-1], np.diff(cuts)
        self.codes = codes_at(self.data, self.starts, self.ends, lower)


def ngram_codes(codes: np.ndarray, n: int) -> np.ndarray:
    """Code of each run of n words; empty if there are fewer."""
    size = len(codes) - n + 1
    if size <= 0:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        out = np.full(size, n, np.uint64)
        for k in range(n):
            out = out * _MIX + codes[k : k + size]
        return _stir(out)


def places(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """begin, begin + 1, ... of each run, one run after the other."""
    return np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def shingle_sets(texts: pa.Array, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-word shingles of each text with A-Z lower-cased, and how many each has.

    A text with fewer words has one, the whole sequence; a text without words has none.
    """
    w = Words(texts, lower=True)
    counts = np.where(w.sizes >= n, w.sizes - n + 1, np.minimum(w.sizes, 1))
    begins = np.cumsum(counts) - counts
    every = ngram_codes(w.codes, n)
    at = places(w.begins, counts)
    out = every[np.minimum(at, max(0, len(every) - 1))] if len(every) else np.zeros(len(at), np.uint64)
    for k in np.flatnonzero((w.sizes > 0) & (w.sizes < n)):
        out[begins[k]] = ngram_codes(w.codes[w.begins[k] : w.begins[k] + w.sizes[k]], int(w.sizes[k]))[0]
    for a, c in zip(begins.tolist(), counts.tolist()):
        if c > 1:
            out[a : a + c].sort()
    new = np.ones(len(out), bool)
    new[1:] = out[1:] != out[:-1]
    new[begins[counts > 0]] = True
    return out[new], np.add.reduceat(np.append(new, False).astype(np.int64), begins) * (counts > 0) if len(counts) else counts


def shingle_set(text: bytes, n: int = 5) -> np.ndarray:
    """shingle_sets of one text."""
    return shingle_sets(pa.array([text], pa.large_binary()), n)[0]


def slices(batch: pa.RecordBatch, size: int = 4 << 20, column: str = "text") -> Iterator[pa.RecordBatch]:
    """Parts of a batch with about so many bytes each, by the lengths of one column."""
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(sizes) // size
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def small_batches(rows: DataFrame, records: int = 1000, size: int = 8 << 20) -> DataFrame:
    """rows, with the session's Arrow batches bounded for whole texts: records, and bytes where Spark knows that setting.

    Both sides hold a batch; ten thousand texts at once would be most of a small executor's memory.
    """
    conf, unset = rows.sparkSession.conf, "1999999999"  # comes back where the session has no value of its own
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", records), ("spark.sql.execution.arrow.maxBytesPerBatch", size)):
        now = conf.get(key, unset).rstrip("bB")
        if not now.isdigit() or int(now) > most:
            conf.set(key, str(most))
    return rows


def columns(df: DataFrame) -> list[Column]:
    """All columns, whatever stands in their names."""
    return [F.col(f"`{c}`") for c in df.columns]


def _hashable(c: Column, kind: T.DataType) -> Column:
    """c with every map in it as its entries in order of their hashes, since maps themselves have no hash."""
    if "map<" not in kind.simpleString():
        return c
    if isinstance(kind, T.ArrayType):
        return F.transform(c, lambda x: _hashable(x, kind.elementType))
    if isinstance(kind, T.StructType):
        return F.when(c.isNotNull(), F.struct(*(_hashable(c[f.name], f.dataType).alias(f"c{k}") for k, f in enumerate(kind.fields))))
    entry = T.StructType([T.StructField("key", kind.keyType), T.StructField("value", kind.valueType)])
    return F.array_sort(F.transform(F.map_entries(c), lambda e: F.xxhash64(_hashable(e, entry), e["value"].isNull())))


def row_key(df: DataFrame) -> Column:
    """64-bit hash of a whole row; xxhash64 skips nulls, so their places are hashed as well."""
    cols = [F.col(f"`{f.name}`") for f in df.schema.fields]
    return F.xxhash64(*(_hashable(c, f.dataType) for c, f in zip(cols, df.schema.fields)), *(c.isNull() for c in cols))


def release() -> None:
    """Give memory that a finished task no longer uses back; Python workers live on after their task."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):  # another C library: its allocator decides
        pass


def releasing(function):
    """A mapInArrow function that gives its memory back at the end of the task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            release()

    return run


def raw_texts(column: pa.Array) -> Iterator[bytes]:
    """UTF-8 bytes of a string column, empty for null."""
    for x in column.cast(pa.large_binary()):
        yield x.as_py() or b""


def concat(parts: Iterable[np.ndarray], kind: type) -> np.ndarray:
    parts = list(parts)
    return np.concatenate(parts) if parts else np.zeros(0, kind)
