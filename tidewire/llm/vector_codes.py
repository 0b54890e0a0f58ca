"""Product codes of vectors by Lloyd's rounds with Elkan's bounds, in whole numbers.

Components become integers, vectors are cut into equal parts, and each part position has a codebook
of its own. A round assigns every part to its nearest entry and moves each entry to the floored mean
of its parts. Between rounds each part keeps an upper bound of the distance to its own entry and a
lower bound of the distance to every entry; both are shifted by how far the entries moved. An entry
is left out only where the upper bound lies strictly under its lower bound, or strictly under half
the distance of the two entries; all others are measured by exact integer distances, the lower index
winning ties. Bounds are 32-bit floats rounded away from the truth, so a bound can never leave out an
entry that is nearest or ties.

The vectors with their bounds are a written table, one per round, and the one before is deleted. Each
task also writes the sums of its parts by entry, at most parts * entries rows; those are summed by
Spark, so only codebooks (entries * width numbers) reach the driver and go out to the tasks.

Defined cases: null vectors and vectors with null or non-finite components are dropped; a null vec_id
is coded like any other and comes last among the first entries; rows of one vec_id are vectors each, the
smaller vector first; with fewer rows than entries a codebook has as many entries as rows; all vectors
count as filled up with zeros to the longest, rounded up to a multiple of the parts; empty tables give no
rows; other columns of the input are ignored, whatever their names. A table whose largest possible
error leaves 64 bits is an error, never a wrong code.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.shingles import releasing, small_batches
from tidewire.runtime import drop, settle

PARTS, ENTRIES, ROUNDS, SCALE = 8, 16, 6, 4096
_MARGIN = 1e-12  # relative, more than the error of a square root of a 64-bit integer
_VALUES = 1 << 18  # components that are measured at once
STATE = "vec_id long, label int, v binary, own binary, upper binary, lower binary, part int, entry int, n long, total array<long>"


def whole_vectors(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label and v, the array of floor(scale * x); only rows that take part."""
    kept = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.where(F.col("embedding").isNotNull()).where(kept)
    v = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    return rows.select(F.col("vec_id").cast("long"), F.col("label").cast("int"), v.alias("v"))


def _up(x: np.ndarray) -> np.ndarray:
    return np.nextafter((x * (1 + _MARGIN)).astype(np.float32), np.float32(np.inf))


def _down(x: np.ndarray) -> np.ndarray:
    return np.maximum(np.nextafter((x * (1 - _MARGIN)).astype(np.float32), np.float32(-np.inf)), np.float32(0))


class Codebook:
    """The entries of one part position, the distances between them and how far each moved last."""

    def __init__(self, entries: np.ndarray, before: np.ndarray | None = None):
        self.entries = entries
        squares = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(axis=2)
        self.half = _down(np.sqrt(squares.astype(np.float64)) / 2)
        apart = self.half.copy()
        np.fill_diagonal(apart, np.inf)
        self.nearest = apart.min(axis=1)  # half the way to the closest other entry
        moved = ((entries - (entries if before is None else before)) ** 2).sum(axis=1)
        self.moved = np.where(moved > 0, _up(np.sqrt(moved.astype(np.float64))), np.float32(0))


def assign(x: np.ndarray, own: np.ndarray, upper: np.ndarray, lower: np.ndarray, book: Codebook) -> int:
    """Move each row of x to its nearest entry, in place; gives the number of distances that were measured."""
    np.copyto(upper, np.where(book.moved[own] > 0, _up(upper.astype(np.float64) + book.moved[own]), upper))
    np.copyto(lower, np.where(book.moved > 0, _down(lower.astype(np.float64) - book.moved), lower))
    open_ = np.flatnonzero(~(upper < book.nearest[own]))
    if not len(open_):
        return 0

    def candidates(rows: np.ndarray) -> np.ndarray:
        left = ~(upper[rows, None] < lower[rows]) & ~(upper[rows, None] < book.half[own[rows]])
        left[np.arange(len(rows)), own[rows]] = False
        return left

    open_ = open_[candidates(open_).any(axis=1)]
    # the upper bound becomes the true distance, which leaves out more entries
    best = ((x[open_] - book.entries[own[open_]]) ** 2).sum(axis=1)
    measured = len(open_)
    true = np.sqrt(best.astype(np.float64))
    upper[open_] = _up(true)
    lower[open_, own[open_]] = _down(true)
    left = candidates(open_)
    at, entry = np.nonzero(left)  # entries of a row in ascending order
    far = ((x[open_[at]] - book.entries[entry]) ** 2).sum(axis=1)
    lower[open_[at], entry] = _down(np.sqrt(far.astype(np.float64)))
    every = np.full(left.shape, np.iinfo(np.int64).max)
    every[at, entry] = far
    every[np.arange(len(open_)), own[open_]] = best
    new = every.argmin(axis=1)  # the first of equal ones
    own[open_] = new
    upper[open_] = _up(np.sqrt(every[np.arange(len(open_)), new].astype(np.float64)))
    return measured + len(at)


def _matrix(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """Rows of a binary column of one size as a matrix of its own."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width).copy()


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.array([r.tobytes() for r in rows], pa.binary())


def _round(books: list[np.ndarray], before: list[np.ndarray] | None, width: int, first: bool):
    """A mapInArrow function: one assignment; rows with new bounds, then the sums of the task."""
    k, part, rows = len(books[0]), width // len(books), max(1, _VALUES // width)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codebooks = [Codebook(b, None if before is None else before[p]) for p, b in enumerate(books)]
        totals = np.zeros((len(books), k, part), np.int64)
        counts = np.zeros((len(books), k), np.int64)
        for whole in batches:
            for begin in range(0, whole.num_rows, rows):
                batch = whole.slice(begin, rows)
                n = batch.num_rows
                x = _matrix(batch.column("v"), np.int32, width).astype(np.int64).reshape(n, len(books), part)
                if first:
                    own = np.zeros((n, len(books)), np.uint8)
                    upper = np.full((n, len(books)), np.inf, np.float32)
                    lower = np.zeros((n, len(books), k), np.float32)
                else:
                    own = _matrix(batch.column("own"), np.uint8, len(books))
                    upper = _matrix(batch.column("upper"), np.float32, len(books))
                    lower = _matrix(batch.column("lower"), np.float32, len(books) * k).reshape(n, len(books), k)
                for p, book in enumerate(codebooks):
                    mine, high, low = own[:, p].astype(np.int64), upper[:, p].copy(), lower[:, p].copy()
                    assign(x[:, p], mine, high, low, book)
                    own[:, p], upper[:, p], lower[:, p] = mine, high, low
                    np.add.at(totals[p], mine, x[:, p])
                    counts[p] += np.bincount(mine, minlength=k)
                none = pa.nulls(n)
                yield _rows(batch.column("vec_id"), batch.column("label"), batch.column("v"), _binary(own), _binary(upper), _binary(lower.reshape(n, -1)), none, none, none, none)
        p, e = np.nonzero(counts)
        none = pa.nulls(len(p))
        yield _rows(none, none, none, none, none, none, p, e, counts[p, e], totals[p, e].tolist())

    return releasing(run)


_SCHEMA = pa.schema([("vec_id", pa.int64()), ("label", pa.int32()), ("v", pa.binary()), ("own", pa.binary()), ("upper", pa.binary()), ("lower", pa.binary()), ("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("total", pa.list_(pa.int64()))])


def _rows(*columns) -> pa.RecordBatch:
    cast = [c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SCHEMA)]
    return pa.RecordBatch.from_arrays(cast, schema=_SCHEMA)


def _moved(state: DataFrame, books: list[np.ndarray]) -> list[np.ndarray]:
    """Codebooks with each entry at the floored mean of its parts; at most entries * width sums reach the driver."""
    each = state.where(F.col("part").isNotNull()).select("part", "entry", "n", F.posexplode("total").alias("at", "x"))
    new = [b.copy() for b in books]
    for r in each.groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():
        new[r["part"]][r["entry"], r["at"]] = r["x"] // r["n"]
    return new


def _final(books: list[np.ndarray], width: int):
    """A mapInArrow function: code and error of each row of the last assignment."""
    part = width // len(books)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            x = _matrix(batch.column("v"), np.int32, width).astype(np.int64).reshape(n, len(books), part)
            own = _matrix(batch.column("own"), np.uint8, len(books))
            near = np.stack([b[own[:, p]] for p, b in enumerate(books)], axis=1) if n else x
            error = ((x - near) ** 2).sum(axis=(1, 2))
            code = pa.array([r.tobytes().hex() for r in own], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), code, pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return releasing(run)


def _packed(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = np.zeros((batch.num_rows, width), np.int32)
            column = batch.column("v")
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            v[np.arange(width)[None, :] < sizes[:, None]] = column.flatten().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), _binary(v)], ["vec_id", "label", "v"])

    return releasing(run)


def codebooks_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all integers by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(int(x)) for b in books for e in b for x in e).encode()).hexdigest()


def fit_codes(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray]]:
    """vec_id, label, code and error of every kept row, and the final codebooks, one array of entries per part."""
    whole = whole_vectors(small_batches(vectors), scale)
    seen = whole.agg(F.max(F.size("v")).alias("width"), F.max(F.greatest(F.abs(F.array_max("v")), F.abs(F.array_min("v")))).alias("most")).first()
    width, most = -(-max(seen["width"] or 0, 1) // parts) * parts, int(seen["most"] or 0)
    if width * (2 * most + 1) ** 2 >= 1 << 63:
        raise ValueError(f"components up to {most} in {width} places: errors can leave 64 bits")
    first = [list(r["v"]) + [0] * (width - len(r["v"])) for r in whole.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()]
    if not first:
        return whole.select("vec_id", "label", F.lit("").alias("code"), F.lit(0).cast("long").alias("error")), []
    start = np.array(first, np.int64).reshape(len(first), parts, width // parts)
    books, before = [start[:, p].copy() for p in range(parts)], None
    source = whole.mapInArrow(_packed(width), "vec_id long, label int, v binary")
    state = None
    for k in range(rounds + 1):
        old, state = state, settle(source.mapInArrow(_round(books, before, width, k == 0), STATE))
        if old is not None:
            drop(old)
        source = state.where(F.col("part").isNull())
        new = _moved(state, books) if k < rounds else books
        if all(np.array_equal(a, b) for a, b in zip(new, books)):
            break  # nothing moves any more: all further rounds give the same
        before, books = books, new
    coded = settle(source.select("vec_id", "label", "v", "own").mapInArrow(_final(books, width), "vec_id long, label int, code string, error long"))
    drop(state)
    return coded, books


def vector_codes(vectors: DataFrame, **options) -> DataFrame:
    """vec_id, code, error, label_error and codebooks_sha256 of every kept row."""
    coded, books = fit_codes(vectors, **options)
    labels = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = coded.alias("c").join(labels.alias("l"), F.expr("c.label <=> l.label"))
    return joined.select("c.vec_id", "c.code", "c.error", "l.label_error", F.lit(codebooks_digest(books)).alias("codebooks_sha256"))
