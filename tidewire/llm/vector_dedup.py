"""Near-duplicate vectors by cross-polytope hashing.

Vectors with equal label and equal components are one class first, so exact copies never meet
each other. Each class vector is rotated by three rounds of random signs and a fast Hadamard
transform; its hash is the nearest signed unit vector, `rotations` of them side by side in each of
`tables` tables, by default as many as the dimension needs (`tables_for`). Multiprobe: besides its own bucket a vector enters the bucket of the next nearest
vertex of its least certain rotation. Vectors that share a bucket and a label are candidates and
are verified by cosine in double precision. A pair that shares several buckets is counted in the
first of them only. Buckets of more than `block` vectors are cut into sub-blocks, and pairs of
sub-blocks are tasks of bounded size, so no bucket is capped and nothing is dropped.

Defined cases: vectors that are null, zero, or hold null or non-finite components, and rows
without a label or vec_id, link with nothing and are components of their own; vectors of different
lengths link with nothing; rows of one vec_id are a vector each, and component_id is the smallest
vec_id reachable from the row's own vector; pairs exactly at the threshold link; vectors of any width
are read in whole; empty tables give no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.shingles import release, releasing
from tidewire.operators.components import connected_components
from tidewire.runtime import settle


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows; their length is a power of two."""
    n, d = x.shape
    h = 1
    while h < d:
        x = x.reshape(n, d // (2 * h), 2, h)
        x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, d)
        h *= 2
    return x / np.sqrt(d)


def tables_for(d: int) -> int:
    """Tables of 3 rotations that find at least 0.98 of the pairs at cosine 0.93, measured up to 1536 dimensions."""
    return max(14, 2 * max(1, (d - 1).bit_length()) - 2)


def bucket_keys(x: np.ndarray, tables: int, rotations: int, seed: int = 11) -> np.ndarray:
    """n x (2 * tables) bucket numbers: of each table the own bucket and the probed one.

    Numbers of different tables differ; the two of one table always differ from each other.
    """
    n, d = x.shape
    size = 1 << max(4, (d - 1).bit_length())  # short vectors have too few vertices of their own
    x = np.pad(x, ((0, 0), (0, size - d)))
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    rng = np.random.default_rng([seed, size])
    out = np.empty((n, 2 * tables), np.int64)
    for t in range(tables):
        own, second, gap = [], [], []
        for _ in range(rotations):
            y = x
            for signs in rng.choice([-1.0, 1.0], size=(3, size)):
                y = hadamard(y * signs)
            a = np.abs(y)
            rows = np.arange(n)
            best = a.argmax(axis=1)
            top = a[rows, best].copy()
            a[rows, best] = -1
            after = a.argmax(axis=1)
            own.append(2 * best + (y[rows, best] < 0))
            second.append(2 * after + (y[rows, after] < 0))
            gap.append(top - a[rows, after])
        own, second, gap = np.array(own), np.array(second), np.array(gap)
        probe = own.copy()
        least = gap.argmin(axis=0)
        probe[least, np.arange(n)] = second[least, np.arange(n)]
        for k, codes in enumerate((own, probe)):
            number = np.full(n, t, np.int64)
            for c in codes:
                number = number * (2 * size) + c
            out[:, 2 * t + k] = number
    return out


def _stack(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


class _Forest:
    """Union-find over positions."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, a: int) -> int:
        while self.up[a] != a:
            self.up[a] = self.up[self.up[a]]
            a = self.up[a]
        return a

    def join(self, a: int, b: int) -> bool:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)
        return a != b


def links(x: np.ndarray, keys: np.ndarray, key: int, left: np.ndarray, right: np.ndarray, least: float, chunk: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """Verified pairs (i, j), i < j, i in left or j in left and the other in right, whose first common bucket is key."""
    unit = np.sqrt((x * x).sum(axis=1))
    a_all, b_all = np.flatnonzero(left), np.flatnonzero(right)
    same = np.array_equal(a_all, b_all)
    found_a, found_b = [], []
    for at in range(0, len(a_all), chunk):
        a = a_all[at : at + chunk]
        cosine = (x[a] @ x[b_all].T) / (unit[a][:, None] * unit[b_all][None, :])
        hit = cosine >= least
        if same:
            hit &= b_all[None, :] > a[:, None]
        i, j = np.nonzero(hit)
        i, j = a[i], b_all[j]
        # a smaller bucket number that both have: counted there
        ki, kj = keys[i], keys[j]
        earlier = np.zeros(len(i), bool)
        for c in range(keys.shape[1]):
            mine = ki[:, c]
            earlier |= (mine < key) & (kj == mine[:, None]).any(axis=1)
        found_a.append(i[~earlier])
        found_b.append(j[~earlier])
    none = np.zeros(0, np.int64)
    return np.concatenate(found_a or [none]), np.concatenate(found_b or [none])


def near_duplicates(vectors: DataFrame, least: float = 0.93, tables: int | None = None, rotations: int = 3, block: int = 2000, task_rows: int = 4000) -> DataFrame:
    """vec_id, n_links, component_id and kept of every vector."""
    rows = vectors.select(F.col("vec_id").cast("long"), F.col("label").alias("label"), F.col("embedding").alias("x"))
    finite = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < float("inf")))
    some = F.exists("x", lambda v: v != 0)
    usable = rows.where("x is not null and label is not null and vec_id is not null").where(finite & some)
    # x + 0.0 makes -0.0 and 0.0 equal; float components stay floats until they are compared
    kind = "float" if rows.schema["x"].dataType.simpleString() == "array<float>" else "double"
    usable = usable.select("vec_id", "label", F.transform("x", lambda v: v.cast(kind) + F.lit(0.0).cast(kind)).alias("x"))
    # a class has a number of its own: two classes may hold one vec_id
    classes = usable.groupBy("label", "x").agg(F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("copies"))
    classes = settle(classes.withColumn("rep", F.monotonically_increasing_id()))
    members = usable.join(classes, ["label", "x"]).select("vec_id", "rep", "copies", "least")

    @releasing
    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes = b.column("x").value_lengths().to_numpy(zero_copy_only=False)
            for size in np.unique(sizes):
                part = b.filter(pa.array(sizes == size))
                keys = bucket_keys(_stack(part.column("x")), tables or tables_for(int(size)), rotations)
                edges = pa.array(np.arange(0, keys.size + 1, keys.shape[1]), pa.int32())
                cols = {c: part.column(c) for c in ("label", "rep", "copies", "x")}
                yield pa.RecordBatch.from_pydict({**cols, "size": pa.array(np.full(part.num_rows, size), pa.int32()), "keys": pa.ListArray.from_arrays(edges, pa.array(keys.ravel()))})

    label_type = vectors.schema["label"].dataType.simpleString()
    dealt = settle(classes.select("label", "rep", "copies", "x").mapInArrow(hashed, f"label {label_type}, rep long, copies long, x array<{kind}>, size int, keys array<long>"))
    group = ["label", "size", "key"]
    # narrow rows until it is known which vectors meet any other; only those travel with their components
    narrow = dealt.select("label", "size", F.explode("keys").alias("key"), "rep")
    counts = settle(narrow.groupBy(*group).agg(F.count(F.lit(1)).alias("n")).where("n > 1"))
    # a task takes many buckets, and each of them is looked at by itself
    parted = F.greatest(F.ceil(F.col("n") / block), F.lit(1))
    work = counts.agg(F.sum(F.col("n") * parted)).first()[0] or 0
    n_tasks = max(1, -(-int(work) // task_rows))
    parts = F.ceil(F.col("n") / block).cast("int")
    own = F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")
    pairs = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.struct(F.least(o, F.col("own")).alias("p"), F.greatest(o, F.col("own")).alias("q")))
    meet = narrow.join(counts, group).withColumn("parts", parts).withColumn("own", own).withColumn("pq", F.explode(pairs))
    bucket = F.xxhash64(*group, "p", "q")
    meet = meet.select("key", "pq.p", "pq.q", "own", "rep", *group[:2]).withColumn("bucket", bucket)
    meet = meet.select("size", "key", "p", "q", "own", "rep", "bucket", F.pmod(F.col("bucket"), F.lit(n_tasks)).cast("int").alias("task"))
    tasks = meet.join(dealt.select("rep", "copies", "x", "keys"), "rep")

    def verify(table: pa.Table) -> pa.Table:
        table = table.sort_by("bucket")
        own, ids = table.column("own").to_numpy(), table.column("rep").to_numpy()
        copies, buckets = table.column("copies").to_numpy(), table.column("bucket").to_numpy()
        key, p, q, size = (table.column(c).to_numpy() for c in ("key", "p", "q", "size"))
        vectors_, all_keys = table.column("x"), table.column("keys")
        n = np.zeros(len(ids), np.int64)
        forest, src, dst = _Forest(len(ids)), [], []
        cuts = np.flatnonzero(np.diff(buckets)) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(ids)]):
            if hi - lo < 2 or size[lo] == 0:
                continue
            x, keys = _stack(vectors_.slice(lo, hi - lo)), _stack_int(all_keys.slice(lo, hi - lo))
            a, b = links(x, keys, int(key[lo]), own[lo:hi] == p[lo], own[lo:hi] == q[lo], least)
            a, b = a + lo, b + lo
            np.add.at(n, a, copies[b])
            np.add.at(n, b, copies[a])
            for i, j in zip(a.tolist(), b.tolist()):
                if forest.join(i, j):
                    src.append(ids[i])
                    dst.append(ids[j])
        hit = np.flatnonzero(n)
        release()
        return pa.table(
            {"rep": pa.array(np.concatenate((ids[hit], np.array(src, np.int64)))),
             "n": pa.array(np.concatenate((n[hit], np.zeros(len(src), np.int64)))),
             "other": pa.array([None] * len(hit) + dst, pa.int64())}
        )

    found = settle(tasks.groupBy("task").applyInArrow(verify, "rep long, n long, other long"))
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    edges = found.where("other is not null").select(F.col("rep").alias("src"), F.col("other").alias("dst"))
    comps = settle(connected_components(edges).select(F.col("node").alias("rep"), "component").join(classes.select("rep", "least"), "rep"))
    lowest = comps.groupBy("component").agg(F.min("least").alias("lowest"))
    comps = comps.join(lowest, "component").select("rep", "lowest")
    linked = members.join(counts, "rep", "left").join(comps, "rep", "left").select(
        "vec_id",
        (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
        F.coalesce("lowest", "least").alias("component_id"),
    )
    rest = rows.where(~F.coalesce(F.expr("x is not null and label is not null and vec_id is not null") & finite & some, F.lit(False)))
    alone = rest.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def _stack_int(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
