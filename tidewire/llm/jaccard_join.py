"""Jaccard join of documents on word shingles by vertical partitioning.

Shingles have one global order, from rare to common (number of different sets that hold them, then
their 64-bit code). The order is cut into fragments; every set is cut at the same places, the overlap
of a pair is counted in each fragment separately and summed per pair.

Which pairs are counted follows from the order and loses none: a set at similarity >= t to any other
shares at least ceil(t n) of its n shingles, so sets with fewer shingles that stand elsewhere drop
out; two linked sets share one of the first n - ceil(t n) + 1 shingles of each, which are the rarest,
so documents that only share a common passage never meet; and the places of the shared shingle must
leave room for the overlap.

Groups of copies: equal sets are one class. Twice each set is counted against one leader of the lists
that it stands in; what links is one component, and sets of one component are never paired. All pairs
of different components that still pass are counted. So no link between components is lost and no
group emits all its pairs.

Defined cases: null and empty texts have an empty set and link with nothing; texts shorter than a
shingle are one shingle; repeated rows and repeated ids are rows of their own (a class goes by its
shingles, not by ids); component_id is the smallest doc_id that is not null, the row's own id (null
too) if it links with nothing; texts of any length are read in whole, one in memory at a time at
least; empty tables give no rows; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.shingles import columns, concat, release, releasing, row_key, shingle_sets, slices, small_batches
from tidewire.operators.components import connected_components
from tidewire.runtime import drop, settle, unused

FRAGMENTS = 8  # ranges of the global order with about equally many shingles
BROADCAST_ROWS = 300_000  # rows of at most 24 bytes that are sent to every executor


def needed(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    """Least overlap of a set of n shingles with any set at `percent` similarity."""
    return -(-(n * percent) // 100)


def with_text_key(documents: DataFrame) -> DataFrame:
    """doc_id, rid (a hash of the text) and text of every row."""
    text = F.col("text").cast("string")
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("rid"), text.alias("text"))


def _small(rows: DataFrame) -> DataFrame:
    """A settled table of keys, sent to every executor only while its rows are few."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def _node(digest: bytes) -> int:
    return int.from_bytes(digest[:8], "little", signed=True)


def sets_of(documents: DataFrame, words: int) -> DataFrame:
    """doc_id, rid, n and node (64 bits of a digest, null for an empty set) of every row's shingle set."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            codes, n = shingle_sets(b.column("text"), words)
            ends = np.cumsum(n)
            node = [_node(hashlib.blake2b(codes[e - k : e], digest_size=16).digest()) if k else None for e, k in zip(ends.tolist(), n.tolist())]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "rid": b.column("rid"), "n": pa.array(n, pa.int64()), "node": pa.array(node, pa.int64())})

    return small_batches(with_text_key(documents)).mapInArrow(run, "doc_id long, rid long, n long, node long")


def _in_several(t: np.ndarray) -> np.ndarray:
    """Which entries of a sorted array are equal to a neighbour."""
    same = np.zeros(len(t), bool)
    eq = t[1:] == t[:-1]
    same[1:] |= eq
    same[:-1] |= eq
    return same


def shared_counts(documents: DataFrame, words: int, shards: int) -> DataFrame:
    """rid and how many shingles of that text stand in other rows too.

    Shingles are dealt to shards by their code, as packed numbers: 32 bits each, and per text and
    shard one id and a length. What several rows of a slice share is counted there and travels once,
    without an owner, so a shingle of very many documents brings one entry a slice to its shard.
    """
    names, kinds = ["shard", "tokens", "rids", "sizes"], [pa.int32(), pa.binary(), pa.binary(), pa.binary()]

    @releasing
    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            codes, n = shingle_sets(b.column("text"), words)
            if not len(codes):
                continue
            rid = b.column("rid").to_numpy(zero_copy_only=False)
            own = np.repeat(np.arange(len(n)), n)
            order = np.argsort(codes)
            t = codes[order]
            same = _in_several(t)
            inner = np.zeros(len(codes), bool)
            inner[order[same]] = True
            rows: list[tuple] = []
            held = np.bincount(own[inner], minlength=len(n))
            # counts of what is already known to be shared ride along, marked by no tokens
            known = np.flatnonzero(held)
            if len(known):
                rows.append((int(codes[0] % np.uint64(shards)), b"", rid[known].tobytes(), held[known].astype(np.int64).tobytes()))
            common = np.unique(t[same])
            alone = ~inner
            t, o = np.concatenate([codes[alone], common]), np.concatenate([own[alone], np.full(len(common), -1)])
            shard = (t >> np.uint64(32)) % np.uint64(shards)
            order = np.argsort(shard.astype(np.uint16) if shards <= 1 << 16 else shard, kind="stable")
            t, o, shard = t[order].astype(np.uint32), o[order], shard[order]
            cuts = np.append(0, np.flatnonzero(np.diff(shard)) + 1)
            stops = np.append(cuts[1:], len(t))
            for a, z in zip(cuts.tolist(), stops.tolist()):
                mine = o[a:z]
                head = np.append(0, np.flatnonzero(np.diff(mine)) + 1)
                size = np.diff(np.append(head, len(mine)))
                free = int(size[-1]) if mine[-1] < 0 else 0  # ownerless ones come last
                who = rid[mine[head[: len(head) - bool(free)]]]
                rows.append((int(shard[a]), t[a:z].tobytes(), who.tobytes(), size[: len(who)].astype(np.uint32).tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    def count(table: pa.Table) -> pa.Table:
        tokens, owner, free, ids, counts = [], [], [], [], []
        for t, r, s in zip(*(table.column(c).to_pylist() for c in ("tokens", "rids", "sizes"))):
            r = np.frombuffer(r, np.int64)
            if not t:
                ids.append(r)
                counts.append(np.frombuffer(s, np.int64))
                continue
            t, s = np.frombuffer(t, np.uint32), np.frombuffer(s, np.uint32)
            owner.append(np.concatenate([np.repeat(r, s), np.zeros(len(t) - int(s.sum()), np.int64)]))
            free.append(np.arange(len(t)) >= int(s.sum()))
            tokens.append(t)
        t, r, f = concat(tokens, np.uint32), concat(owner, np.int64), concat(free, bool)
        order = np.argsort(t, kind="stable")
        hit = _in_several(t[order]) & ~f[order]
        found, k = np.unique(r[order[hit]], return_counts=True)
        del tokens, owner, free, t, r, f, order, hit
        r, k = np.concatenate([found, *ids]), np.concatenate([k.astype(np.int64), *counts])
        home = r % shards
        order = np.argsort(home, kind="stable")
        home, r, k = home[order], r[order], k[order]
        cuts = np.flatnonzero(np.diff(home)) + 1
        parts = [(int(h[0]), x.tobytes(), y.tobytes()) for h, x, y in zip(np.split(home, cuts), np.split(r, cuts), np.split(k, cuts)) if len(h)]
        release()
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("home", "rids", "ks"), zip(*parts) if parts else ((), (), ()), (pa.int32(), pa.binary(), pa.binary()))})

    def add(table: pa.Table) -> pa.Table:
        r, k = (concat([np.frombuffer(x, np.int64) for x in table.column(c).to_pylist()], np.int64) for c in ("rids", "ks"))
        found, at = np.unique(r, return_inverse=True)
        return pa.table({"rid": found, "shared": np.bincount(at, k, len(found)).astype(np.int64)})

    blobs = small_batches(with_text_key(documents)).mapInArrow(emit, "shard int, tokens binary, rids binary, sizes binary")
    found = blobs.groupBy("shard").applyInArrow(count, "home int, rids binary, ks binary")
    return found.groupBy("home").applyInArrow(add, "rid long, shared long")


def tokens_of(documents: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """node, n and tokens of one text of each wanted rid."""

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (part for whole in batches for part in slices(whole)):
            codes, n = shingle_sets(b.column("text"), words)
            edges = pa.array(np.append(0, np.cumsum(n)), pa.int32())
            yield pa.RecordBatch.from_pydict({"node": b.column("node"), "n": pa.array(n, pa.int64()), "tokens": pa.ListArray.from_arrays(edges, pa.array(codes.view(np.int64)))})

    texts = with_text_key(documents).join(_small(wanted), "rid").groupBy("node").agg(F.first("text").alias("text"))
    return small_batches(texts).mapInArrow(run, "node long, n long, tokens array<long>")


def _key(token: Column, count: Column) -> Column:
    """A shingle's place in the global order as one number: its count, then its code."""
    return count + (token.cast("double") / 2.0**64 + 0.5)


def ordered_fragments(classes: DataFrame, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Per node and fragment: n, the place of its first shingle in the order, and the shingles by order.

    Only shingles of at least two classes are in there; they come after the others. The second value
    lists settled tables that the first one reads.
    """
    tokens = classes.select("node", "n", F.explode("tokens").alias("token"))
    counts = settle(tokens.groupBy("token").agg(F.count(F.lit(1)).alias("k")).where("k > 1"))
    cuts = counts.agg(F.percentile_approx(_key(F.col("token"), F.col("k")), [i / FRAGMENTS for i in range(1, FRAGMENTS)], 1000)).first()[0] or []
    fragment = sum((F.when(_key(F.col("token"), F.col("k")) > c, 1).otherwise(0) for c in cuts), F.lit(0))
    every = Window.partitionBy("node")
    rows = tokens.join(counts, "token").withColumn("shared", F.count(F.lit(1)).over(every))
    rows = rows.where(F.col("shared") * 100 >= F.col("n") * percent)
    # the shingles that no other class has come first
    rows = rows.withColumn("place", F.col("n") - F.col("shared") + F.row_number().over(every.orderBy("k", "token")) - 1)
    packed = rows.withColumn("fragment", fragment).groupBy("node", "n", "fragment").agg(
        F.array_sort(F.collect_list(F.struct("place", "token"))).alias("seg")
    )
    found = packed.select("node", "n", "fragment", F.col("seg")[0]["place"].alias("first"), F.col("seg.token").alias("seg"))
    return settle(found), [counts]


def overlaps(fragments: DataFrame, pairs: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose similarity is at least `percent`, by the sum of their overlaps in each fragment."""
    one = fragments.select(F.col("node").alias("a"), "fragment", F.col("n").alias("na"), F.col("seg").alias("sa"))
    two = fragments.select(F.col("node").alias("b"), "fragment", F.col("n").alias("nb"), F.col("seg").alias("sb"))
    part = pairs.select("a", "b").join(one, "a").join(two, ["b", "fragment"])
    part = part.select("a", "b", "na", "nb", F.size(F.array_intersect("sa", "sb")).alias("part"))
    summed = part.groupBy("a", "b", "na", "nb").agg(F.sum("part").alias("shared"))
    return summed.where(F.col("shared") * 100 >= (F.col("na") + F.col("nb") - F.col("shared")) * percent).select("a", "b", "shared")


def _room(n: Column, m: Column, percent: int) -> Column:
    """Least overlap of two sets of n and m shingles."""
    return F.ceil((n + m) * percent / (100 + percent) - 1e-9)


def _links(fragments: DataFrame, percent: int, rounds: int) -> tuple[DataFrame, DataFrame]:
    """The linked pairs that hold the components together, and the components."""
    last = F.col("n") - F.ceil(F.col("n") * percent / 100)  # a link shares a shingle at this place or before
    heads = fragments.where(F.col("first") <= last).select("node", "n", "first", F.posexplode("seg").alias("at", "token"))
    heads = heads.withColumn("rest", F.col("n") - F.col("first") - F.col("at")).where(F.col("n") - F.col("rest") <= last)
    heads = settle(heads.select("token", "node", "n", "rest"))
    edges, comps, tested, used = None, None, None, [heads]

    def lists() -> DataFrame:
        if comps is None:
            return heads.withColumn("comp", F.col("node"))
        known = comps.select("node", F.col("component").alias("comp"))
        return heads.join(known, "node", "left").withColumn("comp", F.coalesce("comp", "node"))

    def fits(n: str, m: str, rest: str, other: str) -> Column:
        big, small = F.greatest(n, m), F.least(n, m)
        return (small * 100 >= big * percent) & (F.least(rest, other) >= _room(F.col(n), F.col(m), percent))

    for r in range(rounds + 1):
        rows = settle(lists())
        used.append(rows)
        if r < rounds:
            # the set with the fewest shingles before this one is closest to what a group shares
            rank = F.struct(F.col("n") - F.col("rest"), F.xxhash64("node", F.lit(r)))
            lead = rows.groupBy("token").agg(
                F.min_by(F.struct("node", "comp", "n", "rest"), rank).alias("lead"), F.min("comp").alias("lo"), F.max("comp").alias("hi")
            ).where("lo <> hi").select("token", F.col("lead.node").alias("a"), F.col("lead.comp").alias("ca"), F.col("lead.n").alias("na"), F.col("lead.rest").alias("resta"))
            met = rows.join(lead, "token").where((F.col("comp") != F.col("ca")) & fits("n", "na", "rest", "resta"))
            met = met.groupBy("node", "a").agg(F.count(F.lit(1)).alias("c"))
            if tested is not None:
                met = met.join(tested, (F.col("node") == F.col("b")) & (F.col("a") == F.col("l")), "left_anti")
            pairs = met.groupBy("node").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", F.col("node").alias("b"))
            pairs = settle(pairs)
            used.append(pairs)
            more = pairs.select(F.col("a").alias("l"), "b")
            tested = more if tested is None else tested.unionByName(more)
        else:
            # components meet per token first, so members of one component are never paired with each other
            inside = settle(rows.groupBy("token", "comp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max("rest").alias("rest")))
            used.append(inside)
            one, two = (inside.select("token", *(F.col(c).alias(f"{c}{x}") for c in ("comp", "lo", "hi", "rest"))) for x in "ab")
            may = (F.col("compa") < F.col("compb")) & (F.col("hia") * 100 >= F.col("lob") * percent) & (F.col("hib") * 100 >= F.col("loa") * percent)
            may &= F.least("resta", "restb") >= _room(F.col("loa"), F.col("lob"), percent)
            meet = one.join(two, "token").where(may).select("token", "compa", "compb")
            x, y = (rows.select("token", F.col("node").alias(s), F.col("n").alias(f"n{s}"), F.col("comp").alias(f"comp{s}"), F.col("rest").alias(f"rest{s}")) for s in "ab")
            pairs = meet.join(x, ["token", "compa"]).join(y, ["token", "compb"]).where(fits("na", "nb", "resta", "restb")).select("a", "b").distinct()
        linked = settle(overlaps(fragments, pairs, percent))
        old, edges = edges, linked if edges is None else settle(edges.unionByName(linked))
        found = settle(connected_components(edges, "a", "b"))
        if old is not None:
            drop(old, linked)
        if comps is not None:
            drop(comps)
        comps = found
    drop(*used)
    return edges, comps


def _components(documents: DataFrame, words: int, percent: int, rounds: int, shard_shingles: int) -> tuple[DataFrame, DataFrame]:
    """Every row's doc_id, rid, n and node; and, for nodes of more than one row, node and comp."""
    sets = settle(sets_of(documents, words))
    total = sets.agg(F.sum("n")).first()[0] or 0
    shared = shared_counts(documents, words, max(8, math.ceil(total / shard_shingles)))
    # rows of one text are one from here on, so a text of very many rows is no hot key
    texts = sets.where("n > 0").groupBy("rid", "node", "n").agg(F.count(F.lit(1)).alias("copies"))
    classes = settle(texts.groupBy("node").agg(F.min("rid").alias("rid"), F.min("n").alias("n"), F.sum("copies").alias("copies")))
    # one text stands for its class; with others of equal set, all of its shingles are shared
    alive = shared.join(classes, "rid").where(F.col("shared") * 100 >= F.col("n") * percent)
    wanted = settle(alive.select("rid", "node"))
    tokens = settle(tokens_of(documents, wanted, words))
    fragments, used = ordered_fragments(tokens, percent)
    edges, comps = _links(fragments, percent, rounds)
    copies = classes.where("copies > 1").select("node", F.col("node").alias("comp"))
    linked = comps.select("node", F.col("component").alias("comp"))
    found = settle(copies.join(linked.select("node"), "node", "left_anti").unionByName(linked))
    drop(wanted, classes, tokens, fragments, edges, comps, *used)
    return sets, found


def jaccard_components(documents: DataFrame, words: int = 5, percent: int = 80, rounds: int = 2, shard_shingles: int = 2_000_000) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    sets, found = _components(documents, words, percent, rounds, shard_shingles)
    rows = sets.join(_small(found), "node", "left")
    # a component's smallest id; partial minima meet, so its size does not matter
    least = settle(rows.where("comp is not null").groupBy("comp").agg(F.min("doc_id").alias("least")))
    rows = rows.join(_small(least), "comp", "left")
    return rows.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("least", "doc_id").alias("component_id"))


def keep_one(documents: DataFrame, words: int = 5, percent: int = 80, rounds: int = 2, shard_shingles: int = 2_000_000) -> DataFrame:
    """documents with one row for each component of near copies, the one with its smallest doc_id.

    Rows are told apart by their text, not by doc_id: rows that share an id but not a component stay.
    """
    sets, found = _components(documents, words, percent, rounds, shard_shingles)
    rid, key, comp, row = (unused(documents, c) for c in ("_rid", "_key", "_comp", "_row"))
    known = settle(sets.join(_small(found), "node").select(F.col("rid").alias(key), F.col("comp").alias(comp)).distinct())
    keyed = documents.withColumn(rid, F.xxhash64(F.col("text").cast("string")))
    alone = keyed.join(_small(known), F.col(rid) == F.col(key), "left_anti").select(*columns(documents))
    grouped = keyed.join(_small(known), F.col(rid) == F.col(key))
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col(rid), row_key(documents))
    first = grouped.groupBy(comp).agg(F.min_by(F.struct(*columns(documents)), order).alias(row)).select(f"{row}.*")
    return alone.unionByName(first)
