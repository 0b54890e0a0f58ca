"""Vector codes, the point-in-time join and sharding against plain versions."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import feature_join, sharding, vector_codes

VECTORS = "vec_id long, embedding array<float>, label int, code string, error long, v int"


def lloyd(rows, parts=8, entries=16, rounds=6, scale=4096):
    """Codes, errors and codebooks by whole-number Lloyd rounds that measure everything."""
    kept = [(i, [int(np.floor(float(np.float32(x)) * scale)) for x in v], lab) for i, v, lab in rows if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    if not kept:
        return [], ""
    width = -(-max(1, *(len(v) for _, v, _ in kept)) // parts) * parts if len(kept) > 1 else -(-max(1, len(kept[0][1])) // parts) * parts
    # short vectors sort before they are filled up
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    vs = [v + [0] * (width - len(v)) for _, v, _ in kept]
    w = width // parts
    cut = [[tuple(v[p * w : (p + 1) * w]) for p in range(parts)] for v in vs]
    books = [[list(c[p]) for c in cut[:entries]] for p in range(parts)]

    def nearest(c, p):
        return min((sum((a - b) ** 2 for a, b in zip(c, e)), k) for k, e in enumerate(books[p]))

    for _ in range(rounds):
        own = [[nearest(c[p], p)[1] for p in range(parts)] for c in cut]
        for p in range(parts):
            for k in range(len(books[p])):
                mine = [c[p] for c, o in zip(cut, own) if o[p] == k]
                if mine:
                    books[p][k] = [sum(x) // len(mine) for x in zip(*mine)]
    out, labels = [], {}
    for (i, _, lab), c in zip(kept, cut):
        best = [nearest(c[p], p) for p in range(parts)]
        out.append((i, "".join(f"{k:02x}" for _, k in best), sum(d for d, _ in best), lab))
        labels[lab] = labels.get(lab, 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return [(i, code, error, labels[lab], digest) for i, code, error, lab in out], digest


def vectors(n, width, seed, grid=None):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, width)).astype(np.float32)
    if grid:
        x = np.round(x * grid) / grid
    return [[k, [float(y) for y in v], int(rng.integers(0, 4)) if k % 9 else None] for k, v in enumerate(x)]


@pytest.mark.parametrize("rows", [
    vectors(300, 16, 1),
    vectors(200, 8, 2, grid=1) + [[7, [1.0] * 8, 1], [7, [1.0] * 8, 1], [7, [0.5] * 8, 2], [None, [0.0] * 8, None]],  # very many ties, repeated ids and rows
    vectors(5, 24, 3),  # fewer rows than entries
    vectors(40, 10, 4) + [[900, None, 1], [901, [1.0, None], 1], [902, [float("nan")] * 10, 2], [903, [float("inf")] * 10, 2], [904, [], 3], [905, [0.25], 3]],
    [[k, [0.5] * 8, 1] for k in range(30)],
    [],
])
def test_vector_codes(spark, rows):
    some = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], VECTORS).repartition(5)
    got = vector_codes.vector_codes(some)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    key = lambda r: tuple((x is None, x or 0) if not isinstance(x, str) else (False, x) for x in r)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(lloyd(rows)[0], key=key)


def test_vector_codes_bounds():
    """Bounds that went through rounds leave entries out and never change a result, ties included."""
    rng = np.random.default_rng(8)
    for grid in (3, 500):
        x = rng.integers(-grid, grid, (400, 4)).astype(np.int64)
        entries, before = x[:16].copy(), None
        own, upper, lower, measured = np.zeros(400, np.int64), np.full(400, np.inf, np.float32), np.zeros((400, 16), np.float32), []
        for _ in range(8):
            measured.append(vector_codes.assign(x, own, upper, lower, vector_codes.Codebook(entries, before)))
            far = ((x[:, None, :] - entries[None]) ** 2).sum(axis=2)
            assert np.array_equal(own, far.argmin(axis=1))
            true = np.sqrt(far)
            assert (upper >= true[np.arange(400), own]).all() and (lower <= true).all()
            before, entries = entries, np.array([x[own == k].sum(axis=0) // max(1, (own == k).sum()) if (own == k).any() else entries[k] for k in range(16)])
        assert 400 * 4 < measured[0] <= 400 * 16 and measured[-1] < measured[0] / 2


def test_vector_codes_too_large(spark):
    with pytest.raises(ValueError):
        vector_codes.vector_codes(spark.createDataFrame([(1, [3e30] * 8, 1)], "vec_id long, embedding array<float>, label int"))


def test_interval_tree():
    rng = np.random.default_rng(3)
    for n in [0, 1, 2, 3, 7, 8, 9, 100, 1000]:
        start = np.sort(rng.integers(0, 500, n))
        expiry = start + rng.integers(1, 80, n)
        tree, t = feature_join.IntervalTree(start, expiry), np.arange(-5, 600, 3)
        got = sorted((int(a), int(b)) for asks, nodes in tree.stabbed(t) for a, b in zip(asks, nodes))
        assert got == sorted((a, b) for a in range(len(t)) for b in range(n) if start[b] <= t[a] < expiry[b])
        order = rng.permutation(n)
        best = feature_join.latest_of(tree, order, t)
        assert best.tolist() == [max((int(order[b]) for b in range(n) if start[b] <= x < expiry[b]), default=-1) for x in t]


def _part(doc, k):
    return int(hashlib.sha256(str(doc).encode()).hexdigest()[8 * k : 8 * k + 8], 16)


def joined(documents, labels):
    versions = [(s, _part(d, 0) % 50000, _part(d, 1) % 600, _part(d, 2) % 900, d, n, lang) for d, s, n, lang in documents if d is not None and s is not None]
    out = []
    for d in labels:
        if d is None:
            out.append((None, None, None, None, "none", None, None))
            continue
        t, source = _part(d, 3) % 50000, min((s for x, s, _, _ in documents if x == d and s is not None), default=None)
        can = [(e, -(e - 60 + b), v, (n is not None, n or 0), (lang is not None, lang or "")) for s, e, b, c, v, n, lang in versions if s == source and e <= t and e - 60 + b <= t < e + c]
        if not can:
            out.append((d, t, None, None, "none", None, None))
            continue
        e, _, v, n, lang = max(can)
        fresh = t - e <= 120
        out.append((d, t, v, t - e, "fresh" if fresh else "stale", n[1] if fresh and n[0] else None, lang[1] if fresh and lang[0] else None))
    return out


def _plain(rows):
    return sorted(map(tuple, rows), key=str)


@pytest.mark.parametrize("options", [{}, {"block": 5}, {"chunk": 16, "reach": 1}, {"chunk": 100_000}])
def test_features(spark, options):
    rng = random.Random(4)
    documents = [(k, "hot" if k % 3 else rng.choice(["a", "b", None]), rng.choice([5, 6, None]), rng.choice(["en", None])) for k in range(4000)]
    documents += [(None, "hot", 1, "en"), (5, "a", 9, "fr"), (5, "a", 9, "fr"), (5, "a", 8, "de"), (7, None, 1, "x")]
    labels = [rng.randrange(5000) for _ in range(600)] + [None, None, 5, 5, 7, 8] + [11] * 40
    d = spark.createDataFrame([(*r[:2], None, *r[2:], 1) for r in documents], "doc_id long, source string, text string, n_chars long, lang string, t int").repartition(7)
    asked = spark.createDataFrame([(x, 1, "fresh") for x in labels], "doc_id long, event int, status string").repartition(3)
    got = feature_join.features(d, asked, **options)
    assert _plain(got.collect()) == _plain(joined(documents, labels))
    assert got.columns == ["doc_id", "t", "version_id", "age", "status", "n_chars", "lang"]


def test_features_of_empty_tables(spark):
    d = spark.createDataFrame([(1, "a", 1, "en")], "doc_id long, source string, n_chars long, lang string")
    asked = spark.createDataFrame([(1,), (2,)], "doc_id long")
    assert feature_join.features(d, asked.limit(0)).count() == 0
    assert [r["status"] for r in feature_join.features(d.limit(0), asked).collect()] == ["none", "none"]


def test_features_over_many_tasks(spark):
    """Versions and asks of a cell come to one task, however many tasks there are."""
    documents = [(k, "hot" if k % 3 else "b", k, "en") for k in range(3000)]
    d = spark.createDataFrame([(*r[:2], None, *r[2:]) for r in documents], "doc_id long, source string, text string, n_chars long, lang string")
    asked = spark.createDataFrame([(x,) for x in range(0, 3000, 5)], "doc_id long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = feature_join.features(d, asked).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert _plain(got) == _plain(joined(documents, range(0, 3000, 5)))


def test_long_lived_versions(spark):
    """Versions of any length go to a level with few copies; answers stay those of a plain search."""
    rng = random.Random(9)
    rows = [("s", k, e, e + rng.randrange(-5, 30), e + rng.choice([0, 1, 50, 1 << 20, 1 << 40]), k, None) for k, e in enumerate(rng.randrange(10_000) for _ in range(500))]
    asks = [("s", rng.randrange(-10, 20_000), k) for k in range(200)] + [(None, 5, 900), ("z", 5, 901)]
    v = spark.createDataFrame(rows, "source string, version_id long, event long, arrival long, expiry long, n_chars long, lang string")
    got = {r["ask_id"]: r["version_id"] for r in feature_join.latest_versions(v, spark.createDataFrame(asks, "source string, t long, ask_id long"), block=50).collect()}
    want = {}
    for s, t, k in asks:
        can = [(e, -a, i) for s2, i, e, a, x, _, _ in rows if s2 == s and e <= t and a <= t < x]
        if can:
            want[k] = max(can)[2]
    assert got == want


def check_shards(rows, got, shards):
    assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["size"], r["text_crc32"]) for r in got) == sorted(
        (d if d is not None else -1, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows
    )
    assert all(r["law"] == "bytes" and r["grown_shard"] is None and 0 <= r["shard"] < shards for r in got)
    total, most = sum(r["size"] for r in got), max(r["size"] for r in got)
    sums = {}
    for k in range(shards):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))
        sums[k] = sum(r["size"] for r in got if r["shard"] == k)
    assert all(abs(x - total / shards) <= most + 2 * 0.001 * total / shards for x in sums.values())
    return sums


def test_shards(spark):
    rng = random.Random(6)
    rows = [(k, "wörd " * rng.choice([0, 1, 30, 200])) for k in range(1500)]
    rows += [(rng.choice([None, k]), "the hot text " * 20) for k in range(800)]  # one group of equal texts
    rows += [(5, "same row")] * 900 + [(None, None)] * 30 + [(9000, "very long " * 20_000)]
    some = spark.createDataFrame([(*r, 1, "z") for r in rows], "doc_id long, text string, shard int, size string").repartition(6)
    for shards, fan in ((16, 1024), (3, 2), (1, 16)):
        check_shards(rows, sharding.assign_shards(some, shards).collect(), shards)
        keyed = sharding.keyed(some)
        keys = sharding.splitters(keyed, shards, fan=fan)
        assert len(keys) == shards - 1 and keys == sorted(keys)


def test_shards_are_cut_at_groups_only_where_needed(spark):
    """The texts of two neighbouring shards have at most the group that a splitter falls into in common."""
    rows = [(k, f"text {k % 50} " * 10) for k in range(2000)]
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), keep=["text"]).collect()
    check_shards(rows, got, 16)
    seen = {k: {r["text"] for r in got if r["shard"] == k} for k in range(16)}
    assert all(len(seen[a] & seen[b]) <= (1 if b == a + 1 else 0) or b > a + 1 and seen[a] & seen[b] == seen[a] & seen[a + 1] for a in range(16) for b in range(a + 1, 16))
    assert sum(map(len, seen.values())) <= 50 + 15


def test_shards_of_small_tables(spark):
    schema = "doc_id long, text string"
    assert sharding.assign_shards(spark.createDataFrame([], schema)).count() == 0
    check_shards([(1, "a"), (2, None)], sharding.assign_shards(spark.createDataFrame([(1, "a"), (2, None)], schema)).collect(), 16)


def test_written_shards(spark, tmp_path):
    rows = [(k, f"text {k}", {"a": k}, k) for k in range(50)]
    some = spark.createDataFrame(rows, "doc_id long, text string, shard map<string,int>, slot int")
    sharding.write_shards(some, str(tmp_path / "out"), shards=4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(back.columns) == sorted(["doc_id", "text", "shard", "slot", "slot_", "shard_"])
    assert sorted((r["doc_id"], r["text"], r["shard"]["a"], r["slot"]) for r in back.collect()) == sorted((k, t, m["a"], s) for k, t, m, s in rows)
    assert back.groupBy("shard_").agg(F.max("slot_") + 1, F.count("*")).where("(max(slot_) + 1) <> `count(1)`").count() == 0
