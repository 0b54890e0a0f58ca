"""Best partners, stories over digests and the keyed table."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from tidewire.functions import fixed
from tidewire.operators import history
from tidewire.operators.best_match import best_partners
from tidewire.sources.state_table import StateTable
from tidewire.streaming import stories, streams

KINDS = list(fixed.ENTITY_WEIGHTS)
ENTITIES = "struct<" + ",".join(f"{k}:array<string>" for k in KINDS) + ">"


def overlap(a, b):
    total = 0.0
    for kind, w in fixed.ENTITY_WEIGHTS.items():
        x, y = ({v.strip().lower() for v in (e[kind] or []) if v is not None and v.strip()} for e in (a, b))
        if x and y:
            total += len(x & y) / len(x | y) * w
    return min(total, 1.0)


def sets(rng, hot=0.3):
    pick = lambda n: [rng.choice(["Hot", f"v{rng.randrange(40)}", f" V{rng.randrange(8)} "]) for _ in range(rng.randrange(n + 1))]
    if rng.random() < hot:  # a large group of equal sets
        return {"organizations": ["Hot"], "products": [], "people": None, "topics": ["hot", ""]}
    return {"organizations": pick(3), "products": pick(2), "people": pick(1), "topics": pick(12)}


@pytest.mark.parametrize("least", [0.05, 0.1, 0.5, 0.9])
def test_best_partners(spark, least):
    rng = random.Random(int(least * 100))
    left, right = [(k, sets(rng)) for k in range(250)], [(k * 7 % 1000, sets(rng, 0.2)) for k in range(150)]
    left += [(900, {k: [] for k in KINDS}), (901, {k: None for k in KINDS}), (902, left[0][1])]
    frame = lambda rows: spark.createDataFrame(rows, f"id long, entities {ENTITIES}").repartition(3)
    got = {r["a"]: (r["b"], r["score"]) for r in best_partners(frame(left), frame(right), fixed.ENTITY_WEIGHTS, least).collect()}
    want = {}
    for a, x in left:
        best = max(((overlap(x, y), -b) for b, y in right), default=(0, 0))
        if best[0] >= least:
            want[a] = (-best[1], best[0])
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 1e-12 for k in want)


def test_best_partners_of_nothing(spark):
    some = spark.createDataFrame([(1, {k: ["a"] for k in KINDS})], f"id long, entities {ENTITIES}")
    assert best_partners(some, some.limit(0), fixed.ENTITY_WEIGHTS, 0.1).count() == 0
    assert best_partners(some.limit(0), some, fixed.ENTITY_WEIGHTS, 0.1).count() == 0


def test_state_table(spark, tmp_path):
    rng = random.Random(3)
    rows = [(rng.randrange(60), rng.choice("IUD"), k, {"k": k}) for k in range(600)]
    schema = "id long, op string, version long, tags map<string,int>"
    batches = [rows[k::6] for k in (3, 0, 5, 1, 4, 2)]  # out of order
    table = StateTable(spark, str(tmp_path / "t"), ["id"], ["version"], buckets=4, deleted="op = 'D'", compact_after=3)
    with pytest.raises(ValueError):
        table.read()
    for k, some in enumerate(batches):
        assert table.upsert(spark.createDataFrame(some, schema), k)
        assert not table.upsert(spark.createDataFrame(rows, schema), k)  # a batch that is run again
        seen = [r for b in batches[: k + 1] for r in b]
        want = {}
        for r in sorted(seen, key=lambda r: r[2]):
            want[r[0]] = r
        got = {r["id"]: tuple(r) for r in StateTable(spark, str(tmp_path / "t")).read().collect()}
        assert got == {i: r for i, r in want.items() if r[1] != "D"}
    m = table.manifest()
    assert m["done"] == {"": 5} and len(m["deltas"]) < 3 and m["base"]
    table.upsert(spark.createDataFrame([(1, "I", -5, {}), (2, "I", 10_000, {"x": 1})], schema), 0, writer="other")  # late, and new
    table.compact()
    assert table.read().where("id = 2").first()["version"] == 10_000 and {r[0] for r in table.read().collect()} == set(got) | {2}
    named = {*table.manifest()["base"].values()}
    table.vacuum(keep=1)
    assert {p.name for p in (tmp_path / "t" / "data").iterdir()} == {n.rpartition("/")[2] for n in named}


def test_state_table_survives_a_failed_write(spark, tmp_path, monkeypatch):
    table = StateTable(spark, str(tmp_path / "t"), ["id"], ["v"])
    one = spark.createDataFrame([(1, 1)], "id long, v long")
    table.upsert(one, 0)
    monkeypatch.setattr(StateTable, "_commit", lambda self, m: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        table.upsert(spark.createDataFrame([(1, 2)], "id long, v long"), 1)
    monkeypatch.undo()
    assert table.read().collect() == one.collect()
    assert table.upsert(spark.createDataFrame([(1, 3)], "id long, v long"), 1)
    assert [r["v"] for r in table.read().collect()] == [3]
    with pytest.raises(ValueError):
        StateTable(spark, str(tmp_path / "none"))


def test_state_table_of_a_stream(spark, tmp_path):
    for k in range(3):
        spark.createDataFrame([(i, k * 10 + i) for i in range(5)], "id long, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    table = StateTable(spark, str(tmp_path / "t"), ["id"], ["v"], buckets=2)
    stream = lambda: spark.readStream.schema("id long, v long").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.finish(streams.deliver(stream(), table.sink(), str(tmp_path / "cp")))
    spark.createDataFrame([(9, 9)], "id long, v long").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    streams.finish(streams.deliver(stream(), table.sink(), str(tmp_path / "cp")))
    assert sorted(map(tuple, table.read().collect())) == [*((i, 20 + i) for i in range(5)), (9, 9)]
    assert table.manifest()["done"] == {"": 3}


def test_story_state_is_the_fold(spark, tmp_path):
    """Three days and then, after a long silence, more: the replay ends where the batch does."""
    rng = random.Random(1)
    start = dt.datetime(2024, 1, 1)
    days = [0, 1, 2, 30, 31]
    rows = [(rng.randrange(12), n, start + dt.timedelta(days=d, minutes=rng.randrange(1400)), f"t{n}.{k}") for n, d in enumerate(days) for k in range(12)]
    rows += [(99, None, start, "no digest"), (98, 1, start, "once")]
    schema = "story_id long, digest_id long, seen_at timestamp, title string"
    for n, d in enumerate(days):
        mine = [r for r in rows if start + dt.timedelta(days=d) <= r[2] < start + dt.timedelta(days=d + 1)]
        spark.createDataFrame(mine, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stories.use_rocksdb(spark)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = streams.run_once(stories.track(stream), "replay", "update", str(tmp_path / "cp")).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r["last_seen_at"], r["card_count"])):
        got[r["story_id"]] = tuple(r)
    want = {r["story_id"]: tuple(r) for r in stories.fold(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and want[99][5] == [] and want[98][4] == 1
    assert any(r[2] >= start + dt.timedelta(days=30) for r in want.values())  # some began anew


def test_story_book(spark, tmp_path):
    """Digest after digest equals a plain loop over all of them; a digest that comes again changes nothing."""
    rng = random.Random(5)
    digests = [(n, dt.datetime(2024, 1, 1 + 6 * n), [(n * 100 + k, f"c{k}", sets(rng)) for k in range(15)]) for n in range(1, 5)]
    schema = f"digest_id long, digest_at timestamp_ntz, event_id long, canonical_title string, entities {ENTITIES}"
    book = stories.StoryBook(spark, str(tmp_path / "book"), least=0.2, buckets=2)
    assert book.stories() is None
    frame = lambda ds: spark.createDataFrame([(n, at, *c) for n, at, cards in ds for c in cards], schema)
    book.take(frame(digests[:1]))
    book.take(frame(digests[:3][::-1]))  # the first one again, and two in one batch
    book.take(frame(digests[3:]))
    known = {}
    for n, at, cards in digests:
        hits = {}
        for i, title, e in cards:
            best = max(((overlap(e, s["e"]), -k) for k, s in known.items() if at - s["last"] <= dt.timedelta(days=14)), default=(0, 0))
            if best[0] >= 0.2:
                hits.setdefault(-best[1], []).append(i)
            else:
                hits[(1 << 40) + i] = (title, e)
        for k, v in hits.items():
            if isinstance(v, tuple):
                known[k] = {"e": v[1], "title": v[0], "first": at, "last": at, "n": 1, "ids": [n]}
            else:
                known[k]["last"] = at
                known[k]["n"] += len(v)
                known[k]["ids"].append(n)
    got = {r["story_id"]: (r["canonical_title"], r["first_seen_at"], r["last_seen_at"], r["card_count"], r["digest_ids"]) for r in book.stories().collect()}
    assert got == {k: (s["title"], s["first"], s["last"], s["n"], s["ids"]) for k, s in known.items()}
    assert max(s["n"] for s in known.values()) > 2


def test_update_adds_a_digest_once(spark):
    e = {k: ["Tesla"] for k in KINDS}
    now = "2024-01-10 00:00:00"
    schema = f"story_id long, canonical_title string, entities {ENTITIES}, first_seen_at timestamp_ntz, last_seen_at timestamp_ntz, card_count long, digest_ids array<long>"
    old = spark.createDataFrame([(1, "t", e, dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 9), 1, [2])], schema)
    events = spark.createDataFrame([(5, "u", e)], f"event_id long, canonical_title string, entities {ENTITIES}")
    found = history.best_story(events, old, 0.5, now)
    for digest, want in ((2, [2]), (3, [2, 3]), (None, [2])):
        r = history.upsert_stories(old, events, found, now, digest).collect()
        assert [(x["story_id"], x["card_count"], x["digest_ids"], str(x["last_seen_at"])) for x in r] == [(1, 2, want, now)]
    assert history.best_story(events, old, 0.5, "2024-02-10").count() == 0
    assert history.upsert_stories(old, events, found.where(F.lit(False)), now, 7).where("story_id > 1").first()["digest_ids"] == [7]
