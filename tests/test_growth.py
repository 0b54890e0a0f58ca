"""What keeps the work of a query in proportion to its input, with results against plain versions."""

import hashlib
import random
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tidewire.functions import fixed
from tidewire.functions import text as T
from tidewire.operators import best_match, cluster, dedup, discover, history, overlap, rank
from tidewire.operators.components import connected_components
from tidewire.runtime import settle


def _simhash(text):
    votes = [int(hashlib.md5(w.encode()).hexdigest()[16:], 16) for w in text.lower().split()]
    h = sum(1 << i for i in range(64) if 2 * sum(v >> i & 1 for v in votes) > len(votes))
    return h - (1 << 64) if h >> 63 else h


def test_simhash_reads_each_word_once(spark):
    texts = ["", "one", "one two", "x " * 300 + "y z", " ".join(f"w{k}" for k in range(200_000))]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "k int, t string")
    began = time.time()
    got = dict(rows.select("k", T.simhash(F.col("t"))).collect())
    assert time.time() - began < 20
    assert got == {k: _simhash(t) for k, t in enumerate(texts)}


def test_simhash_pairs_broadcast_nothing(spark):
    rows = [(k, "a", f"title number {k % 40} of some words {k % 3}", "") for k in range(200)]
    a = spark.createDataFrame(rows, "seq long, category string, title string, snippet string")
    pairs = dedup.simhash_pairs(a)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    hashes = {k: _simhash(t + " ") for k, _, t, _ in rows}
    first = {}
    for k, h in hashes.items():
        first.setdefault(h, k)
    bits = lambda a, b: bin((a ^ b) & (2**64 - 1)).count("1")
    want = {(first[h], k, 0) for k, h in hashes.items() if first[h] != k}
    want |= {(x, y, bits(g, h)) for g, x in first.items() for h, y in first.items() if x < y and bits(g, h) < 4}
    assert {(r["a"], r["b"], r["bits"]) for r in pairs.collect()} == want


@pytest.mark.parametrize("jaccard, shared, hours", [(0.2, 2, 24), (0.34, 3, 5), (0.0, 2, 24), (0.5, 1, 24)])
def test_event_edges_connect_as_all_pairs(spark, jaccard, shared, hours):
    rng = random.Random(shared)
    words = [f"word{c}" for c in "abcdefghijklmnop"]
    rows = [(k, rng.choice(["x", "y", None]), " ".join(rng.sample(words, rng.randrange(1, 7))).replace("word", "wor"), rng.choice([None] + [rng.randrange(900)] * 15)) for k in range(150)]
    a = spark.createDataFrame(rows, "seq long, category string, title string, h int")
    a = a.withColumn("published_at", F.expr("timestampadd(HOUR, h, TIMESTAMP_NTZ'2024-01-01 00:00:00')"))
    of = lambda edges: {(r["node"], r["component"]) for r in connected_components(edges, "a", "b").collect()}
    got, want = of(cluster.event_edges(a, jaccard, shared, hours)), of(cluster.token_edges(a, jaccard, shared, hours))
    assert got == want and len(got) > 15


def test_event_edges_are_few(spark):
    """Very many articles of one moment and one title: an edge or two each for every pair of keywords."""
    a = spark.range(3000).select(F.col("id").alias("seq"), F.lit("x").alias("category"), F.lit("some words here").alias("title"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("published_at"))
    assert cluster.event_edges(a).count() < 10 * 3000


def test_events_broadcast_nothing(spark, monkeypatch):
    """Tables of keys and edges look small to the planner; no step from articles to events sends one through the driver."""
    from tidewire.operators import components
    from tidewire.plans import digest

    plans = []
    seen = lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or settle(df)
    for module in (cluster, components, digest):
        monkeypatch.setattr(module, "settle", seen)
    rows = [(k, "x", f"word{'abcdefg'[k % 7]} some{'pqrst'[k % 5]}", "", "s", "source", "a", None if k % 11 == 0 else k % 90) for k in range(200)]
    a = spark.createDataFrame(rows, "seq long, category string, title string, snippet string, source string, role string, section string, h int")
    events = digest.events_of(a.withColumn("published_at", F.expr("timestampadd(HOUR, h, TIMESTAMP_NTZ'2024-01-01 00:00:00')")))
    plans.append(events._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 6 and not [p for p in plans if "Broadcast" in p]
    assert sum(r["n_articles"] for r in events.collect()) == 200


def test_diverse_top_ends_with_the_choice(spark):
    """Rows that all resemble each other make no pairs; what is decided is the greedy choice, and skipped rows fill up."""
    rows = [("same", k, "alpha beta gamma") for k in range(1, 2001)] + [("mixed", k, f"alpha {'abcdefghij'[k % 10] * 5}") for k in range(1, 41)]
    got = rank.diverse_top(spark.createDataFrame(rows, "section string, rank int, text string"), 4).collect()
    of = lambda s: [(r["place"], r["rank"], r["diverse"]) for r in sorted(got, key=lambda r: r["place"]) if r["section"] == s]
    assert of("same") == [(1, 1, True), (2, 2, False), (3, 3, False), (4, 4, False)]
    assert of("mixed") == [(k, k, True) for k in range(1, 5)]


@pytest.mark.parametrize("name, batches", [("story_book", 3)])
def test_stories_come_in_files_of_many_tasks(spark, name, batches):
    """Each digest is one micro-batch of all its files, which no single task has to write or read."""
    from tidewire.plans import registry
    from tidewire.runtime import shared_dir

    shared = Path(shared_dir(spark).removeprefix("file://"))
    before, kept = set(shared.glob("stor*")), spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert registry.QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", kept)
    (folder,) = set(shared.glob("stor*")) - before
    assert len(list((folder / "cards").glob("*.parquet"))) > batches


def test_copies_of_titles_meet_last(spark):
    """Rows of equal titles meet in the last join, and a filter by similar titles never pairs them."""
    rows = lambda n, t: spark.range(n).select("id", F.lit(t).alias("t"), F.col("id").alias("day"))
    now, past = rows(300, "some title of the day"), rows(200, "some title of the days")
    pairs = history.similar_titles(now, past.withColumnRenamed("id", "past"), "id", "t", "past", "t", more=("day",))
    assert pairs.where("past = day").count() == pairs.count() == 60_000
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2
    assert history.new_only(now, past.withColumnRenamed("id", "past"), "id", "t", "past", "t").count() == 0


def test_candidates_are_filtered_before_they_are_shuffled(spark):
    """Sets of common tokens meet very often, but hardly any pair is passed on to be told apart and checked."""
    rng = random.Random(5)
    sets = {k: sorted(rng.sample(range(120), 40)) for k in range(250)} | {900: list(range(40)), 901: list(range(2, 42))}
    df = settle(spark.createDataFrame([(k, [f"t{x}" for x in v]) for k, v in sets.items()], "id long, tokens array<string>"))
    got = overlap.similar_within(df, 0.7)
    assert {(r["a"], r["b"]) for r in got.collect()} == {(a, b) for a in sets for b in sets if a < b and len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b])) >= 0.7}
    assert "bit_count" in got._jdf.queryExecution().optimizedPlan().toString()


def _entity_events(spark):
    """Copies, null categories and values, and kinds that only sum up to the threshold together."""
    rng = random.Random(9)
    kinds = ("organizations", "products", "people", "topics")
    some = lambda n: rng.choice([None, []] + [[rng.choice(["Acme", " acme", "Beta", "Gamma 2", None, "x", "y"]) for _ in range(rng.randrange(1, n + 1))]] * 4)
    rows = [(k, rng.choice(["a", "a", "b", None]), {kind: some(3) for kind in kinds}) for k in range(1, 220)]
    rows += [(k, "a", {"organizations": ["Acme"], "products": ["P 1"], "people": [], "topics": ["t"]}) for k in range(1000, 1300)]
    return rows, spark.createDataFrame(rows, f"event_id long, category string, entities struct<{','.join(k + ':array<string>' for k in kinds)}>")


def _overlap(a, b):
    total = 0.0
    for kind, w in fixed.ENTITY_WEIGHTS.items():
        x, y = ({v if v is None else v.strip(" ").lower() for v in e[kind] or ()} for e in (a, b))
        total += (len(x & y) / len(x | y) if x and y else 0.0) * w
    return min(total, 1.0)


@pytest.mark.parametrize("least", [0.3, 0.5])
def test_entity_pairs_expand_last(spark, monkeypatch, least):
    """Classes of equal entities are compared, and their events meet in the last step, which is not shuffled."""
    monkeypatch.setattr(cluster, "_BLOCK", 70, raising=False)
    rows, df = _entity_events(spark)
    pairs = cluster.entity_edges(df, least)
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert 0 <= plan.find("Generate") < plan.find("Join")
    got = [(r["a"], r["b"], round(r["overlap"], 9)) for r in pairs.collect()]
    want = {(a, b, round(_overlap(x, y), 9)) for a, c, x in rows for b, d, y in rows if a < b and c == d and c is not None and _overlap(x, y) >= least}
    assert len(got) == len(want) and set(got) == want


def test_entity_groups_connect_classes(spark, monkeypatch):
    """Events are connected by an edge each, not by all their pairs."""
    counts, connect = [], cluster.connected_components
    monkeypatch.setattr(cluster, "connected_components", lambda edges, *c: counts.append(edges.count()) or connect(edges, *c))
    rows, df = _entity_events(spark)
    got = {r["event_id"]: r["group_id"] for r in cluster.entity_groups(df).collect()}
    group = {k: k for k, _, _ in rows}
    pairs = [(a, b) for a, c, x in rows for b, d, y in rows if a < b and c == d and c is not None and _overlap(x, y) >= 0.5]
    for _ in range(10):
        for a, b in pairs:
            group[a] = group[b] = min(group[a], group[b])
    assert got == group and counts[0] < 300 + len([p for p in pairs if p[0] < 1000])


def test_entity_texts_are_read_once(spark):
    """The parts of the text are computed once, not again for each value that is compared with the others."""
    text = F.concat(F.lit("Alpha Beta and "), F.col("t"))
    plan = spark.range(1).select(F.lit("Gamma 3").alias("t")).select(T.entities(text).alias("e"))._jdf.queryExecution().analyzed().toString()
    assert plan.count("Alpha Beta and") == 1


def test_token_pairs_are_not_shuffled(spark):
    """Pairs are judged where they are found: nothing is aggregated or joined behind the joins that make them."""
    rows = [(k, "x" if k % 3 else None, f"word{'abcdefg'[k % 7]} some{'pqrst'[k % 5]} {'title ' * (k % 2)}", None if k % 11 == 0 else k % 90) for k in range(200)]
    a = spark.createDataFrame(rows, "seq long, category string, title string, h int")
    a = a.withColumn("published_at", F.expr("timestampadd(HOUR, h, TIMESTAMP_NTZ'2024-01-01 00:00:00')"))
    edges = cluster.token_edges(a)
    plan = edges._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 2 and "Aggregate" not in plan
    words = {k: set(r["kw"]) for k, r in ((r["seq"], r) for r in a.select("seq", T.keywords(F.col("title")).alias("kw")).collect())}
    want = {}
    for p, c, _, h in rows:
        for q, d, _, g in rows:
            n = len(words[p] & words[q])
            if p < q and c == d and c is not None and (h is None or g is None or abs(h - g) <= 24) and n and (n >= 2 or n >= 0.2 * (len(words[p] | words[q]))):
                want[p, q] = n
    got = [((r["a"], r["b"]), r["shared"]) for r in edges.collect()]
    assert len(got) == len(want) > 500 and dict(got) == want


@pytest.mark.parametrize("few", [0, 10_000])
def test_catalogue_is_not_broadcast(spark, tmp_path, monkeypatch, few):
    """Words go to all tasks if they are few; the catalogue looks small to the planner, but never does."""
    monkeypatch.setattr(discover, "_FEW", few, raising=False)
    names = [f"steel {'abcdefg'[k % 7] * 3} copper{k % 5}" for k in range(300)]
    rows = [(k, t, f"brass {t[:8]}", ["tin", t[:5]], k % 3 == 0, ("high", "medium", "low")[k % 3]) for k, t in enumerate(names)]
    spark.createDataFrame(rows, "id long, name string, description string, tags array<string>, recommended boolean, quality string").write.parquet(f"{tmp_path}/catalog")
    asks = [(0, "Steel bbb steel"), (1, "copper3 tin none")]
    got = discover.match_interests(spark.createDataFrame(asks, "interest_id long, text string"), spark.read.parquet(f"{tmp_path}/catalog"))
    lines, sent = got._jdf.queryExecution().executedPlan().toString().splitlines(), False
    for line in lines:
        depth = len(line) - len(line.lstrip(" :+-"))
        if "BroadcastExchange" in line:
            sent, below = True, depth
        elif sent and depth <= below:
            sent = False
        assert not (sent and (few == 0 or f"{tmp_path}/catalog" in line or "Generate" in line)), line
    assert few == 0 or any("BroadcastExchange" in line for line in lines)
    want = []
    for i, text in asks:
        found = []
        for k, name, about, tags, good, quality in rows:
            hits = sum(3 * (w in name) + 2 * (w in about) + 2 * sum(w in t for t in tags) for w in text.lower().split())
            if hits:
                found.append((not good, -(hits + 5 * good + {"high": 2, "medium": 1, "low": 0}[quality]), k))
        want += [(i, r + 1, k, -s) for r, (_, s, k) in enumerate(sorted(found)[:5])]
    assert sorted(map(tuple, got.collect())) == want and len(want) == 10


def test_one_common_value_brings_few_candidates(spark, monkeypatch):
    """Sets that share one very common value of the heaviest kind meet on rarer values of other kinds first."""
    met, meet = [], best_match._meet
    monkeypatch.setattr(best_match, "_meet", lambda *a: met.append(meet(*a).count()) or meet(*a))
    rng, none = random.Random(3), {"products": [], "people": []}
    sets = lambda: {"organizations": ["Hot"] + ["Other"] * (rng.random() < 0.1), "topics": [f"t{rng.randrange(60)}" for _ in range(4)]} | none
    left, right = ([(k, sets()) for k in range(300)] for _ in range(2))
    frame = lambda rows: spark.createDataFrame(rows, f"id long, entities struct<{','.join(k + ':array<string>' for k in fixed.ENTITY_WEIGHTS)}>")
    got = {r["a"]: (r["b"], round(r["score"], 9)) for r in best_match.best_partners(frame(left), frame(right), fixed.ENTITY_WEIGHTS, 0.3).collect()}
    score = {(a, b): _overlap({k: [v.lower() for v in x[k]] for k in x}, {k: [v.lower() for v in y[k]] for k in y}) for a, x in left for b, y in right}
    want = {a: max((round(score[a, b], 9), -b) for b, _ in right) for a, _ in left}
    assert got == {a: (-b, s) for a, (s, b) in want.items() if s >= 0.3} and len(got) == 300
    assert sum(met) < 300 * 300 / 4


def test_sets_are_marked_once_and_stay_off_the_driver(spark):
    """A title is normalised once and not for each run, marks are made for a set and not for each token, and no side is broadcast."""
    title = F.concat(F.lit("Alpha Beta and "), F.col("t"))
    grams = spark.createDataFrame([("x",), (None,)], "t string").select(T.trigrams(title).alias("g"))
    assert grams._jdf.queryExecution().analyzed().toString().count("Alpha Beta and") == 1
    assert [len(r["g"]) for r in grams.collect()] == [14, 0]
    sets = settle(spark.createDataFrame([(k, [f"t{(k + j) % 90}" for j in range(20)]) for k in range(100)], "id long, tokens array<string>"))
    pairs = overlap.similar_between(sets, sets, 0.7)
    assert "Broadcast" not in pairs._jdf.queryExecution().executedPlan().toString()
    lines = pairs._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert not [b for a, b in zip(lines[1:], lines) if "Generate explode" in a and "xxhash64" in b]
    alike = lambda a, b: len({(a + j) % 90 for j in range(20)} & {(b + j) % 90 for j in range(20)})
    want = {(a, b) for a in range(100) for b in range(100) if alike(a, b) >= 0.7 * (40 - alike(a, b))}
    assert {(r["a"], r["b"]) for r in pairs.collect()} == want


def test_entity_blocks_are_small(spark, monkeypatch):
    """All pairs of two blocks are in memory at once, so blocks of a class with very many events are many and small."""
    tables = []
    monkeypatch.setattr(cluster, "settle", lambda df: tables.append(settle(df)) or tables[-1])
    one = F.struct(F.array(F.lit("Acme")).alias("organizations"), F.array(F.lit("P 1")).alias("products"), *(F.array().cast("array<string>").alias(k) for k in ("people", "topics")))
    pairs = cluster.entity_edges(spark.range(1, 1501).select(F.lit("a").alias("category"), F.col("id").alias("event_id"), one.alias("entities")))
    (blocks,) = [t for t in tables if "events" in t.columns]
    assert blocks.agg(F.max(F.size("events"))).first()[0] <= 256 and blocks.agg(F.sum(F.size("events"))).first()[0] == 1500
    assert pairs.count() == pairs.where("a < b").distinct().count() == 1500 * 1499 // 2


def test_story_state_reads_files_of_many_tasks(spark, monkeypatch):
    """Each batch of story_state is one micro-batch of all its files, which no single task has to write."""
    from tidewire.plans import registry
    from tidewire.streaming import streams

    files, once = [], streams.run_once
    monkeypatch.setattr(streams, "run_once", lambda stream, *more: files.append(len(spark.read.parquet(more[-1].rpartition("/")[0] + "/cards").inputFiles())) or once(stream, *more))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "64k")
    try:
        assert registry.QUERIES["story_state"](spark, "/root/testdata/sf0.001").count() > 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(files) == 4 and all(b - a > 1 for a, b in zip([0, *files], files))
