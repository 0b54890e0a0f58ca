"""Fixpoint operators against sequential models, and single cases with known results."""

import random
import sys

from pyspark import cloudpickle
from pyspark.sql import functions as F

from tidewire.functions import fixed
from tidewire.functions import text as T
from tidewire.operators import cluster, compose, dedup, discover, feedback, filters, model, overlap, rank
from tidewire.operators.components import connected_components
from tidewire.sources import feeds, providers, sinks

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file


def union_find(edges):
    up = {}

    def find(a):
        up.setdefault(a, a)
        while up[a] != a:
            a = up[a]
        return a

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {a: find(a) for a in list(up)}


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(1000 + k, 1001 + k) for k in range(60)]
    edges = [(a, b) for a, b in edges if a != b]
    got = {r[0]: r[1] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    assert got == union_find(edges)
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_greedy_keep_of_long_chains(spark):
    """Each id shares a key with the next one: every second one stays, by rounds, by parts, or by both."""
    chain = [(k, f"c{k + e}") for k in range(300) for e in (0, 1)]
    loose = [(1000 + k, f"l{k // 3}") for k in range(30)]
    want = [*range(0, 300, 2), *range(1000, 1030, 3)]
    rows = spark.createDataFrame(chain + loose, "id long, key string")
    assert sorted(r[0] for r in dedup.greedy_keep(rows, patience=2).collect()) == want
    places = rows.where("id < 40").selectExpr("struct('x' AS s, id AS r) AS id", "key")
    assert sorted(r[0]["r"] for r in dedup.greedy_keep(places, patience=1).collect()) == list(range(0, 40, 2))
    few = spark.createDataFrame(chain[:40] + loose, "id long, key string")  # parts that are too large go on in rounds
    assert sorted(r[0] for r in dedup.greedy_keep(few, patience=1, most=5).collect()) == [*range(0, 20, 2), *range(1000, 1030, 3)]
    assert dedup.greedy_keep(rows.limit(0)).count() == 0


def test_greedy_keep_is_the_sequential_pass(spark):
    rng = random.Random(2)
    rows = [(k, f"u{rng.randrange(60)}") for k in range(150)] + [(k, f"t{rng.randrange(60)}") for k in range(150)]
    keys, kept, seen = {}, [], set()
    for k, key in rows:
        keys.setdefault(k, []).append(key)
    for k in sorted(keys):
        if not seen.intersection(keys[k]):
            kept.append(k)
            seen.update(keys[k])
    got = dedup.greedy_keep(spark.createDataFrame(rows, "id long, key string"))
    assert sorted(r[0] for r in got.collect()) == kept


def test_diverse_top(spark):
    rng = random.Random(3)
    words = ["alpha", "beta", "gamma", "delta", "omega", "sigma"]
    rows = [("s", k + 1, " ".join(rng.sample(words, 3))) for k in range(20)]
    chosen, skipped = [], []
    for _, r, t in rows:
        if len(chosen) == 6:
            break
        sets = [set(x.split()) for _, x in chosen]
        if any(len(s & set(t.split())) / len(s | set(t.split())) >= 0.40 for s in sets):
            skipped.append(r)
        else:
            chosen.append((r, t))
    expect = ([r for r, _ in chosen] + skipped)[:6]
    got = rank.diverse_top(spark.createDataFrame(rows, "section string, rank int, text string"), 6)
    assert [r["rank"] for r in got.orderBy("place").collect()] == expect


def test_batch_dedup_chain(spark):
    rows = [(1, "c", "A b", "u1"), (2, "c", "a B!", "u2"), (3, "c", "x", "u2"), (4, "d", "a b", "u1"), (5, "c", "", "u5"), (6, "c", "", "u6"), (7, "c", "y", "u5")]
    got = dedup.batch_dedup(spark.createDataFrame(rows, "seq long, category string, title string, url string"))
    assert sorted(r["seq"] for r in got.collect()) == [1, 3, 4, 5, 6]


def test_simhash_and_scores(spark):
    one = spark.createDataFrame([("", "a b c", "a b c d")], "e string, x string, y string")
    r = one.select(T.simhash(F.col("e")).alias("e"), T.simhash(F.col("x")) == T.simhash(F.col("x"))).first()
    assert r[0] == 0 and r[1]
    rows = [("bbc", "up")] * 3 + [("bbc", "down")] + [("tab", "mute")] * 2 + [("tab", "down")] + [("x", "odd")]
    fb = spark.createDataFrame(rows, "source string, rating string").withColumn("created_at", F.lit("2024-01-30").cast("timestamp_ntz"))
    got = {r["source"]: r["score"] for r in feedback.source_stats(fb, "2024-01-31").collect()}
    assert got == {"bbc": 0.5, "tab": -1.0, "x": 0.0}
    ratings = {r["source"]: r["score"] for r in feedback.source_ratings(fb, "2024-01-31").collect()}
    assert ratings == {"bbc": 0.5, "tab": -5 / 3}


def test_blacklist(spark):
    hit = lambda text, topic: spark.createDataFrame([(text,)], "t string").select(filters.blacklisted(F.col("t"), [topic])).first()[0]
    assert not hit("the trumpet plays", "trump") and hit("trumpism rises", "trump*") and not hit("a b", "a")
    assert hit("ai and agents", "ai agents") and not hit("ai only", "ai agents") and hit("NFT sale", "nft") and hit("речь Путин сказал", "Путин")


def test_time_close_and_role(spark):
    ts = spark.createDataFrame([("2024-01-01 00:00:00", "2024-01-01 10:00:00"), ("2024-01-01 00:00:00", "2024-01-03 00:00:00"), (None, "2024-01-03 00:00:00")], "a string, b string")
    rows = ts.select(T.time_close(F.col("a").cast("timestamp"), F.col("b").cast("timestamp"))).collect()
    assert [r[0] for r in rows] == [True, False, True]
    r = spark.createDataFrame([("signal",), ("analysis",)], "role string").agg(cluster.role_of(F.col("role"))).first()[0]
    assert r == "partially_verified"


def test_entities(spark):
    e = spark.createDataFrame([("Tesla and Google DeepMind launch GPT-5 today",)], "t string").select(T.entities(F.col("t")).alias("e")).first()["e"]
    assert "Tesla" in e["organizations"] and "Google DeepMind" in e["organizations"] and e["products"] == ["GPT-5"] and e["people"] == []
    both = spark.createDataFrame([("Tesla ships Model S", "Tesla ships Model S")], "a string, b string")
    assert both.select(T.entity_overlap(T.entities(F.col("a")), T.entities(F.col("b")))).first()[0] > 0.3


def test_split_and_hard_split(spark):
    long = "\n\n\n".join("x " * 900 + f"\n\n· · ·\n\n{k} " + "y " * 1500 for k in range(3))
    parts = compose.split_messages(spark.createDataFrame([(1, long)], "id long, full_text string")).collect()
    assert all(len(p["part"]) <= 3800 for p in parts) and len(parts) >= 6
    bare = lambda s: "".join(c for c in s if not c.isspace() and c != "·")
    assert bare("".join(p["part"] for p in parts)) == bare(long)
    assert all(len(p) <= 40 for p in compose.hard_split("word " * 100, 40))
    assert compose.hard_split("short") == ["short"]


def test_model_filter_and_build_time(spark):
    class Third:
        def answer(self, prompt):
            return '{"keep": [2]}'

    rows = spark.createDataFrame([(k, "c", f"t{k}") for k in range(25)], "seq long, category string, title string")
    kept = model.filter_batches(rows, "category", "seq", "title", Third)
    assert sorted(r["seq"] for r in kept.collect()) == [2, 12, 22]
    assert model.filter_batches(rows, "category", "seq", "title").count() == 25
    at = spark.createDataFrame([("09:00", 15), ("00:05", 30), ("25:00", 1)], "t string, m int").select(T.hhmm_minus(F.col("t"), F.col("m"))).collect()
    assert [r[0] for r in at] == ["08:45", "23:35", None]
    runs = lambda n, sec: spark.createDataFrame([(k, f"2024-01-{k + 1:02d}", "ok", sec) for k in range(n)], "id long, started_at string, status string, duration_sec long")
    assert [feedback.build_minutes(runs(n, s), "2024-01-31").first()["buffer_minutes"] for n, s in ((7, 600), (3, 600), (7, 100_000))] == [13, 15, 120]


class Said:
    """A backend with one fixed answer."""

    def __init__(self, text):
        self.text = text

    def answer(self, prompt):
        return self.text


def _events(spark):
    rows = [(1, "world", "Big title", ["Big title", "big TITLE", "Other"], ["snip one.", "", "snip two"], "verified"), (2, "ai_agents", "Agent", ["Agent"], ["text"], "signal_only")]
    return spark.createDataFrame(rows, "event_id long, section string, canonical_title string, titles array<string>, snippets array<string>, role string")


def test_cards_by_model_and_by_rule(spark):
    tags, agent = fixed.CARD_TAGS, fixed.AGENT_TAGS
    both = f"<think>[{tags[0]}] no</think>Hm: [{tags[0]}] (до 80 символов) Имя\n[{tags[2]}] Потому\n[{agent[1]}] Что\n[{agent[3]}] MCP\n[{agent[4]}] Verified"
    got = {r["event_id"]: r for r in model.write_cards(_events(spark), lambda: Said(both)).collect()}
    assert got[1]["title"] == "Имя" and got[1]["summary"] == "snip one. snip two" and got[1]["llm_used"] and got[1]["confidence"] == "verified"
    assert got[2]["title"] == "Имя" and got[2]["summary"] == "Что" and got[2]["area"] == "MCP" and got[2]["confidence"] == "verified"
    rule = {r["event_id"]: r for r in model.write_cards(_events(spark)).collect()}
    assert not rule[1]["llm_used"] and rule[1]["title"] == "Big title" and rule[2]["confidence"] == "signal_only" and rule[2]["why"] == ""
    told = _events(spark).select(model.prompt_of("titles", "snippets", "{canonical_title}|{titles}|{snippets}|{x}{memory_context}", canonical_title=F.col("canonical_title")).alias("p")).collect()
    assert told[0][0] == "Big title|Big title\nOther|snip one.\nsnip two|{x}"


def test_small_model_steps(spark):
    e = _events(spark)
    assert [r[0] for r in model.refined_titles(e, make=lambda: Said("Новый заголовок")).select("canonical_title").collect()] == ["Новый заголовок"] * 2
    assert [r[0] for r in model.refined_titles(e, make=lambda: Said("two\nlines")).select("canonical_title").collect()] == ["Big title", "Agent"]
    assert model.translated(e, "canonical_title", lambda: Said("Перевод")).first()["canonical_title"] == "Перевод"
    assert model.translated(e, "canonical_title", lambda: Said("no")).first()["canonical_title"] == "Big title"
    named = model.entities_of(e, "canonical_title", lambda: Said('```{"organizations": ["Acme", "acme "], "people": ["Bo"]}```')).first()["entities"]
    assert named["organizations"] == ["Acme"] and named["people"] == ["Bo"] and named["topics"] == []
    assert model.entities_of(e, "canonical_title", lambda: Said("{broken")).first()["entities"]["organizations"] == ["Big"]
    topics = spark.createDataFrame([("go",)], "topic string")
    assert [r["query"] for r in model.search_queries(topics, lambda: Said("- go news\n\"go feed\"\nx\nmore go\nfifth")).orderBy("place").collect()] == ["go news", "go feed", "more go"]
    assert [r["query"] for r in model.search_queries(topics).orderBy("place").collect()] == ["best RSS feed for go", "go blog RSS", "go news feed"]
    bad, rule = spark.createDataFrame([("u", "s")], "article_url string, source string"), spark.createDataFrame([("rule",)], "word string")
    assert sorted(r[0] for r in model.keywords_to_avoid(bad, rule, lambda: Said("Spam, ok, scandal")).collect()) == ["scandal", "spam"]
    assert [r[0] for r in model.keywords_to_avoid(bad, rule).collect()] == ["rule"]
    rows = spark.createDataFrame([(k, "c", f"t{k}") for k in range(12)], "seq long, category string, title string")
    picked = model.pick_batches(rows, "category", "seq", "title", lambda: Said('{"keep": [3, 1, 1]}')).orderBy("place").collect()
    assert [r["seq"] for r in picked] == [3, 1, 1, 11, 11]


def test_issue(spark):
    long = "Очень подробный текст о событии. Второе предложение здесь."
    cards = [(k, s, k, f"Заголовок {k}", long, "card%d" % k, 1.0 - k / 100, 0.5, 0.5, k % 2 == 0) for k, s in enumerate(["world", "world", "ai", "tech", "ai_agents", "games", "custom", "ai", "ai"])]
    cards.append((9, "world", 9, "English title", "Only English text stands in this card, so it goes.", "x", 0.9, 0.9, 0.9, False))
    df = spark.createDataFrame(cards, "event_id long, section string, rank int, title string, summary string, card string, final_score double, importance double, relevance double, llm_used boolean")
    r = compose.issue(df, F.lit("2024-02-03").cast("date")).first()
    parts = r["full_text"].split("\n\n\n")
    assert parts[0].startswith("📰 <b>УТРЕННИЙ ДАЙДЖЕСТ</b>\n3 февраля 2024\n\n⚡ <b>Главное</b>\n\n• <b>Заголовок 0</b> — Очень подробный текст о событии.") and parts[0].endswith("\n\n#главное #world")
    assert parts[1] == "🌍 <b>Мировые новости</b>\n#world\n\ncard0\n\n· · ·\n\ncard1"
    assert parts[2].split("\n\n", 1)[1].split(compose.ITEM_BREAK) == ["card2", "card3", "card4", "card7", "card8"] and parts[3].endswith("card5") and len(parts) == 4
    assert (r["item_count"], r["llm_items"], r["fallback_items"], r["sections"]) == (9, 5, 4, "world,ai_agents,tech,ai,games") and r["parts"] == "headline,world,ai,games"
    radar = compose.issue(df, F.lit("2024-02-03").cast("date"), radar=df.where("rank = 6")).first()["full_text"]
    assert radar.split("\n\n\n")[-1] == "📡 <b>На радаре</b>\n\n• <b>Заголовок 6</b> — Очень подробный текст о событии."
    none = compose.issue(df.limit(0), F.lit("2024-02-03").cast("date")).first()
    assert none["full_text"].count("\n\n\n") == 0 and none["item_count"] == 0
    one = spark.createDataFrame([("T & x", "First. Second.", "why", "take", "area")], "t string, s string, w string, e string, a string")
    text = lambda c: one.select(c).first()[0]
    shown = F.lit("🔗 l")
    card = lambda style: text(compose.card_text(F.col("t"), F.col("s"), F.col("w"), shown, style, F.col("e")))
    assert card("brief") == "<b>T &amp; x</b>\nFirst.\n🔗 l"
    assert card("medium") == "<b>T &amp; x</b>\nFirst. Second.\n<blockquote><i>Почему важно:</i> why</blockquote>\n🔗 l"
    assert card("detailed").split("\n")[3] == "<i>Редакция:</i> take"
    assert text(compose.agent_card(F.col("t"), F.col("s"), F.lit(""), F.col("a"), F.lit(""))) == "<b>T &amp; x</b>\nFirst. Second.\n<i>Зона влияния:</i> area"


class Numbers(providers.ArticleFormat):
    @classmethod
    def name(cls):
        return "numbers"

    def articles(self, config):
        k = 0
        while config.get("n", k) > k or config.get("endless"):
            yield ("c", f"t{k}", f"u{k}", "", "numbers", None, "source", None)
            k += 1

    def faults(self, config):
        if not isinstance(config.get("n"), int):
            yield "n is required"


def test_article_formats(spark):
    import pytest

    said = providers.use_modules(spark, [__name__, "no_such_module"])
    assert said[__name__] == "" and "ModuleNotFoundError" in said["no_such_module"]
    assert providers.formats(spark) == {"numbers": Numbers}
    got = spark.read.format("numbers").option("configs", '[{"n": 3}, {"n": 9}, {"n": 1, "endless": true}]').option("limit", "5").load()
    assert got.count() == 13 and got.where("title = 't4'").count() == 2 and got.rdd.getNumPartitions() == 3
    with pytest.raises(Exception, match="n is required"):
        spark.read.format("numbers").option("configs", '[{"n": "x"}]').load().count()


def test_similar_pairs(spark):
    rng = random.Random(8)
    sets = [(k, "p" if k % 3 else "q", sorted(rng.sample(range(18), rng.randrange(1, 9)))) for k in range(90)]
    df = spark.createDataFrame(sets, "id long, part string, tokens array<long>")
    jac = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    for least in (0.1, 0.5, 0.8):
        got = {(r["a"], r["b"], r["shared"]) for r in overlap.similar_within(df, least, ("part",)).collect()}
        assert got == {(a, b, len(set(x) & set(y))) for a, p, x in sets for b, q, y in sets if a < b and p == q and jac(x, y) >= least}
        left, right = df.where("id < 40").drop("part"), df.where("id >= 40").drop("part")
        got = {(r["a"], r["b"]) for r in overlap.similar_between(left, right, least).collect()}
        assert got == {(a, b) for a, _, x in sets for b, _, y in sets if a < 40 <= b and jac(x, y) >= least}


def test_simhash_classes_and_times(spark):
    rng = random.Random(6)
    texts = [" ".join(rng.choices(["a", "b", "c", "d"], k=40)) for _ in range(60)] + ["x y z"] * 4
    rows = [(k, "c", "t", s) for k, s in enumerate(texts)]
    df = spark.createDataFrame(rows, "seq long, category string, title string, snippet string")
    h = {r["seq"]: r["h"] for r in df.select("seq", T.simhash(F.concat_ws(" ", "title", F.substring("snippet", 1, 200))).alias("h")).collect()}
    first = {}
    for k in sorted(h):
        first.setdefault(h[k], k)
    want = {(first[h[k]], k, 0) for k in h if first[h[k]] != k}
    bits = lambda a, b: bin((h[a] ^ h[b]) & (1 << 64) - 1).count("1")
    want |= {(a, b, bits(a, b)) for a in first.values() for b in first.values() if a < b and bits(a, b) < 4}
    assert {(r["a"], r["b"], r["bits"]) for r in dedup.simhash_pairs(df).collect()} == want and len(want) > 3
    at = [None, "2024-01-01 00:00:00", "2024-01-02 00:00:00", "2024-01-02 00:00:01", "2024-01-09 12:00:00"]
    rows = [(k, "c", "alpha beta gamma", t) for k, t in enumerate(at)]
    close = cluster.token_edges(spark.createDataFrame(rows, "seq long, category string, title string, published_at string").withColumn("published_at", F.col("published_at").cast("timestamp")))
    assert {(r["a"], r["b"]) for r in close.collect()} == {(0, 1), (0, 2), (0, 3), (0, 4), (1, 2), (2, 3)}


def test_state_catalogue_and_sinks(spark, tmp_path):
    state = filters.pause_row(spark, "2024-01-01 00:00:00", 2)
    assert filters.paused(state, "2024-01-02 00:00:00").first()[0] and not filters.paused(state, "2024-01-04 00:00:00").first()[0]
    assert not filters.paused(state.limit(0), "2024-01-02 00:00:00").first()[0]
    path = str(tmp_path / "catalogue.json")
    with open(path, "w") as f:
        f.write('{"topics": {"t": {"sources": [{"type": "rss", "url": "http://x", "tags": ["a"], "recommended": true}, {"type": "reddit", "name": "n"}]}}}')
    got = discover.load_catalog(spark, path).collect()
    assert [(r["topic"], r["type"], r["name"], r["recommended"]) for r in got] == [("t", "rss", "http://x", True), ("t", "reddit", "n", False)]
    out = str(tmp_path / "feedback")
    for _ in range(2):  # a rerun replaces its rows
        sinks.record_feedback(spark, out, "r1", [("d", 3, "u", "mute")], "2024-01-01 00:00:00")
    sinks.record_feedback(spark, out, "r2", [("d", 4, "u", "up")], "2024-01-01 00:00:00")
    assert sorted(r["article_url"] for r in spark.read.parquet(out).collect()) == ["idx:3", "idx:4"]
    assert sinks.save_digest(spark.createDataFrame([("x",)], "full_text string"), str(tmp_path / "d"), "run7", "2024-01-01") == "run7"
    sinks.export_json(spark.createDataFrame([("k", "s", "")], "name string, token string, secret string"), str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().asDict() == {"name": "k", "token": "***", "secret": ""}
    assert sinks.redact_tree({"a": [{"Token": "x", "token": ""}], "password": 3}) == {"a": [{"Token": "***", "token": ""}], "password": 3}
    topics = spark.createDataFrame([("t", ["a"], {"s1": "x", "s2": "y"})], "topic string, blacklist array<string>, sources map<string,string>")
    learned = feedback.apply_learning(topics, spark.createDataFrame([("s2", "remove"), ("s1", "boost")], "source string, action string"), spark.createDataFrame([("b",), ("a",)], "word string")).first()
    assert learned["blacklist"] == ["a", "b"] and learned["sources"] == {"s1": "x"}
    old = spark.createDataFrame([(1, "a", 1)], "id long, v string, ver long")
    old.write.parquet(str(tmp_path / "s0"))
    new = sinks.upsert(spark, str(tmp_path / "s0"), spark.createDataFrame([(1, "b", 2), (2, "c", 1)], "id long, v string, ver long"), "id", "ver", str(tmp_path / "s1"))
    assert sorted((r["id"], r["v"]) for r in new.collect()) == [(1, "b"), (2, "c")]


def test_feeds_of_video_channels_and_validation(spark):
    body = '<feed xmlns="http://www.w3.org/2005/Atom" xmlns:media="http://m/"><entry><title>V</title><link href="https://v/1"/><published>2024-01-02T10:00:00+00:00</published><media:group><media:description>D &lt;b&gt;x&lt;/b&gt;</media:description></media:group></entry></feed>'
    got = feeds.parse_atom(spark.createDataFrame([("c", "CHANNEL123", body), ("c", "x", "<broken")], "category string, channel string, body string")).collect()
    assert [(r["title"], r["url"], r["snippet"], r["source"]) for r in got] == [("V", "https://v/1", "D x", "youtube:CHANNEL1")]
    dated = feeds.parse_feed(spark.createDataFrame([("c", "https://www.A.com/f", "<rss><channel><item><title>T</title><link>l</link><pubDate>Tue, 02 Jan 2024 10:00:00 GMT</pubDate></item></channel></rss>")], "category string, url string, body string")).first()
    assert dated["source"] == "rss:a.com" and str(dated["published_at"]) == "2024-01-02 10:00:00" and dated["snippet"] == "" and dated["image_url"] is None
    cases = [  # type, body, newest, then items and ok by the rule of the type
        ("rss", "<item ><item>", "2024-01-01 00:00:00", 2, True), ("rss", "", None, 0, False), ("rss", "<entry>", None, 1, True), ("rss", "<entry>", "2023-01-01 00:00:00", 1, False),
        ("rss", "<entry>", "2023-12-03 00:00:01", 1, True), ("rss", "<entry>", "2023-12-03 00:00:00", 1, False),  # under 60 days to the second
        ("telegram", '<div class="tgme_widget_message"><div class="tgme_widget_message_text">', None, 2, True), ("telegram", "<html>", None, 0, False), ("telegram", None, None, 0, False),
        ("reddit", '{"kind": "t5", "data": {}}', None, 1, True), ("reddit", '{"data": null}', None, 1, True), ("reddit", '{"error": 404}', None, 0, False), ("reddit", '["data"]', None, 0, False), ("reddit", "<item>", None, 0, False),
        ("youtube", "<feed></feed>", None, 1, True), ("youtube", None, None, 0, False), ("hackernews", None, None, 1, True), ("fax", "x", None, 0, False),
    ]
    pages = spark.createDataFrame([c[:3] for c in cases], "type string, body string, newest string").withColumn("newest", F.col("newest").cast("timestamp")).coalesce(1)
    assert [(r["items"], r["ok"]) for r in feeds.validate_pages(pages, "2024-02-01").collect()] == [c[3:] for c in cases]


def test_stream_first_seen_forgets_and_keeps(spark, tmp_path):
    from tidewire.streaming import streams

    days = [("a", 1), ("a", 3), ("b", 2), ("a", 2)]
    spark.createDataFrame([(k, f"2024-01-{d:02d} 00:00:00") for k, d in days], "url_hash string, published_at string").withColumn("published_at", F.col("published_at").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in" / "t.parquet"))
    stream = spark.readStream.schema("url_hash string, published_at timestamp").parquet(str(tmp_path / "in" / "t.parquet"))
    out = streams.run_once(streams.first_seen(stream), "seen", "append", str(tmp_path / "cp"))
    assert sorted(r["url_hash"] for r in out.collect()) == ["a", "b"]
    handed = []
    streams.deliver(spark.readStream.schema("url_hash string, published_at timestamp").parquet(str(tmp_path / "in" / "t.parquet")), lambda df, n: handed.append(df.count()), str(tmp_path / "cp2")).awaitTermination()
    assert handed == [4]


def test_chain_takes_the_first_answer():
    class Down:
        def answer(self, prompt):
            raise TimeoutError

    assert model.Chain(Down(), Said(""), Said("yes"), Said("no")).answer("x") == "yes"
    assert model.Chain(Down()).answer("x") == ""
