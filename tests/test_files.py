"""Raw files of the payload shapes, several to a folder and broken ones among them; queries with parameters; table functions."""

import json

from pyspark.sql import functions as F

from tidewire.operators import compose
from tidewire.sources import files

RSS = """<?xml version="1.0" encoding="UTF-8"?><rss version="2.0"><channel><title>Own feed</title><link>https://a.example/</link>
<item><title>One &amp; all</title><link>https://a.example/1</link><description>&lt;p&gt;First &lt;b&gt;text&lt;/b&gt;.&lt;/p&gt;</description><pubDate>Tue, 02 Jan 2024 12:00:00 GMT</pubDate></item>
<item><title>Two</title><link>https://a.example/2</link><description>Plain.</description><pubDate>Wed, 03 Jan 2024 09:30:00 GMT</pubDate></item>
<item><title> </title><link>https://a.example/3</link></item></channel></rss>"""
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>Entry</title><link href="https://b.example/1"/><summary>About it</summary><updated>2024-01-04T08:00:00Z</updated></entry></feed>"""
LISTING = {"kind": "Listing", "data": {"children": [{"kind": "t3", "data": {"title": "High", "url": "https://c.example/h", "permalink": "/r/x/h/", "selftext": "Body", "score": 250, "created_utc": 1712000000}}, {"kind": "t3", "data": {"title": "Low", "url": "https://c.example/l", "permalink": "/r/x/l/", "selftext": "", "score": 5, "created_utc": 1712000000}}, {"kind": "t3", "data": {"title": "Self", "url": "/r/x/s/", "permalink": "/r/x/s/", "score": 90, "created_utc": 1712000001}}]}}
PAGE = "".join(f'<div class="tgme_widget_message"><a href="https://t.me/own/{n}"><time datetime="2024-01-0{n}T10:00:00+00:00">x</time></a><div class="tgme_widget_message_text js" dir="auto">{text}</div></div>' for n, text in ((1, "A first post that is long enough to stay."), (2, "short"), (3, "Третий пост, и он тоже достаточно длинный.")))


def _folder(tmp_path, **some):
    for name, text in some.items():
        at = tmp_path / name.replace("__", "/")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(text)
    return str(tmp_path)


def test_feed_files(spark, tmp_path):
    folder = _folder(tmp_path, **{"category=a__one.xml": RSS, "category=a__again.xml": RSS.replace("a.example", "z.example"), "category=b__atom.xml": ATOM, "category=b__broken.xml": RSS[:300], "category=b__empty.xml": "", "category=b__page.html": "<html><body>no feed</body></html>"})
    got = {(r["category"], r["title"], r["url"], r["snippet"], str(r["published_at"])) for r in files.feed_files(spark, folder, category="category").collect()}
    own = lambda host: {("a", "One & all", f"https://{host}/1", "First text.", "2024-01-02 12:00:00"), ("a", "Two", f"https://{host}/2", "Plain.", "2024-01-03 09:30:00")}
    assert got == own("a.example") | own("z.example") | {("b", "Entry", "https://b.example/1", "About it", "2024-01-04 08:00:00")}
    assert files.feed_files(spark, folder, limit=1).count() == 3


def test_feed_items(spark, tmp_path):
    folder = _folder(tmp_path, **{"one.xml": RSS, "two.xml": RSS.replace("<item>", "<item><title><b>odd</item><item>", 1)})
    got = files.feed_items(spark, folder)
    found = {(r["file"].rpartition("/")[2], r["url"], r["snippet"]) for r in got.collect()}
    assert {x for x in found if x[0] == "one.xml"} == {("one.xml", "https://a.example/1", "First text."), ("one.xml", "https://a.example/2", "Plain.")}
    assert got.where("trim(title) = '' OR title LIKE '%odd%'").count() == 0


def test_listing_files(spark, tmp_path):
    folder = _folder(tmp_path, **{"sub=x__hot.json": json.dumps(LISTING, indent=1), "sub=y__hot.json": json.dumps(LISTING), "sub=y__cut.json": json.dumps(LISTING)[:200], "sub=z__other.json": '{"error": 404}', "sub=z__list.json": "[]"})
    got = sorted(tuple(r)[2:4] + (r["source"],) for r in files.listing_files(spark, folder).collect())
    assert got == sorted((t, u, f"reddit:{s}") for s in "xy" for t, u in (("High", "https://c.example/h"), ("Self", "https://www.reddit.com/r/x/s/")))
    assert {(r["file"].rpartition("/")[2], r["reason"]) for r in files.broken(spark, folder).collect()} == {("cut.json", "no JSON"), ("other.json", "nothing known in it")}


def test_page_files(spark, tmp_path):
    folder = _folder(tmp_path, **{"user=own__page.html": PAGE, "user=none__page.html": "<html></html>"})
    got = files.page_files(spark, folder).orderBy("pos").collect()
    assert [(r["url"], r["source"], str(r["published_at"])) for r in got] == [("https://t.me/own/1", "tg:own", "2024-01-01 10:00:00"), ("https://t.me/own/3", "tg:own", "2024-01-03 10:00:00")]


def test_values_stay_values(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.createDataFrame([(k, f"n{k % 3}") for k in range(30)], "id long, name string").write.parquet(path)
    t = {"t": spark.read.parquet(path)}
    bad = "n1' OR '1' = '1"
    ask = lambda name: files.scan(spark, "SELECT id FROM {t} WHERE name = :name AND id >= :least", t, name=name, least=10)
    assert ask(bad).count() == 0 and sorted(r["id"] for r in ask("n1").collect()) == list(range(10, 30, 3))
    plan = ask(bad)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(name), IsNotNull(id), EqualTo(name,n1' OR '1' = '1)" in plan and "GreaterThanOrEqual(id,10)" in plan and "struct<id:bigint,name:string>" in plan


def test_split_table_functions(spark):
    compose.register_splits(spark)
    long = ("word " * 90 + "\n") * 20
    texts = [(1, f"A\n\n\n\n{long}\n\n\nB"), (2, ""), (3, None), (4, "x" * 9000), (5, "\n\n\n"), (6, f"a{compose.ITEM_BREAK}".join(["item " * 300] * 6))]
    rows = spark.createDataFrame(texts, "id long, text string")
    for most in (400, 3800):
        got = files.scan(spark, "SELECT id, section, chunk, part FROM {t}, LATERAL split_message(text, :most)", {"t": rows}, most=most)
        want = compose.split_messages(rows.withColumnRenamed("text", "full_text"), most=most).select("id", "part_no._s", "part_no._p", "part")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
        assert got.where(F.length("part") > most).count() == 0
        hard = files.scan(spark, "SELECT id, chunk, part FROM {t}, LATERAL hard_split(text, :most)", {"t": rows}, most=most).collect()
        assert sorted(map(tuple, hard)) == sorted((k, n, p) for k, t in texts for n, p in enumerate(compose.hard_split(t or "", most)))
