"""Scans: raw payloads (text columns) to articles. Broken payloads give no rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import fixed
from tidewire.functions import text as T


def feed_date(c: Column) -> Column:
    """RFC 822 or ISO time, null if it is neither."""
    bare = F.regexp_replace(F.trim(c), r"^[A-Za-z]{3},\s*", "")
    bare = F.regexp_replace(bare, r"\s(GMT|UT|UTC|Z)$", " +0000")
    return F.coalesce(F.try_to_timestamp(bare, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(c))


def feed_snippet(c: Column) -> Column:
    return F.substring(F.trim(T.strip_tags(c)), 1, 300)


_MEDIA = "ARRAY<STRUCT<_VALUE: STRING, _url: STRING, _href: STRING, _type: STRING, _medium: STRING, _rel: STRING>>"
_RSS = f"channel STRUCT<title: STRING, item: ARRAY<STRUCT<title: STRING, link: STRING, description: STRING, encoded: STRING, pubDate: STRING, updated: STRING, date: STRING, thumbnail: {_MEDIA}, content: {_MEDIA}, enclosure: {_MEDIA}>>>"
_ATOM = f"entry ARRAY<STRUCT<title: STRING, link: {_MEDIA}, summary: STRING, published: STRING, updated: STRING, thumbnail: {_MEDIA}, content: {_MEDIA}>>"


def _image_in(markup: Column) -> Column:
    found = F.regexp_extract(F.coalesce(markup, F.lit("")), fixed.IMAGE_TAG, 1)
    return F.when(valid_image(found), found)


def _first_image(media: Column, wanted) -> Column:
    """The first valid url among media elements that are wanted."""
    url = lambda m: F.coalesce(m["_href"], m["_url"])
    return F.get(F.transform(F.filter(media, lambda m: wanted(m) & valid_image(url(m))), url), F.lit(0))


def entry_image(i: Column) -> Column:
    """Image of a feed entry: thumbnail, media of kind image, enclosure, then the first image in its texts."""
    typed = lambda m: F.contains(F.coalesce(m["_type"], F.lit("")), F.lit("image"))
    thumb = F.get(i["thumbnail"], F.lit(0))["_url"]
    return F.coalesce(
        F.when(valid_image(thumb), thumb),
        _first_image(i["content"], lambda m: (F.coalesce(m["_medium"], F.lit("")) == "image") | typed(m)),
        _first_image(i["enclosure"], typed),
        _image_in(i["summary"]),
        F.get(F.filter(F.transform(i["texts"], _image_in), lambda x: x.isNotNull()), F.lit(0)),
    )


def parse_feed(feeds: DataFrame, limit: int = 20, text: str = "body") -> DataFrame:
    """feeds (category, url, body and, if given, role) to articles: the first `limit` entries, then those with link and title.

    RSS items or Atom entries. The time is the published one, else the updated one; the snippet comes
    from the summary, else from the first content; a broken feed gives no rows.
    """
    body = F.col(text)
    rss = F.from_xml(body, _RSS, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})["channel"]["item"]
    atom = F.from_xml(body, _ATOM, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})["entry"]
    none = F.array().cast(_MEDIA)
    texts = lambda media: F.transform(F.coalesce(media, none), lambda m: m["_VALUE"])
    item = lambda title, link, summary, first, at, thumb, content, enclosure, more: F.struct(
        title.alias("title"), link.alias("link"), summary.alias("summary"), first.alias("first"), at.alias("at"),
        F.coalesce(thumb, none).alias("thumbnail"), F.coalesce(content, none).alias("content"), F.coalesce(enclosure, none).alias("enclosure"), more.alias("texts"),
    )
    items = F.transform(rss, lambda i: item(i["title"], i["link"], i["description"], i["encoded"], F.coalesce(i["pubDate"], i["updated"], i["date"]), i["thumbnail"], i["content"], i["enclosure"], F.array(i["encoded"])))
    href = lambda links: F.get(F.filter(links, lambda m: F.coalesce(m["_rel"], F.lit("alternate")) == "alternate"), F.lit(0))["_href"]
    enclosed = lambda links: F.filter(links, lambda m: F.coalesce(m["_rel"], F.lit("")) == "enclosure")
    entries = F.transform(atom, lambda i: item(i["title"], href(i["link"]), i["summary"], F.get(texts(i["content"]), F.lit(0)), F.coalesce(i["published"], i["updated"]), i["thumbnail"], i["content"], enclosed(i["link"]), texts(i["content"])))
    role = F.coalesce("role", F.lit("source")) if "role" in feeds.columns else F.lit("source")
    rows = feeds.select("category", "url", role.alias("role"), F.posexplode(F.slice(F.coalesce(items, entries), 1, limit)).alias("pos", "i"))
    host = F.replace(F.lower(F.try_parse_url("url", F.lit("AUTHORITY"))), F.lit("www."), F.lit(""))
    rows = rows.where("trim(coalesce(i.title, '')) <> '' AND trim(coalesce(i.link, '')) <> ''")
    return rows.select(
        "category", "pos", F.trim("i.title").alias("title"), F.trim("i.link").alias("url"), feed_snippet(F.coalesce("i.summary", "i.first")).alias("snippet"),
        F.concat(F.lit("rss:"), host).alias("source"), feed_date(F.col("i.at")).alias("published_at"), "role", entry_image(F.col("i")).alias("image_url"),
    )


def parse_rss(feeds: DataFrame, limit: int = 20, text: str = "body") -> DataFrame:
    """parse_feed without images."""
    return parse_feed(feeds, limit, text).drop("image_url")


def parse_atom(feeds: DataFrame, limit: int = 20, text: str = "body") -> DataFrame:
    """Atom entries of video channels: (category, channel, body) to articles."""
    entry = "entry ARRAY<STRUCT<title STRING, link STRUCT<_href: STRING>, published STRING, group STRUCT<description: STRING>>>"
    e = F.from_xml(F.col(text), entry, {"mode": "PERMISSIVE", "ignoreNamespace": "true"})["entry"]
    rows = feeds.select("category", "channel", F.posexplode(F.slice(e, 1, limit)).alias("pos", "i"))
    return rows.where("coalesce(i.title, '') <> '' AND coalesce(i.link._href, '') <> ''").select(
        "category", "pos", F.trim("i.title").alias("title"), F.col("i.link._href").alias("url"), feed_snippet(F.col("i.group.description")).alias("snippet"),
        F.concat(F.lit("youtube:"), F.substring("channel", 1, 8)).alias("source"), feed_date(F.col("i.published")).alias("published_at"), F.lit("source").alias("role"),
    )


def parse_channel_page(pages: DataFrame, limit: int = 15, text: str = "body") -> DataFrame:
    """Public channel pages (category, user, url, body): texts, times and links by index; the last `limit`."""
    b = F.col(text)
    texts = F.regexp_extract_all(b, F.lit(r'(?s)tgme_widget_message_text[^>]*>(.*?)</div>'), 1)
    times = F.regexp_extract_all(b, F.lit(r'datetime="([^"]+)"'), 1)
    links = F.regexp_extract_all(b, F.lit(r'href="(https://t\.me/[^"/]+/\d+)"'), 1)
    rows = pages.select("category", "user", F.col("url").alias("page_url"), F.arrays_zip(texts.alias("t"), times.alias("d"), links.alias("l")).alias("z"), F.size(texts).alias("n"))
    rows = rows.select("category", "user", "page_url", F.posexplode(F.slice(F.slice("z", F.lit(1), F.greatest("n", F.lit(1))), F.greatest(F.col("n") - limit + 1, F.lit(1)), F.lit(limit))).alias("pos", "m"))
    clean = F.substring(F.trim(F.regexp_replace(T.strip_tags(F.col("m.t"), " "), r"(?U)\s+", " ")), 1, 500)
    rows = rows.withColumn("snippet", clean).where((F.length("snippet") >= 30) & F.col("snippet").rlike("[A-Za-zА-Яа-яЁё]{4,}"))
    return rows.select(
        "category", "pos", F.substring("snippet", 1, 120).alias("title"), F.coalesce("m.l", "page_url").alias("url"), "snippet",
        F.concat(F.lit("tg:"), "user").alias("source"), F.try_to_timestamp("m.d").alias("published_at"), F.lit("signal").alias("role"),
    )


LISTING = "data STRUCT<children ARRAY<STRUCT<data STRUCT<title STRING, url STRING, permalink STRING, selftext STRING, score BIGINT, created_utc DOUBLE>>>>"


def parse_listing(pages: DataFrame, limit: int = 15, least: int = 50, text: str = "body") -> DataFrame:
    """Forum listings (category, sub, body): posts with enough points, the first `limit` of them."""
    kids = F.from_json(F.col(text), LISTING)["data"]["children"]
    rows = pages.select("category", "sub", F.posexplode(kids).alias("pos", "c")).where((F.col("c.data.score") >= least) & (F.coalesce("c.data.title", F.lit("")) != ""))
    w = Window.partitionBy("category", "sub").orderBy("pos")
    rows = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    url = F.when(F.col("c.data.url").startswith("http"), F.col("c.data.url")).otherwise(F.concat(F.lit("https://www.reddit.com"), "c.data.permalink"))
    return rows.select(
        "category", "pos", "c.data.title", url.alias("url"), F.substring(F.coalesce("c.data.selftext", F.lit("")), 1, 300).alias("snippet"),
        F.concat(F.lit("reddit:"), "sub").alias("source"), F.timestamp_seconds("c.data.created_utc").alias("published_at"), F.lit("source").alias("role"),
    )


def join_items(ids: DataFrame, items: DataFrame, limit: int = 15, least: int = 50, first: int = 30) -> DataFrame:
    """Top ids (category, ids array) joined with their items, in list order; those with points, url and title."""
    top = ids.select("category", F.posexplode(F.slice("ids", 1, first)).alias("pos", "id"))
    rows = top.join(items, "id").where((F.col("score") >= least) & (F.coalesce("url", F.lit("")) != "") & (F.coalesce("title", F.lit("")) != ""))
    w = Window.partitionBy("category").orderBy("pos")
    rows = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit)
    note = F.format_string("HN score=%d comments=%d", "score", F.coalesce("descendants", F.lit(0).cast("long")))
    return rows.select("category", "pos", "title", "url", note.alias("snippet"), F.lit("hackernews").alias("source"), F.timestamp_seconds("time").alias("published_at"), F.lit("source").alias("role"))


def parse_search(pages: DataFrame, limit: int = 10, text: str = "body") -> DataFrame:
    """Search answers (category, engine, body): two JSON shapes and one page of result anchors."""
    b = F.col(text)
    hit = "url STRING, title STRING, content STRING"
    plain = F.from_json(b, f"results ARRAY<STRUCT<{hit}>>")["results"]
    web = F.transform(F.from_json(b, "web STRUCT<results ARRAY<STRUCT<url STRING, title STRING, description STRING>>>")["web"]["results"], lambda r: F.struct(r["url"].alias("url"), r["title"].alias("title"), r["description"].alias("content")))
    anchors = F.regexp_extract_all(b, F.lit(r'(?s)class="result__a"[^>]*href="([^"]+)"'), 1)
    titles = F.regexp_extract_all(b, F.lit(r'(?s)class="result__a"[^>]*>(.*?)</a>'), 1)
    notes = F.regexp_extract_all(b, F.lit(r'(?s)class="result__snippet"[^>]*>(.*?)</a>'), 1)
    target = lambda u: F.coalesce(F.nullif(F.try_url_decode(F.regexp_extract(u, r"uddg=([^&]+)", 1)), F.lit("")), u)
    html = F.transform(anchors, lambda u, i: F.struct(target(u).alias("url"), F.get(titles, i).alias("title"), F.get(notes, i).alias("content")))
    hits = F.when(F.col("engine") == "json", plain).when(F.col("engine") == "web", web).otherwise(html)
    tidy = lambda c: T.strip(T.unescape_html(T.strip_tags(c)))
    bare = lambda c: T.strip(F.coalesce(c, F.lit("")))
    # the plain engine gives text, the others markup
    clean = F.transform(hits, lambda r: F.struct(bare(r["url"]).alias("url"), F.when(F.col("engine") == "json", bare(r["title"])).otherwise(tidy(r["title"])).alias("title"), F.when(F.col("engine") == "json", F.coalesce(r["content"], F.lit(""))).otherwise(tidy(r["content"])).alias("content")))
    good = lambda rs: F.filter(rs, lambda r: (r["url"] != "") & (r["title"] != ""))
    # JSON engines are cut before bad hits go, the page of anchors after
    taken = F.when(F.col("engine").isin("json", "web"), good(F.slice(clean, 1, limit))).otherwise(F.slice(good(clean), 1, limit))
    rows = pages.select("category", F.posexplode(taken).alias("pos", "r"))
    return rows.select("category", "pos", "r.title", "r.url", F.substring("r.content", 1, 300).alias("snippet"), F.lit("search").alias("source"), F.lit("signal").alias("role"))


def valid_image(c: Column) -> Column:
    u = F.lower(F.split(F.coalesce(c, F.lit("")), r"\?")[0])
    ends, path = F.lit(False), F.lit(False)
    for e in fixed.IMAGE_ENDINGS:
        ends = ends | u.endswith(e)
    for p in fixed.IMAGE_PATHS:
        path = path | F.contains(u, F.lit(p))
    return u.rlike("^https?://") & (ends | path)


def page_image(html: Column) -> Column:
    """The page's announced image, else its first image, if valid."""
    og = F.regexp_extract(html, fixed.IMAGE_META, 1)
    return F.coalesce(F.when(valid_image(og), og), _image_in(html))


def post_image(post: Column) -> Column:
    """Image of a forum post (JSON text): its preview, its thumbnail, or its url if that ends like an image."""
    preview = F.replace(F.get_json_object(post, "$.preview.images[0].source.url"), F.lit("&amp;"), F.lit("&"))
    thumb, url = F.get_json_object(post, "$.thumbnail"), F.get_json_object(post, "$.url")
    bare = F.lower(F.split(F.coalesce(url, F.lit("")), r"\?")[0])
    ends = F.lit(False)
    for e in fixed.IMAGE_ENDINGS:
        ends = ends | bare.endswith(e)
    return F.coalesce(F.when(valid_image(preview), preview), F.when(valid_image(thumb) & ~thumb.isin(*fixed.NO_THUMBNAILS), thumb), F.when(valid_image(url) & ends, url))


def page_title(html: Column) -> Column:
    return F.trim(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1))


def page_links(pages: DataFrame) -> DataFrame:
    """Distinct links of each page with the place of their first occurrence."""
    rows = pages.select("page_id", F.posexplode(F.regexp_extract_all("html", F.lit('(?i)<a[^>]+href="([^"]+)"'), 1)).alias("pos", "href"))
    return rows.groupBy("page_id", "href").agg(F.min("pos").alias("pos"))


def page_feeds(pages: DataFrame) -> DataFrame:
    """Feed links that pages announce, resolved against their urls."""
    tags = F.explode(F.regexp_extract_all("html", F.lit(r"""(?i)(<link[^>]+type=["']application/(?:rss|atom)\+xml["'][^>]*>)"""), 1))
    rows = pages.select("page_id", "url", tags.alias("tag")).withColumn("href", F.regexp_extract("tag", r"""(?i)href=["']([^"']+)["']""", 1)).where("href <> ''")
    root = F.regexp_extract("url", "^(https?://[^/]+)", 1)
    full = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(root, "href")).otherwise(F.concat(F.regexp_replace("url", "[^/]*$", ""), "href"))
    return rows.select("page_id", full.alias("feed")).distinct()


def feed_candidates(pages: DataFrame) -> DataFrame:
    """(page_id, place, feed): the feeds a page announces, then the usual feed paths of its host; each once.

    Which of them answer is for the caller to find out; this is the list to probe, in order.
    """
    tags = F.regexp_extract_all("html", F.lit(r"""(?i)<link[^>]+type=["']application/(?:rss|atom)\+xml["'][^>]*>"""), 0)
    hrefs = F.filter(F.transform(tags, lambda t: F.regexp_extract(t, r"""(?i)href=["']([^"']+)["']""", 1)), lambda h: h != "")
    root = F.regexp_extract("url", "^(https?://[^/?#]+)", 1)
    folder = F.when(F.col("url").rlike("^https?://[^/?#]+/"), F.regexp_replace(F.split("url", "[?#]")[0], "[^/]*$", "")).otherwise(F.concat(root, F.lit("/")))
    full = lambda h: F.when(h.rlike("^https?://"), h).when(h.startswith("//"), F.concat(F.regexp_extract("url", "^(https?:)", 1), h)).when(h.startswith("/"), F.concat(root, h)).otherwise(F.concat(folder, h))
    usual = F.when(root != "", F.array(*[F.concat(root, F.lit(p)) for p in fixed.FEED_PATHS])).otherwise(F.array().cast("array<string>"))
    every = F.array_distinct(F.concat(F.transform(hrefs, full), usual))
    return pages.select("page_id", F.posexplode(every).alias("place", "feed"))


def validate_pages(pages: DataFrame, as_of: str) -> DataFrame:
    """ok and items of fetched source pages (type, body, newest); a null body is no answer.

    Feeds need entries, and their newest one under 60 days of age if it has a time; channel pages count the marks of
    messages; a forum's answer is an object with data; any answer of a video channel is good, and the item list needs none.
    """
    kind, body = F.col("type"), F.col("body")
    age = F.floor((F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(F.col("newest").cast("timestamp"))) / 86_400_000_000)
    count = lambda mark: F.coalesce(F.regexp_count(body, F.lit(mark)), F.lit(0))
    forum = F.coalesce(F.array_contains(F.json_object_keys(body), "data"), F.lit(False))
    items = F.when(kind == "telegram", count("tgme_widget_message")).when(kind == "rss", count("<(?:item|entry)[ >]"))
    items = items.when(kind == "hackernews", 1).when(kind == "youtube", body.isNotNull().cast("int")).when(kind == "reddit", forum.cast("int")).otherwise(0)
    fresh = (kind != "rss") | F.col("newest").isNull() | (age < 60)
    return pages.withColumn("items", items).withColumn("ok", (F.col("items") > 0) & fresh)
