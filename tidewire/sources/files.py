"""Scans of raw files: whole feeds and pages, forum listings as JSON, and the items of very large feeds.

Every scan keeps where a row comes from (file) and takes whole folders. Files that are no feed, page or
listing give no rows; broken() tells which ones and why.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.sources import feeds

CORRUPT = "_corrupt"
_FILE = "_metadata.file_path AS file"
ITEM = "title STRING, link STRING, description STRING, pubDate STRING"


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """file, body and the partition columns of every file of a folder, one row each."""
    rows = spark.read.text(path, wholetext=True).withColumnRenamed("value", "body")
    return rows.selectExpr("*", _FILE)


def feed_files(spark: SparkSession, path: str, limit: int = 20, category: str = "", url: str | None = None) -> DataFrame:
    """Articles of all feeds in a folder, RSS or Atom, `limit` of each file.

    category and url name columns that the folder's partitions give; without them the category is empty and
    the file stands for the feed's address.
    """
    files = whole_files(spark, path)
    named = files.select("file", (F.col(category).cast("string") if category else F.lit("")).alias("category"), F.col(url or "file").cast("string").alias("url"), "body")
    return feeds.parse_feed(named, limit)


def page_files(spark: SparkSession, path: str, user: str = "user", category: str = "", limit: int = 15) -> DataFrame:
    """Posts of all channel pages in a folder; the partition column `user` names the channel."""
    files = whole_files(spark, path)
    named = files.select((F.col(category).cast("string") if category else F.lit("")).alias("category"), F.col(user).cast("string").alias("user"), F.concat(F.lit("https://t.me/s/"), F.col(user)).alias("url"), "body")
    return feeds.parse_channel_page(named, limit)


def _json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    rows = spark.read.schema(f"{schema}, {CORRUPT} STRING").json(path, multiLine=True, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT)
    return rows.selectExpr("*", _FILE)


def listing_files(spark: SparkSession, path: str, sub: str = "sub", category: str = "", limit: int = 15, least: int = 50) -> DataFrame:
    """Posts of all forum listings in a folder; the partition column `sub` names the forum."""
    rows = _json(spark, path, feeds.LISTING).where(F.col(CORRUPT).isNull() & F.col("data.children").isNotNull())
    named = rows.select((F.col(category).cast("string") if category else F.lit("")).alias("category"), F.col(sub).cast("string").alias("sub"), F.to_json(F.struct("data")).alias("body"))
    return feeds.parse_listing(named, limit, least)


def broken(spark: SparkSession, path: str, schema: str = feeds.LISTING) -> DataFrame:
    """file and reason of the JSON files of a folder that are not what the schema says."""
    rows = _json(spark, path, schema)
    known = F.coalesce(*(F.to_json(F.struct(c)) for c in spark.createDataFrame([], schema).columns))
    return rows.where(F.col(CORRUPT).isNotNull() | (known == "{}")).select("file", F.when(F.col(CORRUPT).isNotNull(), "no JSON").otherwise("nothing known in it").alias("reason"))


def feed_items(spark: SparkSession, path: str, tag: str = "item") -> DataFrame:
    """The items of feeds of any size, one row each and cut by Spark into tasks; their order in a file is not kept.

    An item that breaks off can take those after it along; feed_files reads a feed as one document.
    """
    rows = spark.read.schema(f"{ITEM}, {CORRUPT} STRING").xml(path, rowTag=tag, mode="PERMISSIVE", columnNameOfCorruptRecord=CORRUPT, ignoreNamespace=True).selectExpr("*", _FILE)
    good = rows.where(F.col(CORRUPT).isNull() & (F.trim(F.coalesce("title", F.lit(""))) != "") & (F.trim(F.coalesce("link", F.lit(""))) != ""))
    return good.select("file", F.trim("title").alias("title"), F.trim("link").alias("url"), feeds.feed_snippet(F.col("description")).alias("snippet"), feeds.feed_date(F.col("pubDate")).alias("published_at"))


def scan(spark: SparkSession, sql: str, tables: dict[str, DataFrame], **values) -> DataFrame:
    """A parameterised query: {name} is one of the tables, :name one of the values, which is never read as SQL."""
    return spark.sql(sql, args=values, **tables)
