"""The driver's tables as the engine's entities, in Spark and, for comparison, in SQL."""

from __future__ import annotations

import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import fixed
from tidewire.runtime import table

AS_OF = "2024-01-31 00:00:00"


# some sources carry names that titles and scores prefer
_SOURCE = "CASE source WHEN 'src3' THEN 'rss:reuters' WHEN 'src5' THEN 'rss:bbc_world' WHEN 'src7' THEN 'rss:techcrunch' ELSE concat('rss:', source) END"


class Keeper:
    """A backend that keeps the same places of every batch."""

    def answer(self, prompt: str) -> str:
        return '```json\n{"keep": [5, 0, 2]}\n```'


class Writer:
    """A backend without a model: cards in Russian from a number of the prompt; no answer to every seventh."""

    def answer(self, prompt: str) -> str:
        number = zlib.crc32(prompt.encode())
        if number % 7 == 0:
            return ""
        agents = f"[{fixed.AGENT_TAGS[1]}]" in prompt
        said = [f"Новость под номером {number % 10_000}", f"Коротко о событии {number % 97}. Подробности остались в источниках.", "Это меняет планы многих."]
        said += ["локальные модели", ("verified", "partial", "?")[number % 3]] if agents else ["Следим дальше."]
        return "Вот карточка:\n" + "\n".join(f"[{t}] {s}" for t, s in zip(fixed.AGENT_TAGS if agents else fixed.CARD_TAGS, said))


def articles(spark: SparkSession, d: str) -> DataFrame:
    """Every document as an article; the times spread over January 2024 by id."""
    docs = table(spark, d, "documents").withColumn("published_at", F.expr("timestampadd(MINUTE, cast((doc_id * 7919) % 43200 as int), TIMESTAMP_NTZ'2024-01-01 00:00:00')"))
    return docs.select(
        F.col("doc_id").alias("seq"),
        F.col("lang").alias("category"),
        F.expr("array_join(slice(split(trim(text), '\\\\s+'), 1, 8), ' ')").alias("title"),
        F.expr("concat('https://', source, '.example/', doc_id % 700)").alias("url"),
        F.substring("text", 1, 300).alias("snippet"),
        F.expr(_SOURCE).alias("source"),
        "published_at",
        F.expr("CASE doc_id % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'analysis' ELSE 'signal' END").alias("role"),
        F.element_at(F.array(*[F.lit(s) for s in [*fixed.SECTION_ORDER, "custom"]]), (F.col("doc_id") % 7 + 1).cast("int")).alias("section"),
    )


_SECTIONS = ", ".join(f"'{s}'" for s in [*fixed.SECTION_ORDER, "custom"])
ARTICLES = rf"""articles AS (
  SELECT d.doc_id AS seq, d.lang AS category, array_to_string(list_slice(regexp_split_to_array(trim(d.text), '\s+'), 1, 8), ' ') AS title,
    concat('https://', d.source, '.example/', d.doc_id % 700) AS url, substr(d.text, 1, 300) AS snippet, {_SOURCE.replace("source", "d.source")} AS source,
    TIMESTAMP '2024-01-01 00:00:00' + to_minutes((d.doc_id * 7919) % 43200) AS published_at, CASE d.doc_id % 3 WHEN 0 THEN 'source' WHEN 1 THEN 'analysis' ELSE 'signal' END AS role,
    list_extract([{_SECTIONS}], CAST(d.doc_id % 7 + 1 AS INTEGER)) AS section
  FROM documents d)"""


def feedback(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select(
        F.col("event_id").alias("id"),
        F.expr("concat('src', user_id % 20)").alias("source"),
        F.expr("CASE event_type WHEN 'purchase' THEN 'save' WHEN 'click' THEN 'up' WHEN 'view' THEN 'down' WHEN 'error' THEN 'mute' ELSE 'ignored' END").alias("rating"),
        F.expr("concat('https://', event_type, '.example/story')").alias("article_url"),
        F.col("user_id").cast("string").alias("user_id"),
        F.col("ts").alias("created_at"),
    )


FEEDBACK = """feedback AS (
  SELECT event_id AS id, concat('src', user_id % 20) AS source,
    CASE event_type WHEN 'purchase' THEN 'save' WHEN 'click' THEN 'up' WHEN 'view' THEN 'down' WHEN 'error' THEN 'mute' ELSE 'ignored' END AS rating,
    concat('https://', event_type, '.example/story') AS article_url, CAST(user_id AS VARCHAR) AS user_id, ts AS created_at
  FROM events)"""


def runs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderdate").alias("started_at"),
        F.expr("CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'running' ELSE 'error' END").alias("status"),
        F.expr("CASE WHEN o_orderkey % 9 = 0 THEN CAST(0 AS BIGINT) ELSE CAST(floor(o_totalprice) AS BIGINT) END").alias("duration_sec"),
        F.expr("o_orderkey % 5").alias("llm_calls"),
    )


RUNS = """runs AS (
  SELECT o_orderkey AS id, o_orderdate AS started_at, CASE o_orderstatus WHEN 'F' THEN 'ok' WHEN 'O' THEN 'running' ELSE 'error' END AS status,
    CASE WHEN o_orderkey % 9 = 0 THEN 0 ELSE CAST(floor(o_totalprice) AS BIGINT) END AS duration_sec, o_orderkey % 5 AS llm_calls
  FROM orders)"""


def past_titles(spark: SparkSession, d: str) -> DataFrame:
    """Titles of former digests: of benchmark items, and of all documents (negative ids) without their last word."""
    words = lambda n: F.expr(f"array_join(slice(split(trim(text), '\\\\s+'), 1, {n}), ' ')")
    day = lambda c: F.expr(f"date_sub(DATE'2024-01-31', cast({c} % 10 as int))")
    items = table(spark, d, "benchmark").select("item_id", words(8).alias("title"), day("item_id").alias("digest_date"))
    docs = table(spark, d, "documents").select((F.lit(-1) - F.col("doc_id")).alias("item_id"), words(7).alias("title"), day("doc_id").alias("digest_date"))
    return items.unionByName(docs)


PAST = r"""past AS (
  SELECT item_id, array_to_string(list_slice(regexp_split_to_array(trim(text), '\s+'), 1, 8), ' ') AS title, CAST(DATE '2024-01-31' - CAST(item_id % 10 AS INTEGER) AS DATE) AS digest_date
  FROM benchmark
  UNION ALL SELECT -1 - doc_id, array_to_string(list_slice(regexp_split_to_array(trim(text), '\s+'), 1, 7), ' '), CAST(DATE '2024-01-31' - CAST(doc_id % 10 AS INTEGER) AS DATE) FROM documents)"""
