"""Matching of interests with a source catalogue, and choice of sources."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.runtime import settle, tasks

_FEW = 10_000  # rows that may go through the driver


def _held(rows: DataFrame) -> DataFrame:
    """rows as a side of a join that is sent to all tasks if it is small, else dealt by its key; the other side never is sent."""
    return F.broadcast(rows) if rows.limit(_FEW + 1).count() <= _FEW else rows.hint("merge")


def match_interests(interests: DataFrame, catalog: DataFrame, k: int = 5) -> DataFrame:
    """Best catalogue entries for each interest text.

    catalog: id, name, description, tags, recommended, quality. Each word of the interest counts 3
    in the name, 2 in the description, 2 in every tag; recommended counts 5, quality high 2 and
    medium 1. A word can only stand in texts that hold its first three letters, so words and entries
    meet on those, whatever the size of the catalogue. Neither the catalogue nor its runs of letters, which the planner
    takes for small, go through the driver; the words do if they are few.
    """
    words = interests.select("interest_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-zа-я0-9]{3,}"), 0)).alias("w"))
    inside = F.contains(F.lower("name"), F.col("w")).cast("int") * 3 + F.contains(F.lower("description"), F.col("w")).cast("int") * 2
    inside = inside + F.size(F.filter("tags", lambda t: F.contains(F.lower(t), F.col("w")))) * 2
    base = F.when(F.col("recommended"), 5).otherwise(0) + F.when(F.col("quality") == "high", 2).when(F.col("quality") == "medium", 1).otherwise(0)
    # each distinct word meets the catalogue once; repeats count by their number
    counted = settle(words.groupBy("interest_id", "w").agg(F.count(F.lit(1)).alias("times")))
    text = F.lower(F.concat_ws("\n", "name", "description", F.array_join("tags", "\n")))
    # an entry is many runs, so the number of tasks must not go by the size of the catalogue
    dealt = catalog.select("id", "name", "description", "tags").repartition(tasks(catalog.sparkSession), "id")
    starts = dealt.withColumn("g", F.explode(T.runs(text)))
    asked = settle(counted.select("w").distinct().withColumn("g", F.substring("w", 1, 3)))
    hits = starts.join(_held(asked), "g").where(inside > 0).select("w", "id", inside.alias("hit"))
    scored = hits.join(_held(counted), "w").groupBy("interest_id", "id").agg(F.sum(F.col("hit") * F.col("times")).alias("hits"))
    full = scored.join(catalog.select("id", "recommended", base.alias("base")).hint("merge"), "id").withColumn("score", F.col("hits") + F.col("base"))
    w = Window.partitionBy("interest_id").orderBy(F.desc("recommended"), F.desc("score"), "id")
    return full.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("interest_id", "rank", "id", "score")


def selected_sources(catalog: DataFrame, chosen: DataFrame) -> DataFrame:
    """Per topic the chosen sources as ordered lists by type; topics without any are left out."""
    kept = catalog.join(chosen, "id", "left_semi")
    rows = kept.groupBy("topic", "type").agg(F.array_join(F.array_sort(F.collect_list("name")), ",").alias("names"), F.count(F.lit(1)).alias("n"))
    return rows


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A catalogue file as rows: topic, id, type, name, url, language, quality, description, tags, recommended.

    JSON or YAML, topics to lists of sources; the file is a configuration that the driver reads.
    """
    body = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    try:
        loaded = json.loads(body)
    except ValueError:
        import yaml

        loaded = yaml.safe_load(body)
    rows = []
    for topic, entry in ((loaded or {}).get("topics") or {}).items():
        for s in entry.get("sources") or []:
            label = s.get("name") or s.get("url") or ""
            rows.append((topic, f"{topic}/{len(rows)}", s.get("type"), label, s.get("url"), s.get("language"), s.get("quality"), s.get("description") or "", list(s.get("tags") or []), bool(s.get("recommended"))))
    return spark.createDataFrame(rows, "topic string, id string, type string, name string, url string, language string, quality string, description string, tags array<string>, recommended boolean")


def flatten_catalog(topics: DataFrame) -> DataFrame:
    """(topic, type, label, value) of nested topics: id, sources map<type, array<entry>>.

    An entry is a plain value or a JSON object with subreddit or name and min_score; a leading @ or r/
    belongs to the label only.
    """
    rows = topics.select(F.col("id").alias("topic"), F.explode("sources").alias("type", "entries")).select("topic", "type", F.posexplode("entries").alias("pos", "entry"))
    field = lambda k: F.get_json_object("entry", "$." + k)
    value = F.when(F.col("entry").startswith("{"), F.coalesce(field("subreddit"), field("name"), field("url"), field("username"), field("channel_id"), F.lit("?"))).otherwise(F.regexp_replace("entry", "^@", ""))
    score = F.when(F.col("entry").startswith("{"), F.nullif(field("min_score"), F.lit("0")))
    label = (
        F.when(F.col("type") == "telegram", F.concat(F.lit("@"), value))
        .when(F.col("type") == "reddit", F.concat(F.lit("r/"), value, F.coalesce(F.concat(F.lit(" (min_score="), score, F.lit(")")), F.lit(""))))
        .when(F.col("type") == "hackernews", "enabled")
        .otherwise(value)
    )
    return rows.where((F.col("type") != "hackernews") | (F.col("pos") == 0)).select("topic", "type", label.alias("label"), value.alias("value"))


def validation_report(checked: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """Status of each source (type, label, error, last_post) in order, and how many have each status."""
    kind, age = freshness_class(F.col("last_post"), as_of)
    failed = F.coalesce(F.col("error"), F.lit("")) != ""
    rows = checked.select("type", "label", F.when(failed, "error").otherwise(kind).alias("status"), F.when(failed, F.substring("error", 1, 80)).otherwise(age).alias("detail"))
    return rows.orderBy("type", "label"), rows.groupBy("status").agg(F.count(F.lit(1)).alias("n"))


def topic_totals(flat: DataFrame) -> DataFrame:
    """Sources of each topic, by type and in all."""
    return flat.groupBy("topic").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("type").alias("types"))


def freshness_class(last: Column, as_of: Column) -> tuple[Column, Column]:
    """live or stale, and the age as text."""
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(last.cast("timestamp"))
    kind = F.when(last.isNull() | (age > 2 * 86_400), "stale").otherwise("live")
    part = lambda n, unit: F.concat(F.floor(age / n).cast("string"), F.lit(unit))
    text = F.when(last.isNull(), "never").when(age < 0, "future").when(age < 60, part(1, "s")).when(age < 3600, part(60, "m")).when(age < 86_400, part(3600, "h")).otherwise(part(86_400, "d"))
    return kind, text


def memory_lookup(memory: DataFrame, query: str, k: int = 3) -> DataFrame:
    """Most important memory rows that hold any of the query's first six words."""
    words = F.slice(F.array_distinct(F.regexp_extract_all(F.lower(F.lit(query)), F.lit(r"(?U)\w{3,}"), 0)), 1, 6)
    hit = F.exists(words, lambda w: F.contains(F.lower("title"), w) | F.contains(F.lower("content"), w))
    return memory.where(hit).orderBy(F.desc("importance"), F.desc("created_at"), "id").limit(k)
