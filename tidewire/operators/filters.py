"""Predicates on events, cards, log lines and source settings."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.functions import fixed
from tidewire.functions import text as T


def blacklisted(text: Column, topics: Sequence[str]) -> Column:
    """True if all words of any topic stand in the text; words of one letter never match."""
    low = F.lower(text)
    any_topic = F.lit(False)
    for topic in topics:
        all_words = F.lit(bool(topic.split()))
        for word in topic.split():
            all_words = all_words & (low.rlike(T.word_match(word)) if len(word) >= 2 else F.lit(False))
        any_topic = any_topic | all_words
    return any_topic


def drop_blacklisted(events: DataFrame, text: Column, topics: Sequence[str]) -> DataFrame:
    return events.where(~F.coalesce(blacklisted(text, topics), F.lit(False)))


def quality_card(title: Column, summary: Column) -> Column:
    """False for cards that are too short, untranslated or hold leftovers of markup."""
    s, t = T.strip(F.coalesce(summary, F.lit(""))), T.strip(F.coalesce(title, F.lit("")))
    cyrillic, latin = T.letters(s)
    foreign = (cyrillic + latin > 20) & (cyrillic < (cyrillic + latin) * 0.35)
    leftovers = s.startswith(fixed.LEFTOVER_START) | (F.contains(s, F.lit(fixed.LEFTOVER_PAIR[0])) & F.contains(s, F.lit(fixed.LEFTOVER_PAIR[1])))
    for mark in fixed.LEFTOVERS:
        leftovers = leftovers | F.contains(s, F.lit(mark))
    return (F.length(s) >= 30) & (F.length(t) >= 5) & ~leftovers & ~foreign


def score_at_least(df: DataFrame, column: str, least: int = 50) -> DataFrame:
    return df.where(F.col(column) >= least)


def log_lines(df: DataFrame, words: Sequence[str], column: str = "value") -> DataFrame:
    keep = F.lit(False)
    for w in words:
        keep = keep | F.contains(F.lower(F.col(column)), F.lit(w.lower()))
    return df.where(keep)


def config_errors(kind: Column, value: Column) -> Column:
    """Error texts for one source setting, an empty array if it is fine."""
    v = F.trim(F.coalesce(value, F.lit("")))
    checks = [
        F.when(v == "", "value is missing"),
        F.when((kind == "rss") & (v != "") & ~v.rlike("^https?://"), "url must start with http"),
        F.when((kind == "telegram") & v.rlike(r"\s"), "channel must be one word"),
        F.when((kind == "reddit") & v.startswith("/"), "sub must be a bare name"),
        F.when((kind == "hackernews") & (v != "") & v.try_cast("int").isNull(), "min_score must be a number"),
        F.when(~kind.isin("rss", "telegram", "reddit", "hackernews", "youtube", "search"), "unknown type"),
    ]
    return F.array_compact(F.array(*checks))


def paused_until(context: Column) -> Column:
    """The time in a state's JSON, null for none that can be read."""
    return F.try_to_timestamp(F.get_json_object(context, "$.paused_until")).cast("timestamp")


def paused(state: DataFrame, as_of: str) -> DataFrame:
    """Of a state table (key, context), whether delivery is paused: one row, false without a readable time."""
    own = state.where(F.col("key") == fixed.PAUSE_KEY)
    return own.agg(F.coalesce(F.max(paused_until(F.col("context"))) > F.lit(as_of).cast("timestamp"), F.lit(False)).alias("paused"))


def pause_row(spark: SparkSession, as_of: str, days: int = 1) -> DataFrame:
    """The state row that pauses delivery for some days; upsert it by key, delete it to resume."""
    until = F.date_format(F.lit(as_of).cast("timestamp") + F.expr(f"INTERVAL {days} DAYS"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return spark.range(1).select(F.lit(fixed.PAUSE_KEY).alias("key"), F.to_json(F.struct(until.alias("paused_until"))).alias("context"))


def source_key(kind: Column, value: Column) -> Column:
    """Identity of a configured source."""
    low = F.lower(F.trim(value))
    return (
        F.when(kind == "rss", F.concat(F.lit("rss:"), low))
        .when(kind == "telegram", F.concat(F.lit("tg:"), F.regexp_replace(low, "^@", "")))
        .when(kind == "reddit", F.concat(F.lit("reddit:"), F.regexp_replace(low, "^r/", "")))
        .otherwise(F.concat_ws(":", kind, low))
    )
