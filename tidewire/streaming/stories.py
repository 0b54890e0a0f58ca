"""Stories over digests as keyed state, and the same as a batch."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType, TimestampType

from tidewire.operators.history import best_story, upsert_stories
from tidewire.runtime import drop, settle
from tidewire.sources.state_table import StateTable

STORY = "story_id long, canonical_title string, first_seen_at timestamp, last_seen_at timestamp, card_count long, digest_ids array<long>"
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ABOUT = StructType([StructField("title", StringType()), StructField("first_seen", TimestampType()), StructField("last_seen", TimestampType()), StructField("cards", LongType())])
_DIGEST, _SEEN = StructType([StructField("digest_id", LongType())]), StructType([StructField("seen_at", TimestampType())])


class StoryState(StatefulProcessor):
    """One story: when it was first and last seen, its cards, and its digests as a map.

    A story that no card has come for in `days` days is forgotten: an event-time timer at that moment clears
    its state, and a card after that begins the story anew. Rows of a batch are taken in order of time, so
    only their times decide, not how they are dealt into batches, as far as the watermark lets rows in.
    """

    def __init__(self, days: int = 14):
        self.days = days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.about = handle.getValueState("about", _ABOUT)
        self.digests = handle.getMapState("digests", _DIGEST, _SEEN)

    def _forget(self) -> None:
        self.about.clear()
        self.digests.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cards = pd.concat(list(rows)).sort_values(["seen_at", "digest_id", "title"], kind="stable")
        title, first, last, count = self.about.get() if self.about.exists() else (None, None, None, 0)
        before = last
        for card in cards.itertuples():
            if last is not None and card.seen_at - pd.Timestamp(last) > pd.Timedelta(days=self.days):
                self._forget()
                title, first, last, count = None, None, None, 0
            if first is None or card.seen_at < pd.Timestamp(first):
                title, first = card.title, card.seen_at.to_pydatetime()
            last = card.seen_at.to_pydatetime() if last is None else max(pd.Timestamp(last), card.seen_at).to_pydatetime()
            count += 1
            if not pd.isna(card.digest_id):
                self.digests.updateValue((int(card.digest_id),), (card.seen_at.to_pydatetime(),))
        self.about.update((title, first, last, count))
        if before is not None:
            self.handle.deleteTimer(self._due(before))
        self.handle.registerTimer(self._due(last))
        ids = sorted((when[0], k[0]) for k, when in self.digests.iterator())
        yield pd.DataFrame({"story_id": [key[0]], "canonical_title": [title], "first_seen_at": [first], "last_seen_at": [last], "card_count": [count], "digest_ids": [[k for _, k in ids]]})

    def _due(self, last) -> int:
        return int(pd.Timestamp(last).timestamp() * 1000) + self.days * 86_400_000 + 1

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._forget()
        return iter(())

    def close(self) -> None:
        pass


def use_rocksdb(spark: SparkSession) -> None:
    """Map state and timers need the RocksDB state store; queries that start after this use it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def track(cards: DataFrame, days: int = 14, late: str = "2 days") -> DataFrame:
    """The story of every card (story_id, digest_id, seen_at, title) after each micro-batch; the newest row of a story is its state."""
    rows = cards.select(F.col("story_id").cast("long"), F.col("digest_id").cast("long"), F.col("seen_at").cast("timestamp"), F.col("title").cast("string"))
    timed = rows.withWatermark("seen_at", late)
    return timed.groupBy("story_id").transformWithStateInPandas(StoryState(days), STORY, "Update", "EventTime")


def fold(cards: DataFrame, days: int = 14) -> DataFrame:
    """The same stories from all cards at once: a story begins anew after `days` days without a card.

    Numbering runs inside a story only; digests come in order of when they were last seen.
    """
    seen = F.col("seen_at").cast("timestamp")
    rows = cards.select("story_id", F.col("digest_id").cast("long"), seen.alias("seen_at"), "title")
    w = Window.partitionBy("story_id").orderBy("seen_at", "digest_id", "title")
    gap = F.col("seen_at") > F.lag("seen_at").over(w) + F.make_dt_interval(F.lit(days))
    runs = rows.withColumn("run", F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(w))
    per = runs.groupBy("story_id", "run", "digest_id").agg(F.min(F.struct("seen_at", "digest_id", "title")).alias("head"), F.max("seen_at").alias("last"), F.count(F.lit(1)).alias("n"))
    ids = F.array_sort(F.collect_list(F.when(F.col("digest_id").isNotNull(), F.struct("last", "digest_id"))))
    out = per.groupBy("story_id", "run").agg(F.min("head").alias("head"), F.max("last").alias("last_seen_at"), F.sum("n").alias("card_count"), ids.alias("ids"))
    newest = out.groupBy("story_id").agg(F.max_by(F.struct("head", "last_seen_at", "card_count", "ids"), "run").alias("s"))
    return newest.select("story_id", F.col("s.head.title").alias("canonical_title"), F.col("s.head.seen_at").alias("first_seen_at"), "s.last_seen_at", "s.card_count", F.col("s.ids.digest_id").alias("digest_ids"))


class StoryBook:
    """The stories of all digests so far, in a state table that each digest is matched against and taken into.

    Digests are taken in order of their numbers; one that was taken before, as after a restart, is passed over.
    """

    def __init__(self, spark: SparkSession, path: str, least: float = 0.5, days: int = 14, buckets: int = 16):
        self.table = StateTable(spark, path, ["story_id"], ["last_seen_at", "card_count"], buckets)
        self.least, self.days = least, days

    def stories(self) -> DataFrame | None:
        """All stories; None before the first digest."""
        return self.table.read() if self.table.manifest()["schema"] else None

    def take(self, cards: DataFrame, batch: int | None = None) -> None:
        """Cards of one or more digests: digest_id, digest_at, event_id, canonical_title, entities. Usable as a foreachBatch function."""
        for d in cards.select("digest_id", "digest_at").distinct().orderBy("digest_id").collect():  # one row per digest
            mine = cards.where(F.col("digest_id") == d["digest_id"]).select("event_id", "canonical_title", "entities")
            self._digest(mine, d["digest_id"], str(d["digest_at"]))

    def _digest(self, events: DataFrame, digest_id: int, at: str) -> None:
        if self.table.manifest()["done"].get("", -1) >= digest_id:
            return
        events, known = settle(events), self.stories()
        if known is None:
            known = events.sparkSession.createDataFrame([], upsert_stories(_no_stories(events), events, _no_matches(events), at, digest_id).schema)
        matched = settle(best_story(events, known, self.least, at, self.days))
        seen = known.join(matched.select("story_id").distinct(), "story_id", "left_semi")
        self.table.upsert(upsert_stories(seen, events, matched, at, digest_id), digest_id)
        drop(events, matched)


def _no_stories(events: DataFrame) -> DataFrame:
    none = events.where("false").select(F.lit(0).cast("long").alias("story_id"), "canonical_title", "entities")
    times = {c: F.lit(None).cast("timestamp_ntz") for c in ("first_seen_at", "last_seen_at")}
    return none.withColumns(times | {"card_count": F.lit(0).cast("long"), "digest_ids": F.array().cast("array<long>")})


def _no_matches(events: DataFrame) -> DataFrame:
    return events.where("false").select("event_id", F.lit(0).cast("long").alias("story_id"))
