"""From articles to a digest: one plan per step, all sections at once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators import cluster, compose, dedup, filters, history, model, rank
from tidewire.runtime import settle

SHOWN = 100  # first articles of an event whose texts and sources it carries


def _arrays(articles: DataFrame, key: str) -> DataFrame:
    """Texts, sources and section of the first articles of each event, in order; bounded per event."""
    order = ["lead", "seq"] if "lead" in articles.columns else ["seq"]
    first = articles.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("_r") <= SHOWN)
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("_r", F.col(c).alias("v")))), lambda x: x["v"])
    return first.groupBy(key).agg(ordered("title").alias("titles"), ordered("snippet").alias("snippets"), ordered("source").alias("sources"), F.min_by("section", "_r").alias("section"))


def _with_entities(events: DataFrame) -> DataFrame:
    text = F.concat_ws(" ", "canonical_title", F.array_join(F.slice("snippets", 1, 3), " "))
    return events.withColumn("entities", T.entities(text))


def events_of(articles: DataFrame) -> DataFrame:
    """Events of deduplicated articles, with entities and article arrays in order."""
    grouped = settle(cluster.with_component(articles, cluster.event_edges(articles)))
    return _with_entities(cluster.event_summary(grouped).join(_arrays(grouped, "event_id").hint("merge"), "event_id"))


def merged_events(events: DataFrame, articles: DataFrame, least: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Events that share entities as one, with title, time and role of the largest, and the articles of each, the largest event's first.

    event_id is the group's, in both. articles: seq, event_id and what events carry of them.
    """
    groups = settle(cluster.entity_groups(events, least))
    rows = settle(cluster.merged_members(articles, events, groups))
    lead = F.max_by(F.struct("canonical_title", "published_at", "role"), F.struct("n_articles", -F.col("first_seq")))
    whole = events.join(groups, "event_id").groupBy("category", "group_id").agg(F.sum("n_articles").alias("n_articles"), F.min("first_seq").alias("first_seq"), lead.alias("lead"))
    whole = whole.select("category", F.col("group_id").alias("event_id"), "n_articles", "first_seq", "lead.*")
    return _with_entities(whole.join(_arrays(rows, "event_id"), "event_id")), rows


def digest(
    articles: DataFrame,
    past: DataFrame,
    boosts: DataFrame,
    as_of: str,
    blacklist: list[str],
    per_section: int = 10,
    stories: DataFrame | None = None,
    style: str = "medium",
    make: Callable[[], model.Backend] = model.Offline,
) -> dict[str, DataFrame]:
    """Every table on the way: kept articles, events, ranked events, cards, the issue and its parts.

    past: titles of former digests (item_id, title, digest_date); of these the last 7 days count. stories:
    (story_id, entities, last_seen_at); an event whose story of the last 14 days stood in a digest of the
    last 3 is left out.
    """
    kept = settle(dedup.batch_dedup(articles))
    grouped = settle(cluster.with_component(kept, cluster.event_edges(kept)))
    events = settle(_with_entities(cluster.event_summary(grouped).join(_arrays(grouped, "event_id").hint("merge"), "event_id")))
    wanted = filters.drop_blacklisted(events, F.concat_ws(" ", "canonical_title", F.array_join("snippets", " ")), blacklist)
    merged, members = merged_events(settle(wanted), grouped)
    merged = settle(merged)
    signed = history.within(past, "digest_date", as_of, 7).select("item_id", T.signature(F.col("title"), F.lit("")).alias("_sig"))
    fresh = history.new_only(merged.withColumn("_sig", T.signature(F.col("canonical_title"), F.lit(""))), signed, "event_id", "_sig", "item_id", "_sig")
    fresh = settle(fresh.drop("_sig"))
    if stories is not None:
        fresh = settle(history.not_recent(fresh, history.best_story(fresh, stories, 0.5, as_of, 14), as_of, 3))
    scored = settle(rank.boosted(rank.score_events(fresh, as_of), boosts))
    top = settle(rank.top_per(scored, per_section))
    cards = model.write_cards(top, make)
    shown = cluster.shown_sources(cluster.collect_sources(members.join(top.select("event_id"), "event_id", "left_semi")))
    links = shown.groupBy("event_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("shown", "url", "domain"))), lambda x: F.struct(x["url"], x["domain"])).alias("links"))
    cards = cards.join(links, "event_id", "left").withColumn("_links", compose.links_line(F.coalesce("links", F.array().cast("array<struct<url:string,domain:string>>"))))
    agents = F.col("section") == "ai_agents"
    own = compose.card_text(F.col("title"), F.col("summary"), F.col("why"), F.col("_links"), style, F.col("take"))
    text = F.when(agents, compose.agent_card(F.col("title"), F.col("summary"), F.col("why"), F.col("area"), F.col("_links"))).otherwise(own)
    cards = settle(cards.withColumn("card", text).drop("_links", "links"))
    issue = settle(compose.issue(cards, F.lit(as_of[:10]).cast("date")))
    return {"articles": kept, "events": events, "merged": merged, "ranked": scored, "cards": cards, "issue": issue, "parts": compose.split_messages(issue.select("item_count", "full_text"))}

