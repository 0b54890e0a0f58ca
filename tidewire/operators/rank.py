"""Scores, ranking, diversity and per-section limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import fixed
from tidewire.functions import text as T
from tidewire.runtime import settle


def _by_section(section: Column, values: dict, other: Column) -> Column:
    out = other
    for name, value in values.items():
        out = F.when(section == name, value).otherwise(out)
    return out


def _words(lists: dict[str, list[str]], section: Column) -> Column:
    empty = F.array().cast("array<string>")
    return _by_section(section, {k: F.array(*[F.lit(w) for w in v]) for k, v in lists.items()}, empty)


def _hits(words: Column, text: Column) -> Column:
    return F.size(F.filter(words, lambda w: F.contains(text, w)))


def freshness(published: Column, as_of: str) -> Column:
    hours = (F.unix_micros(F.lit(as_of).cast("timestamp")) - F.unix_micros(published.cast("timestamp"))) / F.lit(3_600_000_000)
    return F.when(published.isNull(), 0.5).otherwise(F.greatest(F.lit(0.05), F.lit(1.0) - hours / 48))


def places4(c: Column) -> Column:
    """Four decimal places, half to even."""
    return F.rint(c * 10000) / 10000


def score_events(events: DataFrame, as_of: str) -> DataFrame:
    """Four scores and the final one, each rounded to four places after the sum; events carry section, title, snippets, sources, role, published_at, n_articles.

    snippets and sources are arrays in article order.
    """
    section = F.col("section")
    text = F.lower(F.concat_ws(" ", F.col("canonical_title"), F.transform(F.filter("snippets", lambda s: s != ""), lambda s: F.substring(s, 1, 300))))
    names = F.transform("sources", T.clean_source)
    trusted = F.array(*[F.lit(w) for w in fixed.TRUSTED])
    worth = lambda s: F.when(F.exists(_words(fixed.TRUSTED_IN, section), lambda w: F.contains(s, w)), 0.35).when(F.exists(trusted, lambda w: F.contains(s, w)), 0.20).otherwise(0.05)
    n = F.col("n_articles")
    source = F.aggregate(names, F.lit(0.0), lambda a, s: a + worth(s))
    source = source + F.when(n >= 4, 0.25).when(n >= 2, 0.10).otherwise(0.0)
    source = source + F.when(F.col("role") == "verified", 0.20).when(F.col("role") == "partially_verified", 0.10).otherwise(0.0)
    length = F.when(F.size("snippets") > 0, F.aggregate("snippets", F.lit(0), lambda a, s: a + F.length(s)) / F.size("snippets")).otherwise(0.0)
    world = F.least(F.lit(0.40), n * 0.10) + F.least(F.lit(0.15), F.size(F.array_distinct(names)) * 0.05)
    world = world + F.least(F.lit(0.35), _hits(_words(fixed.SIGNALS, section), F.col("_text")) * 0.12) + F.least(F.lit(0.10), length / 1200)
    words = _words(fixed.SECTION_KEYWORDS, section)
    part = F.least(F.lit(1.0), _hits(words, F.col("_text")) / F.greatest(F.lit(1.0), F.log2(F.size(words) + F.lit(2.0))))
    base = _by_section(section, {k: F.lit(v) for k, v in fixed.SECTION_WEIGHTS.items()}, F.lit(None).cast("double"))
    personal = F.when(base.isNull(), F.lit(0.7 * 0.5)).otherwise(F.least(F.lit(1.0), base * 0.35 + part * 0.65))
    out = events.withColumn("_text", text).withColumns(
        {"freshness": freshness(F.col("published_at"), as_of), "source_confidence": F.least(F.lit(1.0), source), "importance": F.least(F.lit(1.0), world), "relevance": personal}
    )
    weight = lambda k: _by_section(section, {s: F.lit(w[k]) for s, w in fixed.SCORE_WEIGHTS.items()}, F.lit(fixed.OTHER_WEIGHTS[k]))
    final = weight(0) * F.col("importance") + weight(1) * F.col("relevance") + weight(2) * F.col("freshness") + weight(3) * F.col("source_confidence")
    names = ["freshness", "source_confidence", "importance", "relevance", "final_score"]
    return out.withColumn("final_score", final).withColumns({c: places4(F.col(c)) for c in names}).drop("_text")


def ranked(events: DataFrame, part: str = "section", score: str = "final_score", order: str = "event_id") -> DataFrame:
    w = Window.partitionBy(part).orderBy(F.desc(score), order)
    return events.withColumn("rank", F.row_number().over(w))


def top_per(events: DataFrame, k: int, part: str = "section", score: str = "final_score", order: str = "event_id") -> DataFrame:
    return ranked(events, part, score, order).where(F.col("rank") <= k)


def diverse_top(events: DataFrame, k: int, alike: float = 0.40, part: str = "section", text: str = "text") -> DataFrame:
    """Greedy choice by rank that skips what resembles a chosen one, filled up from the skipped.

    A round chooses the first row of each part that resembles none of the chosen ones, so there are k rounds at most, each
    reads the rows once and only compares them with the few chosen ones. Where rounds end before k rows are chosen, all
    others are skipped ones and fill up in rank order.
    """
    tokens = F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[а-яёa-z]{4,}"), 0))
    rows = settle(events.withColumn("_tok", tokens))
    open_ = rows.select(part, "rank", "_tok")
    kept = None
    for _ in range(k):
        mine = open_ if kept is None else open_.alias("x").join(kept.alias("y"), F.col(f"x.{part}").eqNullSafe(F.col(f"y.{part}")) & _alike(alike), "left_anti")
        best = settle(mine.groupBy(part).agg(F.min("rank").alias("rank"), F.min_by("_tok", "rank").alias("_tok")))
        if not best.limit(1).count():
            break
        kept = best if kept is None else settle(kept.unionByName(best))
    marks = rows.limit(0) if kept is None else kept
    marks = marks.select(F.col(part).alias("_p"), F.col("rank").alias("_r"), F.lit(True).alias("_ok"))
    decided = rows.join(marks, F.col(part).eqNullSafe(F.col("_p")) & (F.col("rank") == F.col("_r")), "left").withColumn("_ok", F.coalesce("_ok", F.lit(False)))
    order = Window.partitionBy(part).orderBy(F.when(F.col("_ok"), 0).otherwise(1), "rank")
    chosen = decided.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    return chosen.select(*events.columns, F.col("_ok").alias("diverse"), "place")


def _alike(least: float) -> Column:
    """Whether the tokens of x and y are as similar as that, or are the same row's."""
    shared = F.size(F.array_intersect("x._tok", "y._tok"))
    return (F.col("x.rank") == F.col("y.rank")) | ((shared > 0) & (shared >= least * (F.size("x._tok") + F.size("y._tok") - shared)))


def boosted(events: DataFrame, boosts: DataFrame) -> DataFrame:
    """final_score times the mean boost of the event's matched sources, rounded to four places; others keep theirs."""
    src = events.select("event_id", F.explode(F.array_distinct(F.transform("sources", T.clean_source))).alias("s"))
    known = boosts.select(T.clean_source(F.col("source")).alias("s"), "boost")
    factor = src.join(known, "s").groupBy("event_id").agg(F.avg("boost").alias("factor"))
    return events.join(factor, "event_id", "left").withColumn("final_score", F.when(F.col("factor").isNull(), F.col("final_score")).otherwise(places4(F.col("final_score") * F.col("factor"))))


def merged_top(events: DataFrame, sections: tuple[str, ...] = ("ai_agents", "ai", "tech"), k: int = 5, score: str = "final_score", other: str | None = None, order: str = "event_id") -> DataFrame:
    """The best rows of several sections together, sections in the given order on ties.

    Rows without a positive score go by `other`, if given.
    """
    place = _by_section(F.col("section"), {s: F.lit(i) for i, s in enumerate(sections)}, F.lit(None).cast("int"))
    value = F.when(F.col(score) > 0, F.col(score)).otherwise(F.col(other) if other else F.lit(0.0))
    rows = events.where(F.col("section").isin(*sections)).withColumns({"_value": value, "_place": place})
    return rows.orderBy(F.desc("_value"), "_place", order).limit(k).drop("_value", "_place")


def chosen_events(events: DataFrame, k: int = 5, part: str = "category", score: str = "final_score", order: str = "event_id") -> DataFrame:
    """The events of each category that cards are written for, with their place.

    Scored events go by score; those without a positive one by their articles, then with a snippet first.
    """
    scored = F.coalesce(F.col(score), F.lit(0.0)) > 0
    first = F.when(scored, -F.col(score)).otherwise(-F.col("n_articles").cast("double"))
    bare = ~F.exists("snippets", lambda s: F.trim(F.coalesce(s, F.lit(""))) != "")
    w = Window.partitionBy(part).orderBy(first, F.when(scored, 0).otherwise(bare.cast("int")), order)
    return events.withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)


def headline(cards: DataFrame, count: int = 5, worth: Column | None = None) -> DataFrame:
    """The best cards over all sections: at most three of world and two of each other section, and two in all if there are two.

    Cards without a positive final_score go by `worth`, or by nothing. Where fewer than two are asked for, the
    first cards of the first sections fill up.
    """
    world = F.col("section") == "world"
    ranked = F.when(world, F.col("importance") + 0.1).otherwise(F.col("relevance") * 0.7 + F.col("importance") * 0.3)
    score = F.when(F.col("final_score") > 0, ranked).otherwise((F.lit(0.0) if worth is None else worth).cast("double"))
    place = _by_section(F.col("section"), {s: F.lit(k) for k, s in enumerate(fixed.SECTION_ORDER)}, F.lit(99))
    rows = cards.withColumn("headline_score", score).withColumn("_place", place).where("_place < 99")
    w = Window.partitionBy("section").orderBy(F.desc("headline_score"), "rank")
    capped = rows.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= F.when(world, 3).otherwise(2))
    best = capped.orderBy(F.desc("headline_score"), "_place", "rank").limit(count).drop("_r")
    if count < 2:
        others = rows.join(best.select("section", "rank"), ["section", "rank"], "left_anti")
        best = best.unionByName(others.orderBy("_place", "rank").limit(2 - count).select(best.columns))
    return best.drop("_place")
