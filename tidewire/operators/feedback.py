"""Feedback aggregates and what is learned from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import fixed
from tidewire.functions import text as T


def normal_rating(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low == "mute", "blocked").when(low == "save", "saved").otherwise(low)


def since(df: DataFrame, as_of: str, days: int, column: str = "created_at") -> DataFrame:
    """Rows of the last `days` days before as_of."""
    return df.where(F.col(column) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))


def _counts(rating: Column) -> list[Column]:
    return [F.count_if(rating == r).alias(n) for r, n in (("up", "up"), ("down", "down"), ("blocked", "blocked"), ("saved", "saved"))]


def source_stats(feedback: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Counts, total and clamped score (to four places) of every source; unknown ratings only create the row."""
    name = F.trim(F.coalesce("source", F.lit("")))
    rows = since(feedback, as_of, days).withColumn("source", F.when(name == "", "unknown").otherwise(name))
    out = rows.groupBy("source").agg(*_counts(normal_rating(F.col("rating"))))
    total = F.col("up") + F.col("down") + F.col("blocked") + F.col("saved")
    raw = (F.col("up") + F.col("saved") - F.col("down") - 2 * F.col("blocked")) / F.col("total")
    score = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), raw))
    return out.withColumn("total", total).withColumn("score", F.when(F.col("total") > 0, F.rint(score * 10000) / 10000).otherwise(0.0))


def source_ratings(feedback: DataFrame, as_of: str, days: int = 30) -> DataFrame:
    """Unclamped score without saved; sources with unknown ratings only don't appear."""
    rating = normal_rating(F.col("rating"))
    rows = since(feedback, as_of, days).where(rating.isin("up", "down", "blocked", "saved"))
    out = rows.groupBy(F.trim("source").alias("source")).agg(*_counts(rating))
    total = F.col("up") + F.col("down") + F.col("blocked") + F.col("saved")
    return out.withColumn("total", total).withColumn("score", (F.col("up") - F.col("down") - 2 * F.col("blocked")) / F.greatest("total", F.lit(1)))


def top_sources(ratings: DataFrame, least: int = 5, score: float = 0.5) -> DataFrame:
    return ratings.where((F.col("total") >= least) & (F.col("score") > score)).orderBy(F.desc("score"), "source")


def blocked_sources(ratings: DataFrame, least: int = 3) -> DataFrame:
    return ratings.where(F.col("blocked") >= least).select("source", "blocked")


def user_pivot(feedback: DataFrame, as_of: str, days: int = 7) -> DataFrame:
    r = normal_rating(F.col("rating"))
    out = since(feedback, as_of, days).groupBy("user_id").agg(*_counts(r))
    return out.withColumn("total", F.col("up") + F.col("down") + F.col("blocked") + F.col("saved"))


def boosts(stats: DataFrame, least: int = 10) -> DataFrame:
    s = F.col("score")
    return stats.withColumn("boost", F.when(F.col("total") < least, 1.0).when(s > 0.3, 1.5).when(s < -0.3, 0.5).otherwise(1.0))


def suggestions(ratings: DataFrame) -> DataFrame:
    """Sources to boost and by how much (to three places), and sources to remove, each with its reason."""
    s = F.col("score")
    by = F.least(F.lit(0.5), F.lit(0.2) + F.lit(0.1) * (s - 0.5) * 2)
    two = lambda c: F.format_string("%.2f", F.bround(c, 2))
    why = F.concat("source", F.lit(": "), "up", F.lit(" 👍 / "), "down", F.lit(" 👎, score="), two(s), F.lit(" → boost +"), two(by))
    up = ratings.where((F.col("total") >= 5) & (s > 0.5)).select("source", F.lit("boost").alias("action"), (F.rint(by * 1000) / 1000).alias("by"), why.alias("reason"))
    gone = F.concat("source", F.lit(": "), "blocked", F.lit(" 🔕 — candidate for removal"))
    return up.unionByName(ratings.where("blocked >= 3").select("source", F.lit("remove").alias("action"), F.lit(0.0).alias("by"), gone.alias("reason")))


def window_stats(runs: DataFrame, feedback: DataFrame, digests: DataFrame, as_of: str, days: int = 7, k: int = 5) -> DataFrame:
    """One row for the last days: digests, their items, mean seconds of runs (zeros left out), reactions and the k most liked sources.

    digests: created_at and item_count. Likes count as "source:likes", the most first, then the one liked first.
    """
    recent = lambda rows, at: rows.where(F.col(at) >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {days} DAYS"))
    some = recent(digests, "created_at").agg(F.count(F.lit(1)).alias("digest_count"), F.coalesce(F.sum("item_count"), F.lit(0)).cast("long").alias("total_items"))
    long = recent(runs, "started_at").agg(F.coalesce(F.avg(F.when(F.col("duration_sec") != 0, F.col("duration_sec"))), F.lit(0.0)).alias("mean_sec"))
    ratings = recent(feedback, "created_at").select("id", F.trim(F.coalesce("rating", F.lit(""))).alias("r"), F.coalesce("source", F.lit("")).alias("source"))
    total = ratings.where("r <> ''").agg(F.count(F.lit(1)).alias("total_reactions"))
    liked = ratings.where(F.col("r").isin("like", "👍") & (F.col("source") != "")).groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    top = liked.orderBy(F.desc("n"), "first").limit(k)
    top = top.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("m"), "first", "source"))), lambda x: F.concat(x["source"], F.lit(":"), -x["m"])), ",").alias("top_sources"))
    return some.join(long).join(total).join(top)  # four single rows


def negative_keywords(feedback: DataFrame, as_of: str, days: int = 30, k: int = 5, least: int = 2) -> DataFrame:
    """Most frequent words of disliked urls and sources; ties by first appearance."""
    bad = since(feedback, as_of, days).where(F.lower("rating").isin("down", "mute", "blocked"))
    text = F.lower(F.concat_ws(" ", "article_url", "source"))
    words = bad.select("id", F.posexplode(F.regexp_extract_all(text, F.lit("[а-яёa-z]{4,}"), 0)).alias("pos", "word"))
    counted = words.where(~F.col("word").isin(fixed.FEEDBACK_STOPS)).groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("id", "pos")).alias("first"))
    return counted.orderBy(F.desc("n"), "first").limit(k).where(F.col("n") >= least).select("word", "n")


def learning_report(boosted: DataFrame) -> DataFrame:
    """One row: the boosted and the demoted sources in order."""
    pick = lambda cond: F.array_join(F.array_sort(F.collect_list(F.when(cond, F.col("source")))), ",")
    return boosted.agg(pick(F.col("boost") > 1).alias("boosted"), pick(F.col("boost") < 1).alias("demoted"))


def source_health(articles: DataFrame, as_of: str, days: int = 14, least: int = 3) -> DataFrame:
    out = since(articles, as_of, days, "published_at").groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.max("published_at").alias("last_seen"))
    return out.withColumn("healthy", F.col("n") >= least)


def unhealthy(configured: DataFrame, health: DataFrame, least: int = 3) -> DataFrame:
    """Configured sources with too few articles; those without any count 0."""
    joined = configured.join(health.select("source", "n"), "source", "left")
    return joined.select("source", F.coalesce("n", F.lit(0)).alias("n")).where(F.col("n") < least)


def dead_source_lines(bad: DataFrame, k: int = 20) -> DataFrame:
    """One row: the first k unhealthy sources as text lines."""
    rows = bad.orderBy("source").limit(k)
    lines = F.array_sort(F.collect_list(F.concat(F.lit("- "), F.col("source"), F.lit(": "), F.col("n").cast("string"))))
    return rows.agg(F.array_join(lines, "\n").alias("message"))


def run_stats(runs: DataFrame) -> DataFrame:
    """Per status: runs, mean duration without zeros (in thousandths), model calls."""
    long = F.avg(F.when(F.col("duration_sec") != 0, F.col("duration_sec")))
    return runs.groupBy("status").agg(F.count(F.lit(1)).alias("n"), F.floor(long * 1000 + 0.5).cast("long").alias("mean_ms"), F.sum("llm_calls").alias("calls"))


def last_run(runs: DataFrame) -> DataFrame:
    return runs.agg(F.max_by(F.struct("id", "started_at", "status"), F.struct("started_at", "id")).alias("r")).select("r.*")


def build_minutes(runs: DataFrame, as_of: str, provider: str = "groq", override: int | None = None, newest: int = 14) -> DataFrame:
    """Minutes to allow for a build: the override, or recent runs times a factor, or the default."""
    clamp = lambda c: F.greatest(F.lit(fixed.BUILD_LEAST), F.least(F.lit(fixed.BUILD_MOST), c))
    recent = runs.where("status = 'ok'").orderBy(F.desc("started_at"), F.desc("id")).limit(newest).where("duration_sec <> 0")
    ranked = recent.withColumn("r", F.row_number().over(Window.orderBy(F.desc("started_at"), F.desc("id"))))
    rolled = ranked.agg(F.count(F.lit(1)).alias("n"), (F.sum(F.when(F.col("r") <= fixed.BUILD_SAMPLES, F.col("duration_sec"))) / fixed.BUILD_SAMPLES / 60).alias("minutes"))
    history = F.when(F.col("n") >= fixed.BUILD_SAMPLES, clamp(F.bround(F.col("minutes") * fixed.BUILD_FACTOR, 0).cast("int")))
    given = F.lit(override).cast("int")
    return rolled.select("n", F.coalesce(clamp(given) if override is not None else given, history, F.lit(fixed.BUILD_MINUTES.get(provider, fixed.BUILD_OTHER))).cast("int").alias("buffer_minutes"))


def rating_counts(feedback: DataFrame) -> DataFrame:
    """Stored ratings and how often each stands there."""
    return feedback.groupBy("rating").agg(F.count(F.lit(1)).alias("n"))


def digest_totals(days: DataFrame, large: int = 20) -> DataFrame:
    """One row of counts from the items of each digest: digests, items, digests of more than `large` items."""
    return days.agg(F.count(F.lit(1)).alias("digests"), F.sum("n").alias("items"), F.count_if(F.col("n") > large).alias("large"))


def recent_minutes(runs: DataFrame, days: int = 7) -> DataFrame:
    """Mean minutes (in tenths) of the successful runs of the last days before the newest run, zeros left out."""
    newest = runs.agg(F.max("started_at").alias("newest"))
    rows = runs.where("status = 'ok'").join(F.broadcast(newest)).where(f"started_at >= newest - INTERVAL {days} DAYS")
    return rows.agg(F.floor(F.avg(F.when(F.col("duration_sec") != 0, F.col("duration_sec"))) / 60 * 10 + 0.5).cast("long").alias("tenth_minutes"))


def apply_learning(topics: DataFrame, found: DataFrame, words: DataFrame) -> DataFrame:
    """Topics (topic, blacklist, sources map) after learning: words to avoid added once, sources to remove left out.

    found: suggestions (source, action); words: (word). Both are short lists by their own limits.
    """
    gone = found.where("action = 'remove'").agg(F.collect_set("source").alias("_gone"))
    more = words.agg(F.sort_array(F.collect_set("word")).alias("_more"))
    rows = topics.join(F.broadcast(gone)).join(F.broadcast(more))
    kept = F.map_filter("sources", lambda k, v: ~F.array_contains(F.col("_gone"), k))
    return rows.withColumns({"blacklist": T.ordered_union(F.col("blacklist"), F.col("_more")), "sources": kept}).drop("_gone", "_more")
