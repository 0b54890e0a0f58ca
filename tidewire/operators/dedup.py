"""Order-aware deduplication: the first of each group stays, as a loop over rows would decide."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.operators.components import connected_components
from tidewire.operators.history import within
from tidewire.runtime import settle


def first_by(df: DataFrame, keys: list[str], order: str = "seq") -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(order)
    return df.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def _sequential(rows: pd.DataFrame) -> pd.DataFrame:
    """The pass itself over the rows of one part, by the numbers of its ids."""
    seen, kept = set(), []
    for i, keys in rows.groupby("no", sort=True)["key"]:
        if seen.isdisjoint(keys):
            kept.append(i)
            seen.update(keys)
    return pd.DataFrame({"part": pd.Series([rows["part"].iloc[0]] * len(kept), dtype="int64"), "no": pd.Series(kept, dtype="int32")})


def _parts_of(open_: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """Ids kept in the connected parts of at most `most` rows, and the rows of larger ones."""
    least = open_.groupBy("key").agg(F.min("id").alias("least"))
    edges = open_.join(least, "key").select("id", "least").where("id <> least").distinct()
    found = connected_components(edges, "id", "least")
    # two parts of one hash are decided together, which changes nothing
    rows = settle(open_.join(found, F.col("id") == F.col("node"), "left").select("id", "key", F.xxhash64(F.coalesce("component", "id")).alias("part")))
    small = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= most).select("part")
    numbered = settle(rows.join(small, "part", "left_semi").withColumn("no", F.dense_rank().over(Window.partitionBy("part").orderBy("id"))))
    won = numbered.groupBy("part").applyInPandas(_sequential, "part long, no int")
    ids = numbered.select("part", "no", "id").distinct().join(won, ["part", "no"]).select("id")
    return settle(ids), settle(rows.join(small, "part", "left_anti").select("id", "key"))


def greedy_keep(marks: DataFrame, patience: int = 24, most: int = 1_000_000) -> DataFrame:
    """The ids a sequential pass keeps, given (id, key) rows.

    The pass goes through the ids in order and keeps one unless it shares a key with one kept
    before. Here, a round keeps every open id that is the least open id of all its keys, then
    drops the open ids that share a key with it. Work per round is linear in the rows, whatever
    the sizes of the groups; rounds are as many as the longest chain of decisions. What is still open
    after `patience` rounds hangs together in long chains: of that, each connected part of at most `most` rows is decided
    by the pass itself in one task, and larger parts go on in rounds, of which each decides at least one id of every part.
    """
    open_, kept, rounds = settle(marks.select("id", "key").distinct()), [], 0
    while open_.limit(1).count():
        if rounds == patience:
            won, open_ = _parts_of(open_, most)
            kept.append(won)
            rounds, patience = 0, 2 * patience
            continue
        rounds += 1
        least = open_.groupBy("key").agg(F.min("id").alias("least"))
        joined = open_.join(least, "key")
        won = settle(joined.groupBy("id").agg(F.min((F.col("id") == F.col("least")).cast("int")).alias("ok")).where("ok = 1").select("id"))
        kept.append(won)
        taken = open_.join(won, "id", "left_semi").select("key").distinct()
        lost = open_.join(taken, "key", "left_semi").select("id").distinct()
        open_ = settle(open_.join(lost, "id", "left_anti"))
    return reduce(DataFrame.unionByName, kept) if kept else marks.select("id").limit(0)


def batch_dedup(articles: DataFrame) -> DataFrame:
    """Articles that no earlier kept one matches in url or in non-empty normalised title, per category."""
    title = T.normalize_title(F.col("title"))
    keys = F.array_compact(
        F.array(F.concat_ws("|", F.lit("u"), "category", T.strip(F.coalesce("url", F.lit("")))), F.when(title != "", F.concat_ws("|", F.lit("t"), "category", title)))
    )
    marks = articles.select(F.col("seq").alias("id"), F.explode(keys).alias("key"))
    return articles.join(greedy_keep(marks), F.col("seq") == F.col("id"), "left_semi")


def simhash_pairs(articles: DataFrame, below: int = 4) -> DataFrame:
    """Pairs a < b of a category whose SimHashes differ in fewer than `below` bits, between classes.

    Rows of one hash are a class: each is paired with the first of them only, and only the first ones
    are paired with other classes. The hash is cut into twice `below` - 2 bands; of these, `below` - 1
    are equal in all bits whatever the others hold, so candidates come from an equi-join on
    each choice of that many bands and none is lost. The planner takes no notice of how many keys a row has, so
    the join is told not to send one side through the driver.
    """
    h = settle(articles.select("category", "seq", T.simhash(F.concat_ws(" ", "title", F.substring("snippet", 1, 200))).alias("h")))
    first = settle(h.groupBy("category", "h").agg(F.min("seq").alias("seq")))
    same = h.join(first.withColumnRenamed("seq", "a").hint("merge"), ["category", "h"]).where("a < seq").select("category", "a", F.col("seq").alias("b"), F.lit(0).alias("bits"))
    parts = 2 * (below - 1)
    edges = [round(64 * k / parts) for k in range(parts + 1)]
    masks = [sum(1 << bit for bit in range(a, z)) for a, z in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >= 1 << 63 else m
    keys = [F.col("h").bitwiseAND(F.lit(signed(sum(masks[i] for i in some)))) for some in combinations(range(parts), below - 1)]
    b = first.select("category", "seq", "h", F.posexplode(F.array(*keys)).alias("i", "v"))
    x = b.select("category", "i", "v", F.col("seq").alias("a"), F.col("h").alias("ha"))
    y = b.select("category", "i", "v", F.col("seq").alias("b"), F.col("h").alias("hb"))
    near = T.hamming(F.col("ha"), F.col("hb"))
    other = x.join(y.hint("merge"), ["category", "i", "v"]).where("a < b").where(near < below).select("category", "a", "b", near.cast("int").alias("bits")).distinct()
    return other.unionByName(same)


def fuzzy_batch_dedup(articles: DataFrame, below: int = 4, more_than: int = 50) -> DataFrame:
    """batch_dedup, then near copies by SimHash in categories with more than 50 rows left."""
    exact = settle(batch_dedup(articles))
    big = exact.groupBy("category").count().where(F.col("count") > more_than).select("category")
    pairs = settle(simhash_pairs(exact.join(big, "category", "left_semi"), below))
    # of a class only the first row can stay: what drops it is close to the others too
    again = pairs.where("bits = 0").select(F.col("b").alias("id"))
    ends = pairs.where("bits > 0").select(F.explode(F.array("a", "b")).alias("id"), F.concat_ws("-", "a", "b").alias("key"))
    near = settle(ends)
    kept = greedy_keep(near)
    lost = near.select("id").distinct().join(kept, "id", "left_anti").unionByName(again)
    return exact.join(lost, F.col("seq") == F.col("id"), "left_anti")


def not_in_history(articles: DataFrame, history: DataFrame, as_of: str | None = None, days: int = 7, at: str = "digest_date") -> DataFrame:
    """Articles whose url hash is not among the past ones; with as_of, among those of the last days up to it."""
    if as_of is not None:
        history = within(history, at, as_of, days)
    own = articles.withColumn("url_hash", T.url_hash(F.col("title"), F.col("url")))
    return own.join(history.select("url_hash").distinct(), "url_hash", "left_anti")


def fetch_all(*parts: tuple[DataFrame, int]) -> DataFrame:
    """Union of per-type scans, each limited per category, then the first of each exact url."""
    out = None
    for df, limit in parts:
        w = Window.partitionBy("category", "source").orderBy("seq")
        some = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= limit).drop("_r")
        out = some if out is None else out.unionByName(some)
    return first_by(out, ["category", "url"])
