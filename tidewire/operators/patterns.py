"""Very many word patterns over very many texts, by a table of patterns and an index of tokens.

A pattern is a topic of one or more words, as in filters.blacklisted: it fits a text that holds all of
them, "word*" being a beginning, in any case; words of one letter never fit. Patterns are rows, not part of the
plan: each one is looked up by the word that the fewest texts have, and only the texts with that word are
tested for its other words. So a common word brings no pairs unless a pattern has nothing rarer.

A text's tokens are its words (letters, digits and _) and its other signs one by one. A word without such signs
fits exactly the texts with that token; a beginning is looked up among the beginnings of tokens, of the
lengths that patterns have. Words with signs in them ("gpt-4") are looked up by a part and then tested as
expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.runtime import settle

_TOKENS = r"(?U)\w+|[^\w\s]"


def _words(patterns: DataFrame) -> DataFrame:
    """(pattern_id, n, word, begins, key): every distinct word of each pattern, with the token that finds it."""
    words = F.array_distinct(F.filter(F.split(F.lower("pattern"), r"(?U)\s+"), lambda w: w != ""))
    rows = patterns.select("pattern_id", words.alias("ws")).where(F.size("ws") > 0).where(~F.exists("ws", lambda w: F.length(w) < 2))
    rows = rows.select("pattern_id", F.size("ws").alias("n"), F.explode("ws").alias("word"))
    core = F.when(F.col("word").endswith("*"), F.expr("substring(word, 1, length(word) - 1)")).otherwise(F.col("word"))
    parts = F.regexp_extract_all(core, F.lit(_TOKENS), 0)
    rows = rows.withColumn("core", core).withColumn("parts", parts)
    # the last part of a beginning may go on in the text, the others are whole tokens
    open_ = F.col("word").endswith("*") & F.element_at("parts", -1).rlike(r"(?U)^\w")
    rows = rows.withColumn("begins", open_ & (F.size("parts") == 1))
    whole = F.when(open_, F.expr("slice(parts, 1, size(parts) - 1)")).otherwise(F.col("parts"))
    longest = F.array_sort(F.transform(whole, lambda p: F.struct((-F.length(p)).alias("l"), p.alias("p"))))[0]["p"]
    return rows.withColumn("key", F.when(F.col("begins"), F.col("core")).otherwise(longest)).select("pattern_id", "n", "word", "begins", "key", (F.size("parts") == 1).alias("exact"))


def _expression(word: Column) -> Column:
    """The word as an expression with edges, a beginning without the second one."""
    quoted = F.concat(F.lit("\\Q"), F.replace(F.regexp_replace(word, r"\*$", ""), F.lit("\\E"), F.lit("\\E\\\\E\\Q")), F.lit("\\E"))
    return F.concat(F.lit(r"(?U)\b"), quoted, F.when(word.endswith("*"), F.lit("")).otherwise(F.lit(r"\b")))


def matches(texts: DataFrame, key: str, text: Column, patterns: DataFrame) -> DataFrame:
    """Distinct (key, pattern_id) of all patterns (pattern_id, pattern) that fit a text. Keys tell the texts apart."""
    words = settle(_words(patterns))
    rows = texts.select(F.col(key).alias("_key"), F.lower(text).alias("_text")).where(F.col("_text").isNotNull())
    lengths = sorted(r["n"] for r in words.where("begins").select(F.length("key").alias("n")).distinct().collect())  # bounded by the longest word
    tokens = F.array_distinct(F.regexp_extract_all("_text", F.lit(_TOKENS), 0))
    entry = lambda begins: lambda t: F.struct(F.lit(begins).alias("begins"), t.alias("key"))
    every = F.transform("_tokens", entry(False))
    for n in lengths:
        longer = F.filter("_tokens", lambda t: F.length(t) >= n)  # noqa: B023
        every = F.concat(every, F.transform(F.array_distinct(F.transform(longer, lambda t: F.substring(t, 1, n))), entry(True)))  # noqa: B023
    entries = rows.select("_key", tokens.alias("_tokens")).select("_key", F.explode(every).alias("e")).select("_key", "e.begins", "e.key")
    # only tokens that some pattern asks for
    entries = settle(entries.join(words.select("begins", "key").distinct(), ["begins", "key"], "left_semi"))
    counts = entries.groupBy("begins", "key").agg(F.count(F.lit(1)).alias("texts"))
    place = F.row_number().over(Window.partitionBy("pattern_id").orderBy("texts", "begins", "key", "word"))
    known = words.join(counts, ["begins", "key"])  # a pattern of which no text has some word ends here
    whole = known.groupBy("pattern_id").agg(F.count(F.lit(1)).alias("have"), F.any_value("n").alias("n")).where("have = n").select("pattern_id")
    ordered = known.join(whole, "pattern_id", "left_semi").withColumn("place", place)
    rarest = ordered.where("place = 1").select("pattern_id", "begins", "key")
    # what is left to test: the other words, and the first one if it was found by a part of it
    rest = ordered.where("place > 1 OR NOT exact").groupBy("pattern_id").agg(F.collect_list(_expression(F.col("word"))).alias("rest"))
    found = entries.join(rarest, ["begins", "key"]).select("_key", "pattern_id").join(rest, "pattern_id", "left")
    sure = found.where("rest IS NULL").select("_key", "pattern_id")
    tested = found.where("rest IS NOT NULL").join(rows, "_key").where(F.forall("rest", lambda r: F.regexp("_text", r))).select("_key", "pattern_id")
    return sure.unionByName(tested).select(F.col("_key").alias(key), "pattern_id")


def without_matches(texts: DataFrame, key: str, text: Column, patterns: DataFrame) -> DataFrame:
    """The texts that no pattern fits."""
    return texts.join(matches(texts, key, text, patterns).select(key).distinct(), key, "left_anti")
