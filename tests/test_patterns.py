"""Pattern tables against the plain filter and against expressions of the standard library."""

import random
import re

from pyspark.sql import functions as F

from tidewire.operators import filters, patterns


def plain(text, pattern):
    def one(word):
        if len(word) < 2:
            return False
        if word.endswith("*"):
            return re.search(r"\b" + re.escape(word[:-1]), text) is not None
        return re.search(r"\b" + re.escape(word) + r"\b", text) is not None

    words = pattern.lower().split()
    return bool(words) and all(map(one, words))


def test_matches(spark):
    rng = random.Random(2)
    vocabulary = ["trump", "trumpet", "trumpism", "ai", "agents", "gpt-4", "gpt", "4", "c++", "the", "the", "the", "über", "crypto", "cryptocurrency", "x", "don't", "a_b", "привет", "++"]
    texts = [(k, rng.choice([" ", ", ", "\n"]).join(rng.choice([str.lower, str.title])(rng.choice(vocabulary)) for _ in range(rng.randrange(0, 12)))) for k in range(400)] + [(900, None), (901, "")]
    asked = [*vocabulary, "trump*", "crypto*", "the trump*", "ai agents", "THE AI", "gpt-*", "gpt*", "x y", "", "  ", "t*", "*", "**", "über*", "don't*", "++*", "no such", "c++ gpt-4"]
    got = {tuple(r) for r in patterns.matches(spark.createDataFrame(texts, "id long, text string").repartition(3), "id", F.col("text"), spark.createDataFrame(list(enumerate(asked)), "pattern_id int, pattern string")).collect()}
    want = {(k, p) for k, t in texts if t is not None for p, a in enumerate(asked) if plain(t.lower(), a)}
    assert got == want and len({p for _, p in got}) > 20


def test_ten_thousand_topics_are_the_plain_filter(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(3000)}"
    topics = [" ".join(word() + rng.choice(["", "", "*"]) for _ in range(rng.choice([1, 2, 3]))) for _ in range(10_000)]
    texts = spark.createDataFrame([(k, " ".join([word() for _ in range(12)] + ["the"])) for k in range(60)], "id long, text string")
    table = spark.createDataFrame([(k, t) for k, t in enumerate([*topics, "the"[:0]])], "pattern_id long, pattern string")
    got = {tuple(r) for r in patterns.matches(texts, "id", F.col("text"), table).collect()}
    assert got == {(r["id"], k) for r in texts.collect() for k, t in enumerate(topics) if plain(r["text"], t)}
    some = table.where("pattern_id % 500 = 0")  # as many as fit into a plan
    left = {r["id"] for r in patterns.without_matches(texts, "id", F.col("text"), some).collect()}
    assert left == {r["id"] for r in filters.drop_blacklisted(texts, F.col("text"), [r["pattern"] for r in some.collect()]).collect()}
    assert patterns.matches(texts, "id", F.col("text"), table.limit(0)).count() == 0
