"""Rows that only a map tells apart, documents of which nothing is left, and very long texts in the pipeline's stages."""

import corpus_pipeline
from pyspark.sql import functions as F

from tidewire.llm import mixing, shingles

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def test_rows_that_differ_in_a_map_are_rows_of_their_own(spark):
    rows = [(1, "some words here", {"a": k}, [{"b": {"c": k}}]) for k in range(3)] + [(1, "some words here", None, None)]
    some = spark.createDataFrame(rows, "doc_id long, text string, meta map<string,int>, deep array<map<string,map<string,int>>>").withColumn("source", F.lit("s"))
    keys = some.select(shingles.row_key(some).alias("k")).distinct()
    assert keys.count() == 4
    taken = mixing.take(some).collect()
    assert {r["meta"]["a"] if r["meta"] else None for r in taken} == {0, 1, 2, None} and 4 <= len(taken) <= 8


def test_maps_count_whatever_their_order(spark):
    two = spark.sql("SELECT map('a', 1, 'b', 2) AS m UNION ALL SELECT map('b', 2, 'a', 1) UNION ALL SELECT map('a', 1, 'b', NULL) UNION ALL SELECT map()")
    assert two.select(shingles.row_key(two).alias("k")).distinct().count() == 3


def test_documents_of_white_space_go(spark):
    long = "word " * 200_000
    rows = [(k, f"own text {k}\nthe notice", "en", f"s{k}", 1) for k in range(15)]
    rows += [(100, "the notice\n\n", "en", "s1", 1), (101, "the notice\n \t\n", "en", "s2", 1), (102, " \n", "en", "s3", 2), (103, f"{long}\nthe notice", "en", "s4", 1)]
    docs = spark.createDataFrame(rows, SCHEMA)
    left = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.drop_boilerplate(spark, docs, "").collect()}
    assert set(left) == {*range(15), 102, 103}  # a text that lost nothing stays as it is
    assert left[3] == ("own text 3", 10) and left[102] == (" \n", 2) and left[103] == (long, len(long))
