"""Decoding of character references against the standard library."""

import html
import os
import random
from html.entities import html5

import pytest
from pyspark.sql import functions as F

from tidewire.functions import text as T
from tidewire.plans import registry

SF = "/root/testdata/sf0.001"


def test_unescape_is_the_standard_one(spark):
    rng = random.Random(3)
    pieces = [f"&{n}" for n in html5] + [f"&#{k};" for k in (0, 1, 9, 11, 13, 31, 65, 127, 128, 129, 150, 159, 160, 8364, 55296, 64976, 65534, 65535, 131070, 1114111, 1114112, 10**12, 10**30)]
    pieces += [f"&#x{k:x}" for k in (0, 0x41, 0x80, 0x20AC, 0xD800, 0x1F600, 0x10FFFF, 0x110000, 16**20)] + ["&#X41;", "&#0000065;", "&#x00000041;"]
    pieces += ["&notit;", "&notin", "&ampx", "&amp;amp;", "&AMP", "&unknown;", "&", "& ", "&&", "&;", "&#;", "&#x;", "&#xg;", "&a b;", "&copy2024", "&CounterClockwiseContourIntegral", "&" + "x" * 50 + ";", "plain", "ü", "\n", "&lt;&gt", "1 < 2 & 3"]
    texts = [*pieces, "", *("".join(rng.choices(pieces, k=12)) for _ in range(400))]
    rows = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(-1, None)], "id int, t string").repartition(4)
    got = {r["id"]: r["u"] for r in rows.select("id", T.unescape_html(F.col("t")).alias("u")).collect()}
    assert got.pop(-1) is None
    wrong = [(t, got[k], html.unescape(t)) for k, t in enumerate(texts) if got[k] != html.unescape(t)]
    assert not wrong


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_pages(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    import re

    got = {r["page_id"]: r["text"] for r in registry.QUERIES["page_text"](spark, SF).collect()}
    assert got == {k: html.unescape(re.sub("<[^>]+>", " ", v or "")) for k, v in pages.items()}
