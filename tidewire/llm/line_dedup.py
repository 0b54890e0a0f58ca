"""Cross-site boilerplate lines by their distinct-site spread.

A line (trimmed) is boilerplate when it stands on at least `min_sites` distinct sites. The spread is a
HyperLogLog sketch per line hash, built map-side and merged by aggregation; lines whose estimate comes
within `band` of the threshold get exact distinct counts. Sketches are only built for lines with at
least min_sites occurrences, since rarer lines can't have that many sites.

A text that stands word for word on many sites is a copy rather than boilerplate, and copies are the
business of the near-duplicate operators. So each different text votes once, for one of its sites: sites
are counted over whole-text digests, each with the least of its site numbers. Nothing else about a text
matters, whatever share of it a line takes. Boilerplate is removed from every document; other lines, blank
ones included, stay as they are and in order.

The texts are split and hashed once for all counts; the narrow rows are written, and each step reads
those of its lines only.

Defined cases: null text stays null, has no lines and loses none; a null source is a site of its own;
repeated rows are one text, and each is a document; a text of any length is one row of one
task; empty tables give no rows; extra columns pass through, whatever their names (but n_lines and
n_removed, which are set).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.runtime import drop, settle, unused

MIN_SITES = 10
BROADCAST_LINES = 200_000  # 64-bit hashes; more than that are joined by a shuffle
INLINE_LINES = 5_000  # hashes that go into the plan as a set; more are joined


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """Hash of the trimmed line, null for a blank one."""
    bare = F.trim(F.when(line.contains("\t") | line.contains("\r"), F.translate(line, "\t\r", "  ")).otherwise(line))
    return F.when(bare != "", F.xxhash64(bare))


def _few(keys: DataFrame) -> DataFrame:
    return F.broadcast(keys) if keys.count() <= BROADCAST_LINES else keys


def wide_lines(seen: DataFrame, min_sites: int, lg_k: int, band: float) -> DataFrame:
    """The line_key of lines on at least min_sites distinct sites."""
    sketches = settle(seen.groupBy("line_key").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(lg_k))).alias("sites")))
    under, over = min_sites * (1 - band) - 1, min_sites * (1 + band) + 1
    near = sketches.where((F.col("sites") >= under) & (F.col("sites") <= over)).select("line_key")
    # distinct pairs first, so a line on very many rows is pre-aggregated before any shuffle
    pairs = seen.join(_few(near), "line_key", "left_semi").select("line_key", "site").distinct()
    exact = pairs.groupBy("line_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("line_key")
    found = settle(sketches.where(F.col("sites") > over).select("line_key").unionByName(exact))
    drop(sketches)
    return found


def site_number(source: Column) -> Column:
    """A site as a number: the first 60 bits of its MD5, -1 for null."""
    return F.coalesce(F.conv(F.substring(F.md5(source.cast("string")), 1, 15), 16, 10).cast("long"), F.lit(-1))


def boilerplate_lines(documents: DataFrame, min_sites: int = MIN_SITES, lg_k: int = 12, band: float = 0.1) -> DataFrame:
    """One settled column, line_key: the hashes of the boilerplate lines."""
    text = F.col("text").cast("string")
    cut = documents.where(F.col("text").isNotNull()).select(site_number(F.col("source")).alias("site"), F.xxhash64(text).alias("digest"), _lines(text).alias("lines"))
    each = cut.select("site", "digest", F.explode("lines").alias("line"))
    seen = settle(each.select("site", "digest", _key(F.col("line")).alias("line_key")).where("line_key is not null"))
    often = settle(seen.groupBy("line_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_sites).select("line_key"))
    some = seen.join(_few(often), "line_key", "left_semi")
    votes = settle(some.groupBy("line_key", "digest").agg(F.min("site").alias("site")))
    found = wide_lines(votes, min_sites, lg_k, band)
    drop(seen, often, votes)
    return found


def remove_lines(documents: DataFrame, boilerplate: DataFrame) -> DataFrame:
    """documents with text without the boilerplate lines, and n_lines and n_removed.

    A bounded number of hashes goes into the plan; more are joined to the hashes of the lines, and
    the positions to drop come back by a hash of the text.
    """
    keys = [r[0] for r in boilerplate.limit(INLINE_LINES + 1).collect()]
    every, kept_lines, row, dropped, at = (unused(documents, c) for c in ("_all", "_kept", "_text_key", "_dropped", "_at"))
    text = F.col("text").cast("string")
    lines = _lines(text)
    if len(keys) <= INLINE_LINES:
        # a bounded set of hashes: decided inside each row, without any shuffle
        keep = (lambda x: ~F.coalesce(_key(x).isin(keys), F.lit(False))) if keys else (lambda x: F.lit(True))
        kept = documents.withColumn(every, F.size(lines)).withColumn(kept_lines, F.filter(lines, keep))
    else:
        ids = documents.select(F.xxhash64(text).alias(row), F.posexplode(lines).alias(at, "line")).select(row, at, _key(F.col("line")).alias("line_key"))
        gone = ids.join(boilerplate, "line_key", "left_semi").groupBy(row).agg(F.collect_set(at).alias(dropped))
        joined = documents.withColumn(row, F.xxhash64(text)).join(gone, row, "left")
        kept = joined.withColumn(every, F.size(lines)).withColumn(
            kept_lines, F.filter(lines, lambda x, i: ~F.coalesce(F.array_contains(F.col(dropped), i), F.lit(False)))
        ).drop(dropped, row)
    none = F.col("text").isNull()
    return (
        kept.withColumn("n_lines", F.when(none, 0).otherwise(F.col(every)).cast("long"))
        .withColumn("n_removed", F.when(none, 0).otherwise(F.col(every) - F.size(kept_lines)).cast("long"))
        .withColumn("text", F.array_join(kept_lines, "\n"))
        .drop(every, kept_lines)
    )


def dedup_lines(documents: DataFrame, min_sites: int = MIN_SITES) -> DataFrame:
    """documents without cross-site boilerplate lines; adds n_lines and n_removed."""
    return remove_lines(documents, boilerplate_lines(documents, min_sites))
