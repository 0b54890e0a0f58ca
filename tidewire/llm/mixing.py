"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame operations only.

Every document of a source starts with the same expected number of copies
c = target / source size. floor(c) copies are certain; the fraction p = c - floor(c) is rounded
dependently: two documents i and j meet and move probability mass so that
size_i * p_i + size_j * p_j stays as it is until one of the two is 0 or 1. Which of the two
possible moves is made is random, with the chances that keep both expectations. What is left
fractional meets the next document. The sum of size * p of a source is thus kept exactly, and
its taken words end within one document of its target.

The meetings form a reduction tree: documents are dealt into salted buckets of about `fan`
documents, each bucket leaves at most one fractional document, and these are dealt again until a
source has one left, which one last draw decides. A level shuffles one narrow row per fractional
document; no source and no key ever comes together in one task.

Defined cases: null text has size 0 and is taken 0 times; an empty source has target 0; null
source is the last source; repeated rows are rounded one by one; an empty table gives no rows;
other columns of the input are ignored. Draws hash the ids of the two documents and a seed, so
reruns agree.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.shingles import columns, row_key
from tidewire.runtime import settle, unused

WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words of `text`, 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _ranked(per: DataFrame, rows: int = 1_000_000) -> DataFrame:
    """per with `rank`, the place of its source by code point, nulls last; ranges of sources are numbered apart."""
    order = F.col("source").asc_nulls_last()
    parts = max(1, -(-per.count() // rows))
    ranges = settle(per.repartitionByRange(parts, order).withColumn("range", F.spark_partition_id()))
    ranked = ranges.withColumn("rank", F.row_number().over(Window.partitionBy("range").orderBy(order)) - 1)
    counts = {r["range"]: r["n"] for r in ranges.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    before, offset = F.lit(0), 0
    for k in sorted(counts):
        before = F.when(F.col("range") == k, F.lit(offset)).otherwise(before)
        offset += counts[k]
    return ranked.withColumn("rank", F.col("rank") + before).drop("range")


def source_targets(sizes: DataFrame, weights: Sequence[float], share: float, most: float) -> DataFrame:
    """One row per source of (source, size): target words by weight, none above most * its size.

    Resharing the excess by weight until nothing is above is water filling: the target is
    min(cap, level * weight) for the one level at which the targets add up. The level rises from
    the one without caps, each time to what the sources below their cap share, until it stays.
    Sums are whole numbers of words, so the level does not depend on the order of rows.
    """
    per = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("m")).alias("source_size"), F.sum("m").alias("docs"))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = settle(_ranked(per).withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most))))
    whole = per.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    total = float(share) * (whole["words"] or 0)
    level, before = total / (whole["weight"] or 1.0), None
    while level != before:
        full = F.col("cap") <= F.lit(level) * F.col("weight")
        row = per.agg(F.sum(F.when(full, F.col("source_size"))).alias("capped"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        level, before = max(level, (total - float(most) * (row["capped"] or 0)) / row["open"]), level
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return per.select("source", "source_size", "docs", target.alias("target"))


def _draw(a: Column, b: Column, seed: int) -> Column:
    """A number in [0, 1) from two ids."""
    return F.shiftrightunsigned(F.xxhash64(a, b, F.lit(seed)), 11).cast("double") / F.lit(float(1 << 53))


def _meet(state: Column, item: Column, seed: int) -> Column:
    """One meeting of the fractional document carried so far with the next one."""
    wi, pi = state["w"].cast("double"), state["p"]
    wj, pj = item["w"].cast("double"), item["p"]
    up = F.least(wi * (F.lit(1.0) - pi), wj * pj)  # mass that can go to i
    down = F.least(wi * pi, wj * (F.lit(1.0) - pj))  # mass that can go to j
    plan = F.struct(
        up.alias("up"),
        down.alias("down"),
        (_draw(state["k"], item["k"], seed) * (up + down) < down).alias("to_i"),
    )

    def apply(t: Column) -> Column:
        moved = F.when(t["to_i"], t["up"]).otherwise(-t["down"])
        # who became integral: the one whose bound was reached; i on ties
        i_done = F.when(t["to_i"], wi * (1.0 - pi) <= wj * pj).otherwise(wi * pi <= wj * (1.0 - pj))
        x = F.when(i_done, t["to_i"]).otherwise(~t["to_i"]).cast("int")
        done = F.when(i_done, state["k"]).otherwise(item["k"])
        done_i = F.when(i_done, state["i"]).otherwise(item["i"])
        rest = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.when(i_done, pj - moved / wj).otherwise(pi + moved / wi)))
        return F.struct(
            F.when(i_done, item["k"]).otherwise(state["k"]).alias("k"),
            F.when(i_done, item["i"]).otherwise(state["i"]).alias("i"),
            F.when(i_done, item["w"]).otherwise(state["w"]).alias("w"),
            rest.alias("p"),
            F.array_append(state["out"], F.struct(done_i.alias("i"), x.alias("x"))).alias("out"),
        )

    return F.transform(F.array(plan), apply)[0]


def _round_buckets(units: DataFrame, fan: int, level: int, seed: int) -> DataFrame:
    """Reduce every bucket: its decided rows in `out`, its one fractional rest in k, i, w, p."""
    salt = F.pmod(F.xxhash64("k", F.lit(seed + 7919 * level)), F.greatest(F.ceil(F.col("n") / fan), F.lit(1)))
    one = F.struct(F.xxhash64("k", F.lit(seed)).alias("h"), "k", "i", "w", "p")
    rows = (
        units.withColumn("bucket", salt)
        .groupBy("source", "bucket")
        .agg(F.array_sort(F.collect_list(one)).alias("all"))
    )
    kind = "array<struct<i:struct<doc_id:bigint,size:bigint,_row:bigint>,x:int>>"
    head = F.col("all")[0]
    start = F.struct(head["k"].alias("k"), head["i"].alias("i"), head["w"].alias("w"), head["p"].alias("p"), F.array().cast(kind).alias("out"))
    folded = F.aggregate(F.expr("slice(all, 2, size(all))"), start, lambda s, e: _meet(s, e, seed + level))
    return rows.select("source", folded.alias("r")).select("source", "r.*")


def _numbered(sized: DataFrame, block: int = 8_192) -> DataFrame:
    """One row for each of the m equal rows, with its number _n; many are numbered by several tasks."""
    keys = ["doc_id", "source", "size", "_row"]
    once = sized.where("m = 1").select(*keys, F.lit(0).cast("long").alias("_n"))
    again = sized.where("m > 1").select(*keys, "m", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(m - 1) div {block}"))).alias("b"))
    again = again.repartition(F.xxhash64("doc_id", "size", "b"))
    first, last = F.col("b") * block, F.least(F.col("m"), (F.col("b") + 1) * block) - 1
    return once.unionByName(again.select(*keys, F.explode(F.sequence(first, last)).alias("_n")))


def mix(
    documents: DataFrame,
    weights: Sequence[float] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    fan: int = 128,
    seed: int = 20240229,
    row: str | None = None,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every document.

    `row` names a long column that tells rows of one doc_id apart; it comes back as _row.
    """
    mark = (F.col(row) if row else F.lit(None)).cast("long").alias("_row")
    sized = documents.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), word_count(F.col("text")).alias("size"), mark)
    sized = settle(sized.groupBy("doc_id", "source", "size", "_row").agg(F.count(F.lit(1)).alias("m")))
    targets = settle(source_targets(sized, weights, share, most))
    base = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    rate = F.least(base, F.lit(float(most)))
    # within rounding error of a whole number, a rate is that number
    targets = targets.withColumn("rate", F.when(F.abs(rate - F.round(rate)) < 1e-12, F.round(rate)).otherwise(rate))
    targets = targets.withColumn("sure", F.floor("rate").cast("int")).withColumn("p", F.col("rate") - F.floor("rate"))
    # a handful of numbers per source: joined by value, null sources included
    rated = _numbered(sized).alias("d").join(targets.alias("t"), F.expr("d.source <=> t.source")).select(
        "d.doc_id", "d.source", "d.size", "d._row", "d._n", "t.source_size", "t.target", "t.docs", "t.sure", "t.p"
    )
    units = rated.where("p > 0 and size > 0").select(
        "source",
        F.col("docs").alias("n"),
        F.when(F.col("_n") == 0, F.xxhash64(F.coalesce("doc_id", "_row"), "size")).otherwise(F.xxhash64(F.coalesce("doc_id", "_row"), "size", "_n")).alias("k"),
        F.struct("doc_id", "size", "_row").alias("i"),
        F.col("size").alias("w"),
        "p",
    )
    decided, level, fractional = [], 0, 2
    while fractional > 1:
        left = settle(_round_buckets(units, fan, level, seed))
        decided.append(left.select("source", F.explode("out").alias("o")).select("source", "o.i.doc_id", "o.i.size", "o.i._row", "o.x"))
        # every bucket leaves one row; the next level gathers those
        counts = left.groupBy("source").agg(F.count(F.lit(1)).alias("n"))
        units = left.drop("out").alias("l").join(counts.alias("c"), F.expr("l.source <=> c.source")).select("l.*", "c.n")
        fractional = counts.agg(F.max("n")).first()[0] or 0
        level += 1
    last = units.select("source", "i.doc_id", "i.size", "i._row", (_draw(F.col("k"), F.col("k"), seed - 1) < F.col("p")).cast("int").alias("x"))
    decided.append(last)
    whole = rated.where("p = 0 or size = 0").select("source", "doc_id", "size", "_row", F.lit(0).alias("x"))
    everything = whole
    for part in decided:
        everything = everything.unionByName(part)
    known = targets.select(F.col("source").alias("s"), "source_size", "target", "sure")
    copies = F.when(F.col("size") > 0, F.col("sure") + F.col("x")).otherwise(F.lit(0)).cast("int")
    return everything.join(known, F.expr("source <=> s")).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), *(["_row"] if row else [])
    )


def take(documents: DataFrame, few: int = 1_000_000, **options) -> DataFrame:
    """documents, each row as often as the mix takes it.

    Rows are told apart by a hash of all their columns, so a null or repeated doc_id merges none;
    only rows that are equal in everything come out as copies of one, as often as the mix takes all
    of them. The copies are sent out while they are few (three numbers a row), else joined.
    """
    row, key, times, again = (unused(documents, c) for c in ("_row", "_key", "_copies", "_k"))
    keyed = documents.withColumn(row, row_key(documents))
    copies = mix(keyed, row=row, **options).groupBy("_row").agg(F.sum("copies").alias(times), F.count(F.lit(1)).alias("_rows"))
    copies = settle(copies.withColumnRenamed("_row", key))
    state = copies.agg(F.count(F.lit(1)).alias("n"), F.max("_rows").alias("most")).first()
    if (state["most"] or 0) > 1:
        keyed = keyed.dropDuplicates([row])
    wanted = copies.where(F.col(times) > 0).select(key, times)
    if state["n"] <= few:
        wanted = F.broadcast(wanted)
    joined = keyed.join(wanted, F.col(row) == F.col(key))
    return joined.withColumn(again, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*columns(documents))
