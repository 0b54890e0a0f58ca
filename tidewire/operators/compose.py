"""Cards, digest sections and message parts."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewire.functions import fixed
from tidewire.functions import text as T
from tidewire.operators import filters, rank

ITEM_BREAK = "\n\n· · ·\n\n"
SECTION_BREAK = "\n\n\n"


def fallback_cards(events: DataFrame) -> DataFrame:
    """Cards made of the events' own snippets."""
    joined = F.array_join(F.filter("snippets", lambda s: s != ""), " ")
    return events.withColumns(
        {"title": F.col("canonical_title"), "summary": F.when(joined != "", F.substring(joined, 1, 600)).otherwise(F.col("canonical_title")), "llm_used": F.lit(False)}
    )


def links_line(shown: Column, most: int = 3) -> Column:
    """Links to sources, an array of structs url and domain with distinct domains; null without any."""
    link = lambda x: F.concat(F.lit('<a href="'), T.escape_html(x["url"]), F.lit('">'), T.escape_html(x["domain"]), F.lit("</a>"))
    return F.when(F.size(shown) > 0, F.concat(F.lit(fixed.LINKS_SIGN), F.array_join(F.transform(F.slice(shown, 1, most), link), " · ")))


def _line(value: Column, before: str = "", after: str = "") -> Column:
    """A line of a card, null if there is nothing to say."""
    return F.when(F.coalesce(value, F.lit("")) != "", F.concat(F.lit(before), T.escape_html(value), F.lit(after)))


def card_text(title: Column, summary: Column, why: Column, shown: Column, style: str = "medium", take: Column | None = None, area: Column | None = None) -> Column:
    """One card; absent parts leave no line. shown: the finished line of links, null or empty without any.

    brief has the first sentence only, detailed also what the editors say; cards on agents have an area.
    """
    links = F.when(F.coalesce(shown, F.lit("")) != "", shown)
    lines = [F.concat(F.lit("<b>"), T.escape_html(title), F.lit("</b>"))]
    if style == "brief":
        return F.concat_ws("\n", *lines, _line(T.first_sentence(summary, 160)), links)
    lines += [_line(summary), _line(why, *fixed.WHY_LINE)]
    if style == "detailed" and take is not None:
        lines.append(_line(take, fixed.TAKE_LINE))
    if area is not None:
        lines.append(_line(area, fixed.AREA_LINE))
    return F.concat_ws("\n", *lines, links)


def agent_card(title: Column, summary: Column, why: Column, area: Column, shown: Column) -> Column:
    """A card on agents, the same in every style."""
    return card_text(title, summary, why, shown, area=area)


def bullet(title: Column, summary: Column) -> Column:
    """One line: the title, and the first sentence unless it says the same."""
    first = T.first_sentence(summary)
    bare = lambda c: F.regexp_replace(c, "[.!?]+$", "")
    says = (F.coalesce(first, F.lit("")) != "") & (bare(first) != bare(title))
    return F.concat(F.lit("• <b>"), T.escape_html(title), F.lit("</b>"), F.when(says, F.concat(F.lit(" — "), T.escape_html(first))).otherwise(""))


def _joined(order: str, value: str, by: str) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, value))), lambda x: x[value]), by)


def bullet_block(picked: DataFrame, head: str, order: str = "place") -> DataFrame:
    """One row, `block`: a heading and a bullet for each picked card (few by choice), empty without any."""
    rows = picked.withColumn("_line", bullet(F.col("title"), F.col("summary")))
    out = rows.agg(_joined(order, "_line", "\n").alias("lines"))
    return out.select(F.when(F.col("lines") != "", F.concat(F.lit(head + "\n\n"), F.col("lines"))).otherwise("").alias("block"))


def sections(cards: DataFrame, most: int = 5) -> DataFrame:
    """One text per section of its first cards, all sections in digest order, unknown ones last."""
    place, name, sign = F.lit(len(fixed.SECTION_ORDER)), F.col("section"), F.lit("•")
    for k, s in enumerate(fixed.SECTION_ORDER):
        place = F.when(F.col("section") == s, k).otherwise(place)
        name = F.when(F.col("section") == s, fixed.SECTION_NAMES[s]).otherwise(name)
        sign = F.when(F.col("section") == s, fixed.SECTION_SIGNS[s]).otherwise(sign)
    rows = cards.where(F.col("rank") <= most)
    body = rows.groupBy("section").agg(F.count(F.lit(1)).alias("n_cards"), _joined("rank", "card", ITEM_BREAK).alias("body"))
    head = F.concat(sign, F.lit(" <b>"), name, F.lit("</b>\n\n"))
    return body.select("section", place.alias("place"), "n_cards", F.concat(head, F.col("body")).alias("text"))


def issue_parts(cards: DataFrame, most: int = 5) -> DataFrame:
    """(part, place, n_cards, text): the parts of a digest after its first; sections of one part compete by score.

    Cards of sections that belong to no part stand in none.
    """
    out = None
    for k, (name, head, names) in enumerate(fixed.ISSUE_PARTS):
        rows = rank.merged_top(cards, names, most, order="rank") if len(names) > 1 else cards.where(F.col("section") == names[0]).orderBy("rank").limit(most)
        rows = rows.withColumn("_at", F.row_number().over(Window.partitionBy(F.lit(k)).orderBy(F.desc("final_score"), F.array_position(F.array(*[F.lit(n) for n in names]), F.col("section")), "rank") if len(names) > 1 else Window.partitionBy("section").orderBy("rank")))
        text = rows.agg(F.count(F.lit(1)).alias("n_cards"), _joined("_at", "card", ITEM_BREAK).alias("body")).where("n_cards > 0")
        part = text.select(F.lit(name).alias("part"), F.lit(k + 1).alias("place"), "n_cards", F.concat(F.lit(head + "\n\n"), "body").alias("text"))
        out = part if out is None else out.unionByName(part)
    return out


def item_score(cards: DataFrame) -> Column:
    """Worth of an unscored card, from what it holds."""
    has = lambda c: (F.coalesce(F.col(c), F.lit("")) != "").cast("int") if c in cards.columns else F.lit(0)
    return F.col("llm_used").cast("int") * 2 + has("why") + has("take") + (F.length("summary") > 80).cast("int")


def issue(cards: DataFrame, day: Column, name: str = fixed.ISSUE_NAME, radar: DataFrame | None = None) -> DataFrame:
    """One row: the whole digest of cards (section, rank, title, summary, card, scores, llm_used), and its counts.

    Cards that fail the quality gate are left out; the first part holds the best cards of all sections.
    """
    good = cards.where(filters.quality_card(F.col("title"), F.col("summary")))
    picked = rank.headline(good, 5, item_score(good))
    picked = picked.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("headline_score"), F.array_position(F.array(*[F.lit(s) for s in fixed.SECTION_ORDER]), F.col("section")), "rank")))
    top = bullet_block(picked, fixed.HEADLINE_HEAD).select(F.col("block").alias("headline"))
    head = F.concat(F.lit(f"{fixed.ISSUE_SIGN} <b>"), F.upper(T.escape_html(F.lit(name))), F.lit("</b>\n"), T.ru_date(day))
    first = top.select(F.lit("headline").alias("part"), F.lit(0).alias("place"), F.lit(0).cast("long").alias("n_cards"), F.concat(F.concat_ws("\n\n", head, F.when(F.col("headline") != "", F.col("headline"))), F.lit("\n\n" + fixed.HEADLINE_TAGS)).alias("text"))
    rows = first.unionByName(issue_parts(good))
    if radar is not None:
        block = bullet_block(radar, fixed.RADAR_HEAD, "rank").where("block <> ''")
        rows = rows.unionByName(block.select(F.lit("radar").alias("part"), F.lit(99).alias("place"), F.lit(0).cast("long").alias("n_cards"), F.col("block").alias("text")))
    text = rows.agg(_joined("place", "text", SECTION_BREAK).alias("full_text"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda x: x["part"]), ",").alias("parts"))
    return text.join(issue_counts(good)).select("full_text", "parts", "item_count", "llm_items", "fallback_items", "sections")


def issue_counts(cards: DataFrame) -> DataFrame:
    """One row: cards in all, written by a model, by rule, and the known sections that have any, in order."""
    order = F.array(*[F.lit(s) for s in fixed.SECTION_ORDER])
    present = F.filter(order, lambda s: F.array_contains(F.col("_seen"), s))
    out = cards.agg(F.count(F.lit(1)).alias("item_count"), F.count_if("llm_used").alias("llm_items"), F.count_if(~F.col("llm_used")).alias("fallback_items"), F.collect_set(F.when(F.col("section").isin(*fixed.SECTION_ORDER), F.col("section"))).alias("_seen"))
    return out.select("item_count", "llm_items", "fallback_items", F.array_join(present, ",").alias("sections"))


def _cut(text: str, most: int, breaks: tuple[tuple[str, int, bool], ...]) -> list[str]:
    """Chunks of at most `most` characters, each ending at the first break rule that fits."""
    out = []
    while len(text) > most:
        head = text[:most]
        at = most
        for mark, least, behind in breaks:
            pos = head.rfind(mark)
            if pos > least:
                at = pos + len(mark) * behind
                break
        part, text = text[:at].rstrip(), text[at:].lstrip()
        if part:
            out.append(part)
    return out + [text] * bool(text)


def split_messages(texts: DataFrame, column: str = "full_text", most: int = 3800) -> DataFrame:
    """part_no and part of every text: at section breaks, and within longer sections at items, blank lines, lines."""
    keep = [c for c in texts.columns if c != column]
    pieces = F.filter(F.transform(F.split(column, r"\n{3,}"), T.strip), lambda x: x != "")
    rules = ((ITEM_BREAK, most // 4, True), ("\n\n", most // 5, True), ("\n", 0, True))

    @F.pandas_udf("array<string>")
    def chunks(s: pd.Series) -> pd.Series:
        return s.map(lambda x: _cut(x or "", most, rules))

    rows = texts.select(*keep, F.posexplode(pieces).alias("_s", "_piece")).select(*keep, "_s", chunks("_piece").alias("_parts"))
    rows = rows.select(*keep, "_s", F.posexplode("_parts").alias("_p", "part"))
    return rows.select(*keep, F.struct("_s", "_p").alias("part_no"), "part")


class SplitMessage:
    """Table function of the parts that split_messages makes: split_message(text, most) gives section, chunk and part."""

    def eval(self, text: str, most: int) -> Iterator[tuple]:
        rules = ((ITEM_BREAK, most // 4, True), ("\n\n", most // 5, True), ("\n", 0, True))
        sections = (s.strip() for s in re.split(r"\n{3,}", text or ""))
        for k, section in enumerate(s for s in sections if s):
            for n, part in enumerate(_cut(section, most, rules)):
                yield k, n, part


class HardSplit:
    """Table function of hard_split: hard_split(text, most) gives chunk and part."""

    def eval(self, text: str, most: int) -> Iterator[tuple]:
        yield from enumerate(hard_split(text or "", most))


def register_splits(spark: SparkSession) -> None:
    """Make split_message and hard_split known to SQL, for LATERAL joins; texts travel in Arrow batches."""
    spark.udtf.register("split_message", F.udtf(SplitMessage, returnType="section int, chunk int, part string", useArrow=True))
    spark.udtf.register("hard_split", F.udtf(HardSplit, returnType="chunk int, part string", useArrow=True))


def hard_split(text: str, most: int = 4096) -> list[str]:
    """Chunks for a transport limit; blank lines first, then lines, else a plain cut."""
    return _cut(text, most, (("\n\n", most // 4 - 1, False), ("\n", 0, False)))


def batches_of(rows: Iterator, size: int) -> Iterator[list]:
    batch: list = []
    for r in rows:
        batch.append(r)
        if len(batch) == size:
            yield batch
            batch = []
    if batch:
        yield batch
