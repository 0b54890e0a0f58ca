"""Language-model steps behind a pluggable backend with an offline default."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewire.functions import fixed
from tidewire.functions import text as T
from tidewire.operators import compose


class Backend(Protocol):
    """Answers a prompt; built once per task."""

    def answer(self, prompt: str) -> str: ...


class Offline:
    """Default backend: gives no answer, so every step takes its rule-based fallback."""

    def answer(self, prompt: str) -> str:
        return ""


class Chain:
    """The first backend of several that answers without an error."""

    def __init__(self, *backends: Backend):
        self.backends = backends

    def answer(self, prompt: str) -> str:
        for b in self.backends:
            try:
                found = b.answer(prompt)
            except (ConnectionError, TimeoutError):
                continue
            if found:
                return found
        return ""


def model_map(df: DataFrame, prompt: str, make: Callable[[], Backend] = Offline, out: str = "answer") -> DataFrame:
    """df with the backend's answer to the prompt column, in Arrow batches."""

    @F.pandas_udf("string")
    def ask(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        backend = make()
        for s in parts:
            yield s.map(lambda p: backend.answer(p or ""))

    return df.withColumn(out, ask(F.col(prompt)))


def _asked(events: DataFrame, part: str, order: str, title: str, make: Callable[[], Backend], size: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their batch and place in it, and per batch the places that the model keeps."""
    numbered = events.withColumn("_n", F.row_number().over(Window.partitionBy(part).orderBy(order)) - 1)
    numbered = numbered.withColumn("_batch", F.floor(F.col("_n") / size)).withColumn("_i", (F.col("_n") % size).cast("int"))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(title).alias("t")))), lambda x: F.concat_ws(". ", x["_i"].cast("string"), x["t"]))
    prompts = numbered.groupBy(part, "_batch").agg(F.array_join(lines, "\n").alias("_prompt"), F.count(F.lit(1)).cast("int").alias("_size"))
    answered = model_map(prompts, "_prompt", make, "_answer").withColumn("_keep", T.keep_indices(F.col("_answer"), F.col("_size")))
    return numbered, answered.select(part, "_batch", "_keep")


def filter_batches(events: DataFrame, part: str, order: str, title: str, make: Callable[[], Backend] = Offline, size: int = 10) -> DataFrame:
    """Events a model keeps, asked in ordered batches; a batch whose answer can't be read stays whole."""
    numbered, kept = _asked(events, part, order, title, make, size)
    kept = kept.select(part, "_batch", F.explode("_keep").alias("_i"))
    return numbered.join(kept, [part, "_batch", "_i"], "left_semi").drop("_n", "_batch", "_i")


def pick_batches(events: DataFrame, part: str, order: str, title: str, make: Callable[[], Backend] = Offline, size: int = 10) -> DataFrame:
    """As filter_batches, but in the order of the answer within a batch, and as often as it names a row: `place` tells."""
    numbered, kept = _asked(events, part, order, title, make, size)
    picked = kept.select(part, "_batch", F.posexplode("_keep").alias("_at", "_i"))
    rows = numbered.join(picked, [part, "_batch", "_i"])
    place = F.row_number().over(Window.partitionBy(part).orderBy("_batch", "_at"))
    return rows.withColumn("place", place).drop("_n", "_batch", "_i", "_at")


FIELDS = ("titles", "snippets", "canonical_title", "memory_context", "user_profile")


def fill(template: str, **columns: Column) -> Column:
    """A template with {name} places filled from columns; other braces stay."""
    parts = re.split("\\{(" + "|".join(FIELDS) + ")\\}", template)
    none = F.lit("")
    return F.concat(*[F.coalesce(columns.get(p, none).cast("string"), none) if k % 2 else F.lit(p) for k, p in enumerate(parts)])


def prompt_of(titles: str, snippets: str, template: str = "Titles:\n{titles}\n\nTexts:\n{snippets}", **more: Column) -> Column:
    """Prompt column of at most five distinct titles and four snippets of 250 characters; a template may name more fields."""
    low = F.transform(F.col(titles), F.lower)
    distinct = F.slice(F.filter(F.col(titles), lambda t, i: F.array_position(low, F.lower(t)) == i + 1), 1, 5)
    short = F.transform(F.slice(F.filter(F.col(snippets), lambda s: s != ""), 1, 4), lambda s: F.substring(s, 1, 250))
    return fill(template, titles=F.array_join(distinct, "\n"), snippets=F.array_join(short, "\n"), **more)


def _ask_for(tags: list[str]) -> str:
    return "Headlines:\n{titles}\n\nTexts:\n{snippets}\n\n{memory_context}{user_profile}Answer in Russian, each part after its tag:\n" + "\n".join(f"[{t}]" for t in tags)


def write_cards(events: DataFrame, make: Callable[[], Backend] = Offline, template: str | None = None, memory: Column | None = None, profile: Column | None = None) -> DataFrame:
    """events with title, summary, why, take, area, confidence and llm_used, from a model or by rule.

    The model is asked by section; what it leaves out of an answer comes from the event, and an
    event without a readable answer becomes the card of its own snippets. A template replaces
    both prompts.
    """
    own = compose.fallback_cards(events).withColumnsRenamed({"title": "_title", "summary": "_summary"}).drop("llm_used")
    titles = "titles" if "titles" in events.columns else "_titles"
    own = own if titles in events.columns else own.withColumn(titles, F.array("canonical_title"))
    agents = F.col("section") == "ai_agents"
    more = {"canonical_title": F.col("canonical_title"), "memory_context": memory if memory is not None else F.lit(""), "user_profile": profile if profile is not None else F.lit("")}
    prompts = [prompt_of(titles, "snippets", template or _ask_for(tags), **more) for tags in (fixed.AGENT_TAGS, fixed.CARD_TAGS)]
    asked = model_map(own.withColumn("_prompt", F.when(agents, prompts[0]).otherwise(prompts[1])), "_prompt", make, "_raw")
    raw = F.trim(T.strip_thinking(F.col("_raw")))
    asked = asked.withColumn("_a", F.when(agents & (raw != ""), T.agent_answer(raw))).withColumn("_c", F.when(~agents & (raw != ""), T.card_answer(raw)))
    told = F.col("_a").isNotNull() | F.col("_c").isNotNull()
    field = lambda name: F.coalesce(F.col("_a")[name], F.col("_c")[name], F.lit(""))
    out = asked.withColumns(
        {
            "title": F.when(field("title") != "", field("title")).otherwise(F.col("_title")),
            "summary": F.when(field("summary") != "", field("summary")).otherwise(F.col("_summary")),
            "why": field("why"), "take": F.coalesce(F.col("_c")["take"], F.lit("")), "area": F.coalesce(F.col("_a")["area"], F.lit("")),
            "confidence": F.coalesce(F.col("_a")["confidence"], F.col("role")), "llm_used": told,
        }
    )
    return out.drop("_title", "_summary", "_prompt", "_raw", "_a", "_c", "_titles")


def translated(df: DataFrame, column: str, make: Callable[[], Backend] = Offline) -> DataFrame:
    """df with the column in Russian where a model can do it; the text itself otherwise."""
    text = F.col(column)
    needed = (F.coalesce(text, F.lit("")) != "") & ~T.mostly_russian(text)
    prompt = F.when(needed, F.concat(F.lit("Translate into Russian, one short paragraph, only the translation.\n\n"), F.substring(text, 1, 400)))
    asked = model_map(df.withColumn("_prompt", prompt), "_prompt", make, "_said")
    said = F.trim(F.col("_said"))
    return asked.withColumn(column, F.when(needed & (said != "") & T.mostly_russian(said), said).otherwise(text)).drop("_prompt", "_said")


def refined_titles(events: DataFrame, titles: str = "titles", make: Callable[[], Backend] = Offline) -> DataFrame:
    """events with a canonical_title that a model may rewrite: one line of at most 120 characters, else the old one."""
    old = F.col("canonical_title")
    related = F.array_join(F.filter(F.slice(titles, 1, 4), lambda t: (F.trim(t) != "") & (F.trim(t) != old)), "; ")
    prompt = F.concat(F.lit("One clean headline in Russian, at most 80 characters, nothing else.\n\nTitle: "), old, F.lit("\nRelated: "), related)
    asked = model_map(events.withColumn("_prompt", prompt), "_prompt", make, "_said")
    said = F.trim(F.col("_said"))
    return asked.withColumn("canonical_title", F.when((said != "") & ~F.contains(said, F.lit("\n")) & (F.length(said) <= 120), said).otherwise(old)).drop("_prompt", "_said")


def entities_of(df: DataFrame, text: str, make: Callable[[], Backend] = Offline, out: str = "entities") -> DataFrame:
    """df with entities that a model names as JSON; by rule where its answer holds none."""
    prompt = F.concat(F.lit("Name the entities of the text as a JSON object with the lists organizations, people, products, topics.\n\n"), F.substring(text, 1, 500))
    asked = model_map(df.withColumn("_prompt", prompt), "_prompt", make, "_said")
    body = F.regexp_extract("_said", r"(?s)(\{.*\})", 1)
    found = F.from_json(body, "organizations array<string>, people array<string>, products array<string>, topics array<string>")
    none = F.array().cast("array<string>")
    named = F.struct(*[T.unique(F.coalesce(found[k], none)).alias(k) for k in ("organizations", "people", "products", "topics")])
    readable = (body != "") & F.try_parse_json(body).isNotNull()
    return asked.withColumn(out, F.when(readable, named).otherwise(T.entities(F.col(text)))).drop("_prompt", "_said")


def list_answer(answer: Column, by: str, low: int, high: int, most: int) -> Column:
    """Parts of an answer with more than low and fewer than high characters, the first `most`; empty if there are none."""
    parts = F.transform(F.split(F.coalesce(answer, F.lit("")), by), lambda x: F.btrim(x, F.lit(" -*\"'\t\r\n")))
    return F.slice(F.filter(parts, lambda x: (F.length(x) > low) & (F.length(x) < high)), 1, most)


def keywords_to_avoid(disliked: DataFrame, by_rule: DataFrame, make: Callable[[], Backend] = Offline) -> DataFrame:
    """(word): three to five words that a model finds in disliked urls and sources; those found by rule otherwise.

    disliked (article_url, source): the first 2000 characters of them are shown to the model.
    """
    shown = disliked.select(F.concat_ws(" ", "article_url", "source").alias("t")).limit(2000)
    prompt = shown.agg(F.concat(F.lit("Which 3-5 words are common in these disliked items? Comma-separated, nothing else.\n\n"), F.substring(F.array_join(F.collect_list("t"), " "), 1, 2000)).alias("_prompt"))
    words = model_map(prompt, "_prompt", make, "_said").select(F.transform(list_answer(F.col("_said"), ",", 2, 40, 5), F.lower).alias("words"))
    told = words.select(F.explode("words").alias("word"))
    silent = words.where(F.size("words") == 0).select(F.lit(1).alias("_none"))
    return told.unionByName(by_rule.select("word").join(silent).drop("_none"))


def search_queries(topics: DataFrame, make: Callable[[], Backend] = Offline) -> DataFrame:
    """(topic, place, query): up to three queries that a model proposes for each topic, else the usual three."""
    prompt = F.concat(F.lit("Three short web searches that find RSS feeds, one per line. Topic: "), F.col("topic"))
    asked = model_map(topics.withColumn("_prompt", prompt), "_prompt", make, "_said")
    told = list_answer(F.col("_said"), "\n", 3, 1 << 20, 3)
    usual = F.array(F.concat(F.lit("best RSS feed for "), "topic"), F.concat("topic", F.lit(" blog RSS")), F.concat("topic", F.lit(" news feed")))
    return asked.select("topic", F.posexplode(F.when(F.size(told) > 0, told).otherwise(usual)).alias("place", "query"))
