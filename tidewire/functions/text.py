"""Text, hash, time and parsing functions on columns. All are built-in expressions."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from html.entities import html5 as entity_names

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewire.functions import fixed


def strip(c: Column) -> Column:
    """Trim every kind of white space."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_title(c: Column) -> Column:
    """Lower case letter by letter, all but letters, marks, numbers and _ to blanks, single blanks."""
    # the two letters whose lower case goes by the place or is two characters
    low = F.lower(F.translate(F.coalesce(c, F.lit("")), "\u0130\u03a3", "i\u03c3"))
    bare = F.regexp_replace(low, r"(?U)[^\p{L}\p{M}\p{N}_\s]", " ")
    return F.trim(F.regexp_replace(bare, r"(?U)\s+", " "))


def url_hash(title: Column, url: Column) -> Column:
    """sha256 of the normalised title and the trimmed url."""
    return F.sha2(F.concat_ws("|", normalize_title(title), strip(F.coalesce(url, F.lit("")))), 256)


def keywords(title: Column) -> Column:
    """Distinct words of three letters or more that are no stop words."""
    found = F.regexp_extract_all(normalize_title(title), F.lit("[a-zа-яё]{3,}"), 0)
    return F.array_except(F.array_distinct(found), F.array(*[F.lit(w) for w in fixed.KEYWORD_STOPS]))


def jaccard(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct values, 0 if either is empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def simhash(text: Column) -> Column:
    """64-bit SimHash over lower-cased words; each word votes with the low 64 bits of its md5."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"\s+"), lambda w: w != "")
    votes = F.transform(words, lambda w: F.conv(F.substring(F.md5(w), 17, 16), 16, -10).cast("long"))
    # one pass over the words: the ones of bits j and j + 32 are counted in the two halves of the j-th number
    halves, low = F.lit((1 << 32) + 1), F.lit((1 << 32) - 1)
    none = F.struct(F.lit(0).cast("long").alias("n"), *(F.lit(0).cast("long").alias(f"c{j}") for j in range(32)))

    def count(a: Column, h: Column) -> Column:
        return F.struct((a["n"] + 1).alias("n"), *((a[f"c{j}"] + F.shiftrightunsigned(h, j).bitwiseAND(halves)).alias(f"c{j}") for j in range(32)))

    def bits(a: Column) -> Column:
        # ones against zeros: twice the ones must exceed the number of words
        out = F.lit(0).cast("long")
        for i in range(64):
            ones = F.shiftrightunsigned(a[f"c{i - 32}"], 32) if i >= 32 else a[f"c{i}"].bitwiseAND(low)
            out = out.bitwiseOR(F.when(ones * 2 > a["n"], F.lit(1 << i if i < 63 else -(1 << 63))).otherwise(F.lit(0).cast("long")))
        return out

    return F.aggregate(votes, none, count, bits)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def time_close(a: Column, b: Column, hours: int = 24) -> Column:
    """Within some hours; an unknown time is close to any."""
    near = F.abs(F.unix_micros(a.cast("timestamp")) - F.unix_micros(b.cast("timestamp"))) <= F.lit(hours * 3_600_000_000)
    return F.coalesce(near, F.lit(True))


def signature(title: Column, snippet: Column) -> Column:
    """Distinct words of three letters or more of title and snippet, in order."""
    text = F.concat_ws(" ", F.coalesce(title, F.lit("")), F.coalesce(snippet, F.lit("")))
    stops = F.array(*[F.lit(w) for w in fixed.SIGNATURE_STOPS])
    words = F.filter(F.split(normalize_title(text), " "), lambda w: (F.length(w) >= 3) & ~F.array_contains(stops, w))
    return F.array_join(F.array_distinct(words), " ")


def runs(text: Column) -> Column:
    """Distinct runs of three characters of a text, the text itself if shorter; the text is computed once, not for each run."""
    grams = lambda t: F.transform(F.sequence(F.lit(1), F.greatest(F.length(t) - 2, F.lit(1))), lambda i: F.substr(t, i, F.lit(3)))
    return _once(text, lambda t: F.array_distinct(grams(t)))


def trigrams(text: Column) -> Column:
    """Distinct runs of three characters of the normalised text; the text itself if shorter, none if empty."""
    return F.array_remove(runs(normalize_title(text)), "")


def _once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), where value is computed once however often it is used, also for the elements of an array."""
    return F.transform(F.array(value), then)[0]


def unique(a: Column) -> Column:
    """First spelling of each value, whatever its case."""
    first = lambda all_, low: F.filter(all_, lambda x, i: (F.trim(x) != "") & (F.array_position(low, F.lower(F.trim(x))) == i + 1))
    return _once(a, lambda all_: _once(F.transform(all_, lambda x: F.lower(F.trim(x))), lambda low: first(all_, low)))


def entities(text: Column) -> Column:
    """Organisations, people (none by rule), products and topics of a text."""
    return _once(F.coalesce(text, F.lit("")), _entities)


def _entities(t: Column) -> Column:
    found = lambda pattern: F.transform(F.regexp_extract_all(t, F.lit(pattern), 1), lambda x: F.btrim(strip(x), F.lit(fixed.NAME_EDGES)))
    numbered = F.filter(found(fixed.NUMBERED_NAME), lambda x: x.rlike(r"\d"))
    quoted, runs = found(fixed.QUOTED_NAME), found(fixed.CAPITAL_NAME)
    stops = F.array(*[F.lit(w) for w in fixed.CAPITAL_STOPS])
    orgs = F.filter(runs, lambda x: ~x.rlike(r"\d") & ~F.array_contains(stops, F.lower(F.split(x, r"\s+")[0])))
    words = F.regexp_extract_all(F.lower(t), F.lit("[a-zа-яё]{4,}"), 0)
    topics = F.slice(F.array_except(F.array_distinct(words), F.array(*[F.lit(w) for w in fixed.CAPITAL_STOPS + fixed.SIGNATURE_STOPS])), 1, 15)
    return F.struct(
        unique(orgs).alias("organizations"),
        F.array().cast("array<string>").alias("people"),
        unique(F.concat(numbered, quoted)).alias("products"),
        topics.alias("topics"),
    )


def entity_overlap(a: Column, b: Column) -> Column:
    """Weighted sum of Jaccard similarities, at most 1."""
    total = F.lit(0.0)
    for kind, weight in fixed.ENTITY_WEIGHTS.items():
        x, y = (F.array_distinct(F.transform(e[kind], lambda v: F.lower(F.trim(v)))) for e in (a, b))
        total = total + jaccard(x, y) * weight
    return F.least(total, F.lit(1.0))


def clean_source(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"^(rss:|tg:|search:?)\s*", ""))


def domain(url: Column) -> Column:
    """Authority of a url without "www."; the first 25 characters of what is no url."""
    found = F.replace(F.try_parse_url(url, F.lit("AUTHORITY")), F.lit("www."), F.lit(""))
    return F.when(F.coalesce(found, F.lit("")) != "", found).otherwise(F.substring(url, 1, 25))


def first_sentence(text: Column, most: int = 120) -> Column:
    t = strip(F.coalesce(text, F.lit("")))
    found = F.regexp_extract(t, r"(?s)^(.*?[.!?])(?:\s|$)", 1)
    return F.when(found != "", F.substring(strip(found), 1, most)).otherwise(F.rtrim(F.substring(t, 1, most)))


def ru_date(d: Column) -> Column:
    months = F.array(*[F.lit(m) for m in fixed.RU_MONTHS])
    return F.concat_ws(" ", F.dayofmonth(d).cast("string"), F.element_at(months, F.month(d)), F.year(d).cast("string"))


def escape_html(c: Column) -> Column:
    out = F.coalesce(c, F.lit(""))
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def _code_points(n: Column) -> Column:
    """The character of a number."""
    return F.decode(F.unhex(F.lpad(F.hex(n), 8, "0")), "UTF-32")


def _number_reference(n: Column) -> Column:
    """What a numeric reference stands for: numbers of old Windows signs and impossible ones have rules of their own."""
    signs = [bytes([k]).decode("cp1252", "ignore") or chr(k) for k in range(0x80, 0xA0)]
    lost = (n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF)
    none = n.between(1, 8) | (n == 0x0B) | n.between(0x0E, 0x1F) | (n == 0x7F) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    return F.when(lost, "\uFFFD").when(n.between(0x80, 0x9F), F.get(F.array(*map(F.lit, signs)), (n - 0x80).cast("int"))).when(none, "").otherwise(_code_points(n))


def unescape_html(c: Column) -> Column:
    """Text with all named and numeric character references of HTML decoded, as browsers do it.

    A name without its semicolon is read as far as it is the longest known one; what is no reference stays.
    The names come from the standard library as one map, which is a constant of the plan.
    """
    names = F.from_json(F.lit(json.dumps(entity_names)), "map<string,string>")
    pattern = r"&(?:#[0-9]+;?|#[xX][0-9a-fA-F]+;?|[^\t\n\f <&#;]{1,32};?)"
    shortest, longest = 2, max(len(k) for k in entity_names if not k.endswith(";"))

    def named(r: Column) -> Column:
        found = F.try_element_at(names, r)
        for k in range(longest, shortest - 1, -1):
            head = F.when(F.length(r) > k, F.try_element_at(names, F.substring(r, 1, k)))
            found = F.coalesce(found, F.concat(head, F.substring(r, k + 1, 1 << 30)))
        return F.coalesce(found, F.concat(F.lit("&"), r))

    def decoded(ref: Column) -> Column:
        r = F.substring(ref, 2, 1 << 30)
        digits = F.regexp_extract(r, "([0-9a-fA-F]+);?$", 1)
        # more digits than any character needs: too large, however many they are
        number = lambda base, most: F.when(F.length(F.ltrim(digits, F.lit("0"))) > most, F.lit(1 << 24).cast("long")).otherwise(F.conv(digits, base, 10).cast("long"))
        return F.when(r.rlike("^#[xX]"), _number_reference(number(16, 7))).when(r.startswith("#"), _number_reference(number(10, 9))).otherwise(named(r))

    between, refs = F.split(c, pattern, -1), F.regexp_extract_all(c, F.lit(pattern), 0)
    whole = F.array_join(F.zip_with(between, F.transform(refs, decoded), lambda a, b: F.concat(a, F.coalesce(b, F.lit("")))), "")
    return F.when(F.contains(c, F.lit("&")), whole).otherwise(c)


def strip_tags(c: Column, by: str = "") -> Column:
    return F.regexp_replace(F.coalesce(c, F.lit("")), "<[^>]+>", by)


def letters(c: Column) -> tuple[Column, Column]:
    """Numbers of Cyrillic and of ASCII letters."""
    t = F.coalesce(c, F.lit(""))
    return F.regexp_count(t, F.lit(r"[\x{0400}-\x{04ff}]")), F.regexp_count(t, F.lit("[A-Za-z]"))


def mostly_russian(c: Column) -> Column:
    cyrillic, latin = letters(c)
    return F.when(cyrillic + latin == 0, True).otherwise(cyrillic / (cyrillic + latin) > 0.40)


def tagged_section(text: Column, tag: str, tags: Sequence[str]) -> Column:
    """Content of one [TAG] block, up to the next known tag, without an echoed hint."""
    any_tag = "|".join(tags)
    found = F.regexp_extract(text, rf"(?isU)\[{tag}\]\s*(.*?)(?=\[(?:{any_tag})\]|$)", 1)
    return strip(F.regexp_replace(strip(found), r"(?s)^\([^)]{3,120}\)\s*", ""))


def card_answer(text: Column) -> Column:
    """Fields of a model's card answer: title, summary, why, take and whether one of the first two is missing.

    What stands before the first title tag is dropped; null if neither title nor summary is there.
    """
    tags = fixed.CARD_TAGS
    body = F.when(F.locate("[" + tags[0] + "]", text) > 0, F.substring(text, F.locate("[" + tags[0] + "]", text), F.length(text))).otherwise(text)
    title, summary, why, take = (tagged_section(body, t, tags) for t in tags)
    found = F.struct(title.alias("title"), summary.alias("summary"), why.alias("why"), take.alias("take"), ((title == "") | (summary == "")).alias("partial"))
    return F.when((title != "") | (summary != ""), found)


def agent_answer(text: Column) -> Column:
    """Fields of a model's answer on agents: title, summary, why, area and confidence."""
    tags = fixed.AGENT_TAGS
    body = F.when(F.locate("[" + tags[0] + "]", text) > 0, F.substring(text, F.locate("[" + tags[0] + "]", text), F.length(text))).otherwise(text)
    title, summary, why, area, raw = (tagged_section(body, t, tags) for t in tags)
    return F.struct(title.alias("title"), summary.alias("summary"), why.alias("why"), area.alias("area"), confidence(raw).alias("confidence"))


def confidence(raw: Column) -> Column:
    """verified, partially_verified or signal_only, from what a model wrote."""
    low = F.lower(F.coalesce(raw, F.lit("")))
    partial = F.contains(low, F.lit("partial"))
    return F.when(F.contains(low, F.lit("verified")) & ~partial, "verified").when(partial, "partially_verified").otherwise("signal_only")


def parse_json(c: Column, schema: str, default: Column) -> Column:
    """A JSON text by a schema; the default for what is empty or can't be read."""
    mark = F.from_json(c, schema, {"mode": "PERMISSIVE"})
    ok = F.try_parse_json(c).isNotNull() & (F.trim(c) != "")
    return F.when(ok, F.coalesce(mark, default)).otherwise(default)


def callback(c: Column) -> Column:
    """digest_id, article_idx and action of "fb:digest:article:action", null for anything else."""
    part = F.split(c, ":")
    whole = lambda i: F.when(F.trim(part[i]).rlike(r"^[+-]?\d+$"), F.trim(part[i]).try_cast("long"))
    digest, article = (F.when(F.size(part) == 4, whole(i)) for i in (1, 2))
    ok = (F.size(part) == 4) & (part[0] == "fb") & digest.isNotNull() & article.isNotNull()
    return F.when(ok, F.struct(digest.alias("digest_id"), article.alias("article_idx"), part[3].alias("action")))


def menu_callback(c: Column) -> Column:
    """screen, action, value and extra of "menu:screen:action[:value[:extra]]"; extra keeps further colons."""
    part = F.split(c, ":", 5)
    at = lambda i: F.coalesce(F.get(part, F.lit(i)), F.lit(""))
    return F.when(c.startswith("menu:") & (F.size(part) >= 3), F.struct(at(1).alias("screen"), at(2).alias("action"), at(3).alias("value"), at(4).alias("extra")))


def valid_hhmm(c: Column) -> Column:
    """Whether a text is a time of the day, two numbers around one colon."""
    part = F.split(c, ":")
    number = lambda i: F.when(F.trim(F.get(part, F.lit(i))).rlike(r"^[+-]?\d+$"), F.trim(F.get(part, F.lit(i))).try_cast("int"))
    return F.coalesce((F.size(part) == 2) & number(0).between(0, 23) & number(1).between(0, 59), F.lit(False))


def block_time(c: Column) -> Column:
    """day (null without one), hour and minute of "HH:MM" or "mon 09:00"; null where the time is none."""
    words = F.filter(F.split(F.lower(F.trim(F.coalesce(c, F.lit("")))), r"\s+"), lambda w: w != "")
    two = F.size(words) == 2
    clock = F.when(two, F.get(words, F.lit(1))).otherwise(F.array_join(words, " "))
    day = F.when(two, F.substring(F.get(words, F.lit(0)), 1, 3))
    m = minutes_of(clock)
    return F.struct(F.when(day.isin(*fixed.WEEKDAYS), day).alias("day"), F.floor(m / 60).cast("int").alias("hour"), (m % 60).cast("int").alias("minute"))


def ordered_union(a: Column, b: Column) -> Column:
    """Values of both arrays, each once, in the order of their first place."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(a, none), F.coalesce(b, none))


def strip_thinking(c: Column) -> Column:
    return F.regexp_replace(c, "(?s)<think>.*?</think>", "")


def keep_indices(answer: Column, n: Column) -> Column:
    """Indices a model keeps; all of them if its answer can't be read, none if it says so."""
    fenced = F.regexp_extract(answer, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    braced = F.regexp_extract(answer, r"(?s)(\{.*\})", 1)
    body = F.when(fenced != "", fenced).when(braced != "", braced).otherwise(answer)
    keep = F.from_json(body, "keep array<int>")["keep"]
    inside = F.filter(keep, lambda i: (i >= 0) & (i < n))
    return F.when(keep.isNull(), F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))).otherwise(inside)


def minutes_of(hhmm: Column) -> Column:
    """Minutes of the day of HH:MM, null if it is no time."""
    ok = hhmm.rlike(r"^([01]?\d|2[0-3]):[0-5]\d$")
    part = F.split(hhmm, ":")
    return F.when(ok, part[0].try_cast("int") * 60 + F.try_element_at(part, F.lit(2)).try_cast("int"))


def hhmm_minus(hhmm: Column, minutes: Column) -> Column:
    m = F.pmod(minutes_of(hhmm) - minutes, F.lit(1440))
    return F.when(m.isNotNull(), F.format_string("%02d:%02d", F.floor(m / 60).cast("int"), (m % 60).cast("int")))


def word_match(word: str) -> str:
    """Pattern for a whole word, or for the start of one if it ends in *."""
    bare = word.rstrip("*")
    quoted = "".join("\\" + ch if ch in r"\.[]{}()*+-?^$|" else ch for ch in bare.lower())
    return rf"(?U)\b{quoted}" + ("" if word.endswith("*") else r"\b")


def percent(n: Column, total: Column) -> Column:
    return F.when(total > 0, F.floor(n * 100 / total)).otherwise(0).cast("long")


def token_cost(tokens_in: Column, tokens_out: Column, price_in: float, price_out: float) -> Column:
    return (tokens_in * F.lit(price_in) + tokens_out * F.lit(price_out)) / F.lit(1_000_000)
