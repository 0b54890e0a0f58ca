"""URL filter: rules, then host word segmentation with multinomial naive Bayes.

Rules are a small fixed table and are matched with string functions. Urls that no rule fits are
judged by their words: the labels of the host but the last are cut into words by a Viterbi search
over a unigram model, the letter runs of the path are cut in the same way, and a multinomial naive
Bayes model scores the tokens.

Both models are learned from the tables. The unigram counts are those of all words in the texts and
pages (the most frequent are kept, at most `most_words`, a bound on the model, not on what is counted), on top
of two short word lists that name what the classes are about. Naive Bayes counts the tokens of every
url that a rule labels, but for the host suffix and path prefix that the rule itself is made of, which
say nothing about urls that it doesn't fit. Both classes are scaled to the mass of the larger one, and
the word lists weigh as much again; of the tokens, again at most `most_words` are kept. A token that the model does not hold
says nothing, and a url without a known token is allowed.

Defined cases: a null url or one without "://" has an empty host and path, fits no rule and is
allowed; an empty path fits only rules with an empty one; of two rules of equal length that both fit
the one that comes first in the table wins; equal odds allow; a url of any length is judged in whole;
repeated rows are judged one by one, and count as often as they stand there; without labelled urls or
texts the word lists alone are the model; empty tables give no rows; other columns of the input are
ignored, whatever their names.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewire.runtime import drop, settle

RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)
LONGEST = 24  # letters of a word

# training words of the class "block"
BLOCK_WORDS = """
spam casino pills cheap bets bet win winner free poker slots slot jackpot gambling lottery viagra cialis pharmacy
adult porn xxx sex nude escort webcam dating ads ad advert adserver track tracker tracking click clicks popup
banner affiliate doubleclick malware phishing crack cracked warez torrent keygen serial loans loan payday credit
debt bonus prize giveaway replica rolex crypto forex profit rich earn money discount coupon deals weightloss diet
farm linkfarm seo backlinks traffic
""".split()

# training words of the class "allow"
ALLOW_WORDS = """
news blog article articles story stories world politics science health sport sports culture music film books book
library school university college research journal paper papers docs documentation help support about contact team
history art museum travel city weather local region market economy business finance technology tech computer
software code data open source project wiki forum community group family home garden kitchen recipe recipes food
cook nature park river mountain animal animals plant plants energy climate education student teacher learn course
lesson language english french german spanish photo photos gallery video radio magazine press report reports review
reviews guide guides event events calendar archive tag category page index post posts index author public service
the and of in on for with to by from a is my your our best top new online free shop store home world life day time people
""".split()




class Segmenter:
    """Unigram Viterbi segmentation of a letter string into words."""

    def __init__(self, counts: Mapping[str, float]):
        self.total = float(sum(counts.values())) or 1.0
        self.cost = {w: math.log(self.total / n) for w, n in counts.items() if n > 0}
        self.longest = max([1, *map(len, counts)])
        self.start, self.letter = math.log(self.total) + 1.0, math.log(10.0)

    def price(self, word: str) -> float:
        """Cost of one word; an unknown one costs more than any known one, and more with each letter."""
        found = self.cost.get(word)
        return self.start + self.letter * len(word) if found is None else found

    def split(self, name: str) -> list[str]:
        """The cheapest split, the one with the longer last word on ties."""
        n, known = len(name), self.cost
        best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
        # an unknown word grows letter by letter, so its length has no bound
        grown, since = math.inf, 0
        for end in range(1, n + 1):
            if best[end - 1] + self.start < grown:
                grown, since = best[end - 1] + self.start, end - 1
            grown += self.letter
            least, at = grown, since
            for begin in range(max(0, end - self.longest), end):
                cost = known.get(name[begin:end])
                if cost is not None and best[begin] + cost < least:
                    least, at = best[begin] + cost, begin
            best[end], back[end] = least, at
        out, end = [], n
        while end:
            out.append(name[back[end] : end])
            end = back[end]
        return out[::-1]


class NaiveBayes:
    """Multinomial naive Bayes over tokens with Laplace smoothing."""

    def __init__(self, block: Mapping[str, float], allow: Mapping[str, float], prior: float = 0.5):
        vocabulary = set(block) | set(allow)
        self.prior = math.log(prior / (1 - prior))

        def rates(counts: Mapping[str, float]) -> dict[str, float]:
            whole = sum(counts.values()) + len(vocabulary)
            return {w: math.log((counts.get(w, 0) + 1) / whole) for w in vocabulary}

        b, a = rates(block), rates(allow)
        self.weight = {w: b[w] - a[w] for w in vocabulary}

    def score(self, tokens: Sequence[str]) -> float:
        """Log odds of "block"; above 0 the url is blocked."""
        return self.prior + sum(self.weight.get(t, 0.0) for t in tokens)


def runs_of(host: str, path: str, rule: str | None = None) -> list[str]:
    """The letter runs of a host without its last label, and of a path; of a rule that fits both, its own part is left out."""
    if rule is None:
        labels = host.split(":")[0].split(".")
        name = labels[:-1] if len(labels) > 1 else labels
    else:
        suffix, _, prefix = rule.partition("/")
        name, path = host[: len(host) - len(suffix)].split("."), path[len(prefix) + 1 :]
    return re.findall(r"[a-z]+", " ".join(name)) + re.findall(r"[a-z]+", path.lower())


class UrlModel:
    """The segmenter and the classifier together."""

    def __init__(self, words: Mapping[str, float] | None = None, block: Mapping[str, float] | None = None, allow: Mapping[str, float] | None = None):
        words, block, allow = words or {}, block or {}, allow or {}
        lists = Counter([*BLOCK_WORDS, *ALLOW_WORDS])
        # the lists weigh as much as what was learned, so that large tables don't drown them
        each = max(1.0, sum(words.values()) / sum(lists.values()))
        known = {w: n for w, n in words.items() if 1 < len(w) <= LONGEST}
        self.segmenter = Segmenter({w: known.get(w, 0) + each * lists.get(w, 0) for w in known.keys() | {w for w in lists if len(w) > 1}})
        mass = max(sum(block.values()), sum(allow.values()), len(BLOCK_WORDS), len(ALLOW_WORDS))
        self.bayes = NaiveBayes(self._with(block, BLOCK_WORDS, mass), self._with(allow, ALLOW_WORDS, mass), prior=0.3)
        self.cut: dict[str, list[str]] = {}

    @staticmethod
    def _with(counts: Mapping[str, float], words: Sequence[str], mass: float) -> dict[str, float]:
        """Counts scaled to `mass` in all plus a list of words that weighs as much, the same for either class."""
        listed, scale = Counter(words), mass / max(1.0, sum(counts.values()))
        return {w: scale * counts.get(w, 0) + mass / len(words) * listed.get(w, 0) for w in counts.keys() | listed.keys()}

    def tokens(self, host: str, path: str, rule: str | None = None) -> list[str]:
        out: list[str] = []
        for run in runs_of(host, path, rule):
            if len(run) > 64:
                out += self.segmenter.split(run)
                continue
            if run not in self.cut:
                if len(self.cut) >= 50_000:
                    self.cut.clear()
                self.cut[run] = self.segmenter.split(run)
            out += self.cut[run]
        return [w for w in out if len(w) > 1]

    def verdict(self, host: str, path: str) -> tuple[str, float]:
        tokens = [t for t in self.tokens(host, path) if t in self.bayes.weight]
        odds = self.bayes.score(tokens)
        return ("block" if tokens and odds > 0 else "allow"), odds


def most_frequent(counts: DataFrame, n: str, most: int) -> DataFrame:
    """The rows with the largest counts, at most so many; rows of one count are all in or all out.

    The least count that fits comes from how many rows have each count, so no sorted rows meet anywhere.
    """
    least, room = None, most
    for r in counts.groupBy(n).agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc(n)).limit(most).collect():
        if r["rows"] > room:
            break
        least, room = r[n], room - r["rows"]
    return counts.where(F.lit(False) if least is None else F.col(n) >= least)


def word_counts(texts: Sequence[Column], tables: Sequence[DataFrame], most_words: int = 50_000) -> dict[str, int]:
    """Counts of the words of a-z in all these columns, of the most frequent ones."""
    words = None
    for text, table in zip(texts, tables):
        part = table.select(F.explode(F.split(F.lower(text.cast("string")), "[^a-z]+")).alias("word"))
        words = part if words is None else words.unionByName(part)
    if words is None:
        return {}
    fit = settle(words.where(F.length("word").between(2, LONGEST)).groupBy("word").agg(F.count(F.lit(1)).alias("n")))
    found = {r["word"]: r["n"] for r in most_frequent(fit, "n", most_words).collect()}
    drop(fit)
    return found


def with_rules(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule and rule_verdict of every url."""
    text = F.col("url").cast("string")
    has = F.coalesce(F.instr(text, "://") > 0, F.lit(False))
    rest = F.expr("substring(cast(url as string), instr(cast(url as string), '://') + 3)")
    host = F.translate(F.regexp_extract(rest, r"(?s)^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    named = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.when(has, host).otherwise("").alias("host"),
        F.when(has, path).otherwise("").alias("path"),
    )
    # longest first: the first rule that fits is the longest one
    ordered = sorted(rules, key=lambda r: -len(r[0] + r[1]))
    fits = [
        (((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p), h + p, v) for h, p, v in ordered
    ]
    rule, word = F.lit(None).cast("string"), F.lit(None).cast("string")
    for fit, name, verdict in reversed(fits):
        rule, word = F.when(fit, name).otherwise(rule), F.when(fit, verdict).otherwise(word)
    return named.select("*", rule.alias("rule"), word.alias("rule_verdict"))


def token_counts(judged: DataFrame, model: UrlModel, most_words: int = 50_000) -> dict[str, dict[str, int]]:
    """Per verdict of the rules, how often each token stands in the urls that they label."""
    shared = judged.sparkSession.sparkContext.broadcast(model)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts: Counter = Counter()
            for h, p, v, r in zip(*(b.column(c).to_pylist() for c in ("host", "path", "rule_verdict", "rule"))):
                counts.update((t, v) for t in shared.value.tokens(h, p, r))
            keys = list(counts)
            yield pa.RecordBatch.from_pydict({"token": pa.array([k[0] for k in keys], pa.string()), "verdict": pa.array([k[1] for k in keys], pa.string()), "n": pa.array(list(counts.values()), pa.int64())})

    rows = judged.where("rule_verdict is not null").select("host", "path", "rule_verdict", "rule").mapInArrow(cut, "token string, verdict string, n long")
    sums = [F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0)).alias(v) for v in ("block", "allow")]
    whole = settle(rows.groupBy("token").agg(*sums, F.sum("n").alias("n")))
    top = most_frequent(whole, "n", most_words).collect()
    drop(whole)
    return {v: {r["token"]: r[v] for r in top if r[v]} for v in ("block", "allow")}


def learn(judged: DataFrame, words: Mapping[str, int], most_words: int = 50_000) -> UrlModel:
    """The model of these word counts and of the urls that rules label."""
    found = token_counts(judged, UrlModel(words), most_words)
    return UrlModel(words, found["block"], found["allow"])


def judge_urls(pages: DataFrame, documents: DataFrame | None = None, rules: Sequence[tuple[str, str, str]] = RULES, most_words: int = 50_000) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's log odds of every url.

    Words are learned from column `html` of pages, without its tags, and from `text` of documents, as far as given.
    """
    texts, tables = [], []
    if "html" in pages.columns:
        texts.append(F.regexp_replace(F.col("html").cast("string"), "<[^>]*>", " "))
        tables.append(pages)
    if documents is not None:
        texts.append(F.col("text"))
        tables.append(documents)
    judged = settle(with_rules(pages, rules))
    model = learn(judged, word_counts(texts, tables, most_words), most_words)
    shared = pages.sparkSession.sparkContext.broadcast(model)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            verdicts, odds = [], []
            for h, p, v in zip(b.column("host").to_pylist(), b.column("path").to_pylist(), b.column("rule_verdict").to_pylist()):
                own, o = m.verdict(h, p)
                verdicts.append(v or own)
                odds.append(o)
            cols = {c: b.column(c) for c in ("page_id", "host", "path", "rule")}
            yield pa.RecordBatch.from_pydict(cols | {"verdict": pa.array(verdicts, pa.string()), "block_odds": pa.array(odds, pa.float64())})

    return judged.mapInArrow(apply, "page_id long, host string, path string, rule string, verdict string, block_odds double")
