"""Language identification with a byte convolutional network.

The network reads windows of fixed length: each byte has a small embedding, filters of several
widths slide over the window, their largest responses (max pooling) feed a softmax layer. It is
trained in numpy on a bounded sample of labelled rows (`per_language` rows of each language, fewer
of each beyond `many` languages, and of each row the PIECE characters from a place that a hash of its
id gives; every labelled language is learned) and applied to every window of every whole text in
batches; the scores of a text's windows are averaged by their length.

The softmax shares all of a text among the learned languages, however strange it is, so rejecting
has a score of its own: the share of the text's letter trigrams that a language has. `with_rejection` counts
these trigrams over the whole texts of all training rows, and learns the least share of each language on all held-out rows.

Defined cases: null texts and texts without a letter are `und` with score 0; without any labelled
row every text is `und` with score 0; ties go to the language that sorts first; repeated rows are
scored one by one; empty tables give no rows; other columns of the input are ignored. A text without three letters
in a row, and a language without held-out rows, give no ground for rejecting.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from tidewire.llm.shingles import releasing, slices, small_batches
from tidewire.runtime import drop, settle, unused

WINDOW = 192
WIDTHS = (2, 3, 4, 5)
FILTERS = 8
EMBED = 6
SPAN = max(WIDTHS)
PIECE = 2 * WINDOW  # characters of each sampled row
LEAST_ROWS = 30  # of a language with that many, so that the sample does not miss it
BINS = 1 << 16  # hashed letter trigrams
STEPS = 10_000  # in which shares of trigrams are counted


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the ids that training never sees."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5) == 0


@dataclass
class Model:
    """Weights; convolution of all widths as one matrix over SPAN bytes, shorter filters zero-padded."""

    languages: list[str]
    embed: np.ndarray  # 256 x EMBED, byte 0 is padding
    conv: np.ndarray  # SPAN * EMBED x filters
    bias: np.ndarray
    out: np.ndarray  # filters x languages
    out_bias: np.ndarray
    seen: np.ndarray | None = None  # languages x BINS, the trigrams of the training rows
    least: np.ndarray | None = None  # per language, the least share of seen trigrams


def _mask() -> np.ndarray:
    """Which weights of the joint convolution a filter of each width has."""
    mask = np.zeros((SPAN, EMBED, len(WIDTHS) * FILTERS), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width, :, k * FILTERS : (k + 1) * FILTERS] = 1
    return mask.reshape(SPAN * EMBED, -1)


def _unfold(x: np.ndarray) -> np.ndarray:
    """n x L x EMBED to n x (L - SPAN + 1) x (SPAN * EMBED)."""
    n, length, e = x.shape
    x = np.ascontiguousarray(x)
    s0, s1, s2 = x.strides
    return np.lib.stride_tricks.as_strided(x, (n, length - SPAN + 1, SPAN * e), (s0, s1, s2))


def forward(m: Model, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Probabilities; with what the backward pass needs (unfolded input, pooled values, places)."""
    x = m.embed[windows]
    cols = _unfold(x)
    n, places, _ = cols.shape
    z = (cols.reshape(n * places, -1) @ m.conv).reshape(n, places, -1)
    at = z.argmax(axis=1)
    pooled = np.maximum(np.take_along_axis(z, at[:, None, :], 1)[:, 0] + m.bias, 0)
    logits = pooled @ m.out + m.out_bias
    logits -= logits.max(axis=1, keepdims=True)
    p = np.exp(logits)
    return p / p.sum(axis=1, keepdims=True), cols, pooled, at


def train(windows: np.ndarray, labels: np.ndarray, languages: list[str], epochs: int = 5, batch: int = 64, rate: float = 4e-3, seed: int = 7) -> Model:
    """Adam on cross entropy."""
    rng = np.random.default_rng(seed)
    k, mask = len(WIDTHS) * FILTERS, _mask()
    m = Model(
        languages,
        rng.normal(0, 0.5, (256, EMBED)).astype(np.float32),
        (rng.normal(0, 0.3, (SPAN * EMBED, k)).astype(np.float32)) * mask,
        np.zeros(k, np.float32),
        rng.normal(0, 0.3, (k, len(languages))).astype(np.float32),
        np.zeros(len(languages), np.float32),
    )
    m.embed[0] = 0
    names = ("embed", "conv", "bias", "out", "out_bias")
    first = {a: np.zeros_like(getattr(m, a)) for a in names}
    second = {a: np.zeros_like(getattr(m, a)) for a in names}
    step = 0
    for epoch in range(epochs):
        for rows in np.array_split(rng.permutation(len(windows)), max(1, len(windows) // batch)):
            w, y = windows[rows], labels[rows]
            p, cols, pooled, at = forward(m, w)
            n = len(rows)
            d = p.copy()
            d[np.arange(n), y] -= 1
            d /= n
            back = (d @ m.out.T) * (pooled > 0)
            taken = cols[np.arange(n)[:, None], at]  # n x filters x SPAN*EMBED
            grads = {
                "out": pooled.T @ d,
                "out_bias": d.sum(0),
                "bias": back.sum(0),
                "conv": np.einsum("nfc,nf->cf", taken, back) * mask,
            }
            into = (back[:, :, None] * m.conv.T[None]).reshape(n, -1, SPAN, EMBED)
            spots = np.take_along_axis(w[:, None, :].repeat(at.shape[1], 1), at[:, :, None] + np.arange(SPAN), 2)
            embed = np.zeros_like(m.embed)
            np.add.at(embed, spots.ravel(), into.reshape(-1, EMBED))
            embed[0] = 0
            grads["embed"] = embed
            step += 1
            lr = rate * (1 - epoch / (epochs + 1))
            for a in names:
                g = grads[a]
                first[a] = 0.9 * first[a] + 0.1 * g
                second[a] = 0.99 * second[a] + 0.01 * g * g
                change = lr * (first[a] / (1 - 0.9**step)) / (np.sqrt(second[a] / (1 - 0.99**step)) + 1e-8)
                setattr(m, a, (getattr(m, a) - change).astype(np.float32))
    return m


def window_table(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All windows of texts that lie at [begin, end) of data: starts, ends, owners, lengths."""
    n = np.maximum(1, -(-(ends - begins) // window))
    owner = np.repeat(np.arange(len(begins)), n)
    k = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    start = begins[owner] + k * window
    stop = np.minimum(start + window, ends[owner])
    return start, stop, owner, stop - start


def _cut(data: np.ndarray, start: np.ndarray, stop: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Bytes of the windows, filled up with 0."""
    at = start[:, None] + np.arange(window + SPAN - 1)
    out = data[np.minimum(at, len(data) - 1)] if len(data) else np.zeros(at.shape, np.uint8)
    return np.where(at < stop[:, None], out, 0).astype(np.uint8)


def score_texts(m: Model, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, chunk: int = 512) -> np.ndarray:
    """Mean probabilities of each text over its windows."""
    start, stop, owner, length = window_table(data, begins, ends)
    total = np.zeros((len(begins), len(m.languages)))
    for at in range(0, len(start), chunk):
        part = slice(at, at + chunk)
        p = forward(m, _cut(data, start[part], stop[part]))[0]
        np.add.at(total, owner[part], p * np.maximum(length[part], 1)[:, None])
    return total / total.sum(axis=1, keepdims=True)


_LOW = np.arange(256, dtype=np.uint16)
_LOW[65:91] += 32
_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in _LOW])


def trigrams(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bin of the three bytes at every place, and whether all three belong to letters; case is ignored for ASCII."""
    if len(data) < 3:
        return np.zeros(0, np.uint16), np.zeros(0, bool)
    low = _LOW[data]
    good = _LETTER[low]
    bins = low[:-2] * np.uint16(40503) + low[1:-1] * np.uint16(30011) + low[2:] * np.uint16(10007)  # modulo BINS
    return bins, good[:-2] & good[1:-1] & good[2:]


def seen_share(seen: np.ndarray, raw: np.ndarray) -> float:
    """Share of the letter trigrams of one text that a language has seen, 1 without any."""
    bins, good = trigrams(raw)
    return float(seen[bins[good]].mean()) if good.any() else 1.0


def familiar(m: Model, data: np.ndarray, begins: np.ndarray, ends: np.ndarray, best: np.ndarray) -> np.ndarray:
    """Which texts the predicted language, or else any other one, knows well enough."""
    out = np.ones(len(begins), bool)
    for k in range(len(begins)):
        bins, good = trigrams(data[begins[k] : ends[k]])
        bins = bins[good]
        if len(bins) and m.seen[best[k]][bins].mean() < m.least[best[k]]:
            out[k] = any(m.seen[j][bins].mean() >= m.least[j] for j in range(len(m.languages)))
    return out


def _labelled(documents: DataFrame) -> DataFrame:
    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("doc_id").isNotNull())
    return known.select("doc_id", F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))


def _draw(seed: int) -> Column:
    """A number in [0, 1) from the id."""
    return F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11).cast("double") / float(1 << 53)


def _piece(draw: Column) -> Column:
    """Two windows of each sampled text, at places given by the hash."""
    place = F.lit(1) + F.floor(draw * 997_003) % F.greatest(F.length("text") - PIECE, F.lit(1))
    return F.expr("text").substr(place.cast("int"), F.lit(PIECE))


def fit(documents: DataFrame, per_language: int = 700, many: int = 200, seed: int = 7) -> Model | None:
    """Train on at most per_language rows of each language, chosen by a hash of the id.

    Beyond `many` languages the same total is shared by all, down to LEAST_ROWS of each.

    The sample is the documented bound: rows whose hash falls under the share that gives about
    per_language rows of their language; every labelled row outside of the held-out part counts
    for that share.
    """
    known = _labelled(documents).where(~held_out(F.col("doc_id")))
    counts = settle(known.groupBy("lang").agg(F.count(F.lit(1)).alias("_n")))
    languages = sorted(r["lang"] for r in counts.select("lang").collect())
    if not languages:
        return None
    each = per_language if len(languages) <= many else max(min(per_language, LEAST_ROWS), per_language * many // len(languages))
    draw = _draw(seed)
    rows = (
        known.join(F.broadcast(counts), "lang")
        .where(draw < F.lit(float(each)) / F.col("_n"))
        .select("lang", "doc_id", _piece(draw).alias("piece"))
        .limit(2 * each * len(languages))
        .toPandas()
        .sort_values(["doc_id", "piece"])
    )
    place = {lang: k for k, lang in enumerate(languages)}
    rng = np.random.default_rng(seed)
    windows, labels = [], []
    for lang, piece in zip(rows["lang"], rows["piece"]):
        raw = piece.encode("utf-8")
        if not raw.strip():
            continue
        cut = int(rng.integers(8, WINDOW))
        for part in (raw[:WINDOW], raw[WINDOW : 2 * WINDOW], raw[:cut]):
            if len(part) >= 4 or part is raw:
                windows.append(np.pad(np.frombuffer(part, np.uint8), (0, WINDOW + SPAN - 1 - len(part))))
                labels.append(place[lang])
    if not windows:
        return None
    return train(np.array(windows), np.array(labels), languages, seed=seed)


def _per_text(rows: DataFrame, languages: list[str], schema: str, each: Callable[[Iterator[tuple[int, np.ndarray]]], Iterator[tuple[np.ndarray, ...]]]) -> DataFrame:
    """What `each` makes of the (number of the language, bytes) of all texts of a task that have one of the languages."""
    place = {lang: k for k, lang in enumerate(languages)}
    names = [f.split()[0] for f in schema.split(", ")]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def texts() -> Iterator[tuple[int, np.ndarray]]:
            for part in (part for batch in batches for part in slices(batch, column="text")):
                for lang, text in zip(part.column("lang").to_pylist(), part.column("text").cast(pa.binary())):
                    if lang in place:
                        yield place[lang], np.frombuffer(text.as_buffer(), np.uint8)

        for found in each(texts()):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names)

    return small_batches(rows.select("lang", "text")).mapInArrow(run, schema)


def trigrams_of(documents: DataFrame, languages: list[str], one_in: int = 700) -> np.ndarray:
    """languages x BINS: the letter trigrams that at least one in `one_in` of all training rows of a language has."""

    def each(texts: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
        counts: dict[int, np.ndarray] = {}  # the last place counts the rows
        mark = np.zeros(BINS + 1, bool)
        for k, raw in texts:
            bins, good = trigrams(raw)
            mark[bins[good]] = mark[BINS] = True
            there = np.flatnonzero(mark)
            counts.setdefault(k, np.zeros(BINS + 1, np.int64))[there] += 1
            mark[there] = False
        for k, n in counts.items():
            there = np.flatnonzero(n)
            yield np.full(len(there), k, np.int32), there.astype(np.int32), n[there]

    rows = _labelled(documents).where(~held_out(F.col("doc_id")))
    total = settle(_per_text(rows, languages, "place int, bin int, n long", each).groupBy("place", "bin").agg(F.sum("n").alias("n")))
    size = total.where(F.col("bin") == BINS).select("place", F.col("n").alias("rows"))
    often = total.where(F.col("bin") < BINS).join(F.broadcast(size), "place").where(F.col("n") * one_in >= F.col("rows")).select("place", "bin").toPandas()
    drop(total)
    seen = np.zeros((len(languages), BINS), bool)
    seen[often["place"].to_numpy(int), often["bin"].to_numpy(int)] = True
    return seen


def with_rejection(model: Model | None, documents: DataFrame) -> Model | None:
    """model with the trigrams of each language, and half of the share of them that 99 % of its held-out rows reach.

    All labelled rows count with their whole texts. Shares are counted in steps of 1 / STEPS, so a language has no more
    counts than that, however many rows; the driver gets one row of each language.
    """
    if model is None:
        return None
    seen = trigrams_of(documents, model.languages)
    known = documents.sparkSession.sparkContext.broadcast(seen)

    def each(texts: Iterator[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, ...]]:
        counts = Counter((k, int(seen_share(known.value[k], raw) * STEPS)) for k, raw in texts)
        if counts:
            yield *np.array(list(counts), np.int32).T, np.array(list(counts.values()), np.int64)

    rows = _labelled(documents).where(held_out(F.col("doc_id")))
    steps = _per_text(rows, model.languages, "place int, step int, n long", each).groupBy("place", "step").agg(F.sum("n").alias("n"))
    mine = Window.partitionBy("place")
    below = F.coalesce(F.sum("n").over(mine.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    reached = steps.withColumns({"below": below, "rows": F.sum("n").over(mine)}).where(F.col("below") * 100 <= F.col("rows"))
    least = np.zeros(len(model.languages))
    for r in reached.groupBy("place").agg(F.max("step").alias("step")).collect():  # one row of each language
        least[r["place"]] = r["step"] / STEPS / 2
    return replace(model, seen=seen, least=least)


def _predicted(m: Model | None, text: pa.Array, letters: np.ndarray) -> tuple[pa.Array, pa.Array, pa.Array]:
    """Language and score of each text of a batch, and whether it is not rejected."""
    text = text.cast(pa.binary())
    if m is None or not len(text):
        return pa.array(["und"] * len(text), pa.string()), pa.array(np.zeros(len(text)), pa.float64()), pa.array(np.zeros(len(text), bool))
    offsets = np.frombuffer(text.buffers()[1], np.int32)[text.offset : text.offset + len(text) + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    p = score_texts(m, data, offsets[:-1], offsets[1:])
    best = p.argmax(axis=1)
    names = np.where(letters, np.array(m.languages, object)[best], "und").tolist()
    scores = np.where(letters, np.clip(p[np.arange(len(p)), best], 0.0, 1.0), 0.0)
    known = letters if m.least is None else letters & familiar(m, data, offsets[:-1], offsets[1:], best)
    return pa.array(names, pa.string()), pa.array(scores, pa.float64()), pa.array(known)


def with_language(rows: DataFrame, model: Model | None, text: str = "text", pred: str = "lang_pred", score: str = "score", known: str | None = None) -> DataFrame:
    """rows with two more columns, the predicted language and its score; with `known`, whether the text is not rejected."""
    has, whole = unused(rows, "_letters"), unused(rows, "_text")
    inner = rows.withColumn(has, F.coalesce(F.col(text).rlike(r"\p{L}"), F.lit(False))).withColumn(
        whole, F.coalesce(F.col(text).cast("string"), F.lit(""))
    )
    shared = rows.sparkSession.sparkContext.broadcast(model)
    names, added = rows.columns, [pred, score, known] if known else [pred, score]

    @releasing
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in (part for whole_batch in batches for part in slices(whole_batch, column=whole)):
            letters = batch.column(has).to_numpy(zero_copy_only=False).astype(bool)
            found = _predicted(m, batch.column(whole), letters)[: len(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *found], [*names, *added])

    kinds = (StringType(), DoubleType(), BooleanType())
    schema = StructType([*rows.schema.fields, *(StructField(c, t) for c, t in zip(added, kinds))])
    # mapInArrow can't take every name, so columns go in by place
    return small_batches(inner.toDF(*[f"_{k}" for k in range(len(names))], has, whole)).mapInArrow(run, schema)


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row."""
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "text"
    )
    return with_language(rows, model).drop("text")


def predict_languages(documents: DataFrame, per_language: int = 700) -> DataFrame:
    """Train on the labelled part and predict every row."""
    return identify(documents, fit(documents, per_language))
