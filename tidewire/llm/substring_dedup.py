"""Repeated passages across documents, by a compressed FM-index per shard.

A window is `window` consecutive words. All places of one word sequence have the same least
5-gram (minimizer), so runs of windows with equal minimizer, with the words around them, are cut
out as segments and dealt to shards by minimizer: every occurrence of a window is in one shard.
A first pass over minimizers alone finds those that stand in one document only; their windows
cannot repeat, and no word of theirs is shuffled.

Each shard builds an FM-index of its distinct segments (Burrows-Wheeler transform over words,
wavelet tree of packed bit vectors with rank counts) and streams the segments against it: backward
search extends every window to the left word by word, all windows at once. The matching
statistic of a place is cut at the window length; the suffix interval of a full match holds all
occurrences, and the least document id in it decides which documents lose the window.

Documents are grouped in buckets by id. Segments are made distinct per bucket before they are
dealt, so a passage that a third of all documents share arrives once per bucket, not once per
document. Windows of a minimizer that stands in very many documents are dealt one by one, by their
own words, so no shard gets all of them. The answer to a bucket is spans of windows with the least
document that has them. Words travel as 64-bit codes, so windows are told apart by 832 bits.

Defined cases: null text has no words; shorter texts than a window lose nothing; equal doc_ids
are not smaller than each other; a null doc_id comes after all others, and null ids are equal; texts
of any length are coded in whole; empty tables give no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewire.llm.shingles import Words, concat, ngram_codes, places, release, releasing, slices, small_batches

ANCHOR = 5  # words of a minimizer
LAST = np.iinfo(np.int64).max
NO_ID = (1 << 63) - (1 << 40)  # rows without doc_id have this and some bits of their text's hash, to be dealt evenly


class BitVector:
    """Packed bits with rank: 1 bit and, for each 64, one count."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits, bitorder="little")
        words = len(bits) // 64 + 1
        self.words = np.pad(packed, (0, 8 * words - len(packed))).view(np.uint64)
        counts = np.bitwise_count(self.words)
        self.before = np.concatenate(([0], np.cumsum(counts)[:-1])).astype(np.int64)

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        w = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[w] + np.bitwise_count(self.words[w] & mask)


class WaveletTree:
    """Rank of symbols in a sequence, one bit vector per level, zeros first."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.bits = max(1, int(sigma - 1).bit_length())
        self.levels: list[tuple[BitVector, int]] = []
        x = symbols
        for level in range(self.bits - 1, -1, -1):
            ones = ((x >> level) & 1).astype(bool)
            self.levels.append((BitVector(ones), int(len(x) - ones.sum())))
            x = np.concatenate((x[~ones], x[ones]))
        every = np.arange(sigma)
        self.begin = self._descend(every, np.zeros(sigma, np.int64))

    def _descend(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k, (bits, zeros) in enumerate(self.levels):
            ones = bits.rank(at)
            at = np.where((symbol >> (self.bits - 1 - k)) & 1, zeros + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of each symbol before each position."""
        return self._descend(symbol, at) - self.begin[symbol]


class FmIndex:
    """FM-index of a word text; answers patterns of up to 16 words. Symbol 0 parts segments."""

    def __init__(self, text: np.ndarray):
        n = len(text)
        self.text = text
        rank = text.astype(np.int64)
        for step in (1, 2, 4, 8):
            follow = np.zeros(n, np.int64)
            follow[: max(0, n - step)] = rank[step:] + 1
            _, rank = np.unique(rank * (n + 2) + follow, return_inverse=True)
        self.order = np.argsort(rank, kind="stable")
        self.place = rank
        sigma = int(text.max()) + 1 if n else 1
        self.tree = WaveletTree(text[self.order - 1], sigma)
        self.first = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=sigma))))

    def search(self, starts: np.ndarray, length: int, chunk: int = 200_000) -> tuple[np.ndarray, np.ndarray]:
        """Suffix intervals of the patterns text[start : start + length], by backward search."""
        left, right = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        # neighbours in suffix order walk the same parts of the tree
        by_order = np.argsort(self.place[starts], kind="stable")
        for at in range(0, len(starts), chunk):
            rows = by_order[at : at + chunk]
            w = starts[rows]
            c = self.text[w + length - 1]
            lo, hi = self.first[c], self.first[c + 1]
            for k in range(length - 2, -1, -1):
                c = self.text[w + k]
                base = self.first[c]
                lo, hi = base + self.tree.rank(c, lo), base + self.tree.rank(c, hi)
            left[rows], right[rows] = lo, hi
        return left, right


def least_documents(segments: list[np.ndarray], documents: np.ndarray, window: int) -> list[np.ndarray]:
    """For every window of every segment the least document among all segments that hold it."""
    if not segments:
        return []
    codes = np.concatenate(segments)
    _, symbols = np.unique(codes, return_inverse=True)
    sizes = np.array([len(s) for s in segments])
    n = len(codes) + len(segments)
    begins = np.cumsum(sizes + 1) - (sizes + 1)
    text = np.zeros(n, np.int64)
    inner = np.arange(len(codes)) + np.repeat(np.arange(len(segments)), sizes)
    text[inner] = symbols + 1
    owner = np.repeat(np.arange(len(segments)), sizes + 1)
    index = FmIndex(text)
    counts = np.maximum(sizes - window + 1, 0)
    starts = np.repeat(begins, counts) + np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
    lo, hi = index.search(starts, window)
    # intervals of equal length patterns do not overlap: one minimum for each
    heads, where = np.unique(lo, return_inverse=True)
    ends = np.zeros(len(heads), np.int64)
    ends[where] = hi
    in_order = documents[owner[index.order]]
    bounds = np.stack((heads, ends), axis=1).ravel()
    least = np.minimum.reduceat(np.append(in_order, LAST), bounds)[::2] if len(heads) else np.zeros(0, np.int64)
    return np.split(least[where], np.cumsum(counts)[:-1])


class Batch:
    """Words, windows and minimizer runs of some texts."""

    def __init__(self, texts: pa.Array, window: int):
        self.words = Words(texts)
        self.sizes, self.begins, self.codes = self.words.sizes, self.words.begins, self.words.codes
        least = ngram_codes(self.codes, ANCHOR)
        span = window - ANCHOR + 1
        done = 1
        while done < span:
            step = min(done, span - done)
            least = np.minimum(least[:-step], least[step:]) if len(least) > step else least[:0]
            done += step
        counts = np.maximum(self.sizes - window + 1, 0)
        owner = np.repeat(np.arange(len(texts)), counts)
        starts = places(self.begins, counts)
        value = least[starts] if len(starts) else np.zeros(0, np.uint64)
        change = np.ones(len(starts), bool)
        if len(starts) > 1:
            change[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(change)
        self.run_windows = np.diff(np.append(first, len(starts)))
        self.run_start = starts[first]
        self.run_doc = owner[first]
        self.minimizer = value[first]

    def runs(self, tokens: np.ndarray, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, windows, text and minimizer of the runs of these minimizers; hot ones window by window."""
        pick = np.flatnonzero(_member(self.minimizer, tokens))
        times = np.where(_member(self.minimizer[pick], hot), self.run_windows[pick], 1)
        start = places(self.run_start[pick], times)
        pick = np.repeat(pick, times)
        return start, np.where(np.repeat(times > 1, times), 1, self.run_windows[pick]), self.run_doc[pick], self.minimizer[pick]

    def hashes(self, start: np.ndarray, windows: np.ndarray, window: int) -> np.ndarray:
        """64-bit hash of the words of each run, from running sums."""
        if not len(start):
            return np.zeros(0, np.uint64)
        with np.errstate(over="ignore"):
            stirred = self.codes * np.uint64(0x9FB21C651E98DF25)
            stirred ^= stirred >> np.uint64(28)
            size = (windows + window - 1).astype(np.int64)
            out = size.astype(np.uint64)
            alive, k = np.arange(len(start)), 0
            while len(alive):
                out[alive] = (out[alive] ^ stirred[start[alive] + k]) * np.uint64(0x9E3779B97F4A7C15)
                out[alive] ^= out[alive] >> np.uint64(32)
                k += 1
                if k >= window:
                    alive = alive[size[alive] > k]
        return out


def kept_texts(words: Words, gone: np.ndarray) -> pa.Array:
    """Of each text the words that are not gone, joined by one space."""
    n = len(words.sizes)
    owner = np.repeat(np.arange(n), words.sizes)[~gone]
    size = (words.ends - words.starts)[~gone] + 1  # a word and the space after it
    last = np.ones(len(owner), bool)
    last[:-1] = owner[1:] != owner[:-1]
    raw = np.append(words.data, np.uint8(32))[places(words.starts[~gone], size)]
    stops = np.cumsum(size)
    raw[stops - 1] = 32
    raw = np.delete(raw, stops[last] - 1)
    edges = np.append(0, np.cumsum(np.bincount(owner, size - last, n).astype(np.int64)))
    return pa.Array.from_buffers(pa.large_utf8(), n, [None, pa.py_buffer(edges), pa.py_buffer(raw)]).cast(pa.string())


def _bucket(ids: np.ndarray, n: int) -> np.ndarray:
    """As in remove_repeats, for arrays."""
    return ((ids ^ (ids >> 17) ^ (ids >> 34)) % n).astype(np.int32)


def _member(values: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Which values are in the sorted array."""
    if not len(of):
        return np.zeros(len(values), bool)
    at = np.minimum(np.searchsorted(of, values), len(of) - 1)
    return of[at] == values


def _blobs(table: pa.Table, column: str, kind: type) -> list[np.ndarray]:
    return [np.frombuffer(x, kind) for x in table.column(column).to_pylist()]


def remove_repeats(documents: DataFrame, window: int = 13, bucket_chars: int = 4_000_000, shard_chars: int = 5_000_000, hot: int = 20_000) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words that stay, joined by one space).

    A minimizer in more than `hot` documents of a batch of its shard is dealt window by window.
    """
    if not ANCHOR <= window <= 16:
        raise ValueError("windows of 5 to 16 words")
    chars = documents.select(F.sum(F.length("text"))).first()[0] or 0
    n_buckets = max(8, math.ceil(chars / bucket_chars)) | 1
    n_shards = max(8, math.ceil(chars / shard_chars))
    text = F.col("text").cast("string")
    no_id = F.lit(NO_ID) + F.pmod(F.xxhash64(text), F.lit(1 << 40))
    docs = documents.select(F.coalesce(F.col("doc_id").cast("long"), no_id).alias("doc_id"), text.alias("text"))

    @releasing
    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            ids = batch.column("doc_id").to_numpy()
            b = Batch(batch.column("text"), window)
            if not len(b.minimizer):
                continue
            token, doc = b.minimizer, ids[b.run_doc]
            order = np.lexsort((doc, token, token % np.uint64(n_shards)))
            token, doc = token[order], doc[order]
            new = np.ones(len(token), bool)
            new[1:] = (token[1:] != token[:-1]) | (doc[1:] != doc[:-1])
            token, doc = token[new], doc[new]
            shard = (token % np.uint64(n_shards)).astype(np.int32)
            cuts = np.flatnonzero(np.diff(shard)) + 1
            rows = [], [], [], []
            for s, t, d in zip(np.split(shard, cuts), np.split(token, cuts), np.split(doc, cuts)):
                base = int(d.min())
                wide = int(d.max()) - base >= 1 << 32
                rows[0].append(int(s[0]))
                rows[1].append(base)
                rows[2].append(t.tobytes())
                rows[3].append((d - base).astype(np.int64 if wide else np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(r, k) for r, k in zip(rows, (pa.int32(), pa.int64(), pa.binary(), pa.binary()))], ["shard", "base", "tokens", "docs"]
            )

    def repeated(table: pa.Table) -> pa.Table:
        tokens = _blobs(table, "tokens", np.uint64)
        docs_ = []
        for base, t, raw in zip(table.column("base").to_pylist(), tokens, table.column("docs").to_pylist()):
            docs_.append(np.frombuffer(raw, np.int64 if len(raw) == 8 * len(t) else np.uint32).astype(np.int64) + base)
        t, d = concat(tokens, np.uint64), concat(docs_, np.int64)
        order = np.argsort(t, kind="stable")
        t, d = t[order], d[order]
        head = np.flatnonzero(np.concatenate(([True], t[1:] != t[:-1]))) if len(t) else np.zeros(0, np.int64)
        real = np.minimum(d, NO_ID)
        lo, hi = (np.minimum.reduceat(real, head), np.maximum.reduceat(real, head)) if len(t) else (real, real)
        n = np.diff(np.append(head, len(t)))
        many, often = np.repeat(lo != hi, n), np.repeat(n > hot, n)
        bucket, t, often = _bucket(d[many], n_buckets), t[many], often[many]
        order = np.lexsort((t, often, bucket))
        bucket, t, often = bucket[order], t[order], often[order]
        cuts = np.flatnonzero((np.diff(bucket) != 0) | (np.diff(often) != 0)) + 1
        names, parts, marks = [], [], []
        if len(t):
            for b, part, mark in zip(np.split(bucket, cuts), np.split(t, cuts), np.split(often, cuts)):
                names.append(int(b[0]))
                parts.append(np.unique(part).tobytes())
                marks.append(bool(mark[0]))
        release()
        return pa.table({"bucket": pa.array(names, pa.int32()), "hot": pa.array(marks, pa.bool_()), "tokens": pa.array(parts, pa.binary())})

    def segments(docs_: pa.Table, tokens: pa.Table) -> pa.Table:
        empty = {"shard": pa.int32(), "bucket": pa.int32(), "seg": pa.binary(), "mini": pa.binary(), "hot": pa.binary(), "size": pa.binary(), "least": pa.binary(), "most": pa.binary(), "codes": pa.binary()}
        marks = tokens.column("hot").to_pylist()
        parts = _blobs(tokens, "tokens", np.uint64)
        shared = np.unique(concat(parts, np.uint64))
        if not len(shared) or not docs_.num_rows:
            return pa.table({k: pa.array([], v) for k, v in empty.items()})
        often = np.unique(concat([p for p, m in zip(parts, marks) if m], np.uint64))
        ids = docs_.column("doc_id").to_numpy()
        b = Batch(docs_.column("text").combine_chunks(), window)
        start, windows, own, mini = b.runs(shared, often)
        seg, doc = b.hashes(start, windows, window), np.minimum(ids, NO_ID)[own]
        order = np.lexsort((doc, seg))
        start, windows, mini, seg, doc = start[order], windows[order], mini[order], seg[order], doc[order]
        head = np.flatnonzero(np.concatenate(([True], seg[1:] != seg[:-1]))) if len(seg) else np.zeros(0, np.int64)
        least, most = doc[head], doc[np.append(head[1:], len(seg)) - 1]
        start, windows, mini, seg = start[head], windows[head], mini[head], seg[head]
        is_hot = _member(mini, often)
        shard = (np.where(is_hot, seg, mini) % np.uint64(n_shards)).astype(np.int32)
        order = np.argsort(shard, kind="stable")
        rows: list[tuple] = []
        bucket = int(_bucket(ids[:1], n_buckets)[0])
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            if not len(part):
                continue
            size = windows[part] + window - 1
            rows.append((int(shard[part[0]]), bucket, seg[part].tobytes(), mini[part].tobytes(), np.packbits(is_hot[part]).tobytes(), size.astype(np.uint32).tobytes(), least[part].tobytes(), most[part].tobytes(), b.codes[places(start[part], size)].tobytes()))
        cols = list(zip(*rows)) if rows else [()] * len(empty)
        release()
        return pa.table({k: pa.array(c, v) for (k, v), c in zip(empty.items(), cols)})

    def search(table: pa.Table) -> pa.Table:
        seg, mini, size = (_blobs(table, c, k) for c, k in (("seg", np.uint64), ("mini", np.uint64), ("size", np.uint32)))
        least, most, codes = (_blobs(table, c, k) for c, k in (("least", np.int64), ("most", np.int64), ("codes", np.uint64)))
        hots = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(s)).astype(bool) for x, s in zip(table.column("hot").to_pylist(), seg)]
        all_seg = concat(seg, np.uint64)
        names, first, where = np.unique(all_seg, return_index=True, return_inverse=True)
        lows = np.full(len(names), LAST)
        np.minimum.at(lows, where, concat(least, np.int64))
        all_size = concat(size, np.uint32).astype(np.int64)
        all_codes = concat(codes, np.uint64)
        begins = np.cumsum(all_size) - all_size
        found = least_documents([all_codes[begins[k] : begins[k] + all_size[k]] for k in first], lows, window)
        # runs of equal answers
        windows = all_size[first] - window + 1
        heads = np.cumsum(windows) - windows
        flat = concat(found, np.int64)
        cut = np.ones(len(flat), bool)
        cut[1:] = flat[1:] != flat[:-1]
        cut[heads] = True
        at = np.flatnonzero(cut)
        rs = np.repeat(np.arange(len(names)), windows)[at]
        ra = at - heads[rs]
        rb = np.append(at[1:], len(flat)) - heads[rs]
        rd = flat[at]
        from_, to = np.searchsorted(rs, np.arange(len(names))), np.searchsorted(rs, np.arange(len(names)), side="right")
        rows: list[tuple] = []
        at = 0
        for bucket, s, mn, mx, h in zip(table.column("bucket").to_pylist(), seg, mini, most, hots):
            mine = where[at : at + len(s)]
            at += len(s)
            n = to[mine] - from_[mine]
            own = np.repeat(np.arange(len(s)), n)
            pick = places(from_[mine], n)
            useful = rd[pick] < mx[own]
            own, pick = own[useful], pick[useful]
            if len(pick):
                rows.append((bucket, s[own].tobytes(), mn[own].tobytes(), np.packbits(h[own]).tobytes(), ra[pick].astype(np.uint32).tobytes(), rb[pick].astype(np.uint32).tobytes(), rd[pick].tobytes()))
        cols = list(zip(*rows)) if rows else [()] * 7
        kinds = (pa.int32(), *[pa.binary()] * 6)
        release()
        return pa.table({c: pa.array(v, k) for c, v, k in zip(("bucket", "seg", "mini", "hot", "start", "stop", "least"), cols, kinds)})

    def keep(docs_: pa.Table, spans: pa.Table) -> pa.Table:
        ids = docs_.column("doc_id").to_numpy()
        if not len(ids):
            return pa.table({"doc_id": pa.array([], pa.int64()), "n_words": pa.array([], pa.int64()), "n_removed": pa.array([], pa.int64()), "kept": pa.array([], pa.string())})
        b = Batch(docs_.column("text").combine_chunks(), window)
        ids = np.minimum(ids, NO_ID)
        depth = np.zeros(len(b.codes) + 1, np.int32)
        if spans.num_rows and len(b.minimizer):
            segs = _blobs(spans, "seg", np.uint64)
            seg, mini, start, stop, least = (concat(_blobs(spans, c, k), k) for c, k in (("seg", np.uint64), ("mini", np.uint64), ("start", np.uint32), ("stop", np.uint32), ("least", np.int64)))
            is_hot = concat([np.unpackbits(np.frombuffer(x, np.uint8), count=len(s)).astype(bool) for x, s in zip(spans.column("hot").to_pylist(), segs)], bool)
            run_start, windows, own_doc, _ = b.runs(np.unique(mini), np.unique(mini[is_hot]))
            order = np.argsort(seg, kind="stable")
            seg, start, stop, least = seg[order], start[order].astype(np.int64), stop[order].astype(np.int64), least[order]
            mine = b.hashes(run_start, windows, window)
            lo, hi = np.searchsorted(seg, mine), np.searchsorted(seg, mine, side="right")
            n = hi - lo
            own = np.repeat(np.arange(len(run_start)), n)
            pick = places(lo, n)
            smaller = least[pick] < ids[own_doc[own]]
            own, pick = own[smaller], pick[smaller]
            at = run_start[own]
            np.add.at(depth, at + start[pick], 1)
            np.add.at(depth, at + stop[pick] - 1 + window, -1)
        gone = np.cumsum(depth[:-1]) > 0
        removed = np.bincount(np.repeat(np.arange(len(ids)), b.sizes)[gone], minlength=len(ids))
        out = pa.table({"doc_id": pa.array(ids, mask=ids == NO_ID), "n_words": pa.array(b.sizes, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "kept": kept_texts(b.words, gone)})
        release()
        return out

    blobs = small_batches(docs).mapInArrow(anchors, "shard int, base long, tokens binary, docs binary")
    shared = blobs.groupBy("shard").applyInArrow(repeated, "bucket int, hot boolean, tokens binary")
    d = F.col("doc_id")
    bucket = F.pmod(d.bitwiseXOR(F.shiftright(d, 17)).bitwiseXOR(F.shiftright(d, 34)), F.lit(n_buckets)).cast("int")
    bucketed = docs.withColumn("bucket", bucket).groupBy("bucket")
    cut = bucketed.cogroup(shared.groupBy("bucket")).applyInArrow(
        segments, "shard int, bucket int, seg binary, mini binary, hot binary, size binary, least binary, most binary, codes binary"
    )
    spans = cut.groupBy("shard").applyInArrow(search, "bucket int, seg binary, mini binary, hot binary, start binary, stop binary, least binary")
    return bucketed.cogroup(spans.groupBy("bucket")).applyInArrow(keep, "doc_id long, n_words long, n_removed long, kept string")
