"""Best-fit decreasing packing of tokenised documents into sequences of fixed capacity.

Best-fit decreasing only looks at lengths, and lengths are whole numbers up to the capacity, so
the whole order of placements is decided from a histogram of at most `capacity` counts: the
driver holds that, never the documents. A segment tree over remaining capacities finds the
tightest open bin in logarithmic time; equal documents that would go one after the other into
bins of equal room are placed as one run, which gives the same packing as one by one. Each piece
then finds its run from its rank among the pieces of its length, counted in salted parts whose
number grows with the pieces of that length, so no length is a single task.

Defined cases: null text is empty and becomes one piece of the one closing id; documents longer
than the capacity are cut into full pieces and a last shorter one, whatever their length; repeated
rows (and rows of one id) are packed one by one; an empty table gives no rows; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import json
import re
import zlib
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewire.llm.shingles import codes_at, places, raw_texts, releasing, slices, small_batches
from tidewire.runtime import settle

CAPACITY = 2048
PART = 100_000  # pieces of one length that one task numbers, about


class RoomTree:
    """Segment tree over room 0..capacity that says which amounts of room some open bin has."""

    def __init__(self, capacity: int):
        self.base = 1 << max(1, (capacity + 1).bit_length())
        self.open = bytearray(2 * self.base)

    def set(self, room: int, value: bool) -> None:
        i = room + self.base
        self.open[i] = value
        while i > 1:
            i >>= 1
            self.open[i] = self.open[2 * i] | self.open[2 * i + 1]

    def tightest(self, need: int) -> int | None:
        """The least room >= need that is open, None if there is none."""
        i = need + self.base
        if self.open[i]:
            return need
        while i > 1:
            if not i & 1 and self.open[i + 1]:
                i += 1
                break
            i >>= 1
        else:
            return None
        while i < self.base:
            i = 2 * i if self.open[2 * i] else 2 * i + 1
        return i - self.base


def plan_runs(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """Runs (length, first rank, pieces, first bin, pieces a bin, offset) and the number of bins.

    A run puts its pieces, by rank, `pieces a bin` at a time, into consecutive bins from
    `first bin` on, the first piece of each bin at `offset`.
    """
    tree, free, bins, runs = RoomTree(capacity), {}, 0, []

    def add(room: int, first: int, n: int) -> None:
        if room and n:
            free.setdefault(room, deque()).append((first, n))
            tree.set(room, True)

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            each = (room or capacity) // length
            if room is None:
                first, have = bins, -(-left // each)
                bins += have
                room = capacity
            else:
                first, have = free[room].popleft()
                use = min(have, -(-left // each))
                if have > use:
                    free[room].appendleft((first + use, have - use))
                if not free[room]:
                    tree.set(room, False)
                have = use
            n = min(left, have * each)
            runs.append((length, rank, n, first, each, capacity - room))
            full = n // each
            add(room - each * length, first, full)
            if n % each:
                add(room - (n % each) * length, first + full, 1)
            left, rank = left - n, rank + n
    return runs, bins


_SECOND = 0x6A09E667F3BCC909  # key of the second code of a piece
_SPACE = re.compile(rb"[\x20\x09-\x0d]")
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _alphabet() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _kinds() -> np.ndarray:
    """0 for white space, 1 for bytes of letters, 2 for digits, 3 for signs; of lower-cased plain texts."""
    kind = np.full(256, 3, np.uint8)
    kind[[0x20, *range(0x09, 0x0E)]] = 0
    kind[ord("a") : ord("z") + 1] = 1
    kind[0x80:] = 1
    kind[ord("0") : ord("9") + 1] = 2
    return kind


_KIND = _kinds()


def _odd(data: np.ndarray) -> np.ndarray:
    """Bytes that are not plain: characters beyond U+00FF and those between letters, and the start of a special token.

    Plain ones are kept by NFC and are lower-cased one by one.
    """
    before = np.append(np.uint8(0), data[:-1])
    behind = np.append(data[1:], np.uint8(0))
    second = (before == 0xC3) & (data != 0x97) & (data != 0xB7)
    return ((data >= 0x80) & (data != 0xC3) & ~second) | ((data == ord("<")) & (behind == ord("|")))


def plain_pieces(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plain text lower-cased, and where its pieces start and end: by the pattern _SPLIT, in whole arrays."""
    low = data.copy()
    low[(data >= 65) & (data <= 90)] += 32
    second = np.append(False, data[:-1] == 0xC3)
    low[second & (data >= 0x80) & (data <= 0x9E)] += 32
    kind = _KIND[low]
    cut = np.ones(len(low) + 1, bool)
    cut[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == 2)
    # a sign run that begins with an apostrophe: 's 't 'm 'd 're 've 'll are pieces of their own
    at = np.flatnonzero((low == ord("'")) & cut[:-1])
    one, two = (np.append(low, np.zeros(2, np.uint8))[at + k] for k in (1, 2))
    size = np.where(np.isin(one, np.frombuffer(b"stmd", np.uint8)), 2, 0)
    e, l = ord("e"), ord("l")  # noqa: E741
    size[((one == ord("r")) | (one == ord("v"))) & (two == e) | (one == l) & (two == l)] = 3
    at, size = at[size > 0], size[size > 0]
    cut[at + 1] = False
    cut[at + size] = True
    edges = np.flatnonzero(cut)
    word = kind[edges[:-1]] > 0
    return low, edges[:-1][word], edges[1:][word]


class WordIds:
    """Token ids of texts, piece by piece, with a bounded cache of pieces.

    A tokenizer that drops white space, lower-cases and marks word ends encodes each letter run,
    digit or sign run on its own. So the pieces of a group of texts are found and coded in whole
    arrays, and only new ones are encoded, many in one call and without the tracking of offsets; the
    ids that end a word part them again. Known pieces stand in plain arrays, at most `most` of them;
    those asked for last stay.
    Texts with other than plain Latin characters go word by word by the tokenizer's own rules, and
    a tokenizer of another kind gets whole texts.
    """

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.most = most
        self.words: dict[bytes, bytes] = {}
        # of the pieces known so far: code in order, where its ids stand in `flat`, how many, when it was last asked for
        # and a second code of another key, so pieces are told apart by 128 bits
        self.codes, self.second, self.at = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.asked = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.flat, self.clock = np.zeros(0, "<u4"), 0
        model, parts = self.tokenizer.model, [self.tokenizer.normalizer, self.tokenizer.pre_tokenizer]
        norm, cut = (json.loads(x.__getstate__()) if x is not None else {} for x in parts)
        split = (cut.get("pretokenizers") or [{}])[0]
        self.by_piece = (
            type(model).__name__ == "BPE" and model.end_of_word_suffix == "</w>" and not model.dropout and not model.ignore_merges
            and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]
            and split.get("pattern") == {"Regex": _SPLIT} and split.get("invert") is True
        )
        if self.by_piece:
            self.bare = Tokenizer(model)
            self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
            self.letters = _alphabet() | {ord("\n"): "\n"}
            ends = [k for w, k in self.tokenizer.get_vocab(with_added_tokens=False).items() if w.endswith("</w>")]
            self.ends = np.zeros(max(ends) + 1, bool)
            self.ends[ends] = True

    def _encoded(self, new: list[bytes], most: int = 100) -> tuple[np.ndarray, np.ndarray]:
        """The ids of plain pieces one after the other, and where each piece's end."""
        parts = [b"\n".join(new[at : at + most]).decode("latin-1").translate(self.letters) for at in range(0, len(new), most)]
        ids = np.concatenate([np.array(e.ids, dtype="<u4") for e in self.bare.encode_batch_fast(parts, add_special_tokens=False)])
        stops = np.flatnonzero(self.ends[np.minimum(ids, len(self.ends) - 1)] & (ids < len(self.ends))) + 1
        if len(stops) != len(new):
            raise ValueError("pieces and word ends do not agree")
        return ids, stops

    def _forget(self, most: int) -> None:
        """Keep the pieces that were asked for last."""
        if len(self.codes) <= most:
            return
        keep = np.sort(np.argpartition(-self.asked, most)[:most])
        self.flat = self.flat[places(self.at[keep], self.size[keep])]
        self.codes, self.second, self.size, self.asked = self.codes[keep], self.second[keep], self.size[keep], self.asked[keep]
        self.at = np.cumsum(self.size) - self.size

    def _learn(self, codes: np.ndarray, second: np.ndarray, new: list[bytes]) -> None:
        """Encode these pieces, of which none is known, and put them among the others."""
        self._forget(max(0, self.most - len(codes)))
        ids, stops = self._encoded(new)
        starts = np.append(0, stops[:-1])
        every = np.concatenate((self.codes, codes))
        order = np.argsort(every, kind="stable")
        self.codes = every[order]
        self.second = np.concatenate((self.second, second))[order]
        self.at = np.concatenate((self.at, starts + len(self.flat)))[order]
        self.size = np.concatenate((self.size, stops - starts))[order]
        self.asked = np.concatenate((self.asked, np.full(len(codes), self.clock)))[order]
        self.flat = np.concatenate((self.flat, ids))

    def _find(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of codes among the known ones, and which are known."""
        if not len(self.codes):
            return np.zeros(len(codes), np.int64), np.zeros(len(codes), bool)
        at = np.minimum(np.searchsorted(self.codes, codes), len(self.codes) - 1)
        return at, self.codes[at] == codes

    def _plain(self, texts: list[bytes]) -> list[bytes]:
        """The ids of plain texts."""
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        low, starts, ends = plain_pieces(data)
        once = pa.array(codes_at(low, starts, ends)).dictionary_encode()
        where, codes = once.indices.to_numpy(), once.dictionary.to_numpy()
        second = codes_at(low, starts, ends, key=_SECOND)
        first = np.zeros(len(codes), np.int64)
        first[where[::-1]] = np.arange(len(where))[::-1]
        at, known = self._find(codes)
        if (second[first][where] != second).any() or (self.second[at[known]] != second[first][known]).any():
            return [self._words(t) for t in texts]  # two pieces of one code: by their bytes
        self.clock += 1
        self.asked[at[known]] = self.clock
        if not known.all():
            some = first[~known]
            raw = low.tobytes()
            self._learn(codes[~known], second[some], [raw[i:j] for i, j in zip(starts[some].tolist(), ends[some].tolist())])
            at, _ = self._find(codes)
        size = self.size[at][where]
        ids = self.flat[places(self.at[at][where], size)].tobytes()
        stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        upto = np.append(0, np.cumsum(size))[np.searchsorted(starts, stops)].tolist()
        return [ids[4 * a : 4 * z] for a, z in zip([0, *upto], upto)]

    def _learn_words(self, new: list[bytes]) -> None:
        """Encode whole words by the tokenizer's own rules; offsets part their ids."""
        for at in range(0, len(new), 1000):
            part = [w.decode() for w in new[at : at + 1000]]
            found = self.tokenizer.encode("\n".join(part), add_special_tokens=False)
            sizes = np.fromiter(map(len, part), np.int64, len(part)) + 1
            begin = np.fromiter((o[0] for o in found.offsets), np.int64, len(found.ids))
            edges = np.append(np.searchsorted(begin, np.cumsum(sizes) - sizes), len(found.ids)).tolist()
            raw = np.array(found.ids, dtype="<u4").tobytes()
            for k, w in enumerate(new[at : at + 1000]):
                self.words[w] = raw[4 * edges[k] : 4 * edges[k + 1]]

    def _words(self, text: bytes) -> bytes:
        """The ids of any text, word by word."""
        words = text.split()
        new = set(words).difference(self.words)
        if len(self.words) + len(new) > self.most // 10:
            self.words, new = {}, set(words)
        self._learn_words(list(new))
        return b"".join(map(self.words.__getitem__, words))

    def _group(self, texts: list[bytes]) -> list[bytes]:
        data = np.frombuffer(b"\n".join(texts), np.uint8)
        stops = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)) + 1)
        odd = np.append(0, np.cumsum(_odd(data)))[np.minimum(np.append(0, stops), len(data))]
        plain = (odd[1:] == odd[:-1]).tolist()
        ids = iter(self._plain([t for t, p in zip(texts, plain) if p]) if any(plain) else ())
        return [next(ids) if p else self._words(t) for t, p in zip(texts, plain)]

    def _parts(self, text: bytes, size: int) -> Iterator[bytes]:
        """The text, in parts that end at white space."""
        at = 0
        while len(text) - at > size and (gap := _SPACE.search(text, at + size)):
            yield text[at : gap.start()]
            at = gap.end()
        yield text[at:]

    def encode(self, texts: list[bytes], group: int = 2 << 20) -> Iterator[bytes]:
        """The ids of each text as little-endian unsigned 32-bit numbers."""
        if not self.by_piece:
            for found in self.tokenizer.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False):
                yield np.array(found.ids, dtype="<u4").tobytes()
            return
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto]) <= group):
                size += len(texts[upto])
                upto += 1
            if size > group:  # one long text
                yield b"".join(self._group([part])[0] for part in self._parts(texts[at], group))
            else:
                yield from self._group(texts[at:upto])
            at = upto


PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document: its ids and a closing id 0, cut at the capacity."""
    schema = PIECE_SCHEMA + (", ids binary" if keep_ids else "")

    @releasing
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = WordIds(tokenizer)
        for batch in (part for whole in batches for part in slices(whole)):
            rows: list[tuple] = []
            docs = batch.column("doc_id").to_pylist()
            for doc, raw in zip(docs, encoder.encode(list(raw_texts(batch.column("text"))))):
                raw += b"\0\0\0\0"
                step = 4 * capacity
                for k, at in enumerate(range(0, len(raw), step)):
                    part = raw[at : at + step]
                    rows.append((doc, k, at // 4, len(part) // 4, zlib.crc32(part)) + ((part,) if keep_ids else ()))
            if rows:
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.binary()] * keep_ids
                names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)

    return small_batches(documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(cut, schema)


def pack(documents: DataFrame, tokenizer: str, capacity: int = CAPACITY, part: int = PART, keep_ids: bool = False) -> DataFrame:
    """The pieces of every document with sequence_id and offset."""
    spark = documents.sparkSession
    cut = settle(pieces(documents, tokenizer, capacity, keep_ids))
    # at most `capacity` counts for the plan
    counts = {int(k): int(n) for k, n in cut.groupBy("length").agg(F.count(F.lit(1))).collect()}
    runs, _ = plan_runs(counts, capacity)
    by_length: dict[int, list[tuple]] = {}
    for length, *run in runs:
        by_length.setdefault(length, []).append(tuple(run))
    plan = {k: (np.array([r[0] for r in v]), np.array(v, dtype=np.int64)) for k, v in by_length.items()}
    # a length's pieces are numbered in as many parts as they need: capacity + pieces / part numbers in all
    parts = [(k, -(-n // part)) for k, n in counts.items()]
    # rows of one id and text may be many, so a number of the row takes part; the table is settled, so it stays
    salted = cut.withColumn("part", F.monotonically_increasing_id()).join(F.broadcast(spark.createDataFrame(parts, "length long, parts long")), "length")
    salted = salted.withColumn("part", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", "part"), F.col("parts"))).drop("parts")
    firsts: dict[tuple[int, int], int] = {}
    upto = dict.fromkeys(counts, 0)
    for length, salt, n in sorted(map(tuple, salted.groupBy("length", "part").agg(F.count(F.lit(1))).collect())):
        firsts[length, salt] = upto[length]
        upto[length] += n
    order = Window.partitionBy("length", "part").orderBy("doc_id", "piece", "start")
    ranked = salted.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    shared = spark.sparkContext.broadcast((plan, firsts))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, firsts = shared.value
        for batch in batches:
            length, salt = batch.column("length").to_numpy(), batch.column("part").to_numpy()
            rank = batch.column("rank").to_numpy().copy()
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            order = np.lexsort((salt, length))
            cuts = np.flatnonzero((np.diff(length[order]) != 0) | (np.diff(salt[order]) != 0)) + 1
            for mine in np.split(order, cuts) if len(order) else ():
                value = int(length[mine[0]])
                begins, run = plan[value]
                at = rank[mine] + firsts[value, int(salt[mine[0]])]
                hit = run[np.searchsorted(begins, at, side="right") - 1]
                behind = at - hit[:, 0]
                sequence[mine] = hit[:, 2] + behind // hit[:, 3]
                offset[mine] = hit[:, 4] + behind % hit[:, 3] * value
            out = {c: batch.column(c) for c in names}
            yield pa.RecordBatch.from_pydict(out | {"sequence_id": pa.array(sequence), "offset": pa.array(offset)})

    names = [c for c in cut.columns]
    schema = PIECE_SCHEMA + (", ids binary" if keep_ids else "") + ", sequence_id long, offset long"
    return ranked.mapInArrow(place, schema)


def best_fit_decreasing(lengths: list[int], capacity: int) -> int:
    """Number of bins of the plain one-by-one algorithm; the yardstick for plan_runs."""
    rooms: list[int] = []
    bins = 0
    for length in sorted(lengths, reverse=True):
        at = bisect_right(rooms, length - 1)
        if at == len(rooms):
            bins += 1
            room = capacity
        else:
            room = rooms.pop(at)
        rest = room - length
        if rest:
            rooms.insert(bisect_right(rooms, rest), rest)
    return bins
