"""Each operator against its plain version on a small table with nulls, empty and long texts, copies and ties."""

import hashlib
import random
from pathlib import Path

import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewire.llm import html_text, jaccard_join, language_id, line_dedup, mixing, packing, substring_dedup, topk, urls, vector_dedup
from tidewire.llm.queries import tokenizer_path

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, extra string, score double"
VOCAB = ["the", "of", "ein", "Haus", "maison", "rouge", "gato", "perro", "über", "ça", "niño", "x1", "well,", "so.", "Río"]


def _text(rng, n):
    return " ".join(rng.choice(VOCAB) + str(rng.randrange(40)) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    passage = _text(rng, 60)
    out = []
    for k in range(120):
        body = _text(rng, rng.choice([3, 20, 80, 200]))
        if k % 7 == 0:
            body += "\n" + passage
        if k % 3 == 0:
            body += "\nshared footer line"
        out.append([k, body, rng.choice(["en", "de", None]), f"s{k % 13}" if k % 17 else None, len(body), "e", 0.5])
    base = _text(rng, 100).split()
    for k in range(120, 160):  # near copies
        w = list(base)
        w[rng.randrange(100)] = f"edit{k}"
        out.append([k, " ".join(w), "en", f"s{k % 13}", 1, "e", 0.1])
    out += [[160, None, None, None, None, None, None], [161, "", "en", "s1", 0, None, None], [162, " \n\t ", "en", "s1", 0, None, None], [163, "a b", "en", "s2", 3, None, None],
            [164, "A  B", "en", "s2", 4, None, None], [165, "123 !!", "de", "s2", 5, None, None], [166, _text(rng, 9000), "de", "s3", 1, None, None], [167, out[3][1], "en", "s4", 1, None, None]]
    return [tuple(r) for r in out]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def test_substrings(docs, rows, none):
    got = substring_dedup.remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, got)) == sorted(brute.substrings([r[:2] for r in rows]))
    assert sum(r["n_removed"] for r in got) > 500
    assert substring_dedup.remove_repeats(none).count() == 0
    split = substring_dedup.remove_repeats(docs, hot=3).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
    assert sorted(map(tuple, split)) == sorted(map(tuple, got))


def _swapped(letters=1024):
    """Two words of which each half is the other one's swapped: powers of any odd number modulo 2^64 give both one sum."""
    a, b = "a", "b"
    while len(a) < letters:
        a, b = a + b, b + a
    return a, b


def test_structured_words_are_told_apart(spark):
    import pyarrow as pa

    from tidewire.llm import shingles

    for letters in (16, 128, 1024):
        x, y = _swapped(letters)
        code = shingles.Words(pa.array([f"{x} {y} {x.upper()}"]), lower=True).codes
        assert code[0] == code[2] != code[1]
        rest = [f"w{k}" for k in range(12)]
        texts = [" ".join([x, *rest]), " ".join([y, *rest]), f"{x} {y} {x}"]
        some = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        got = substring_dedup.remove_repeats(some).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()
        assert sorted(map(tuple, got)) == sorted(brute.substrings(list(enumerate(texts))))
        four = [f"{x} b c d e", f"{y} b c d e"]
        assert [r["component_id"] for r in jaccard_join.jaccard_components(spark.createDataFrame(list(enumerate(four)), "doc_id long, text string")).orderBy("doc_id").collect()] == [0, 1]
        ids = packing.WordIds(tokenizer_path())
        assert [np.frombuffer(i, "<u4").tolist() for i in ids._plain([t.encode() for t in texts])] == [ids.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_pieces_of_one_code_go_by_their_bytes(monkeypatch):
    """Even if all first codes were equal, the second ones would send the texts the exact way."""
    real = packing.codes_at
    monkeypatch.setattr(packing, "codes_at", lambda *a, **k: real(*a, **k) if k else np.zeros(len(a[1]), np.uint64))
    ids = packing.WordIds(tokenizer_path())
    texts = ["the river ran", "through stones", "the"]
    assert [np.frombuffer(i, "<u4").tolist() for i in ids._plain([t.encode() for t in texts])] == [ids.tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_word_codes_do_not_depend_on_place():
    from tidewire.llm import shingles

    rng = random.Random(2)
    words = [bytes(rng.randrange(33, 127) for _ in range(rng.choice([1, 7, 8, 9, 16, 17, 255, 256, 257, 3000]))) for _ in range(300)]
    data = np.frombuffer(b" ".join(words), np.uint8)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    codes = shingles.codes_at(data, ends - [len(w) for w in words], ends)
    for w, c in zip(words, codes):
        assert shingles.codes_at(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)]))[0] == c
    assert len(set(codes.tolist())) == len(set(words))


def test_substrings_without_ids(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    rows = [(None, passage + " a"), (None, "b " + passage), (5, "c " + passage), (5, passage + " d"), (9, None), (9, "")]
    got = substring_dedup.remove_repeats(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, hot int"))
    mine = [(r[0] or 0, r[1], r[2], r[3]) for r in got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256)).collect()]
    assert sorted(mine) == sorted((r[0] or 0, *r[1:]) for r in brute.substrings(rows))


def test_jaccard(docs, rows, none):
    got = {r[0]: (r[1], r[2]) for r in jaccard_join.jaccard_components(docs).collect()}
    want = brute.jaccard([r[:2] for r in rows])
    assert got == want
    assert len({want[k][1] for k in range(120, 160)}) < 40
    assert jaccard_join.jaccard_components(none).count() == 0


def test_jaccard_repeated_rows(spark, rows):
    twice = spark.createDataFrame(rows[118:130] + rows[118:130], SCHEMA)
    assert jaccard_join.jaccard_components(twice).count() == 24
    near = [f"w{k}" for k in range(100)]  # 75 of 117 shingles shared: under the threshold, also when rows repeat
    texts = {1: near, 2: near[:79] + [f"v{k}" for k in range(21)], 3: near[:98] + ["v"]}
    some = [[k, " ".join(t), "en", "s", 1, "e", 0.5] for k, t in texts.items()]
    got = jaccard_join.jaccard_components(spark.createDataFrame(some + some, SCHEMA)).collect()
    assert sorted((r[0], r[2]) for r in got) == [(1, 1), (1, 1), (2, 2), (2, 2), (3, 1), (3, 1)]


def test_shared_shingles_count_once(spark):
    texts = [f"q w e r t z{k} u{k} i o p" for k in range(8)] + ["q w e r t", None, "a b", "x x x x x x"]
    some = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    keys = {r["rid"]: r["doc_id"] for r in jaccard_join.with_text_key(some).collect()}
    got = {keys[r["rid"]]: r["shared"] for r in jaccard_join.shared_counts(some, 5, 4).collect()}
    assert got == {k: 1 for k in range(9)}


def test_jaccard_rows_of_one_id(spark, rows):
    near = [f"w{k}" for k in range(100)]
    some = [(7, " ".join(near), "a"), (7, "something else that stands alone here", "b"), (9, " ".join(near[:99]), "c"), (None, " ".join(near[1:]), "d"), (None, None, "e"), (3, "x y", "f"), (3, "x y", "f")]
    table = spark.createDataFrame([(*r, 1) for r in some], "doc_id long, text string, comp string, _rid int")
    got = jaccard_join.jaccard_components(table).collect()
    assert sorted((r[0] or 0, r[1], r[2] or 0) for r in got) == sorted([(7, 96, 7), (7, 2, 7), (9, 95, 7), (0, 95, 7), (0, 0, 0), (3, 1, 3), (3, 1, 3)])
    kept = jaccard_join.keep_one(table)
    assert kept.columns == table.columns
    assert sorted((r["doc_id"] or 0, r["comp"]) for r in kept.collect()) == [(0, "e"), (3, "f"), (7, "a"), (7, "b")]


def test_mixing(docs, rows, none):
    got = mixing.mix(docs, fan=8).collect()
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(docs.repartition(2), fan=8).collect()}
    assert again == {r["doc_id"]: r["taken"] for r in got} and len(got) == len(rows)
    size = {r[0]: len(brute.words(r[1])) for r in rows}
    per = {}
    for r in rows:
        per[r[3]] = per.get(r[3], 0) + size[r[0]]
    want = brute.targets(per)
    for s in want:
        mine = [r for r in got if r["source"] == s]
        assert all(abs(r["target"] - want[s]) < 1e-6 and r["source_size"] == per[s] and r["size"] == size[r["doc_id"]] for r in mine)
        assert abs(sum(r["taken"] for r in mine) - want[s]) <= max(r["size"] for r in mine) + 1e-6
        assert all(r["taken"] <= 2 * r["size"] for r in mine)
    assert mixing.mix(none).count() == 0


def test_packing(docs, rows, none):
    from tokenizers import Tokenizer

    got = packing.pack(docs, tokenizer_path()).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == brute.pieces([r[:2] for r in rows], Tokenizer.from_file(tokenizer_path()))
    places = {}
    for r in got:
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for p in places.values():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(places) == packing.best_fit_decreasing([r["length"] for r in got], 2048)
    assert packing.pack(none, tokenizer_path()).count() == 0


def test_plan_runs_is_best_fit_decreasing():
    rng = random.Random(1)
    for _ in range(200):
        cap = rng.choice([10, 30, 100])
        lengths = [rng.randint(1, cap) for _ in range(rng.randint(0, 200))]
        counts = {x: lengths.count(x) for x in lengths}
        assert packing.plan_runs(counts, cap)[1] == packing.best_fit_decreasing(lengths, cap)


def test_word_ids_with_special_strings():
    from tokenizers import Tokenizer

    t, w = Tokenizer.from_file(tokenizer_path()), packing.WordIds(tokenizer_path(), most=3)
    for text in ["a<|endoftext|>b c", "it's I'm ΣΑΣ", "x y  z", "é é", "日本 語\n😀 ok", ""]:
        ids = np.array(t.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert list(w.encode([text.encode()])) == [ids]


def test_lines(spark, docs, rows, none):
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, min_sites=10).collect()}
    assert len(got) == len(rows)
    def number(source):
        return -1 if source is None else int(hashlib.md5(source.encode()).hexdigest()[:15], 16)

    votes, sites = {}, {}  # each text votes once, for the site of the least number
    for r in rows:
        if r[1] is not None:
            votes[r[1]] = min(votes.get(r[1], number(r[3])), number(r[3]))
    for text, site in votes.items():
        for line in text.split("\n"):
            sites.setdefault(line.strip(), set()).add(site)
    bad = {x for x in sites if x and len(sites[x]) >= 10}
    assert "shared footer line" in bad
    for r in rows:
        if r[1] is None:
            assert got[r[0]]["text"] is None and got[r[0]]["n_removed"] == 0
            continue
        keep = [x for x in r[1].split("\n") if x.strip() not in bad]
        assert got[r[0]]["text"] == "\n".join(keep) and got[r[0]]["extra"] == r[5]
    # a whole text copied to many sites is no boilerplate
    copies = spark.createDataFrame([(k, "one\ntwo", None, f"s{k}", 1, None, None) for k in range(40)], SCHEMA)
    assert line_dedup.dedup_lines(copies).where("n_removed > 0").count() == 0
    # all lines of a notice go, wherever they stand, and from copies too
    notice = "Cookies.\n\tRead our policy \nAll rights reserved"
    pages = [(f"banner\nThe text of page {k} stands here, and on no other page.\n\n{notice}", f"s{k}") for k in range(60)] + [("a copy that stands on many sites\nbanner", f"s{k}") for k in range(40)]
    some = spark.createDataFrame([(k, *p, 1, 2) for k, p in enumerate(pages)], "doc_id long, text string, source string, _kept int, line_key int")
    left = line_dedup.dedup_lines(some)
    assert left.columns == [*some.columns, "n_lines", "n_removed"]
    got = {r["text"]: r["n_removed"] for r in left.collect()}
    assert got == {f"The text of page {k} stands here, and on no other page.\n": 4 for k in range(60)} | {"a copy that stands on many sites": 1}
    many = line_dedup.boilerplate_lines(some)
    more = spark.range(line_dedup.INLINE_LINES + 1).select(F.col("id").alias("line_key")).unionByName(many)
    assert {r["text"]: r["n_removed"] for r in line_dedup.remove_lines(some, more).collect()} == got
    assert line_dedup.dedup_lines(none).count() == 0
    # short pages with a long notice: sites decide, whatever share of a page the notice takes
    short = [(k, f"page {k}\n" + "\n".join(f"notice line {n} " * 20 for n in range(3)), f"s{k % 40}") for k in range(200)]
    left = line_dedup.dedup_lines(spark.createDataFrame(short + short[:5] + [(999, "x\n" * 5000 + "y" * 100_000, None)], "doc_id long, text string, source string")).collect()
    assert sum(r["n_removed"] for r in left) == 600 + 15 and all(r["text"] == f"page {r['doc_id']}" for r in left if r["doc_id"] < 999)


def test_language(spark, none):
    rng = random.Random(3)
    words = {"aa": ["tha", "shon", "wick"], "bb": ["üngeit", "schra", "ölf"], "cc": ["eauxi", "çanè", "ouré"]}
    data = []
    for k in range(600):
        lang = rng.choice(list(words))
        text = " ".join("".join(rng.choices(words[lang], k=2)) for _ in range(rng.choice([4, 30, 400])))
        data.append((k, text, lang, "s", 1, None, None))
    data += [(900, None, None, None, None, None, None), (901, "12 !?", "aa", "s", 1, None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    got = language_id.predict_languages(df).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] < 900]
    truth = {r[0]: r[2] for r in data}
    assert len(held) > 60 and np.mean([truth[r["doc_id"]] == r["lang_pred"] for r in held]) > 0.95
    assert {r["doc_id"]: (r["lang_pred"], r["score"]) for r in got if r["doc_id"] >= 900} == {900: ("und", 0.0), 901: ("und", 0.0)}
    assert all(0 <= r["score"] <= 1 for r in got)
    assert language_id.predict_languages(none).count() == 0
    unlabelled = df.withColumn("lang", F.lit(None).cast("string")).limit(3)
    assert {r["lang_pred"] for r in language_id.predict_languages(unlabelled).collect()} == {"und"}


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(4)
    out = []
    for k in range(500):
        v = rng.normal(size=64)
        if k % 5 == 1:
            v = np.array(out[-1][1]) + rng.normal(size=64) * np.linalg.norm(out[-1][1]) / 8 * rng.uniform(0.1, 0.42)
        out.append((k, [float(np.float32(x)) for x in v], k % 50 // 10))
    out += [(500 + k, out[7][1], out[7][2]) for k in range(9)]
    out += [(600, None, 1), (601, [float("nan")] * 64, 1), (602, [0.0] * 64, 1), (603, out[7][1], None), (604, [None] + [1.0] * 63, 1), (650, [1.0, 2.0], 1)]
    return spark.createDataFrame(out, "vec_id long, embedding array<float>, label int").withColumn("rank", F.lit(1)), out


def test_vector_recall(vectors, spark):
    df, rows = vectors
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in vector_dedup.near_duplicates(df, block=4).collect()}
    want = brute.vectors(rows)
    assert set(got) == set(want)
    found, all_ = sum(n for n, _ in got.values()), sum(n for n, _ in want.values())
    assert all(got[k][0] <= want[k][0] for k in got) and found >= 0.9 * all_ > 100
    assert got[500] == want[500] and got[600] == (0, 600) and got[603] == (0, 603)
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_top_k(vectors):
    df, rows = vectors
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, block_rows=100, query_chunk=3).collect()}
    assert got == brute.top([r[:2] for r in rows])
    assert topk.top_k(df.limit(0)).count() == 0


def test_bit_slices_hold_ties():
    rng = np.random.default_rng(2)
    for low in range(4):
        v = rng.integers(-300, 300, (400, 9))
        v[50:90] = v[0]
        q = rng.integers(-300, 300, 9)
        found, score = topk.BitSlicedIndex(v, low).top(q, 6)
        full = v @ q
        assert set(np.flatnonzero(full >= np.sort(full)[-6])) <= set(found) and (full[found] == score).all()


def test_urls(spark):
    data = ["http://WWW.Example.com/en/1?x", "https://a.example.com/en/", "http://x.net/es/a#b", "http://net/fr/", "http://x.org", "http://cheappills.org/buy", "ftp://x.com/a", "x.com/en/", None, "http://quiet.org/en/x"]
    df = spark.createDataFrame([(k, u, None) for k, u in enumerate(data)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(df).collect()}
    assert got[0] == ("www.example.com", "/en/1", "www.example.com/en/", "allow") and got[1] == ("a.example.com", "/en/", "example.com/en/", "block")
    assert got[2] == ("x.net", "/es/a", "net/es/", "block") and got[3][2:] == ("net/fr/", "block") and got[4] == ("x.org", "", None, "allow")
    assert got[5][2:] == (None, "block") and got[6][2:] == ("com/", "allow") and got[7] == got[8] == ("", "", None, "allow") and got[9][3] == "allow"
    assert urls.judge_urls(df.limit(0)).count() == 0


PLANTED = {
    "allow": ["thequietgarden.org/en/", "therin.example.net/en/770", "citylibrary.org/en/books", "familykitchen.de/fr/recipe", "riverpark.org/es/story", "open-source-wiki.io/en/docs"],
    "block": ["casino.org/de/bonus", "cheappills.org/buy", "freeslots.net/en/win", "bestpokerbets.org/story/1", "loanspayday.de/en/", "adulttube.org/free/sex"],
}


def test_planted_hosts(spark):
    """Rules label thousands of urls, /en/ in a blocked place among them; hosts that no rule fits go by what they are about."""
    rng = random.Random(11)
    names = ["thera", "lubin", "example", "garn", "thorin", "meku"]
    labelled = [f"https://{rng.choice(names)}.{rng.choice(['example.com', 'com', 'net'])}/{rng.choice(['en', 'fr', 'es', 'de'])}/{rng.choice(names)}/{k}" for k in range(3000)]
    data = [*labelled, *(f"https://{u}" for us in PLANTED.values() for u in us)]
    pages = spark.createDataFrame([(k, u, "<p>the story of a garden and its family kitchen</p>") for k, u in enumerate(data)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(pages).collect()}
    planted = [(u, v) for v, us in PLANTED.items() for u in us]
    assert [(u, *got[len(labelled) + k]) for k, (u, _) in enumerate(planted)] == [(u, None, v) for u, v in planted]


def test_segmentation_is_cheapest():
    s = urls.Segmenter({"free": 9, "bets": 2, "bet": 3, "re": 1, "cheap": 4, "heap": 2, "at": 30, "a": 2})
    for name in ("freebets", "cheapbet", "xfreat", "zz", "qqfreeqq", "abetsheap"):
        best = min(sum(map(s.price, parts)) for parts in brute.splits(name))
        assert "".join(s.split(name)) == name and abs(sum(map(s.price, s.split(name))) - best) < 1e-9
    # counts decide between splits that are both words
    assert urls.UrlModel({"the": 900, "best": 50, "bestcasin": 0}).segmenter.split("thebestcasinoonline") == ["the", "best", "casino", "online"]
    assert "".join(s.split("freeq" * 100_000)) == "freeq" * 100_000


def test_most_frequent(spark):
    counts = spark.createDataFrame([(w, n) for w, n in zip("abcdefg", (5, 3, 3, 3, 9, 1, 1))], "word string, n long")
    pick = lambda most: sorted(r["word"] for r in urls.most_frequent(counts, "n", most).collect())
    assert [pick(k) for k in (0, 1, 2, 4, 5, 6, 7)] == [[], ["e"], ["a", "e"], ["a", "e"], list("abcde"), list("abcde"), list("abcdefg")]


def test_urls_like_brute(spark):
    rng = random.Random(4)
    hosts = ["freebets", "quiet", "newsblog", "casinowin", "gardenhome", "zzz"]
    data = [f"http://{rng.choice(['www.', 'm.', ''])}{rng.choice(hosts)}.{rng.choice(['example.com', 'net', 'org'])}/{rng.choice(['en', 'de', 'es', 'fr'])}/{rng.choice(['winner', 'story', '17', ''])}{rng.choice(['?a=b', '#c', ''])}" for _ in range(150)]
    data += data[:20] + [None, "", "://", "http://", "HTTP://A.B.com:80", "http://" + "freebets" * 9000 + ".org/x", "http://net/es/", "http://net/es", "http://xnet/es/"]
    pages = spark.createDataFrame([(k, u, f"<p>quiet garden</p> home garden {u}", 5) for k, u in enumerate(data)], "page_id long, url string, html string, host int").repartition(3)
    texts = spark.createDataFrame([(1, "News of the garden, news of the blog"), (2, None)], "doc_id long, text string")
    got = sorted(map(tuple, urls.judge_urls(pages, texts).drop("block_odds").collect()))
    text = ["News of the garden, news of the blog"] + [f" quiet garden  home garden {u}" for u in data]
    assert got == sorted((k, *r) for k, r in enumerate(brute.urls(data, text, urls.RULES, urls.BLOCK_WORDS, urls.ALLOW_WORDS)))
    assert {r[4] for r in got if r[3] is None} == {"allow", "block"}


def test_html(spark):
    long = "The cat of the house is in the garden and it was there with a friend for the whole of the day."
    page = f"""<html><head><title>T</title></head><body><nav><a href=/>Home</a></nav><div class="cookie notice">We use the cookies of this site for you and for us, that is the deal we have with it.</div>
    <article><h1>Big &amp; small</h1><p>{long}<p>Short one.<p>a<b>b</b>c&nbsp;d<script>var x="</p>";</script><form>Sign up</form></article>
    <div id="comments"><p>{long}</p></div><aside>{long}</aside><footer>&copy; x</footer>"""
    df = spark.createDataFrame([(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", f"<div>{long}</div><div>Tail.</div><div>{long}</div><div>Between.</div><p><a href=x>more</a></p>")], "page_id long, url string, html string")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in html_text.extract(df).collect()}
    want = f"Big & small {long} Short one. abc d"
    assert got[1] == (want, len(want)) and got[2] == ("", 0) and got[3] == ("", 0) and got[4][0] == f"{long} Tail. {long}"
    assert html_text.extract(df.limit(0)).count() == 0


def test_html_like_brute(spark):
    rng = random.Random(9)
    texts = ["The cat of the house is in the garden and it was there with a friend for the whole of the day.", "Short.", "Foreign words only: bardo kelmu trista vonde lapir sumat gordi neska plimo. Verta kudo.", "これは日本語の長い文章です。" * 8, "a & b < c", "x"]

    def tree(depth):
        children = []
        for _ in range(rng.randrange(1, 6)):
            pick = rng.random()
            if depth == 0 or pick < 0.35:
                children.append(rng.choice(texts))
            elif pick < 0.45:
                children.append(("a", ' href="/x?a>b"', [rng.choice(texts)]))
            elif pick < 0.55:
                children.append(("b", "", [rng.choice(texts)]))
            elif pick < 0.6:
                children.append(("br", "", []))
            elif pick < 0.7:
                children.append(tree(depth - 1)[:1] + (rng.choice([' class="sidebar"', ' class="with-sidebar"', " hidden", ' style="overflow:hidden"', ' style="display: none"', ' class="comments"']),) + tree(depth - 1)[2:])
            else:
                children.append(tree(depth - 1))
        return (rng.choice(["div", "section", "article", "main", "nav", "aside", "form", "div", "div"]), "", children)

    trees = [("div", "", [tree(3)]) for _ in range(300)]
    pages = [(k, "u", brute.page_html(t), 1) for k, t in enumerate(trees)]
    pages += pages[:5] + [(900, "u", f"<p>{texts[0]}</p>" * 20_000, 1), (901, "u", f"<p>{texts[0]}</p><svg/><p>Tail.", 1), (902, "u", f'<div class="social-science"><p>{texts[0]}</div>', 1)]
    got = {}
    for r in html_text.extract(spark.createDataFrame(pages, "page_id long, url string, html string, text int").repartition(4)).collect():
        got.setdefault(r["page_id"], []).append(r["text"])
    want = {k: [brute.page_text(t, html_text.STOP_WORDS, {"sidebar", "comments"})] for k, t in enumerate(trees)}
    for k in range(5):
        want[k] *= 2
    want |= {900: [" ".join([texts[0]] * 20_000)], 901: [f"{texts[0]} Tail."], 902: [texts[0]]}
    assert got == want and sum(len(t) > 0 for t, *_ in want.values()) > 150


def test_pipeline(spark):
    import corpus_pipeline as c
    from tidewire.runtime import settle, table

    sf = "/root/testdata/sf0.001"
    if not Path(sf).exists():
        pytest.skip("no test data")
    docs = first = table(spark, sf, "documents")
    seen = []
    for name, stage in c.STAGES:
        before = [r[:2] for r in docs.select("doc_id", "text").collect()]
        docs = settle(stage(spark, docs, sf))
        seen.append(name)
        if name != "packing":
            assert docs.columns == first.columns
        if name == "ngram_jaccard":
            want = brute.jaccard(before)
            assert sorted(r[0] for r in docs.select("doc_id").collect()) == sorted(k for k, (_, comp) in want.items() if k == comp)
    assert seen == [n for n, _ in c.STAGES] and docs.count() > 0


NAMES = "rid node comp n k shared place bucket shard token tokens line line_key lines row site seen key keys size source_size target docs weight cap _row _rid _comp _key _n _text _letters _kept _all rep copies least task block chunk is_query part rank first seg parts".split()


def _clashing(df):
    return df.withColumns({c: F.lit(7) for c in NAMES if c not in df.columns})


def test_columns_that_clash(docs, vectors, spark):
    some = docs.where("doc_id < 40 or doc_id >= 155")
    wide = _clashing(some).withColumn("dot.ted", F.lit("x")).withColumn("mapped", F.create_map(F.lit("k"), F.lit(1)))
    plain = lambda df: sorted(map(repr, df.collect()))
    for f in (jaccard_join.jaccard_components, substring_dedup.remove_repeats, lambda x: mixing.mix(x, fan=8), lambda x: packing.pieces(x, tokenizer_path())):
        assert plain(f(wide)) == plain(f(some))
    for f in (jaccard_join.keep_one, lambda x: mixing.take(x, fan=8), line_dedup.dedup_lines):
        got = f(wide)
        assert got.columns[: len(wide.columns)] == wide.columns and plain(got.select(*some.columns)) == plain(f(some).select(*some.columns))
    import corpus_pipeline as c

    kept = c.keep_known_languages(spark, wide, "")
    assert kept.columns == wide.columns and plain(kept.select(*some.columns)) == plain(c.keep_known_languages(spark, some, ""))
    df = vectors[0].drop("rank").where("vec_id < 120")
    for f in (topk.top_k, vector_dedup.near_duplicates):
        assert plain(f(_clashing(df))) == plain(f(df))


def test_vectors_of_one_id(spark):
    rng = np.random.default_rng(1)
    a, b, c = ([float(x) for x in rng.normal(size=64)] for _ in range(3))
    near = [x * 1.5 for x in a]  # the same direction
    rows = [(1, a, 0), (1, b, 0), (1, a, 0), (5, near, 0), (6, [x * 2 for x in b], 0), (7, c, 0)]
    got = vector_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted((r["vec_id"], r["n_links"], r["component_id"]) for r in got) == [(1, 1, 1), (1, 2, 1), (1, 2, 1), (5, 2, 1), (6, 1, 1), (7, 0, 7)]


def test_pipeline_run_on_odd_rows(spark, rows, tmp_path):
    import corpus_pipeline as c

    from tidewire.runtime import settled

    data = rows + rows[:10] + [(None, "the house of the garden", "en", None, 1, None, None)] * 3 + [(5, rows[40][1] + " more words", "en", "s1", 1, None, None)]
    docs = spark.createDataFrame(data, SCHEMA).drop("score")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    before = set(settled(spark))
    got = c.run(spark, str(tmp_path)).collect()
    assert len(settled(spark) - before) == 1 and sum(r["length"] for r in got) > 5000
    ends = {}
    for r in got:
        ends.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all(sum(n for _, n in p) <= 2048 and sorted(p)[0][0] == 0 for p in ends.values())
    spark.createDataFrame([], docs.schema).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert c.run(spark, str(tmp_path / "none")).count() == 0


def test_pipeline_rejects_unknown_languages(spark):
    import corpus_pipeline as c

    rng = random.Random(3)
    words = {"aa": ["tha", "shon", "wick"], "bb": ["üngeit", "schra", "ölf"], "cc": ["eauxi", "çanè", "ouré"]}
    data = []
    for k in range(600):
        lang = rng.choice(list(words))
        data.append((k, " ".join("".join(rng.choices(words[lang], k=2)) for _ in range(rng.choice([1, 4, 30, 200]))), lang, "s", 1, None, None))
    data += [(700, "thashon", None, "s", 1, None, None), (701, "Ölfschra!", None, "s", 1, None, None), (702, "a b", None, "s", 1, None, None)]
    strange = ["Tämä lause on kirjoitettu kielellä jota verkko ei tunne", "Это предложение на русском языке", "xqzvk wjqxz kkvzq zxqwv jjqkx", "日本語の文章です"]
    data += [(800 + k, t, None, "s", 1, None, None) for k, t in enumerate(strange)] + [(900, "12 !?", "aa", "s", 1, None, None), (901, None, None, None, None, None, None)]
    df = spark.createDataFrame(data, SCHEMA)
    kept = {r["doc_id"] for r in c.keep_known_languages(spark, df, "").collect()}
    assert kept == {*range(600), 700, 701, 702}


def test_take_keeps_rows_of_one_id_apart(spark):
    data = [(None, f"text {k} " * (1 + k % 5), None, "s", k, None, None) for k in range(30)]
    data += [(7, f"other {k}", "en", "s", 1, None, None) for k in range(5)] + [(7, "other 0", None, "s", 1, "en", None), (8, "same", "en", "s", 1, None, 0.5), (8, "same", "en", "s", 1, None, 0.5)]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    # one source with as many words as its target: every row exactly once
    got = mixing.take(df, weights=(1,), share=1.0, fan=4)
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, data))
    assert sorted(map(repr, map(tuple, mixing.take(df, few=0, weights=(1,), share=1.0, fan=4).collect()))) == sorted(map(repr, data))
    # fractional copies: each row at least once and at most twice
    many = [tuple(r)[1] for r in mixing.take(df, weights=(1,), share=1.5, fan=4).where("doc_id is null").collect()]
    assert {many.count(r[1]) for r in data[:30]} == {1, 2}


def test_every_language_is_learned(spark):
    rng = random.Random(8)
    data = [(9 * k + n, f"w{k} " + _text(rng, 3), f"l{k:03d}", "s", 1, None, None) for k in range(205) for n in range(9)]
    df = spark.createDataFrame(data, SCHEMA)
    model = language_id.fit(df, per_language=4)
    assert model.languages == [f"l{k:03d}" for k in range(205)] and model.out.shape[1] == 205
    assert language_id.with_rejection(model, df).least.shape == (205,)


def test_top_k_repeated_ids(spark):
    rng = np.random.default_rng(9)
    rows = [(k, [float(x) for x in rng.integers(-4, 5, 8)]) for k in range(1, 120)]
    own = [(100, [9.0 + k] * 8) for k in range(12)]  # each best for the other rows of its id
    rows = rows[:99] + own + rows[100:] + [(7, rows[6][1])] * 3
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    q = [(i, np.floor(256 * np.array(v)).astype(int)) for i, v in rows]
    want = {}
    for query in (50, 100):
        scored = sorted((-int(a @ b), i) for j, a in q if j == query for i, b in q if i != query)[:5]
        want |= {(query, r + 1): (i, -s) for r, (s, i) in enumerate(scored)}
    for block in (10_000, 30):
        got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in topk.top_k(df, block_rows=block, query_chunk=3).collect()}
        assert got == want


def test_vector_recall_near_the_threshold(spark):
    rng = np.random.default_rng(12)
    data, unit = [], lambda a: a / np.linalg.norm(a)
    for d in (64, 384):
        for _ in range(400):  # no copies: pairs of cosine 0.931 to 0.95
            x, c = unit(rng.normal(size=d)), rng.uniform(0.931, 0.95)
            z = rng.normal(size=d)
            data += [(d, x), (d, c * x + np.sqrt(1 - c * c) * unit(z - (z @ x) * x))]
    rows = [(k, [float(v) for v in x], 1) for k, (_, x) in enumerate(data)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in vector_dedup.near_duplicates(df).collect()}
    for d in (64, 384):
        ids = [k for k, (e, _) in enumerate(data) if e == d]
        m = np.array([data[k][1] for k in ids])
        all_ = int((m @ m.T / np.outer(np.linalg.norm(m, axis=1), np.linalg.norm(m, axis=1)) >= 0.93).sum()) - len(ids)
        assert all_ >= 800 and 0.98 * all_ <= sum(got[k] for k in ids) <= all_


def test_rejection_counts_every_row(spark):
    """Shares and trigrams come from the whole texts of all labelled rows, also of those beyond 700 and behind the first characters."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefgh", k=5))
    data = [(k, " ".join(word() for _ in range(rng.choice([1, 3, 120]))) + (" qqq" if k % 20 == 0 else ""), "aa", "s", 1, None, None) for k in range(6000)]
    df = spark.createDataFrame(data, SCHEMA).repartition(5)
    got = language_id.with_rejection(language_id.fit(df, per_language=40), df)
    held = {r["doc_id"] for r in df.where(language_id.held_out(F.col("doc_id"))).collect()}
    counts, rows = np.zeros(language_id.BINS, int), 0
    for k, text, *_ in data:
        if k not in held:
            bins, good = language_id.trigrams(np.frombuffer(text.encode(), np.uint8))
            counts[np.unique(bins[good])] += 1
            rows += 1
    seen = (counts > 0) & (counts * 700 >= rows)
    assert (got.seen == seen).all() and 0 < seen.sum() < (counts > 0).sum() + 1
    bins, good = language_id.trigrams(np.frombuffer(b"qqq", np.uint8))
    assert seen[bins[good]].all()
    shares = sorted(int(language_id.seen_share(seen, np.frombuffer(text.encode(), np.uint8)) * language_id.STEPS) for k, text, *_ in data if k in held)
    assert len(shares) > 1000 and got.least[0] == max(s for s in shares if 100 * sum(x < s for x in shares) <= len(shares)) / language_id.STEPS / 2
