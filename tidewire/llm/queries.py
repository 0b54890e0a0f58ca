"""One query for each operator of this package, over its whole table, and SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import (
    feature_join,
    html_text,
    jaccard_join,
    language_id,
    line_dedup,
    mixing,
    packing,
    sharding,
    substring_dedup,
    topk,
    urls,
    vector_codes,
    vector_dedup,
)
from tidewire.runtime import table


def tokenizer_path() -> str:
    """The public tokenizer that packing counts with by default."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.predict_languages(table(spark, sf_dir, "documents"))


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path())


def substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents")).drop("block_odds")


def exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_components(table(spark, sf_dir, "documents"))


def codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.vector_codes(table(spark, sf_dir, "embeddings"))


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return feature_join.features(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


QUERIES = {
    "op1_language_id": language,
    "op2_line_dedup": lines,
    "op3_mixing": mix,
    "op4_packing": pack,
    "op5_substring_dedup": substrings,
    "op6_url_filter": url_filter,
    "op7_exact_top_k": exact_top_k,
    "op8_html_extraction": html,
    "op9_embedding_near_dedup": vectors,
    "op10_ngram_jaccard": ngram_join,
    "op11_vector_codes": codes,
    "op12_point_in_time": features,
    "op13_sharding": shards,
}

LINE_SQL = """
WITH l AS (
  SELECT doc_id, site, text, pos, line, trim(regexp_replace(line, '[\\t\\r]', ' ', 'g')) AS bare
  FROM (SELECT doc_id, text, CASE WHEN source IS NULL THEN -1 ELSE CAST('0x' || substr(md5(source), 1, 15) AS BIGINT) END AS site,
               unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
        FROM documents WHERE text IS NOT NULL)
), bad AS (
  SELECT bare FROM (SELECT bare, text, min(site) AS site FROM l WHERE bare <> '' GROUP BY bare, text) GROUP BY bare HAVING count(DISTINCT site) >= 10
), kept AS (
  SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE bare IN (SELECT bare FROM bad)) AS n_removed,
         coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE bare NOT IN (SELECT bare FROM bad)), '') AS text
  FROM l GROUP BY doc_id
)
SELECT d.doc_id, coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_removed, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""

TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(list_zip(a.q, b.q), lambda p: p[1] * p[2])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id
)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5
"""

WORD = r"[^\x20\x09-\x0D]+"

REPEATS_SQL = f"""
WITH n AS (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') AS ws FROM documents)),
g AS (SELECT doc_id, i, array_to_string(list_slice(ws, i, i + 12), ' ') AS win FROM n, unnest(range(1, n - 11)) t(i) WHERE n >= 13),
first AS (SELECT win, min(doc_id) AS least FROM g GROUP BY win),
gone AS (SELECT DISTINCT doc_id, i + k AS pos FROM g JOIN first USING (win), range(13) r(k) WHERE least < doc_id),
each AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM n),
kept AS (SELECT e.doc_id, string_agg(word, ' ' ORDER BY e.pos) AS text, count(*) AS k FROM each e ANTI JOIN gone USING (doc_id, pos) GROUP BY e.doc_id)
SELECT n.doc_id, CAST(n.n AS BIGINT) AS n_words, CAST(n.n - coalesce(k, 0) AS BIGINT) AS n_removed, sha256(coalesce(text, '')) AS kept_sha256
FROM n LEFT JOIN kept USING (doc_id)
"""

JACCARD_SQL = f"""
WITH n AS (SELECT doc_id, ws, len(ws) AS n FROM (SELECT doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS ws FROM documents)),
s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(ws, i, i + 4), ' ') AS gram FROM n, unnest(range(1, greatest(n - 4, least(n, 1)) + 1)) t(i)),
size AS (SELECT n.doc_id, count(gram) AS k FROM n LEFT JOIN s USING (doc_id) GROUP BY n.doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * c >= 80 * (x.k + y.k - c)),
ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
walk AS (WITH RECURSIVE r(node, root) AS (SELECT doc_id, doc_id FROM size UNION SELECT w.b, r.root FROM r JOIN ways w ON r.node = w.a) SELECT node, min(root) AS root FROM r GROUP BY node)
SELECT doc_id, k AS n_shingles, root AS component_id FROM size JOIN walk ON doc_id = node
"""


VECTOR_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
), good AS (
  SELECT * FROM v WHERE vec_id IS NOT NULL AND label IS NOT NULL AND e IS NOT NULL
    AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0
), links AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93::DOUBLE
), walk(node, root) AS (
  SELECT vec_id, vec_id FROM v UNION SELECT l.b, w.root FROM walk w JOIN links l ON w.node = l.a
), least AS (SELECT node, min(root) AS root FROM walk GROUP BY node), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, root AS component_id, root = v.vec_id AS kept FROM v JOIN least ON node = v.vec_id LEFT JOIN n ON n.a = v.vec_id
"""


def _codes_sql(rounds: int = 6) -> str:
    """Lloyd's rounds without any bound; a distance and its entry are one number, so the least has the lower entry."""
    steps = ["""
kept AS (
  SELECT vec_id, label, v, row_number() OVER (ORDER BY vec_id NULLS LAST, v) AS r FROM (
    SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
    FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)
), c AS MATERIALIZED (
  SELECT r, (i - 1) // (n // 8) AS part, (i - 1) % (n // 8) AS pos, x
  FROM (SELECT r, len(v) AS n, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM kept)
), b0 AS MATERIALIZED (SELECT part, r - 1 AS entry, pos, x FROM c WHERE r <= 16)"""]
    for k in range(rounds + 1):
        steps.append(f"""
d{k} AS (SELECT c.r, c.part, b.entry, CAST(sum((c.x - b.x) * (c.x - b.x)) AS BIGINT) AS d FROM c JOIN b{k} b USING (part, pos) GROUP BY ALL),
a{k} AS MATERIALIZED (SELECT r, part, min(d * 16 + entry) AS m FROM d{k} GROUP BY r, part)""")
        if k < rounds:
            steps.append(f"""
s{k} AS (SELECT part, m % 16 AS entry, pos, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM c JOIN a{k} USING (r, part) GROUP BY ALL),
b{k + 1} AS MATERIALIZED (SELECT part, entry, pos, coalesce((s - ((s % n) + n) % n) // n, x) AS x FROM b{k} LEFT JOIN s{k} USING (part, entry, pos))""")
    return "WITH" + ",".join(steps) + f""",
e AS (SELECT r, string_agg(printf('%02x', m % 16), '' ORDER BY part) AS code, CAST(sum(m // 16) AS BIGINT) AS error FROM a{rounds} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(CAST(x AS VARCHAR), ',' ORDER BY part, entry, pos)) FROM b{rounds}) AS codebooks_sha256
FROM kept JOIN e USING (r)
"""


def _hex(k: int) -> str:
    return f"CAST('0x' || substr(sha256(CAST(doc_id AS VARCHAR)), {8 * k + 1}, 8) AS BIGINT)"


FEATURES_SQL = f"""
WITH v AS (
  SELECT doc_id AS version_id, source, n_chars, lang, {_hex(0)} % 50000 AS event, {_hex(1)} % 600 AS b, {_hex(2)} % 900 AS c FROM documents
), asks AS (
  SELECT row_number() OVER () AS r, doc_id, {_hex(3)} % 50000 AS t, (SELECT min(source) FROM documents d WHERE d.doc_id = l.doc_id) AS source FROM labels l
), best AS (
  SELECT r, v.*, row_number() OVER (PARTITION BY r ORDER BY event DESC, event - 60 + b, version_id DESC, n_chars DESC NULLS LAST, lang DESC NULLS LAST) AS k
  FROM asks JOIN v ON asks.source = v.source AND event <= t AND event - 60 + b <= t AND t < event + c
)
SELECT doc_id, t, version_id, t - event AS age, CASE WHEN version_id IS NULL THEN 'none' WHEN t - event > 120 THEN 'stale' ELSE 'fresh' END AS status,
       CASE WHEN t - event <= 120 THEN n_chars END AS n_chars, CASE WHEN t - event <= 120 THEN lang END AS lang
FROM asks LEFT JOIN best ON asks.r = best.r AND k = 1
"""

ORACLES = {
    "op2_line_dedup": LINE_SQL,
    "op5_substring_dedup": REPEATS_SQL,
    "op7_exact_top_k": TOP_SQL,
    "op9_embedding_near_dedup": VECTOR_SQL,
    "op10_ngram_jaccard": JACCARD_SQL,
    "op11_vector_codes": _codes_sql(),
    "op12_point_in_time": FEATURES_SQL,
}
