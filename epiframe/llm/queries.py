"""The thin opN queries: each reads its whole table, applies its operator and derives the digest columns."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from epiframe.llm import centroids, chat_format, collocations, decontaminate, html_text, language_id, license_digest, line_dedup, near_dedup, packing, quality, substring_dedup, top_k
from epiframe.llm.sampling import held_out


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page and its length."""
    out = html_text.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return out.select("page_id", "url", F.col("_text").alias("text"), F.length("_text").cast("long").alias("n_chars"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document that holds a benchmark item, with the item, the word edits and the place."""
    return decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op3_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as pieces of sequences of at most 4096 tokens."""
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), with_ids=False)


def op4_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingle count and the smallest id of its group of near duplicates."""
    found = near_dedup.near_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.col("size").alias("n_shingles"), F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(True)).alias("kept"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's canonical digest and the known licence that its whole text is."""
    out = license_digest.scan(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("_digest").alias("digest"), F.col("_license").alias("license_id"))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = _table(spark, sf_dir, "documents")
    model = language_id.train(docs.where(~held_out()))
    out = language_id.predict(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", F.col("_lang").alias("lang_pred"), F.col("_score").alias("score"))


def op7_ball_tree_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest vectors of every 20th vector by integer inner product."""
    vectors = _table(spark, sf_dir, "embeddings")
    return top_k.top_k(vectors.where(F.col("vec_id") % 20 == 0), vectors)


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document, words removed as repeated 35-word windows, and a digest of the words kept."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring_dedup.remove_repeats(docs, digest=True)
    return out.select("doc_id", F.col("_words").alias("n_words"), F.col("_removed").alias("n_removed"), F.col("_kept").alias("kept_sha256"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quality score of every document."""
    docs = _table(spark, sf_dir, "documents")
    model = quality.train(docs, _table(spark, sf_dir, "labels"))
    out = quality.score(docs.select("doc_id", held_out().alias("held_out"), "text"), model)
    return out.select("doc_id", "held_out", F.col("_score").alias("score"), (F.col("_score") >= quality.REJECT).cast("int").alias("predicted"))


def op10_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one of control strings, formatted, expanded and read back."""
    extra = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    conversations = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat_format.read_back(chat_format.expand(conversations.union(extra)))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those dropped as repeated, and a digest of the lines kept."""
    out = line_dedup.drop_repeated_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"), digest=True)
    return out.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_dropped").alias("n_dropped"), F.col("_kept").alias("kept_sha256"))


def op12_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of two and three words of each language."""
    return collocations.collocations(_table(spark, sf_dir, "documents"))


def op13_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every usable vector's centroid after five rounds, its distance, and the sums of distances."""
    assigned, final = centroids.clusters(_table(spark, sf_dir, "embeddings"))
    return centroids.with_inertia(assigned, final).withColumnRenamed("id", "vec_id").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


QUERIES = {
    "op1_html_extraction": op1_html_extraction,
    "op2_benchmark_decontamination": op2_benchmark_decontamination,
    "op3_sum_of_squares_packing": op3_sum_of_squares_packing,
    "op4_minhash_near_dedup": op4_minhash_near_dedup,
    "op5_license_scan": op5_license_scan,
    "op6_language_id": op6_language_id,
    "op7_ball_tree_top_k": op7_ball_tree_top_k,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_chat_formatting": op10_chat_formatting,
    "op11_line_dedup": op11_line_dedup,
    "op12_phrase_collocations": op12_phrase_collocations,
    "op13_centroid_clustering": op13_centroid_clustering,
}

_TOP_K_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0
), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_WINDOW_SQL = r"""
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), p AS (SELECT doc_id, unnest(range(1, len(words) - 33)) AS i, words FROM w WHERE len(words) >= 35),
g AS (SELECT doc_id, i, array_to_string(list_slice(words, i, i + 34), ' ') AS win FROM p),
d AS (SELECT win FROM g GROUP BY win HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS j FROM g JOIN d USING (win)),
k AS (SELECT w.doc_id, t.j, w.words[t.j] AS word FROM w, LATERAL (SELECT unnest(range(1, len(w.words) + 1)) AS j) t),
m AS (SELECT k.doc_id, k.j, k.word, c.j IS NOT NULL AS gone FROM k LEFT JOIN c ON c.doc_id = k.doc_id AND c.j = k.j),
a AS (SELECT doc_id, count(*) AS n_words, sum(CASE WHEN gone THEN 1 ELSE 0 END) AS n_removed, coalesce(string_agg(word, ' ' ORDER BY j) FILTER (NOT gone), '') AS kept FROM m GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(a.n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(a.n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(a.kept, '')) AS kept_sha256
FROM w LEFT JOIN a ON a.doc_id = w.doc_id
"""

_NEAR_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) >= 5 THEN list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) WHEN len(words) > 0 THEN [array_to_string(words, ' ')] ELSE [] END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, w.doc_id = component_id AS kept FROM w JOIN m ON m.a = w.doc_id LEFT JOIN n ON n.doc_id = w.doc_id
"""

_ESCAPED = r"regexp_replace({c}, '(\\|<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|\[ROLE\]|\[/ROLE\])', '\\\1', 'g')"
_CHAT_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), u AS (
  SELECT *, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n,
    sum(20 + length({_ESCAPED.format(c="role")}) + length({_ESCAPED.format(c="text")})) OVER w AS upto
  FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY i)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY i) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(CASE WHEN role = 'assistant' OR i = n THEN upto ELSE 0 END) AS BIGINT) AS formatted_chars
FROM u GROUP BY conv_id
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
_LINE_SQL = rf"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS s FROM documents),
l AS (SELECT doc_id, unnest(s) AS line, unnest(range(len(s))) AS i FROM d),
k AS (SELECT *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'), {_AZ}) AS key FROM l),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
m AS (SELECT k.doc_id, k.line, k.i, coalesce(k.doc_id < c.last, FALSE) AS gone FROM k LEFT JOIN c ON c.key = k.key)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""

_PHRASE_SQL = rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {_AZ}), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS MATERIALIZED (SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (
  SELECT lang, 1 AS m, unnest(w) AS phrase FROM w
  UNION ALL SELECT lang, 2, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM w WHERE len(w) > 1
  UNION ALL SELECT lang, 3, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) FROM w WHERE len(w) > 2
), f AS MATERIALIZED (SELECT lang, m, phrase, count(*) AS f FROM g GROUP BY lang, m, phrase HAVING count(*) >= 10),
n AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM w GROUP BY lang),
x AS (SELECT lang, m, phrase, f AS a, string_split(phrase, ' ') AS s FROM f WHERE m > 1),
u AS (SELECT *, unnest(range(1, m)) AS k FROM x),
c AS (SELECT lang, phrase, a, k, array_to_string(s[1:k], ' ') AS lp, array_to_string(s[k + 1:], ' ') AS rp FROM u),
z AS (
  SELECT c.lang, c.phrase, a, k, l.f AS l, r.f AS r, CAST((CAST(1000000 AS HUGEINT) * a * a) // (CAST(l.f AS HUGEINT) * r.f) AS BIGINT) AS score
  FROM c JOIN f l ON l.lang = c.lang AND l.phrase = c.lp JOIN f r ON r.lang = c.lang AND r.phrase = c.rp
), b AS (SELECT * FROM z QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
t AS (SELECT lang, a, unnest([s[1] || ' ' || s[2], s[2] || ' ' || s[3]]) AS phrase FROM x WHERE m = 3),
o AS (SELECT lang, phrase, max(a) AS most FROM t GROUP BY lang, phrase),
y AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN o ON o.lang = b.lang AND o.phrase = b.phrase WHERE o.most IS NULL OR 100 * o.most < 50 * a)
SELECT y.lang, rank, phrase, a, l, r, n, score FROM y JOIN n ON n.lang = y.lang WHERE rank <= 2000
"""


def _centroid_sql(rounds: int = 5) -> str:
    gap = "CAST(list_sum(list_transform(list_zip(v.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) * 64 + c.c"
    steps = "".join(
        f"""a{i} AS MATERIALIZED (SELECT v.id, any_value(v.v) AS v, min({gap}) AS m FROM v, c{i} c GROUP BY v.id),
s{i} AS (SELECT m % 64 AS c, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM (SELECT m, unnest(v) AS x, unnest(range(64)) AS i FROM a{i}) GROUP BY 1, 2),
n{i} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS v FROM s{i} GROUP BY c),
c{i + 1} AS MATERIALIZED (SELECT c.c, coalesce(n.v, c.v) AS v FROM c{i} c LEFT JOIN n{i} n ON n.c = c.c),
"""
        for i in range(rounds)
    )
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || CAST(vec_id AS VARCHAR)), v) - 1 AS c, v FROM v WHERE vec_id IS NOT NULL QUALIFY c < 40),
{steps}a{rounds} AS MATERIALIZED (SELECT v.id, any_value(v.vec_id) AS vec_id, min({gap}) AS m FROM v, c{rounds} c GROUP BY v.id),
d AS (SELECT vec_id, m % 64 AS c, m // 64 AS distance FROM a{rounds})
SELECT vec_id, CAST(d.c AS INTEGER) AS cluster, distance, CAST(sum(distance) OVER (PARTITION BY d.c) AS BIGINT) AS cluster_inertia,
  CAST(sum(distance) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
FROM d JOIN c{rounds} c ON c.c = d.c
"""


#: Packing, extraction, learned scores and the CGK search have no SQL form; tests hold them against brute force.
ORACLES: dict[str, str] = {
    "op4_minhash_near_dedup": _NEAR_SQL,
    "op5_license_scan": license_digest.ORACLE,
    "op7_ball_tree_top_k": _TOP_K_SQL,
    "op8_substring_dedup": _WINDOW_SQL,
    "op10_chat_formatting": _CHAT_SQL,
    "op11_line_dedup": _LINE_SQL,
    "op12_phrase_collocations": _PHRASE_SQL,
    "op13_centroid_clustering": _centroid_sql(),
}
