"""The corpus operators as queries over a folder of Parquet tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, classifier, clustering, codes, jaccard, line_dedup, mixing, packing, pii, quality, sharding, suffix_dedup, topk


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.plan(_documents(spark, sf_dir), keep=["doc_id"])
    return plan.select("row.doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(_documents(spark, sf_dir))
    return found.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(pii.spans_text(F.col("base_spans")), 256).alias("base_sha256"), pii.spans_text(F.col("spans")).alias("spans"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = sharding.shard(_documents(spark, sf_dir), keep=["doc_id"])
    return done.select("row.doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = suffix_dedup.deduplicate(_documents(spark, sf_dir), keep=["doc_id"])
    return done.select("row.doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_documents(spark, sf_dir), keep=["doc_id"])
    return judged.select("row.doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op6_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = line_dedup.deduplicate(_documents(spark, sf_dir))
    return done.select("row.doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_documents(spark, sf_dir), tokenizer_path(), with_ids=False)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.classes(_documents(spark, sf_dir))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    tricky = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", tricky), (-7, 1, "assistant", tricky)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_events(chat.events_of(table.unionByName(more))))


def op11_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.report(clustering.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))).withColumnRenamed("id", "vec_id")


def op12_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = classifier.score(docs, model, keep=["doc_id"]).withColumn("held_out", classifier.remainder(F.col("row.doc_id")) == 1)
    return scored.select("row.doc_id", "held_out", "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def op13_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = codes.encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), keep=["vec_id", "label"])
    return codes.report(done).select("row.vec_id", "code", "error", "label_error", "codebooks_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": op1_mixing,
        "op2_pii": op2_pii,
        "op3_sharding": op3_sharding,
        "op4_suffix_dedup": op4_suffix_dedup,
        "op5_quality": op5_quality,
        "op6_top_k": op6_top_k,
        "op7_line_dedup": op7_line_dedup,
        "op8_packing": op8_packing,
        "op9_ngram_jaccard": op9_ngram_jaccard,
        "op10_chat": op10_chat,
        "op11_clustering": op11_clustering,
        "op12_classifier": op12_classifier,
        "op13_codes": op13_codes,
    }


_MIXING = r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INTEGER)] AS w, source_size * 3.0::DOUBLE AS cap, sum(source_size) OVER () AS total FROM s),
l AS (SELECT *, cap / w AS ratio, (CAST(total AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY cap / w, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least(cap, coalesce((SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * w, cap)) AS target FROM l),
k AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS e,
  row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.doc_id) AS k, CAST(concat('0x', substr(md5(concat('42:', coalesce(d.source, ''))), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(least(floor(e * k + u) - floor(e * (k - 1) + u), 3) AS INTEGER) AS copies FROM k)
SELECT doc_id, size, source_size, target, copies * size AS taken, copies FROM c
"""

_QUALITY = r"""
WITH t AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM t),
p AS (SELECT doc_id, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT doc_id, i, concat(w, ' ', lead(w) OVER o, ' ', lead(w, 2) OVER o) AS g, lead(w, 2) OVER o AS third FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g WHERE third IS NOT NULL),
x AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM r WHERE n > 1) GROUP BY 1),
f AS (SELECT w.doc_id, source, CAST(len(w) AS BIGINT) AS n_words, CAST(length(translate(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13), '')) AS BIGINT) AS word_chars,
  CAST(length(text) - length(translate(text, '#*$%&|<>', '')) AS BIGINT) AS n_symbols, len(lines) AS n_lines, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, CAST(coalesce(x.n, 0) AS BIGINT) AS n_repeat_words
  FROM w LEFT JOIN x USING (doc_id)),
b AS (SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, n_symbols > 0.1 * word_chars AS f3, n_dup_lines > 0.3 * n_lines AS f4 FROM f),
h AS (SELECT source, count(*) AS n, sum(f1::INT) AS n1, sum(f2::INT) AS n2, sum(f3::INT) AS n3, sum(f4::INT) AS n4 FROM b GROUP BY 1),
u AS (SELECT source, n, unnest([n1, n2, n3, n4]) AS k, unnest([1, 2, 3, 4]) AS rule FROM h),
m AS (SELECT rule, avg(k / n) AS m, var_samp(k / n) AS v FROM u GROUP BY 1),
z AS (SELECT source, (k + m * s) / (n + s) AS rate FROM (SELECT u.*, m, CASE WHEN v > 0 AND v < m * (1 - m) THEN m * (1 - m) / v - 1 ELSE 20.0 END AS s FROM u JOIN m USING (rule))),
bad AS (SELECT source, max(rate) > 0.5 AS bad FROM z GROUP BY 1)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, f1 OR f2 AS base_failed, NOT (f1 OR f2) AND NOT (bad AND (f3 OR f4)) AS kept
FROM b JOIN bad ON b.source IS NOT DISTINCT FROM bad.source
"""

_TOP_K = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e) WHERE q.vec_id % 20 = 0),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

_JACCARD = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM g a JOIN g b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
c AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT c.a, l.b FROM c JOIN l ON c.b = l.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, m AS component_id FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS m FROM c GROUP BY 1) USING (doc_id)
"""

_CHAT = r"""
WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), chr(92) || '### Assistant: </turn> ok'),
e AS (SELECT *, 14 + length(role) + length(text) + length(text) - length(replace(text, chr(92), '')) + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x))), 0) + len(regexp_extract_all(text, '</turn>')) AS f FROM t)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256, CAST(sum(f) AS BIGINT) AS formatted_chars
FROM e GROUP BY 1
"""


_WHOLE = "list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(embedding) = 64"


def _lloyd(start: str, rounds: int) -> str:
    """Rounds of exact Lloyd iterations over x (r, p, q) from c0 (p, c, q): the last assignment is in a, the last table in c, with the round's number."""
    sql = f"{start.strip()},\nn AS MATERIALIZED (SELECT *, list_inner_product(q, q) AS w FROM x)"
    for i in range(rounds + 1):
        sql += f""",
m{i} AS (SELECT r, p, c, CAST(n.w - 2 * list_inner_product(n.q, t.q) + list_inner_product(t.q, t.q) AS BIGINT) AS d FROM n JOIN c{i} t USING (p)),
a{i} AS MATERIALIZED (SELECT r, p, CAST(min(d * 1024 + c) % 1024 AS INTEGER) AS c, min(d) AS d FROM m{i} GROUP BY r, p)"""
        if i < rounds:
            sql += f""",
s{i} AS (SELECT p, c, j, CAST(sum(CAST(v AS BIGINT)) AS BIGINT) AS s, count(*) AS n FROM (SELECT n.p, a.c, unnest(n.q) AS v, generate_subscripts(n.q, 1) AS j FROM n JOIN a{i} a USING (r, p)) GROUP BY ALL),
u{i} AS (SELECT p, c, list(CAST((s - ((s % n) + n) % n) // n AS DOUBLE) ORDER BY j) AS q FROM s{i} GROUP BY p, c),
c{i + 1} AS MATERIALIZED (SELECT t.p, t.c, coalesce(u.q, t.q) AS q FROM c{i} t LEFT JOIN u{i} u USING (p, c))"""
    return sql


_CLUSTERING_START = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, {_WHOLE}),
x AS (SELECT r, 0 AS p, q FROM v),
c0 AS MATERIALIZED (SELECT 0 AS p, CAST(row_number() OVER (ORDER BY h) - 1 AS INTEGER) AS c, q FROM (SELECT sha256('3:' || vec_id) AS h, q FROM v ORDER BY h LIMIT 8))
"""

_CLUSTERING = f"""
{_lloyd(_CLUSTERING_START, 10)}
SELECT vec_id, a10.c AS "cluster", a10.d AS distance, CAST(sum(d) OVER (PARTITION BY a10.c) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(list_transform(c10.q, lambda y: CAST(y AS BIGINT)), ',')) AS centroid_sha256
FROM v JOIN a10 USING (r) JOIN c10 ON c10.c = a10.c
"""

_CODES_START = f"""
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS r, vec_id, label, {_WHOLE}),
x AS (SELECT r, p, q[p * 16 + 1:p * 16 + 16] AS q FROM v, (SELECT unnest([0, 1, 2, 3]) AS p)),
c0 AS MATERIALIZED (SELECT p, c, q[p * 16 + 1:p * 16 + 16] AS q
  FROM (SELECT CAST(row_number() OVER (ORDER BY vec_id) - 1 AS INTEGER) AS c, q FROM v ORDER BY vec_id LIMIT 256), (SELECT unnest([0, 1, 2, 3]) AS p))
"""

_CODES = f"""
{_lloyd(_CODES_START, 4)},
h AS (SELECT sha256(string_agg(array_to_string(list_transform(q, lambda y: CAST(y AS BIGINT)), ','), ',' ORDER BY p, c)) AS h FROM c4),
e AS (SELECT r, string_agg(lpad(lower(to_hex(c)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a4 GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256 FROM v JOIN e USING (r), h
"""


def oracle_sql() -> dict[str, str]:
    """What SQL can express: the others need byte windows, tokenizers, SimHash groups, places of matches or a compressor, and have brute-force tests."""
    return {
        "op1_mixing": _MIXING,
        "op5_quality": _QUALITY,
        "op6_top_k": _TOP_K,
        "op9_ngram_jaccard": _JACCARD,
        "op10_chat": _CHAT,
        "op11_clustering": _CLUSTERING,
        "op13_codes": _CODES,
    }
