"""The registered queries of this subpackage, with production parameters, and their DuckDB equivalents.

Each query reads its whole table and returns the operator's full result.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lacuna.llm import chat, exact_dedup, gif, hard_negatives, html_text, licenses, near_dedup, packing, quality, resampling, substrings, tokens, toxicity


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op2_sum_of_squares_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"), window=1024, end_id=0)


def op3_block_naming(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op4_factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality.score(docs, quality.fit(docs, labels))


def op5_convolutional_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return toxicity.score(docs, toxicity.fit(docs, labels))


def op6_prob_min_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op7_block_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return tokens.token_digests(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


#: A conversation whose texts hold the template's control strings, added to the table.
CONTROL_TEXT = "\\### Assistant: </turn> ok"


def op9_schema_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text")
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    return chat.conversation_digests(rows.unionByName(planted))


def op10_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gif.store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def op11_suffix_automata(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op12_radix_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(vectors.withColumn("label", label), F.col("vec_id") % 50 == 0)


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resampling.resample(docs, target)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_sum_of_squares_packing": op2_sum_of_squares_packing,
    "op3_block_naming": op3_block_naming,
    "op4_factorisation_machine": op4_factorisation_machine,
    "op5_convolutional_toxicity": op5_convolutional_toxicity,
    "op6_prob_min_hash": op6_prob_min_hash,
    "op7_block_rules": op7_block_rules,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_schema_fingerprints": op9_schema_fingerprints,
    "op10_gif_media": op10_gif_media,
    "op11_suffix_automata": op11_suffix_automata,
    "op12_radix_negatives": op12_radix_negatives,
    "op13_importance_resampling": op13_importance_resampling,
}

#: Equal texts by their normalised strings themselves, compared whole.
OP3_SQL = r"""
WITH docs AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       doc_id = min(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
FROM docs
"""

#: The template's escapes and marks applied to the rows; nothing is formatted as a whole but its length.
OP9_SQL = r"""
WITH turns AS (
  SELECT conv_id, turn::BIGINT AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '\### Assistant: </turn> ok'), (-7, 1, 'assistant', '\### Assistant: </turn> ok')) v(conv_id, turn, role, text)
),
escaped AS (
  SELECT *, replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), chr(10), '\n') AS r,
         replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS t
  FROM turns
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('### ' || r || chr(10) || t || '</turn>' || chr(10)))::BIGINT AS formatted_chars
FROM escaped GROUP BY conv_id
"""

#: Every window as a string, with the first document that has it.
OP11_SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT rid, doc_id, p, array_to_string(w[p : p + 49], ' ') AS t FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 48)) AS p FROM docs WHERE len(w) >= 50)
),
repeated AS (SELECT rid, p FROM windows QUALIFY min(doc_id) OVER (PARTITION BY t) < coalesce(doc_id, 9223372036854775807)),
gone AS (SELECT DISTINCT rid, p + k AS p FROM repeated, range(50) r(k)),
kept AS (
  SELECT rid, w, p FROM (SELECT rid, unnest(w) AS w, unnest(range(1, len(w) + 1)) AS p FROM docs) ANTI JOIN gone USING (rid, p)
),
joined AS (SELECT rid, string_agg(w, ' ' ORDER BY p) AS t, count(*) AS n FROM kept GROUP BY rid)
SELECT doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM docs LEFT JOIN joined USING (rid)
"""

#: All pairs of the anchors with all rows, ranked by windows.
OP12_SQL = r"""
WITH vectors AS (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT a.rid AS anchor, a.vec_id AS anchor_id, b.rid, b.vec_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM vectors a JOIN vectors b ON a.rid <> b.rid AND len(a.v) = len(b.v) WHERE a.vec_id % 50 = 0
),
positives AS (SELECT * FROM scored WHERE same QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, vec_id, rid) <= 5)
SELECT p.anchor_id, p.vec_id AS positive_id, row_number() OVER (PARTITION BY p.anchor, p.rid ORDER BY n.score DESC, n.vec_id, n.rid)::INTEGER AS rank,
       n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positives p JOIN scored n ON n.anchor = p.anchor AND NOT n.same AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""

#: CRC-32 by its table, byte by byte, for each distinct word; everything else as the contract says it.
OP13_SQL = r"""
WITH RECURSIVE rounds(b, c, k) AS (
  SELECT b, b, 0 FROM range(256) r(b)
  UNION ALL SELECT b, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM rounds WHERE k < 8
),
crc AS (SELECT list(c ORDER BY b) AS t FROM rounds WHERE k = 8),
docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM documents
),
aim AS (
  SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words FROM benchmark
),
used AS (
  SELECT rid, w, count(*) AS n FROM (SELECT rid, unnest(words) AS w FROM docs) GROUP BY ALL
  UNION ALL SELECT NULL, w, count(*) FROM (SELECT unnest(words) AS w FROM aim) GROUP BY w
),
vocabulary AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM used),
bucketed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295, list_transform(range(length(h) // 2), lambda k: (ascii(h[2 * k + 1]) - CASE WHEN h[2 * k + 1] <= '9' THEN 48 ELSE 55 END) * 16 + ascii(h[2 * k + 2]) - CASE WHEN h[2 * k + 2] <= '9' THEN 48 ELSE 55 END)),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket
  FROM vocabulary, crc
),
counts AS (
  SELECT b AS bucket, coalesce(sum(n) FILTER (rid IS NOT NULL), 0) AS s, coalesce(sum(n) FILTER (rid IS NULL), 0) AS t
  FROM range(10000) r(b) LEFT JOIN bucketed ON bucket = b LEFT JOIN used USING (w) GROUP BY b
),
gain AS (
  SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS g FROM counts
),
weights AS (SELECT rid, sum(n * g)::BIGINT AS weight FROM used JOIN bucketed USING (w) JOIN gain USING (bucket) WHERE rid IS NOT NULL GROUP BY rid),
scored AS (
  SELECT rid, doc_id, len(words) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM docs LEFT JOIN weights USING (rid)
),
ranked AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (rid)
"""

ORACLE_SQL: dict[str, str] = {
    "op1_license_scan": licenses.oracle_sql(),
    "op3_block_naming": OP3_SQL,
    "op9_schema_fingerprints": OP9_SQL,
    "op11_suffix_automata": OP11_SQL,
    "op12_radix_negatives": OP12_SQL,
    "op13_importance_resampling": OP13_SQL,
}
