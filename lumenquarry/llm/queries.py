"""The queries opN_<name> of this subpackage, each over its whole table, and their SQL."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, langid, ngram_join, pii, ppm, quality, token_files, vafile
from .common import shared_dir, table

SURROGATE_KEY = "lumenquarry-public-example-key"  # a deployment passes its own secret


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.groups(table(spark, sf_dir, "documents"))


def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    new = pii.replace(table(spark, sf_dir, "documents"), SURROGATE_KEY)
    return new.select("doc_id", "text", F.size(F.coalesce("__kinds", F.array())).cast("long").alias("n_entities"), F.array_join(F.array_sort(F.array_distinct("__kinds")), ",").alias("kinds"))


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, chat.ASSISTANT, said)], rows.schema)
    return chat.read_packs(chat.pack(rows.unionAll(probe)))


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return vafile.top_k(rows, rows.where(F.col("vec_id") % 50 == 0)).withColumn("score", F.col("score").try_cast("long"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/tokens-{uuid.uuid4().hex}"
    manifest = token_files.write_token_files(docs, tokenizer("word_bpe_49k.json"), folder, end_id=2)
    return token_files.read_token_files(spark, folder, docs.schema["doc_id"], manifest)


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_pages(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    def digests(ids: list[int], decoded: str) -> tuple:
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()

    return bpe.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"), digests, "n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ppm.score_split(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_ngram_join, op3_surrogates, op4_chat, op5_top_k, op6_decontamination, op7_token_files, op8_language, op9_bpe, op10_ppm)}

ORACLE_SQL = {
    "op2_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS t
  FROM w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS u(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY ALL
), e AS (
  SELECT x, y FROM pairs JOIN n AS p ON p.doc_id = x JOIN n AS q ON q.doc_id = y WHERE 100 * k >= 80 * (p.n + q.n - k)
), r AS (
  SELECT doc_id AS x, doc_id AS y FROM documents UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x
)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN (SELECT x, min(y) AS component_id FROM r GROUP BY x) AS c ON c.x = w.doc_id
""",
    "op4_chat": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), sized AS (
  SELECT *, list_sum(list_transform({list(chat.CONTROL)!r}, lambda c: (length(role) - length(replace(role, c, '')) + length(text) - length(replace(text, c, ''))) // length(c)))
         + 2 * (length(role) + length(text)) - length(replace(role, chr(92), '')) - length(replace(text, chr(92), ''))
         + length(role) - length(replace(role, chr(10), '')) + {len(chat.OPEN + chat.CLOSE) + 2} AS chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(chars) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
""",
    "op5_top_k": """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id AS vec_id,
         CAST(list_sum(list_transform(range(1, len(a.q) + 1), lambda i: a.q[i] * b.q[i])) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.q) = len(b.q)
  WHERE a.vec_id % 50 = 0
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS n FROM s
)
SELECT query_id, CAST(n AS INTEGER) AS rank, vec_id, score FROM r WHERE n <= 5
""",
    "op6_decontamination": r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), bw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS t
  FROM bw, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS u(i) WHERE len(w) > 0
), dwin AS (
  SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS t
  FROM dw, (SELECT DISTINCT k FROM win) AS ks, unnest(range(1, len(w) - k + 2)) AS u(i) WHERE len(w) >= k
), occ AS (
  SELECT d.doc_id, d.i, d.k, m.item_id FROM dwin d JOIN win m ON d.k = m.k AND d.t = m.t
), hit AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM occ) GROUP BY doc_id
), its AS (
  SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM occ) GROUP BY doc_id
)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
""",
}
