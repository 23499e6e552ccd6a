"""The queries of this subpackage's operators, and SQL for those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import chat_format, cotraining, decontaminate, line_dedup, lm_scoring, sentencepiece_stream, simhash, substring_dedup, telephony, token_orc
from tallyline.llm.common import new_path, written


def _path(name: str) -> str:
    """A vocabulary file of the public tokenizers; the folder is a parameter of the box, not of this repository."""
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_stream.encoded_digest(_table(spark, sf_dir, "documents"), _path("piece_bpe_32k.model"))


def op3_token_orc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = token_orc.write_tokens(_table(spark, sf_dir, "documents"), _path("byte_bpe_50k.json"))
    return token_orc.token_offsets(spark, path)


def op4_telephony(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = telephony.store_media(_table(spark, sf_dir, "documents"), pcm_rate=2 * telephony.RATE)
    return telephony.media_features(spark.read.parquet(path))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cotraining.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _table(spark, sf_dir, "labels").where("quality = 1 and toxic = 0").select("doc_id")
    return lm_scoring.score_documents(_table(spark, sf_dir, "documents"), good)


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    rows = rows.unionByName(spark.createDataFrame([(-1, 0, "user", odd), (-1, 1, "assistant", odd)], rows.schema))
    stored = written(chat_format.format_conversations(rows, _path("byte_bpe_50k.json")), "chat", new_path(spark, "chat"), options=chat_format.STORED)
    return chat_format.read_back(stored).drop("n_ids", "n_loss_ids")


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_benchmark(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    named = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(named.cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup_substrings(_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    own = (op1_line_dedup, op2_sentencepiece, op3_token_orc, op4_telephony, op5_quality, op6_lm_scoring, op7_chat_format, op8_simhash, op9_decontaminate, op10_substring_dedup, pipeline)
    return {f.__name__: f for f in own}


# ---- DuckDB ----

_OP1 = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, text FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
n AS (SELECT doc_id, count(*) AS n_lines FROM l GROUP BY 1),
w AS (SELECT doc_id, i, line || chr(10) || lead(line, 1) OVER p || chr(10) || lead(line, 2) OVER p AS win FROM l
      WINDOW p AS (PARTITION BY doc_id ORDER BY i)),
f AS (SELECT win, min((doc_id, i)) AS first FROM w WHERE win IS NOT NULL GROUP BY 1 HAVING count(*) > 1),
s AS (SELECT w.doc_id, w.i FROM w JOIN f USING (win) WHERE (w.doc_id, w.i) <> f.first),
g AS (SELECT DISTINCT doc_id, i + o AS i FROM s, (SELECT unnest([0, 1, 2]) AS o)),
k AS (SELECT l.doc_id, string_agg(line, chr(10) ORDER BY i) AS left_text FROM l ANTI JOIN g USING (doc_id, i) GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
SELECT d.doc_id, n.n_lines, coalesce(c.n, 0)::BIGINT AS n_removed, sha256(CASE WHEN c.n IS NULL THEN d.text ELSE coalesce(k.left_text, '') END) AS kept_sha256
FROM d JOIN n USING (doc_id) LEFT JOIN c USING (doc_id) LEFT JOIN k USING (doc_id)
"""

_OP7 = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, regexp_replace(text, '<(\\*)\|', '<\1\\|', 'g') AS body,
  regexp_replace(regexp_replace(role, '<(\\*)\|', '<\1\\|', 'g'), '\|(\\*)>', '|\1\\>', 'g') AS head FROM c)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(length(head) + length(body) + 13)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
p AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS phrase
      FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT size FROM p),
x AS (SELECT doc_id, i, size, array_to_string(w[i:i + size - 1], ' ') AS phrase
      FROM (SELECT doc_id, w, size, unnest(generate_series(1, len(w) - size + 1)) AS i FROM d, z WHERE len(w) >= size)),
h AS (SELECT DISTINCT doc_id, i, x.size, item_id FROM x JOIN p ON x.size = p.size AND x.phrase = p.phrase),
q AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(generate_series(i, i + size - 1)) AS j FROM h) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN q USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP10 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS win FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 12)) AS i FROM d WHERE len(w) >= 13)),
f AS (SELECT win, min(doc_id) AS first FROM x GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
g AS (SELECT DISTINCT doc_id, i + o AS i FROM x JOIN f USING (win), (SELECT unnest(generate_series(0, 12)) AS o) WHERE first < doc_id),
l AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS left_text FROM l ANTI JOIN g USING (doc_id, i) GROUP BY 1),
c AS (SELECT doc_id, count(*) AS n FROM g GROUP BY 1)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n, 0)::BIGINT AS n_removed, sha256(coalesce(left_text, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN c USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": _OP1, "op7_chat_format": _OP7, "op9_decontaminate": _OP9, "op10_substring_dedup": _OP10}
