"""Queries of the corpus operators over the shared test tables, and SQL for those that it can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bitsliced, chat, exact_dedup, html_extract, mixing, near_dedup, packing, quality, sharding, token_files
from .common import P, shared_path, shared_root, table


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), keep="largest")


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive in four batches, are compacted, and are read back from the newest version."""
    docs = table(spark, sf_dir, "documents")
    shared_root(spark)
    store = sharding.ShardStore(spark, shared_path(spark, "shards"), target_bytes=64 << 20)
    arrival = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(16))
    batch = F.when(arrival < 8, 1).when(arrival < 12, 2).when(arrival < 14, 3).otherwise(4)
    store.append(docs.withColumn(f"{P}batch", batch), batch_col=f"{P}batch")
    version = store.compact()
    sizes = store.manifest(version).select(
        F.element_at(F.split("path", "/"), -1).alias("shard"), F.col("bytes").alias("shard_bytes"), F.col("n_rows").alias("shard_rows")
    )
    rows = store.read(version, shard_col=f"{P}shard").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), F.col(f"{P}shard").alias("shard"))
    return rows.join(sizes, "shard").select("doc_id", "text_sha256", "shard", "shard_bytes", "shard_rows", F.lit(version).alias("version"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_groups(table(spark, sf_dir, "documents")).drop("text_hash")


def op5_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitsliced.top_k(table(spark, sf_dir, "embeddings"), k=20, scale=64)


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    return quality.fit(*quality.labelled_sample(docs, table(spark, sf_dir, "labels"), "doc_id", "text", "quality"))


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    return scored.select(
        "doc_id",
        F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(quality.FOLDS)) == 0, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.encode_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op9_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = chat.format_preferences(chat.swapped_answers(table(spark, sf_dir, "conversations")))

    def text(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["from"].cast("string"), s["to"].cast("string"))), ",")

    return pairs.select(
        F.col("pair_id").alias("conv_id"), "n_prompt_turns", "prompt", "chosen", "rejected",
        text("chosen_loss").alias("chosen_loss"), text("rejected_loss").alias("rejected_loss"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_exact_dedup, op2_sharding, op3_packing, op4_near_dedup, op5_top_k, op6_quality, op7_mixing, op8_token_files, op9_html, op10_chat)
    return {f.__name__: f for f in own}


_MIX_SQL = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
by_source AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST(list_extract([5, 2, 1], 1 + CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT)) AS DOUBLE) AS weight
  FROM sized GROUP BY source),
caps AS (SELECT *, 2.0::DOUBLE * source_size AS cap, (2.0::DOUBLE * source_size) / weight AS ratio FROM by_source),
levels AS (
  SELECT *, (1.5::DOUBLE * CAST(sum(source_size) OVER () AS BIGINT)
     - coalesce(sum(cap) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
     / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE)) AS level
  FROM caps),
targets AS (
  SELECT source, source_size, least(cap, coalesce((SELECT max(level) FROM levels WHERE level <= ratio) * weight, cap)) AS target FROM levels),
keyed AS (
  SELECT *, length(bin(size)) * 16 + CAST(floor(size / pow(2.0::DOUBLE, greatest(length(bin(size)) - 4, 0))) AS BIGINT) AS r,
         ((coalesce(doc_id, 0) % 1024) + 1024) % 1024 AS t FROM sized),
numbered AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY r, t, size, doc_id NULLS FIRST) AS i FROM keyed),
placed AS (
  SELECT n.doc_id, n.size, s.source_size, s.target, CAST(n.i AS DOUBLE) AS i,
         CASE WHEN s.source_size > 0 THEN s.target / s.source_size ELSE 0.0::DOUBLE END AS rate
  FROM numbered n JOIN targets s ON n.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size, source_size, target,
       CAST(floor(OFFSET_OF_SEED::DOUBLE + rate * i) - floor(OFFSET_OF_SEED::DOUBLE + rate * (i - 1)) AS BIGINT) * size AS taken
FROM placed
"""

_CHAT_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(turn, -1) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
last AS (SELECT conv_id, max(turn) AS last, arg_max(text, (turn, text)) AS answer FROM t WHERE role = 'assistant' GROUP BY conv_id),
p0 AS (SELECT conv_id, CAST(NULL AS BIGINT) AS partner FROM last),
PARTNERS
duo AS (SELECT a.conv_id, a.last, b.answer AS other FROM last a JOIN pEND p ON a.conv_id = p.conv_id JOIN last b ON b.conv_id = p.partner),
own AS (
  SELECT t.conv_id, t.turn, t.role, t.text AS c, CASE WHEN t.turn = d.last AND t.role = 'assistant' THEN d.other ELSE t.text END AS r
  FROM t JOIN duo d ON t.conv_id = d.conv_id WHERE t.turn <= d.last),
one AS (SELECT conv_id, turn, min((role, c)) AS c, min((role, r)) AS r FROM (SELECT conv_id, turn, role, c, r FROM own) GROUP BY conv_id, turn),
flat AS (SELECT conv_id, turn, c[1] AS crole, c[2] AS ctext, r[1] AS rrole, r[2] AS rtext FROM one),
cut AS (SELECT conv_id, min(CASE WHEN crole <> rrole OR ctext <> rtext THEN turn END) AS other FROM flat GROUP BY conv_id),
marked AS (
  SELECT f.*, (c.other IS NULL OR f.turn < c.other) AS same,
         '<|' || crole || '|>' || chr(10) || ctext || '<|end|>' || chr(10) AS cr, '<|' || rrole || '|>' || chr(10) || rtext || '<|end|>' || chr(10) AS rr
  FROM flat f JOIN cut c ON f.conv_id = c.conv_id),
sums AS (
  SELECT *, sum(length(cr)) OVER (PARTITION BY conv_id ORDER BY turn) AS cend, sum(length(rr)) OVER (PARTITION BY conv_id ORDER BY turn) AS rend FROM marked)
SELECT conv_id, count(*) FILTER (WHERE same) AS n_prompt_turns,
       coalesce(string_agg(cr, '' ORDER BY turn) FILTER (WHERE same), '') AS prompt,
       coalesce(string_agg(cr, '' ORDER BY turn) FILTER (WHERE NOT same), '') AS chosen,
       coalesce(string_agg(rr, '' ORDER BY turn) FILTER (WHERE NOT same), '') AS rejected,
       coalesce(string_agg((cend - length(ctext) - 8)::BIGINT::VARCHAR || '-' || cend::BIGINT::VARCHAR, ',' ORDER BY turn) FILTER (WHERE NOT same AND crole = 'assistant'), '') AS chosen_loss,
       coalesce(string_agg((rend - length(rtext) - 8)::BIGINT::VARCHAR || '-' || rend::BIGINT::VARCHAR, ',' ORDER BY turn) FILTER (WHERE NOT same AND rrole = 'assistant'), '') AS rejected_loss
FROM sums GROUP BY conv_id
"""


def _chat_sql() -> str:
    """Partners within ever wider ranges of numbers, as chat.partnered finds them."""
    steps = []
    for i, bits in enumerate(chat.REACHES):
        reach = f"conv_id >> {bits}" if bits < 64 else "0"
        group = f"PARTITION BY partner IS NULL, CASE WHEN partner IS NULL THEN {reach} ELSE conv_id END"
        steps.append(
            f"p{i + 1} AS (SELECT conv_id, CASE WHEN partner IS NULL THEN coalesce(lead(conv_id) OVER ({group} ORDER BY conv_id), "
            f"nullif(min(conv_id) OVER ({group}), conv_id)) ELSE partner END AS partner FROM p{i}),"
        )
    return _CHAT_SQL.replace("PARTNERS", "\n".join(steps)).replace("pEND", f"p{len(chat.REACHES)}")


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER (PARTITION BY coalesce(text, '')) AS keep_id, count(*) OVER (PARTITION BY coalesce(text, '')) AS group_size,
                   row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept, sha256(coalesce(text, '')) AS text_sha256
            FROM documents""",
        "op5_top_k": """
            WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v FROM embeddings
                       WHERE embedding IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
                         AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND vec_id IS NOT NULL),
            s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
                  FROM q a JOIN q b ON a.vec_id % 20 = 0 AND a.vec_id <> b.vec_id),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s)
            SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20""",
        "op7_mixing": _MIX_SQL.replace("OFFSET_OF_SEED", repr(mixing.random_offset(0))),
        "op10_chat": _chat_sql(),
    }
