"""The queries of this subpackage, each over the whole table, and SQL for those that it can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact, imatch, langid, mixing, packing, quality, secrets, simhash, store, toxicity


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark, sf_dir):
    return quality.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_token_store(spark, sf_dir):
    return store.encode(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"), end_id=1)


def op3_simhash(spark, sf_dir):
    return simhash.classes(_read(spark, sf_dir, "documents"), threshold=4, words=4)


def op4_secrets(spark, sf_dir):
    return secrets.scan_documents(_read(spark, sf_dir, "documents"))


def op5_packing(spark, sf_dir):
    return packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), end_id=0, length=1024)


def op6_imatch(spark, sf_dir):
    return imatch.compare(_read(spark, sf_dir, "documents"))


def op7_mixing(spark, sf_dir):
    p = mixing.plan(_read(spark, sf_dir, "documents"))
    return p.selectExpr("doc_id", "size", "source_size", "target", "size * times AS taken")


def op8_langid(spark, sf_dir):
    return langid.predict(_read(spark, sf_dir, "documents"))


def op9_exact_dedup(spark, sf_dir):
    return exact.groups(_read(spark, sf_dir, "documents"), keep="max")


def op10_toxicity(spark, sf_dir):
    return toxicity.score(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_quality, op2_token_store, op3_simhash, op4_secrets, op5_packing, op6_imatch, op7_mixing, op8_langid, op9_exact_dedup, op10_toxicity)}

ORACLE = {
    "op7_mixing": r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS DOUBLE) AS w
  FROM d GROUP BY source
), r AS (  -- in ascending order of the level at which a source is full
  SELECT *, sum(3.0 * source_size) OVER o - 3.0 * source_size AS full_before, sum(w) OVER () - (sum(w) OVER o - w) AS w_left,
         sum(source_size) OVER () AS total
  FROM s WINDOW o AS (ORDER BY source_size / w, source ROWS UNBOUNDED PRECEDING)
), l AS (
  SELECT (total - full_before) / w_left AS level FROM r WHERE (total - full_before) / w_left <= 3.0 * source_size / w
  ORDER BY source_size / w, source LIMIT 1
), t AS (
  SELECT source, source_size, round(least(3.0 * source_size, w * level), 6) AS target FROM s, l
), e AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS share,
         CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('mix-1|' || coalesce(CAST(d.doc_id AS VARCHAR), 'null')), d.size ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(share) + CASE WHEN share > floor(share) AND 2 * before + size <= 2 * ((share - floor(share)) * source_size) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM e
""",
    "op9_exact_dedup": """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents
), g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, sha256(n.norm) AS text_sha256
FROM n JOIN g ON n.norm = g.norm
""",
}
