"""The numbered queries over the whole tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, fingerprint, itq, licenses, lm, mixing, ngram_join, sharding, spelling, token_files, topk, toxicity, whitening
from .base import documents


def tokenizer_path(name: str) -> str:
    """Where a public vocabulary file lies; every machine has the files installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every template's occurrences in every document: doc_id, license, containment, first_word, end_word, places."""
    return licenses.scan(documents(spark, sf_dir))


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids and their decoding: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    return bpe.digests(documents(spark, sf_dir), tokenizer_path("byte_bpe_multi_50k.tiktoken"), tokenizer_pattern())


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place in the token files, read back from them: doc_id, start, n_tokens, ids_crc32."""
    return token_files.read(token_files.write(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"), plain=False))


def op4_attention_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's scores: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    return lm.scored(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.tiktoken"), tokenizer_pattern())


def op5_itq_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's links: vec_id, n_links, component_id, kept."""
    return itq.linked(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op6_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of every document: doc_id, size, source_size, target, taken."""
    return mixing.report(documents(spark, sf_dir))


def op7_iblt_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint beside its edited text's and the next document's likeness."""
    return fingerprint.compared(documents(spark, sf_dir))


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shingles and component: doc_id, n_shingles, component_id."""
    return ngram_join.join(documents(spark, sf_dir))


def op9_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard under the law ``rows``: doc_id, size, text_crc32, law, shard, slot, grown_shard, curve."""
    return sharding.shards(documents(spark, sf_dir))


def op10_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's severity: doc_id, expected_severity, grade, p_toxic, toxic."""
    docs = documents(spark, sf_dir)
    return toxicity.scored(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_threshold_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every query vector's five best inner products: query_id, rank, vec_id, score."""
    return topk.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_lobpcg_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's whitened components: vec_id, component, n, deviation, whitened, explained, identity_error."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every frequent word's form and root: word, form, root, n, n_near, form_n."""
    return spelling.variants(documents(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_license_scan, op2_byte_bpe, op3_token_files, op4_attention_lm, op5_itq_near_duplicates, op6_source_mix, op7_iblt_fingerprints, op8_ngram_jaccard, op9_hilbert_shards, op10_ordinal_toxicity, op11_threshold_topk, op12_lobpcg_whitening, op13_spelling_variants)}


def oracle_sql() -> dict[str, str]:
    return {"op6_source_mix": MIX_SQL, "op11_threshold_topk": TOPK_SQL}


#: Sorts by hash, which the operator avoids; the crossing hash goes to the nearer side.
MIX_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || md5(coalesce(doc_id::VARCHAR, ''))[1:15])::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, 3.0::DOUBLE * source_size AS most,
         ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(3.0::DOUBLE * source_size) OVER (
            ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (ORDER BY 3.0::DOUBLE * source_size / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s),
t AS (SELECT source, source_size, least(most, max(level) OVER () * w) AS target FROM l),
b AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies,
         target - CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT * source_size AS rest
  FROM t),
g AS (SELECT source, h, sum(size)::BIGINT AS n FROM d GROUP BY source, h),
r AS (SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS reached FROM g)
SELECT d.doc_id, d.size, b.source_size, b.target,
       (d.size * (b.copies + CASE WHEN r.reached < b.rest OR (r.reached - r.n < b.rest AND r.reached - b.rest < b.rest - (r.reached - r.n)) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source
JOIN r ON r.source IS NOT DISTINCT FROM d.source AND r.h = d.h
"""

#: Every query row against every row; the operator meets few of them.
TOPK_SQL = r"""
WITH v AS (
  SELECT vec_id, [floor(256 * c::DOUBLE) FOR c IN embedding] AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([c FOR c IN embedding IF c IS NULL OR NOT isfinite(c)]) = 0),
s AS (
  SELECT q.vec_id AS query_id, v.vec_id, list_dot_product(q.x, v.x)::BIGINT AS score
  FROM v AS q JOIN v ON q.vec_id <> v.vec_id WHERE q.vec_id % 50 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
