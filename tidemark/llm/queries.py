"""The corpus queries: each applies one operator to its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import audit_sql


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ngram_jaccard import jaccard_components

    return jaccard_components(_documents(spark, sf_dir))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.toxicity import toxicity

    return toxicity(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tidemark.llm.pieces import encode_decode

    return encode_decode(_documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.langid import identify

    return identify(_documents(spark, sf_dir))


def op5_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.lm import score

    return score(_documents(spark, sf_dir))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.mixing import mix_sources

    return mix_sources(_documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.fingerprints import fingerprints

    return fingerprints(_documents(spark, sf_dir))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.quality import quality

    return quality(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.ann import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.secrets import scan_secrets

    return scan_secrets(_documents(spark, sf_dir))


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.centroids import cluster

    return cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op12_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.divergence import divergence

    return divergence(_documents(spark, sf_dir))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.llm.decontamination import decontaminate

    return decontaminate(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES = {
    "op1_ngram_jaccard": op1_ngram_jaccard,
    "op2_toxicity": op2_toxicity,
    "op3_pieces": op3_pieces,
    "op4_language": op4_language,
    "op5_lm": op5_lm,
    "op6_mixing": op6_mixing,
    "op7_fingerprints": op7_fingerprints,
    "op8_quality": op8_quality,
    "op9_neighbours": op9_neighbours,
    "op10_secrets": op10_secrets,
    "op11_centroids": op11_centroids,
    "op12_divergence": op12_divergence,
    "op13_decontamination": op13_decontamination,
}

#: DuckDB SQL over the same tables.
ORACLES = {
    "op11_centroids": audit_sql.centroids(),
    "op12_divergence": audit_sql.DIVERGENCE,
    "op13_decontamination": audit_sql.DECONTAMINATION,
    "op1_ngram_jaccard": r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN CAST([] AS VARCHAR[]) WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) END AS s
  FROM words),
sizes AS (SELECT doc_id, CAST(len(s) AS BIGINT) AS n FROM sets),
items AS (SELECT doc_id, unnest(s) AS g FROM sets),
pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM items a JOIN items b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
linked AS (
  SELECT x, y FROM pairs JOIN sizes p ON p.doc_id = x JOIN sizes q ON q.doc_id = y WHERE 100 * c >= 80 * (p.n + q.n - c)),
edges AS (SELECT x, y FROM linked UNION SELECT y, x FROM linked),
reach AS (
  SELECT doc_id AS x, doc_id AS y FROM sizes
  UNION
  SELECT r.x, e.y FROM reach r JOIN edges e ON e.x = r.y)
SELECT s.doc_id, s.n AS n_shingles, min(r.y) AS component_id FROM sizes s JOIN reach r ON r.x = s.doc_id GROUP BY 1, 2
""",
    "op6_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size,
    CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15)) AS BIGINT) AS hash
  FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY 1),
ranked AS (
  SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS nth, 3.0 * CAST(source_size AS DOUBLE) AS cap FROM totals),
weighed AS (SELECT *, CASE nth % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS weight FROM ranked),
filled AS (
  SELECT *, sum(cap) OVER w - cap AS before, sum(weight) OVER () - sum(weight) OVER w + weight AS left_weight,
    CAST(sum(source_size) OVER () AS DOUBLE) AS total
  FROM weighed WINDOW w AS (ORDER BY cap / weight, nth)),
levels AS (SELECT *, (total - before) / left_weight AS level FROM filled),
final AS (SELECT arg_min(level, before) AS level FROM levels WHERE level * weight <= cap),
aims AS (
  SELECT source, source_size, least(cap, coalesce(final.level * weight, cap)) AS target,
    CASE WHEN source_size > 0 THEN CAST(floor(least(cap, coalesce(final.level * weight, cap)) / source_size) AS BIGINT) ELSE 0 END AS full_passes
  FROM levels LEFT JOIN final ON true),
sums AS (
  SELECT s.source, hash, sum(size) AS words FROM sized s GROUP BY 1, 2),
running AS (
  SELECT s.source, hash, words, sum(words) OVER (PARTITION BY s.source ORDER BY hash) AS upto FROM sums s),
edges AS (
  SELECT r.source, min(hash) AS hash, arg_min(upto, hash) AS upto, arg_min(words, hash) AS words, any_value(target - full_passes * source_size) AS rest
  FROM running r JOIN aims a ON r.source IS NOT DISTINCT FROM a.source WHERE upto > target - full_passes * source_size GROUP BY 1)
SELECT s.doc_id, s.size, a.source_size, a.target,
  CAST(s.size * (a.full_passes + CASE WHEN s.hash < e.hash OR (s.hash = e.hash AND e.upto - e.rest < e.rest - (e.upto - e.words)) THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM sized s JOIN aims a ON s.source IS NOT DISTINCT FROM a.source LEFT JOIN edges e ON s.source IS NOT DISTINCT FROM e.source
""",
}
