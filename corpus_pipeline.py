"""From documents to token ids: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import langid, mixing, ngram_jaccard, pieces, secrets
from tidemark.work import Work


def known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what language ID rejects: texts that are null, without a letter, or far from all known languages."""
    return langid.keep_known(docs)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of near copies.

    Rows of one id are one document: they stay or go together. A row without an id is no copy of another, since it cannot be named, and stays.
    """
    groups = ngram_jaccard.jaccard_components(docs)
    copies = groups.where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(*docs.columns)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace the spans of likely secrets by a mark; all documents stay."""
    return secrets.redact(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take each document as often as the mix of sources says, from not at all to three times."""
    return mixing.apply_mix(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document that is left, what they decode to, their count and digests, with its language and source; a row for each time it is taken."""
    import public_tokenizers

    return pieces.encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), texts=True, keep=("lang", "source"))


STAGES = [
    ("language ID", known_languages),
    ("n-gram Jaccard join", one_of_each_group),
    ("secret scans", without_secrets),
    ("mixing", mixed),
    ("SentencePiece", encoded),
]

#: Trained models, compressed sizes and segmentation have no SQL form; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to documents."""
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = work.write(stage(spark, docs, sf_dir), f"stage{k}")
    return docs
