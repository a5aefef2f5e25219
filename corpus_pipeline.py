"""The corpus pipeline: language ID, near-duplicate removal, decontamination, pseudonyms, SentencePiece ids.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All but
the last return the columns of documents, whatever further ones there are. Rows with a null doc_id or text belong to no class of near
copies and stay; a null text ends as one without tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazmill.llm import decontam, langid, neardup, piece, pii
from hazmill.llm.common import free, stored, table
from hazmill.llm.queries import pseudonym_key, tokenizer

#: Documents of which a smaller share of trigrams belongs to the best language are in no learnt language.
MIN_SCORE = 0.2


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without letters or in no learnt language."""
    model = langid.fit(docs.filter(~langid.held_out()))
    lang, score = free("lang_pred", docs.columns), free("score", docs.columns)
    return langid.predict(docs, model, docs.columns, names=(lang, score)).filter((F.col(lang) != langid.UNKNOWN) & (F.col(score) >= MIN_SCORE)).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the least id of each class; rows are told apart by id and text."""
    return neardup.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark item. Rows are named by id and text, since an id may be given to several texts."""
    row = free("row_id", docs.columns)
    named = docs.withColumn(row, F.xxhash64("doc_id", "text"))
    leaks = decontam.find_leaks(named, table(spark, sf_dir, "benchmark"), key=row).select(F.col("doc_id").alias(row)).distinct()
    return named.join(leaks, row, "left_anti").select(*docs.columns)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace personal data; n_chars follows the new text."""
    keep = [c for c in docs.columns if c != "text"]
    names = ("text", free("n_pii", keep), free("finds", keep))
    got = pii.pseudonymise(docs, pseudonym_key(spark), keep, names=names)
    return got.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source and the token ids with their digests."""
    return piece.encode_texts(docs, tokenizer("piece_bpe_32k.model"), ["doc_id", "lang", "source"]).drop("decoded")


STAGES = [
    ("language_id", keep_known_languages),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("personal_data", hide_personal_data),
    ("sentencepiece", encode_pieces),
]

#: Sampling, singular vectors and keyed permutations can't be written in SQL; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
