"""The corpus pipeline: documents are filtered, deduplicated, pseudonymised, mixed and encoded.

Each stage works on all that the one before it kept. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm import common, langid, mixing, nearjoin, pieces, pii
from gridloom.llm.queries import PIECE_MODEL

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A text of which less than half of the letters' n-grams belong to its language is rejected.
LEAST_SCORE = 0.5
PII_KEY = "corpus-key-1"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter and of no known language; lang becomes the language found.

    Labels teach the model as in the query; without any label, no text can be judged and all stay."""
    model = langid.fit(docs.where(~langid.held_out()))
    if not model.languages:
        return docs.select(*COLUMNS)
    found = langid.identify(docs.select(*COLUMNS), model)
    kept = found.where((F.col("lang_pred") != langid.UNDECIDED) & (F.col("score") >= LEAST_SCORE))
    return kept.withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates stays, that of the smallest doc_id."""
    return nearjoin.keep_first(docs.select(*COLUMNS))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data become pseudonyms; n_chars is that of the new text."""
    done = pii.pseudonymise(docs.select(*COLUMNS), PII_KEY)
    return done.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.apply(docs.select(*COLUMNS))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_pieces and piece_ids of each copy."""
    encoded = pieces.encode(docs.select("doc_id", "text", "lang", "source"), pieces.load(PIECE_MODEL))
    return encoded.select("doc_id", "lang", "source", F.size("piece_ids").cast("long").alias("n_pieces"), "piece_ids")


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_duplicates),
    ("PII", replace_personal_data),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode_pieces),
]

#: Several stages can't be expressed in SQL; tests hold all five against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = common.written(docs, f"stage_{i + 1}")
    return docs
