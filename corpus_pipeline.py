"""The corpus pipeline: documents in, token ids out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tomewise.llm import jaccard, linededup, mixing, pieces, toxicity
from tomewise.llm.queries import SOURCE_WEIGHTS, TOXIC_FROM, table, toxicity_chain

#: What every stage but the last returns.
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the chain rejects go; the chain is learned from the labels in `sf_dir`.

    Every row is judged by its text alone: null ids and repeated rows change nothing, a null text counts as empty.
    """
    scored = toxicity.score(docs, toxicity_chain(spark, sf_dir))
    return scored.where(F.col("p_toxic") < TOXIC_FROM).select(*COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines stay only in the first document that holds them; n_chars follows the text.

    Rows without an id keep all their lines; rows that repeat an id are one document and keep the same lines. A null
    text stays null, with n_chars null.
    """
    return linededup.dedup_lines(docs).selectExpr("doc_id", "text", "lang", "source", "CAST(length(text) AS BIGINT) AS n_chars")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated to the target weights of their sources, in shuffled order.

    Rows of one id share a draw; null ids draw as the text "null". A source without any text keeps each document once.
    """
    return mixing.mix(docs.select(*COLUMNS), SOURCE_WEIGHTS).drop("copy_number")


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every text; decoding gives the text back."""
    return pieces.encode(docs, check=True).select("doc_id", "lang", "source", "ids", "n_tokens", "round_trip")


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies the document with the smallest id stays.

    Rows without an id cannot be told apart by one and pass through unchanged. Rows that are repeated as a whole are
    kept once. Rows of one id with different texts are one document to the join, and stay or go together.
    """
    first = jaccard.jaccard_groups(docs).where("doc_id = component_id").select("doc_id")
    kept = docs.join(first.hint("shuffle_hash"), "doc_id", "left_semi").select(*COLUMNS)
    # The rows of an id are in one partition already.
    return kept.dropDuplicates(COLUMNS).union(docs.where("doc_id IS NULL").select(*COLUMNS))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("near duplicates", keep_one_of_each),
    ("source mixing", mix_sources),
    ("piece encoding", encode_pieces),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every stage in turn over `documents`, each written to the shared folder for the next."""
    from tomewise.llm.tables import stored

    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = stored(docs, name.replace(" ", "-"))
    return docs


ORACLE_SQL = None
