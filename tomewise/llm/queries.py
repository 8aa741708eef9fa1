"""Registered queries of this subpackage: each operator over its whole table, and DuckDB statements where SQL can tell."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tomewise.llm import bytecnn, crosspoly, divergence, dualtree, egojoin, golomb, jaccard, langid, linededup, lmscore, mixing, pieces, toxicity
from tomewise.llm.samples import held_out

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

#: Target weights of the sources in `documents`: 1 to 4 in turn.
SOURCE_WEIGHTS = {f"src{i}": 1.0 + i % 4 for i in range(20)}

#: Quality is predicted as 1 from this score.
GOOD_FROM = 0.7
#: A document is rejected from this probability of being toxic.
TOXIC_FROM = 0.5


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_ego_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of near-equal embeddings."""
    return egojoin.cosine_groups(table(spark, sf_dir, "embeddings"))


ORACLE["op1_ego_near_dedup"] = egojoin.cosine_sql()


@query
def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document as often as its source's weight asks for, shuffled."""
    return mixing.mix(table(spark, sf_dir, "documents"), SOURCE_WEIGHTS)


ORACLE["op2_mix_sources"] = mixing.mix_sql(SOURCE_WEIGHTS)


@query
def op3_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every whole text, learned from the labelled documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality")
    net = bytecnn.fit_quality(docs.where(~held_out("doc_id", 4)), labels, F.col("quality"))
    scored = bytecnn.score(docs, net)
    return scored.select(
        "doc_id", held_out("doc_id", 4).alias("held_out"), "score", (F.col("score") >= GOOD_FROM).cast("int").alias("predicted"))


@query
def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines before and after dropping those that an earlier document holds, and a digest of what stays."""
    kept = linededup.dedup_lines(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return kept.select("doc_id", "n_lines", "n_dropped", digest.alias("kept_sha256"))


ORACLE["op4_line_dedup"] = linededup.LINES_SQL


@query
def op5_gru_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every whole text under the recurrent model and under add-one counts."""
    docs = table(spark, sf_dir, "documents")
    scored = lmscore.lm_scores(docs, ~held_out("doc_id", 7))
    return scored.select(
        "doc_id", held_out("doc_id", 7).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@query
def op6_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows found for every embedding whose id is divisible by 20."""
    return crosspoly.nearest(table(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(20)) == 0)


@query
def op7_piece_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every whole text, and whether decoding them gives the text back."""
    coded = pieces.encode(table(spark, sf_dir, "documents"), check=True)
    return coded.select("doc_id", "ids", "n_tokens", "round_trip")


@query
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and class of near copies of every document."""
    return jaccard.jaccard_groups(table(spark, sf_dir, "documents"))


ORACLE["op8_ngram_jaccard"] = jaccard.JACCARD_SQL


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every whole text, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit_language_model(docs.where(~held_out("doc_id", 4)), F.col("lang"))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out("doc_id", 4).alias("held_out"), "lang_pred", "score")


def toxicity_chain(spark: SparkSession, sf_dir: str) -> toxicity.Chain:
    """The chain low quality, toxic, learned from the labelled documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality", "toxic")
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    categories = {"low_quality": (F.col("quality") == 0), "toxic": (F.col("toxic") == 1)}
    return toxicity.fit_chain(docs, labels, categories)


@query
def op10_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each category of the chain for every whole text, and whether it is rejected."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxicity_chain(spark, sf_dir))
    return scored.select("doc_id", "p_low_quality", "p_toxic", (F.col("p_toxic") >= TOXIC_FROM).cast("int").alias("toxic"))


@query
def op13_golomb_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of equal texts stays, for every document."""
    return golomb.exact_groups(table(spark, sf_dir, "documents"), scan=True)


ORACLE["op13_golomb_dedup"] = golomb.EXACT_SQL


@query
def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language, and the terms in which each stands out."""
    return divergence.divergence(table(spark, sf_dir, "documents"))


ORACLE["op12_source_divergence"] = divergence.DIVERGENCE_SQL


@query
def op11_dual_tree_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return dualtree.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLE["op11_dual_tree_search"] = dualtree.RANKED_SQL
