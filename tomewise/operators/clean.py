"""Cleaning of catalogue tables and their serving joins."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from tomewise.functions.scalars import in_domain_or, upper_trim

# The accepted language codes and group values.
ENGLISH_CODES = ["eng", "en-US", "en-GB", "en-CA", "en"]
GROUP_DOMAINS = {
    "race": ["BLACK", "WHITE", "ASIAN", "LATINO", "NATIVE AMERICAN", "MIXED", "PACIFIC ISLANDER"],
    "gender": ["FEMALE", "MALE"],
}


def english_books(books: DataFrame, codes: Sequence[str] = ENGLISH_CODES) -> DataFrame:
    """Books whose language code is listed; case counts and null is dropped."""
    return books.where(F.col("language_code").isin(*codes))


def enrich_books(books: DataFrame, popularity: DataFrame) -> DataFrame:
    """Popularity columns added on best_book_id, null where unknown."""
    return books.join(popularity, "best_book_id", "left")


def majority_value(df: DataFrame, column: str, domain: Sequence[str]) -> DataFrame:
    """One row: the most frequent value of the domain, the alphabetically first on a tie."""
    return (
        df.where(F.col(column).isin(*domain))
        .groupBy(F.col(column).alias("value")).count()
        .agg(F.min_by("value", F.struct(-F.col("count"), F.col("value"))).alias("value"))
    )


def clean_authors(
    authors: DataFrame,
    domains: Mapping[str, Sequence[str]] = GROUP_DOMAINS,
    required: Sequence[str] = ("race",),
) -> DataFrame:
    """Normalised group columns of main authors.

    Rows without a required column are dropped; any other value outside its domain, null included,
    becomes the majority value of the whole author table.
    """
    tidy = authors.withColumns({name: upper_trim(name) for name in domains})
    for name in required:
        tidy = tidy.where(F.col(name).isNotNull())
    filled = {
        name: in_domain_or(name, domain, majority_value(tidy, name, domain).scalar())
        for name, domain in domains.items()
    }
    return tidy.withColumns(filled).where("main_author")


def clean_isbn_map(isbn_map: DataFrame) -> DataFrame:
    """Numeric best_book_id, entries without one dropped, one row per isbn (the largest id)."""
    best = F.expr("coalesce(try_cast(best_book_id AS BIGINT), cast(try_cast(best_book_id AS DOUBLE) AS BIGINT))")
    return (
        isbn_map.select("isbn", best.alias("best_book_id")).where("best_book_id IS NOT NULL")
        .groupBy("isbn").agg(F.max("best_book_id").alias("best_book_id"))
    )


def limit_isbn_map(isbn_map: DataFrame, books: DataFrame) -> DataFrame:
    """Map entries that lead to one of our books."""
    return isbn_map.join(books.select("best_book_id"), "best_book_id", "left_semi").select("isbn", "best_book_id")


def label_books(books: DataFrame, themes: DataFrame) -> DataFrame:
    """Theme label added to each book, null where unlabelled."""
    return books.join(themes.withColumnRenamed("book_id", "best_book_id"), "best_book_id", "left")


def classify_books(
    books: DataFrame, book_authors: DataFrame, authors: DataFrame, themes: DataFrame | None = None
) -> DataFrame:
    """One row per (book, author) with group columns; books without known authors drop out.

    With ``themes`` the label comes from that table, otherwise from the books themselves.
    """
    bridge = book_authors.select(F.col("book_id").alias("best_book_id"), "author_id").distinct()
    written = bridge.join(authors, "author_id")
    if themes is not None:
        written = label_books(written, themes)
    return books.join(written, "best_book_id")
