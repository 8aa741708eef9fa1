"""Jobs between files and tables: conversion, limiting, serving tables and themes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F

from tomewise.functions.tables import stored
from tomewise.operators import clean, resolve, themes
from tomewise.sources import files

# Columns of the input files.
BOOK_COLUMNS = [
    "book_id", "title", "isbn", "isbn13", "country_code", "language_code", "description", "work_id",
    "best_book_id", "original_title",
]
POPULARITY_COLUMNS = [
    "best_book_id", "ratings_count", "work_ratings_count", "work_text_reviews_count", "ratings_1",
    "ratings_2", "ratings_3", "ratings_4", "ratings_5", "image_url", "small_image_url",
]


def build_tables(
    spark: SparkSession, out: str, books_csv: str, popularity_csv: str, authors_csv: str,
    book_authors_csv: str, isbn_map_csv: str, themes_csv: str,
) -> None:
    """Clean the five source files into tables books, authors, book_authors, isbn_book_id, kmeans."""
    detail = files.read_csv(spark, books_csv, files.BOOK_DETAIL_SCHEMA, columns=BOOK_COLUMNS, multi_line=True)
    popularity = files.read_csv(spark, popularity_csv, files.BOOK_POPULARITY_SCHEMA, columns=POPULARITY_COLUMNS)
    tables = {
        "books": clean.enrich_books(clean.english_books(detail), popularity.dropDuplicates(["best_book_id"])),
        "authors": clean.clean_authors(files.read_csv(spark, authors_csv, files.AUTHOR_SCHEMA, multi_line=True)),
        "book_authors": files.read_csv(spark, book_authors_csv, files.BOOK_AUTHOR_SCHEMA),
        "isbn_book_id": clean.clean_isbn_map(files.read_csv(spark, isbn_map_csv, files.ISBN_MAP_SCHEMA, header=False)),
        "kmeans": files.read_csv(spark, themes_csv, files.THEME_SCHEMA),
    }
    for name, table in tables.items():
        files.write_table(table, f"{out}/{name}")


def convert_book_xml(spark: SparkSession, xml_path: str, out: str) -> None:
    """Saved book pages to the CSV folders updated_books, author_books and errors. Each page is parsed once."""
    parsed = stored(files.parse_book_pages(files.read_pages(spark, xml_path)).select("file_name", "book"), "book-pages")
    files.write_csv(files.flat_books(parsed), f"{out}/updated_books")
    files.write_csv(files.book_author_rows(parsed), f"{out}/author_books")
    files.write_csv(files.page_errors(parsed), f"{out}/errors")


def limit_reviews(spark: SparkSession, reviews_json: str, isbn_map: DataFrame, out: str) -> None:
    """Raw reviews of known books to the headerless CSV folders limited_reviews and limited_ratings.

    Rows stand in the order of the review files: their (file, place) goes through the join, and the part files hold
    ranges of it. Lines that are no reviews go to the folder review_errors.
    """
    parsed = stored(files.read_review_lines(spark, reviews_json), "review-lines")
    reviews = parsed.where("review IS NOT NULL").select("file", "place", "review.*").drop("_corrupt_record")
    order = ["file", "place"]
    rows = resolve.limited_reviews(reviews, isbn_map, order).orderBy(*order).drop(*order)
    files.write_csv(rows, f"{out}/limited_reviews", header=False)
    ratings = resolve.limited_review_ratings(reviews, isbn_map, order).orderBy(*order).drop(*order).withColumn(
        "helpful", F.concat(F.lit("["), F.concat_ws(", ", F.col("helpful").cast("array<string>")), F.lit("]"))
    )
    files.write_csv(ratings, f"{out}/limited_ratings", header=False)
    errors = files.review_errors(parsed, *order).orderBy(*order).select("line")
    files.write_csv(errors, f"{out}/review_errors", header=False)


def load_ratings(spark: SparkSession, ratings_csv: str, books_csv: str | None = None) -> DataFrame:
    """Ratings file, with local book ids translated when the book file is given."""
    ratings = files.read_csv(spark, ratings_csv, files.RATING_SCHEMA).select("user_id", "book_id", "rating")
    if books_csv is None:
        return ratings
    ids = files.read_csv(spark, books_csv, files.BOOK_POPULARITY_SCHEMA, columns=["book_id", "best_book_id"])
    return resolve.translate_ids(ratings, ids)


def load_review_ratings(spark: SparkSession, path: str) -> DataFrame:
    """user_id, book_id, rating of the limited review ratings."""
    rows = files.read_csv(spark, path, files.LIMITED_RATING_SCHEMA, header=False)
    return rows.select("user_id", "book_id", "rating")


def load_limited_reviews(spark: SparkSession, path: str) -> DataFrame:
    """Limited reviews with a review_id in file order: files by name, rows by place in their file.

    The place of the file's name among all names takes the bits from 33 up, the row's place in its
    task the lower ones: a file is read by one task, as texts hold line breaks, so rows of a file
    keep their order whichever files its task reads before.
    """
    rows = files.read_csv(spark, path, files.LIMITED_REVIEW_SCHEMA, header=False, multi_line=True)
    names = spark.createDataFrame(list(enumerate(sorted(rows.inputFiles()))), "place long, file string")
    placed = rows.select("*", F.input_file_name().alias("file"), F.monotonically_increasing_id().alias("_row"))
    number = F.shiftleft("place", 33).bitwiseOR(F.col("_row").bitwiseAND(F.lit((1 << 33) - 1)))
    return placed.join(names, "file").withColumn("review_id", number).drop("file", "place", "_row")


def build_themes(
    reviews: DataFrame, out: str, ks: Sequence[int] = (13, 10), max_features: int = themes.MAX_FEATURES,
    n_terms: int = 15, lemmas: DataFrame | None = None,
) -> None:
    """Theme labels and centroid words for each number of clusters, as tables with a column k."""
    spark = reviews.sparkSession
    vectors, words = themes.theme_vectors(reviews, max_features, lemmas=lemmas)
    for k in ks:
        model, labels = themes.cluster(vectors, k)
        files.write_table(labels, f"{out}/theme_labels/k={k}")
        files.write_table(themes.cluster_terms(model, words, n_terms, spark), f"{out}/theme_terms/k={k}")
    vectors.unpersist()
