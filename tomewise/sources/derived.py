"""Input tables of the engine derived from the supplied Parquet tables.

Orders stand for reading: customer = user, part = book, supplier = author, quantity = rating.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tomewise.functions.scalars import upper_trim
from tomewise.functions.skew import spread

FOREIGN_EDITION_OFFSET = 10_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ratings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """user_id, book_id, rating 1-5; one row per (user, book)."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return (
        lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
        .groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("book_id"))
        .agg(F.ceil(F.avg("l_quantity") / 10).cast("int").alias("rating"))
    )


def isbn_of(book_id: str):
    return F.lpad(F.col(book_id).cast("string"), 10, "0")


def books_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Book details before cleaning, all languages."""
    languages = ["eng", "en-US", "en-GB", "en-CA", "en", "fre", "spa"]
    language = F.get(F.array(*[F.lit(v) for v in languages]), F.pmod(F.col("p_size"), F.lit(8)))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("book_id"),
        F.col("p_name").alias("title"),
        isbn_of("p_partkey").alias("isbn"),
        language.alias("language_code"),
        F.col("p_partkey").alias("best_book_id"),
    )


def themes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Theme label per book; books of size 50 have none."""
    return (
        table(spark, sf_dir, "part").where("p_size <> 50")
        .select((F.col("p_partkey") % 13).cast("int").alias("k_label"), F.col("p_partkey").alias("book_id"))
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """best_book_id, title, k_label."""
    label = F.when(F.col("p_size") != 50, (F.col("p_partkey") % 13).cast("int"))
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("best_book_id"), F.col("p_name").alias("title"), label.alias("k_label")
    )


def book_popularity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rating counts of the books with at least 25 ratings."""
    stars = [F.count_if(F.col("rating") == s).alias(f"ratings_{s}") for s in range(1, 6)]
    return (
        ratings(spark, sf_dir).groupBy(F.col("book_id").alias("best_book_id"))
        .agg(F.count("*").alias("ratings_count"), *stars)
        .where("ratings_count >= 25")
    )


def _author_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    region = table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return (
        table(spark, sf_dir, "supplier")
        .join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
        .join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    )


def authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """author_id, name, race, gender, already clean."""
    return _author_places(spark, sf_dir).select(
        F.col("s_suppkey").alias("author_id"), F.col("s_name").alias("name"),
        upper_trim("r_name").alias("race"),
        F.when(F.col("s_suppkey") % 3 == 0, "FEMALE").otherwise("MALE").alias("gender"),
    )


def authors_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Authors as they arrive: nulls, stray blanks, mixed case and unknown values."""
    key = F.col("s_suppkey")
    race = (
        F.when(key % 10 == 0, F.lit(None))
        .when(key % 10 == 1, F.concat(F.lit("  "), F.lower("r_name"), F.lit(" ")))
        .when(key % 10 == 2, F.lit("unknown"))
        .otherwise(F.col("r_name"))
    )
    gender = (
        F.when(key % 7 == 0, F.lit(None))
        .when(key % 3 == 0, F.lit("female "))
        .otherwise(F.lit("Male"))
    )
    return _author_places(spark, sf_dir).select(
        key.alias("author_id"), F.col("s_name").alias("name"), (key % 5 != 0).alias("main_author"),
        race.alias("race"), gender.alias("gender"),
    )


RACE_DOMAIN = ["AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST"]
GENDER_DOMAIN = ["FEMALE", "MALE"]


def book_authors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """book_id, author_id, role; books of size 12 or less may have a second author."""
    n_authors = table(spark, sf_dir, "supplier").agg(F.count("*")).scalar()
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_size")
    key = F.col("p_partkey")
    second = F.struct(((key * 7 + 3) % n_authors).alias("author_id"), F.lit("Co-author").alias("role"))
    first = F.struct((key % n_authors).alias("author_id"), F.lit(None).cast("string").alias("role"))
    writers = F.when(
        (F.col("p_size") <= 12) & (first["author_id"] != second["author_id"]), F.array(first, second)
    ).otherwise(F.array(first))
    return parts.select(key.alias("book_id"), F.explode(writers).alias("w")).select("book_id", "w.author_id", "w.role")


def item_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, features as doubles."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("features")
    )


def isbn_map_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """isbn, best_book_id as text; ids of size 17 are missing, books of size 3 are not listed."""
    return table(spark, sf_dir, "part").where("p_size <> 3").select(
        isbn_of("p_partkey").alias("isbn"),
        F.when(F.col("p_size") != 17, F.col("p_partkey").cast("string")).alias("best_book_id"),
    )


def kaggle_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dataset-local book_id to best_book_id; books of size 23 are not listed."""
    return table(spark, sf_dir, "part").where("p_size <> 23").select(
        (F.col("p_partkey") * 3 + 1).alias("book_id"), F.col("p_partkey").alias("best_book_id")
    )


def ratings_local(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ratings keyed by the dataset-local book id."""
    return ratings(spark, sf_dir).select("user_id", (F.col("book_id") * 3 + 1).alias("book_id"), "rating")


def shelf_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shelves as they arrive: text ids, foreign editions, missing isbns, unrated (0) rows."""
    mix = F.col("user_id") + F.col("book_id")
    return ratings(spark, sf_dir).select(
        "user_id",
        F.when(mix % 5 == 0, F.col("book_id") + FOREIGN_EDITION_OFFSET).otherwise(F.col("book_id"))
        .cast("string").alias("book_id"),
        F.when(mix % 7 != 0, isbn_of("book_id")).alias("isbn"),
        F.when(mix % 11 == 0, 0).otherwise(F.col("rating")).alias("rating"),
    )


def reviews_raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reviews plus review_id, their order of arrival; ten consecutive documents share a book."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("review_id"),
        F.lpad(F.expr("doc_id div 10").cast("string"), 10, "0").alias("asin"),
        F.col("source").alias("reviewerID"),
        F.array((F.col("n_chars") % 5).cast("int"), F.lit(5)).alias("helpful"),
        (F.col("doc_id") % 5 + 1).cast("double").alias("overall"),
        F.concat_ws(" ", "lang", "source").alias("summary"),
        F.nullif(F.trim("text"), F.lit("")).alias("reviewText"),
        (F.col("doc_id") * 86400 + 1300000000).alias("unixReviewTime"),
    )


def _element(name: str, value, attributes: str = ""):
    """An XML element, or nothing where the value is null. The text holds no markup, or is escaped already."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.lit(f"<{name}{attributes}>"), text, F.lit(f"</{name}>")), F.lit(""))


def book_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved book pages: file_name, page. Books of size 7 have no work, every 11th page is cut off, every 17th malformed."""
    role = _element("role", F.col("role"))
    writers = book_authors(spark, sf_dir).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct(
        "author_id", F.concat(F.lit("<author>"), _element("id", F.col("author_id")), _element("name", F.concat(F.lit("N "), F.col("author_id").cast("string"))),
                              role, F.lit("</author>")).alias("xml")))).alias("w"))
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_size", "p_brand")
    key, typed = F.col("p_partkey"), ' type="integer"'
    title = F.concat("p_name", F.lit(" &amp; &lt;"), "p_brand", F.lit("&gt;"))
    work = F.concat(F.lit("<work>"), _element("id", key + 5000, typed), _element("best_book_id", key, typed), _element("original_title", F.col("p_name")), F.lit("</work>"))
    page = F.concat(
        F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<Response><Request><key>k</key></Request><book>'), _element("id", key), _element("title", title),
        _element("isbn", isbn_of("p_partkey")), F.when(F.col("p_size") != 7, work).otherwise(""),
        F.lit("<authors>"), F.concat_ws("", "w.xml"), F.lit("</authors><similar_books><book><id>1</id><title>Other</title></book></similar_books></book></Response>"))
    whole = spread(parts.join(writers, key == F.col("book_id")).select("p_partkey", page.alias("page")), "p_partkey")
    cut = F.when(key % 11 == 0, F.left("page", F.lit(200))).when(key % 17 == 0, F.replace("page", F.lit("</isbn>"), F.lit(""))).otherwise(F.col("page"))
    return whole.select(F.concat(key.cast("string"), F.lit(".xml")).alias("file_name"), cut.alias("page"))


def shelf_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Saved shelf pages: user_id, page_no, page; the second page of every 9th user is cut off."""
    review = F.concat(
        F.lit("<review><id>9</id><book>"), _element("id", F.col("book_id"), ' type="integer"'), F.coalesce(_element("isbn", F.col("isbn")), F.lit("<isbn/>")),
        F.lit("</book>"), _element("rating", F.col("rating")), F.lit("</review>"))
    number = (F.try_to_number("book_id", F.lit("99999999")) % 3).cast("int")
    pages = shelf_raw(spark, sf_dir).groupBy("user_id", number.alias("page_no")).agg(F.concat_ws("\n", F.collect_list(review)).alias("rows"))
    page = F.concat(F.lit('<Response><reviews start="1" end="200">'), "rows", F.lit("</reviews></Response>"))
    cut = (F.col("user_id") % 9 == 0) & (F.col("page_no") == 1)
    return pages.select("user_id", "page_no", F.when(cut, F.left(page, F.length(page) - 20)).otherwise(page).alias("page"))


def review_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw reviews as JSON lines: review_id, line; every 13th is cut off, every 29th no object."""
    fields = ["asin", "reviewerID", "helpful", "overall", "summary", "reviewText", "unixReviewTime"]
    line, key = F.to_json(F.struct(*fields)), F.col("review_id")
    bad = F.when(key % 13 == 0, F.left(line, F.lit(30))).when(key % 29 == 0, F.lit("[1, 2]")).otherwise(line)
    return reviews_raw(spark, sf_dir).select("review_id", bad.alias("line"))
