"""CSV, JSON-lines and XML readers, and the table and CSV writers."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

BOOK_DETAIL_SCHEMA = (
    "book_id LONG, title STRING, title_without_series STRING, isbn STRING, isbn13 STRING, "
    "asin STRING, country_code STRING, language_code STRING, description STRING, work_id LONG, "
    "best_book_id LONG, original_title STRING"
)
BOOK_POPULARITY_SCHEMA = (
    "book_id LONG, best_book_id LONG, ratings_count LONG, work_ratings_count LONG, "
    "work_text_reviews_count LONG, ratings_1 LONG, ratings_2 LONG, ratings_3 LONG, "
    "ratings_4 LONG, ratings_5 LONG, image_url STRING, small_image_url STRING"
)
AUTHOR_SCHEMA = (
    "author_id LONG, name STRING, main_author BOOLEAN, race STRING, gender STRING, "
    "image_url STRING, about STRING, influences STRING, works_count LONG, hometown STRING, "
    "born_at STRING, died_at STRING"
)
BOOK_AUTHOR_SCHEMA = "book_id LONG, author_id LONG, name STRING, role STRING"
RATING_SCHEMA = "book_id LONG, user_id LONG, rating INT"
THEME_SCHEMA = "k_label INT, book_id LONG"
ISBN_MAP_SCHEMA = "isbn STRING, best_book_id STRING"
LIMITED_REVIEW_SCHEMA = "best_book_id LONG, asin STRING, summary STRING, review_text STRING"
LIMITED_RATING_SCHEMA = (
    "book_id LONG, asin STRING, user_id STRING, helpful STRING, rating DOUBLE, unix_review_time LONG"
)
REVIEW_JSON_SCHEMA = (
    "asin STRING, reviewerID STRING, helpful ARRAY<INT>, overall DOUBLE, summary STRING, "
    "reviewText STRING, unixReviewTime LONG"
)
# Work ids carry a type attribute, so their text sits in _VALUE.
BOOK_XML_SCHEMA = """
    id LONG, title STRING, title_without_series STRING, isbn STRING, isbn13 STRING, asin STRING,
    country_code STRING, language_code STRING, description STRING,
    work STRUCT<id: STRUCT<_VALUE: LONG>, best_book_id: STRUCT<_VALUE: LONG>, original_title: STRING>,
    authors STRUCT<author: ARRAY<STRUCT<id: LONG, name: STRING, role: STRING>>>,
    _corrupt_record STRING
"""
SHELF_XML_SCHEMA = """
    book STRUCT<id: STRUCT<_VALUE: STRING>, isbn: STRING>, rating INT, _corrupt_record STRING
"""
SHELF_PAGE_SCHEMA = """
    review ARRAY<STRUCT<book: STRUCT<id: STRUCT<_VALUE: STRING>, isbn: STRING>, rating: INT>>, _corrupt_record STRING
"""


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: str,
    header: bool = True,
    columns: Sequence[str] | None = None,
    multi_line: bool = False,
) -> DataFrame:
    """CSV scan with a declared schema and doubled quotes inside quoted values.

    With a header the columns are matched by name, so files may hold more columns, in any order that
    all of them share; files whose headers differ under one path are an error, never misread.
    Pass ``columns`` to read a subset only. Values with line breaks need ``multi_line``, which reads
    each file in one task, so leave it off for the others.
    """
    reader = (
        spark.read.option("header", header)
        .option("multiLine", multi_line)
        .option("quote", '"')
        .option("escape", '"')
    )
    if not header:
        frame = reader.schema(schema).csv(path)
        return frame.select(*columns) if columns else frame
    wanted = spark.createDataFrame([], schema).schema
    names = list(columns) if columns else wanted.fieldNames()
    # The header of the first file names the columns; with enforceSchema off every other header is compared with it.
    raw = reader.option("enforceSchema", False).schema(reader.csv(path).schema).csv(path)
    return raw.select(*[F.expr(f"try_cast(`{n}` AS {wanted[n].dataType.simpleString()})").alias(n) for n in names])


def _parsed_once(rows: DataFrame, name: str, parsed: Column) -> DataFrame:
    """Rows with a parsed column. As the output of a generator it is made once for each row; a plain column would be
    parsed again by every filter on it, as filters move below the columns that they read."""
    return rows.select("*", F.explode(F.array(parsed)).alias(name))


def parse_reviews(lines: DataFrame, line_col: str = "line") -> DataFrame:
    """JSON lines with a struct ``review``, null where the line is no well-formed review; the line is kept.

    A line that cannot be parsed, or is no object, is not dropped and does not become a row of nulls.
    """
    schema = f"{REVIEW_JSON_SCHEMA}, _corrupt_record STRING"
    parsed = F.from_json(line_col, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"})
    good = F.col("review._corrupt_record").isNull() & F.trim(line_col).startswith("{")
    return _parsed_once(lines, "review", parsed).withColumn("review", F.when(good, F.col("review")))


def review_errors(parsed: DataFrame, *keys: str, line_col: str = "line") -> DataFrame:
    """The lines of `parse_reviews` that hold no review, blank ones aside."""
    return parsed.where(F.col("review").isNull() & (F.trim(line_col) != "")).select(*keys, line_col)


def read_review_lines(spark: SparkSession, path: str | Sequence[str], partitions: int | None = None) -> DataFrame:
    """Lines of (gzip) JSON files with their global order, parsed: file, place, line, review.

    A gzip file cannot be split, so its rows are spread after reading. `file` (path and start of the stretch that a task
    reads) and `place` are made before that: ordered by both, rows stand as in the files, files by path.
    """
    lines = spark.read.text(path).select(
        F.format_string("%s %020d", "_metadata.file_path", "_metadata.file_block_start").alias("file"),
        F.monotonically_increasing_id().alias("place"), F.col("value").alias("line"),
    )
    return parse_reviews(lines.repartition(partitions) if partitions else lines.hint("rebalance"))


def read_reviews_json(spark: SparkSession, path: str | Sequence[str], partitions: int | None = None) -> DataFrame:
    """The well-formed reviews of JSON-lines files with their global order (file, place)."""
    return read_review_lines(spark, path, partitions).where("review IS NOT NULL").select("file", "place", F.col("review").dropFields("_corrupt_record").alias("review")).select("file", "place", "review.*")


def read_review_json_errors(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """The malformed lines of JSON-lines files: file_name, line."""
    found = review_errors(read_review_lines(spark, path), "file", "place")
    return found.select(F.element_at(F.split(F.element_at(F.split("file", "/"), -1), " "), 1).alias("file_name"), "line")


def read_pages(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.xml") -> DataFrame:
    """Saved XML pages, a row each: file_path, file_name, page."""
    pages = spark.read.option("pathGlobFilter", pattern).text(path, wholetext=True)
    return pages.select(F.col("_metadata.file_path").alias("file_path"), F.col("_metadata.file_name").alias("file_name"), F.col("value").alias("page"))


def _with_element(pages: DataFrame, page_col: str, element: str, schema: str, name: str) -> DataFrame:
    """Pages with an element of theirs as a struct, null where it is missing or malformed."""
    inner = F.regexp_extract(page_col, f"(?s)<{element}[ >].*</{element}>", 0)
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = _parsed_once(pages.withColumn("_inner", inner), name, F.from_xml("_inner", schema, options))
    good = (F.col("_inner") != "") & F.col(f"{name}._corrupt_record").isNull()
    return parsed.withColumn(name, F.when(good, F.col(name))).drop("_inner")


def parse_book_pages(pages: DataFrame, page_col: str = "page") -> DataFrame:
    """Pages with a struct ``book``: parsed once, null where the page holds no well-formed book with an id."""
    parsed = _with_element(pages, page_col, "book", BOOK_XML_SCHEMA, "book")
    return parsed.withColumn("book", F.when(F.col("book.id").isNotNull(), F.col("book")))


def flat_books(parsed: DataFrame) -> DataFrame:
    """One flat row per book of `parse_book_pages`; elements that are missing become null."""
    return parsed.where("book IS NOT NULL").select("book.*").select(
        F.col("id").alias("book_id"), "title", "title_without_series", "isbn", "isbn13", "asin",
        "country_code", "language_code", "description", F.col("work.id._VALUE").alias("work_id"),
        F.col("work.best_book_id._VALUE").alias("best_book_id"), F.col("work.original_title").alias("original_title"),
    )


def book_author_rows(parsed: DataFrame) -> DataFrame:
    """One row per author of a book of `parse_book_pages`; a book without authors yields none."""
    return parsed.where("book IS NOT NULL").select(F.col("book.id").alias("book_id"), F.explode("book.authors.author").alias("author")).select(
        "book_id", F.col("author.id").alias("author_id"), F.col("author.name").alias("name"), F.col("author.role").alias("role"))


def page_errors(parsed: DataFrame, name_col: str = "file_name") -> DataFrame:
    """Names of the pages without a well-formed book: malformed, truncated or without one."""
    return parsed.where("book IS NULL").select(F.col(name_col).alias("file_name"))


def shelf_rows(pages: DataFrame, user_col: str = "user_id", page_col: str = "page") -> DataFrame:
    """user_id, book_id, isbn, rating of every review of every well-formed shelf page; an empty isbn is null."""
    parsed = _with_element(pages.select(F.col(user_col).alias("user_id"), page_col), page_col, "reviews", SHELF_PAGE_SCHEMA, "_reviews")
    return parsed.select("user_id", F.explode("_reviews.review").alias("r")).select(
        "user_id", F.col("r.book.id._VALUE").alias("book_id"), F.nullif("r.book.isbn", F.lit("")).alias("isbn"), "r.rating")


def _book_xml(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    return (
        spark.read.format("xml")
        .option("rowTag", "book")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .schema(BOOK_XML_SCHEMA)
        .load(path)
    )


def read_book_xml(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One flat row per book; elements that are missing become null."""
    return (
        _book_xml(spark, path)
        .where(F.col("_corrupt_record").isNull())
        .select(
            F.col("id").alias("book_id"), "title", "title_without_series", "isbn", "isbn13", "asin",
            "country_code", "language_code", "description",
            F.col("work.id._VALUE").alias("work_id"),
            F.col("work.best_book_id._VALUE").alias("best_book_id"),
            F.col("work.original_title").alias("original_title"),
        )
    )


def read_book_authors_xml(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One row per author of a book; a book without authors yields none."""
    return (
        _book_xml(spark, path)
        .where(F.col("_corrupt_record").isNull())
        .select(F.col("id").alias("book_id"), F.explode("authors.author").alias("author"))
        .select(
            "book_id", F.col("author.id").alias("author_id"),
            F.col("author.name").alias("name"), F.col("author.role").alias("role"),
        )
    )


def read_book_xml_errors(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.xml") -> DataFrame:
    """Names of the files that yield no well-formed book: malformed, truncated or without a book."""
    def plain(path_column: str):
        return F.regexp_replace(path_column, "^[a-z0-9]+:/+", "/")

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select(plain("path").alias("file"))
    good = (
        _book_xml(spark, path).where(F.col("_corrupt_record").isNull() & F.col("id").isNotNull())
        .select(plain("_metadata.file_path").alias("file")).distinct()
    )
    return files.join(good, "file", "left_anti").select(F.element_at(F.split("file", "/"), -1).alias("file_name"))


def read_shelf_xml(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Shelf rows from saved pages stored as <user id>/<page>.xml; all pages of a user are read."""
    return (
        spark.read.format("xml")
        .option("rowTag", "review")
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt_record")
        .schema(SHELF_XML_SCHEMA)
        .load(path)
        .select("*", F.col("_metadata.file_path").alias("_path"))
        .where(F.col("_corrupt_record").isNull())
        .select(
            F.element_at(F.split("_path", "/"), -2).cast("bigint").alias("user_id"),
            F.col("book.id._VALUE").alias("book_id"),
            F.nullif(F.col("book.isbn"), F.lit("")).alias("isbn"),
            "rating",
        )
    )


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """Parquet table; an existing one is an error, never replaced."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str, header: bool = True) -> None:
    """CSV in the dialect read_csv reads; null and empty text stay apart."""
    (
        df.write.mode("errorifexists").option("header", header)
        .option("quote", '"').option("escape", '"').option("emptyValue", '""').csv(path)
    )


def read_table(spark: SparkSession, name: str, base: str | None = None) -> DataFrame:
    """Named table: a Parquet folder under ``base``, else a catalogue table."""
    return spark.read.parquet(f"{base}/{name}") if base else spark.table(name)
