"""Reading profiles, category shares, prediction errors and other per-user summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

TOP_CATEGORIES = 5
MAX_LABELS = 1000


def star_profile(ratings: DataFrame, source_col: str = "source") -> DataFrame:
    """Histogram of ratings per source with the share of each value."""
    counts = ratings.groupBy(source_col, "rating").agg(F.count("*").alias("n"))
    share = F.col("n") / F.sum("n").over(Window.partitionBy(source_col))
    return counts.select(source_col, "rating", "n", share.alias("share"))


def books_per_user(ratings: DataFrame, source_col: str = "source") -> DataFrame:
    """Ratings, users and mean ratings per user for each source."""
    per_user = ratings.groupBy(source_col, "user_id").agg(F.count("*").alias("n"))
    return per_user.groupBy(source_col).agg(
        F.sum("n").alias("ratings"), F.count("*").alias("users"), F.avg("n").alias("books_per_user")
    )


def category_share(ratings: DataFrame, books: DataFrame) -> DataFrame:
    """Books read per theme and the part of that theme's catalogue they make up.

    ``ratings`` is distinct on (user, book), ``books`` on best_book_id. Books without a theme
    form a category of their own only in the candidate lists, not here.
    """
    labelled = books.where("k_label IS NOT NULL").select("best_book_id", "k_label")
    catalogue = labelled.groupBy("k_label").agg(F.count("*").alias("n_books"))
    read = (
        ratings.select("user_id", F.col("book_id").alias("best_book_id"))
        .join(labelled, "best_book_id").groupBy("user_id", "k_label").agg(F.count("*").alias("n_read"))
    )
    return read.join(catalogue, "k_label").select(
        "user_id", "k_label", "n_read", "n_books", (F.col("n_read") / F.col("n_books")).alias("share")
    )


def top_categories(shares: DataFrame, ratings: DataFrame, books: DataFrame, n: int = TOP_CATEGORIES) -> DataFrame:
    """The n themes of which a user has read the largest part, for every user with a rating.

    All themes of the catalogue take part, unread ones with share 0, so a user has n of them whenever
    the catalogue has. Ties, those among unread themes too, go to the smaller label. The labels are
    one small array (their number is checked), which is ranked inside each user's row.
    """
    rows = books.where("k_label IS NOT NULL").select("k_label").distinct().orderBy("k_label").limit(MAX_LABELS + 1).collect()
    if len(rows) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} themes")
    labels = F.array(*[F.lit(r[0]) for r in rows]).cast("array<int>")
    read = shares.groupBy("user_id").agg(
        F.map_from_entries(F.collect_list(F.struct(F.col("k_label").cast("int"), "share"))).alias("read")
    )
    users = ratings.select("user_id").distinct().join(read, "user_id", "left")

    def entry(label: Column) -> Column:
        share = F.coalesce(F.try_element_at("read", label), F.lit(0.0))
        return F.struct((-share).alias("order"), label.alias("k_label"))

    ranked = F.slice(F.array_sort(F.transform(labels, entry)), 1, n)
    return users.select("user_id", F.posexplode(ranked)).select(
        "user_id", "col.k_label", F.abs("col.order").alias("share"), (F.col("pos") + 1).alias("position")
    )


def with_top_slice(ratings: DataFrame, quantile: float = 0.95) -> DataFrame:
    """Rows with the flag ``is_top``: rating at or above the user's interpolated quantile.

    The quantile is an aggregate over counts of distinct ratings, combined before the shuffle; a
    window would gather all rows of a user in one task.
    """
    limits = ratings.groupBy("user_id").agg(F.percentile("rating", F.lit(quantile)).alias("limit"))
    return ratings.join(limits, "user_id").withColumn("is_top", F.col("rating") >= F.col("limit"))


def rmse_columns(actual: str = "rating", predicted: str = "prediction", top: str = "is_top") -> list[Column]:
    """Root mean squared error over all rows and over the flagged rows, in one pass."""
    squared = F.pow(F.col(actual) - F.col(predicted), F.lit(2.0))
    return [
        F.sqrt(F.avg(squared)).alias("rmse"),
        F.sqrt(F.avg(F.when(F.col(top), squared))).alias("rmse_top_5"),
    ]


def predict_book_mean(train: DataFrame, test: DataFrame) -> DataFrame:
    """Baseline predictor: a book's mean training rating, else the mean of all."""
    means = train.groupBy("book_id").agg(F.avg("rating").alias("book_mean"))
    overall = train.agg(F.avg("rating")).scalar()
    return (
        test.join(means, "book_id", "left")
        .select("user_id", "book_id", "rating", F.coalesce("book_mean", overall).alias("prediction"))
    )


def evaluate(predictions: DataFrame) -> DataFrame:
    """One row with rmse and rmse_top_5."""
    return with_top_slice(predictions).agg(*rmse_columns())
