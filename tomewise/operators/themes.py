"""Book themes from review text: tokens, TF-IDF, k-means and their descriptions.

Word counts are summed per (book, word) from the single reviews; the text of a book is never put
together for them, so a book with very many reviews needs no large row.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import StorageLevel
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tomewise.functions.text import STOP_WORDS, keep_word, singular_forms, split_words

MAX_FEATURES = 1000
CLUSTERS = 13
SEED = 72
#: Starts of k-means, passes at most, and the movement of a centre below which a start rests.
STARTS = 10
MAX_ITER = 20
TOLERANCE = 1e-4
#: Vectors from which the first centres are drawn; vectors measured at once.
START_SAMPLE = 4096
ROWS_PER_STEP = 2048
#: A part of a book's text holds the reviews of a range of 2**12 review ids.
PART_BITS = 12


def reviews_by_book(reviews: DataFrame, order_col: str = "review_id", part_bits: int = PART_BITS) -> DataFrame:
    """Review text of each book joined by blanks in order of arrival, null texts skipped, in parts.

    A part is the text of the book's reviews in one range of 2**part_bits review ids, numbered by
    that range, so the parts are the same whatever the size of the data and one row stays bounded.
    """
    text = F.expr("listagg(review_text, ' ') WITHIN GROUP (ORDER BY _order)")
    return (
        reviews.where("review_text IS NOT NULL")
        .select(
            "best_book_id", F.shiftright(F.col(order_col).cast("bigint"), part_bits).alias("part"), "review_text",
            F.col(order_col).alias("_order"),
        )
        .groupBy("best_book_id", "part").agg(text.alias("review_text"))
    )


def review_tokens(reviews: DataFrame, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """One row per kept word of a review: best_book_id, review_id, word."""
    words = reviews.where("review_text IS NOT NULL").select(
        "best_book_id", "review_id", F.explode(split_words("review_text")).alias("word")
    )
    return words.where(keep_word(F.col("word"), stop_words))


def term_counts(words: DataFrame) -> DataFrame:
    """Occurrences of each word per book."""
    return words.groupBy("best_book_id", "word").agg(F.count("*").alias("tf"))


def lemma_table(words: DataFrame) -> DataFrame:
    """(word, lemma) for the words of a column ``word`` that are plurals of others among them.

    The words themselves are the lexicon: a form that an ending rule makes counts only if it occurs, the shortest one
    wins. So movies goes to movie and not to movy, wolves to wolf, and series or specimen stay as they are.
    """
    known = words.select("word").distinct()
    forms = known.select("word", F.explode(singular_forms(F.col("word"))).alias("form"))
    found = forms.join(known.select(F.col("word").alias("form")), "form", "left_semi")
    return found.groupBy("word").agg(F.min(F.struct(F.length("form").alias("n"), "form")).alias("least")).select(
        "word", F.col("least.form").alias("lemma"))


def _lemmas(words: DataFrame, lemmas: DataFrame | None) -> DataFrame:
    """`lemma_table` of the words, with the entries of a given table before its own."""
    found = lemma_table(words)
    if lemmas is None:
        return found
    given = lemmas.select("word", F.col("lemma").alias("given"))
    return given.join(found, "word", "full").select("word", F.coalesce("given", "lemma").alias("lemma"))


def lemmatise(counts: DataFrame, lemmas: DataFrame | None = None) -> DataFrame:
    """Counts per reduced word: a table (word, lemma) decides, `lemma_table` of the counted words handles the rest.

    Reducing counts instead of running text handles each distinct word of a book once.
    """
    reduced = counts.join(_lemmas(counts, lemmas), "word", "left").withColumn("word", F.coalesce("lemma", "word"))
    return reduced.groupBy("best_book_id", "word").agg(F.sum("tf").alias("tf"))


def word_lemmas(words: DataFrame) -> DataFrame:
    """Distinct words with their reduced form and how often they occur."""
    counts = words.groupBy("word").agg(F.count("*").alias("n"))
    return counts.join(lemma_table(counts), "word", "left").select("word", F.coalesce("lemma", "word").alias("lemma"), "n")


def reviewed_books(reviews: DataFrame) -> DataFrame:
    """Books with at least one review text."""
    return reviews.where("review_text IS NOT NULL").select("best_book_id").distinct()


def vocabulary(counts: DataFrame, max_features: int = MAX_FEATURES) -> DataFrame:
    """The most frequent words with their document frequency; ties alphabetical. At most max_features rows."""
    return (
        counts.groupBy("word").agg(F.sum("tf").alias("total"), F.count("*").alias("df"))
        .orderBy(F.desc("total"), "word").limit(max_features)
    )


def tfidf_long(counts: DataFrame, vocab: DataFrame, n_books: Column) -> DataFrame:
    """best_book_id, word, weight: tf * (ln((1 + n) / (1 + df)) + 1), each book scaled to length 1.

    ``vocab`` comes from vocabulary(), so it has at most max_features rows and is broadcast.
    """
    idf = F.log((F.lit(1.0) + n_books) / (F.lit(1.0) + F.col("df"))) + 1.0
    raw = counts.join(F.broadcast(vocab), "word").select(
        "best_book_id", "word", (F.col("tf") * idf).alias("raw")
    )
    norm = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy("best_book_id")))
    return raw.select("best_book_id", "word", (F.col("raw") / norm).alias("weight"))


def review_words(reviews: DataFrame, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """(best_book_id, words): the kept words of every review that has a text, so that texts are split once."""
    return reviews.where("review_text IS NOT NULL").select(
        "best_book_id", F.filter(split_words("review_text"), lambda word: keep_word(word, stop_words)).alias("words"))


def vocabulary_counts(words: DataFrame, max_features: int = MAX_FEATURES, lemmas: DataFrame | None = None) -> DataFrame:
    """(best_book_id, word, tf) of the ``max_features`` words that `vocabulary` takes, reduced as by `lemmatise`.

    ``words`` comes from `review_words`. A word's total needs no book, so totals, lemmas and the vocabulary follow from
    one count per word; only words that lead to the vocabulary are then counted per book.
    """
    totals = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n")).persist(StorageLevel.MEMORY_AND_DISK)
    found = _lemmas(totals, lemmas)
    named = totals.join(found, "word", "left").select("word", "n", F.coalesce("lemma", "word").alias("lemma")).persist(StorageLevel.MEMORY_AND_DISK)
    top = named.groupBy("lemma").agg(F.sum("n").alias("total")).orderBy(F.desc("total"), "lemma").limit(max_features)
    chosen = named.join(F.broadcast(top), "lemma").select("word", "lemma").toArrow()  # at most a few forms of each word
    totals.unpersist()
    named.unpersist()
    chosen = F.broadcast(words.sparkSession.createDataFrame(chosen.to_pylist(), "word string, lemma string"))
    return (
        words.select("best_book_id", F.explode("words").alias("word")).join(chosen, "word")
        .groupBy("best_book_id", F.col("lemma").alias("word")).agg(F.count("*").alias("tf"))
    )


VECTOR_SCHEMA = StructType([
    StructField("best_book_id", LongType()), StructField("features", VectorUDT()),
])


def to_vectors(weights: DataFrame, books: DataFrame, words: list[str]) -> DataFrame:
    """Sparse ML vectors of the long weights; a book without vocabulary words gets the zero vector.

    A book has at most one entry per vocabulary word. The batches are rearranged as whole Arrow
    columns into the storage layout of a sparse vector.
    """
    size = len(words)
    vocab = weights.sparkSession.createDataFrame(list(enumerate(words)), "idx int, word string")
    packed = (
        weights.join(F.broadcast(vocab), "word").groupBy("best_book_id")
        .agg(F.array_sort(F.collect_list(F.struct("idx", "weight"))).alias("e"))
        .select("best_book_id", F.col("e.idx").alias("idx"), F.col("e.weight").alias("weight"))
    )
    rows = books.join(packed, "best_book_id", "left").select(
        "best_book_id",
        F.coalesce("idx", F.array().cast("array<int>")).alias("idx"),
        F.coalesce("weight", F.array().cast("array<double>")).alias("weight"),
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            vector = pa.StructArray.from_arrays(
                [
                    pa.array([0] * n, pa.int8()), pa.array([size] * n, pa.int32()),
                    batch.column("idx"), batch.column("weight"),
                ],
                names=["type", "size", "indices", "values"],
            )
            yield pa.RecordBatch.from_arrays([batch.column("best_book_id"), vector], names=["best_book_id", "features"])

    return rows.mapInArrow(pack, VECTOR_SCHEMA)


def theme_vectors(
    reviews: DataFrame, max_features: int = MAX_FEATURES, stop_words: Iterable[str] = STOP_WORDS,
    lemmas: DataFrame | None = None,
) -> tuple[DataFrame, list[str]]:
    """TF-IDF vectors per book and the vocabulary in vector order (at most max_features words)."""
    split = review_words(reviews, stop_words).persist(StorageLevel.MEMORY_AND_DISK)
    counts = vocabulary_counts(split, max_features, lemmas).persist(StorageLevel.MEMORY_AND_DISK)
    books = split.select("best_book_id").distinct()
    vocab = vocabulary(counts, max_features)
    words = [r["word"] for r in vocab.collect()]
    weights = tfidf_long(counts, vocab, books.agg(F.count("*")).scalar())
    vectors = to_vectors(weights, books, words).persist(StorageLevel.MEMORY_AND_DISK)
    vectors.count()
    counts.unpersist()
    split.unpersist()
    return vectors, words


@dataclass(frozen=True)
class Themes:
    """Centres of the best start, its cost, and the costs of all starts."""

    centers: np.ndarray
    cost: float
    costs: list[float]


def _dense(features: pa.StructArray, size: int) -> np.ndarray:
    """Rows of a matrix from a column of sparse vectors."""
    indices, values = features.field("indices"), features.field("values")
    out = np.zeros((len(features), size))
    row = pc.list_parent_indices(indices).to_numpy()
    out[row, indices.flatten().to_numpy()] = values.flatten().to_numpy()
    return out


def _distances(rows: np.ndarray, centers: np.ndarray) -> np.ndarray:
    squares = np.einsum("ij,ij->i", rows, rows)[:, None] + np.einsum("ij,ij->i", centers, centers)[None, :]
    return np.maximum(squares - 2 * rows @ centers.T, 0)


def _first_centers(sample: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of the sample, each drawn with odds by the squared distance to those before it."""
    chosen = [int(rng.integers(len(sample)))]
    near = _distances(sample, sample[chosen])[:, 0]
    while len(chosen) < k:
        total = near.sum()
        chosen.append(int(rng.choice(len(sample), p=near / total)) if total > 0 else int(rng.integers(len(sample))))
        near = np.minimum(near, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def _labels(batches: Iterator[pa.RecordBatch], centers: np.ndarray) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_PER_STEP):
            part = batch.slice(start, ROWS_PER_STEP)
            nearest = _distances(_dense(part.column(1), centers.shape[1]), centers).argmin(axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(nearest, pa.int32()), part.column(0)], ["k_label", "book_id"])


def cluster(
    vectors: DataFrame, k: int = CLUSTERS, seed: int = SEED, n_init: int = STARTS, max_iter: int = MAX_ITER, tolerance: float = TOLERANCE,
) -> tuple[Themes, DataFrame]:
    """k-means from ``n_init`` starts: the cheapest one's centres, and the theme table (k_label, book_id).

    The starts advance together: a pass over the vectors adds up the sums and costs of every centre of every start that
    still moves, and only those sums (starts x k x words) come to the driver. The first centres are drawn from up to
    START_SAMPLE vectors in hashed order, all passes read all vectors. A centre that loses its books stays where it is.
    Label numbers carry no meaning.
    """
    spark = vectors.sparkSession
    rows = vectors.select("best_book_id", "features")
    head = rows.orderBy(F.xxhash64("best_book_id", F.lit(seed)), "best_book_id").limit(START_SAMPLE).toArrow()
    if not head.num_rows:
        raise ValueError("there are no vectors to cluster")
    features = head.column("features").combine_chunks()
    features = features.chunk(0) if isinstance(features, pa.ChunkedArray) else features
    size = features.field("size")[0].as_py()
    sample = _dense(features, size)
    k = min(k, len(sample))
    starts = [_first_centers(sample, k, np.random.default_rng([seed, i])) for i in range(n_init)]
    costs, moving = [math.inf] * n_init, list(range(n_init))
    for step in range(max_iter + 1):
        if not moving:
            break
        shared = spark.sparkContext.broadcast(np.concatenate([starts[i] for i in moving]))

        def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            centers = shared.value
            n = len(centers)
            sums, tally = np.zeros((n, size)), np.zeros((n, 2))
            for batch in batches:
                for start in range(0, batch.num_rows, ROWS_PER_STEP):
                    dense = _dense(batch.column(1).slice(start, ROWS_PER_STEP), size)
                    apart = _distances(dense, centers).reshape(len(dense), -1, k)
                    nearest = apart.argmin(axis=2) + np.arange(n // k) * k
                    tally[:, 0] += np.bincount(nearest.ravel(), minlength=n)
                    tally[:, 1] += np.bincount(nearest.ravel(), weights=apart.min(axis=2).ravel(), minlength=n)
                    # The starts have centres of their own, so one product adds up all of them.
                    member = np.zeros((len(dense), n))
                    member[np.arange(len(dense))[:, None], nearest] = 1
                    sums += member.T @ dense
            whole = np.hstack((sums, tally))
            center, place = np.nonzero(whole)
            yield pa.RecordBatch.from_arrays(
                [pa.array(center, pa.int32()), pa.array(place, pa.int32()), pa.array(whole[center, place])], ["center", "place", "value"])

        found = rows.mapInArrow(advance, "center int, place int, value double").groupBy("center", "place").agg(F.sum("value").alias("value")).toArrow()
        shared.destroy()
        whole = np.zeros((len(moving) * k, size + 2))
        whole[found["center"].to_numpy(), found["place"].to_numpy()] = found["value"].to_numpy()
        still = []
        for nth, i in enumerate(moving):
            part = whole[nth * k : (nth + 1) * k]
            costs[i] = float(part[:, -1].sum())
            held = part[:, -2] > 0
            new = np.where(held[:, None], part[:, :-2] / np.maximum(part[:, -2], 1)[:, None], starts[i])
            if step < max_iter and ((new - starts[i]) ** 2).sum(axis=1).max() > tolerance**2:
                starts[i] = new
                still.append(i)
        moving = still
    best = min(range(n_init), key=lambda i: (costs[i], i))
    centers = starts[best]
    labels = rows.mapInArrow(lambda batches: _labels(batches, centers), "k_label int, book_id long")
    return Themes(centers, costs[best], costs), labels


def nearest_checks(weights: DataFrame, books: DataFrame, words: list[str], model: Themes, labels: DataFrame, k: int) -> DataFrame:
    """(book_id, label_in_range, nearest): whether each book's centre is the nearest to it, from its long weights."""
    spark = books.sparkSession
    n, squares = len(model.centers), [float(c @ c) for c in model.centers]
    along = F.broadcast(spark.createDataFrame(
        [(word, [float(x) for x in model.centers[:, i]]) for i, word in enumerate(words)], "word string, along array<double>"))
    # |x - c|^2 without |x|^2, which all centres share; a book without words has the squares alone.
    dots = weights.join(along, "word").groupBy("best_book_id").agg(
        F.array(*[F.sum(F.col("weight") * F.col("along")[i]) for i in range(n)]).alias("dots"))
    apart = F.array(*[F.lit(squares[i]) - 2 * F.coalesce(F.col("dots")[i], F.lit(0.0)) for i in range(n)])
    own = labels.withColumnRenamed("book_id", "best_book_id").join(books, "best_book_id").join(dots, "best_book_id", "left").select(
        "best_book_id", "k_label", apart.alias("apart"))
    return own.select(
        F.col("best_book_id").alias("book_id"), F.col("k_label").between(0, k - 1).alias("label_in_range"),
        F.coalesce(F.get("apart", F.col("k_label")) <= F.array_min("apart") + 1e-9, F.lit(False)).alias("nearest"))


def theme_terms(weights: DataFrame, labels: DataFrame, n: int, decimals: int = 6) -> DataFrame:
    """The n heaviest words of every theme of a given label table: k_label, position, word, weight (mean over its books)."""
    named = weights.join(labels.select("k_label", F.col("book_id").alias("best_book_id")), "best_book_id")
    books = named.groupBy("k_label").agg(F.countDistinct("best_book_id").alias("n"))
    means = named.groupBy("k_label", "word").agg(F.sum("weight").alias("sum")).join(F.broadcast(books), "k_label")
    order = Window.partitionBy("k_label").orderBy(F.desc("weight"), "word")
    return means.select("k_label", "word", F.round(F.col("sum") / F.col("n"), decimals).alias("weight")).withColumn(
        "position", F.row_number().over(order)).where(F.col("position") <= n).select("k_label", "position", "word", "weight")


def cluster_terms(model: Themes, words: list[str], n: int, spark: SparkSession) -> DataFrame:
    """The n heaviest words of every centroid: k values of vocabulary length."""
    rows = [(i, [float(x) for x in c]) for i, c in enumerate(model.centers)]
    centers = spark.createDataFrame(rows, "k_label int, weights array<double>")
    vocab = spark.createDataFrame(list(enumerate(words)), "idx int, word string")
    order = Window.partitionBy("k_label").orderBy(F.desc("weight"), "idx")
    return (
        centers.select("k_label", F.posexplode("weights").alias("idx", "weight"))
        .withColumn("position", F.row_number().over(order)).where(F.col("position") <= n)
        .join(F.broadcast(vocab), "idx").select("k_label", "position", "word", "weight")
    )


def cluster_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("k_label").agg(F.count("*").alias("n_books"))


def cluster_titles(labels: DataFrame, books: DataFrame, n: int) -> DataFrame:
    """The first n titles of every theme in book order.

    A theme may hold most books, so candidates are first cut per (theme, id range), then ranked.
    """
    named = books.select("best_book_id", "title").join(labels.withColumnRenamed("book_id", "best_book_id"), "best_book_id")
    narrow = Window.partitionBy("k_label", F.pmod(F.xxhash64("best_book_id"), F.lit(1024))).orderBy("best_book_id")
    final = Window.partitionBy("k_label").orderBy("best_book_id")
    return (
        named.withColumn("near", F.row_number().over(narrow)).where(F.col("near") <= n)
        .withColumn("position", F.row_number().over(final)).where(F.col("position") <= n)
        .select("k_label", "position", "best_book_id", "title")
    )
