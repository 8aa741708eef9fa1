import math
from collections import Counter

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from tomewise.functions.text import STOP_WORDS, keep_word, tokens
from tomewise.operators import themes


@pytest.mark.parametrize("text, words", [
    ("Don't stop; it's 1,000 well-known e.g. things!", ["do", "nt", "stop", "it", "s", "1000", "wellknown", "eg", "things"]),
    ("one,two three:four 3:15 -- end...", ["one", "two", "three", "four", "315", "end"]),
    ("  (They'd)\n[gone] now. ", ["they", "d", "gone", "now"]),
    ("... !!! ", []),
])
def test_tokens(spark, text, words):
    df = spark.createDataFrame([(text,)], "t string")
    assert df.select(tokens("t")).head()[0] == words


def test_stop_words(spark):
    df = spark.createDataFrame([(["the", "books", "of", "glass"],)], "w array<string>")
    assert df.select(F.filter("w", lambda w: keep_word(w))).head()[0] == ["books", "glass"]


def test_lemmas_are_words_of_the_corpus(spark):
    plurals = {
        "movies": "movie", "cookies": "cookie", "stories": "story", "wolves": "wolf", "lenses": "lens", "boxes": "box",
        "churches": "church", "wishes": "wish", "houses": "house", "women": "woman", "books": "book", "gases": "gas",
        "quizzes": "quizzes",
    }
    alone = ["series", "species", "specimen", "abdomen", "omen", "glass", "bus", "analysis", "unknowns", "was", "gas"]
    words = [*plurals, *plurals.values(), *alone, "men", "man"]
    rows = spark.createDataFrame([(1, w) for w in words], "best_book_id long, word string")
    got = {r["word"]: r["lemma"] for r in themes.word_lemmas(rows).collect()}
    assert {w: got[w] for w in plurals} == plurals
    assert all(got[w] == w for w in alone)
    assert got["men"] == "men"  # three letters are never cut
    assert themes.word_lemmas(rows.limit(0)).collect() == []


REVIEWS = [(1, 11, "good dragons"), (1, 12, None), (1, 13, "bad dragon, bad"), (2, 21, "good love"), (3, 31, "the of")]


@pytest.fixture(scope="module")
def reviews(spark):
    return spark.createDataFrame(REVIEWS, "best_book_id long, review_id long, review_text string").cache()


def test_reviews_by_book_in_order(spark, reviews):
    got = {r["best_book_id"]: (r["part"], r["review_text"]) for r in themes.reviews_by_book(reviews).collect()}
    assert got == {1: (0, "good dragons bad dragon, bad"), 2: (0, "good love"), 3: (0, "the of")}


def test_long_text_goes_on_in_parts(spark):
    rows = [(7, i, f"review number {i}") for i in range(500)] + [(8, 1000, "short")]
    df = spark.createDataFrame(rows, "best_book_id long, review_id long, review_text string").repartition(5)
    parts = themes.reviews_by_book(df, part_bits=6).where("best_book_id = 7").orderBy("part").collect()
    assert len(parts) > 5
    assert " ".join(p["review_text"] for p in parts) == " ".join(r[2] for r in rows[:500])


def test_tfidf_matches_definition_and_vectors(spark, reviews):
    words = {1: ["good", "dragon", "bad", "dragon", "bad"], 2: ["good", "love"], 3: []}
    df = Counter(w for ws in words.values() for w in set(ws))
    want = {}
    for book, ws in words.items():
        raw = {w: n * (math.log(4 / (1 + df[w])) + 1) for w, n in Counter(ws).items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        want |= {(book, w): x / norm for w, x in raw.items()}
    vectors, vocab = themes.theme_vectors(reviews, 100)
    assert vocab == ["bad", "dragon", "good", "love"]
    got = {}
    for r in vectors.select("best_book_id", vector_to_array("features").alias("f")).collect():
        got |= {(r["best_book_id"], w): x for w, x in zip(vocab, r["f"]) if x}
    assert got == pytest.approx(want)
    # A book whose reviews hold stop words only still gets a (zero) vector, hence a theme.
    assert vectors.count() == 3
    model, labels = themes.cluster(vectors, 2)
    assert labels.count() == 3
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, themes.cluster(vectors, 2)[1].collect()))
    terms = themes.cluster_terms(model, vocab, 2, spark).collect()
    assert all(1 <= r["position"] <= 2 for r in terms) and len(terms) == 2 * len(model.centers)


def test_vocabulary_limit_and_lemma_table(spark, reviews):
    counts = themes.term_counts(themes.review_tokens(reviews))
    lemmas = spark.createDataFrame([("bad", "poor")], "word string, lemma string")
    reduced = {(r["best_book_id"], r["word"]): r["tf"] for r in themes.lemmatise(counts, lemmas).collect()}
    assert reduced == {(1, "good"): 1, (1, "dragon"): 2, (1, "poor"): 2, (2, "good"): 1, (2, "love"): 1}
    top = [r["word"] for r in themes.vocabulary(themes.lemmatise(counts), 2).collect()]
    assert top == ["bad", "dragon"]


def test_only_words_of_the_vocabulary_are_counted_per_book(spark):
    rows = [(b, r, f"movies movie wolf w{b}x{r} cats") for b in range(6) for r in range(3)] + [(9, 1, "the"), (9, 2, None), (8, 1, "wolves cat cats")]
    reviews = spark.createDataFrame(rows, "best_book_id long, review_id long, review_text string")
    given = spark.createDataFrame([("cats", "pet"), ("unheard", "movie")], "word string, lemma string")
    split = themes.review_words(reviews)
    assert {r["best_book_id"] for r in split.collect()} == {*range(6), 8, 9}
    for lemmas in (None, given):
        whole = themes.lemmatise(themes.term_counts(themes.review_tokens(reviews)), lemmas)
        top = {r["word"]: (r["total"], r["df"]) for r in themes.vocabulary(whole, 3).collect()}
        counts = themes.vocabulary_counts(split, 3, lemmas)
        assert {r["word"]: (r["total"], r["df"]) for r in themes.vocabulary(counts, 3).collect()} == top
        assert sorted(map(tuple, counts.collect())) == sorted(tuple(r) for r in whole.collect() if r["word"] in top)


def test_a_pass_adds_up_all_starts_in_one_product(spark, monkeypatch):
    zeros, made = themes.np.zeros, []
    batch = blobs(spark).toArrow().to_batches()[0]
    rows = themes.np.array([[float(i == j) for j in range(6)] for i in range(4)])

    class Frame:
        """Runs a pass in this process."""

        def __init__(self, df):
            self.df = df

        def mapInArrow(self, run, schema):
            if "value" not in schema:
                return None
            monkeypatch.setattr(themes.np, "zeros", lambda shape, *a, **k: made.append(shape) or zeros(shape, *a, **k))
            out = list(run(iter([batch])))
            monkeypatch.setattr(themes.np, "zeros", zeros)
            return spark.createDataFrame([r for b in out for r in b.to_pylist()], schema)

        def __getattr__(self, name):
            return getattr(self.df, name)

    class Vectors:
        sparkSession = spark

        def select(self, *columns):
            return Frame(blobs(spark).select(*columns))

    model, _ = themes.cluster(Vectors(), len(rows), n_init=5, max_iter=0)
    assert made.count((batch.num_rows, 20)) == 1 and len(model.costs) == 5


def test_cluster_titles_in_book_order(spark):
    labels = spark.range(5000).select(F.when(F.col("id") < 4990, 0).otherwise(1).alias("k_label"), F.col("id").alias("book_id"))
    books = spark.range(5000).select(F.col("id").alias("best_book_id"), F.concat(F.lit("t"), F.col("id")).alias("title"))
    got = themes.cluster_titles(labels, books, 3).orderBy("k_label", "position").collect()
    assert [r["title"] for r in got] == ["t0", "t1", "t2", "t4990", "t4991", "t4992"]
    sizes = {r["k_label"]: r["n_books"] for r in themes.cluster_sizes(labels).collect()}
    assert sizes == {0: 4990, 1: 10}


def test_stop_list_is_plain_lower_case():
    assert len(STOP_WORDS) == len(set(STOP_WORDS)) and all(w == w.lower() for w in STOP_WORDS)


def blobs(spark, n=90):
    """Three groups of sparse vectors around three pairs of words, and a book without words."""
    import numpy as np
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(2)
    rows = [(i, Vectors.sparse(6, [2 * (i % 3), 2 * (i % 3) + 1], [1 + rng.normal() / 20, 1 + rng.normal() / 20])) for i in range(n)]
    return spark.createDataFrame([*rows, (n, Vectors.sparse(6, [], []))], themes.VECTOR_SCHEMA)


def test_the_cheapest_of_many_starts_is_kept(spark):
    vectors = blobs(spark).cache()
    model, labels = themes.cluster(vectors, 4, n_init=6)
    assert model.cost == min(model.costs) and len(model.costs) == 6
    groups = {}
    for r in labels.collect():
        groups.setdefault(r["k_label"], set()).add(r["book_id"])
    assert sorted(map(sorted, groups.values())) == sorted([list(range(g, 90, 3)) for g in range(3)] + [[90]])
    single = themes.cluster(vectors, 4, n_init=1)[0]
    assert single.costs[0] == pytest.approx(model.costs[0])
    # Cost and labels follow from the centres alone.
    rows = {r["best_book_id"]: r["f"] for r in vectors.select("best_book_id", vector_to_array("features").alias("f")).collect()}
    cost = sum(min(sum((x - y) ** 2 for x, y in zip(f, c)) for c in model.centers) for f in rows.values())
    assert cost == pytest.approx(model.cost)


def test_clusters_of_few_or_no_vectors(spark):
    vectors = blobs(spark, 2)
    model, labels = themes.cluster(vectors, 13)
    assert len(model.centers) == 3 and labels.count() == 3
    with pytest.raises(ValueError):
        themes.cluster(vectors.limit(0), 2)


def test_nearest_checks_find_wrong_labels(spark, reviews):
    vectors, vocab = themes.theme_vectors(reviews, 100)
    counts = themes.lemmatise(themes.term_counts(themes.review_tokens(reviews)))
    books = themes.reviewed_books(reviews)
    weights = themes.tfidf_long(counts, themes.vocabulary(counts), books.agg(F.count("*")).scalar())
    model, labels = themes.cluster(vectors, 3)
    good = themes.nearest_checks(weights, books, vocab, model, labels, 3).collect()
    assert len(good) == 3 and all(r["label_in_range"] and r["nearest"] for r in good)
    moved = labels.withColumn("k_label", (F.col("k_label") + 1) % 3)
    assert not any(r["nearest"] for r in themes.nearest_checks(weights, books, vocab, model, moved, 3).collect())
