import pytest
from pyspark.sql import functions as F

from tomewise.operators import als, clean, groups, profile, resolve, splits


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


AUTHORS = "author_id long, main_author boolean, race string, gender string"


def test_authors_clean_rules(spark):
    raw = spark.createDataFrame([
        (1, True, " white ", "Male"), (2, True, "WHITE", "male"), (3, True, "unknown", "female"),
        (4, True, None, "female"), (5, True, "Black", None), (6, False, "Asian", "female"),
    ], AUTHORS)
    got = {r["author_id"]: (r["race"], r["gender"]) for r in clean.clean_authors(raw).collect()}
    # Null race is dropped, unknown race and null gender become the majority, other authors are hidden.
    assert got == {1: ("WHITE", "MALE"), 2: ("WHITE", "MALE"), 3: ("WHITE", "FEMALE"), 5: ("BLACK", "FEMALE")}


def test_invalid_majority_does_not_win(spark):
    raw = spark.createDataFrame(
        [(i, True, "x", "male") for i in range(5)] + [(9, True, "asian", "female"), (10, True, "asian", "female")], AUTHORS
    )
    assert {r["race"] for r in clean.clean_authors(raw).collect()} == {"ASIAN"}


def test_english_filter_is_case_sensitive_and_drops_null(spark):
    books = spark.createDataFrame([(1, "eng"), (2, "ENG"), (3, None), (4, "en-CA"), (5, "fre")], "book_id long, language_code string")
    assert {r["book_id"] for r in clean.english_books(books).collect()} == {1, 4}


def test_isbn_map_rules(spark):
    raw = spark.createDataFrame([("001X", "5"), ("001X", "9.0"), ("2", None), ("3", "junk")], "isbn string, best_book_id string")
    assert rows(clean.clean_isbn_map(raw)) == [("001X", 9)]


def test_shelf_resolution(spark):
    books = spark.createDataFrame([(10,), (20,)], "best_book_id long")
    isbn_map = spark.createDataFrame([("i20", 20), ("i99", 99)], "isbn string, best_book_id long")
    shelf = spark.createDataFrame([
        (1, "10", None, 4), (1, "777", "i20", 5), (1, "20", "i99", 3), (1, "888", None, 5), (1, "999", "nope", 2),
        (1, "10", None, 0), (2, "x", "i99", 1),
    ], "user_id long, book_id string, isbn string, rating int")
    got = rows(resolve.resolve_shelf(shelf, books, isbn_map).select("user_id", "book_id", "rating"))
    assert got == [(1, 10, 4), (1, 20, 5), (2, 99, 1)]
    assert rows(resolve.shelf_coverage(shelf, books, isbn_map)) == [(1, 6, 3), (2, 1, 1)]


def test_id_translation_misses(spark):
    ratings = spark.createDataFrame([(1, 1, 5), (1, 2, 4)], "user_id long, book_id long, rating int")
    id_map = spark.createDataFrame([(1, 100)], "book_id long, best_book_id long")
    assert rows(resolve.translate_ids(ratings, id_map)) == [(1, 100, 5), (1, None, 4)]
    assert rows(resolve.translate_ids(ratings, id_map, missing=0)) == [(1, 0, 4), (1, 100, 5)]


def test_worklist_and_union_of_maps(spark):
    reviews = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "asin string")
    known = spark.createDataFrame([("a", 1), ("b", None)], "isbn string, best_book_id long")
    assert rows(resolve.unresolved_asins(reviews, known)) == [("c",)]
    new = spark.createDataFrame([("a", 50), ("c", 7)], "isbn string, best_book_id long")
    assert rows(resolve.union_isbn_maps(known.dropna(), new)) == [("a", 1), ("c", 7)]


@pytest.fixture(scope="module")
def read(spark):
    classified = spark.createDataFrame([
        (1, 11, "A", "F"), (2, 12, "A", "M"), (2, 13, "B", "F"), (3, 12, "A", "M"), (4, 14, None, "M"),
    ], "best_book_id long, author_id long, race string, gender string")
    ratings = spark.createDataFrame(
        [(1, 1, 5), (1, 2, 4), (2, 2, 4), (2, 3, 3), (3, 4, 2)], "user_id long, book_id long, rating int"
    )
    return ratings, classified


def test_group_shares_and_boost(spark, read):
    ratings, classified = read
    shares = groups.group_share(classified)
    assert shares.agg(F.sum("share")).head()[0] == pytest.approx(1)
    assert shares.count() == 3
    mine = groups.user_group_share(ratings, classified)
    assert all(r["s"] == pytest.approx(1) for r in mine.groupBy("user_id").agg(F.sum("share").alias("s")).collect())
    table = groups.group_boost(ratings, classified)
    # Every user meets every group, also the one who read only an unclassified author.
    assert table.count() == 9
    for r in table.collect():
        target = (r["gr_count"]) / (4 + 3000)
        assert r["gr_percentage"] == pytest.approx(target)
        share = r["user_percentage"]
        assert r["user_gr_perc_norm"] == pytest.approx(1 / (1 + share / target))
        assert 0 < r["user_gr_perc_norm"] < 1
        assert (share == groups.UNREAD_SHARE) == (r["user_count"] == 0)
    boosts = {(r["user_id"], r["race_gender"]): r["user_gr_perc_norm"] for r in table.collect()}
    assert boosts[(2, "A M")] < boosts[(1, "A M")] < boosts[(3, "A M")]


def test_user_group_share_is_one_row_a_user_until_its_end(spark):
    classified = spark.createDataFrame([
        (1, 11, "A", "F"), (2, 12, "A", "M"), (2, 13, "B", "F"), (2, 13, "B", "F"), (3, None, "C", "M"), (4, 14, None, "M"), (None, 15, "A", "F"),
    ], "best_book_id long, author_id long, race string, gender string")
    ratings = spark.createDataFrame(
        [(1, 1, 5), (1, 2, 4), (1, 3, 1), (2, 2, 4), (2, 2, 4), (3, 4, 2), (None, 1, 3), (None, 2, 3), (5, None, 3)],
        "user_id long, book_id long, rating int")
    mine = groups.user_group_share(ratings, classified)
    want = {
        (1, "A F", "A", "F", 1, 0.25), (1, "A M", "A", "M", 1, 0.25), (1, "B F", "B", "F", 2, 0.5), (1, "C M", "C", "M", 0, 0.0),
        (2, "A M", "A", "M", 2, 1 / 3), (2, "B F", "B", "F", 4, 2 / 3),
        (None, "A F", "A", "F", 1, 0.25), (None, "A M", "A", "M", 1, 0.25), (None, "B F", "B", "F", 2, 0.5),
    }
    assert mine.count() == len(want) and {tuple(r) for r in mine.collect()} == want
    assert mine.columns == ["user_id", "race_gender", "race", "gender", "n", "share"]
    # No window over the groups of a user: the pairs read are shuffled by user and nothing after that.
    assert "Window" not in mine._jdf.queryExecution().sparkPlan().toString()
    authors = classified.union(spark.createDataFrame([(9, 99, "D", "F")], classified.schema)).drop("best_book_id")
    assert {tuple(r) for r in groups.user_group_share(ratings, classified, authors=authors).collect()} == want
    many = groups.user_group_share(ratings, classified, max_sums=2)
    assert many.dtypes == mine.dtypes and {tuple(r) for r in many.collect()} == want
    assert groups.user_group_share(ratings, classified.where("race IS NULL")).count() == 0


def test_category_shares_and_ties(spark):
    books = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 2), (5, None)], "best_book_id long, k_label int")
    ratings = spark.createDataFrame([(1, b, 3) for b in (1, 3, 4, 5)], "user_id long, book_id long, rating int")
    shares = profile.category_share(ratings, books)
    assert rows(shares) == [(1, 0, 1, 2, 0.5), (1, 1, 1, 1, 1.0), (1, 2, 1, 1, 1.0)]
    top = profile.top_categories(shares, ratings, books, 2)
    assert [r["k_label"] for r in top.orderBy("position").collect()] == [1, 2]


def test_unread_categories_fill_the_places(spark):
    books = spark.createDataFrame([(b, b % 7) for b in range(21)] + [(30, None)], "best_book_id long, k_label int")
    ratings = spark.createDataFrame([(1, 4, 3), (2, 30, 5)], "user_id long, book_id long, rating int")
    top = profile.top_categories(profile.category_share(ratings, books), ratings, books)
    got = [(r["user_id"], r["position"], r["k_label"], round(r["share"], 3)) for r in top.orderBy("user_id", "position").collect()]
    assert got == [(1, 1, 4, 0.333), *((1, p + 2, k, 0.0) for p, k in enumerate((0, 1, 2, 3))), *((2, p + 1, p, 0.0) for p in range(5))]


def test_top_slice_uses_interpolated_quantile(spark):
    ratings = spark.createDataFrame([(1, b, r) for b, r in enumerate([1, 2, 3, 4, 5])] + [(2, 1, 3)], "user_id long, book_id long, rating int")
    got = {(r["user_id"], r["rating"]): (r["limit"], r["is_top"]) for r in profile.with_top_slice(ratings).collect()}
    assert got[(1, 5)] == (pytest.approx(4.8), True) and not got[(1, 4)][1] and got[(2, 3)][1]


def test_splits_are_stable_and_keep_users_together(spark):
    ratings = spark.range(4000).select(
        (F.col("id") % 200).alias("user_id"), F.col("id").alias("book_id"), F.lit(3).alias("rating")
    )
    share = splits.split_rows(ratings).where("split = 'train'").count() / 4000
    assert 0.66 < share < 0.74
    a = rows(splits.split_rows(ratings))
    assert a == rows(splits.split_rows(ratings.repartition(7)))
    users = splits.split_users(ratings).groupBy("user_id").agg(F.count_distinct("split").alias("n"))
    assert users.where("n > 1").count() == 0
    sample = splits.sample_users(ratings, 50)
    assert sample.distinct().count() == 50
    assert rows(sample) == rows(splits.sample_users(ratings.repartition(3), 50))
    assert rows(sample) != rows(splits.sample_users(ratings, 50, seed=1))


def test_best_config_first_wins(spark):
    metrics = spark.createDataFrame([(0, 1, 0.5), (1, 1, 0.2), (2, 2, 0.2), (3, 2, None)], "position int, rank int, m double")
    assert als.best_config(metrics, "m").head()["position"] == 1
    assert als.best_config(metrics, "m", ascending=False).head()["position"] == 0
    assert [r["position"] for r in als.best_config(metrics, "m", within=["rank"]).orderBy("rank").collect()] == [1, 2]
