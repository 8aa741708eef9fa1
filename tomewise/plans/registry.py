"""Registered queries: every operator run over the whole supplied tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from tomewise.functions.skew import spread_unsplit
from tomewise.functions.tables import dense_index, scratch_path, stored
from tomewise.operators import als, clean, foldin, groups, profile, rankings, resolve, scoring, splits, themes
from tomewise.plans import grids
from tomewise.plans.recommend import Recommender, recommend_shelves
from tomewise.session import tune
from tomewise.sources import derived as src
from tomewise.sources import files
from tomewise.sources.factors import ITEM, USER, FactorStore

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

DECIMALS = 6
TOP_N = 10
GRID_ALPHAS = grids.GRID_ALPHAS
GRID_ITERATIONS = grids.GRID_ITERATIONS
#: Limits of the queries that show the layouts for large catalogues on the supplied tables.
SMALL_BLOCK, SMALL_CHUNK = 1 << 17, 64


# How to free what a query keeps in storage because several of its branches read it; the next query does.
HELD: list[Callable[[], object]] = []


def hold(df: DataFrame) -> DataFrame:
    df = df.persist(StorageLevel.MEMORY_AND_DISK)
    HELD.append(df.unpersist)
    return df


def query(fn: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        while HELD:
            HELD.pop()()
        return fn(tune(spark), sf_dir)

    QUERIES[fn.__name__] = run
    return fn


def rounded(df: DataFrame, *columns: str, decimals: int = DECIMALS) -> DataFrame:
    return df.withColumns({c: F.round(c, decimals) for c in columns})


def isbn_map(spark: SparkSession, sf: str) -> DataFrame:
    return clean.clean_isbn_map(src.isbn_map_raw(spark, sf))


def isbn_map_english(spark: SparkSession, sf: str) -> DataFrame:
    return clean.limit_isbn_map(isbn_map(spark, sf), clean.english_books(src.books_detail(spark, sf)))


def classified(spark: SparkSession, sf: str) -> DataFrame:
    return clean.classify_books(
        src.books(spark, sf), src.book_authors(spark, sf).drop("role"), src.authors(spark, sf)
    )


def limited(spark: SparkSession, sf: str) -> DataFrame:
    """Known reviews with their order of arrival, the input of the theme operators."""
    reviews = spread_unsplit(src.reviews_raw(spark, sf).select("asin", "review_id", "reviewText"))
    known = isbn_map(spark, sf).withColumnRenamed("isbn", "asin")
    return reviews.join(known, "asin").select("best_book_id", "review_id", F.col("reviewText").alias("review_text"))


def recommender(spark: SparkSession, sf: str, **options) -> Recommender:
    job = Recommender(
        hold(src.ratings(spark, sf)), src.books(spark, sf), hold(classified(spark, sf)), src.item_factors(spark, sf), **options
    )
    HELD.append(job.release)
    return job


# Sources and cleaning


@query
def scan_reviews_json(spark, sf):
    fields = ["asin", "reviewerID", "helpful", "overall", "summary", "reviewText", "unixReviewTime"]
    lines = src.reviews_raw(spark, sf).select("review_id", F.to_json(F.struct(*fields)).alias("line"))
    return files.parse_reviews(lines).select(
        "review_id", "review.asin", F.col("review.reviewerID").alias("reviewer_id"),
        F.get("review.helpful", F.lit(0)).alias("helpful_yes"), F.get("review.helpful", F.lit(1)).alias("helpful_all"),
        "review.overall", "review.summary", F.col("review.reviewText").alias("review_text"),
        F.col("review.unixReviewTime").alias("unix_review_time"),
    )


@query
def reviews_json_errors(spark, sf):
    """Lines that are no reviews, kept and named."""
    return files.review_errors(files.parse_reviews(src.review_lines(spark, sf)), "review_id")


@query
def reviews_json_good(spark, sf):
    """The other lines, read in spite of them."""
    return files.parse_reviews(src.review_lines(spark, sf)).where("review IS NOT NULL").select(
        "review_id", "review.asin", F.col("review.overall").alias("overall"), F.length("review.reviewText").alias("n_chars"))


@query
def book_xml_flat(spark, sf):
    return files.flat_books(files.parse_book_pages(src.book_pages(spark, sf)))


@query
def book_xml_authors(spark, sf):
    return files.book_author_rows(files.parse_book_pages(src.book_pages(spark, sf)))


@query
def xml_errors(spark, sf):
    return files.page_errors(files.parse_book_pages(src.book_pages(spark, sf)))


@query
def shelf_xml_rows(spark, sf):
    return files.shelf_rows(src.shelf_pages(spark, sf))


@query
def author_worklist(spark, sf):
    """Author lists not yet visited; those of every tenth book are."""
    writers = src.book_authors(spark, sf)
    visited = resolve.author_worklist(writers.where("book_id % 10 = 0"))
    found = resolve.author_worklist(writers, visited)
    return found.select(F.concat_ws(",", F.col("author_ids").cast("array<string>")).alias("author_ids"), "book_id", "n_books")


@query
def books_english(spark, sf):
    return clean.english_books(src.books_detail(spark, sf))


@query
def books_enriched(spark, sf):
    return clean.enrich_books(clean.english_books(src.books_detail(spark, sf)), src.book_popularity(spark, sf))


@query
def authors_clean(spark, sf):
    domains = {"race": src.RACE_DOMAIN, "gender": src.GENDER_DOMAIN}
    return clean.clean_authors(src.authors_raw(spark, sf), domains)


@query
def isbn_map_clean(spark, sf):
    return isbn_map(spark, sf)


@query
def isbn_map_limited(spark, sf):
    return isbn_map_english(spark, sf)


@query
def isbn_map_union(spark, sf):
    found = src.ratings(spark, sf).select(
        src.isbn_of("book_id").alias("isbn"), (F.col("book_id") + src.FOREIGN_EDITION_OFFSET).alias("best_book_id")
    )
    return resolve.union_isbn_maps(isbn_map(spark, sf), found)


# Joins


@query
def books_labelled(spark, sf):
    return clean.label_books(src.books_detail(spark, sf), src.themes(spark, sf))


@query
def books_classified(spark, sf):
    return clean.classify_books(
        src.books_detail(spark, sf), src.book_authors(spark, sf), src.authors(spark, sf), src.themes(spark, sf)
    )


@query
def ratings_translated(spark, sf):
    return resolve.translate_ids(src.ratings_local(spark, sf), src.kaggle_ids(spark, sf))


@query
def ratings_translated_zero(spark, sf):
    return resolve.translate_ids(src.ratings_local(spark, sf), src.kaggle_ids(spark, sf), missing=0)


@query
def reviews_limited(spark, sf):
    return resolve.limited_reviews(src.reviews_raw(spark, sf), isbn_map(spark, sf))


@query
def review_ratings_limited(spark, sf):
    rows = resolve.limited_review_ratings(src.reviews_raw(spark, sf), isbn_map(spark, sf))
    return rows.withColumn("helpful", F.concat_ws("/", F.col("helpful").cast("array<string>")))


@query
def reviews_limited_full(spark, sf):
    rows = resolve.limited_reviews_full(src.reviews_raw(spark, sf), isbn_map(spark, sf))
    return rows.withColumn("helpful", F.concat_ws("/", F.col("helpful").cast("array<string>")))


@query
def unresolved_asins(spark, sf):
    return resolve.unresolved_asins(src.reviews_raw(spark, sf), isbn_map_english(spark, sf))


@query
def resolve_user_shelf(spark, sf):
    return resolve.resolve_shelf(src.shelf_raw(spark, sf), src.books(spark, sf), isbn_map(spark, sf))


@query
def shelf_coverage(spark, sf):
    return resolve.shelf_coverage(src.shelf_raw(spark, sf), src.books(spark, sf), isbn_map(spark, sf))


# Profiles and groups


@query
def group_share(spark, sf):
    return rounded(groups.group_share(classified(spark, sf)), "share")


def _user_group_share(spark, sf):
    return groups.user_group_share(src.ratings(spark, sf), classified(spark, sf), authors=src.authors(spark, sf))


@query
def user_group_share(spark, sf):
    return rounded(_user_group_share(spark, sf), "share")


@query
def group_share_display(spark, sf):
    return groups.group_share_display(_user_group_share(spark, sf))


@query
def group_boost(spark, sf):
    rows = groups.group_boost(src.ratings(spark, sf), classified(spark, sf))
    return rounded(rows, "gr_percentage", "user_percentage", "user_gr_perc", "user_gr_perc_norm")


@query
def category_share(spark, sf):
    return rounded(profile.category_share(src.ratings(spark, sf), src.books(spark, sf)), "share")


@query
def top_categories(spark, sf):
    ratings, books = src.ratings(spark, sf), src.books(spark, sf)
    return rounded(profile.top_categories(profile.category_share(ratings, books), ratings, books), "share")


def both_sources(spark, sf):
    main = src.ratings(spark, sf).select(
        F.lit("main").alias("source"), F.col("user_id").cast("string").alias("user_id"),
        F.col("rating").cast("double").alias("rating"),
    )
    review = resolve.limited_review_ratings(src.reviews_raw(spark, sf), isbn_map(spark, sf)).select(
        F.lit("review").alias("source"), "user_id", "rating"
    )
    return main.unionByName(review)


@query
def ratings_profile(spark, sf):
    return rounded(profile.star_profile(both_sources(spark, sf)), "share")


@query
def books_per_user(spark, sf):
    return rounded(profile.books_per_user(both_sources(spark, sf)), "books_per_user")


@query
def top_rated_slice(spark, sf):
    return profile.with_top_slice(src.ratings(spark, sf)).where("is_top").select(
        "user_id", "book_id", "rating", F.round("limit", DECIMALS).alias("limit")
    )


@query
def rmse_overall_top(spark, sf):
    parts = splits.split_rows(src.ratings(spark, sf))
    train, test = (parts.where(F.col("split") == s) for s in ("train", "test"))
    return rounded(profile.evaluate(profile.predict_book_mean(train, test)), "rmse", "rmse_top_5")


# Splits


@query
def split_rows(spark, sf):
    return splits.split_rows(src.ratings(spark, sf))


@query
def split_users(spark, sf):
    return splits.split_users(src.ratings(spark, sf))


@query
def sample_users(spark, sf):
    return splits.sample_users(src.ratings(spark, sf))


# Fold-in, scoring, rankings


@query
def foldin_nonneg(spark, sf):
    vectors = foldin.foldin_nonneg(src.ratings(spark, sf), src.item_factors(spark, sf))
    return rounded(foldin.factors_long(vectors).select("user_id", "dim", "value"), "value")


@query
def foldin_gradient(spark, sf):
    vectors = foldin.foldin_gradient(src.ratings(spark, sf), src.item_factors(spark, sf))
    return rounded(foldin.factors_long(vectors).select("user_id", "dim", "value"), "value")


@query
def item_index(spark, sf):
    """Gapless numbers of the order keys, which lie apart."""
    return dense_index(src.table(spark, sf, "orders").select(F.col("o_orderkey").alias("order_id")), "order_id")


@query
def foldin_nonneg_chunked(spark, sf):
    """foldin_nonneg with ratings in chunks and items sent range by range."""
    vectors = foldin.foldin_nonneg(
        src.ratings(spark, sf), src.item_factors(spark, sf), chunk_limit=SMALL_CHUNK, broadcast_limit=SMALL_BLOCK)
    return rounded(foldin.factors_long(vectors).select("user_id", "dim", "value"), "value")


@query
def foldin_gradient_chunked(spark, sf):
    """foldin_gradient with a tree product over chunks and items sent range by range."""
    vectors = foldin.foldin_gradient(
        src.ratings(spark, sf), src.item_factors(spark, sf), chunk_limit=SMALL_CHUNK, broadcast_limit=SMALL_BLOCK)
    return rounded(foldin.factors_long(vectors).select("user_id", "dim", "value"), "value")


def _grid_errors(spark, sf):
    ratings, items = src.ratings(spark, sf), src.item_factors(spark, sf)
    vectors = foldin.foldin_nonneg(ratings, items, GRID_ALPHAS, GRID_ITERATIONS)
    return foldin.foldin_error(ratings, items, vectors)


@query
def foldin_error(spark, sf):
    return rounded(_grid_errors(spark, sf), "error", decimals=5)


@query
def best_config(spark, sf):
    grid_place = [
        F.array_position(F.array(*[F.lit(v) for v in values]), F.col(name))
        for name, values in (("alpha", GRID_ALPHAS), ("iterations", GRID_ITERATIONS))
    ]
    place = grid_place[0] * len(GRID_ITERATIONS) + grid_place[1]
    means = _grid_errors(spark, sf).groupBy("alpha", "iterations").agg(F.avg("error").alias("error"))
    best = als.best_config(rounded(means, "error", decimals=5).withColumn("position", place), "error")
    return best.drop("position")


@query
def score_items(spark, sf):
    ratings, items = src.ratings(spark, sf), src.item_factors(spark, sf)
    vectors = foldin.foldin_nonneg(ratings, items).select("user_id", "features")
    catalogue = scoring.plan_catalogue(items.withColumnRenamed("id", "item_id"))
    HELD.append(catalogue.items.unpersist)
    return scoring.score_top(vectors, catalogue, 50)


@query
def score_items_blocked(spark, sf):
    """score_items with the catalogue sent block by block."""
    ratings, items = src.ratings(spark, sf), src.item_factors(spark, sf)
    vectors = foldin.foldin_nonneg(ratings, items).select("user_id", "features")
    catalogue = scoring.plan_catalogue(items.withColumnRenamed("id", "item_id"), SMALL_BLOCK)
    HELD.append(catalogue.items.unpersist)
    return scoring.score_top(vectors, catalogue, 50)


@query
def unread_candidates(spark, sf):
    ratings, items = src.ratings(spark, sf), src.item_factors(spark, sf)
    vectors = foldin.foldin_nonneg(ratings, items).select("user_id", "features")
    catalogue = scoring.plan_catalogue(items.withColumnRenamed("id", "item_id"))
    HELD.append(catalogue.items.unpersist)
    return scoring.score_top(vectors, catalogue, 50, scoring.read_lists(ratings, catalogue))


@query
def rank_similarity(spark, sf):
    ratings, items = src.ratings(spark, sf), src.item_factors(spark, sf)
    vectors = foldin.foldin_nonneg(ratings, items, GRID_ALPHAS)
    pairs = vectors.groupBy("user_id").agg(
        F.min_by("features", "alpha").alias("features_a"), F.max_by("features", "alpha").alias("features_b")
    )
    return rounded(rankings.factor_overlap(pairs, items, items), "overlap")


@query
def rank_overlap_top(spark, sf):
    job = recommender(spark, sf)
    job.keep()
    # The overlap reads a list for its lengths and for its rows; scoring makes it once.
    lists = [
        stored(job.top(TOP_N, boosted=b).select(
            "user_id", F.struct("best_book_id", "author_id").alias("item_id"), "position"
        ), "overlap-list")
        for b in (True, False)
    ]
    return rounded(rankings.average_overlap(*lists, depth=TOP_N), "overlap")


# Recommendations


@query
def recommend_topk(spark, sf):
    return rounded(recommender(spark, sf).top(TOP_N), "rating_guess", "boost", "boosted_rating")


@query
def recommend_topk_blocked(spark, sf):
    """recommend_topk with the catalogue sent block by block."""
    return rounded(recommender(spark, sf, broadcast_limit=SMALL_BLOCK).top(TOP_N), "rating_guess", "boost", "boosted_rating")


@query
def recommend_unboosted(spark, sf):
    rows = recommender(spark, sf).top(TOP_N, boosted=False).drop("boosted_rating")
    return rounded(rows, "rating_guess", "boost")


@query
def recommend_final(spark, sf):
    return rounded(recommender(spark, sf).final(), "boosted_rating")


@query
def topk_per_category(spark, sf):
    return rounded(recommender(spark, sf).by_category(TOP_N), "boosted_rating")


@query
def recommend_from_shelf(spark, sf):
    rows = recommend_shelves(
        src.shelf_raw(spark, sf), src.books(spark, sf), isbn_map(spark, sf), hold(classified(spark, sf)),
        src.item_factors(spark, sf), TOP_N,
    )
    return rounded(rows, "boosted_rating")


# ALS: factors are not a matter of SQL, so these queries return what SQL can tell of them: which ids have factors, which
# rows get which fallback, that vectors are optimal, that metrics are finite and the chosen setting the best of its table.


def finite(column: str):
    return F.coalesce(~F.isnan(column) & (F.abs(column) < F.lit(float("inf"))), F.lit(False))


@query
def als_factors(spark, sf):
    ratings = hold(src.ratings(spark, sf))
    model = als.train(ratings)
    solved = als.optimality(ratings, model.userFactors, model.itemFactors)
    store = FactorStore(spark, scratch_path(spark, "factors"))
    store.save_model(model, als.RANK, "all")
    users = store.load(als.RANK, "all", USER).join(solved, F.col("id") == F.col("user_id"), "left")
    columns = ["id", F.size("features").alias("n_factors"), F.forall("features", lambda x: x >= 0).alias("nonnegative")]
    users = users.select(F.lit(USER).alias("side"), *columns, "n_ratings", "optimal")
    items = store.load(als.RANK, "all", ITEM).select(
        F.lit(ITEM).alias("side"), *columns, F.lit(None).cast("bigint").alias("n_ratings"), F.lit(None).cast("boolean").alias("optimal"))
    return users.unionByName(items)


def _als_rows(spark, sf):
    # Counts, fit, means and lookups all read the ratings; they are derived from the lines once.
    parts = splits.split_rows(stored(src.ratings(spark, sf), "ratings"))
    return tuple(parts.where(F.col("split") == s).drop("split") for s in ("train", "test"))


@query
def als_predict(spark, sf):
    train, test = _als_rows(spark, sf)
    known = [train.select(c, F.lit(True).alias(f"has_{c}")).distinct() for c in ("user_id", "book_id")]
    rows = als.predict(als.train(train), train, test).join(known[0], "user_id", "left").join(known[1], "book_id", "left")
    fallback = F.when(F.col("has_user_id").isNull() | F.col("has_book_id").isNull(), F.round("prediction", DECIMALS))
    return rows.select("user_id", "book_id", "rating", fallback.alias("fallback"), (finite("prediction") & (F.col("prediction") >= 0)).alias("usable"))


@query
def als_eval(spark, sf):
    train, test = _als_rows(spark, sf)
    rows = profile.with_top_slice(als.predict(als.train(train), train, test))
    found = rows.agg(F.count("*").alias("n_rows"), F.count_if("is_top").alias("n_top"), *profile.rmse_columns())
    return found.select("n_rows", "n_top", finite("rmse").alias("rmse_finite"), finite("rmse_top_5").alias("rmse_top_5_finite"))


@query
def predict_from_store(spark, sf):
    """Every rating predicted from matrices read back from a store: the item vectors and the folded-in users."""
    ratings, items = hold(src.ratings(spark, sf)), src.item_factors(spark, sf)
    store = FactorStore(spark, scratch_path(spark, "factors"))
    store.save(items, 64, "all", ITEM)
    store.save(foldin.foldin_nonneg(ratings, items).withColumnRenamed("user_id", "id"), 64, "all", USER)
    mean = ratings.agg(F.avg("rating")).scalar()
    return rounded(store.predict(ratings, 64, "all", mean), "prediction")


#: Results that several queries of one session ask for, by application, tables and kind: 80 fits are made once.
SHARED: dict[tuple[str, str, str], object] = {}


def shared(fn):
    def run(spark: SparkSession, sf: str):
        key = (spark.sparkContext.applicationId, sf, fn.__name__)
        if key not in SHARED:
            SHARED[key] = fn(spark, sf)
        return SHARED[key]

    return run


def _user_parts(spark, sf):
    parts = splits.split_users(src.ratings(spark, sf))
    train = parts.where("split = 'train'").drop("split")
    val = parts.where("split = 'val'").drop("split")
    return train, val, train.unionByName(val)


@shared
def _flat_metrics(spark, sf):
    train, test = _als_rows(spark, sf)
    path = scratch_path(spark, "factors")
    metrics = als.grid_search(train, test, als.GRID_REG_PARAMS, als.GRID_RANKS, path)
    return stored(metrics, "als-metrics"), FactorStore(spark, path)


@shared
def _rank_grid(spark, sf):
    train, _, train_val = _user_parts(spark, sf)
    path = scratch_path(spark, "factors")
    metrics = als.grid_search_per_rank(train, train_val, als.GRID_REG_PARAMS, als.GRID_RANKS, path)
    return stored(metrics, "rank-metrics"), FactorStore(spark, path)


@shared
def _foldin_metrics(spark, sf):
    _, store = _rank_grid(spark, sf)
    models = {
        rank: tuple(store.load(rank, *key) for key in (("train", ITEM), ("test", ITEM), ("test", USER))) for rank in als.GRID_RANKS
    }
    return stored(grids.foldin_grid(_user_parts(spark, sf)[1], models, grids.GRID_ALPHAS, grids.GRID_ITERATIONS), "foldin-metrics")


def _best_of(metrics: DataFrame, metric: str, ascending: bool, *settings: str) -> DataFrame:
    """Checks of the best setting against its whole table: no other is better, no equal one comes before it."""
    best = als.best_config(metrics, metric, ascending).select(*settings, F.col(metric).alias("best"), F.col("position").alias("place"))
    better = F.col(metric) < F.col("best") if ascending else F.col(metric) > F.col("best")
    earlier = (F.col(metric) == F.col("best")) & (F.col("position") < F.col("place"))
    return metrics.select(metric, "position").join(F.broadcast(best)).groupBy(*settings).agg(
        F.count("*").alias("n_settings"), F.count_if(better).alias("n_better"), F.count_if(earlier).alias("n_earlier"))


@query
def als_grid(spark, sf):
    """Every setting's fit, its matrices stored under the split grid-<reg_param>, and its errors."""
    return _flat_metrics(spark, sf)[0].select(
        "position", "rank", "reg_param", finite("rmse").alias("rmse_finite"), finite("rmse_top_5").alias("rmse_top_5_finite"))


@query
def als_grid_best(spark, sf):
    """The published grid's best setting by the error of the top slice, as counts that prove it."""
    best = _best_of(_flat_metrics(spark, sf)[0], "rmse_top_5", True, "rank", "reg_param")
    inside = F.col("rank").isin(als.GRID_RANKS) & F.col("reg_param").isin(als.GRID_REG_PARAMS)
    return best.select("n_settings", "n_better", "n_earlier", inside.alias("in_grid"))


@query
def als_grid_per_rank(spark, sf):
    metrics, store = _rank_grid(spark, sf)
    best = als.best_config(metrics, "rmse_top_5", within=["rank"])
    return best.select("rank", F.col("reg_param").isin(als.GRID_REG_PARAMS).alias("in_grid"), finite("rmse_top_5").alias("rmse_top_5_finite")).join(
        store.sizes(), "rank")


@query
def foldin_grid(spark, sf):
    similar = (F.col("rank_sim") > 0) & (F.col("rank_sim") <= 1) | F.col("rank_sim").isNull() & (F.col("n_users") == 0)
    return _foldin_metrics(spark, sf).select(
        "rank", "negative", "iterations", "alpha", "position", (F.col("n_users") + F.col("n_diverged")).alias("n_users"),
        (F.col("negative") | (F.col("n_diverged") == 0)).alias("converged"), similar.alias("similarity_in_range"))


@query
def foldin_grid_best(spark, sf):
    """The published fold-in grid's best setting by rank similarity, as counts that prove it."""
    best = _best_of(_foldin_metrics(spark, sf), "rank_sim", False, "rank", "negative", "iterations", "alpha")
    return best.select("n_settings", "n_better", "n_earlier", F.col("rank").isin(als.GRID_RANKS).alias("in_grid"))


@query
def foldin_coverage(spark, sf):
    """What a grid over the supplied vectors leaves out: the items with even ids stand for the other matrix."""
    ratings, items = src.ratings(spark, sf), src.item_factors(spark, sf)
    users = foldin.foldin_nonneg(ratings.where("user_id % 7 <> 0"), items).select(F.col("user_id").alias("id"), "features")
    found = grids.foldin_coverage(ratings, items, items.where("id % 2 = 0"), users, [0.01], [100])
    return found.where("NOT negative").drop("n_diverged").unionByName(found.where("negative").drop("n_diverged"))


@query
def recommend_from_als(spark, sf):
    """Trained factors to lists: train, store, fold new users into the stored items, recommend; each row with its checks."""
    parts = splits.split_users(src.ratings(spark, sf))
    train, new = hold(parts.where("split <> 'test'").drop("split")), hold(parts.where("split = 'test'").drop("split"))
    path, rank = scratch_path(spark, "factors"), als.GRID_RANKS[-1]
    FactorStore(spark, path).save_model(als.train(train, rank=rank), rank, "test")
    items = FactorStore(spark, path).load(rank, "test", ITEM)
    job = Recommender(new, src.books(spark, sf), hold(classified(spark, sf)), items)
    HELD.append(job.release)
    rows = job.final(20)
    read = new.select("user_id", F.col("book_id").alias("best_book_id"), F.lit(True).alias("read"))
    trained = train.select(F.col("book_id").alias("best_book_id"), F.lit(True).alias("trained")).distinct()
    before = F.lag("boosted_rating").over(Window.partitionBy("user_id").orderBy("position"))
    return rows.withColumn("before", before).join(read, ["user_id", "best_book_id"], "left").join(trained, "best_book_id", "left").select(
        "user_id", "position", F.col("read").isNull().alias("unread"), F.col("trained").isNotNull().alias("trained"),
        (~F.col("k_label").eqNullSafe(8)).alias("shown"),
        F.coalesce(F.col("before") >= F.col("boosted_rating"), F.col("position") == 1).alias("in_order"))


# Themes


@query
def reviews_by_book(spark, sf):
    return themes.reviews_by_book(limited(spark, sf))


@query
def review_tokens(spark, sf):
    return themes.term_counts(themes.review_tokens(limited(spark, sf)))


@query
def review_lemmas(spark, sf):
    return themes.word_lemmas(themes.review_tokens(limited(spark, sf)))


def _weights(spark, sf):
    """TF-IDF weights of the reviewed books in long form, those books, and the vocabulary."""
    split = stored(themes.review_words(limited(spark, sf)), "review-words")
    counts = hold(themes.vocabulary_counts(split))
    books = hold(split.select("best_book_id").distinct())
    vocab = themes.vocabulary(counts)
    return themes.tfidf_long(counts, vocab, books.agg(F.count("*")).scalar()), books, vocab


@query
def review_tfidf(spark, sf):
    return rounded(_weights(spark, sf)[0], "weight")


def _clusters(spark, sf, k):
    """Every book with its checks: a label in range, and no other centre nearer."""
    weights, books, vocab = _weights(spark, sf)
    words = [r["word"] for r in vocab.collect()]
    weights = hold(weights)
    model, labels = themes.cluster(hold(themes.to_vectors(weights, books, words)), k)
    return themes.nearest_checks(weights, books, words, model, labels, k)


@query
def review_clusters(spark, sf):
    return _clusters(spark, sf, themes.CLUSTERS)


@query
def review_clusters_10(spark, sf):
    return _clusters(spark, sf, 10)


# Labels of a clustering carry no meaning, so the descriptions of themes are shown on the given label table.


@query
def cluster_sizes(spark, sf):
    return themes.cluster_sizes(src.themes(spark, sf))


@query
def cluster_terms(spark, sf):
    return themes.theme_terms(_weights(spark, sf)[0], src.themes(spark, sf), 15)


@query
def cluster_titles(spark, sf):
    return themes.cluster_titles(src.themes(spark, sf), src.books(spark, sf), 15)
