"""Gapless numbers, fold-in over chunks, factor stores, optimality and coverage on small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomewise.functions.tables import dense_index
from tomewise.operators import als, foldin
from tomewise.plans import grids
from tomewise.sources.factors import ITEM, USER, FactorStore

RANK = 5


@pytest.mark.parametrize("partitions", [1, 7, 40])
def test_dense_index_numbers_distinct_values_in_order(spark, partitions):
    values = [5, -3, 5, None, 1 << 40, 7, 0, 1 << 20] + list(range(100, 160))
    rows = spark.createDataFrame([(v, 1) for v in values], "id long, place long")
    got = {r["id"]: r["place"] for r in dense_index(rows, "id", partitions).collect()}
    assert got == {v: i for i, v in enumerate(sorted({v for v in values if v is not None}))}
    assert dense_index(rows.where("id = 2"), "id").collect() == []


def sparse_tables(spark, n_items=300, users=3):
    """Items 2^20 apart."""
    rng = np.random.default_rng(4)
    ids = [i << 20 for i in range(n_items)]
    items = {i: rng.normal(size=RANK) * 0.4 for i in ids}
    ratings = [(u, i, int(rng.integers(1, 6))) for u in range(users) for i in ids if rng.random() < 0.6]
    return (
        spark.createDataFrame(ratings, "user_id long, book_id long, rating int"),
        spark.createDataFrame([(i, [float(x) for x in v]) for i, v in items.items()], "id long, features array<double>"),
        sorted(ratings), items,
    )


def test_far_apart_ids_make_few_chunks(spark):
    ratings, factors, _, _ = sparse_tables(spark)
    layout = foldin.Layout(ratings, factors, 100, foldin.BROADCAST_LIMIT)
    lists = layout.lists.collect()
    assert layout.chunks == 3 and len(lists) == 9
    assert max(len(r["books"]) for r in lists) <= 100
    assert all(r["books"] == sorted(r["books"]) for r in lists)


@pytest.mark.parametrize("chunk_limit, broadcast_limit, fan_in", [(1 << 16, 1 << 27, 16), (7, 1 << 27, 2), (40, 1, 3)])
def test_gradient_equals_rating_by_rating_loop(spark, monkeypatch, chunk_limit, broadcast_limit, fan_in):
    monkeypatch.setattr(foldin, "TREE_FAN_IN", fan_in)
    ratings, factors, rows, items = sparse_tables(spark)
    got = foldin.foldin_gradient(ratings, factors, [0.02], [3], chunk_limit=chunk_limit, broadcast_limit=broadcast_limit)
    for r in got.collect():
        u = np.full(RANK, foldin.START)
        for _ in range(3):
            for who, book, star in rows:
                if who == r["user_id"]:
                    u = u + 0.04 * items[book] * (star - u @ items[book])
        np.testing.assert_allclose(r["features"], u, rtol=1e-9)
    assert got.count() == 3


@pytest.mark.parametrize("method", [foldin.foldin_nonneg, foldin.foldin_gradient])
@pytest.mark.parametrize("broadcast_limit", [1, 1 << 27])
def test_chunks_are_dealt_out_in_one_pass_and_give_the_same_vectors(spark, method, broadcast_limit):
    """Users with short, long and many chunks; one without an id. No table is written for a range of chunks."""
    ratings, factors, _, _ = sparse_tables(spark, users=2)
    few = spark.createDataFrame([(u, i << 20, 4) for u in (7, 8, None) for i in (3, 150, 151, 299)], ratings.schema)
    ratings = ratings.unionByName(few)
    want = {(r["user_id"], r["iterations"]): r["features"] for r in method(ratings, factors, [0.02], [1, 3]).collect()}
    ranges = []
    stored, foldin.stored = foldin.stored, lambda df, name: ranges.append(name) or stored(df, name)
    try:
        found = method(ratings, factors, [0.02], [1, 3], chunk_limit=4, broadcast_limit=broadcast_limit).collect()
    finally:
        foldin.stored = stored
    assert ranges == ["foldin-items"]
    assert len(found) == len(want) == 10
    for r in found:
        np.testing.assert_allclose(r["features"], want[r["user_id"], r["iterations"]], rtol=1e-9)


def test_a_short_chunk_travels_as_its_ratings(spark):
    """A chunk of two ratings needs two vectors, not a map of rank x rank."""
    ratings, factors, _, _ = sparse_tables(spark)
    sizes = []
    whole, foldin._whole_users = foldin._whole_users, lambda parts, *a: sizes.extend(
        r["n"] for r in parts.select(F.size("a").alias("n")).collect()) or whole(parts, *a)
    try:
        assert foldin.foldin_gradient(ratings, factors, [0.02], [3], chunk_limit=2).count() == 3
    finally:
        foldin._whole_users = whole
    assert max(sizes) <= 2 * RANK


def test_block_maps_equal_the_composed_maps():
    rng = np.random.default_rng(0)
    v, r = rng.normal(size=(3, 8, 4)), rng.normal(size=(3, 8))
    v[2, 5:], r[2, 5:] = 0, 0
    a, b = foldin.block_maps(v, r, 0.05)
    for i in range(3):
        want_a, want_b = np.eye(4), np.zeros(4)
        for x, star in zip(v[i], r[i]):
            step = np.eye(4) - 0.1 * np.outer(x, x)
            want_a, want_b = step @ want_a, step @ want_b + 0.1 * star * x
        np.testing.assert_allclose(a[i], want_a, atol=1e-12)
        np.testing.assert_allclose(b[i], want_b, atol=1e-12)
    whole_a, whole_b = foldin.tree_product(a, b, np.array([0, 0, 0]))
    np.testing.assert_allclose(whole_a[0], a[2] @ a[1] @ a[0], atol=1e-12)
    np.testing.assert_allclose(whole_b[0], a[2] @ (a[1] @ b[0] + b[1]) + b[2], atol=1e-12)
    apart_a, _ = foldin.tree_product(a, b, np.array([0, 0, 1]))
    np.testing.assert_allclose(apart_a[1], a[2])


def test_gradient_that_diverges_is_not_finite_and_keeps_its_row(spark):
    ratings = spark.createDataFrame([(1, 1, 4), (1, 2, 5)], "user_id long, book_id long, rating int")
    factors = spark.createDataFrame([(1, [9.0, 9.0]), (2, [9.0, -8.0])], "id long, features array<double>")
    row = foldin.foldin_gradient(ratings, factors, [0.1], [1000]).head()
    assert not np.isfinite(row["features"]).all()


@pytest.fixture(scope="module")
def ratings(spark):
    rng = np.random.default_rng(5)
    rows = [(u, b, int(rng.integers(1, 6))) for u in range(25) for b in range(20) if rng.random() < 0.5]
    return spark.createDataFrame(rows, "user_id long, book_id long, rating int").cache()


def test_store_reads_one_matrix_and_predicts_without_a_model(spark, ratings, tmp_path):
    store = FactorStore(spark, str(tmp_path / "store"))
    model = als.train(ratings, rank=3, max_iter=3)
    store.save_model(model, 3, "train")
    store.save_model(als.train(ratings, rank=4, max_iter=1), 4, "test")
    store.save_model(model, 3, "train")  # replaces itself and nothing else
    sizes = {(r["rank"], r["split"], r["side"]): r["n_factors"] for r in store.sizes().collect()}
    assert sizes == {(k, s, d): n for k, s in ((3, "train"), (4, "test")) for d, n in (("item", 20), ("user", 25))}
    plan = spark.read.parquet(store.path).where("rank = 3 AND split = 'train' AND side = 'item'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(rank" in plan
    rows = spark.createDataFrame([(1, 1, 5), (999, 1, 3), (2, None, 1), (1, 1, 5)], "user_id long, book_id long, rating int")
    got = store.predict(rows.withColumn("features", F.lit("clash")), 3, "train", F.lit(2.5)).collect()
    live = model.transform(rows.where("user_id = 1")).head()["prediction"]
    assert sorted((r["user_id"], r["known"], round(r["prediction"], 4)) for r in got) == [
        (1, True, round(live, 4)), (1, True, round(live, 4)), (2, False, 2.5), (999, False, 2.5)]
    with pytest.raises(ValueError):
        store.load(5, "train", ITEM)


def test_no_vector_travels_with_a_stored_prediction_row(spark, tmp_path):
    """A row's shuffle holds its keys and columns; repeated rows and ids that a matrix repeats stay as they were."""
    store = FactorStore(spark, str(tmp_path / "store"))
    items = spark.createDataFrame([(b, [1.0 * b, 2.0]) for b in (1, 2, 3, 3, 9)], "id long, features array<double>")
    users = spark.createDataFrame([(u, [0.5, 1.0 * u]) for u in (1, 2)], "id long, features array<double>")
    store.save(items, 2, "all", ITEM)
    store.save(users, 2, "all", USER)
    pairs = [(1, 1), (1, 1), (1, 3), (2, 9), (2, 4), (3, 1), (None, 1), (1, None)]
    rows = spark.createDataFrame([(u, b, i) for i, (u, b) in enumerate(pairs)], "user_id long, book_id long, rating int")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = store.predict(rows, 2, "all", F.lit(-1.0))
        nodes = found._jdf.queryExecution().explainString(
            spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")).split("\n\n")
        got = sorted((r["rating"], r["known"], r["prediction"]) for r in found.collect())
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    sent = [node for node in nodes if "Exchange" in node.split("\n")[0] and "rating#" in node]
    assert sent and not [node for node in sent if any(c in node for c in ("_u#", "_v#", "features#"))]
    assert got == [(0, True, 2.5), (1, True, 2.5), (2, True, 3.5), (2, True, 3.5), (3, True, 8.5)] + [(i, False, -1.0) for i in (4, 5, 6, 7)]


def test_optimality_tells_solved_vectors_from_others(spark, ratings):
    model = als.train(ratings, rank=3, max_iter=4)
    solved = als.optimality(ratings, model.userFactors, model.itemFactors)
    assert solved.where("optimal").count() == 25
    moved = model.userFactors.withColumn("features", F.transform("features", lambda x: x + F.lit(0.2).cast("float")))
    assert als.optimality(ratings, moved, model.itemFactors).where("optimal").count() == 0


def test_optimality_neither_sorts_ratings_nor_widens_vectors(spark):
    ratings = spark.createDataFrame(
        [(1, 1, 5), (1, 2, 1), (2, 2, 4), (2, 9, 1), (3, 1, 2), (3, 1, 2), (None, 1, 3), (1, None, 3)], "user_id long, book_id long, rating int")
    items = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "id int, features array<float>")
    # Of user 2 the first dimension has no rating, so it must be 0; item 9 has no vector and counts nowhere.
    users = spark.createDataFrame(
        [(1, [5 / 1.2, 1 / 1.2]), (2, [0.0, 4 / 1.1]), (3, [4 / 2.4, 0.0]), (4, [1.0, 1.0])], "id int, features array<float>")
    solved = als.optimality(ratings, users, items)
    assert sorted(tuple(r) for r in solved.collect()) == [(1, 2, True), (2, 1, True), (3, 2, False)]
    plan = solved._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ShuffledHashJoin") == 2 and "SortMergeJoin" not in plan and "SortAggregate" not in plan
    assert "array<double>" not in plan


def test_coverage_counts_what_a_grid_leaves_out(spark):
    ratings = spark.createDataFrame([(u, b, 3) for u in range(4) for b in range(5)], "user_id long, book_id long, rating int")
    train = spark.createDataFrame([(b, [1.0, 9.0 * b]) for b in range(1, 4)], "id long, features array<double>")
    test = spark.createDataFrame([(b, [1.0, 1.0]) for b in range(2, 5)], "id long, features array<double>")
    users = spark.createDataFrame([(u, [0.5, 0.5]) for u in range(3)], "id long, features array<double>")
    found = {r["negative"]: r for r in grids.foldin_coverage(ratings, train, test, users, [0.1], [2000]).collect()}
    for r in found.values():
        assert (r["n_ratings"], r["n_without_factors"], r["n_dropped_items"]) == (20, 8, 2)
        assert (r["n_folded"], r["n_untrained"]) == (4, 1)
    assert found[True]["n_diverged"] == 4 and found[False]["n_diverged"] == 0
    # The rows of diverged users stay in the grid.
    grid = grids.foldin_grid(ratings, {2: (train, test, users)}, [0.1], [2000]).collect()
    assert {(r["negative"], r["n_users"], r["n_diverged"]) for r in grid} == {(True, 0, 3), (False, 3, 0)}
