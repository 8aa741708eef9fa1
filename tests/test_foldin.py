import numpy as np
import pytest

from tomewise.operators import foldin

RANK = 5


def tables(spark, ids, seed=0, zero_id=None):
    rng = np.random.default_rng(seed)
    items = {i: (np.zeros(RANK) if i == zero_id else rng.normal(size=RANK)) for i in ids}
    rows = []
    for user in range(4):
        for i in ids:
            if user == 0 or rng.random() < 0.5:
                rows.append((user, i, int(rng.integers(1, 6))))
    rows.append((9, 10**9, 4))  # knows only an item without factors
    rows.append((0, 10**9, 4))
    ratings = spark.createDataFrame(rows, "user_id long, book_id long, rating int")
    factors = spark.createDataFrame(
        [(i, [float(x) for x in v]) for i, v in items.items()], "id long, features array<double>"
    )
    return ratings, factors, sorted(rows), items


def loop_nonneg(rows, items, user, alpha, passes):
    u = np.full(RANK, foldin.START)
    for _ in range(passes):
        for who, book, r in rows:
            if who == user and book in items:
                v = items[book]
                t = np.linalg.pinv(v.reshape(1, -1)) @ np.array([r])
                u = u * (1 - alpha) + np.clip(t, foldin.EPS, None) * alpha
    return u


def loop_gradient(rows, items, user, alpha, passes):
    u = np.full(RANK, foldin.START)
    for _ in range(passes):
        for who, book, r in rows:
            if who == user and book in items:
                v = items[book]
                u = u + 2 * alpha * v * (r - u @ v)
    return u


SPREAD_IDS = [3, 7, 70_000, 70_001, 140_000, 900_000]


@pytest.mark.parametrize("chunk_limit", [foldin.CHUNK_LIMIT, 1])
@pytest.mark.parametrize(
    "method, loop", [(foldin.foldin_nonneg, loop_nonneg), (foldin.foldin_gradient, loop_gradient)]
)
def test_equals_the_pass_by_pass_loop(spark, method, loop, chunk_limit):
    ratings, factors, rows, items = tables(spark, SPREAD_IDS, zero_id=70_001)
    got = method(ratings, factors, [0.01, 0.05], [1, 7], chunk_limit=chunk_limit).collect()
    assert {r["user_id"] for r in got} == {0, 1, 2, 3}
    assert len(got) == 4 * 4
    for r in got:
        want = loop(rows, items, r["user_id"], r["alpha"], r["iterations"])
        np.testing.assert_allclose(r["features"], want, rtol=1e-9, atol=1e-12)


def test_gradient_with_one_rating_reaches_it(spark):
    ratings = spark.createDataFrame([(1, 1, 4)], "user_id long, book_id long, rating int")
    factors = spark.createDataFrame([(1, [0.6, 0.8])], "id long, features array<double>")
    u = foldin.foldin_gradient(ratings, factors, [0.1], [500]).head()["features"]
    assert abs(0.6 * u[0] + 0.8 * u[1] - 4) < 1e-9


def test_nonneg_is_positive_and_error_is_mean_squared_residual(spark):
    ratings, factors, rows, items = tables(spark, SPREAD_IDS)
    vectors = foldin.foldin_nonneg(ratings, factors)
    errors = {r["user_id"]: r for r in foldin.foldin_error(ratings, factors, vectors).collect()}
    for r in vectors.collect():
        assert min(r["features"]) > 0
        known = [(b, x) for u, b, x in rows if u == r["user_id"] and b in items]
        want = np.mean([(x - np.dot(r["features"], items[b])) ** 2 for b, x in known])
        assert errors[r["user_id"]]["error"] == pytest.approx(want)
        assert errors[r["user_id"]]["n_known"] == len(known)
