"""Operators on vectors against brute force, with awkward rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomewise.llm import crosspoly, egojoin

SCHEMA = "vec_id long, embedding array<double>, label int"


def clustered(n, dim, seed, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 1, (n // 6, dim))
    rows = centres[rng.integers(0, len(centres), n)] + spread * rng.normal(0, 1, (n, dim)) * rng.random((n, 1)) * 2
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, x if x is None else [None if v is None else float(v) for v in x], 0) for i, x in rows], SCHEMA)


def odd_rows(dim):
    nan, inf = float("nan"), float("inf")
    return [(1000, None), (1001, []), (1002, [0.0] * dim), (1003, [nan] + [1.0] * (dim - 1)), (1004, [inf] + [1.0] * (dim - 1)),
            (1005, [None] + [1.0] * (dim - 1)), (1006, [1.0] * (dim + 1)), (None, [1.0] * dim)]


def groups_by_hand(ids, rows, cosine):
    u = rows / np.linalg.norm(rows, axis=1, keepdims=True)
    linked = u @ u.T >= cosine
    np.fill_diagonal(linked, False)
    label = np.arange(len(ids))
    while True:
        low = np.minimum(label, np.where(linked, label[None, :], len(ids)).min(axis=1))
        if (low == label).all():
            break
        label = low
    return {i: (int(k), int(ids[c]), i == ids[c]) for i, k, c in zip(ids, linked.sum(1), label)}


@pytest.mark.parametrize("interval, leaf", [(4096, 512), (16, 4)])
def test_grid_order_join_matches_brute_force(spark, monkeypatch, interval, leaf):
    monkeypatch.setattr(egojoin, "LEAF", leaf)
    rows = clustered(160, 12, 1)
    rows[40:50] = rows[3]  # equal vectors
    rows[70] = 7 * rows[3]  # the same direction
    got = egojoin.cosine_groups(
        frame(spark, list(enumerate(rows)) + odd_rows(12)).withColumn("block", F.lit("clash")).withColumn("id", F.lit("clash")),
        interval=interval, dimensions=3)
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in got.collect()}
    want = groups_by_hand(np.arange(160), rows, 0.9)
    assert {k: v for k, v in found.items() if k is not None and k < 1000} == want
    assert all(found[i] == (0, i, True) for i in range(1000, 1007)) and found[None] == (0, None, False)


def test_grid_order_join_repeated_rows_and_empty_table(spark):
    rows = list(enumerate(clustered(30, 8, 2)))
    df = frame(spark, rows)
    once = {tuple(r) for r in egojoin.cosine_groups(df).collect()}
    assert {tuple(r) for r in egojoin.cosine_groups(df.union(df)).collect()} == once
    assert egojoin.cosine_groups(df.limit(0)).count() == 0
    assert egojoin.cosine_groups(frame(spark, odd_rows(8))).count() == 8


def test_skipped_intervals_are_apart():
    rng = np.random.default_rng(3)
    a, b = rng.normal(0, 1, (200, 5)), rng.normal(0, 1, (200, 5)) + 1.0
    axes = egojoin.principal_axes(np.concatenate((a, b)), 2)
    ids = [np.arange(200), np.arange(200, 400)]
    weights = [np.ones(200, dtype=np.int64)] * 2
    every, count, edges = egojoin.join_intervals(ids, weights, [a, b], axes, 0.9, False)
    ua, ub = (x / np.linalg.norm(x, axis=1, keepdims=True) for x in (a, b))
    linked = ua @ ub.T >= 0.9
    assert count.tolist() == np.concatenate((linked.sum(1), linked.sum(0))).tolist()
    assert set(edges.ravel()) <= set(every)


def neighbours_by_hand(ids, rows, queries, k):
    out = {}
    for q in queries:
        score = (rows * rows[q]).sum(axis=1)
        order = sorted((i for i in range(len(ids)) if i != q), key=lambda i: (-score[i], ids[i]))[:k]
        out[ids[q]] = [(ids[i], score[i]) for i in order]
    return out


def test_neighbours_of_a_small_table_are_exact_with_ties(spark):
    rows = np.random.default_rng(4).normal(0, 1, (150, 16))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    rows[20:60] = rows[10]  # more equal vectors than places
    df = frame(spark, list(enumerate(rows)) + odd_rows(16))
    got = crosspoly.nearest(df.union(df.where("vec_id < 5")), F.col("vec_id") % 10 == 0, k=7, enough=1000)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        assert r.rank == len(found.setdefault(r.query_id, [])) + 1
        found[r.query_id].append((r.vec_id, r.score))
    want = neighbours_by_hand(list(range(150)), rows, range(0, 150, 10), 7)
    assert {q: [i for i, _ in v] for q, v in found.items()} == {q: [i for i, _ in v] for q, v in want.items()}
    assert all(a[1] == b[1] for q in want for a, b in zip(found[q], want[q]))


def test_recall_on_unclustered_vectors(spark):
    rows = np.random.default_rng(5).normal(0, 1, (3000, 64))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    got = crosspoly.nearest(frame(spark, enumerate(rows)), F.col("vec_id") % 20 == 0, k=20)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    product = rows[::20] @ rows.T
    product[np.arange(150), np.arange(0, 3000, 20)] = -9
    top = np.argpartition(-product, 20, axis=1)[:, :20]
    assert np.mean([len(found[20 * q] & set(t.tolist())) / 20 for q, t in enumerate(top)]) >= 0.9
    assert all(len(f) == 20 for f in found.values()) and len(found) == 150


def test_neighbours_awkward_tables(spark):
    few = frame(spark, [(0, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (2, [0.9, 0.1, 0.0])])
    got = [(r.query_id, r.rank, r.vec_id) for r in crosspoly.nearest(few, F.col("vec_id") == 0, k=20).collect()]
    assert sorted(got) == [(0, 1, 2), (0, 2, 1)]
    assert crosspoly.nearest(few.limit(0), F.lit(True)).count() == 0
    assert crosspoly.nearest(frame(spark, odd_rows(3)[:6]), F.lit(True)).count() == 0
    assert crosspoly.nearest(few, F.lit(False)).count() == 0


def test_vectors_of_every_length_are_joined_and_searched(spark):
    df = frame(spark, [(i, [1.0, 0.5 + i, 0.0]) for i in range(5)] + [(10 + i, [1.0, 2.0]) for i in range(3)])
    links = {r.vec_id: (r.n_links, r.component_id) for r in egojoin.cosine_groups(df).collect()}
    assert [links[i] for i in (10, 11, 12)] == [(2, 10)] * 3 and all(links[i][1] < 5 for i in range(5))
    near = [(r.rank, r.vec_id, r.score) for r in crosspoly.nearest(df, F.col("vec_id") == 11).collect()]
    assert sorted(near) == [(1, 10, 5.0), (2, 12, 5.0)]


def test_recall_on_vectors_of_mixed_lengths_with_few_of_the_rows_met(spark):
    rng = np.random.default_rng(7)
    rows = rng.normal(0, 1, (8000, 64)) * np.exp(0.3 * rng.normal(0, 1, (8000, 1)))
    got = crosspoly.nearest(frame(spark, enumerate(rows)), F.col("vec_id") % 80 == 0, k=10, enough=20)
    found = {}
    for r in got.collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    want = neighbours_by_hand(list(range(8000)), rows, range(0, 8000, 80), 10)
    assert np.mean([len(found[q] & {i for i, _ in v}) / 10 for q, v in want.items()]) >= 0.9


def test_queries_that_find_too_few_rows_meet_all_rows(spark):
    rows = np.random.default_rng(8).normal(0, 1, (300, 64))
    got = crosspoly.nearest(frame(spark, enumerate(rows)), F.col("vec_id") % 10 == 0, k=20, tables=1, probes=1, enough=1)
    found = {}
    for r in sorted(got.collect(), key=lambda r: (r.query_id, r.rank)):
        found.setdefault(r.query_id, []).append(r.vec_id)
    want = neighbours_by_hand(list(range(300)), rows, range(0, 300, 10), 20)
    assert {q: [i for i, _ in v] for q, v in want.items()} == found


def test_the_share_of_rows_that_a_query_meets_falls_with_their_number():
    rng, share = np.random.default_rng(9), []
    for n in (4000, 64000):
        rows = rng.normal(0, 1, (n, 64))
        rows /= np.linalg.norm(rows, axis=1, keepdims=True)
        index = crosspoly.index_for(0, n, 64, 20, crosspoly.TABLES, crosspoly.ENOUGH, 1)
        assert len(index.widths) == 2
        met = np.zeros((20, n), dtype=bool)
        for t in range(index.tables):
            keys, probed = index.keys(rows, t), index.probed(rows[:20], t, crosspoly.PROBES)
            assert all(len(set(p)) == crosspoly.PROBES and own in p for own, p in zip(keys[:20], probed))
            met |= (keys[None, None, :] == probed[:, :, None]).any(axis=1)
        share.append(met.mean())
    assert share[1] < 0.5 * share[0] < 0.5


def test_rotations_keep_lengths_and_hash_to_the_nearest_axis():
    rows = np.random.default_rng(6).normal(0, 1, (50, 20))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    turned = crosspoly.rotated(rows, 0, 1)
    assert turned.shape == (50, 32) and np.allclose(np.linalg.norm(turned, axis=1), 1)
    assert np.allclose(rows @ rows.T, turned @ turned.T)
    axes = np.stack((np.eye(32), -np.eye(32)), axis=1).reshape(64, 32)
    assert (crosspoly.bucket_of(turned) == (turned @ axes.T).argmax(axis=1)).all()
