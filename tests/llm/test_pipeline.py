"""The corpus pipeline against a brute-force version of its stages, and the registered queries against DuckDB."""

import os
import sys

import duckdb
import numpy as np
import pytest
sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import __spark_entry__ as entry  # noqa: E402
import corpus_pipeline as pipeline  # noqa: E402

from tests.llm.test_text_operators import jaccard_by_hand, lines_by_hand  # noqa: E402
from tomewise.llm import mixing  # noqa: E402
from tomewise.llm.queries import ORACLE, SOURCE_WEIGHTS, TOXIC_FROM  # noqa: E402

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [name for name, _ in pipeline.STAGES]
    assert names == ["toxicity", "line dedup", "near duplicates", "source mixing", "piece encoding"]
    stage = dict(pipeline.STAGES)

    clean = stage["toxicity"](spark, docs, SF)
    chance = {r.doc_id: r.p_toxic for r in entry.queries()["op10_toxicity_chain"](spark, SF).collect()}
    rows = {r.doc_id: r for r in clean.collect()}
    assert clean.columns == COLUMNS and set(rows) == {d for d, p in chance.items() if p < TOXIC_FROM}

    single = stage["line dedup"](spark, clean, SF)
    got = {r.doc_id: r for r in single.collect()}
    want = lines_by_hand([(r.doc_id, r.text) for r in rows.values()])
    assert single.columns == COLUMNS and {d: t for d, *_, t in want} == {d: r.text for d, r in got.items()}
    assert all(r.n_chars == len(r.text) for r in got.values())

    order = sorted(got)
    kept = stage["near duplicates"](spark, single, SF)
    found = {r.doc_id for r in kept.collect()}
    assert kept.columns == COLUMNS
    assert found == {order[i] for i, _, c in jaccard_by_hand([got[d].text for d in order]) if i == c}

    mixed = stage["source mixing"](spark, kept, SF)
    con = duckdb.connect()
    con.register("documents", kept.toPandas())
    numbers = dict(con.execute(
        f"SELECT doc_id, count(*) FROM ({mixing.mix_sql(SOURCE_WEIGHTS)}) GROUP BY 1").fetchall())
    counts = {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert mixed.columns == COLUMNS and counts == numbers

    coded = stage["piece encoding"](spark, mixed, SF).collect()
    assert len(coded) == sum(numbers.values()) and all(r.round_trip for r in coded)
    whole = sorted((r.doc_id, tuple(r.ids)) for r in pipeline.run(spark, SF).collect())
    assert whole == sorted((r.doc_id, tuple(r.ids)) for r in coded)


def test_stages_of_an_empty_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_match_duckdb(spark, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "benchmark"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    got = entry.queries()[name](spark, SF).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert sorted(map(repr, got[columns].astype(object).values.tolist())) == sorted(map(repr, want[columns].astype(object).values.tolist()))


def test_search_query_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    x, ids = np.array([r.embedding for r in rows], dtype=float), np.array([r.vec_id for r in rows])
    found = {}
    for r in entry.queries()["op6_cross_polytope"](spark, SF).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    recall = []
    for i in np.flatnonzero(ids % 20 == 0):
        score = x @ x[i]
        score[i] = -np.inf
        recall.append(len(found[ids[i]] & set(ids[np.argsort(-score)[:20]].tolist())) / 20)
    assert np.mean(recall) >= 0.9


def test_every_operator_is_registered():
    names = list(entry.queries())
    for n in range(1, 14):
        assert sum(name.startswith(f"op{n}_") for name in names) == 1
    assert "pipeline" in names


ODD = [
    (1, "one two three four five six seven eight nine ten", "en", "src0", 48),
    (2, "one two three four five six seven eight nine ten", "en", "src1", 48),
    (3, "some other words that nobody else has written down here", "en", "src2", 55),
    (3, "some other words that nobody else has written down here", "en", "src2", 55),
    (4, None, "en", "src3", None), (5, "", None, None, 0), (6, "   ", "en", "src3", 3),
    (None, "a text without an id that no other row has at all", "en", "src4", 49),
    (None, "one two three four five six seven eight nine ten", "en", "src4", 48),
    (None, None, None, None, None),
]


@pytest.fixture(scope="module")
def odd(spark):
    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string, n_chars long")
    return docs.selectExpr("*", "1 AS n_lines", "'x' AS component_id", "2 AS copy_number", "'y' AS ids", "3 AS node")


def test_rows_without_an_id_and_repeated_rows_in_each_stage(spark, odd):
    stage = dict(pipeline.STAGES)
    clean = stage["toxicity"](spark, odd, SF)
    assert clean.columns == COLUMNS and clean.count() == len(ODD)  # a clean corpus loses nothing

    single = stage["line dedup"](spark, odd, SF)
    assert single.columns == COLUMNS and single.count() == len(ODD)
    texts = sorted(((r.doc_id, r.text) for r in single.collect()), key=repr)
    want = [(d, "" if d == 2 else t) for d, t, *_ in ODD]
    assert texts == sorted(want, key=repr)

    kept = stage["near duplicates"](spark, odd, SF)
    assert kept.columns == COLUMNS
    want = [r for i, r in enumerate(ODD) if r[0] != 2 and i != 3]
    assert sorted(map(tuple, kept.collect()), key=repr) == sorted(want, key=repr)

    mixed = stage["source mixing"](spark, odd, SF)
    assert mixed.columns == COLUMNS and {tuple(r) for r in mixed.collect()} <= set(ODD)

    coded = stage["piece encoding"](spark, odd, SF).collect()
    assert len(coded) == len(ODD) and all(r.round_trip or r.ids is None for r in coded)
