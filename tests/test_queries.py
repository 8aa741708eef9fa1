"""Registered queries against their DuckDB statements on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from check import TABLES, normal
from tomewise.plans import registry

SF_DIR = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="supplied tables not present")

CHECKED = [
    "scan_reviews_json", "reviews_json_errors", "reviews_json_good", "book_xml_flat", "book_xml_authors", "xml_errors",
    "shelf_xml_rows", "author_worklist", "item_index", "foldin_nonneg_chunked", "foldin_gradient", "foldin_gradient_chunked",
    "foldin_coverage", "score_items", "score_items_blocked", "recommend_topk_blocked", "recommend_from_als",
    "predict_from_store", "als_factors", "als_predict", "als_eval", "review_clusters", "cluster_sizes", "cluster_terms",
    "cluster_titles", "books_enriched", "authors_clean", "isbn_map_limited", "isbn_map_union", "books_classified",
    "ratings_translated", "reviews_limited_full", "unresolved_asins", "resolve_user_shelf", "group_share_display",
    "group_boost", "top_categories", "ratings_profile", "books_per_user", "top_rated_slice", "rmse_overall_top",
    "split_users", "sample_users", "foldin_nonneg", "best_config", "unread_candidates", "rank_similarity",
    "rank_overlap_top", "recommend_topk", "recommend_final", "topk_per_category", "recommend_from_shelf",
    "reviews_by_book", "review_lemmas", "review_tfidf",
]


@pytest.fixture(scope="module")
def con():
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF_DIR}/{name}.parquet'")
    return con


@pytest.mark.parametrize("name", CHECKED)
def test_query_equals_sql(spark, con, name):
    got = entry.queries()[name](spark, SF_DIR).toPandas()
    want = con.execute(entry.oracle_sql()[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert normal(got) == normal(want)


def test_every_statement_belongs_to_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_every_query_of_the_library_has_a_statement():
    assert set(registry.QUERIES) <= set(entry.oracle_sql())
