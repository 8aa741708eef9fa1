import gzip
import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tomewise.plans.tables import (
    build_tables, build_themes, convert_book_xml, limit_reviews, load_limited_reviews, load_ratings, load_review_ratings,
)
from tomewise.operators import als, resolve
from tomewise.sources import factors, files

BOOK_1 = """<?xml version="1.0" encoding="UTF-8"?>
<GoodreadsResponse><book><id>1</id><title>Salt &amp; Smoke</title><isbn>000000001X</isbn>
<language_code>eng</language_code>
<work><id type="integer">900</id><best_book_id type="integer">10</best_book_id><original_title>Salt</original_title></work>
<authors><author><id>5</id><name>A</name><role>Author</role></author>
<author><id>6</id><name>B</name><role></role></author></authors>
<similar_books><book><id>77</id><title>Other</title></book></similar_books></book></GoodreadsResponse>"""
BOOK_2 = "<GoodreadsResponse><book><id>2</id><title>Cut o"
BOOK_3 = """<GoodreadsResponse><book><id>3</id><title>Plain</title>
<authors><author><id>7</id><name>C</name></author></authors></book></GoodreadsResponse>"""
SHELF = """<GoodreadsResponse><reviews>{}</reviews></GoodreadsResponse>"""
REVIEW = '<review><book><id type="integer">{}</id><isbn>{}</isbn></book><rating>{}</rating></review>'


@pytest.fixture()
def books_dir(tmp_path):
    folder = tmp_path / "books"
    folder.mkdir()
    for i, text in enumerate([BOOK_1, BOOK_2, BOOK_3], 1):
        (folder / f"{i}.xml").write_text(text)
    return str(folder)


def test_book_xml(spark, books_dir):
    got = {r["book_id"]: r for r in files.read_book_xml(spark, books_dir).collect()}
    assert set(got) == {1, 3}
    assert got[1]["title"] == "Salt & Smoke" and got[1]["isbn"] == "000000001X"
    assert (got[1]["work_id"], got[1]["best_book_id"], got[1]["original_title"]) == (900, 10, "Salt")
    assert got[3]["best_book_id"] is None and got[3]["isbn"] is None


def test_book_authors_xml(spark, books_dir):
    got = sorted((r["book_id"], r["author_id"], r["name"]) for r in files.read_book_authors_xml(spark, books_dir).collect())
    assert got == [(1, 5, "A"), (1, 6, "B"), (3, 7, "C")]


def test_malformed_files_are_listed(spark, books_dir):
    assert [r["file_name"] for r in files.read_book_xml_errors(spark, books_dir).collect()] == ["2.xml"]


def test_shelf_pages(spark, tmp_path):
    folder = tmp_path / "shelf" / "42"
    folder.mkdir(parents=True)
    (folder / "p1.xml").write_text(SHELF.format(REVIEW.format(10, "0123", 5) + REVIEW.format(11, "", 0)))
    (folder / "p2.xml").write_text(SHELF.format(REVIEW.format(12, "9", 3)))
    got = sorted(tuple(r) for r in files.read_shelf_xml(spark, str(tmp_path / "shelf" / "*" / "*.xml")).collect())
    assert got == [(42, "10", "0123", 5), (42, "11", None, 0), (42, "12", "9", 3)]


def test_reviews_json_and_csv_round_trip(spark, tmp_path):
    path = tmp_path / "reviews.json.gz"
    lines = [
        {"asin": "000000001X", "reviewerID": "r1", "helpful": [2, 3], "overall": 5.0, "summary": "so, so",
         "reviewText": 'He said "no".\nThen left.', "unixReviewTime": 1300000000},
        {"asin": "0000000002", "reviewerID": "r2", "helpful": [0, 0], "overall": 1.0, "summary": "", "unixReviewTime": 1},
        {"asin": "unknown", "reviewerID": "r3", "helpful": [0, 0], "overall": 2.0, "summary": "x", "unixReviewTime": 2},
    ]
    with gzip.open(path, "wt") as f:
        f.write("\n".join(json.dumps(x) for x in lines))
    reviews = files.read_reviews_json(spark, str(path), 3)
    assert reviews.rdd.getNumPartitions() == 3
    isbn_map = spark.createDataFrame([("000000001X", 1), ("0000000002", 2)], "isbn string, best_book_id long")
    limited = resolve.limited_reviews(reviews, isbn_map)
    out = str(tmp_path / "limited")
    files.write_csv(limited, out, header=False)
    back = files.read_csv(spark, out, files.LIMITED_REVIEW_SCHEMA, header=False, multi_line=True)
    got = sorted(tuple(r) for r in back.collect())
    assert got[0] == (1, "000000001X", "so, so", 'He said "no".\nThen left.')
    assert got[1][:2] == (2, "0000000002") and got[1][3] is None
    assert back.count() == 2
    with pytest.raises(AnalysisException):
        files.write_csv(limited, out, header=False)


def test_factor_store(spark, tmp_path):
    ratings = spark.range(60).select((F.col("id") % 6).alias("user_id"), (F.col("id") % 10).alias("book_id"), (F.col("id") % 5 + 1).cast("int").alias("rating"))
    path = str(tmp_path / "factors")
    for rank in (2, 3):
        for split in ("train", "test"):
            factors.save_factors(als.train(ratings, rank=rank, max_iter=2), rank, split, path)
    items = factors.load_factors(spark, path, 3, "test", "item")
    assert items.count() == 10 and items.select(F.size("features")).distinct().collect() == [(3,)]
    assert factors.load_factors(spark, path, 2, "train", "user").count() == 6
    plan = items._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "rank" in plan.split("PartitionFilters: [")[1][:120]


def test_build_tables(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    out = str(tmp_path / "tables")
    paths = dict(
        books_csv=put("b.csv", "extra,book_id,title,title_without_series,isbn,isbn13,asin,country_code,language_code,description,work_id,best_book_id,original_title\n"
                      ',1,"A, ""x""",A,001,,,US,eng,"two\nlines",9,10,A\n,2,B,B,002,,,FR,fre,d,9,20,B\n,3,C,C,003,,,US,en,d,9,30,C\n'),
        popularity_csv=put("p.csv", "book_id,best_book_id,ratings_count,work_ratings_count,work_text_reviews_count,ratings_1,ratings_2,ratings_3,ratings_4,ratings_5,image_url,small_image_url\n1,10,7,8,9,1,1,1,2,2,u,s\n"),
        authors_csv=put("a.csv", "author_id,name,main_author,race,gender,image_url,about,influences,works_count,hometown,born_at,died_at\n1,N, True,white,male,,,,3,,,\n2,M,True,,male,,,,3,,,\n"),
        book_authors_csv=put("ba.csv", "book_id,author_id,name,role\n10,1,N,\n"),
        isbn_map_csv=put("i.csv", "001X,10\n0002,\n001X,11\n"),
        themes_csv=put("k.csv", "k_label,book_id\n4,10\n"),
    )
    build_tables(spark, out, **paths)
    books = {r["best_book_id"]: r for r in files.read_table(spark, "books", out).collect()}
    assert set(books) == {10, 30}
    assert books[10]["title"] == 'A, "x"' and books[10]["description"] == "two\nlines" and books[10]["ratings_count"] == 7
    assert books[30]["ratings_count"] is None
    assert [r["author_id"] for r in files.read_table(spark, "authors", out).collect()] == [1]
    assert [tuple(r) for r in files.read_table(spark, "isbn_book_id", out).collect()] == [("001X", 11)]
    assert files.read_table(spark, "kmeans", out).head()["k_label"] == 4
    with pytest.raises(AnalysisException):
        build_tables(spark, out, **paths)


def test_build_themes(spark, tmp_path):
    texts = ["dragon sword king castle", "dragon king sword magic", "love heart kiss summer", "heart love kiss wedding"]
    reviews = spark.createDataFrame(
        [(b, b * 10 + k, t) for b, t in enumerate(texts) for k in range(3)], "best_book_id long, review_id long, review_text string"
    )
    build_themes(reviews, str(tmp_path / "t"), ks=(2,), max_features=20, n_terms=3)
    labels = {r["book_id"]: r["k_label"] for r in spark.read.parquet(str(tmp_path / "t" / "theme_labels")).collect()}
    assert labels[0] == labels[1] != labels[2] == labels[3]
    terms = spark.read.parquet(str(tmp_path / "t" / "theme_terms"))
    assert terms.count() == 6 and "k" in terms.columns


def test_xml_to_csv_job(spark, books_dir, tmp_path):
    out = str(tmp_path / "csv")
    convert_book_xml(spark, books_dir, out)
    books = files.read_csv(spark, f"{out}/updated_books", files.BOOK_DETAIL_SCHEMA, multi_line=True)
    assert sorted((r["book_id"], r["title"], r["best_book_id"]) for r in books.collect()) == [(1, "Salt & Smoke", 10), (3, "Plain", None)]
    assert files.read_csv(spark, f"{out}/author_books", files.BOOK_AUTHOR_SCHEMA).count() == 3
    assert files.read_csv(spark, f"{out}/errors", "file_name STRING").head()[0] == "2.xml"


def test_limit_reviews_job(spark, tmp_path):
    path = tmp_path / "r.json.gz"
    rows = [{"asin": a, "reviewerID": "r", "helpful": [1, 2], "overall": 4.0, "summary": "s", "reviewText": "a\n\"b\"", "unixReviewTime": 5} for a in ("1", "2", "1")]
    with gzip.open(path, "wt") as f:
        f.write("\n".join(map(json.dumps, rows)))
    isbn_map = spark.createDataFrame([("1", 100)], "isbn string, best_book_id long")
    limit_reviews(spark, str(path), isbn_map, str(tmp_path / "o"))
    ratings = load_review_ratings(spark, str(tmp_path / "o" / "limited_ratings"))
    assert [tuple(r) for r in ratings.collect()] == [("r", 100, 4.0)] * 2
    reviews = load_limited_reviews(spark, str(tmp_path / "o" / "limited_reviews"))
    assert [r["review_text"] for r in reviews.collect()] == ['a\n"b"'] * 2
    assert reviews.select("review_id").distinct().count() == 2


def test_load_ratings_translates(spark, tmp_path):
    (tmp_path / "r.csv").write_text("user_id,book_id,rating\n1,1,5\n1,2,3\n")
    (tmp_path / "b.csv").write_text("id,book_id,best_book_id,title\n1,1,900,x\n")
    got = sorted(map(tuple, load_ratings(spark, str(tmp_path / "r.csv"), str(tmp_path / "b.csv")).collect()), key=repr)
    assert got == [(1, 900, 5), (1, None, 3)]


def test_files_with_other_headers_are_never_misread(spark, tmp_path):
    (tmp_path / "r").mkdir()
    (tmp_path / "r" / "a.csv").write_text("user_id,book_id,rating\n1,2,3\n")
    (tmp_path / "r" / "b.csv").write_text("book_id,user_id,rating\n5,4,2\n")
    with pytest.raises(Exception, match="header"):
        files.read_csv(spark, str(tmp_path / "r"), "book_id INT, user_id INT, rating INT").collect()
    (tmp_path / "r" / "b.csv").write_text("user_id,book_id,rating\n4,5,2\n")
    got = files.read_csv(spark, str(tmp_path / "r"), "book_id INT, user_id INT, rating INT").collect()
    assert sorted(map(tuple, got)) == [(2, 1, 3), (5, 4, 2)]


def test_review_order_follows_file_names_and_rows(spark, tmp_path):
    (tmp_path / "v").mkdir()
    for name, n in (("a", 3), ("b", 300), ("c", 40)):
        (tmp_path / "v" / f"{name}.csv").write_text("".join(f'1,x{name},"s","{name} {i}\nmore"\n' for i in range(n)))
    got = [r["review_text"] for r in load_limited_reviews(spark, str(tmp_path / "v")).orderBy("review_id").collect()]
    assert got == [f"{name} {i}\nmore" for name, n in (("a", 3), ("b", 300), ("c", 40)) for i in range(n)]


def test_pages_of_many_lines_and_bad_ones(spark, books_dir):
    parsed = files.parse_book_pages(files.read_pages(spark, books_dir))
    assert sorted(r["book_id"] for r in files.flat_books(parsed).collect()) == [1, 3]
    assert [r["file_name"] for r in files.page_errors(parsed).collect()] == ["2.xml"]
    texts = [(0, None), (1, ""), (2, "<x><book></book></x>"), (3, "<book><id>8</id><isbn></book>"), (4, "<book><id>9</id></book>")]
    parsed = files.parse_book_pages(spark.createDataFrame(texts, "n int, page string"))
    assert sorted(r["n"] for r in parsed.where("book IS NULL").collect()) == [0, 1, 2, 3]


def test_a_page_is_parsed_once_whatever_filters_follow(spark):
    pages = spark.createDataFrame([(1, "<book><id>9</id></book>")], "n int, page string")
    plan = files.flat_books(files.parse_book_pages(pages))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_xml") == 1
    lines = spark.createDataFrame([(1, "{}")], "n int, line string")
    plan = files.review_errors(files.parse_reviews(lines), "n")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_malformed_review_lines_are_kept(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text('{"asin": "1", "overall": 4.0}\n{"asin": "2", "over\n\n[1, 2]\n{"asin": 3, "overall": "x"}\n{}\n')
    assert [r["asin"] for r in files.read_reviews_json(spark, str(path)).orderBy("file", "place").collect()] == ["1", None]
    errors = files.read_review_json_errors(spark, str(path)).collect()
    assert {r["file_name"] for r in errors} == {"r.json"}
    assert sorted(r["line"] for r in errors) == ['[1, 2]', '{"asin": "2", "over', '{"asin": 3, "overall": "x"}']


def test_limited_reviews_keep_the_order_of_all_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for name, n in (("b", 50), ("a", 400), ("c", 3)):
        with gzip.open(tmp_path / "in" / f"{name}.json.gz", "wt") as f:
            f.write("\n".join(json.dumps({"asin": str(i % 3), "reviewerID": f"{name}{i}", "overall": 1.0, "reviewText": f"{name} {i}"}) for i in range(n)) + "\n{bad\n")
    isbn_map = spark.createDataFrame([("1", 100), ("2", 200)], "isbn string, best_book_id long")
    limit_reviews(spark, str(tmp_path / "in"), isbn_map, str(tmp_path / "o"))
    back = [r["review_text"] for r in load_limited_reviews(spark, str(tmp_path / "o" / "limited_reviews")).orderBy("review_id").collect()]
    assert back == [f"{name} {i}" for name, n in (("a", 400), ("b", 50), ("c", 3)) for i in range(n) if i % 3]
    assert spark.read.text(str(tmp_path / "o" / "review_errors")).count() == 3


def test_author_lists_are_visited_once(spark):
    rows = [(1, 5), (1, 6), (2, 6), (2, 5), (2, 5), (3, 5), (4, None), (5, 7), (6, 7)]
    writers = spark.createDataFrame(rows, "book_id long, author_id long")
    got = {tuple(r["author_ids"]): (r["book_id"], r["n_books"]) for r in resolve.author_worklist(writers).collect()}
    assert got == {(5, 6): (1, 2), (5,): (3, 1), (7,): (5, 2)}
    visited = resolve.author_worklist(writers.where("book_id = 6"))
    assert {tuple(r["author_ids"]) for r in resolve.author_worklist(writers, visited).collect()} == {(5, 6), (5,)}
