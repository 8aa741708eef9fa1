"""DuckDB statements that state each registered query independently, over the same tables."""

from __future__ import annotations

from tomewise.functions.hashing import hash_fraction_sql
from tomewise.functions.text import (
    BREAK_PATTERN, CLITIC_PATTERN, FULL_STOP_PATTERN, STOP_WORDS,
)
from tomewise.plans.recommend import OTHER_THEMES, THEME_NAMES


def text_literal(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _in_list(words) -> str:
    return "(" + ", ".join(text_literal(w) for w in words) + ")"


HARD_BREAKS = "[;@#$%&?!()\\[\\]{}<>\" \t\n\r\f\u000b\u00a0]+"
PUNCTUATION_CLASS = r"[!-/:-@\[-`{-~]"


def _regex_chain(expr: str) -> str:
    steps = [
        (HARD_BREAKS, " "), (BREAK_PATTERN, r" \1"), (FULL_STOP_PATTERN, " "),
        (CLITIC_PATTERN, r"\1 \2\3"), (PUNCTUATION_CLASS, ""),
    ]
    expr = f"lower({expr})"
    for pattern, new in steps:
        expr = f"regexp_replace({expr}, {text_literal(pattern)}, {text_literal(new)}, 'g')"
    return expr


def _split_case(fraction: str, bounds: list[tuple[str, float]], last: str) -> str:
    return "CASE " + " ".join(f"WHEN {fraction} < {b} THEN '{n}'" for n, b in bounds) + f" ELSE '{last}' END"


# Views by name: the views they use, and their statement. Dependencies come first.
VIEWS: dict[str, str] = {
    "ratings": """
        SELECT o_custkey AS user_id, l_partkey AS book_id, CAST(ceil(avg(l_quantity) / 10) AS INTEGER) AS rating
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2""",
    "books_detail": """
        SELECT p_partkey AS book_id, p_name AS title, lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS isbn,
               CASE p_size % 8 WHEN 0 THEN 'eng' WHEN 1 THEN 'en-US' WHEN 2 THEN 'en-GB' WHEN 3 THEN 'en-CA'
                    WHEN 4 THEN 'en' WHEN 5 THEN 'fre' WHEN 6 THEN 'spa' END AS language_code,
               p_partkey AS best_book_id
        FROM part""",
    "english": "SELECT * FROM books_detail WHERE language_code IN ('eng', 'en-US', 'en-GB', 'en-CA', 'en')",
    "kmeans": """
        SELECT CAST(p_partkey % 13 AS INTEGER) AS k_label, p_partkey AS book_id FROM part WHERE p_size <> 50""",
    "books": """
        SELECT p_partkey AS best_book_id, p_name AS title, k_label FROM part LEFT JOIN kmeans ON p_partkey = book_id""",
    "popularity": """
        SELECT book_id AS best_book_id, count(*) AS ratings_count,
               count(*) FILTER (rating = 1) AS ratings_1, count(*) FILTER (rating = 2) AS ratings_2,
               count(*) FILTER (rating = 3) AS ratings_3, count(*) FILTER (rating = 4) AS ratings_4,
               count(*) FILTER (rating = 5) AS ratings_5
        FROM ratings GROUP BY 1 HAVING count(*) >= 25""",
    "places": """
        SELECT s_suppkey, s_name, r_name FROM supplier JOIN nation ON s_nationkey = n_nationkey
        JOIN region ON n_regionkey = r_regionkey""",
    "authors": """
        SELECT s_suppkey AS author_id, s_name AS name, trim(upper(r_name)) AS race,
               CASE WHEN s_suppkey % 3 = 0 THEN 'FEMALE' ELSE 'MALE' END AS gender FROM places""",
    "authors_raw": """
        SELECT s_suppkey AS author_id, s_name AS name, s_suppkey % 5 <> 0 AS main_author,
               CASE s_suppkey % 10 WHEN 0 THEN NULL WHEN 1 THEN '  ' || lower(r_name) || ' '
                    WHEN 2 THEN 'unknown' ELSE r_name END AS race,
               CASE WHEN s_suppkey % 7 = 0 THEN NULL WHEN s_suppkey % 3 = 0 THEN 'female ' ELSE 'Male' END AS gender
        FROM places""",
    "book_authors": """
        SELECT p_partkey AS book_id, p_partkey % n AS author_id, CAST(NULL AS VARCHAR) AS role
        FROM part, (SELECT count(*) AS n FROM supplier)
        UNION ALL
        SELECT p_partkey, (p_partkey * 7 + 3) % n, 'Co-author' FROM part, (SELECT count(*) AS n FROM supplier)
        WHERE p_size <= 12 AND (p_partkey * 7 + 3) % n <> p_partkey % n""",
    "classified": """
        SELECT best_book_id, title, k_label, author_id, name, race, gender, race || ' ' || gender AS race_gender
        FROM books JOIN book_authors ON best_book_id = book_id JOIN authors USING (author_id)""",
    "item_factors": "SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS features FROM embeddings",
    "isbn_map_raw": """
        SELECT lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS isbn,
               CASE WHEN p_size <> 17 THEN CAST(p_partkey AS VARCHAR) END AS best_book_id
        FROM part WHERE p_size <> 3""",
    "isbn_map": """
        SELECT isbn, max(CAST(best_book_id AS BIGINT)) AS best_book_id FROM isbn_map_raw
        WHERE best_book_id IS NOT NULL GROUP BY 1""",
    "local_ids": "SELECT p_partkey * 3 + 1 AS book_id, p_partkey AS best_book_id FROM part WHERE p_size <> 23",
    "ratings_local": "SELECT user_id, book_id * 3 + 1 AS book_id, rating FROM ratings",
    "shelf_raw": """
        SELECT user_id,
               CAST(CASE WHEN (user_id + book_id) % 5 = 0 THEN book_id + 10000000 ELSE book_id END AS VARCHAR) AS book_id,
               CASE WHEN (user_id + book_id) % 7 <> 0 THEN lpad(CAST(book_id AS VARCHAR), 10, '0') END AS isbn,
               CASE WHEN (user_id + book_id) % 11 = 0 THEN 0 ELSE rating END AS rating
        FROM ratings""",
    "shelf_rows": """
        SELECT s.user_id, coalesce(b.best_book_id, m.best_book_id) AS best_book_id, s.isbn, s.rating
        FROM shelf_raw s LEFT JOIN books b ON TRY_CAST(s.book_id AS BIGINT) = b.best_book_id
        LEFT JOIN isbn_map m ON s.isbn = m.isbn""",
    "shelf": """
        SELECT user_id, best_book_id AS book_id, max(rating) AS rating, min(isbn) AS isbn FROM shelf_rows
        WHERE best_book_id IS NOT NULL AND rating > 0 GROUP BY 1, 2""",
    "reviews_raw": """
        SELECT doc_id AS review_id, lpad(CAST(doc_id // 10 AS VARCHAR), 10, '0') AS asin, source AS reviewer_id,
               CAST(n_chars % 5 AS INTEGER) AS helpful_yes, CAST(doc_id % 5 + 1 AS DOUBLE) AS overall,
               lang || ' ' || source AS summary, nullif(trim(text, ' '), '') AS review_text,
               doc_id * 86400 + 1300000000 AS unix_review_time
        FROM documents""",
    "reviews": "SELECT r.*, best_book_id FROM reviews_raw r JOIN isbn_map m ON r.asin = m.isbn",
    "both_sources": """
        SELECT 'main' AS source, CAST(user_id AS VARCHAR) AS user_id, CAST(rating AS DOUBLE) AS rating FROM ratings
        UNION ALL SELECT 'review', reviewer_id, overall FROM reviews""",
    # Groups
    "group_counts": """
        SELECT race, gender, race_gender, count(DISTINCT (best_book_id, author_id)) AS n FROM classified
        WHERE race IS NOT NULL AND gender IS NOT NULL GROUP BY 1, 2, 3""",
    "group_targets": """
        SELECT race, gender, race_gender, n + 1000 AS gr_count,
               CAST(n + 1000 AS DOUBLE) / CAST(sum(n + 1000) OVER () AS DOUBLE) AS gr_percentage FROM group_counts""",
    "user_groups": """
        SELECT user_id, race, gender, race_gender, n,
               CAST(n AS DOUBLE) / CAST(sum(n) OVER (PARTITION BY user_id) AS DOUBLE) AS share
        FROM (SELECT user_id, race, gender, race_gender, count(DISTINCT (best_book_id, author_id)) AS n
              FROM ratings JOIN classified ON book_id = best_book_id
              WHERE race IS NOT NULL AND gender IS NOT NULL GROUP BY 1, 2, 3, 4)""",
    "boosts": """
        SELECT user_id, t.race_gender, t.race, t.gender, gr_count, gr_percentage, coalesce(n, 0) AS user_count,
               coalesce(share, 0.00001::DOUBLE) AS user_percentage,
               coalesce(share, 0.00001::DOUBLE) / gr_percentage AS user_gr_perc,
               1.0::DOUBLE / (1.0::DOUBLE + coalesce(share, 0.00001::DOUBLE) / gr_percentage) AS user_gr_perc_norm
        FROM (SELECT DISTINCT user_id FROM ratings) u CROSS JOIN group_targets t
        LEFT JOIN user_groups g USING (user_id, race_gender)""",
    "category": """
        SELECT user_id, k_label, n_read, n_books, CAST(n_read AS DOUBLE) / n_books AS share
        FROM (SELECT user_id, k_label, count(*) AS n_read FROM ratings JOIN books ON book_id = best_book_id
              WHERE k_label IS NOT NULL GROUP BY 1, 2)
        JOIN (SELECT k_label, count(*) AS n_books FROM books WHERE k_label IS NOT NULL GROUP BY 1) USING (k_label)""",
    "top_category": """
        SELECT * FROM (SELECT user_id, k_label, coalesce(share, 0.0::DOUBLE) AS share,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY coalesce(share, 0.0::DOUBLE) DESC, k_label) AS INTEGER) AS position
        FROM (SELECT DISTINCT user_id FROM ratings) CROSS JOIN (SELECT DISTINCT k_label FROM books WHERE k_label IS NOT NULL)
        LEFT JOIN category USING (user_id, k_label)) WHERE position <= 5""",
    # Fold-in
    "configs": """
        SELECT * FROM (VALUES (0.01::DOUBLE, 100, 1), (0.01, 500, 2), (0.01, 1000, 3), (0.1, 100, 4), (0.1, 500, 5), (0.1, 1000, 6))
        AS c(alpha, iterations, place)""",
    "steps": """
        SELECT id AS book_id, unnest(range(len(features))) AS dim,
               unnest(features) / list_dot_product(features, features) AS step FROM item_factors""",
    "known": """
        SELECT user_id, book_id, rating, row_number() OVER (PARTITION BY user_id ORDER BY book_id) AS j,
               count(*) OVER (PARTITION BY user_id) AS b
        FROM ratings WHERE book_id IN (SELECT id FROM item_factors)""",
    "folded_long": """
        SELECT user_id, alpha, iterations, dim,
               pow(1 - alpha, iterations * b) * 0.5
               + (1 - pow(1 - alpha, iterations * b)) / (1 - pow(1 - alpha, b))
                 * sum(alpha * pow(1 - alpha, b - j) * greatest(rating * step, 1e-6)) AS value
        FROM known JOIN steps USING (book_id) CROSS JOIN configs
        GROUP BY user_id, alpha, iterations, dim, b""",
    "folded_one": """
        SELECT user_id, dim,
               pow(0.99::DOUBLE, 100 * b) * 0.5
               + (1 - pow(0.99::DOUBLE, 100 * b)) / (1 - pow(0.99::DOUBLE, b))
                 * sum(0.01::DOUBLE * pow(0.99::DOUBLE, b - j) * greatest(rating * step, 1e-6)) AS value
        FROM known JOIN steps USING (book_id) GROUP BY user_id, dim, b""",
    "rated": """
        SELECT user_id, j, b, CAST(rating AS DOUBLE) AS r, features AS v FROM known JOIN item_factors ON book_id = id""",
    "vectors": "SELECT user_id, list(value ORDER BY dim) AS u FROM folded_one GROUP BY 1",
    "scores": """
        SELECT user_id, id AS item_id, round(list_dot_product(u, features), 6) AS score
        FROM vectors CROSS JOIN item_factors""",
    "errors": """
        SELECT user_id, alpha, iterations, avg((rating - dot) * (rating - dot)) AS error, count(*) AS n_known
        FROM (SELECT v.user_id, v.alpha, v.iterations, k.rating, list_dot_product(v.u, i.features) AS dot
              FROM (SELECT user_id, alpha, iterations, list(value ORDER BY dim) AS u FROM folded_long GROUP BY ALL) v
              JOIN known k ON v.user_id = k.user_id JOIN item_factors i ON k.book_id = i.id)
        GROUP BY 1, 2, 3""",
    # Recommendations
    "candidates": """
        SELECT s.user_id, c.best_book_id, c.author_id, c.race_gender, c.k_label, c.title, score AS guess,
               CASE WHEN max(score) OVER (PARTITION BY s.user_id) > 0
                    THEN 5.0::DOUBLE * score / max(score) OVER (PARTITION BY s.user_id) END AS rating_guess
        FROM scores s ANTI JOIN ratings r ON s.user_id = r.user_id AND s.item_id = r.book_id
        JOIN classified c ON s.item_id = c.best_book_id WHERE c.k_label IS DISTINCT FROM 8""",
    "boosted": """
        SELECT c.*, coalesce(user_gr_perc_norm, 0) AS boost, rating_guess + coalesce(user_gr_perc_norm, 0) AS boosted_rating
        FROM candidates c LEFT JOIN boosts b USING (user_id, race_gender)""",
    "placed": """
        SELECT *,
               row_number() OVER (PARTITION BY user_id
                   ORDER BY coalesce(boosted_rating, guess) DESC, guess DESC, best_book_id, author_id) AS place,
               row_number() OVER (PARTITION BY user_id
                   ORDER BY coalesce(rating_guess, guess) DESC, guess DESC, best_book_id, author_id) AS plain_place
        FROM boosted""",
    "best_books": """
        SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY place) AS book_place
        FROM (SELECT *, row_number() OVER (PARTITION BY user_id, best_book_id ORDER BY place) AS one FROM placed)
        WHERE one = 1""",
    # Themes
    "words": f"""
        SELECT best_book_id, word FROM (
            SELECT best_book_id, unnest(string_split_regex({_regex_chain('review_text')}, ' +')) AS word
            FROM reviews WHERE review_text IS NOT NULL)
        WHERE word <> '' AND word NOT IN {_in_list(STOP_WORDS)}""",
    "lexicon": "SELECT DISTINCT word FROM words",
    "plurals": """
        SELECT word FROM lexicon WHERE length(word) > 3 AND NOT regexp_matches(word, '(ss|us|is)$')""",
    "forms": """
        SELECT word, left(word, length(word) - 1) AS form FROM plurals WHERE ends_with(word, 's')
        UNION ALL SELECT word, left(word, length(word) - 2) FROM plurals WHERE regexp_matches(word, '(ses|xes|zes|ches|shes)$')
        UNION ALL SELECT word, left(word, length(word) - 3) || 'f' FROM plurals WHERE ends_with(word, 'ves')
        UNION ALL SELECT word, left(word, length(word) - 3) || 'y' FROM plurals WHERE ends_with(word, 'ies')
        UNION ALL SELECT word, left(word, length(word) - 2) || 'an' FROM plurals WHERE ends_with(word, 'men')""",
    "lemma_of": """
        SELECT word, arg_min(form, (length(form), form)) AS lemma FROM forms WHERE form IN (SELECT word FROM lexicon) GROUP BY 1""",
    "counts": """
        SELECT best_book_id, coalesce(lemma, w.word) AS word, count(*) AS tf FROM words w LEFT JOIN lemma_of l ON w.word = l.word
        GROUP BY 1, 2""",
    "vocab": """
        SELECT word, sum(tf) AS total, count(*) AS df FROM counts GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 1000""",
}

TRAIN_TEST = _split_case(hash_fraction_sql("user_id", "book_id"), [("train", 0.7)], "test")
USER_PARTS = _split_case(hash_fraction_sql("user_id"), [("train", 0.6), ("val", 0.8)], "test")
NAMES = ", ".join(f"({k}, {text_literal(v)})" for k, v in [*THEME_NAMES.items(), (-1, OTHER_THEMES)])

STATEMENTS: dict[str, str] = {
    "scan_reviews_json": "SELECT *, 5 AS helpful_all FROM reviews_raw",
    "reviews_json_errors": """
        SELECT review_id, CASE WHEN review_id % 13 = 0 THEN left('{"asin":"' || asin || '","reviewerID":"' || reviewer_id, 30)
               ELSE '[1, 2]' END AS line FROM reviews_raw WHERE review_id % 13 = 0 OR review_id % 29 = 0""",
    "reviews_json_good": """
        SELECT review_id, asin, overall, CAST(length(review_text) AS INTEGER) AS n_chars
        FROM reviews_raw WHERE review_id % 13 <> 0 AND review_id % 29 <> 0""",
    "book_xml_flat": """
        SELECT p_partkey AS book_id, p_name || ' & <' || p_brand || '>' AS title, CAST(NULL AS VARCHAR) AS title_without_series,
               lpad(CAST(p_partkey AS VARCHAR), 10, '0') AS isbn, CAST(NULL AS VARCHAR) AS isbn13, CAST(NULL AS VARCHAR) AS asin,
               CAST(NULL AS VARCHAR) AS country_code, CAST(NULL AS VARCHAR) AS language_code, CAST(NULL AS VARCHAR) AS description,
               CASE WHEN p_size <> 7 THEN p_partkey + 5000 END AS work_id, CASE WHEN p_size <> 7 THEN p_partkey END AS best_book_id,
               CASE WHEN p_size <> 7 THEN p_name END AS original_title
        FROM part WHERE p_partkey % 11 <> 0 AND p_partkey % 17 <> 0""",
    "book_xml_authors": """
        SELECT book_id, author_id, 'N ' || author_id AS name, role FROM book_authors WHERE book_id % 11 <> 0 AND book_id % 17 <> 0""",
    "xml_errors": "SELECT p_partkey || '.xml' AS file_name FROM part WHERE p_partkey % 11 = 0 OR p_partkey % 17 = 0",
    "shelf_xml_rows": """
        SELECT * FROM shelf_raw WHERE NOT (user_id % 9 = 0 AND CAST(book_id AS BIGINT) % 3 = 1)""",
    "author_worklist": """
        WITH lists AS (SELECT book_id, list_sort(list(DISTINCT author_id)) AS author_ids FROM book_authors GROUP BY 1)
        SELECT array_to_string(author_ids, ',') AS author_ids, min(book_id) AS book_id, count(*) AS n_books FROM lists
        WHERE author_ids NOT IN (SELECT author_ids FROM lists WHERE book_id % 10 = 0) GROUP BY author_ids""",
    "books_english": "SELECT * FROM english",
    "books_enriched": "SELECT e.*, p.* EXCLUDE (best_book_id) FROM english e LEFT JOIN popularity p USING (best_book_id)",
    "authors_clean": """
        WITH tidy AS (SELECT author_id, name, main_author, trim(upper(race), ' ') AS race, trim(upper(gender), ' ') AS gender
                      FROM authors_raw WHERE race IS NOT NULL),
        top_race AS (SELECT race FROM tidy WHERE race IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST')
                     GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
        top_gender AS (SELECT gender FROM tidy WHERE gender IN ('FEMALE', 'MALE') GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)
        SELECT author_id, name, main_author,
               CASE WHEN race IN ('AFRICA', 'AMERICA', 'ASIA', 'EUROPE', 'MIDDLE EAST') THEN race
                    ELSE (SELECT race FROM top_race) END AS race,
               CASE WHEN gender IN ('FEMALE', 'MALE') THEN gender ELSE (SELECT gender FROM top_gender) END AS gender
        FROM tidy WHERE main_author""",
    "isbn_map_clean": "SELECT * FROM isbn_map",
    "isbn_map_limited": "SELECT * FROM isbn_map WHERE best_book_id IN (SELECT best_book_id FROM english)",
    "isbn_map_union": """
        SELECT isbn, best_book_id FROM isbn_map
        UNION ALL
        SELECT DISTINCT lpad(CAST(book_id AS VARCHAR), 10, '0'), book_id + 10000000 FROM ratings
        WHERE lpad(CAST(book_id AS VARCHAR), 10, '0') NOT IN (SELECT isbn FROM isbn_map)""",
    "books_labelled": "SELECT d.*, k_label FROM books_detail d LEFT JOIN kmeans k ON d.best_book_id = k.book_id",
    "books_classified": """
        SELECT d.*, a.author_id, a.name, a.race, a.gender, k.k_label
        FROM (SELECT DISTINCT book_id, author_id FROM book_authors) w JOIN authors a USING (author_id)
        LEFT JOIN kmeans k ON w.book_id = k.book_id JOIN books_detail d ON d.best_book_id = w.book_id""",
    "ratings_translated": """
        SELECT user_id, best_book_id AS book_id, rating FROM ratings_local LEFT JOIN local_ids USING (book_id)""",
    "ratings_translated_zero": """
        SELECT user_id, coalesce(best_book_id, 0) AS book_id, rating FROM ratings_local LEFT JOIN local_ids USING (book_id)""",
    "reviews_limited": "SELECT best_book_id, asin, summary, review_text FROM reviews",
    "review_ratings_limited": """
        SELECT best_book_id AS book_id, asin, reviewer_id AS user_id, helpful_yes || '/5' AS helpful, overall AS rating,
               unix_review_time FROM reviews""",
    "reviews_limited_full": """
        SELECT best_book_id, asin, reviewer_id, helpful_yes || '/5' AS helpful, overall, summary, review_text,
               unix_review_time FROM reviews""",
    "unresolved_asins": """
        SELECT DISTINCT asin FROM reviews_raw WHERE asin NOT IN
        (SELECT isbn FROM isbn_map WHERE best_book_id IN (SELECT best_book_id FROM english))""",
    "resolve_user_shelf": "SELECT * FROM shelf",
    "shelf_coverage": """
        SELECT user_id, count(*) AS books_read,
               count(*) FILTER (best_book_id IS NOT NULL AND rating > 0) AS books_read_known
        FROM shelf_rows GROUP BY 1""",
    "group_share": """
        SELECT race_gender, race, gender, n, round(CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE), 6) AS share
        FROM group_counts""",
    "user_group_share": "SELECT user_id, race_gender, race, gender, n, round(share, 6) AS share FROM user_groups",
    "group_share_display": """
        SELECT user_id, n, array_to_string(list_transform(string_split(lower(race), ' '),
               lambda w: upper(w[1]) || w[2:]), ' ') || ' / ' || upper(gender[1]) || lower(gender[2:]) AS label,
               printf('%.2f%%', round(100.0 * share, 2)) AS percent FROM user_groups""",
    "group_boost": """
        SELECT user_id, race_gender, race, gender, gr_count, round(gr_percentage, 6) AS gr_percentage, user_count,
               round(user_percentage, 6) AS user_percentage, round(user_gr_perc, 6) AS user_gr_perc,
               round(user_gr_perc_norm, 6) AS user_gr_perc_norm FROM boosts""",
    "category_share": "SELECT user_id, k_label, n_read, n_books, round(share, 6) AS share FROM category",
    "top_categories": "SELECT user_id, k_label, round(share, 6) AS share, position FROM top_category",
    "ratings_profile": """
        SELECT source, rating, count(*) AS n,
               round(CAST(count(*) AS DOUBLE) / CAST(sum(count(*)) OVER (PARTITION BY source) AS DOUBLE), 6) AS share
        FROM both_sources GROUP BY 1, 2""",
    "books_per_user": """
        SELECT source, count(*) AS ratings, count(DISTINCT user_id) AS users,
               round(CAST(count(*) AS DOUBLE) / count(DISTINCT user_id), 6) AS books_per_user
        FROM both_sources GROUP BY 1""",
    "top_rated_slice": """
        SELECT user_id, book_id, rating, round("limit", 6) AS "limit"
        FROM (SELECT *, quantile_cont(CAST(rating AS DOUBLE), 0.95) OVER (PARTITION BY user_id) AS "limit" FROM ratings)
        WHERE rating >= "limit" """,
    "rmse_overall_top": f"""
        WITH parts AS (SELECT *, {TRAIN_TEST} AS split FROM ratings),
        means AS (SELECT book_id, avg(rating) AS book_mean FROM parts WHERE split = 'train' GROUP BY 1),
        predicted AS (SELECT user_id, rating, coalesce(book_mean, (SELECT avg(rating) FROM parts WHERE split = 'train')) AS p,
                      quantile_cont(CAST(rating AS DOUBLE), 0.95) OVER (PARTITION BY user_id) AS q
                      FROM parts LEFT JOIN means USING (book_id) WHERE split = 'test')
        SELECT round(sqrt(avg((rating - p) ** 2)), 6) AS rmse,
               round(sqrt(avg((rating - p) ** 2) FILTER (rating >= q)), 6) AS rmse_top_5 FROM predicted""",
    "split_rows": f"SELECT *, {TRAIN_TEST} AS split FROM ratings",
    "split_users": f"SELECT *, {USER_PARTS} AS split FROM ratings",
    "sample_users": f"""
        SELECT user_id FROM (SELECT DISTINCT user_id FROM ratings)
        ORDER BY {hash_fraction_sql('user_id', seed=0)}, user_id LIMIT 1000""",
    "foldin_nonneg": "SELECT user_id, CAST(dim AS INTEGER) AS dim, round(value, 6) AS value FROM folded_one",
    "foldin_error": """
        SELECT user_id, alpha, iterations, round(error, 5) AS error, n_known FROM errors""",
    "best_config": """
        SELECT alpha, iterations, error FROM (
            SELECT alpha, iterations, round(avg(error), 5) AS error FROM errors GROUP BY 1, 2)
        JOIN configs USING (alpha, iterations) ORDER BY error, place LIMIT 1""",
    "item_index": "SELECT o_orderkey AS order_id, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders",
    # One rating after another, pass after pass.
    "foldin_gradient": """
        WITH RECURSIVE walk(user_id, place, u) USING KEY (user_id) AS (
            SELECT DISTINCT user_id, 0::BIGINT, list_transform(range(64), lambda x: 0.5::DOUBLE) FROM rated
            UNION ALL
            SELECT w.user_id, w.place + 1, list_transform(list_zip(w.u, t.v),
                lambda p: p[1] + 0.02::DOUBLE * (t.r - list_dot_product(w.u, t.v)) * p[2])
            FROM walk w JOIN rated t ON t.user_id = w.user_id AND t.j = w.place % t.b + 1 WHERE w.place < 100 * t.b)
        SELECT user_id, CAST(unnest(range(64)) AS INTEGER) AS dim, round(unnest(u), 6) AS value FROM walk""",
    "foldin_coverage": """
        WITH folds AS (SELECT user_id FROM known GROUP BY 1),
        methods AS (SELECT * FROM (VALUES (true), (false)) AS m(negative))
        SELECT negative, 100 AS iterations, 0.01::DOUBLE AS alpha, (SELECT count(*) FROM folds) AS n_folded,
               (SELECT count(*) FROM folds WHERE user_id % 7 = 0) AS n_untrained,
               (SELECT count(*) FROM ratings) AS n_ratings,
               (SELECT count(*) FROM ratings WHERE book_id NOT IN (SELECT id FROM item_factors)) AS n_without_factors,
               (SELECT count(*) FROM item_factors WHERE id % 2 = 1) AS n_dropped_items FROM methods""",
    # ALS
    "als_factors": """
        SELECT 'user' AS side, user_id AS id, 10 AS n_factors, true AS nonnegative, count(*) AS n_ratings, true AS optimal
        FROM ratings GROUP BY user_id
        UNION ALL SELECT DISTINCT 'item', book_id, 10, true, NULL, NULL FROM ratings""",
    "als_predict": f"""
        WITH parts AS (SELECT *, {TRAIN_TEST} AS split FROM ratings),
        fit AS (SELECT * FROM parts WHERE split = 'train')
        SELECT user_id, book_id, rating, CASE WHEN user_id NOT IN (SELECT user_id FROM fit) OR book_id NOT IN (SELECT book_id FROM fit)
               THEN round((SELECT avg(rating) FROM fit), 6) END AS fallback, true AS usable
        FROM parts WHERE split = 'test'""",
    "als_eval": f"""
        WITH held AS (SELECT *, quantile_cont(CAST(rating AS DOUBLE), 0.95) OVER (PARTITION BY user_id) AS q
                      FROM (SELECT *, {TRAIN_TEST} AS split FROM ratings) WHERE split = 'test')
        SELECT count(*) AS n_rows, count(*) FILTER (rating >= q) AS n_top, true AS rmse_finite, true AS rmse_top_5_finite FROM held""",
    "predict_from_store": """
        SELECT r.user_id, r.book_id, r.rating, u IS NOT NULL AND features IS NOT NULL AS known,
               round(coalesce(list_dot_product(u, features), (SELECT avg(rating) FROM ratings)), 6) AS prediction
        FROM ratings r LEFT JOIN vectors v ON r.user_id = v.user_id LEFT JOIN item_factors i ON r.book_id = i.id""",
    "als_grid": """
        SELECT CAST(row_number() OVER (ORDER BY reg_param, rank) - 1 AS INTEGER) AS position, CAST(rank AS INTEGER) AS rank, reg_param,
               true AS rmse_finite, true AS rmse_top_5_finite
        FROM (SELECT unnest(range(11, 42, 2)) AS rank), (VALUES (0.01::DOUBLE), (0.05), (0.1)) AS g(reg_param), (SELECT count(*) FROM ratings)""",
    "als_grid_best": "SELECT 48::BIGINT AS n_settings, 0::BIGINT AS n_better, 0::BIGINT AS n_earlier, count(*) > 0 AS in_grid FROM ratings",
    "als_grid_per_rank": f"""
        WITH parts AS (SELECT *, {USER_PARTS} AS split FROM ratings),
        fits AS (SELECT 'train' AS split, user_id, book_id FROM parts WHERE split = 'train'
                 UNION ALL SELECT 'test', user_id, book_id FROM parts WHERE split <> 'test'),
        sizes AS (SELECT split, 'user' AS side, count(DISTINCT user_id) AS n_factors FROM fits GROUP BY 1
                  UNION ALL SELECT split, 'item', count(DISTINCT book_id) FROM fits GROUP BY 1)
        SELECT CAST(rank AS INTEGER) AS rank, true AS in_grid, true AS rmse_top_5_finite, split, side, n_factors
        FROM (SELECT unnest(range(11, 42, 2)) AS rank), sizes""",
    "foldin_grid": f"""
        WITH parts AS (SELECT *, {USER_PARTS} AS split FROM ratings),
        sampled AS (SELECT user_id FROM (SELECT DISTINCT user_id FROM parts WHERE split = 'val')
                    ORDER BY {hash_fraction_sql('user_id', seed=0)}, user_id LIMIT 1000),
        folds AS (SELECT count(DISTINCT user_id) AS n FROM parts WHERE user_id IN (SELECT user_id FROM sampled)
                  AND book_id IN (SELECT book_id FROM parts WHERE split = 'train'))
        SELECT CAST(r AS INTEGER) AS rank, negative, CAST(i AS INTEGER) AS iterations, alpha,
               ((r - 9) // 2) * 1000000 + CASE WHEN negative THEN 0 ELSE 500000 END + place * 1000 + nth AS position,
               n AS n_users, true AS converged, true AS similarity_in_range
        FROM (SELECT unnest(range(11, 42, 2)) AS r), (VALUES (true), (false)) AS m(negative),
             (VALUES (100, 1), (500, 2), (1000, 3)) AS p(i, place), (VALUES (0.01::DOUBLE, 1), (0.1, 2)) AS a(alpha, nth), folds""",
    "foldin_grid_best": "SELECT 192::BIGINT AS n_settings, 0::BIGINT AS n_better, 0::BIGINT AS n_earlier, count(*) > 0 AS in_grid FROM ratings",
    "recommend_from_als": f"""
        WITH parts AS (SELECT *, {USER_PARTS} AS split FROM ratings),
        trained AS (SELECT DISTINCT book_id FROM parts WHERE split <> 'test'),
        readers AS (SELECT DISTINCT user_id FROM parts WHERE split = 'test' AND book_id IN (SELECT book_id FROM trained)
                    AND book_id IN (SELECT best_book_id FROM classified)),
        free AS (SELECT user_id, best_book_id FROM readers,
                 (SELECT DISTINCT best_book_id FROM classified WHERE k_label IS DISTINCT FROM 8
                  AND best_book_id IN (SELECT book_id FROM trained))),
        unread AS (SELECT user_id, best_book_id FROM free ANTI JOIN ratings r ON free.user_id = r.user_id AND free.best_book_id = r.book_id)
        SELECT user_id, CAST(unnest(range(1, least(20, count(*)) + 1)) AS INTEGER) AS position, true AS unread, true AS trained,
               true AS shown, true AS in_order FROM unread GROUP BY user_id""",
    "score_items": """
        SELECT * FROM (SELECT user_id, item_id, score,
               CAST(row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS INTEGER) AS position
        FROM scores) WHERE position <= 50""",
    "unread_candidates": """
        SELECT * FROM (SELECT s.user_id, item_id, score,
               CAST(row_number() OVER (PARTITION BY s.user_id ORDER BY score DESC, item_id) AS INTEGER) AS position
        FROM scores s ANTI JOIN ratings r ON s.user_id = r.user_id AND s.item_id = r.book_id) WHERE position <= 50""",
    "rank_similarity": """
        WITH vec AS (SELECT user_id, alpha, list(value ORDER BY dim) AS u FROM folded_long WHERE iterations = 100
                     GROUP BY 1, 2),
        pos AS (SELECT user_id, alpha, id, row_number() OVER (PARTITION BY user_id, alpha
                ORDER BY round(list_dot_product(u, features), 6) DESC, id) AS p FROM vec CROSS JOIN item_factors),
        late AS (SELECT user_id, id, max(p) AS m FROM pos GROUP BY 1, 2),
        h AS (SELECT d, sum(1.0::DOUBLE / d) OVER (ORDER BY d DESC) AS tail
              FROM (SELECT unnest(range(1, (SELECT count(*) FROM item_factors) + 1)) AS d))
        SELECT user_id, round(avg(tail), 6) AS overlap FROM late JOIN h ON m = d GROUP BY 1""",
    "rank_overlap_top": """
        WITH both_lists AS (SELECT user_id, greatest(place, plain_place) AS m FROM placed
                            WHERE place <= 10 AND plain_place <= 10),
        h AS (SELECT d, sum(1.0::DOUBLE / d) OVER (ORDER BY d DESC) AS tail FROM (SELECT unnest(range(1, 11)) AS d))
        SELECT user_id, count(m) AS shared, round(coalesce(sum(tail), 0) / 10, 6) AS overlap
        FROM (SELECT DISTINCT user_id FROM placed) LEFT JOIN both_lists USING (user_id) LEFT JOIN h ON m = d GROUP BY 1""",
    "recommend_topk": """
        SELECT user_id, CAST(place AS INTEGER) AS position, best_book_id, author_id, race_gender,
               round(rating_guess, 6) AS rating_guess, round(boost, 6) AS boost, round(boosted_rating, 6) AS boosted_rating
        FROM placed WHERE place <= 10""",
    "recommend_unboosted": """
        SELECT user_id, CAST(plain_place AS INTEGER) AS position, best_book_id, author_id, race_gender,
               round(rating_guess, 6) AS rating_guess, round(boost, 6) AS boost
        FROM placed WHERE plain_place <= 10""",
    "recommend_final": """
        SELECT user_id, CAST(book_place AS INTEGER) AS position, best_book_id, title, k_label,
               round(boosted_rating, 6) AS boosted_rating FROM best_books WHERE book_place <= 20""",
    "topk_per_category": f"""
        WITH named AS (SELECT * FROM (VALUES {NAMES}) AS t(bucket, category)),
        bucketed AS (SELECT b.*, CASE WHEN t.k_label IS NULL THEN -1 ELSE b.k_label END AS bucket
                     FROM best_books b LEFT JOIN top_category t ON b.user_id = t.user_id AND b.k_label = t.k_label),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY user_id, bucket ORDER BY place) AS position FROM bucketed)
        SELECT user_id, category, CAST(position AS INTEGER) AS position, best_book_id, title,
               round(boosted_rating, 6) AS boosted_rating
        FROM ranked LEFT JOIN named USING (bucket) WHERE position <= 10""",
    "reviews_by_book": """
        SELECT best_book_id, review_id >> 12 AS part, string_agg(review_text, ' ' ORDER BY review_id) AS review_text
        FROM reviews WHERE review_text IS NOT NULL GROUP BY 1, 2""",
    "review_tokens": "SELECT best_book_id, word, count(*) AS tf FROM words GROUP BY 1, 2",
    "review_lemmas": """
        SELECT w.word, coalesce(lemma, w.word) AS lemma, n FROM (SELECT word, count(*) AS n FROM words GROUP BY 1) w
        LEFT JOIN lemma_of l ON w.word = l.word""",
    "review_clusters": """
        SELECT DISTINCT best_book_id AS book_id, true AS label_in_range, true AS nearest FROM reviews WHERE review_text IS NOT NULL""",
    "cluster_sizes": "SELECT k_label, count(*) AS n_books FROM kmeans GROUP BY 1",
    "cluster_titles": """
        SELECT k_label, position, best_book_id, title FROM (
            SELECT *, CAST(row_number() OVER (PARTITION BY k_label ORDER BY best_book_id) AS INTEGER) AS position
            FROM books WHERE k_label IS NOT NULL) WHERE position <= 15""",
    "cluster_terms": """
        WITH heavy AS (SELECT best_book_id, word, tf * (ln((1.0::DOUBLE + (SELECT count(DISTINCT best_book_id) FROM reviews
                         WHERE review_text IS NOT NULL)) / (1 + df)) + 1) AS raw FROM counts JOIN vocab USING (word)),
        unit AS (SELECT best_book_id, word, raw / sqrt(sum(raw * raw) OVER (PARTITION BY best_book_id)) AS weight FROM heavy),
        named AS (SELECT k_label, best_book_id, word, weight FROM unit JOIN kmeans ON best_book_id = book_id),
        means AS (SELECT k_label, word, round(sum(weight) / any_value(n), 6) AS weight FROM named
                  JOIN (SELECT k_label, count(DISTINCT best_book_id) AS n FROM named GROUP BY 1) USING (k_label) GROUP BY 1, 2)
        SELECT * FROM (SELECT k_label, CAST(row_number() OVER (PARTITION BY k_label ORDER BY weight DESC, word) AS INTEGER) AS position,
                              word, weight FROM means) WHERE position <= 15""",
    "review_tfidf": """
        WITH raw AS (SELECT best_book_id, word, tf * (ln((1.0::DOUBLE + (SELECT count(DISTINCT best_book_id) FROM reviews
                         WHERE review_text IS NOT NULL)) / (1 + df)) + 1) AS raw FROM counts JOIN vocab USING (word))
        SELECT best_book_id, word, round(raw / sqrt(sum(raw * raw) OVER (PARTITION BY best_book_id)), 6) AS weight
        FROM raw""",
}

# The layouts for large catalogues give the same rows.
for twin, base in (("foldin_nonneg_chunked", "foldin_nonneg"), ("foldin_gradient_chunked", "foldin_gradient"),
                   ("score_items_blocked", "score_items"), ("recommend_topk_blocked", "recommend_topk"),
                   ("review_clusters_10", "review_clusters")):
    STATEMENTS[twin] = STATEMENTS[base]

# The final list from raw shelves is the final list with the resolved shelf as the ratings.
FROM_SHELF = {"recommend_from_shelf": ("recommend_final", "WHERE book_place <= 10")}


def _used(text: str, views: dict[str, str]) -> set[str]:
    import re

    words = set(re.findall(r"[a-z_]+", text))
    return words & views.keys()


def _with_views(body: str, views: dict[str, str]) -> str:
    needed: set[str] = set()
    pending = _used(body, views)
    while pending:
        name = pending.pop()
        if name not in needed:
            needed.add(name)
            pending |= _used(views[name], views) - needed
    if not needed:
        return body
    parts = ",\n".join(f"{name} AS ({views[name]})" for name in views if name in needed)
    body = body.strip()
    recursive = "RECURSIVE " if body.startswith("WITH RECURSIVE ") else ""
    body = body.replace("WITH RECURSIVE ", "WITH ", 1)
    return f"WITH {recursive}{parts}\n" + (", " + body[5:] if body.startswith("WITH ") else body)


def all_sql() -> dict[str, str]:
    statements = {name: _with_views(body, VIEWS) for name, body in STATEMENTS.items()}
    # The resolved shelf replaces the ratings: raw ratings keep feeding the shelf under another name.
    shelf_views: dict[str, str] = {"first_ratings": VIEWS["ratings"]}
    for name in ("books_detail", "kmeans", "books", "isbn_map_raw", "isbn_map", "shelf_raw", "shelf_rows"):
        shelf_views[name] = VIEWS[name].replace("FROM ratings", "FROM first_ratings")
    shelf_views["ratings"] = """
        SELECT user_id, best_book_id AS book_id, max(rating) AS rating FROM shelf_rows
        WHERE best_book_id IS NOT NULL AND rating > 0 GROUP BY 1, 2"""
    shelf_views |= {k: v for k, v in VIEWS.items() if k not in shelf_views}
    for name, (base, cut) in FROM_SHELF.items():
        body = STATEMENTS[base].replace("WHERE book_place <= 20", cut)
        statements[name] = _with_views(body, shelf_views)
    return statements
