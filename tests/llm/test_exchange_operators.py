"""Dual-tree search, source divergence and fingerprint exchange against brute force."""

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from tomewise.llm import divergence, dualtree, golomb
from tomewise.llm.terms import LETTERS, counts_by_text, term_column, term_hashes

WORDS = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LETTER_RUNS = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def corpus(rows=160, seed=3):
    """Documents of two languages with copies, nulls, empty, very long and odd texts."""
    rng = random.Random(seed)
    stems = {"aa": [f"ka{i}" for i in range(40)] + ["Élan", "élan"], "bb": [f"Öz{i}" for i in range(30)] + ["ka1", "ka2"]}
    out = []
    for i in range(rows):
        lang = rng.choice(["aa", "bb"])
        length = rng.choice([0, 1, 3, 20, 60])
        text = rng.choice([" ", "-", "\n"]).join(rng.choice(stems[lang]) for _ in range(length))
        out.append((i, text, lang, rng.choice(["s0", "s0", "s0", "s1", "s2"]), len(text)))
    out += [(1000 + i, "Same TEXT of ka1 " + "x" * (i % 2), "aa", "s0", 1) for i in range(40)]
    out += [(2000, None, None, None, None), (2001, "", "aa", "s9", 0), (2002, None, "aa", "s1", 0), (None, "ka3 ka4", "bb", "s2", 0)]
    out += [(2003, "ka5 " * 30000, "aa", "s1", 0), (2004, "same text of ka1 ", "bb", "s1", 0), (2004, "same text of ka1 ", "bb", "s1", 0)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(3).withColumnsRenamed({})


def test_terms_of_a_column():
    texts = ["Abc déf1 x", "", "--", "Z"]
    terms, first = term_column([t.encode() for t in texts], LETTERS)
    assert [t.decode() for t in terms.to_pylist()] == ["abc", "déf", "x", "z"]
    assert first.tolist() == [0, 3, 3, 3, 4]
    assert len(set(term_hashes(term_column([b"a b " + b"c" * 100 + b" " + b"c" * 101], LETTERS)[0]).tolist())) == 4
    code, text, times = counts_by_text(np.array([2, 2, -1, 0, 2]), np.array([0, 3, 5]))
    assert list(zip(code, text, times)) == [(0, 1, 1), (2, 0, 2), (2, 1, 1)]


@pytest.mark.parametrize("top", [1, 7, 1000, 1 << 40])
def test_golomb_code_round_trip(top):
    rng = np.random.default_rng(top % 97)
    values = np.unique(rng.integers(0, top, 500))
    coded = golomb.golomb_encode(values)
    assert golomb.golomb_decode(len(values), *coded).tolist() == values.tolist()
    # Within half a bit of what the gaps need, and two for the quotient.
    assert 8 * (len(coded[1]) + len(coded[2])) <= len(values) * (math.log2(max(2, top / len(values))) + 2.5) + 16


def expected_groups(rows):
    groups = defaultdict(list)
    for doc, text, *_ in rows:
        groups[lowered(text)].append(doc)
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = max(known) if known else None
        out += [(i, keep, len(ids), i == keep) for i in ids]
    return sorted(out, key=str)


@pytest.mark.parametrize("spare, sender", [(10, 1 << 16), (-3, 20)])
def test_exact_groups_equal_brute_force(docs, monkeypatch, spare, sender):
    """Also with fingerprints so short that most rows are suspects, and many senders."""
    monkeypatch.setattr(golomb, "SPARE_BITS", spare)
    monkeypatch.setattr(golomb, "SENDER_ROWS", sender)
    clash = docs.selectExpr("*", "1 AS sender", "2 AS owner", "'x' AS text_sha256", "3 AS file", "4 AS row")
    found = golomb.exact_groups(clash, round_rows=50)
    assert found.columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    got = found.collect()
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got), key=str) == expected_groups(corpus())
    assert {r.text_sha256 for r in got if r.doc_id == 2001} == {"e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"}


def test_exact_groups_of_a_scan_and_of_nothing(spark, docs, tmp_path):
    path = str(tmp_path / "docs")
    docs.write.parquet(path)
    got = golomb.exact_groups(spark.read.parquet(path), scan=True, round_rows=60)
    assert sorted(((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got.collect()), key=str) == expected_groups(corpus())
    assert golomb.exact_groups(docs.limit(0)).collect() == []


def test_owners_reply_only_with_shared_entries(spark, docs):
    """A bit is set for every row whose text occurs twice, and for few others."""
    rows = golomb.stored(docs.select("doc_id", "text"), "t").selectExpr(
        "xxhash64(_metadata.file_path) AS file", "_metadata.row_index AS row", "text", "doc_id")
    bits = golomb.suspect_bits(rows.select("file", "row", "text"), 200)
    marked = {(r.file, (r.block << 12) + 64 * w + b) for r in bits.collect() for w, word in enumerate(r.words) for b in range(64) if word >> b & 1}
    texts = Counter(lowered(t) for _, t, *_ in corpus())
    expected = {(r.file, r.row) for r in rows.collect() if texts[lowered(r.text)] > 1}
    assert expected <= marked and len(marked) <= len(expected) + 3


def expected_divergence(rows, min_docs, top):
    groups, df = defaultdict(Counter), defaultdict(Counter)
    for _, text, lang, source, _ in rows:
        terms = LETTER_RUNS.findall(lowered(text))
        groups[lang or "", source or ""].update(terms)
        df[lang or ""].update(set(terms))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in df[lang].items() if n >= min_docs]
        own = {s: {t: groups[g][t] for t in kept} for g in groups if g[0] == lang for s in [g[1]]}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}

        def shares(c):
            total = sum(c.values()) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        q, p = shares(whole), {s: shares(c) for s, c in own.items()}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in own:
            pairs = [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in own if o != s]
            stands = [(f(p[s][t], q[t]), t) for t in kept if own[s][t] > 0 and p[s][t] > q[t]]
            for part, items, last in (("pair", pairs, None), ("term", stands, top)):
                items.sort(key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, value, i + 1) for i, (value, item) in enumerate(items[:last])]
    return sorted(out)


@pytest.mark.parametrize("min_docs, bucket_docs", [(10, 1 << 13), (1, 5), (10**6, 10)])
def test_divergence_equals_brute_force(docs, min_docs, bucket_docs):
    clash = docs.selectExpr("*", "1 AS g", "2 AS lang_no", "3 AS value", "'y' AS term")
    got = divergence.divergence(clash, min_docs=min_docs, bucket_docs=bucket_docs, top=4)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    assert sorted(map(tuple, got.collect())) == expected_divergence(corpus(), min_docs, 4)


def test_divergence_in_small_slices_and_of_nothing(docs, monkeypatch):
    monkeypatch.setattr(divergence, "SLICE_BYTES", 300)
    assert sorted(map(tuple, divergence.divergence(docs, min_docs=3).collect())) == expected_divergence(corpus(), 3, 10)
    assert divergence.divergence(docs.limit(0)).collect() == []


def test_shares_of_very_large_totals():
    counts, total = np.array([0, 7, 10**15]), 9 * 10**15
    assert divergence.share(counts, total).tolist() == [1 + 10**9 * (c + 2) // total for c in counts.tolist()]


def items_table(spark):
    rows = [(0, "ka1 KA2 ka3 ka4 ka5"), (1, "öz1 Öz2 Öz3 Élan"), (2, None), (3, "nowhere"), (4, "same text, of x")]
    rows += [(5, "ka7"), (5, "ka8 ka8"), (None, "ka9 ka10")] + [(10 + i, f"ka{i} ka{i + 1} Öz{i}") for i in range(25)]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


def expected_ranks(rows, items, k):
    docs = [(d, Counter(WORDS.findall(lowered(t)))) for d, t, *_ in rows]
    docs = [(d, c) for d, c in docs if c]
    n, length = len(docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    terms = defaultdict(set)
    for i, t in items:
        terms[i] |= set(WORDS.findall(lowered(t)))
    out = []
    for item, ts in terms.items():
        scored = []
        for d, c in docs:
            m = 10 + 90 * sum(c.values()) * n // length
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in ts if c[t])
            if score > 0:
                scored.append((-score, d is None, d or 0, d))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


@pytest.mark.parametrize("cells, item_block, k", [(1 << 23, 1024, 10), (64 * 40, 7, 3)])
def test_ranked_search_equals_brute_force(spark, docs, monkeypatch, cells, item_block, k):
    """Also with small trees and items in several blocks."""
    monkeypatch.setattr(dualtree, "CELLS", cells)
    rows, items = items_table(spark)
    clash = docs.selectExpr("*", "1 AS n", "2 AS terms", "3 AS times", "4 AS item")
    got = dualtree.ranked_search(clash, items.selectExpr("*", "5 AS term", "6 AS item"), k=k, item_block=item_block, parts=3)
    assert sorted(map(tuple, got.collect()), key=str) == expected_ranks(corpus(), rows, k)


def test_ranked_search_of_nothing(spark, docs):
    _, items = items_table(spark)
    assert dualtree.ranked_search(docs.limit(0), items).collect() == []
    assert dualtree.ranked_search(docs, items.limit(0)).collect() == []
    assert dualtree.ranked_search(docs.where("text IS NULL"), items).collect() == []


def test_whole_batches_are_passed_over(spark):
    """Items of one vocabulary never meet the documents of another, nor those far below the k-th score."""
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice([f"{'ab'[i % 2]}{j}" for j in range(400)]) for _ in range(30)), "x", "s", 0) for i in range(4000)]
    items = [(i, " ".join(f"{'ab'[i % 2]}{rng.randrange(400)}" for _ in range(6))) for i in range(40)]
    work = []
    got = dualtree.ranked_search(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(items, "item_id long, text string"), work=work)
    assert sorted(map(tuple, got.collect()), key=str) == expected_ranks(rows, items, 10)
    scored, bounded, possible = work[0]
    assert 3900 * 40 < possible <= 4000 * 40 and scored < possible / 20 and bounded < possible / 2
