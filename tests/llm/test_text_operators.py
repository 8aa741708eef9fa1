"""Operators on texts against brute force, exact round trips and held-out accuracy, with awkward rows."""

import collections
import itertools
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomewise.llm import bytecnn, gru, jaccard, langid, linededup, lmscore, mixing, pieces, toxicity
from tomewise.llm.cuckoo import CuckooFilter
from tomewise.llm.gru import GatedModel
from tomewise.llm.tables import components
from tomewise.llm.words import Words, shingles

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
SF = "/root/testdata/sf0.001"


def frame(spark, texts, source=None, schema=DOCS):
    rows = [(i, t, "en", (source or {}).get(i, "a"), len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, schema)


def awkward(spark):
    """Null and empty texts, a very long one, repeated rows and columns whose names clash with work columns."""
    long = " ".join(f"word{i}" for i in range(30_000))
    texts = [None, "", " \n\t ", "one two", "one two", long, "a b c d e f g h", "A B C D E F G H", "a b c d e f g h"]
    df = frame(spark, texts)
    for name in ("key", "part", "id", "row", "label", "vec", "_keys", "bucket", "word", "ids_extra"):
        df = df.withColumn(name, F.lit("x"))
    return df.union(df.where("doc_id = 3"))


# Words


def test_words_and_shingles_match_python():
    rng = random.Random(1)
    texts = ["".join(rng.choice("aBc é\n\t\x0b\x0c\r  ") for _ in range(rng.randrange(0, 60))).encode() for _ in range(200)]
    words = Words(texts)
    plain = [t.lower().split() for t in texts]
    assert np.diff(words.first).tolist() == [len(p) for p in plain]
    hashes = words.hashes()
    by_word = {}
    for word, h in zip(itertools.chain(*plain), hashes.tolist()):
        assert by_word.setdefault(word, h) == h
    assert len(set(by_word.values())) == len(by_word)
    grams, text = shingles(hashes, words.first, 5)
    got = [set(grams[text == i].tolist()) for i in range(len(texts))]
    sets = [{tuple(p[k : k + 5]) for k in range(max(len(p) - 4, 1))} if p else set() for p in plain]
    assert [len(g) for g in got] == [len(s) for s in sets]
    for i, j in itertools.combinations(range(60), 2):
        assert len(got[i] & got[j]) == len(sets[i] & sets[j])


# Line dedup


def lines_by_hand(rows):
    keys = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            key = linededup.line_key(line.encode())
            if key is not None and doc is not None:
                keys.setdefault(key, set()).add(doc)
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if not (
            doc is not None and (k := linededup.line_key(x.encode())) is not None and len(keys[k]) > 1 and doc != min(keys[k]))]
        out.append((doc, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def line_rows(n, seed):
    rng = random.Random(seed)
    pool = [f"shared line number {i}" for i in range(8)] + ["  SHARED line number 1\t", "short", "", "zehn zeiché", "0123456789"]
    return [(i, None if rng.random() < 0.05 else "\n".join(rng.choice(pool) if rng.random() < 0.6 else f"own line {i} {j}"
             for j in range(rng.randrange(1, 6)))) for i in range(n)]


def test_cuckoo_filter_holds_all_keys_and_forgets_deleted_ones():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 1 << 63, 20_000).astype(np.uint64))
    held = CuckooFilter.build(keys)
    assert held.contains(keys).all()
    again = CuckooFilter.from_bytes(held.to_bytes())
    again.discard(keys[:5000])
    assert again.contains(keys[5000:]).all()
    assert again.contains(keys[:5000]).mean() < 0.01
    small = CuckooFilter.for_keys(10)
    assert not small.add(keys)  # does not fit: the caller rebuilds


def test_line_dedup_matches_brute_force(spark):
    rows = line_rows(60, 2) + [(None, "shared line number 1\nshared line number 2"), (5, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in linededup.dedup_lines(df).collect()]
    assert sorted(got, key=str) == lines_by_hand(rows)


def test_line_index_is_incremental_and_reversible(spark):
    rows = line_rows(50, 3)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = linededup.LineIndex(spark, shards=3)
    index.insert(df.where("doc_id < 20")).insert(df.where("doc_id >= 20 AND doc_id < 45"))
    index.delete(df.where("doc_id % 3 = 0").select("doc_id"))
    index.insert(df.where("doc_id >= 45"))
    stays = df.where("doc_id >= 45 OR doc_id % 3 <> 0")
    got = [(r.doc_id, r.n_lines, r.n_dropped, r.text or "") for r in index.deduplicate(stays).collect()]
    assert sorted(got, key=str) == lines_by_hand([r for r in rows if r[0] >= 45 or r[0] % 3])
    filters = {r.shard: CuckooFilter.from_bytes(r.filter) for r in index.filters.collect()}
    for r in index.counts.select("shard", F.xxhash64("key").alias("h")).collect():
        assert filters[r.shard].contains(np.array([r.h]).view(np.uint64)).all()


# Mixing


def test_mixing_reaches_target_shares_and_repeats(spark):
    docs = spark.range(6000).selectExpr(
        "id AS doc_id", "repeat('x', 50) AS text", "CASE WHEN id % 3 = 0 THEN 'big' WHEN id % 300 = 1 THEN NULL ELSE 'mid' END AS source")
    mixed = mixing.mix(docs, {"big": 1.0, "mid": 3.0}, default_weight=1.0)
    shares = {r.source: r.n / 6000 for r in mixed.groupBy("source").agg(F.count("*").alias("n")).collect()}
    assert shares["big"] == pytest.approx(0.2, abs=0.03) and shares["mid"] == pytest.approx(0.6, abs=0.04)
    assert shares[None] == pytest.approx(0.2, abs=0.03)  # 20 documents, each about 60 times
    again = mixing.mix(docs.repartition(7), {"big": 1.0, "mid": 3.0}, default_weight=1.0)
    assert sorted(map(tuple, mixed.select("doc_id", "copy_number").collect())) == sorted(
        map(tuple, again.select("doc_id", "copy_number").collect()))
    assert mixed.columns == [*docs.columns, "copy_number"]


def test_poisson_table_and_large_means(spark):
    cdf = spark.range(1).select(mixing.poisson_cdf(F.lit(2.5)).alias("c")).first().c
    want = list(itertools.accumulate(math.exp(-2.5) * 2.5**k / math.factorial(k) for k in range(len(cdf))))
    assert np.allclose(cdf, want)
    docs = spark.range(40).selectExpr("id AS doc_id", "'abc' AS text", "IF(id = 0, 'rare', 'rest') AS source")
    n = mixing.mix(docs, {"rare": 99.0, "rest": 1.0}, total_chars=30_000).where("source = 'rare'").count()
    assert n == pytest.approx(9900, abs=400)


def test_mixing_awkward_rows(spark):
    df = awkward(spark)
    out = mixing.mix(df, {}).collect()
    assert set(out[0].asDict()) == {*df.columns, "copy_number"}
    assert mixing.mix(df.limit(0), {}).count() == 0
    empty = df.where("doc_id = 1")
    assert mixing.mix(empty, {"a": 5.0}).count() >= 0  # a source without characters keeps rate 1


# Jaccard


def jaccard_by_hand(texts):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} if w else set())
    label = list(range(len(texts)))
    changed = True
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2)
             if sets[i] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j])]
    while changed:
        changed = False
        for i, j in links:
            low = min(label[i], label[j])
            changed |= label[i] != label[j]
            label[i] = label[j] = low
    return [(i, len(s), c) for i, (s, c) in enumerate(zip(sets, label))]


def near_texts(n, seed):
    rng = random.Random(seed)
    base = [[f"w{rng.randrange(400)}" for _ in range(rng.randrange(3, 60))] for _ in range(12)]
    common = [f"c{k}" for k in range(30)]
    out = [None, "", "  \n", "x", "X", "one two three"]
    for _ in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.randrange(0, 4)):
            words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            words += common
        out.append(" ".join(words))
    return out


def test_jaccard_matches_brute_force(spark):
    texts = near_texts(220, 4)
    got = jaccard.jaccard_groups(frame(spark, texts).withColumn("component_id", F.lit("clash")))
    assert sorted(map(tuple, got.collect())) == jaccard_by_hand(texts)


def test_jaccard_large_groups_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "ROW_BLOCK", 7)
    texts = near_texts(150, 5)
    got = jaccard.jaccard_groups(frame(spark, texts))
    assert sorted(map(tuple, got.collect())) == jaccard_by_hand(texts)


def test_jaccard_hot_ngrams(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "HOT_SHARE", 1 << 30)
    texts = ["boiler plate text that everyone has " * 3 + f"own {i} words {i * 7} here" for i in range(80)] + near_texts(60, 6)
    got = jaccard.jaccard_groups(frame(spark, texts))
    assert sorted(map(tuple, got.collect())) == jaccard_by_hand(texts)


def test_jaccard_awkward_rows(spark):
    rows = {r.doc_id: r for r in jaccard.jaccard_groups(awkward(spark)).collect()}
    assert sorted(rows) == list(range(9))
    assert rows[0].n_shingles == rows[1].n_shingles == rows[2].n_shingles == 0
    assert [rows[i].component_id for i in (0, 1, 2, 4, 7, 8)] == [0, 1, 2, 3, 6, 6]
    assert jaccard.jaccard_groups(awkward(spark).limit(0)).count() == 0


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (None, 3), (500, 499)]
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 130)) and got[500] == 499
    assert len(got) == 41 + 30 + 2


# Pieces


@pytest.fixture(scope="module")
def model():
    return pieces.PieceModel.load(pieces.default_model_path())


def log_scores():
    """By hand: every normal piece of the file in the order of its score, the r-th with a share in proportion to 1 / r."""
    import sentencepiece

    file = sentencepiece.SentencePieceProcessor(model_file=pieces.default_model_path())
    falling = sorted(range(259, file.get_piece_size()), key=lambda i: -file.get_score(i))
    place, out = 0, {}
    for at, i in enumerate(falling):
        if at == 0 or file.get_score(i) != file.get_score(falling[at - 1]):
            place = at + 1
        out[i] = 1 / place
    total = math.fsum(out.values())
    return {i: math.log(share / total) for i, share in out.items()}


def library():
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(pieces.default_model_path(), "rb") as f:
        proto.ParseFromString(f.read())
    proto.trainer_spec.model_type = 1  # the same vocabulary read as a unigram model
    for i, score in log_scores().items():
        proto.pieces[i].score = score
    return sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def best_score(model, pieces_, text):
    """The best total by the definition, character by character over whole texts; None where a character has no piece."""
    data = "\u2581" + text.replace(" ", "\u2581")
    best = [0.0] + [-math.inf] * len(data)
    for i in range(len(data)):
        for j in range(i + 1, min(i + 48, len(data)) + 1):
            if data[i:j] in pieces_ and best[i] + pieces_[data[i:j]] > best[j]:
                best[j] = best[i] + pieces_[data[i:j]]
    return best[-1] if best[-1] > -math.inf else None


def test_pieces_are_the_best_path(spark, model):
    reference = library()
    known = {reference.id_to_piece(i): score for i, score in log_scores().items()}
    lines = [line for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect() for line in r.text.split("\n")]
    lines = [x for x in lines if x and len(x) < 400][:300]
    ids, at = model.encode([x.encode() for x in lines])
    for x, a, b in zip(lines, at[:-1], at[1:]):
        total, best = model.score[ids[a:b]].sum(), best_score(model, known, x)
        assert best is None or total == pytest.approx(best, abs=1e-8)
        assert "  " in x or total >= model.score[reference.encode(x)].sum() - 1e-8  # the library's path is never better
        assert reference.decode(ids[a:b].tolist()) == x


def test_round_trip_and_awkward_rows(spark, model):
    strange = ["", " ", "  two  spaces ", "tab\tand\nnewline\r\n", "日本語 😀 é", "▁ marker", "x" * 50_000, "a  b" * 9]
    ids, at = model.encode([s.encode() for s in strange])
    back = [b.decode() for b in model.decode(ids, at)]
    assert back == [s.replace("▁", " ") for s in strange]
    coded = pieces.encode(awkward(spark).withColumn("n_tokens", F.lit("clash")), check=True)
    rows = coded.collect()
    assert all(r.round_trip for r in rows if r.text is not None)
    assert [r.ids for r in rows if r.text is None] == [None] and {r.n_tokens for r in rows if not r.text} == {0}
    decoded = pieces.decode(coded.withColumnRenamed("text", "was")).select("was", "text").collect()
    assert all(r.was == r.text for r in decoded)
    assert pieces.encode(awkward(spark).limit(0)).count() == 0


def test_long_words_and_ties_take_the_best_path(model):
    for word in ("thntblere", "unbelievable", "internationalization" * 20, "aaaaaaaaaaaaa"):
        ids, _ = model.encode([word.encode()])
        score = model.score[ids].sum()
        data = b"\xff" + word.encode()
        lengths = [len(model.surface[model.surface_at[i] : model.surface_at[i + 1]]) for i in ids]
        assert sum(lengths) == len(data)
        best = np.full(len(data) + 1, -np.inf)
        best[0] = 0
        begin, stop, piece = model.trie.matches(np.frombuffer(data, np.uint8), np.full(len(data), len(data)), np.arange(len(data)))
        for i in range(len(data)):
            for b, s, p in zip(begin[begin == i], stop[begin == i], piece[begin == i]):
                best[s] = max(best[s], best[b] + model.score[p])
        assert score == pytest.approx(best[-1], abs=1e-8), word


def test_scores_are_log_shares_and_frequent_words_are_one_piece(model):
    assert np.allclose([model.score[i] for i in log_scores()], list(log_scores().values()))
    ids, _ = model.encode([b"The quality of the device depends on every component"])
    assert len(ids) == 9


# Toxicity, quality, language: held-out accuracy on the supplied tables


@pytest.fixture(scope="module")
def labelled(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs, spark.read.parquet(f"{sf}/labels.parquet")


def test_toxicity_chain_on_held_out_documents(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    categories = {"low_quality": F.col("quality") == 0, "toxic": F.col("toxic") == 1}
    chain = toxicity.fit_chain(docs.where("doc_id % 3 <> 0"), labels, categories)
    assert len(chain.models[1].dense) == 1  # the second model is given the first one's probability
    rows = toxicity.score(docs.where("doc_id % 3 = 0"), chain).join(labels, "doc_id").select("p_toxic", "toxic", "p_low_quality", "quality").collect()
    # Some non-English documents are labelled toxic without a word that others share; clean ones must stay.
    assert np.mean([r.p_toxic >= 0.5 for r in rows if r.toxic]) > 0.75
    assert np.mean([r.p_toxic >= 0.5 for r in rows if not r.toxic]) < 0.01
    assert np.mean([(r.p_low_quality >= 0.5) == (r.quality == 0) for r in rows]) > 0.8


def test_toxicity_awkward_rows(spark, labelled):
    _, labels = labelled
    categories = {"toxic": F.col("toxic") == 1}
    none = toxicity.fit_chain(awkward(spark), labels.limit(0), categories)
    rows = toxicity.score(awkward(spark).withColumn("p_toxic", F.lit("clash")), none).collect()
    assert len(rows) == 10 and {r.p_toxic for r in rows} == {0.5}


def test_later_models_see_out_of_fold_probabilities():
    rng = np.random.default_rng(0)
    texts = [" ".join(rng.choice(["apple", "pear", "plum", "grape", "idiot"], 6)).encode() for _ in range(400)]
    first = np.array([b"idiot" in t for t in texts], dtype=float)
    chain = toxicity.Chain(["insult", "harm"]).fit(texts, np.column_stack((first, first)))
    found = chain.predict(texts)
    assert ((found[:, 1] > 0.5) == first.astype(bool)).mean() > 0.98


def test_quality_network(spark, labelled):
    docs, labels = labelled
    net = bytecnn.fit_quality(docs.where("doc_id % 3 <> 0"), labels, F.col("quality"))
    rows = bytecnn.score(docs.where("doc_id % 3 = 0"), net).join(labels, "doc_id").select("score", "quality").collect()
    assert np.mean([(r.score >= 0.7) == bool(r.quality) for r in rows]) > 0.9
    odd = bytecnn.score(awkward(spark).withColumn("score", F.lit("clash")), net).collect()
    assert len(odd) == 10 and all(0 <= r.score <= 1 for r in odd)


def test_network_pools_every_byte():
    """Responses against the definition, and a change anywhere can change the score."""
    net = bytecnn.ByteNet(filters=4).ready()
    text = bytes(np.random.default_rng(1).integers(32, 127, 70_000).astype(np.uint8))
    data, first = bytecnn.padded([text, b"", text[:300]])
    got = net._halves(data)
    taps = net.p["taps"]
    n = first[-1] * bytecnn.HALF
    want = sum(taps[j][data[j : j + n]] for j in range(bytecnn.WIDTH)).reshape(first[-1], bytecnn.HALF, 4).max(1)
    assert np.allclose(got, want, atol=1e-5)
    assert first.tolist()[1] * bytecnn.HALF >= len(text) + bytecnn.WIDTH


def test_network_gradients_match_differences():
    net = bytecnn.ByteNet(filters=3, seed=5)
    texts, labels = [b"abcabc !! " * 40, b"quiet words here " * 30, b""], np.array([0.0, 1.0, 1.0])

    def loss():
        net.ready()
        p = net.predict(texts)
        return -np.mean(labels * np.log(p) + (1 - labels) * np.log(1 - p))

    grads = net._gradients(texts, labels)
    for name, at in (("mean", (1,)), ("max", (0,)), ("bias", (2,)), ("out", (0,))):
        before = net.p[name][at]
        net.p[name][at] = before + 1e-2
        up = loss()
        net.p[name][at] = before - 1e-2
        down = loss()
        net.p[name][at] = before
        assert grads[name][at] == pytest.approx((up - down) / 2e-2, rel=0.05, abs=2e-4)


def test_language_model(spark, labelled):
    docs, _ = labelled
    model = langid.fit_language_model(docs.where("doc_id % 3 <> 0"), F.col("lang"))
    assert (model.weights == 0).mean() > 0.3  # the elastic net leaves most weights at zero
    rows = langid.identify(docs.where("doc_id % 3 = 0"), model).select("lang", "lang_pred", "score").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    odd = {r.doc_id: r for r in langid.identify(awkward(spark).withColumn("lang_pred", F.lit(1)), model).collect()}
    assert all(odd[i].lang_pred == "und" and odd[i].score == 0 for i in (0, 1, 2)) and odd[3].lang_pred in model.labels
    none = langid.fit_language_model(docs.limit(0), F.col("lang"))
    assert {r.lang_pred for r in langid.identify(awkward(spark), none).collect()} == {"und"}


def test_ngram_counts_match_python_across_blocks(monkeypatch):
    monkeypatch.setattr(langid, "BLOCK", 7)
    texts = [b"Abab cab", b"", "äöü abc".encode(), b"z"]
    text, _, count = langid.gram_counts(texts)
    for i, t in enumerate(texts):
        s = t.decode().lower()
        total = sum(max(len(s) - k + 1, 0) for k in (1, 2, 3))
        assert count[text == i].sum() == total


# Language-model scores


def test_scores_are_exact_against_brute_force(spark):
    rng = random.Random(8)
    texts = [" ".join(rng.choice(["the", "The", "of", "cat", "dog", f"w{rng.randrange(50)}"]) for _ in range(rng.randrange(0, 40)))
             for _ in range(120)] + [None, ""]
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in lmscore.lm_scores(docs, F.col("doc_id") % 4 != 0, model_words=5, sent_words=8).collect()}
    tokens = [(t or "").encode().lower().split() + [None] for t in texts]
    counts = {}
    for i, words in enumerate(tokens):
        if i % 4:
            for w in words:
                counts[w] = counts.get(w, 0) + 1
    n, v = sum(counts.values()), len(counts)
    for i, words in enumerate(tokens):
        assert got[i].n_tokens == len(words) and got[i].train_tokens == n
        assert got[i].n_known == sum(w in counts for w in words)
        assert got[i].base_score == pytest.approx(sum(math.log10((counts.get(w, 0) + 1) / (n + v + 1)) for w in words))
        assert got[i].score < 0


def test_gru_is_a_distribution_and_carries_its_state():
    rng = np.random.default_rng(0)
    model = GatedModel(np.array([50, 40, 30, 20, 10, 5, 4.0]), np.array([6.0, 3.0]), hidden=8)
    ids = np.insert(rng.integers(1, 9, 4000), np.arange(0, 4000, 50), 0)
    model.train(ids, 60)
    model.ready()
    one = np.array([model.log_probabilities(np.array([1, 2, w]), np.array([0, 3]))[0] for w in range(9)])
    ended = np.array([model.log_probabilities(np.array([1, 2]), np.array([0, 2]))[0]])
    assert len(one) == 9 and np.isfinite(one).all() and np.isfinite(ended).all()
    # Over all next tokens the probabilities add to one: words and rare classes after the same beginning.
    h, last, logs = np.zeros((1, 8), np.float32), 0, []
    for w in (1, 2):
        h, *_ = model._step(model.folded[[last]], h)
        last = w
    h, *_ = model._step(model.folded[[last]], h)
    logs = [model._log_output(h, np.array([w]))[0] for w in range(9)]
    assert np.exp(logs).sum() == pytest.approx(1, abs=1e-4)
    # Scored in windows or one by one, a long text has the same probability.
    long = rng.integers(1, 9, 700)
    whole = model.log_probabilities(np.concatenate((long, long[:3])), np.array([0, 700, 703]))
    h, last, total = np.zeros((1, 8), np.float32), 0, 0.0
    for w in [*long.tolist(), 0]:
        h, *_ = model._step(model.folded[[last]], h)
        total += model._log_output(h, np.array([w]))[0]
        last = w
    assert whole[0] == pytest.approx(total, rel=1e-4)


def test_texts_share_lanes_and_are_scored_each_by_itself(monkeypatch):
    """Steps are what the lanes hold, not the longest text of every group of them; the state starts anew in each text."""
    model = GatedModel(np.arange(40, 0, -1).astype(float), np.ones(6))
    rng = np.random.default_rng(5)
    model.p["classes"][:], model.p["words"][:] = rng.normal(0, 1, model.p["classes"].shape), rng.normal(0, 1, model.p["words"].shape)
    model.ready()
    length = np.array([90, 0, 3, 55, 7, 7, 0, 31, 62, 1, 18, 40, 2, 77, 5, 25])
    first = np.concatenate(([0], np.cumsum(length)))
    ids = rng.integers(1, 46, first[-1])
    alone = [model.log_probabilities(ids[a:b], np.array([0, b - a]))[0] for a, b in zip(first, first[1:])]
    steps, step = [], model._step
    monkeypatch.setattr(model, "_step", lambda x, h: steps.append(len(h)) or step(x, h))
    monkeypatch.setattr(gru, "SCORE_ROWS", 4)
    monkeypatch.setattr(gru, "SCORE_STATES", 100)
    found = model.log_probabilities(ids, first)
    np.testing.assert_allclose(found, alone, rtol=1e-6)
    assert sum(steps) == length.sum() + len(length)
    assert len(steps) <= -(-sum(steps) // 4) + 8  # 91 + 63 + 19 + 6 with groups of like length
    assert model.log_probabilities(ids[:0], np.zeros(1, dtype=int)).shape == (0,)


def test_gru_gradients_match_differences():
    model = GatedModel(np.array([5.0, 4, 3, 2]), np.array([2.0]), hidden=3)
    for name in ("words", "classes"):
        model.p[name] = np.random.default_rng(2).normal(0, 0.3, model.p[name].shape).astype(np.float32)
    state = np.random.default_rng(3).normal(0, 1, (6, 3)).astype(np.float32)
    target = np.array([0, 1, 2, 3, 4, 1])
    _, d_state, grads = model._output_gradients(state, target)
    for name, at in (("classes", (1, 1)), ("words", (0, 1, 1)), ("class_bias", (0,))):
        before = model.p[name][at]
        model.p[name][at] = before + 1e-2
        up = model._output_gradients(state, target)[0]
        model.p[name][at] = before - 1e-2
        down = model._output_gradients(state, target)[0]
        model.p[name][at] = before
        assert grads[name][at] == pytest.approx((up - down) / 2e-2, abs=1e-3)


def test_model_beats_counts_on_held_out_documents(spark, labelled):
    docs, _ = labelled
    rows = lmscore.lm_scores(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 != 2).where("NOT learned").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 7 == 2 for r in rows)
    assert sum(r.score for r in rows) > 0.95 * sum(r.base_score for r in rows)  # log10, so less negative is better


def test_every_learning_text_reaches_the_weights(spark):
    texts = [" ".join(f"w{(i * k) % 23}" for k in range(1, 2 + i % 60)) for i in range(300)] + [None, ""]
    docs = frame(spark, texts).repartition(3)
    scorer, _ = lmscore.count_scorer(lmscore.word_counts(docs), model_words=9, sent_words=12)
    inputs = lmscore.dealt_inputs(docs, scorer, 2, "doc_id", "text")
    assert inputs.count() == len(texts) and {r[0] for r in inputs.select("round").distinct().collect()} == {0, 1}
    got = collections.Counter(tuple(r.ids) for r in inputs.collect())
    best = scorer.inputs >= 0
    known = dict(zip(scorer.words[best].tolist(), scorer.inputs[best].tolist()))
    want = collections.Counter()
    for t in texts:
        word, rare, _ = lmscore.word_hashes([(t or "").encode()])
        want[(*[known.get(w, scorer.model.n_words + c) for w, c in zip(word.tolist(), rare.tolist())], 0)] += 1
    assert got == want
    before = scorer.model.copy()
    trained = lmscore.train_on_all(inputs, scorer.model, (0.01, 0.01))
    assert all((before.p[k] == scorer.model.p[k]).all() for k in before.p)  # the start is left as it was
    assert any((before.p[k] != trained.p[k]).any() for k in before.p)
    # A round in one task is the same as learning from its texts in this process.
    alone = spark.createDataFrame([(list(t), 0) for t in want], "ids array<int>, round int").coalesce(1)
    here = before.copy()
    here.learn(iter([np.concatenate([np.array(r.ids) for r in alone.collect()])]), 0.01)
    there = lmscore.train_on_all(alone, before, (0.01,))
    assert all(there.p[k] == pytest.approx(here.p[k], abs=1e-4) for k in here.p)


def test_weights_are_means_by_the_tokens_that_moved_them(spark, monkeypatch):
    monkeypatch.setattr(lmscore, "FAN_IN", 2)
    rng = np.random.default_rng(4)
    seen = rng.integers(0, 3, (7, 5)).astype(float)
    seen[:, 4] = 0  # moved by no task
    weights = rng.normal(0, 1, (7, 5, 3)).astype(np.float32)
    weights[:, 4] = 2.5
    parts = spark.createDataFrame(
        [(t * 3, 0, seen[t].tolist(), weights[t].ravel().tolist()) for t in range(7)],
        "slot long, part int, seen array<double>, weights array<float>")
    row = lmscore.mean_weights(parts).collect()
    assert len(row) == 1 and row[0].seen == seen.sum(axis=0).tolist()
    want = np.where(seen.sum(0)[:, None] > 0, (seen[..., None] * weights).sum(0) / np.maximum(seen.sum(0), 1)[:, None], weights[0])
    assert np.reshape(row[0].weights, (5, 3)) == pytest.approx(want, abs=1e-5)


def test_scores_of_awkward_rows(spark):
    none = lmscore.lm_scores(awkward(spark), F.lit(False)).collect()
    assert len(none) == 10 and all(r.score == r.base_score == 0 and r.train_tokens == 0 for r in none)
    assert lmscore.lm_scores(awkward(spark).limit(0), F.lit(True)).count() == 0
    some = {r.doc_id: r for r in lmscore.lm_scores(awkward(spark), F.lit(True)).collect()}
    assert some[0].n_tokens == some[1].n_tokens == some[2].n_tokens == 1 and some[5].n_tokens == 30_001


def colliding_lines(spark):
    """Two lines of which the second seems known to a filter that holds the first only."""
    lines = F.concat(F.lit("line number "), F.col("id").cast("string"))
    hashed = spark.range(1_500_000).select(F.xxhash64(F.unhex(F.md5(lines))).alias("h")).toArrow()["h"].to_numpy().view(np.uint64)
    known = CuckooFilter.build(hashed[:1]).contains(hashed[1:])
    return "line number 0", f"line number {int(np.flatnonzero(known)[0]) + 1}"


def test_index_keeps_lines_that_a_filter_knows_by_chance(spark):
    a, b = colliding_lines(spark)
    def docs(*rows):
        return spark.createDataFrame(list(rows), "doc_id long, text string")
    index = linededup.LineIndex(spark, shards=1).insert(docs((1, a))).insert(docs((2, b)))
    index.delete(docs((2, "")).select("doc_id"))
    index.insert(docs((3, a)))
    assert [(r.refs, r.first_doc, r.last_doc) for r in index.counts.collect()] == [(2, 1, 3)]
    left = {r.doc_id: r.text for r in index.deduplicate(docs((1, a), (3, a))).collect()}
    assert left == {1: a, 3: ""}


def test_index_after_random_changes_equals_brute_force(spark):
    """Insertions and deletions in turn, among them lines whose fingerprints collide."""
    rng = np.random.default_rng(8)
    lines = [*colliding_lines(spark), *[f"common line {i}" for i in range(6)], "short"]
    index, held = linededup.LineIndex(spark, shards=1), {}
    for step in range(4):
        new = {int(d): "\n".join(rng.choice(lines, 4)) for d in rng.integers(0, 12, 4)}
        index.insert(spark.createDataFrame(list(new.items()), "doc_id long, text string"))
        held |= new
        gone = [int(d) for d in rng.choice(sorted(held), 2, replace=False)]
        index.delete(spark.createDataFrame([(d,) for d in gone], "doc_id long"))
        held = {d: t for d, t in held.items() if d not in gone}
        keys = [r.key for r in index.counts.collect()]
        assert len(keys) == len(set(keys)) == len({x.lower() for t in held.values() for x in t.split("\n") if len(x) >= 10})
    got = {r.doc_id: r.text for r in index.deduplicate(spark.createDataFrame(list(held.items()), "doc_id long, text string")).collect()}
    assert got == {d: t for d, *_, t in lines_by_hand(sorted(held.items()))}


def test_texts_are_encoded_half_a_megabyte_at_a_time():
    """A worker holds 120 to 140 bytes for each byte of a step, as measured, so steps stay small; a long text is one by itself."""
    texts = [b"x" * 1000] * 4000 + [b"y" * 3_000_000] + [b"z"] * 3
    steps = list(pieces._groups(texts))
    assert [t for part in steps for t in texts[part]] == texts
    assert max(sum(map(len, texts[part])) for part in steps if max(map(len, texts[part])) <= 1000) <= 600_000
