"""The classifiers' scores against plain Python, value by value, and their handling of odd tables."""

import collections
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tomewise.llm import bytecnn, langid, toxicity

ODD = [None, "", " \n", "1 2 3", "Plain words here.", "plain WORDS here", "é ü ß", "x" * 5000, "one two " * 3000]


def corpus(n=160, seed=3):
    """Texts of two kinds with words of their own, and some in common."""
    rng = random.Random(seed)
    kinds = [["lorem", "ipsum", "dolor", "sit!"], ["bad", "worse,", "Worst", "awful"]]
    texts = [" ".join(rng.choice(kinds[i % 2] + ["the", "of", "And"]) for _ in range(rng.randrange(3, 120))) for i in range(n)]
    return texts, [i % 2 for i in range(n)]


def table(spark, texts, labels):
    rows = [(i, t, labels[i] if i < len(labels) else None, "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, label int, o string")


# Byte-level network


def network_by_hand(net, text):
    """Every filter at every position of the text between zeros, maxima over chunks of two halves, then their mean and
    maximum."""
    p = {k: v.astype(float) for k, v in net.p.items()}
    halves = (len(text) + bytecnn.WIDTH) // bytecnn.HALF + 1
    data = bytes(bytecnn.WIDTH - 1) + text + bytes(halves * bytecnn.HALF - len(text))
    tops = []
    for h in range(halves):
        best = None
        for at in range(h * bytecnn.HALF, (h + 1) * bytecnn.HALF):
            response = sum(p["taps"][j][data[at + j]] for j in range(bytecnn.WIDTH))
            best = response if best is None else np.maximum(best, response)
        tops.append(best)
    chunks = [np.maximum(a, b) for a, b in zip(tops, tops[1:])] or tops
    act = [np.maximum(c + p["bias"], 0) for c in chunks]
    total = np.mean(act, axis=0) @ p["mean"] + np.max(act, axis=0) @ p["max"] + p["out"][0]
    return 1 / (1 + math.exp(-total))


def test_quality_scores_equal_the_network_by_hand(spark):
    texts, labels = corpus()
    net = bytecnn.fit_quality(table(spark, texts, labels), table(spark, texts, labels).select("doc_id", "label"), F.col("label"), epochs=3)
    shown = texts[:12] + ODD
    got = {r.doc_id: r.score for r in bytecnn.score(table(spark, shown, labels), net).collect()}
    assert len(got) == len(shown)
    for i, t in enumerate(shown):
        assert got[i] == pytest.approx(network_by_hand(net, (t or "").encode()), abs=1e-5)


def test_quality_without_rows_or_examples(spark):
    texts, labels = corpus(8)
    none = table(spark, texts, [])
    net = bytecnn.fit_quality(none, none.select("doc_id", "label"), F.col("label"))
    assert bytecnn.score(none.limit(0), net).count() == 0
    assert all(0 < r.score < 1 for r in bytecnn.score(table(spark, ODD, []).withColumn("score", F.lit("x")), net).collect())


# Language identification


def grams_by_hand(text):
    """Feature counts of one text: the hash folds one code point after the other into 32 bits."""
    points, counts, full = [ord(c) for c in text.lower()], collections.Counter(), (1 << 32) - 1
    for at in range(len(points)):
        value = 0
        for k in range(min(3, len(points) - at)):
            value = ((value ^ points[at + k]) * 0x9E3779B1) & full
            value ^= value >> 15
            counts[((value * 0x85EBCA6B) & full) >> (32 - langid.BITS)] += 1
    return counts


def test_language_scores_equal_tf_idf_and_softmax_by_hand(spark):
    texts, labels = corpus()
    docs = table(spark, texts, labels).withColumn("lang", F.when(F.col("label") == 1, "bb").otherwise("aa"))
    model = langid.fit_language_model(docs, F.col("lang"))
    df = collections.Counter(f for t in texts for f in grams_by_hand(t))
    idf = {f: math.log((1 + len(texts)) / (1 + n)) + 1 for f, n in df.items()}
    for f, value in idf.items():
        assert model.idf[f] == pytest.approx(value)
    shown = texts[:10] + ODD
    got = {r.doc_id: r for r in langid.identify(table(spark, shown, []), model).collect()}
    for i, t in enumerate(shown):
        if not any(map(str.isalpha, t or "")):
            assert (got[i].lang_pred, got[i].score) == (langid.UNKNOWN, 0)
            continue
        value = {f: (1 + math.log(n)) * idf.get(f, math.log(1 + len(texts)) + 1) for f, n in grams_by_hand(t).items()}
        norm = math.sqrt(sum(v * v for v in value.values()))
        logits = [(model.weights[-1][k] + sum(v / norm * model.weights[f][k] for f, v in value.items())) / model.temperature for k in (0, 1)]
        p = [math.exp(x - max(logits)) for x in logits]
        best = p.index(max(p))
        assert got[i].lang_pred == ["aa", "bb"][best] and got[i].score == pytest.approx(p[best] / sum(p))


def test_leader_weights_equal_the_rule_by_hand():
    rng = np.random.default_rng(5)
    vectors = [(np.sort(rng.choice(6, 3, replace=False)), rng.normal(0, 1, 3)) for _ in range(30)]
    target = rng.integers(0, 3, 30)
    got = langid.fit_weights(vectors, target, 3, epochs=2)
    z, n, order = collections.defaultdict(float), collections.defaultdict(float), np.random.default_rng(6)

    def weight(f, k):
        size = abs(z[f, k]) - 0.02
        return 0.0 if size <= 0 else -math.copysign(size, z[f, k]) / (1 + math.sqrt(n[f, k]) + 0.5)

    for _ in range(2):
        for i in order.permutation(30):
            held = {(f, k): weight(f, k) for f in vectors[i][0] for k in range(3)}
            score = [sum(v * held[f, k] for f, v in zip(*vectors[i])) for k in range(3)]
            total = sum(map(math.exp, score))
            for f, v in zip(*vectors[i]):
                for k in range(3):
                    g = v * (math.exp(score[k]) / total - (k == target[i]))
                    sigma = math.sqrt(n[f, k] + g * g) - math.sqrt(n[f, k])
                    z[f, k] += g - sigma * held[f, k]
                    n[f, k] += g * g
    for f in range(6):
        assert got[f] == pytest.approx([weight(f, k) for k in range(3)])
    assert not got[6:].any()


def test_temperature_has_the_least_loss():
    rng = np.random.default_rng(1)
    logits, target = rng.normal(0, 4, (200, 3)), rng.integers(0, 3, 200)

    def loss(t):
        return -np.mean([x[y] / t - math.log(sum(math.exp(v / t) for v in x)) for x, y in zip(logits, target)])

    found = langid.calibrated(logits, target)
    assert all(loss(found) <= loss(t) + 1e-6 for t in np.exp(np.linspace(-3.9, 1.9, 60)))


def test_language_of_odd_tables(spark):
    texts, labels = corpus(40)
    docs = table(spark, texts + ODD, labels).withColumn("lang", F.col("label").cast("string"))
    model = langid.fit_language_model(docs, F.col("lang"))  # rows with a null label are no examples
    assert model.labels == ["0", "1"]
    assert langid.identify(docs.limit(0), model).count() == 0
    assert langid.fit_language_model(docs.limit(0), F.col("lang")) is None
    clash = langid.identify(docs.withColumn("score", F.lit("x")).withColumn("lang_pred", F.lit(1)), None).collect()
    assert {(r.lang_pred, r.score) for r in clash} == {("und", 0.0)}


# Toxicity chain


def features_by_hand(text):
    """Bare words, beginnings and endings of one text, each once."""
    out = set()
    for word in "".join(c.lower() if c.isascii() else c for c in text).encode().split():
        marks = {i for i in range(33, 127) if not chr(i).isalnum()} - {ord("_")} | {ord("_")}
        bare = word[1:] if len(word) > 1 and word[0] in marks else word
        bare = bare[:-1] if len(bare) > 1 and bare[-1] in marks else bare
        out.add(("word", bare))
        out |= {(f"begin{k}", bare[:k]) for k in (4, 5, 6) if len(bare) > k}
        out |= {(f"end{k}", word[-k:]) for k in (2, 3) if len(word) > k}
    return out


def test_chain_probabilities_equal_the_chain_by_hand(spark):
    texts, labels = corpus()
    docs = table(spark, texts, labels)
    first = (F.length("text") > 200).cast("int")
    rows = docs.select("doc_id", "label", first.alias("long"))
    chain = toxicity.fit_chain(docs, rows, {"long": F.col("long"), "label": F.col("label")})
    shown = texts[:20] + [t for t in ODD if t is None or "é" not in t]
    got = {r.doc_id: r for r in toxicity.score(table(spark, shown, []), chain).collect()}
    # The numbers of the known features, found by hashing each feature of each word by itself.
    names = {}
    for text in texts + [t or "" for t in shown]:
        for word in text.split():
            hashes, _ = toxicity.text_features([word.encode()])
            ordered = [k for kind in ("word", "begin4", "begin5", "begin6", "end2", "end3") for k in features_by_hand(word) if k[0] == kind]
            names.update(zip(ordered, hashes.tolist(), strict=True))
    assert len(set(names.values())) == len(names)
    number = {h: i for i, h in enumerate(chain.vocabulary.hashes.tolist())}
    assert number
    for i, t in enumerate(shown):
        known = [number[names[f]] for f in features_by_hand(t or "") if names[f] in number]
        earlier = []
        for model in chain.models:
            score = model.bias + sum(model.weights[k] for k in known) + sum(w * p for w, p in zip(model.dense, earlier))
            earlier.append(1 / (1 + math.exp(-min(max(score, -30), 30))))
        assert [got[i].p_long, got[i].p_label] == pytest.approx(earlier)


def test_linear_model_is_at_its_optimum():
    """The gradient of the penalised log loss, written out, is near zero."""
    rng = np.random.default_rng(2)
    row, feature = np.repeat(np.arange(80), 3), np.concatenate([rng.choice(5, 3, replace=False) for _ in range(80)])
    dense, target = rng.random((80, 1)), rng.integers(0, 2, 80).astype(float)
    model = toxicity.fit_linear(feature, row, dense, target, 5, penalty=0.05, rounds=800)
    p = model.probability(feature, row, 80, dense)
    for k in range(5):
        assert abs(sum((p - target)[row[feature == k]]) / 80 + 0.05 * model.weights[k]) < 2e-3
    assert abs(sum((p - target) * dense[:, 0]) / 80 + 0.05 * model.dense[0]) < 2e-3 and abs(sum(p - target)) / 80 < 2e-3


def test_toxicity_of_odd_tables(spark):
    texts, _ = corpus(12)
    docs = table(spark, texts + ODD, [])
    chain = toxicity.fit_chain(docs, docs.select("doc_id", "label"), {"toxic": F.col("label")})  # no label at all
    assert toxicity.score(docs.limit(0), chain).count() == 0
    found = toxicity.score(docs.withColumn("p_toxic", F.lit("x")), chain).collect()
    assert len(found) == len(texts + ODD) and {r.p_toxic for r in found} == {0.5}
