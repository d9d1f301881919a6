import zlib

import numpy as np
import pyarrow as pa
import pytest
from helpers import AWKWARD, documents, empty

from lumenseek.llm import common, quality, sampling, toxicity

MODULES = {"quality": (quality, quality.op2_quality, 0.3, 0.97), "toxic": (toxicity, toxicity.op5_toxicity, 0.5, 0.88)}


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_held_out_accuracy(spark, label):
    sf = "/root/testdata/sf0.1"
    _, query, threshold, least = MODULES[label]
    rows = {r["doc_id"]: r for r in query(spark, sf).collect()}
    assert len(rows) == common.table(spark, sf, "documents").count()
    for i, r in rows.items():
        assert r["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) and 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= threshold)
    judged = [(rows[r["doc_id"]]["predicted"], r[label]) for r in common.table(spark, sf, "labels").collect() if rows[r["doc_id"]]["held_out"]]
    for side in (0, 1):
        assert np.mean([p == y for p, y in judged if y == side]) > least - 0.25 * (label == "toxic" and side == 1)
    assert np.mean([p == y for p, y in judged]) > least


@pytest.mark.parametrize("label", ["quality", "toxic"])
def test_awkward_rows_and_tables(spark, label):
    module = MODULES[label][0]
    docs = documents(spark, AWKWARD * 2)
    labels = spark.createDataFrame([(i, i % 2, i % 2) for i in range(1, 20)] + [(None, 1, 1), (3, None, None), (4, 1, 1)], "doc_id bigint, quality int, toxic int")
    model = module.train(docs, labels)
    rows = module.score(docs, model).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    by_text = {t: {r["score"] for r, u in zip(rows, [x["text"] for x in docs.collect()]) if u == t} for t in ("one", "")}
    assert all(len(s) == 1 for s in by_text.values())
    nothing = module.train(docs, labels.limit(0))
    assert all(r["score"] == 0.5 for r in module.score(docs, nothing).collect())
    assert module.score(empty(spark), model).count() == 0 and module.score(empty(spark), module.train(empty(spark), labels)).count() == 0


def test_training_rows_leave_out_the_held_out(spark):
    docs = spark.createDataFrame([(i, f"t{i}") for i in range(500)], "doc_id bigint, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(500)] + [(7, 0)], "doc_id bigint, quality int")
    rows = sampling.training_rows(docs, labels, "quality", 10_000).collect()
    assert {r["doc_id"] for r in rows} == {i for i in range(500) if zlib.crc32(str(i).encode()) % 5} and len(rows) == len({r["doc_id"] for r in rows})
    assert 40 < sampling.training_rows(docs, labels, "quality", 80).count() < 130


def test_nothing_to_learn_from_drops_nothing(spark):
    docs = documents(spark, AWKWARD)
    schema = "doc_id bigint, toxic int"
    held = [i for i in range(500) if zlib.crc32(str(i).encode()) % 5 == 0]
    for rows in ([], [(i, None) for i in range(20)], [(i, 1) for i in held], [(10**6, 1), (10**6 + 1, 0)]):
        model = toxicity.train(docs, spark.createDataFrame(rows, schema))
        kept = toxicity.keep_clean(docs, model)
        assert kept.columns == docs.columns and sorted(map(repr, kept.collect())) == sorted(map(repr, docs.collect()))


def test_a_text_too_long_to_learn_from_does_not_shut_out_others(spark):
    sample = spark.createDataFrame([(i, "x" * (1000 if i % 7 == 0 else 10), i % 2) for i in range(100)], "doc_id bigint, text string, label int")
    found = sampling.learnt(sample, lambda texts, labels: f"{len(texts)} {max(map(len, texts), default=0)}".encode(), 900)
    assert found == b"85 10"


def test_scores_equal_plain_dot_product():
    rng = np.random.default_rng(2)
    weights = rng.normal(size=(1 << quality.BITS) + 1).astype(np.float32)
    texts = ["Some words!! and some words", "", "x", "a a a a b"]
    column = pa.array(texts)
    buckets, bounds = quality.features(column)
    for i, s in enumerate(quality.scores(column, weights)):
        at, values = quality.counted(buckets[bounds[i] : bounds[i + 1]])
        z = float(weights[-1]) + float(weights[at].astype(float) @ values)
        assert np.isclose(s, 1 / (1 + np.exp(-z)))
        alone, _ = quality.features(column.slice(i, 1))
        assert sorted(alone) == sorted(buckets[bounds[i] : bounds[i + 1]])


def test_ftrl_separates_and_stays_sparse():
    rng = np.random.default_rng(1)
    examples = [(np.array([y, 2 + rng.integers(0, 50), 100]), np.ones(3), int(y)) for y in rng.integers(0, 2, 400)]
    w = quality.fit(examples, 100)
    assert w[1] > 0 > w[0] and (w == 0).any()


def test_ftrl_steps_equal_a_plain_version():
    rng = np.random.default_rng(3)
    examples = [(np.sort(rng.choice(20, 5, replace=False)), rng.normal(size=5), int(rng.integers(0, 2))) for _ in range(60)]
    model, z, n = quality.Ftrl(20), [0.0] * 21, [0.0] * 21

    def weight(i):
        if abs(z[i]) <= quality.L1:
            return 0.0
        return -(z[i] - (quality.L1 if z[i] > 0 else -quality.L1)) / ((quality.BETA + n[i] ** 0.5) / quality.ALPHA + quality.L2)

    for at, values, label in examples:
        model.learn(at, values, label)
        before = {i: weight(i) for i in at}
        p = 1 / (1 + np.exp(-sum(before[i] * v for i, v in zip(at, values))))
        for i, v in zip(at, values):
            g = (p - label) * v
            z[i] += g - ((n[i] + g * g) ** 0.5 - n[i] ** 0.5) / quality.ALPHA * before[i]
            n[i] += g * g
    assert np.allclose(model.z, z) and np.allclose(model.n, n) and np.allclose(model.weights(), [weight(i) for i in range(21)])
    assert any(w != 0 for w in model.weights())


def test_softmax_and_embeddings_follow_the_numeric_gradient():
    """Training against AdaGrad steps whose gradients are taken by finite differences of the cross entropy."""
    rng, size = np.random.default_rng(4), 12
    bags = [(np.sort(rng.choice(size, 4, replace=False)).astype(np.int32), rng.random(4).astype(np.float32)) for _ in range(6)]
    labels = np.array([0, 1, 1, 0, 1, 0])
    found = toxicity.fit(toxicity.Bags(np.concatenate([a for a, _ in bags]), np.concatenate([w for _, w in bags]), np.arange(0, 28, 4), labels), size, epochs=2, kept=1)
    again = np.random.default_rng(11)
    table = ((again.random((size, toxicity.DIMENSIONS), np.float32) - 0.5) / toxicity.DIMENSIONS).astype(float)
    out, bias = (again.random((toxicity.DIMENSIONS, 2), np.float32) - 0.5).astype(float), np.zeros(2)
    seen, seen_out, seen_bias = np.full(size, 1e-4), 1e-2, 1e-2

    def numeric(parameter, loss):
        grad = np.zeros_like(parameter)
        for k in np.ndindex(parameter.shape):
            kept = parameter[k]
            parameter[k] = kept + 1e-5
            up = loss()
            parameter[k] = kept - 1e-5
            grad[k] = (up - loss()) / 2e-5
            parameter[k] = kept
        return grad

    for _ in range(2):
        for i in again.permutation(6):
            at, weights = bags[i]

            def loss(at=at, weights=weights, label=labels[i]):
                z = weights.astype(float) @ table[at] @ out + bias
                return np.log(np.exp(z).sum()) - z[label]

            rows, outer, shift = numeric(table, loss), numeric(out, loss), numeric(bias, loss)
            seen += (rows**2).sum(axis=1)
            seen_out += (outer**2).sum()
            seen_bias += (shift**2).sum()
            table -= toxicity.RATE * rows / np.sqrt(seen)[:, None]
            out -= toxicity.RATE * outer / np.sqrt(seen_out)
            bias -= 0.1 * toxicity.RATE * shift / np.sqrt(seen_bias)
    assert np.allclose(found.table, table @ (out[:, 1] - out[:, 0]), rtol=1e-2, atol=1e-3) and np.isclose(found.bias, bias[1] - bias[0], rtol=1e-2, atol=1e-3)


def test_subwords_of_a_word_do_not_depend_on_its_place():
    found = toxicity.subwords(pa.array(["Idiot! idiot, b", "x\n\nIDIOT", "", None, "é"]))
    words = [tuple(found.buckets[a:b]) for a, b in zip(found.bounds, found.bounds[1:])]
    assert found.rows.tolist() == [0, 2, 4, 4, 4, 5]  # the word that repeats the one before is left out
    assert words[0] == words[3] and len(words[0]) == 1 + 5 + 4 + 3 + 2


def test_misspellings_share_vectors():
    clean = ["the cat sat on the mat today", "we like green trees and rivers", "music plays in the old town hall"] * 30
    bad = ["you are an idiot and a moron", "such an idiot this moron is", "moron and idiot again today"] * 30
    model = toxicity.fit(toxicity.bags(clean + bad, [0] * len(clean) + [1] * len(bad)), 1 << toxicity.BITS)
    scores = toxicity.sigmoid(toxicity.logits(pa.array(["an idiott", "a morron here", "green rivers", ""]), model))
    assert scores[0] > 0.5 and scores[1] > 0.5 and scores[2] < 0.5
    assert toxicity.sigmoid(np.array([toxicity.fit(toxicity.bags(clean[:3], [0] * 3), 1 << toxicity.BITS).bias]))[0] < 0.5


def test_logits_equal_bags():
    rng = np.random.default_rng(5)
    model = toxicity.Model(rng.normal(size=1 << toxicity.BITS).astype(np.float32), 0.25)
    texts = ["Some Words and words words", "", "é", "a b c d e f"]
    for t, z in zip(texts, toxicity.logits(pa.array(texts), model)):
        at, weight = toxicity.bag(t)
        assert np.isclose(z, 0.25 + float(model.table[at] @ weight), atol=1e-5)


def test_keep_clean_keeps_columns(spark):
    model = toxicity.Model(np.zeros(1 << toxicity.BITS, np.float32), -1.0)
    docs = documents(spark, AWKWARD)
    assert toxicity.keep_clean(docs, model).columns == docs.columns and toxicity.keep_clean(docs, model).count() == docs.count()
    assert toxicity.keep_clean(docs, model._replace(bias=1.0)).count() == 0


def test_samples_keep_their_size_at_any_count(spark):
    """The share is taken from all 64 bits of the hash, so it is never 0."""
    for n in (10**4, 10**8, 10**11, 10**15):
        found = (sampling.threshold(n, 7000) + 2**63) / 2**64
        assert abs(found / (7000 / n) - 1) < 1e-6 or n > 10**14 and found > 0
    docs = spark.range(30_000).selectExpr("id AS doc_id", "concat('text ', id) AS text")
    labels = spark.range(30_000).selectExpr("id AS doc_id", "CAST(id % 2 AS INT) AS toxic")
    chosen = sampling.training_rows(docs, labels, "toxic", 2000)
    assert 1800 < chosen.count() < 2200


def test_repeated_ids_are_one_training_row(spark):
    docs = spark.createDataFrame([(1, f"copy {i:03d}") for i in range(500)] + [(2, None), (3, "three")], "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, 1) for i in range(1, 30)], "doc_id bigint, toxic int")
    rows = {r["doc_id"]: r["text"] for r in sampling.training_rows(docs, labels, "toxic", 100).collect()}
    kept = {i for i in (1, 2, 3) if zlib.crc32(str(i).encode()) % 5}
    assert rows == {i: {1: "copy 000", 2: None, 3: "three"}[i] for i in kept}
