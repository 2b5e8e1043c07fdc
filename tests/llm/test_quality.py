"""Quality classifier: held-out accuracy, odd rows, and learning from the allowed fold only."""

import random

import numpy as np
from pyspark.sql import functions as F
from siltstone.llm import quality as Q
from siltstone.llm.common import fold


def corpus(n=400):
    r = random.Random(9)
    vocab = ["".join(r.choice("aeinrst") for _ in range(r.randint(2, 7))) for _ in range(300)]
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(vocab) for _ in range(r.randint(20, 120))]
        good = r.random() < 0.7
        if not good:
            w = r.choice([[x.upper() + "!!" for x in w], [x + r.choice(["***", "%%%"]) for x in w], [w[0]] * len(w)])
        docs.append((i, " ".join(w), 0.5, 1))
        labels.append((i, int(good), 0))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus()
    odd = [(5000, None, 0.0, 1), (5001, "", 0.0, 1), (5002, " \n", 0.0, 1), (None, "some words", 0.0, 1), (3, docs[3][1], 0.0, 1), (5003, "very " * 20000, 0.0, 1)]
    df = spark.createDataFrame(docs + odd, "doc_id long, text string, score double, predicted int")
    lab = spark.createDataFrame(labels + [(3, labels[3][1], 1), (None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    model = Q.train(df, lab, fold(F.col("doc_id"), 4) != 2)
    rows = Q.score(df, model).withColumn("held", fold(F.col("doc_id"), 4) == 2).collect()
    assert len(rows) == len(docs) + len(odd)
    truth = {i: y for i, y, _ in labels}
    held = [x for x in rows if x["held"] and x["doc_id"] in truth]
    assert len(held) > 50 and np.mean([x["predicted"] == truth[x["doc_id"]] for x in held]) > 0.97
    assert all(0 <= x["score"] <= 1 and x["predicted"] == int(x["score"] >= 0.7) for x in rows)
    blank = {x["score"] for x in rows if x["doc_id"] in (5000, 5001, 5002)}
    assert len(blank) == 1
    kept = Q.keep_good(df, model)
    assert kept.columns == df.columns and kept.count() == sum(x["predicted"] for x in rows)


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    model = Q.train(df, none, F.lit(True))
    assert Q.score(df, model).first()["score"] == 0.5
    assert Q.score(df.limit(0), model).collect() == []


def test_scores_are_sparse_dot_products():
    r = np.random.default_rng(0)
    m = Q.Model(r.normal(size=Q.BUCKETS).astype(np.float32), 0.1)
    for t in ["Some words, some WORDS!! words words", "x", "", "é Ünï 12 a1 ..."]:
        at, v = Q.summed(t)
        want = 1 / (1 + np.exp(-(float((m.weights[at] * v).sum()) + 0.1)))
        assert abs(m.score(t) - want) < 1e-9


def test_outlines():
    assert [Q.shape(w) for w in ["word", "Word.", "WORD!!", "w***", "1999", "aB1", "été", "***", ""]] == ["a", "Aa.", "A!", "a*", "0", "aA0", "a", "*", ""]


def test_learner_matches_a_plain_one():
    """Follow-the-regularised-leader against a loop over single weights, as published."""
    import math
    import random

    import numpy as np
    from siltstone.llm import quality as Q

    r = random.Random(5)
    rows = [(np.array(sorted(r.sample(range(40), 6))), np.array([r.random() for _ in range(6)]), r.randint(0, 1)) for _ in range(120)]
    leader = Q.Leader()
    z, n, bias = {}, {}, 0.0
    a, b, l1, l2 = leader.alpha, leader.beta, leader.l1, leader.l2

    def weight(i):
        if abs(z.get(i, 0.0)) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((b + math.sqrt(n[i])) / a + l2)

    for at, v, y in rows:
        leader.learn(at, v, y, 1.5)
        w = {i: weight(i) for i in at.tolist()}
        p = 1 / (1 + math.exp(-(sum(w[i] * x for i, x in zip(at.tolist(), v.tolist())) + bias)))
        for i, x in zip(at.tolist(), v.tolist()):
            g = (p - y) * x * 1.5
            s = (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / a
            z[i], n[i] = z.get(i, 0.0) + g - s * w[i], n.get(i, 0.0) + g * g
        bias -= 0.02 * (p - y) * 1.5
    got = leader.weights(slice(None))
    assert abs(leader.bias - bias) < 1e-9 and all(abs(got[i] - weight(i)) < 1e-9 for i in range(40)) and not got[40:].any()


def test_outlines_have_no_end():
    """Two long tokens that differ after any number of characters have outlines of their own."""
    from siltstone.llm import quality as Q

    one, two = "a1" * 50 + "b!", "a1" * 50 + "B?"
    assert Q.shape(one) != Q.shape(two) and Q.features(one)[0].tolist() != Q.features(two)[0].tolist()
