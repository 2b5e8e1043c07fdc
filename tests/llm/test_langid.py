"""Language field: exact marginals, held-out accuracy and odd rows."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from siltstone.llm import langid as L
from siltstone.llm.common import fold

SOUNDS = {"aa": ["ta", "ko", "mi", "ru"], "bb": ["sch", "ung", "ein", "er"], "cc": ["eaux", "ois", "que", "é"]}


def words(r, lang, n):
    return " ".join("".join(r.choice(SOUNDS[lang]) for _ in range(r.randint(1, 3))) for _ in range(n))


def brute(emit, move, start):
    n, k = emit.shape
    post, moves = np.zeros((n, k)), np.zeros((k, k))
    total = 0.0
    for path in itertools.product(range(k), repeat=n):
        p = start[path[0]] * emit[0, path[0]]
        for i in range(1, n):
            p *= move[path[i - 1], path[i]] * emit[i, path[i]]
        total += p
        for i, y in enumerate(path):
            post[i, y] += p
            if i:
                moves[path[i - 1], y] += p
    return post / total, moves / total


@pytest.mark.parametrize("block", [2, 3, 128])
def test_forward_backward_is_exact(monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    r = np.random.default_rng(1)
    lengths = [1, 5, 4, 1, 6]
    emit = r.random((sum(lengths), 3)) + 0.01
    move, start = L.softmax(r.normal(size=(3, 3))), np.full(3, 1 / 3)
    first = np.zeros(len(emit), bool)
    first[np.cumsum([0, *lengths[:-1]])] = True
    post, moves = L.marginals(emit, first, move, start, count=True)
    at, want_moves = 0, 0
    for n in lengths:
        p, m = brute(emit[at : at + n], move, start)
        assert np.allclose(post[at : at + n], p)
        want_moves, at = want_moves + m, at + n
    assert np.allclose(moves, want_moves)


def test_held_out_accuracy_and_odd_rows(spark):
    r = random.Random(2)
    docs = []
    for i in range(240):
        lang = r.choice(list(SOUNDS))
        text = words(r, lang, r.randint(5, 80))
        if r.random() < 0.2:
            text += " " + words(r, r.choice(list(SOUNDS)), 4)
        docs.append((i, text, lang, "s"))
    odd = [(900, None, "aa", "s"), (901, "", "aa", "s"), (902, "12 ... !?", "bb", "s"), (903, docs[0][1], None, "s"), (None, "tako", "aa", "s"), (1, docs[1][1], docs[1][2], "s"), (904, "mi " * 30000, "aa", "s")]
    df = spark.createDataFrame([(*d, 0.0) for d in docs + odd], "doc_id long, text string, lang string, lang_pred string, score double")
    model = L.train(df, fold(F.col("doc_id"), 3) != 1)
    assert model.langs == sorted(SOUNDS)
    rows = L.identify(df, model).collect()
    assert len(rows) == len(docs) + len(odd)
    got = {x["doc_id"]: (x["lang_pred"], x["score"]) for x in rows}
    import zlib

    held = [(i, lang) for i, _, lang, _ in docs if zlib.crc32(str(i).encode()) % 3 == 1]
    assert len(held) > 40 and np.mean([got[i][0] == lang for i, lang in held]) > 0.95
    assert all(got[i] == ("und", 0.0) for i in (900, 901, 902))
    assert got[903][0] == docs[0][2] and got[904][0] == "aa"
    assert all(0 <= s <= 1 for _, s in got.values())


def test_code_switched_words_are_told_apart():
    r = random.Random(3)
    model = L.fit([(words(r, lang, 40), lang) for lang in SOUNDS for _ in range(20)])
    half = model.predict([words(r, "aa", 60) + " " + words(r, "bb", 30)])[0]
    assert half[0] == "aa" and 0.5 < half[1] < 0.8


def test_no_labels_and_no_rows(spark):
    df = spark.createDataFrame([(1, "word", None)], "doc_id long, text string, lang string")
    model = L.train(df, F.lit(True))
    assert L.identify(df, model).first()["lang_pred"] == "und"
    assert L.identify(df.limit(0), model).collect() == []


def test_long_words_count_whole():
    """Text without spaces is judged from all its letters, not from its first 64."""
    r = random.Random(4)
    run = lambda lang, n: words(r, lang, n).replace(" ", "")
    model = L.fit([(words(r, lang, 40), lang) for lang in list(SOUNDS) * 20])
    texts = [run("aa", 40)[:64] + run("bb", 400), run("cc", 40)[:64] + run("aa", 400)]
    assert [p for p, _ in model.predict(texts)] == ["bb", "aa"]
    assert [p for p, _ in model.predict(texts[::-1])] == ["aa", "bb"]
    assert L.letters_of("é1" * 100) == "é" * 100
