"""Decontamination against a full edit-distance table."""

import random

from siltstone.llm import decontam as D


def fewest(pattern, text):
    """Fewest errors of pattern against any part of text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, p in enumerate(pattern, 1):
        new = [i]
        for j, c in enumerate(text, 1):
            new.append(min(row[j - 1] + (p != c), row[j] + 1, new[j - 1] + 1))
        row = new
    return min(row)


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[j - 1] + 1))
        row = new
    return row[-1]


def test_myers_matches_the_table():
    r = random.Random(0)
    for _ in range(300):
        p = "".join(r.choice("abc") for _ in range(r.randint(1, 80)))
        t = "".join(r.choice("abc") for _ in range(r.randint(0, 120)))
        if r.random() < 0.5:
            q = list(p)
            for _ in range(r.randint(0, 6)):
                q[r.randrange(len(q))] = r.choice(["", "a", "bc"])
            t = t[:30] + "".join(q) + t[30:]
        want = fewest(p, t)
        errors, start, end = D.myers(p, t, len(p))
        assert errors == want == distance(p, t[start:end])
        assert want == 0 or D.myers(p, t, want - 1) is None


def edit(r, s, n):
    s = list(s)
    for _ in range(n):
        s[r.randrange(len(s))] = r.choice(["", "x", "yy", " "])
    return "".join(s)


def test_matches_brute_force(spark):
    r = random.Random(6)
    text = lambda n: " ".join("".join(r.choice("abcdef") for _ in range(r.randint(1, 7))) for _ in range(n))
    items = [(i, text(r.randint(1, 14))) for i in range(14)] + [(50, None), (51, ""), (52, "..!"), (53, "Mi, xEd\n\nCase"), (0, text(9))]
    docs = []
    for i in range(60):
        k = r.choice(items)[1] or ""
        docs.append((i, text(r.randint(0, 20)) + "\n" + (edit(r, k, r.randint(0, 8)) if len(k) > 8 else k).upper() + ", " + text(r.randint(0, 20))))
    docs += [(100, None), (101, ""), (102, "a"), (3, docs[3][1]), (None, docs[4][1])]
    df = spark.createDataFrame([(i, t, 1, 2) for i, t in docs], "doc_id long, text string, item_id int, errors int")
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, doc_id int")
    got = sorted((str(x["doc_id"]), x["item_id"]) for x in D.find_items(df, bench).collect())
    want = set()
    hits = []
    for i, t in docs:
        n = D.normal(t)
        found = {j for j, p in ((j, D.normal(p)) for j, p in items) if p and n and (fewest(f" {p} ", f" {n} ") <= len(p) // D.PER_ERROR if len(p) >= D.TINY else p == n)}
        hits += [(str(i), j) for j in found]
        want |= found
    assert sorted(set(got)) == sorted(set(hits)) and len(want) > 5
    clean = {str(i) for i, _ in docs} - {i for i, _ in hits}
    kept = D.drop_contaminated(df, bench)
    assert kept.columns == df.columns and {str(x["doc_id"]) for x in kept.collect()} == clean


def test_errors_and_offsets(spark):
    item = "the quick brown fox jumps over the lazy dog again"
    doc = "Intro: THE quick brwn fox, jumps over the lazzy dog again!"
    df = spark.createDataFrame([(1, doc)], "doc_id long, text string")
    (x,) = D.find_items(df, spark.createDataFrame([(9, item)], "item_id long, text string")).collect()
    assert (x["errors"], D.normal(doc)[x["start"] : x["end"]]) == (2, "the quick brwn fox jumps over the lazzy dog again")


def test_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(D, "BLOCK", 300)
    items = [(i, f"item number {i} of the whole benchmark set") for i in range(7)]
    docs = [(i, f"some words, then item number {i} of the whole benchmark set.") for i in range(7)]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    exact = [(x["doc_id"], x["item_id"]) for x in D.find_items(df, bench).collect() if not x["errors"]]
    assert sorted(exact) == [(i, i) for i in range(7)]
    assert D.drop_contaminated(df, bench).count() == 0


def test_empty(spark):
    docs, items = spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame([], "item_id long, text string")
    assert D.find_items(docs, items).collect() == []
    some = spark.createDataFrame([(1, "a")], docs.schema)
    assert D.drop_contaminated(some, items).count() == 1


def test_items_are_not_found_within_words(spark):
    """Word borders, items too short to mean anything, scripts without spaces, and very long texts."""
    items = [(1, "Yes"), (2, "A"), (3, "green bottles on it"), (4, "hundred years of time"), (5, "人工智能将会改变世界的面貌和未来的一切")]
    docs = [(1, "Yesterday was fine."), (2, "yes!"), (3, "Evergreen bottles on items"), (4, "Green bottles, on it"), (5, "word " * 200_000 + "one hundred years of time, " + "word " * 200_000), (6, "我们认为人工智能将会改变世界的面貌和未来的一切可能"), (7, "a")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(x["doc_id"], x["item_id"], x["errors"]): (x["start"], x["end"]) for x in D.find_items(df, bench).collect()}
    assert got == {(2, 1, 0): (0, 3), (7, 2, 0): (0, 1), (4, 3, 0): (0, 19), (5, 4, 0): (1_000_004, 1_000_025), (6, 5, 0): (4, 23)}
    assert {x["doc_id"] for x in D.drop_contaminated(df, bench).collect()} == {1, 3}
