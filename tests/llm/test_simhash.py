"""SimHash against brute force over all pairs."""

import random
import re

import numpy as np
import pytest
import xxhash
from siltstone.llm import simhash as S

SCHEMA = "doc_id long, text string, fp long, fingerprint string, _row int"


def slow_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(prints):
    root = {i: i for i, _ in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in prints:
        for b, y in prints:
            if (x ^ y).bit_count() <= 4:
                lo, hi = sorted((top(a), top(b)))
                root[hi] = lo
    return {i: top(i) for i, _ in prints}


def corpus():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdeÀß") for _ in range(r.randint(1, 5)))
    base = [[word() for _ in range(r.randint(1, 200))] for _ in range(40)]
    docs = [(1000, None), (5, ""), (7, " \t\n"), (8, "one"), (9, "ONE"), (11, "a b c\x1cd e")]
    for i, w in enumerate(base):
        for k in range(r.choice([1, 1, 2, 6])):
            w = list(w)
            w[r.randrange(len(w))] = word()
            docs.append((100 + 10 * i + k, " ".join(w)))
    return docs


def test_matches_brute_force(spark):
    docs = corpus()
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], SCHEMA)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in S.near_duplicates(df).collect()}
    prints = [(i, slow_print(t)) for i, t in docs]
    want = slow_components(prints)
    assert got == {i: (f"{p:016x}", want[i]) for i, p in prints}
    assert len(set(want.values())) < len(docs)


@pytest.mark.parametrize("trie", [3, 4096])
def test_hot_groups_lose_no_link(spark, monkeypatch, trie):
    """Many fingerprints around a few centres; small tries force more agreeing blocks and the split of hot groups."""
    monkeypatch.setattr(S, "TRIE", trie)
    r = random.Random(5)
    prints = set()
    for c in [0, 1 << 63, r.getrandbits(64)]:
        for _ in range(60):
            x = c
            for b in r.sample(range(64), r.randint(0, 5)):
                x ^= 1 << b
            prints.add(x)
    prints |= {r.getrandbits(64) for _ in range(100)}
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    df = spark.createDataFrame([(p, p) for p in signed], "id long, fp long")
    stars = {r["node"]: r["root"] for r in S.components(S.trie_links(df)).collect()}
    want = slow_components([(p, p & (1 << 64) - 1) for p in sorted(signed)])
    groups = lambda f: {frozenset(q for q in signed if f(q) == f(p)) for p in signed}
    assert groups(lambda p: stars.get(p, p)) == groups(want.get)


def jaccard(a, b, k=5):
    grams = lambda t: {tuple(w[i : i + k]) for w in [(t or "").lower().split()] for i in range(max(1, len(w) - k + 1))}
    a, b = grams(a), grams(b)
    return len(a & b) / len(a | b)


def test_sketches_know_the_similarity():
    r = random.Random(11)
    errors = []
    for _ in range(200):
        w = [f"w{r.randrange(5000)}" for _ in range(r.randint(100, 600))]
        v = list(w)
        for _ in range(r.randint(0, 40)):
            v[r.randrange(len(v))] = "new"
        a, b = " ".join(w), " ".join(v)
        two = [[n >> k & 3 for n in S.unpacked([S.signature(t)[3]])[0].tolist() for k in range(0, 64, 2)] for t in (a, b)]
        same = sum(x == y for x, y in zip(*two, strict=True)) / S.SLOTS
        errors.append((same - 1 / 4) / (1 - 1 / 4) - jaccard(a, b))
    assert abs(sum(errors)) / len(errors) < 0.01 and sum(e * e for e in errors) / len(errors) < 0.06**2


def test_similar_documents_go_and_others_stay(spark):
    r = random.Random(12)
    docs, family = [], {}
    for f in range(40):
        base = [f"w{r.randrange(3000)}" for _ in range(r.randint(150, 400))]
        for k in range(4):
            w = list(base)
            for _ in range(r.randint(0, len(base) // 100)):  # near copies
                w[r.randrange(len(w))] = f"x{r.randrange(99)}"
            docs.append((f * 10 + k, " ".join(w)))
            family[f * 10 + k] = f
        w = [x if r.random() < 0.8 else f"y{r.randrange(99)}" for x in base]  # related, not near
        docs.append((f * 10 + 9, " ".join(w)))
        family[f * 10 + 9] = ("far", f)
    df = spark.createDataFrame(docs, "doc_id long, text string")
    kept = {x["doc_id"] for x in S.drop_near_duplicates(df).collect()}
    assert {f * 10 + 9 for f in range(40)} <= kept
    texts, left = dict(docs), [i for i in kept if i % 10 != 9]
    assert {family[i] for i in left} == set(range(40)) and len(left) <= 42
    extra = [i for i in left if i % 10]
    assert all(jaccard(texts[i], texts[i // 10 * 10]) < 0.9 for i in extra)


def test_keeps_one_of_each(spark):
    docs = corpus() + [(7, " \t\n"), (None, "zzz yyy"), (None, "zzz yyy")]
    df = spark.createDataFrame([(i, t, 1, "x", 2) for i, t in docs], SCHEMA)
    out = S.drop_near_duplicates(df, 4, 4, None)
    assert out.columns == df.columns
    kept = [r["doc_id"] for r in out.collect()]
    want = slow_components([(i, slow_print(t)) for i, t in corpus()])
    assert sorted(k for k in kept if k is not None) == sorted(set(want.values()))
    assert kept.count(None) == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(df).collect() == [] and S.drop_near_duplicates(df).collect() == []


def test_similarity_is_exact_at_the_threshold(spark):
    """Pairs just over and just under 0.8, closer than a sketch can tell: only those of at least 0.8 are one."""
    r = random.Random(21)
    docs, want = [], {}
    for f in range(60):
        base = [f"v{r.randrange(10**6)}" for _ in range(404)]  # 400 shingles; n words replaced at the end leave 400 - n
        cut = r.choice([42, 43, 44, 45, 46])  # 358 of 442 is 0.81, 355 of 445 is 0.798
        docs += [(2 * f, " ".join(base)), (2 * f + 1, " ".join(base[:-cut] + [f"u{r.randrange(10**6)}" for _ in range(cut)]))]
        want[f] = jaccard(docs[-2][1], docs[-1][1]) >= 0.8
    assert 10 < sum(want.values()) < 50
    df = spark.createDataFrame(docs, "doc_id long, text string")
    root = {x["doc_id"]: x["component_id"] for x in S.near_duplicates(df, 5, 24, 0.8).collect()}
    assert {f: root[2 * f] == root[2 * f + 1] for f in want} == want


@pytest.mark.parametrize("exact,most", [(4000, 12), (4000, 30), (9000, 24), (1 << 20, 24)])
def test_parts_of_large_groups_lose_no_exact_link(spark, monkeypatch, exact, most):
    """Near copies of one text in one part or many, all linked or (with more changes) in several components."""
    monkeypatch.setattr(S, "EXACT", exact)
    r = random.Random(22)
    base = [f"v{r.randrange(10**6)}" for _ in range(300)]
    docs = []
    for i in range(40):
        w = list(base)
        for j in range(r.randint(0, most)):
            w[r.randrange(300)] = f"u{r.randrange(10**6)}"
        docs.append((i, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    root = {i: i for i, _ in docs}
    for i, a in docs:
        for j, b in docs:
            if jaccard(a, b) >= 0.8 and root[i] != root[j]:
                lo, hi = sorted((root[i], root[j]))
                root = {k: lo if v == hi else v for k, v in root.items()}
    assert {x["doc_id"]: x["component_id"] for x in S.near_duplicates(df, 5, 24, 0.8).collect()} == root


def test_cut_and_inserted_passages_are_candidates(spark):
    """Near copies by one contiguous edit, down to a similarity of 0.8, whose SimHashes are far apart."""
    r = random.Random(23)
    docs, far = [], 0
    for f in range(60):
        base = [f"v{int(r.paretovariate(0.6)) % 9999}" for _ in range(r.randint(60, 400))]
        copy = base[: int(len(base) * 0.83)] if f % 2 else base[:20] + [f"u{r.randrange(9999)}" for _ in range(len(base) // 8)] + base[20:]
        a, b = " ".join(base), " ".join(copy)
        if jaccard(a, b) >= 0.8:
            docs += [(2 * f, a), (2 * f + 1, b)]
            far += ((S.signature(a)[2] ^ S.signature(b)[2]) & (1 << 64) - 1).bit_count() > 7
    assert len(docs) > 60 and far > 10
    kept = {x["doc_id"] for x in S.drop_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert kept == {i for i, _ in docs if i % 2 == 0}


def test_groups_that_link_the_same_give_the_same_edges():
    """A group's edges go to its smallest id, however its fingerprints are sorted, so one that many tasks find stays one star."""
    ids, zeros = np.array([30, 10, 20, -5]), np.zeros(4, np.int64)
    for keys in ([1, 2, 3, 255 << 40], [3, 1, 2, 255 << 40], [2, 3, 1, 255 << 40]):
        u, v = S.join_tries(zeros, zeros, ids, np.array(keys, np.uint64), 63, 3, None, None, 0.0)
        assert sorted(zip(u.tolist(), v.tolist(), strict=True)) == [(20, 10), (30, 10)]


@pytest.mark.parametrize("links", [1 << 21, 100])
def test_components_of_chains_and_hubs(spark, monkeypatch, links):
    """Chains, hubs, repeated links and links to itself, by one task and by steps; the first takes few jobs, however long the chains."""
    monkeypatch.setattr(S, "LINKS", links)
    rng = np.random.default_rng(5)
    chain = rng.permutation(np.arange(-300, 300))
    edges = list(zip(chain[:-1].tolist(), chain[1:].tolist(), strict=True)) + [(5000, k) for k in range(1000, 1200)] + [(7, 7), (9000, 9000), (8000, 8001), (8001, 8000)]
    df = spark.createDataFrame(edges, "u long, v long").repartition(7)
    spark.sparkContext.setJobGroup(f"components-{links}", "")
    try:
        got = {r["node"]: r["root"] for r in S.components(df).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"components-{links}"))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert got == {k: -300 for k in range(-299, 300)} | {k: 1000 for k in [*range(1001, 1200), 5000]} | {8001: 8000}
    assert links == 100 or jobs <= 8
    assert S.components(df.limit(0)).count() == 0
