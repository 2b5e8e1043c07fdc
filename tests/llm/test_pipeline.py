"""The pipeline's stages against plain versions on a small corpus, and its contract."""

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

SF = "/root/testdata/sf0.001"


def grams(text):
    w = text.lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}


def test_stages(spark, tmp_path):
    from siltstone.llm import decontam

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, seen = docs.columns, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        seen[name] = docs.collect()
        out = stage(spark, docs, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == columns
    names = [n for n, _ in corpus_pipeline.STAGES]
    ids = {n: [r["doc_id"] for r in seen[n]] for n in names}
    last = docs.collect()
    # Quality: labels agree with what went, inside and outside the fold that was learnt.
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(ids[names[1]])
    assert sum((i in kept) == bool(y) for i, y in labels.items()) >= 0.97 * len(labels)
    # Near-dedup: what stays has no similar pair among close fingerprints; what went is similar to something.
    sets = {r["doc_id"]: grams(r["text"]) for r in seen[names[1]]}
    near = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    left = set(ids[names[2]])
    assert not [(a, b) for a in left for b in left if a < b and near(a, b) > 0.9]
    assert all(any(near(a, b) > 0.7 for b in sets if b != a) for a in set(sets) - left)
    # Decontamination: what stays holds no item; nothing else went.
    items = [decontam.normal(r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    after = {r["doc_id"] for r in last}
    for r in seen[names[3]]:
        exact = any(p in decontam.normal(r["text"]) for p in items)
        assert not (exact and r["doc_id"] in after)
    assert sum(r["taken"] for r in last) > 0 and all(0 <= r["taken"] <= 3 * r["size"] for r in last)
    assert len(last) == len(set(after)) <= len(ids[names[3]])
    assert sorted(map(str, corpus_pipeline.run(spark, SF).collect())) == sorted(map(str, last))


ODD = "doc_id long, text string, lang string, source string, n_chars long, removed int, _row string, score double, size int"


def test_odd_rows_and_empty_tables(spark):
    """Nulls anywhere, blank and very long texts, repeated rows and columns with clashing names, in every stage."""
    long = " ".join(f"Word{i % 977} and{i % 31}." for i in range(20000))
    rows = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n", "en", None, 2), (None, "A text without an id, of nine words here.", None, "a", None), (4, long, "en", "b", len(long))]
    rows += [(5, "One text that comes again and again in the table, word for word.", "en", "a", 1)] * 3 + [(6, "One text that comes again and again in the table, word for word.", "en", "a", 1)]
    rows += [(None, "A text without an id, of nine words here.", None, "a", None), (7, "!!! ... ###", "en", "a", 3), (8, "x", None, None, 1)]
    df = spark.createDataFrame([(*r, 1, "r", 0.5, 9) for r in rows], ODD)
    for docs in (df, df.limit(0)):
        n = docs.count()
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, docs, SF)
            got = out.collect()
            assert len(got) <= n, name
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns, name
    near = dict(corpus_pipeline.STAGES)["SimHash near-dedup"](spark, df, SF).collect()
    assert sorted(str(r["doc_id"]) for r in near) == ["1", "4", "5", "7", "8", "None"]
