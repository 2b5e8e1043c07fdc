"""WARC round trips."""

import glob
import gzip
import hashlib

from siltstone.llm import warc as W

BIG = "é" * 600


def pages(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i}</p>" * (i % 300), 1, "x") for i in range(1000)]
    rows += [(2000, "http://a b\r\nc", BIG, 1, "x"), (2005, None, BIG, 1, "x"), (2003, "u", BIG, 1, "x"), (2003, "u", BIG, 1, "x"), (2005, None, BIG, 1, "x")]
    rows += [(3000, "u", None, 1, "x"), (3001, "u", "", 1, "x"), (3002, "u", "same", 1, "x"), (3003, "u", "same", 1, "x"), (None, "u", BIG, 1, "x"), (None, "u", "z" * 2000, 1, "x")]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, shard int, digest string")


def test_round_trip(spark, tmp_path):
    rows, df = pages(spark)
    folder = f"file://{tmp_path}/one"
    manifest = W.write_warc(df, folder, roll=20_000, shard_rows=100).collect()
    assert sum(m["records"] for m in manifest) == len(rows) and len(manifest) > 10
    for m in manifest:
        data = open(f"{tmp_path}/one/{m['file']}", "rb").read()
        assert hashlib.sha1(data).hexdigest() == m["sha1"] and len(data) == m["bytes"]
        assert gzip.decompress(data).count(b"WARC/1.1\r\n") == m["records"]
    got = W.read_warc(spark, folder, payloads=True).collect()
    assert len(got) == len(rows)
    last = {}
    for i, _, h, *_ in rows:
        if len((h or "").encode()) >= 1000:
            last[h] = max(last.get(h, -1), -1 if i is None else i)
    html = {}
    for i, _, h, *_ in rows:
        html.setdefault(i, []).append(h or "")
    for r in got:
        (h,) = {h for h in html[r["page_id"]] if hashlib.sha1(h.encode()).hexdigest() == r["payload_digest"]}
        assert r["payload_bytes"] == len(h.encode())
        if r["record_type"] == "response":
            assert r["refers_to"] is None and r["payload"].decode() == h
            assert h not in last or last[h] == (-1 if r["page_id"] is None else r["page_id"])
        else:
            assert r["refers_to"] == last[h]
    sha = hashlib.sha1(BIG.encode()).hexdigest()
    kinds = [(r["record_type"], r["page_id"]) for r in got if r["payload_digest"] == sha]
    assert sorted(kinds, key=str) == sorted([("response", 2005), ("revisit", 2005), ("revisit", 2003), ("revisit", 2003), ("revisit", 2000), ("revisit", None)], key=str)


def test_same_bytes_again(spark, tmp_path):
    _, df = pages(spark)
    one = W.write_warc(df, f"file://{tmp_path}/a", shard_rows=200).collect()
    two = W.write_warc(df.repartition(7), f"file://{tmp_path}/b", shard_rows=200).collect()
    assert sorted(map(str, one)) == sorted(map(str, two))
    assert not glob.glob(f"{tmp_path}/a/.*tmp")


def test_left_behind_files_are_not_read(spark, tmp_path):
    _, df = pages(spark)
    W.write_warc(df.limit(10), f"file://{tmp_path}/c")
    open(f"{tmp_path}/c/records-999999-00000.warc.gz", "wb").write(b"half a file")
    assert W.read_warc(spark, f"file://{tmp_path}/c").count() == 10


def test_empty(spark):
    assert W.archive_pages(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []


def test_shards_grow_with_rows_and_share_a_common_key(spark):
    """No number of shards is the last; null ids, a third of all rows, are in many shards, each payload in one."""
    from pyspark.sql import functions as F
    from siltstone.llm import warc as W

    assert [W.shards_for(n, 0, 4000) for n in (0, 1, 4001, 80_000_000)] == [1, 1, 2, 20_000]
    assert W.shards_for(10**10, 100 << 40, 4000) == 409_600
    rows = [(None if i % 3 == 0 else i // 2, f"page {i % 700} " * 120) for i in range(3000)]
    df = spark.createDataFrame(rows, "page_id long, html string")
    keyed = df.select(F.coalesce("page_id", F.lit(-(1 << 63))).alias("key"), F.sha1(F.col("html").cast("binary")).alias("digest"))
    edges = W.borders(keyed, 30)
    got = keyed.withColumn("shard", W.number_of_shard(F.col("key"), F.col("digest"), edges)).collect()
    sizes = [sum(r["shard"] == s for r in got) for s in range(30)]
    assert max(sizes) < 3 * 100 and len({r["shard"] for r in got if r["key"] < 0}) > 5
    assert sorted((r["shard"], r["key"]) for r in got) == sorted(((r["shard"], r["key"]) for r in got), key=lambda x: (x[1], x[0]))
    assert all(len({r["shard"] for r in got if (r["key"], r["digest"]) == k}) == 1 for k in {(r["key"], r["digest"]) for r in got[:50]})
