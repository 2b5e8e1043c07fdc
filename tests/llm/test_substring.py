"""Substring dedup against a plain loop over the ranked units."""

import random

import pytest
from siltstone.llm import substring as S

SCHEMA = "doc_id long, text string, removed int, _cuts int, row long"


def sentences(text):
    """(start, end, words) of lines cut at marks that white space or another mark or the end follows."""
    out, start = [], None
    for i, c in enumerate(text):
        if c in "\n" or (c in ".!?" and start is None):
            if start is not None:
                out.append((start, i))
            start = None
            continue
        start = i if start is None else start
        after = text[i + 1 : i + 2]
        if c in ".!?" and (not after or after.isspace()):
            out.append((start, i + 1))
            start = None
    if start is not None:
        out.append((start, len(text)))
    return [(a, b, text[a:b].lower().split()) for a, b in out if text[a:b].split()]


def windows(text, least, short):
    """Every run of sentences that has enough words but not without its last (or, for a short last one, its first)."""
    s = sentences(text)
    n = [len(w) for *_, w in s]
    spans = set()
    for i in range(len(s)):
        for j in range(i, len(s)):
            if sum(n[i : j + 1]) >= least and (sum(n[i:j]) < least or n[j] < least and sum(n[i + 1 : j + 1]) < least):
                spans.add((i, j))
    if s and sum(n) < least:
        spans.add((0, len(s) - 1))
    if short:
        line = 0
        for i in range(len(s)):
            if i + 1 == len(s) or "\n" in text[s[i][1] : s[i + 1][0]]:
                if sum(n[line : i + 1]) < least:
                    spans.add((line, i))
                line = i + 1
    return {(s[i][0], s[j][1]): tuple(w for *_, ws in s[i : j + 1] for w in ws) for i, j in spans}


def brute(docs, least, short=False):
    """Texts by id: in rank order each unit that was seen before goes, but for letters of its own first occurrence."""
    seen, gone = {}, {}
    distinct = sorted({(i is None, i or 0, ROWS[i, t], t) for i, t in docs if t})
    for none, i, _, t in distinct:
        marks = gone.setdefault((none, i, t), set())
        for (a, b), unit in sorted(windows(t, least, short).items()):
            first = seen.setdefault(unit, (none, i, t, a, b))
            if first != (none, i, t, a, b):
                marks |= set(range(a, b)) - (set(range(*first[3:])) if first[:3] == (none, i, t) else set())
    out = {}
    for i, t in docs:
        if t:
            marks, left, at = gone[i is None, i or 0, t], "", 0
            while at < len(t):
                end = at
                while end < len(t) and end in marks:
                    end += 1
                if end > at:
                    while end < len(t) and t[end].isspace():
                        end += 1
                    left += "" if any(c.isalnum() for c in t[at:end]) else t[at:end]
                    at = end
                else:
                    left += t[at]
                    at += 1
            t = left
        out.setdefault(i, []).append(t)
    return {i: sorted(map(str, ts)) for i, ts in out.items()}


ROWS = {}


def words(r, n):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(r.randint(1, 6))) for _ in range(n))


def test_units_do_not_depend_on_what_surrounds_them():
    passage = "One two. Three four five six seven eight nine ten eleven. A b. C d e f g h i j."
    alone = {h for *_, h in S.units(passage, 8)}
    within = {h for *_, h in S.units("Before it stands this sentence here now. " + passage + " And after it comes another one as well. Yes.", 8)}
    assert alone <= within
    assert {h for *_, h in S.units(passage.upper().replace(" ", "\t"), 8)} == alone


@pytest.mark.parametrize("least,short,block", [(8, False, 1 << 18), (8, True, 40), (20, False, 40)])
def test_matches_brute_force(spark, monkeypatch, least, short, block):
    from pyspark.sql import functions as F

    monkeypatch.setattr(S, "BLOCK", block)
    r = random.Random(8)
    lines = [words(r, r.randint(1, 25)).capitalize() + r.choice([".", "", "!", "?!"]) for _ in range(60)]
    docs = [(i, "".join(r.choice(lines) + r.choice([" ", "\n", "\n\n"]) for _ in range(r.randint(0, 12)))) for i in range(80)]
    docs += [(200, None), (201, ""), (202, "x " * 400), (203, "A. " * 50), (5, docs[5][1]), (7, docs[9][1]), (None, docs[3][1]), (None, "\n".join(lines[:5]))]
    docs += [(300, "\n".join(lines * 2)), (301, "Three words only."), (302, "three  words ONLY.")]
    df = spark.createDataFrame([(i, t, 1, 2, 3) for i, t in docs], SCHEMA).repartition(5)
    ROWS.update({(x["doc_id"], x["text"]): x["h"] for x in df.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).collect()})
    out = S.drop_repeats(df, least, short, report=False)
    assert out.columns == df.columns
    got = {}
    for x in out.collect():
        got.setdefault(x["doc_id"], []).append(x["text"])
    assert {i: sorted(map(str, ts)) for i, ts in got.items()} == brute(docs, least, short)


def test_reports_original_offsets(spark):
    p = "This very passage of more than twenty words is in both of them, and nothing else in either of the two is."
    df = spark.createDataFrame([(1, "Intro one here. " + p + " End."), (2, "Other words come first.\n" + p + "\nLast."), (3, "Clean text that nobody else has, all of it new.")], "doc_id long, text string")
    a, b, c = sorted(S.drop_repeats(df).collect(), key=lambda x: x["doc_id"])
    assert a["text"] == "Intro one here. " + p + " End." and a["removed"] == []
    assert b["text"] == "Other words come first.\nLast." and b["original_chars"] == len("Other words come first.\n" + p + "\nLast.")
    assert [(s["start"], s["end"]) for s in b["removed"]] == [(24, 24 + len(p) + 1)]
    assert c["text"].startswith("Clean") and c["removed"] == []


def test_long_passages_stay_once(spark):
    """Passages of over 50 words, on their own lines and within lines, in many documents."""
    r = random.Random(1)
    passages = [" ".join(words(r, r.randint(3, 14)).capitalize() + "." for _ in range(8)) for _ in range(4)]
    docs = []
    for i in range(60):
        own = [words(r, r.randint(4, 12)).capitalize() + "." for _ in range(6)]
        own.insert(r.randint(0, 6), passages[i % 4])
        docs.append((i, r.choice([" ", "\n"]).join(own)))
    out = {x["doc_id"]: x["text"] for x in S.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    for k, p in enumerate(passages):
        assert [i for i, t in out.items() if p in t] == [k] or sorted(i for i, t in out.items() if p in t) == [k]
        sentence = max(p.split(". ")[1:-1], key=len)
        assert sorted(i for i, t in out.items() if sentence in t) == [k]


def test_empty(spark):
    assert S.drop_repeats(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_short_lines_go_in_differing_surroundings(spark):
    """Lines under eight words, a short text and lines of a script without white space."""
    docs = [(1, "First words of one.\nRead more here\nAn end."), (2, "Other words stand here.\nread  more here\nNo end at all."), (3, "Read more here"), (4, "版权所有不得转载\n甲"), (5, "乙\n版权所有不得转载")]
    out = {x["doc_id"]: x["text"] for x in S.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 8, True).collect()}
    assert out == {1: docs[0][1], 2: "Other words stand here.\nNo end at all.", 3: "", 4: docs[3][1], 5: "乙\n"}


def test_a_repeat_goes_though_a_wider_unit_is_first(spark):
    """A line repeats an earlier one; with its short neighbour it is first here and comes again later."""
    line = "Yes it is. This sentence has at least eight words in it."
    docs = [(1, "One two three four five six seven eight nine.\n" + line), (2, "A heading.\n" + line), (3, "A heading.\n" + line), (4, "Na. " * 30)]
    out = {x["doc_id"]: x["text"] for x in S.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string"), 8, True).collect()}
    assert out[1] == docs[0][1] and out[2] == "A heading.\n" and out[3] == ""
    assert out[4].startswith("Na. " * 7 + "Na.")


def test_lines_that_many_texts_have_stay_and_unspaced_passages_go(spark):
    """A short common line leaves a text alone; a passage without white space is measured by its letters."""
    passage = "\n".join("本作品依照公共许可协议发布任何人都可以自由复制传播和修改其内容" + c for c in "甲乙丙丁戊己")
    docs = [(i, f"Share this page.\nText {i} has a line of its own, which nobody else has got, as one can see at once, and so it is.") for i in range(5)]
    docs += [(10, "开头一行\n" + passage), (11, "另一个开头\n" + passage + "\n结尾")]
    out = {x["doc_id"]: x["text"] for x in S.drop_repeats(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert all(out[i] == t for i, t in docs[:6])
    assert out[11] == "另一个开头\n结尾"


def test_bytes_that_are_no_text(spark):
    """What is no UTF-8 reads as U+FFFD, in every operator that takes whole texts."""
    from pyspark.sql import functions as F
    from siltstone.llm import common, decontam, langid, quality, simhash

    df = spark.createDataFrame([(1, b"caf\xe9 and more words here"), (2, b"plain")], "doc_id long, b binary").select("doc_id", F.col("b").cast("string").alias("text"))
    assert {x["doc_id"]: x["text"] for x in S.drop_repeats(df).collect()}[1] == "caf\ufffd and more words here"
    assert len(simhash.near_duplicates(df).collect()) == 2 and len(simhash.drop_near_duplicates(df).select("doc_id").collect()) == 2
    items = spark.createDataFrame([(7, "and more words here")], "item_id long, text string")
    assert [x["doc_id"] for x in decontam.find_items(df, items).collect()] == [1]
    assert decontam.drop_contaminated(df, items).select("doc_id").collect() == [(2,)]
    assert len(langid.identify(df, langid.fit([("and more words", "en"), ("mehr und worte", "de")])).collect()) == 2
    assert len(quality.score(df, quality.fit([(*quality.summed("a b"), 1)])).collect()) == 2
    assert common.shared_dir(spark)
