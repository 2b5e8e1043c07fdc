"""Tokenizer, stemmer, query parser and the function compiler."""

import pytest
from pyspark.sql import functions as F
from siltstone.operators import fts
from siltstone.operators.udf import FunctionError, compile_function


def test_tokens_and_stems(spark):
    df = spark.createDataFrame([("Don't STOP  the-Music, été 2024! x",), (None,), ("",)], "t string")
    got = [sorted(r[0]) for r in df.select(fts.tokens(F.col("t"))).collect()]
    assert got == [sorted(["dont", "stop", "themusic", "été", "2024", "x"]), [], []]
    words = ["running", "national", "happiness", "the", "cats", "valences", "goodness", "ation", "relational", "quickly"]
    stems = [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(fts.stem(F.col("w"))).collect()]
    assert stems == [fts.stem_text(w) for w in words]
    assert dict(zip(words, stems, strict=True))["running"] == "runn" and "the" in stems and stems[1] == "nation"


def test_turning_stems_back_is_exact():
    import itertools

    heads = ["run", "nat", "walk", "x", "be", "valen", ""]
    words = {h + s + t for h in heads for (s, _), (t, _) in itertools.product([*fts.RULES, ("", "")], repeat=2)} | {h + i + s for h in heads for s, i in fts.RULES}
    for w in words:
        assert w in fts.unstemmed(fts.stem_text(w))
    assert all(fts.stem_text(w) == "tion" for w in fts.unstemmed("tion")) and len(fts.unstemmed("walk")) > 5


def test_queries(spark):
    df = spark.createDataFrame([(1, "a b c"), (2, "b c"), (3, "c d"), (4, "")], "id int, t string")
    ask = lambda q: sorted(r[0] for r in fts.search(df, ["t"], q).select("id").collect())
    assert ask("a") == [1] and ask("b AND c") == [1, 2] and ask("b c") == [1, 2] and ask("a OR d") == [1, 3]
    assert ask("c NOT b") == [3] and ask("c AND NOT b OR a") == [1, 3] and ask("") == [] and ask("NOT c") == [4] and ask('"B" c') == [1, 2]


def test_index(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "b c")], "id int, t string")
    index = fts.index(docs, "id", ["t"])
    index = fts.add_documents(index, spark.createDataFrame([(2, "z"), (3, "b")], docs.schema), "id", ["t"])
    assert sorted(r[0] for r in fts.search_index(index, "id", "b").collect()) == [1, 3]
    assert fts.remove_documents(index, docs, "id").count() == 1


def f(body, params="n INT", result="INT"):
    return compile_function("f", [tuple(p.strip().split()) for p in params.split(",")], body, result)


def test_blocks():
    grade = f("BEGIN IF n >= 90 THEN RETURN 'A'; ELSIF n >= 80 THEN RETURN 'B'; ELSE RETURN 'C'; END IF; END", result="TEXT")
    assert [grade(x) for x in (95, 85, 5, None)] == ["A", "B", "C", "C"]
    assert f("BEGIN DECLARE r INT := 1; FOR i IN 1..n LOOP r := r * i; END LOOP; RETURN r; END")(6) == 720
    assert f("BEGIN DECLARE c INT := 0; LOOP c := c + 1; EXIT WHEN c >= n; END LOOP; RETURN c; END")(3) == 3
    assert f("BEGIN DECLARE s INT := 0; WHILE n > 0 LOOP s := s + n; n := n - 1; IF s > 8 THEN EXIT; END IF; END LOOP; RETURN s; END")(5) == 9
    assert f("BEGIN BEGIN RETURN n / 2; END; END")(-7) == -3
    with pytest.raises(FunctionError):
        f("BEGIN n := 1; END")(1)
    with pytest.raises(FunctionError):
        f("BEGIN LOOP n := n + 1; END LOOP; RETURN n; END")(1)


@pytest.mark.parametrize(
    "body,args,want",
    [
        ("a + b * 2", (1, 2), 5), ("NOT a = b OR a IS NULL", (None, 1), True), ("a BETWEEN 1 AND b", (2, 3), True), ("a NOT IN (1, b)", (5, None), None), ("CASE WHEN a > b THEN 1 ELSE 0 END", (1, 2), 0), ("COALESCE(a, b)", (None, 4), 4),
        ("a / b", (7, 2), 3), ("a / b", (7.0, 2), 3.5), ("-a - -b", (1, 2), 1), ("GREATEST(a, b, 3)", (1, None), 3), ("CAST(a AS TEXT) || 'x'", (5, 0), "5x"), ("ROUND(a)", (2.5, 0), 3.0), ("MOD(a, b)", (-7, 3), -1), ("a AND b", (None, False), False),
        ("LENGTH('é')", (0, 0), 2), ("SUBSTRING('hello', a, b)", (0, 3), "hel"), ("a LIKE 'x%'", ("xyz", 0), True),
    ],
)
def test_expressions(body, args, want):
    assert compile_function("f", [("a", "INT"), ("b", "INT")], body, "ANY")(*args) == want


@pytest.mark.parametrize("body", ["a +", "BEGIN RETURN 1", "nosuch(a)", "IF a THEN RETURN 1; END", "a b"])
def test_bad_bodies(body):
    with pytest.raises((FunctionError, IndexError)):
        compile_function("f", [("a", "INT"), ("b", "INT")], body)


def test_endless_recursion_is_an_error():
    with pytest.raises(FunctionError):
        compile_function("f", [("n", "INT")], "f(n + 1)", "INT")(1)
