"""Scalar functions of the SQL front, one expression a case; and the same over columns."""

import pytest
from siltstone.functions import casts, datetimes, json_, maths, strings
from siltstone.operators.database import Database

CASES = [
    ("CONCAT('a', ' ', 'b')", "a b"), ("CONCAT('a', NULL)", None), ("CONCAT('n', 1)", "n1"), ("CONCAT_WS('-', 'a', NULL, '', 'b')", "a-b"), ("CONCAT_WS(NULL, 'a')", None),
    ("UPPER('aé')", "AÉ"), ("LOWER('AbC')", "abc"), ("SUBSTRING('hello', 2, 3)", "ell"), ("SUBSTRING('hello', 0, 3)", "hel"), ("SUBSTRING('hello', -5, 2)", "he"), ("SUBSTRING('hello', 3)", "llo"),
    ("SUBSTRING('hello' FROM 2 FOR 2)", "el"), ("SUBSTRING('hello' FROM 4)", "lo"), ("SUBSTRING('hi', 9, 2)", ""), ("LENGTH('héllo')", 6), ("LENGTH('')", 0), ("LENGTH(NULL)", None),
    ("TRIM(' \t a b \n ')", "a b"), ("LTRIM('  a ')", "a "), ("RTRIM('  a ')", "  a"), ("REPLACE('aXbX', 'X', '--')", "a--b--"), ("STRPOS('hello', 'l')", 3), ("STRPOS('éa', 'a')", 3), ("STRPOS('abc', 'z')", 0),
    ("SPLIT_PART('a,b,c', ',', 2)", "b"), ("SPLIT_PART('a,b', ',', 3)", ""), ("SPLIT_PART('a,b', ',', 0)", ""), ("SPLIT_PART('a,b', ',', -1)", ""),
    ("ABS(-5)", 5), ("ABS(5)", 5), ("ABS(0)", 0), ("ROUND(2.5)", 3), ("ROUND(-2.5)", -3), ("ROUND(3.14159, 2)", 3.14), ("ROUND(1234, -2)", 1200), ("CEIL(1.2)", 2), ("CEIL(-1.2)", -1), ("FLOOR(1.8)", 1), ("FLOOR(-1.2)", -2),
    ("MOD(10, 3)", 1), ("MOD(-10, 3)", -1), ("GREATEST(1, 5, 3)", 5), ("GREATEST(1, NULL)", 1), ("LEAST(-1, -5)", -5), ("LEAST(NULL, NULL)", None), ("7 / 2", 3), ("-7 / 2", -3), ("7.0 / 2", 3.5), ("2 + 3 * 4", 14), ("8 / 2 * 3", 12),
    ("CAST('42' AS INT)", 42), ("CAST(2.9 AS INT)", 2), ("CAST(-2.9 AS INT)", -2), ("CAST(5 AS TEXT)", "5"), ("CAST('1.5' AS FLOAT)", 1.5), ("TO_INT('7')", 7), ("TO_FLOAT('2')", 2.0), ("TO_TEXT(9)", "9"), ("TO_VARCHAR(9)", "9"), ("TO_DOUBLE('2.5')", 2.5),
    ("COALESCE(NULL, NULL, 3)", 3), ("NULLIF(1, 1)", None), ("NULLIF(1, 2)", 1), ("NULLIF(1, NULL)", 1), ("CASE WHEN 1 > 2 THEN 'a' WHEN 2 > 1 THEN 'b' ELSE 'c' END", "b"), ("CASE WHEN CAST(NULL AS INT) = 1 THEN 1 END", None),
    ("DATE_TRUNC('month', '2024-03-15 10:20:30')", "2024-03-01 00:00:00"), ("DATE_TRUNC('hour', '2024-03-15T10:20:30Z')", "2024-03-15 10:00:00"), ("DATE_TRUNC('eon', '2024-03-15 10:20')", "2024-03-15 00:00:00"), ("DATE_TRUNC('day', 'bad')", None),
    ("EXTRACT(YEAR FROM '2024-03-15')", 2024), ("EXTRACT(DOW FROM '2024-03-17')", 0), ("EXTRACT(WEEK FROM '2024-12-30')", 1), ("EXTRACT(SECOND FROM '2024-01-01 00:00:59.9')", 59), ("EXTRACT(QUARTER FROM '2024-07-01')", 3), ("EXTRACT(YEAR FROM 86400)", 1970),
    ("TO_TIMESTAMP('2024-03-15')", "2024-03-15 00:00:00"), ("TO_CHAR('2024-03-15 01:02:03', 'YYYY-MM-DD')", "2024-03-15"),
    ("JSON_EXTRACT('{\"a\":{\"b\":[1,\"x\"]}}', '$.a.b[1]')", '"x"'), ("JSON_EXTRACT('{\"b\":1,\"a\":2}', '$')", '{"a":2,"b":1}'), ("JSON_EXTRACT('{}', '$.x')", None), ("JSON_EXTRACT('[1,2.5]', '$[1]')", "2.5"),
    ("JSON_TYPE('{\"a\":1.0}', '$.a')", "integer"), ("JSON_TYPE('{\"a\":1.5}', '$.a')", "real"), ("JSON_TYPE('{\"a\":true}', '$.a')", "integer"), ("JSON_TYPE('[]', '$')", "array"), ("JSON_TYPE('{}', '$.q')", "null"), ("JSON_TYPE('\"s\"', '$')", "text"),
    ("JSON_SET('{\"a\":1}', '$.b.c', 'x')", '{"a":1,"b":{"c":"x"}}'), ("JSON_SET('[1]', '$[2]', 9)", "[1,null,9]"), ("JSON_SET('{\"a\":1}', '$.a', NULL)", '{"a":null}'), ("JSON_INSERT('{\"a\":1}', '$.a', 2)", '{"a":1}'), ("JSON_INSERT('{\"a\":[1]}', '$.a[1]', 2)", '{"a":[1,2]}'),
    ("JSON_REMOVE('{\"a\":[1,2,3]}', '$.a[0]')", '{"a":[2,3]}'), ("JSON_REMOVE('{\"a\":1}', '$.zz')", '{"a":1}'),
    ("JSONB_EXTRACT_PATH_TEXT('{\"a\":{\"b\":[true,\"t\"]}}', 'a.b.1')", "t"), ("JSONB_EXTRACT_PATH('{\"a\":{\"b\":[true]}}', 'a.b.0')", "1"), ("JSONB_EXTRACT_PATH('{\"a\":1}', 'z')", None),
    ("JSONB_TYPEOF('[1]')", "array"), ("JSONB_TYPEOF('1.5')", "number"), ("JSONB_TYPEOF('{bad')", "null"), ("JSONB_TYPEOF('false')", "boolean"), ("JSONB_ARRAY_LENGTH('[1,[2],3]')", 3),
    ("JSONB_BUILD_OBJECT('b', 1, 'a', 'x')", '{"a":"x","b":1}'), ("JSONB_BUILD_OBJECT('a', NULL)", '{"a":null}'), ("JSONB_BUILD_ARRAY(1, 'a', NULL)", '[1,"a",null]'), ("JSONB_BUILD_ARRAY()", "[]"),
    ("1 IN (1, NULL)", True), ("2 IN (1, NULL)", None), ("2 BETWEEN 1 AND 3", True), ("2 NOT BETWEEN 5 AND 3", True), ("'abc' LIKE 'a%'", True), ("'abc' NOT LIKE '_b_'", False), ("NULL AND false", False), ("NULL OR true", True), ("NOT NULL", None), ("NULL IS NULL", True), ("'it''s'", "it's"), ("-(3 - 5)", 2),
]


@pytest.fixture(scope="module")
def db(spark):
    return Database(spark)


def test_front(db):
    row = db.query("SELECT " + ", ".join(f"{e} AS c{i}" for i, (e, _) in enumerate(CASES))).first()
    got = [None if v is None else float(v) if isinstance(w, (int, float)) and not isinstance(w, bool) else v for v, (_, w) in zip(row, CASES, strict=True)]
    bad = [(e, g, w) for g, (e, w) in zip(got, CASES, strict=True) if g != w]
    assert not bad


@pytest.mark.parametrize("expr", ["MOD(1, 0)", "1 / 0", "CAST('x' AS INT)", "JSONB_ARRAY_LENGTH('{}')", "JSON_REMOVE('{}', '$')", "ABS()", "NOSUCH(1)"])
def test_errors(db, expr):
    with pytest.raises(Exception):
        db.query(f"SELECT {expr} AS x").collect()


def test_columns(spark):
    from pyspark.sql import functions as F

    c, lit = F.col, F.lit
    df = spark.createDataFrame([(" hé ", 2.5, '{"a":[1]}', "2024-02-29 23:59:59.5"), (None, None, None, None)], "s string, x double, j string, t string")
    cols = [
        (strings.length(c("s")), 5), (strings.trim(c("s")), "hé"), (strings.strpos(c("s"), " "), 1), (strings.strpos(c("s"), c("s")), 1), (strings.split_part(c("s"), "h", 2), "é "), (strings.concat_ws(",", c("s"), lit("")), " hé "),
        (maths.ceil(c("x")), 3.0), (maths.floor(-c("x")), -3.0), (maths.round_(c("x")), 3.0), (maths.int_div(lit(-7), lit(2)), -3), (casts.to_int(c("x")), 2), (casts.float_to_text(lit(3.0)), "3"), (casts.float_to_text(lit(1e-7)).substr(1, 9), "0.0000001"), (casts.to_text(c("x")), "2.5"),
        (datetimes.date_trunc("minute", c("t")), "2024-02-29 23:59:00"), (datetimes.extract("doy", c("t")), 60), (datetimes.to_char(c("t"), "DD.MM.YYYY HH24h"), "29.02.2024 23h"), (datetimes.age(c("t"), lit("2025-04-01")), "1 years 1 months 1 days"),
        (json_.json_extract(c("j"), "$.a[0]"), "1"), (json_.json_set(c("j"), "$.a[0]", c("x")), '{"a":[2.5]}'), (json_.json_insert(c("j"), "$.b", "q"), '{"a":[1],"b":"q"}'), (json_.json_remove(c("j"), "$.a"), "{}"), (json_.json_type(c("j"), "$.a"), "array"),
    ]
    rows = df.select(*[e.alias(f"c{i}") for i, (e, _) in enumerate(cols)]).collect()
    assert list(rows[0]) == [w for _, w in cols]
    constant = {0: 0}
    nulls = [v for i, v in enumerate(rows[1]) if i not in constant and i not in (9, 11, 12)]
    assert all(v is None or v == "" for v in nulls)


def test_bad_paths():
    for p in ("$.", "$[x]", "$[1", "a", "$.a[-1]"):
        with pytest.raises(ValueError):
            json_.parse_path(p)
