"""String, math, cast, date-time and JSON functions."""

from pyspark.sql import functions as F

from ..functions import casts, datetimes, json_, maths, strings
from ..session import prepare, table
from .registry import query

c = F.col


def _on(name, source, key, sql, cols):
    """Registers a projection of a table by functions, made when it runs, and its SQL."""

    @query(name, f"SELECT {key}, {sql} FROM {source}")
    def q(spark, d):
        return table(prepare(spark), d, source).select(*key.split(", "), *[v.alias(k) for k, v in cols().items()])

    q.__name__ = name


S = strings
_N = lambda: c("p_name")
_on("q_str_substring", "part", "p_partkey", "substring(p_name, 2, 5) AS a, substring(p_name, 4) AS b, substring(p_name, greatest(0, 1), 3) AS z, substring(p_name, 100, 3) AS e", lambda: {"a": S.substring(_N(), 2, 5), "b": S.substring(_N(), 4), "z": S.substring(_N(), 0, 3), "e": S.substring(_N(), 100, 3)})
_on("q_str_concat", "part", "p_partkey", "p_brand || ' ' || p_type || p_partkey AS a, p_name || NULL AS n", lambda: {"a": S.concat(c("p_brand"), F.lit(" "), c("p_type"), c("p_partkey")), "n": S.concat(_N(), F.lit(None).cast("string"))})
_on("q_str_concat_ws", "part", "p_partkey", "concat_ws('-', p_brand, nullif('', ''), CASE WHEN p_size > 20 THEN p_type END, p_size::VARCHAR) AS a", lambda: {"a": S.concat_ws("-", c("p_brand"), F.lit(""), F.when(c("p_size") > 20, c("p_type")), c("p_size"))})
_on("q_str_upper_lower", "part", "p_partkey", "upper(p_name) AS u, lower(p_type) AS l", lambda: {"u": S.upper(_N()), "l": S.lower(c("p_type"))})
_on("q_str_length", "documents", "doc_id", "strlen(text)::BIGINT AS n", lambda: {"n": S.length(c("text"))})
_PAD = lambda: F.concat(F.lit(" \t\n"), _N(), F.lit("\r\n  "))
_PADQ = "chr(32) || chr(9) || chr(10) || p_name || chr(13) || chr(10) || '  '"
_on("q_str_trim", "part", "p_partkey", f"regexp_replace({_PADQ}, '^\\s+|\\s+$', '', 'g') AS t", lambda: {"t": S.trim(_PAD())})
_on("q_str_ltrim_rtrim", "part", "p_partkey", f"ltrim({_PADQ}, chr(32) || chr(9) || chr(10) || chr(13)) AS l, rtrim({_PADQ}, chr(32) || chr(9) || chr(10) || chr(13)) AS r", lambda: {"l": S.ltrim(_PAD()), "r": S.rtrim(_PAD())})
_on("q_str_replace", "part", "p_partkey", "replace(p_name, 'e', 'EE') AS a, replace(p_type, 'zz', '') AS b", lambda: {"a": S.replace(_N(), "e", "EE"), "b": S.replace(c("p_type"), "zz", "")})
_on("q_str_strpos", "documents", "doc_id", "CASE WHEN strpos(text, 'é') > 0 THEN strlen(substring(text, 1, strpos(text, 'é')::INT - 1)) + 1 ELSE 0 END::BIGINT AS a, strpos(source, 'c')::BIGINT AS b", lambda: {"a": S.strpos(c("text"), "é"), "b": S.strpos(c("source"), "c")})
_on("q_str_split_part", "part", "p_partkey", "split_part(p_name, ' ', 1) AS a, split_part(p_name, ' ', 2) AS b, '' AS z, split_part(p_name, ' ', 99) AS e", lambda: {"a": S.split_part(_N(), " ", 1), "b": S.split_part(_N(), " ", 2), "z": S.split_part(_N(), " ", 0), "e": S.split_part(_N(), " ", 99)})

_BAL = lambda: c("c_acctbal")
_on("q_math_abs", "customer", "c_custkey", "abs(c_acctbal) AS a, abs(-c_custkey) AS b", lambda: {"a": maths.abs_(_BAL()), "b": maths.abs_(-c("c_custkey"))})
_on("q_math_ceil_floor", "customer", "c_custkey", "ceil(c_acctbal) AS a, floor(c_acctbal) AS b", lambda: {"a": maths.ceil(_BAL()), "b": maths.floor(_BAL())})
_on("q_math_round", "customer", "c_custkey", "round(c_acctbal) AS a, round(c_acctbal, 1) AS b, round(c_custkey, -2)::BIGINT AS k", lambda: {"a": maths.round_(_BAL()), "b": maths.round_(_BAL(), 1), "k": maths.round_(c("c_custkey"), -2)})
_on("q_math_mod", "customer", "c_custkey", "mod(c_custkey, 7) AS a, mod(-c_custkey, 7) AS b, mod(c_custkey, nullif(c_custkey % 3, 0)) AS z", lambda: {"a": maths.mod(c("c_custkey"), F.lit(7)), "b": maths.mod(-c("c_custkey"), F.lit(7)), "z": maths.safe_mod(c("c_custkey"), c("c_custkey") % 3)})
_HALF = lambda: F.when(_BAL() > 0, _BAL())
_on("q_math_greatest_least", "customer", "c_custkey", "greatest(c_acctbal, 100.5, CASE WHEN c_acctbal > 0 THEN c_acctbal END)::DOUBLE AS g, least(c_acctbal, 100.5)::DOUBLE AS l", lambda: {"g": maths.greatest(_BAL(), F.lit(100.5), _HALF()), "l": maths.least(_BAL(), F.lit(100.5))})


@query("q_math_random", "SELECT n_nationkey, true AS within FROM nation")
def q_math_random(spark, d):
    return table(spark, d, "nation").select("n_nationkey", maths.random().alias("r")).select("n_nationkey", F.col("r").between(0, 1).alias("within"))


_on("q_cast_int", "customer", "c_custkey", "trunc(c_acctbal)::BIGINT AS a, ('12' || c_custkey)::BIGINT AS b", lambda: {"a": casts.to_int(_BAL()), "b": casts.to_int(F.concat(F.lit("12"), c("c_custkey").cast("string")))})
_on("q_cast_text", "customer", "c_custkey", "c_custkey::VARCHAR AS a, c_nationkey::VARCHAR AS b", lambda: {"a": casts.to_text(c("c_custkey")), "b": casts.float_to_text(c("c_nationkey").cast("double"))})
_on("q_cast_float", "customer", "c_custkey", "c_custkey::DOUBLE AS a, (c_custkey || '.5')::DOUBLE AS b", lambda: {"a": casts.to_float(c("c_custkey")), "b": casts.to_float(F.concat(c("c_custkey").cast("string"), F.lit(".5")))})
_on("q_cast_blob", "customer", "c_custkey", "hex(c_name::BLOB) AS a", lambda: {"a": F.hex(casts.to_blob(c("c_name")))})
_on("q_to_funcs", "part", "p_partkey", "trunc(p_retailprice)::BIGINT AS i, p_size::DOUBLE AS f, p_size::VARCHAR AS t", lambda: {"i": casts.to_int(c("p_retailprice")), "f": casts.to_float(c("p_size")), "t": casts.to_text(c("p_size"))})

_TS = lambda: F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")
_TRUNC = ", ".join(f"strftime(date_trunc('{u}', ts), '%Y-%m-%d %H:%M:%S') AS {u}_" for u in ("year", "month", "day", "hour", "minute", "second"))
_on("q_dt_trunc", "events", "event_id", _TRUNC, lambda: {f"{u}_": datetimes.date_trunc(u, _TS()) for u in ("year", "month", "day", "hour", "minute", "second")})
_FIELDS = ("year", "month", "day", "hour", "minute", "second", "dow", "doy", "quarter", "week")
_on("q_dt_extract", "events", "event_id", ", ".join(f"floor(extract({f} FROM ts))::BIGINT AS {f}_" for f in _FIELDS), lambda: {f"{f}_": datetimes.extract(f, _TS()) for f in _FIELDS})
_on("q_dt_extract_unix", "events", "event_id", "extract(year FROM to_timestamp(event_id * 86400))::BIGINT AS y", lambda: {"y": datetimes.extract("year", c("event_id") * 86400, unix=True)})
_on("q_dt_to_char", "orders", "o_orderkey", "strftime(o_orderdate, '%Y-%m-%d') AS a, strftime(o_orderdate, '%d/%m/%Y %H:%M:%S') AS b", lambda: {"a": datetimes.to_char(c("o_orderdate"), "YYYY-MM-DD"), "b": datetimes.to_char(c("o_orderdate"), "DD/MM/YYYY HH24:MI:SS")})
_on("q_dt_to_timestamp", "events", "event_id", "strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS a, strftime(ts, '%Y-%m-%d') || ' 00:00:00' AS d, NULL::VARCHAR AS bad", lambda: {"a": datetimes.to_timestamp(_TS()), "d": datetimes.to_timestamp(F.date_format("ts", "yyyy-MM-dd")), "bad": datetimes.to_timestamp(F.lit("31/12/2020"))})
_AGE = """
SELECT o_orderkey, CASE WHEN y > 0 THEN y || ' years ' || m || ' months ' || (dd - y * 365 - m * 30) || ' days'
  WHEN m > 0 THEN m || ' months ' || (dd - m * 30) || ' days' ELSE (dd - m * 30) || ' days' END AS age
FROM (SELECT *, trunc(h / (30.44 * 24) - y * 12)::BIGINT AS m, trunc(h / 24)::BIGINT AS dd
  FROM (SELECT *, trunc(h / (365.25 * 24))::BIGINT AS y
    FROM (SELECT o_orderkey, epoch_us(TIMESTAMP '2002-01-01' - o_orderdate) / 3600000000.0::DOUBLE AS h FROM orders)))
"""


@query("q_dt_age", _AGE)
def q_dt_age(spark, d):
    return table(prepare(spark), d, "orders").select("o_orderkey", datetimes.age(c("o_orderdate"), F.lit("2002-01-01")).alias("age"))


@query("q_dt_now", "SELECT true AS shape, true AS recent")
def q_dt_now(spark, d):
    """The present as text: its form, and that it is of this hour or the one before (a run may cross its end)."""
    now = datetimes.now()
    recent = datetimes.parse(now).between(F.localtimestamp() - F.expr("INTERVAL 1 HOUR"), F.localtimestamp() + F.expr("INTERVAL 1 HOUR"))
    return prepare(spark).range(1).select(now.rlike(r"^\d{4}-\d\d-\d\d \d\d:\d\d:\d\d\.\d{6}$").alias("shape"), recent.alias("recent"))


J = json_
_P = lambda: c("props")
_DOC = lambda: F.concat(F.lit('{"u":'), c("user_id").cast("string"), F.lit(',"t":"'), c("event_type"), F.lit('","v":[1,2.5,{"z":null,"b":true}],"p":'), _P(), F.lit("}"))
_DOCQ = "'{\"u\":' || user_id || ',\"t\":\"' || event_type || '\",\"v\":[1,2.5,{\"z\":null,\"b\":true}],\"p\":' || props || '}'"
_on("q_json_extract", "events", "event_id", "(props::JSON->'$.k')::VARCHAR AS k, '\"' || event_type || '\"' AS t, '2.5' AS f, NULL::VARCHAR AS none", lambda: {"k": J.json_extract(_P(), "$.k"), "t": J.json_extract(_DOC(), "$.t"), "f": J.json_extract(_DOC(), "$.v[1]"), "none": J.json_extract(_DOC(), "$.a.b")})
_on("q_json_type", "events", "event_id", "'object' AS o, 'array' AS a, 'integer' AS i, 'real' AS r, 'text' AS t, 'null' AS n, 'integer' AS b", lambda: {"o": J.json_type(_P(), "$"), "a": J.json_type(_DOC(), "$.v"), "i": J.json_type(_P(), "$.k"), "r": J.json_type(_DOC(), "$.v[1]"), "t": J.json_type(_DOC(), "$.t"), "n": J.json_type(_DOC(), "$.v[2].z"), "b": J.json_type(_DOC(), "$.v[2].b")})
_K = "(props::JSON->>'$.k')"
_on("q_json_set", "events", "event_id", f"'{{\"a\":{{\"b\":7}},\"k\":' || {_K} || '}}' AS a, '{{\"k\":\"' || event_type || '\"}}' AS b", lambda: {"a": J.json_set(_P(), "$.a.b", 7), "b": J.json_set(_P(), "$.k", c("event_type"))})
_on("q_json_insert", "events", "event_id", f"'{{\"k\":' || {_K} || ',\"n\":1.5}}' AS a, '{{\"k\":' || {_K} || '}}' AS b", lambda: {"a": J.json_insert(_P(), "$.n", 1.5), "b": J.json_insert(_P(), "$.k", 0)})
_on("q_json_remove", "events", "event_id", f"'{{}}' AS a, '{{\"k\":' || {_K} || '}}' AS b", lambda: {"a": J.json_remove(_P(), "$.k"), "b": J.json_remove(_P(), "$.x")})
_on("q_jsonb_extract_path", "events", "event_id", f"{_K} AS k, '{{\"b\":true,\"z\":null}}' AS o, event_type AS t, '1' AS b, NULL::VARCHAR AS none", lambda: {"k": J.jsonb_extract_path(_P(), "k"), "o": J.jsonb_extract_path(_DOC(), "v.2"), "t": J.jsonb_extract_path(_DOC(), "t"), "b": J.jsonb_extract_path(_DOC(), "v.2.b"), "none": J.jsonb_extract_path(_DOC(), "v.9")})
_on("q_jsonb_extract_path_text", "events", "event_id", f"{_K} AS k, event_type AS t", lambda: {"k": J.jsonb_extract_path_text(_DOC(), "p.k"), "t": J.jsonb_extract_path_text(_DOC(), "t")})
_on("q_jsonb_typeof", "events", "event_id", "'object' AS a, 'array' AS b, 'string' AS c, 'number' AS d, 'boolean' AS e, 'null' AS f, 'null' AS g", lambda: {k: J.jsonb_typeof(F.lit(v) if v else _P()) for k, v in {"a": "", "b": "[1]", "c": '"x"', "d": "1.5", "e": "true", "f": "null", "g": "{bad"}.items()})
_on("q_jsonb_array_length", "events", "event_id", "3 AS n", lambda: {"n": J.jsonb_array_length(F.lit("[1,[2],3]")).cast("int")})
_on("q_jsonb_build_object", "events", "event_id", "'{\"a\":null,\"id\":' || event_id || ',\"type\":\"' || event_type || '\"}' AS o", lambda: {"o": J.jsonb_build_object(("type", c("event_type")), ("id", c("event_id")), ("a", F.lit(None).cast("string")))})
_on("q_jsonb_build_array", "events", "event_id", "'[' || event_id || ',\"' || event_type || '\",null,2.5]' AS a", lambda: {"a": J.jsonb_build_array(c("event_id"), c("event_type"), F.lit(None).cast("string"), F.lit(2.5))})
