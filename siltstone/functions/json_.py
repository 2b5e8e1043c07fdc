"""JSON functions over TEXT documents.

Reads stay in the JVM (VARIANT). The three mutators have no built-in counterpart and run as Arrow-batched
Pandas UDFs. Whole documents are written with sorted keys and without spaces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_STEP = re.compile(r"\.([^.\[]+)|\[(\d+)\]")


def parse_path(path: str) -> list[str | int]:
    """``$.a[0].b`` to keys and indexes; raises for anything else."""
    rest, out = path.removeprefix("$"), []
    while rest:
        m = _STEP.match(rest)
        if not m:
            raise ValueError(f"invalid JSON path {path}")
        out.append(m[1] if m[2] is None else int(m[2]))
        rest = rest[m.end() :]
    return out


def _at(doc: Column, steps: list[str | int]) -> Column:
    """The VARIANT at a path, null where it leads nowhere; invalid documents are null."""
    v = F.try_parse_json(doc)
    path = "$" + "".join(f"[{s}]" if isinstance(s, int) else "['" + s.replace("'", "\\'") + "']" for s in steps)
    return F.try_variant_get(v, path, "variant") if steps else v


def json_extract(doc: Column, path: str) -> Column:
    """The value's JSON text: strings keep their quotes, keys are sorted; null if missing."""
    return F.to_json(_at(doc, parse_path(path)))


def _kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def json_type(doc: Column, path: str = "$") -> Column:
    """null, integer, real, text, array or object; booleans count as integers, what is missing as null."""
    v = _at(doc, parse_path(path))
    k = _kind(v)
    whole = k.isin("BIGINT", "BOOLEAN") | (k.startswith("DECIMAL") & k.endswith(",0)"))
    number = F.try_variant_get(v, "$", "double")
    name = F.when(whole, "integer").when(k.startswith("DECIMAL") | k.isin("DOUBLE", "FLOAT"), F.when(number == F.floor(number), "integer").otherwise("real"))
    name = name.when(k == "STRING", "text").when(k.startswith("ARRAY"), "array").when(k.startswith("OBJECT"), "object").otherwise("null")
    return F.when(doc.isNotNull(), F.coalesce(name, F.lit("null")))


def jsonb_typeof(doc: Column) -> Column:
    """object, array, string, number, boolean or null; what is no JSON counts as null."""
    k = _kind(F.try_parse_json(doc))
    name = F.when(k.startswith("OBJECT"), "object").when(k.startswith("ARRAY"), "array").when(k == "STRING", "string").when(k == "BOOLEAN", "boolean")
    name = name.when(k.isin("BIGINT", "DOUBLE", "FLOAT") | k.startswith("DECIMAL"), "number").otherwise("null")
    return F.when(doc.isNotNull(), F.coalesce(name, F.lit("null")))


def _dotted(path: str) -> list[str | int]:
    return [int(p) if p.isdigit() else p for p in path.split(".") if p]


def jsonb_extract_path(doc: Column, path: str) -> Column:
    """The value at a dotted path: text bare, booleans 0 and 1, objects and arrays as JSON; null if missing."""
    v = _at(doc, _dotted(path))
    k = _kind(v)
    json_text = F.to_json(v)
    return F.when(k == "VOID", None).when(k == "STRING", F.try_variant_get(v, "$", "string")).when(k == "BOOLEAN", F.when(json_text == "true", "1").otherwise("0")).otherwise(F.regexp_replace(json_text, r"^(-?\d+)\.0+$", "$1"))


jsonb_extract_path_text = jsonb_extract_path


def jsonb_array_length(doc: Column) -> Column:
    """An error if the document is no array."""
    n = F.json_array_length(doc)
    return F.when(doc.isNull(), None).otherwise(F.coalesce(n, F.raise_error(F.concat(F.lit("no JSON array: "), doc)).cast("int"))).cast("bigint")


def jsonb_build_object(*pairs: tuple[str, Column]) -> Column:
    """Keys sorted; a key given twice keeps its last value; null values stay."""
    last = dict(p for p in pairs if p[0] is not None)
    if not last:
        return F.lit("{}")
    return F.to_json(F.struct(*[v.alias(k) for k, v in sorted(last.items())]), {"ignoreNullFields": "false"})


def jsonb_build_array(*xs: Column) -> Column:
    """Values of mixed types, nulls included."""
    if not xs:
        return F.lit("[]")
    one = lambda x: F.regexp_extract(F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"}), r'(?s)^\{"v":(.*)\}$', 1)
    return F.concat(F.lit("["), F.concat_ws(",", *[one(x) for x in xs]), F.lit("]"))


def dump(x: object) -> str:
    """Compact, keys sorted, whole floats without a point."""

    def plain(v):
        if isinstance(v, float) and v.is_integer() and abs(v) < 1e21:
            return int(v)
        if isinstance(v, dict):
            return {k: plain(w) for k, w in v.items()}
        return [plain(w) for w in v] if isinstance(v, list) else v

    return json.dumps(plain(x), sort_keys=True, separators=(",", ":"), ensure_ascii=False)


_MISSING = object()


def _child(at: object, step: str | int) -> object:
    if isinstance(at, dict) and isinstance(step, str):
        return at.get(step, _MISSING)
    if isinstance(at, list) and isinstance(step, int) and step < len(at):
        return at[step]
    return _MISSING


def set_at(doc: object, steps: list[str | int], value: object, replace: bool) -> object:
    """Sets (or, without ``replace``, only adds) a value; missing objects and arrays on the way are made."""
    if not steps:
        return value if replace else doc
    step, rest = steps[0], steps[1:]
    if isinstance(step, int):
        if not isinstance(doc, list):
            return doc
        if step < len(doc):
            if rest or replace:
                doc[step] = set_at(doc[step], rest, value, replace)
            return doc
        doc += [None] * (step - len(doc))
        doc.append(set_at([] if rest and isinstance(rest[0], int) else {}, rest, value, replace) if rest else value)
        return doc
    if not isinstance(doc, dict):
        return doc
    there = _child(doc, step)
    if not rest:
        if there is _MISSING or replace:
            doc[step] = value
    else:
        doc[step] = set_at(([] if isinstance(rest[0], int) else {}) if there is _MISSING else there, rest, value, replace)
    return doc


def remove_at(doc: object, steps: list[str | int]) -> object:
    """Takes out what is at a path; a path that leads nowhere changes nothing, the whole document is an error."""
    if not steps:
        raise ValueError("cannot remove the whole document")
    at = doc
    for s in steps[:-1]:
        at = _child(at, s)
    if _child(at, steps[-1]) is not _MISSING:
        del at[steps[-1]]  # type: ignore[attr-defined]
    return doc


def _mutator(change: Callable[[object, object], object]):
    def run(docs: pd.Series, values: pd.Series) -> pd.Series:
        def one(d, v):
            return None if d is None else dump(change(json.loads(d), json.loads(v).get("v")))

        return pd.Series([one(d, v) for d, v in zip(docs, values, strict=True)], dtype=object)

    run.__annotations__ = {"docs": pd.Series, "values": pd.Series, "return": pd.Series}
    return F.pandas_udf(run, "string")


def _value(v) -> Column:
    return F.to_json(F.struct((v if isinstance(v, Column) else F.lit(v)).alias("v")))


def json_set(doc: Column, path: str, value) -> Column:
    """Creates or replaces; text values are strings, null is null."""
    steps = parse_path(path)
    return _mutator(lambda d, v: set_at(d, steps, v, True))(doc, _value(value))


def json_insert(doc: Column, path: str, value) -> Column:
    """Creates, but leaves what is there."""
    steps = parse_path(path)
    return _mutator(lambda d, v: set_at(d, steps, v, False))(doc, _value(value))


def json_remove(doc: Column, path: str) -> Column:
    steps = parse_path(path)
    return _mutator(lambda d, _: remove_at(d, steps))(doc, F.lit("{}"))
