"""The statement front: SQL text of the dialect in, a DataFrame or a row count out."""

from __future__ import annotations

import math
import re
import time
import uuid
import warnings
from collections.abc import Sequence
from dataclasses import replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import json_
from ..session import prepare
from ..types import SPARK, name_of
from . import udf
from .dialect import Rewriter
from .lexer import Token, closing, lex, split_top, unquote
from .tables import ACTIONS, Column, ConstraintViolation, Exists, ForeignKey, Index, NotFound, Store, Table, Trigger


def literal(value: object) -> str:
    """A Python value as SQL text."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(int(value))
    if isinstance(value, (bytes, bytearray)):
        return f"X'{value.hex()}'"
    if isinstance(value, float) and not math.isfinite(value):
        return f"CAST('{value}' AS FLOAT)"
    return "'" + value.replace("'", "''") + "'" if isinstance(value, str) else repr(value)


def bind(sql: str, params: Sequence[object]) -> str:
    """Puts values in for ``$n`` and ``?``."""
    out, at, asked = "", 0, 0
    for t in lex(sql):
        if t.kind == "param":
            n = int(t.text[1:]) - 1 if t.text != "?" else asked
            asked += t.text == "?"
            if not 0 <= n < len(params):
                raise ValueError(f"no value for {t.text}")
            out, at = out + sql[at : t.at] + literal(params[n]), t.end
    return out + sql[at:]


class Prepared:
    """A statement whose values come later."""

    def __init__(self, db: Database, sql: str):
        self.db, self.sql = db, sql

    def execute(self, *params: object):
        return self.db.execute(self.sql, params)


class Database(Store):
    """Tables, views, functions and triggers of one session of their own.

    ``folder`` (by default below the warehouse) must be one that all executors share.
    """

    def __init__(self, spark: SparkSession, folder: str | None = None):
        own = prepare(spark.newSession())
        super().__init__(own, folder or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/siltstone_{uuid.uuid4().hex}")
        self.stack: list[tuple[str, object]] = []
        self._register()

    def _register(self) -> None:
        """The helpers that rewritten statements call."""
        words = "split(regexp_replace(lower(t), '[^\\\\p{L}\\\\p{Nd}\\\\p{IsWhite_Space}]', ''), '\\\\p{IsWhite_Space}+')"
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION sil_tokens(t STRING) RETURNS ARRAY<STRING> RETURN {words}")
        for name, change in (("json_set", lambda d, p, v: json_.set_at(d, p, v, True)), ("json_insert", lambda d, p, v: json_.set_at(d, p, v, False))):
            self.spark.udf.register(f"sil_{name}", F.pandas_udf(_json_udf(change), "string"))
        self.spark.udf.register("sil_json_remove", F.pandas_udf(_json_remove, "string"))

    # statements

    def prepare(self, sql: str) -> Prepared:
        return Prepared(self, sql)

    def script(self, sql: str) -> list:
        """Runs statements that end with semicolons."""
        return [self.execute(s) for s in split_statements(sql)]

    def execute(self, sql: str, params: Sequence[object] = ()):
        """Runs one statement; a statement that fails changes nothing."""
        sql = bind(sql.strip().rstrip(";").strip(), params)
        tokens = lex(sql)
        if not tokens:
            raise SyntaxError("empty statement")
        word = tokens[0].up
        before = self.state.copy()
        try:
            run = getattr(self, f"_do_{word.lower()}", None)
            if run is None:
                raise SyntaxError(f"unknown statement {tokens[0].text}")
            return run(sql, tokens)
        except Exception:
            if word not in ("ROLLBACK", "COMMIT"):
                self.state = before
            raise

    def query(self, sql: str, params: Sequence[object] = ()) -> DataFrame:
        return self.execute(sql, params)

    # queries

    def spark_sql(self, sql: str, of: str | None = None) -> str:
        """The Spark SQL of an expression (over the table ``of``) or query; views of what it names are made ready."""
        tokens = lex(sql)
        named = {t.text.lower() for t in tokens if t.kind == "word"} | {unquote(t.text).lower() for t in tokens if t.kind == "quoted"}
        for t in named:
            if t in self.state.tables:
                self.read(t).createOrReplaceTempView(t)
            elif t in self.state.views:
                self.spark.sql(self.spark_sql(self.state.views[t])).createOrReplaceTempView(t)
        # The columns of what the statement names, and of no other table, decide whether a division is whole.
        named |= {of.lower()} if of else set()
        kinds: dict[str, set[str]] = {}
        for n, table in self.state.tables.items():
            if n in named:
                for c in table.columns:
                    kinds.setdefault(c.name.lower(), set()).add(name_of(SPARK[c.type.upper()]))
        for v in named & set(self.state.views):
            for f in self.spark.table(v).schema.fields:
                kinds.setdefault(f.name.lower(), set()).add(name_of(f.dataType))
        whole = {c for c, k in kinds.items() if k == {"INT"}}
        indexed = {n: (t.tokenizer, [c.lower() for c in t.names]) for n, t in self.state.tables.items() if t.tokenizer}
        whole = with_aliases(sql, tokens, whole)
        return Rewriter(whole, indexed).sql(grouped(sql))

    def _select(self, sql: str) -> DataFrame:
        sql, locks = re.subn(r"\s+FOR\s+UPDATE(\s+NOWAIT|\s+SKIP\s+LOCKED)?\s*$", "", sql, flags=re.I)
        if locks:
            warnings.warn("FOR UPDATE has no effect: versions are immutable, readers need no locks", stacklevel=3)
        return self.spark.sql(self.spark_sql(sql))

    def _do_select(self, sql, tokens):
        return self._select(sql)

    def _do_values(self, sql, tokens):
        return self._select(sql)

    def _do_with(self, sql, tokens):
        depth, i = 0, 1
        for i, t in enumerate(tokens):
            depth += (t.text == "(") - (t.text == ")")
            if not depth and t.up in ("SELECT", "INSERT", "UPDATE", "DELETE"):
                break
        if tokens[i].up == "INSERT":
            j = next(k for k in range(i, len(tokens)) if tokens[k].up == "SELECT")
            return self.execute(f"{sql[tokens[i].at : tokens[j].at]} {sql[: tokens[i].at]} {sql[tokens[j].at :]}")
        if tokens[i].up in ("UPDATE", "DELETE"):
            # The expressions become views for as long as the change takes.
            names = [unquote(tokens[k].text) for k in range(1, i) if self._names_cte(tokens, k)]
            if taken := [n for n in names if n.lower() in self.state.tables or n.lower() in self.state.views]:
                raise Exists(taken[0])
            for n in names:
                self._select(f"{sql[: tokens[i].at]} SELECT * FROM {n}").createOrReplaceTempView(n)
            try:
                return self.execute(sql[tokens[i].at :])
            finally:
                for n in names:
                    self.spark.catalog.dropTempView(n)
        return self._select(sql)

    @staticmethod
    def _names_cte(tokens: list[Token], k: int) -> bool:
        """Whether a token of a WITH clause names an expression: it follows WITH or a comma, outside of parentheses."""
        outside = sum((t.text == "(") - (t.text == ")") for t in tokens[:k]) == 0
        return outside and tokens[k].kind in ("word", "quoted") and tokens[k].up != "RECURSIVE" and (tokens[k - 1].up in ("WITH", "RECURSIVE") or tokens[k - 1].text == ",")

    def _do_explain(self, sql, tokens):
        """One row of text: the plan, and with ANALYZE the rows and seconds of a run."""
        analyze = tokens[1].up == "ANALYZE"
        df = self._select(sql[tokens[1 + analyze].at :])
        text = df._jdf.queryExecution().explainString(df._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
        if analyze:
            start = time.time()
            n = df.count()
            text += f"\nRows: {n}\nSeconds: {time.time() - start:.3f}"
        return self.spark.createDataFrame([(text,)], "plan string")

    def _do_pragma(self, sql, tokens):
        what = tokens[1].text.lower()
        arg = unquote(tokens[3].text) if len(tokens) > 3 else None
        if what == "database_list":
            return self.spark.createDataFrame([(0, "main", self.folder)], "seq int, name string, file string")
        if what in ("table_list", "tables"):
            rows = [("main", t.name, "virtual" if t.tokenizer else "table", len(t.columns)) for t in self.state.tables.values()] + [("main", v, "view", None) for v in self.state.views]
            return self.spark.createDataFrame(sorted(rows, key=lambda r: r[1]), "schema string, name string, type string, ncol int")
        if what == "table_info":
            t = self.table(arg)
            rows = [(i, c.name, c.type, int(c.not_null or c.name in t.primary_key), c.default, t.primary_key.index(c.name) + 1 if c.name in t.primary_key else 0) for i, c in enumerate(t.columns)]
            return self.spark.createDataFrame(rows, "cid int, name string, type string, notnull int, dflt_value string, pk int")
        if what == "index_list":
            t = self.table(arg)
            rows = [(f"{t.name}_{'_'.join(k)}_key", 1, "pk" if k == t.primary_key else "u") for k in t.keys] + [(i.name, int(i.unique), "c") for i in self.state.indexes.values() if i.table == t.name.lower()]
            return self.spark.createDataFrame([(n, *r) for n, r in enumerate(rows)], "seq int, name string, unique int, origin string")
        raise SyntaxError(f"unknown PRAGMA {what}")

    # definitions

    def _do_create(self, sql, tokens):
        ups = [t.up for t in tokens]
        kind = next(u for u in ups[1:] if u in ("TABLE", "INDEX", "VIEW", "FUNCTION", "TRIGGER"))
        return getattr(self, f"_create_{kind.lower()}")(sql, tokens, ups, ups.index(kind) + 1)

    @staticmethod
    def _maybe(ups: list[str], at: int) -> tuple[bool, int]:
        """Moves over IF [NOT] EXISTS."""
        for words in (["IF", "NOT", "EXISTS"], ["IF", "EXISTS"]):
            if ups[at : at + len(words)] == words:
                return True, at + len(words)
        return False, at

    def _free(self, name: str) -> None:
        if name.lower() in self.state.tables or name.lower() in self.state.views:
            raise Exists(name)

    def _create_table(self, sql, tokens, ups, at):
        quiet, at = self._maybe(ups, at)
        name = unquote(tokens[at].text)
        if quiet and name.lower() in self.state.tables:
            return 0
        self._free(name)
        if "VIRTUAL" in ups[:3]:
            open_ = ups.index("(", at)
            close = closing(tokens, open_)
            columns, tokenizer = [], "simple"
            for part in split_top(sql, tokens, open_ + 1, close):
                if "=" in part:
                    tokenizer = unquote(part.split("=", 1)[1].strip()).split()[0]
                else:
                    columns.append(Column(unquote(part.split()[0]), "TEXT"))
            rest = sql[tokens[close].end :]
            if m := re.search(r"tokenize\s*=\s*'?(\w+)", rest, re.I):
                tokenizer = m[1]
            self.put(Table(name, tuple(columns), tokenizer="porter" if tokenizer.lower() == "porter" else "simple"))
            return 0
        if ups[at + 1] == "AS":
            df = self._select(sql[tokens[at + 2].at :])
            columns = tuple(Column(f.name, name_of(f.dataType)) for f in df.schema.fields)
            self.put(Table(name, columns))
            return self.insert(name, df)
        close = closing(tokens, at + 1)
        columns, pk, uniques, checks, fks = [], (), [], [], []
        for part in split_top(sql, tokens, at + 2, close):
            c = self._constraint(part, lex(part))
            if c is not None:
                kind, value = c
                pk = value if kind == "pk" else pk
                {"unique": uniques, "check": checks, "fk": fks, "pk": []}[kind].append(value)
                continue
            column, more = self._column(part, lex(part))
            columns.append(column)
            for kind, value in more:
                pk = value if kind == "pk" else pk
                {"unique": uniques, "check": checks, "fk": fks, "pk": []}[kind].append(value)
        names = [c.name for c in columns]
        if len({n.lower() for n in names}) != len(names):
            raise Exists("column given twice")
        for fk in fks:
            if fk.parent.lower() != name.lower():
                self.table(fk.parent)
        self.put(Table(name, tuple(columns), tuple(pk), tuple(uniques), tuple(checks), tuple(fks)))
        return 0

    def _names(self, part: str, tokens: list[Token], at: int) -> tuple[tuple[str, ...], int]:
        close = closing(tokens, at)
        return tuple(unquote(x) for x in split_top(part, tokens, at + 1, close)), close + 1

    def _constraint(self, part: str, tokens: list[Token]):
        ups = [t.up for t in tokens]
        at = 2 if ups[0] == "CONSTRAINT" else 0
        if ups[at : at + 2] == ["PRIMARY", "KEY"]:
            return "pk", self._names(part, tokens, at + 2)[0]
        if ups[at] == "UNIQUE" and ups[at + 1] == "(":
            return "unique", self._names(part, tokens, at + 1)[0]
        if ups[at] == "CHECK":
            return "check", self._check(part, tokens, at + 1)[0]
        if ups[at : at + 2] == ["FOREIGN", "KEY"]:
            columns, at = self._names(part, tokens, at + 2)
            return "fk", self._references(part, tokens, ups, at, columns)[0]
        return None

    def _check(self, part, tokens, at):
        close = closing(tokens, at)
        return Rewriter(set()).sql(part[tokens[at].end : tokens[close].at]), close + 1

    def _references(self, part, tokens, ups, at, columns):
        parent = unquote(tokens[at + 1].text)
        at += 2
        if at < len(ups) and ups[at] == "(":
            keys, at = self._names(part, tokens, at)
        else:
            keys = self.table(parent).primary_key
        actions = {"DELETE": "NO ACTION", "UPDATE": "NO ACTION"}
        while at < len(ups) and ups[at] == "ON":
            two = " ".join(ups[at + 2 : at + 4])
            action = two if two in ACTIONS else ups[at + 2]
            if action not in ACTIONS:
                raise SyntaxError(f"unknown action {action}")
            actions[ups[at + 1]] = action
            at += 4 if action == two else 3
        return ForeignKey(columns, parent, tuple(keys), actions["DELETE"], actions["UPDATE"]), at

    def _column(self, part: str, tokens: list[Token]):
        ups = [t.up for t in tokens]
        name, kind = unquote(tokens[0].text), ups[1]
        if kind not in SPARK:
            raise SyntaxError(f"unknown type {tokens[1].text}")
        at, more, c = 2, [], Column(name, "INT" if kind == "SERIAL" else kind, auto=kind == "SERIAL")
        while at < len(ups):
            if ups[at : at + 2] == ["NOT", "NULL"]:
                c, at = replace(c, not_null=True), at + 2
            elif ups[at : at + 2] == ["PRIMARY", "KEY"]:
                more.append(("pk", (name,)))
                at += 2
            elif ups[at] == "UNIQUE":
                more.append(("unique", (name,)))
                at += 1
            elif ups[at] in ("AUTOINCREMENT", "AUTO_INCREMENT", "SERIAL"):
                c, at = replace(c, auto=True), at + 1
            elif ups[at] == "NULL":
                at += 1
            elif ups[at] == "DEFAULT":
                end = closing(tokens, at + 1) + 1 if ups[at + 1] == "(" else at + (3 if ups[at + 1] == "-" else 2)
                c, at = replace(c, default=Rewriter(set()).sql(part[tokens[at + 1].at : tokens[end - 1].end])), end
            elif ups[at] == "CHECK":
                text, at = self._check(part, tokens, at + 1)
                more.append(("check", text))
            elif ups[at] == "REFERENCES":
                fk, at = self._references(part, tokens, ups, at, (name,))
                more.append(("fk", fk))
            else:
                raise SyntaxError(f"unexpected {tokens[at].text} in column {name}")
        return c, more

    def _create_index(self, sql, tokens, ups, at):
        quiet, at = self._maybe(ups, at)
        name, table = unquote(tokens[at].text), unquote(tokens[at + 2].text)
        if name.lower() in self.state.indexes:
            if quiet:
                return 0
            raise Exists(f"index {name}")
        t, close = self.table(table), closing(tokens, at + 3)
        expr = Rewriter(set()).sql(sql[tokens[at + 3].end : tokens[close].at])
        self.state.indexes[name.lower()] = Index(name, t.name.lower(), unquote(expr), "UNIQUE" in ups[:2])
        if "UNIQUE" in ups[:2]:
            keys = self.read(table).select(F.expr(expr).alias("k")).dropna()
            self._none(keys.groupBy("k").count().where("count > 1"), f"UNIQUE {name}")
        self.read(table).select(F.expr(expr))
        return 0

    def _create_view(self, sql, tokens, ups, at):
        quiet, at = self._maybe(ups, at)
        name = unquote(tokens[at].text)
        if quiet and name.lower() in self.state.views:
            return 0
        self._free(name)
        text = sql[tokens[at + 2].at :]
        self._select(text)
        self.state.views[name.lower()] = text
        return 0

    def _create_function(self, sql, tokens, ups, at):
        name, params, result, body = udf.parse_create(sql)
        if not udf.is_block(name, body):
            sql = sql.replace(body, Rewriter({p for p, t in params if t in ("INT", "INTEGER")}).sql(body), 1)
        udf.create_function(self.spark, sql)
        self.state.functions[name] = sql
        return 0

    def _create_trigger(self, sql, tokens, ups, at):
        quiet, at = self._maybe(ups, at)
        name = unquote(tokens[at].text)
        if name.lower() in self.state.triggers:
            if quiet:
                return 0
            raise Exists(f"trigger {name}")
        timing, event, table = ups[at + 1], ups[at + 2], unquote(tokens[at + 4].text)
        if timing not in ("BEFORE", "AFTER") or event not in ("INSERT", "UPDATE", "DELETE"):
            raise SyntaxError("expected BEFORE or AFTER and an event")
        begin = ups.index("BEGIN", at)
        when = None
        if "WHEN" in ups[at:begin]:
            w = ups.index("WHEN", at)
            when = Rewriter(set()).sql(sql[tokens[w].end : tokens[begin].at])
        end = len(ups) - 1 - ups[::-1].index("END")
        self.state.triggers[name.lower()] = Trigger(name, timing, event, self.table(table).name.lower(), when, tuple(split_statements(sql[tokens[begin].end : tokens[end].at])))
        return 0

    def _do_drop(self, sql, tokens):
        ups = [t.up for t in tokens]
        quiet, at = self._maybe(ups, 2)
        name = unquote(tokens[at].text).lower()
        there = {"TABLE": self.state.tables, "VIEW": self.state.views, "INDEX": self.state.indexes, "TRIGGER": self.state.triggers, "FUNCTION": self.state.functions}[ups[1]]
        if name not in there:
            if quiet:
                return 0
            raise NotFound(f"{ups[1].lower()} {name}")
        if ups[1] == "TABLE":
            if any(fk.parent.lower() == name and t.name.lower() != name for t in self.state.tables.values() for fk in t.foreign_keys):
                raise ConstraintViolation(f"{name} is referenced")
            self.state.indexes = {k: i for k, i in self.state.indexes.items() if i.table != name}
            self.state.triggers = {k: t for k, t in self.state.triggers.items() if t.table != name}
        if ups[1] == "FUNCTION":
            udf.drop_function(self.spark, name, True)
        if ups[1] in ("TABLE", "VIEW"):
            self.spark.catalog.dropTempView(name)
        del there[name]
        return 0

    def _do_alter(self, sql, tokens):
        ups = [t.up for t in tokens]
        t = self.table(unquote(tokens[2].text))
        if ups[3] == "ADD":
            at = 4 + (ups[4] == "COLUMN")
            c, more = self._column(sql[tokens[at].at :], lex(sql[tokens[at].at :]))
            if c.name in t.names:
                raise Exists(f"column {c.name}")
            fill = (F.expr(c.default) if c.default is not None else F.lit(None)).cast(SPARK[c.type.upper()])
            df = self.read(t.name).withColumn(c.name, fill)
            kinds = {k: tuple(v for kk, v in more if kk == k) for k in ("unique", "check", "fk")}
            new = replace(t, columns=(*t.columns, c), uniques=t.uniques + kinds["unique"], checks=t.checks + kinds["check"], foreign_keys=t.foreign_keys + kinds["fk"])
            self.check(new, df, df.limit(0))
        elif ups[3] == "DROP":
            name = unquote(tokens[4 + (ups[4] == "COLUMN")].text)
            if name not in t.names:
                raise NotFound(f"column {name}")
            if name in t.primary_key:
                raise ConstraintViolation(f"{name} is a primary key")
            df = self.read(t.name).drop(name)
            new = replace(t, columns=tuple(c for c in t.columns if c.name != name), uniques=tuple(u for u in t.uniques if name not in u), foreign_keys=tuple(f for f in t.foreign_keys if name not in f.columns), checks=tuple(c for c in t.checks if name not in c))
        elif ups[3] == "RENAME" and ups[4] == "TO":
            to = unquote(tokens[5].text)
            self._free(to)
            del self.state.tables[t.name.lower()]
            self.put(replace(t, name=to))
            follow = lambda fk: replace(fk, parent=to) if fk.parent.lower() == t.name.lower() else fk
            for other in list(self.state.tables.values()):
                self.put(replace(other, foreign_keys=tuple(follow(fk) for fk in other.foreign_keys)))
            self.state.indexes = {k: replace(i, table=to.lower()) if i.table == t.name.lower() else i for k, i in self.state.indexes.items()}
            self.state.triggers = {k: replace(x, table=to.lower()) if x.table == t.name.lower() else x for k, x in self.state.triggers.items()}
            return 0
        else:
            at = 4 + (ups[4] == "COLUMN")
            old, to = unquote(tokens[at].text), unquote(tokens[at + 2].text)
            if old not in t.names:
                raise NotFound(f"column {old}")
            if to in t.names:
                raise Exists(f"column {to}")
            df, swap = self.read(t.name).withColumnRenamed(old, to), lambda k: tuple(to if c == old else c for c in k)
            new = replace(
                t, columns=tuple(replace(c, name=to) if c.name == old else c for c in t.columns), primary_key=swap(t.primary_key), uniques=tuple(map(swap, t.uniques)),
                foreign_keys=tuple(replace(f, columns=swap(f.columns)) for f in t.foreign_keys), checks=tuple(re.sub(rf"\b{re.escape(old)}\b", to, c) for c in t.checks),
            )
            word = re.compile(rf"\b{re.escape(old)}\b")
            follow = lambda fk: replace(fk, parent_columns=swap(fk.parent_columns)) if fk.parent.lower() == t.name.lower() else fk
            new = replace(new, foreign_keys=tuple(map(follow, new.foreign_keys)))
            for other in list(self.state.tables.values()):
                if other.name != t.name:
                    self.put(replace(other, foreign_keys=tuple(map(follow, other.foreign_keys))))
            self.state.indexes = {k: replace(i, expr=word.sub(to, i.expr)) if i.table == t.name.lower() else i for k, i in self.state.indexes.items()}
        self.put(replace(new, parts=(self.write(df, t.name),)))
        return 0

    def _do_truncate(self, sql, tokens):
        self.truncate(unquote(tokens[1 + (tokens[1].up == "TABLE")].text))
        return 0

    # changes

    def _do_insert(self, sql, tokens):
        ups = [t.up for t in tokens]
        t = self.table(unquote(tokens[2].text))
        at, given = 3, t.names
        if ups[3] == "(" and ups[4] not in ("SELECT", "WITH"):
            columns, at = self._names(sql, tokens, 3)
            given = list(columns)
        end, depth = len(tokens), 0
        for i in range(at, len(tokens)):
            depth += (ups[i] == "(") - (ups[i] == ")")
            if not depth and ups[i : i + 2] == ["ON", "CONFLICT"]:
                end = i
                break
        source = sql[tokens[at].at : tokens[end - 1].end]
        rows = self._literals(t, given, sql, tokens, at, end) if ups[at] == "VALUES" else self._select(source)
        if end == len(tokens):
            return self.insert(t.name, rows, given)
        key, at = self._names(sql, tokens, end + 2) if ups[end + 2] == "(" else (t.primary_key, end + 2)
        if ups[at : at + 2] != ["DO", "NOTHING"] and ups[at : at + 3] != ["DO", "UPDATE", "SET"]:
            raise SyntaxError("expected DO NOTHING or DO UPDATE SET")
        values = None if ups[at + 1] == "NOTHING" else self._sets(sql, tokens, at + 3, len(tokens), t.name)
        return self.upsert(t.name, rows, given, list(key), values)

    def _literals(self, t: Table, given: list[str], sql, tokens, at, end) -> DataFrame:
        defaults, rows, i = {c.name: c.default for c in t.columns}, [], at + 1
        while i < end:
            close = closing(tokens, i)
            parts = split_top(sql, tokens, i + 1, close)
            if len(parts) != len(given):
                raise ConstraintViolation(f"{len(given)} columns but {len(parts)} values")
            rows.append("(" + ", ".join((defaults.get(g) or "NULL") if p.upper() == "DEFAULT" else self.spark_sql(p) for g, p in zip(given, parts, strict=True)) + ")")
            i = close + 2
        return self.spark.sql(f"SELECT * FROM VALUES {', '.join(rows)}")

    def _sets(self, sql, tokens, start, end, of: str) -> dict[str, str]:
        out = {}
        for part in split_top(sql, tokens, start, end):
            name, _, value = part.partition("=")
            out[unquote(name.strip())] = self.spark_sql(value.strip(), of)
        return out

    def _do_update(self, sql, tokens):
        ups = [t.up for t in tokens]
        depth, where = 0, len(tokens)
        for i, u in enumerate(ups):
            depth += (u == "(") - (u == ")")
            if not depth and u == "WHERE":
                where = i
                break
        name = unquote(tokens[1].text)
        values = self._sets(sql, tokens, 3, where, name)
        return self.update(name, values, self.spark_sql(sql[tokens[where].end :], name) if where < len(tokens) else None)

    def _do_delete(self, sql, tokens):
        name = unquote(tokens[2].text)
        return self.delete(name, self.spark_sql(sql[tokens[3].end :], name) if len(tokens) > 3 else None)

    def run_trigger(self, statement: str, changes: DataFrame, depth: int) -> None:
        """A trigger's statement once for all changed rows, joined to what it changes by its condition."""
        tokens = lex(statement)
        ups = [t.up for t in tokens]
        view = f"_changes_{uuid.uuid4().hex}"
        changes.createOrReplaceTempView(view)
        if ups[0] == "INSERT":
            t = self.table(unquote(tokens[2].text))
            columns, at = self._names(statement, tokens, 3) if ups[3] == "(" else (tuple(t.names), 3)
            if ups[at] == "VALUES":
                values = split_top(statement, tokens, at + 2, closing(tokens, at + 1))
                source = f"SELECT {', '.join(map(self.spark_sql, values))} FROM {view}"
            else:
                source = self.spark_sql(statement[tokens[at].at :]) + f" CROSS JOIN {view}" if "WHERE" not in ups else self.spark_sql(statement[tokens[at].at : tokens[ups.index("WHERE")].at]) + f" CROSS JOIN {view} " + self.spark_sql(statement[tokens[ups.index("WHERE")].at :])
            self.insert(t.name, self.spark.sql(source), list(columns), depth)
            return
        t = self.table(unquote(tokens[1 if ups[0] == "UPDATE" else 2].text))
        where = self.spark_sql(statement[tokens[ups.index("WHERE")].end :], t.name) if "WHERE" in ups else "true"
        rows = f"_rows_{uuid.uuid4().hex}"
        self.rows(t.name).createOrReplaceTempView(rows)
        old = "named_struct(" + ", ".join(f"'{c}', `{t.name}`.`{c}`" for c in t.names) + ")"
        if ups[0] == "DELETE":
            hit = self.spark.sql(f"SELECT DISTINCT {old} AS OLD, _rid FROM {rows} AS `{t.name}` JOIN {view} ON {where}")
            self.remove(t.name, hit, depth)
            return
        sets = self._sets(statement, tokens, 3, ups.index("WHERE") if "WHERE" in ups else len(ups), t.name)
        kinds = {c.name: SPARK[c.type.upper()].simpleString() for c in t.columns}
        new = "named_struct(" + ", ".join(f"'{c}', " + (f"CAST(({sets[c]}) AS {kinds[c]})" if c in sets else f"`{t.name}`.`{c}`") for c in t.names) + ")"
        hit = self.spark.sql(f"SELECT {old} AS OLD, {new} AS NEW, _rid FROM {rows} AS `{t.name}` JOIN {view} ON {where}")
        self.change(t.name, hit.groupBy("_rid").agg(F.any_value("OLD").alias("OLD"), F.max("NEW").alias("NEW")).select("OLD", "NEW", "_rid"), depth)

    # transactions

    def _do_begin(self, sql, tokens):
        if self.stack:
            raise ConstraintViolation("a transaction is open")
        self.stack = [("", self.state.copy())]
        return 0

    def _do_commit(self, sql, tokens):
        if not self.stack:
            raise ConstraintViolation("no transaction is open")
        self.stack = []
        return 0

    def _savepoint(self, name: str) -> int:
        at = [i for i, (n, _) in enumerate(self.stack) if n == name.lower() and i]
        if not at:
            raise NotFound(f"savepoint {name}")
        return at[-1]

    def _do_rollback(self, sql, tokens):
        if not self.stack:
            raise ConstraintViolation("no transaction is open")
        words = [t.up for t in tokens[1:] if t.up not in ("TO", "SAVEPOINT", "TRANSACTION")]
        if words:
            at = self._savepoint(unquote(tokens[-1].text))
            self.state = self.stack[at][1].copy()
            self.stack = self.stack[: at + 1]
        else:
            self.state, self.stack = self.stack[0][1], []
        return 0

    def _do_savepoint(self, sql, tokens):
        if not self.stack:
            raise ConstraintViolation("no transaction is open")
        self.stack.append((unquote(tokens[1].text).lower(), self.state.copy()))
        return 0

    def _do_release(self, sql, tokens):
        self.stack = self.stack[: self._savepoint(unquote(tokens[-1].text))]
        return 0


def _json_udf(change):
    import json

    def run(docs: pd.Series, paths: pd.Series, values: pd.Series) -> pd.Series:
        rows = zip(docs, paths, values, strict=True)
        return pd.Series([None if d is None or p is None else json_.dump(change(json.loads(d), json_.parse_path(p), json.loads(v).get("v"))) for d, p, v in rows], dtype=object)

    run.__annotations__ = {"docs": pd.Series, "paths": pd.Series, "values": pd.Series, "return": pd.Series}
    return run


def _json_remove(docs, paths):
    import json

    return pd.Series([None if d is None or p is None else json_.dump(json_.remove_at(json.loads(d), json_.parse_path(p))) for d, p in zip(docs, paths, strict=True)], dtype=object)


_json_remove.__annotations__ = {"docs": pd.Series, "paths": pd.Series, "return": pd.Series}


def split_statements(sql: str) -> list[str]:
    """Statements between semicolons; BEGIN … END of a trigger and $$ … $$ stay whole."""
    out, start, depth, create = [], None, 0, False
    for t in lex(sql):
        if start is None:
            if t.text == ";":
                continue
            start, create = t.at, False
        create = create or t.up == "TRIGGER"
        if create and t.up == "BEGIN" or t.up == "CASE":
            depth += 1
        elif t.up == "END" and depth:
            depth -= 1
        elif t.text == ";" and not depth:
            out.append(sql[start : t.at].strip())
            start = None
    if start is not None:
        out.append(sql[start:].strip())
    return [s for s in out if s]


def with_aliases(sql: str, tokens: list[Token], whole: set[str]) -> set[str]:
    """The names of whole columns where the statement's own ``AS name`` count as well: whole only if what they name is."""
    known = dict.fromkeys(whole, True)
    for k, t in enumerate(tokens):
        if t.up != "AS" or k + 1 >= len(tokens) or tokens[k + 1].kind not in ("word", "quoted"):
            continue
        i, depth = k, 0
        while i > 0 and (depth or tokens[i - 1].text not in (",", "(") and tokens[i - 1].up not in ("SELECT", "DISTINCT", "FROM", "JOIN", "WITH")):
            i -= 1
            depth += (tokens[i].text == ")") - (tokens[i].text == "(")
        if i and tokens[i - 1].up in ("SELECT", "DISTINCT") or i and tokens[i - 1].text == ",":
            name = unquote(tokens[k + 1].text).lower()
            is_whole = i < k and Rewriter({n for n, w in known.items() if w}).is_whole(sql[tokens[i].at : tokens[k - 1].end])
            known[name] = is_whole and known.get(name, True)
    return {n for n, w in known.items() if w}


def grouped(sql: str) -> str:
    """Chains of set operations grouped to the right, as the dialect has them: A EXCEPT (B EXCEPT C), in every query body."""
    tokens = lex(sql)
    out, at, i = "", 0, 0
    while i < len(tokens):  # sub-selects and the bodies of WITH first
        if tokens[i].text == "(" and i + 1 < len(tokens) and tokens[i + 1].up in ("SELECT", "WITH", "("):
            j = closing(tokens, i)
            out += sql[at : tokens[i].end] + grouped(sql[tokens[i].end : tokens[j].at])
            at, i = tokens[j].at, j
        i += 1
    sql = out + sql[at:]
    tokens, depth, cuts, start = lex(sql), 0, [], None
    for i, t in enumerate(tokens):
        depth += (t.text == "(") - (t.text == ")")
        if not depth and start is None and (t.up == "SELECT" or t.text == ")" and tokens[0].text == "("):
            start = i
        if not depth and start is not None and t.up in ("UNION", "INTERSECT", "EXCEPT"):
            cuts.append(i)
    if len(cuts) < 2:
        return sql
    end, depth = len(sql), 0
    for i in range(cuts[-1], len(tokens)):
        depth += (tokens[i].text == "(") - (tokens[i].text == ")")
        if not depth and (tokens[i].up == "LIMIT" or tokens[i].up == "ORDER"):
            end = tokens[i].at
            break
    out = sql[: tokens[cuts[0]].at]
    for k, c in enumerate(cuts):
        op = "UNION ALL" if tokens[c + 1].up == "ALL" else tokens[c].up
        begin = tokens[c + 1 + (tokens[c + 1].up == "ALL")].at
        part = sql[begin : tokens[cuts[k + 1]].at if k + 1 < len(cuts) else end]
        out += f"{op} {'(' if k + 1 < len(cuts) else ''}{part}"
    return out + ")" * (len(cuts) - 1) + " " + sql[end:]
