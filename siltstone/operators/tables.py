"""Tables as immutable versions: constraints, copy-on-write changes, foreign-key actions and row-set triggers.

A version is a list of Parquet folders. An insert adds a folder; an update or delete writes a new one. The
catalog points at versions, so a statement takes effect by one change of a pointer after all its checks have
passed, a savepoint is a copy of the pointers, and readers of older versions are not disturbed.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..types import TypeMismatch, name_of, spark_type

#: Triggers within triggers, and foreign-key actions within such, at most.
DEPTH = 16
ACTIONS = ("RESTRICT", "NO ACTION", "CASCADE", "SET NULL")


class ConstraintViolation(Exception):
    """A NOT NULL, UNIQUE, CHECK or FOREIGN KEY constraint that a statement would break."""


class NotFound(Exception):
    """A table, column, view, index, trigger or savepoint that does not exist."""


class Exists(Exception):
    """A name that is taken."""


@dataclass(frozen=True)
class Column:
    name: str
    type: str
    not_null: bool = False
    default: str | None = None
    auto: bool = False


@dataclass(frozen=True)
class ForeignKey:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    on_delete: str = "NO ACTION"
    on_update: str = "NO ACTION"


@dataclass(frozen=True)
class Table:
    name: str
    columns: tuple[Column, ...]
    primary_key: tuple[str, ...] = ()
    uniques: tuple[tuple[str, ...], ...] = ()
    checks: tuple[str, ...] = ()
    foreign_keys: tuple[ForeignKey, ...] = ()
    tokenizer: str | None = None
    parts: tuple[str, ...] = ()
    counter: int = 0

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def schema(self) -> T.StructType:
        return T.StructType([T.StructField(c.name, spark_type(c.type)) for c in self.columns])

    @property
    def keys(self) -> list[tuple[str, ...]]:
        return [k for k in (self.primary_key, *self.uniques) if k]


@dataclass(frozen=True)
class Index:
    name: str
    table: str
    expr: str
    unique: bool


@dataclass(frozen=True)
class Trigger:
    name: str
    timing: str
    event: str
    table: str
    when: str | None
    body: tuple[str, ...]


@dataclass
class State:
    tables: dict[str, Table] = field(default_factory=dict)
    views: dict[str, str] = field(default_factory=dict)
    indexes: dict[str, Index] = field(default_factory=dict)
    triggers: dict[str, Trigger] = field(default_factory=dict)
    functions: dict[str, str] = field(default_factory=dict)

    def copy(self) -> State:
        return State(*[dict(x) for x in (self.tables, self.views, self.indexes, self.triggers, self.functions)])


class Store:
    """Reads and writes versions below one folder that all executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder, self.state = spark, folder, State()

    # versions

    def table(self, name: str) -> Table:
        try:
            return self.state.tables[name.lower()]
        except KeyError:
            raise NotFound(f"table {name}") from None

    def read(self, name: str) -> DataFrame:
        t = self.table(name)
        return self.spark.read.schema(t.schema).parquet(*t.parts) if t.parts else self.spark.createDataFrame([], t.schema)

    def write(self, df: DataFrame, name: str) -> str:
        path = f"{self.folder}/{name}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return path

    def put(self, t: Table) -> None:
        self.state.tables[t.name.lower()] = t

    def rows(self, name: str) -> DataFrame:
        """A table's rows with ``_rid``: the file and the place in it, so it does not depend on how a scan is split."""
        if not self.table(name).parts:
            return self.read(name).withColumn("_rid", F.lit(None).cast("struct<file:string,place:bigint>"))
        place = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("place"))
        return self.read(name).withColumn("_rid", place)

    # checks

    def _none(self, df: DataFrame, what: str) -> None:
        if bad := df.limit(1).collect():
            raise ConstraintViolation(f"{what}: {bad[0].asDict()}")

    def check(self, t: Table, new: DataFrame, others: DataFrame) -> None:
        """Raises unless the new rows fit the table's constraints beside its other rows; null keys are exempt."""
        for c in t.columns:
            if c.not_null or c.name in t.primary_key:
                self._none(new.where(F.col(c.name).isNull()), f"NOT NULL {t.name}.{c.name}")
        for text in t.checks:
            self._none(new.where(F.expr(f"NOT ({text})")), f"CHECK ({text})")
        unique = [i.expr for i in self.state.indexes.values() if i.table == t.name.lower() and i.unique]
        for key in [*t.keys, *[(u,) for u in unique]]:
            cols = [F.expr(k if k not in t.names else f"`{k}`").alias(f"k{i}") for i, k in enumerate(key)]
            keys, what = new.select(*cols).dropna(), f"UNIQUE {t.name}({', '.join(key)})"
            self._none(keys.groupBy(*keys.columns).count().where("count > 1"), what)
            self._none(keys.join(others.select(*cols), keys.columns, "left_semi"), what)
        for fk in t.foreign_keys:
            parent = self.read(fk.parent) if fk.parent.lower() != t.name.lower() else new.unionByName(others)
            have = parent.select(*[F.col(p).alias(c) for p, c in zip(fk.parent_columns, fk.columns, strict=True)])
            lost = new.select(*fk.columns).dropna().join(have, list(fk.columns), "left_anti")
            self._none(lost, f"FOREIGN KEY {t.name}({', '.join(fk.columns)}) to {fk.parent}")

    def aligned(self, t: Table, rows: DataFrame, given: list[str]) -> DataFrame:
        """The table's columns: what is given, of just the column's type, else the default, else null."""
        if len(given) != len(rows.columns):
            raise TypeMismatch(f"{len(given)} columns but {len(rows.columns)} values")
        if unknown := [g for g in given if g not in t.names]:
            raise NotFound(f"column {unknown[0]} of {t.name}")
        rows = rows.toDF(*[f"_{i}" for i in range(len(given))])
        kinds = dict(zip(given, rows.schema.fields, strict=True))
        out = []
        for c in t.columns:
            kind = spark_type(c.type)
            if c.name in kinds:
                f = kinds[c.name]
                if not isinstance(f.dataType, T.NullType) and name_of(f.dataType) != name_of(kind):
                    raise TypeMismatch(f"column {c.name} is {c.type}, value is {f.dataType.simpleString()}")
                out.append(F.col(f.name).cast(kind).alias(c.name))
            else:
                out.append((F.expr(c.default) if c.default is not None else F.lit(None)).cast(kind).alias(c.name))
        return rows.select(*out)

    def numbered(self, t: Table, rows: DataFrame) -> tuple[DataFrame, int]:
        """Fills the AUTOINCREMENT column where it is null, after the largest number so far; and the counter then."""
        auto = next((c.name for c in t.columns if c.auto), None)
        if auto is None:
            return rows.drop("_i"), t.counter
        top = rows.agg(F.max(auto)).first()[0]
        start = max(t.counter, top or 0)
        # _i was given before the rows were written: source task and place in it, so their order is kept.
        empty = rows.where(F.col(auto).isNull()).withColumn("_p", F.shiftright("_i", 33))
        firsts = {r["_p"]: r["n"] for r in empty.groupBy("_p").agg(F.count("*").alias("n")).collect()}
        if not firsts:
            return rows.drop("_i"), start
        # Tasks are numbered after each other; only a count a task is gathered.
        offset, at = [], start
        for p in sorted(firsts):
            offset += [F.lit(p), F.lit(at)]
            at += firsts[p]
        from pyspark.sql import Window

        within = F.row_number().over(Window.partitionBy("_p").orderBy("_i"))
        filled = empty.withColumn(auto, (F.create_map(*offset)[F.col("_p")] + within).cast("long")).drop("_p", "_i")
        return rows.where(F.col(auto).isNotNull()).drop("_i").unionByName(filled), at

    # changes

    def insert(self, name: str, rows: DataFrame, given: list[str] | None = None, depth: int = 0) -> int:
        """Adds rows; returns how many."""
        t = self.table(name)
        staged = self.write(self.aligned(t, rows, given or t.names).withColumn("_i", F.monotonically_increasing_id()), t.name)
        new, counter = self.numbered(t, self.spark.read.schema(T.StructType([*t.schema.fields, T.StructField("_i", T.LongType())])).parquet(staged))
        if counter != t.counter:
            staged = self.write(new, t.name)
            new = self.spark.read.schema(t.schema).parquet(staged)
        changes = self._changes(None, new, t)
        self.fire("BEFORE", "INSERT", t.name, changes, depth)
        self.check(t, new, self.read(name))
        t = self.table(name)
        self.put(replace(t, parts=(*t.parts, staged), counter=counter))
        self.fire("AFTER", "INSERT", t.name, changes, depth)
        return new.count()

    def _changes(self, old: DataFrame | None, new: DataFrame | None, t: Table) -> DataFrame:
        side = new if new is not None else old
        empty = F.lit(None).cast(t.schema)
        row = F.struct(*[F.col(c) for c in t.names])
        return side.select((row if old is not None else empty).alias("OLD"), (row if new is not None else empty).alias("NEW"))

    def pairs(self, name: str, values: dict[str, str], where: str | None) -> DataFrame:
        """(OLD, NEW, _rid) of the rows that an update changes; ``where`` and values may hold subqueries."""
        t = self.table(name)
        if unknown := [v for v in values if v not in t.names]:
            raise NotFound(f"column {unknown[0]} of {t.name}")
        view = f"_rows_{uuid.uuid4().hex}"
        self.rows(name).createOrReplaceTempView(view)
        sets = ", ".join(f"CAST(({v}) AS {spark_type(next(c.type for c in t.columns if c.name == k)).simpleString()}) AS `_set_{k}`" for k, v in values.items())
        df = self.spark.sql(f"SELECT *{', ' + sets if sets else ''} FROM {view} AS `{t.name}`{' WHERE ' + where if where else ''}")
        new = F.struct(*[F.col(f"_set_{c}" if c in values else c).alias(c) for c in t.names])
        return df.select(F.struct(*t.names).alias("OLD"), new.alias("NEW"), "_rid")

    def update(self, name: str, values: dict[str, str], where: str | None = None, depth: int = 0) -> int:
        return self.change(name, self.pairs(name, values, where), depth)

    def change(self, name: str, pairs: DataFrame, depth: int = 0) -> int:
        """Replaces rows by (OLD, NEW, _rid), with triggers and the actions of foreign keys that point here."""
        if depth > DEPTH:
            raise ConstraintViolation("triggers or foreign keys go too deep")
        t = self.table(name)
        kept = self.write(pairs, f"{t.name}_changes")
        pairs = self.spark.read.parquet(kept)
        n = pairs.count()
        if not n:
            return 0
        self.fire("BEFORE", "UPDATE", t.name, pairs, depth)
        others = self.rows(name).join(pairs.select("_rid"), "_rid", "left_anti").drop("_rid")
        new = pairs.select("NEW.*")
        for child, fk in self.children(t.name):
            moved = pairs.where(F.array(*[F.col(f"OLD.{p}") for p in fk.parent_columns]) != F.array(*[F.col(f"NEW.{p}") for p in fk.parent_columns]))
            if fk.on_update in ("RESTRICT", "NO ACTION"):
                self._none(self._referring(child, fk, moved, "OLD"), f"FOREIGN KEY {child}({', '.join(fk.columns)}) restricts the update")
        self.check(replace(t, foreign_keys=tuple(f for f in t.foreign_keys if f.parent.lower() != t.name.lower())), new, others)
        path = self.write(others.unionByName(new), t.name)
        self.put(replace(self.table(name), parts=(path,)))
        for child, fk in self.children(t.name):
            self._follow_update(child, fk, pairs, depth)
        self.fire("AFTER", "UPDATE", t.name, pairs, depth)
        return n

    def delete(self, name: str, where: str | None = None, depth: int = 0) -> int:
        return self.remove(name, self.pairs(name, {}, where).select("OLD", "_rid"), depth)

    def remove(self, name: str, gone: DataFrame, depth: int = 0) -> int:
        """Deletes rows (OLD, _rid), with triggers and the actions of foreign keys that point here."""
        if depth > DEPTH:
            raise ConstraintViolation("triggers or foreign keys go too deep")
        t = self.table(name)
        gone = self.spark.read.schema(gone.schema).parquet(self.write(gone, f"{t.name}_changes"))
        n = gone.count()
        if not n:
            return 0
        changes = gone.select("OLD", F.lit(None).cast(t.schema).alias("NEW"))
        self.fire("BEFORE", "DELETE", t.name, changes, depth)
        left = self.rows(name).join(gone.select("_rid"), "_rid", "left_anti").drop("_rid")
        path = self.write(left, t.name)
        self.put(replace(self.table(name), parts=(path,)))
        for child, fk in self.children(t.name):
            hit = self._referring(child, fk, gone, "OLD")
            if fk.on_delete in ("RESTRICT", "NO ACTION"):
                self._none(hit, f"FOREIGN KEY {child}({', '.join(fk.columns)}) restricts the delete")
            elif fk.on_delete == "CASCADE":
                self.remove(child, hit.select(F.struct(*self.table(child).names).alias("OLD"), "_rid"), depth + 1)
            else:
                self._set_null(child, fk, hit, depth)
        self.fire("AFTER", "DELETE", t.name, changes, depth)
        return n

    def truncate(self, name: str) -> None:
        """Empties a table; its counter stays."""
        self.put(replace(self.table(name), parts=()))

    # foreign keys

    def children(self, parent: str) -> list[tuple[str, ForeignKey]]:
        return [(t.name, fk) for t in self.state.tables.values() for fk in t.foreign_keys if fk.parent.lower() == parent.lower()]

    def _referring(self, child: str, fk: ForeignKey, changes: DataFrame, side: str) -> DataFrame:
        keys = changes.select(*[F.col(f"{side}.{p}").alias(c) for p, c in zip(fk.parent_columns, fk.columns, strict=True)]).distinct()
        return self.rows(child).join(keys, list(fk.columns), "left_semi")

    def _set_null(self, child: str, fk: ForeignKey, hit: DataFrame, depth: int) -> None:
        names = self.table(child).names
        new = F.struct(*[(F.lit(None).cast(hit.schema[c].dataType) if c in fk.columns else F.col(c)).alias(c) for c in names])
        self.change(child, hit.select(F.struct(*names).alias("OLD"), new.alias("NEW"), "_rid"), depth + 1)

    def _follow_update(self, child: str, fk: ForeignKey, pairs: DataFrame, depth: int) -> None:
        old = [F.col(f"OLD.{p}").alias(c) for p, c in zip(fk.parent_columns, fk.columns, strict=True)]
        new = [F.col(f"NEW.{p}").alias(f"_new_{c}") for p, c in zip(fk.parent_columns, fk.columns, strict=True)]
        moved = pairs.select(*old, *new).where(F.array(*fk.columns) != F.array(*[f"_new_{c}" for c in fk.columns])).dropDuplicates(list(fk.columns))
        names = self.table(child).names
        hit = self.rows(child).join(moved, list(fk.columns))
        if fk.on_update == "CASCADE":
            row = F.struct(*[F.col(f"_new_{c}" if c in fk.columns else c).alias(c) for c in names])
            self.change(child, hit.select(F.struct(*names).alias("OLD"), row.alias("NEW"), "_rid"), depth + 1)
        elif fk.on_update == "SET NULL":
            self._set_null(child, fk, hit, depth)

    # triggers

    def fire(self, timing: str, event: str, table: str, changes: DataFrame, depth: int) -> None:
        """Runs the bodies of a table's triggers once over all changed rows; set by the statement front."""
        for trigger in list(self.state.triggers.values()):
            if (trigger.timing, trigger.event, trigger.table) == (timing, event, table.lower()):
                if depth >= DEPTH:
                    raise ConstraintViolation("triggers go too deep")
                hit = changes.where(F.expr(trigger.when)) if trigger.when else changes
                if not hit.isEmpty():
                    for statement in trigger.body:
                        self.run_trigger(statement, hit, depth + 1)

    def run_trigger(self, statement: str, changes: DataFrame, depth: int) -> None:
        raise NotImplementedError

    def upsert(self, name: str, rows: DataFrame, given: list[str], key: list[str], values: dict[str, str] | None) -> int:
        """INSERT … ON CONFLICT (key): without ``values`` conflicting rows are left out, else they change what is there.

        Rows of the statement itself that share a key conflict as well: the first is inserted, the others
        change it. ``excluded.x`` in a value is the column of the row that was to be inserted (the last of them).
        """
        t = self.table(name)
        if not any(set(key) == set(k) for k in t.keys):
            raise ConstraintViolation(f"ON CONFLICT ({', '.join(key)}) needs a unique key")
        new = self.aligned(t, rows, given).withColumn("_i", F.monotonically_increasing_id())
        new = self.spark.read.parquet(self.write(new, f"{t.name}_changes"))
        whole = F.struct(*t.names)
        per_key = new.dropna(subset=key).groupBy(*key).agg(F.min_by(whole, "_i").alias("first"), F.max_by(whole, "_i").alias("last"), F.count("*").alias("n"))
        met = per_key.join(self.rows(name).select(*key, "_rid", whole.alias("OLD")), key, "left")
        fresh = met.where("_rid IS NULL").select("first.*").unionByName(new.where(" OR ".join(f"`{k}` IS NULL" for k in key)).drop("_i"))
        fresh = self.spark.read.schema(t.schema).parquet(self.write(fresh, f"{t.name}_changes"))
        hit = self.spark.read.parquet(self.write(met.where("_rid IS NOT NULL OR n > 1").select(*key, "last"), f"{t.name}_keys"))
        n = self.insert(name, fresh, t.names) if not fresh.isEmpty() else 0
        if values is None:
            return n
        view = f"_rows_{uuid.uuid4().hex}"
        self.rows(name).join(hit.select(*key, F.col("last").alias("excluded")), key).createOrReplaceTempView(view)
        kinds = {c.name: spark_type(c.type).simpleString() for c in t.columns}
        if unknown := [v for v in values if v not in kinds]:
            raise NotFound(f"column {unknown[0]} of {t.name}")
        new_row = ", ".join(f"'{c}', " + (f"CAST(({values[c]}) AS {kinds[c]})" if c in values else f"`{c}`") for c in t.names)
        old_row = ", ".join(f"'{c}', `{c}`" for c in t.names)
        return n + self.change(name, self.spark.sql(f"SELECT named_struct({old_row}) AS OLD, named_struct({new_row}) AS NEW, _rid FROM {view} AS `{t.name}`"))
