"""Statements over a catalog of tables: queries are lazy DataFrames; changes write a new version and swap a pointer.

A managed table is a list of Parquet folders under the warehouse folder; nothing that is read is ever overwritten. INSERT adds a
folder of the new rows, checked before it counts; other changes write the table anew. A
transaction keeps a copy of the catalog and puts it back on ROLLBACK. One writer at a time. A statement reads and makes views of
only the tables that it names.

An engine is strict unless told otherwise: AND, OR and BETWEEN with a NULL on either side are NULL; LIKE and GREATEST of a NULL are errors."""

from __future__ import annotations

import copy
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.compile import INTEGERS, TYPES, Compiler, quote
from ..plans.parser import SqlError, parse


class ConstraintError(ValueError):
    """A row that a constraint of its table refuses."""


@dataclass
class Table:
    source: DataFrame | Callable[[], DataFrame]  # a reader is called when a statement first names the table
    columns: list[dict] | None = None  # None: a table of files, without constraints
    foreign: list[tuple] = field(default_factory=list)
    indexes: dict[str, tuple] = field(default_factory=dict)
    comment: str | None = None
    paths: list[str] | None = None  # the folders of a managed table; replaced, never changed in place

    @property
    def frame(self) -> DataFrame:
        if not isinstance(self.source, DataFrame):
            self.source = self.source()
        return self.source

    @frame.setter
    def frame(self, frame: DataFrame) -> None:
        self.source = frame


DICTIONARY = ("CATALOG_TABLES", "CATALOG_COLUMNS", "CATALOG_INDEXES", "CATALOG_OBJECTS")


class Views:
    """table name -> (view name, {column: type}); a view is made when its table is first asked for."""

    def __init__(self, engine: Engine):
        self.engine, self.known = engine, {}

    def __contains__(self, name: str) -> bool:
        return name in self.engine.tables or name in DICTIONARY

    def __getitem__(self, name: str) -> tuple[str, dict[str, str]]:
        if name not in self.known:
            frame = self.engine.tables[name].frame if name in self.engine.tables else self.engine._dictionary(name)
            view = f"t_{self.engine.own}_{name}"
            frame.createOrReplaceTempView(view)
            self.known[name] = (view, dict(frame.dtypes))
        return self.known[name]


class Engine:
    def __init__(self, spark: SparkSession, warehouse: str | None = None, strict: bool = True):
        self.spark, self.strict = spark, strict
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir") or ("/tmp/checkpoints/lumenquarry" if spark.sparkContext.master.startswith("local") else None)
        self.warehouse = warehouse or (shared and shared.rstrip("/") + "/tables")
        self.tables: dict[str, Table] = {}
        self.functions: dict[str, tuple] = {}
        self.saved: tuple | None = None
        self.own = uuid.uuid4().hex[:8]

    # tables and queries
    def register(self, name: str, frame: DataFrame) -> Engine:
        """A DataFrame as a table; one with a single VARIANT column _doc is schemaless: its names are fields."""
        self.tables[name] = Table(frame)
        return self

    def folder(self, path: str, *names: str) -> Engine:
        for name in names:
            self.tables[name] = Table(lambda name=name: self.spark.read.parquet(f"{path}/{name}.parquet"))
        return self

    def compiler(self) -> Compiler:
        return Compiler(self.spark, Views(self), self.functions, self.strict)

    def explain(self, text: str, params: tuple = ()) -> str:
        """The Spark SQL of a query."""
        (kind, q), *rest = parse(text, params)
        if kind != "query" or rest:
            raise SqlError("one query is needed")
        return self.compiler().query(self._documents(q))

    def query(self, text: str, params: tuple = ()) -> DataFrame:
        return self.spark.sql(self.explain(text, params))

    def sql(self, text: str, params: tuple = ()) -> list:
        """Every statement in turn: a DataFrame for a query, a number of rows for a change, else a name."""
        return [self.run(s) for s in parse(text, params)]

    def run(self, s: tuple):
        if s[0] == "query":
            return self.spark.sql(self.compiler().query(self._documents(s[1])))
        return getattr(self, f"_{s[0]}")(*s[1:])

    def _documents(self, q):
        """Names on schemaless tables become fields of _doc."""
        if isinstance(q, dict) and q.get("from") and q["from"][0] == "table" and not q["joins"]:
            t = self.tables.get(q["from"][1])
            if t is not None and t.frame.dtypes == [("_doc", "variant")]:
                return {k: _fields(v) if k in ("select", "where", "group", "having", "order") else v for k, v in q.items()}
        return q

    def _dictionary(self, name: str) -> DataFrame:
        make = lambda rows, schema: self.spark.createDataFrame(rows, schema)
        if name == "CATALOG_TABLES":
            return make([(n, t.comment) for n, t in sorted(self.tables.items())], "TABLE_NAME string, COMMENT string")
        if name == "CATALOG_COLUMNS":
            rows = []
            for n, t in sorted(self.tables.items()):
                for i, (c, _) in enumerate(t.frame.dtypes, 1):
                    d = next((x for x in t.columns or [] if x["name"] == c), {})
                    rows.append((n, c, i, d.get("null", True), "PRIMARY KEY" if d.get("primary") else "UNIQUE" if d.get("unique") else None, str(d["default"]) if d.get("default") else None, d.get("comment")))
            return make(rows, "TABLE_NAME string, COLUMN_NAME string, COLUMN_ID long, NULLABLE boolean, KEY string, DEFAULT string, COMMENT string")
        if name == "CATALOG_INDEXES":
            rows = [(n, i, o, e, False) for n, t in sorted(self.tables.items()) for i, (e, o) in t.indexes.items()]
            rows += [(n, "PRIMARY", "BOTH", c["name"], True) for n, t in sorted(self.tables.items()) for c in t.columns or [] if c["primary"]]
            return make(rows, "TABLE_NAME string, INDEX_NAME string, ORDER string, EXPRESSION string, UNIQUENESS boolean")
        rows = [(n, "TABLE") for n in sorted(self.tables)] + [(i, "INDEX") for t in self.tables.values() for i in t.indexes]
        return make(rows, "OBJECT_NAME string, OBJECT_TYPE string")

    # changes
    def _table(self, name: str) -> Table:
        if name not in self.tables:
            raise SqlError(f"table not found: {name}")
        return self.tables[name]

    def _write(self, name: str, frame: DataFrame) -> str:
        if not self.warehouse:
            raise ValueError("managed tables need a warehouse folder, or spark.checkpoint.dir, that the driver and all executors share")
        path = f"{self.warehouse}/{self.own}/{name}/v={uuid.uuid4().hex}"
        frame.write.parquet(path)
        return path

    def _hold(self, name: str, schema, paths: list[str]) -> None:
        t = self.tables[name]
        t.paths, t.frame = paths, self.spark.read.schema(schema).parquet(*paths)

    def _store(self, name: str, frame: DataFrame) -> None:
        self._hold(name, frame.schema, [self._write(name, frame)])

    def _checked(self, name: str, frame: DataFrame, old: DataFrame | None = None) -> tuple[str, DataFrame]:
        """The folder and rows of a written frame that all constraints of its table allow; the folder of one that they don't is deleted."""
        path = self._write(name, frame)
        new = self.spark.read.schema(frame.schema).parquet(path)
        try:
            self._check(name, new, old)
        except ConstraintError:
            found = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            found.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(found, True)
            raise
        return path, new

    def _create(self, name, cols, keys, quiet, source, comment) -> str:
        if name in self.tables:
            if quiet:
                return name
            raise SqlError(f"table exists: {name}")
        cols = [c for _, c in cols]
        for c in cols:
            if c["type"] not in TYPES:
                raise SqlError(f"unknown type {c['type']}")
            if c["unique"] and c["type"] in ("FLOAT", "FLOAT32", "MAP"):
                raise SqlError(f"{c['type']} can't be UNIQUE")
        for _, own, parent, key in keys:
            if not any(c["primary"] and c["name"] == key for c in (cols if parent == name else self._table(parent).columns) or []):
                raise SqlError(f"{parent}.{key} isn't a primary key")
        if source is not None:
            frame = self.spark.sql(self.compiler().query(source))
            cols = [{"name": c, "type": t, "null": True, "default": None, "primary": False, "unique": False, "comment": None} for c, t in frame.dtypes]
        else:
            frame = self.spark.createDataFrame([], ", ".join(f"{quote(c['name'])} {TYPES[c['type']]}" for c in cols) or "_doc variant")
        self.tables[name] = Table(frame, cols, [k[1:] for k in keys], {}, comment)
        self._store(name, frame)
        return name

    def _drop(self, names, quiet, cascade) -> int:
        for n in names:
            if n not in self.tables and quiet:
                continue
            self._table(n)
            users = [m for m, t in self.tables.items() if m not in names and any(f[1] == n for f in t.foreign)]
            if users and not cascade:
                raise ConstraintError(f"{n} is referenced by {', '.join(users)}")
            for m in users:
                self.tables[m].foreign = [f for f in self.tables[m].foreign if f[1] != n]
            del self.tables[n]
        return len(names)

    def _insert(self, name, cols, q) -> int:
        t = self._table(name)
        new = self.spark.sql(self.compiler().query(q))
        fields = t.frame.schema.fields
        if t.frame.dtypes == [("_doc", "variant")]:
            new = new.select(F.parse_json(F.col(new.columns[0])).alias("_doc"))
        else:
            names = cols or [f.name for f in fields]
            if len(names) != len(new.columns):
                raise SqlError("columns and values differ in number")
            new, comp = new.toDF(*names), self.compiler()
            missing = {c["name"]: c["default"] for c in t.columns or [] if c["name"] not in names}
            given = dict(new.dtypes)
            typed = lambda f: F.parse_json(F.col(quote(f.name))) if f.dataType.typeName() == "variant" and given[f.name] == "string" else F.col(quote(f.name)).cast(f.dataType)  # noqa: E731  text for a MAP or LIST is JSON
            new = new.select(*(typed(f).alias(f.name) if f.name in names else F.expr(comp.expr(missing[f.name]) if missing.get(f.name) else "NULL").cast(f.dataType).alias(f.name) for f in fields))
        path, new = self._checked(name, new, t.frame)
        if t.paths:
            self._hold(name, t.frame.schema, [*t.paths, path])
        else:
            self._store(name, t.frame.unionAll(new))
        return new.count()

    def _check(self, name: str, new: DataFrame, old: DataFrame | None) -> None:
        """Constraints of the rows of new beside those of old, which keep them already."""
        t = self.tables[name]
        whole = new if old is None else old.unionAll(new)
        for c in t.columns or []:
            col = F.col(quote(c["name"]))
            if not c["null"] and not new.where(col.isNull()).isEmpty():
                raise ConstraintError(f"{name}.{c['name']} can't be null")
            if not (c["primary"] or c["unique"]):
                continue
            keys = new.where(col.isNotNull()).select(col.alias("key"))
            if not keys.groupBy("key").count().where("count > 1").isEmpty() or (old is not None and not keys.join(old.select(col.alias("key")), "key", "left_semi").isEmpty()):
                raise ConstraintError(f"{name}.{c['name']} has to be unique")
        for own, parent, key in t.foreign:
            keys = self._table(parent).frame.select(F.col(quote(key)).alias(own)) if parent != name else whole.select(F.col(quote(key)).alias(own))
            if not new.where(F.col(quote(own)).isNotNull()).join(keys, own, "left_anti").isEmpty():
                raise ConstraintError(f"{name}.{own} has no {parent}.{key}")

    def _update(self, name, sets, where) -> int:
        t, comp = self._table(name), self.compiler()
        known = dict(t.frame.dtypes)
        for c, _ in sets:
            if c not in known:
                raise SqlError(f"no column {c} in {name}")
            if any(x["name"] == c and x["primary"] for x in t.columns or []):
                raise ConstraintError(f"{name}.{c} is the primary key")
        comp.kinds.append(known)
        cond = f"coalesce({comp.expr(where)}, false)" if where else "true"
        typed = lambda c, e: f"parse_json({comp.expr(e)})" if known[c] == "variant" and comp.type_of(e) != "variant" else f"cast({comp.expr(e)} AS {known[c]})"
        new = {c: f"CASE WHEN {cond} THEN {typed(c, e)} ELSE {quote(c)} END" for c, e in sets}
        view, _ = comp.catalog[name]
        out = self.spark.sql(f"SELECT {', '.join(f'{new[c]} AS {quote(c)}' if c in new else quote(c) for c in known)} FROM {quote(view)} AS {quote(name)}")
        n = self.spark.sql(f"SELECT count(*) FROM {quote(view)} AS {quote(name)} WHERE {cond}").first()[0]
        path, _ = self._checked(name, out)
        self._hold(name, out.schema, [path])
        return n

    def _delete(self, name, where) -> int:
        t, comp = self._table(name), self.compiler()
        comp.kinds.append(dict(t.frame.dtypes))
        view, _ = comp.catalog[name]
        cond = f"coalesce({comp.expr(where)}, false)" if where else "true"
        gone = self.spark.sql(f"SELECT * FROM {quote(view)} AS {quote(name)} WHERE {cond}")
        n = gone.count()
        kept = self.spark.sql(f"SELECT * FROM {quote(view)} AS {quote(name)} WHERE NOT {cond}")
        for m, other in self.tables.items():
            for own, parent, key in other.foreign:
                if parent != name:
                    continue
                users = (kept if m == name else other.frame).select(F.col(quote(own)).alias("own"))
                if not users.join(gone.select(F.col(quote(key)).alias("own")), "own", "left_semi").isEmpty():
                    raise ConstraintError(f"rows of {name} are referenced by {m}.{own}")
        self._store(name, kept)
        return n

    def _alter(self, name, change) -> str:
        t = self._table(name)
        if change[0] == "move":
            self.tables[change[1]] = self.tables.pop(name)
        elif change[0] == "add":
            c = change[1]
            if c["name"] in t.frame.columns or (not c["null"] and c["default"] is None):
                raise SqlError(f"can't add {c['name']}")
            value = self.compiler().expr(c["default"]) if c["default"] else "NULL"
            self._store(name, t.frame.withColumn(c["name"], F.expr(f"cast({value} AS {TYPES[c['type']]})")))
            t.columns = [*(t.columns or []), c]
        else:
            old = change[1] if change[0] == "rename" else change[2]
            if old not in t.frame.columns:
                if change[0] == "drop" and change[1]:
                    return name
                raise SqlError(f"no column {old} in {name}")
            if any(f[0] == old for f in t.foreign):
                raise ConstraintError(f"{name}.{old} is a foreign key")
            if change[0] == "rename":
                self._store(name, t.frame.withColumnRenamed(old, change[2]))
                t.columns = [c | {"name": change[2]} if c["name"] == old else c for c in t.columns or []]
            else:
                self._store(name, t.frame.drop(old))
                t.columns = [c for c in t.columns or [] if c["name"] != old]
                t.indexes = {i: x for i, x in t.indexes.items() if old not in x[0]}
        return name

    def _index(self, table, index, e, order) -> str:
        if index.upper() == "PRIMARY":
            raise SqlError("PRIMARY is a reserved name")
        comp = self.compiler()
        comp.kinds.append(dict(self._table(table).frame.dtypes))
        self._table(table).indexes[index] = (comp.expr(e), order)
        return index

    def _drop_index(self, table, index) -> str:
        if self._table(table).indexes.pop(index, None) is None:
            raise SqlError(f"index not found: {index}")
        return index

    def _function(self, name, args, body, again) -> str:
        names = [n for n, _, _ in args]
        if len(set(names)) < len(names) or any(d is None and args[i - 1][2] is not None for i, (_, _, d) in enumerate(args) if i):
            raise SqlError("arguments need distinct names, those with defaults last")
        if name.upper() in self.functions and not again:
            raise SqlError(f"function exists: {name}")
        self.functions[name.upper()] = (args, body)
        return name

    def _drop_function(self, names, quiet) -> int:
        for n in names:
            if self.functions.pop(n.upper(), None) is None and not quiet:
                raise SqlError(f"function not found: {n}")
        return len(names)

    def _begin(self) -> str:
        if self.saved:
            raise SqlError("a transaction is open")
        self.saved = ({n: _as_it_is(t) for n, t in self.tables.items()}, dict(self.functions))
        return "begin"

    def _commit(self) -> str:
        self.saved = None
        return "commit"

    def _rollback(self) -> str:
        if self.saved:
            self.tables, self.functions = self.saved
        self.saved = None
        return "rollback"

    def _show(self, what, table):
        if what == "TABLES":
            return sorted(self.tables)
        if what == "COLUMNS":
            return self._table(table).frame.dtypes
        if what == "INDEXES":
            return sorted(self._table(table).indexes)
        if what == "FUNCTIONS":
            return sorted(f"{n}({', '.join(f'{a}: {t}' for a, t, _ in args)})" for n, (args, _) in self.functions.items())
        if what == "VERSION":
            return "1"
        raise SqlError(f"SHOW {what}")


def _as_it_is(table: Table) -> Table:
    """A copy that later changes of the table's indexes don't reach."""
    out = copy.copy(table)
    out.indexes = dict(table.indexes)
    return out


def _fields(e):
    if isinstance(e, tuple) and e[:1] == ("col",):
        return ("cast_doc", e[1][-1])
    if isinstance(e, tuple):
        return tuple(_fields(x) for x in e)
    return [_fields(x) for x in e] if isinstance(e, list) else e


__all__ = ["INTEGERS", "ConstraintError", "Engine", "SqlError", "Table"]
