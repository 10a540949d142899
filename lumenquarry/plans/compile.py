"""Plan tuples to one Spark SQL text: Catalyst sees the whole query and does joins, pushdown, pruning and decorrelation."""

from __future__ import annotations

import datetime
import decimal

from pyspark.errors import AnalysisException

from ..functions import scalar
from .parser import AGGREGATES, SqlError

#: Type names of the dialect and Spark's; INT has 64 bits and FLOAT is double.
TYPES = {
    "BOOLEAN": "boolean", "INT8": "tinyint", "INT16": "smallint", "INT32": "int", "INT": "bigint", "INTEGER": "bigint", "INT64": "bigint", "INT128": "decimal(38,0)",
    "UINT8": "smallint", "UINT16": "int", "UINT32": "bigint", "UINT64": "decimal(20,0)", "UINT128": "decimal(38,0)", "FLOAT32": "float", "FLOAT": "double", "FLOAT64": "double", "DECIMAL": "decimal(38,18)",
    "TEXT": "string", "BYTEA": "binary", "INET": "string", "DATE": "date", "TIMESTAMP": "timestamp_ntz", "TIME": "string", "UUID": "string", "INTERVAL": "interval day to second", "MAP": "variant", "LIST": "variant", "POINT": "struct<x:double,y:double>",
}
UNSIGNED = {"UINT8": 2**8 - 1, "UINT16": 2**16 - 1, "UINT32": 2**32 - 1, "UINT64": 2**64 - 1, "UINT128": 10**38 - 1}
INTEGERS = ("tinyint", "smallint", "int", "bigint")
BITS = {"tinyint": 8, "smallint": 16, "int": 32}
#: Functions whose first argument can be a LIST or a MAP: these are read as arrays and maps of text.
OF_LISTS = ("APPEND", "PREPEND", "SKIP", "TAKE", "SLICE", "SORT", "DEDUP", "SPLICE")
OF_MAPS = ("ENTRIES", "KEYS", "VALUES")


def quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def text_literal(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n") + "'"


class Compiler:
    """catalog: table name -> (view name, {column: type}); functions: name -> (args, body); strict: NULL makes AND, OR and BETWEEN NULL, LIKE and GREATEST errors."""

    def __init__(self, spark, catalog, functions, strict: bool = True):
        self.spark, self.catalog, self.functions, self.strict = spark, catalog, functions, strict
        self.kinds: list[dict[str, str]] = []  # column types of the sources in scope, innermost last
        self.grouped: list[list[tuple] | None] = []

    # queries
    def query(self, q: dict) -> str:
        if "values" in q:
            rows = ", ".join("(" + ", ".join(map(self.expr, r)) + ")" for r in q["values"])
            cols = ", ".join(f"column{i + 1}" for i in range(len(q["values"][0])))
            return f"SELECT * FROM (VALUES {rows}) AS v({cols})" + self._tail(q)
        scope: dict[str, str] = {}
        self.kinds.append(scope)
        froms = "FROM " + self._source(q["from"], scope) if q["from"] else "FROM (SELECT 1L AS N)"
        for kind, source, on in q["joins"]:
            name = self._source(source, scope)
            cond = " ON " + ("CAST(NULL AS BOOLEAN)" if on == ("null",) else self.condition(on)) if on else " ON true" if kind == "LEFT" else ""
            froms += f" {'CROSS' if not cond else kind} JOIN {name}{cond}"
        where = f" WHERE {self.condition(q['where'])}" if q["where"] else ""
        items = q["select"]
        if q["distinct"] and not q["joins"] and "variant" in scope.values():
            items = [x for e, label in items for x in ([(("col", [c]), c) for c in scope] if e[0] == "star" else [(e, label)])]
        grouping = bool(q["group"]) or q["having"] is not None or any(has_aggregate(e) for e, _ in items)
        labels = {label: e for e, label in items if label}
        group = [items[int(g[1]) - 1][0] if g[0] == "num" and g[1].isdigit() else labels.get(g[1][0], g) if g[0] == "col" and len(g[1]) == 1 and g[1][0] not in scope and not has_aggregate(labels.get(g[1][0], g)) else g for g in q["group"]]
        by = f" GROUP BY {', '.join(map(self.expr, group))}" if group else ""
        self.grouped.append(group if grouping else None)
        documents = [label for e, label in items if q["distinct"] and e[0] != "star" and self.type_of(e) == "variant"]
        cols = ", ".join(f"to_json({self.expr(e)}) AS {quote(label)}" if label in documents else self._item(e, label) for e, label in items)
        having = f" HAVING {self.condition(q['having'])}" if q["having"] else ""
        tail = self._tail(q, items)
        self.grouped.pop()
        self.kinds.pop()
        out = f"SELECT {'DISTINCT ' if q['distinct'] else ''}{cols} {froms}{where}{by}{having}{tail}"
        if documents:  # LIST and MAP have no equality in Spark: their JSON, with sorted keys, stands for them
            out = f"SELECT {', '.join(f'parse_json({quote(label)}) AS {quote(label)}' if label in documents else quote(label) for _, label in items)} FROM ({out})"
        return out

    def _item(self, e: tuple, label: str | None) -> str:
        if e[0] == "star":
            return f"{quote(e[1])}.*" if e[1] else "*"
        return f"{self.expr(e)} AS {quote(label)}"

    def _tail(self, q: dict, items=()) -> str:
        out = ""
        if q["order"]:
            keys = []
            for e, down in q["order"]:
                if e[0] == "un" and e[1] == "+":
                    e = e[2]
                label = next((x for x, name in items if e == ("col", [name])), None)
                key = e[1] if e[0] == "num" else quote(e[1][0]) if label is not None else self.expr(e)
                keys.append(f"{key} {'DESC NULLS FIRST' if down else 'ASC NULLS LAST'}")
            out += " ORDER BY " + ", ".join(keys)
        if q["limit"] is not None:
            out += f" LIMIT cast({self.expr(q['limit'])} AS int)"
        if q["offset"] is not None:
            out += f" OFFSET cast({self.expr(q['offset'])} AS int)"
        return out

    def _source(self, source: tuple, scope: dict) -> str:
        kind, what, alias, cols = source
        if kind == "series":
            n = self.expr(what)
            text, types, name = f"(SELECT id + 1 AS N FROM (SELECT explode(sequence(0L, greatest({n}, 1) - 1)) AS id) WHERE if({n} < 0, raise_error('SERIES needs a size of 0 or more'), id < {n}))", {"N": "bigint"}, alias or "Series"
            if what[0] == "num":
                text = f"(SELECT id AS N FROM range(1, {int(what[1]) + 1}))"
        elif kind == "derived":
            text = f"({self.query(what)})"
            try:
                types = dict(self.spark.sql(text).dtypes)
            except AnalysisException as e:
                if not (e.getCondition() or "").startswith("UNRESOLVED_COLUMN"):
                    raise
                types = {}  # correlated: its types are known only inside the outer query
            name = alias
        else:
            if what not in self.catalog:
                raise SqlError(f"table not found: {what}")
            view, types = self.catalog[what]
            text, name = quote(view), alias or what
        if cols:
            if types and len(cols) > len(types):
                raise SqlError("more column aliases than columns")
            names = [*cols, *list(types)[len(cols) :]]
            types = dict(zip(names, types.values()))
            scope |= types
            if kind == "table":
                text = f"(SELECT * FROM {text})"
            return f"{text} AS {quote(name)}({', '.join(map(quote, names))})"
        scope |= types
        return f"{text} AS {quote(name)}"

    def condition(self, e: tuple) -> str:
        """A filter: only TRUE counts, so conjuncts stay bare for pushdown and IN (query) becomes a semi join."""
        if e[0] == "bin" and e[1] == "AND":
            return f"({self.condition(e[2])} AND {self.condition(e[3])})"
        if e[0] == "in_query" and not e[3]:
            return f"{self.expr(e[1])} IN ({self.query(e[2])})"
        return self.expr(e)

    # expressions
    def type_of(self, e: tuple) -> str | None:
        if e[0] == "num":
            return "bigint" if e[1].isdigit() else "double"
        if e[0] == "value":
            return "bigint" if isinstance(e[1], int) and not isinstance(e[1], bool) else None
        if e[0] == "col":
            return next((s[e[1][-1]] for s in reversed(self.kinds) if e[1][-1] in s), None)
        if e[0] == "cast":
            return TYPES.get(e[2])
        if e[0] == "un" and e[1] in "+-~":
            return self.type_of(e[2])
        if e[0] == "bin" and e[1] in ("+", "-", "*", "/", "%", "&", "<<", ">>"):
            a, b = self.type_of(e[2]), self.type_of(e[3])
            return "bigint" if a in INTEGERS and b in INTEGERS else "double" if a and b else None
        if e[0] == "fn" and e[1] in ("COUNT", "LENGTH", "EXTRACT", "GCD", "LCM", "DIV"):
            return "bigint"
        if e[0] == "fn" and e[1] in ("SUM", "MIN", "MAX", "ABS", "MOD") and e[2]:
            return self.type_of(e[2][0])
        return None

    def expr(self, e: tuple) -> str:
        if self.grouped and self.grouped[-1] is not None and e[0] == "col" and e not in self.grouped[-1] and not any(g[0] == "col" and g[1][-1] == e[1][-1] for g in self.grouped[-1]) and any(e[1][-1] in s for s in self.kinds[-1:]):
            return f"any_value({self._col(e)})"  # a column that isn't grouped: that of one row of the group
        if self.grouped and self.grouped[-1] is not None and e in self.grouped[-1]:
            self.grouped.append(None)
            out = self._expr(e)
            self.grouped.pop()
            return out
        return self._expr(e)

    def _col(self, e: tuple) -> str:
        return ".".join(map(quote, e[1]))

    def _expr(self, e: tuple) -> str:
        return getattr(self, f"_{e[0]}_")(*e[1:])

    def _col_(self, parts):
        return ".".join(map(quote, parts))

    def _num_(self, text):
        return f"{text}L" if text.isdigit() and int(text) < 2**63 else f"{text}D" if not text.isdigit() else text

    def _str_(self, s):
        return text_literal(s)

    def _bytes_(self, s):
        return f"X'{s}'"

    def _value_(self, v):
        if v is None:
            return "NULL"
        if isinstance(v, bool):
            return str(v).lower()
        if isinstance(v, int):
            return f"{v}L"
        if isinstance(v, float):
            return f"{v!r}D"
        if isinstance(v, decimal.Decimal):
            return f"{v}BD"
        if isinstance(v, datetime.datetime):
            return f"TIMESTAMP_NTZ '{v}'"
        if isinstance(v, datetime.date):
            return f"DATE '{v}'"
        if isinstance(v, (list, tuple)):
            return f"array({', '.join(map(self._value_, v))})"
        return text_literal(str(v))

    def _true_(self):
        return "true"

    def _false_(self):
        return "false"

    def _null_(self):
        return "NULL"

    def _bin_(self, op, l, r):
        a, b = self.expr(l), self.expr(r)
        if op in ("AND", "OR") and self.strict:
            return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE {a} {op} {b} END)" if self._nullable(l) or self._nullable(r) else f"({a} {op} {b})"
        if op == "XOR":
            return f"(CASE WHEN {a} IS NULL OR {b} IS NULL THEN NULL ELSE {a} <> {b} END)"
        if op == "/" and self.type_of(l) in INTEGERS and self.type_of(r) in INTEGERS:
            if l[0] == r[0] == "num":  # two literals are exact
                return f"({a} / {b})"
            return f"({a} div {b})"
        if op in ("<<", ">>"):
            most = BITS.get(self.type_of(l), 64) - 1
            out = f"{'shiftleft' if op == '<<' else 'shiftright'}({a}, cast({b} AS int))"
            return out if r[0] == "num" and r[1].isdigit() and int(r[1]) <= most else f"if({b} < 0 OR {b} > {most}, raise_error('a shift by more bits than the number has'), {out})"
        return f"({a} {op} {b})"

    def _un_(self, op, x):
        if op == "NOT" and x[0] == "in_query":
            return self._in_query_(x[1], x[2], not x[3])
        return f"(NOT {self.expr(x)})" if op == "NOT" else f"({op}{self.expr(x)})"

    def _isnull_(self, x, no):
        return f"({self.expr(x)} IS {'NOT ' if no else ''}NULL)"

    def _in_(self, x, items, no):
        a = self.expr(x)
        known = [self.expr(i) for i in items if i != ("null",)]
        inside = f"coalesce({a} IN ({', '.join(known)}), false)" if known else "false"
        if known and not no and all(i[0] in ("num", "str", "value") for i in items):
            return f"({a} IN ({', '.join(known)}))"
        return f"(CASE WHEN {a} IS NULL THEN NULL ELSE {'NOT ' if no else ''}{inside} END)"

    def _in_query_(self, x, q, no):
        if no:  # no match by plain equality: an anti join, and nulls never match
            inner = self.query(q)
            return f"(NOT EXISTS (SELECT 1 FROM ({inner}) AS __s(__c) WHERE __s.__c = {self.expr(x)}))"
        return f"coalesce({self.expr(x)} IN ({self.query(q)}), false)"

    def _exists_(self, q):
        return f"EXISTS ({self.query(q)})"

    def _sub_(self, q):
        return f"({self.query(q)})"

    def _between_(self, x, lo, hi, no):
        a, l, h = map(self.expr, (x, lo, hi))
        inside = f"({a} BETWEEN {l} AND {h})"
        if self.strict and (self._nullable(lo) or self._nullable(hi)):  # a NULL between literals is NULL anyway
            inside = f"(CASE WHEN {a} IS NULL OR {l} IS NULL OR {h} IS NULL THEN NULL ELSE {inside} END)"
        return f"(NOT {inside})" if no else inside

    @staticmethod
    def _nullable(e: tuple) -> bool:
        """Whether an expression can be NULL, as far as its form tells."""
        return not (e[0] in ("num", "str", "true", "false", "isnull", "exists") or (e[0] == "un" and e[1] in "+-" and e[2][0] == "num"))

    def _like_(self, x, p, no, any_case):
        pattern = text_literal(p[1].replace("\\", "\\\\")) if p[0] == "str" else f"replace({self.expr(p)}, '\\\\', '\\\\\\\\')"
        a = self.expr(x)
        out = f"({a} {'NOT ' if no else ''}{'ILIKE' if any_case else 'LIKE'} {pattern})"
        if self.strict:  # coalesce reads the error only where the comparison is NULL
            return f"coalesce({out}, cast(raise_error('LIKE of a NULL') AS boolean))"
        return out

    def _case_(self, operand, whens, other):
        head = f" {self.expr(operand)}" if operand else ""
        return "(CASE" + head + "".join(f" WHEN {self.expr(c)} THEN {self.expr(v)}" for c, v in whens) + (f" ELSE {self.expr(other)}" if other else "") + " END)"

    def _cast_(self, x, kind):
        if kind not in TYPES:
            raise SqlError(f"unknown type {kind}")
        a = self.expr(x)
        if kind in UNSIGNED:
            return f"if({a} < 0 OR {a} > {UNSIGNED[kind]}, raise_error('out of range of {kind}'), cast({a} AS {TYPES[kind]}))"
        if kind in ("MAP", "LIST"):
            return f"parse_json({a})"
        if kind == "UUID":
            return f"lower({a})"
        if kind == "POINT":
            xy = f"regexp_extract_all({a}, '-?[0-9.]+', 0)"
            return f"named_struct('x', cast({xy}[0] AS double), 'y', cast({xy}[1] AS double))"
        return f"cast({a} AS {TYPES[kind]})"

    def _interval_(self, x, unit, last):
        a = self.expr(x)
        if last:
            return f"cast({a} AS interval {unit} to {last})"
        names = {"YEAR": "make_ym_interval({0}, 0)", "MONTH": "make_ym_interval(0, {0})", "DAY": "make_dt_interval({0})", "HOUR": "make_dt_interval(0, {0})", "MINUTE": "make_dt_interval(0, 0, {0})", "SECOND": "make_dt_interval(0, 0, 0, {0})"}
        if unit not in names:
            raise SqlError(f"unknown interval unit {unit}")
        return names[unit].format(f"cast({a} AS {'decimal(18,6)' if unit == 'SECOND' else 'int'})")

    def _array_(self, items):
        return f"array({', '.join(map(self.expr, items))})"

    def _index_(self, x, i):
        kind, a, k = self.type_of(x) or "", self.expr(x), self.expr(i)
        if kind == "variant":
            path = f"concat('$.', {k})" if i[0] == "str" else f"concat('$[', {k}, ']')"
            return f"try_variant_get({a}, {path}, 'string')"
        if i[0] == "str":
            return f"try_element_at({a}, {k})"
        return f"if({k} < 0, NULL, get({a}, cast({k} AS int)))"

    def _factorial_(self, x):
        a = self.expr(x)
        return f"if({a} < 0, raise_error('factorial of a negative number'), aggregate(if({a} < 1, array(1L), sequence(1L, {a})), cast(1 AS decimal(38, 0)), (p, i) -> cast(p * i AS decimal(38, 0))))"

    def _fn_(self, name, args, distinct):
        if name in AGGREGATES:
            return self._aggregate(name, args, distinct)
        if name == "EXTRACT":
            return f"cast(extract({args[0][1]} FROM {self.expr(args[1])}) AS bigint)"
        if name == "TRIM":
            return f"trim({args[0][1]} {self.expr(args[1])} FROM {self.expr(args[2])})"
        if name in ("LENGTH", "IS_EMPTY") and len(args) == 1 and self.type_of(args[0]) == "variant":
            a = self.expr(args[0])
            size = f"cast(coalesce(size(try_variant_get({a}, '$', 'array<variant>')), size(try_variant_get({a}, '$', 'map<string,variant>'))) AS bigint)"
            return size if name == "LENGTH" else f"({size} = 0)"
        if name == "LENGTH" and len(args) == 1:
            kind = self.type_of(args[0]) or ""
            a = self.expr(args[0])
            return f"cast({'size' if kind.startswith(('array', 'map')) or args[0][0] in ('array',) or (args[0][0] == 'fn' and args[0][1] in ('SPLIT', 'TAKE', 'SKIP', 'SLICE', 'APPEND', 'PREPEND', 'DEDUP', 'SPLICE', 'SORT', 'KEYS', 'VALUES', 'ENTRIES', 'MAP_OF_JSON')) else 'char_length'}({a}) AS bigint)"
        if name in ("FORMAT", "TO_DATE", "TO_TIMESTAMP", "TO_TIME") and len(args) == 2 and args[1][0] == "str":
            args = [args[0], ("str", scalar.java_pattern(args[1][1]))]
        if name in self.functions:
            return self._custom(name, args)
        done = [self.expr(a) for a in args]
        if args and self.type_of(args[0]) == "variant" and name in (*OF_LISTS, *OF_MAPS):
            done[0] = f"try_variant_get({done[0]}, '$', '{'array<string>' if name in OF_LISTS else 'map<string,string>'}')"
            if name in ("APPEND", "PREPEND"):
                done[1] = f"cast({done[1]} AS string)"
        if name in scalar.ANY:
            if not done or (name == "GREATEST" and len(done) < 2):
                raise SqlError(f"{name} needs more arguments")
            out = scalar.ANY[name].format(", ".join(done))
            if name == "GREATEST" and self.strict:
                return f"if({' OR '.join(f'{a} IS NULL' for a in done)}, raise_error('GREATEST of a NULL'), {out})"
            return out
        if (name, len(args)) not in scalar.TEMPLATES:
            raise SqlError(f"no function {name} of {len(args)} arguments")
        if name == "DIV" and all(self.type_of(a) in INTEGERS for a in args):
            return f"({done[0]} div {done[1]})"
        template = scalar.TEMPLATES[name, len(args)]
        for i, a in enumerate(done):
            template = template.replace("{%d}" % i, a)
        return template

    def _custom(self, name, args):
        """The body with its arguments in place, cast to their types: Catalyst sees a plain expression."""
        formal, body = self.functions[name]
        if len(args) > len(formal) or any(d is None for _, _, d in formal[len(args) :]):
            raise SqlError(f"wrong number of arguments of {name}")
        given = {n: ("cast", args[i] if i < len(args) else d, t) for i, (n, t, d) in enumerate(formal)}
        return self.expr(substitute(body, given))

    def _aggregate(self, name, args, distinct):
        self.grouped.append(None)
        word = "DISTINCT " if distinct else ""
        star = args and args[0][0] == "star"
        a = "*" if star else self.expr(args[0])
        self.grouped.pop()
        if name == "COUNT":
            return f"count({word}{'struct(*)' if star and distinct else a})"
        if star or len(args) != 1:
            raise SqlError(f"{name} needs one argument")
        return {"SUM": f"sum({word}{a})", "MIN": f"min({a})", "MAX": f"max({a})", "AVG": f"avg({word}cast({a} AS double))", "VARIANCE": f"var_pop({word}{a})", "STDEV": f"stddev_pop({word}{a})"}[name]

    def _cast_doc_(self, name):
        """A field of a schemaless row."""
        return f"try_variant_get(_doc, {text_literal('$.' + name)}, 'string')"

    def _star_(self, _):
        raise SqlError("* stands alone")


def has_aggregate(e) -> bool:
    if isinstance(e, tuple) and e[:1] == ("fn",) and e[1] in AGGREGATES:
        return True
    if isinstance(e, tuple) and e and e[0] in ("sub", "exists", "in_query"):
        return e[0] == "in_query" and has_aggregate(e[1])
    return isinstance(e, (tuple, list)) and any(has_aggregate(x) for x in e)


def substitute(e, given: dict):
    if isinstance(e, tuple) and e[:1] == ("col",) and len(e[1]) == 1 and e[1][0] in given:
        return given[e[1][0]]
    if isinstance(e, tuple):
        return tuple(substitute(x, given) for x in e)
    return [substitute(x, given) for x in e] if isinstance(e, list) else e
