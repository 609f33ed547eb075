"""Syntax trees to DataFrames. A variable is a column of terms (kind, value, datatype, language); null is unbound."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.operators.identity import document_of
from quadrel.operators.quads import QUAD, XSD, graph_scan
from quadrel.sources.layout import written
from quadrel.sparql.parser import AGGREGATES, Call, Group, Query, Term

TERM = "struct<k:string,v:string,d:string,l:string>"
NUMERIC = [XSD + t for t in ("integer", "decimal", "double", "float", "int", "long")]


@dataclass
class Rows:
    """Solutions, and for each variable whether every row binds it."""

    df: DataFrame
    sure: dict[str, bool]


def constant(t: Term) -> Column:
    dt = None if t.kind != "literal" or t.lang else t.dt or XSD + "string"
    return F.struct(F.lit(t.kind).alias("k"), F.lit(t.value).alias("v"), F.lit(dt).cast("string").alias("d"), F.lit(t.lang).cast("string").alias("l"))


def literal(value: Column, dt: Column | str, on: Column | None = None) -> Column:
    d = F.lit(dt) if isinstance(dt, str) else dt
    made = F.struct(F.lit("literal").alias("k"), value.cast("string").alias("v"), d.cast("string").alias("d"), F.lit(None).cast("string").alias("l"))
    return F.when(value.isNotNull() if on is None else on, made)


def number(t: Column) -> Column:
    return F.when(t["d"].isin(NUMERIC), t["v"].try_cast("double"))


def plain(x: Column) -> Column:
    """A number's text; whole ones without a fraction."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))


class Compiler:
    def __init__(self, spark: SparkSession, quads: DataFrame, unique: bool = False) -> None:
        """unique: no statement stands in two graphs, nor twice in one, so patterns need no distinct()."""
        if quads is None:
            raise ValueError("SPARQL needs a database of quads")
        self.spark, self.quads, self.unique, self.n = spark, quads, unique, 0

    # ---- patterns

    def bgp(self, triples: list[tuple[Term, Term, Term]], graph: Term | None, graphs: list[str]) -> Rows:
        return reduce(self.join, (self.path(*t, graph, graphs) for t in triples))

    def path(self, s: Term, p: Any, o: Term, graph: Term | None, graphs: list[str]) -> Rows:
        """Solutions of s p o, where p may be a path."""
        if isinstance(p, Term):
            return self.triple((s, p, o), graph, graphs)
        match p.name:
            case "^":
                return self.path(o, p.args[0], s, graph, graphs)
            case "/":
                middle = Term("var", f"_path{self._next()}")
                rows = self.join(self.path(s, p.args[0], middle, graph, graphs), self.path(middle, p.args[1], o, graph, graphs))
                return Rows(rows.df.drop(middle.value), {v: k for v, k in rows.sure.items() if v != middle.value})
            case "|":
                a, b = (self.path(s, x, o, graph, graphs) for x in p.args)
                if a.sure.keys() != b.sure.keys():  # neither end is a variable
                    a, b = (Rows(r.df.select(F.lit(None).cast(TERM).alias("_one0")), {"_one0": False}) for r in (a, b))
                return Rows(a.df.unionByName(b.df), a.sure)
        return self._closure(s, p, o, graph, graphs)

    def _closure(self, s: Term, p: Call, o: Term, graph: Term | None, graphs: list[str]) -> Rows:
        """p+, p* and p?: pairs of nodes, each once. Steps begin at the end that is known; each is written out."""
        x, y = Term("var", f"_from{self._next()}"), Term("var", f"_to{self._next()}")
        edges = self.path(x, p.args[0], y, graph, graphs).df.select(F.col(x.value).alias("a"), F.col(y.value).alias("b")).distinct()
        back = s.kind == "var" and o.kind != "var"
        if back:  # from the object on
            edges = edges.select(F.col("b").alias("a"), F.col("a").alias("b"))
        start = constant(o if back else s) if not (s.kind == "var" and o.kind == "var") else None
        found = edges if start is None else edges.filter(F.col("a") == start)
        if p.name != "?":
            edges = written(edges, "edges")
            found = front = written(found if start is None else edges.filter(F.col("a") == start), "reached")
            while not front.isEmpty():
                step = front.select("a", F.col("b").alias("m")).join(edges.select(F.col("a").alias("m"), "b"), "m").select("a", "b").distinct()
                front = written(step.join(found, ["a", "b"], "left_anti"), "reached")
                found = found.unionByName(front)
        if p.name != "+":
            if start is None:
                scan = graph_scan(self.quads, graphs or None)
                none = F.lit(None).cast("string")
                subject = F.struct(F.when(F.startswith("s", F.lit("_:")), "blank").otherwise("iri").alias("k"), F.col("s").alias("v"), none.alias("d"), none.alias("l")).cast(TERM)
                obj = F.struct(F.col("o_kind").alias("k"), F.col("o").alias("v"), F.when(F.col("o_lang").isNull(), F.col("o_dt")).alias("d"), F.col("o_lang").alias("l")).cast(TERM)
                nodes = scan.select(F.explode(F.array(subject, obj)).alias("a")).distinct()
                same = nodes.select("a", F.col("a").alias("b"))
            else:
                same = self.spark.range(1).select(start.cast(TERM).alias("a"), start.cast(TERM).alias("b"))
            found = found.unionByName(same).distinct()
        if back:
            found = found.select(F.col("b").alias("a"), F.col("a").alias("b"))
        for c, term in (("a", s), ("b", o)):
            if term.kind != "var":
                found = found.filter(F.col(c) == constant(term))
        if s.kind == o.kind == "var" and s.value == o.value:
            found = found.filter(F.col("a") == F.col("b"))
        names = {t.value: c for c, t in (("a", s), ("b", o)) if t.kind == "var"}
        if not names:
            names, found = {f"_one{self._next()}": "a"}, found.withColumn("a", F.lit(None).cast(TERM))
        return Rows(found.select(*(F.col(c).alias(v) for v, c in names.items())), {v: not v.startswith("_one") for v in names})

    def triple(self, t: tuple[Term, Term, Term], graph: Term | None, graphs: list[str]) -> Rows:
        df = graph_scan(self.quads, graphs or None)
        null = F.lit(None).cast("string")
        node = lambda c: F.struct(F.when(F.startswith(c, F.lit("_:")), "blank").otherwise("iri").alias("k"), F.col(c).alias("v"), null.alias("d"), null.alias("l")).cast(TERM)
        obj = F.struct(F.col("o_kind").alias("k"), F.col("o").alias("v"), F.when(F.col("o_lang").isNull(), F.col("o_dt")).alias("d"), F.col("o_lang").alias("l")).cast(TERM)
        places, tests, made = [("s", t[0], node("s")), ("p", t[1], node("p")), ("o", t[2], obj)], [], {}
        if graph is not None:
            places.append(("g", graph, node("g")))
            tests.append(F.col("g").isNotNull())
        for c, term, value in places:
            if term.kind == "var":
                if term.value in made:
                    tests.append(made[term.value] == value)
                else:
                    made[term.value] = value
                continue
            tests.append(F.col(c) == term.value)
            if c == "o":
                tests.append(F.col("o_kind") == term.kind)
                if term.kind == "literal":
                    tests.append(F.col("o_lang").eqNullSafe(F.lit(term.lang).cast("string")))
                    if not term.lang:
                        tests.append(F.coalesce("o_dt", F.lit(XSD + "string")) == (term.dt or XSD + "string"))
        df = reduce(lambda d, c: d.filter(c), tests, df)
        made = {k: v for k, v in made.items()} or {f"_one{self._next()}": F.lit(None).cast(TERM)}
        out = df.select(*(v.alias(k) for k, v in made.items()))
        # graphs repeat statements; the default graph is their union
        return Rows(out if graph is not None or self.unique else out.distinct(), {k: not k.startswith("_one") for k in made})

    def _next(self) -> int:
        self.n += 1
        return self.n

    def _apart(self, b: Rows, shared: list[str]) -> tuple[DataFrame, dict[str, str]]:
        names = {v: f"_r{self._next()}_{v}" for v in shared}
        return b.df.select(*(F.col(f"`{c}`").alias(names.get(c, c)) for c in b.df.columns)), names

    def _compatible(self, a: Rows, b: Rows, names: dict[str, str], free: bool = True) -> Column:
        """free: a variable that b leaves unbound fits anything. a binds all shared ones here."""
        tests = []
        for v, r in names.items():
            same = F.col(f"`{v}`") == F.col(f"`{r}`")
            if free and not b.sure[v]:
                same = same | F.col(f"`{r}`").isNull()
            tests.append(same)
        return reduce(lambda x, y: x & y, tests) if tests else F.lit(True)

    def _merged(self, df: DataFrame, a: Rows, b: Rows, names: dict[str, str]) -> DataFrame:
        out = [(F.coalesce(F.col(f"`{v}`"), F.col(f"`{names[v]}`")) if v in names and not a.sure[v] else F.col(f"`{v}`")).alias(v) for v in a.sure]
        return df.select(*out, *(F.col(f"`{v}`") for v in b.sure if v not in names))

    def _halves(self, a: Rows, v: str) -> tuple[Rows, Rows]:
        """The rows that bind v, and the others without v: joins on it are then equalities, which Spark can hash and sort by."""
        bound, free = a.df.filter(F.col(f"`{v}`").isNotNull()), a.df.filter(F.col(f"`{v}`").isNull()).drop(v)
        return Rows(bound, {**a.sure, v: True}), Rows(free, {k: s for k, s in a.sure.items() if k != v})

    @staticmethod
    def _both(a: Rows, b: Rows, sure: dict[str, bool]) -> Rows:
        names = list(sure)
        return Rows(a.df.unionByName(b.df, allowMissingColumns=True).select(*(F.col(f"`{n}`") for n in names)), sure)

    def _loose(self, a: Rows, b: Rows) -> str | None:
        """A shared variable that some rows of a leave unbound."""
        return next((v for v in a.sure if v in b.sure and not a.sure[v]), None)

    def join(self, a: Rows, b: Rows) -> Rows:
        shared = [v for v in a.sure if v in b.sure]
        if (v := self._loose(a, b)) is not None:
            bound, free = (self.join(half, b) for half in self._halves(a, v))
            return self._both(bound, free, {**b.sure, **{n: a.sure[n] or b.sure.get(n, False) for n in a.sure}})
        if self._loose(b, a) is not None:
            return self.join(b, a)
        right, names = self._apart(b, shared)
        df = a.df.join(right, self._compatible(a, b, names)) if shared else a.df.crossJoin(right)
        return Rows(self._merged(df, a, b, names), {**b.sure, **{v: a.sure[v] or b.sure.get(v, False) for v in a.sure}})

    def optional(self, a: Rows, b: Rows, filters: list[Any]) -> Rows:
        if (v := self._loose(a, b)) is not None:
            bound, free = (self.optional(half, b, filters) for half in self._halves(a, v))
            return self._both(bound, free, {**{n: False for n in b.sure}, **a.sure})
        shared = [v for v in a.sure if v in b.sure]
        right, names = self._apart(b, shared)
        on = self._compatible(a, b, names)
        see = {**{v: F.col(f"`{v}`") for v in b.sure if v not in names}, **{v: F.coalesce(F.col(f"`{v}`"), F.col(f"`{names[v]}`")) if v in names else F.col(f"`{v}`") for v in a.sure}}
        for e in filters:
            on = on & F.coalesce(self.truth(e, see), F.lit(False))
        return Rows(self._merged(a.df.join(right, on, "left"), a, b, names), {**{v: False for v in b.sure}, **a.sure})

    def semi(self, a: Rows, b: Rows, keep: bool) -> Rows:
        if (v := self._loose(a, b)) is not None:
            return self._both(*(self.semi(half, b, keep) for half in self._halves(a, v)), a.sure)
        shared = [v for v in a.sure if v in b.sure]
        right, names = self._apart(b, shared)
        return Rows(a.df.join(right.select(*names.values()) if names else right, self._compatible(a, b, names), "left_semi" if keep else "left_anti"), a.sure)

    def minus(self, a: Rows, b: Rows) -> Rows:
        if (v := self._loose(a, b)) is not None:
            return self._both(*(self.minus(half, b) for half in self._halves(a, v)), a.sure)
        shared = [v for v in a.sure if v in b.sure]
        if not shared:
            return a
        right, names = self._apart(b, shared)
        meet = reduce(lambda x, y: x | y, (F.col(f"`{v}`").isNotNull() & F.col(f"`{r}`").isNotNull() for v, r in names.items()))
        on = self._compatible(a, b, names)
        if not any(a.sure[v] and b.sure[v] for v in shared):
            on = on & meet
        return Rows(a.df.join(right.select(*names.values()), on, "left_anti"), a.sure)

    def group(self, g: Group, graph: Term | None, graphs: list[str]) -> tuple[Rows | None, list[Any]]:
        """Solutions without the group's own filters, and those filters."""
        rows: Rows | None = None
        filters: list[Any] = []
        add = lambda b: b if rows is None else self.join(rows, b)
        unit = lambda: rows or Rows(self.spark.range(1).select(F.lit(None).cast(TERM).alias(f"_one{self._next()}")), {f"_one{self.n}": False})
        for part in g.parts:
            match part[0]:
                case "triples":
                    rows = add(self.bgp(part[1], graph, graphs))
                case "graph":
                    rows = add(self.solve(part[2], part[1], graphs))
                case "union":
                    sides = [self.solve(s, graph, graphs) for s in part[1]]
                    df = reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), (s.df for s in sides))
                    rows = add(Rows(df, {v: all(s.sure.get(v, False) for s in sides) for v in df.columns}))
                case "optional":
                    inner, own = self.group(part[1], graph, graphs)
                    exists = [e for e in own if _exists(e)]
                    inner = self._filtered(inner, exists, graph, graphs)
                    rows = self.optional(unit(), inner, [e for e in own if not _exists(e)])
                case "minus":
                    rows = self.minus(unit(), self.solve(part[1], graph, graphs))
                case "select":
                    rows = add(self.select(part[1], graph, graphs))
                case "values":
                    rows = add(self._values(part[1], part[2]))
                case "bind":
                    rows = unit()
                    see = {v: F.col(f"`{v}`") for v in rows.sure}
                    rows = Rows(rows.df.withColumn(part[1], self.term(part[2], see)), {**rows.sure, part[1]: False})
                case "filter":
                    filters.append(part[1])
        return (rows if rows is not None else unit()), filters

    def solve(self, g: Group, graph: Term | None = None, graphs: list[str] | None = None) -> Rows:
        rows, filters = self.group(g, graph, graphs or [])
        return self._filtered(rows, filters, graph, graphs or [])

    def _filtered(self, rows: Rows, filters: list[Any], graph: Term | None, graphs: list[str]) -> Rows:
        for e in filters:
            for part in _conjuncts(e):
                if (found := _exists(part)) is not None:
                    rows = self.semi(rows, self.solve(found[0], graph, graphs), found[1])
                else:
                    rows = Rows(rows.df.filter(self.truth(part, {v: F.col(f"`{v}`") for v in rows.sure})), rows.sure)
        return rows

    def _values(self, names: list[str], rows: list[tuple]) -> Rows:
        data = [tuple(None if t is None else (t.kind, t.value, None if t.kind != "literal" or t.lang else t.dt or XSD + "string", t.lang) for t in row) for row in rows]
        df = self.spark.createDataFrame(data, ", ".join(f"`{n}` {TERM}" for n in names))
        return Rows(df, {n: all(r[k] is not None for r in rows) for k, n in enumerate(names)})

    # ---- expressions

    def truth(self, e: Any, see: dict[str, Column]) -> Column:
        """The effective boolean value; null on an error."""
        if isinstance(e, Call):
            match e.name:
                case "&&":
                    return self.truth(e.args[0], see) & self.truth(e.args[1], see)
                case "||":
                    return self.truth(e.args[0], see) | self.truth(e.args[1], see)
                case "!":
                    return ~self.truth(e.args[0], see)
                case "=" | "!=" | "<" | ">" | "<=" | ">=":
                    return self._compare(e.name, self.term(e.args[0], see), self.term(e.args[1], see))
                case "IN" | "NOT IN":
                    a = self.term(e.args[0], see)
                    found = reduce(lambda x, y: x | y, (self._compare("=", a, self.term(b, see)) for b in e.args[1:]), F.lit(False))
                    return found if e.name == "IN" else ~found
                case "BOUND":
                    return see[e.args[0].value].isNotNull() if e.args[0].value in see else F.lit(False)
                case "REGEX":
                    flags = e.args[2].value if len(e.args) > 2 else ""
                    return self.term(e.args[0], see)["v"].rlike((f"(?{flags})" if flags else "") + e.args[1].value)
                case "CONTAINS" | "STRSTARTS" | "STRENDS":
                    f = {"CONTAINS": F.contains, "STRSTARTS": F.startswith, "STRENDS": F.endswith}[e.name]
                    return f(*(self.term(x, see)["v"] for x in e.args))
                case "ISIRI" | "ISURI" | "ISLITERAL" | "ISBLANK":
                    return self.term(e.args[0], see)["k"] == {"ISIRI": "iri", "ISURI": "iri", "ISLITERAL": "literal", "ISBLANK": "blank"}[e.name]
                case "ISNUMERIC":
                    return number(self.term(e.args[0], see)).isNotNull()
                case "SAMETERM":
                    return self.term(e.args[0], see) == self.term(e.args[1], see)
                case "EXISTS":
                    raise ValueError("SPARQL: EXISTS may stand alone, under && and under !")
        t = self.term(e, see)
        return F.when(t["d"] == XSD + "boolean", t["v"] == "true").when(number(t).isNotNull(), number(t) != 0).when(t["k"] == "literal", F.char_length(t["v"]) > 0)

    def _compare(self, op: str, a: Column, b: Column) -> Column:
        x, y = number(a), number(b)
        both = x.isNotNull() & y.isNotNull()
        do: Callable[[Column, Column], Column] = {"=": lambda p, q: p == q, "!=": lambda p, q: p != q, "<": lambda p, q: p < q, ">": lambda p, q: p > q, "<=": lambda p, q: p <= q, ">=": lambda p, q: p >= q}[op]
        if op in ("=", "!="):
            return F.when(both, do(x, y)).otherwise(do(a, b))
        alike = (a["k"] == b["k"]) & a["d"].eqNullSafe(b["d"]) & x.isNull() & y.isNull()
        return F.when(both, do(x, y)).when(alike, do(a["v"], b["v"]))

    def term(self, e: Any, see: dict[str, Column]) -> Column:
        if isinstance(e, Term):
            return see.get(e.value, F.lit(None).cast(TERM)) if e.kind == "var" else constant(e)
        args = [self.term(x, see) for x in e.args] if e.name not in ("BOUND", "EXISTS") else []
        text = lambda k=0: args[k]["v"]
        string = lambda c: literal(c, XSD + "string")
        match e.name:
            case "+" | "-" | "*" | "/":
                x, y = number(args[0]), number(args[1])
                value = {"+": x + y, "-": x - y, "*": x * y, "/": F.try_divide(x, y)}[e.name]
                whole = (args[0]["d"] == XSD + "integer") & (args[1]["d"] == XSD + "integer") & F.lit(e.name != "/")
                return literal(plain(value), F.when(whole, XSD + "integer").otherwise(XSD + "decimal"))
            case "STR":
                return string(text())
            case "LANG":
                return string(F.coalesce(args[0]["l"], F.lit("")))
            case "DATATYPE":
                return F.when(args[0]["d"].isNotNull(), F.struct(F.lit("iri").alias("k"), args[0]["d"].alias("v"), F.lit(None).cast("string").alias("d"), F.lit(None).cast("string").alias("l")))
            case "IRI" | "URI":
                return F.struct(F.lit("iri").alias("k"), text().alias("v"), F.lit(None).cast("string").alias("d"), F.lit(None).cast("string").alias("l"))
            case "UCASE":
                return string(F.upper(text()))
            case "LCASE":
                return string(F.lower(text()))
            case "STRLEN":
                return literal(F.char_length(text()), XSD + "integer")
            case "SUBSTR":
                start = text(1).cast("int")
                return string(F.substring(text(), start, text(2).cast("int") if len(args) > 2 else F.lit(1 << 30)))
            case "CONCAT":
                return string(F.concat(*(a["v"] for a in args)))
            case "REPLACE":
                return string(F.regexp_replace(text(), text(1), text(2)))
            case "STRBEFORE":
                return string(F.when(F.contains(text(), text(1)), F.substring_index(text(), e.args[1].value, 1)).otherwise(""))
            case "STRAFTER":
                n = F.instr(text(), text(1))
                return string(F.when(n > 0, F.substring(text(), n + F.char_length(text(1)), F.lit(1 << 30))).otherwise(""))
            case "ABS" | "CEIL" | "FLOOR" | "ROUND":
                f = {"ABS": F.abs, "CEIL": F.ceil, "FLOOR": F.floor, "ROUND": lambda c: F.floor(c + 0.5)}[e.name]
                return literal(plain(f(number(args[0])).cast("double")), args[0]["d"])
            case "YEAR" | "MONTH" | "DAY" | "HOURS" | "MINUTES":
                f = {"YEAR": F.year, "MONTH": F.month, "DAY": F.dayofmonth, "HOURS": F.hour, "MINUTES": F.minute}[e.name]
                return literal(f(text().try_cast("timestamp")), XSD + "integer")
            case "COALESCE":
                return F.coalesce(*args)
            case "IF":
                return F.when(self.truth(e.args[0], see), args[1]).otherwise(args[2])
        return literal(self.truth(e, see), XSD + "boolean")

    # ---- solution modifiers

    def _aggregate(self, c: Call, see: dict[str, Column]) -> Column:
        if not c.args:
            if c.distinct:
                return literal(F.count_distinct(F.struct(*see.values())), XSD + "integer")
            return literal(F.count("*"), XSD + "integer")
        t = self.term(c.args[0], see)
        if c.name == "COUNT":
            return literal(F.count_distinct(t) if c.distinct else F.count(t), XSD + "integer")
        x = number(t)
        whole = F.coalesce(F.bool_and(t["d"] == XSD + "integer"), F.lit(True))
        if c.name == "SUM":
            total = F.coalesce(F.sum_distinct(x) if c.distinct else F.sum(x), F.lit(0.0))
            return literal(F.when(whole, total.cast("bigint").cast("string")).otherwise(total.cast("string")), F.when(whole, XSD + "integer").otherwise(XSD + "decimal"))
        if c.name == "AVG":
            mean = F.sum_distinct(x) / F.count_distinct(x) if c.distinct else F.avg(x)
            return literal(mean, XSD + "decimal")
        # numbers by value, before other terms, which go by text
        pick = {"MIN": F.min, "MAX": F.max}[c.name]
        return pick(F.when(t.isNotNull(), F.struct(x.alias("n"), t["v"].alias("t"), t.alias("term"))))["term"]

    def select(self, q: Query, graph: Term | None = None, graphs: list[str] | None = None) -> Rows:
        rows = self.solve(q.where, graph, q.graphs or graphs or [])
        see = {v: F.col(f"`{v}`") for v in rows.sure}
        items = q.items if q.items is not None else [(v, Term("var", v)) for v in rows.sure if not v.startswith("_")]
        df, sure = rows.df, dict(rows.sure)
        order, having = list(q.order_by), list(q.having)
        if q.group_by or any(_has_aggregate(e) for _, e in items) or having:
            found: dict[str, Call] = {}

            def lift(e: Any) -> Any:
                if isinstance(e, Call) and e.name in AGGREGATES:
                    name = f"_agg{self._next()}"
                    found[name] = e
                    return Term("var", name)
                return Call(e.name, tuple(map(lift, e.args)), e.distinct) if isinstance(e, Call) else e

            keys = {n for n, _ in q.group_by}
            for n, e in items:
                if isinstance(e, Term) and e.kind == "var" and e.value not in keys:
                    raise ValueError(f"SPARQL: ?{e.value} is neither grouped nor an aggregate")
            items, having, order = [(n, lift(e)) for n, e in items], [lift(e) for e in having], [(lift(e), down) for e, down in order]
            grouped = df.groupBy(*(self.term(e, see).alias(n) for n, e in q.group_by))
            marks = [self._aggregate(c, see).alias(n) for n, c in found.items()]
            df = grouped.agg(*marks) if marks else grouped.agg(F.count("*").alias("_none")).drop("_none")
            sure = {**{n: sure.get(n, False) for n, _ in q.group_by}, **dict.fromkeys(found, False)}
            see = {v: F.col(f"`{v}`") for v in sure}
            for e in having:
                df = df.filter(self.truth(e, see))
        for n, e in items:
            if not (isinstance(e, Term) and e.kind == "var" and e.value == n):
                df = df.withColumn(n, self.term(e, see))
                sure[n] = sure.get(e.value, False) if isinstance(e, Term) and e.kind == "var" else False
                see[n] = F.col(f"`{n}`")
            elif n not in see:
                df, sure[n] = df.withColumn(n, F.lit(None).cast(TERM)), False
        names = [n for n, _ in items]
        if q.distinct:
            df = df.select(*(F.col(f"`{n}`") for n in names)).distinct()
        if order:
            by = []
            for e, down in order:
                t = self.term(e, {v: F.col(f"`{v}`") for v in df.columns})
                by += [c.desc_nulls_first() if down else c.asc_nulls_last() for c in (number(t), t["v"])]
            df = df.orderBy(*by)
        if q.offset:
            df = df.offset(q.offset)
        if q.limit is not None:
            df = df.limit(q.limit)
        return Rows(df.select(*(F.col(f"`{n}`") for n in names)), {n: sure.get(n, False) for n in names})

    def select_rows(self, q: Query) -> DataFrame:
        """Each variable as text."""
        rows = self.select(q)
        return rows.df.select(*(F.col(f"`{c}`")["v"].alias(c) for c in rows.df.columns))

    def ask(self, q: Query) -> DataFrame:
        return self.solve(q.where, None, q.graphs).df.limit(1).agg((F.count("*") > 0).alias("result"))

    # ---- updates

    def _made(self, templates: list[tuple], rows: Rows | None) -> DataFrame:
        """Quads of the templates for each solution; what stays unbound gives none."""
        if not templates:
            return self.spark.createDataFrame([], QUAD)
        see = {v: F.col(f"`{v}`") for v in rows.sure} if rows else {}
        made = []
        for g, s, p, o in templates:
            subject, obj = self.term(s, see), self.term(o, see)
            graph = self.term(g, see)["v"] if g is not None else document_of(subject["v"])
            made.append(F.struct(graph.alias("g"), subject["v"].alias("s"), self.term(p, see)["v"].alias("p"), obj["k"].alias("o_kind"), obj["v"].alias("o"), obj["d"].alias("o_dt"), obj["l"].alias("o_lang"), F.lit(g is not None).alias("named")))
        df = (rows.df if rows else self.spark.range(1)).select(F.explode(F.array(*made)).alias("q")).select("q.*")
        return df.filter("s is not null and p is not null and o is not null").distinct()

    def construct(self, q: Query) -> DataFrame:
        """Statements of the template for each solution, each once."""
        rows = self.solve(q.where, None, q.graphs)
        df = self._made(q.insert, rows).select("s", "p", "o_kind", "o", F.when(F.col("o_kind") == "literal", F.col("o_dt")).alias("o_dt"), "o_lang").distinct()
        df = df.offset(q.offset) if q.offset else df
        return df.limit(q.limit) if q.limit is not None else df

    def describe(self, q: Query) -> DataFrame:
        """All statements whose subject is one of the resources."""
        rows = self.solve(q.where, None, q.graphs) if q.where is not None else None
        see = {v: F.col(f"`{v}`") for v in rows.sure} if rows else {}
        named = F.explode(F.array(*(self.term(e, see)["v"] for _, e in q.items))).alias("s")
        subjects = (rows.df if rows else self.spark.range(1)).select(named).distinct()
        found = graph_scan(self.quads, q.graphs or None).join(subjects, "s", "left_semi")
        return found.select("s", "p", "o_kind", "o", "o_dt", "o_lang").distinct()

    def _manage(self, word: str, source: str, target: str | None) -> DataFrame:
        """CLEAR, DROP, CREATE, COPY, MOVE and ADD. DEFAULT is what stands in no named graph. Returns inserted and deleted."""
        quads, g = self.quads, F.col("g")
        of = lambda name: g.isNull() if name == "DEFAULT" else g.isNotNull() if name == "NAMED" else F.lit(True) if name == "ALL" else g.eqNullSafe(F.lit(name))
        none = quads.limit(0)
        if word in ("CLEAR", "DROP"):
            gone, new, left = quads.filter(of(source)), none, quads.filter(~of(source))
        elif word == "CREATE" or source == target:
            gone, new, left = none, none, quads
        else:
            moved = quads.filter(of(source)).withColumn("g", F.lit(None if target == "DEFAULT" else target).cast("string")).distinct()
            dropped = F.lit(False) if word == "ADD" else of(target) | of(source) if word == "MOVE" else of(target)
            gone, left = quads.filter(dropped), quads.filter(~dropped)
            keys = [c for c in quads.columns if c != "g"]
            have = left.filter(of(target)).select(*(F.col(c).alias(f"h_{c}") for c in keys))
            new = moved.join(have, reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"h_{c}")) for c in keys)), "left_anti").select(*quads.columns)
        self.quads, self.unique = written(left.unionByName(new), "quads"), self.unique and word in ("CLEAR", "DROP", "CREATE", "MOVE")
        return new.agg(F.count("*").alias("inserted")).crossJoin(gone.agg(F.count("*").alias("deleted")))

    def update(self, q: Query) -> tuple[DataFrame, DataFrame]:
        counts = []
        for step in [q, *q.then]:
            if step.manage is not None:
                counts.append(self._manage(*step.manage))
                continue
            self.unique = self.unique and not step.insert
            rows = self.solve(step.where, None, step.graphs) if step.where is not None else None
            gone, new = self._made(step.delete, rows), self._made(step.insert, rows)
            quads, left = self.quads, self.quads
            same = lambda a, b: reduce(lambda x, y: x & y, (a[c].eqNullSafe(b[c]) for c in ("s", "p", "o_kind", "o", "o_lang")))
            if step.delete:
                d = gone.select(*(F.col(c).alias(c) for c in ("g", "s", "p", "o_kind", "o", "o_lang", "named"))).alias("d")
                on = same(quads, d) & (~d["named"] | quads["g"].eqNullSafe(d["g"]))
                left = quads.join(d, on, "left_anti")
            if step.insert:
                n = new.select("g", "s", "p", "o_kind", "o", F.when(F.col("o_kind") == "literal", F.col("o_dt")).alias("o_dt"), "o_lang")
                have = left.alias("h")
                n = n.join(have, same(n, have) & n["g"].eqNullSafe(have["g"]), "left_anti")
                after = left.unionByName(n)
            else:
                n, after = None, left
            lost = quads.join(d, on, "left_semi") if step.delete else quads.limit(0)
            removed = lost.agg(F.count("*").alias("deleted"))
            added = n.agg(F.count("*").alias("inserted")) if n is not None else self.spark.range(1).select(F.lit(0).cast("long").alias("inserted"))
            counts.append(added.crossJoin(removed))
            self.quads = written(after.select(*quads.columns), "quads")  # later steps read the store several times each
        total = reduce(lambda a, b: a.unionByName(b), counts)
        return self.quads, total.agg(F.sum("inserted").alias("inserted"), F.sum("deleted").alias("deleted"))


def _conjuncts(e: Any) -> list[Any]:
    return [p for a in e.args for p in _conjuncts(a)] if isinstance(e, Call) and e.name == "&&" else [e]


def _exists(e: Any) -> tuple[Group, bool] | None:
    if isinstance(e, Call) and e.name == "EXISTS":
        return e.args[0], True
    if isinstance(e, Call) and e.name == "!" and (found := _exists(e.args[0])):
        return found[0], not found[1]
    return None


def _has_aggregate(e: Any) -> bool:
    return isinstance(e, Call) and (e.name in AGGREGATES or any(map(_has_aggregate, e.args)))
