"""SPARQL text to a syntax tree."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from quadrel.operators.quads import RDF_TYPE, XSD

_TOKENS = re.compile(
    r'''(?P<space>\s+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<var>[?$]\w+)|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)'''
    r'''|(?P<number>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?)|(?P<blank>_:\w+)|(?P<name>(?:[A-Za-z][\w-]*)?:[\w.-]*[\w-]|(?:[A-Za-z][\w-]*)?:)|(?P<word>[A-Za-z_]\w*)'''
    r'''|(?P<mark>\^\^|&&|\|\||!=|<=|>=|[{}().;,=<>!+*/|^?-])''',
)
UPDATES = ("INSERT", "DELETE", "WITH", "CLEAR", "DROP", "CREATE", "COPY", "MOVE", "ADD", "LOAD")
AGGREGATES = ("COUNT", "SUM", "AVG", "MIN", "MAX")


@dataclass(frozen=True)
class Term:
    """kind: var, iri, literal or blank."""

    kind: str
    value: str
    dt: str | None = None
    lang: str | None = None


@dataclass(frozen=True)
class Call:
    """An expression: operator or function name, and arguments (Terms, Calls, Groups)."""

    name: str
    args: tuple
    distinct: bool = False


@dataclass
class Group:
    """A group graph pattern: elements in order."""

    parts: list[tuple] = field(default_factory=list)


@dataclass
class Query:
    form: str
    items: list[tuple[str, Any]] | None = None  # (name, expression); None: every variable
    where: Group | None = None
    distinct: bool = False
    group_by: list[tuple[str, Any]] = field(default_factory=list)
    having: list[Any] = field(default_factory=list)
    order_by: list[tuple[Any, bool]] = field(default_factory=list)
    limit: int | None = None
    offset: int | None = None
    graphs: list[str] = field(default_factory=list)
    delete: list[tuple] = field(default_factory=list)
    insert: list[tuple] = field(default_factory=list)
    then: list[Query] = field(default_factory=list)
    manage: tuple | None = None  # (word, from, to) of updates of whole graphs; a graph is an IRI, DEFAULT, NAMED or ALL


class _Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.prefixes, at, self.at, self.fresh = [], {"xsd": XSD, "rdf": RDF_TYPE.removesuffix("type")}, 0, 0, 0
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise ValueError(f"SPARQL: cannot read {text[at : at + 30]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        k = self.at + ahead
        return self.tokens[k] if k < len(self.tokens) else ("end", "")

    def is_(self, *words: str) -> bool:
        return self.peek()[0] in ("word", "mark") and self.peek()[1].upper() in words

    def take(self, *words: str) -> str:
        if words and not self.is_(*words):
            raise ValueError(f"SPARQL: {' or '.join(words)} expected, not {self.peek()[1]!r}")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def maybe(self, *words: str) -> str | None:
        return self.take().upper() if self.is_(*words) else None

    # -- whole queries

    def query(self) -> Query:
        self.prologue()
        word = self.peek()[1].upper()
        if word == "SELECT":
            q = self.select()
        elif word == "ASK":
            self.take()
            q = Query("ask")
            self.dataset(q)
            self.maybe("WHERE")
            q.where = self.group()
        elif word in UPDATES:
            q = self.update()
            while self.maybe(";"):
                self.prologue()
                if self.peek()[0] == "end":
                    break
                q.then.append(self.update())
        elif word == "CONSTRUCT":
            q = self.construct()
        elif word == "DESCRIBE":
            q = self.describe()
        else:
            raise ValueError(f"SPARQL: no query begins with {word!r}")
        if self.peek()[0] != "end":
            raise ValueError(f"SPARQL: {self.peek()[1]!r} after the end")
        return q

    def prologue(self) -> None:
        while self.is_("PREFIX", "BASE"):
            if self.take().upper() == "PREFIX":
                name = self.take()
                self.prefixes[name[:-1]] = self.take()[1:-1]
            else:
                self.take()

    def dataset(self, q: Query) -> None:
        while self.maybe("FROM"):
            self.maybe("NAMED")
            q.graphs.append(self.term().value)

    def select(self) -> Query:
        self.take("SELECT")
        q = Query("select", distinct=bool(self.maybe("DISTINCT", "REDUCED")))
        if not self.maybe("*"):
            q.items = []
            while self.peek()[0] == "var" or self.is_("("):
                if self.peek()[0] == "var":
                    name = self.take()[1:]
                    q.items.append((name, Term("var", name)))
                else:
                    self.take("(")
                    e = self.expression()
                    self.take("AS")
                    q.items.append((self.take()[1:], e))
                    self.take(")")
        self.dataset(q)
        self.maybe("WHERE")
        q.where = self.group()
        if self.maybe("GROUP"):
            self.take("BY")
            while self.peek()[0] == "var" or self.is_("("):
                if self.peek()[0] == "var":
                    name = self.take()[1:]
                    q.group_by.append((name, Term("var", name)))
                else:
                    self.take("(")
                    e = self.expression()
                    self.fresh += 1
                    q.group_by.append((self.take()[1:] if self.maybe("AS") else f"_key{self.fresh}", e))
                    self.take(")")
        if self.maybe("HAVING"):
            while self.is_("("):
                q.having.append(self.primary())
        if self.maybe("ORDER"):
            self.take("BY")
            while self.peek()[0] == "var" or self.is_("ASC", "DESC", "("):
                down = self.maybe("ASC", "DESC") == "DESC"
                q.order_by.append((self.primary(), down))
        while word := self.maybe("LIMIT", "OFFSET"):
            setattr(q, word.lower(), int(self.take()))
        return q

    def construct(self) -> Query:
        self.take("CONSTRUCT")
        q, start = Query("construct"), self.at
        if short := self.is_("WHERE"):
            start = self.at + 1
            self.take()
        q.insert = self.quads(None)
        if short:  # the pattern is the template
            self.at = start
        self.dataset(q)
        self.maybe("WHERE")
        q.where = self.group()
        while word := self.maybe("LIMIT", "OFFSET"):
            setattr(q, word.lower(), int(self.take()))
        return q

    def describe(self) -> Query:
        self.take("DESCRIBE")
        q = Query("describe", items=[])
        while self.peek()[0] in ("var", "iri", "name"):
            q.items.append(("", self.term()))
        self.dataset(q)
        self.maybe("WHERE")
        if self.is_("{"):
            q.where = self.group()
        return q

    def _graph(self) -> str:
        if word := self.maybe("DEFAULT", "NAMED", "ALL"):
            return word
        self.maybe("GRAPH")
        return self.term().value

    def update(self) -> Query:
        graph = None
        if word := self.maybe("CLEAR", "DROP", "CREATE", "COPY", "MOVE", "ADD"):
            self.maybe("SILENT")
            q = Query("update", manage=(word, self._graph(), None))
            if word in ("COPY", "MOVE", "ADD"):
                self.take("TO")
                q.manage = (word, q.manage[1], self._graph())
            return q
        if self.is_("LOAD"):
            raise ValueError("SPARQL: LOAD is not supported; read the file with quadrel.sources.rdf and add its quads")
        if self.maybe("WITH"):
            graph = self.term()
        q = Query("update")
        word = self.take("INSERT", "DELETE").upper()
        if self.maybe("DATA"):
            setattr(q, word.lower(), self.quads(graph))
            return q
        if word == "DELETE" and self.maybe("WHERE"):
            start = self.at
            q.delete = self.quads(graph)
            self.at = start
            q.where = self.group()
            return self._inside(q, graph)
        setattr(q, word.lower(), self.quads(graph))
        if word == "DELETE" and self.maybe("INSERT"):
            q.insert = self.quads(graph)
        while self.maybe("USING"):
            q.graphs.append(self.term().value)
        self.take("WHERE")
        q.where = self.group()
        return self._inside(q, graph)

    @staticmethod
    def _inside(q: Query, graph: Term | None) -> Query:
        if graph is not None:
            q.where = Group([("graph", graph, q.where)])
        return q

    def quads(self, graph: Term | None) -> list[tuple]:
        """(graph or None, s, p, o) templates."""
        self.take("{")
        found = []
        while not self.is_("}"):
            if self.maybe("GRAPH"):
                inner = self.term()
                self.take("{")
                found += [(inner, *t) for t in self.triples()]
                self.maybe(".")
                self.take("}")
            else:
                found += [(graph, *t) for t in self.triples()]
            self.maybe(".")
        self.take("}")
        return found

    # -- patterns

    def group(self) -> Group:
        self.take("{")
        g = Group()
        if self.is_("SELECT"):
            g.parts.append(("select", self.select()))
        while not self.is_("}"):
            if self.maybe("OPTIONAL"):
                g.parts.append(("optional", self.group()))
            elif self.maybe("MINUS"):
                g.parts.append(("minus", self.group()))
            elif self.maybe("GRAPH"):
                name = self.term()
                g.parts.append(("graph", name, self.group()))
            elif self.maybe("FILTER"):
                g.parts.append(("filter", self.primary()))
            elif self.maybe("BIND"):
                self.take("(")
                e = self.expression()
                self.take("AS")
                g.parts.append(("bind", self.take()[1:], e))
                self.take(")")
            elif self.maybe("VALUES"):
                g.parts.append(self.values())
            elif self.is_("{"):
                sides = [self.group()]
                while self.maybe("UNION"):
                    sides.append(self.group())
                g.parts.append(("union", sides))
            else:
                g.parts.append(("triples", self.triples()))
            self.maybe(".")
        self.take("}")
        return g

    def values(self) -> tuple:
        if self.peek()[0] == "var":
            names, many = [self.take()[1:]], False
        else:
            names, many = [], True
            self.take("(")
            while not self.maybe(")"):
                names.append(self.take()[1:])
        self.take("{")
        rows = []
        one = lambda: None if self.maybe("UNDEF") else self.term()
        while not self.maybe("}"):
            if many:
                self.take("(")
                row = []
                while not self.maybe(")"):
                    row.append(one())
                rows.append(tuple(row))
            else:
                rows.append((one(),))
        return "values", names, rows

    def triples(self) -> list[tuple[Term, Term, Term]]:
        found = []
        while True:
            s = self.term()
            while True:
                p = self.path()
                found.append((s, p, self.term()))
                while self.maybe(","):
                    found.append((s, p, self.term()))
                if not self.maybe(";") or self.is_(".", "}"):
                    break
            if not (self.is_(".") and self.peek(1)[0] in ("var", "iri", "name", "blank", "string", "number")):
                return found
            self.take(".")

    # a path is a Term, or a Call named / | ^ + * or ?

    def path(self) -> Any:
        return self._left(lambda: self._left(self._step, ("/",)), ("|",))

    def _step(self) -> Any:
        if self.maybe("^"):
            return Call("^", (self._step(),))
        if self.maybe("("):
            p = self.path()
            self.take(")")
        else:
            p = Term("iri", RDF_TYPE) if self.peek() == ("word", "a") and self.take() else self.term()
        if self.is_("*", "?") or self.is_("+") and self.peek(1)[0] != "number":
            p = Call(self.take(), (p,))
        return p

    def term(self) -> Term:
        kind, text = self.peek()
        self.at += 1
        if kind == "var":
            return Term("var", text[1:])
        if kind == "iri":
            return Term("iri", text[1:-1])
        if kind == "blank":
            return Term("var", "_blank_" + text[2:])
        if kind == "name":
            head, _, tail = text.partition(":")
            if head not in self.prefixes:
                raise ValueError(f"SPARQL: no prefix {head!r}")
            return Term("iri", self.prefixes[head] + tail)
        if kind == "number" or text in ("-", "+"):
            text += self.take() if kind == "mark" else ""
            return Term("literal", text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"))
        if kind == "string":
            value = re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), text[1:-1])
            if self.peek()[0] == "lang":
                return Term("literal", value, None, self.take()[1:])
            if self.peek()[1] == "^^":
                self.take()
                return Term("literal", value, self.term().value)
            return Term("literal", value, XSD + "string")
        if text.lower() in ("true", "false"):
            return Term("literal", text.lower(), XSD + "boolean")
        raise ValueError(f"SPARQL: a term expected, not {text!r}")

    # -- expressions

    def expression(self) -> Any:
        return self._left(self._and, ("||",))

    def _and(self) -> Any:
        return self._left(self._relation, ("&&",))

    def _relation(self) -> Any:
        a = self._sum()
        if self.is_("=", "!=", "<", ">", "<=", ">="):
            return Call(self.take(), (a, self._sum()))
        negated = self.is_("NOT") and self.peek(1)[1].upper() == "IN" and bool(self.take())
        if self.maybe("IN"):
            return Call("NOT IN" if negated else "IN", (a, *self._list()))
        return a

    def _sum(self) -> Any:
        return self._left(lambda: self._left(self._unary, ("*", "/")), ("+", "-"))

    def _left(self, part: Any, signs: tuple[str, ...]) -> Any:
        a = part()
        while self.is_(*signs):
            a = Call(self.take(), (a, part()))
        return a

    def _unary(self) -> Any:
        if self.maybe("!"):
            return Call("!", (self._unary(),))
        if self.maybe("-"):
            return Call("-", (Term("literal", "0", XSD + "integer"), self._unary()))
        return self.primary()

    def _list(self) -> list[Any]:
        self.take("(")
        found = []
        while not self.maybe(")"):
            found.append(self.expression())
            self.maybe(",")
        return found

    def primary(self) -> Any:
        if self.maybe("("):
            e = self.expression()
            self.take(")")
            return e
        if self.is_("EXISTS"):
            self.take()
            return Call("EXISTS", (self.group(),))
        if self.is_("NOT"):
            self.take()
            self.take("EXISTS")
            return Call("!", (Call("EXISTS", (self.group(),)),))
        kind, text = self.peek()
        if kind == "word" and text.lower() not in ("true", "false"):
            name = self.take().upper()
            if name in AGGREGATES:
                self.take("(")
                distinct = bool(self.maybe("DISTINCT"))
                arg = () if self.maybe("*") else (self.expression(),)
                self.take(")")
                return Call(name, arg, distinct)
            return Call(name, tuple(self._list()))
        return self.term()


def parse(text: str) -> Query:
    return _Parser(text).query()
