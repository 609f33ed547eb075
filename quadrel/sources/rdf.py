"""RDF text to quads: N-Triples line by line in the JVM, Turtle and JSON-LD a document at a time."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from typing import Any, NamedTuple

import pandas as pd
from pyspark.sql import Column as SparkColumn
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrel.operators.quads import QUAD, RDF_TYPE, XSD

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"


class Quad(NamedTuple):
    g: str | None
    s: str
    p: str
    o_kind: str
    o: str
    o_dt: str | None = None
    o_lang: str | None = None


# ---- N-Triples and N-Quads ------------------------------------------------------------------

_TERM = r"(?:<([^>]*)>|(_:\S+))"
_LINE = rf'^\s*{_TERM}\s+<([^>]*)>\s+(?:<([^>]*)>|(_:[^\s.]+)|"((?:[^"\\]|\\.)*)"(?:\^\^<([^>]*)>|@([A-Za-z0-9-]+))?)\s*(?:{_TERM})?\s*\.\s*(?:#.*)?$'


def _unescape(text: SparkColumn) -> SparkColumn:
    mark = "\u0001"
    out = F.replace(text, F.lit("\\\\"), F.lit(mark))
    for code, char in (("\\n", "\n"), ("\\t", "\t"), ("\\r", "\r"), ('\\"', '"')):
        out = F.replace(out, F.lit(code), F.lit(char))
    return F.replace(out, F.lit(mark), F.lit("\\"))


def read_ntriples(spark: SparkSession, path: str, graph: str | None = None) -> DataFrame:
    """Quads of N-Triples or N-Quads files; lines that are neither are left out (see broken_lines)."""
    lines = spark.read.text(path)
    part = lambda k: F.nullif(F.regexp_extract("value", _LINE, k), F.lit(""))
    literal = F.regexp_extract("value", _LINE, 6)
    is_literal = part(4).isNull() & part(5).isNull()
    return lines.filter(F.col("value").rlike(_LINE)).select(
        F.coalesce(part(9), part(10), F.lit(graph).cast("string")).alias("g"), F.coalesce(part(1), part(2)).alias("s"), part(3).alias("p"),
        F.when(part(4).isNotNull(), "iri").when(part(5).isNotNull(), "blank").otherwise("literal").alias("o_kind"),
        F.coalesce(part(4), part(5), _unescape(literal)).alias("o"),
        F.when(is_literal, F.coalesce(part(7), F.when(part(8).isNull(), F.lit(XSD + "string")))).alias("o_dt"), part(8).alias("o_lang"),
    )


def broken_lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines that are neither statements, comments nor empty."""
    return spark.read.text(path).filter(~F.col("value").rlike(_LINE) & ~F.col("value").rlike(r"^\s*(#.*)?$"))


def write_ntriples(quads: DataFrame, path: str) -> None:
    text = F.col("o")
    for char, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(char), F.lit(code))
    node = lambda c: F.when(F.startswith(c, F.lit("_:")), c).otherwise(F.concat(F.lit("<"), c, F.lit(">")))
    end = F.when(F.col("o_lang").isNotNull(), F.concat(F.lit("@"), "o_lang")).when(F.coalesce("o_dt", F.lit(XSD + "string")) != XSD + "string", F.concat(F.lit("^^<"), "o_dt", F.lit(">"))).otherwise("")
    obj = F.when(F.col("o_kind") == "literal", F.concat(F.lit('"'), text, F.lit('"'), end)).otherwise(node(F.col("o")))
    quads.select(F.concat_ws(" ", node(F.col("s")), F.concat(F.lit("<"), "p", F.lit(">")), obj, F.lit(".")).alias("value")).write.text(path)


# ---- Turtle ---------------------------------------------------------------------------------

_TOKENS = re.compile(
    r'''(?P<space>[\s]+|\#[^\n]*)|(?P<iri><[^<>"{}|^`\\\s]*>)|(?P<long>"""(?:[^"\\]|\\.|"(?!""))*"""|\'\'\'(?:[^'\\]|\\.|'(?!''))*\'\'\')'''
    r'''|(?P<string>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')|(?P<directive>@prefix|@base)|(?P<lang>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<dt>\^\^)'''
    r'''|(?P<number>[+-]?(?:\d+\.\d*[eE][+-]?\d+|\.?\d+[eE][+-]?\d+|\d*\.\d+|\d+))|(?P<blank>_:[\w](?:[\w.-]*[\w-])?)|(?P<name>[^\W\d_]?(?:[\w-]|\.(?=[\w-]))*:(?:[\w:%-]|\.(?=[\w:%-])|\\.)*)|(?P<word>[A-Za-z]+)|(?P<mark>[.;,\[\]()])''',
    re.S,
)
_ESCAPES = {"t": "\t", "n": "\n", "r": "\r", "b": "\b", "f": "\f", '"': '"', "'": "'", "\\": "\\"}


def _plain(text: str) -> str:
    return re.sub(r"\\(?:u([0-9A-Fa-f]{4})|U([0-9A-Fa-f]{8})|(.))", lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else _ESCAPES.get(m[3], m[3]), text, flags=re.S)


class _Turtle:
    def __init__(self, text: str, graph: str | None, base: str) -> None:
        self.graph, self.base, self.prefixes, self.out, self.blanks = graph, base, {}, [], 0
        self.tokens, at = [], 0
        while at < len(text):
            m = _TOKENS.match(text, at)
            if not m:
                raise ValueError(f"Turtle: cannot read {text[at : at + 30]!r}")
            if m.lastgroup != "space":
                self.tokens.append((m.lastgroup, m[0]))
            at = m.end()
        self.at = 0

    def peek(self) -> tuple[str, str]:
        return self.tokens[self.at] if self.at < len(self.tokens) else ("end", "")

    def take(self, value: str | None = None) -> tuple[str, str]:
        token = self.peek()
        if token[0] == "end" or value is not None and token[1] != value:
            raise ValueError(f"Turtle: {value or 'a term'} expected, not {token[1]!r}")
        self.at += 1
        return token

    def blank(self) -> str:
        self.blanks += 1
        return f"_:b{self.blanks}"

    def resolve(self, iri: str) -> str:
        from urllib.parse import urljoin

        return urljoin(self.base, iri) if self.base and not re.match(r"^[A-Za-z][A-Za-z0-9+.-]*:", iri) else iri

    def parse(self) -> list[Quad]:
        while self.peek()[0] != "end":
            kind, text = self.peek()
            if kind == "directive" or text.upper() in ("PREFIX", "BASE"):
                self.take()
                if text.lstrip("@").lower() == "prefix":
                    name = self.take()[1]
                    self.prefixes[name[:-1]] = self.resolve(self.take()[1][1:-1])
                else:
                    self.base = self.resolve(self.take()[1][1:-1])
                if kind == "directive":
                    self.take(".")
                continue
            lone = text == "["
            s = self.term()[1]
            if not (lone and self.peek()[1] == "."):
                self.predicates(s)
            self.take(".")
        return self.out

    def predicates(self, s: str) -> None:
        while True:
            p = RDF_TYPE if self.peek() == ("word", "a") else None
            p = (self.take(), p)[1] if p else self.term()[1]
            while True:
                self.out.append(Quad(self.graph, s, p, *self.term()))
                if self.peek()[1] != ",":
                    break
                self.take()
            while self.peek()[1] == ";":
                self.take()
                if self.peek()[1] in (".", "]", ";"):
                    continue
                break
            else:
                return
            if self.peek()[1] in (".", "]"):
                return

    def term(self) -> tuple[str, str, str | None, str | None]:
        kind, text = self.take()
        if kind == "iri":
            return "iri", self.resolve(_plain(text[1:-1])), None, None
        if kind == "name":
            head, _, tail = text.partition(":")
            if head not in self.prefixes:
                raise ValueError(f"Turtle: no prefix {head!r}")
            return "iri", self.prefixes[head] + re.sub(r"\\(.)", r"\1", tail), None, None
        if kind == "blank":
            return "blank", text, None, None
        if kind in ("string", "long"):
            value = _plain(text[3:-3] if kind == "long" else text[1:-1])
            if self.peek()[0] == "lang":
                return "literal", value, None, self.take()[1][1:]
            if self.peek()[0] == "dt":
                self.take()
                return "literal", value, self.term()[1], None
            return "literal", value, XSD + "string", None
        if kind == "number":
            return "literal", text, XSD + ("double" if "e" in text.lower() else "decimal" if "." in text else "integer"), None
        if text in ("true", "false"):
            return "literal", text, XSD + "boolean", None
        if text == "[":
            s = self.blank()
            if self.peek()[1] != "]":
                self.predicates(s)
            self.take("]")
            return "blank", s, None, None
        if text == "(":
            items = []
            while self.peek()[1] != ")":
                items.append(self.term())
            self.take(")")
            nodes = [self.blank() for _ in items]
            for k, item in enumerate(items):
                self.out.append(Quad(self.graph, nodes[k], RDF + "first", *item))
                rest = ("blank", nodes[k + 1], None, None) if k + 1 < len(nodes) else ("iri", RDF + "nil", None, None)
                self.out.append(Quad(self.graph, nodes[k], RDF + "rest", *rest))
            return ("blank", nodes[0], None, None) if nodes else ("iri", RDF + "nil", None, None)
        raise ValueError(f"Turtle: a term expected, not {text!r}")


def parse_turtle(text: str, graph: str | None = None, base: str = "") -> list[Quad]:
    return _Turtle(text, graph, base).parse()


# ---- JSON-LD --------------------------------------------------------------------------------


def parse_jsonld(text: str, graph: str | None = None) -> list[Quad]:
    """Expanded or simply compacted JSON-LD: @context of terms, @id, @type, @value, @language, @list as values, @graph."""
    doc, out, count = json.loads(text), [], [0]

    def name(term: str, context: dict[str, Any]) -> str | None:
        if re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://|^_:|^urn:", term):
            return term
        found = context.get(term)
        found = found.get("@id") if isinstance(found, dict) else found
        if found:
            return name(found, {k: v for k, v in context.items() if k != term})
        head, colon, tail = term.partition(":")
        if colon and head in context:
            return (name(head, context) or "") + tail
        return context["@vocab"] + term if "@vocab" in context else None

    def value(v: Any, context: dict[str, Any], kind: str | None) -> list[tuple]:
        if isinstance(v, list):
            return [x for item in v for x in value(item, context, kind)]
        if isinstance(v, dict) and "@value" in v:
            dt = v.get("@type")
            return [("literal", str(v["@value"]), None if "@language" in v else name(dt, context) if dt else XSD + "string", v.get("@language"))]
        if isinstance(v, dict) and "@list" in v:
            return value(v["@list"], context, kind)
        if isinstance(v, dict):
            s = node(v, context)
            return [("blank" if s.startswith("_:") else "iri", s, None, None)]
        if kind == "@id":
            return [("iri", name(v, context) or v, None, None)]
        if isinstance(v, bool):
            return [("literal", str(v).lower(), XSD + "boolean", None)]
        if isinstance(v, int | float):
            return [("literal", str(v), XSD + ("integer" if isinstance(v, int) else "double"), None)]
        return [] if v is None else [("literal", v, name(kind, context) if kind else XSD + "string", None)]

    def node(n: dict[str, Any], context: dict[str, Any]) -> str:
        context = {**context, **(n["@context"] if isinstance(n.get("@context"), dict) else {})}
        count[0] += 1
        s = n.get("@id") or f"_:j{count[0]}"
        s = name(s, context) or s
        for key, v in n.items():
            if key == "@type":
                out.extend(Quad(graph, s, RDF_TYPE, "iri", name(t, context) or t) for t in (v if isinstance(v, list) else [v]))
            elif key == "@graph":
                for inner in v if isinstance(v, list) else [v]:
                    node(inner, context)
            elif not key.startswith("@") and (p := name(key, context)):
                how = context.get(key)
                out.extend(Quad(graph, s, p, *x) for x in value(v, context, how.get("@type") if isinstance(how, dict) else None))
        return s

    for n in doc if isinstance(doc, list) else [doc]:
        node(n, {})
    return out


def read_documents(spark: SparkSession, path: str, format: str = "turtle", base: str = "") -> DataFrame:
    """Quads of whole Turtle or JSON-LD documents, one per file; the file's path is the graph.

    A document must fit in memory, as its prefixes hold for all of it. One that can't be read gives a
    quad with predicate error: and the message, so that the others stay.
    """
    parse = {"turtle": lambda t, g: parse_turtle(t, g, base or g), "jsonld": parse_jsonld}[format]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows: list[tuple] = []
            for g, text in zip(frame["path"], frame["content"], strict=True):
                try:
                    found = parse(bytes(text).decode(), g)
                    rows += [tuple(q._replace(s=f"{q.s}@{g}" if q.s.startswith("_:") else q.s, o=f"{q.o}@{g}" if q.o_kind == "blank" else q.o)) for q in found]
                except ValueError as error:
                    rows.append((g, g, "error:", "literal", str(error), XSD + "string", None))
            yield pd.DataFrame(rows, columns=["g", "s", "p", "o_kind", "o", "o_dt", "o_lang"], dtype=object)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, QUAD)


def schema_terms(quads: DataFrame) -> DataFrame:
    """property, domain, range, label out of an RDF schema."""
    rdfs = "http://www.w3.org/2000/01/rdf-schema#"
    of = lambda p: F.min(F.when(F.col("p") == rdfs + p, F.col("o"))).alias(p)
    return quads.groupBy(F.col("s").alias("property")).agg(of("domain"), of("range"), of("label")).filter("domain is not null or range is not null")


def check_quads(quads: DataFrame) -> DataFrame:
    """Statements whose form is wrong: s, p, o and the problem."""
    absolute = r"^[a-zA-Z][a-zA-Z0-9+.-]*:"
    problem = (
        F.when(~F.coalesce(F.col("s").rlike(absolute) | F.startswith("s", F.lit("_:")), F.lit(False)), "subject is no IRI or blank node")
        .when(~F.coalesce(F.col("p").rlike(absolute), F.lit(False)), "predicate is no IRI")
        .when((F.col("o_kind") == "iri") & ~F.coalesce(F.col("o").rlike(absolute), F.lit(False)), "object is no IRI")
        .when(F.col("o").isNull(), "object is missing")
        .when((F.col("o_kind") == "literal") & (F.col("o_dt") == XSD + "integer") & ~F.col("o").rlike(r"^[+-]?\d+$"), "literal is no integer")
    )
    return quads.select("s", "p", "o", problem.alias("problem")).filter("problem is not null")
