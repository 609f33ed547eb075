"""A select plan without joins, or a change, as SPARQL text, for reading and for other engines."""

from __future__ import annotations

from typing import TYPE_CHECKING, Any

from quadrel.functions.aggregates import Aggregate
from quadrel.functions.predicates import Compare, Logic, refs
from quadrel.operators.identity import iri_of, link_value
from quadrel.operators.quads import DATATYPES, XSD, is_iri
from quadrel.plans.select import SelectPlan, _named
from quadrel.schema import Column, Ref, Table

if TYPE_CHECKING:
    from quadrel.operators.mutations import ChangePlan


def _value(v: Any) -> str:
    if isinstance(v, Ref):
        return f"?{v.name}"
    if isinstance(v, bool):
        return str(v).lower()
    if isinstance(v, int | float):
        return str(v)
    text = str(v).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")
    return f'"{text}"^^<{XSD}dateTime>' if hasattr(v, "isoformat") else f'"{text}"'


def _like(pattern: str) -> str:
    import re

    return "^" + "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in pattern) + "$"


def condition(n: Any) -> str:
    if isinstance(n, Logic):
        if n.op == "not":
            return f"!({condition(n.parts[0])})"
        return "(" + (" && " if n.op == "and" else " || ").join(map(condition, n.parts)) + ")" if n.parts else "true"
    if not isinstance(n, Compare):
        raise ValueError("this condition has no SPARQL text")
    a = _value(n.left)
    match n.op:
        case "null":
            return f"!(BOUND({a}))"
        case "in":
            return f"{a} IN ({', '.join(map(_value, n.right))})" if n.right else "false"
        case "between":
            return f"({a} >= {_value(n.right[0])} && {a} <= {_value(n.right[1])})"
        case "like":
            return f"REGEX(STR({a}), {_value(_like(n.right))}, \"i\")"
        case "regex":
            return f"REGEX(STR({a}), {_value(n.right)})"
    return f"{a} {n.op} {_value(n.right)}"


def select_text(plan: SelectPlan) -> str:
    t = plan.base
    if plan.joins or any(isinstance(f, dict) for f in (plan.projection or {}).values()):
        raise ValueError("joins and nested projections have no SPARQL text")
    fields = plan.projection or {n: t.c[n] for n in t.columns}
    shown, used = [], {r.name for r in refs(plan.where)} | {r.name for r in plan.group_by}
    for n, f in fields.items():
        f = _named(plan, f) if isinstance(f, str) else f
        if isinstance(f, Aggregate):
            inner = ("DISTINCT " if f.distinct else "") + (f"?{f.column.name}" if f.column else "*")
            shown.append(f"({f.fn.upper()}({inner}) AS ?{n})")
            used |= {f.column.name} if f.column else set()
        else:
            used.add(f.name)
            shown.append(f"?{n}" if f.name == n else f"(?{f.name} AS ?{n})")
    used |= {o.by.name for o in plan.order_by if isinstance(o.by, Ref)}
    lines = [f"SELECT {'DISTINCT ' if plan.distinct else ''}{' '.join(shown)} WHERE {{", f"  ?subject a <{t.type_iri}> ."]
    for n, c in t.columns.items():
        if n in used and not (c.primary and not c.predicate_iri):
            triple = f"?{n} <{t.predicate_of(n)}> ?subject" if c.is_inverse else f"?subject <{t.predicate_of(n)}> ?{n}"
            lines.append(f"  {triple} ." if c.required else f"  OPTIONAL {{ {triple} }}")
    if plan.where is not None:
        lines.append(f"  FILTER({condition(plan.where)})")
    lines.append("}")
    if plan.group_by:
        lines.append("GROUP BY " + " ".join(f"?{r.name}" for r in plan.group_by))
    if plan.having is not None:
        lines.append(f"HAVING ({condition(plan.having)})")
    if plan.order_by:
        lines.append("ORDER BY " + " ".join(f"{'DESC' if o.descending else 'ASC'}(?{o.by.name if isinstance(o.by, Ref) else o.by})" for o in plan.order_by))
    lines += [f"LIMIT {plan.limit}"] * (plan.limit is not None) + [f"OFFSET {plan.offset}"] * bool(plan.offset)
    return "\n".join(lines)


def _node(c: Column, v: Any) -> str:
    """A value of a column as a term."""
    if is_iri(c):
        return f"<{link_value(c.link_to, v) if c.link_to is not None else v}>"
    dt = DATATYPES.get(c.kind, XSD + "string")
    if hasattr(v, "isoformat"):
        v = v.strftime("%Y-%m-%dT%H:%M:%S.") + f"{v.microsecond // 1000:03d}Z"
    text = str(v).lower() if isinstance(v, bool) else str(v)
    for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r")):
        text = text.replace(a, b)
    return f'"{text}"' + ("" if dt == XSD + "string" else f"^^<{dt}>")


def _statements(t: Table, iri: str, row: dict[str, Any]) -> list[str]:
    out = [f"<{iri}> a <{t.type_iri}> ."]
    for n, v in row.items():
        c = t.columns[n]
        if v is None or (c.primary and not c.predicate_iri):
            continue
        for x in dict.fromkeys(v) if isinstance(v, list | tuple) else [v]:
            out.append(f"{_node(c, x)} <{t.predicate_of(n)}> <{iri}> ." if c.is_inverse else f"<{iri}> <{t.predicate_of(n)}> {_node(c, x)} .")
    return out


def change_text(plan: ChangePlan) -> str:
    """INSERT DATA grouped by document, or DELETE / INSERT / WHERE."""
    t = plan.table
    if plan.kind == "insert":
        if plan.rows is None:
            raise ValueError("rows of a DataFrame have no SPARQL text")
        by: dict[str, list[str]] = {}
        for row in plan.rows:
            if row.get(t.pk) is None:
                raise ValueError("a row without a key has no SPARQL text: its key is made when it is inserted")
            iri = iri_of(t, row[t.pk])
            by.setdefault(iri.split("#")[0], []).extend(_statements(t, iri, row))
        blocks = ["  GRAPH <" + doc + "> {\n    " + "\n    ".join(lines) + "\n  }" for doc, lines in by.items()]
        return "INSERT DATA {\n" + "\n".join(blocks) + "\n}"
    if plan.where is None:
        raise ValueError(f"{plan.kind} needs where()")
    where = [f"?subject a <{t.type_iri}> ."]
    for n in sorted({r.name for r in refs(plan.where)}):
        c = t.columns[n]
        if c.primary and not c.predicate_iri:
            iri = next((x.right for x in _compares(plan.where) if x.left == t.c[n] and x.op == "="), None)
            if iri is None:
                raise ValueError("a key is compared by = alone in SPARQL text")
            where.append(f"VALUES ?subject {{ <{iri_of(t, iri)}> }}")
            continue
        where.append(f"OPTIONAL {{ ?subject <{t.predicate_of(n)}> ?{n} }}")
    rest = _without_key(plan.where, t)
    if rest is not None:
        where.append(f"FILTER({condition(rest)})")
    if plan.kind == "delete":
        return "DELETE { ?subject ?p ?o }\nWHERE {\n  " + "\n  ".join([*where, "?subject ?p ?o ."]) + "\n}"
    gone, new = [], []
    for n, v in plan.values.items():
        if hasattr(v, "_jc"):
            raise ValueError("a computed value has no SPARQL text")
        c = t.columns[n]
        gone.append(f"?subject <{t.predicate_of(n)}> ?old_{n} .")
        where.append(f"OPTIONAL {{ ?subject <{t.predicate_of(n)}> ?old_{n} }}")
        new += [f"?subject <{t.predicate_of(n)}> {_node(c, x)} ." for x in (dict.fromkeys(v) if isinstance(v, list | tuple) else [v]) if x is not None]
    parts = ["DELETE { " + " ".join(gone) + " }"] + (["INSERT { " + " ".join(new) + " }"] if new else [])
    return "\n".join(parts) + "\nWHERE {\n  " + "\n  ".join(where) + "\n}"


def _compares(n: Any) -> list[Compare]:
    return [x for p in n.parts for x in _compares(p)] if isinstance(n, Logic) else [n] if isinstance(n, Compare) else []


def _without_key(n: Any, t: Table) -> Any:
    """The condition without equalities of the key, which VALUES states."""
    is_key = lambda x: isinstance(x, Compare) and isinstance(x.left, Ref) and x.left.name == t.pk and not t.columns[t.pk].predicate_iri
    if is_key(n):
        return None
    if isinstance(n, Logic) and n.op == "and":
        left = [x for x in (_without_key(p, t) for p in n.parts) if x is not None]
        return Logic("and", tuple(left)) if left else None
    if any(map(is_key, _compares(n))):
        raise ValueError("a key is compared by = alone, under AND, in SPARQL text")
    return n
