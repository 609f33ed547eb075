"""A SPARQL subset compiled to DataFrames over quads."""

from __future__ import annotations

import re
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame

from quadrel.sparql.compiler import Compiler
from quadrel.sparql.parser import parse

if TYPE_CHECKING:
    from quadrel.database import Database

_SQL = re.compile(r"^\s*(?:select\s+[^{]*\bfrom\s+[a-z_\"`]|insert\s+into\b|update\s+\S+\s+set\b|delete\s+from\b)", re.I)


def run(db: Database, text: str) -> DataFrame:
    """SELECT and ASK give rows, CONSTRUCT and DESCRIBE statements; an update gives inserted and deleted and replaces the database's quads."""
    if not isinstance(text, str) or not text.strip():
        raise ValueError("a SPARQL text is needed")
    if _SQL.match(text):
        raise ValueError("this is SQL; spark.sql() takes it")
    query = parse(text)
    compiler = Compiler(db.spark, db.quads, db.unique)
    if query.form == "select":
        return compiler.select_rows(query)
    if query.form == "ask":
        return compiler.ask(query)
    if query.form in ("construct", "describe"):
        return getattr(compiler, query.form)(query)
    quads, counts = compiler.update(query)
    db.replace_quads(quads, compiler.unique)
    return counts
