"""Where the rows of a class are: registries, lookups over them, and tables made from what they say."""

from __future__ import annotations

import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrel.operators.validation import from_shacl, table_of
from quadrel.schema import Column, Table, key, string, table, uri

# The vocabulary of application registries.
INTEROP = "http://www.w3.org/ns/solid/interop#"
_KINDS = {"links": lambda: uri().array(), "link": uri, "text": string}
_REGISTRY = {
    "RegistrySet": {"hasDataRegistry": "links", "hasAgentRegistry": "links"},
    "DataRegistry": {"hasDataRegistration": "links"},
    "DataRegistration": {"registeredShapeTree": "link", "registeredBy": "link", "registeredAt": "text", "subjectTemplate": "text"},
    "ApplicationRegistration": {"registeredAgent": "link", "hasAccessGrant": "link"},
    "AccessGrant": {"grantedBy": "link", "grantedAt": "text", "grantee": "link", "hasDataGrant": "links"},
    "DataGrant": {"registeredShapeTree": "link", "hasDataRegistration": "link", "scopeOfGrant": "link", "accessMode": "links", "dataOwner": "link"},
}


def registry_tables(base: str = "") -> dict[str, Table]:
    """The six tables of an application registry, by class name."""
    made = {}
    for name, columns in _REGISTRY.items():
        own: dict[str, Column] = {"id": key(), **{n: _KINDS[k]().predicate(INTEROP + n) for n, k in columns.items()}}
        made[name] = table(name, own, INTEROP + name, namespace=INTEROP, base=base)
    return made


class Cache:
    """Values that count for `ttl` seconds."""

    def __init__(self, ttl: float = 24 * 3600, clock: Callable[[], float] = time.monotonic) -> None:
        self.ttl, self.clock, self.held = ttl, clock, {}

    def get(self, name: str, make: Callable[[], Any]) -> Any:
        if name not in self.held or self.held[name][0] <= self.clock():
            self.held[name] = (self.clock() + self.ttl, make())
        return self.held[name][1]

    def clear(self, name: str | None = None) -> None:
        self.held.clear() if name is None else self.held.pop(name, None)


class Discovery:
    """Lookups over registrations: rdf_class, container, shape, app, rank (1: application registry, 2: type index)."""

    def __init__(self, registrations: DataFrame, cache: Cache | None = None) -> None:
        self.rows, self.cache = registrations, cache or Cache()

    def discover(self, rdf_class: str, app: str | None = None) -> DataFrame:
        """rdf_class, container, shapes, rank of one class; each container once, the best rank first."""
        rows = self.rows.filter(F.col("rdf_class") == rdf_class)
        return self._merged(rows if app is None else rows.filter(F.col("app") == app))

    def discover_all(self) -> DataFrame:
        """Every registration, each once."""
        return self.rows.distinct()

    def discover_by_app(self, app: str) -> DataFrame:
        return self._merged(self.rows.filter(F.col("app") == app))

    def is_registered(self, rdf_class: str) -> bool:
        return not self.rows.filter(F.col("rdf_class") == rdf_class).isEmpty()

    def register(self, t: Table, container: str, app: str | None = None, shape: str | None = None, rank: int = 1) -> None:
        new = self.rows.sparkSession.createDataFrame([(t.type_iri, container, shape, app, rank)], "rdf_class string, container string, shape string, app string, rank int")
        self.rows = self.rows.unionByName(new)
        self.cache.clear()

    def tables_for(self, rdf_class: str, read_shape: Callable[[str], str], app: str | None = None) -> list[Table]:
        """A table for each container of the class, its columns from the first shape registered for it. Containers of one class are few."""
        found = []
        for row in self.discover(rdf_class, app).collect():
            shapes = [s for s in row["shapes"] if s]
            found.append(self.table_at(row["container"], shapes[0] if shapes else None, rdf_class, read_shape))
        return found

    def table_at(self, container: str, shape: str | None, rdf_class: str, read_shape: Callable[[str], str]) -> Table:
        """The table of a place; shapes are read once within the cache's time. Without a shape it has its key alone."""
        name = container.rstrip("/").rsplit("/", 1)[-1]
        if shape is None:
            return table(name, {"id": key()}, rdf_class, base=container)
        return table_of(self.cache.get(shape, lambda: from_shacl(read_shape(shape))), name, container)

    @staticmethod
    def _merged(rows: DataFrame) -> DataFrame:
        found = rows.groupBy("rdf_class", "container").agg(F.array_sort(F.collect_set("shape")).alias("shapes"), F.min("rank").alias("rank"))
        return found.orderBy("rank", "container")
