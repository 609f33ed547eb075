"""Change notifications: a stream of events, dispatched by kind in micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quadrel.schema import Table

EVENT = "id string, type string, object string, published timestamp, state string"
KINDS = ("Create", "Update", "Delete", "Add", "Remove")


def events(spark: SparkSession, path: str, format: str = "parquet", schema: str = EVENT, per_trigger: int = 16) -> DataFrame:
    """A file source of events; `object` is the IRI of what changed."""
    return spark.readStream.format(format).schema(schema).option("maxFilesPerTrigger", per_trigger).load(path)


def subscribe(stream: DataFrame, checkpoint: str, on: dict[str, Callable[[DataFrame], None]], t: Table | None = None, iri: str | None = None, once: bool = False, late: str = "1 hour") -> StreamingQuery:
    """Calls on[kind](rows) for each kind of KINDS, and on['*'](rows) with all, for each micro-batch.

    Only events below the table's base, or of one document, count. An event id counts once within `late`.
    A handler may run again for a batch after a failure, as batches are replayed from the checkpoint.
    """
    if unknown := set(on) - {*KINDS, "*"}:
        raise ValueError(f"unknown kind of event {sorted(unknown)[0]!r}")
    if t is not None:
        stream = stream.filter(F.startswith("object", F.lit(t.base)))
    if iri is not None:
        stream = stream.filter(F.substring_index("object", "#", 1) == iri.split("#")[0])
    stream = stream.withWatermark("published", late).dropDuplicatesWithinWatermark(["id"])

    def dispatch(rows: DataFrame, batch: int) -> None:
        rows = rows.persist()
        try:
            for kind, handler in on.items():
                some = rows if kind == "*" else rows.filter(F.col("type") == kind)
                if not some.isEmpty():
                    handler(some)
        finally:
            rows.unpersist()

    writer = stream.writeStream.foreachBatch(dispatch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def subscribe_by_iri(stream: DataFrame, checkpoint: str, db: object, t: Table, iri: str, on_update: Callable[[DataFrame], None], on_delete: Callable[[DataFrame], None] | None = None, once: bool = False, late: str = "1 hour") -> StreamingQuery:
    """Calls on_update with the row as it is now when its document changes, on_delete with the events when it goes."""
    again = lambda rows: on_update(reread(db, t, rows))
    handlers = {"Create": again, "Update": again, **({"Delete": on_delete} if on_delete else {})}
    return subscribe(stream, checkpoint, handlers, t, iri, once, late)


def reread(db: object, t: Table, rows: DataFrame) -> DataFrame:
    """The rows of t as they are now, for the events' objects."""
    return db.frame(t).join(rows.select(F.col("object").alias("_iri")).distinct(), "_iri", "left_semi")


def windowed_counts(stream: DataFrame, width: str = "1 minute", late: str = "10 minutes") -> DataFrame:
    """Beyond parity: events by kind and tumbling window, closed by a watermark."""
    return stream.withWatermark("published", late).groupBy(F.window("published", width), "type").agg(F.count("*").alias("n"))
