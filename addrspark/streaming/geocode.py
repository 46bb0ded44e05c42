"""Geocoding of streams: stateless, a micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.matching import Settings
from ..operators.search import Gazetteer, geocode


def geocode_stream(gazetteer: Gazetteer, stream: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, settings: Settings | None = None) -> StreamingQuery:
    """Start a query that gives each micro-batch of stream (qid, query), geocoded, to sink with its number.

    A batch that is tried again comes with the same number, so a sink that overwrites by number stores each row once.
    """

    def each(batch: DataFrame, number: int) -> None:
        sink(geocode(gazetteer, batch, settings), number)

    return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(each).start()
