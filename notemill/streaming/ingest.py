"""Notes that arrive as files of a stream, appended to a table of parsed notes.

The reference rebuilds its index whole; this is an addition, so that a large collection need not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..functions.parser import parse_notes


def parsed_stream(texts: DataFrame) -> DataFrame:
    """A stream of `(path, text)` as a stream of parsed notes; stateless, so any trigger and any restart will do."""
    return parse_notes(texts, ["path"], "path", "text").drop("wiki", "links")


def append_to(texts: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Write the parsed stream to Parquet at `table`, all that is there now, exactly once by the checkpoint."""
    return parsed_stream(texts).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
