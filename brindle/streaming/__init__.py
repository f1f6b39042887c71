"""Continuous ingestion into the engine's tables.

The dialect has no unbounded queries; what a stream can do here is feed a table.  Each micro-batch is appended once: the table's metadata names the
last batch that it has of every stream (by the id in the stream's checkpoint), and one that it has is passed over, whatever has happened to the table since;
a batch that was cut short is written again to its own place.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from brindle.errors import EngineError
from brindle.plans.render import name_sql
from brindle.session import Engine


def ingest(engine: Engine, table: str, stream: DataFrame, checkpoint: str, **trigger) -> StreamingQuery:
    """Appends a stream's rows to a table whose columns the stream has by name.

    The table must have no constraint: those are checked by INSERT.  trigger: as of DataStreamWriter.trigger, available now if none.
    """
    home = engine.catalog.database()
    found = home.own_table(table)
    if any(c.not_null or c.unique or c.references or c.check_text for c in found.columns):
        raise EngineError(f"table '{table}' has constraints, which a stream can't check")
    missing = [c.name for c in found.columns if c.name not in stream.columns]
    if missing:
        raise EngineError(f"the stream has no column '{missing[0]}'")

    def append(batch: DataFrame, batch_id: int) -> None:
        own = json.loads(engine.catalog.files.read(f"{checkpoint.rstrip('/')}/metadata"))["id"]
        if found.streams.get(own, -1) >= batch_id:
            return
        rows = batch.select([F.col(name_sql(c.name)).cast(c.kind.spark).alias(c.physical) for c in found.columns])
        rows.write.mode("overwrite").parquet(f"{found.path}/stream={own}/batch={batch_id}")
        found.streams[own] = batch_id
        found.rows = None
        engine.catalog.save(home)

    return stream.writeStream.foreachBatch(append).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
