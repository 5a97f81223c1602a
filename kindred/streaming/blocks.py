"""Blocking and pair features over streams: both are projections without state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from kindred.operators.blocking import generate_blocks
from kindred.operators.resolve import weak_components
from kindred.spec import Feature


def stream_blocks(records: DataFrame, features: list[Feature]) -> DataFrame:
    """Block keys of a stream of records. distinct within a record is kept by the arrays; across records it needs no state."""
    return generate_blocks(records, features)


def resolve_batches(records: DataFrame, known: DataFrame, match, features: list[Feature], path: str, checkpoint: str):
    """Each micro-batch of a stream is resolved together with known records; labels go to ``path/<batch>``."""

    def one(batch: DataFrame, number: int) -> None:
        both = known.unionByName(batch)
        weak_components(both, match, generate_blocks(both, features)).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return records.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
