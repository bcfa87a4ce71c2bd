"""Landed payload files as a stream of feed runs."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from fairline.plans.ingest import ingest
from fairline.session import cut_lineage
from fairline.sources.payloads import sound_and_rejected
from fairline.storage import Store


def ingest_stream(
    payloads: DataFrame,
    store: Store,
    bookmaker_code: str,
    parse: Callable[[DataFrame], tuple[DataFrame, DataFrame, DataFrame]],
    clock: Callable[[], datetime],
    progress_path: str,
    order: list[str] | None = None,
    problem: Column | None = None,
    rejected_path: str | None = None,
) -> StreamingQuery:
    """One feed run per micro-batch of payload rows.

    ``parse`` turns a batch into (sports, events, markets). Decision keys, mapping claims and
    observation keys make a batch that is run again add nothing. With ``problem`` (see ``sources.payloads``), payloads that have
    one are written to ``rejected_path`` and the rest of the batch goes on; without it they fail the run.
    """

    def run(batch: DataFrame, number: int) -> None:
        landed = cut_lineage(batch)
        if problem is not None:
            landed, rejected = sound_and_rejected(landed, problem)
            rejected.write.mode("overwrite").parquet(f"{rejected_path}/batch={number}")
        sports, events, markets = parse(landed)
        ingest(store, bookmaker_code, sports, events, markets, f"{bookmaker_code}-batch-{number}", clock(), order)

    return (
        payloads.writeStream.foreachBatch(run)
        .option("checkpointLocation", progress_path)
        .trigger(availableNow=True)
        .start()
    )
