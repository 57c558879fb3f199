"""Point-in-time features for evaluation rows that arrive as a stream.

Each micro-batch of new evaluation rows is joined with the event tables as
they are at batch time (a plain batch DataFrame, re-read per batch), using
the same operator as the batch queries. Output goes to
``<sink>/batch_id=<n>`` with overwrite, so a replayed batch (after a
failure) rewrites its own folder instead of appending twice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def run_incremental(evals_stream: DataFrame, compute: Callable[[DataFrame], DataFrame], *, sink: str,
                    checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Start a stream that writes ``compute(new_evals)`` for every micro-batch.

    ``compute`` is any batch operator taking the evaluation rows, e.g.
    ``lambda ev: decayed_mean(ev, labs)``. ``checkpoint`` must be a shared
    folder (the stream's progress and offsets live there).
    """

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        out = compute(batch)
        out.write.mode("overwrite").parquet(f"{sink.rstrip('/')}/batch_id={batch_id}")

    w = evals_stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
