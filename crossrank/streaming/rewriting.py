"""Rewriting of reports as they arrive (an extension: the batch job with checkpoints, run by Structured Streaming)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from crossrank.operators.rewriting import Rewriter, rewrite, with_backoff


def rewrite_stream(reports: DataFrame, audit_path: str, checkpoint: str, rewriter: Rewriter) -> StreamingQuery:
    """Audit records of each micro-batch in a folder of its own, so that a batch that runs again replaces itself."""

    def one(batch: DataFrame, epoch: int) -> None:
        rewrite(batch, with_backoff(rewriter)).write.mode("overwrite").json(f"{audit_path}/batch={epoch}")

    return reports.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


