"""Scoring messages as they arrive, with the same functions as the batch jobs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..config import EscalationLimits
from ..operators import decisions
from ..plans import triage


def with_history(messages: DataFrame, best_scores: DataFrame, key: str = "id") -> DataFrame:
    """Stream-static join with scores known beforehand; unmatched messages keep a null score."""
    return messages.join(best_scores, key, "left")


def score(messages: DataFrame, limits: EscalationLimits = EscalationLimits()) -> DataFrame:
    """Escalation decisions; stateless, so it works on batches and streams alike."""
    return decisions.decide(messages, limits)


def triage_job(documents: DataFrame, dim: int, **settings) -> Callable[[DataFrame], DataFrame]:
    """The triage job over a static history, to be run on every micro-batch.

    `settings` are those of the batch job; an `index` built beforehand keeps a
    batch from reading the whole history.
    """
    return lambda batch: triage.triage(batch, documents, dim, **settings)


def start(
    messages: DataFrame, sink: str, checkpoint: str, job: Callable[[DataFrame], DataFrame] = score, available_now: bool = True
) -> StreamingQuery:
    """Run `job` on every micro-batch and write it below `sink`.

    A batch owns one folder and replaces it, so a batch replayed after a failure
    leaves no duplicates. Any batch job can be passed, the triage job included.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        job(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    w = messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()
