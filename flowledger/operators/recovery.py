"""Recovery as compositions of transitions: reclaim passes, the lease sweep, cancelling with children."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import lineage, reports, transitions


class Reclaimed(NamedTuple):
    workflows: DataFrame  # the next snapshot
    handled: DataFrame  # workflow_uuid: put back in their queues, then reclaimed
    outcome: str  # drained or batch_exhausted
    declined: DataFrame | None  # what is left and why; not asked for where the batch is exhausted


def reclaim(ws: DataFrame, dead: list[str] | DataFrame, caps: DataFrame, executor: str, now_ms: int, batch: int | None = None) -> Reclaimed:
    """Queued work of dead executors goes back to its queue; what these capabilities can run is taken over, oldest first.

    A snapshot has one writer, so the rescan for rows that others had locked finds
    nothing: without a bound one pass drains, and with one it ends when the batch
    is full.
    """
    queued = lineage.cut(reports.queued_pending(ws, dead))
    taken = lineage.cut(reports.reclaimable(ws, dead, caps, batch).select("workflow_uuid"))
    after, _ = transitions.clear_queue_assignment(ws, queued)
    after, _ = transitions.reclaim(after, taken, executor, now_ms)
    full = batch is not None and taken.count() >= batch
    declined = None if full else reports.declined(ws, dead, caps, taken)
    return Reclaimed(after, queued.unionByName(taken), "batch_exhausted" if full else "drained", declined)


def lease_sweep(ws: DataFrame, oo: DataFrame, el: DataFrame, caps: DataFrame, executor: str, now_ms: int, batch: int | None = 50) -> tuple[Reclaimed, DataFrame, DataFrame]:
    """One sweep: work of executors without a live lease is reclaimed, and cancellations that they left are finished.

    Gives what was reclaimed (its snapshot has the cancellations, too), the ids
    whose cancellation was finished, and the unwinding workflows to enqueue for them.
    """
    expired = reports.expired_pending_executors(ws, el, now_ms)
    got = reclaim(ws, expired, caps, executor, now_ms, batch)
    stale = lineage.cut(reports.stale_cancelling(ws, el, now_ms))
    done = stale.select("workflow_uuid", F.lit("CANCELLED").alias("new_status"), F.lit(None).cast("string").alias("new_output"), F.lit(None).cast("string").alias("new_error"))
    after, finished = transitions.record_outcomes(got.workflows, done, now_ms)
    return got._replace(workflows=after), finished, transitions.enqueue_unwinds(after, oo, finished, now_ms)


def cancel_with_children(ws: DataFrame, oo: DataFrame, roots: DataFrame, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Cancels the roots and everything below them, as ``transitions.cancel`` does; (next snapshot, ids that exist)."""
    below = lineage.descendants(ws, roots).select("workflow_uuid")
    return transitions.cancel(ws, oo, lineage.cut(roots.select("workflow_uuid").unionByName(below).distinct()), now_ms)
