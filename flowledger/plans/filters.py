"""The filter algebra of workflow listings: options become predicates, predicates a plan."""

from __future__ import annotations

import json
from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import json_contains
from ..schema import STATUSES

EQUAL = ["status", "name", "queue_name", "executor_id", "application_version", "authenticated_user", "forked_from", "parent_workflow_id", "deduplication_id", "schedule_name", "is_debounced"]
BOUNDS = {"created": "created_at", "completed": "completed_at", "dequeued": "started_at_epoch_ms"}


@dataclass
class WorkflowFilter:
    """Options AND together; equality options take a value or a list; time bounds are inclusive."""

    status: str | list | None = None
    name: str | list | None = None
    queue_name: str | list | None = None
    executor_id: str | list | None = None
    application_version: str | list | None = None
    authenticated_user: str | list | None = None
    forked_from: str | list | None = None
    parent_workflow_id: str | list | None = None
    deduplication_id: str | list | None = None
    schedule_name: str | list | None = None
    is_debounced: bool | None = None
    workflow_ids: list | None = None
    workflow_id_prefix: str | None = None
    created_after: int | None = None
    created_before: int | None = None
    completed_after: int | None = None
    completed_before: int | None = None
    dequeued_after: int | None = None
    dequeued_before: int | None = None
    has_parent: bool | None = None
    queues_only: bool = False
    attributes: dict | None = None
    load_input: bool = True
    load_output: bool = True
    sort: str = "desc"
    limit: int | None = None
    offset: int | None = None

    def predicates(self) -> list[Column]:
        out = []
        for name in EQUAL:
            value = getattr(self, name)
            if value is not None:
                out.append(F.col(name).isin(value) if isinstance(value, (list, tuple)) else F.col(name) == value)
        if self.workflow_ids is not None:
            out.append(F.col("workflow_uuid").isin(list(self.workflow_ids)))
        if self.workflow_id_prefix is not None:  # not escaped: % and _ in it are wildcards
            out.append(F.col("workflow_uuid").like(self.workflow_id_prefix + "%"))
        for key, column in BOUNDS.items():
            for side in ("after", "before"):
                value = getattr(self, f"{key}_{side}")
                if isinstance(value, (list, tuple)):
                    raise ValueError(f"{key}_{side} takes one value")
                if value is not None:
                    out.append(F.col(column) >= value if side == "after" else F.col(column) <= value)
        if self.has_parent is not None:
            out.append(F.col("parent_workflow_id").isNotNull() if self.has_parent else F.col("parent_workflow_id").isNull())
        if self.queues_only:
            out.append(F.col("queue_name").isNotNull())
        if self.attributes is not None:
            out.append(json_contains(F.col("attributes"), self.attributes))
        return out

    @classmethod
    def from_request(cls, body: str) -> WorkflowFilter:
        """From the JSON of an administration request; unknown fields are an error."""
        asked = json.loads(body or "{}")
        unknown = set(asked) - {f.name for f in fields(cls)}
        if unknown:
            raise ValueError(f"unknown filter: {', '.join(sorted(unknown))}")
        states = asked.get("status") or []
        for s in states if isinstance(states, list) else [states]:
            if s not in STATUSES:
                raise ValueError(f"unknown status: {s}")
        return cls(**asked)


def list_workflows(ws: DataFrame, f: WorkflowFilter) -> DataFrame:
    """Filtered, sorted by creation (ties by id), paged; payload columns keep their place when not loaded."""
    df = ws.where(reduce(lambda a, b: a & b, f.predicates(), F.lit(True)))
    if not f.load_input:
        df = df.withColumn("inputs", F.lit(None).cast("string"))
    if not f.load_output:
        df = df.withColumns({c: F.lit(None).cast("string") for c in ("output", "error")})
    df = df.orderBy(F.col("created_at").desc() if f.sort == "desc" else F.col("created_at").asc(), "workflow_uuid")
    df = df.offset(f.offset) if f.offset else df
    return df.limit(f.limit) if f.limit is not None else df
