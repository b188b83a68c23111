"""Scalar functions as Column expressions."""

from __future__ import annotations

import json
import re
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import RETRYABLE, STATUSES, TERMINAL


def is_terminal(status: Column) -> Column:
    return status.isin(TERMINAL)


def is_retryable(status: Column) -> Column:
    return status.isin(RETRYABLE)


def known_status(status: Column) -> Column:
    """The status; an unknown one fails the query."""
    return F.when(status.isNull() | status.isin(STATUSES), status).otherwise(F.raise_error(F.concat(F.lit("unknown status: "), status)))


def retry_delay_ms(run: Column, base: float, factor: float, most: float) -> Column:
    """Milliseconds before the run after ``run`` runs."""
    return F.round(F.least(F.lit(float(base)) * F.pow(F.lit(float(factor)), run - 1), F.lit(float(most)))).cast("long")


def may_retry(runs: Column, max_retries: int) -> Column:
    return runs <= max_retries


DATABASE_ATTEMPTS = 10


def database_retry_delay_ms(attempt: Column) -> Column:
    """Expected delay (jitter is 5 % either way) before the next of ``DATABASE_ATTEMPTS`` attempts."""
    return F.least(100 * F.pow(F.lit(2.0), attempt - 1), F.lit(30_000.0))


def reconnect_delay_ms(attempt: Column) -> Column:
    return F.least(200 * F.pow(F.lit(2.0), attempt), F.lit(5_000.0)).cast("long")


def next_poll_ms(current: Column, outcome: Column, base: float, most: float, listening: bool) -> Column:
    """The polling interval after a tick's outcome: contention, claimed, limited or idle."""
    idle = F.least(current * 1.5, F.lit(float(most))) if listening else F.greatest(current * 0.9, F.lit(float(base)))
    return F.when(outcome == "contention", F.least(current * 2, F.lit(float(most)))).when(outcome.isin("claimed", "limited"), F.lit(float(base))).otherwise(idle)


def poll_after(outcomes: Column, base: float, most: float, listening: bool) -> Column:
    """The interval after a whole array of outcomes, from ``base``."""
    return F.aggregate(outcomes, F.lit(float(base)), lambda acc, o: next_poll_ms(acc, o, base, most, listening))


def age(ms: Column) -> Column:
    """12s, 5m, 3h or 2d."""
    s = F.floor(ms / 1000)
    unit = lambda n, u: F.concat(F.floor(s / n).cast("string"), F.lit(u))
    return F.when(s < 60, unit(1, "s")).when(s < 3600, unit(60, "m")).when(s < 86400, unit(3600, "h")).otherwise(unit(86400, "d"))


def short_digest(value: Column) -> Column:
    return F.substring(F.sha2(value.cast("binary"), 256), 1, 16)


def stub_embedding(value: Column) -> Column:
    """Eight numbers between 0 and 1 from the bytes of an MD5."""
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.conv(F.substr(F.md5(value.cast("binary")), i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0)


def text_chunks(text: Column, size: int = 500) -> Column:
    count = F.ceil(F.char_length(text) / size).cast("int")
    return F.when(count > 0, F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.substr(text, i * size + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def text_graphemes(text: Column, size: int = 500) -> Column:
    """Pieces of ``size`` characters as a reader counts them (a letter with its marks, an emoji sequence, a line end are one)."""
    parts = F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0))
    count = F.ceil(F.size(parts) / size).cast("int")
    cut = lambda all_: F.transform(F.sequence(F.lit(0), F.ceil(F.size(all_) / size).cast("int") - 1), lambda i: F.array_join(F.slice(all_, i * size + 1, F.lit(size)), ""))
    return F.when(count > 0, F.get(F.transform(F.array(parts), cut), 0)).otherwise(F.array().cast("array<string>"))


def payload(first: str, second: str) -> Column:
    """``a::b``; null if either is null."""
    return F.concat(F.col(first), F.lit("::"), F.col(second))


def stable_uuid(name: Column) -> Column:
    """A version 4 UUID's form from a SHA-256 of ``name``: the same on every run, where a random one is not wanted."""
    h = F.sha2(name.cast("binary"), 256)
    part = lambda at, n: F.substring(h, at, n)
    variant = F.substring(F.lit("89ab"), 1 + F.conv(part(17, 1), 16, 10).cast("int") % 4, F.lit(1))
    return F.concat(part(1, 8), F.lit("-"), part(9, 4), F.lit("-4"), part(14, 3), F.lit("-"), variant, part(18, 3), F.lit("-"), part(21, 12))


def encoded_payload(value: Column) -> Column:
    return F.base64(value.cast("binary"))


def decoded_payload(value: Column, serialization: Column) -> Column:
    """The bytes of a stored payload: text of ``portable_json`` as it is, everything else from base 64."""
    return F.when(serialization == "portable_json", value.cast("binary")).otherwise(F.unbase64(value))


def remaining_ms(deadline: Column, now_ms: int) -> Column:
    """What is left of a durable sleep, whose deadline was fixed when it first ran; never less than nothing."""
    return F.greatest(deadline - F.lit(now_ms), F.lit(0))


def parks(remaining: Column, completed_steps: Column, threshold_ms: int = 60_000, ceiling: int = 500) -> Column:
    """Whether a wait gives its process up: long enough, and not too many steps to replay."""
    return (remaining > threshold_ms) & (completed_steps < ceiling)


def detection_ms(ttl_ms: Column, interval_ms: Column) -> Column:
    """The longest that a dead executor goes unnoticed: its lease, then one sweep interval."""
    return ttl_ms + interval_ms


def split_payload(payload: Column) -> Column:
    """The two parts at the first ``::``."""
    return F.split(payload, "::", 2)


def duration_ms(text: str) -> int:
    """Milliseconds of ``1h30m``, ``1.5s`` and the like, rounded; ValueError for anything else."""
    units = {"ns": 1e-6, "us": 1e-3, "µs": 1e-3, "ms": 1, "s": 1000, "m": 60_000, "h": 3_600_000}
    part = r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)"
    if not re.fullmatch(f"(?:{part})+", text):
        raise ValueError(f"not a duration: {text}")
    return int(sum(float(n) * units[u] for n, u in re.findall(part, text)) + 0.5)


def json_contains(document: Column, pattern: Any) -> Column:
    """Whether JSON text contains ``pattern``: objects by key, arrays as sets, numbers by value.

    The pattern is walked on the driver; each leaf becomes a predicate.
    """
    return F.coalesce(_contains(F.try_parse_json(document), pattern, top=True), F.lit(False))


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _leaf(value: Column, want: Any) -> Column:
    if want is None:
        return F.is_variant_null(value)
    if isinstance(want, bool):
        return (_kind(value) == "BOOLEAN") & (F.try_variant_get(value, "$", "boolean") == want)
    if isinstance(want, (int, float)):
        return ~_kind(value).isin("STRING", "BOOLEAN") & (F.try_variant_get(value, "$", "double") == float(want))
    return (_kind(value) == "STRING") & (F.try_variant_get(value, "$", "string") == want)


def _test(want: Any):
    return lambda x: F.coalesce(_contains(x, want), F.lit(False))


def _contains(value: Column, want: Any, top: bool = False) -> Column:
    items = lambda v: F.try_variant_get(v, "$", "array<variant>")
    if isinstance(want, dict):
        out = _kind(value).startswith("OBJECT")
        for key, inner in want.items():
            name = json.dumps(key)[1:-1].replace("'", "\\'")
            out = out & F.coalesce(_contains(F.try_variant_get(value, f"$['{name}']", "variant"), inner), F.lit(False))
        return out
    if isinstance(want, (list, tuple)):
        out = _kind(value).startswith("ARRAY")
        for inner in want:
            out = out & F.coalesce(F.exists(items(value), _test(inner)), F.lit(False))
        return out
    if top:  # a top-level array contains a bare scalar
        return F.when(_kind(value).startswith("ARRAY"), F.exists(items(value), lambda x: F.coalesce(_leaf(x, want), F.lit(False)))).otherwise(_leaf(value, want))
    return _leaf(value, want)
