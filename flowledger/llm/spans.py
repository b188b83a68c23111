"""Places of regular-expression matches in texts, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,kind:int,end_:int,value:string>>"


#: Matches are placed in blocks of this many, so that appending to an array never copies a long one.
BLOCK = 256


def bound(value: Column, use) -> Column:
    """``use`` of ``value``, which is computed once however often ``use`` names it."""
    return F.get(F.transform(F.array(value), use), 0)


def in_blocks(items: Column) -> Column:
    """``items`` in slices of BLOCK, one at least."""
    return F.transform(F.sequence(F.lit(1), F.greatest(F.size(items), F.lit(1)), F.lit(BLOCK)), lambda i: F.slice(items, i, BLOCK))


def matches(text: Column, pattern: str, kind: int, keep=None, gate: Column | None = None) -> Column:
    """Leftmost non-overlapping matches as structs (start, kind, end_, value), places in code points, end exclusive.

    What lies between matches and the matches themselves add up to the places.
    ``keep`` is a condition on a match's text.  Texts that fail ``gate`` (by
    default: those without a match) cost one search and nothing more.
    """
    between = F.split(text, pattern, -1)
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def add(acc: Column, pair: Column) -> Column:
        start = acc["at"] + F.char_length(pair["gap"])
        end = start + F.char_length(pair["hit"])
        span = F.array(F.struct(start.alias("start"), F.lit(kind).alias("kind"), end.alias("end_"), pair["hit"].alias("value")))
        return F.struct(end.alias("at"), F.concat(acc["out"], span).alias("out"))

    def add_block(acc: Column, block: Column) -> Column:
        done = F.aggregate(block, F.struct(acc["at"].alias("at"), F.array().cast(SPAN).alias("out")), add)
        return bound(done, lambda d: F.struct(d["at"].alias("at"), F.concat(acc["out"], F.array(d["out"])).alias("out")))

    pairs = F.filter(F.arrays_zip(between.alias("gap"), found.alias("hit")), lambda p: p["hit"].isNotNull())
    blocks = bound(pairs, in_blocks)
    begin = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("out"))
    placed = F.flatten(F.aggregate(blocks, begin, add_block, lambda acc: acc["out"]))
    placed = F.filter(placed, lambda s: keep(s["value"])) if keep else placed
    return F.when(text.rlike(pattern) if gate is None else gate & text.rlike(pattern), placed).otherwise(F.array().cast(SPAN))


def line(spans: Column, kinds: list[str]) -> Column:
    """kind:start:end, joined by commas, in the order given."""
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*[F.lit(k) for k in kinds]), s["kind"] + 1), s["start"].cast("string"), s["end_"].cast("string"))))


def in_order(spans: Column, kind_first: bool = False) -> Column:
    """Sorted by start and then kind, or by kind and then start."""
    if not kind_first:
        return F.array_sort(spans)
    turned = F.array_sort(F.transform(spans, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end_"].alias("end_"))))
    return turned


def blocked(spans: Column) -> Column:
    """Spans in blocks with each block's bounds, which ``overlaps`` skips whole; quick where neighbours in ``spans`` lie near each other."""
    return F.transform(bound(spans, in_blocks), lambda b: F.struct(F.array_min(F.transform(b, lambda s: s["start"])).alias("lo"), F.array_max(F.transform(b, lambda s: s["end_"])).alias("hi"), b.alias("spans")))


def overlaps(span: Column, blocks: Column, also=None) -> Column:
    """Whether ``span`` overlaps one of the spans of ``blocks``, for which ``also`` holds."""
    hit = lambda o: (o["start"] < span["end_"]) & (span["start"] < o["end_"])
    return F.exists(blocks, lambda b: F.coalesce((b["lo"] < span["end_"]) & (span["start"] < b["hi"]), F.lit(False)) & F.exists(b["spans"], lambda o: hit(o) & also(o) if also else hit(o)))
