"""Benchmark decontamination by q-gram lemma filtering.

Benchmark items are cut into overlapping passages of ``PASSAGE`` code points
(shorter items are one passage).  A passage of m code points that occurs in a
document with at most e edits shares at least m - q + 1 - q*e of its q-grams
with it, all within a band of e + 1 diagonals (position in the document less
position in the passage).  For each document and passage, shared q-grams are
counted in diagonal bands of width 2(e + 1) that overlap by half, so that
every such run of diagonals lies within one band; bands under the bound are
dropped, and what remains is verified by banded alignment of the whole passage.

Pairs of a place in the text and a place in a passage that share a q-gram are
counted in slices of ``PAIRS`` at most, however common a q-gram is on both sides:
stretches of text that overlap by more than a passage and a band, and where these
are not enough, ranges of passages.  A band's pairs lie within one stretch.

Items of under ``Q`` normal code points are held against whole texts: a document
whose normal form equals the item's is a match.

Passages of ``FRAGMENT`` code points and more that stand in a document verbatim
are found at any place of the item: each such run holds a q-gram of the item at
a multiple of FRAGMENT - q + 1, from which the run is followed to both sides.

The passages are a stated query set that all rows are held against: they are
broadcast in blocks of ``BLOCK_CHARS`` code points, whose size is thereby
bounded, with one pass over the documents for each block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from .common import arrays_of, materialize, portions
from .langid import points

Q = 12
PASSAGE = 96
ERROR = 1 / 16
FRAGMENT = 64
BLOCK_CHARS = 4_000_000
PORTION = 2_000_000
TABLE_BITS = 22
PAIRS = 2_000_000
ALIGNED = 2048
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def plain_table() -> np.ndarray:
    """By code point: the code point of its small form if it is a letter or digit, else that of a space."""
    out = np.full(0x110000, 32, dtype=np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalnum():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


_plain: list[np.ndarray] = []


def plain(text: str) -> np.ndarray:
    """Code points of the normal form: small letters and digits, all else a single space between them."""
    if not _plain:
        _plain.append(plain_table())
    line = _plain[0][points(text)]
    gap = line == 32
    line = line[~(gap & np.concatenate(([True], gap[:-1])))] if len(line) else line
    return line[:-1] if len(line) and line[-1] == 32 else line


def gram_hashes(line: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit value for each of the q-grams of ``line``, in order."""
    n = len(line) - q + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, part, size, out, done = MULTIPLIER, line.astype(np.uint64) + np.uint64(1), 1, None, 0
    with np.errstate(over="ignore"):
        while True:  # q as a sum of powers of two, each from two halves
            if q & size:
                piece = part[done : done + n]
                out = piece.copy() if out is None else out * power + piece
                done += size
            if 2 * size > q:
                return (out ^ (out >> np.uint64(29))) * MULTIPLIER
            part = part[: len(part) - size] * power + part[size:]
            power = power * power
            size *= 2


ITEM_STOP = 0xFFFFFFFF


@dataclass
class Index:
    item: np.ndarray  # by passage: the item's number in its block
    size: np.ndarray  # of the passage
    edits: np.ndarray
    needed: np.ndarray
    home: np.ndarray  # the passage's place in ``whole``
    gram: np.ndarray  # sorted values; postings of gram[i]: begin[i] to begin[i+1], by passage and offset
    begin: np.ndarray
    passage: np.ndarray
    offset: np.ndarray
    seen: np.ndarray  # bit table by the upper bits of a value
    whole: np.ndarray  # all items in a row, each with ITEM_STOP before and after it
    anchor: np.ndarray  # by posting: the q-gram's place in ``whole`` if fragments are followed from it, else 0
    short: dict  # the normal forms of items of under q code points, as bytes, and their numbers


def index(texts: list[str | None], numbers: list[int] | None = None, q: int = Q, passage: int = PASSAGE, error: float = ERROR) -> Index:
    """``numbers``: equal for texts of one item, by default 0, 1, ..."""
    own, sizes, home, starts, whole, at, short = [], [], [], [], [np.array([ITEM_STOP], np.uint32)], 1, {}
    lines = []
    for item, text in zip(range(len(texts)) if numbers is None else numbers, texts):
        line = plain(text or "").astype(np.uint32)
        if 0 < len(line) < q:
            short.setdefault(line.tobytes(), []).append(item)
        if len(line) >= q:
            for end in [*range(passage, len(line), passage // 2), len(line)] if len(line) > passage else [len(line)]:
                own.append(item)
                starts.append(max(0, end - passage))
                sizes.append(end - starts[-1])
                home.append(at + starts[-1])
                lines.append(line[starts[-1] : end])
            whole += [line, whole[0]]
            at += len(line) + 1
    size, home, shift = (np.array(x, dtype=np.int64) for x in (sizes, home, starts))
    edits = np.maximum(0, np.minimum((size * error).astype(np.int64), (size - q) // q))
    hashes = [gram_hashes(x, q) for x in lines]
    every = np.concatenate([*hashes, np.zeros(0, np.uint64)])
    passage_of = np.repeat(np.arange(len(lines)), size - q + 1)
    offset = np.arange(len(every)) - np.repeat(np.cumsum(size - q + 1) - (size - q + 1), size - q + 1)
    order = np.argsort(every, kind="stable")
    gram, begin = np.unique(every[order], return_index=True)
    seen = np.zeros(1 << TABLE_BITS, dtype=bool)
    seen[(gram >> np.uint64(64 - TABLE_BITS)).astype(np.int64)] = True
    place = shift[passage_of] + offset  # in the item
    anchor = np.where(place % (FRAGMENT - q + 1) == 0, home[passage_of] + offset, 0)
    anchor[np.setdiff1d(np.arange(len(anchor)), np.unique(anchor, return_index=True)[1])] = 0  # passages overlap: once each
    return Index(np.array(own, dtype=np.int64), size, edits, size - q + 1 - q * edits, home, gram, np.append(begin, len(every)), passage_of[order], offset[order], seen, np.concatenate(whole), anchor[order], short)


def shared_grams(ix: Index, line: np.ndarray, q: int = Q, most: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(place in ``line``, posting) of all q-grams shared with passages, in slices of about ``most`` pairs.

    ``line``: texts in a row, parted by code point 0.  A slice holds all pairs of
    some passages in a stretch of ``line``; each part of ``line`` of twice a
    passage's length lies within one stretch whole.
    """
    most = most or PAIRS
    value = gram_hashes(line, q)
    at = np.flatnonzero(ix.seen[(value >> np.uint64(64 - TABLE_BITS)).astype(np.int64)])
    if not len(at) or not len(ix.gram):
        return
    spot = np.minimum(np.searchsorted(ix.gram, value[at]), len(ix.gram) - 1)
    real = ix.gram[spot] == value[at]
    at, spot = at[real], spot[real]
    over = 2 * int(ix.size.max())
    total = np.concatenate(([0], np.cumsum(ix.begin[spot + 1] - ix.begin[spot])))
    i = 0
    while i < len(at):
        j = max(int(np.searchsorted(total, total[i] + most, side="right")) - 1, int(np.searchsorted(at, at[i] + 2 * over)))
        yield from _pairs(ix, at[i:j], ix.begin[spot[i:j]], ix.begin[spot[i:j] + 1], 0, len(ix.size), most)
        i = int(np.searchsorted(at, at[j] - over)) if j < len(at) else j


def _pairs(ix: Index, at: np.ndarray, low: np.ndarray, high: np.ndarray, first: int, last: int, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Of postings low to high at each place, those of passages first to last."""
    many = high - low
    if many.sum() <= most or last - first == 1:
        at = np.repeat(at, many)
        if len(at):
            yield at, np.repeat(low, many) + np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
        return
    middle, cut, ends = (first + last) // 2, low.copy(), high.copy()
    while (wide := cut < ends).any():  # the first posting of passage ``middle`` or later
        half = (cut + ends) // 2
        less = wide & (ix.passage[np.minimum(half, len(ix.passage) - 1)] < middle)
        cut = np.where(less, half + 1, cut)
        ends = np.where(wide & ~less, half, ends)
    for a, b, x, y in ((low, cut, first, middle), (cut, high, middle, last)):
        some = a < b
        yield from _pairs(ix, at[some], a[some], b[some], x, y, most)


def fragments(ix: Index, line: np.ndarray, at: np.ndarray, own: np.ndarray, q: int = Q) -> tuple[np.ndarray, np.ndarray]:
    """Of q-grams of ``line`` at ``at`` that stand in ``whole`` at ``own``: starts and ends in ``line`` of the runs shared around them."""
    reach = []
    for first, step in ((-1, -1), (q, 1)):
        length, alive, j = np.zeros(len(at), np.int64), np.arange(len(at)), first
        while len(alive):
            place = at[alive] + j
            inside = (place >= 0) & (place < len(line))
            same = inside & (line[np.clip(place, 0, len(line) - 1)] == ix.whole[own[alive] + j])
            alive = alive[same]  # items end in ITEM_STOP, which no text holds
            length[alive] += 1
            j += step
        reach.append(length)
    return at - reach[0], at + q + reach[1]


def candidates(ix: Index, starts: np.ndarray, at: np.ndarray, posting: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, passage, first diagonal of a band in ``line``) with enough shared q-grams; ``starts``: of the texts in ``line``."""
    passage, offset = ix.passage[posting], ix.offset[posting]
    text = np.searchsorted(starts, at, side="right") - 1
    apart = 4 * int(ix.size.max()) + 64  # diagonals of neighbouring texts are moved so far apart that no band holds two texts'
    diagonal = at - offset + text * apart
    least = int(diagonal.min())
    half = ix.edits[passage] + 1
    band = (diagonal - least) // half + 1  # the band that begins here, and the one before
    wide, long = int(band.max()) + 1, int(ix.size.max())
    key = (passage * wide + band) * long + offset
    key = np.concatenate((key, key - long))
    key.sort()
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]  # each q-gram of the passage counts once for a band
    group = key // long
    begin = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
    count = np.diff(np.append(begin, len(group)))
    passage, band = group[begin] // wide, group[begin] % wide
    enough = count >= ix.needed[passage]
    passage, band = passage[enough], band[enough]
    diagonal = (band - 1) * (ix.edits[passage] + 1) + least
    moved = starts + np.arange(len(starts)) * apart
    text = np.maximum(0, np.searchsorted(moved, diagonal + 2 * (ix.edits[passage] + 1) + long, side="right") - 1)
    return text, passage, diagonal - text * apart


def align(ix: Index, line: np.ndarray, begin: np.ndarray, end: np.ndarray, passage: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Banded alignment of many passages, each against the text at begin to end of ``line``: least edits and the end of that part.

    A passage's band holds 2 (e + 1) diagonals from ``diagonal`` and e more on
    either side; its part of the text begins in the band.  More than e edits
    come out as e + 1, with no end.
    """
    edits, size = ix.edits[passage], ix.size[passage]
    far, width = (edits + 1)[:, None], int((4 * edits + 2).max())
    j = np.arange(width)[None, :]
    banned = j >= (4 * edits + 2)[:, None]
    begin, end, first = begin[:, None], end[:, None], (diagonal - edits)[:, None]
    cost = np.where((first + j >= begin) & (first + j <= end) & ~banned, 0, far)
    done, where = np.zeros(len(passage), np.int64), np.zeros(len(passage), np.int64)
    rows = np.arange(len(passage))
    for row in range(int(size.max()) + 1):
        over = size[rows] == row
        if over.any():
            best = cost[over].argmin(axis=1)
            done[rows[over]] = cost[over][np.arange(len(best)), best]
            where[rows[over]] = first[over, 0] + row + best
        keep = ~over & (cost < far).any(axis=1)
        done[rows[~over & ~keep]] = far[~over & ~keep, 0]
        if not keep.all():
            rows, cost, far, begin, end, first, banned = (x[keep] for x in (rows, cost, far, begin, end, first, banned))
        if not len(rows):
            break
        place = first + row + j
        inside = (place >= begin) & (place < end)
        same = inside & (line[np.clip(place, 0, len(line) - 1)] == ix.whole[ix.home[passage[rows]] + row][:, None])
        step = np.where(inside, cost + ~same, far)
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)  # the passage has a symbol more
        step = np.where((place + 1 >= begin) & (place + 1 <= end) & ~banned, step, far)
        cost = np.minimum(np.minimum.accumulate(step - j, axis=1) + j, far)  # the line has symbols more
        cost[banned] = np.broadcast_to(far, cost.shape)[banned]
    return done, where


def scan(ix: Index, texts: list[str | None]) -> list[tuple[int, int, int, int, int]]:
    """(text, item, edits, start, end) of each text's best passage of each item, or longest fragment if it has no passage; positions in the normal form."""
    lines = [plain(x or "") for x in texts]
    stop = np.zeros(1, np.uint32)
    whole = np.concatenate([y for x in lines for y in (x, stop)] + [stop]).astype(np.uint32)
    sizes = np.array([len(x) for x in lines], dtype=np.int64)
    starts = np.cumsum(sizes + 1) - sizes - 1
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    runs: dict[tuple[int, int], tuple[int, int, int]] = {}
    if ix.short:
        for t, x in enumerate(lines):
            if 0 < len(x) < Q:
                best.update({(t, item): (0, 0, len(x)) for item in ix.short.get(x.astype(np.uint32).tobytes(), ())})
    for at, posting in shared_grams(ix, whole):
        text, passage, diagonal = candidates(ix, starts, at, posting)
        order = np.lexsort((passage, diagonal, text))
        for some in np.array_split(order, -(-len(order) // ALIGNED) or 1):
            some = [i for i in some if best.get((int(text[i]), int(ix.item[passage[i]])), (1,))[0]]  # others are found without an edit already
            if not some:
                continue
            t, p = text[some], passage[some]
            cost, end = align(ix, whole, starts[t], starts[t] + sizes[t], p, diagonal[some])
            good = cost <= ix.edits[p]
            for a, b, c, e, n in zip(*(x[good].tolist() for x in (t, ix.item[p], cost, end - starts[t], ix.size[p]))):
                best[a, b] = min(best.get((a, b), (c, e, e)), (c, max(0, e - n), e))
        own = ix.anchor[posting]
        at, own, item = at[own > 0], own[own > 0], ix.item[ix.passage[posting[own > 0]]]
        text = np.searchsorted(starts, at, side="right") - 1
        open_ = np.array([pair not in best for pair in zip(text.tolist(), item.tolist())], dtype=bool)
        start, end = fragments(ix, whole, at[open_], own[open_])
        for t, i, a, b in zip(text[open_].tolist(), item[open_].tolist(), start.tolist(), end.tolist()):
            if b - a >= FRAGMENT:
                low = int(starts[t])
                runs[t, i] = min(runs.get((t, i), (0, 0, 0)), (a - b, a - low, b - low))
    found = {key: (0, start, end) for key, (_, start, end) in runs.items()} | best
    return [(*key, *value) for key, value in sorted(found.items())]


def item_blocks(benchmark: DataFrame, item_id: str, text: str, limit: int = BLOCK_CHARS) -> Iterator[tuple[list, Index]]:
    """The benchmark in blocks of bounded size, read one partition at a time: the ids, by number, and the index."""
    rows = ((r[0], r[1]) for r in benchmark.select(item_id, text).toLocalIterator())
    for block in portions(rows, lambda r: len(r[1] or "") + 1, limit):
        numbers: dict = {}
        numbered = [numbers.setdefault(item, len(numbers)) for item, _ in block]
        yield list(numbers), index([x for _, x in block], numbered)


def _judged(docs: DataFrame, ix: Index, columns: list[str], text: str, run_batch, schema) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(arrays_of(ix))
    place = columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = Index(*shared.value)
        for batch in batches:
            at, found = 0, []
            for some in portions(batch.column(place).to_pylist(), lambda x: len(x or "") + 1, PORTION):
                found += [(at + t, *rest) for t, *rest in scan(ix, some)]
                at += len(some)
            yield from run_batch(batch, found)

    return docs.select(*columns).mapInArrow(run, schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """One row for each document and benchmark item of which it holds a passage: doc_id, item_id, edits, start, end_.

    ``edits``, ``start`` and ``end_`` are of the item's best passage in the
    document, in code points of the normal form; ties go to the first.  Without
    one they are of its longest verbatim run of ``FRAGMENT`` code points or more
    (no edits).  An item of under ``Q`` normal code points matches a document
    that is nothing else; null and empty texts match nothing.  Ids are of any
    type; rows with a null item_id are one item.  Repeated documents are reported
    each; an item_id that repeats within a block of ``BLOCK_CHARS`` is one item,
    and is reported for each block that it stands in.  Other columns are ignored;
    an empty table on either side gives an empty result.  Of several blocks each
    is done before the next is read, so that the driver holds one at a time.
    """
    spark, item_type = docs.sparkSession, benchmark.schema[item_id].dataType
    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("item_id", item_type), *(T.StructField(x, T.LongType()) for x in ("edits", "start", "end_"))])
    own, kind = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), to_arrow_type(item_type)
    parts: list[DataFrame] = []
    for ids, ix in item_blocks(benchmark, item_id, item_text):
        names = spark.sparkContext.broadcast(ids)

        def rows(batch: pa.RecordBatch, found: list, names=names) -> Iterator[pa.RecordBatch]:
            if found:
                text_at, item, *rest = zip(*found)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(text_at)), pa.array([names.value[i] for i in item], kind), *(pa.array(x, pa.int64()) for x in rest)], names=schema.names)

        found = _judged(own, ix, ["doc_id", "text"], "text", rows, schema)
        parts.append(materialize(found, "leaks") if parts or len(ix.whole) > BLOCK_CHARS // 2 else found)
    return reduce(DataFrame.unionByName, parts) if parts else spark.createDataFrame([], schema)


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text") -> DataFrame:
    """The rows of ``docs`` that hold no passage of the benchmark, whole and unshuffled.

    One pass for each block of the benchmark; a block after the first begins
    with what the one before left, written to the shared folder.
    """

    def rows(batch: pa.RecordBatch, found: list) -> Iterator[pa.RecordBatch]:
        keep = np.ones(batch.num_rows, dtype=bool)
        keep[[f[0] for f in found]] = False
        yield batch.filter(pa.array(keep))

    out, blocks = docs, 0
    for _, ix in item_blocks(benchmark, item_id, item_text):
        out = _judged(materialize(out, "clean") if blocks else out, ix, docs.columns, text, rows, docs.schema)
        blocks += 1
    return out
