"""Language-model scoring: online logistic mixing of hashed-context bit predictors, beside a word unigram base.

The model.  A text's bytes and one end symbol are written in prefix codes, one for
each preceding byte (from the counts of all pairs of neighbours in the training
documents), so that a symbol is a few binary choices.
For each choice, predictors of context ORDERS look up how often it went either
way after the same preceding bytes in all training documents; contexts are
hashed into tables whose size grows with the training text (``table_bits``; those
of one byte have a slot for every choice).  Their log odds, each multiplied by a gate that
depends on how many observations stand behind it, are combined in the logistic
domain by weights that adapt online to the text being scored, and the result is
the probability of the choice.  Weights move after every ``STEP`` choices (and
after every ``LANE`` bytes of the text, where a new step begins), by the sum of
the choices' gradients.  Gates are fitted on every choice of the training
documents, each seen with itself taken off the counts.  The weights start anew
with each text and adapt over all
of it: texts of like lengths are scored side by side, a stretch of each at a time,
and each text's weights go on from one stretch to the next, so that a score
depends on the text and the trained tables alone.  Scores are rounded to four
decimals.

Tables stay dealt out.  Documents go in chunks of about ``CHUNK`` bytes; a chunk's
distinct runs of bytes name the slots it needs, the tables' blocks are summed where
those requests meet them, and a chunk is scored beside its own slots.  Neither
the driver nor a task holds a whole table, but those of one byte.

The base.  Words' counts over all training documents.  A bounded number of the
most frequent words (all above a count, ``FREQUENT`` words at most) goes to
every task; other words are joined by word, so no word is dropped and a common
one makes no hot key.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrays_of, fold, materialize, portions

FOLDS = 10
END = 256
ORDERS = (1, 2, 4)
BITS = (17, 18, 20)  # of the smallest tables
SLOT_BYTES = (None, 2048, 256)  # training bytes for each slot; None: the table is complete
LANE = 160
STEP = 16  # a power of two
RATE = 0.03
PORTION = 60_000
PIECE = 1000 * LANE
AHEAD = 1_000_000
GROUP = 500
SCORED = 64_000_000
COUNTED = 4_000_000
SMALL = 20_000
CHUNK = 16_000_000  # bytes of text scored beside the same slots
HELD_GRAMS = 1_000_000  # distinct runs of bytes after which a chunk ends
BUCKET = 64_000_000  # training bytes for each bucket of runs
FITTED = 100_000  # runs whose choices make a row of the gates' fit
ROUNDS = 12
RIDGE = 50.0
FREQUENT = 100_000
LONGEST_WORD = 64
HELD_WORDS = 300_000
BLOCK = 1 << 14
ROWS = 1000
BUCKETS = 18
SMOOTH = 0.4


@dataclass
class Code:
    """For each preceding byte, a prefix code over 257 symbols.

    Symbol s after byte p makes ``length[257 * p + s]`` choices, the first at
    place ``at[257 * p + s]`` of ``part``: by order, the choice's and its
    outcome's share of the index into the order's table.
    """

    at: np.ndarray
    length: np.ndarray
    part: list[np.ndarray]
    bits: tuple[int, ...] = BITS


def table_bits(size: int) -> tuple[int, ...]:
    """By order: the bits of a slot's number after ``size`` bytes of training text, one more for each doubling.

    A choice of order 1 has a slot of its own.  Over 30 bits (256 GB of training
    text) hashes of 32 bits don't tell slots apart, and an error is raised.
    """
    out = tuple(least if each is None else max(least, math.ceil(math.log2(max(1, size / each)))) for least, each in zip(BITS, SLOT_BYTES))
    if max(out) > 30:
        raise ValueError(f"{size} bytes of training text need tables of over 2^30 slots")
    return out


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    return x ^ (x >> np.uint32(16))


def huffman(counts: list[int]) -> list[list[tuple[int, int]]]:
    """The (node, outcome) choices of each symbol, from the root."""
    heap = [(c, s) for s, c in enumerate(counts)]
    heapq.heapify(heap)
    up, number = {}, len(heap)
    while len(heap) > 1:
        (a, x), (b, y) = heapq.heappop(heap), heapq.heappop(heap)
        up[x], up[y] = (number - len(counts), 0), (number - len(counts), 1)
        heapq.heappush(heap, (a + b, number))
        number += 1
    paths = []
    for s in range(len(counts)):
        path, x = [], s
        while x in up:
            path.append(up[x])
            x = up[x][0] + len(counts)
        paths.append(path[::-1])
    return paths


def prefix_code(sample: list[bytes], table: tuple[int, ...] = BITS) -> Code:
    """The code of the pairs of neighbouring symbols in ``sample``."""
    pairs = np.zeros((256, END + 1), dtype=np.int64)
    for x in sample:
        line = np.frombuffer(b"\0" + x, dtype=np.uint8).astype(np.int64)
        np.add.at(pairs, (line, np.append(line[1:], END)), 1)
    return code_of(pairs, table)


def code_of(pairs: np.ndarray, table: tuple[int, ...] = BITS) -> Code:
    """Huffman's codes for pairs of neighbouring symbols, backed by their single symbols and one of each."""
    weights = pairs * 1000 + pairs.sum(axis=0) + 1
    at, length, node, bit = [], [], [], []
    for before in range(256):
        for path in huffman(weights[before].tolist()):
            at.append(len(node))
            length.append(len(path))
            node += [before << 8 | n for n, _ in path]
            bit += [b for _, b in path]
    node, bit = np.array(node, np.uint32), np.array(bit, np.uint32)
    part = []
    for order, bits in zip(ORDERS, table):
        free = np.uint32(31 - bits)
        part.append(2 * node + bit if order == 1 else scramble(node * np.uint32(7) + np.uint32(order)) & ~(np.uint32(1) << free) | bit << free)
    return Code(np.array(at, np.int32), np.array(length, np.int32), part, table)


Piece = tuple[bytes, bytes, bool]  # up to four bytes before, the bytes, whether the text ends here


def pieces(text: bytes) -> list[Piece]:
    """A text in pieces of ``PIECE`` bytes, so that no text is too long for a task."""
    pad, n = max(ORDERS), max(1, -(-len(text) // PIECE))
    return [(text[max(0, i * PIECE - pad) : i * PIECE], text[i * PIECE : (i + 1) * PIECE], i == n - 1) for i in range(n)]


def weight(piece: Piece) -> int:
    return len(piece[1]) + 16


def coded_places(some: list[Piece]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All pieces' bytes in a row; of each symbol its place there and the symbol; symbols by piece."""
    pad = max(ORDERS)
    line = np.frombuffer(b"".join(x for before, body, _ in some for x in (before.rjust(pad, b"\0"), body, b"\0")), dtype=np.uint8)
    last = np.array([p[2] for p in some])
    held = np.array([len(p[1]) for p in some], dtype=np.int64)
    sizes = held + last
    ends = np.cumsum(sizes)
    first = np.cumsum(held + pad + 1) - held - 1
    coded = np.arange(int(ends[-1])) + np.repeat(first - (ends - sizes), sizes)
    symbol = line[coded].astype(np.int64)
    symbol[(ends - 1)[last]] = END
    return line, coded, symbol, sizes


def paths(code: Code, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Choices by symbol (257 times the byte before, plus the symbol) and each choice's place in ``code.part``."""
    lengths = code.length[symbol]
    path = np.repeat(code.at[symbol] - (np.cumsum(lengths) - lengths), lengths)
    path += np.arange(len(path))
    return lengths, path


def indices(code: Code, k: int, path: np.ndarray, lengths: np.ndarray, context: np.ndarray) -> np.ndarray:
    """Each choice's index in the table of the order numbered k: twice the slot, plus the outcome.  ``context``: scrambled, by symbol."""
    if ORDERS[k] == 1:
        return code.part[k].take(path, mode="clip").astype(np.intp)
    free = np.uint32(31 - code.bits[k])
    mixed = np.repeat(context & ~(np.uint32(1) << free), lengths)
    mixed ^= code.part[k].take(path, mode="clip")
    mixed >>= free
    return mixed.astype(np.intp)


def choices(code: Code, some: list[Piece]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Of all pieces in a row: choices by symbol; by order, each choice's index (twice the slot, plus the outcome); symbols by piece."""
    line, coded, symbol, sizes = coded_places(some)
    lengths, path = paths(code, symbol + 257 * line[coded - 1].astype(np.int64))
    wide, value, done, out = line.astype(np.uint32) + np.uint32(1), np.zeros(len(line), dtype=np.uint32), 0, []
    for k, order in enumerate(ORDERS):
        for back in range(done + 1, order + 1):
            value[back:] += wide[:-back]  # right from place ``pad`` on, where what is coded begins
            value *= np.uint32(0x9E3779B1)
        done = order
        out.append(indices(code, k, path, lengths, scramble(value).take(coded, mode="clip") if order > 1 else value))
    return lengths, out, sizes


def table_starts(table: tuple[int, ...] = BITS) -> np.ndarray:
    return np.cumsum([0] + [1 << b for b in table])


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The distinct runs of four bytes and the symbol after them (in 32 and 9 bits) in ``texts``, and how often each occurs."""
    held = []
    for some in portions((p for x in texts for p in pieces(x)), weight, PORTION):
        line, coded, key, _ = coded_places(some)
        for back in range(1, 5):
            key += line[coded - back].astype(np.int64) << (8 * back + 1)
        held.append(key)
    every = np.concatenate([*held, np.zeros(0, np.int64)])
    every.sort()
    begin = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1]))) if len(every) else np.zeros(0, np.int64)
    return every[begin], np.diff(np.append(begin, len(every)))


def count(code: Code, texts: list[bytes], into: np.ndarray) -> None:
    """Adds the choices of ``texts`` to ``into`` (slots of all orders, outcome 0 or 1).

    Symbols are counted first, each after the four bytes before it; the choices
    of each distinct one are then worked out once.
    """
    key, many = grams(texts)
    lengths, found = gram_choices(code, key)
    many = np.repeat(many, lengths).astype(into.dtype)
    for start, bits, each in zip(table_starts(code.bits), code.bits, found):
        np.add.at(into[start : start + (1 << bits)].reshape(-1), each, many)


def gram_choices(code: Code, key: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
    """As ``choices``, of symbols that each stand after four bytes (as in ``grams``): choices by symbol; by order, each one's index."""
    lengths, path = paths(code, (key & 511) + 257 * (key >> 9 & 255))
    value, done, out = np.zeros(len(key), dtype=np.uint32), 0, []
    for k, order in enumerate(ORDERS):
        for back in range(done + 1, order + 1):
            value += (key >> (8 * back + 1) & 255).astype(np.uint32) + np.uint32(1)
            value *= np.uint32(0x9E3779B1)
        done = order
        out.append(indices(code, k, path, lengths, scramble(value)))
    return lengths, out


def log_odds(counts: np.ndarray) -> np.ndarray:
    return np.log((counts[:, 1] + SMOOTH) / (counts[:, 0] + SMOOTH)).astype(np.float32)


def bucket(counts: np.ndarray) -> np.ndarray:
    """By the number of observations: 0, 1, 2-3, 4-7, ..."""
    return np.minimum(np.frexp(counts.sum(axis=1).astype(np.float64))[1], BUCKETS - 1)


def moments(gates: np.ndarray, odds: np.ndarray, level: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Of choices that occur ``many`` times each (odds of the outcome and level by order): the loss's gradient by gate and, below it, its second derivatives."""
    spots = level.astype(np.int64) + BUCKETS * np.arange(len(ORDERS))[:, None]
    flat, n = gates.ravel(), gates.size
    miss = 1 / (1 + np.exp(np.clip((flat[spots] * odds).sum(axis=0), -30, 30)))
    out = np.zeros((n + 1, n))
    out[0] = -sum(np.bincount(spots[k], weights=many * miss * odds[k], minlength=n) for k in range(len(ORDERS)))
    both = many * miss * (1 - miss)
    for k in range(len(ORDERS)):
        for j in range(len(ORDERS)):
            out[1:] += np.bincount(spots[k] * n + spots[j], weights=both * odds[k] * odds[j], minlength=n * n).reshape(n, n)
    return out


def fit_gates(fitted: DataFrame) -> np.ndarray:
    """Gates by order and bucket, by Newton's method over all choices (column ``choices``: rows' odds, levels and numbers), drawn to 0.4 by ``RIDGE``."""
    gates = np.full((len(ORDERS), BUCKETS), 0.4)
    for _ in range(ROUNDS):

        def run(batches: Iterator[pa.RecordBatch], gates: np.ndarray = gates) -> Iterator[pa.RecordBatch]:
            total = np.zeros((gates.size + 1, gates.size))
            for batch in batches:
                for data in batch.column(0).to_pylist():
                    n, orders = len(data) // (8 + 5 * len(ORDERS)), len(ORDERS)
                    many = np.frombuffer(data, np.float64, n)
                    odds = np.frombuffer(data, np.float32, n * orders, 8 * n).reshape(orders, n)
                    total += moments(gates, odds, np.frombuffer(data, np.uint8, n * orders, (8 + 4 * orders) * n).reshape(orders, n), many)
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["total"])

        total = sum(np.frombuffer(r["total"]).reshape(gates.size + 1, gates.size) for r in fitted.select("choices").mapInArrow(run, "total binary").toLocalIterator())
        if np.ndim(total) == 0:
            break
        step = np.linalg.solve(total[1:] + RIDGE * np.eye(gates.size), total[0] + RIDGE * (gates.ravel() - 0.4))
        gates = gates - np.clip(step, -1, 1).reshape(gates.shape)
        if abs(step).max() < 1e-3:
            break
    return np.round(gates, 6)


def gated_odds(counts: np.ndarray, gates: np.ndarray, table: tuple[int, ...] = BITS) -> list[np.ndarray]:
    """By order and index of a choice: the gated log odds of its outcome."""
    edges = table_starts(table)
    odds, level = log_odds(counts), bucket(counts)
    return [np.stack([-x, x], axis=1).ravel().astype(np.float32) for k, (a, b) in enumerate(zip(edges[:-1], edges[1:])) for x in [odds[a:b] * gates[k][level[a:b]]]]


@dataclass
class Chunk:
    """What a chunk's texts need of the tables: its distinct runs (as in ``grams``), ascending; choices by run and the first one's place; gated odds of choices by order."""

    keys: np.ndarray
    length: np.ndarray
    at: np.ndarray
    odds: list[np.ndarray]

    def __len__(self) -> int:
        return len(self.odds)


def chunk_of(code: Code, first: np.ndarray, gates: np.ndarray, keys: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> Chunk:
    """``first``: counts of the order of one byte; ``slots``, ``counts``: those of the others that ``keys`` touch, numbered through all orders."""
    lengths, sides, odds = *slot_counts(code, first, keys, slots, counts), []
    for k, (own, other) in enumerate(sides):
        both = np.stack([other, own], axis=1)
        odds.append((log_odds(both) * gates[k][bucket(both)]).astype(np.float32))
    return Chunk(keys, lengths, np.cumsum(lengths) - lengths, odds)


def slot_counts(code: Code, first: np.ndarray, keys: np.ndarray, slots: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Choices by run of ``keys``; by order, how often each choice had its outcome and how often the other."""
    order = np.argsort(slots, kind="stable")
    slots, counts = slots[order], counts[order]
    lengths, found = gram_choices(code, keys)
    sides = []
    for k, (start, each) in enumerate(zip(table_starts(code.bits), found)):
        spot, table = (each >> 1, first) if ORDERS[k] == 1 else (np.searchsorted(slots, start + (each >> 1)), counts)
        sides.append((table[spot, each & 1].astype(np.float64), table[spot, 1 - (each & 1)].astype(np.float64)))
    return lengths, sides


def runs_of(chunk: Chunk, some: list[Piece]) -> list[np.ndarray]:
    """By piece: the number in ``chunk.keys`` of each symbol's run."""
    line, coded, key, sizes = coded_places(some)
    for back in range(1, 5):
        key += line[coded - back].astype(np.int64) << (8 * back + 1)
    found = pa.array(key).dictionary_encode()
    distinct = found.dictionary.to_numpy()
    order = np.argsort(distinct)
    spot = np.empty(len(order), dtype=np.int32)
    spot[order] = np.searchsorted(chunk.keys, distinct[order])
    return np.split(spot[found.indices.to_numpy()], np.cumsum(sizes)[:-1])


def looked_up(code: Code, tables: list[np.ndarray] | Chunk, some: list[Piece] | list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """As ``choices``, with each choice's gated odds instead of its index.  ``some``: with a chunk, pieces as ``runs_of`` gives them."""
    if isinstance(tables, list):
        lengths, found, sizes = choices(code, some)
        return lengths, [table.take(part, mode="clip") for table, part in zip(tables, found)], sizes
    run = np.concatenate(some)
    lengths = tables.length[run]
    path = np.repeat(tables.at[run] - (np.cumsum(lengths) - lengths), lengths)
    path += np.arange(len(path))
    return lengths, [x.take(path, mode="clip") for x in tables.odds], np.array([len(x) for x in some], dtype=np.int64)


def score_texts(code: Code, tables: list[np.ndarray] | Chunk, texts: list[bytes]) -> np.ndarray:
    """Natural log of the model's probability of each text and its end.

    ``GROUP`` texts at most, of like lengths, advance together by a multiple of
    ``LANE`` bytes at a time; how they are cut and grouped changes no score.
    """
    out, pad = np.zeros(len(texts)), max(ORDERS)

    def cuts(at: int, span: int, n: int) -> list[Piece]:
        return [(x[max(0, at - pad) : at], x[at : at + span], len(x) <= at + span) for x in (texts[i] for i in group[:n])]

    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    for g in range(0, len(order), GROUP):
        group = order[g : g + GROUP]
        adapted, at, n = np.ones((len(tables), len(group)), dtype=np.float32), 0, len(group)
        ahead, until = [], 0
        while n:
            span = max(LANE, min(PIECE, PORTION // n) // LANE * LANE)
            if isinstance(tables, list):
                cut = cuts(at, span, n)
            else:
                if at + span > until:  # runs are looked up for several stretches at once
                    begin, until = at, at + max(1, AHEAD // (n * span)) * span
                    ahead = runs_of(tables, cuts(at, until - at, n))
                cut = [x[at - begin :] if len(texts[i]) <= at + span else x[at - begin : at - begin + span] for i, x in zip(group, ahead[:n])]
            out[group[:n]] += score_pieces(code, tables, cut, adapted[:, :n])
            at += span
            while n and len(texts[group[n - 1]]) <= at:
                n -= 1
    return out


def steps(lengths: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """By lane of all pieces in a row: its choices, the place of the first of them, its piece, and how many steps come before it there.

    A lane is ``LANE`` symbols or what is left of a piece; its steps hold
    ``STEP`` choices and the last one what is left.
    """
    at = np.append(0, np.cumsum(lengths))
    lanes = -(-sizes // LANE)  # no piece is without a symbol
    piece = np.repeat(np.arange(len(sizes)), lanes)
    first = np.cumsum(lanes) - lanes
    begin = at[(np.cumsum(sizes) - sizes)[piece] + (np.arange(len(piece)) - first[piece]) * LANE]
    many = np.diff(np.append(begin, at[-1]))
    taken = -(-many // STEP)
    before = np.cumsum(taken) - taken
    return many, begin, piece, before - before[first][piece]


def score_pieces(code: Code, tables: list[np.ndarray] | Chunk, cut: list[Piece], adapted: np.ndarray | None = None) -> np.ndarray:
    """As ``score_texts``, by piece.  ``adapted``: the weights of each piece's text (by order and piece), which go on from there in place."""
    if adapted is None:
        adapted = np.ones((len(tables), len(cut)), dtype=np.float32)
    found = [looked_up(code, tables, some) for some in (portions(cut, weight, SMALL) if isinstance(tables, list) else [cut])]
    lengths, sizes = np.concatenate([f[0] for f in found]), np.concatenate([f[2] for f in found])
    many, begin, piece, before = steps(lengths, sizes)
    size = np.zeros(len(cut), dtype=np.int64)
    np.maximum.at(size, piece, before - (-many // STEP))
    order = np.argsort(-size, kind="stable")
    rank = np.empty(len(order), dtype=np.int64)
    rank[order] = np.arange(len(order))
    width, depth = len(order), int(size.max())
    total = np.bincount(piece, weights=many, minlength=len(cut)).astype(np.int64)
    line = len(tables) * STEP * width  # of a step; in it a choice's first order, the others' are STEP * width further each
    rest = np.arange(int(many.sum())) - np.repeat(begin, many)
    place = np.repeat(before * line + rank[piece], many)
    place += (rest // STEP) * line
    rest &= STEP - 1
    rest *= width
    place += rest
    x = np.zeros((depth, len(tables), STEP, width), dtype=np.float32)
    for k in range(len(tables)):
        flat, done = x.reshape(-1)[k * STEP * width :], 0
        for f in found:
            part = f[1][k]
            flat[place[done : done + len(part)]] = part
            done += len(part)
    active = np.searchsorted(-size[order], -np.arange(depth), side="left").tolist()
    weights = adapted[:, order]
    sure = np.ones((depth, STEP, width), dtype=np.float32)
    for t, n in enumerate(active):
        part, w, p = x[t, :, :, :n], weights[:, :n], sure[t, :, :n]
        each = part * w[:, None, :]
        miss = each[0]
        for k in range(1, len(tables)):
            miss += each[k]
        np.maximum(miss, -30, out=miss)
        np.negative(miss, out=miss)
        np.exp(miss, out=miss)
        miss += 1
        np.reciprocal(miss, out=p)
        np.multiply(p, -RATE, out=miss)
        miss += RATE
        np.multiply(part, miss, out=each)
        half = STEP // 2  # summed in halves, in one order however many texts stand side by side
        while half:
            each = each[:, :half] + each[:, half:]
            half //= 2
        w += each[:, 0]
    adapted[:, order] = weights
    out = np.empty(width)
    out[order] = np.log(np.multiply.reduce(sure, axis=1, dtype=np.float64)).sum(axis=0)  # a step's product is above 1e-210
    return out + (size * STEP - total) * math.log(2)  # places of a step without a choice count as even odds


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The words of all texts in a row, A-Z made small, and the number of each one's text."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))  # space and 9 to 13 in ASCII; white space at an end gives an empty word
    words, owner = lists.flatten().cast(pa.binary()), pc.list_parent_indices(lists)
    real = pc.greater(pc.binary_length(words), 0)
    return words.filter(real), owner.filter(real).to_numpy(zero_copy_only=False).astype(np.int64)


@dataclass
class Trained:
    code: Code
    first: np.ndarray  # counts of the order of one byte
    gates: np.ndarray
    slots: DataFrame  # who (a chunk; below zero a bucket of training runs), block, data: places in the block and counts
    texts: DataFrame  # chunk, doc_id, text: every document
    runs: DataFrame  # chunk, keys
    vocabulary: DataFrame  # word (binary), c
    ends: int  # training documents
    tokens: int
    distinct: int

    @property
    def tables(self) -> list[np.ndarray]:
        """Whole tables of gated odds, on the driver: to look into small ones; no query asks for them."""
        counts = np.zeros((int(table_starts(self.code.bits)[-1]), 2), dtype=np.float64)
        counts[: len(self.first)] = self.first
        for r in self.slots.where(F.col("who") < 0).toLocalIterator():
            spot, many = unpacked(r["block"], r["data"])
            counts[spot] = many
        return gated_odds(counts, self.gates, self.code.bits)


def packed(slots: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """By block of the ascending ``slots``: the rows of ``values``, then places in the block."""
    block = slots // BLOCK
    edges = np.flatnonzero(np.diff(block, prepend=-1, append=-1)) if len(slots) else np.zeros(0, np.int64)
    place = (slots % BLOCK).astype(np.uint16)
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        yield int(block[a]), b"".join(v[a:b].tobytes() for v in values) + place[a:b].tobytes()


def unpacked(block: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Slots, and how often either outcome was seen (32-bit floats, as the odds are)."""
    n = len(data) // 10
    return np.frombuffer(data, np.uint16, n, 8 * n).astype(np.int64) + block * BLOCK, np.frombuffer(data, np.float32, 2 * n).reshape(n, 2)


def in_batches(df: DataFrame, name: str) -> DataFrame:
    """``materialize`` with ``ROWS`` rows in a batch to Python, so that neither side holds many texts at once."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = conf.get(key)
    conf.set(key, str(ROWS))
    try:
        return materialize(df, name)
    finally:
        conf.set(key, before)


def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, with their numbers summed."""
    table = pa.table([pa.array(np.concatenate([p[i] for p in parts])) for i in (0, 1)], names=["key", "many"]).group_by("key", use_threads=False).aggregate([("many", "sum")])
    key, many = table.column("key").to_numpy(), table.column("many_sum").to_numpy()
    order = np.argsort(key)
    return key[order], many[order]


def gather(docs: DataFrame, buckets: int) -> DataFrame:
    """One pass over all documents (doc_id, text, trains): texts by chunk, runs of each chunk, training runs by bucket, words' and documents' counts."""
    kind = docs.schema["doc_id"].dataType
    fields = [("chunk", T.LongType()), ("doc_id", kind), ("text", T.StringType()), ("bucket", T.IntegerType()), ("keys", T.BinaryType()), ("many", T.BinaryType()), ("word", T.BinaryType()), ("c", T.LongType())]
    names = [f[0] for f in fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        chunk, words, runs, held, ends, types = TaskContext.get().partitionId() << 32, [], [], 0, 0, None

        def rows(n: int, **columns) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([columns[x] if x in columns else pa.nulls(n, t) for x, t in zip(names, types)], names=names)

        def summed() -> pa.Table:
            return pa.concat_tables(words).group_by("word", use_threads=False).aggregate([("c", "sum")]).select(["word", "c_sum"]).rename_columns(["word", "c"])

        def told(table: pa.Table) -> Iterator[pa.RecordBatch]:
            words.clear()
            for part in table.combine_chunks().to_batches(max_chunksize=HELD_WORDS):
                yield rows(part.num_rows, word=part.column("word"), c=part.column("c"))

        def ended() -> Iterator[pa.RecordBatch]:
            key, many = merged(runs)
            runs.clear()
            yield rows(1, chunk=pa.array([chunk], pa.int64()), keys=pa.array([key.tobytes()], pa.binary()))
            key, many = key[many > 0], many[many > 0]
            own = scramble((key >> 9).astype(np.uint32)) % np.uint32(buckets)
            order = np.argsort(own, kind="stable")
            edges = np.searchsorted(own[order], np.arange(buckets + 1))
            for b in np.flatnonzero(np.diff(edges)).tolist():
                at = order[edges[b] : edges[b + 1]]
                yield rows(1, bucket=pa.array([b], pa.int32()), keys=pa.array([key[at].tobytes()], pa.binary()), many=pa.array([many[at].tobytes()], pa.binary()))

        for batch in batches:
            if not batch.num_rows:
                continue
            types = types or [pa.int64(), batch.column(0).type, batch.column(1).type, pa.int32(), pa.binary(), pa.binary(), pa.binary(), pa.int64()]
            at, trains = 0, batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for some in portions(batch.column(1).cast(pa.binary()).to_pylist(), len, COUNTED):
                n = len(some)
                ids, texts, own = batch.column(0).slice(at, n), batch.column(1).slice(at, n), trains[at : at + n]
                at += n
                yield rows(n, chunk=pa.array(np.full(n, chunk)), doc_id=ids, text=texts)
                found = words_of(texts.filter(pa.array(own)))[0].value_counts()
                words.append(pa.table([found.field("values"), found.field("counts")], names=["word", "c"]))
                if sum(x.num_rows for x in words) > 3 * HELD_WORDS:
                    words[:] = [summed()]
                    if words[0].num_rows > HELD_WORDS:
                        yield from told(words[0])
                ends += int(own.sum())
                for side in (True, False):
                    key, many = grams([x for x, t in zip(some, own.tolist()) if t == side])
                    runs.append((key, many if side else np.zeros_like(many)))
                held += sum(map(len, some))
                if sum(len(x[0]) for x in runs) > 3 * HELD_GRAMS:
                    runs[:] = [merged(runs)]
                if held >= CHUNK or len(runs) == 1 and len(runs[0][0]) > HELD_GRAMS:
                    yield from ended()
                    chunk, held = chunk + 1, 0
        if runs:
            yield from ended()
        if words:
            yield from told(summed())
        if ends:
            yield rows(1, c=pa.array([ends], pa.int64()))

    return in_batches(docs.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields])), "lm-counts")


def sum_runs(gathered: DataFrame) -> DataFrame:
    """bucket, keys, many: the distinct runs of all training documents, in rows of ``FITTED`` at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []

        def told() -> Iterator[pa.RecordBatch]:
            key, many = merged(held)
            held.clear()
            for a in range(0, len(key), FITTED):
                yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), *(pa.array([x[a : a + FITTED].tobytes()], pa.binary()) for x in (key, many))], names=["bucket", "keys", "many"])

        for batch in batches:
            for b, key, many in zip(*(c.to_pylist() for c in batch.columns)):
                if b != bucket and held:
                    yield from told()
                bucket = b
                held.append((np.frombuffer(key, np.int64), np.frombuffer(many, np.int64)))
                if len(held) > 1 and sum(len(x[0]) for x in held) > 3 * max(HELD_GRAMS, len(held[0][0])):
                    held[:] = [merged(held)]
        if held:
            yield from told()

    own = gathered.where(F.col("bucket").isNotNull()).select("bucket", "keys", "many")
    return materialize(own.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "bucket int, keys binary, many binary"), "lm-runs")


def pair_counts(runs: DataFrame) -> np.ndarray:
    """How often each symbol stands after each byte in all training documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(256 * 257, dtype=np.int64)
        for batch in batches:
            for key, many in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                key = np.frombuffer(key, np.int64)
                np.add.at(total, (key & 511) + 257 * (key >> 9 & 255), np.frombuffer(many, np.int64))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["pair", "c"])

    out = np.zeros(256 * 257, dtype=np.int64)
    for r in runs.select("keys", "many").mapInArrow(run, "pair int, c long").groupBy("pair").agg(F.sum("c").alias("c")).collect():
        out[r["pair"]] = r["c"]
    return out.reshape(256, 257)


def slots_of(shared, wanted: DataFrame) -> DataFrame:
    """who, block, data: the summed counts of the slots that the runs of each row of ``wanted`` (who, keys, many) touch; ``many`` is null where none are to be added."""

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(*shared.value[0])
        starts = table_starts(code.bits)
        for batch in batches:
            for who, key, many in zip(*(c.to_pylist() for c in batch.columns)):
                lengths, found = gram_choices(code, np.frombuffer(key, np.int64))
                spots = np.concatenate([2 * start + each for order, start, each in zip(ORDERS, starts, found) if order > 1])
                if many is None:
                    slots, values = np.unique(spots >> 1), []
                else:
                    slots, at = np.unique(spots >> 1, return_inverse=True)
                    values = [np.zeros((len(slots), 2), dtype=np.int64)]
                    np.add.at(values[0].reshape(-1), 2 * at + (spots & 1), np.tile(np.repeat(np.frombuffer(many, np.int64), lengths), sum(order > 1 for order in ORDERS)))
                out = list(packed(slots, *values))
                n = len(out)
                yield pa.RecordBatch.from_arrays([pa.array([who] * n, pa.int64()), pa.array([x[0] for x in out], pa.int32()), pa.array([many is not None] * n), pa.array([x[1] for x in out], pa.binary())], names=["who", "block", "adds", "data"])

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, asked = None, None, []

        def told() -> Iterator[pa.RecordBatch]:
            some = total.astype(np.float32)
            for part in portions(asked, lambda x: 5 * len(x[1]), COUNTED):
                data = [some[np.frombuffer(places, np.uint16)].tobytes() + places for _, places in part]
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in part], pa.int64()), pa.array([block] * len(part), pa.int32()), pa.array(data, pa.binary())], names=["who", "block", "data"])
            asked.clear()

        for batch in batches:
            for who, b, adds, data in zip(*(c.to_pylist() for c in batch.columns)):
                if b != block:
                    if block is not None:
                        yield from told()
                    block, total = b, np.zeros((BLOCK, 2), dtype=np.int64)
                if adds:
                    n = len(data) // 18
                    data, counts = data[16 * n :], np.frombuffer(data, np.int64, 2 * n).reshape(n, 2)
                    total[np.frombuffer(data, np.uint16)] += counts
                asked.append((who, data))
        if block is not None:
            yield from told()

    rows = wanted.mapInArrow(touched, "who long, block int, adds boolean, data binary")
    return materialize(rows.repartition("block").sortWithinPartitions("block").mapInArrow(answered, "who long, block int, data binary"), "lm-slots")


def beside(slots: DataFrame, *others: DataFrame) -> DataFrame:
    """Rows of all (each with ``who``) in one table, those of a ``who`` in a row and in the order given; missing columns are null."""
    out = slots.withColumn("part", F.lit(0))
    for i, x in enumerate(others):
        out = out.unionByName(x.withColumn("part", F.lit(i + 1)), allowMissingColumns=True)
    return out.repartition("who").sortWithinPartitions("who", "part")


def gate_rows(shared, slots: DataFrame, runs: DataFrame) -> DataFrame:
    """Every choice of the training documents, each distinct one once: odds and level by order with one occurrence taken off, and how often it occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, first = Code(*shared.value[0]), shared.value[1]
        who, held = None, {}
        for batch in batches:
            for w, block, data, key, many in zip(*(c.to_pylist() for c in batch.columns)):
                if w != who:
                    who, held = w, {}
                if key is None:
                    held.setdefault(block, []).append(unpacked(block, data))
                    continue
                found = [x for part in held.values() for x in part]
                slots, counts = (np.concatenate([x[i] for x in found]) for i in (0, 1))
                key = np.frombuffer(key, np.int64)
                lengths, sides = slot_counts(code, first, key, slots, counts)
                both = [np.stack([other, np.maximum(own - 1, 0)], axis=1) for own, other in sides]
                odds, level = np.stack([log_odds(x) for x in both]), np.stack([bucket(x) for x in both]).astype(np.uint8)
                data = np.repeat(np.frombuffer(many, np.int64), lengths).astype(np.float64).tobytes() + odds.tobytes() + level.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([data], pa.binary())], names=["choices"])

    rows = beside(slots.where(F.col("who") < 0), runs).select("who", "block", "data", "keys", "many")
    return materialize(rows.mapInArrow(run, "choices binary"), "lm-choices")


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> Trained:
    """Counts, codes and gates from every document whose fold isn't 0; beside them all documents by chunk, with the slots each chunk needs."""
    spark = docs.sparkSession
    every = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), (fold(F.col(doc_id), FOLDS) != 0).alias("trains"))
    size = every.where("trains").agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    table = table_bits(size)
    gathered = gather(every, max(12, -(-size // BUCKET)))
    runs = sum_runs(gathered)
    pairs = pair_counts(runs)
    code = code_of(pairs, table)
    lengths, path = paths(code, np.arange(256 * 257))
    first = np.zeros((1 << table[0], 2), dtype=np.int64)
    np.add.at(first.reshape(-1), indices(code, 0, path, lengths, lengths), np.repeat(pairs.ravel(), lengths))
    shared = spark.sparkContext.broadcast((arrays_of(code), first))
    runs = runs.select((-1 - F.col("bucket").cast("long")).alias("who"), "keys", "many")
    chunks = gathered.where(F.col("chunk").isNotNull() & F.col("keys").isNotNull()).select(F.col("chunk").alias("who"), "keys")
    slots = slots_of(shared, runs.unionByName(chunks.withColumn("many", F.lit(None).cast("binary"))))
    gates = fit_gates(gate_rows(shared, slots, runs))
    vocabulary = materialize(gathered.where(F.col("word").isNotNull()).groupBy("word").agg(F.sum("c").alias("c")), "lm-words")
    ends = gathered.where(F.col("word").isNull() & F.col("c").isNotNull()).agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c")).first()["c"]
    total = vocabulary.agg(F.count("*").alias("v"), F.coalesce(F.sum("c"), F.lit(0)).alias("n")).first()
    texts = gathered.where(F.col("text").isNotNull()).select(F.col("chunk").alias("who"), "doc_id", "text")
    return Trained(code, first, gates, slots, texts, chunks, vocabulary, ends, total["n"] + ends, total["v"] + (ends > 0))


def frequent_words(vocabulary: DataFrame, most: int = FREQUENT) -> dict[bytes, int]:
    """All words of ``LONGEST_WORD`` bytes at most above a count that ``most`` of them at most reach."""
    vocabulary = vocabulary.where(F.length("word") <= LONGEST_WORD)
    levels = vocabulary.groupBy(F.floor(F.log2("c") * 4).cast("int").alias("level")).count().collect()
    total, least = 0, None
    for r in sorted(levels, key=lambda r: -r["level"]):
        total += r["count"]
        if total > most:
            break
        least = r["level"]
    if least is None:
        return {}
    return {bytes(r["word"]): r["c"] for r in vocabulary.where(F.floor(F.log2("c") * 4).cast("int") >= least).collect()}


def score(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_frequent: int = FREQUENT) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte.

    Null texts count as empty: one token, the end.  Null ids are in the fold of
    the empty text.  Repeated rows each get a row with the same values; equal
    texts score alike.  Other columns are ignored.  An empty table gives an
    empty one.
    """
    spark = docs.sparkSession
    fitted = train(docs, doc_id, text)
    n, smooth = fitted.tokens, 0.1
    denominator = n + smooth * (fitted.distinct + 1)
    frequent = frequent_words(fitted.vocabulary, most_frequent)
    shared = spark.sparkContext.broadcast((arrays_of(fitted.code), fitted.first, fitted.gates, list(frequent), np.log10((np.array([*frequent.values(), 0]) + smooth) / denominator)))
    end = float(np.log10((fitted.ends + smooth) / denominator))
    ends = fitted.ends

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        code, first, gates, frequent, logs = shared.value
        code, frequent = Code(*code), pa.array(frequent, pa.binary())
        row, who, held, chunk, texts = TaskContext.get().partitionId() << 34, None, [], None, []

        def ended() -> Iterator[pa.RecordBatch]:
            nonlocal row
            if texts:
                ids, lines = (pa.concat_arrays([x[i] for x in texts]) for i in (0, 1))
                texts.clear()
                for out in scored_texts(code, chunk, frequent, logs, ids, lines, row):
                    yield out
                row += len(ids)
                pa.default_memory_pool().release_unused()

        for batch in batches:
            whos, parts = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edges = np.flatnonzero(np.concatenate(([True], (whos[1:] != whos[:-1]) | (parts[1:] != parts[:-1]), [True]))) if len(whos) else np.zeros(0, np.int64)
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                some = batch.slice(a, b - a)
                if whos[a] != who:
                    yield from ended()
                    who, held, chunk = whos[a], [], None
                if parts[a] == 0:
                    held += [unpacked(*x) for x in zip(some.column(2).to_pylist(), some.column(3).to_pylist())]
                elif parts[a] == 1:
                    slots, counts = (np.concatenate([x[i] for x in held]) for i in (0, 1))
                    chunk, held = chunk_of(code, first, gates, np.frombuffer(some.column(4)[0].as_py(), np.int64), slots, counts), []
                else:
                    texts.append((some.column(5), some.column(6)))
        yield from ended()

    def scored_texts(code: Code, chunk: Chunk, frequent: pa.Array, logs: np.ndarray, ids: pa.Array, lines: pa.Array, row: int) -> Iterator[pa.RecordBatch]:
        at, texts, scores = 0, lines.cast(pa.binary()).to_pylist(), {}
        for many in portions(dict.fromkeys(texts), len, SCORED):  # equal texts score alike
            scores.update(zip(many, score_texts(code, chunk, many)))
        for some in portions(texts, len, COUNTED):
            n = len(some)
            words, owner = words_of(lines.slice(at, n))
            spot = pc.index_in(words, value_set=frequent)
            held = spot.is_valid().to_numpy(zero_copy_only=False)
            size, known = np.bincount(owner, minlength=n), np.bincount(owner[held], minlength=n)
            base = np.bincount(owner[held], weights=logs[spot.drop_null().to_numpy()], minlength=n)
            rare = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(size - known)), pa.int32()), words.filter(pa.array(~held)))
            natural = np.array([scores[x] for x in some])
            yield pa.RecordBatch.from_arrays(
                [ids.slice(at, n), pa.array(np.arange(row + at, row + at + n)), pa.array(size + 1, pa.int64()), pa.array(known + (ends > 0), pa.int64()), pa.array(base + end, pa.float64()), pa.array(np.round(natural / np.log(10), 4)), pa.array([len(x) for x in some], pa.int64()), rare],
                names=["doc_id", "row", "n_tokens", "known", "base", "score", "n_bytes", "rare"],
            )
            at += n

    kind = docs.schema[doc_id].dataType
    fields = [("doc_id", kind), ("row", T.LongType()), ("n_tokens", T.LongType()), ("known", T.LongType()), ("base", T.DoubleType()), ("score", T.DoubleType()), ("n_bytes", T.LongType()), ("rare", T.ArrayType(T.BinaryType()))]
    rows = beside(fitted.slots.where(F.col("who") >= 0), fitted.runs, fitted.texts).select("who", "part", "block", "data", "keys", "doc_id", "text")
    scored = in_batches(rows.mapInArrow(run, T.StructType([T.StructField(*f) for f in fields])), "lm-scored")
    rare = scored.select("row", F.explode("rare").alias("word"))
    c = F.coalesce("c", F.lit(0))
    sums = rare.join(fitted.vocabulary, "word", "left").groupBy("row").agg(F.sum((c > 0).cast("long")).alias("more"), F.sum(F.log10((c + smooth) / denominator)).alias("rest"))
    return scored.join(sums, "row", "left").select(
        "doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "n_tokens",
        (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rest", F.lit(0.0))).alias("base_score"), "score",
        (-F.col("score") * float(np.log2(10)) / F.greatest("n_bytes", F.lit(1))).alias("bits_per_byte"),
    )
