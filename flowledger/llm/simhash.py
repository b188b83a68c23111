"""SimHash near-duplicates through pivot distance tables.

A document's fingerprint holds, for each of 64 bits, the majority over the
XXH64 values of its 4-word shingles.  Fingerprints link at Hamming distance
``radius`` or less, and linked fingerprints form components.

How links are found, without comparing everything with everything:

* Six blocks of bits; two fingerprints within distance 4 agree on two blocks at
  least, so each is filed under its 15 pairs of blocks.  This only deals the
  work out, it loses no link.
* Within a file, a table holds each fingerprint's Hamming distances to
  ``PIVOTS`` reference fingerprints.  By the triangle inequality two
  fingerprints whose coordinates differ by more than the radius anywhere can't
  link: rows are sorted by the first coordinate and compared only while that one
  stays within the radius, then the other coordinates discard pairs, and
  survivors are verified bit by bit.
* Pairs that are connected already are skipped and only a spanning forest
  leaves the task, so a large group of near copies makes few rows.
* A file of over ``chunk`` rows is filed again by the bits that its rows need not
  share: six blocks of those, of which two at least agree once more.  A file that
  is crowded still after ``LEVELS`` such rounds is cut into chunks, and each pair
  of chunks is a file of its own.

Components come from repeated minimum labels with pointer jumping; every round
is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, materialize

SEED = 42
WORDS = 4
RADIUS = 4
PIVOTS = 24
BLOCKS = 6
CHUNK = 2048
LEVELS = 3


def pivot_table(fp: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Hamming distances of each fingerprint (rows) to each reference fingerprint (columns)."""
    return np.bitwise_count(fp[:, None] ^ pivots[None, :]).astype(np.int8)


def reference_fingerprints(count: int = PIVOTS) -> np.ndarray:
    return np.array([xxhash.xxh64_intdigest(f"pivot {i}", SEED) for i in range(count)], dtype=np.uint64)


def fingerprint_of(text: bytes | None, words: int = WORDS, block: int = 1 << 20) -> int:
    """The unsigned fingerprint of a text in UTF-8; zero where it has no word."""
    tokens = (text or b"").lower().split()
    if not tokens:
        return 0
    line = b" ".join(tokens)
    ends = np.cumsum(np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    k = min(words, len(tokens))
    a, b = starts[: len(tokens) - k + 1].tolist(), ends[k - 1 :].tolist()
    h, ones = xxhash.xxh64_intdigest, np.zeros(64, dtype=np.int64)
    for at in range(0, len(a), block):
        values = np.array([h(line[x:y], SEED) for x, y in zip(a[at : at + block], b[at : at + block])], dtype="<u8")
        ones += np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(a), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, row: Column | None = None) -> DataFrame:
    """``doc_id``, the signed 64-bit ``fp`` and ``row`` (a long; null unless given) of every row; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = [fingerprint_of(x, words) for x in batch.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(values, dtype=np.uint64).view(np.int64), pa.int64()), batch.column(2)], names=["doc_id", "fp", "row"])

    kind = docs.schema[doc_id].dataType
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), (F.lit(None) if row is None else row).cast("long").alias("row"))
    return own.mapInArrow(run, T.StructType([T.StructField("doc_id", kind), T.StructField("fp", T.LongType()), T.StructField("row", T.LongType())]))


def _merge(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unites the sets of a[k] and b[k]; afterwards every label is a root again."""
    while a.size:
        la, lb = label[a], label[b]
        apart = la != lb
        a, b = a[apart], b[apart]
        if not a.size:
            return
        np.minimum.at(label, np.maximum(la[apart], lb[apart]), np.minimum(la[apart], lb[apart]))
        while True:
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def link_files(key: np.ndarray, fp: np.ndarray, pivots: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links among fingerprints that share a key, as two aligned arrays."""
    table = pivot_table(fp, pivots)
    order = np.lexsort((table[:, 0], key))
    key, fp, table = key[order], fp[order], np.ascontiguousarray(table[order].T)
    n = len(fp)
    change = np.flatnonzero(np.concatenate((key[1:] != key[:-1], [True])))
    end = np.repeat(change + 1, np.diff(np.concatenate(([-1], change))))
    label, first = np.arange(n), table[0].astype(np.int16)
    i, step = np.flatnonzero(np.arange(n) + 1 < end), 1
    while i.size:
        i = i[first[i + step] - first[i] <= radius]
        a = i[label[i] != label[i + step]]
        for column in table[1:]:
            a = a[np.abs(column[a + step] - column[a]) <= radius]
        a = a[np.bitwise_count(fp[a] ^ fp[a + step]) <= radius]
        _merge(label, a, a + step)
        step += 1
        i = i[i + step < end[i]]
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def block_masks(bits: list[int], blocks: int, shared: int) -> list[list[int]]:
    """Each choice of ``shared`` of ``blocks`` nearly equal runs of ``bits``, as a list of bits."""
    cut = [bits[len(bits) * i // blocks : len(bits) * (i + 1) // blocks] for i in range(blocks)]
    return [sum(pick, []) for pick in combinations(cut, shared)]


def as_long(bits: list[int]) -> int:
    mask = sum(1 << b for b in bits)
    return mask - (1 << 64) if mask >> 63 else mask


def links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, chunk: int = CHUNK, levels: int = LEVELS) -> DataFrame:
    """Edges (u, v) that connect exactly what links of ``radius`` or less bits among the distinct ``fp`` connect."""
    picks = [[]]  # by number: the bits that a file's rows share by design
    files, crowd = None, nodes.select("fp", F.lit(0).alias("pick"), F.lit(0).cast("long").alias("key"))
    for level in range(levels):
        more = [[p + m for m in block_masks([b for b in range(64) if b not in p], blocks, blocks - radius)] for p in picks]
        wide = len(more[0])
        masks = F.split(F.lit(",".join(str(as_long(m)) for each in more for m in each)), ",").cast("array<bigint>")
        numbers = F.transform(F.sequence(F.lit(0), F.lit(wide - 1)), lambda t: F.col("pick") * wide + t)
        keys = F.transform(numbers, lambda n: F.struct(n.cast("int").alias("pick"), F.xxhash64("key", n, F.col("fp").bitwiseAND(F.get(masks, n.cast("int")))).alias("key")))
        filed = crowd.select("fp", F.explode(keys).alias("k")).select("fp", "k.pick", "k.key")
        crowded = materialize(filed.groupBy("key").count().where(F.col("count") > chunk), "simhash-crowded")
        known = crowded.limit(10_001).count()
        if not known:
            files = filed.select("fp", "key") if files is None else files.unionByName(filed.select("fp", "key"))
            break
        side = F.broadcast(crowded) if known <= 10_000 else crowded
        calm = filed.join(side, "key", "left_anti").select("fp", "key")
        files = calm if files is None else files.unionByName(calm)
        crowd = filed.join(side, "key")
        picks = [m for each in more for m in each]
        if level + 1 < levels:
            crowd = materialize(crowd.select("fp", "pick", "key"), "simhash-crowd")
    else:
        parts = F.ceil(F.col("count") / chunk).cast("int")
        own = F.pmod(F.xxhash64("fp", F.lit("chunk")), parts).cast("int")
        others = F.filter(F.transform(F.sequence(F.lit(0), parts - 1), lambda j: F.struct(F.least(own, j).alias("a"), F.greatest(own, j).alias("b"))), lambda p: p["a"] != p["b"])
        files = files.unionByName(crowd.select("fp", "key", F.explode(others).alias("p")).select("fp", F.xxhash64("key", "p.a", "p.b").alias("key")))

    pivots = reference_fingerprints()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, fps, held = [], [], 0

        def flush(last: bool) -> Iterator[pa.RecordBatch]:
            nonlocal keys, fps, held
            key, fp = np.concatenate(keys), np.concatenate(fps)
            cut = len(key) if last else int(np.searchsorted(key, key[-1]))
            u, v = link_files(key[:cut], fp[:cut], pivots, radius)
            keys, fps, held = [key[cut:]], [fp[cut:]], len(key) - cut
            if len(u):
                yield pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

        for batch in batches:
            if batch.num_rows:
                fps.append(batch.column(0).to_numpy().view(np.uint64))
                keys.append(batch.column(1).to_numpy())
                held += batch.num_rows
                if held > 200_000:
                    yield from flush(False)
        if held:
            yield from flush(True)

    return files.repartition("key").sortWithinPartitions("key").mapInArrow(run, "u long, v long").where(F.col("u") != F.col("v")).distinct()


def connected(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, label) for each end of ``edges``: equal labels just for connected nodes, the smallest node of each component."""
    both = materialize(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct(), "edges")
    labels = materialize(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("label")), "labels")
    before = labels  # the table of the last round, whatever is selected from it
    for _ in range(most_rounds):
        heard = both.join(labels, both.v == labels.node).groupBy("u").agg(F.min("label").alias("heard"))
        lower = labels.join(heard, labels.node == heard.u).select("node", F.col("label").alias("was"), F.least("label", "heard").alias("mid"))
        target = labels.select(F.col("node").alias("mid"), F.col("label").alias("next"))
        labels = materialize(lower.join(target, "mid").select("node", "was", F.least("mid", "next").alias("label")), "labels", before)
        before = labels
        if labels.where(F.col("was") != F.col("label")).isEmpty():
            return labels.select("node", "label")
        labels = labels.select("node", "label")
    raise RuntimeError(f"components still change after {most_rounds} rounds")


def _components(marked: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """(fp, first) for each fingerprint and for each component, of the (doc_id, row) that comes first in it; null ids last."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row"))
    nodes = materialize(marked.groupBy("fp").agg(first.alias("first")), "simhash-nodes")
    named = connected(links(nodes.select("fp"), radius))
    heads = materialize(named.join(nodes, named.node == nodes.fp).groupBy("label").agg(F.min("first").alias("head")), "simhash-first")
    linked = named.join(heads, "label").select(F.col("node").alias("fp"), "head")
    every = materialize(nodes.join(linked, "fp", "left").select("fp", F.coalesce("head", "first").alias("first"), (F.col("head").isNull() | (F.col("head") == F.col("first"))).alias("leads")), "simhash-named")
    return every.select("fp", "first"), every.where("leads").select("fp", "first")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id of its component).

    Null and empty texts, and texts of white space, have fingerprint zero and
    link like others.  A text of fewer than ``words`` words is one shingle.
    Repeated rows stay, each with the same values.  Rows with a null doc_id link
    too but name a component only if it has no other id (then null).  An empty
    table gives an empty one; other columns of ``docs`` are ignored.
    """
    marked = materialize(fingerprints(docs, doc_id, text, words), "simhash")
    each, _ = _components(marked, radius)
    return marked.join(each, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", radius: int = RADIUS, words: int = WORDS) -> DataFrame:
    """One row of ``docs`` for each component of near duplicates: that of the smallest doc_id, null ids last.

    Rows are told apart by id and a hash of all columns, so of rows that repeat
    an id with other texts each is judged by its own text; of rows with the
    smallest id in one component that with the smallest hash stays, and of rows
    alike in every column one.  The choice is the same on every run.
    """
    mark, head_id, head_mark = fresh(docs, "_mark", "_head_id", "_head_mark")
    whole = F.xxhash64(*[F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, T.MapType) else F.col(f"`{f.name}`") for f in docs.schema])
    marked = materialize(fingerprints(docs, doc_id, text, words, whole), "simhash")
    _, heads = _components(marked, radius)
    heads = heads.select(F.col("first.doc_id").alias(head_id), F.col("first.row").alias(head_mark))
    # A merge join at every size: rows to keep are as many as documents, so they are never sent around.
    own = docs.withColumn(mark, whole)
    kept = own.join(heads.hint("merge"), own[doc_id].eqNullSafe(F.col(head_id)) & (own[mark] == F.col(head_mark)), "left_semi")
    again = marked.groupBy("doc_id", "row").count().where(F.col("count") > 1).select(F.col("doc_id").alias(head_id), F.col("row").alias(head_mark))
    if not again.isEmpty():
        same = kept[doc_id].eqNullSafe(F.col(head_id)) & (kept[mark] == F.col(head_mark))
        kept = kept.join(again, same, "left_anti").unionByName(kept.join(again, same, "left_semi").dropDuplicates([doc_id, mark]))
    return kept.drop(mark)
