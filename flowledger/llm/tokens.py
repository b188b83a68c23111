"""Token counts by a separator scan over flat token files.

Texts are encoded into files that are nothing but token ids in a row, with an
end-of-document id after each document, and no index of where documents begin.
A file is a table's rows (file, block, tokens): blocks of ``BLOCK`` tokens that
cut documents anywhere.  Counting them back:

1. every block is searched for the separator id in one vectorised pass;
2. blocks' sizes, numbers of separators and last separators go through a prefix
   scan, within super-blocks of ``SUPER`` blocks and then over those, which tells
   each block how many documents ended before it and where the last one did;
3. a document's count is the distance of neighbouring separators less one.

The order in which ids were written is kept beside the files, in rows of
(file, first, ids), and joined to the documents' ordinals.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, portions

RANKS = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's own pattern of pieces.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
END = 50_256
BLOCK = 1 << 16
SUPER = 1024
IDS = 4096
PORTION = 1_000_000


def encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
    return tiktoken.Encoding("flat", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def write_tokens(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_path: str = RANKS, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """The flat token files (file, block, tokens as 16-bit little-endian ids) and the written order (file, first, ids).

    One file a task.  The vocabulary file is read by the driver and sent along (under 2 MB).
    """
    shared = docs.sparkSession.sparkContext.broadcast(Path(ranks_path).read_bytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, file = encoder(shared.value).encode_ordinary_batch, TaskContext.get().partitionId()
        held, number, first = np.zeros(0, dtype="<u2"), 0, 0

        def row(block_no, tokens, at, ids) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([block_no], pa.int64()), pa.array([tokens], pa.binary()), pa.array([at], pa.int64()), pa.array([ids], pa.list_(id_type))], names=names)

        for batch in batches:
            id_type = batch.column(0).type
            for some in portions(batch.column(1).to_pylist(), lambda x: len(x or "") + 1, PORTION):
                parts = [held]
                for tokens in encode([x or "" for x in some], num_threads=1):
                    parts.append(np.array([*tokens, END], dtype="<u2"))
                held = np.concatenate(parts)
                while len(held) >= block:
                    yield row(number, held[:block].tobytes(), None, None)
                    held, number = held[block:], number + 1
            for at in range(0, batch.num_rows, IDS):
                yield row(None, None, first + at, batch.column(0).slice(at, IDS).to_pylist())
            first += batch.num_rows
        if len(held):
            yield row(number, held.tobytes(), None, None)

    names = ["file", "block", "tokens", "first", "ids"]
    kinds = [T.LongType(), T.LongType(), T.BinaryType(), T.LongType(), T.ArrayType(docs.schema[doc_id].dataType)]
    both = materialize(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, T.StructType([T.StructField(*x) for x in zip(names, kinds)])), "tokens")
    return both.where(F.col("block").isNotNull()).select("file", "block", "tokens"), both.where(F.col("first").isNotNull()).select("file", "first", "ids")


def block_separators(files: DataFrame, end: int = END) -> DataFrame:
    """file, block, size and the places of separators (``at``, from 0) of each block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            arrays = [np.frombuffer(x or b"", dtype="<u2") for x in batch.column(2).to_pylist()]
            places = [np.flatnonzero(a == end).astype(np.int64) for a in arrays]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(a) for a in arrays], pa.int64()), pa.array(places, pa.list_(pa.int64()))], names=["file", "block", "size", "at"])

    return files.select("file", "block", "tokens").mapInArrow(run, "file long, block long, size long, at array<long>")


def scan(files: DataFrame, end: int = END) -> DataFrame:
    """file, ordinal (from 0), n_tokens, ended of each document of flat token files.

    What follows a file's last separator, if anything, is a document that isn't
    ended.  Two separators in a row enclose a document of no tokens.  Null and
    empty blocks have no tokens.  No files give an empty result.
    """
    found = materialize(block_separators(files, end), "separators")
    facts = found.select("file", "block", F.floor(F.col("block") / SUPER).alias("super"), "size", F.size("at").cast("long").alias("ends"), F.try_element_at("at", F.lit(-1)).alias("last"))
    # A separator's place counted from the super-block's start, and then from the file's.
    inner = Window.partitionBy("file", "super").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    summed = facts.withColumns({"skip": F.coalesce(F.sum("size").over(inner), F.lit(0)), "before": F.coalesce(F.sum("ends").over(inner), F.lit(0))})
    summed = summed.withColumn("mark", F.col("skip") + F.col("last")).withColumn("prior", F.max("mark").over(inner))
    outer = Window.partitionBy("file").orderBy("super").rowsBetween(Window.unboundedPreceding, -1)
    supers = summed.groupBy("file", "super").agg(F.sum("size").alias("s"), F.sum("ends").alias("e"), F.max("mark").alias("m"))
    supers = supers.withColumns({"s0": F.coalesce(F.sum("s").over(outer), F.lit(0)), "e0": F.coalesce(F.sum("e").over(outer), F.lit(0))})
    supers = supers.withColumn("m0", F.max(F.col("s0") + F.col("m")).over(outer)).select("file", "super", "s0", "e0", "m0")
    placed = summed.join(supers, ["file", "super"]).select("file", "block", (F.col("s0") + F.col("skip")).alias("skip"), (F.col("e0") + F.col("before")).alias("before"), F.coalesce(F.col("s0") + F.col("prior"), "m0", F.lit(-1)).alias("prior"))
    one = found.join(placed, ["file", "block"]).select("file", "before", F.posexplode(F.transform("at", lambda x, i: x + F.col("skip") - F.when(i == 0, F.col("prior")).otherwise(F.get("at", i - 1) + F.col("skip")) - 1)).alias("i", "n_tokens"))
    whole = one.select("file", (F.col("before") + F.col("i")).alias("ordinal"), "n_tokens", F.lit(True).alias("ended"))
    files_end = supers.join(summed.groupBy("file", "super").agg(F.sum("size").alias("s"), F.sum("ends").alias("e"), F.max("mark").alias("m")), ["file", "super"]).groupBy("file").agg(F.max(F.col("s0") + F.col("s")).alias("size"), F.max(F.col("e0") + F.col("e")).alias("ordinal"), F.coalesce(F.max(F.col("s0") + F.col("m")), F.lit(-1)).alias("last"))
    rest = files_end.where(F.col("size") > F.col("last") + 1).select("file", "ordinal", (F.col("size") - F.col("last") - 1).alias("n_tokens"), F.lit(False).alias("ended"))
    return whole.unionByName(rest)


def token_counts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", ranks_path: str = RANKS) -> DataFrame:
    """doc_id and n_tokens of every document, from the flat files that its texts were written to.

    Null and empty texts have no tokens.  Rows that repeat stay, as do null ids;
    other columns are ignored; an empty table gives an empty one.
    """
    files, order = write_tokens(docs, doc_id, text, ranks_path)
    ids = order.select("file", "first", F.posexplode("ids").alias("i", "doc_id")).select("file", (F.col("first") + F.col("i")).alias("ordinal"), "doc_id")
    return ids.join(scan(files), ["file", "ordinal"]).select("doc_id", "n_tokens")
