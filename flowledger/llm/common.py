"""Helpers that several training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import fields

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: list[str] = []

WORD_BREAKS = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``.

    Where a session has none, a temporary folder is made once for the process if
    all executors are threads of it (unit tests); on a cluster that is an error.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not _own_dir:
        _own_dir.append(tempfile.mkdtemp(prefix="flowledger-"))
    return "file://" + _own_dir[0]


def materialize(df: DataFrame, name: str, replaces: DataFrame | None = None) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back: lineage ends there, and lost executors lose nothing.

    ``replaces``: a table of an earlier call that nothing needs any more; it is
    deleted once the new one is written.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if replaces is not None:
        for old in {f.rsplit("/", 1)[0] for f in replaces.inputFiles()}:
            where = spark._jvm.org.apache.hadoop.fs.Path(old)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
    return spark.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """``names``, with underscores added where ``df`` has such a column already (in any case of letters)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def fold(doc_id: Column, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % parts


def bounded_sample(df: DataFrame, doc_id: str, text: str, per_key: int, chars: int, keys: list[str] = (), max_rows: int = 4096, all_chars: int = 12_000_000) -> DataFrame:
    """``keys`` and the first ``chars`` characters of ``text``: ``per_key`` rows at most for each value of ``keys``, the same on every run.

    Rows are dealt by a hash of the id into ``per_key`` cells; the smallest hash
    of each cell is chosen, and of the rows that share it (ids that repeat or are
    null) the one whose text has the smallest hash, so that a cell gives one row.
    Where keys are many, each has fewer cells, so that ``max_rows`` rows leave at
    most; of over ``max_rows`` keys those with the smallest hashes have one row.
    Where rows are many, each has fewer characters, so that ``all_chars`` leave
    at most.
    """
    spot = F.xxhash64(F.lit("sample"), F.col(doc_id).cast("string"))
    cell, tag = F.pmod(spot, F.lit(per_key)), F.xxhash64(*[F.col(k) for k in keys], spot)
    cells = df.groupBy(*keys, cell.alias("_cell")).agg(F.min(spot).alias("_spot"))
    named = cells.withColumn("_tag", F.xxhash64(*[F.col(k) for k in keys], "_spot"))
    tags = [r["_tag"] for r in named.select("_tag").limit(max_rows + 1).collect()]
    if len(tags) > max_rows:
        each = max(1, max_rows // cells.select(*keys).distinct().count())
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_spot"))
        few = named.withColumn("_rank", rank).where(F.col("_rank") <= each).orderBy("_rank", "_spot", "_tag")
        tags = [r["_tag"] for r in few.limit(max_rows).select("_tag").collect()]
    chars = min(chars, max(1, all_chars // max(1, len(tags))))
    chosen = df.where(tag.isin(tags)) if tags else df.limit(0)
    one = F.min(F.struct(F.xxhash64(F.col(text)), F.substring(F.col(text), 1, chars).alias("text")))
    return chosen.groupBy(*keys, cell.alias("_cell")).agg(one.alias("_one")).select(*keys, F.col("_one.text").alias("text"))


def arrays_of(value) -> tuple:
    """A dataclass's fields, to be broadcast: plain arrays need no module on the executors, instances of our classes would."""
    return tuple(getattr(value, f.name) for f in fields(value))


def portions(items: Iterable, weigh, limit: int) -> Iterator[list]:
    """Successive lists of ``items`` whose weights sum to about ``limit``; one heavy item may exceed it."""
    held, total = [], 0
    for x in items:
        w = weigh(x)
        if held and total + w > limit:
            yield held
            held, total = [], 0
        held.append(x)
        total += w
    if held:
        yield held
