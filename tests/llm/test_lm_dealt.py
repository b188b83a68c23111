"""the language model's tables stay dealt out, on the driver as in tasks."""

import itertools
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from flowledger.llm import lm


def test_driver_holds_no_table(spark, sf_dir, monkeypatch):
    """Tables of 2^25 slots, which took 16 bytes a slot on the driver and more to be sent."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(60)
    monkeypatch.setattr(lm, "BITS", (17, 24, 25))
    assert lm.table_bits(1) == (17, 24, 25)
    tracemalloc.start()
    try:
        got = lm.score(docs).collect()
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert len(got) == 60 and all(r.score < 0 for r in got) and peak < 250e6


def test_chunks_score_as_whole_tables(spark, sf_dir, monkeypatch):
    """Many small chunks, texts whose ends meet a stretch's end, long ones and copies: the same scores as from whole tables."""
    own = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").limit(150).collect()]
    odd = [" ".join(t for _, t in own)[:n] for n in (0, 1, lm.LANE - 1, lm.LANE, 3 * lm.LANE, 120 * lm.LANE, 400_000)]
    docs = spark.createDataFrame([*own, *((10_000_000 + i, t) for i, t in enumerate(odd + odd))], "doc_id long, text string").repartition(3).localCheckpoint()
    monkeypatch.setattr(lm, "CHUNK", 100_000)
    monkeypatch.setattr(lm, "COUNTED", 50_000)
    monkeypatch.setattr(lm, "BUCKET", 20_000)
    monkeypatch.setattr(lm, "FITTED", 1000)
    fitted = lm.train(docs)
    assert fitted.runs.count() > 5
    tables, held = fitted.tables, {r.doc_id: r.score for r in lm.score(docs).collect()}
    texts = {r.doc_id: r.text.encode() for r in docs.collect()}
    expected = lm.score_texts(fitted.code, tables, list(texts.values())) / np.log(10)
    assert len(held) == len(texts) and np.allclose([held[d] for d in texts], expected, rtol=0, atol=1e-4)
    train = [t.encode() for t, in docs.where(F.crc32(F.col("doc_id").cast("string")) % 10 != 0).select("text").collect()]
    counts = np.zeros((int(lm.table_starts(fitted.code.bits)[-1]), 2), np.int64)
    lm.count(fitted.code, train, counts)
    for got, plain in zip(tables, lm.gated_odds(counts, fitted.gates, fitted.code.bits)):
        assert np.allclose(got, plain, rtol=1e-5, atol=1e-6)
    assert all(a != b for a, b in itertools.pairwise(sorted(r.who for r in fitted.runs.collect())))
