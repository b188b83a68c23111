"""the language model's code and gates come from all training documents, whole."""

import numpy as np
from pyspark.sql import functions as F

from flowledger.llm import lm


def test_code_and_gates_come_from_all_training_text(spark, sf_dir):
    """Codes are those of all pairs; at the gates, the loss over all choices, each taken off the counts, is flat."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    train = [(r.text or "").encode() for r in docs.where(F.crc32(F.col("doc_id").cast("string")) % 10 != 0).select("text").collect()]
    fitted = lm.train(docs)
    code = lm.prefix_code(train, fitted.code.bits)
    assert (fitted.code.length == code.length).all() and all((a == b).all() for a, b in zip(fitted.code.part, code.part))
    counts = np.zeros((int(lm.table_starts(code.bits)[-1]), 2), np.int64)
    lm.count(code, train, counts)
    slope = lm.RIDGE * (fitted.gates - 0.4)
    for some in lm.portions((p for x in train for p in lm.pieces(x)), lm.weight, 1_000_000):
        found = lm.choices(code, some)[1]
        sides = [counts[start + (i >> 1)] for start, i in zip(lm.table_starts(code.bits), found)]
        own = [np.take_along_axis(c, (i & 1)[:, None], 1)[:, 0] - 1 for c, i in zip(sides, found)]
        other = [np.take_along_axis(c, 1 - (i & 1)[:, None], 1)[:, 0] for c, i in zip(sides, found)]
        level = [np.minimum(np.where(a + b > 0, np.floor(np.log2(np.maximum(a + b, 1))).astype(int) + 1, 0), lm.BUCKETS - 1) for a, b in zip(own, other)]
        odds = [np.log((a + lm.SMOOTH) / (b + lm.SMOOTH)) for a, b in zip(own, other)]
        miss = 1 / (1 + np.exp(sum(fitted.gates[k][level[k]] * odds[k] for k in range(3))))
        slope -= np.stack([np.bincount(level[k], weights=miss * odds[k], minlength=lm.BUCKETS) for k in range(3)])
    total = sum(map(len, train))
    assert total > 400_000 and abs(slope).max() < 1e-4 * total
