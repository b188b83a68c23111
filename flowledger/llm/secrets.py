"""Secret scans: fixed patterns, and character Markov models for random strings.

Two first-order character models, one of random strings and one of ordinary
identifiers, are trained from labelled samples: random strings made by rule from
SHA-256 digests (hexadecimal, base 64, letters and digits), and identifiers from
words of a bounded sample of the corpus (alone, joined by underscores or
capitals, numbered, as paths), with numbers, dates and rulers made by rule.  A run of ``SHORTEST`` or more identifier characters whose
log-likelihood ratio is above ``THRESHOLD`` a character is a span of kind
``markov``, unless a fixed pattern has it already.

Everything is DataFrame functions; the models are one array of
``len(ALPHABET) + 1`` squared log ratios, folded into the plan.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_sample
from .spans import SPAN, blocked, bound, in_order, line, matches, overlaps

# The patterns of the contract and their kinds, in order.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{32,}+"
KINDS = ["assign", "access", "hex", "markov"]
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"

SHORTEST = 20
THRESHOLD = 0.8
SAMPLE_DOCS = 256
SAMPLE_CHARS = 2000
RANDOM_STRINGS = 3000
RULERS = ["-", "=", "_", "+", "/", "-=", "-+", "=+", "_-", "---+", "===+"]
RUN = rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{SHORTEST},}}+"


def base_spans(text: Column) -> Column:
    """Spans of the fixed patterns: assign, access and hex, each leftmost and non-overlapping within its kind."""
    long_value = lambda v: F.char_length(F.regexp_extract(v, ASSIGN, 1)) >= 8
    return F.concat(
        matches(text, ASSIGN, 0, long_value),
        matches(text, ACCESS, 1, lambda v: F.char_length(v) >= 16),
        matches(text, HEX, 2),
    )


def random_samples(spark: SparkSession, count: int = RANDOM_STRINGS) -> DataFrame:
    digest = F.sha2(F.concat(F.lit("random "), F.col("id").cast("string")).cast("binary"), 256)
    packed = F.base64(F.unhex(digest))
    return spark.range(count).select(
        F.explode(F.array(digest, F.substring(F.upper(digest), 1, 24), packed, F.regexp_replace(packed, "[+/=]", ""), F.translate(packed, "+/", "-_"))).alias("token")
    )


def ordinary_samples(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Words of the sample, alone, joined in pairs by an underscore, as Camel case and in capitals."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    start = F.regexp_replace("text", "[0-9a-f]{24,}", " ")
    words = bounded_sample(own, "doc_id", "text", SAMPLE_DOCS, SAMPLE_CHARS).select(F.regexp_extract_all(start, F.lit("[A-Za-z]{2,}"), F.lit(0)).alias("w"))
    pair = F.transform(F.slice("w", 2, 400), lambda x, i: F.struct(F.lower(F.get(F.col("w"), i)).alias("a"), F.lower(x).alias("b")))
    many = words.select(F.explode(pair).alias("p"))
    return many.select(F.explode(F.array(F.col("p.a"), F.initcap("p.a"), F.upper("p.a"), F.concat_ws("_", "p.a", "p.b"), F.concat_ws("-", "p.a", "p.b"), F.concat(F.initcap("p.a"), F.initcap("p.b")), F.concat(F.upper("p.a"), F.lit("_"), F.upper("p.b")), F.concat("p.a", "p.b"), *_numbered())).alias("token"))


def _numbered() -> list[Column]:
    """The pair as a path with a number, and its first word with a digit or two."""
    number = F.crc32(F.col("p.a").cast("binary")).cast("string")
    return [F.concat(F.lit("/"), "p.a", F.lit("/"), "p.b", F.lit("/"), F.upper("p.a"), F.lit("_"), number), F.concat("p.a", F.right(number, F.lit(2)), F.lit("/"), "p.b", F.lit("-"), F.right(number, F.lit(1)))]


def plain_samples(spark: SparkSession, count: int = RANDOM_STRINGS) -> DataFrame:
    """Numbers, dates alone and in paths, and rulers: long runs of these characters that are no secrets."""
    d = F.translate(F.sha2(F.concat(F.lit("plain "), F.col("id").cast("string")).cast("binary"), 256), "abcdef", "013579")
    year, month, day, clock = F.concat(F.lit("20"), F.substring(d, 1, 2)), F.concat(F.lit("0"), F.substring(d, 3, 1)), F.substring(d, 4, 2), F.substring(d, 6, 6)
    ruler = F.repeat(F.element_at(F.array(*[F.lit(x) for x in RULERS]), (F.col("id") % len(RULERS) + 1).cast("int")), 12)
    return spark.range(count).select(F.explode(F.array(F.substring(d, 1, 30), F.concat_ws("-", year, month, day, clock), F.concat_ws("/", F.lit(""), year, month, day, clock), F.concat_ws("_", F.concat(year, month, day), clock), ruler)).alias("token"))


def marks(token: Column) -> Column:
    """Each character's number in ALPHABET, from 1; 0 for any other."""
    return F.transform(F.split(token, ""), lambda c: F.instr(F.lit(ALPHABET), c))


def pairs(token: Column) -> Column:
    """Numbers of the pairs of neighbouring characters; the first one's left neighbour is 0."""
    return bound(marks(token), lambda m: F.zip_with(F.concat(F.array(F.lit(0)), F.slice(m, 1, F.size(m) - 1)), m, lambda left, right: left * (len(ALPHABET) + 1) + right))


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> list[float]:
    """Log ratios (random over ordinary) of each pair of characters, with one added to each count."""
    spark, n = docs.sparkSession, len(ALPHABET) + 1
    labelled = random_samples(spark).withColumn("kind", F.lit(0)).unionByName(ordinary_samples(docs, doc_id, text).unionByName(plain_samples(spark)).withColumn("kind", F.lit(1)))
    counts = [[1.0] * (n * n), [1.0] * (n * n)]
    for r in labelled.select("kind", F.explode(pairs(F.col("token"))).alias("pair")).groupBy("kind", "pair").count().collect():
        counts[r["kind"]][r["pair"]] += r["count"]
    logs = [[math.log(c[a * n + b] / sum(c[a * n : a * n + n])) for a in range(n) for b in range(n)] for c in counts]
    return [round(x - y, 6) for x, y in zip(*logs)]


def ratio(token: Column, weights: list[float]) -> Column:
    """Log-likelihood ratio a character, in one pass that carries the character before."""
    # One literal that the optimizer folds into an array; a literal for each number costs the driver seconds.
    table = F.split(F.lit(",".join(map(str, weights))), ",").cast("array<double>")
    begin = F.struct(F.lit(0).alias("left"), F.lit(0.0).alias("sum"))
    step = lambda acc, m: F.struct(m.alias("left"), (acc["sum"] + F.get(table, acc["left"] * (len(ALPHABET) + 1) + m)).alias("sum"))
    return F.aggregate(marks(token), begin, step, lambda acc: acc["sum"]) / F.char_length(token)


def scan(docs: DataFrame, weights: list[float] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_markov.

    A null text counts as empty and has no spans (``spans`` is then the empty
    string); null ids and repeated rows stay as they are; other columns are
    ignored; an empty table gives an empty one (its models are those of the
    added ones alone, and nothing is scored).
    """
    weights = train(docs, doc_id, text) if weights is None else weights
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = own.select("doc_id", base_spans(F.col("text")).alias("base"), matches(F.col("text"), RUN, 3).alias("runs"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    added = bound(blocked(F.col("base")), lambda blocks: F.filter("runs", lambda s: ~overlaps(s, blocks) & (ratio(s["value"], weights) > THRESHOLD)))
    both = found.select("doc_id", in_order(F.col("base")).alias("base"), F.when(F.size("runs") > 0, added).otherwise(F.array().cast(SPAN)).alias("added"))
    return both.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(line(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        line(in_order(F.concat("base", "added")), KINDS).alias("spans"),
        F.size("added").cast("long").alias("n_markov"),
    )


def drop_secrets(docs: DataFrame, weights: list[float] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text the scan finds no span of any kind."""
    weights = train(docs, doc_id, text) if weights is None else weights
    own = F.coalesce(F.col(text), F.lit(""))
    base = base_spans(own)
    added = F.exists(matches(own, RUN, 3), lambda s: ratio(s["value"], weights) > THRESHOLD)
    return docs.where((F.size(base) == 0) & ~added)
