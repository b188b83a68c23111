"""Language identification by cross-parsing entropy.

For every language a suffix automaton is built from a bounded sample of
labelled text.  A text is parsed greedily into the longest phrases that occur
in that sample; the language that needs the fewest phrases per symbol wins.

The automaton is flattened into one transition table in which a missing
transition already points to where the next phrase begins, with a flag bit that
counts the phrase.  Languages of over ``WIDE`` letters, and all of them where
there are over ``MOST_DENSE`` languages, keep only the transitions that exist, as
sorted keys.  Texts are cut into lanes of ``LANE`` symbols (a phrase ends
with its lane; whole texts are covered), and all lanes advance together.

The sample: for each language ``SAMPLE_DOCS`` documents at most (smallest id
hashes), and of their symbols the first ``SAMPLE_SYMBOLS`` at most; fewer of both
if there are so many languages that ``SAMPLE_ROWS`` documents or
``MODEL_SYMBOLS`` symbols in all would be exceeded.  So the broadcast model stays
under some 100 MB.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrays_of, bounded_sample, fold, portions

SAMPLE_DOCS = 48
SAMPLE_SYMBOLS = 30_000
SAMPLE_ROWS = 4096
SAMPLE_CHARS = 12_000_000  # of all languages, before they are squeezed
MODEL_SYMBOLS = 1_000_000
WIDE = 300
MOST_DENSE = 12
LANE = 512
FOLDS = 5
#: Above this many phrases per symbol a text is written in none of the languages.
FOREIGN = 0.5
UNKNOWN = "und"
PORTION = 2_000_000


@dataclass
class Model:
    languages: list[str]
    symbols: np.ndarray  # by code point: 0 for what separates words, else a letter's number, the last for any other letter
    letters: list[np.ndarray]  # by language: a symbol's number among the language's own, 0 for separators, the last for any other
    tables: list[tuple[np.ndarray, ...]]  # see ``dense_table`` and ``sparse_table``


def suffix_automaton(line: list[int]) -> list[dict[int, int]]:
    """Transitions of the minimal automaton of all factors of ``line``; state 0 is the start."""
    step, link, size = [{}], [-1], [0]
    last = 0
    for c in line:
        new = len(step)
        step.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            if size[q] == size[p] + 1:
                link[new] = q
            else:
                twin = len(step)
                step.append(dict(step[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                link[q] = link[new] = twin
                while p >= 0 and step[p].get(c) == q:
                    step[p][c] = twin
                    p = link[p]
        last = new
    return step


def dense_table(step: list[dict[int, int]], width: int) -> tuple[np.ndarray]:
    """By state * width + symbol: 2 * the next state's offset, plus 1 where a phrase begins."""
    start = np.array([2 * step[0].get(c, 0) * width + 1 for c in range(width)], dtype=np.int32)
    table = np.tile(start, (len(step), 1))
    for state, row in enumerate(step[1:], 1):  # from the start, every symbol begins a phrase
        for c, target in row.items():
            table[state, c] = 2 * target * width
    return (table.ravel(),)


def sparse_table(step: list[dict[int, int]], width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``dense_table`` in three arrays: existing transitions' sorted keys and values, and what begins a phrase, by symbol."""
    start = np.array([2 * step[0].get(c, 0) * width + 1 for c in range(width)], dtype=np.int64)
    pairs = sorted((state * width + c, 2 * target * width) for state, row in enumerate(step[1:], 1) for c, target in row.items())
    key, value = np.array(pairs, dtype=np.int64).reshape(-1, 2).T
    return np.append(key, np.iinfo(np.int64).max), np.append(value, 0), start


def follow(table: tuple[np.ndarray, ...], state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """``table``'s value at each state (an offset) and symbol."""
    if len(table) == 1:
        return table[0][state + symbol]
    key, value, start = table
    wanted = state + symbol
    at = np.searchsorted(key, wanted)
    return np.where(key[at] == wanted, value[at], start[symbol])


def letters() -> np.ndarray:
    """By code point: the code point of its small letter, or 0 for what is no letter."""
    out = np.zeros(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        if (c := chr(i)).isalpha():
            low = c.lower()
            out[i] = ord(low) if len(low) == 1 else i
    return out


def points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def squeeze(symbols: np.ndarray) -> np.ndarray:
    """Without separators at the beginning and after another separator."""
    if not len(symbols):
        return symbols
    return symbols[(symbols != 0) | (np.concatenate((symbols[:1] * 0, symbols[:-1])) != 0)]


def build(samples: dict[str, list[str]], symbols_each: int = SAMPLE_SYMBOLS, symbols_all: int = MODEL_SYMBOLS) -> Model:
    """Any number of languages and letters: many languages get shorter samples each."""
    lower = letters()
    each = min(symbols_each, max(1, symbols_all // max(1, len(samples))))
    lines = {lang: squeeze(lower[points("\n".join(texts))])[:each] for lang, texts in samples.items()}
    known = np.unique(np.concatenate([*lines.values(), np.zeros(1, np.uint32)]))
    number = np.full(0x110000, len(known), dtype=np.uint32)
    number[known] = np.arange(len(known))
    symbols = np.where(lower == 0, 0, number[lower]).astype(np.uint32)
    languages, own, tables = sorted(lines), [], []
    for lang in languages:
        line = number[lines[lang]]
        used = np.union1d(line, [0])
        letter = np.full(len(known) + 1, len(used), dtype=np.int32)
        letter[used] = np.arange(len(used))
        own.append(letter)
        dense = len(used) < WIDE and len(languages) <= MOST_DENSE
        tables.append((dense_table if dense else sparse_table)(suffix_automaton(letter[line].tolist()), len(used) + 1))
    return Model(languages, symbols, own, tables)


def train(docs: DataFrame, doc_id: str, text: str, lang: str, docs_each: int = SAMPLE_DOCS) -> Model:
    """Fits on labelled rows with a text whose fold isn't 0."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    labelled = own.where(F.col("lang").isNotNull() & (fold(F.col("doc_id"), FOLDS) != 0))
    found = bounded_sample(labelled, "doc_id", "text", docs_each, SAMPLE_SYMBOLS, ["lang"], SAMPLE_ROWS, SAMPLE_CHARS).where(F.col("text").isNotNull()).collect()
    samples: dict[str, list[str]] = {}
    for r in sorted(found, key=lambda r: (r["lang"], zlib.crc32(r["text"].encode()), r["text"])):
        samples.setdefault(r["lang"], []).append(r["text"])
    return build(samples)


def phrases(model: Model, symbols: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Phrases by text (rows) and language. ``symbols``: all texts' in a row, which begin at ``starts``."""
    sizes = np.diff(np.concatenate((starts, [len(symbols)])))
    lanes = -(-sizes // LANE)
    owner = np.repeat(np.arange(len(starts)), lanes)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(lanes) - lanes, lanes)
    begin = starts[owner] + place * LANE
    length = np.minimum(LANE, sizes[owner] - place * LANE)
    order = np.argsort(-length, kind="stable")
    begin, length, owner = begin[order], length[order], owner[order]
    active = np.searchsorted(-length, -np.arange(LANE), side="left")
    out = np.zeros((len(starts), len(model.tables)), dtype=np.int64)
    for k, (letter, table) in enumerate(zip(model.letters, model.tables)):
        wide = letter[symbols]
        state = np.zeros(len(begin), dtype=table[0].dtype)
        count = np.zeros(len(begin), dtype=np.int32)
        for t in range(LANE):
            n = active[t]
            if not n:
                break
            got = follow(table, state[:n], wide[begin[:n] + t])
            count[:n] += (got & 1).astype(np.int32)
            state[:n] = got >> 1
        out[:, k] = np.bincount(owner, weights=count, minlength=len(starts))
    return out


def classify(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and phrases per symbol of each text."""
    parts = [squeeze(model.symbols[points(x or "")]) for x in texts]
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    has = np.array([bool(p.any()) for p in parts], dtype=bool)
    lang, score, rate = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts))
    if len(texts) and model.tables and sizes.sum():
        found = phrases(model, np.concatenate(parts), np.cumsum(sizes) - sizes) / np.maximum(sizes, 1)[:, None]
        best = found.argmin(axis=1)
        rows = np.arange(len(texts))
        rate = np.where(has, found[rows, best], 1.0)
        rest = found.copy()
        rest[rows, best] = np.inf
        second = rest.min(axis=1)
        score = np.where(has, np.where(np.isfinite(second), 1 - rate / np.where(np.isfinite(second) & (second > 0), second, 1), 1.0), 0.0)
        lang = [model.languages[b] if h else UNKNOWN for b, h in zip(best, has)]
    return lang, np.clip(score, 0, 1), rate


def predict(docs: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, lang_pred, score (0 to 1: how far the runner-up is behind) and phrases per symbol of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(arrays_of(model))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            lang, score, rate = [], [], []
            for some in portions(batch.column(1).to_pylist(), lambda x: len(x or "") + 1, PORTION):
                a, b, c = classify(model, some)
                lang += a
                score.append(b)
                rate.append(c)
            score, rate = (np.concatenate(x) if x else np.zeros(0) for x in (score, rate))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score), pa.array(rate)], names=["doc_id", "lang_pred", "score", "phrase_rate"])

    schema = T.StructType([T.StructField("doc_id", docs.schema[doc_id].dataType), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("phrase_rate", T.DoubleType())])
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score, phrase_rate of every row.

    Learns from rows of fold 1 to 4 with a label and a text.  ``und`` with score
    0: the text is null, empty, without letters, or nothing could be learned.  A
    single language scores 1.  Ties go to the language first in order.  Repeated
    rows each get the same answer; null ids are in the fold of the empty text;
    other columns are ignored; an empty table gives an empty one.
    """
    found = predict(docs, train(docs, doc_id, text, lang), doc_id, text)
    return found.select("doc_id", (fold(F.col("doc_id"), FOLDS) == 0).alias("held_out"), "lang_pred", "score", "phrase_rate")


def keep_identified(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", foreign: float = FOREIGN) -> DataFrame:
    """The rows of ``docs`` in one of the learned languages: not ``und``, ``foreign`` phrases per symbol at most.

    The text is judged in one pass with its row, so rows stay whole and nothing is shuffled.
    """
    shared = docs.sparkSession.sparkContext.broadcast(arrays_of(train(docs, doc_id, text, lang)))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(*shared.value)
        for batch in batches:
            keep = []
            for some in portions(batch.column(place).to_pylist(), lambda x: len(x or "") + 1, PORTION):
                known, _, rate = classify(model, some)
                keep += [k != UNKNOWN and r <= foreign for k, r in zip(known, rate)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
