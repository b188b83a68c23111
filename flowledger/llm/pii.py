"""Personal data: fixed patterns, and overlapping candidates judged by gradient-boosted trees.

Generators of high recall propose spans of further forms (local phone numbers,
nine-digit identity numbers, bank accounts, veiled e-mail addresses, digit runs,
long addresses of hosts).  Each candidate gets features of its format and of the
characters before it; boosted trees of depth two give a log-odds score, and a
threshold for each generator, calibrated on samples held out from the fit, selects
the spans to redact.  Of overlapping candidates the best scored stays, and none
that overlaps a fixed pattern's span.

The labelled samples are made by rule from SHA-256 digests, as DataFrame rows;
their features come from the same expressions as those of real texts.  A sample's
label is the sort of its value, drawn first: personal forms, or things that look
alike to the generators (part and order numbers, product keys, book numbers,
times, hardware addresses).  The words before it are drawn afterwards and only
lean one way or the other, and often say nothing, so labels don't follow from any
feature.  The trees are fitted by the driver on these (``SAMPLES`` rows) and
become ``when`` expressions, so that scoring is DataFrame functions only.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .spans import SPAN, blocked, bound, in_order, line, matches, overlaps

# Kinds and patterns of the contract.  The look-behinds only keep a
# search from starting again within a run; \G lets it start where a match ended.
EMAIL = r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"

GENERATORS = {
    "local_phone": r"(?<![0-9+])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
    "identity": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?|(?:\x20?[A-Z0-9]{4}){2}\x20?[A-Z0-9]{3})(?![A-Za-z0-9])",
    "veiled_email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++\x20?[\[(][aA][tT][\])]\x20?[A-Za-z0-9-]++(?:\x20?[\[(][dD][oO][tT][\])]\x20?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)++",
    "digits": r"(?<![A-Za-z0-9])[0-9](?:[\x20-]?[0-9]){8,}+",
    "long_host": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){5,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
}
KINDS = ["email", "ip", "card", "phone", *GENERATORS]
FIXED = 4

# Words that speak for and against personal data when they stand before a candidate.
CUES = ["phone", "call", "tel", "mobile", "fax", "ssn", "social", "passport", "iban", "account", "mail", "contact", "host", "login"]
COUNTER = ["order", "invoice", "isbn", "version", "part", "serial", "total", "build", "page", "ticket"]
#: Country, length and a bank's letters of bank account numbers in the samples.
ACCOUNTS = [("NO", 15, ""), ("BE", 16, ""), ("DK", 18, ""), ("NL", 18, "ABNA"), ("AT", 20, ""), ("CH", 21, ""), ("DE", 22, ""), ("GB", 22, "NWBK"), ("ES", 24, ""), ("FR", 27, ""), ("IT", 27, "X"), ("PL", 28, ""), ("MT", 31, "MALT")]
BEFORE = 24
SAMPLES = 9000
TREES = 32
STEP = 0.4
PRECISION = 0.97


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(value: Column) -> Column:
    """Whether the digits of ``value`` pass Luhn's test."""
    each = F.transform(F.split(F.reverse(digits(value)), ""), lambda c: c.cast("int"))
    part = F.transform(each, lambda d, i: F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d)))
    return F.aggregate(part, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def base_spans(text: Column) -> Column:
    small = lambda v: F.forall(F.split(v, r"\."), lambda p: F.regexp_replace(p, "^0+", "").rlike(r"^(?:[0-9]{0,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$"))
    count = lambda v: F.char_length(digits(v))
    return F.concat(
        matches(text, EMAIL, 0, gate=text.contains("@")),
        matches(text, IP, 1, small, gate=text.rlike(r"[0-9]\.[0-9]")),
        matches(text, CARD, 2, lambda v: count(v).between(13, 19) & luhn(v), gate=text.rlike(r"[0-9](?:[\x20-]?[0-9]){12}")),
        matches(text, PHONE, 3, lambda v: count(v).between(9, 15), gate=text.contains("+")),
    )


def candidates(text: Column) -> Column:
    """All generators' spans; they may overlap. Kinds go on from the fixed ones."""
    spans = [matches(text, p, FIXED + i) for i, p in enumerate(GENERATORS.values())]
    return F.when(text.rlike(r"[0-9][\x20-]?[0-9]|[\[(][aA][tT][\])]|[0-9A-Fa-f]:[0-9A-Fa-f]"), F.concat(*spans)).otherwise(F.array().cast(SPAN))


FEATURES = ["kind", "digits", "length", "luhn", "groups", "letters", "cue", "counter", "stuck", "lead", "bracket"]


def features(text: Column, span: Column) -> list[Column]:
    value = span["value"]
    before = F.lower(F.substring(text, F.greatest(span["start"] + 1 - BEFORE, F.lit(1)), F.least(span["start"], F.lit(BEFORE))))
    after = F.substring(text, span["end_"] + 1, 1)
    word = lambda some: before.rlike(r"\b(?:" + "|".join(some) + r")").cast("int")
    return [
        span["kind"],
        F.char_length(digits(value)),
        F.char_length(value),
        luhn(value).cast("int"),
        F.size(F.split(value, r"[^A-Za-z0-9]+")),
        F.char_length(F.regexp_replace(value, "[^A-Za-z]", "")),
        word(CUES),
        word(COUNTER),
        after.rlike(r"[A-Za-z0-9]").cast("int"),
        F.coalesce(F.substring(digits(value), 1, 3).try_cast("int"), F.lit(-1)),
        value.startswith("(").cast("int"),
    ]


def samples(spark: SparkSession, count: int = SAMPLES) -> DataFrame:
    """id, label, text: one value in a context each; the label is the sort of the value, whatever stands before it."""
    plain = F.sha2(F.concat(F.lit("pii "), F.col("id").cast("string")).cast("binary"), 256)
    d = F.translate(plain, "abcdef", "013579")
    draw = lambda n, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(n))
    one_of = lambda some, salt: F.element_at(F.array(*[F.lit(x) if isinstance(x, str) else x for x in some]), (draw(len(some), salt) + 1).cast("int"))
    s = lambda a, n: F.substring(d, a, n)
    run = lambda least, most, salt: F.substring(d, F.lit(1), (F.lit(least) + draw(most - least + 1, salt)).cast("int"))
    joined = lambda mark, sizes: F.concat_ws(mark, *[s(1 + sum(sizes[:i]), n) for i, n in enumerate(sizes)])
    # A bank account number of its country's length, in groups of four or together.
    bban = F.concat(d, d)
    whole = one_of([F.concat(F.lit(c), s(1, 2), F.lit(b), F.substring(bban, 3, n - 4 - len(b))) for c, n, b in ACCOUNTS], "country")
    grouped = lambda v, salt: F.when(draw(2, salt) == 0, v).otherwise(F.rtrim(F.regexp_replace(v, "(.{4})", "$1 ")))
    hexes = F.concat_ws(":", *[F.substring(plain, 1 + 4 * i, 4) for i in range(8)])
    personal = [
        one_of([F.concat(F.lit("("), s(1, 3), F.lit(") "), joined("-", [3, 4])), joined("-", [3, 3, 4]), joined(" ", [3, 3, 4]), joined(".", [3, 3, 4])], "phone"),
        joined("-", [3, 2, 4]),
        grouped(whole, "together"),
        F.concat(one_of(["user", "jo.doe", "info-", "a"], "user"), s(1, 3), one_of([" (at) mail", "(at)mail", " [at] mail"], "at"), s(4, 1), one_of([" (dot) org", "(dot)org", " [dot] net"], "dot")),
        run(9, 17, "n"),
        hexes,
    ]
    key = F.upper(F.translate(F.concat(plain, F.md5(plain)), "0123", "kqxz"))
    alike = [
        one_of([joined("-", [3, 3, 4]), joined(".", [3, 3, 4])], "part"),
        F.concat_ws("-", F.concat(F.lit("0"), s(1, 2)), s(3, 2), s(5, 4)),
        grouped(F.concat(F.lit("SK"), s(1, 2), F.substring(key, 1, 12)), "product"),
        F.concat(F.lit("look (at) page "), s(1, 2), F.lit(" (dot) ")),
        one_of([F.concat(F.lit("978"), s(1, 10)), F.concat(F.lit("20"), s(1, 12)), F.concat(F.lit("17"), s(1, 8)), run(9, 17, "order"), run(9, 12, "total")], "number"),
        F.concat_ws(":", *[F.substring(plain, 1 + 2 * i, 2) for i in range(6)]),
    ]
    label, side = draw(2, "label"), draw(100, "side")
    form = F.when(label == 1, F.element_at(F.array(*personal), (F.col("id") % 6 + 1).cast("int"))).otherwise(F.element_at(F.array(*alike), (F.col("id") % 6 + 1).cast("int")))
    cue, counter = F.when(label == 1, 50).otherwise(6), F.when(label == 1, 54).otherwise(46)
    context = F.when(side < cue, one_of([c + t for c in CUES for t in (" ", ": ", " no. ")], "cue")).when(side < counter, one_of([c + t for c in COUNTER for t in (" ", ": ", " no. ")], "counter")).otherwise(one_of(["the ", "of thing ", "and then ", "mente de ", "in der ", "et la ", "so it was, "], "plain"))
    return spark.range(count).select("id", label.cast("int").alias("label"), F.concat(context, form, F.lit(" and so on.")).alias("text"))


@dataclass
class Trees:
    """Depth-two trees (feature, limit, left, right) where left and right are (feature, limit, value, value), and thresholds by kind."""

    base: float
    trees: list = field(default_factory=list)
    limits: dict[int, float] = field(default_factory=dict)

    def score(self, x: list) -> float:
        return self.base + sum(v for t in self.trees for n in [t[2] if x[t[0]] <= t[1] else t[3]] for v in [n[2] if x[n[0]] <= n[1] else n[3]])

    def column(self, x: list[Column]) -> Column:
        leaf = lambda n: F.when(x[n[0]] <= n[1], n[2]).otherwise(n[3])
        total = F.lit(self.base)
        for t in self.trees:
            total = total + F.when(x[t[0]] <= t[1], leaf(t[2])).otherwise(leaf(t[3]))
        return total


def best_split(rows: np.ndarray, level: list[np.ndarray], values: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> tuple:
    """The (gain, feature, limit, left value, right value) of a regression stump on the gradients of ``rows``; ``level``: by feature, each row's place in ``values``."""
    value = lambda a, b: float(STEP * a / (b + 1.0))
    g, h = g[rows], h[rows]
    all_g, all_h = g.sum(), h.sum()
    best = (0.0, 0, math.inf, value(all_g, all_h), value(all_g, all_h))
    for f, (places, known) in enumerate(zip(level, values)):
        own = places[rows]
        left_g, left_h = (np.cumsum(np.bincount(own, weights=w, minlength=len(known)))[:-1] for w in (g, h))
        gain = left_g**2 / (left_h + 1) + (all_g - left_g) ** 2 / (all_h - left_h + 1) - all_g**2 / (all_h + 1)
        if len(gain) and gain.max() > best[0] + 1e-9:
            i = int(gain.argmax())
            best = (float(gain[i]), f, float(known[i]), value(left_g[i], left_h[i]), value(all_g - left_g[i], all_h - left_h[i]))
    return best


def fit(x: list[list[float]], y: list[int]) -> Trees:
    """Boosting on the logistic loss; a quarter of the rows is held out and sets each kind's threshold."""
    table, y = np.array(x, dtype=np.float64).reshape(-1, len(FEATURES)), np.array(y, dtype=np.float64)
    values, level = zip(*[np.unique(table[:, f], return_inverse=True) for f in range(len(FEATURES))])
    out = (np.arange(len(y)) * 2654435761 >> 16) % 4 == 0
    train, held = np.flatnonzero(~out), np.flatnonzero(out)
    rate = (y[train].sum() + 1) / (len(train) + 2)
    model = Trees(math.log(rate / (1 - rate)))
    score = np.full(len(y), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        g, h = y - p, p * (1 - p)
        _, f, limit, _, _ = best_split(train, level, values, g, h)
        left = table[:, f] <= limit
        tree = (f, limit, *(best_split(train[side[train]], level, values, g, h)[1:] for side in (left, ~left)))
        model.trees.append(tree)
        for side, n in ((left, tree[2]), (~left, tree[3])):
            score[side] += np.where(table[side, n[0]] <= n[1], n[2], n[3])
    for kind in range(FIXED, len(KINDS)):
        own = sorted((float(score[i]), float(y[i])) for i in held if table[i, 0] == kind)
        model.limits[kind] = 1e9
        for at in range(len(own)):  # the lowest threshold of enough precision
            rest = own[at:]
            if sum(b for _, b in rest) >= PRECISION * len(rest) + math.sqrt(PRECISION * (1 - PRECISION) * len(rest)):  # a deviation above, as the best of many is taken
                model.limits[kind] = round((own[at][0] + own[at - 1][0]) / 2 if at else own[at][0] - 0.5, 6)
                break
    return model


def train(spark: SparkSession) -> Trees:
    made = samples(spark).select("id", "label", "text", F.explode(candidates(F.col("text"))).alias("s"))
    rows = made.select("id", "label", F.array(*[c.cast("double") for c in features(F.col("text"), F.col("s"))]).alias("x")).orderBy("id", "x").collect()
    return fit([r["x"] for r in rows], [r["label"] for r in rows])


def scan(docs: DataFrame, model: Trees | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added, n_spans (of any kind).

    A null text counts as empty and has no spans (the empty string); null ids
    and repeated rows stay; other columns are ignored; an empty table gives an
    empty one.  Of overlapping candidates with equal scores the first stays.
    """
    model = train(docs.sparkSession) if model is None else model
    own = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = own.select("doc_id", "text", in_order(base_spans(F.col("text")), True).alias("base"), candidates(F.col("text")).alias("some"))
    free = bound(blocked(F.col("base")), lambda blocks: F.filter("some", lambda s: ~overlaps(s, blocks)))
    limit = lambda s: F.element_at(F.array(*[F.lit(float(model.limits[k])) for k in range(FIXED, len(KINDS))]), s["kind"] - FIXED + 1)
    scored = F.transform(free, lambda s: F.struct((limit(s) - model.column(features(F.col("text"), s))).alias("miss"), s["start"].alias("start"), s["kind"].alias("kind"), s["end_"].alias("end_")))
    wanted = F.filter(scored, lambda s: s["miss"] < 0)
    # The best of overlapping ones stays, then the best of those that overlap none that stayed, and so on; each is scored once.
    first = lambda some: bound(blocked(some), lambda blocks: F.filter(some, lambda s: ~overlaps(s, blocks, lambda o: o < s)))
    without = lambda some, kept: bound(blocked(kept), lambda blocks: F.filter(some, lambda s: ~overlaps(s, blocks)))
    once_more = lambda acc: bound(first(acc["rest"]), lambda top: F.struct(F.concat(acc["kept"], top).alias("kept"), without(acc["rest"], top).alias("rest")))
    begin = lambda some: F.struct(F.slice(some, 1, 0).alias("kept"), some.alias("rest"))
    greedy = lambda some: F.aggregate(some, begin(some), lambda acc, _: F.when(F.size(acc["rest"]) == 0, acc).otherwise(once_more(acc)), lambda acc: acc["kept"])
    added = bound(wanted, greedy)
    added = F.transform(added, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end_"].alias("end_")))
    both = found.select("doc_id", "base", F.when(F.size("some") > 0, added).otherwise(F.array().cast("array<struct<kind:int,start:int,end_:int>>")).alias("added"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return both.select(
        "doc_id", *[count(k).alias(f"n_{KINDS[k]}") for k in range(FIXED)],
        F.sha2(line(F.col("base"), KINDS).cast("binary"), 256).alias("base_sha256"),
        line(F.array_sort(F.concat("base", "added")), KINDS).alias("spans"), F.size("added").cast("long").alias("n_added"),
        (F.size("base") + F.size("added")).cast("long").alias("n_spans"),
    )
