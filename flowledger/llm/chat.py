"""Chat formatting by quotation linking.

A message's lines are parsed into passages of one quote level (leading ``>``
marks).  Passages are normalised (small letters, single spaces) and hashed,
whole and by line.  What a message says itself (level 0) is indexed by
conversation and hash with its first turn; quoted passages are joined to that
index, and a message replies to the turn that its outermost linked quote came
from.  Threads follow reply links up by pointer jumping; conversations come out
in the order of threads and turns, without quotes.

DataFrame functions only.  No conversation is gathered in one task: links are
joins on (conversation, hash), and the order is a range sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .spans import bound

#: A line's quote marks with blanks between them, up to the last mark; one loop over single characters, however many there are.
MARKS = r"^[ \t>]*>"
QUOTING = r"(?md)" + MARKS
LEAST_WORDS = 3
MOST_ROUNDS = 40


def passages(text: Column) -> Column:
    """array<struct<level, lines>>: runs of lines of one quote level, marks removed.

    Lines are parsed once, each is held against the level of the one before it,
    and runs are slices between changes, so the work grows with the text alone.
    """

    def parsed(x: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 0)
        return F.struct(F.char_length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.rtrim(F.regexp_replace(F.substring(x, F.char_length(marks) + 1, F.char_length(x)), "^ ", "")).alias("line"))

    def runs(lines: Column) -> Column:
        levels = F.transform(lines, lambda x: x["level"])
        changed = F.zip_with(levels, F.concat(F.array(F.lit(-1)), F.slice(levels, 1, F.size(lines) - 1)), lambda now, before: now != before)
        starts = F.filter(F.transform(changed, lambda c, i: F.when(c, i + 1)), lambda i: i.isNotNull())
        cut = bound(starts, lambda at: F.arrays_zip(at.alias("at"), F.concat(F.slice(at, 2, F.size(at)), F.array(F.size(lines) + 1)).alias("end")))
        return F.transform(cut, lambda r: F.struct(F.get(lines, r["at"] - 1)["level"].alias("level"), F.transform(F.slice(lines, r["at"], r["end"] - r["at"]), lambda x: x["line"]).alias("lines")))

    plain = F.array(F.struct(F.lit(0).alias("level"), F.array(text).alias("lines")))
    return F.when(text.rlike(QUOTING), bound(F.transform(F.split(text, r"\r?\n", -1), parsed), runs)).otherwise(plain)


def normal(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"\s+", " "))


def units(lines: Column) -> Column:
    """Hashes of a passage, whole first, then its lines of LEAST_WORDS words or more: array<struct<part, hash>>."""
    whole = F.array(normal(F.array_join(lines, "\n")))
    each = F.filter(F.transform(F.flatten(F.transform(lines, lambda x: F.split(x, r"\n"))), normal), lambda x: F.size(F.split(x, " ")) >= LEAST_WORDS)
    return F.transform(F.filter(F.concat(whole, each), lambda x: x != ""), lambda x, i: F.struct((i > 0).cast("int").alias("part"), F.md5(x.cast("binary")).alias("hash")))


def thread_roots(replies: DataFrame) -> DataFrame:
    """conv_id, turn, root, depth for each (conv_id, turn, reply_to), reply_to < turn, by pointer jumping."""
    at = materialize(replies.select("conv_id", "turn", F.col("reply_to").alias("root"), F.lit(1).cast("long").alias("depth")), "threads")
    for _ in range(MOST_ROUNDS):
        up = at.select("conv_id", F.col("turn").alias("root"), F.col("root").alias("next"), F.col("depth").alias("more"))
        at = materialize(at.join(up, ["conv_id", "root"], "left").select("conv_id", "turn", F.coalesce("next", "root").alias("root"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("next").isNotNull().alias("moved")), "threads", at)
        if at.where("moved").isEmpty():
            return at.drop("moved")
        at = at.drop("moved")
    raise RuntimeError("reply chains are too long")


def reply_order(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per message, ordered by conversation, thread and turn: conv_id, turn, role, text (without
    quotes), n_quotes, n_linked, quote_level (deepest), reply_to (turn), thread (its first turn), depth.

    A message without a linked quote begins a thread (reply_to null, depth 0).
    A quote links to the first turn of its conversation that says the passage
    itself, if that is before the quoting one; the whole passage counts before
    its lines, outer levels before inner ones, later turns before earlier ones.
    Null texts count as empty; rows with a null conv_id or turn stay, unlinked;
    rows that repeat a (conv_id, turn) stay and share links; other columns are
    ignored; an empty table gives an empty one.
    """
    own = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    parsed = own.withColumn("p", passages(F.col("text")))
    said = F.flatten(F.transform(F.filter("p", lambda x: x["level"] == 0), lambda x: units(x["lines"])))
    quoting = parsed.where(F.col("text").rlike(QUOTING))
    quoted = quoting.select("conv_id", "turn", F.posexplode(F.filter("p", lambda x: x["level"] > 0)).alias("i", "q")).select("conv_id", "turn", "i", F.col("q.level").alias("level"), F.explode(units(F.col("q.lines"))).alias("u")).select("conv_id", "turn", "i", "level", "u.part", "u.hash")
    quoted = materialize(quoted.distinct(), "quotes")
    out = parsed.select(
        "conv_id", "turn", "role",
        F.trim(F.array_join(F.flatten(F.transform(F.filter("p", lambda x: x["level"] == 0), lambda x: x["lines"])), "\n")).alias("text"),
        F.size(F.filter("p", lambda x: x["level"] > 0)).cast("long").alias("n_quotes"), F.array_max(F.transform("p", lambda x: x["level"])).cast("long").alias("quote_level"),
    )
    # Only conversations' hashes that are quoted matter; that keeps the index as small as the quotes.
    first = parsed.select("conv_id", "turn", F.explode(said).alias("u")).select("conv_id", "turn", "u.hash").join(quoted.select("conv_id", "hash").distinct(), ["conv_id", "hash"], "left_semi").groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    linked = quoted.join(first, ["conv_id", "hash"]).where(F.col("source") < F.col("turn"))
    replies = linked.groupBy("conv_id", "turn").agg(F.max(F.struct(-F.col("part"), -F.col("level"), F.col("source"))).alias("best"), F.countDistinct("i").alias("n_linked")).select("conv_id", "turn", F.col("best.source").alias("reply_to"), "n_linked")
    replies = materialize(replies, "replies")
    roots = thread_roots(replies)
    named = replies.join(roots, ["conv_id", "turn"])
    done = out.join(named, ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "text", "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), "quote_level",
        "reply_to", F.coalesce("root", "turn").alias("thread"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"),
    )
    return done.orderBy("conv_id", "thread", "turn")
