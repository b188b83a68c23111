"""Hot, long, null and repeated inputs, and what executors may not need."""

import os
import random
import re
import subprocess
import sys
from collections import Counter
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from flowledger.llm import chat, common, langid, pii, secrets, simhash

MESSAGES = "conv_id long, turn long, role string, text string"
TEXTS = "doc_id long, text string"


def threads(rows):
    """Replies, threads and texts by a plain parser of quotes."""
    said, out = {}, {}
    norm = lambda x: re.sub(r"[ \t\n\x0b\f\r]+", " ", x.lower()).strip(" ")

    def hashes(lines):
        whole = norm("\n".join(lines))
        each = [n for x in lines for n in [norm(x)] if n and len(n.split(" ")) >= 3]
        return [(0, whole)] * bool(whole) + [(1, n) for n in each]

    parsed = {}
    for conv, turn, _, text in sorted(rows):
        runs = []
        for line in text.split("\n"):
            marks = re.match(r"[ \t>]*>", line)
            level = marks[0].count(">") if marks else 0
            rest = re.sub("^ ", "", line[len(marks[0]) if marks else 0 :]).rstrip(" ")
            if not runs or runs[-1][0] != level:
                runs.append((level, []))
            runs[-1][1].append(rest)
        parsed[conv, turn] = runs
        for level, lines in runs:
            if not level:
                for _, h in hashes(lines):
                    said.setdefault((conv, h), turn)
    for (conv, turn), runs in parsed.items():
        quotes = [(level, lines) for level, lines in runs if level]
        found = [(-part, -level, said[conv, h], i) for i, (level, lines) in enumerate(quotes) for part, h in hashes(lines) if said.get((conv, h), turn) < turn]
        best = max(x[:3] for x in found)[2] if found else None
        above = out.get((conv, best))
        out[conv, turn] = ("\n".join(x for level, lines in runs if not level for x in lines).strip(" "), len(quotes), len({x[3] for x in found}), best, above[4] if above else turn, above[5] + 1 if above else 0)
    return out


def test_chat_equals_plain_parser(spark):
    rng = random.Random(4)
    words = ["one", "two", "Three", "four", "five"]
    rows = []
    for conv in range(12):
        texts = []
        for turn in range(rng.randint(2, 9)):
            lines = []
            for _ in range(rng.randint(1, 5)):
                if texts and rng.random() < 0.5:
                    mark = rng.choice(["> ", ">", ">> ", " > > "])
                    lines += [mark + x for x in rng.choice(texts).split("\n")[: rng.randint(1, 3)]]
                else:
                    lines.append(" ".join(rng.choice(words) for _ in range(rng.randint(0, 6))))
            texts.append("\n".join(lines))
            rows.append((conv, turn, "user", texts[-1]))
    got = {(r.conv_id, r.turn): (r.text, r.n_quotes, r.n_linked, r.reply_to, r.thread, r.depth) for r in chat.reply_order(spark.createDataFrame(rows, MESSAGES)).collect()}
    expected = threads(rows)
    assert got == expected and sum(x[3] is not None for x in expected.values()) > 15 and max(x[5] for x in expected.values()) > 1


def test_chat_long_messages(spark):
    lines = "\n".join("> a b c d" if i % 2 else f"line {i}" for i in range(20_000))
    rows = [(1, 0, "u", "A b c d\nand more"), (1, 1, "u", lines), (1, 2, "u", ">" * 20_000 + " line 4\n" + " " * 50_000 + "x"), (2, 0, None, None), (2, 0, "u", "> a b c d")]
    got = {(r.conv_id, r.turn, r.role): r for r in chat.reply_order(spark.createDataFrame(rows, MESSAGES).withColumns({"p": F.lit(1), "hash": F.lit("x"), "level": F.lit(None)})).collect()}
    assert len(got) == 5 and (got[1, 1, "u"].n_quotes, got[1, 1, "u"].n_linked, got[1, 1, "u"].reply_to) == (10_000, 10_000, 0)
    assert got[1, 2, "u"].quote_level == 20_000 and got[1, 2, "u"].text == "x"


def test_markov_ratio_of_long_runs(spark):
    """One pass over a run of any length; equal to a plain sum, for the scan and the filter."""
    rng = random.Random(2)
    weights = [round(rng.uniform(-2, 3), 6) for _ in range((len(secrets.ALPHABET) + 1) ** 2)]
    n = len(secrets.ALPHABET) + 1

    def plain(token):
        marks = [secrets.ALPHABET.find(c) + 1 for c in token]
        return sum(weights[a * n + b] for a, b in zip([0, *marks], marks)) / len(token)

    tokens = ["".join(rng.choice(secrets.ALPHABET) for _ in range(size)) for size in (20, 21, 64, 300, 5000, 300_000)] + ["a" * 20, "z+" * 30]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(tokens)], TEXTS)
    for r in got.select("doc_id", secrets.ratio(F.col("text"), weights).alias("r"), secrets.pairs(F.col("text")).alias("p")).collect():
        marks = [secrets.ALPHABET.find(c) + 1 for c in tokens[r.doc_id]]
        assert abs(r.r - plain(tokens[r.doc_id])) < 1e-9 and r.p == [a * n + b for a, b in zip([0, *marks], marks)]
    found = {r.doc_id: r.spans for r in secrets.scan(got, weights).collect()}
    random_ones = {i for i, t in enumerate(tokens) if plain(t) > secrets.THRESHOLD}
    assert all((f"markov:0:{len(t)}" in found[i]) == (i in random_ones) for i, t in enumerate(tokens)) and 0 < len(random_ones)
    kept = {r.doc_id for r in secrets.drop_secrets(got, weights).collect()}
    assert kept == {i for i in range(len(tokens)) if not found[i]}


def test_bounded_sample_keeps_its_promise(spark):
    nulls = spark.range(20_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"), (F.col("id") % 3).alias("lang"))
    got = common.bounded_sample(nulls, "doc_id", "text", 48, 6, ["lang"]).collect()
    assert Counter(r.lang for r in got) == {0: 1, 1: 1, 2: 1} and {len(r.text) for r in got} == {6}
    many = spark.range(30_000).select((F.col("id") % 9000).alias("doc_id"), F.col("id").cast("string").alias("text"), (F.col("id") % 500).alias("lang"))
    counts = Counter(r.lang for r in common.bounded_sample(many, "doc_id", "text", 48, 9, ["lang"], 1000).collect())
    assert len(counts) == 500 and set(counts.values()) == {2}
    assert common.bounded_sample(many, "doc_id", "text", 48, 9, ["doc_id"], 100).count() == 100
    again = [sorted(map(tuple, common.bounded_sample(many.repartition(n), "doc_id", "text", 10, 9).collect())) for n in (1, 5)]
    assert again[0] == again[1] and len(again[0]) == 10


def test_language_with_many_letters_and_languages(spark):
    rng = random.Random(3)
    schema = "doc_id long, text string, lang string"
    han = lambda base: "".join(chr(base + rng.randrange(3000)) + " " * (rng.random() < 0.1) for _ in range(400))
    rows = [(i, han(0x4E00 + 3000 * (i % 2)), "ja" if i % 2 else "zh") for i in range(160)]
    got = langid.identify(spark.createDataFrame(rows, schema)).where("held_out").collect()
    assert got and all((r.lang_pred == "ja") == (r.doc_id % 2 == 1) for r in got)
    rows = []
    for lang in range(100):
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 7))) for _ in range(40)]
        rows += [(lang * 10 + k, " ".join(rng.choice(words) for _ in range(30)), f"l{lang:03d}") for k in range(10)]
    got = langid.identify(spark.createDataFrame(rows, schema)).where("held_out").collect()
    assert sum(r.lang_pred == f"l{r.doc_id // 10:03d}" for r in got) > 0.95 * len(got)


def test_sparse_and_dense_tables_agree(monkeypatch):
    samples = {"x": ["the cat and the dog and the mouse"] * 9, "y": ["la casa y el perro y la rosa é"] * 9}
    texts = ["the dog and la casa zzz", "perro " * 300, "ñ é", "1234", None]
    dense = langid.classify(langid.build(samples), texts)
    monkeypatch.setattr(langid, "WIDE", 1)
    sparse = langid.classify(langid.build(samples), texts)
    assert dense[0] == sparse[0] and (dense[1] == sparse[1]).all() and (dense[2] == sparse[2]).all()


A, B = "the cat sat on the mat with the hat and the bat on a boat", "eine ganz andere geschichte von einem hund und einer katze im haus am see"


def test_one_row_of_a_component_stays(spark):
    rows = [(2, B), (5, A), (5, B), (5, A), (None, A), (None, "x y z w v"), (None, "x y z w v"), (7, None), (8, "")]
    kept = sorted(map(tuple, simhash.keep_one(spark.createDataFrame(rows, TEXTS)).collect()), key=str)
    assert kept == sorted([(2, B), (5, A), (None, "x y z w v"), (7, None)], key=str)
    by_name = simhash.keep_one(spark.createDataFrame([("b", A, {"k": 1}), ("a", A, None)], "doc_id string, text string, _mark map<string,int>"))
    assert [r.doc_id for r in by_name.collect()] == ["a"] and by_name.columns == ["doc_id", "text", "_mark"]


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_crowded_files_lose_no_link(spark, levels):
    """Fingerprints that agree on two blocks and more, refiled by other bits or cut into chunks."""
    rng = random.Random(6)
    prints = [rng.getrandbits(40) for _ in range(300)]
    for f in prints[:60]:
        prints.append(f ^ sum(1 << b for b in rng.sample(range(40), rng.choice([3, 4, 5]))))
    prints = sorted(set(prints))
    nodes = spark.createDataFrame([(f,) for f in prints], "fp long")
    named = {r.node: r.label for r in simhash.connected(simhash.links(nodes, chunk=16, levels=levels)).collect()}
    near = [(a, b) for i, a in enumerate(prints) for b in prints[i + 1 :] if (a ^ b).bit_count() <= 4]
    assert len(near) > 20 and all(named[a] == named[b] for a, b in near)
    up = {f: f for f in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in near:
        up[root(b)] = root(a)
    assert len(set(named.values())) == len({root(f) for f in named})


def test_crowded_files_do_not_square(spark):
    """50,000 fingerprints in one file make a few rows each, not one for each pair of chunks."""
    rng = random.Random(1)
    nodes = spark.createDataFrame([(f,) for f in {rng.getrandbits(42) for _ in range(50_000)}], "fp long")
    assert simhash.links(nodes).count() < 50_000


def test_pii_precision_and_recall(spark, sf_dir):
    """On rows that the fit has not seen, and on planted phone numbers rewritten without their country."""
    model = pii.train(spark)
    fresh = pii.samples(spark, 15_000).where(F.col("id") >= pii.SAMPLES)
    got = pii.scan(fresh.withColumnRenamed("id", "doc_id"), model).join(fresh.select(F.col("id").alias("doc_id"), "label"), "doc_id").collect()
    hit = Counter((r.label, any(k in r.spans for k in pii.GENERATORS)) for r in got)
    assert hit[1, True] / (hit[1, True] + hit[0, True]) > 0.96 and hit[1, True] / (hit[1, True] + hit[1, False]) > 0.6
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert pii.scan(docs, model).where("n_email + n_ip + n_card + n_phone = 0 and n_added > 0").count() <= 0.01 * docs.count()
    local = spark.createDataFrame([(i, f"ing haaton there (0{i}7) 555-77{i}3 rethsh on toon") for i in range(10)], TEXTS)
    assert {r.spans for r in pii.scan(local, model).collect()} == {"local_phone:17:31"}


def test_pii_best_candidates_stay(spark, monkeypatch):
    """Of A over B over C, where B overlaps both, A and C stay; nothing is covered by what went."""
    monkeypatch.setattr(pii, "GENERATORS", {"a": "aaaabb", "b": "bbcccc", "c": "ccccdddd"})
    monkeypatch.setattr(pii, "KINDS", ["email", "ip", "card", "phone", "a", "b", "c"])
    model = pii.Trees(0.0, [(0, 4, (0, 99, 3.0, 3.0), (0, 5, 2.0, 1.0))], {4: 0.0, 5: 0.0, 6: 0.0})
    spans = lambda t: pii.scan(spark.createDataFrame([(1, t)], TEXTS), model).first().spans
    monkeypatch.setattr(pii, "candidates", lambda text: F.concat(*[pii.matches(text, p, 4 + i) for i, p in enumerate(pii.GENERATORS.values())]))
    assert spans("aaaabbccccdddd") == "a:0:6,c:6:14" and spans("xx bbccccdddd") == "b:3:9" and spans("ccccdddd") == "c:0:8"


def test_executors_need_no_copy_of_the_package(sf_dir, tmp_path):
    """The package is on the driver's path only: workers start in another folder with another PYTHONPATH."""
    root = Path(common.__file__).resolve().parents[2]
    script = f"""
import sys
sys.path.insert(0, {str(root)!r})
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.sql.shuffle.partitions", "2").config("spark.ui.enabled", "false").getOrCreate()
from flowledger.llm import queries
docs = spark.read.parquet({str(sf_dir)!r} + "/documents.parquet").limit(40)
bench = spark.read.parquet({str(sf_dir)!r} + "/benchmark.parquet")
from flowledger.llm import decontam, langid, lm, media, simhash, tokens
for df in (decontam.contaminated(docs, bench), langid.identify(docs), lm.score(docs), media.media_features(docs), simhash.near_duplicates(docs), tokens.token_counts(docs), simhash.keep_one(docs), langid.keep_identified(docs), decontam.drop_contaminated(docs, bench)):
    df.write.format("noop").mode("overwrite").save()
print("ALL DONE")
"""
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, "-c", script], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=400)
    assert "ALL DONE" in done.stdout, done.stderr[-3000:]


def test_long_runs_that_are_no_secrets_stay_clean(spark, sf_dir):
    """Rulers, numbers, dates and paths have no span and their documents stay; random strings beside them go."""
    plain = ["-" * 40, "=" * 3000, "_" * 20, "----------+----------+----------", "12345678901234567890", "314159265358979323846264338", "2024-01-15-12-30-45-000000", "2024/01/15/12/30/45/backup",
             "/images/2019/04/IMG_20190412_103045", "/usr/local/lib/python3/site-packages/numpy/core", "linux-image-5-15-0-91-generic", "getElementsByClassNameAndTagName"]
    rng, letters = random.Random(4), "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    hidden = ["".join(rng.choice(letters) for _ in range(n)) for n in (24, 32, 40, 64, 200)]
    docs = spark.createDataFrame([(i, f"see\n{t}\nabove") for i, t in enumerate(plain + hidden)], TEXTS)
    weights = secrets.train(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    assert {r.doc_id: r.n_markov for r in secrets.scan(docs, weights).collect()} == {i: int(i >= len(plain)) for i in range(len(plain + hidden))}
    assert {r.doc_id for r in secrets.drop_secrets(docs, weights).collect()} == set(range(len(plain)))
