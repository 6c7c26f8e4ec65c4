"""Row numbers, quota splits, code tokens and token alignment against plain Python."""

from __future__ import annotations

import bisect
import hashlib
import io
import json
import keyword
import random
import re
import token
import tokenize

import pytest
from pyspark.sql import functions as F

from loam.functions import code
from loam.operators import alignment, ordering


def digest(value):
    return hashlib.sha256(json.dumps(value, ensure_ascii=False, separators=(",", ":")).encode()).hexdigest()


def test_row_numbers_are_exact(spark):
    rng = random.Random(3)
    rows = [(rng.randint(0, 50), k) for k in range(3000)]
    df = spark.createDataFrame(rows, "a int, b int").repartition(7)
    got = ordering.row_numbers(df, F.desc("a"), "b").collect()
    assert [(r.a, r.b) for r in sorted(got, key=lambda r: r.row)] == sorted(rows, key=lambda r: (-r[0], r[1])) and sorted(r.row for r in got) == list(range(3000))
    assert ordering.row_numbers(df.where("a < 0"), "a").count() == 0
    shards = ordering.row_shards(df, 4, "b").collect()
    assert {(r.b, r.shard, r.turn) for r in shards} == {(b, b % 4, b // 4) for _, b in rows}


def test_ordered_files(spark, tmp_path):
    df = spark.createDataFrame([(k * 37 % 101, f"x{k}") for k in range(101)], "a int, b string").repartition(5)
    ordering.write_ordered(df, f"{tmp_path}/out", "a")
    lines = [json.loads(line)["a"] for f in sorted(tmp_path.glob("out/part-*")) for line in f.read_text().splitlines()]
    assert lines == list(range(101))


def by_loop(count, test, validation):
    t = max(1, round(count * test)) if count >= 3 else 0
    v = max(1, round(count * validation)) if count >= 3 else (1 if count == 2 else 0)
    while t + v >= count and t:
        t -= 1
    return t, v


def test_quotas():
    for count in range(40):
        for test in (0.0, 0.05, 0.1, 0.25, 0.5, 0.9):
            for validation in (0.0, 0.1, 0.15, 0.5):
                if count != 1:
                    assert ordering.quotas(count, test, validation) == by_loop(count, test, validation), (count, test, validation)
    assert ordering.quotas(1, 0.1, 0.1) == (0, 0) and ordering.quotas(25, 0.1, 0.1) == (2, 2)  # 2.5 is rounded to 2


@pytest.mark.parametrize("count", [1, 2, 3, 35])
def test_quota_splits(spark, count):
    groups = {f"c{k}": [f'n{k}-{j}"é' for j in range(1 + (k % 3) * 4)] for k in range(count)}
    rows = [(c, n) for c, names in groups.items() for n in names] * 2
    got = dict(map(tuple, ordering.quota_splits(spark.createDataFrame(rows, "component string, name string").repartition(4), 7, 0.1, 0.2).collect()))
    order = sorted(groups, key=lambda c: digest([7, sorted(groups[c])]))
    t, v = by_loop(count, 0.1, 0.2)
    assert got == {c: "test" if i >= count - t else "validation" if i >= count - t - v else "train" for i, c in enumerate(order)}
    samples = spark.createDataFrame([("s1", "a"), ("s2", "b"), ("s3", None), ("s4", "zz")], "sample_id string, name string")
    split = spark.createDataFrame([("a", "test"), ("b", "train")], "name string, split string")
    assert {tuple(r) for r in ordering.split_ids(samples, split).collect()} == {("test", "s1"), ("train", "s2"), ("train", "s3"), ("train", "s4")}


CODE = ['def f(a, b=1):\n    # note\n    return a ** b + f(a)[0:-1]\n', 'x = {"k": 1.5e-3, \'s\': r"\\d+"}\nclass A(B):\n    """Doc\n    string"""\n    y: int = 0xFF\n', "while not x:\n\tx >>= 2; y //= 3\n", "async def été(ñ): return await ñ @ 2j != ...\n", "if (a := 5) and b'\\x00' or u'é\\'s':\n  pass\n", "", "# only\n", "s = 'it''s' \"#no comment\"  # comment 'x'\n"]


def lexed(text, plain=False):
    skip = {tokenize.COMMENT, tokenize.NL, tokenize.NEWLINE, tokenize.ENCODING, tokenize.ENDMARKER, tokenize.INDENT, tokenize.DEDENT}
    found = [t for t in tokenize.generate_tokens(io.StringIO(text).readline) if t.type not in skip]
    return ["IDENT" if plain and t.type == token.NAME and not keyword.iskeyword(t.string) else t.string for t in found]


def renamed(items):
    seen = {}
    return [f"v{seen.setdefault(t, len(seen) + 1)}" if re.fullmatch(r"[^\W\d]\w*", t) and not keyword.iskeyword(t) else t for t in items]


def test_code_tokens_and_hashes(spark):
    df = spark.createDataFrame(list(enumerate(CODE)), "id int, text string")
    rows = df.select("id", code.tokens(F.col("text")).alias("t"), code.fingerprints(F.col("text")).alias("f")).collect()
    names = {r.id: r.renamed_hash for r in code.renamed_hashes(df, "id", "text").collect()}
    for r in rows:
        assert r.t == lexed(CODE[r.id])
        assert r.f.token_hash == digest(lexed(CODE[r.id])) and r.f.identifier_normalized_hash == digest(lexed(CODE[r.id], True))
        assert names[r.id] == digest(renamed(lexed(CODE[r.id])))
    two = spark.createDataFrame([(0, "a = b + a"), (1, "xx = y + xx"), (2, "xx = y + y"), (3, "open = 'it"), (4, None)], "id int, text string")
    h = {r.id: r.renamed_hash for r in code.renamed_hashes(two, "id", "text").collect()}
    assert h[0] == h[1] != h[2] and h[4] == digest([])
    assert two.where("id = 3").select(code.tokens(F.col("text")).alias("t")).first().t == ["open", "=", "'", "it"]


def test_tokens_begin_in_lines(spark):
    rng = random.Random(8)
    texts = ["".join(rng.choices(["word", " ", "  ", "\n", "\r\n", "\n\n", "été", "12345", "+=", "\u2028", "\x85", "\t"], k=rng.randint(1, 80))) for _ in range(120)]
    texts += ["a", "\n", "a\nb", "x " * 5000]
    got = alignment.token_lines(spark.createDataFrame(list(enumerate(texts)), "k int, t string").repartition(3), "k", "t").collect()
    for i, text in enumerate(texts):
        ends, at = [], 0
        for line in text.splitlines(keepends=True):
            at += len(line)
            ends.append(at)
        mine = sorted((r.token, r.start, r.line) for r in got if r.id == i)
        assert [r[0] for r in mine] == list(range(len(mine))) and mine[0][1] == 0
        assert all(line == min(bisect.bisect_right(ends, start), len(ends) - 1) for _, start, line in mine), repr(text)


def test_encoded_rows(spark):
    text = "a b\nc d\ne"
    rows = [(1, text, 3, [1, 0, 1], ["CORE", "DROP", "SUPPORT"], [0.9, 0.8, 0.7], [5, 6, 7], [(6, 6)], 4, True), (2, text, 3, [1, 0, 1], ["CORE", "DROP", "ODD"], [0.9, 0.8, 0.7], [5, 6, 7], [], 99, False), (3, text, 3, [1, 0], ["CORE", "DROP", "DROP"], [0.9, 0.8, 0.7], [5, 6, 7], [], 9, True), (4, text, 3, [1, 0, 1], ["CORE", "DROP", "DROP"], [0.9, 0.8, 0.7], [5, 6, 7], [], 0, True)]
    df = spark.createDataFrame(rows, "id int, text string, code_lines int, line_keep_labels array<int>, line_roles array<string>, line_confidences array<double>, line_numbers array<int>, hard_spans array<struct<start:int,stop:int>>, most int, made boolean")
    tokens = alignment.token_lines(df, "id", "text")  # a, " b", "\n", c, " d", "\n", e
    got = {r.id: r for r in alignment.encoded(df.drop("text"), tokens, F.col("most"), F.col("made")).collect()}
    assert (got[1].line_index, got[1].keep, got[1].roles, got[1].hard_negative) == ([0, 0, 0, 1], [1, 1, 1, 0], [2, 2, 2, 0], [False, False, False, True])
    assert got[2].roles == [-100] * 7 and got[2].confidences == [0.9, 0.9, 0.9, 0.8, 0.8, 0.8, 0.7]
    assert got[3].error == "line arrays do not align" and got[4].error == "no tokens" and got[3].keep is None
    means = alignment.line_means(tokens.where("id = 1").withColumn("v", F.col("token").cast("double")), "v").collect()
    assert {(r.line, r["mean"], r.n) for r in means} == {(0, 1.0, 3), (1, 4.0, 3), (2, 6.0, 1)}
    b = spark.range(1).select(alignment.budgets(F.lit(50), 20, 3, 2).alias("long"), alignment.budgets(F.lit(4), 20, 3, 2).alias("short"), alignment.format_instruction("do", F.lit("why")).alias("t")).first()
    assert (tuple(b.long), tuple(b.short), b.t) == ((14, 1), (4, 11), "<Instruct>: do\n<Query>: why\n<Document>: ")
    with pytest.raises(ValueError, match="no room"):
        alignment.budgets(F.lit(1), 6, 3, 2)
