"""Spelling variants against all pairs of words in plain Python."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np

from loam.llm import spelling

ROWS = "doc_id long, text string, word string, key long, n long"


def words(rows):
    count = Counter()
    for doc, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            count[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in count.items() if len(w) >= 7 and n >= 2}


def distance_one(a, b):
    return a != b and ((len(a) == len(b) and sum(x != y for x, y in zip(a, b, strict=True)) == 1) or (len(a) == len(b) + 1 and any(a[:i] + a[i + 1 :] == b for i in range(len(a)))) or (len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))))


def brute(rows):
    n, out = words(rows), {}
    for w in n:
        near = sorted((-n[x], x) for x in n if distance_one(w, x))
        out[w] = (near[0][1] if near and -near[0][0] >= 10 * n[w] else None, n[w], len(near), -near[0][0] if near and -near[0][0] >= 10 * n[w] else None)
    def root(w):
        return root(out[w][0]) if out[w][0] else w
    return sorted((w, f, root(w), c, m, k) for w, (f, c, m, k) in out.items())


def run(spark, rows):
    df = spark.createDataFrame([(i, t, "w", 1, 2) for i, t in rows], ROWS).repartition(4)
    got = spelling.variants(df)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted((tuple(r) for r in got.collect()), key=lambda r: r[0])


def texts(seed, docs=40):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abéÿ") for _ in range(rng.randint(6, 10))) for _ in range(60)] + ["aaaaaaa", "aaaaaaaa", "aaaaaaaaa", "abababab", "babababa"]
    def typo(w):
        i = rng.randrange(len(w) + 1)
        return rng.choice([w[:i] + "c" + w[i:], w[:i] + w[i + 1 :], w[:i] + "b" + w[i + 1 :]])
    return [(d, ", ".join(w.title() if rng.random() < 0.2 else typo(w) if rng.random() < 0.3 else w for w in rng.choices(base, weights=range(1, 66), k=150))) for d in range(docs)]


def test_against_all_pairs(spark):
    rows = texts(4)
    want = brute(rows)
    assert run(spark, rows) == want
    assert sum(r[1] is not None for r in want) > 20 and sum(r[4] for r in want) > 300


def test_shared_ends_are_split_over_shards(spark, monkeypatch):
    monkeypatch.setattr(spelling, "SHARD", 20)
    monkeypatch.setattr(spelling, "TILE", 50)
    monkeypatch.setattr(spelling, "HELD", 30)
    rng = random.Random(9)
    hot = ["pre" + "".join(rng.choice("xyz") for _ in range(rng.randint(4, 6))) for _ in range(200)]  # all share their first segment
    rows = texts(5, 10) + [(100 + k, " ".join(rng.choices(hot, k=100))) for k in range(20)]
    assert run(spark, rows) == brute(rows)


def test_chains_of_forms(spark):
    rows = [(1, " ".join(["abcdefgh"] * 1000 + ["abcdefg"] * 100 + ["abcdef", "abcdexg", "abcdexg", "zbcdexg"] * 5))]
    want = brute(rows)
    assert run(spark, rows) == want and any(r[1] and r[1] != r[2] for r in want)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "short words only"), (None, "nullable nullable Nullable"), (4, "zwölfmal zwölfmal ZWÖLFMAL zwÖlfmal"), (4, "zwölfmal zwölfmal ZWÖLFMAL zwÖlfmal"), (5, "x" * 200_000 + " " + "x" * 200_000), (6, "naïveté_naïveté-naïveté×naïveté日本naïveté"), (7, "combinińg combinińg")]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []


def test_edits():
    rng = random.Random(1)
    for n, m in ((3, 3), (3, 4), (4, 3), (1, 2), (2, 1), (0, 1), (1, 1), (0, 0), (2, 4)):
        a, b = (["".join(rng.choice("ab") for _ in range(k)) for _ in range(30)] for k in (n, m))
        want = np.array([[distance_one(x, y) for y in b] for x in a])
        assert (np.array([[spelling.one_edit(x, y) for y in b] for x in a]) == want).all()
        if abs(n - m) < 2:
            assert (spelling.edits(spelling._coded(a), spelling._coded(b)) == want).all()
