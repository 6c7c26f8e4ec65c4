"""Toxicity against a model in plain Python, with the table whole and in parts."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from loam.llm import toxicity

BAD, GOOD = ["idiot", "moronic", "trashfire", "stupidity", "loser"], ["river", "garden", "teapots", "morning", "windows", "Übung", "sunlight", "moronicity"]


def rows(n=400):
    rng = random.Random(5)
    out, marks = [], []
    for i in range(n):
        bad = rng.random() < 0.35
        words = [rng.choice(GOOD) + rng.choice(["", "s", "!", "."]) for _ in range(rng.randint(3, 40))]
        if bad:
            at = rng.randrange(len(words))
            words[at:at] = [rng.choice(BAD).upper() if rng.random() < 0.2 else rng.choice(BAD) for _ in range(rng.randint(3, 9))]
        out.append((i, " ".join(words), "x", 0))
        marks.append((i, int(bad), "t"))
    out += [(7, out[7][1], "x", 0), (None, "idiot moronic loser trashfire", "x", 0), (n, None, None, None), (n + 1, "", "y", 1), (n + 2, " \t.", "y", 1), (n + 3, "river " * 30_000 + "idiot " * 30 + "garden " * 30_000, "x", 2)]
    marks += [(9, None, "t"), (None, 1, "t"), (10_000, 1, "t"), (11, 5, "t")]
    return out, marks


def words_of(text):
    return [w.lower() for w in re.sub(rb"[^0-9A-Za-z\x80-\xff]", b" ", (text or "").encode()).split()]


def units_of(w):
    return [(0, w)] + [(k, w[:k]) for k in toxicity.PREFIXES if len(w) > k]


def plain(docs, labels, counted):
    """{(doc_id, text): score}, from the definitions."""
    label = {}
    for i, y, _ in labels:
        if i is not None and y in (0, 1) and zlib.crc32(str(i).encode()) % 5:
            label[i] = max(y, label.get(i, 0))
    train = [(i, t, label[i]) for i, t, *_ in docs if i in label]
    c = {y: Counter(u for i, t, z in train if z == y and counted[i] for w in words_of(t) for u in units_of(w)) for y in (0, 1)}
    n0, n1 = sum(c[0].values()), sum(c[1].values())
    odds, sure = {}, {}
    for u in c[0] | c[1]:
        a = 0.5 + toxicity.PRIOR * (c[0][u] + c[1][u]) / (n0 + n1)
        v = math.log((c[1][u] + a) / (n1 + toxicity.PRIOR)) - math.log((c[0][u] + a) / (n0 + toxicity.PRIOR))
        z = abs(v) / math.sqrt(1 / (c[1][u] + a) + 1 / (c[0][u] + a))
        if z > toxicity.SURE:
            odds[u], sure[u] = v * (1 - toxicity.SURE**2 / z**2) + toxicity.UNSEEN, z
    x = lambda t: [max(((sure[u], odds[u]) for u in units_of(w) if u in odds), default=(0, toxicity.UNSEEN))[1] for w in words_of(t)]
    law = Counter(v for i, t, y in train if y == 0 and counted[i] for v in x(t))
    n = sum(law.values())
    lo, hi = 1e-6, 1e3
    for _ in range(200):  # the root of a sum that rises through 1
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(m / n * math.exp(min(500, mid * v)) for v, m in law.items()) < 1 else (lo, mid)
    tilt = {v: m / n * math.exp(lo * v) for v, m in law.items()}
    k = min(1.0, max(1e-4, lo * sum(v * m for v, m in tilt.items()) / sum(tilt.values())))

    def best(x, a, b):
        """The segments of x[a:b]: the highest (first, shortest), then the same on either side of it."""
        out, todo = [], [(a, b)]
        while todo:
            a, b = todo.pop()
            top, total, low, at = (0.0, 0, 0), 0.0, 0.0, a
            for i in range(a, b):
                total += x[i]
                if total <= low:
                    low, at = total, i + 1
                elif total - low > top[0] + 1e-12:
                    top = (total - low, at, i + 1)
            if top[0] > 0:
                out.append(top[0])
                todo += [(a, top[1]), (top[2], b)]
        return out

    def features(t):
        v = x(t)
        floor = math.log(k * max(1, len(v)))
        found = [lo * s - floor for s in best(v, 0, len(v))]
        strong = [f for f in found if 1 - math.exp(-math.exp(-f)) < toxicity.SIGNIFICANT]
        return [max(found, default=-floor), sum(strong), len(strong)]

    seen = [(features(t), y) for i, t, y in train if not counted[i]]
    f, y = np.array([f for f, _ in seen]), np.array([y for _, y in seen], float)
    mean, scale = f.mean(0), np.maximum(f.std(0), 1e-9)
    z = np.hstack([(f - mean) / scale, np.ones((len(f), 1))])
    w = np.zeros(4)
    for _ in range(200):  # the slope of the penalised likelihood becomes 0
        p = 1 / (1 + np.exp(-z @ w))
        w += np.clip(np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + 1e-6 * len(z) * np.eye(4), z.T @ (y - p) - 1e-6 * len(z) * w), -5, 5)
    score = lambda g: 1 / (1 + math.exp(-max(-50, min(50, ((np.array(g) - mean) / scale) @ w[:3] + w[3]))))
    return {(i, t): score(features(t)) for i, t, *_ in docs}


def test_scores_are_those_of_plain_python(spark, monkeypatch):
    docs, labels = rows()
    frame = spark.createDataFrame(docs, "doc_id long, text string, label string, token long").repartition(3)
    marks = spark.createDataFrame(labels, "doc_id long, toxic int, text string")
    counted = {r.doc_id: r.c for r in frame.select("doc_id", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0).alias("c")).collect()}
    want = plain(docs, labels, counted)
    held = lambda i: None if i is None else zlib.crc32(str(i).encode()) % 5 == 0

    def check():
        got = toxicity.report(frame, marks).collect()
        assert sorted((str(r.doc_id) for r in got)) == sorted(str(d[0]) for d in docs)
        text = {d[0]: d[1] for d in docs}
        for r in got:
            assert abs(r.score - want[r.doc_id, text[r.doc_id]]) < 1e-6 and r.held_out == held(r.doc_id) and r.predicted == int(r.score >= 0.5)
        return {(r.doc_id, r.score) for r in got}

    whole = check()
    monkeypatch.setattr(toxicity, "TOKENS", 3)  # the table in parts
    model = toxicity.fit(frame, marks.where(~toxicity.held_out()))
    assert model.parts > 2 and not len(model.tokens) and model.large.count() > 6
    assert check() == whole
