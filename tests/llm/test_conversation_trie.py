"""The conversation trie against a trie of Python tuples."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import pytest

from loam.llm import conversation_trie

ROWS = "conv_id long, turn long, role string, text string, depth long, a long, owner long"


def sha(role, text):
    return hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()[:30]


def brute(rows, span=5):
    turns = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            turns[conv].append(((turn is not None, turn or 0, sha(role or "", text or "")), (role or "", text or "")))
    plain = {c: [x for _, x in sorted(v)] for c, v in turns.items()}
    made = plain
    if span:
        made = {}
        for c, own in plain.items():
            h, base = zlib.crc32(str(c).encode()) % 9, c - (abs(c) % span) * (1 if c >= 0 else -1)
            made[c] = plain.get(base, [])[:h] + own[h:]
    members, ends, kids = defaultdict(list), defaultdict(list), defaultdict(set)
    for c in sorted(made):
        x = tuple(made[c])
        ends[x].append(c)
        for d in range(len(x) + 1):
            members[x[:d]].append(c)
            if d:
                kids[x[: d - 1]].add(x[:d])
    leaves, saved = {}, {}
    for k in sorted(members, key=len, reverse=True):
        leaves[k] = sum(leaves[j] for j in kids[k]) or 1
        saved[k] = sum(saved[j] for j in kids[k]) + ((len(members[k]) - 1) * len(k[-1][1].encode()) if k else 0)
    return sorted(
        (m[0], len(k), members[k[:-1]][0] if k else None, len(m), len(kids[k]), leaves[k], saved[k], hashlib.sha256(",".join(map(str, ends[k])).encode()).hexdigest()) for k, m in members.items()
    )


def run(spark, rows, span=5):
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], ROWS).repartition(5)
    got = conversation_trie.trie(df, span)
    return sorted(tuple(r) for r in got.collect())


def some(seed, convs=120, ids=range(-40, 400)):
    rng = random.Random(seed)
    rows = []
    for c in rng.sample(list(ids), convs):
        n = rng.choice([1, 2, 3, 8, 12])
        rows += [(c, 10 * k, "user" if k % 2 == 0 else "bot", rng.choice(["", "a", "é", "b b"])) for k in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("span", [0, 5])
def test_random_conversations(spark, span):
    rows = some(span + 1)
    assert run(spark, rows, span) == brute(rows, span)


def test_long_hot_and_nested_conversations(spark, monkeypatch):
    monkeypatch.setattr(conversation_trie, "RUN", 16)
    monkeypatch.setattr(conversation_trie, "SHARE", 4)
    rows = [(7, k, "u", str(k % 3)) for k in range(300)]  # one holds a third of the turns
    rows += [(1000 + c, k, "u", str(k % 3)) for c in range(40) for k in range(c)]  # each a turn longer: a chain of chains
    rows += [(2000 + c, 0, "u", "same") for c in range(90)]  # copies, in several chunks of ids
    assert run(spark, rows, 0) == brute(rows, 0)
    assert run(spark, rows) == brute(rows)


def test_odd_rows(spark):
    rows = [(1, None, "u", "x"), (1, 0, None, None), (1, None, None, "w"), (1, 3, "u", "y"), (1, 3, "u", "y"), (1, 3, "t", "z"), (None, 0, "u", "lost"), (6, 0, "", ""), (8, 0, "u", "é" * 70_000), (-7, 1, "u", "x"), (-5, 1, "u", "v")]
    want = brute(rows)
    assert run(spark, rows) == want
    assert [r for r in want if r[1] == 0 and r[2] is None] and any(r[3] == 5 for r in want)
    turnless = next(c for c in range(1, 500) if c % 5 and zlib.crc32(str(c).encode()) % 9 > 0)
    alone = [(turnless, 0, "u", "x")]  # its base is absent and all it has is cut off
    assert run(spark, alone) == brute(alone) == [(turnless, 0, None, 1, 0, 1, 0, hashlib.sha256(str(turnless).encode()).hexdigest())]


def test_empty_table(spark):
    assert run(spark, []) == []
