"""Cases that the larger tests of the corpus operators pass by: smallest sets, repeated ids with other payloads."""

from __future__ import annotations

import base64
import hashlib
import math
import random
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from loam.llm import language_model, minhash, queries, warc, word_model


@pytest.mark.parametrize("num", [75, 80])
def test_smallest_sets_at_the_threshold(spark, num):
    rng, rows, linked = random.Random(num), [], {}
    for n in range(1, 8):
        for more in range(0, 4):
            for _ in range(12):
                a = [f"w{len(rows)}x{k}" for k in range(n)]
                b = [*a, *[f"w{len(rows)}y{k}" for k in range(more)]]
                rng.shuffle(b)
                i = len(rows)
                rows += [(i, " ".join(a)), (i + 1, " ".join(b))]
                linked[i] = n * 100 >= num * (n + more)
    got = {r.doc_id: r for r in minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=1, num=num).collect()}
    for i, yes in linked.items():
        assert got[i].component_id == i and got[i + 1].component_id == (i if yes else i + 1), (rows[i], rows[i + 1])
        assert got[i + 1].kept == (not yes)
    assert linked[2 * 12 * (2 * 4 + 1)] == (num == 75)  # 3 of 4


@pytest.mark.parametrize("rows", [[(5, "aaa"), (5, "bbbbb"), (3, "aaa")], [(5, "aaa"), (5, "bbbbb"), (5, None), (3, "bbbbb"), (2, ""), (9, "cc"), (9, "cc"), (8, "cc"), (None, "aaa")]])
def test_page_ids_with_several_payloads(spark, rows):
    top = {}
    for page, html in rows:
        if page is not None:
            top[html or ""] = max(page, top.get(html or "", page))
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    want = sorted((p, len((h or "").encode()), sha(h or ""), "response" if top[h or ""] == p else "revisit", None if top[h or ""] == p else top[h or ""]) for p, h in rows if p is not None)
    pages = spark.createDataFrame([(p, "u", h, 1, "x", 2) for p, h in rows], "page_id long, url string, html string, payload_bytes int, digest string, n int")
    assert sorted(map(tuple, warc.round_trip(pages).collect())) == want


def test_scores_from_counts_of_all_texts(spark):
    """op3's score against plain Python, over several chunks and shards; a word that one learning text alone holds counts."""
    rng = random.Random(5)
    texts = [" ".join(rng.choice("Ab ba cc dd EE fü g".split()) for _ in range(rng.randrange(9))) + (f" only{k}" if k % 3 else "") for k in range(400)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(400, None), (3, texts[3]), (None, "ba zz")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    low = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)
    made = [(d, [*(t or "").translate(low).split(), None]) for d, t in rows]
    learned = [w for d, w in made if d is not None and zlib.crc32(str(d).encode()) % 7 != 2]
    one = Counter(x for w in learned for x in w)
    two = Counter(p for w in learned for p in zip([0, *w], w))
    total, once = sum(one.values()), sum(v == 1 for v in one.values())
    want = defaultdict(list)
    for d, w in made:
        p = lambda x: (one[x] or once) / (total + once)
        want[d].append(sum(math.log10((two[v, x] + 100 * p(x)) / ((len(learned) if v == 0 else one[v]) + 100)) for v, x in zip([0, *w], w)))
    got = defaultdict(list)
    for r in language_model.report(docs).collect():
        got[r.doc_id].append(r.score)
    assert set(got) == set(want) and all(len(got[d]) == len(want[d]) and max(abs(a - b) for a, b in zip(got[d], want[d])) < 1e-9 for d in want)
    x = np.sort(np.random.default_rng(1).integers(0, 1 << 63, 1000).astype(np.uint64))
    assert (word_model.unpack(word_model.pack(x, True), True) == x).all() and (word_model.unpack(word_model.pack(x[::-1])) == x[::-1]).all()


def test_contexts_of_three_words(spark, tmp_path):
    """op3 against plain Python with runs of up to four tokens; a held-out text that was learned from in another document is
    told from one of the same words in other order."""
    rng = random.Random(8)
    vocabulary = [f"w{k}" for k in range(12)]
    learned, held = ([k for k in range(400) if (zlib.crc32(str(k).encode()) % 7 == 2) == x] for x in (False, True))
    rows = {k: [rng.choice(vocabulary) for _ in range(rng.randrange(4) if k % 9 == 0 else 40)] for k in learned}
    twins, mixed = held[::2], held[1::2]
    rows |= {k: rows[learned[3 * i + 1]] for i, k in enumerate(twins)}
    rows |= {k: rng.sample(rows[twins[i]], len(rows[twins[i]])) for i, k in enumerate(mixed)}
    spark.createDataFrame([(k, " ".join(w)) for k, w in rows.items()], "doc_id long, text string").repartition(6).write.parquet(f"file://{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op3_lm_scoring(spark, f"file://{tmp_path}").collect()}
    grams = lambda w, n: zip(*[([0] * (n - 1) + w)[k : k + len(w)] for k in range(n)])
    counts = [Counter(g for k in learned for g in grams([*rows[k], None], n)) for n in range(1, 5)]
    total, once = sum(counts[0].values()), sum(v == 1 for v in counts[0].values())
    for k, words in rows.items():
        want = 0.0
        for gram in grams([*words, None], 4):
            p = (counts[0][gram[3:]] or max(1, once)) / (total + max(1, once))
            for n, weight in ((2, 100), (3, 300), (4, 1)):
                before = gram[4 - n : 3]
                p = (counts[n - 1][gram[4 - n :]] + weight * p) / ((counts[n - 2][before] if before[-1] else len(learned)) + weight)
            want += math.log10(p)
        assert abs(got[k].score - want) < 1e-9
    per = lambda ks: [got[k].score / got[k].n_tokens for k in ks if got[k].n_tokens > 20]
    assert min(per(twins)) > max(per(mixed))
