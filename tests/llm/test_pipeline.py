"""The quality query and the whole pipeline against plain Python, on a table with nulls, repeats and a long text."""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from loam.llm import packing, quality

SF = "/root/testdata/sf0.01"
NAMES = ["doc_id", "text", "lang", "source", "n_chars", "key"]
ODD = [(90_001, None), (90_002, ""), (90_003, " \n\t"), (None, "a row without a number"), (None, None), (90_004, "word " * 30_000), (90_005, "?" * 200_000)]
WORDS, BARE = re.compile(r"[^\x20\x09-\x0D]+"), re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """(rows of documents, {doc_id: quality}, [(item_id, text)], folder of the tables)"""
    folder = f"file://{tmp_path_factory.mktemp('tables')}"
    docs = [(*r, "k") for r in spark.read.parquet(f"{SF}/documents.parquet").select(*NAMES[:-1]).collect()]
    docs += [docs[5], docs[11]] + [(i, t, None, "s", len(t or ""), None) for i, t in ODD]
    docs.append((90_006, " ".join(docs[20][1].split()[:60] + ["tail"]), None, "s", 0, "k"))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long, key string").repartition(5).write.parquet(f"{folder}/documents.parquet")
    marks, items = spark.read.parquet(f"{SF}/labels.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    marks.withColumn("text", F.lit("clash")).unionByName(marks.limit(1).withColumn("doc_id", F.lit(None).cast("long")).withColumn("text", F.lit(None))).write.parquet(f"{folder}/labels.parquet")
    items.withColumn("lang", F.lit(1)).write.parquet(f"{folder}/benchmark.parquet")
    return docs, {r.doc_id: r.quality for r in marks.collect()}, [(r.item_id, r.text) for r in items.collect()], folder


def drawn(doc_id: int) -> int:
    return xxhash.xxh64_intdigest(struct.pack("<i", 11), xxhash.xxh64_intdigest(struct.pack("<q", doc_id), 42)) % (1 << 20)


def discounts(counts):
    n = Counter(v for v in counts.values() if v <= 4)
    y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
    d = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k for k in (1, 2, 3)]
    d = [max(0.05, min(k + 0.95, x)) for k, x in enumerate(d)]
    return lambda v: d[min(v, 3) - 1]


class KneserNey:
    def __init__(self, texts):
        tri = Counter(g for t in texts for g in self.grams(t))
        bi = Counter((b, c) for _, b, c in tri)
        uni = Counter((c,) for _, c in bi)
        self.words = len(uni) + 1
        self.orders = []
        for counts in (uni, bi, tri):
            less, total, left = discounts(counts), Counter(), Counter()
            for g, v in counts.items():
                total[g[:-1]] += v
                left[g[:-1]] += less(v)
            self.orders.append((counts, less, total, left))

    @staticmethod
    def grams(text):
        w = ["<s>", "<s>", *WORDS.findall(text)]
        return zip(w, w[1:], w[2:], strict=False)

    def log_ppl(self, text):
        got = [self.chance(g) for g in self.grams(text)]
        return -sum(math.log10(p) for p in got) / len(got) if got else None

    def chance(self, g):
        p = 1 / self.words
        for k, (counts, less, total, left) in enumerate(self.orders):
            own, before = g[2 - k :], g[2 - k : 2]
            if before in total:
                p = max(0, counts[own] - less(counts[own]) if own in counts else 0) / total[before] + left[before] / total[before] * p
        return p


def judged(docs, marks):
    """[(kept, log_ppl, (low, high))] of each row."""
    trusted = {i for i, q in marks.items() if q == 1}
    known = {(i, lang) for i, t, lang, *_ in docs if t is not None and i in trusted}
    sizes = Counter(lang for _, lang in known)
    rate = {lang: math.floor(min(1 / 2, quality.TRUSTED / len(sizes) / n) * (1 << 20)) for lang, n in sizes.items()}
    counted = {i for i, lang in known if drawn(i) < rate[lang]}
    model = KneserNey([t for i, t, *_ in docs if t is not None and i in counted])
    scores = [model.log_ppl(t or "") for _, t, *_ in docs]
    size = [max(1, len(WORDS.findall(t or ""))).bit_length() - 1 for _, t, *_ in docs]
    groups = defaultdict(list)
    for (i, _, lang, *_), s, n in zip(docs, scores, size, strict=True):
        if s is not None and i in trusted - counted:
            for by in ((lang, n), (lang,), ()):
                groups[by].append(s)

    def bounds(by):
        x = sorted(groups[by])
        low, mid, high = (x[max(1, math.ceil(q * len(x))) - 1] for q in (0.01, 0.5, 0.99))
        return low + 0.8 * (low - mid), high + 0.8 * (high - mid)

    out = []
    for (_, _, lang, *_), s, n in zip(docs, scores, size, strict=True):
        by = next(b for b in ((lang, n), (lang,), ()) if not b or lang is not None and len(groups[b]) >= 60)
        low, high = bounds(by)
        assert s is None or min(abs(s - low), abs(s - high)) > 1e-5  # shares are kept in single precision
        out.append((s is not None and low <= s <= high, s, (low, high)))
    return out


def without_lines(docs):
    seen, out = {}, []
    spots = lambda t: [tuple(t.split("\n")[k : k + 3]) for k in range(t.count("\n") - 1)]
    numbered = [(i, t) for i, t, *_ in docs if i is not None and t is not None]
    for i, t in sorted(numbered):
        for k, w in enumerate(spots(t)):
            seen.setdefault(w, (i, k))
    for row in docs:
        i, t = row[:2]
        if i is not None and t is not None:
            gone = {k + j for k, w in enumerate(spots(t)) if seen[w] != (i, k) for j in range(3)}
            t = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in gone) if gone else t
        out.append((i, t, *row[2:4], row[4] if t == row[1] else len(t), *row[5:]))
    return out


def one_of_each(docs):
    sets, by, up = {}, defaultdict(set), {}
    for i, t, *_ in docs:
        w = WORDS.findall((t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()

    def top(i):
        while up.get(i, i) != i:
            i = up[i]
        return i

    for i in sorted(i for i in sets if i is not None):
        shared = Counter(j for g in sets[i] for j in by[g])
        for j, n in shared.items():
            if 100 * n >= 80 * (len(sets[i]) + len(sets[j]) - n):
                a, b = sorted((top(i), top(j)))
                up[b] = a
        for g in sets[i]:
            by[g].add(i)
    return [r for r in docs if r[0] is None or top(r[0]) == r[0]]


def unleaked(docs, items):
    grams = defaultdict(set)
    for _, t in items:
        w = BARE.findall((t or "").translate(LOWER))
        for k in range(max(1, len(w) - 9) if w else 0):
            grams[len(w[k : k + 10])].add(tuple(w[k : k + 10]))

    def hit(t):
        w = BARE.findall((t or "").translate(LOWER))
        return any(tuple(w[k : k + n]) in g for n, g in grams.items() for k in range(len(w) - n + 1))

    return [r for r in docs if r[0] is None or not hit(r[1])]


def test_quality_query(spark, made):
    docs, marks, _, folder = made
    table = spark.createDataFrame([(*r[:5], k) for k, r in enumerate(docs)], "doc_id long, text string, lang string, source string, n_chars long, key long").repartition(4)
    got = quality.classify(table, spark.read.parquet(f"{folder}/labels.parquet")).collect()
    want = Counter((r[0], kept, s and round(s, 4), round(low, 4), round(high, 4)) for r, (kept, s, (low, high)) in zip(docs, judged(docs, marks), strict=True))
    have = Counter((r.doc_id, r.kept, r.log_ppl and round(r.log_ppl, 4), round(r.low, 4), round(r.high, 4)) for r in got)
    close = lambda c: sorted(c.elements(), key=str)
    assert len(got) == len(docs)
    for a, b in zip(close(have), close(want), strict=True):
        assert a[:2] == b[:2] and (a[2] is None) == (b[2] is None)
        assert max(abs((x or 0) - (y or 0)) for x, y in zip(a[2:], b[2:], strict=True)) < 3e-4


def test_run_and_each_stage(spark, made):
    docs, marks, items, folder = made
    bad = {r[0] for r, (kept, *_) in zip(docs, judged(docs, marks), strict=True) if not kept}
    kept = [r for r in docs if r[0] is None or r[0] not in bad]
    wanted = [kept, without_lines(kept)]
    wanted.append(one_of_each(wanted[-1]))
    wanted.append(unleaked(wanted[-1], items))
    assert len(docs) > len(wanted[0]) > len(wanted[2]) > len(wanted[3]) and wanted[0] != wanted[1]
    now = spark.read.parquet(f"{folder}/documents.parquet")
    for (name, stage), want in zip(corpus_pipeline.STAGES, wanted, strict=False):
        rows = stage(spark, now, folder)
        assert rows.columns == NAMES
        assert Counter(map(tuple, rows.collect())) == Counter(want), name
        now = spark.createDataFrame(want, rows.schema).repartition(3)

    ids = Tokenizer.from_file(packing.default_ranks().replace(".tiktoken", ".json"))
    pieces = Counter()
    for r in wanted[-1]:
        own = [*ids.encode(r[1] or "", add_special_tokens=False).ids, 2]
        cuts = [0, *range(len(own) % 1024 or 1024, len(own), 1024), len(own)]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            pieces[r[0], k, a, b - a, zlib.crc32(struct.pack(f"<{b - a}I", *own[a:b]))] += 1
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == pieces
    sequences = defaultdict(list)
    for r in got:
        sequences[r.sequence_id].append((r.offset, r.length))
    for spots in sequences.values():
        ends = [0]
        for at, n in sorted(spots):
            assert at == ends[-1]
            ends.append(at + n)
        assert ends[-1] <= 1024


def test_empty_tables(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"file://{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
