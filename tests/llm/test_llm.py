"""The corpus operators against plain Python, on small tables with nulls, ties, repeats and clashing columns."""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from loam.llm import decontaminate, embedding_join, language_model, line_dedup, minhash, packing, quality, substring_dedup, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string"


def texts():
    rng = random.Random(5)
    syl = "the on ti in er an re th ou at ed nd ha".split()
    word = lambda: "".join(rng.choice(syl) for _ in range(rng.randint(1, 3)))
    out = [" ".join(word() for _ in range(rng.randint(20, 200))) for _ in range(60)]
    out += ["\n".join(" ".join(word() for _ in range(8)) for _ in range(12)) for _ in range(10)]
    for k in range(25):  # near copies
        w = out[k % 5].split()
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = word()
        out.append(" ".join(w))
    out += [out[3], out[3], out[61] + "\n" + out[62], "", "one", "One", "a b", "a " * 3000, "é" * 300, out[7][:150] * 3]
    return out


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, t, "en", "s", len(t), "k") for i, t in enumerate(texts())] + [(900, None, None, None, None, None)]
    return rows, spark.createDataFrame(rows, DOCS).repartition(3).cache()


def union(nodes, pairs):
    p = {n: n for n in nodes}

    def find(x):
        while p[x] != x:
            x = p[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        p[b] = a
    return {n: find(n) for n in nodes}


def test_packing_round_trip(spark, table):
    rows, df = table
    enc = packing.encoder(packing.default_ranks())
    got = packing.pack(df).collect()
    by, seqs = defaultdict(list), defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
        seqs[r.sequence_id].append((r.offset, r.length))
    for r in rows:
        parts = sorted(by[r[0]], key=lambda p: p.piece)
        ids = np.concatenate([np.frombuffer(p.ids, "<i4") for p in parts]).tolist()
        assert ids == enc.encode_ordinary(r[1] or "") + [2]
        assert [p.start for p in parts] == [sum(q.length for q in parts[:k]) for k in range(len(parts))]
        assert all(p.length == 1024 for p in parts[1:])
    for spots in seqs.values():
        end = 0
        for o, n in sorted(spots):
            assert o == end
            end += n
        assert end <= 1024


def test_encoder_equals_the_vocabulary(table):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = packing.encoder(packing.default_ranks())
    for x in [r[1] for r in table[0] if r[1]] + ["a  b\n\n c\t", "l'été 12 3 😀", "  \n "]:
        assert t.encode(x, add_special_tokens=False).ids == enc.encode_ordinary(x)


def test_substrings(spark, table):
    rows, df = table
    got = {r.doc_id: r for r in substring_dedup.remove_repeats(df).collect()}
    seen = set()
    for i, text, *_ in sorted(rows):
        raw = (text or "").encode()
        gone = np.zeros(len(raw), bool)
        for s in range(len(raw) - 99):
            w = raw[s : s + 100]
            gone[s : s + 100] |= w in seen
            seen.add(w)
        kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
        assert (got[i].n_bytes, got[i].n_removed, bytes(got[i].kept)) == (len(raw), int(gone.sum()), kept)
        assert got[i].kept_sha256 == hashlib.sha256(kept).hexdigest()


def test_added_tokens_in_a_text(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    enc = packing.encoder(packing.default_ranks())
    end = "<|endoftext|>"
    odd = [f"end{end}next", f"a {end} b", end, f"a{end}{end}\n x  {end}  ", f" \n {end}'s 12  ", "<|endoftext|", "<|fim|> x", f"  a  \n\n{end}é"]
    want = [t.encode(x, add_special_tokens=False).ids for x in odd]
    assert [packing.encode(enc, x) for x in odd] == want and want[0] == [437, 50256, 19545]
    docs = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    got = {r.doc_id: np.frombuffer(r.ids, "<i4").tolist() for r in packing.pack(docs).collect()}
    assert got == {i: [*x, 2] for i, x in enumerate(want)}
    raw = [x.encode() for x in odd]
    ids, _ = language_model.subwords(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), packing.default_ranks())
    assert (ids == 50256).sum() == sum(x.count(end) for x in odd) and ids.max() < language_model.PUBLIC_IDS
    assert language_model.score(docs, F.lit(True), rounds=-1).where("isnan(score) or score is null").count() == 0


@pytest.mark.parametrize("chunk", [2, 20_000])
def test_substrings_of_a_document_given_twice(spark, monkeypatch, chunk):
    import pyarrow as pa

    rng = random.Random(10)
    some = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    passage = some(300)
    rows = [(1, some(200) + passage + some(200)), (2, some(200) + passage + some(200)), (3, some(400))]
    want = {1: 0, 2: 300, 3: 0}
    for parts in (1, 5):  # its rows in one batch, and in several
        got = substring_dedup.remove_repeats(spark.createDataFrame(rows + rows[:2] + rows[:1], "doc_id long, text string").repartition(parts)).collect()
        assert len(got) == 6 and all(r.n_removed == want[r.doc_id] for r in got)
    # rows of one segment in a chunk, and over several
    monkeypatch.setattr(substring_dedup, "CHUNK_ROWS", chunk)
    raw = passage.encode()
    seg = [(7, d, 0, 201, raw) for d in (1, 1, 1, 2, 2)]
    cols = [pa.array(c, t) for c, t in zip(zip(*seg, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)]
    batch = pa.RecordBatch.from_arrays(cols, ["h", "doc", "a", "n", "raw"])
    marks = [m for out in substring_dedup._marks([batch.slice(k, 1) for k in range(5)], 100) for m in out.to_pylist()]
    assert marks == [{"doc": 2, "a": 0, "n": 201}]


def test_previous_factors():
    rng = np.random.default_rng(2)
    for _ in range(30):
        s = "".join(rng.choice(list("ab"), 40))
        sa = sorted(range(40), key=lambda i: s[i:])
        common = lambda i, j: next((k for k in range(41) if i + k >= 40 or j + k >= 40 or s[i + k] != s[j + k]), 0)
        lcp = np.array([0] + [common(sa[k - 1], sa[k]) for k in range(1, 40)])
        got = substring_dedup.previous_factors(np.array(sa), lcp)
        assert {sa[k]: int(got[k]) for k in range(40)} == {i: max((common(i, j) for j in range(i)), default=0) for i in range(40)}


@pytest.mark.parametrize("width", [2, 5])
def test_minhash(spark, table, width):
    rows, df = table
    sets = {}
    for i, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + width]) for k in range(len(w) - width + 1)} if len(w) >= width else {tuple(w)} - {()}
    pairs = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    comp = union(sets, pairs)
    got = {r.doc_id: r for r in minhash.near_duplicates(df, width).collect()}
    assert {i: r.component_id for i, r in got.items()} == comp
    assert all(r.n_shingles == len(sets[i]) and r.kept == (i == comp[i]) for i, r in got.items())
    assert minhash.drop_near_duplicates(df, width).columns == df.columns


def test_minhash_runs_of_small_sets(spark):
    """Sets of up to 20 values and all their subsets that are linked with them share as many runs as the filters ask for."""
    values = np.sort(np.random.default_rng(8).integers(0, 1 << 62, 20).astype(np.uint64))
    least = dict(spark.range(2, 21).select(F.col("id").cast("int"), minhash.least_shared(F.col("id"), 0.2).cast("int")).collect())
    for n in range(4, 21):
        x = values[:n]
        mine = set(minhash.run_keys(x, n).tolist())
        for d in range(1, n // 5 + 1):
            for gone in itertools.combinations(range(n), d):
                y = np.delete(x, list(gone))
                if 100 * len(y) >= 80 * n:
                    assert len(mine & set(minhash.run_keys(y, len(y)).tolist())) >= max(least[n], least[len(y)]), (n, gone)


def test_minhash_linked_pairs_of_all_sizes_meet():
    """Recall of the sketches' lists for pairs at the threshold, by size; exact up to 0.8 K values."""
    rng = np.random.default_rng(9)
    for n in (13, 16, 40, 76, 120, 300, 1000, 4000):
        for _ in range(200):
            u = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
            out = rng.permutation(len(u))[: len(u) // 5]
            cut = rng.integers(0, len(out) + 1)
            x, y = np.delete(u, out[:cut]), np.delete(u, out[cut:])
            assert 100 * len(np.intersect1d(x, y)) >= 80 * len(u)
            shared = len(set(minhash.run_keys(x[: minhash.K], len(x)).tolist()) & set(minhash.run_keys(y[: minhash.K], len(y)).tolist()))
            assert shared >= minhash.SHARED, n


def test_minhash_blocks_against_plain_sets():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 62, 300).astype(np.uint64)
    sets = []
    for _ in range(90):
        keep = base[rng.random(300) > rng.choice([0.02, 0.1, 0.2])]
        sets.append(np.unique(np.concatenate([keep, rng.integers(0, 1 << 62, rng.integers(0, 40)).astype(np.uint64)])))
    sets += [np.unique(rng.integers(0, 1 << 62, 50).astype(np.uint64)), base[:1]]
    got = minhash.similar(sets, 30, 80, 100)
    for i in range(30):
        for j in range(len(sets)):
            a, b = set(sets[i].tolist()), set(sets[j].tolist())
            assert i == j or got[i, j] == (100 * len(a & b) >= 80 * len(a | b)), (i, j)


def test_minhash_families_and_several_blocks(spark, monkeypatch):
    """Copies around the threshold of one text, a row given twice, and one doc_id with two texts, in blocks of a few."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "MEMBERS", 5)
    rng = random.Random(12)
    base = [f"w{rng.randrange(400)}" for _ in range(120)]
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.choice([0, 2, 5, 7, 8, 9, 10, 14])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(60)}"
        rows.append((1000 - i, " ".join(w)))
    rows += [rows[5], (2000, "a b c d e"), (2000, rows[7][1]), (None, rows[8][1])]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len(got) == len(rows) - 1
    by = {}
    for d, t in rows[:121]:
        w = t.split()
        by[d] = {tuple(w[k : k + 2]) for k in range(len(w) - 1)}
    links = [(a, b) for a, b in itertools.combinations(by, 2) if 100 * len(by[a] & by[b]) >= 80 * len(by[a] | by[b])]
    want = union(sorted(by), links)
    for r in got:
        if r.doc_id != 2000:
            assert r.component_id == want[r.doc_id], r
    assert sorted(r.n_shingles for r in got if r.doc_id == 2000) == sorted([4, len(by[rows[7][0]])])


def test_minhash_of_texts_cut_short(spark):
    rng = random.Random(9)
    rows = []
    for k in range(100):  # 16 pairs of words; and the 13 first of them
        words = [f"w{k}x{rng.randrange(10**9)}" for _ in range(17)]
        rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(words[:14]))]
    got = minhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert all(r.component_id == r.doc_id // 2 * 2 for r in got)


def test_lines(spark, table):
    rows, df = table
    seen, want = set(), {}
    for i, text, *_ in sorted(rows):
        ls = (text or "").split("\n")
        gone = set()
        for k in range(len(ls) - 2):
            w = tuple(ls[k : k + 3])
            if w in seen:
                gone |= {k, k + 1, k + 2}
            seen.add(w)
        want[i] = None if text is None else "\n".join(x for k, x in enumerate(ls) if k not in gone)
    got = line_dedup.dedup_lines(df)
    assert got.columns == df.columns and {r.doc_id: r.text for r in got.collect()} == want


def test_benchmark(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven"), (2, "Short item!"), (3, None), (4, "...")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x TWO three, four five six seven eight nine ten eleven y", "a"), (2, "a short  ITEM here", "b"), (3, "clean", "c"), (4, None, "d"), (None, "short item", "e")], "doc_id long, text string, hit string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in decontaminate.report(docs.where("doc_id is not null"), items).collect()}
    assert got == {1: (12, 10, 1), 2: (4, 2, 1), 3: (1, 0, 0), 4: (0, 0, 0)}
    assert {r.doc_id for r in decontaminate.decontaminate(docs, items).collect()} == {3, 4, None}
    assert {r.doc_id: r.text for r in decontaminate.decontaminate(docs, items, remove="spans").collect()}[1] == "x y"


@pytest.mark.parametrize("most", [(64 << 20, 4_000_000), (0, 4_000_000), (0, 0)])
def test_benchmark_by_either_join(spark, monkeypatch, most):
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", most[0])
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", most[1])
    rng = random.Random(8)
    say = lambda n: [rng.choice("ab cd ef gh".split()) for _ in range(n)]
    items = [(i, " ".join(say(n))) for i, n in enumerate([14, 12, 10, 11, 4, 3, 7])] + [(90, None), (91, "--")]
    docs = [(i, " ".join(say(rng.randint(0, 40)) + (items[i % 7][1].upper().split() if i % 3 == 0 else []) + say(9))) for i in range(40)]
    docs += [docs[0], (3, "ab"), (3, "--"), (70, None), (71, ""), (72, " ".join(say(3000))), (None, items[1][1]), (None, "zz")]
    words = lambda t: re.findall(r"[a-z0-9]+", (t or "").lower())
    grams = {(i, tuple(w[k : k + 10])) for i, t in items for w in [words(t)] if w for k in range(max(1, len(w) - 9))}
    want = defaultdict(lambda: [0, set(), set()])
    for i, t in docs:
        w, row = words(t), want[i]
        row[0] = max(row[0], len(w))
        for item, g in grams:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    row[1].update(range(k, k + len(g)))
                    row[2].add(str(item))
    d, b = spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.report(d, b).collect()}
    assert got == {i: (n, len(h), len(x), hashlib.sha256(",".join(sorted(x)).encode()).hexdigest()) for i, (n, h, x) in want.items()}
    left = decontaminate.decontaminate(d, b, remove="spans").where("doc_id = 6 or doc_id is null").collect()
    assert {r.text for r in left if r.doc_id == 6} == {" ".join(w for k, w in enumerate(words(docs[6][1])) if k not in want[6][1])}
    assert {r.text for r in left if r.doc_id is None} == {items[1][1], "zz"}
    assert decontaminate.report(d.limit(0), b).count() == 0 and decontaminate.report(d, b.limit(0)).where("contaminated").count() == 0


def test_embeddings(spark):
    rng = np.random.default_rng(3)
    base = rng.standard_normal((40, 16))
    rows = [(i, [float(x) for x in base[i % 40] + rng.standard_normal(16) * (0.25 if i >= 40 else 0)]) for i in range(200)]
    rows += [(300, None), (301, [0.0] * 16), (302, [float("nan")] * 16), (303, rows[0][1]), (304, [2 * x for x in rows[0][1]]), (305, [])]
    got = {r.vec_id: r for r in embedding_join.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    ok = {i: np.array(v) / np.linalg.norm(v) for i, v in rows if v and np.isfinite(v).all() and any(v)}
    pairs = [(a, b) for a in ok for b in ok if a < b and ok[a] @ ok[b] >= 0.9]
    comp, deg = union([i for i, _ in rows], pairs), Counter(x for p in pairs for x in p)
    assert {i: (r.component_id, r.n_links) for i, r in got.items()} == {i: (comp[i], deg[i]) for i, _ in rows}


@pytest.mark.parametrize("group", [1, 3])
def test_embeddings_in_many_blocks(spark, monkeypatch, group):
    for name, value in (("BLOCK", 32), ("FAN", 2), ("GROUP", group)):
        monkeypatch.setattr(embedding_join, name, value)
    monkeypatch.setattr(embedding_join.math, "sqrt", lambda x: 1.0)  # as if there were few cores: groups of GROUP intervals
    rng = np.random.default_rng(12)
    centres = rng.standard_normal((40, 12))
    made = [centres[k % 40] * (1 + k % 3) + rng.standard_normal(12) * rng.choice([0.1, 0.4, 0.55]) for k in range(1400)]  # families across blocks
    made += [made[5]] * 30 + [x for x in rng.standard_normal((200, 12))]
    rows = [(7 * i, [float(x) for x in v]) for i, v in enumerate(made)]
    rows += [(0, rows[900][1]), (99_999, [1.0, 2.0]), (99_998, [2.0, 4.0])]  # an id with another vector, and another length
    x = np.array([v for _, v in rows[:-2]])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    i, j = np.nonzero(np.triu(unit @ unit.T >= 0.9, 1))
    ids = [r[0] for r in rows]
    links = Counter([*i.tolist(), *j.tolist(), len(rows) - 2, len(rows) - 1])
    comp = union(ids, [(ids[a], ids[b]) for a, b in zip(i.tolist(), j.tolist(), strict=True)] + [(99_998, 99_999)])
    got = embedding_join.link(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(6)).collect()
    assert len(got) == len(rows) and len(i) > 10_000 and len(set(comp.values())) > 100
    assert all(r.component_id == comp[r.vec_id] and r.kept == (r.vec_id == comp[r.vec_id]) for r in got)
    most = {}
    for k, v in enumerate(ids):
        most[v] = max(most.get(v, 0), links[k])
    assert all(r.n_links == most[r.vec_id] for r in got)


def test_segments_are_the_maximal_ones():
    rng = np.random.default_rng(4)

    def slow(x, at=0):  # the best segment, then the same left and right of it
        best = max(((sum(x[a:b]), -(b - a), a, b) for a in range(len(x)) for b in range(a + 1, len(x) + 1)), default=None)
        if best is None or best[0] <= 0:
            return []
        _, _, a, b = best
        return slow(x[:a], at) + [(at + a, at + b)] + slow(x[b:], at + b)

    for _ in range(50):
        x = rng.standard_normal(14)
        assert [(a, b) for a, b, _ in toxicity.segments(x)] == slow(list(x))


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.report(docs, marks).join(marks, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.93
    hit = got[got.predicted == 1]
    assert (hit.toxic == 1).mean() > 0.8 and (got[got.toxic == 1].predicted == 1).mean() > 0.6
    none = toxicity.score(docs.limit(5), toxicity.fit(docs, marks.limit(0)))
    assert none.where("score < 0.5").count() == 5


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "<p>x</p>"), (2, "http://b", None), (3, None, "<p>x</p>"), (4, "http://d", "é" * 5000), (5, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    got = {r.page_id: tuple(r)[1:] for r in warc.round_trip(pages).collect()}
    sha = lambda s: base64.b32encode(hashlib.sha1(s.encode()).digest()).decode()
    assert got == {1: (8, sha("<p>x</p>"), "revisit", 3), 2: (0, sha(""), "revisit", 5), 3: (8, sha("<p>x</p>"), "response", None), 4: (10000, sha("é" * 5000), "response", None), 5: (0, sha(""), "response", None)}
    folder = f"file://{tmp_path}"
    archives = warc.write(pages, folder)
    index = warc.normalise(archives, folder).orderBy("offset").collect()
    whole = b"".join(gzip.decompress(open(r.path, "rb").read()) for r in archives.collect())
    single = b"".join(gzip.decompress(open(r.path, "rb").read()[r.offset : r.offset + r["size"]]) for r in index)
    assert whole == single and len(index) == 5
    assert list(warc.records(warc.inflate(io.BytesIO(gzip.compress(whole)))))[0] == whole[: len(list(warc.records([whole]))[0])]
    with pytest.raises(ValueError, match="within a record"):
        list(warc.records([whole[:-10]]))


def test_warc_index_beside_each_file(spark, tmp_path):
    pages = spark.createDataFrame([(k, f"http://{k}", "x" * k) for k in range(9)], "page_id long, url string, html string")
    folder = f"file://{tmp_path}"
    index = warc.normalise(warc.write(pages, folder, per_file=500), folder)
    files = {str(p) for p in tmp_path.glob("*.members.warc.gz")}
    assert len(files) > 1 and {str(p) for p in tmp_path.glob("*.cdx.parquet")} == {f.removesuffix(".warc.gz") + ".cdx.parquet" for f in files}
    beside = spark.read.parquet(f"{folder}/*.members.cdx.parquet")
    assert beside.columns == index.columns and sorted(map(tuple, beside.collect())) == sorted(map(tuple, index.collect()))
    for f in files:
        assert {r.path for r in spark.read.parquet(f"file://{f.removesuffix('.warc.gz')}.cdx.parquet").collect()} == {f}
    assert {r.page_id for r in warc.read(beside, folder).collect()} == set(range(9))


def test_model_is_a_distribution_and_learns():
    rng = np.random.default_rng(6)
    n = language_model.VOCAB
    pair = language_model.pair_logs(rng.integers(0, 50, (n, n)).astype(float))
    w = language_model.start_weights()
    w["c"], w["g"] = (rng.standard_normal(w[k].shape).astype(np.float32) * 0.3 for k in ("c", "g"))
    state = rng.standard_normal((2, language_model.WIDTH)).astype(np.float32)
    total = [np.exp(language_model.log_probs(w, pair, np.repeat(state[k : k + 1], n, 0), np.arange(n), np.full(n, 5 + k))).sum() for k in range(2)]
    assert np.allclose(total, 1, atol=1e-3)
    ids = np.tile(np.arange(40), 200)
    rows = language_model.blocks(ids, np.array([0, 4000, 8000]))
    assert (rows[0] >= 0).sum() == 8002
    pair, w = language_model.pair_logs(np.zeros((n, n))), language_model.start_weights()
    before = language_model.score_rows(w, pair, rows, 2).sum()
    after = language_model.score_rows(language_model.train(w, pair, rows, 60, 0.02, 1), pair, rows, 2).sum()
    assert after > before / 2
    # a text alone and among others, in whatever steps, gets the same score
    one = language_model.score_rows(w, pair, language_model.blocks(ids[:4000], np.array([0, 4000])), 1)
    assert np.allclose(one[0], language_model.score_rows(w, pair, rows, 2, step=7)[0], rtol=1e-5)


def test_language_model_columns(spark, table):
    """Every column that plain Python can tell, on nulls, empty texts and repeated rows."""
    rows, df = table
    docs = df.unionAll(df.where("doc_id in (2, 3)"))
    got = defaultdict(list)
    for r in language_model.report(docs).collect():
        got[r.doc_id].append(r)
    texts_ = [(r[0], r[1] or "") for r in [*rows, rows[2], rows[3]]]
    low = lambda t: re.sub("[A-Z]", lambda m: m[0].lower(), t)
    toks = lambda t: [*re.findall(r"[^\x20\x09-\x0D]+", low(t)), None]
    held = lambda d: zlib.crc32(str(d).encode()) % 7 == 2
    counts = Counter(w for d, t in texts_ if not held(d) for w in toks(t))
    total, kinds = sum(counts.values()), len(counts)
    for d, t in texts_:
        w = toks(t)
        base = sum(math.log10((counts[x] + 1) / (total + kinds + 1)) for x in w)
        for r in got[d]:
            assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(d), len(w), sum(counts[x] > 0 for x in w), total), d
            assert abs(r.base_score - base) < 1e-6 and r.score < 0
        assert max(r.score for r in got[d]) - min(r.score for r in got[d]) < 1e-3  # rows of other batches: single precision
    assert sum(len(x) for x in got.values()) == len(texts_)


def test_encoder_on_long_gaps_and_added_tokens():
    import public_tokenizers
    from tokenizers import Tokenizer

    plain, enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), packing.encoder(packing.default_ranks())
    for text in (" " * 400_000 + "a", "x" + "\n" * 400_000, "x" + " \u3000" * 150_000 + "<|endoftext|>  b" + " " * 250_000 + "1", "é" * 300_000):
        assert packing.encode(enc, text) == plain.encode(text, add_special_tokens=False).ids


def test_lines_of_long_texts_and_of_one_text(spark):
    lines_ = [f"line {k % 7001}" for k in range(20_000)]
    docs = spark.createDataFrame([(1, "\n".join(lines_)), (2, "\n".join(["own", *lines_[:5], "more", "end"])), (3, "a\na\na\na\na")], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()}
    assert got[1] == "\n".join(lines_[:7003]) or got[1] == "\n".join(lines_[:7001])
    assert got[2] == "own\nmore\nend" and got[3] == "a"



def test_gradient():
    rng = np.random.default_rng(7)
    n = language_model.VOCAB
    pair = tuple(x.astype(np.float64) for x in language_model.pair_logs(rng.integers(0, 9, (n, n)).astype(float)))
    w = {k: v.astype(np.float64) for k, v in language_model.start_weights().items()}
    w["c"], w["g"] = (rng.standard_normal(w[k].shape) * 0.3 for k in ("c", "g"))
    target, given, first, _ = language_model.blocks(rng.integers(0, n - 2, 60), np.array([0, 25, 60]))
    before = np.roll(given, 1, axis=0)
    order = np.argsort(target.ravel() // language_model.SIDE, kind="stable")
    order = order[target.ravel()[order] >= 0]
    loss = lambda: -language_model.log_probs(w, pair, language_model.forward(w, given, before, first)["out"].reshape(-1, language_model.WIDTH)[order], target.ravel()[order], given.ravel()[order]).mean()
    g = language_model.gradient(w, pair, target, given, before, first)
    for k in ("q", "k", "v", "near", "w1", "b1", "w2", "c"):
        at = tuple(rng.integers(0, n) for n in w[k].shape)
        old = w[k][at]
        w[k][at] = old + 1e-3
        up = loss()
        w[k][at] = old - 1e-3
        down = loss()
        w[k][at] = old
        assert abs((up - down) / 2e-3 - g[k][at]) < 2e-3, k


def test_quality(spark):
    sf = "/root/testdata/sf0.01"
    docs, marks = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = quality.classify(docs, marks).join(marks, "doc_id").toPandas()
    assert got[got.quality == 1].kept.mean() > 0.98 > 0.7 > got[got.quality == 0].kept.mean()
    odd = spark.createDataFrame([(1, None, "en"), (2, "", None), (None, "some words", "xx")], "doc_id long, text string, lang string")
    assert [r.kept for r in quality.classify(odd, marks.limit(0)).orderBy(F.col("doc_id").isNull(), "doc_id").collect()] == [False, False, True]


def test_kneser_ney_adds_up_to_one(spark):
    text = ["a b c a b d", "a b c", "c a b b", "d d a"]
    m = quality.fit_model(spark.createDataFrame([(t,) for t in text], "text string"))
    for context in ("", "a ", "a b ", "c a ", "z z "):
        total = 0.0
        for w in "abcdq":  # q stands for all words not seen
            docs = spark.createDataFrame([(1, context + w)], "doc_id long, text string")
            both = [x.log_ppl * x.n_words for x in quality.score(docs, m).collect()]
            n = len(context.split())
            head = quality.score(spark.createDataFrame([(1, context)], "doc_id long, text string"), m).first().log_ppl if n else 0
            total += 10 ** -(both[0] - (head or 0) * n)
        assert abs(total - 1) < 1e-3


def test_empty_tables(spark):
    none = spark.createDataFrame([], DOCS)
    items, marks = spark.createDataFrame([], "item_id long, text string"), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert packing.pack(none).count() == 0
    assert substring_dedup.remove_repeats(none).count() == 0
    assert minhash.near_duplicates(none).count() == 0
    assert line_dedup.dedup_lines(none).count() == 0
    assert decontaminate.report(none, items).count() == 0
    assert toxicity.report(none, marks).count() == 0
    assert quality.classify(none, marks).count() == 0
    assert language_model.report(none).count() == 0
    assert embedding_join.link(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert warc.round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = {r.doc_id for r in docs.select("doc_id").collect()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} == ids
