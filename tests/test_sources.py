"""Offsets, line numbers and upserts, on files of several blocks; records and relations on hand-made rows."""

from __future__ import annotations

import hashlib
import itertools
import json
import random

import pytest
from pyspark.sql import functions as F

from loam.functions import arrays as A
from loam.functions import text as T
from loam.operators import records, relations
from loam.sources import indexed


@pytest.fixture
def small_blocks(spark):
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    yield
    spark.conf.set("spark.sql.files.maxPartitionBytes", was)


def test_line_numbers_of_split_files(spark, tmp_path, small_blocks):
    rng = random.Random(1)
    texts = {f"f{k}.txt": [f"{k} {'x' * rng.randint(0, 60)}" for _ in range(rng.choice([0, 1, 200]))] for k in range(5)}
    for name, lines in texts.items():
        (tmp_path / name).write_text("".join(x + "\n" for x in lines))
    df = indexed.numbered_lines(spark, f"file://{tmp_path}/*.txt")
    assert spark.read.text(f"file://{tmp_path}/*.txt").rdd.getNumPartitions() > 4
    assert {(r.path.rsplit("/", 1)[1], r.line): r.value for r in df.collect()} == {(f, k): x for f, lines in texts.items() for k, x in enumerate(lines, 1)}


def test_a_bad_line_is_named(spark, tmp_path, small_blocks):
    rows = [json.dumps({"a": k, "b": "y" * 50}) for k in range(300)]
    (tmp_path / "good.jsonl").write_text("\n".join([*rows[:5], "", "  ", *rows[5:]]) + "\n")
    got = indexed.read_checked_jsonl(spark, f"file://{tmp_path}/good.jsonl", "a int, b string")
    assert got.columns == ["a", "b"] and sorted(r.a for r in got.collect()) == list(range(300))
    for at, line in ((250, '{"a": 1'), (7, "[1]"), (122, '{"a": "no number"}')):
        (tmp_path / "bad.jsonl").write_text("\n".join([*rows[:at], line, *rows[at:], "[]"]) + "\n")
        with pytest.raises(ValueError, match=rf"bad\.jsonl:{at + 1}: "):
            indexed.read_checked_jsonl(spark, f"file://{tmp_path}/bad.jsonl", "a int, b string")


def test_records_by_offset(spark, tmp_path):
    rows = [(f"s{k}", "é\"\n" * (k % 7), k, None if k % 3 else [k, k]) for k in range(500)]
    schema, path = "sample_id string, text string, n int, xs array<int>", f"file://{tmp_path}/t"
    indexed.write_indexed(spark.createDataFrame(rows, schema), path, "sample_id", 8)
    index = spark.read.parquet(f"{path}/index")
    assert index.count() == 500 and index.select("bucket").distinct().count() == 8
    ids = spark.createDataFrame([(f"s{k}",) for k in (*range(0, 500, 7), 3, 3, 999)], "id string")
    got = indexed.read_by_ids(spark, path, ids, schema, 8).collect()
    assert sorted(map(tuple, got)) == sorted(rows[k] for k in {*range(0, 500, 7), 3})
    assert [r.id for r in indexed.missing_ids(spark, path, ids).collect()] == ["s999"]
    spark.dataSource.register(indexed.IndexedJsonl)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("indexed_jsonl").schema(schema).option("id", "sample_id").option("buckets", 8).load(path)
    assert sorted(map(tuple, df.collect())) == sorted(rows) and df.rdd.getNumPartitions() == 8
    one = df.where("sample_id = 's14'")
    assert [tuple(r) for r in one.collect()] == [rows[14]] and one.rdd.getNumPartitions() == 1
    assert sorted(r.n for r in df.where("sample_id in ('s1', 's2', 'zz') and n > 1").collect()) == [2]


def test_upserts_touch_their_buckets(spark, tmp_path):
    path, schema, want = f"file://{tmp_path}/cache", "k string, at int, status string, error string", {}
    assert indexed.read_buckets(spark, path) is None
    for turn, keys in enumerate((range(200), [5, 5, 900], [], range(3))):
        rows = [(f"k{k}", 1000 * turn + i, f"v{turn}", "e" * 1500 if k == 5 else None) for i, k in enumerate(keys)]
        indexed.upsert_buckets(path, spark.createDataFrame(rows, schema), "k", "at", 16, "error")
        want |= {r[0]: (r[0], r[1], r[2], r[3] and r[3][:1000]) for r in rows}
        assert {tuple(r) for r in indexed.read_buckets(spark, path).drop("bucket").collect()} == set(want.values())
    assert len(list((tmp_path / "cache").glob("version=2/bucket=*"))) == len({__import__("zlib").crc32(k) % 16 for k in (b"k5", b"k900")})
    (tmp_path / "cache/version=9/bucket=0").mkdir(parents=True)  # a run that failed
    (tmp_path / "cache/version=9/bucket=0/part-0.parquet").write_text("half")
    assert indexed.read_buckets(spark, path).count() == 201
    indexed.upsert_buckets(path, spark.createDataFrame([(f"k{k}", 1, "new", None) for k in range(201)], schema), "k", "at", 16)
    assert indexed.drop_old_versions(spark, path) >= 2 and indexed.read_buckets(spark, path).where("status = 'new'").count() == 201


def test_review_goes_through_the_lattice(spark):
    d = records.DEFAULT
    labels = [(1, "a", "DROP", 0.7, "NONE", [d]), (1, "b", "SUPPORT", 0.8, "CALL", ["static"]), (1, "c", "CORE", 0.5, "NONE", ["patch"]), (1, "d", "DROP", 0.05, "NONE", [d]), (1, "e", "DROP", 0.7, "NONE", [d]), (2, "a", "DROP", 0.7, "NONE", [d]), (1, "f", "SUPPORT", 0.6, "X", ["api_primary:m1"])]
    said = [(1, "a", "SUPPORT", 0.4, "CALL", ["m1"], None), (1, "b", "SUPPORT", 0.8, "TYPE", ["m1", "m2"], None), (1, "c", "SUPPORT", 0.9, "CALL", ["m1"], None), (1, "d", "SUPPORT", 0.9, "CALL", ["m1"], "timeout"), (1, "e", "DROP", 0.9, "NONE", ["m1"], None), (1, "f", "SUPPORT", 0.7, "CALL", ["m1"], None), (1, "f", "SUPPORT", 0.2, "CALL", ["m1"], None)]
    got = records.reviewed(spark.createDataFrame(labels, "task int, block string, role string, confidence double, relation string, provenance array<string>"), spark.createDataFrame(said, "task int, block string, new_role string, new_confidence double, new_relation string, models array<string>, error string"))
    assert {(r.task, r.block): (r.role, r.confidence, r.relation, r.provenance) for r in got.collect()} == {
        (1, "a"): ("SUPPORT", 0.4, "CALL", ["api_primary:m1"]), (1, "b"): ("SUPPORT", 0.8, "CALL", ["static", "api_primary:m1", "api_reviewer:m2"]), (1, "c"): ("CORE", 0.5, "NONE", ["patch", "api_primary:m1"]),
        (1, "d"): ("DROP", 0.0, "NONE", [d]), (1, "e"): ("DROP", 0.9, "NONE", [d, "api_primary:m1"]), (2, "a"): ("DROP", 0.7, "NONE", [d]), (1, "f"): ("SUPPORT", 0.7, "CALL", ["api_primary:m1"])}


def test_spread_and_parity(spark):
    df = spark.createDataFrame([(k * 7 % 101, k) for k in range(101)], "a int, b int").repartition(5)
    for points in (2, 5, 32, 101, 500):
        got = sorted((r.row, r.a) for r in records.spread(df, points, "a").collect())
        want = sorted({round(i * 100 / (points - 1)) for i in range(points)})
        assert got == [(w, w) for w in want]
    assert records.spread(df.where("a < 0"), 5, "a").count() == 0 and records.spread(df.where("a = 4"), 5, "a").count() == 1
    pair = "struct<lr:string,seed:string>"
    rows = spark.createDataFrame([(1, ("1", "2"), ("1", "3")), (2, None, ("1", None)), (3, ("x", None), ("x", None))], f"k int, left {pair}, right {pair}")
    assert {tuple(r) for r in records.parity(rows, "k", ["seed", "lr"]).collect()} == {(1, "seed", "2", "3"), (2, "lr", None, "1")}


def test_lists_and_children(spark):
    rows = spark.createDataFrame([(["a"], "b"), (None, "b"), (None, "  "), (None, None), ([], "c")], "m array<string>, o string")
    assert [r[0] for r in rows.select(records.as_list(F.col("m"), F.col("o"))).collect()] == [["a"], ["b"], [], [], []]
    kids = spark.createDataFrame([("s1", 1), ("s2", 2), (None, 3)], "sample_id string, x int")
    assert [r.x for r in records.restricted(kids, spark.createDataFrame([("s1",), ("s1",)], "sample_id string")).collect()] == [1]


def test_score_of_given_tags(spark):
    rng = random.Random(4)
    start, trans, end = [0.2, -0.4], [[0.5, -0.3], [-0.6, 0.1]], [0.3, -0.2]
    rows = [([(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(k)], list(tags)) for k in range(1, 5) for tags in itertools.product((0, 1), repeat=k)] + [([], []), ([(1.0, 1.0)], [0, 1])]
    got = spark.createDataFrame(rows, "e array<struct<a:double,b:double>>, t array<int>").coalesce(1).select(A.crf_score(F.col("e"), F.col("t"), start, trans, end).alias("s")).collect()
    for (e, t), r in zip(rows[:-2], got, strict=False):
        want = start[t[0]] + end[t[-1]] + sum(x[k] for x, k in zip(e, t, strict=True)) + sum(trans[t[i]][t[i - 1]] for i in range(1, len(t)))
        assert abs(r.s - want) < 1e-12
    assert got[-1].s is None and got[-2].s is None


def test_canonical_json_and_hashes(spark):
    one = spark.createDataFrame([(1, "é", None)], "b int, a string, c string")
    r = one.select(T.canonical_json("b", "a", z=F.lit(2), B=F.lit("x")).alias("j"), T.canonical_json("c").alias("n"), T.json_hash(F.lit(42), F.col("a"), F.col("c"), length=64).alias("h")).first()
    assert (r.j, r.n) == (json.dumps({"b": 1, "a": "é", "z": 2, "B": "x"}, sort_keys=True, separators=(",", ":"), ensure_ascii=False), '{"c":null}')
    assert r.h == hashlib.sha256('[42,"é",null]'.encode()).hexdigest()


def test_fragments_by_grams(spark, monkeypatch):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab ") for _ in range(n))
    texts = [(k, word(rng.choice([0, 3, 60]))) for k in range(80)] + [(99, "héllo wörld, a 😀 smile"), (100, None)]
    parts = [word(n) for n in (1, 2, 3, 5, 8, 9, 12, 14) for _ in range(6)] + ["wörld, a", "😀 smile", "lo", "", "absent gram here"]
    want = {(i, f) for i, t in texts for f in parts if t is not None and f and f in t}
    for most, few in ((10_000, 64), (10_000, 0), (0, 0)):
        monkeypatch.setattr(relations, "BROADCAST_GRAMS", most)
        monkeypatch.setattr(relations, "FEW", few)
        got = relations.contained_fragments(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([(p,) for p in parts], "fragment string"))
        assert {tuple(r) for r in got.collect()} == want
    assert relations.contained_fragments(spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame([], "fragment string")).count() == 0
    lines = spark.createDataFrame([(1, " a  line of text "), (2, "a line"), (3, None)], "id int, text string")
    assert [r.id for r in relations.contained_lines(lines, spark.createDataFrame([("a line of text",)], "fragment string")).collect()] == [1]
