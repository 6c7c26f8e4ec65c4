from __future__ import annotations

import hashlib
import itertools
import json
import math
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from loam.functions import arrays as A
from loam.functions import text as T
from loam.operators import audit as reports
from loam.operators import graph, labels, records, relations, sampling
from loam.plans import audit, building, catalog, dataset  # noqa: F401  (the others add their queries to the catalog)
from loam.sources import files

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def clean(rows, names):
    return sorted(json.dumps([None if v is None or v != v else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v for v in (r[names.index(c)] for c in sorted(names))], default=str) for r in rows)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_against_sql(spark, duck, name):
    got = catalog.QUERIES[name](spark, SF)
    want = duck.execute(catalog.ORACLES[name])
    names = [c[0] for c in want.description]
    assert sorted(got.columns) == sorted(names)
    assert clean([tuple(r) for r in got.collect()], got.columns) == clean(want.fetchall(), names)


def test_splitlines(spark):
    cases = {x: x.splitlines() for x in ("", "\n", "a\n", "a\r\nb", "a\n\nb\n\n", "a\x1cb\x1d\x1ec", "a\x85b\u2028c\u2029", "\x0b\x0c")}
    rows = spark.createDataFrame([(k,) for k in cases], "t string").select("t", T.splitlines(F.col("t")).alias("x")).collect()
    assert {r[0]: r[1] for r in rows} == cases


def test_paths_and_frames(spark):
    one = spark.createDataFrame([("a/./src/x.py\t2024", '  File "a.py", line 3, in f\n  x\nFile "b.py", line 10\n File "/c d.py", line 7, in <module>\n')], "p string, t string")
    r = one.select(T.patch_path(F.col("p")).alias("p"), T.traceback_frames(F.col("t")).alias("f")).first()
    assert r.p == "src/x.py" and [(x.path, x.line, x.name) for x in r.f] == [("a.py", 3, "f"), ("/c d.py", 7, "<module>")]


def test_lattice_keeps_the_first_of_equals(spark):
    rows = [(1, "DROP", 0.7, 0, "a"), (1, "SUPPORT", 0.88, 1, "b"), (1, "CORE", 0.9, 2, "c"), (1, "CORE", 0.9, 3, "d"), (1, "SUPPORT", 0.95, 4, "b")]
    got = labels.lattice_merge(spark.createDataFrame(rows, "k int, role string, confidence double, seq int, source string"), ["k"]).first()
    assert (got.role, got.confidence, got.provenance) == ("CORE", 0.9, ["a", "b", "c", "d"])


def windows(lines, n, most):
    out, cur = [], []
    for x in sorted(set(lines)):
        if cur and x - cur[0] < most:
            cur.append(x)
        else:
            if cur:
                out.append(cur)
            cur = [x]
    if cur:
        out.append(cur)
    res = set()
    for w in out:
        first = max(1, min(w[0] - (most - (w[-1] - w[0] + 1)) // 2, n - most + 1))
        res.add((first, min(first + most - 1, n)))
    return res


def test_core_windows(spark):
    files_ = {1: ([1, 2, 3, 40, 41, 60], 60), 2: ([5], 8), 3: (list(range(1, 50, 3)), 50)}
    rows = [(k, x, n) for k, (xs, n) in files_.items() for x in xs]
    got = labels.core_windows(spark.createDataFrame(rows, "k int, line int, n_lines int"), ["k"], 12).collect()
    for k, (xs, n) in files_.items():
        assert {(r["first"], r["last"]) for r in got if r.k == k} == windows(xs, n, 12)


def test_components_and_hop(spark):
    rows = spark.createDataFrame([(1, "a", None), (2, "a", "x"), (3, "b", "x"), (4, "c", None), (5, None, None)], "n int, p string, q string")
    assert {r.node: r.component for r in graph.shared_key_components(rows, "n", ["p", "q"]).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    edges = spark.createDataFrame([(1, 2, "r"), (3, 1, "s"), (2, 4, "r")], "src int, dst int, relation string")
    assert {r.node for r in graph.one_hop(edges, spark.createDataFrame([(1,)], "node int")).collect()} == {2, 3}


def test_replay_draws_with_replacement_only_when_short(spark):
    new, old = spark.range(100).withColumnRenamed("id", "k"), spark.range(100, 103).withColumnRenamed("id", "k")
    got = sampling.replay_mix(new, old, "k", 20, 0.5, 7).collect()
    assert len([r for r in got if r.pool == "new"]) == 10 == len({r.k for r in got if r.pool == "new"})
    assert len([r for r in got if r.pool == "replay"]) == 10 and {r.k for r in got if r.pool == "replay"} == {100, 101, 102}


def test_sources(spark, tmp_path):
    (tmp_path / "t.jsonl").write_text('{"id": "x", "repo": "o/n", "checkout_path": "/r", "gold_patch": "p"}\n\n{"id": "y", "patch": "p"}\n{"id": "z", "repo_path": "/r", "patch": " "}\n')
    got = {r.task_id: r.error for r in files.load_tasks(files.read_jsonl(spark, str(tmp_path / "t.jsonl"), files.TASK)).collect()}
    assert got == {"x": None, "y": "no repository", "z": "no patch"}
    (tmp_path / "bad.jsonl").write_text("[1]\n")
    with pytest.raises(Exception, match="not an object"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a int").collect()
    (tmp_path / "l.txt").write_text("# c\n\n a/b \na/b\n")
    assert [r.name for r in files.read_list(spark, str(tmp_path / "l.txt")).collect()] == ["a/b"]
    files.write_jsonl(spark.createDataFrame([(1, None)], "b int, a int"), str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).first()[0] == '{"a":null,"b":1}'


def test_blocks(spark):
    code = spark.createDataFrame([("a.py", "def f():\n    return 1\n"), ("b.py", "def")], "path string, code string")
    rows = {(r.id, r.type, r.start, r.stop, r.container) for r in files.python_blocks(code).collect()}
    assert {("a.py", "FunctionDef", 1, 2, True), ("a.py", "Return", 2, 2, False)} <= rows and any(r[1] == "Error" for r in rows)


def test_json_files_and_splits(spark, tmp_path):
    path = f"file://{tmp_path}/d.json"
    assert files.read_json(spark, path, {"none": 1}) == {"none": 1}
    assert files.write_json(spark, {"b": "é", "a": [1]}, path) and files.read_json(spark, path, None) == {"b": "é", "a": [1]}
    assert not files.write_json(spark, {}, path, replace=False) and (tmp_path / "d.json").read_text().startswith('{\n  "a"')
    assert files.read_list(spark, f"file://{tmp_path}/none.txt").count() == 0
    files.write_splits(spark.createDataFrame([(1, "train"), (2, "test")], "k int, split string"), f"file://{tmp_path}/s")
    assert spark.read.json(f"file://{tmp_path}/s/split=test").first().k == 2
    for _ in range(2):
        files.append_jsonl(spark.range(1), f"file://{tmp_path}/log")
    assert spark.read.json(f"file://{tmp_path}/log").count() == 2
    (tmp_path / "c.toml").write_text("a = 1\n")
    assert files.load_config(spark, f"file://{tmp_path}/c.toml")["a"] == 1 and len(files.load_config(spark, f"file://{tmp_path}/c.toml")["fingerprint"]) == 24
    assert files.file_digests(spark, f"file://{tmp_path}/c.toml").first().sha256 == hashlib.sha256(b"a = 1\n").hexdigest()


def test_crf_against_all_taggings(spark):
    rng = random.Random(3)
    start, trans, end = [0.2, -0.4], [[0.5, -0.3], [-0.6, 0.1]], [0.3, -0.2]
    rows = [(k, [(rng.uniform(-1, 1), rng.uniform(-1, 1)) for _ in range(k)]) for k in range(7)]
    df = spark.createDataFrame(rows, "k int, e array<struct<a:double,b:double>>")
    got = {r.k: r for r in df.select("k", A.crf_normalizer(F.col("e"), start, trans, end).alias("z"), A.crf_decode(F.col("e"), start, trans, end).alias("d")).collect()}
    assert got[0].z is None and got[0].d is None
    for k, e in rows[1:]:
        scores = {}
        for tags in itertools.product((0, 1), repeat=k):
            scores[tags] = start[tags[0]] + end[tags[-1]] + sum(e[i][t] for i, t in enumerate(tags)) + sum(trans[tags[i]][tags[i - 1]] for i in range(1, k))
        best = max(scores, key=scores.get)
        assert abs(got[k].z - math.log(sum(map(math.exp, scores.values())))) < 1e-9
        assert abs(got[k].d.score - scores[best]) < 1e-9 and got[k].d.tags == "".join(map(str, best))


def test_review_and_names(spark):
    rows = [("DROP", 0.7, "SUPPORT", 0.9, "DROP"), ("DROP", 0.7, "SUPPORT", 0.4, "SUPPORT"), ("DROP", 0.7, "SUPPORT", 0.7, "SUPPORT"), ("DROP", 0.7, "SUPPORT", 0.7, "DROP")]
    got = records.adjudicated(spark.createDataFrame(rows, "role string, confidence double, first_role string, first_confidence double, second_role string")).collect()
    assert [(r.new_role, round(r.new_confidence, 2), r.agreement) for r in got] == [("SUPPORT", 0.9, None), ("DROP", 0.6, False), ("SUPPORT", 0.82, True), ("DROP", 0.55, False)]
    one = spark.createDataFrame([("org/owner__name.abc1234", "see sk-abcdefgh12 now", "x-sk-abcdefgh12")], "r string, s string, t string")
    r = one.select(T.repo_of(F.col("r")).alias("r"), T.redact(F.col("s")).alias("s"), T.has_secret(F.col("t")).alias("t")).first()
    assert (r.r.repository, r.r.commit, r.s, r.t) == ("owner/name", "abc1234", "see [REDACTED_API_KEY] now", False)


def test_related_blocks_and_paths(spark):
    edges = spark.createDataFrame([("c", "x", "CALL", 0.72), ("x", "c", "IMPORT", 0.78), ("y", "c", "TYPE", 0.78), ("c", "d", "CALL", 0.72)], "source string, target string, relation string, confidence double")
    core, none = spark.createDataFrame([("c",), ("d",)], "block string"), spark.createDataFrame([], "block string")
    assert {tuple(r) for r in relations.support_labels(edges, core, none).collect()} == {("x", "CALL", 0.72), ("y", "TYPE", 0.78)}
    known = spark.createDataFrame([("a/b.py",), ("c/b.py",), ("a/z.py",)], "file string")
    want = spark.createDataFrame([("b.py",), ("z.py",), ("/root/a/b.py",), ("a/b.py",), ("q.py",)], "path string")
    assert {r.path: r.file for r in relations.resolve_paths(want, known).collect()} == {"b.py": None, "z.py": "a/z.py", "/root/a/b.py": "a/b.py", "a/b.py": "a/b.py", "q.py": None}
    texts = spark.createDataFrame([(1, "the quick brown fox"), (2, "a quickly brown fox")], "id int, text string")
    parts = spark.createDataFrame([("quick brown fox",), ("ick",), ("k brown f",)], "fragment string")
    assert {tuple(r) for r in relations.contained_fragments(texts, parts).collect()} == {(1, "quick brown fox"), (1, "ick"), (2, "ick"), (1, "k brown f")}


def test_long_chain_has_one_component(spark):
    chain = spark.range(300).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"))
    assert {r.component for r in graph.components(chain).collect()} == {0}


def test_screen_and_export_on_defects(spark):
    cols = "sample_id string, text string, lines array<string>, keep array<int>, bad boolean"
    rows = [("a", "x sk-abcdefgh12", ["x"], [1], False), ("a", "y", ["y", "z"], [1], None), ("b", None, None, None, True), (None, "q", ["q"], [0], False)]
    df = spark.createDataFrame(rows, cols)
    aux = spark.createDataFrame([("a",), ("zz",), (None,)], "sample_id string")
    got = {r.finding: r.n for r in reports.screen(df, aux, ["keep"], F.col("bad")).collect()}
    assert got == {"key": 1, "unverified": 1, "length:keep": 2, "duplicate": 1, "orphan": 2}
    empty = {r.finding for r in reports.screen(df.limit(0), aux.limit(0), ["keep"], F.col("bad")).collect()}
    assert not empty
    assert [tuple(r) for r in reports.mapped(df.where("text = 'q'"), {"text": "code", "keep": "labels"}).collect()] == [("q", [0])]
    with pytest.raises(Exception, match="marks don't fit"):
        reports.mapped(df, {"text": "code"}).collect()
    with pytest.raises(ValueError, match="fields missing"):
        reports.mapped(df, {"nothing": "code"})


def test_derived_errors_and_loading(spark):
    rows = [(["a"], [1], "p"), ([], [], "p"), (["a"], [1, 2], "p"), (["a"], [1], ""), (["a"], None, None)]
    df = spark.createDataFrame(rows, "lines array<string>, keep array<int>, parent_sample_id string")
    assert [r[0] for r in df.select(reports.derived_error(["keep"])).collect()] == [None, "code", "keep", "parent_sample_id", "keep"]
    base = spark.createDataFrame([("a", 1), ("b", 2), ("b", 3)], "sample_id string, n int")
    more = spark.createDataFrame([("a1", "a", "x"), ("c1", "c", "y")], "sample_id string, parent_sample_id string, kind string")
    ids = spark.createDataFrame([("a",), ("b",), ("d",), ("a",)], "sample_id string")
    got = {(r.sample_id, r.n, r.kind, r.error) for r in reports.training_rows(base, more, ids).collect()}
    assert got == {("a", 1, None, None), ("b", 2, None, None), ("b", 3, None, None), ("a1", None, "x", None), ("d", None, None, "missing"), ("b", None, None, "duplicate")}


def test_hop_tells_orders_from_suppliers_of_one_number(spark, tmp_path):
    # order 0 is in the frontier and supplier 0 a neighbour; order -3 is one of the frontier and supplier 3 of another order
    orders = [(0, "1-URGENT"), (1, "5-LOW"), (-3, "1-URGENT"), (4, "1-URGENT"), (None, "1-URGENT")]
    items = [(0, 7), (0, 0), (1, 0), (1, 5), (4, 3), (-3, 2), (1, 3), (None, 6), (4, None)]
    spark.createDataFrame(orders, "o_orderkey long, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame(items, "l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    for t in ("orders", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tmp_path}/{t}.parquet/*.parquet'")
    want = con.execute(catalog.ORACLES["one_hop"]).fetchall()
    got = catalog.QUERIES["one_hop"](spark, str(tmp_path))
    assert got.dtypes == [("node", "bigint"), ("relation", "string")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want)) and len(want) == 5


def test_long_chains_stay_finite(spark):
    # the sums of exp pass what a double holds at some 709; logs of sums do not
    ls = [(i % 7 / 7.0, i * 3 % 5 / 5.0) for i in range(3_000)]
    start, trans, end = dataset.CRF
    a, b = ls[0][0] + start[0], ls[0][1] + start[1]
    both = lambda x, y: max(x, y) + math.log1p(math.exp(-abs(x - y)))
    for x, y in ls[1:]:
        a, b = both(a + trans[0][0], b + trans[0][1]) + x, both(a + trans[1][0], b + trans[1][1]) + y
    got = spark.createDataFrame([(ls,)], "e array<struct<a:double,b:double>>").select(A.crf_normalizer(F.col("e"), *dataset.CRF)).first()[0]
    assert a > 709 and math.isclose(got, both(a + end[0], b + end[1]), rel_tol=1e-9)


def test_crf_scores_and_their_sql_on_long_texts(spark, tmp_path):
    # exp in the SQL overflows beyond some 709; written without that it agrees on every text, as it is on all others
    rng = random.Random(4)
    texts = ["\n".join("x" * rng.randrange(1, 40) for _ in range(n)) for n in (1, 2, 7, 60, 300)] + ["\n".join(["x" * 34] * n) for n in (400, 900)]
    spark.createDataFrame([(k, t, "en", "s") for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    sql = plain = catalog.ORACLES["crf_scores"]
    for x, y in (("za + 0.3", "zb - 0.2"), ("za - 0.4", "zb + 0.2"), ("za + 0.05", "zb - 0.05")):
        assert f"ln(exp({x}) + exp({y}))" in plain
        plain = plain.replace(f"ln(exp({x}) + exp({y}))", f"(greatest({x}, {y}) + ln(1 + exp(-abs(({x}) - ({y})))))")
    got = sorted(map(tuple, catalog.QUERIES["crf_scores"](spark, str(tmp_path)).collect()))
    as_is = sorted(con.execute(sql).fetchall())
    assert got == sorted(con.execute(plain).fetchall())
    assert [r[0] for r in as_is if math.isinf(r[1])] == [6] and got[6][1] > 709 and got[:6] == as_is[:6]
