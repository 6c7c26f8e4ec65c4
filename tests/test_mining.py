"""Relations, mined negatives, relation loss and warm-up against plain loops on hand-made rows."""

from __future__ import annotations

import hashlib
import math
import random

from pyspark.sql import functions as F

from loam.operators import mining, records, relations, sampling
from loam.plans import mining as mining_plans


def test_uses_meet_the_last_definition_before_them(spark):
    rng = random.Random(3)
    rows = []
    for symbol in ("a", "b", None):
        for at in range(30):
            used, defined = ({rng.choice("xyz") for _ in range(2)} for _ in range(2))
            rows += [(symbol, at, f"{symbol}{at}", n, n in used, n in defined) for n in used | defined]
    rows.append(("a", 3, "a3", None, True, True))
    want, last = set(), {}
    for symbol, at, block, name, used, _ in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        here = {r[3] for r in rows if r[:2] == (symbol, at) and r[5]}
        prior = [k for s, k, n in last if s == symbol and n == name and k < at]
        if name and used and prior:
            want.add((block, f"{symbol}{max(prior)}"))
        last.update({(symbol, at, n): 1 for n in here if n})
    got = mining.last_definitions(spark.createDataFrame(rows, "symbol string, at int, block string, name string, used boolean, defined boolean"))
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)


def test_headers_and_calls(spark):
    nodes = [(1, None, True, False), (2, 1, False, None), (3, 2, True, True), (4, 3, False, False), (5, 2, True, None), (6, 5, False, False), (7, None, False, False), (8, 7, False, False)]
    got = mining.header_relations(spark.createDataFrame(nodes, "node int, parent int, is_header boolean, handles boolean"))
    assert {tuple(r) for r in got["CONTROL"].collect()} == {(2, 1), (3, 1), (5, 1), (6, 5)} and {tuple(r) for r in got["EXCEPTION"].collect()} == {(4, 3)}
    calls = spark.createDataFrame([(10, 1, "f"), (11, None, "f"), (12, 1, "g"), (13, 1, None), (14, 1, "none")], "source int, caller int, name string")
    got = mining.call_relations(calls, spark.createDataFrame([("f", 100), ("g", 101), ("g", 102), (None, 103)], "name string, target int"))
    assert {tuple(r) for r in got["CALL"].collect()} == {(10, 100), (11, 100)} and [tuple(r) for r in got["CALLED_BY"].collect()] == [(100, 1)]
    assert relations.edges(got).where("relation = 'CALL' and confidence = 0.72").count() == 2


def test_mined_negatives_by_reason_and_order(spark):
    anchors = [("r", 1, "load_file", ["load", "file", "path", "open"], ["crash", "cache"], "K", "m.py")]
    blocks = [
        ("r", 1, "load_file", ["load"], "K", "m.py"), ("r", 2, "save", ["save"], "K", "m.py"), ("r", 3, "load_files", ["x"], None, "n.py"), ("r", 4, "other", ["load", "file", "q"], "", "n.py"),
        ("r", 5, "other", ["crash", "cache", "clear"], "Z", "n.py"), ("r", 6, "zip", ["zip"], None, "m.py"), ("r", 7, "zip", ["zip"], None, "n.py"), ("r", 8, "load_file", ["load"], "K", "m.py"), ("s", 9, "load_file", ["load"], "K", "m.py"),
        ("r", 10, None, None, None, None), ("r", 11, "load_file", ["a"], None, "n.py")]
    a = spark.createDataFrame(anchors, "repo string, anchor int, name string, words array<string>, issue array<string>, class string, file string")
    b = spark.createDataFrame(blocks, "repo string, block int, name string, words array<string>, class string, file string")
    related = spark.createDataFrame([(8, 1)], "source int, target int")
    got = [(r.block, r.negative_type, r.similarity, r["rank"]) for r in mining.mined(a, b, related, ["repo"], 50).orderBy("rank").collect()]
    # load_file and load_files share one of three words, so 3 has no reason
    assert got == [(2, "same_class_other_method", 0.0, 1), (6, "same_file_other_branch", 0.0, 2), (11, "similar_name_no_relation", 1.0, 3), (5, "issue_keyword_match_no_relation", 0.6667, 4), (4, "similar_name_no_relation", 0.4, 5)]
    top = mining.mined(a, b, related, ["repo"], 2)
    assert {r.block for r in top.collect()} == {2, 6} and "WindowGroupLimit" in top._jdf.queryExecution().toString()
    assert mining.mined(a.limit(0), b, related, ["repo"], 5).count() == 0


def test_relation_loss_and_warm_up(spark):
    rows = [("a", [1.0, 2.0, -1.0], 0, 0.5), ("a", [300.0, -300.0], 1, 2.0), ("a", [0.0], 0, -3.0), ("a", None, 0, 1.0), ("a", [1.0], None, 1.0), ("b", [1.0, 1.0], 1, None)]
    got = {r.g: (r.n, r.loss) for r in mining.relation_loss(spark.createDataFrame(rows, "g string, z array<double>, y int, w double"), ["g"], "z", "y", "w").collect()}
    want = (0.5 * (math.log(sum(map(math.exp, (1, 2, -1)))) - 1) + 2 * 600) / 2.5
    assert got["a"][0] == 3 and abs(got["a"][1] - want) < 1e-9 and got["b"] == (1, 0.0)
    rates = {r.id: r.v for r in spark.range(0, 40).select("id", mining.warmup_cosine(F.col("id"), 4, 20).alias("v")).collect()}
    assert [rates[i] for i in (0, 1, 4, 20, 39)] == [0, 0.25, 1, 0, 0] and abs(rates[12] - 0.5) < 1e-12
    assert spark.range(1).select(mining.warmup_cosine(F.lit(0), 0, 0).alias("v")).first().v == 1


def test_listings_and_turns_match_whole_ranks(spark):
    rng = random.Random(8)
    files = [(g, f"{g}/{i}", rng.choice(["d", "e", None]), rng.choice([True, False, False, None])) for g, n in (("a", 300), ("b", 9), ("c", 3), ("d", 60)) for i in range(n)] + [("e", f"e/{i}", "d", False) for i in range(9)]
    mark = lambda *x: hashlib.sha256("\0".join(map(str, x)).encode()).hexdigest()[:24]
    want = {}
    for g in "abcde":
        mine = [f for f in files if f[0] == g]
        patch = [f for f in mine if f[3]]
        if len(mine) < 4 or not patch:
            continue
        rest = sorted((f for f in mine if not f[3]), key=lambda f: (mark(42, g, f[1]), f[1]))[: max(0, 12 - len(patch))]
        dirs = {f[2] for f in patch}
        n = max(len(patch), math.floor(0.3 * (len(patch) + len(rest)) + 0.999 + 1e-9)) - len(patch)
        best = sorted(sorted(rest, key=lambda f: f[1], reverse=True), key=lambda f: f[2] not in dirs)[:n]
        want |= {f[1]: ("CORE", 1.0) for f in patch} | {f[1]: ("SUPPORT", 0.7) if f in best else ("DROP", 0.85) for f in rest}
    frame = spark.createDataFrame(files, "g string, path string, dir string, patch boolean")
    got = sampling.file_listing(frame, "g", 42, most=12).collect()
    assert {r.path: (r.role, r.confidence) for r in got} == want and len(got) == len(want)

    once = [(g, f"{g}{i}") for g, n in (("a", 40), ("b", 2), ("c", 5)) for i in range(n)]
    turns = {g: sorted((k for h, k in once if h == g), key=lambda k: (mark(k), k)) for g in "abc"}
    order = sorted(((turns[g].index(k) + 1, mark(g), g, k) for g, k in once))[:20]
    got = records.diverse(spark.createDataFrame(once + once[:5], "g string, k string"), "g", "k", 3, 20)
    assert [(r.turn, r.g, r.k) for r in got.collect()] == [(t, g, k) for t, _, g, k in order]


def test_profiles_give_the_negatives_that_all_pairs_give(spark):
    rng = random.Random(11)
    blocks = [(rng.choice("rs"), k, rng.choice(["a b", "b c", "c", None]), rng.choice("xy"), rng.random() < 0.5) for k in range(300)]
    anchors = [(r, k, n, c) for r, k, n, c, _ in blocks if k % 17 == 0] + [("none", 999, "a b", "x"), (None, 998, "a", "x")]
    edges = [(k, rng.randrange(300)) for _, k, *_ in anchors for _ in range(rng.randrange(6))] + [(rng.randrange(300), k) for _, k, *_ in anchors]
    related = {p for a, b in edges for p in ((a, b), (b, a))}
    want = set()
    for r, a, an, ac in anchors:
        rows = []
        for br, b, bn, bc, same_file in blocks:
            if br != r or a == b or (a, b) in related:
                continue
            x, y = set((an or "").split()), set((bn or "").split())
            names = round(len(x & y) / len(x | y), 4) if an and bn else 0.0
            kind = "class" if ac == bc else "name" if names >= 0.3 else "file" if same_file else None
            if kind:
                rows.append((not same_file, ac != bc, -names, b, kind))
        want |= {(a, b, kind, -n, at + 1) for at, (_, _, n, b, kind) in enumerate(sorted(rows)[:7])}
    x, y = F.split("an", " "), F.split("bn", " ")
    names = F.round(F.coalesce(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)), F.lit(0.0)), 4)
    names = F.when(F.col("an").isNull() | F.col("bn").isNull(), 0.0).otherwise(names)
    kind = F.when(F.col("ac") == F.col("bc"), "class").when(names >= 0.3, "name").when(F.col("same_file"), "file")
    got = mining.mined_by_profile(
        spark.createDataFrame(anchors, "repo string, anchor int, an string, ac string"), spark.createDataFrame(blocks, "repo string, block int, bn string, bc string, same_file boolean"), ["repo"], ["bn", "bc", "same_file"],
        {"same_file": F.col("same_file"), "same_class": F.col("ac") == F.col("bc"), "similarity": names, "negative_type": kind}, spark.createDataFrame(edges, "source int, target int"), 7)
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)


def test_shared_names_lists_each_pair_once_and_shuffles_none(spark, monkeypatch):
    rng = random.Random(9)
    monkeypatch.setattr(relations, "TOGETHER", 4)
    draw = lambda n: [(rng.choice(["f", "g", None]), rng.randrange(40), rng.choice([None, [], [""], ["a", "a"], ["a", "b"], ["b", None, "c"], ["", "c"]])) for _ in range(n)]
    uses, defined = draw(150), draw(60)
    want = {(b, d) for f, b, names in uses for g, d, more in defined if f and f == g and {x for x in names or [] if x} & set(more or [])}
    schema = "file string, block int, names array<string>"
    got = relations.shared_names(spark.createDataFrame(uses, schema), spark.createDataFrame(defined, schema))
    rows = [tuple(r) for r in relations.edges({"IMPORT": got}, once=("IMPORT",)).select("source", "target").collect()]
    assert set(rows) == {p for p in want if p[0] != p[1]} and len(rows) == len(set(rows))
    assert {tuple(r) for r in got.collect()} == want
    plan = relations.edges({"IMPORT": got}, once=("IMPORT",))._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan[: plan.index("explode(targets")] and "Join" not in plan[: plan.index("explode(targets")]


def test_names_of_few_lists_what_shared_names_lists(spark):
    rng = random.Random(4)
    sets = [None, [], [""], ["a", "a"], ["a", "b"], ["b", None, "c"], ["", "c"]]
    uses = [(rng.choice(["f", "g", None]), i, rng.choice(sets)) for i in range(80)]
    defined = [(rng.choice(["f", "g", "h", None]), i, rng.choice(sets)) for i in range(6)]
    schema = "file string, block int, names array<string>"
    a, b = spark.createDataFrame(uses, schema), spark.createDataFrame(defined, schema)
    want = {(u, d) for f, u, names in uses for g, d, more in defined if f and f == g and {x for x in names or [] if x} & set(more or [])}
    got = [tuple(r) for r in relations.names_of_few(a, b).collect()]
    assert set(got) == want == {tuple(r) for r in relations.shared_names(a, b).collect()} and len(got) == len(want)


def test_line_relations_reads_texts_once(spark):
    plan = mining_plans.line_relations(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and "documents.parquet" not in plan


def test_anchors_that_repeat_others_meet_no_profile_again(spark):
    met = spark.sparkContext.accumulator(0)

    @F.udf("boolean")
    def same(a, b):
        met.add(1)
        return a == b

    anchors = [("r", k, "ab"[k % 2]) for k in range(200)]
    blocks = [("r", k, "abc"[k % 3]) for k in range(200)]
    scores = {"same_file": F.lit(True), "same_class": same("ac", "bc"), "similarity": F.lit(1.0), "negative_type": F.lit("file")}
    got = mining.mined_by_profile(spark.createDataFrame(anchors, "repo string, anchor int, ac string"), spark.createDataFrame(blocks, "repo string, block int, bc string"), ["repo"], ["bc"], scores, spark.createDataFrame([(0, 6), (4, 4)], "source int, target int"), 3).collect()
    want = {(a, b, at + 1) for _, a, ac in anchors for at, (_, b) in enumerate(sorted((bc != ac, b) for _, b, bc in blocks if a != b and {a, b} != {0, 6})[:3])}
    assert {(r.anchor, r.block, r["rank"]) for r in got} == want and len(got) == len(want)
    assert met.value <= 60  # two distinct anchors and three profiles, some evaluations each


def test_mined_negatives_reads_texts_once_and_leaves_blocks_where_they_are(spark):
    plan = mining_plans.mined_negatives(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract" not in plan and "documents.parquet" not in plan and "array_union" not in plan
    rows = [("r", k, None if k == 3 else f"a_b{k % 3}", [f"w{k % 5}", "w1"] if k % 4 else None, "c", "f") for k in range(12)]
    blocks = spark.createDataFrame(rows, "repo string, block int, name string, words array<string>, class string, file string")
    anchors = blocks.where("block < 4").withColumnRenamed("block", "anchor").withColumn("issue", F.array(F.lit("w1")))
    few, mining.FEW = mining.FEW, 0
    try:
        many = mining.mined(anchors, blocks, spark.createDataFrame([(0, 5)], "source int, target int"), ["repo"], 6).collect()
    finally:
        mining.FEW = few
    want = set()
    share = lambda x, y: len(x & y) / len(x | y) if x | y else 0.0
    for _, a, an, aw, *_ in rows[:4]:
        near = []
        for _, b, bn, bw, *_ in rows:
            if a != b and {a, b} != {0, 5}:
                names = share(set(an.split("_")), set(bn.split("_"))) if an and bn else 0.0
                near.append((-round(max(names, share(set(aw or []), set(bw or [])), share({"w1"}, set(bw or []))), 4), b))
        want |= {(a, b, -n, at + 1) for at, (n, b) in enumerate(sorted(near)[:6])}
    assert {(r.anchor, r.block, r.similarity, r["rank"]) for r in many} == want
