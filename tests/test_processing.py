"""Outcomes of tasks, document negatives, exports and the report against plain loops on hand-made rows."""

from __future__ import annotations

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from loam.operators import processing, records


def test_first_file_that_a_task_does_not_touch(spark):
    rng = random.Random(5)
    files = {f"r{r}": {f"{rng.choice('abc')}/{k}.py" for k in range(rng.randrange(9))} for r in range(6)}
    tasks = [(f"t{k}", f"r{rng.randrange(7)}") for k in range(60)]
    touched = [(t, p) for t, r in tasks for p in rng.sample(sorted(files.get(r, ())), rng.randrange(len(files.get(r, ())) + 1))] + [("t0", None), ("t1", "elsewhere.py"), ("t1", "elsewhere.py")]
    got = processing.first_unrelated(
        spark.createDataFrame(tasks + tasks[:3], "task string, repo string"), spark.createDataFrame(touched, "task string, path string"),
        spark.createDataFrame([(r, p) for r, ps in files.items() for p in ps] + [("r1", None)], "repo string, path string"))
    want = {}
    for t, r in tasks:
        free = sorted(files.get(r, set()) - {p for x, p in touched if x == t})
        if free:
            want[t] = (r, free[0])
    assert {r.task: (r.repo, r.path) for r in got.collect()} == want and got.count() == len(want)


def test_first_file_of_no_tasks(spark):
    none = spark.createDataFrame([], "task string, repo string")
    got = processing.first_unrelated(none, spark.createDataFrame([], "task string, path string"), spark.createDataFrame([("r", "a.py")], "repo string, path string"))
    assert got.collect() == []


def test_negative_rows_are_heads_without_blank_ends(spark):
    files = spark.createDataFrame([("r", "a.py", ["x", "", "y", " ", "z"]), ("r", "b.py", ["", " ", "", "", "late"]), ("r", "c.py", None), ("q", "a.py", ["other"])], "repo string, path string, lines array<string>")
    chosen = spark.createDataFrame([(1, "r", "a.py"), (2, "r", "b.py"), (3, "r", "c.py"), (4, "r", "a.py")], "task int, repo string, path string")
    got = {r.task: r for r in processing.negative_rows(chosen, files, 4, 7).collect()}
    assert set(got) == {1, 4} and got[1].code == "x\n\ny" and got[1].line_numbers == [1, 2, 3] and got[1].line_roles == ["DROP"] * 3
    assert got[1].line_keep_labels == [0] * 3 and got[1].line_confidences == [0.9] * 3 and got[1].line_provenance == [["document_negative:unrelated_file"]] * 3 and got[1].document_label == 0
    assert got[4].sample_id == "docneg_" + hashlib.sha256(b"4\0a.py\x007").hexdigest()[:24]


def test_leaks_in_issue_or_code(spark):
    rows = [
        (1, "please  make it so", ["a"], ["make it so ok"], False), (2, "please  make it so", ["a"], ["  make   it so", "short"], False), (3, "we  make it so, yes", ["a"], ["make it so, yes"], True),
        (4, None, ["b", "  return   value + 1 "], ["return value + 1"], True), (5, None, ["b return value + 1"], ["return value + 1"], False), (6, "tiny", ["tiny"], ["tiny"], False),
        (7, None, None, None, False), (8, "some words here", None, ["some words here"], True), (9, "", [None], [None], False), (10, "", [], ["long enough to count"], False)]
    df = spark.createDataFrame(rows, "id int, issue string, lines array<string>, added array<string>, want boolean")
    got = df.withColumn("got", processing.leaks(F.col("issue"), F.col("lines"), F.col("added")))
    assert [r.id for r in got.where("not (got <=> want)").collect()] == []


def _chance(task: int, seed: int) -> float:
    return int(hashlib.sha256(json.dumps([task, seed], separators=(",", ":")).encode()).hexdigest()[:8], 16) / 0xFFFFFFFF


def test_outcomes_and_what_is_kept(spark):
    rng = random.Random(9)
    tasks = [(k, rng.choice(["do it", " \t", None, "x", "y"]), rng.choice([0, 1, 2, 3, None]), rng.choice([True, True, True, False, None])) for k in range(200)]
    samples = [(t[0], f"s{t[0]}-{j}", rng.choice([True, False, None])) for t in tasks for j in range(rng.randrange(4))]
    negatives = [(t[0], f"n{t[0]}") for t in tasks if rng.random() < 0.7]
    want, kept = {}, set()
    for task, q, core, mapped in tasks:
        own = [s for s in samples if s[0] == task]
        safe = [s for s in own if not s[2]]
        error = "query" if not (q or "").strip() else "core" if not core else "mapping" if not mapped else "samples" if not own else "leakage" if not safe else None
        taken = error is None and (task, f"n{task}") in negatives and _chance(task, 3) < 0.5
        want[task] = (error, len(own), len(safe), taken)
        kept |= {(task, s[1], "sample") for s in safe if error is None} | ({(task, f"n{task}", "document_negative")} if taken else set())
    s = spark.createDataFrame(samples, "task int, sample_id string, leaks boolean")
    n = spark.createDataFrame(negatives, "task int, sample_id string")
    told = processing.outcomes(spark.createDataFrame(tasks, "task int, query string, n_core int, mapped boolean"), s, n, 0.5, 3)
    assert {r.task: (r.error, r.n_samples, r.n_safe, r.negative) for r in told.collect()} == want
    assert {e for e, *_ in want.values()} == {"query", "core", "mapping", "samples", "leakage", None} and any(w[3] for w in want.values())
    ids = processing.kept_ids(told, s, n)
    assert {tuple(r) for r in ids.collect()} == kept
    rest = records.restricted(s.select("sample_id"), ids)
    assert {r[0] for r in rest.collect()} == {i for _, i, kind in kept if kind == "sample"}


def test_eligible_patches_name_python_files_alone(spark):
    rows = spark.createDataFrame([(1, "a.py"), (1, "b/c.py"), (2, "a.py"), (2, "b.txt"), (3, "x.pyc")], "id int, path string")
    assert [r.id for r in processing.eligible(rows).collect()] == [1]


def test_official_rows_carry_scores_and_check_marks(spark):
    schema = "sample_id string, query string, code string, keep array<int>, document_label int, original_score double"
    rows = [("a", "q", "x\ny\nz\n", [1, 0, 1], 1, None), ("b", None, "x", [0], 0, 0.25), ("c", "q", "", [], None, None), ("d", "q", None, None, 1, 0.0)]
    got = {r.sample_id: tuple(r)[1:] for r in processing.official(spark.createDataFrame(rows, schema)).collect()}
    assert got == {"a": ("q", "x\ny\nz\n", [1, 3], 1.0), "b": ("", "x", [], 0.25), "c": ("q", "", [], 0.0), "d": ("q", "", [], 0.0)}
    with pytest.raises(Exception, match="marks don't fit the lines of e"):
        processing.official(spark.createDataFrame([("e", "q", "x\ny", [1], 1, None)], schema)).collect()


def test_derived_rows_and_their_check(spark):
    schema = "parent_sample_id string, task string, repo_name string, query string, lines array<string>, keep array<int>, roles array<string>, confidences array<double>, least double, parent_path string"
    good = [("p", "t", None, "q", ["a", "b"], [1, 0], ["CORE", "DROP"], [1.0, 0.5], 0.15, "f.py")]
    r = processing.derived_rows(spark.createDataFrame(good, schema), F.concat(F.lit("nl "), F.col("parent_path")), "numbered_view").collect()[0]
    assert (r.sample_id, r.repo_name, r.code, r.line_numbers, r.command, r.document_label) == ("cmd_numbered_view_" + hashlib.sha256(b"p\0numbered_view").hexdigest()[:24], "", "a\nb\n", [1, 2], "nl f.py", 1)
    for lines, keep in ([["a"], [1, 0]], [[], []], [None, [1]]):
        with pytest.raises(Exception, match="arrays don't fit"):
            processing.derived_rows(spark.createDataFrame([("p", "t", "r", "q", lines, keep, keep and ["DROP"] * len(lines or []), [0.5] * len(lines or []), 0.1, "f")], schema), F.lit("c"), "k").collect()


SAMPLE = "task_id string, repo_name string, code string, roles array<string>, keep array<int>, confidences array<double>, provenance array<array<string>>, relation_types array<string>, hard_types array<string>, tokens int, truncated boolean, split string"


def test_report_lists_every_figure(spark):
    rows = [("t1", "r1", "ab\nc", ["CORE", "DROP"], [1, 0], [0.95, 1.0], [["x", "y"], ["x"]], ["CALL", "NONE"], ["h"], 3, True, "train"), ("t1", "r2", "abcd", ["SUPPORT"], [1], [0.0], [["y"]], ["NONE"], None, 5, None, "train"), ("t2", "", None, None, None, None, None, None, [], None, False, None)]
    fail, told = spark.createDataFrame([("t3", "LeakageError"), ("t1", "E"), ("t1", "E")], "task_id string, error_type string"), spark.createDataFrame([(True, None), (False, ""), (None, "bad"), (True, "bad")], "agreement boolean, error string")
    got = {(r.metric, r.key): r.value for r in processing.report(spark.createDataFrame(rows, SAMPLE), spark.range(4), spark.range(2), fail, told).collect()}
    want = {"successful_tasks": 2, "failed_tasks": 2, "tasks": 4, "repositories": 2, "samples": 3, "relations": 4, "rankings": 2, "core_lines": 1, "support_lines": 1, "drop_lines": 1, "truncated_samples": 1, "api_requests": 4, "api_successes": 2, "api_failures": 2, "leakage_failures": 1, "mean_lines": 1, "mean_chars": round(8 / 3, 9), "mean_tokens": round(8 / 3, 9), "agreement_rate": round(2 / 3, 9)}
    want |= {f"{r}_ratio": round(1 / 3, 9) for r in ("core", "support", "drop")}
    parts = {("provenance", "x"): 2, ("provenance", "y"): 2, ("relation_type", "CALL"): 1, ("relation_type", "NONE"): 2, ("hard_negative_type", "h"): 1, ("confidence", "0.9-1.0"): 2, ("confidence", "0.0-0.1"): 1, ("keep_ratio", "0.5-0.6"): 1, ("keep_ratio", "0.9-1.0"): 1, ("keep_ratio", "0.0-0.1"): 1, ("split_repositories", "train"): 2}
    assert got == {(k, ""): v for k, v in want.items()} | parts


def test_report_of_nothing(spark):
    none = spark.range(0)
    got = processing.report(spark.createDataFrame([], SAMPLE), none, none, spark.createDataFrame([], "task_id string, error_type string"), spark.createDataFrame([], "agreement boolean, error string")).collect()
    assert len(got) == 22 and all(r.value == 0 and r.key == "" for r in got)


def test_auxiliary_rows_without_a_sample_and_odd_labels(spark):
    rel = spark.createDataFrame([("a", "CALL"), ("b", "CALL"), ("z", "ODD"), (None, None)], "sample_id string, relation string")
    rank = spark.createDataFrame([("a", "h")], "sample_id string, kind string")
    ids = spark.createDataFrame([("a",), ("b",), ("b",)], "sample_id string")
    got = processing.auxiliary_findings({"relation": (rel, "relation"), "ranking": (rank, "kind")}, ids, {"relation": ("CALL",), "ranking": ("h",)})
    assert {tuple(r) for r in got.collect()} == {("orphan", "relation", "", 2), ("label", "relation", "ODD", 1), ("label", "relation", "", 1)}


def test_tasks_and_samples_parse_the_texts_once(spark):
    from loam.plans import building
    from loam.plans import processing as plans

    for query in (building.built_samples, plans.processed_tasks, plans.processed_samples):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert "split(text" not in plan, query.__name__
