"""Reports on a finished dataset, its screen, and the measures of a model's line choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators.metrics import bucket

#: Folders whose files are never read.
SKIPPED = (".git", ".venv", "venv", "node_modules", "build", "dist", "__pycache__")


def ratio(part: Column, whole: Column) -> Column:
    """part / whole, 0 for an empty whole."""
    return F.when(whole > 0, part / whole).otherwise(F.lit(0.0))


def task_counts(samples: DataFrame, failures: DataFrame) -> DataFrame:
    """Tasks that gave samples and tasks that failed, and failures for a leak; a task may be both, as in the sum."""
    done = samples.agg(F.count_distinct("task_id").alias("successful"), F.count_distinct(F.nullif("repo_name", F.lit(""))).alias("repositories"), F.count("*").alias("samples"))
    lost = failures.agg(F.count_distinct("task_id").alias("failed"), F.count_if(F.col("error_type") == "LeakageError").alias("leaks"))
    return done.crossJoin(F.broadcast(lost)).withColumn("tasks", F.col("successful") + F.col("failed"))  # one row each


def line_totals(samples: DataFrame) -> DataFrame:
    """Lines by role with their shares, and the means of lines and characters, from per-sample arrays: nothing is
    exploded, each sample adds its counts."""
    role = lambda r: F.coalesce(F.sum(F.size(F.filter("roles", lambda x: x == r))), F.lit(0))
    t = samples.agg(role("CORE").alias("core"), role("SUPPORT").alias("support"), role("DROP").alias("drop"), F.coalesce(F.sum(F.size("roles")), F.lit(0)).alias("n_lines"), F.count("*").alias("m"), F.coalesce(F.sum(F.length("code")), F.lit(0)).alias("chars"))
    share = lambda c: F.round(ratio(F.col(c), F.col("n_lines")), 9).alias(f"{c}_ratio")
    return t.select("core", "support", "drop", share("core"), share("support"), share("drop"), F.round(ratio(F.col("n_lines"), F.col("m")), 6).alias("mean_lines"), F.round(ratio(F.col("chars"), F.col("m")), 6).alias("mean_chars"))


def keep_ratio_histogram(samples: DataFrame, keep: str = "keep") -> DataFrame:
    """(bucket, n): samples by their share of kept lines."""
    share = F.aggregate(keep, F.lit(0), lambda s, k: s + k) / F.greatest(F.lit(1), F.size(keep))
    return samples.groupBy(bucket(share).alias("bucket")).agg(F.count("*").alias("n"))


def review_rates(decisions: DataFrame) -> DataFrame:
    """Requests, successes and failures of reviews, and the share of agreement among those with a second opinion."""
    bad = F.coalesce(F.col("error"), F.lit("")) != ""
    told = F.count("agreement")
    return decisions.agg(F.count("*").alias("requests"), F.count_if(~bad).alias("successes"), F.count_if(bad).alias("failures"), F.round(ratio(F.count_if("agreement"), told), 9).alias("agreement"))


def screen(rows: DataFrame, auxiliary: DataFrame, arrays: list[str], verified_only: Column) -> DataFrame:
    """(finding, n) of a dataset's rows (sample_id, text, lines, the ``arrays``): rows whose text holds a key, ids given
    again, arrays that don't fit the lines, rows that should be verified and aren't (``verified_only`` says that a row
    breaks this), auxiliary rows without a sample. Findings of none aren't listed."""
    per_row = {"key": T.has_secret(F.col("text")), "unverified": verified_only} | {f"length:{a}": ~F.coalesce(F.size(a) == F.size("lines"), F.lit(False)) for a in arrays}
    one = rows.agg(*[F.count_if(F.coalesce(c, F.lit(False))).alias(k) for k, c in per_row.items()])
    own = one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("finding"), F.col(f"`{k}`").alias("n")) for k in per_row])).alias("f")).select("f.*")
    again = rows.groupBy("sample_id").agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.lit("duplicate").alias("finding"), "n")
    orphan = auxiliary.join(rows.select("sample_id"), "sample_id", "left_anti").agg(F.count("*").alias("n")).select(F.lit("orphan").alias("finding"), "n")
    return own.unionAll(again).unionAll(orphan).where("n > 0")


def expected_counts(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """(key, n, expected) where the number of rows isn't the one in ``wanted`` (key, expected)."""
    got = rows.groupBy(key).agg(F.count("*").alias("n"))
    both = got.join(F.broadcast(wanted), key, "full").select(key, F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("expected", F.lit(0)).alias("expected"))  # wanted: a setting's few rows
    return both.where("n <> expected")


def training_rows(base: DataFrame, derived: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of the given samples and what was derived from them, the columns of either filled up with nulls. A
    wanted sample that isn't there and an id given twice are rows with an ``error``, so the caller can stop on them."""
    wanted = ids.select("sample_id").distinct()
    own = base.join(wanted, "sample_id", "left_semi")
    more = derived.join(wanted.withColumnRenamed("sample_id", "parent_sample_id"), "parent_sample_id", "left_semi")
    rows = own.unionByName(more, allowMissingColumns=True)
    missing = wanted.join(base, "sample_id", "left_anti").select("sample_id", F.lit("missing").alias("error"))
    again = rows.groupBy("sample_id").agg(F.count("*").alias("m")).where("m > 1").select("sample_id", F.lit("duplicate").alias("error"))
    return rows.withColumn("error", F.lit(None).cast("string")).unionByName(missing.unionAll(again), allowMissingColumns=True)


def mapped(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    """The fields of ``names`` under their new names. A field that no row can have is refused at once; a row whose marks
    (keep) aren't as many as its lines fails the job."""
    if not names or not set(names) <= set(rows.columns):
        raise ValueError(f"fields missing: {sorted(set(names) - set(rows.columns))}" if names else "no fields given")
    fits = F.size("lines") == F.size("keep")
    checked = rows.where(F.when(F.coalesce(fits, F.lit(False)), True).otherwise(F.raise_error(F.concat(F.lit("marks don't fit the lines of "), F.col("sample_id").cast("string")))))
    return checked.select(*[F.col(a).alias(b) for a, b in names.items()])


def source_manifest(samples: DataFrame, splits: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(source, samples, repositories, weight, and repositories by split): what each source gives; ``splits``
    (repo_name, split). ``weights`` are for a loader and repeat no row."""
    table = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]) if weights else F.create_map().cast("map<string,double>")
    pairs = samples.groupBy("source", "repo_name").agg(F.count("*").alias("n")).join(splits, "repo_name", "left")
    within = lambda s: F.count_distinct(F.when(F.col("split") == s, F.col("repo_name"))).alias(s)
    once = F.when(F.col("first"), F.col("n"))
    first = F.row_number().over(Window.partitionBy("source", "repo_name").orderBy("split")) == 1
    per = pairs.withColumn("first", first).groupBy("source").agg(F.sum(once).alias("samples"), F.count_distinct(F.nullif("repo_name", F.lit(""))).alias("repositories"), within("train"), within("validation"), within("test"))
    return per.withColumn("weight", F.coalesce(F.try_element_at(table, F.col("source")), F.lit(0.0)))


def frames_in_files(frames: DataFrame, files: DataFrame, resolved: DataFrame) -> DataFrame:
    """(task, place, file, line, name, role) of traceback frames that stand in known files: ``frames`` (task,
    place, path, line, name), ``resolved`` (path, file) as of ``relations.resolve_paths``. A task's last such frame is
    CORE, those before it SUPPORT."""
    known = frames.join(resolved.where("file is not null"), "path").join(files.select("file").distinct(), "file", "left_semi")
    last = known.groupBy("task").agg(F.max("place").alias("last"))
    role = F.when(F.col("place") == F.col("last"), "CORE").otherwise("SUPPORT")
    return known.join(last, "task").select("task", "place", "file", "line", "name", role.alias("role"))


def positive_pick(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The SUPPORT candidate of the highest confidence of each group, the first of equals: ``edges`` (keys, candidate,
    relation, role, confidence, seq). A partial maximum, so a hot group costs a row a task."""
    best = F.max_by(F.struct("candidate", "relation", "confidence"), F.struct("confidence", -F.col("seq")))
    return edges.where("role = 'SUPPORT'").groupBy(*keys).agg(best.alias("v")).select(*keys, "v.*")


def line_measures(tokens: DataFrame, threshold: float) -> DataFrame:
    """Measures of kept lines from tokens (sample_id, line, prob, keep, role, hard): a line's probability is the mean of
    its tokens', and it's hard if one of them is. Ratios of nothing are 0."""
    lines = tokens.groupBy("sample_id", "line").agg(F.avg("prob").alias("p"), F.max("keep").alias("t"), F.max("role").alias("role"), F.bool_or("hard").alias("hard"))
    p = F.col("p") >= threshold
    t, one = F.col("t") == 1, F.lit(1)
    of = lambda c, part: F.count_if(c & part) / F.greatest(one, F.count_if(c))
    c = lines.agg(
        of(p, t).alias("precision"), of(t, p).alias("recall"), of(F.col("role") == "CORE", p).alias("core_recall"), of(F.col("role") == "SUPPORT", p).alias("support_recall"),
        of(~p & F.col("role").isNotNull(), F.col("role") == "DROP").alias("drop_precision"), of(F.col("hard"), p).alias("false_keep"), (F.count_if(p) / F.greatest(one, F.count("*"))).alias("keep_ratio"))
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12))
    return c.select(*[F.round(x, 9).alias(x) for x in c.columns], F.round(f1, 9).alias("f1"))


def ranked_files(files: DataFrame, wanted: DataFrame, most: int) -> DataFrame:
    """(repo, path, rank): the Python files of a repository that are read, ``wanted`` ones (repo, path) first and all of
    them, then others by path up to ``most`` in all. Files in folders of tools and caches are left out."""
    inside = F.array_except(F.split("path", "/"), F.array(*[F.lit(x) for x in SKIPPED]))
    py = files.where(F.col("path").endswith(".py") & (F.size(inside) == F.size(F.array_distinct(F.split("path", "/")))))
    marked = py.join(wanted.select("repo", "path").distinct().withColumn("first", F.lit(True)), ["repo", "path"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    rank = F.row_number().over(Window.partitionBy("repo").orderBy(F.desc("first"), "path"))
    return marked.withColumn("rank", rank).where(F.col("first") | (F.col("rank") <= most)).select("repo", "path", "rank")


def derived_error(arrays: list[str]) -> Column:
    """Why a derived row (lines, the ``arrays``, parent_sample_id) can't be used: no lines, an array that doesn't fit them
    (by its name), no parent; null if it can."""
    n = F.coalesce(F.size("lines"), F.lit(0))
    error = F.when(n < 1, "code")
    for a in arrays:
        error = error.when(~F.coalesce(F.size(a) == n, F.lit(False)), a)
    return error.when(F.coalesce(F.col("parent_sample_id"), F.lit("")) == "", "parent_sample_id")
