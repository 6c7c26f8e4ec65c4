"""Registered queries of tasks' outcomes, document negatives, exports and the whole report, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import patches, processing, records, sampling
from loam.plans.building import BUILT, DIFFS, built_rows, diffs
from loam.plans.catalog import query, read
from loam.plans.dataset import SAMPLES, samples
from loam.storage import written

# documents as files of their source, those of a line or none left out; each language of a source is a task that touches its files
UNRELATED = f"""{SAMPLES}, F AS (SELECT source AS repo, lang || '/' || doc_id AS path, ls, lang FROM S WHERE len(ls) % 4 <> 1), K AS (SELECT DISTINCT source AS repo, lang FROM S), X AS (SELECT repo, K.lang, min(path) AS path FROM K JOIN F USING (repo) WHERE F.lang <> K.lang GROUP BY ALL),
H AS (SELECT X.*, ls[1:20] h FROM X JOIN F ON F.repo = X.repo AND F.path = X.path), B AS (SELECT *, list_max(list_transform(h, lambda x, i: CASE WHEN trim(x) <> '' THEN i ELSE 0 END)) m FROM H)"""


def _files(rows: DataFrame) -> DataFrame:
    s = rows.where(F.size("ls") % 4 != 1)
    return s.select(F.col("source").alias("repo"), F.concat_ws("/", "lang", "doc_id").alias("path"), F.col("ls").alias("lines"))


@query(f"""WITH {UNRELATED} SELECT 'docneg_' || substr(sha256(repo || ':' || lang || chr(0) || path || chr(0) || '42'), 1, 24) sample_id, repo || ':' || lang task, path, sha256(array_to_string(h[:m], chr(10))) code, CAST(m AS INTEGER) n_lines, greatest(1, (length(array_to_string(h[:m], chr(10))) + 3) // 4) tokens, 0 document_label FROM B WHERE m > 0""")
def unrelated_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document negatives: of each source and language the first file in another language, its first 20 lines."""
    files = _files(samples(spark, sf_dir))
    docs = read(spark, sf_dir, "documents").where("text <> ''")
    task = F.concat_ws(":", "source", "lang").alias("task")
    touched = docs.select(task, F.concat_ws("/", "lang", "doc_id").alias("path"))
    chosen = processing.first_unrelated(docs.select(task, F.col("source").alias("repo")), touched, files.select("repo", "path"))
    rows = processing.negative_rows(chosen, files, 20, 42)
    return rows.select("sample_id", "task", F.col("file_path").alias("path"), F.sha2("code", 256).alias("code"), F.size("line_roles").alias("n_lines"), F.col("estimated_tokens").alias("tokens"), "document_label")


# built samples as those of tasks; lines of some lengths are a patch's added ones; Spanish documents have no query
PROCESSED = rf"""{BUILT}, TK AS (SELECT doc_id, source, CASE WHEN lang = 'es' THEN '' ELSE ls[1] END query, len(list_filter(roles, lambda r: r = 'CORE')) n_core, len(ls) % 9 <> 4 mapped, list_filter(list_transform(list_filter(ls, lambda t: length(t) % 25 = 18), lambda t: trim(regexp_replace(t, '\s+', ' ', 'g'))), lambda t: length(t) >= 12) added FROM S),
SM AS (SELECT doc_id, 'sample_' || substr(sha256(doc_id || chr(0) || k || chr(0) || f || chr(0) || l || chr(0) || CASE WHEN v = 9 THEN 'none' ELSE 'u' || (k + v) END || chr(0) || '42'), 1, 24) sample_id, kind, list_has_any(nx, added) OR len(list_filter(added, lambda t: contains(trim(regexp_replace(query, '\s+', ' ', 'g')), t))) > 0 AS leaks FROM Z JOIN TK USING (doc_id) WHERE place <= 4),
FI AS (SELECT source, lang || '/' || doc_id AS path, doc_id, ls[1:20] h FROM S WHERE len(ls) % 4 <> 1), RK AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY path) r FROM FI), NX AS (SELECT TK.doc_id, arg_min({{'path': RK.path, 'h': RK.h}}, r) x FROM TK JOIN RK ON TK.source = RK.source AND RK.r <= 2 AND RK.doc_id <> TK.doc_id GROUP BY ALL),
NG AS (SELECT doc_id, 'docneg_' || substr(sha256(doc_id || chr(0) || x.path || chr(0) || '42'), 1, 24) sample_id FROM NX WHERE len(list_filter(x.h, lambda t: trim(t) <> '')) > 0), CT AS (SELECT doc_id, count(*) n, count(*) FILTER (WHERE NOT leaks) safe FROM SM GROUP BY doc_id),
OC AS (SELECT TK.doc_id, CASE WHEN NOT regexp_matches(query, '\S') THEN 'query' WHEN n_core < 1 THEN 'core' WHEN NOT mapped THEN 'mapping' WHEN coalesce(n, 0) = 0 THEN 'samples' WHEN safe = 0 THEN 'leakage' END error, coalesce(n, 0) n_samples, coalesce(safe, 0) n_safe,
NG.sample_id IS NOT NULL AND CAST('0x' || substr(sha256('[' || TK.doc_id || ',42]'), 1, 8) AS BIGINT) / 4294967295.0 < 0.25 lucky FROM TK LEFT JOIN CT ON CT.doc_id = TK.doc_id LEFT JOIN NG ON NG.doc_id = TK.doc_id)"""


def _processed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Outcomes of documents as tasks, their samples with whether they leak, and their document negatives."""
    s = written(samples(spark, sf_dir), "samples")
    asked = F.when(F.col("lang") == "es", "").otherwise(F.get("ls", F.lit(0)))
    tasks = s.select(F.col("doc_id").alias("task"), F.col("source").alias("repo"), F.concat_ws("/", "lang", "doc_id").alias("path"), asked.alias("query"), F.size(F.filter("roles", lambda r: r == "CORE")).alias("n_core"), (F.size("ls") % 9 != 4).alias("mapped"), F.filter("ls", lambda x: F.length(x) % 25 == 18).alias("added"))
    built = built_rows(s).select("task", "sample_id", "hard_negative_type", "code")
    judged = built.join(tasks.select("task", F.col("query").alias("issue"), "added"), "task").select("task", "sample_id", "hard_negative_type", processing.leaks(F.col("issue"), T.splitlines(F.col("code")), F.col("added")).alias("leaks"))
    files = _files(s)
    chosen = processing.first_unrelated(tasks.select("task", "repo"), tasks.select("task", "path"), files.select("repo", "path"))
    negatives = processing.negative_rows(chosen, files, 20, 42).select("task", "sample_id")
    judged, negatives = written(judged, "judged"), written(negatives, "negatives")  # ids and marks, which are read several times
    return processing.outcomes(tasks.select("task", "query", "n_core", "mapped"), judged, negatives, 0.25, 42), judged, negatives


@query(f"""WITH RECURSIVE {PROCESSED} SELECT doc_id, error, n_samples, n_safe, error IS NULL AND lucky AS negative FROM OC""")
def processed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What becomes of each document as a task: why it fails, or its samples, those that don't leak and its negative."""
    return _processed(spark, sf_dir)[0].withColumnRenamed("task", "doc_id")


@query(f"""WITH RECURSIVE {PROCESSED}, KP AS (SELECT doc_id, sample_id, 'sample' kind FROM SM JOIN OC USING (doc_id) WHERE error IS NULL AND NOT leaks UNION ALL SELECT doc_id, sample_id, 'document_negative' FROM NG JOIN OC USING (doc_id) WHERE error IS NULL AND lucky)
SELECT KP.doc_id, KP.sample_id, KP.kind, CASE WHEN SM.kind <> 'easy' THEN SM.kind END negative_type FROM KP LEFT JOIN SM USING (sample_id)""")
def processed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples and document negatives that tasks keep, with the rankings of those that are left."""
    told, judged, negatives = _processed(spark, sf_dir)
    kept = processing.kept_ids(told, judged, negatives)
    rankings = records.restricted(judged.where("hard_negative_type is not null").select("sample_id", F.col("hard_negative_type").alias("negative_type")), kept)
    return kept.join(rankings, "sample_id", "left").select(F.col("task").alias("doc_id"), "sample_id", "kind", "negative_type")


@query(rf"""WITH {DIFFS}, D AS (SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN replace(patch, '.txt' || chr(10), '.py' || chr(10)) ELSE patch END AS patch FROM P), N AS (SELECT doc_id, unnest(regexp_extract_all(patch, '(?m)^\+\+\+ ([^\r\n\x0b\x0c\x1c-\x1e\x{{85}}\x{{2028}}\x{{2029}}]+)', 1)) p FROM D) SELECT doc_id FROM N GROUP BY doc_id HAVING bool_and(ends_with(trim(p), '.py'))""")
def eligible_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as patches that touch Python files alone; every third one's names end so."""
    d = diffs(spark, sf_dir).withColumn("patch", F.when(F.col("doc_id") % 3 == 0, F.replace("patch", F.lit(".txt\n"), F.lit(".py\n"))).otherwise(F.col("patch")))
    return processing.eligible(patches.diff_files(d, "doc_id")).select(F.col("id").alias("doc_id"))


@query(f"""WITH {SAMPLES} SELECT S.doc_id, ls[1] query, sha256(array_to_string(ls, chr(10))) code, array_to_string(list_filter(range(1, len(ls) + 1), lambda i: keep[i] = 1), ',') kept_frags, CAST(CASE WHEN S.doc_id % 3 = 0 THEN coalesce(quality, 0) ELSE length(ls[1]) / 1000.0 END AS DOUBLE) score FROM S LEFT JOIN labels USING (doc_id) WHERE ls[-1] <> ''""")
def official_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples in the exchange form, their marks checked; every third one has no score of its own but its label's."""
    s = samples(spark, sf_dir).where(F.element_at("ls", -1) != "").join(read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("document_label")), "doc_id", "left")
    first = F.get("ls", F.lit(0))
    rows = s.select(F.col("doc_id").alias("sample_id"), first.alias("query"), F.array_join("ls", "\n").alias("code"), "keep", "document_label", F.when(F.col("doc_id") % 3 != 0, F.length(first) / 1000).alias("original_score"))
    return processing.official(rows).select(F.col("sample_id").alias("doc_id"), "query", F.sha2("code", 256).alias("code"), F.array_join(F.col("kept_frags").cast("array<string>"), ",").alias("kept_frags"), "score")


@query(f"""WITH {SAMPLES} SELECT 'cmd_numbered_view_' || substr(sha256(doc_id || chr(0) || 'numbered_view'), 1, 24) sample_id, CAST(doc_id AS VARCHAR) parent_sample_id, sha256(array_to_string(list_transform(ls, lambda x, i: CASE WHEN i < 1000000 THEN lpad(CAST(i AS VARCHAR), 6, ' ') ELSE CAST(i AS VARCHAR) END || chr(9) || x), chr(10)) || chr(10)) code, CAST(len(ls) AS INTEGER) n_lines, 0.15::DOUBLE minimum_keep_ratio, 'nl -ba ' || lang || '/' || doc_id AS command FROM S""")
def derived_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole rows of numbered views, made from documents as parents."""
    s = samples(spark, sf_dir)
    path = F.concat_ws("/", "lang", "doc_id")
    numbered = F.transform("ls", lambda x, i: F.concat(F.when(i < 999_999, F.lpad((i + 1).cast("string"), 6, " ")).otherwise((i + 1).cast("string")), F.lit("\t"), x))
    views = s.select(F.col("doc_id").alias("parent_sample_id"), F.col("doc_id").alias("task"), F.col("source").alias("repo_name"), F.get("ls", F.lit(0)).alias("query"), numbered.alias("lines"), "keep", "roles", F.transform("keep", lambda k: F.lit(0.9)).alias("confidences"), F.lit(0.15).alias("least"), path.alias("parent_path"))
    rows = processing.derived_rows(views, F.concat(F.lit("nl -ba "), F.col("parent_path")), "numbered_view")
    return rows.select("sample_id", "parent_sample_id", F.sha2("code", 256).alias("code"), F.size("line_numbers").alias("n_lines"), "minimum_keep_ratio", "command")


@query("""WITH n AS (SELECT p_partkey, row_number() OVER (ORDER BY substr(sha256('42' || chr(0) || p_partkey), 1, 24), p_partkey) r FROM part WHERE p_size > 10), o AS (SELECT s_suppkey, row_number() OVER (ORDER BY substr(sha256('42' || chr(0) || s_suppkey), 1, 24), s_suppkey) r, count(*) OVER () m FROM supplier)
SELECT p_partkey item, 0 turn, 'new' pool FROM n WHERE r <= 75 UNION ALL SELECT s_suppkey, CAST(t AS INTEGER), 'replay' FROM o, range(0, 26) g(t) WHERE t * m + r <= 25""")
def replayed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 100 rows, a quarter of them suppliers replayed, again and again if there are too few."""
    new = read(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_partkey").alias("item"))
    return sampling.replay_mix(new, read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("item")), "item", 100, 0.25, 42)


REPORTED = f"""{SAMPLES}, A AS (SELECT *, list_transform(ls, lambda x: (length(x) % 11) / 10.0) conf, list_transform(ls, lambda x: CASE WHEN length(x) % 5 = 0 THEN 'CALL' ELSE 'NONE' END) rel, list_transform(roles, lambda r: lower(r) || ':' || lang) prov, CASE WHEN len(ls) % 3 = 0 THEN [lang] ELSE [] END hard, length(array_to_string(ls, chr(10))) chars FROM S),
L AS (SELECT unnest(conf) conf, unnest(rel) rel, unnest(prov) prov, unnest(roles) r FROM A), X AS (SELECT count(*) m, sum(len(ls)) n, count(DISTINCT source || ':' || lang) ok, sum(chars) chars, sum(greatest(1, (chars + 3) // 4)) toks, count(*) FILTER (WHERE len(ls) > 60) cut FROM A),
E AS (SELECT count(*) n, count(*) FILTER (WHERE event_type = 'error') bad, count(*) FILTER (WHERE event_type IN ('click', 'purchase') AND value IS NOT NULL) told, count(*) FILTER (WHERE event_type IN ('click', 'purchase') AND value > 50) agreed FROM events), RC AS (SELECT count(*) FILTER (WHERE r = 'CORE') c, count(*) FILTER (WHERE r = 'SUPPORT') s, count(*) FILTER (WHERE r = 'DROP') d FROM L),
FA AS (SELECT count(*) f, count(*) FILTER (WHERE toxic = 1) lk FROM labels WHERE quality = 0)"""


@query(rf"""WITH {REPORTED}, ONE AS (SELECT * FROM (SELECT unnest([{{'metric': 'successful_tasks', 'value': ok::DOUBLE}}, {{'metric': 'failed_tasks', 'value': f}}, {{'metric': 'tasks', 'value': ok + f}}, {{'metric': 'repositories', 'value': (SELECT count(DISTINCT nullif(source, '')) FROM S)}}, {{'metric': 'samples', 'value': m}}, {{'metric': 'relations', 'value': (SELECT count(*) FROM conversations)}}, {{'metric': 'rankings', 'value': (SELECT count(*) FROM embeddings)}},
{{'metric': 'core_lines', 'value': RC.c}}, {{'metric': 'support_lines', 'value': RC.s}}, {{'metric': 'drop_lines', 'value': RC.d}}, {{'metric': 'core_ratio', 'value': RC.c / X.n}}, {{'metric': 'support_ratio', 'value': RC.s / X.n}}, {{'metric': 'drop_ratio', 'value': RC.d / X.n}}, {{'metric': 'mean_lines', 'value': X.n / m}}, {{'metric': 'mean_chars', 'value': chars / m}}, {{'metric': 'mean_tokens', 'value': toks / m}},
{{'metric': 'truncated_samples', 'value': cut}}, {{'metric': 'api_requests', 'value': E.n}}, {{'metric': 'api_successes', 'value': E.n - bad}}, {{'metric': 'api_failures', 'value': bad}}, {{'metric': 'agreement_rate', 'value': CASE WHEN told > 0 THEN agreed / told ELSE 0 END}}, {{'metric': 'leakage_failures', 'value': lk}}]) u FROM X, E, RC, FA))
SELECT u.metric metric, '' AS key, round(u.value, 9) AS value FROM ONE UNION ALL SELECT 'provenance', prov, count(*) FROM L GROUP BY prov UNION ALL SELECT 'relation_type', rel, count(*) FROM L GROUP BY rel UNION ALL SELECT 'hard_negative_type', h, count(*) FROM (SELECT unnest(hard) h FROM A) GROUP BY h
UNION ALL SELECT 'confidence', printf('%.1f-%.1f', k / 10.0, (k + 1) / 10.0), count(*) FROM (SELECT CAST(floor(least(conf, 0.999999) * 10) AS INTEGER) k FROM L) GROUP BY k UNION ALL SELECT 'keep_ratio', printf('%.1f-%.1f', k / 10.0, (k + 1) / 10.0), count(*) FROM (SELECT CAST(floor(least(list_sum(keep) / len(keep), 0.999999) * 10) AS INTEGER) k FROM A) GROUP BY k
UNION ALL SELECT 'split_repositories', CASE WHEN length(source) % 2 = 0 THEN 'train' ELSE 'test' END, count(DISTINCT source) FROM S GROUP BY 2""")
def whole_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every figure of documents as samples, events as reviews, junk labels as failures, in one long table."""
    s = samples(spark, sf_dir)
    code = F.array_join("ls", "\n")
    rows = s.select(
        F.concat_ws(":", "source", "lang").alias("task_id"), F.col("source").alias("repo_name"), code.alias("code"), "roles", "keep", F.transform("ls", lambda x: (F.length(x) % 11) / 10.0).alias("confidences"), F.transform("roles", lambda r: F.array(F.concat(F.lower(r), F.lit(":"), "lang"))).alias("provenance"),
        F.transform("ls", lambda x: F.when(F.length(x) % 5 == 0, "CALL").otherwise("NONE")).alias("relation_types"), F.when(F.size("ls") % 3 == 0, F.array("lang")).alias("hard_types"), T.token_estimate(code).alias("tokens"), (F.size("ls") > 60).alias("truncated"), F.when(F.length("source") % 2 == 0, "train").otherwise("test").alias("split"))
    failures = read(spark, sf_dir, "labels").where("quality = 0").select(F.col("doc_id").alias("task_id"), F.when(F.col("toxic") == 1, "LeakageError").otherwise("RuntimeError").alias("error_type"))
    e = read(spark, sf_dir, "events")
    decisions = e.select(F.when(F.col("event_type") == "error", F.col("props")).alias("error"), F.when(F.col("event_type").isin("click", "purchase"), F.col("value") > 50).alias("agreement"))
    return processing.report(rows, read(spark, sf_dir, "conversations"), read(spark, sf_dir, "embeddings"), failures, decisions)


@query("""WITH ids AS (SELECT doc_id FROM documents WHERE lang <> 'fr'), r AS (SELECT conv_id sample_id, role AS label FROM conversations), k AS (SELECT doc_id sample_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' END AS label FROM labels),
f AS (SELECT 'orphan' finding, 'relation' kind, '' AS key, count(*) n FROM r WHERE sample_id NOT IN (SELECT doc_id FROM ids) UNION ALL SELECT 'orphan', 'ranking', '', count(*) FROM k WHERE sample_id NOT IN (SELECT doc_id FROM ids)
UNION ALL SELECT 'label', 'relation', coalesce(label, ''), count(*) FROM r WHERE coalesce(label NOT IN ('user', 'assistant'), true) GROUP BY 3 UNION ALL SELECT 'label', 'ranking', coalesce(label, ''), count(*) FROM k WHERE coalesce(label <> 'good', true) GROUP BY 3) SELECT * FROM f WHERE n > 0""")
def auxiliary_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as relations and labels as rankings of documents that aren't French: rows without one, and odd labels."""
    ids = read(spark, sf_dir, "documents").where("lang <> 'fr'").select(F.col("doc_id").alias("sample_id"))
    turns = read(spark, sf_dir, "conversations").select(F.col("conv_id").alias("sample_id"), F.col("role").alias("label"))
    marks = read(spark, sf_dir, "labels").select(F.col("doc_id").alias("sample_id"), F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").alias("label"))
    return processing.auxiliary_findings({"relation": (turns, "label"), "ranking": (marks, "label")}, ids, {"relation": ("user", "assistant"), "ranking": ("good",)})
