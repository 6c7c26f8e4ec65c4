"""Registered queries of reports, screens and measures, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import audit, relations
from loam.plans.catalog import query, read
from loam.plans.dataset import SAMPLES, samples


@query("""SELECT count(DISTINCT lang || n_chars) successful, count(DISTINCT nullif(source, '')) repositories, count(*) samples, (SELECT count(DISTINCT user_id) FROM events) failed, (SELECT count(*) FROM events WHERE event_type = 'error') leaks,
count(DISTINCT lang || n_chars) + (SELECT count(DISTINCT user_id) FROM events) tasks FROM documents""")
def report_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = read(spark, sf_dir, "documents").select(F.concat("lang", "n_chars").alias("task_id"), F.col("source").alias("repo_name"))
    lost = read(spark, sf_dir, "events").select(F.col("user_id").alias("task_id"), F.when(F.col("event_type") == "error", "LeakageError").otherwise("other").alias("error_type"))
    return audit.task_counts(done, lost)


@query(f"""WITH {SAMPLES}, c AS (SELECT len(list_filter(roles, lambda r: r = 'CORE')) c, len(list_filter(roles, lambda r: r = 'SUPPORT')) s, len(roles) n, length(array_to_string(ls, chr(10))) x FROM S), t AS (SELECT CAST(sum(c) AS BIGINT) core, CAST(sum(s) AS BIGINT) support, CAST(sum(n) AS BIGINT) n, sum(x) x, count(*) m FROM c)
SELECT core, support, n - core - support AS drop, round(core / n, 9) core_ratio, round(support / n, 9) support_ratio, round((n - core - support) / n, 9) drop_ratio, round(n / m, 6) mean_lines, round(x / m, 6) mean_chars FROM t""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.line_totals(samples(spark, sf_dir).withColumn("code", F.array_join("ls", "\n")))


@query(f"""WITH {SAMPLES}, r AS (SELECT CAST(floor(least(list_sum(keep) / len(keep), 0.999999) * 10) AS INTEGER) k FROM S) SELECT printf('%.1f-%.1f', k / 10.0, (k + 1) / 10.0) bucket, count(*) n FROM r GROUP BY 1""")
def keep_ratio_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.keep_ratio_histogram(samples(spark, sf_dir))


@query("""SELECT count(*) requests, count(*) FILTER (WHERE event_type <> 'error') successes, count(*) FILTER (WHERE event_type = 'error') failures,
round(count(*) FILTER (WHERE event_type IN ('click', 'purchase') AND value > 50) / greatest(1, count(*) FILTER (WHERE event_type IN ('click', 'purchase') AND value IS NOT NULL)), 9) agreement FROM events""")
def review_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    return audit.review_rates(e.select(F.when(F.col("event_type") == "error", F.col("props")).alias("error"), F.when(F.col("event_type").isin("click", "purchase"), F.col("value") > 50).alias("agreement")))


@query(f"""WITH {SAMPLES}, z AS (SELECT S.lang || '-' || len(ls) sample_id, text, ls, keep, S.lang FROM S JOIN documents USING (doc_id)), f AS (
SELECT 'key' finding, count(*) n FROM z WHERE regexp_matches(text, '(^|[^A-Za-z0-9_-])sk-[A-Za-z0-9_-]{{8,}}') UNION ALL SELECT 'unverified', count(*) FROM z WHERE lang = 'es' AND len(ls) < 3 UNION ALL
SELECT 'length:numbers', count(*) FROM z WHERE len(ls) > 5 UNION ALL SELECT 'duplicate', count(*) - count(DISTINCT sample_id) FROM z UNION ALL SELECT 'orphan', count(*) FROM documents WHERE lang || '-' || n_chars NOT IN (SELECT sample_id FROM z))
SELECT * FROM f WHERE n > 0""")
def screen_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a screen finds in documents taken as samples with defects; the numbers of a line beyond the fifth are missing."""
    docs = read(spark, sf_dir, "documents")
    rows = samples(spark, sf_dir).join(docs.select("doc_id", "text"), "doc_id")
    rows = rows.select(F.concat_ws("-", "lang", F.size("ls")).alias("sample_id"), "text", F.col("ls").alias("lines"), "keep", "lang", F.slice("keep", 1, 5).alias("numbers"))
    unverified = (F.col("lang") == "es") & (F.size("lines") < 3)
    return audit.screen(rows, docs.select(F.concat_ws("-", "lang", "n_chars").alias("sample_id")), ["keep", "numbers"], unverified)


@query("""WITH w AS (SELECT * FROM (VALUES ('en', 7), ('xx', 3), ('yy', 0)) v(lang, expected)), g AS (SELECT lang, count(*) n FROM documents GROUP BY lang)
SELECT coalesce(g.lang, w.lang) lang, coalesce(n, 0) n, CAST(coalesce(expected, 0) AS BIGINT) expected FROM g FULL JOIN w ON g.lang = w.lang WHERE coalesce(n, 0) <> coalesce(expected, 0)""")
def expected_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = spark.createDataFrame([("en", 7), ("xx", 3), ("yy", 0)], "lang string, expected long")
    return audit.expected_counts(read(spark, sf_dir, "documents"), "lang", wanted)


@query("""WITH ids AS (SELECT doc_id FROM labels WHERE quality = 1 UNION SELECT -5), own AS (SELECT doc_id sample_id, NULL AS role FROM documents WHERE doc_id IN (SELECT doc_id FROM ids)),
more AS (SELECT -10 - conv_id sample_id, role FROM conversations WHERE conv_id IN (SELECT doc_id FROM ids)), a AS (SELECT * FROM own UNION ALL SELECT * FROM more)
SELECT CAST(NULL AS VARCHAR) error, count(*) n, count(role) derived, CAST(sum(sample_id) AS BIGINT) ids FROM a UNION ALL SELECT 'missing', count(*), 0, CAST(sum(doc_id) AS BIGINT) FROM ids WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'duplicate', count(*), 0, CAST(sum(sample_id) AS BIGINT) FROM (SELECT sample_id FROM a GROUP BY sample_id HAVING count(*) > 1)""")
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted documents with the turns made from them, whose ids, one a conversation, are given again."""
    ids = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("sample_id")).unionAll(spark.range(1).select(F.lit(-5).cast("long")))
    base = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("sample_id"), "text")
    turns = read(spark, sf_dir, "conversations").select((-10 - F.col("conv_id")).alias("sample_id"), F.col("conv_id").alias("parent_sample_id"), "role")
    return audit.training_rows(base, turns, ids).groupBy("error").agg(F.count("*").alias("n"), F.count("role").alias("derived"), F.sum("sample_id").alias("ids"))


@query(f"""WITH {SAMPLES} SELECT doc_id AS "id", lang AS "language", array_to_string(list_transform(keep, lambda k: CAST(k AS VARCHAR)), ',') marks FROM S""")
def mapped_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumns({"lines": F.col("ls"), "sample_id": F.col("doc_id"), "joined": F.array_join("keep", ",")})
    return audit.mapped(s, {"doc_id": "id", "lang": "language", "joined": "marks"})


@query("""WITH sp AS (SELECT DISTINCT source, CASE length(source) % 3 WHEN 0 THEN 'train' WHEN 1 THEN 'validation' ELSE 'test' END split FROM documents)
SELECT lang AS source, count(*) samples, count(DISTINCT nullif(d.source, '')) repositories, count(DISTINCT CASE WHEN split = 'train' THEN d.source END) train, count(DISTINCT CASE WHEN split = 'validation' THEN d.source END) validation, count(DISTINCT CASE WHEN split = 'test' THEN d.source END) test,
CAST(CASE lang WHEN 'en' THEN 0.55 WHEN 'de' THEN 0.3 ELSE 0 END AS DOUBLE) weight FROM documents d LEFT JOIN sp USING (source) GROUP BY lang""")
def source_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Languages as sources and sources as repositories."""
    docs = read(spark, sf_dir, "documents").select(F.col("lang").alias("source"), F.col("source").alias("repo_name"))
    split = F.element_at(F.array(F.lit("train"), F.lit("validation"), F.lit("test")), F.length("repo_name") % 3 + 1)
    return audit.source_manifest(docs, docs.select("repo_name", split.alias("split")).distinct(), {"en": 0.55, "de": 0.3})


@query("""WITH k AS (SELECT DISTINCT 'lib/' || p_brand || '/' || p_size || '.py' AS file FROM part), fr AS (SELECT p_partkey task, 0 place, 'repo/lib/' || p_brand || '/' || p_size || '.py' path, p_size line, p_type AS name FROM part UNION ALL SELECT p_partkey, 1, p_size || '.py', 3, 'f' FROM part UNION ALL SELECT p_partkey, 2, 'none.py', 1, 'g' FROM part),
h AS (SELECT path, file FROM (SELECT DISTINCT path FROM fr) JOIN k ON file = path OR ends_with(file, '/' || path) OR ends_with(path, '/' || file)), o AS (SELECT path, min(file) AS file FROM h GROUP BY path HAVING count(*) = 1)
SELECT task, place, file, line, name, CASE WHEN place = max(place) OVER (PARTITION BY task) THEN 'CORE' ELSE 'SUPPORT' END role FROM fr JOIN o USING (path)""")
def frames_in_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three frames of a made traceback of each part, set to the files that they name by their paths' ends."""
    part = read(spark, sf_dir, "part")
    files = part.select(F.concat(F.lit("lib/"), "p_brand", F.lit("/"), "p_size", F.lit(".py")).alias("file")).distinct()
    text = F.format_string('Traceback\n  File "repo/lib/%s/%d.py", line %d, in %s\n    x\n  File "%d.py", line 3, in f\n  File "none.py", line 1, in g\n', "p_brand", "p_size", "p_size", "p_type", "p_size")
    frames = part.select(F.col("p_partkey").alias("task"), F.posexplode(T.traceback_frames(text)).alias("place", "f")).select("task", "place", "f.path", "f.line", "f.name")
    return audit.frames_in_files(frames, files, relations.resolve_paths(frames.select("path").distinct(), files))


@query("""SELECT l_orderkey, candidate, relation, confidence FROM (SELECT l_orderkey, l_partkey candidate, l_returnflag relation, l_discount confidence, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount DESC, l_partkey) r FROM lineitem WHERE l_returnflag = 'R') WHERE r = 1""")
def positive_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("l_returnflag") == "R", "SUPPORT").otherwise("DROP")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_partkey").alias("candidate"), F.col("l_returnflag").alias("relation"), F.col("l_discount").alias("confidence"), role.alias("role"), F.col("l_partkey").alias("seq"))
    return audit.positive_pick(rows, ["l_orderkey"])


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, avg(l_quantity) >= 25.3 p, max(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END) = 1 t, max(CASE l_returnflag WHEN 'R' THEN 'CORE' WHEN 'A' THEN 'SUPPORT' ELSE 'DROP' END) AS role, bool_or(l_linestatus = 'O') hard FROM lineitem GROUP BY 1, 2),
c AS (SELECT count(*) FILTER (WHERE p AND t) / greatest(1, count(*) FILTER (WHERE p)) AS precision, count(*) FILTER (WHERE p AND t) / greatest(1, count(*) FILTER (WHERE t)) recall, count(*) FILTER (WHERE p AND role = 'CORE') / greatest(1, count(*) FILTER (WHERE role = 'CORE')) core_recall,
count(*) FILTER (WHERE p AND role = 'SUPPORT') / greatest(1, count(*) FILTER (WHERE role = 'SUPPORT')) support_recall, count(*) FILTER (WHERE NOT p AND role = 'DROP') / greatest(1, count(*) FILTER (WHERE NOT p)) drop_precision, count(*) FILTER (WHERE p AND hard) / greatest(1, count(*) FILTER (WHERE hard)) false_keep, count(*) FILTER (WHERE p) / count(*) keep_ratio FROM l)
SELECT round(precision, 9) AS precision, round(recall, 9) recall, round(core_recall, 9) core_recall, round(support_recall, 9) support_recall, round(drop_precision, 9) drop_precision, round(false_keep, 9) false_keep, round(keep_ratio, 9) keep_ratio, round(2 * precision * recall / greatest(precision + recall, 1e-12), 9) f1 FROM c""")
def line_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items as tokens of an order's lines."""
    role = F.when(F.col("l_returnflag") == "R", "CORE").when(F.col("l_returnflag") == "A", "SUPPORT").otherwise("DROP")
    rows = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("sample_id"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("prob"), (F.col("l_discount") > 0.05).cast("int").alias("keep"), role.alias("role"), (F.col("l_linestatus") == "O").alias("hard"))
    return audit.line_measures(rows, 25.3)


@query("""WITH f AS (SELECT p_brand repo, CASE WHEN p_size % 10 = 0 THEN 'build/' ELSE 'src/' END || p_partkey || CASE WHEN p_size % 7 = 0 THEN '.txt' ELSE '.py' END path, p_size >= 45 AS first FROM part), g AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY first DESC, path) rank FROM f WHERE path LIKE '%.py' AND path NOT LIKE 'build/%')
SELECT repo, path, CAST(rank AS INTEGER) rank FROM g WHERE first OR rank <= 5""")
def ranked_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as files of their brand's repository: the wanted ones and, up to five, others."""
    folder, end = F.when(F.col("p_size") % 10 == 0, "build/").otherwise("src/"), F.when(F.col("p_size") % 7 == 0, ".txt").otherwise(".py")
    f = read(spark, sf_dir, "part").select(F.col("p_brand").alias("repo"), F.concat(folder, "p_partkey", end).alias("path"), "p_size")
    return audit.ranked_files(f.select("repo", "path"), f.where("p_size >= 45"), 5)


@query(f"""WITH {SAMPLES} SELECT doc_id, CASE WHEN len(ls) > 20 THEN 'keep' WHEN lang = 'es' THEN 'parent_sample_id' END error FROM S""")
def derived_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with derived rows: marks cut after 20 lines, a language without parents."""
    s = samples(spark, sf_dir).select("doc_id", F.col("ls").alias("lines"), "roles", F.slice("keep", 1, 20).alias("keep"), F.when(F.col("lang") != "es", F.col("doc_id").cast("string")).alias("parent_sample_id"))
    return s.select("doc_id", audit.derived_error(["roles", "keep"]).alias("error"))
