"""Registered queries of patches, windows, samples, orders and code, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import code
from loam.functions import text as T
from loam.operators import alignment, building, graph, ordering, patches, records, relations
from loam.plans.catalog import query, read, sql_lines
from loam.plans.dataset import SAMPLES, marked, samples
from loam.sources import indexed
from loam.storage import work_dir, written

# documents as diffs: a hunk every 10 lines, marks by the lines' lengths, now and then another file's header
DIFFS = f"""P AS (SELECT doc_id, '--- a/' || lang || '/' || doc_id || '.txt' || chr(10) || '+++ b/' || lang || '/' || doc_id || '.txt' || chr(10) || array_to_string(list_transform(ls, lambda x, i:
CASE WHEN i % 10 = 1 THEN '@@ -' || i || ',10 +' || i || ',10 @@ part' || chr(10) ELSE '' END || CASE WHEN length(x) % 43 = 0 THEN '--- a/' || i || '.txt' || chr(10) WHEN length(x) % 43 = 1 THEN '+++ b/' || i || '.txt' || chr(10) ELSE '' END ||
CASE length(x) % 7 WHEN 0 THEN '-' WHEN 1 THEN '+' WHEN 2 THEN '+' WHEN 3 THEN CASE WHEN length(x) % 5 = 0 THEN '' ELSE ' ' END ELSE ' ' END || x), chr(10)) AS patch FROM (SELECT doc_id, lang, {sql_lines("text")} ls FROM documents WHERE text IS NOT NULL))"""


def diffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat_ws("/", "lang", F.concat("doc_id", F.lit(".txt"))).alias("path"), T.splitlines(F.col("text")).alias("ls"))

    def line(x, i):
        n, k = F.length(x), (i + 1).cast("string")
        hunk = F.when(i % 10 == 0, F.concat(F.lit("@@ -"), k, F.lit(",10 +"), k, F.lit(",10 @@ part\n"))).otherwise("")
        other = F.when(n % 43 == 0, F.concat(F.lit("--- a/"), k, F.lit(".txt\n"))).when(n % 43 == 1, F.concat(F.lit("+++ b/"), k, F.lit(".txt\n"))).otherwise("")
        return F.concat(hunk, other, F.when(n % 7 == 0, "-").when((n % 7).isin(1, 2), "+").when((n % 7 == 3) & (n % 5 == 0), "").otherwise(" "), x)

    return docs.select("doc_id", F.concat(F.lit("--- a/"), "path", F.lit("\n+++ b/"), "path", F.lit("\n"), F.array_join(F.transform("ls", line), "\n")).alias("patch"))


@query(rf"""WITH {DIFFS}, L AS (SELECT doc_id, n, ls[n] raw FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) n FROM (SELECT doc_id, {sql_lines("patch")} ls FROM P))),
K AS (SELECT *, CASE WHEN starts_with(raw, '--- ') THEN 'old' WHEN starts_with(raw, '+++ ') THEN 'new' WHEN regexp_matches(raw, '^@@ -(\d+)(?:,\d+)? \+\d+(?:,\d+)? @@') THEN 'hunk' ELSE 'body' END kind, regexp_replace(substr(raw, 5), '^[ab]/', '') told FROM L),
A AS (SELECT *, coalesce(last_value(CASE WHEN kind = 'old' THEN told END IGNORE NULLS) OVER w, last_value(CASE WHEN kind = 'new' THEN told END IGNORE NULLS) OVER w, '') path, count(*) FILTER (WHERE kind IN ('old', 'hunk')) OVER w part FROM K WINDOW w AS (PARTITION BY doc_id ORDER BY n ROWS UNBOUNDED PRECEDING)),
B AS (SELECT *, first_value(kind) OVER w head, TRY_CAST(regexp_extract(first_value(raw) OVER w, '^@@ -(\d+)', 1) AS INTEGER) start FROM A WINDOW w AS (PARTITION BY doc_id, part ORDER BY n)),
C AS (SELECT *, CASE WHEN kind = 'body' AND head = 'hunk' AND path <> '' AND raw <> '' THEN CASE WHEN raw[1] = '-' AND raw[1:3] <> '---' THEN 'deleted' WHEN raw[1] = '+' AND raw[1:3] <> '+++' THEN 'added' WHEN raw[1] = ' ' THEN 'context' WHEN raw[1] = '\' THEN 'note' ELSE 'stop' END END what FROM B),
D AS (SELECT * REPLACE (CASE WHEN coalesce(count(*) FILTER (WHERE what = 'stop') OVER (PARTITION BY doc_id, part ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 0 THEN what END AS what) FROM C),
E AS (SELECT *, start + coalesce(count(*) FILTER (WHERE what IN ('deleted', 'context')) OVER (PARTITION BY doc_id, part ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) old_line, count(*) FILTER (WHERE what IN ('context', 'stop')) OVER (PARTITION BY doc_id, part ORDER BY n ROWS UNBOUNDED PRECEDING) run FROM D),
G AS (SELECT *, count(*) FILTER (WHERE what = 'deleted') OVER r = 0 pure, min(CASE WHEN what = 'added' THEN n END) OVER r lead FROM E WINDOW r AS (PARTITION BY doc_id, part, run))
SELECT doc_id, path, CAST(old_line AS INTEGER) old_line, what AS kind, raw[2:] AS text FROM G WHERE what IN ('deleted', 'added') UNION ALL SELECT doc_id, path, CAST(greatest(1, old_line) AS INTEGER), 'addition_context', '' FROM G WHERE what = 'added' AND pure AND n = lead""")
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Changed lines of the documents as diffs, and where changes only add."""
    return patches.diff_lines(diffs(spark, sf_dir), "doc_id").select(F.col("id").alias("doc_id"), "path", "old_line", "kind", "text")


# documents as files with units of 12 lines; a core line's block has three lines; two units that follow are negatives,
# and one of another file, which is none; lines of certain lengths are forbidden
UNITS = f"""{SAMPLES}, U AS (SELECT doc_id, k, 12 * k + 1 a, least(12 * k + 12, n) b FROM (SELECT doc_id, len(ls) n, unnest(range(0, (len(ls) + 11) // 12)) k FROM S)),
R AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) i, unnest(roles) r FROM S), C AS (SELECT R.doc_id, k, i s, least(i + 2, b) e FROM R JOIN U ON U.doc_id = R.doc_id AND U.k = (i - 1) // 12 WHERE r = 'CORE'),
G AS (SELECT doc_id, k, min(s) f FROM C JOIN U USING (doc_id, k) WHERE b - a >= 8 GROUP BY ALL UNION ALL SELECT G.doc_id, G.k, min(C.s) FROM G JOIN C ON C.doc_id = G.doc_id AND C.k = G.k AND C.e > G.f + 7 GROUP BY G.doc_id, G.k, G.f),
H AS (SELECT G.doc_id, G.k, f, max(e) l FROM G JOIN C ON C.doc_id = G.doc_id AND C.k = G.k AND C.s >= f AND C.e <= f + 7 GROUP BY ALL),
I AS (SELECT doc_id, k, f, least(b, greatest(a, f - (8 - (l - f + 1)) // 2) + 7) w2, a FROM H JOIN U USING (doc_id, k)),
W AS (SELECT doc_id, k, row_number() OVER (PARTITION BY doc_id, k ORDER BY min(f)) - 1 w, greatest(a, w2 - 7) w1, w2 FROM I GROUP BY doc_id, k, a, w2 UNION ALL SELECT doc_id, k, 0, a, b FROM U WHERE b - a < 8)"""


def _units(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The files of documents as samples, and their units (doc_id, unit, u_start, u_stop)."""
    files = rows.select("doc_id", "source", F.col("ls").alias("lines"), "roles")
    n = F.size("roles")
    units = files.select("doc_id", n.alias("n"), F.explode(F.sequence(F.lit(0), F.floor((n - 1) / 12).cast("int"))).alias("unit"))
    return files, units.select("doc_id", "unit", (F.col("unit") * 12 + 1).alias("u_start"), F.least(F.col("unit") * 12 + 12, "n").alias("u_stop"))


def _windows(files: DataFrame, units: DataFrame) -> DataFrame:
    core = files.select("doc_id", F.posexplode("roles").alias("i", "role")).where("role = 'CORE'").select("doc_id", F.floor(F.col("i") / 12).cast("int").alias("unit"), (F.col("i") + 1).alias("start"), (F.col("i") + 3).alias("stop"))
    return building.span_windows(units, core, ["doc_id", "unit"], 8)


@query(f"""WITH RECURSIVE {UNITS} SELECT doc_id, CAST(k AS INTEGER) AS unit, CAST(w AS INTEGER) AS "window", CAST(w1 AS INTEGER) AS first, CAST(w2 AS INTEGER) AS last FROM W""")
def unit_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 8 lines around the core blocks of units of 12."""
    return _windows(*_units(samples(spark, sf_dir)))


BUILT = f"""{UNITS}, D AS (SELECT doc_id, k, a, b FROM U WHERE NOT EXISTS (SELECT 1 FROM R WHERE R.doc_id = U.doc_id AND i BETWEEN a AND b AND r <> 'DROP')),
N AS (SELECT U.doc_id, U.k, arg_min({{'a': D.a, 'b': D.b}}, {{'g': least(abs(D.b - U.a), abs(D.a - U.b)), 'a': D.a}}) d FROM U JOIN D ON D.doc_id = U.doc_id AND D.k <> U.k GROUP BY ALL),
V AS (SELECT doc_id, k, w, v, CASE v WHEN 1 THEN 'same_file_other_branch' ELSE 'similar_name_no_relation' END kind, least(w1, a2) f, greatest(w2, b2) l FROM W JOIN (SELECT doc_id, k - d k, d v, a a2, b b2 FROM U, (VALUES (1), (2)) t(d) WHERE k >= d) USING (doc_id, k)
UNION ALL SELECT W.doc_id, W.k, w, 9, 'easy', least(w1, CASE WHEN w1 = a AND w2 = b THEN d.a END), greatest(w2, CASE WHEN w1 = a AND w2 = b THEN d.b END) FROM W JOIN U ON U.doc_id = W.doc_id AND U.k = W.k LEFT JOIN N ON N.doc_id = W.doc_id AND N.k = W.k),
X AS (SELECT *, list_max(list_transform(ls[f:l], lambda x, i: CASE WHEN x <> '' THEN i ELSE 0 END)) m FROM V JOIN S USING (doc_id)),
Y AS (SELECT doc_id, k, w, v, kind, f, f + m - 1 l, ls[f:f + m - 1] x, roles[f:f + m - 1] r, ls FROM X WHERE m > 0),
Q AS (SELECT *, row_number() OVER (PARTITION BY doc_id, k, f, l, kind ORDER BY w, v) o, length(array_to_string(x, chr(10))) chars, list_transform(x, lambda t: trim(regexp_replace(t, '\\s+', ' ', 'g'))) nx, list_transform(list_filter(ls, lambda t: length(t) % 40 = 39), lambda t: trim(regexp_replace(t, '\\s+', ' ', 'g'))) bad, trim(regexp_replace(ls[1], '\\s+', ' ', 'g')) q FROM Y),
Z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k, w, v) place FROM Q WHERE o = 1 AND l - f + 1 <= 24 AND chars <= 1500 AND greatest(1, (chars + 3) // 4) <= 350 AND list_contains(r, 'DROP') AND len(list_filter(r, lambda t: t = 'CORE')) >= 2
AND NOT list_has_any(list_filter(nx, lambda t: length(t) >= 12), bad) AND NOT (length(q) >= 12 AND list_contains(bad, q)))""".replace("\\\\", "\\")


@query(f"""WITH RECURSIVE {BUILT} SELECT doc_id, CAST(place AS INTEGER) place, 'sample_' || substr(sha256(doc_id || chr(0) || k || chr(0) || f || chr(0) || l || chr(0) || CASE WHEN v = 9 THEN 'none' ELSE 'u' || (k + v) END || chr(0) || '42'), 1, 24) sample_id, CASE WHEN v <> 9 THEN kind END hard_negative_type, sha256(array_to_string(x, chr(10))) code,
array_to_string(list_transform(r, lambda t, i: (f + i - 1) || ':' || t), ',') marks, array_to_string(list_transform(list_filter(list_zip(r, range(f, l + 1)), lambda t: t[1] = 'CORE'), lambda t: t[2]), ',') core, CAST(greatest(1, (chars + 3) // 4) AS BIGINT) tokens FROM Z WHERE place <= 4""")
def built_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of each document as a task: its units are anchors, with two negatives of the same file and one of another,
    and the easy variant; the first four that are accepted, as whole rows."""
    rows = built_rows(written(samples(spark, sf_dir), "samples"))
    marks = F.array_join(F.zip_with("line_numbers", "line_roles", lambda n, r: F.concat_ws(":", n, r)), ",")
    return rows.select(F.col("task").alias("doc_id"), "place", "sample_id", "hard_negative_type", F.sha2("code", 256).alias("code"), marks.alias("marks"), F.array_join(F.col("core_line_numbers").cast("array<string>"), ",").alias("core"), F.col("estimated_tokens").alias("tokens"))


def built_rows(rows: DataFrame) -> DataFrame:
    """The samples that are built from ``rows``, which are read by many steps: written ones are parsed once."""
    files, units = _units(rows)
    tasks = files.select(F.col("doc_id").alias("task"), F.get("lines", F.lit(0)).alias("query"), F.transform(F.filter("lines", lambda x: F.length(x) % 40 == 39), T.fragment_hash).alias("forbidden"))
    at = units.select(F.col("doc_id").alias("task"), F.col("unit").alias("anchor"), F.col("doc_id").alias("file"), "u_start", "u_stop")
    windows = _windows(files, units).select(F.col("doc_id").alias("task"), F.col("unit").alias("anchor"), "window", "first", "last").join(at, ["task", "anchor"]).withColumn("whole", (F.col("first") == F.col("u_start")) & (F.col("last") == F.col("u_stop")))
    follows = at.select("task", "u_start", "u_stop", F.col("anchor").alias("of"), F.explode(F.array(F.lit(1), F.lit(2))).alias("variant")).where("of >= variant")
    negatives = follows.select("task", (F.col("of") - F.col("variant")).alias("anchor"), "variant", F.when(F.col("variant") == 1, "same_file_other_branch").otherwise("similar_name_no_relation").alias("kind"), F.concat(F.lit("u"), "of").alias("block"), F.col("task").alias("v_file"), F.col("u_start").alias("v_start"), F.col("u_stop").alias("v_stop"))
    other = at.select("task", "anchor", F.lit(0).alias("variant"), F.lit("issue_keyword_match_no_relation").alias("kind"), F.lit("elsewhere").alias("block"), (F.col("task") + 1).alias("v_file"), F.lit(1).alias("v_start"), F.lit(3).alias("v_stop"))
    kept = files.select(F.col("doc_id").alias("task"), F.posexplode("roles").alias("i", "role")).where("role <> 'DROP'").select("task", F.floor(F.col("i") / 12).cast("int").alias("anchor")).distinct()
    dropped = at.join(kept, ["task", "anchor"], "left_anti").select("task", F.col("u_start").alias("start"), F.col("u_stop").alias("stop"))
    near = relations.nearest_unit(at.select("task", F.col("u_start").alias("a_start"), F.col("u_stop").alias("a_stop")).join(dropped, (F.col("a_start") == F.col("start")) & (at["task"] == dropped["task"]), "left_anti"), dropped, ["task"])
    own = near.where("start is not null").select("task", F.floor(F.col("a_start") / 12).cast("int").alias("anchor"), F.col("start").alias("n_start"), F.col("stop").alias("n_stop"))
    found = building.candidates(windows.drop("u_start", "u_stop"), negatives.unionByName(other), own)
    texts = files.select(F.col("doc_id").alias("file"), "lines", "roles")
    budget = {"lines": 24, "chars": 1_500, "tokens": 350, "core": 2}
    chosen = building.accepted(found, texts, tasks, 4, budget)
    return building.sample_rows(chosen, texts, tasks, 42)


REPOS = """R AS (SELECT doc_id, 'r' || (doc_id // 10) AS name, md5(text) h FROM documents WHERE text IS NOT NULL),
T AS (SELECT DISTINCT a.name u, b.name v FROM R a JOIN (SELECT h, min(name) AS name FROM R GROUP BY h) b USING (h) WHERE a.name <> b.name),
B AS (SELECT u, v FROM T UNION SELECT v, u FROM T), X AS (SELECT name u, name v FROM R UNION SELECT X.u, B.v FROM X JOIN B ON B.u = X.v),
C AS (SELECT u AS name, min(v) component FROM X GROUP BY u), H AS (SELECT component, sha256('[42,[' || string_agg('"' || name || '"', ',' ORDER BY name) || ']]') h FROM C GROUP BY component),
O AS (SELECT component, row_number() OVER (ORDER BY h) - 1 row, count(*) OVER () n FROM H),
Q AS (SELECT *, CASE WHEN n >= 3 THEN greatest(1, round_even(n * 0.1, 0)) ELSE 0 END t, CASE WHEN n >= 3 THEN greatest(1, round_even(n * 0.1, 0)) WHEN n = 2 THEN 1 ELSE 0 END v FROM O)"""


@query(f"""WITH RECURSIVE {REPOS} SELECT doc_id, component, CASE WHEN row >= n - t THEN 'test' WHEN row >= n - t - v THEN 'validation' ELSE 'train' END split FROM R JOIN C USING (name) JOIN Q USING (component)""")
def quota_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten documents each as a repository; those with an equal text in common stay together; a tenth of the groups for
    test and for validation."""
    rows = read(spark, sf_dir, "documents").where("text is not null").select("doc_id", F.concat(F.lit("r"), F.floor(F.col("doc_id") / 10).cast("string")).alias("name"), F.md5(F.col("text").cast("binary")).alias("h"))
    groups = graph.shared_key_components(rows, "name", ["h"]).withColumnRenamed("node", "name")
    splits = groups.join(ordering.quota_splits(groups, 42, 0.1, 0.1), "component")
    return rows.select("doc_id", "name").join(splits, "name").select("doc_id", "component", "split")


@query("""WITH n AS (SELECT *, row_number() OVER (ORDER BY l_extendedprice, l_orderkey, l_linenumber) - 1 row FROM lineitem) SELECT CAST(row % 16 AS INTEGER) shard, count(*) n, min(l_extendedprice) first, max(l_extendedprice) last, CAST(sum((row // 16) * l_linenumber) AS BIGINT) checksum FROM n GROUP BY 1""")
def row_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items by price, dealt out to 16 shards one by one."""
    rows = ordering.row_shards(read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice"), 16, "l_extendedprice", "l_orderkey", "l_linenumber")
    return rows.groupBy("shard").agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("first"), F.max("l_extendedprice").alias("last"), F.sum(F.col("turn") * F.col("l_linenumber")).alias("checksum"))


_LEXED = code.LEXER.replace("'", "''")
_KEYS = ", ".join(f"'{k}'" for k in code.KEYWORDS)
_JSON = "sha256(to_json({})::VARCHAR)"


@query(f"""WITH T AS (SELECT doc_id, list_filter(regexp_extract_all(coalesce(text, ''), '{_LEXED}'), lambda t: NOT starts_with(t, '#')) ts FROM documents),
E AS (SELECT doc_id, ts, list_transform(ts, lambda t: regexp_full_match(t, '{code.NAME}') AND t NOT IN ({_KEYS})) ids FROM T),
F AS (SELECT doc_id, ts, ids, list_distinct(list_transform(list_filter(list_zip(ts, ids), lambda x: x[2]), lambda x: x[1])) ns FROM E),
X AS (SELECT doc_id, unnest(ts) t, unnest(ids) id, unnest(range(len(ts))) k FROM E), Y AS (SELECT *, min(k) OVER (PARTITION BY doc_id, t) f FROM X),
Z AS (SELECT *, CASE WHEN id THEN 'v' || dense_rank() OVER (PARTITION BY doc_id, id ORDER BY f) ELSE t END s FROM Y), L AS (SELECT doc_id, list(s ORDER BY k) ls FROM Z GROUP BY doc_id)
SELECT E.doc_id, {_JSON.format("ts")} token_hash, {_JSON.format("list_transform(ts, lambda t, i: CASE WHEN ids[i] THEN 'IDENT' ELSE t END)")} identifier_normalized_hash, {_JSON.format("coalesce(ls, [])")} renamed_hash FROM E LEFT JOIN L USING (doc_id)""")
def code_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hashes of each text's tokens: as they are, without identifiers, and with identifiers by their order."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return code.all_hashes(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")


_SQL_END = r"\n\r\x0b\x0c\x1c\x1d\x1e\x{85}\x{2028}\x{2029}"


@query(rf"""WITH {SAMPLES}, X AS (SELECT doc_id, text, CAST(greatest(1, 599 - least(length(text) // 100, 598)) AS INTEGER) budget FROM documents WHERE text <> ''),
P AS (SELECT doc_id, budget, unnest(ps) p, unnest(range(len(ps))) k FROM (SELECT doc_id, budget, regexp_extract_all(text, ' ?\p{{L}}+| ?\p{{N}}{{1,3}}| ?[^\s\x0b\p{{L}}\p{{N}}]+|[\s\x0b]+') ps FROM X)), T AS (SELECT doc_id, budget, k, coalesce(sum(length(p)) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) start FROM P),
M AS (SELECT doc_id, unnest(ms) m, unnest(range(1, len(ms) + 1)) j FROM (SELECT doc_id, regexp_extract_all(text, '[^{_SQL_END}]*(?:\r\n|[{_SQL_END}])|[^{_SQL_END}]+') ms FROM X)), E AS (SELECT doc_id, j, sum(length(m)) OVER (PARTITION BY doc_id ORDER BY j) stop, count(*) OVER (PARTITION BY doc_id) n FROM M),
A AS (SELECT T.doc_id, k, coalesce(E.j, 0) line FROM (SELECT * FROM T WHERE k < budget) T ASOF LEFT JOIN E ON E.doc_id = T.doc_id AND T.start >= E.stop),
B AS (SELECT A.doc_id, k, least(line, len(ls) - 1) line, keep, roles, ls FROM A JOIN S USING (doc_id))
SELECT doc_id, CAST(count(*) AS INTEGER) tokens, CAST(max(line) + 1 AS INTEGER) seen_lines, sha256(string_agg(CAST(line AS VARCHAR), ',' ORDER BY k)) line_index, sum(keep[line + 1])::BIGINT kept, string_agg(CASE roles[line + 1] WHEN 'CORE' THEN '2' WHEN 'SUPPORT' THEN '1' ELSE '0' END, '' ORDER BY k) roles, round(avg(length(ls[line + 1]) * 1.0), 6) AS mean_length FROM B GROUP BY doc_id""")
def aligned_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of each text by their lines and labels, within what its query leaves of 600."""
    s = marked(read(spark, sf_dir, "documents").where("text <> ''").select("doc_id", "text", T.splitlines(F.col("text")).alias("ls")))  # a line at least
    n = F.size("ls")
    rows = s.select(F.col("doc_id").alias("id"), "text", n.alias("code_lines"), F.col("keep").alias("line_keep_labels"), F.col("roles").alias("line_roles"), F.transform("ls", lambda x: F.length(x).cast("double")).alias("line_confidences"), F.sequence(F.lit(1), n).alias("line_numbers"), F.array().cast("array<struct<start:int,stop:int>>").alias("hard_spans"))
    budget = alignment.budgets(F.floor(F.length("text") / 100), 601, 1, 1)["code"]
    got = alignment.labelled(alignment.with_token_lines(rows, "text", F.col("code_lines"), budget), F.lit(True))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return got.where("error is null").select(
        F.col("id").alias("doc_id"), F.size("keep").alias("tokens"), (F.array_max("line_index") + 1).alias("seen_lines"), F.sha2(F.array_join(F.col("line_index").cast("array<string>"), ","), 256).alias("line_index"), total("keep").cast("long").alias("kept"),
        F.array_join(F.col("roles").cast("array<string>"), "").alias("roles"), F.round(total("confidences") / F.size("confidences"), 6).alias("mean_length"))


@query("""SELECT doc_id, lang, source, n_chars, length(text) AS n FROM documents WHERE CAST(doc_id AS VARCHAR) IN (SELECT CAST(doc_id AS VARCHAR) FROM labels WHERE quality = 1)""")
def offset_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as indexed JSON lines, those labelled good read back by offset."""
    path = work_dir(spark, "records")
    indexed.write_indexed(read(spark, sf_dir, "documents"), path, "doc_id")
    ids = read(spark, sf_dir, "labels").where("quality = 1").select(F.col("doc_id").alias("id"))
    return indexed.read_by_ids(spark, path, ids, "doc_id long, lang string, source string, n_chars long, text string").select("doc_id", "lang", "source", "n_chars", F.length("text").alias("n"))


@query("""SELECT user_id, arg_max(event_type, event_id) event_type, max(event_id) event_id, substr(repeat(arg_max(event_type, event_id), 300), 1, 1000) error FROM events GROUP BY user_id""")
def upserted_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events put into a bucketed table by their types, one after the other, each over what is earlier."""
    path, events = work_dir(spark, "cache"), read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.repeat("event_type", 300).alias("error"))
    newest = events.groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    indexed.upsert_buckets(path, events.join(newest, ["user_id", "event_id"], "left_anti"), "user_id", "event_id", error_col="error")
    indexed.upsert_buckets(path, events.join(newest, ["user_id", "event_id"]), "user_id", "event_id", error_col="error")
    return indexed.read_buckets(spark, path).select("user_id", "event_type", "event_id", "error")


@query("""SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN role || ',' || role WHEN trim(text) <> '' THEN text ELSE '' END told FROM conversations WHERE conv_id IN (SELECT doc_id FROM labels WHERE toxic = 0)""")
def listed_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of the conversations whose number is a clean document's, with one value or several as a list."""
    turns = read(spark, sf_dir, "conversations").select("conv_id", "turn", F.when(F.col("turn") % 3 == 0, F.array("role", "role")).alias("many"), "text")
    clean = read(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").alias("conv_id"))
    return records.restricted(turns, clean, "conv_id").select("conv_id", "turn", F.array_join(records.as_list(F.col("many"), F.col("text")), ",").alias("told"))
