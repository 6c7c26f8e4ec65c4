"""Registered queries of the line-dataset operators, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import graph, labels, metrics, sampling

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def doc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, line, text): the lines of all documents, from 1."""
    docs = read(spark, sf_dir, "documents").select("doc_id", T.splitlines(F.col("text")).alias("lines"))
    return docs.select("doc_id", F.posexplode("lines").alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("line"), "text")


def sql_lines(text: str) -> str:
    parts = rf"string_split_regex({text}, '\\r\\n|[\\n\\r\\x0b\\x0c\\x1c\\x1d\\x1e\\x{{85}}\\x{{2028}}\\x{{2029}}]')".replace("\\\\", "\\")
    return f"(CASE WHEN {parts}[-1] = '' THEN {parts}[:-2] ELSE {parts} END)"


LINES = f"""lines AS (SELECT doc_id, i AS line, ls[i] AS text FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) i FROM (SELECT doc_id, {sql_lines("text")} ls FROM documents)))"""


@query(f"""WITH {LINES}, shared AS (SELECT text FROM lines WHERE length(text) >= 12 GROUP BY text HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT doc_id, line, text IN (SELECT text FROM shared) core FROM lines),
n AS (SELECT *, max(core) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) near FROM m)
SELECT doc_id, count(*) FILTER (WHERE core) n_core, count(*) FILTER (WHERE near AND NOT core) n_support, count(*) FILTER (WHERE NOT near) n_drop FROM n GROUP BY doc_id""")
def doc_line_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that documents share are CORE, those within two of one SUPPORT, the others DROP. A line's hash and not its
    text is shuffled, short lines, of which a few are everywhere, not at all, and a line is shared if the first and the
    last document that have it differ."""
    lines = doc_lines(spark, sf_dir).select("doc_id", "line", F.when(F.length("text") >= 12, F.unhex(F.md5(F.col("text").cast("binary")))).alias("h"))
    long_ = lines.where("h is not null")
    shared = long_.groupBy("h").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo <> hi").select("h")
    core = long_.join(shared, "h", "left_semi").select("doc_id", "line", F.lit(True).alias("core"))
    marked = lines.select("doc_id", "line").join(core, ["doc_id", "line"], "left").select("doc_id", "line", F.coalesce("core", F.lit(False)).alias("core"))
    near = labels.dilate(marked, ["doc_id"], "line", "core", 2)
    return near.groupBy("doc_id").agg(F.count_if("core").alias("n_core"), F.count_if(F.col("near") & ~F.col("core")).alias("n_support"), F.count_if(~F.col("near")).alias("n_drop"))


@query(r"""SELECT doc_id, sha256(trim(regexp_replace(text, '[\s\x1c-\x1f]+', ' ', 'g'))) fragment_hash FROM documents""")
def fragment_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.fragment_hash(F.col("text")).alias("fragment_hash"))


@query("""SELECT doc_id, 'doc_' || substr(sha256(source || chr(0) || doc_id), 1, 24) sample_id FROM documents""")
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.stable_id("doc", F.col("source"), F.col("doc_id")).alias("sample_id"))


TOKENS = r"list_distinct(list_transform(regexp_extract_all({}, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda x: lower(x)))"


@query(f"""WITH d AS (SELECT doc_id, doc_id % (SELECT max(item_id) + 1 FROM benchmark) item_id, {TOKENS.format("text")} a FROM documents),
b AS (SELECT item_id, {TOKENS.format("text")} b FROM benchmark)
SELECT doc_id, item_id, CAST(len(list_intersect(a, b)) AS INTEGER) overlap, round(len(list_intersect(a, b)) / greatest(1, len(list_distinct(list_concat(a, b)))), 9) jaccard FROM d JOIN b USING (item_id)""")
def lexical_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifier overlap of each document with one benchmark item: an equi-join, then array intersections."""
    items = read(spark, sf_dir, "benchmark").select("item_id", T.query_tokens(F.col("text")).alias("b"))
    top = items.agg(F.max("item_id") + 1).first()[0] or 1
    docs = read(spark, sf_dir, "documents").select("doc_id", (F.col("doc_id") % top).alias("item_id"), T.query_tokens(F.col("text")).alias("a"))
    return docs.join(items, "item_id").select("doc_id", "item_id", F.size(F.array_intersect("a", "b")).alias("overlap"), F.round(T.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"))


@query("""SELECT doc_id, greatest(1, (length(text) + 3) // 4) tokens, len(string_split(text, chr(10))) <= 240 AND length(text) <= 30000 AND greatest(1, (length(text) + 3) // 4) <= 7500 fits FROM documents""")
def budget_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    t, lines = T.token_estimate(F.col("text")), F.size(F.split("text", "\n", -1))
    return read(spark, sf_dir, "documents").select("doc_id", t.alias("tokens"), ((lines <= 240) & (F.length("text") <= 30000) & (t <= 7500)).alias("fits"))


#: A secret of the test tables besides API keys.
PLANTED = r"token\s*=\s*\"[0-9a-f]{40}\""


@query(rf"""SELECT doc_id, sha256(regexp_replace(text, '{PLANTED}', '{T.REDACTED}', 'g')) redacted FROM documents WHERE regexp_matches(text, '(^|[^A-Za-z0-9_-])sk-[A-Za-z0-9_-]{{8,}}|{PLANTED}')""")
def secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").where(T.has_secret(F.col("text"), PLANTED)).select("doc_id", F.sha2(T.redact(F.col("text"), PLANTED), 256).alias("redacted"))


@query("""SELECT o_orderkey FROM orders WHERE CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) / 4294967295.0 < 0.25""")
def bernoulli_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.gate(read(spark, sf_dir, "orders"), "o_orderkey", 0.25).select("o_orderkey")


@query("""SELECT toxic, doc_id, CAST(rank AS INTEGER) rank FROM (SELECT toxic, doc_id, row_number() OVER (PARTITION BY toxic ORDER BY substr(sha256(CAST(doc_id AS VARCHAR)), 1, 24), doc_id) rank FROM labels) WHERE rank <= 50""")
def balanced_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 50 rows of each class by hash order."""
    return sampling.balanced_top(read(spark, sf_dir, "labels"), "toxic", "doc_id", 50).select("toxic", "doc_id", "rank")


@query("""SELECT source, doc_id, CAST(round AS INTEGER) round FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY substr(sha256(CAST(doc_id AS VARCHAR)), 1, 24), doc_id) round FROM documents) WHERE round <= 20""")
def round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 20 rounds over the sources."""
    return sampling.round_robin(read(spark, sf_dir, "documents"), "source", "doc_id", 20).select("source", "doc_id", "round")


@query("""SELECT CAST('0x' || substr(sha256(CAST(o_orderkey AS VARCHAR)), 1, 8) AS BIGINT) % 16 shard, count(*) n, CAST(sum(o_orderkey) AS BIGINT) keys FROM orders GROUP BY 1""")
def shard_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").groupBy(sampling.shard(F.col("o_orderkey"), 16).alias("shard")).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("""SELECT printf('%.1f-%.1f', k / 10.0, (k + 1) / 10.0) bucket, count(*) n FROM (SELECT CAST(floor(least(greatest(l_discount * 10, 0), 0.999999) * 10) AS INTEGER) k FROM lineitem) GROUP BY 1""")
def discount_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy(metrics.bucket(F.col("l_discount") * 10).alias("bucket")).agg(F.count("*").alias("n"))


@query("""SELECT source, count(*) samples, count(DISTINCT sha256(text)) texts, CAST(sum(n_chars) AS BIGINT) chars, round(avg(n_chars), 6) mean_chars, count(quality) labelled, count(*) FILTER (WHERE toxic = 1) toxic,
round(count(*) FILTER (WHERE toxic = 1) / greatest(1, count(quality)), 9) toxic_ratio FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source""")
def dataset_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels"), "doc_id", "left").withColumn("h", F.sha2("text", 256))
    toxic = F.count_if(F.col("toxic") == 1)
    return rows.groupBy("source").agg(F.count("*").alias("samples"), F.count_distinct("h").alias("texts"), F.sum("n_chars").alias("chars"), F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.count("quality").alias("labelled"), toxic.alias("toxic"), F.round(toxic / F.greatest(F.lit(1), F.count("quality")), 9).alias("toxic_ratio"))


@query("""SELECT lang, source, count(*) n FROM documents GROUP BY lang, source""")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"))


@query("""WITH r AS (SELECT user_id, event_id, event_type, round(value, 6) confidence, CASE event_type WHEN 'purchase' THEN 2 WHEN 'click' THEN 1 ELSE 0 END rank FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY rank DESC, confidence DESC, event_id) p FROM r),
s AS (SELECT user_id, string_agg(event_type, ',' ORDER BY f) provenance FROM (SELECT user_id, event_type, min(event_id) f FROM r GROUP BY user_id, event_type) GROUP BY user_id)
SELECT user_id, CASE rank WHEN 2 THEN 'CORE' WHEN 1 THEN 'SUPPORT' ELSE 'DROP' END AS role, confidence, provenance FROM b JOIN s USING (user_id) WHERE p = 1""")
def label_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    role = F.when(F.col("event_type") == "purchase", "CORE").when(F.col("event_type") == "click", "SUPPORT").otherwise("DROP")
    rows = read(spark, sf_dir, "events").select("user_id", role.alias("role"), F.round("value", 6).alias("confidence"), F.col("event_id").alias("seq"), F.col("event_type").alias("source"))
    return labels.lattice_merge(rows, ["user_id"]).withColumn("provenance", F.array_join("provenance", ","))


RELATIONS = {"click": 0.88, "purchase": 0.9, "error": 0.8}


@query("""SELECT event_type relation, count(*) n, CASE event_type WHEN 'click' THEN 0.88 WHEN 'purchase' THEN 0.9 WHEN 'error' THEN 0.8 ELSE 0.7 END::DOUBLE confidence FROM events GROUP BY event_type""")
def relation_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = F.create_map(*[F.lit(x) for kv in RELATIONS.items() for x in kv])
    return read(spark, sf_dir, "events").groupBy(F.col("event_type").alias("relation")).agg(F.count("*").alias("n")).withColumn("confidence", F.coalesce(F.try_element_at(table, F.col("relation")), F.lit(0.7)))


@query(f"""WITH {LINES}, n AS (SELECT doc_id, max(line) n FROM lines GROUP BY doc_id),
b AS (SELECT doc_id, unnest(range(1, n + 1, 20)) AS start, 20 w FROM n UNION ALL SELECT doc_id, unnest(range(3, n + 1, 7)), 4 FROM n),
j AS (SELECT l.doc_id, line, b.start, b.start + w - 1 AS stop, row_number() OVER (PARTITION BY l.doc_id, line ORDER BY w > 10, w, b.start DESC) r FROM lines l JOIN b ON l.doc_id = b.doc_id AND line BETWEEN b.start AND b.start + w - 1)
SELECT doc_id, CAST(line AS INTEGER) line, CAST(start AS INTEGER) AS start, CAST(stop AS INTEGER) AS stop FROM j WHERE r = 1""")
def enclosing_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each line with the smallest of two families of line blocks around it."""
    lines = doc_lines(spark, sf_dir).select("doc_id", "line")
    n = lines.groupBy("doc_id").agg(F.max("line").alias("n"))
    def family(first: int, step: int, width: int) -> DataFrame:
        starts = F.when(F.col("n") >= first, F.sequence(F.lit(first), F.col("n"), F.lit(step))).otherwise(F.array().cast("array<int>"))
        return n.select("doc_id", F.explode(starts).alias("start")).select("doc_id", "start", (F.col("start") + width - 1).alias("stop"), F.lit(width > 10).alias("container"))
    return labels.smallest_enclosing(lines, family(1, 20, 20).unionAll(family(3, 7, 4)), ["doc_id"], "line")


@query("""SELECT u.event_id, (SELECT max(d.event_id) FROM events d WHERE d.user_id = u.user_id AND d.event_type = 'click' AND d.event_id < u.event_id) definition FROM events u WHERE u.event_type = 'purchase'""")
def latest_definition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each purchase with the user's last click before it: a backward as-of join by one sort."""
    e = read(spark, sf_dir, "events")
    uses = e.where("event_type = 'purchase'").select("user_id", "event_id")
    clicks = e.where("event_type = 'click'").select("user_id", "event_id", F.col("event_id").alias("definition"))
    return labels.latest_definition(uses, clicks, "user_id", "event_id", "definition").select("event_id", "definition")


@query("""WITH u AS (SELECT string_split(p_name, ' ')[-1] AS name, p_partkey, p_size FROM part), one AS (SELECT name, p_size, any_value(p_partkey) target FROM u GROUP BY name, p_size HAVING count(*) = 1)
SELECT count(*) resolved, CAST(coalesce(sum(target), 0) AS BIGINT) targets FROM one""")
def unique_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names that resolve since they stand once."""
    p = read(spark, sf_dir, "part").select(F.concat_ws("/", F.element_at(F.split("p_name", " "), -1), "p_size").alias("name"), "p_partkey")
    return graph.unique_targets(p, "name", "p_partkey").agg(F.count("*").alias("resolved"), F.coalesce(F.sum("p_partkey"), F.lit(0)).alias("targets"))


@query("""WITH f AS (SELECT p_partkey FROM part WHERE p_size = 50) SELECT l_suppkey AS supplier, count(DISTINCT l_orderkey) orders FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM f) GROUP BY l_suppkey""")
def frontier_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One hop from a frontier of parts, as a semi-join; the frontier is a filter of part."""
    parts = read(spark, sf_dir, "part").where("p_size = 50").select(F.col("p_partkey").alias("l_partkey"))
    return read(spark, sf_dir, "lineitem").join(parts, "l_partkey", "left_semi").groupBy(F.col("l_suppkey").alias("supplier")).agg(F.count_distinct("l_orderkey").alias("orders"))


@query("""WITH e AS (SELECT DISTINCT l_orderkey src, 'supplied' relation, -l_suppkey dst FROM lineitem), f AS (SELECT o_orderkey node FROM orders WHERE o_orderpriority LIKE '1%')
SELECT DISTINCT dst AS node, relation FROM e WHERE src IN (SELECT node FROM f)""")
def one_hop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Neighbours of all orders of the first priority. A node is its kind and number: an order's key may be that of a
    supplier, negative or not."""
    node = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("id"))
    edges = read(spark, sf_dir, "lineitem").where("l_orderkey is not null").select(node("order", F.col("l_orderkey")).alias("src"), F.lit("supplied").alias("relation"), node("supplier", -F.col("l_suppkey")).alias("dst")).distinct()
    frontier = read(spark, sf_dir, "orders").where("o_orderpriority like '1%'").select(node("order", F.col("o_orderkey")).alias("node"))
    return graph.one_hop(edges, frontier).select("node.id", "relation").withColumnRenamed("id", "node")


@query("""WITH c AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY sha256(text)) component FROM documents), h AS (SELECT *, CAST('0x' || substr(sha256('split' || chr(0) || component), 1, 8) AS BIGINT) / 4294967295.0 h FROM c)
SELECT doc_id, component, CASE WHEN h < 0.1 THEN 'test' WHEN h < 0.2 THEN 'validation' ELSE 'train' END split FROM h""")
def component_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that share a fingerprint land in one split."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("fingerprint"))
    label = graph.shared_key_components(docs, "doc_id", ["fingerprint"])
    return label.join(graph.split_components(label, 0.1, 0.1), "component").select(F.col("node").alias("doc_id"), "component", "split")


@query("""SELECT l.doc_id FROM labels l WHERE NOT EXISTS (SELECT 1 FROM documents d WHERE d.doc_id = l.doc_id) UNION ALL SELECT d.doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE d.doc_id = l.doc_id)""")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, marks = read(spark, sf_dir, "documents").select("doc_id"), read(spark, sf_dir, "labels").select("doc_id")
    return marks.join(docs, "doc_id", "left_anti").unionAll(docs.join(marks, "doc_id", "left_anti"))


@query(f"""WITH {LINES}, f AS (SELECT DISTINCT trim(regexp_replace(x, '\\s+', ' ', 'g')) t FROM (SELECT unnest(string_split(text, '.')) x FROM benchmark) WHERE length(trim(regexp_replace(x, '\\s+', ' ', 'g'))) >= 12),
p AS (SELECT doc_id, trim(regexp_replace(unnest(string_split(text, '.')), '\\s+', ' ', 'g')) t FROM lines)
SELECT doc_id, count(*) leaks FROM p WHERE t IN (SELECT t FROM f) GROUP BY doc_id""")
def leaked_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences of 12 or more normalised characters that stand in the benchmark: a semi-join on the fragment."""
    split = lambda df, *keep: df.select(*keep, F.explode(F.split("text", r"\.", -1)).alias("x")).select(*keep, F.trim(F.regexp_replace("x", r"[ \t\n\f\r]+", " ")).alias("t"))
    forbidden = split(read(spark, sf_dir, "benchmark")).where(F.length("t") >= 12).distinct()
    return split(doc_lines(spark, sf_dir), "doc_id").where(F.length("t") >= 12).join(forbidden, "t", "left_semi").groupBy("doc_id").agg(F.count("*").alias("leaks"))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 51).alias("prob"), (F.col("l_returnflag") == "R").alias("truth"))


@query("""WITH c AS (SELECT count(*) FILTER (WHERE p AND t) tp, count(*) FILTER (WHERE p AND NOT t) fp, count(*) FILTER (WHERE NOT p AND t) fn, count(*) FILTER (WHERE NOT p AND NOT t) tn FROM (SELECT l_quantity / 51 >= 0.5 p, l_returnflag = 'R' t FROM lineitem)),
r AS (SELECT *, tp / greatest(tp + fp, 1) p, tp / greatest(tp + fn, 1) r FROM c) SELECT tp, fp, fn, tn, round(p, 9) AS precision, round(r, 9) recall, round(2 * p * r / greatest(p + r, 1e-12), 9) f1 FROM r""")
def selection_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_scored(spark, sf_dir), "prob", "truth", 0.5)


CURVE = """curve AS (SELECT CAST(s * 5 AS INTEGER) percent, round(count(*) FILTER (WHERE k >= s) / count(*), 9) keep_ratio, round(count(*) FILTER (WHERE k >= s AND t) / greatest(1, count(*) FILTER (WHERE t)), 9) recall
FROM (SELECT floor(l_quantity / 51 * 20 + 1e-9) k, l_returnflag = 'R' t FROM lineitem), range(1, 20) r(s) GROUP BY s)"""


@query(f"WITH {CURVE} SELECT * FROM curve")
def threshold_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.threshold_curve(_scored(spark, sf_dir), "prob", "truth")


@query(f"WITH {CURVE} SELECT w::DOUBLE wanted, percent, keep_ratio, recall FROM (SELECT *, row_number() OVER (PARTITION BY w ORDER BY round(abs(keep_ratio - w), 9), percent) r FROM curve, (VALUES (0.5), (0.55)) v(w)) WHERE r = 1")
def operating_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    curve = metrics.threshold_curve(_scored(spark, sf_dir), "prob", "truth")
    return metrics.operating_point(curve, 0.5).unionAll(metrics.operating_point(curve, 0.55))


@query(f"""WITH {LINES}, k AS (SELECT doc_id, line, length(text) % 3 = 0 keep FROM lines) SELECT doc_id, string_agg(CASE WHEN keep THEN CAST(line AS VARCHAR) END, ',' ORDER BY line) kept_frags, CAST(max(CASE WHEN keep THEN 1 ELSE 0 END) AS INTEGER) document_label FROM k GROUP BY doc_id""")
def official_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    """1-based kept lines and the document's label, from per-line arrays."""
    docs = read(spark, sf_dir, "documents").select("doc_id", F.transform(T.splitlines(F.col("text")), lambda x: F.length(x) % 3 == 0).alias("keep"))
    frags = F.filter(F.transform("keep", lambda k, i: F.when(k, i + 1)), lambda x: x.isNotNull())
    out = docs.where(F.size("keep") > 0).select("doc_id", F.array_join(frags, ",").alias("s"), F.exists("keep", lambda k: k).cast("int").alias("document_label"))
    return out.select("doc_id", F.when(F.col("s") != "", F.col("s")).alias("kept_frags"), "document_label")


@query(f"""WITH {LINES}, k AS (SELECT doc_id, line, text LIKE '%|%' m FROM lines), d AS (SELECT a.doc_id, a.line, min(abs(a.line - b.line)) distance FROM k a LEFT JOIN k b ON a.doc_id = b.doc_id AND b.m GROUP BY a.doc_id, a.line)
SELECT doc_id, CAST(line AS INTEGER) line, CAST(distance AS INTEGER) distance FROM d""")
def anchor_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_lines(spark, sf_dir).withColumn("mark", F.col("text").contains("|"))
    return labels.nearest_marked(rows, ["doc_id"], "line", "mark").select("doc_id", "line", "distance")


@query(f"""WITH {LINES}, k AS (SELECT doc_id, line, length(text) % 5 = 0 keep, length(text) len FROM lines), r AS (SELECT *, count(*) OVER (PARTITION BY doc_id) n, row_number() OVER (PARTITION BY doc_id ORDER BY keep DESC, len DESC, line) rank FROM k)
SELECT doc_id, CAST(line AS INTEGER) line, keep FROM r WHERE keep OR rank <= least(greatest(ceil(n * 0.4), 1), greatest(n - 1, 1))""")
def context_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = doc_lines(spark, sf_dir).select("doc_id", "line", (F.length("text") % 5 == 0).alias("keep"), F.length("text").alias("len"))
    return sampling.select_views(rows, ["doc_id"], "line", "keep", [F.desc("len")], 0.4).select("doc_id", "line", "keep")


@query("""SELECT sha256(concat_ws(chr(0), lang, text)) signature, min(doc_id) first_doc, count(*) copies FROM documents GROUP BY 1""")
def content_signatures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").groupBy(F.sha2(F.concat_ws("\0", "lang", "text"), 256).alias("signature")).agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


@query(f"""WITH RECURSIVE {LINES}, m AS MATERIALIZED (SELECT doc_id, line, contains(text, 'a') core, count(*) OVER (PARTITION BY doc_id) n FROM lines), c AS MATERIALIZED (SELECT doc_id, line, n FROM m WHERE core),
s AS (SELECT doc_id, min(line) f FROM c GROUP BY doc_id UNION ALL SELECT s.doc_id, min(c.line) f FROM s JOIN c ON s.doc_id = c.doc_id AND c.line >= s.f + 12 GROUP BY s.doc_id),
w AS (SELECT s.doc_id, f, max(c.line) l, max(c.n) n FROM s JOIN c ON s.doc_id = c.doc_id AND c.line BETWEEN s.f AND s.f + 11 GROUP BY s.doc_id, f),
p AS (SELECT doc_id, greatest(1, least(f - (12 - (l - f + 1)) // 2, n - 11)) first, n FROM w)
SELECT DISTINCT doc_id, CAST(first AS INTEGER) AS first, CAST(least(first + 11, n) AS INTEGER) AS last FROM p""")
def core_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of at most 12 lines around the lines with an a: an ordered fold, in SQL a recursion over window starts."""
    docs = read(spark, sf_dir, "documents").select("doc_id", T.splitlines(F.col("text")).alias("ls"))
    rows = docs.select("doc_id", F.size("ls").alias("n_lines"), F.posexplode("ls").alias("pos", "x")).where(F.col("x").contains("a")).select("doc_id", "n_lines", (F.col("pos") + 1).alias("line"))
    return labels.core_windows(rows, ["doc_id"], 12)


@query("""WITH r AS (SELECT doc_id, (row_number() OVER (ORDER BY substr(sha256(CAST(doc_id AS VARCHAR)), 1, 24), doc_id) - 1) % 4 p FROM labels WHERE toxic = 1) SELECT doc_id, round, CAST((p + round) % 4 AS INTEGER) profile FROM r, range(0, 4) t(round)""")
def profile_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row meets each of four profiles once, in an order that its place rotates. Places come from counts by hash
    prefix, so no task sorts all rows."""
    rows = read(spark, sf_dir, "labels").where("toxic = 1").withColumn("h", T.stable_hash(F.col("doc_id"))).withColumn("part", F.substring("h", 1, 3))
    from pyspark.sql import Window

    counts = rows.groupBy("part").agg(F.count("*").alias("n"))  # 4,096 rows at most
    ahead = counts.withColumn("ahead", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.col("ahead") + F.row_number().over(Window.partitionBy("part").orderBy("h", "doc_id")) - 1
    placed = rows.join(F.broadcast(ahead.select("part", "ahead")), "part").select("doc_id", place.alias("p"))
    return placed.select("doc_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(3).cast("long"))).alias("round"), "p").select("doc_id", "round", ((F.col("p") + F.col("round")) % 4).cast("int").alias("profile"))
