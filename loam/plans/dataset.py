"""Registered queries of records, relations, arrays and checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loam.functions import arrays as A
from loam.functions import text as T
from loam.operators import checks, mining, records, relations, sampling
from loam.plans.catalog import LINES, query, read, sql_lines

#: Documents as samples: the lines, a role by a line's length, and a keep mark.
SAMPLES = f"""S AS (SELECT doc_id, source, lang, ls, list_transform(ls, lambda x: CASE WHEN length(x) % 9 = 0 THEN 'CORE' WHEN length(x) % 3 = 0 THEN 'SUPPORT' ELSE 'DROP' END) roles,
list_transform(ls, lambda x: CAST(length(x) % 3 = 0 AS INTEGER)) keep FROM (SELECT doc_id, source, lang, {sql_lines("text")} ls FROM documents) WHERE len(ls) > 0)"""


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked(read(spark, sf_dir, "documents").select("doc_id", "source", "lang", T.splitlines(F.col("text")).alias("ls")).where(F.size("ls") > 0))


def marked(docs: DataFrame) -> DataFrame:
    role = lambda x: F.when(F.length(x) % 9 == 0, "CORE").when(F.length(x) % 3 == 0, "SUPPORT").otherwise("DROP")
    return docs.select("*", F.transform("ls", role).alias("roles"), F.transform("ls", lambda x: (F.length(x) % 3 == 0).cast("int")).alias("keep"))


@query("""SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"lang":"' || lang || '","source":"' || source || '"}') canonical, CAST(CAST('0x' || substr(sha256('7' || chr(31) || doc_id), 1, 16) AS UBIGINT) AS VARCHAR) h64 FROM documents""")
def canonical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.canonical_json("doc_id", "lang", "source"), 256).alias("canonical"), T.hash64(F.lit(7), F.col("doc_id")).cast("string").alias("h64"))


@query(r"""SELECT doc_id, regexp_matches(text, '(?i)\b(change|replace|edit|modify)\b.{0,40}\b(to|with)\b|把.{0,30}(改成|替换为)|第\s*\d+\s*行') instructs FROM documents
UNION ALL SELECT -1 - conv_id * 1000 - turn, regexp_matches(text, '(?i)\b(change|replace|edit|modify)\b.{0,40}\b(to|with)\b|把.{0,30}(改成|替换为)|第\s*\d+\s*行') FROM conversations""")
def edit_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", T.has_instruction(F.col("text")).alias("instructs"))
    return docs.unionAll(read(spark, sf_dir, "conversations").select(-1 - F.col("conv_id") * 1000 - F.col("turn"), T.has_instruction(F.col("text"))))


@query(r"""WITH w AS (SELECT p_partkey, list_distinct(string_split_regex(lower(p_name), '[_\W]+')) a, list_distinct(string_split_regex(lower(p_type), '[_\W]+')) b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))), 9) similarity FROM w""")
def name_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", F.round(T.name_similarity(F.col("p_name"), F.col("p_type")), 9).alias("similarity"))


@query(r"""WITH r AS (SELECT s_suppkey, 'org/team' || s_nationkey || '__' || replace(s_name, '#', '.') || '.' || substr(sha256(s_name), 1, 7) v FROM supplier)
SELECT s_suppkey, 'team' || split_part(split_part(v, 'org/team', 2), '__', 1) || '/' || regexp_extract(v, '__(.*)\.[^.]*$', 1) repository, regexp_extract(v, '\.([^.]*)$', 1) "commit",
regexp_replace(v, '[^A-Za-z0-9_.-]+', '_', 'g') || '_' || substr(sha256(v), 1, 12) slug FROM r""")
def repo_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.concat(F.lit("org/team"), F.col("s_nationkey"), F.lit("__"), F.regexp_replace("s_name", "#", "."), F.lit("."), F.substring(F.sha2("s_name", 256), 1, 7))
    rows = read(spark, sf_dir, "supplier").select("s_suppkey", v.alias("v"))
    return rows.select("s_suppkey", T.repo_of(F.col("v")).alias("r"), T.slug(F.col("v")).alias("slug")).select("s_suppkey", "r.repository", "r.commit", "slug")


@query(rf"""WITH {SAMPLES} SELECT doc_id, sha256(array_to_string(list_transform(ls, lambda x, i: lpad(CAST(i AS VARCHAR), 6, ' ') || chr(9) || x), chr(10))) numbered,
sha256('[ANCHOR]' || chr(10) || ls[1] || chr(10) || '[CANDIDATE]' || chr(10) || ls[len(ls)]) pair FROM S""")
def numbered_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples(spark, sf_dir).select("doc_id", F.sha2(T.numbered_view(F.col("ls")), 256).alias("numbered"), F.sha2(T.pair_document(F.get("ls", F.lit(0)), F.element_at("ls", -1)), 256).alias("pair"))


GREP = """n AS (SELECT *, max(p) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) near, max(p) OVER (PARTITION BY doc_id) has_core FROM (SELECT *, role = 'CORE' p FROM L)),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY near DESC, CASE WHEN near THEN NULL ELSE substr(sha256('42' || chr(0) || doc_id || chr(0) || line), 1, 24) END, line) r FROM n WHERE has_core)"""


@query(f"""WITH {SAMPLES}, L AS (SELECT doc_id, CAST(unnest(range(1, len(ls) + 1)) AS INTEGER) line, unnest(ls) x, unnest(roles) role FROM S), {GREP}
SELECT doc_id, line, sha256('doc/' || doc_id || ':' || line || ':' || x) view, CAST(near AS INTEGER) keep, CASE WHEN p THEN role WHEN near THEN 'SUPPORT' ELSE 'DROP' END role, CAST(CASE WHEN p THEN 1.0 WHEN near THEN 0.75 ELSE 0.85 END AS DOUBLE) confidence FROM k WHERE r <= 40""")
def grep_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines as a search shows them: those within two of a CORE line, and others by hash order, up to 40."""
    rows = samples(spark, sf_dir).select("doc_id", F.posexplode(F.arrays_zip("ls", "roles")).alias("pos", "v")).select("doc_id", (F.col("pos") + 1).alias("line"), F.col("v.ls").alias("x"), F.col("v.roles").alias("role"))
    return sampling.grep_rows(rows, ["doc_id"], "line", 42, 40).select("doc_id", "line", F.sha2(T.grep_line(F.concat(F.lit("doc/"), F.col("doc_id")), F.col("line"), F.col("x")), 256).alias("view"), "keep", "role", "confidence")


@query(f"""WITH {SAMPLES}, w AS (SELECT doc_id, ls w FROM S), t AS (SELECT doc_id, w, list_max(list_transform(w, lambda x, i: CASE WHEN x <> '' THEN i ELSE 0 END)) a, list_max(list_transform(w, lambda x, i: CASE WHEN trim(x) <> '' THEN i ELSE 0 END)) b FROM w)
SELECT doc_id, CAST(a AS INTEGER) n_lines, CAST(b AS INTEGER) n_stripped FROM t""")
def trimmed_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = samples(spark, sf_dir).select("doc_id", F.col("ls").alias("w"))
    return w.select("doc_id", F.size(A.without_blank_end(F.col("w"))).alias("n_lines"), F.size(A.without_blank_end(F.col("w"), strip=True)).alias("n_stripped"))


@query(f"""WITH {SAMPLES}, i AS (SELECT *, list_filter(range(0, len(ls)), lambda k: keep[k + 1] = 1 OR k % 2 = 0) ix FROM S), v AS (SELECT *, list_transform(ix, lambda k: ls[k + 1]) sub, list_transform(ix, lambda k: keep[k + 1]) sk FROM i)
SELECT doc_id, sha256(array_to_string(sub, chr(10))) code, CAST(len(sub) AS INTEGER) n_lines, round(greatest(0.2, least(0.65, list_sum(sk) / len(sk) * 1.25)), 9) floor, sha256(array_to_string((list_transform(sk, lambda x: CAST(x AS VARCHAR)) || list_transform(range(0, 50), lambda x: '-1'))[1:50], ',')) padded,
CAST(list_sum(list_transform(list_zip(ls, keep), lambda x: CASE WHEN x[2] = 1 THEN length(x[1]) ELSE 0 END)) AS BIGINT) packed_chars FROM v""")
def array_subsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views of a sample by line numbers: kept lines and every other one, its least keep ratio, its marks padded."""
    s = samples(spark, sf_dir)
    ix = F.filter(F.transform("keep", lambda v, k: F.when((v == 1) | (k % 2 == 0), k)), lambda k: k.isNotNull())
    s = s.withColumn("ix", ix).select("doc_id", "ls", "keep", A.subset(F.col("ls"), F.col("ix")).alias("sub"), A.subset(F.col("keep"), F.col("ix")).alias("sk"))
    packed = F.aggregate(A.packed(F.col("ls"), F.transform("keep", lambda k: k == 1)), F.lit(0).cast("long"), lambda t, x: t + F.length(x))
    return s.select("doc_id", F.sha2(F.array_join("sub", "\n"), 256).alias("code"), F.size("sub").alias("n_lines"), F.round(A.keep_floor(F.col("sk"), 0.2, 1.25), 9).alias("floor"), F.sha2(F.array_join(A.padded(F.col("sk"), 50, -1), ","), 256).alias("padded"), packed.alias("packed_chars"))


@query(f"""WITH {SAMPLES}, c AS (SELECT *, list_sort(list_distinct(list_filter([9, 2, 2, 4, 400, 6], lambda x: x <= len(ls))))[1:greatest(1, CAST(floor(len(ls) * 0.2 + 1e-9) AS INTEGER))] v FROM S)
SELECT doc_id, array_to_string(v, ',') chosen, array_to_string(list_transform(roles, lambda r, i: CASE WHEN r <> 'CORE' AND list_contains(v, i) THEN 'SUPPORT' ELSE r END), ',') roles FROM c""")
def support_applied(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).withColumn("v", A.support_lines(F.array(*map(F.lit, (9, 2, 2, 4, 400, 6))), F.size("ls")))
    return s.select("doc_id", F.array_join("v", ",").alias("chosen"), F.array_join(A.apply_support(F.col("roles"), F.col("v")), ",").alias("roles"))


@query(f"""WITH {SAMPLES}, o AS (SELECT doc_id, list_transform(ls, lambda x: length(x) + 1) n, list_sum(list_transform(ls, lambda x: length(x) + 1)) // 2 AS off FROM S), e AS (SELECT doc_id, off, len(n) m, list_transform(range(1, len(n) + 1), lambda i: list_sum(n[1:i])) ends FROM o)
SELECT doc_id, CAST(least(len(list_filter(ends, lambda x: x <= off)), m - 1) AS INTEGER) line FROM e""")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line that holds the character in the middle of a text."""
    s = samples(spark, sf_dir).select("doc_id", F.transform("ls", F.length).alias("n"))
    total = F.aggregate("n", F.lit(0), lambda a, x: a + x + 1)
    return s.select("doc_id", A.line_at(F.col("n"), F.floor(total / 2).cast("int")).alias("line"))


BLOCKS = """B AS (SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(start + w - 1 AS INTEGER) stop, CASE start % 3 WHEN 0 THEN 'CORE' WHEN 1 THEN 'SUPPORT' ELSE 'DROP' END role, round(0.7 + (start % 4) / 20.0, 4)::DOUBLE confidence
FROM (SELECT doc_id, unnest(range(1, n + 1, 20)) AS start, 12 w FROM N UNION ALL SELECT doc_id, unnest(range(3, n + 1, 7)), 4 FROM N))"""


def _blocks(n: DataFrame) -> DataFrame:
    def family(first: int, step: int, width: int) -> DataFrame:
        starts = F.when(F.col("n") >= first, F.sequence(F.lit(first), F.col("n"), F.lit(step))).otherwise(F.array().cast("array<int>"))
        return n.select("doc_id", F.explode(starts).alias("start")).withColumn("stop", F.col("start") + width - 1)
    both = family(1, 20, 12).unionAll(family(3, 7, 4))
    role = F.when(F.col("start") % 3 == 0, "CORE").when(F.col("start") % 3 == 1, "SUPPORT").otherwise("DROP")
    return both.select("doc_id", "start", "stop", role.alias("role"), F.round(0.7 + (F.col("start") % 4) / 20.0, 4).alias("confidence"))


@query(f"""WITH {LINES}, N AS (SELECT doc_id, max(line) n FROM lines GROUP BY doc_id), {BLOCKS},
J AS (SELECT l.doc_id, l.line, b.role, b.confidence, row_number() OVER (PARTITION BY l.doc_id, l.line ORDER BY CASE b.role WHEN 'CORE' THEN 2 WHEN 'SUPPORT' THEN 1 ELSE 0 END DESC, b.confidence DESC, b.stop - b.start, b.start) r FROM lines l LEFT JOIN B b ON l.doc_id = b.doc_id AND l.line BETWEEN b.start AND b.stop)
SELECT doc_id, CAST(line AS INTEGER) line, coalesce(role, 'DROP') role, coalesce(confidence, 0.7::DOUBLE) confidence FROM J WHERE r = 1""")
def line_best_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = samples(spark, sf_dir).select("doc_id", F.size("ls").alias("n"))
    points = n.select("doc_id", F.explode(F.sequence(F.lit(1), "n")).alias("line"))
    return relations.best_label(points, _blocks(n), ["doc_id"], "line")


@query(f"""WITH {LINES}, N AS (SELECT doc_id, max(line) n FROM lines GROUP BY doc_id), {BLOCKS}
SELECT doc_id, start, stop FROM B b WHERE NOT EXISTS (SELECT 1 FROM B m WHERE m.doc_id = b.doc_id AND m.role = 'CORE' AND m.start >= b.start AND m.stop <= b.stop)""")
def blocks_without_core(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks that hold no CORE block as a whole."""
    blocks = _blocks(samples(spark, sf_dir).select("doc_id", F.size("ls").alias("n")))
    marked = blocks.where("role = 'CORE'").select("doc_id", F.col("start").alias("m_start"), F.col("stop").alias("m_stop"))
    return relations.holding_none(blocks.select("doc_id", "start", "stop"), marked, ["doc_id"])


@query(f"""WITH {LINES}, N AS (SELECT doc_id, max(line) n FROM lines GROUP BY doc_id), U AS (SELECT doc_id, CAST(start AS INTEGER) AS start, CAST(start + 4 AS INTEGER) stop FROM (SELECT doc_id, unnest(range(1, n + 1, 9)) AS start FROM N)),
A AS (SELECT doc_id, CAST(n // 2 + 1 AS INTEGER) a_start, CAST(n // 2 + 2 AS INTEGER) a_stop FROM N),
J AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY gap, start) r FROM (SELECT A.doc_id, a_start, a_stop, start, stop, least(abs(stop - a_start), abs(start - a_stop)) gap FROM A JOIN U USING (doc_id)))
SELECT doc_id, a_start, a_stop, start, stop, gap FROM J WHERE r = 1""")
def nearest_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = samples(spark, sf_dir).select("doc_id", F.size("ls").alias("n"))
    units = n.select("doc_id", F.explode(F.sequence(F.lit(1), F.col("n"), F.lit(9))).alias("start")).withColumn("stop", F.col("start") + 4)
    mid = F.floor(F.col("n") / 2).cast("int")
    return relations.nearest_unit(n.select("doc_id", (mid + 1).alias("a_start"), (mid + 2).alias("a_stop")), units, ["doc_id"])


@query("""WITH RECURSIVE t AS (SELECT p_partkey AS node, p_partkey // 3 AS to FROM part WHERE p_partkey >= 3 UNION ALL SELECT t.node, t.to // 3 FROM t JOIN part p ON p.p_partkey = t.to WHERE p.p_size % 5 <> 0 AND t.to >= 3)
SELECT node, t.to AS header FROM t JOIN part p ON p.p_partkey = t.to WHERE p.p_size % 5 = 0""")
def nearest_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as a tree of blocks; those of some sizes have a header."""
    p = F.col("p_partkey")
    return relations.nearest_header(read(spark, sf_dir, "part").select(p.alias("node"), F.when(p >= 3, F.floor(p / 3)).alias("parent"), (F.col("p_size") % 5 == 0).alias("is_header")))


@query(r"""WITH n AS (SELECT p_brand AS file, p_partkey AS block, p_size, unnest(list_distinct(string_split(p_name, ' '))) w FROM part), imp AS (SELECT DISTINCT u.block AS source, d.block AS target, 'IMPORT' relation FROM n u JOIN n d ON u.file = d.file AND u.w = d.w WHERE u.p_size > 25 AND d.p_size <= 3),
sym AS (SELECT p_type || '/' || p_size AS name, any_value(p_partkey) AS target FROM part GROUP BY 1 HAVING count(*) = 1), cal AS (SELECT DISTINCT p.p_partkey AS source, s.target FROM part p JOIN sym s ON s.name = p.p_type || '/' || (p.p_size % 50 + 1)),
e AS (SELECT * FROM imp UNION SELECT source, target, 'CALL' FROM cal UNION SELECT target, source, 'CALLED_BY' FROM cal UNION SELECT p_partkey, p_partkey // 3, 'DECORATOR' FROM part WHERE p_partkey >= 3 AND p_size % 7 = 0)
SELECT source, target, relation, CAST(CASE relation WHEN 'CALL' THEN 0.72 WHEN 'CALLED_BY' THEN 0.68 ELSE 0.78 END AS DOUBLE) confidence FROM e WHERE source <> target""")
def code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations of parts as blocks: shared names in a file, names that one has alone, and parents."""
    return _code_edges(spark, sf_dir)


def _code_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    names = part.select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("block"), "p_size", F.split("p_name", " ").alias("names"))
    symbol = lambda size: F.concat_ws("/", "p_type", size.cast("string"))
    calls = relations.unique_name_edges(part.select(F.col("p_partkey").alias("source"), symbol(F.col("p_size") % 50 + 1).alias("name")), part.select(symbol(F.col("p_size")).alias("name"), F.col("p_partkey").alias("target")))
    up = part.where("p_partkey >= 3 and p_size % 7 = 0").select(F.col("p_partkey").alias("source"), F.floor(F.col("p_partkey") / 3).alias("target"))
    return relations.edges({"IMPORT": relations.shared_names(names.where("p_size > 25"), names.where("p_size <= 3")), "CALL": calls, "CALLED_BY": calls.select(F.col("target").alias("source"), F.col("source").alias("target")), "DECORATOR": up}, once=("IMPORT",))


EDGES = "E AS (SELECT p_partkey AS source, p_partkey // 3 AS target, 'DECORATOR' relation, 0.78::DOUBLE confidence FROM part WHERE p_partkey >= 3 UNION ALL SELECT p_partkey, p_partkey // 2, 'CALL', 0.72 FROM part WHERE p_partkey >= 2)"


def _tree_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("source"))
    edge = lambda by: p.where(F.col("source") >= by).select("source", F.floor(F.col("source") / by).alias("target"))
    return relations.edges({"DECORATOR": edge(3), "CALL": edge(2)})


@query(f"""WITH {EDGES}, C AS (SELECT p_partkey AS block FROM part WHERE p_size >= 45), F AS (SELECT block FROM C UNION SELECT p_partkey FROM part WHERE p_size = 1),
O AS (SELECT target AS block, relation, confidence, 1 away FROM E WHERE source IN (SELECT block FROM F) UNION ALL SELECT source, relation, confidence, 0 FROM E WHERE target IN (SELECT block FROM F)),
R AS (SELECT *, row_number() OVER (PARTITION BY block ORDER BY away DESC, confidence DESC, relation) r FROM O WHERE block NOT IN (SELECT block FROM C)) SELECT block, relation, confidence FROM R WHERE r = 1""")
def support_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").withColumnRenamed("p_partkey", "block")
    return relations.support_labels(_tree_edges(spark, sf_dir), part.where("p_size >= 45"), part.where("p_size = 1"))


NEGATIVES = r"""A AS (SELECT p_brand, p_partkey AS anchor, p_name an, p_type aty FROM part WHERE p_size = 7), C AS (SELECT anchor, p_partkey AS block, an, p_name bn, aty, p_type bty FROM A JOIN part USING (p_brand) WHERE p_partkey <> anchor),
U AS (SELECT * FROM C WHERE NOT EXISTS (SELECT 1 FROM E WHERE (source = anchor AND target = block) OR (target = anchor AND source = block))),
W AS (SELECT *, list_distinct(string_split_regex(lower(an), '[_\W]+')) x, list_distinct(string_split_regex(lower(bn), '[_\W]+')) y, list_distinct(string_split_regex(lower(aty), '[_\W]+')) z FROM U),
V AS (SELECT *, aty = bty same_class, len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) nm, len(list_intersect(z, y)) / len(list_distinct(list_concat(z, y))) iss FROM W),
T AS (SELECT *, CASE WHEN same_class THEN 'same_class_other_method' WHEN nm >= 0.5 OR nm >= 0.3 THEN 'similar_name_no_relation' WHEN iss >= 0.2 THEN 'issue_keyword_match_no_relation' WHEN block % 2 = 0 THEN 'same_file_other_branch' END negative_type FROM V)"""


@query(f"""WITH {EDGES}, {NEGATIVES} SELECT anchor, block, negative_type, round(greatest(nm, iss), 4) similarity, CAST(row_number() OVER (PARTITION BY anchor ORDER BY CAST(block % 2 = 0 AS INTEGER) DESC, CAST(same_class AS INTEGER) DESC, round(greatest(nm, iss), 4) DESC, block) AS INTEGER) rank FROM T WHERE negative_type IS NOT NULL QUALIFY rank <= 20""")
def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of an anchor's brand that no edge joins to it, by why they are near; the 20 first of each anchor."""
    part = read(spark, sf_dir, "part")
    a = part.where("p_size = 7").select("p_brand", F.col("p_partkey").alias("anchor"), T.name_words(F.col("p_name")).alias("an"), T.name_words(F.col("p_type")).alias("aw"), F.col("p_type").alias("at"))
    b = part.select("p_brand", F.col("p_partkey").alias("block"), T.name_words(F.col("p_name")).alias("bn"), F.col("p_type").alias("bt"), (F.col("p_partkey") % 2 == 0).alias("same_file"))
    names, issue, same = T.jaccard(F.col("an"), F.col("bn")), T.jaccard(F.col("aw"), F.col("bn")), F.col("at") == F.col("bt")
    scores = {"same_file": F.col("same_file"), "same_class": same, "similarity": F.round(F.greatest(names, issue), 4), "negative_type": relations.negative_type(same, names, names, issue, F.col("same_file"))}
    return mining.mined_by_profile(a, b, ["p_brand"], ["bn", "bt", "same_file"], scores, _tree_edges(spark, sf_dir), 20)


@query(f"""WITH {EDGES}, C AS (SELECT p_brand AS task, p_partkey AS block FROM part WHERE p_size >= 48), M AS (SELECT DISTINCT p_brand AS task, p_brand || '/' || p_size AS sample_id FROM part WHERE p_size <= 3),
R AS (SELECT DISTINCT task, source, target, relation FROM E JOIN C ON source = block OR target = block) SELECT task, sample_id, count(*) relations FROM R JOIN M USING (task) GROUP BY 1, 2""")
def core_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part").withColumnRenamed("p_brand", "task")
    marks = part.where("p_size <= 3").select("task", F.concat_ws("/", "task", "p_size").alias("sample_id")).distinct()
    rows = relations.core_relations(_tree_edges(spark, sf_dir), part.where("p_size >= 48").select("task", F.col("p_partkey").alias("block")), marks)
    return rows.groupBy("task", "sample_id").agg(F.count("*").alias("relations"))


@query("""WITH k AS (SELECT 'lib/' || p_brand || '/' || p_size || '.py' AS file FROM part GROUP BY 1), w AS (SELECT DISTINCT p_size || '.py' AS path FROM part UNION SELECT 'repo/' || file FROM k UNION SELECT split_part(file, 'lib/', 2) FROM k UNION SELECT 'none.py' UNION SELECT 'lib/Brand#11/1.py'),
h AS (SELECT path, file FROM w JOIN k ON file = path OR ends_with(file, '/' || path) OR ends_with(path, '/' || file)), o AS (SELECT path, CASE WHEN max(CAST(file = path AS INTEGER)) = 1 THEN path WHEN count(*) = 1 THEN min(file) END AS file FROM h GROUP BY path)
SELECT path, o.file FROM w LEFT JOIN o USING (path)""")
def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    known = part.select(F.concat(F.lit("lib/"), "p_brand", F.lit("/"), "p_size", F.lit(".py")).alias("file")).distinct()
    more = spark.createDataFrame([("none.py",), ("lib/Brand#11/1.py",)], "path string")
    wanted = part.select(F.concat("p_size", F.lit(".py")).alias("path")).unionAll(known.select(F.concat(F.lit("repo/"), "file"))).unionAll(known.select(F.regexp_replace("file", "^lib/", ""))).unionAll(more).distinct()
    return relations.resolve_paths(wanted, known)


@query(f"""WITH {LINES}, e AS (SELECT doc_id AS file, line + doc_id % 2 AS line, trim(text) t FROM lines), s AS (SELECT doc_id AS file, line spot, trim(text) t FROM lines),
o AS (SELECT file, t, count(*) m, min(spot) AS only FROM s GROUP BY 1, 2), r AS (SELECT e.file, e.line, CASE WHEN EXISTS (SELECT 1 FROM s WHERE s.file = e.file AND s.t = e.t AND s.spot = e.line) THEN e.line WHEN m = 1 THEN o.only END AS found FROM e LEFT JOIN o ON e.file = o.file AND e.t = o.t)
SELECT file, CAST(line AS INTEGER) line, CAST(found AS INTEGER) AS found FROM r""")
def reanchored_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every line as evidence, in every other document a line too late, set to where its text stands."""
    lines = samples(spark, sf_dir).select(F.col("doc_id").alias("file"), F.posexplode("ls").alias("pos", "text")).select("file", (F.col("pos") + 1).alias("line"), "text")
    late = lines.withColumn("line", (F.col("line") + F.col("file") % 2).cast("int"))
    return relations.reanchor(late, lines).select("file", "line", F.col("at").alias("found"))


FRAGMENTS = r"""f AS (SELECT DISTINCT item_id, fragment FROM (SELECT item_id, trim(regexp_replace(unnest(string_split(text, '.')), '[\s]+', ' ', 'g')) fragment FROM benchmark) WHERE length(fragment) >= 12),
d AS (SELECT doc_id, trim(regexp_replace(text, '[\s]+', ' ', 'g')) t, text FROM documents)"""


@query(f"""WITH {FRAGMENTS}, h AS (SELECT DISTINCT doc_id, fragment FROM d JOIN (SELECT DISTINCT fragment FROM f) ON contains(t, fragment)) SELECT doc_id, count(*) fragments FROM h GROUP BY doc_id""")
def contained_fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = relations.contained_fragments(_norm(spark, sf_dir), _fragments(spark, sf_dir))
    return hits.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("fragments"))


def _norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), T.normalize_fragment(F.col("text")).alias("text"))


def _fragments(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = read(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"\.", -1)).alias("x"))
    return parts.select(T.normalize_fragment(F.col("x")).alias("fragment")).where(F.length("fragment") >= 12).distinct()


@query(rf"""WITH {LINES}, g AS (SELECT DISTINCT sha256(t) h FROM (SELECT trim(regexp_replace(unnest(string_split_regex(text, '\r\n|[\n\r\x0b\x0c\x1c\x1d\x1e\x{{85}}\x{{2028}}\x{{2029}}]')), '[\s]+', ' ', 'g')) t FROM benchmark) WHERE length(t) >= 12)
SELECT doc_id, CAST(line AS INTEGER) line FROM (SELECT doc_id, line, trim(regexp_replace(text, '[\s]+', ' ', 'g')) t FROM lines) WHERE length(t) >= 12 AND sha256(t) IN (SELECT h FROM g)""")
def forbidden_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that are, normalised, a line of the benchmark."""
    lines = samples(spark, sf_dir).select("doc_id", F.posexplode("ls").alias("pos", "text")).select("doc_id", (F.col("pos") + 1).alias("line"), "text")
    return checks.forbidden_lines(lines, read(spark, sf_dir, "benchmark").select(F.explode(T.splitlines(F.col("text"))).alias("text")))


@query(rf"""WITH {FRAGMENTS}, {SAMPLES}, q AS (SELECT DISTINCT fragment FROM f), i AS (SELECT doc_id, array_to_string(ls[1:3], chr(10)) issue, ls[4:] code FROM S),
h AS (SELECT DISTINCT doc_id FROM i JOIN q ON contains(trim(regexp_replace(issue, '[\s]+', ' ', 'g')), fragment)), c AS (SELECT DISTINCT doc_id FROM (SELECT doc_id, trim(regexp_replace(unnest(code), '[\s]+', ' ', 'g')) t FROM i) JOIN q ON t = fragment)
SELECT doc_id, doc_id IN (SELECT doc_id FROM h) in_issue, doc_id IN (SELECT doc_id FROM c) in_code, CASE WHEN doc_id IN (SELECT doc_id FROM h) OR doc_id IN (SELECT doc_id FROM c) THEN 'high' WHEN regexp_matches(issue, '(?i)\b(change|replace|edit|modify)\b.{{0,40}}\b(to|with)\b|把.{{0,30}}(改成|替换为)|第\s*\d+\s*行') THEN 'medium' ELSE 'low' END risk FROM i""")
def leak_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's first three lines as an issue, the others as code, against the benchmark's sentences."""
    s, parts = samples(spark, sf_dir).select(F.col("doc_id").alias("id"), F.array_join(F.slice("ls", 1, 3), "\n").alias("issue"), F.slice("ls", F.lit(4), F.size("ls")).alias("code")), _fragments(spark, sf_dir)
    told = relations.contained_fragments(s.select("id", T.normalize_fragment(F.col("issue")).alias("text")), parts).select("id").distinct().withColumn("in_issue", F.lit(True))
    coded = relations.contained_lines(s.select("id", F.explode("code").alias("text")), parts).withColumn("in_code", F.lit(True))
    rows = s.select("id", "issue").join(told, "id", "left").join(coded, "id", "left").withColumns({c: F.coalesce(c, F.lit(False)) for c in ("in_issue", "in_code")})
    return checks.leak_risk(rows).select(F.col("id").alias("doc_id"), "in_issue", "in_code", "risk")


TASKS = """T AS (SELECT o_orderkey task_id, CASE WHEN o_orderkey % 11 <> 0 THEN 'repo' || o_custkey % 50 END repo_path, 'repo' || o_custkey % 50 repo_name, CASE o_orderstatus WHEN 'F' THEN 'fix ' || o_orderkey WHEN 'O' THEN ' ' END issue_text, CASE WHEN o_orderkey % 7 <> 0 THEN 'diff' END patch, CASE WHEN o_orderpriority LIKE '1%' THEN 'File' END traceback FROM orders),
K AS (SELECT *, CASE WHEN repo_path IS NULL THEN 'no repository' WHEN patch IS NULL THEN 'no patch' END error FROM T)"""


def _tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from loam.sources.files import TASK, load_tasks

    o, key = read(spark, sf_dir, "orders"), F.col("o_orderkey")
    name = F.concat(F.lit("repo"), F.col("o_custkey") % 50)
    given = {"id": key.cast("string"), "checkout_path": F.when(key % 11 != 0, name), "repo": name, "problem_statement": F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("fix "), key)).when(F.col("o_orderstatus") == "O", " "), "gold_patch": F.when(key % 7 != 0, "diff"), "trace": F.when(F.col("o_orderpriority").startswith("1"), "File")}
    fields = [x.split()[0] for x in TASK.split(", ")]
    return load_tasks(o.select(*[given.get(f, F.lit(None).cast("string")).alias(f) for f in fields]))


@query(f"""WITH {TASKS} SELECT count(*) FILTER (WHERE error IS NULL) valid, count(*) FILTER (WHERE error IS NOT NULL) invalid, count(DISTINCT CASE WHEN error IS NULL THEN repo_name END) repositories, count(*) FILTER (WHERE trim(coalesce(issue_text, '')) <> '') with_issue, count(*) FILTER (WHERE traceback IS NOT NULL) with_traceback FROM K""")
def task_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.profile(_tasks(spark, sf_dir))


@query(f"""WITH {TASKS} SELECT coalesce(CASE WHEN repo_name IN ('repo3', 'repo4') THEN 'blacklisted' ELSE error END, 'ok') outcome, count(*) n, CAST(sum(task_id) AS BIGINT) ids FROM K GROUP BY 1""")
def routed_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks by what becomes of them: excluded by name, unusable for a reason, or kept."""
    names = spark.createDataFrame([("repo3",), ("repo4",)], "name string")
    kept, out = records.excluded(_tasks(spark, sf_dir), names, "repo_name", "blacklisted")
    rows = kept.select("task_id", "error").unionByName(out.select("task_id", "error"))
    return rows.groupBy(F.coalesce("error", F.lit("ok")).alias("outcome")).agg(F.count("*").alias("n"), F.sum(F.col("task_id").cast("long")).alias("ids"))


@query("""SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM orders d WHERE d.o_orderkey = o.o_orderkey AND d.o_orderstatus = 'F' AND substr(sha256(CASE WHEN d.o_orderkey % 3 = 0 THEN 'v1' ELSE 'v2' END || chr(0) || d.o_orderpriority), 1, 24) = substr(sha256('v2' || chr(0) || o.o_orderpriority), 1, 24))""")
def pending_tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders whose finished state isn't there or was made under an earlier setting."""
    o = read(spark, sf_dir, "orders")
    mark = lambda v: T.stable_hash(v, F.col("o_orderpriority")).alias("fingerprint")
    done = o.where("o_orderstatus = 'F'").select("o_orderkey", mark(F.when(F.col("o_orderkey") % 3 == 0, "v1").otherwise("v2")))
    return records.pending(o.select("o_orderkey", mark(F.lit("v2"))), done, "o_orderkey", "fingerprint").select("o_orderkey")


@query("""SELECT user_id, arg_max(event_type, event_id) event_type, round(arg_max(value, event_id), 6) AS value, max(event_id) event_id FROM events GROUP BY user_id""")
def cache_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cache after all its entries were put in, the later half over the earlier."""
    e = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", F.round("value", 6).alias("value"))
    old, new = e.where("event_id % 2 = 0"), e.where("event_id % 2 = 1")
    first = records.upsert(old, old, "user_id", ["event_type", "value"], "event_id")
    later = records.upsert(new, new, "user_id", ["event_type", "value"], "event_id")
    return records.latest(first.unionByName(later), "user_id", [F.col("event_id")], ["event_type", "value", "event_id"])


@query("""SELECT user_id, arg_min(event_id, event_id) event_id, arg_min(event_type, event_id) event_type FROM events WHERE event_type <> 'error' GROUP BY user_id""")
def cache_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.answered(read(spark, sf_dir, "events"), "user_id", F.col("event_type") != "error", "event_id", ["event_id", "event_type"])


@query("""SELECT count(*) requests, count(*) FILTER (WHERE event_type = 'error') errors, CAST(coalesce(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) FILTER (WHERE event_type <> 'error'), 0) AS BIGINT) tokens FROM events""")
def cache_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").withColumn("k", F.get_json_object("props", "$.k").cast("long"))
    return records.cache_stats(e, F.col("event_type") != "error", "k")


@query(r"""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) k, regexp_extract('answer: ' || props || ' end', '(?s)\{.*\}', 0) inner_json,
(event_type IN ('view', 'click') AND value BETWEEN 0 AND 1) valid FROM events""")
def parsed_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewers' answers: JSON in a code fence, JSON within text, and whether a decision is well formed."""
    e = read(spark, sf_dir, "events")
    k = F.from_json(T.fenced_json(F.concat(F.lit("```json\n"), "props", F.lit("\n```"))), "k long")["k"]
    d = F.struct(F.col("event_id").alias("block_id"), F.when(F.col("event_type") == "view", "SUPPORT").when(F.col("event_type") == "click", "DROP").otherwise("CORE").alias("role"), F.lit("CALL").alias("relation"), F.col("value").alias("confidence"))
    return e.select("event_id", k.alias("k"), T.braces(F.concat(F.lit("answer: "), "props", F.lit(" end"))).alias("inner_json"), T.valid_decision(d, F.col("event_id")).alias("valid"))


REVIEWS = """V AS (SELECT l_orderkey, l_linenumber, CASE l_returnflag WHEN 'R' THEN 'SUPPORT' ELSE 'DROP' END role, 0.7::DOUBLE confidence, CASE WHEN l_linestatus = 'O' THEN 'SUPPORT' ELSE 'DROP' END first_role, round(l_discount * 10, 4) first_confidence, CASE WHEN l_linenumber % 2 = 0 THEN 'SUPPORT' ELSE 'DROP' END second_role FROM lineitem)"""


@query(f"""WITH {REVIEWS}, d AS (SELECT CASE WHEN first_confidence >= 0.85 OR (first_confidence >= 0.45 AND first_role = second_role) THEN first_role ELSE role END new_role,
round(CASE WHEN first_confidence >= 0.85 THEN first_confidence WHEN first_confidence < 0.45 THEN 0.6 WHEN first_role = second_role THEN 0.82 ELSE 0.55 END, 4) new_confidence, CASE WHEN first_confidence < 0.85 THEN first_confidence >= 0.45 AND first_role = second_role END agreement FROM V)
SELECT new_role, new_confidence, agreement, count(*) n FROM d GROUP BY ALL""")
def adjudicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")
    rows = l.select(F.when(F.col("l_returnflag") == "R", "SUPPORT").otherwise("DROP").alias("role"), F.lit(0.7).alias("confidence"), F.when(F.col("l_linestatus") == "O", "SUPPORT").otherwise("DROP").alias("first_role"), F.round(F.col("l_discount") * 10, 4).alias("first_confidence"), F.when(F.col("l_linenumber") % 2 == 0, "SUPPORT").otherwise("DROP").alias("second_role"))
    return records.adjudicated(rows).groupBy("new_role", F.round("new_confidence", 4).alias("new_confidence"), "agreement").agg(F.count("*").alias("n"))


@query("""WITH b AS (SELECT l_orderkey, l_linenumber, round(l_discount * 10, 4) confidence, CASE l_returnflag WHEN 'R' THEN 'SUPPORT' WHEN 'A' THEN 'CORE' ELSE 'DROP' END role, l_linenumber % 2 = 0 hard_negative FROM lineitem)
SELECT l_orderkey, l_linenumber, confidence, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY confidence, l_linenumber) AS INTEGER) rank FROM b WHERE role <> 'CORE' AND confidence < 0.8 AND (role = 'SUPPORT' OR hard_negative) QUALIFY rank <= 2""")
def review_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two least certain open lines of each order."""
    role = F.when(F.col("l_returnflag") == "R", "SUPPORT").when(F.col("l_returnflag") == "A", "CORE").otherwise("DROP")
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(F.col("l_discount") * 10, 4).alias("confidence"), role.alias("role"), (F.col("l_linenumber") % 2 == 0).alias("hard_negative"))
    return records.review_candidates(rows, "l_orderkey", "confidence", 0.8, 2, F.col("l_linenumber")).select("l_orderkey", "l_linenumber", "confidence", "rank")


OFFICIAL = f"""Q AS (SELECT doc_id, {sql_lines("text")} ls, doc_id % 5 = 0 neg, split_part(text, ' ', 1) q FROM documents), P AS (SELECT *, CASE WHEN doc_id % 10 = 0 THEN [] ELSE list_filter(range(1, len(ls) + 1 + CAST(doc_id % 13 = 0 AS INTEGER)), lambda i: i > len(ls) OR length(ls[i]) % 3 = 0) END kept FROM Q),
X AS (SELECT *, CASE WHEN trim(q) = '' THEN 'query' WHEN len(ls) < 1 THEN 'code' WHEN neg AND len(kept) > 0 THEN 'negative_with_lines' WHEN NOT neg AND len(kept) = 0 THEN 'positive_without_lines' WHEN len(list_filter(kept, lambda k: k < 1 OR k > len(ls))) > 0 THEN 'line_numbers' END error FROM P)"""


def _official(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = read(spark, sf_dir, "documents").withColumn("lines", T.splitlines(F.col("text")))
    beyond = F.when(F.col("doc_id") % 13 == 0, F.array(F.size("lines") + 1)).otherwise(F.array().cast("array<int>"))
    kept = F.concat(A.kept_numbers(F.transform("lines", lambda x: (F.length(x) % 3 == 0).cast("int"))), beyond)
    rows = d.select("doc_id", F.split_part("text", F.lit(" "), F.lit(1)).alias("query"), "lines", F.when(F.col("doc_id") % 10 == 0, F.array().cast("array<int>")).otherwise(kept).alias("kept"), (F.col("doc_id") % 5 == 0).alias("is_negative"))
    return records.labelled_rows(rows)


@query(f"""WITH {OFFICIAL} SELECT doc_id, error, CASE WHEN error IS NULL THEN array_to_string(list_transform(ls, lambda x, i: CASE WHEN list_contains(kept, i) THEN 'SUPPORT' ELSE 'DROP' END), ',') END roles, CASE WHEN neg THEN 0 ELSE 1 END document_label, CAST(greatest(1, length(array_to_string(ls, chr(10))) // 4) AS INTEGER) tokens FROM X""")
def official_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of kept line numbers as per-line arrays; those that can't be used with the reason."""
    return _official(spark, sf_dir).select("doc_id", "error", F.when(F.col("error").isNull(), F.array_join("roles", ",")).alias("roles"), "document_label", "tokens")


@query(f"""WITH {OFFICIAL} SELECT doc_id FROM X WHERE error IS NULL ORDER BY doc_id LIMIT 200""")
def accepted_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A limit that counts usable rows only: the first 200."""
    return records.accepted(_official(spark, sf_dir), "doc_id", 200).select("doc_id")


@query(f"""WITH {SAMPLES}, C AS (SELECT doc_id, ls, roles, CAST(round_even((len(ls) + 1) / 2.0, 0) AS INTEGER) mid, CAST(ceil(len(ls) / 3.0) AS INTEGER) third FROM S WHERE list_contains(roles, 'DROP') AND len(list_filter(roles, lambda r: r = 'CORE')) >= 2)
SELECT doc_id, mid, third FROM C""")
def role_mixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = samples(spark, sf_dir).where(checks.role_mix(F.col("roles"), 2))
    return s.select("doc_id", F.bround((F.size("ls") + 1) / 2.0, 0).cast("int").alias("mid"), F.ceil(F.size("ls") / 3.0).cast("int").alias("third"))


@query(f"""WITH {SAMPLES}, f AS (SELECT source, doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY len(ls), doc_id) AS INTEGER) variant FROM S WHERE list_contains(roles, 'DROP') AND list_contains(roles, 'CORE') AND len(ls) <= 240 AND list_sum(list_transform(ls, lambda x: length(x))) <= 30000) SELECT * FROM f WHERE variant <= 4""")
def sample_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples within the budget and of mixed roles, the first four of each task (a source)."""
    s = samples(spark, sf_dir).where(checks.role_mix(F.col("roles")) & (F.size("ls") <= 240) & (F.aggregate("ls", F.lit(0), lambda a, x: a + F.length(x)) <= 30000))
    w = Window.partitionBy("source").orderBy(F.size("ls"), "doc_id")
    return s.select("source", "doc_id", F.row_number().over(w).alias("variant")).where("variant <= 4")


STRATEGY = f"""WITH {SAMPLES}, L AS (SELECT doc_id, ls[1] q, CAST(unnest(range(0, len(ls))) AS INTEGER) i, unnest(ls) x, unnest(keep) = 1 k, len(ls) n FROM S),
D AS (SELECT *, least(i - max(CASE WHEN k THEN i END) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING), min(CASE WHEN k THEN i END) OVER (PARTITION BY doc_id ORDER BY i DESC ROWS UNBOUNDED PRECEDING) - i) near, count(*) FILTER (WHERE k) OVER (PARTITION BY doc_id) pos FROM L),
H AS (SELECT *, coalesce(near, abs(i - n // 2)) dist, sha256('42' || chr(31) || doc_id || chr(31) || s || chr(31) || i) h, len(list_intersect(list_distinct(list_transform(regexp_extract_all(q, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda t: lower(t))), list_distinct(list_transform(regexp_extract_all(x, '[A-Za-z_][A-Za-z0-9_]{{2,}}'), lambda t: lower(t))))) lex FROM D, (VALUES ('local'), ('lexical'), ('mixed'), ('wide')) v(s)),
R AS (SELECT *, row_number() OVER (PARTITION BY s, doc_id ORDER BY k DESC, CASE WHEN k THEN 0 WHEN s = 'lexical' THEN -lex WHEN s = 'mixed' THEN CAST('0x' || substr(h, 1, 8) AS BIGINT) % 3 WHEN s = 'wide' THEN dist // 3 ELSE 0 END, CASE WHEN s = 'wide' THEN 0 ELSE dist END, h, i) r FROM H)
SELECT s strategy, doc_id, CAST(count(*) AS INTEGER) n_lines, sha256(string_agg(CAST(i AS VARCHAR), ',' ORDER BY i)) chosen FROM R WHERE k OR r <= greatest(pos, CASE WHEN pos < n AND ceil(n * 0.4) >= n THEN n - 1 ELSE ceil(n * 0.4) END) GROUP BY 1, 2"""


@query(STRATEGY)
def context_strategies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four ways to choose a view's other lines: near kept ones, by the query's words, mixed, and wide."""
    s = samples(spark, sf_dir)
    rows = s.select("doc_id", T.query_tokens(F.get("ls", F.lit(0))).alias("q"), F.size("ls").alias("n"), F.posexplode(F.arrays_zip("ls", "keep")).alias("i", "v"))
    rows = rows.select("doc_id", "q", "n", "i", F.col("v.ls").alias("x"), (F.col("v.keep") == 1).alias("k"))
    return sampling.strategy_views(rows, 42, 0.4).groupBy("strategy", "doc_id").agg(F.count("*").cast("int").alias("n_lines"), F.sha2(F.array_join(F.array_sort(F.collect_list("i")), ","), 256).alias("chosen"))


@query("""WITH p AS (SELECT source, lang || '/' || doc_id AS path, coalesce(toxic, 0) = 1 patch, lang FROM documents LEFT JOIN labels USING (doc_id)), g AS (SELECT *, count(*) OVER (PARTITION BY source) pool, count(*) FILTER (WHERE patch) OVER (PARTITION BY source) np,
row_number() OVER (PARTITION BY source, patch ORDER BY substr(sha256('42' || chr(0) || source || chr(0) || path), 1, 24), path) r, max(CAST(patch AS INTEGER)) OVER (PARTITION BY source, lang) samedir FROM p),
s AS (SELECT *, count(*) OVER (PARTITION BY source) m FROM g WHERE pool >= 4 AND np > 0 AND (patch OR r <= 40 - np)), t AS (SELECT *, greatest(np, CAST(floor(0.30 * m + 0.999 + 1e-9) AS INTEGER)) - np want, row_number() OVER (PARTITION BY source, patch ORDER BY samedir DESC, path DESC) k FROM s)
SELECT source, path, CASE WHEN patch THEN 'CORE' WHEN k <= want THEN 'SUPPORT' ELSE 'DROP' END role, CAST(CASE WHEN patch THEN 1.0 WHEN k <= want THEN 0.7 ELSE 0.85 END AS DOUBLE) confidence FROM t""")
def file_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A source's documents as files, the toxic ones as those of a patch, with others up to 40 and the likeliest of these."""
    files = read(spark, sf_dir, "documents").join(read(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return sampling.file_listing(files.select("source", F.concat_ws("/", "lang", "doc_id").alias("path"), (F.coalesce("toxic", F.lit(0)) == 1).alias("patch"), F.col("lang").alias("dir")), "source", 42)


@query(f"""WITH {SAMPLES}, c AS (SELECT source, min(doc_id) doc_id FROM S WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) GROUP BY source), w AS (SELECT source, doc_id, ls[1:20] w FROM S JOIN c USING (source, doc_id))
SELECT source, doc_id, CAST(list_max(list_transform(w, lambda x, i: CASE WHEN trim(x) <> '' THEN i ELSE 0 END)) AS INTEGER) n_lines, 0 document_label, 0.9::DOUBLE confidence FROM w""")
def document_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first document of each source that isn't marked, cut to 20 lines, as one that keeps nothing."""
    s = samples(spark, sf_dir).select("source", "doc_id", "ls").join(read(spark, sf_dir, "labels").where("toxic = 1").select("doc_id"), "doc_id", "left_anti")
    first = s.groupBy("source").agg(F.min_by(F.struct("doc_id", F.slice("ls", 1, 20).alias("w")), "doc_id").alias("v")).select("source", "v.doc_id", "v.w")
    return first.select("source", "doc_id", F.size(A.without_blank_end(F.col("w"), strip=True)).alias("n_lines"), F.lit(0).alias("document_label"), F.lit(0.9).alias("confidence"))


@query(f"""WITH {SAMPLES}, r AS (SELECT doc_id, ls, roles, row_number() OVER (ORDER BY substr(sha256('42' || chr(0) || doc_id), 1, 24), doc_id) k FROM S)
SELECT doc_id, sha256(array_to_string(list_transform(ls, lambda x, i: lpad(CAST(i AS VARCHAR), 5, ' ') || ' ' || rpad(roles[i], 7, ' ') || ' ' || x), chr(10))) page FROM r WHERE k <= 25""")
def review_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 25 samples by hash order, each line with its number and role."""
    s = samples(spark, sf_dir).orderBy(T.stable_hash(F.lit(42), F.col("doc_id")), "doc_id").limit(25)
    line = lambda v, i: F.concat_ws(" ", F.lpad((i + 1).cast("string"), 5, " "), F.rpad(v["roles"], 7, " "), v["ls"])
    return s.select("doc_id", F.sha2(F.array_join(F.transform(F.arrays_zip("ls", "roles"), line), "\n"), 256).alias("page"))


@query("""WITH o AS (SELECT source, min(doc_id) doc_id FROM documents GROUP BY text, source), c AS (SELECT source FROM (SELECT DISTINCT source FROM documents) ORDER BY substr(sha256(source), 1, 24), source LIMIT 5),
t AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY substr(sha256(CAST(doc_id AS VARCHAR)), 1, 24), doc_id) turn FROM documents WHERE source IN (SELECT source FROM c))
SELECT source, doc_id, CAST(turn AS INTEGER) turn FROM t ORDER BY turn, substr(sha256(source), 1, 24), source LIMIT 60""")
def diverse_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sampling operator: 60 documents of five sources by turns."""
    return records.diverse(read(spark, sf_dir, "documents"), "source", "doc_id", 5, 60).select("source", "doc_id", "turn")


@query("""WITH n AS (SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice, o_orderkey) - 1 row, count(*) OVER () n FROM orders)
SELECT o_orderkey, row FROM n WHERE row IN (SELECT CAST(round_even(i * (n - 1) / 31.0, 0) AS BIGINT) FROM range(0, 32) r(i))""")
def spread_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """32 orders evenly apart by price, the cheapest and the dearest among them."""
    return records.spread(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), 32, "o_totalprice", "o_orderkey").select("o_orderkey", "row")


PARITY = ["l_linestatus", "l_quantity", "l_returnflag", "l_shipdate", "l_tax"]


@query(f"""WITH p AS (SELECT coalesce(a.l_orderkey, b.l_orderkey) AS "key", {", ".join(f"a.{c}::VARCHAR a_{c}, b.{c}::VARCHAR b_{c}" for c in PARITY if c in ("l_linestatus", "l_returnflag", "l_shipdate"))}, CAST(a.l_quantity AS BIGINT)::VARCHAR a_l_quantity, CAST(b.l_quantity AS BIGINT)::VARCHAR b_l_quantity, CAST(round(a.l_tax * 100) AS BIGINT)::VARCHAR a_l_tax, CAST(round(b.l_tax * 100) AS BIGINT)::VARCHAR b_l_tax
FROM (SELECT * FROM lineitem WHERE l_linenumber = 1) a FULL JOIN (SELECT * FROM lineitem WHERE l_linenumber = 2) b USING (l_orderkey)) """ + " UNION ALL ".join(f"""SELECT "key" order_key, '{c}' field, a_{c} "left", b_{c} "right" FROM p WHERE a_{c} IS DISTINCT FROM b_{c}""" for c in PARITY))
def config_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two lines of an order as settings: the fields in which they differ, or that one lacks."""
    rows = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.struct("l_linestatus", F.col("l_quantity").cast("long").alias("l_quantity"), "l_returnflag", F.col("l_shipdate").cast("string").alias("l_shipdate"), F.round(F.col("l_tax") * 100).cast("long").alias("l_tax")).alias("v"))
    side = lambda n, name: rows.where(F.col("l_linenumber") == n).select("l_orderkey", F.col("v").alias(name))
    return records.parity(side(1, "left").join(side(2, "right"), "l_orderkey", "full"), "l_orderkey", PARITY).withColumnRenamed("l_orderkey", "order_key")


@query("""WITH b AS (SELECT o_custkey task, o_orderkey block, CASE o_orderstatus WHEN 'F' THEN 'CORE' WHEN 'O' THEN 'SUPPORT' ELSE 'DROP' END role, round(o_totalprice / 600000, 4) confidence, CASE WHEN o_orderstatus = 'P' THEN 'static_default_drop' ELSE 'static' END prov FROM orders),
d AS (SELECT o_custkey task, l_orderkey block, CASE WHEN l_returnflag = 'A' THEN 'DROP' ELSE 'SUPPORT' END nr, round(l_discount * 10, 4) nc, l_shipdate::VARCHAR rel, CASE WHEN l_tax > 0.07 THEN 'timeout' END error, l_linestatus = 'F' two FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = 1 QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY error IS NULL DESC, nc DESC, nr DESC, rel DESC, two DESC) = 1),
r AS (SELECT b.*, d.*, d.block IS NOT NULL asked, CASE role WHEN 'CORE' THEN 2 WHEN 'SUPPORT' THEN 1 ELSE 0 END o, CASE nr WHEN 'SUPPORT' THEN 1 ELSE 0 END w FROM b LEFT JOIN d ON d.task = b.task AND d.block = b.block),
k AS (SELECT *, asked AND error IS NULL AND (w > o OR (nr = role AND nc > confidence)) wins FROM r)
SELECT task, block, CASE WHEN wins THEN nr ELSE role END role, round(CASE WHEN wins THEN nc WHEN asked AND error IS NOT NULL THEN greatest(0, confidence - 0.10) ELSE confidence END, 6) confidence, CASE WHEN wins THEN rel ELSE 'NONE' END relation,
CASE WHEN asked AND error IS NULL THEN CASE WHEN prov = 'static_default_drop' AND nr <> 'DROP' THEN '' ELSE prov || ',' END || 'api_primary:m1' || CASE WHEN two THEN ',api_reviewer:m2' ELSE '' END ELSE prov END provenance FROM k""")
def reviewed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as labelled blocks of a customer, their first lines as a reviewer's decisions, some of them failed."""
    o, l = read(spark, sf_dir, "orders"), read(spark, sf_dir, "lineitem").where("l_linenumber = 1")
    role = F.when(F.col("o_orderstatus") == "F", "CORE").when(F.col("o_orderstatus") == "O", "SUPPORT").otherwise("DROP")
    labels = o.select(F.col("o_custkey").alias("task"), F.col("o_orderkey").alias("block"), role.alias("role"), F.round(F.col("o_totalprice") / 600000, 4).alias("confidence"), F.lit("NONE").alias("relation"), F.array(F.when(F.col("o_orderstatus") == "P", records.DEFAULT).otherwise("static")).alias("provenance"))
    models = F.when(F.col("l_linestatus") == "F", F.array(F.lit("m1"), F.lit("m2"))).otherwise(F.array(F.lit("m1")))
    said = l.join(o, l["l_orderkey"] == o["o_orderkey"]).select(F.col("o_custkey").alias("task"), F.col("l_orderkey").alias("block"), F.when(F.col("l_returnflag") == "A", "DROP").otherwise("SUPPORT").alias("new_role"), F.round(F.col("l_discount") * 10, 4).alias("new_confidence"), F.col("l_shipdate").cast("string").alias("new_relation"), models.alias("models"), F.when(F.col("l_tax") > 0.07, "timeout").alias("error"))
    return records.reviewed(labels, said).select("task", "block", "role", F.round("confidence", 6).alias("confidence"), "relation", F.array_join("provenance", ",").alias("provenance"))


@query("""SELECT doc_id, substr(sha256('[7,' || to_json(lang) || ',' || doc_id || ',' || coalesce(to_json(source)::VARCHAR, 'null') || ']'), 1, 24) h FROM documents""")
def json_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", T.json_hash(F.lit(7), F.col("lang"), F.col("doc_id"), F.col("source")).alias("h"))


@query("""WITH c AS (SELECT source, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END split FROM documents GROUP BY ALL) SELECT source, string_agg(split, ',' ORDER BY split) splits FROM c GROUP BY source HAVING count(*) > 1""")
def split_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "documents").select("source", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split"))
    return checks.set_overlap(rows, "source", "split")


@query("""WITH c AS (SELECT lang, source, CASE WHEN doc_id % 4 = 0 THEN 'test' ELSE 'train' END split, count(*) n FROM documents GROUP BY ALL) SELECT lang, split, count(*) repositories, CAST(sum(n) AS BIGINT) samples, string_agg(source, ',' ORDER BY source) names FROM c GROUP BY lang, split""")
def split_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repositories and samples of each source's language and split."""
    rows = read(spark, sf_dir, "documents").groupBy("lang", "source", F.when(F.col("doc_id") % 4 == 0, "test").otherwise("train").alias("split")).agg(F.count("*").alias("n"))
    return rows.groupBy("lang", "split").agg(F.count("*").alias("repositories"), F.sum("n").alias("samples"), F.array_join(F.array_sort(F.collect_list("source")), ",").alias("names"))


@query("""WITH c AS (SELECT l_returnflag = 'R' t, least(greatest(l_quantity / 51, 1e-6), 1 - 1e-6) p, l_tax w FROM lineitem), s AS (SELECT count(*) FILTER (WHERE NOT t) n0, count(*) FILTER (WHERE t) n1, sum(CASE WHEN t THEN -ln(p) * w END) l1, sum(CASE WHEN NOT t THEN -ln(1 - p) * w END) l0, sum(w) w FROM c),
g AS (SELECT *, least(4.0, (n0 + n1) / (2.0 * greatest(n0, 1)))::DOUBLE weight0, least(4.0, (n0 + n1) / (2.0 * greatest(n1, 1)))::DOUBLE weight1 FROM s) SELECT n0, n1, round(weight0, 9) weight0, round(weight1, 9) weight1, round((l0 * weight0 + l1 * weight1) / greatest(w, 1e-6), 6) loss FROM g""")
def weighted_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 51).alias("p"), (F.col("l_returnflag") == "R").alias("t"), "l_tax")
    return checks.class_weighted_loss(rows, "p", "t", "l_tax", 4.0)


@query("""SELECT l_returnflag, round(sum(greatest(0.0, 0.2 - l_discount * 10 + l_tax * 10) * l_quantity) / sum(l_quantity), 6) ranking, round(avg(CASE WHEN abs(l_discount * 20 - 1) < 1 THEN 0.5 * (l_discount * 20 - 1) ** 2 ELSE abs(l_discount * 20 - 1) - 0.5 END), 6) score FROM lineitem GROUP BY 1""")
def ranking_losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = read(spark, sf_dir, "lineitem")
    h, s = checks.hinge(F.col("l_discount") * 10, F.col("l_tax") * 10, 0.2), checks.smooth_l1(F.col("l_discount") * 20 - 1)
    return l.groupBy("l_returnflag").agg(F.round(F.sum(h * F.col("l_quantity")) / F.sum("l_quantity"), 6).alias("ranking"), F.round(F.avg(s), 6).alias("score"))


CRF = ([0.1, -0.1], [[0.3, -0.2], [-0.4, 0.2]], [0.05, -0.05])


@query(f"""WITH RECURSIVE {SAMPLES}, M AS MATERIALIZED (SELECT doc_id, len(ls) n, list_transform(ls, lambda x: (length(x) % 7) / 7.0) a, list_transform(ls, lambda x: (length(x) % 5) / 5.0) b, keep FROM S),
r AS (SELECT doc_id, 1 i, (0.1 + a[1])::DOUBLE za, (-0.1 + b[1])::DOUBLE zb, (0.1 + a[1])::DOUBLE va, (-0.1 + b[1])::DOUBLE vb FROM M UNION ALL
SELECT r.doc_id, i + 1, ln(exp(za + 0.3) + exp(zb - 0.2)) + a[i + 1], ln(exp(za - 0.4) + exp(zb + 0.2)) + b[i + 1], greatest(va + 0.3, vb - 0.2) + a[i + 1], greatest(va - 0.4, vb + 0.2) + b[i + 1] FROM r JOIN M USING (doc_id) WHERE i < n),
g AS MATERIALIZED (SELECT doc_id, i, CAST(vb - 0.2 > va + 0.3 AS INTEGER) to0, CAST(vb + 0.2 > va - 0.4 AS INTEGER) to1, CAST(vb - 0.05 > va + 0.05 AS INTEGER) fin FROM r),
t AS (SELECT g.doc_id, i, fin tag FROM g JOIN M ON M.doc_id = g.doc_id AND i = n UNION ALL SELECT g.doc_id, g.i, CASE WHEN t.tag = 1 THEN to1 ELSE to0 END FROM t JOIN g ON g.doc_id = t.doc_id AND g.i = t.i - 1),
z AS (SELECT doc_id, sha256(string_agg(tag, '' ORDER BY i)) tags FROM t GROUP BY doc_id),
y AS (SELECT doc_id, list_sum(list_transform(keep, lambda k, i: CASE WHEN k = 1 THEN b[i] ELSE a[i] END + CASE WHEN i = 1 THEN CASE WHEN k = 1 THEN -0.1 ELSE 0.1 END WHEN k = 1 THEN CASE WHEN keep[i - 1] = 1 THEN 0.2 ELSE -0.4 END ELSE CASE WHEN keep[i - 1] = 1 THEN -0.2 ELSE 0.3 END END)) + CASE WHEN keep[-1] = 1 THEN -0.05 ELSE 0.05 END score FROM M)
SELECT doc_id, round(ln(exp(za + 0.05) + exp(zb - 0.05)), 6) normalizer, round(greatest(va + 0.05, vb - 0.05), 6) best, tags, round(ln(exp(za + 0.05) + exp(zb - 0.05)) - score, 5) loss FROM r JOIN M USING (doc_id) JOIN z USING (doc_id) JOIN y USING (doc_id) WHERE i = n""")
def crf_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A text's lines as a two-tag chain: the summed and best scores, the best tags, and the loss of its keep marks."""
    e = F.transform("ls", lambda x: F.struct(((F.length(x) % 7) / 7.0).alias("a"), ((F.length(x) % 5) / 5.0).alias("b")))
    s = samples(spark, sf_dir).select("doc_id", e.alias("e"), "keep")
    s = s.select("doc_id", A.crf_normalizer(F.col("e"), *CRF).alias("z"), A.crf_decode(F.col("e"), *CRF).alias("d"), A.crf_score(F.col("e"), F.col("keep"), *CRF).alias("s"))
    return s.select("doc_id", F.round("z", 6).alias("normalizer"), F.round("d.score", 6).alias("best"), F.sha2("d.tags", 256).alias("tags"), F.round(F.col("z") - F.col("s"), 5).alias("loss"))


@query("""WITH d AS (SELECT vec_id, list_dot_product(embedding::DOUBLE[], list_transform(range(0, 64), lambda i: (i % 3 - 1)::DOUBLE)) yes, list_dot_product(embedding::DOUBLE[], list_transform(range(0, 64), lambda i: ((i % 5 - 2) / 2.0)::DOUBLE)) AS nope FROM embeddings)
SELECT vec_id, round(-ln(1 + exp(nope - yes)), 6) log_chance FROM d""")
def document_log_chance(spark: SparkSession, sf_dir: str) -> DataFrame:
    yes, no = (F.array(*[F.lit(float(w)) for w in ws]) for ws in ([i % 3 - 1 for i in range(64)], [(i % 5 - 2) / 2 for i in range(64)]))
    e = F.col("embedding")
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(A.log_chance(A.dot(e, yes), A.dot(e, no)), 6).alias("log_chance"))


VIOLATIONS = rf"""Z AS (SELECT source || '-' || len(ls) sample_id, lang, ls[1] q, ls, roles, list_transform(ls, lambda x: CASE WHEN length(x) % 3 = 0 OR length(x) % 50 = 49 THEN 1 ELSE 0 END) keep, doc_id, list_filter(range(1, len(ls) + 1), lambda i: roles[i] = 'CORE') core, list_filter(range(1, len(ls) + 1 - CAST(doc_id % 17 = 0 AS INTEGER)), lambda i: roles[i] = 'CORE') seen FROM S),
rules AS (SELECT sample_id, unnest(list_filter([CASE WHEN doc_id % 17 = 0 THEN 'length' END, CASE WHEN len(list_filter(list_zip(roles, keep), lambda x: x[2] <> CAST(x[1] <> 'DROP' AS INTEGER))) > 0 THEN 'role_keep' END, CASE WHEN trim(q) = '' THEN 'query' END,
CASE WHEN lang <> 'es' AND NOT (list_contains(roles, 'CORE') AND list_contains(roles, 'DROP')) THEN 'positive_roles' END, CASE WHEN lang NOT IN ('es', 'en', 'de') THEN 'revision' END, CASE WHEN lang NOT IN ('es', 'en', 'fr') THEN 'patch_mapping' END,
CASE WHEN len(core) > 0 AND core[1:1] <> seen THEN 'core_truncated' END, CASE WHEN len(ls) < 3 THEN 'block_span' END, CASE WHEN doc_id % 2 = 0 AND length(trim(regexp_replace(ls[1], '\s+', ' ', 'g'))) >= 12 THEN 'leakage' END, CASE WHEN contains(array_to_string(ls, chr(10)), 'diff --git') THEN 'gold_patch' END], lambda c: c IS NOT NULL)) code FROM Z)"""


@query(f"""WITH {SAMPLES}, {VIOLATIONS} SELECT code, count(*) n FROM (SELECT code FROM rules UNION ALL SELECT 'sample_id' FROM (SELECT sample_id, count(*) - 1 m FROM Z GROUP BY sample_id HAVING count(*) > 1), range(0, m) r(i)) GROUP BY code""")
def sample_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as sample rows with defects, counted by the rule that finds them."""
    s, n = samples(spark, sf_dir), F.size("ls")
    core = F.filter(F.transform("roles", lambda r, i: F.when(r == "CORE", i + 1)), lambda x: x.isNotNull())
    numbers = F.sequence(F.lit(1), n)
    rows = s.select(
        F.concat_ws("-", "source", n).alias("sample_id"), F.when(F.col("lang") == "es", "original").otherwise("made").alias("dataset_source"), F.get("ls", F.lit(0)).alias("query"), F.col("ls").alias("lines"),
        F.when(F.col("doc_id") % 17 == 0, F.slice(numbers, F.lit(1), n - 1)).otherwise(numbers).alias("line_numbers"), F.col("roles").alias("line_roles"), F.transform("ls", lambda x: ((F.length(x) % 3 == 0) | (F.length(x) % 50 == 49)).cast("int")).alias("line_keep_labels"),
        F.array_repeat(F.lit(1.0), n).alias("line_confidences"), F.lit(1).alias("document_label"), F.when(F.col("lang").isin("en", "de"), "buggy_base").alias("revision"), F.col("lang").isin("en", "fr").alias("mapped"), F.slice(core, 1, 1).alias("core_line_numbers"),
        F.array(F.struct(F.lit(1).alias("start"), (n - 2).alias("stop"))).alias("block_spans"), F.when(F.col("doc_id") % 2 == 0, F.array(T.fragment_hash(F.get("ls", F.lit(0))))).otherwise(F.array().cast("array<string>")).alias("forbidden"))
    return checks.violations(rows).groupBy("code").agg(F.count("*").alias("n"))
