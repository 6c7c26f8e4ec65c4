"""Benchmark decontamination with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import stash

N = 10
#: Bytes of windows, words and items and what a row costs beside them, that are broadcast whole; and, beyond them, windows
#: whose hashes alone are, 16 bytes each. A still larger benchmark is joined by a shuffle on the hash.
BROADCAST_BYTES, BROADCAST_WINDOWS = 64 << 20, 4_000_000
#: What isn't part of a word, after A-Z are lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def norm_words(text: Column) -> Column:
    """Words of ``text`` (null: none), A-Z lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), GAP), lambda w: w != "")


def windows(item_words: DataFrame, n: int) -> DataFrame:
    """(w, width, items): each distinct window of the benchmark with the sorted ids of its items."""
    size = F.size("words")
    starts = F.when(size >= n, F.sequence(F.lit(1), size - n + 1)).when(size > 0, F.array(F.lit(1))).otherwise(F.array().cast("array<int>"))
    each = item_words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice("words", i, n))).alias("w"))
    return each.groupBy("w").agg(F.array_sort(F.collect_set("item_id")).alias("items")).withColumn("width", F.size("w"))


def window_hash(hashes: Column, i: Column, width: int) -> Column:
    return F.xxhash64(*[F.get(hashes, i + k) for k in range(width)], F.lit(width))


def candidate(width: int):
    """The hash of the window of ``width`` words that starts at word i."""
    return lambda i: window_hash(F.col("hs"), i, width)


def hits(docs: DataFrame, benchmark: DataFrame, n: int = N) -> DataFrame:
    """One row per row group of doc_id: doc_id, n_words, hit (0-based positions of words inside any benchmark window)
    and items (ids of the items with a window there).

    The benchmark's windows become a hash set, broadcast with their words while all have at most ``BROADCAST_BYTES`` (they
    are added up first): documents are then read once, each emits the hashes of its own windows and one mark, so documents
    without a hit come through the same join. Beyond, up to ``BROADCAST_WINDOWS`` hashes are broadcast alone, and (doc_id,
    place, hash) of what they hit is shuffled to the words and joined back to the documents; with still more windows, of
    every window of the documents. A hit's words are compared one by one before it counts.

    Null or wordless text: no words, no hits. Null doc_id: such rows are judged together, as are those of any other id.
    Repeated rows change nothing. Two texts of one id: the longer one's number of words, the hits of both. Null item_id:
    the item is ignored. Empty tables: no rows, or no hits. Other columns are left behind."""
    spark = docs.sparkSession
    items = benchmark.select("item_id", norm_words(F.col("text")).alias("words")).where(F.col("item_id").isNotNull())
    found = stash(windows(items, n), "ngrams")
    widths = sorted(r[0] for r in found.select("width").distinct().collect())  # at most n rows
    keyed = None
    for width in widths:
        h = F.transform("w", lambda w: F.xxhash64(w))
        part = found.where(F.col("width") == width).select(window_hash(h, F.lit(0), width).alias("h"), "w", "items", F.lit(width).alias("b_width"))
        keyed = part if keyed is None else keyed.unionAll(part)
    mark = spark.range(1).select(F.lit(0).cast("long").alias("h"), F.lit(None).cast("array<string>").alias("w"), F.lit(None).cast(f"array<{dict(benchmark.dtypes)['item_id']}>").alias("items"), F.lit(0).alias("b_width"))
    keyed = mark if keyed is None else keyed.unionAll(mark)
    base = docs.select("doc_id", norm_words(F.col("text")).alias("words"))
    base = base.select("doc_id", "words", F.transform("words", lambda w: F.xxhash64(w)).alias("hs"))
    # one long per window, in a projection of its own: the explode and the join then compile into one loop that
    # touches a document's words only where a hash is in the set. The outer form keeps the optimizer from adding a
    # size test that would compute the whole array again. Places: the mark, then the windows of each width.
    n_words, first, parts, word_at = F.size("words"), F.lit(1), [F.array(F.lit(0).cast("long"))], F.lit(-1)
    for width in widths:
        starts = F.when(n_words >= width, F.sequence(F.lit(0), n_words - width)).otherwise(F.array().cast("array<int>"))
        parts.append(F.transform(starts, candidate(width)))
        word_at = F.when(F.col("b_width") == width, F.col("pos") - first).otherwise(word_at)
        first = first + F.greatest(n_words - width + 1, F.lit(0))
    base = base.select("doc_id", "words", F.concat(*parts).alias("own"))
    cand = base.select("doc_id", "words", F.posexplode_outer("own").alias("pos", "h"))
    size = F.aggregate("w", F.lit(64), lambda n, x: n + F.octet_length(x) + 16) + 24 * F.size("items")
    n_windows, n_bytes = found.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    if n_bytes <= BROADCAST_BYTES:
        joined = cand.join(F.broadcast(keyed), "h")
    else:
        # a window's row is three numbers; those found go back to their documents, where the words are compared
        spots = cand.where("pos > 0").select(F.col("doc_id").alias("of"), "pos", "h")
        if n_windows <= BROADCAST_WINDOWS:
            spots = spots.join(F.broadcast(keyed.where("b_width > 0").select("h").distinct()), "h", "left_semi")
        spots = spots.join(keyed.where("b_width > 0"), "h")
        joined = base.select("doc_id", "words").join(spots, F.col("doc_id").eqNullSafe(F.col("of")), "left")
    spot = joined.withColumn("i", word_at)
    same = (F.col("i") >= 0) & (F.slice("words", F.greatest(F.col("i"), F.lit(0)) + 1, F.greatest(F.col("b_width"), F.lit(0))) == F.col("w"))
    real = F.when(F.col("b_width") > 0, same)
    rows = spot.select(
        "doc_id", F.size("words").alias("nw"), F.when(real, F.struct("i", F.col("b_width").alias("width"))).alias("span"), F.when(real, F.col("items")).alias("its"))
    found_in = rows.groupBy("doc_id").agg(F.max("nw").alias("n_words"), F.collect_set("span").alias("spans"), F.collect_set("its").alias("its"))
    return found_in.select(
        "doc_id", F.col("n_words").cast("long").alias("n_words"),
        F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["i"], s["i"] + s["width"] - 1)))).alias("hit"),
        F.array_distinct(F.flatten("its")).alias("items"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, n: int = N, remove: str = "documents") -> DataFrame:
    """``docs`` without what stands in ``benchmark`` (item_id, text).

    A window is ``n`` consecutive words of an item, or all words of a shorter one. ``remove="documents"`` drops each
    document with a hit; ``remove="spans"`` keeps every row and replaces its text, where there is a hit, by its
    normalised words outside all hits, joined by spaces. Columns stay as they were.

    Null or wordless text: no hits, the row stays. Null doc_id: the row stays, unread. Repeated rows of one doc_id are
    judged together. Empty benchmark or items without words: nothing is removed. Null item_id: the item is ignored."""
    if remove not in ("documents", "spans"):
        raise ValueError("remove must be documents or spans")
    bad = stash(hits(docs.where("doc_id is not null"), benchmark, n).where(F.size("hit") > 0).select(F.col("doc_id").alias("__hit_id"), F.col("hit").alias("__hit")), "leaks")
    if remove == "documents":
        return docs.join(bad, docs["doc_id"] == bad["__hit_id"], "left_anti")
    out = docs.join(bad, docs["doc_id"] == bad["__hit_id"], "left").withColumn("__words", norm_words(F.col("text")))
    places = F.array_except(F.sequence(F.lit(0), F.size("__words") - 1), "__hit")
    kept = F.array_join(F.transform(places, lambda i: F.get("__words", i)), " ")
    return out.withColumn("text", F.when(F.col("__hit").isNotNull(), kept).otherwise(F.col("text"))).select(*[f"`{c}`" for c in docs.columns])


def report(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The contract's digest of :func:`hits`."""
    names = F.array_sort(F.transform("items", lambda x: x.cast("string")))
    n_hit = F.size("hit").cast("long")
    return hits(docs, benchmark).select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(names, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


ORACLE = r"""
WITH b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws FROM benchmark),
w AS (SELECT DISTINCT item_id, array_to_string(ws[i:i+9], ' ') k, least(10, len(ws)) n FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) i FROM b WHERE len(ws) > 0)),
d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') ws FROM documents),
lens AS (SELECT DISTINCT n FROM w),
dw AS (SELECT doc_id, n, i, array_to_string(ws[i:i+n-1], ' ') k FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) i FROM d, lens WHERE len(ws) >= n)),
h AS (SELECT DISTINCT doc_id, dw.n, i, item_id FROM dw JOIN w ON dw.k = w.k AND dw.n = w.n),
c AS (SELECT doc_id, count(*) n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) p FROM h) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) n_items, string_agg(s, ',' ORDER BY s) s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) s FROM h) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) n_words, CAST(coalesce(n_hit, 0) AS BIGINT) n_hit, CAST(coalesce(n_items, 0) AS BIGINT) n_items, sha256(coalesce(s, '')) items_sha256, n_hit IS NOT NULL contaminated
FROM d LEFT JOIN c USING (doc_id) LEFT JOIN it USING (doc_id)
"""
