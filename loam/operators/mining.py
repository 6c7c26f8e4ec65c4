"""Relations between the blocks of a symbol and hard negatives of anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import relations
from loam.storage import written


#: Anchors that may be sent to all tasks.
FEW = 1_000


def if_few(rows: DataFrame) -> DataFrame:
    """A written table, to be broadcast if it has up to ``FEW`` rows: what it meets then stays where it is, however much of
    it has one key."""
    return F.broadcast(rows) if rows.count() <= FEW else rows


def last_definitions(names: DataFrame, symbol: str = "symbol", at: str = "at") -> DataFrame:
    """(source, target): each block's use of a name with the block before it, in the same symbol, that defined it last.

    ``names`` has a row (symbol, at, block, name, used, defined) for every name of a block, ``at`` being the block's
    place. A name that its own block defines counts for later blocks only. Null names: no row of the result."""
    before = Window.partitionBy(symbol, "name").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    target = F.last(F.when(F.col("defined"), F.col("block")), ignorenulls=True).over(before)
    rows = names.where("name is not null").withColumn("target", target).where("used and target is not null")
    return rows.select(F.col("block").alias("source"), "target").distinct()


def header_relations(nodes: DataFrame) -> dict[str, DataFrame]:
    """CONTROL and EXCEPTION as (source, target): each node of (node, parent, is_header, handles) with its nearest
    ancestor that has a header; EXCEPTION where that one handles errors."""
    found = relations.nearest_header(nodes).join(nodes.select(F.col("node").alias("header"), "handles"), "header").select(F.col("node").alias("source"), F.col("header").alias("target"), "handles")
    pick = lambda c: found.where(c).select("source", "target")
    return {"CONTROL": pick("not coalesce(handles, false)"), "EXCEPTION": pick("handles")}


def call_relations(calls: DataFrame, symbols: DataFrame) -> dict[str, DataFrame]:
    """CALL and CALLED_BY as (source, target) of calls (source, caller, name), ``caller`` being the signature around the
    source, and symbols (name, target): names that one symbol alone has."""
    one = symbols.groupBy("name").agg(F.count("*").alias("m"), F.first("target").alias("target")).where("m = 1").select("name", "target")
    met = calls.join(one, "name").select("source", "caller", "target")
    back = met.where("caller is not null").select(F.col("target").alias("source"), F.col("caller").alias("target"))
    return {"CALL": met.select("source", "target"), "CALLED_BY": back}


def mined(anchors: DataFrame, blocks: DataFrame, related: DataFrame, keys: list[str], most: int) -> DataFrame:
    """(anchor, block, negative_type, similarity, same_file, same_class, rank): the ``most`` first hard negatives of each
    anchor among the blocks of its keys.

    ``anchors`` (keys, anchor, name, words, issue, class, file) meet ``blocks`` (keys, block, name, words, class, file) by
    an equi-join, so the pairs are the blocks times the anchors of their repository, a few; sets of words, of names too, are
    made once a block and met once a pair, unions are told by sizes. Up to ``FEW`` anchors are sent to the blocks. Blocks of
    ``related`` (source, target) edges are none. Ranks are limited before the shuffle. A null class is no shared one; null
    words are none."""
    bare = lambda c: F.array_distinct(F.coalesce(F.col(c), F.array().cast("array<string>")))
    part = lambda *more: F.struct(T.name_words(F.col("name")).alias("name"), bare("words").alias("words"), *more, "class", "file")
    a = if_few(written(anchors.select(*keys, "anchor", part(bare("issue").alias("issue")).alias("a")), "anchors"))
    b = blocks.select(*keys, "block", part().alias("b"))
    met = lambda x, y: F.size(F.array_intersect(x, y))
    both = b.join(a, keys).where("anchor <> block").withColumns({"__n": met("a.name", "b.name"), "__w": met("a.words", "b.words"), "__i": met("a.issue", "b.words")})
    share = lambda n, x, y: F.coalesce(F.when(F.size(x) + F.size(y) == 0, 0.0).otherwise(F.col(n) / (F.size(x) + F.size(y) - F.col(n))), F.lit(0.0))
    scored = both.select("anchor", "block", F.when(F.col("a.name").isNotNull() & F.col("b.name").isNotNull(), share("__n", "a.name", "b.name")).otherwise(0.0).alias("names"), share("__w", "a.words", "b.words").alias("lexical"), share("__i", "a.issue", "b.words").alias("issue"),
        F.coalesce((F.col("a.class") == F.col("b.class")) & (F.col("a.class") != ""), F.lit(False)).alias("same_class"), F.coalesce(F.col("a.file") == F.col("b.file"), F.lit(False)).alias("same_file"))
    scored = scored.select("anchor", "block", "same_file", "same_class", relations.negative_type(F.col("same_class"), F.col("names"), F.col("lexical"), F.col("issue"), F.col("same_file")).alias("negative_type"), F.round(F.greatest("names", "lexical", "issue"), 4).alias("similarity"))
    order = Window.partitionBy("anchor").orderBy(F.desc("same_file"), F.desc("same_class"), F.desc("similarity"), "block")
    # scores alone, not words, are shuffled to the related pairs
    free = relations.unrelated(scored.where("negative_type is not null"), related, anchors.select("anchor").distinct())
    return free.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def mined_by_profile(anchors: DataFrame, blocks: DataFrame, keys: list[str], profile: list[str], scores: dict[str, Column], related: DataFrame, most: int) -> DataFrame:
    """(anchor, block, negative_type, similarity, rank): the ``most`` first hard negatives of each anchor, as in :func:`mined`,
    for blocks that a few columns describe.

    Blocks (keys, block, profile) of one profile in one repository tie but for their ids, so anchors (keys, anchor, ..) meet
    profiles, not blocks: ``scores`` gives same_file, same_class, similarity and negative_type (null: none) of such a pair.
    Anchors that agree in all but their ids have the same list but for themselves and their related ones (``related``:
    source, target), so pairs are of distinct anchors and profiles, scores and counts alone; of a list only as many
    blocks are kept as the anchor with the most related ones can need, and each anchor then meets these few. Pairs don't
    grow with anchors or blocks that repeat others. Null profiles are equal; null keys meet nothing."""
    ends = related.select(F.col("source").alias("anchor"), F.col("target").alias("block")).unionByName(related.select(F.col("target").alias("anchor"), F.col("source").alias("block"))).join(anchors.select("anchor"), "anchor", "left_semi").distinct()
    need = most + 1 + (ends.groupBy("anchor").count().agg(F.max("count")).first()[0] or 0)
    first = F.row_number().over(Window.partitionBy(*keys, *profile).orderBy("block"))
    few = blocks.withColumn("at", first).where(F.col("at") <= need).groupBy(*keys, *profile).agg(F.collect_list("block").alias("ids"))
    kinds = written(few.withColumn("kind", F.array_min("ids")), "kinds")
    told = [c for c in anchors.columns if c not in (*keys, "anchor")]
    one = written(anchors.groupBy(*keys, *told).agg(F.min("anchor").alias("who")), "anchors")
    pairs = one.join(kinds.select(*keys, *profile, "kind", F.size("ids").alias("n")), keys).withColumns(scores).where("negative_type is not null").select("who", "kind", "n", *scores)
    score = [F.desc("same_file"), F.desc("same_class"), F.desc("similarity")]
    n = F.sum("n")
    ahead = n.over(Window.partitionBy("who").orderBy(*score).rangeBetween(Window.unboundedPreceding, 0)) - n.over(Window.partitionBy("who", "same_file", "same_class", "similarity"))
    near = pairs.withColumn("ahead", ahead).where(F.col("ahead") < need).join(kinds.select("kind", "ids"), "kind").select("who", *scores, F.explode("ids").alias("block"))
    order = [*score, "block"]
    near = near.withColumn("at", F.row_number().over(Window.partitionBy("who").orderBy(*order))).where(F.col("at") <= need).drop("at")
    same = [anchors[c] == one[c] for c in keys] + [anchors[c].eqNullSafe(one[c]) for c in told]
    free = anchors.join(one, same).select("anchor", "who").join(near, "who").where("anchor <> block").join(ends, ["anchor", "block"], "left_anti")
    return free.withColumn("rank", F.row_number().over(Window.partitionBy("anchor").orderBy(*order))).where(F.col("rank") <= most).select("anchor", "block", "negative_type", "similarity", "rank")


def relation_loss(rows: DataFrame, groups: list[str], logits: str, label: str, weight: str) -> DataFrame:
    """(groups, n, loss): the mean cross entropy of arrays of logits and the label's place (from 0), by weights, which
    count as 0 below it. Rows without logits or a label: left out."""
    x = F.col(logits)
    top = F.array_max(x)
    entropy = top + F.log(F.aggregate(x, F.lit(0.0), lambda s, v: s + F.exp(v - top))) - F.get(x, F.col(label))
    w = F.greatest(F.coalesce(F.col(weight), F.lit(0.0)), F.lit(0.0))
    sums = rows.withColumns({"__l": entropy, "__w": w}).where("__l is not null").groupBy(*groups).agg(F.count("*").alias("n"), F.sum(F.col("__l") * F.col("__w")).alias("l"), F.sum("__w").alias("w"))
    return sums.select(*groups, "n", (F.col("l") / F.greatest(F.col("w"), F.lit(1e-6))).alias("loss"))


def warmup_cosine(step: Column, warmup: int, total: int) -> Column:
    """The share of the learning rate at a step: up to 1 in a line over ``warmup`` steps, then down to 0 as half a cosine
    at ``total``; 0 after it."""
    done = F.least(F.lit(1.0), (step - warmup) / F.lit(float(max(1, total - warmup))))
    return F.when(step < warmup, step / F.lit(float(max(1, warmup)))).otherwise(0.5 * (1 + F.cos(F.lit(3.141592653589793) * done)))
