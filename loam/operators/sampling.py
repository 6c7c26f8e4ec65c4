"""Deterministic draws by hash order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.functions.text import stable_hash, unit_hash


def balanced_top(rows: DataFrame, cls: str, key: str, k: int) -> DataFrame:
    """The ``k`` rows of smallest hash of each class; the rank filter prunes before the shuffle."""
    w = Window.partitionBy(cls).orderBy(stable_hash(F.col(key)), key)
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def round_robin(rows: DataFrame, group: str, key: str, each: int) -> DataFrame:
    """Up to ``each`` rows of every group by hash order, numbered in rounds: one of each group, then the next."""
    rows = rows.withColumn("h", stable_hash(F.col(key))).withColumn("round", F.row_number().over(Window.partitionBy(group).orderBy("h", key)))
    return rows.where(F.col("round") <= each).drop("h")


def gate(rows: DataFrame, key: str, ratio: float) -> DataFrame:
    return rows.where(unit_hash(F.col(key)) < ratio)


def shard(key: Column, world: int) -> Column:
    return F.pmod(F.conv(stable_hash(key, length=8), 16, 10).cast("long"), F.lit(world))


def replay_mix(new: DataFrame, old: DataFrame, key: str, total: int, ratio: float, seed: int) -> DataFrame:
    """``total`` rows, ``round(total * ratio)`` of them from ``old``: hash order of (seed, key); a pool that is too small is
    drawn from again and again."""
    n_old = round(total * ratio)

    def draw(pool: DataFrame, n: int, name: str) -> DataFrame:
        """The ``n`` first by hash of a pool that may be drawn several times: whole prefixes of the hash are counted,
        and only the one in which the limit falls is ranked."""
        size = pool.count()
        if not size or n < 1:
            return pool.limit(0).select(key, F.lit(0).alias("turn"), F.lit(name).alias("pool"))
        whole, rest = divmod(n, size)
        hashed = pool.select(key, stable_hash(F.lit(seed), F.col(key)).alias("h")).withColumn("part", F.substring("h", 1, 3))
        full = hashed.select(key, F.explode(F.sequence(F.lit(0), F.lit(whole - 1))).alias("turn")) if whole else None
        ahead, cut = 0, None
        for part, m in sorted(hashed.groupBy("part").count().collect()):  # 4,096 rows at most
            if ahead + m > rest:
                cut = part
                break
            ahead += m
        last = hashed.where(F.col("part") < cut).select(key) if cut else hashed.select(key)
        if cut:
            last = last.unionAll(hashed.where(F.col("part") == cut).orderBy("h", key).limit(rest - ahead).select(key))
        last = last.withColumn("turn", F.lit(whole))
        return (full.unionByName(last) if full is not None else last).select(key, "turn", F.lit(name).alias("pool"))

    return draw(new, total - n_old, "new").unionByName(draw(old, n_old, "replay"))


def grep_rows(rows: DataFrame, keys: list[str], at: str, seed: int, most: int, reach: int = 2) -> DataFrame:
    """Of texts with a CORE line: lines within ``reach`` of one, and others in hash order, up to ``most``; with the marks
    of what a search shows."""
    from loam.operators.labels import dilate

    per = Window.partitionBy(*keys)
    near = dilate(rows.withColumn("p", F.col("role") == "CORE"), keys, at, "p", reach).withColumn("some", F.max("p").over(per)).where("some")
    order = F.when(~F.col("near"), stable_hash(F.lit(seed), *[F.col(k) for k in keys], F.col(at)))
    top = near.withColumn("r", F.row_number().over(per.orderBy(F.desc("near"), order, at))).where(F.col("r") <= most)
    role = F.when(F.col("p"), F.col("role")).when(F.col("near"), "SUPPORT").otherwise("DROP")
    return top.withColumns({"keep": F.col("near").cast("int"), "role": role, "confidence": F.when(F.col("p"), 1.0).when(F.col("near"), 0.75).otherwise(0.85)})


def strategy_views(rows: DataFrame, seed: int, ratio: float) -> DataFrame:
    """Lines (doc_id, q, n, i, x, k) chosen by each of four strategies: all kept lines (k), and others up to
    ``ceil(n * ratio)`` lines, one staying out at least. ``local``: nearest to kept ones; ``lexical``: most words of the
    query (q); ``mixed``: a third by hash, then nearest; ``wide``: by thirds of the distance."""
    from loam.functions.text import query_tokens
    from loam.operators.labels import nearest_marked

    d = nearest_marked(rows, ["doc_id"], "i", "k", middle=True).withColumn("pos", F.count_if("k").over(Window.partitionBy("doc_id")))
    d = d.withColumn("lex", F.size(F.array_intersect("q", query_tokens(F.col("x"))))).withColumn("strategy", F.explode(F.array(*map(F.lit, ("local", "lexical", "mixed", "wide")))))
    s = F.col("strategy")
    h = F.sha2(F.concat_ws("\x1f", F.lit(str(seed)), F.col("doc_id").cast("string"), s, F.col("i").cast("string")), 256)
    first = F.when(F.col("k"), 0).when(s == "lexical", -F.col("lex")).when(s == "mixed", F.conv(F.substring(h, 1, 8), 16, 10).cast("long") % 3).when(s == "wide", F.floor(F.col("distance") / 3)).otherwise(0)
    ranked = d.withColumn("r", F.row_number().over(Window.partitionBy("strategy", "doc_id").orderBy(F.desc("k"), first, F.when(s == "wide", 0).otherwise(F.col("distance")), h, "i")))
    wanted = F.ceil(F.col("n") * F.lit(ratio))
    most = F.greatest("pos", F.when((F.col("pos") < F.col("n")) & (wanted >= F.col("n")), F.col("n") - 1).otherwise(wanted))
    return ranked.where(F.col("k") | (F.col("r") <= most))


def file_listing(files: DataFrame, group: str, seed: int, most: int = 40, share: float = 0.3) -> DataFrame:
    """(group, path, role, confidence) of a listing of (group, path, dir, patch): the files of the patch, others in hash
    order up to ``most``, and of these as SUPPORT up to ``share`` of all, those in a directory of the patch first. Groups
    with fewer than four files or no patch have none; a null ``patch`` is none, a null directory is one.

    Counts are added up before the shuffle and others ranked up to a fixed place, which Spark cuts before the shuffle too:
    no task sees a whole group."""
    rows = files.withColumn("patch", F.coalesce("patch", F.lit(False)))
    counts = rows.groupBy(group).agg(F.count("*").alias("pool"), F.count_if("patch").alias("np")).where("pool >= 4 and np > 0")
    near = rows.where("patch").select(F.col(group).alias("__g"), F.col("dir").alias("__d"), F.lit(1).alias("samedir")).distinct()
    hashed = Window.partitionBy(group).orderBy(stable_hash(F.lit(seed), F.col(group), F.col("path")), "path")
    some = rows.where("not patch").withColumn("r", F.row_number().over(hashed)).where(F.col("r") <= most).join(counts, group).where(F.col("r") <= most - F.col("np"))
    some = some.join(near, F.col(group).eqNullSafe(F.col("__g")) & F.col("dir").eqNullSafe(F.col("__d")), "left")
    m = F.col("np") + F.least(F.col("pool") - F.col("np"), F.greatest(most - F.col("np"), F.lit(0)))
    want = F.greatest(F.col("np"), F.floor(share * m + 0.999 + 1e-9)) - F.col("np")
    support = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(F.coalesce("samedir", F.lit(0))), F.desc("path"))) <= want
    others = some.withColumn("support", support).select(group, "path", F.when(F.col("support"), "SUPPORT").otherwise("DROP").alias("role"), F.when(F.col("support"), 0.7).otherwise(0.85).alias("confidence"))
    core = rows.where("patch").join(counts.select(group), group, "left_semi").select(group, "path", F.lit("CORE").alias("role"), F.lit(1.0).alias("confidence"))
    return core.unionByName(others)


def select_views(lines: DataFrame, keys: list[str], at: str, keep: str, order: list[Column], ratio: float) -> DataFrame:
    """All kept lines of a key, and the best others up to ``ceil(n * ratio)`` lines; one line at least stays out."""
    per = Window.partitionBy(*keys)
    rows = lines.withColumn("n", F.count("*").over(per)).withColumn("rank", F.row_number().over(per.orderBy(F.desc(keep), *order, at)))
    most = F.least(F.greatest(F.ceil(F.col("n") * F.lit(ratio)), F.lit(1)), F.greatest(F.col("n") - 1, F.lit(1)))
    return rows.where((F.col("rank") <= most) | F.col(keep)).drop("n", "rank")
