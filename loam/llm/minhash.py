"""Near-duplicate documents by bottom-k sketches from one hash function."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm import textvec as tv
from loam.llm.common import Scratch, components, flat, if_small, slices, texts_of

#: Retained values of a sketch.
K = 96
#: Sets of at most PAIRS_TO values are listed under runs of two values, those of TRIPLES_FROM or more under runs of three.
#: Linked sets are of one kind at least: if the larger has over PAIRS_TO values, the smaller has TRIPLES_FROM.
PAIRS_TO, TRIPLES_FROM = 16, 13
#: Lists that a sketch shares at least with that of a linked set, where sketches don't hold the whole sets. Of a pair at
#: the threshold that share 0.8 of their values, fewer runs are shared with a chance of 2.4e-14.
SHARED = 2
#: Members of one leader that one task verifies, and documents and shingles of one block of a comparison by blocks.
MEMBERS, BLOCK, BLOCK_SHINGLES = 500, 1_000, 1_000_000
U = np.uint64


def shingle_sets(buf: np.ndarray, offs: np.ndarray, width: int) -> list[np.ndarray]:
    """For each text its sorted distinct shingle hashes; a text of fewer words has one, of all its words."""
    h, _, _, doc = tv.words(buf, offs)
    n = len(offs) - 1
    sh = h.copy()
    for k in range(1, width):
        sh = tv.join2(sh[: len(h) - k], h[k:])
    ok = doc[: len(sh)] == doc[width - 1 :] if len(sh) else np.zeros(0, bool)
    of = doc[: len(sh)][ok]
    ends = np.searchsorted(of, np.arange(n + 1))
    at = np.searchsorted(doc, np.arange(n + 1))
    sh = sh[ok]
    out = []
    for i in range(n):
        x = sh[ends[i] : ends[i + 1]]
        if len(x) > 1:
            x = np.sort(x)
            new = np.ones(len(x), bool)
            np.not_equal(x[1:], x[:-1], out=new[1:])
            x = x[new]
        elif not len(x) and at[i + 1] > at[i]:
            few = h[at[i] : at[i + 1]]
            one = few[:1] ^ U(0x5DEECE66D)
            for k in range(1, len(few)):
                one = tv.join2(one, few[k : k + 1])
            x = tv.mix(one)
        out.append(x)
    return out


def set_keys(x: np.ndarray) -> tuple[int, int]:
    """Two 64-bit hashes of a whole set: sets with equal ones are equal."""
    with np.errstate(over="ignore"):
        return int(np.sum(tv.mix(x), dtype=U).view(np.int64)), int(np.sum(tv.mix(x ^ U(0x9E3779B97F4A7C15)), dtype=U).view(np.int64))


def run_keys(x: np.ndarray, n: int) -> np.ndarray:
    """Keys of the runs of consecutive values of a sorted set of ``n`` values, or of its retained ones."""
    out = []
    if n <= PAIRS_TO and len(x) > 1:
        out.append(tv.join2(x[:-1], x[1:]))
    if n >= TRIPLES_FROM:
        out.append(tv.join2(tv.join2(x[:-2], x[1:-1]), x[2:]))
    return np.concatenate(out) if out else np.zeros(0, U)


def least_shared(n: Column, apart: float) -> Column:
    """Runs that a set of ``n`` values shares at least with a linked one. Of u values in the union of the two at most
    ``apart`` * u aren't shared, and each breaks as many runs as a run has values."""
    two, three = n * F.lit(1 - 2 * apart) - 1, n * F.lit(1 - 3 * apart) - 2
    return F.greatest(F.lit(1), F.ceil(F.when(n < TRIPLES_FROM, two).otherwise(three) - 1e-9))


def _sketch(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, (buf, offs) = batch.column("doc_id"), flat(batch.column("text"))
        for lo, hi, b, o in slices(buf, offs):
            sets = shingle_sets(b, o, width)
            keys = [set_keys(x) if len(x) else (0, 0) for x in sets]
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array([len(x) for x in sets], pa.int64()), pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()), pa.array([x[:K].tobytes() for x in sets], pa.binary())],
                ["doc_id", "n", "k1", "k2", "sketch"])


def _listed(docs: list[int], sizes: list[int], sets: list[np.ndarray]) -> pa.RecordBatch:
    """(key, doc, n) of each run."""
    keys = [run_keys(x, n) for x, n in zip(sets, sizes, strict=True)]
    each = np.array([len(k) for k in keys], np.int64)
    key = np.concatenate(keys) if keys else np.zeros(0, U)
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(np.repeat(np.array(docs, np.int64), each)), pa.array(np.repeat(np.array(sizes, np.int32), each))], ["key", "doc", "n"])


def _sketch_runs(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield _listed(batch.column("doc_id").to_pylist(), batch.column("n").to_pylist(), [np.frombuffer(x, U) for x in batch.column("sketch").to_pylist()])


def _whole_sets(batches: Iterable[pa.RecordBatch], width: int, cols: tuple[str, ...]) -> Iterator[tuple[list[tuple], list[np.ndarray]]]:
    """(values of ``cols``, set) of each row, a slice at a time. A row whose set isn't the one that stands for its
    doc_id is left out."""
    for batch in batches:
        rows = list(zip(*(batch.column(c).to_pylist() for c in (*cols, "k1", "k2")), strict=True))
        buf, offs = flat(batch.column("text"))
        for lo, hi, b, o in slices(buf, offs):
            both = [(r[:-2], x) for r, x in zip(rows[lo:hi], shingle_sets(b, o, width), strict=True) if len(x) and set_keys(x) == r[-2:]]
            yield [r for r, _ in both], [x for _, x in both]


def _text_runs(batches: Iterable[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for rows, sets in _whole_sets(batches, width, ("doc_id",)):
        yield _listed([r[0] for r in rows], [len(x) for x in sets], sets)


def _estimate(batches: Iterable[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Pairs whose estimate from the union's sketch isn't far below ``least``."""
    for batch in batches:
        keep = []
        for n1, n2, s1, s2 in zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True):
            both = np.sort(np.concatenate([np.frombuffer(s1, U), np.frombuffer(s2, U)]))
            same = both[1:] == both[:-1]
            distinct = np.concatenate([[True], ~same])
            top = np.cumsum(distinct) <= K
            est = np.count_nonzero(same & top[1:]) / max(1, np.count_nonzero(distinct & top))
            # three standard deviations of a sketch's estimate; what is left out is compared with the open lists
            keep.append(min(n1, n2) >= least * max(n1, n2) - 1e-9 and est >= least - 3 * (least * (1 - least) / K) ** 0.5)
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))


def _verify(batches: Iterable[pa.RecordBatch], width: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows come by (leader, salt) with the leader's own first: (u, v) for members that are linked to it."""
    now, whole = None, np.zeros(0, U)
    for rows, sets in _whole_sets(batches, width, ("leader", "salt", "doc_id")):
        us, vs = [], []
        for (leader, salt, doc), x in zip(rows, sets, strict=True):
            if leader == doc:
                now, whole = (leader, salt), x
            elif now == (leader, salt):
                same = len(np.intersect1d(x, whole, assume_unique=True))
                if den * same >= num * (len(x) + len(whole) - same):
                    us.append(leader)
                    vs.append(doc)
        yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])


def shared_counts(ids: np.ndarray, owner: np.ndarray, left: int, width: int) -> np.ndarray:
    """(left x width) counts of the values that two owners both have, from (value, owner) rows. Frequent values are
    multiplied as columns of zeros and ones; the others add one for each two of their owners."""
    out = np.zeros((left, width), np.float32)
    order = np.lexsort((owner, ids))
    ids, owner = ids[order], owner[order]
    start = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]])) if len(ids) else np.zeros(0, np.int64)
    m = np.diff(np.append(start, len(ids)))
    often = np.flatnonzero(m >= max(16, width // 16))
    for lo in range(0, len(often), 512):
        cols = np.zeros((width, len(part := often[lo : lo + 512])), np.float32)
        for c, g in enumerate(part):
            cols[owner[start[g] : start[g] + m[g]], c] = 1
        out += cols[:left] @ cols.T
    few = np.repeat((m > 1) & (m < max(16, width // 16)), m) & (owner < left)  # an entry of a left owner meets its value's owners
    group = np.repeat(np.arange(len(m)), m)
    for part in np.array_split(np.flatnonzero(few), max(1, np.count_nonzero(few) >> 17)):
        each = m[group[part]]
        at = np.repeat(start[group[part]] - (np.cumsum(each) - each), each) + np.arange(each.sum())
        out += np.bincount(np.repeat(owner[part], each) * width + owner[at], minlength=left * width).reshape(left, width)
    return out


def similar(sets: list[np.ndarray], left: int, num: int, den: int) -> np.ndarray:
    """(left x all) whether den * |A & B| >= num * |A | B| for the first ``left`` sets and all others.

    Sets are held as their differences from the values that most of them have: |A ^ B| = |DA| + |DB| - 2 |DA & DB|."""
    width, size = len(sets), np.array([len(x) for x in sets], np.int64)
    value, ids = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(width), size)
    most = np.bincount(ids) * 2 > width
    place = np.cumsum(most) - 1
    has = np.zeros((width, int(most.sum())), bool)
    has[owner[most[ids]], place[ids[most[ids]]]] = True
    lacks = np.argwhere(~has)
    extra = ~most[ids]
    d_ids = np.concatenate([ids[extra], np.flatnonzero(most)[lacks[:, 1]]])
    d_own = np.concatenate([owner[extra], lacks[:, 0]])
    d = np.bincount(d_own, minlength=width)
    apart = d[:left, None] + d[None, :] - 2 * shared_counts(d_ids, d_own, left, width).astype(np.int64)
    total = size[:left, None] + size[None, :]
    return den * (total - apart) >= num * (total + apart)


def _tiles(batches: Iterable[pa.RecordBatch], width: int, num: int, den: int) -> Iterator[pa.RecordBatch]:
    """Rows come by (leader, i, j): (u, v) for linked documents of the tile that are in different components, as many
    as it takes to join these."""
    def links(rows: list[tuple], sets: list[np.ndarray]) -> pa.RecordBatch:
        order = sorted(range(len(rows)), key=lambda k: not rows[k][4])
        left = sum(r[4] for r in rows)
        docs, comp = [rows[k][3] for k in order], np.array([rows[k][5] for k in order])
        us, vs = [], []
        if left:
            ok = similar([sets[k] for k in order], left, num, den) & (comp[:left, None] != comp[None, :])
            if rows[0][2] != 0:  # the queries among themselves are compared in the tile of the first block
                ok[:, :left] = False
            up = {c: c for c in comp.tolist()}

            def root(c: int) -> int:
                while up[c] != c:
                    up[c] = c = up[up[c]]
                return c

            for x, y in np.argwhere(ok).tolist():
                p, q = root(int(comp[x])), root(int(comp[y]))
                if p != q:
                    up[max(p, q)] = min(p, q)
                    us.append(docs[x])
                    vs.append(docs[y])
        return pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], ["u", "v"])

    held, held_sets = [], []
    for rows, sets in _whole_sets(batches, width, ("leader", "i", "j", "doc_id", "query", "c")):
        for r, x in zip(rows, sets, strict=True):
            if held and held[0][:3] != r[:3]:
                yield links(held, held_sets)
                held, held_sets = [], []
            held.append(r)
            held_sets.append(x)
    if held:
        yield links(held, held_sets)


def _open(rows: DataFrame, apart: float) -> DataFrame:
    """(key, doc, pop) of the lists that may hold a link between components. Rows are (key, doc, n, m, c), m members to a
    list. A document in fewer lists than it shares with a linked one leaves all; of the others, each drops its most
    frequent lists, one fewer than a linked pair shares, which leaves the pair's rarest one to both."""
    per = Window.partitionBy("doc")
    need = least_shared(F.col("n"), apart)
    ranked = rows.select("key", "doc", "n", F.count("*").over(per).alias("k"), F.sum("m").over(per).alias("pop"), F.row_number().over(per.orderBy(F.desc("m"), "key")).alias("rank"))
    return ranked.where((F.col("k") >= need) & (F.col("rank") >= need)).select("key", "doc", "pop")


def _led(rows: DataFrame) -> DataFrame:
    """(leader, doc), the leader included, of lists with two members or more: each list is led by its document that
    is in the fullest lists, so a text that others were made from leads them all."""
    lists = rows.groupBy("key").agg(F.max(F.struct("pop", (-F.col("doc")).alias("minus"))).alias("top"), F.count("*").alias("m")).where("m > 1")
    return rows.join(lists.select("key", (-F.col("top.minus")).alias("leader")), "key").select("leader", "doc").distinct()


def near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): the classes of documents that are linked, directly or not, by
    ``den * |A & B| >= num * |A | B|`` on their sets of distinct ``width``-word shingles; ``num / den`` is 3/4 or more.

    One hash function orders all shingles; a document retains its ``K`` smallest. Documents with equal sets become one
    class first. Inverted lists of runs of three consecutive values (two for small sets) bring documents together: a
    linked pair shares at least 0.4 u - 2 of its runs at 0.8, u being the size of its union (:func:`least_shared`).

    1. Lists of the retained values tell who has a partner: a document in fewer shared lists than a linked pair has
       goes. That is certain for sets of up to ``K`` * 0.8 values, and misses a larger pair with a chance of 2e-14.
    2. The others are listed by the runs of their whole sets; documents in too few shared lists go, and so do each
       one's most frequent lists (:func:`_open`). Nothing is lost here.
    3. A list never becomes all its pairs: each member meets the list's leader alone. Pairs that the sketches of their
       unions place near the threshold are verified on whole sets, computed anew from whole texts, and joined.
    4. Lists that still hold two components are cut down again as in 2. The members of their leaders are then compared
       by blocks, those outside the leader's component with all (:func:`similar`), on whole sets: nothing but links
       leaves a task. This finds every link that 3 has left.

    Null or empty text, or no words: an empty set, linked with nothing. Fewer words than ``width``: one shingle of
    them all. Repeated rows of a doc_id: one document, each row returned with its class and its own n_shingles; if
    their texts differ, one of them (by the hash of its set) stands for it. Null doc_id: not returned. Empty table: no
    rows. Other columns: ignored."""
    if 4 * num < 3 * den or num > den:
        raise ValueError("num / den must be between 3/4 and 1")
    apart, work = (den - num) / den, Scratch(docs.sparkSession, "minhash")
    texts = texts_of(docs.where("doc_id is not null"))
    sketched = work.put("sketched", texts.mapInArrow(lambda it: _sketch(it, width), "doc_id long, n long, k1 long, k2 long, sketch binary"))
    full = sketched.where("n > 0").select("doc_id", "n", "k1", "k2")
    one = full.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("own")).select("doc_id", "own.k1", "own.k2")
    twins = work.put("twins", one.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).where("m > 1"))
    member = work.put("member", one.join(twins.drop("m"), ["k1", "k2"]).where("doc_id <> rep").select("doc_id", "rep"))
    # a smaller set's only links are with its equals: one value more on either side is beyond the threshold
    heads = sketched.where(F.col("n") * (den - num) >= num).join(if_small(member), "doc_id", "left_anti").select("doc_id", "n", "sketch", "k1", "k2")

    keys = heads.mapInArrow(_sketch_runs, "key long, doc long, n int")
    met = keys.join(keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key"), "key", "left_semi")
    need = F.when(F.col("n") <= K * (1 - apart), least_shared(F.col("n"), apart)).otherwise(SHARED)
    maybe = work.put("maybe", met.groupBy("doc").agg(F.count("*").alias("k"), F.max("n").alias("n")).where(F.col("k") >= need).select(F.col("doc").alias("doc_id")))
    each = heads.join(if_small(maybe), "doc_id", "left_semi").groupBy("doc_id").agg(F.min(F.struct("k1", "k2", "n", "sketch")).alias("own"))
    able = work.put("able", each.select("doc_id", "own.*"))
    stands = able.select("doc_id", "k1", "k2")
    found = work.put("texts", texts.join(if_small(stands), "doc_id"))
    runs = work.put("runs", found.mapInArrow(lambda it: _text_runs(it, width), "key long, doc long, n int"))
    lists = runs.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    rows = work.put("rows", runs.join(lists, "key").select("key", "doc", "n", "m"))
    work.drop("runs", "maybe", "twins")

    led = work.put("led", _led(work.put("prefix", _open(rows, apart))).where("leader <> doc").toDF("a", "b"))
    sa = able.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("sa"))
    sb = able.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("sb"))
    likely = work.put("likely", led.join(sa, "a").join(sb, "b").mapInArrow(lambda it: _estimate(it, num / den), "a long, b long"))
    size = likely.groupBy("a").agg(F.count("*").alias("m")).withColumn("salts", F.ceil(F.col("m") / MEMBERS).cast("int"))
    salted = likely.join(size, "a").select(F.col("b").alias("doc_id"), F.col("a").alias("leader"), F.pmod(F.xxhash64("b"), "salts").cast("int").alias("salt"))
    tops = size.select(F.col("a").alias("doc_id"), F.col("a").alias("leader"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    meet = found.join(if_small(work.put("salted", salted.unionAll(tops))), "doc_id").repartition("leader", "salt").sortWithinPartitions("leader", "salt", F.col("doc_id") != F.col("leader"))
    links = work.put("links", meet.mapInArrow(lambda it: _verify(it, width, num, den), "u long, v long"))
    comp = components(links, "near")

    named = rows.join(if_small(comp).toDF("doc", "c"), "doc", "left").select("key", F.coalesce("c", "doc").alias("c"))
    mixed = named.groupBy("key").agg(F.min("c").alias("c0"), F.max("c").alias("c1")).where("c0 <> c1").select("key")
    still = work.put("open", rows.join(mixed, "key", "left_semi"))
    groups = work.put("groups", _led(work.put("again", _open(still, apart))).join(if_small(comp).toDF("doc", "c"), "doc", "left").withColumn("c", F.coalesce("c", "doc")))
    tiles = _tiled(groups, able.select("doc_id", "n"))
    meet = found.join(if_small(work.put("tiles", tiles)), "doc_id").repartition("leader", "i", "j").sortWithinPartitions("leader", "i", "j", "doc_id")
    more = work.put("more", meet.mapInArrow(lambda it: _tiles(it, width, num, den), "u long, v long"))
    if more.count():
        comp = components(links.unionAll(more), "near-all")
    work.drop("texts", "rows", "prefix", "led", "likely", "salted", "links", "open", "again", "groups", "tiles", "more", "able")
    of = sketched.select("doc_id", F.col("n").alias("n_shingles")).join(if_small(member), "doc_id", "left").withColumn("node", F.coalesce("rep", "doc_id"))
    out = of.join(if_small(comp), "node", "left").select("doc_id", "n_shingles", F.when(F.col("n_shingles") > 0, F.coalesce("component", "node")).otherwise(F.coalesce("component", "doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def _tiled(groups: DataFrame, sizes: DataFrame) -> DataFrame:
    """(doc_id, leader, i, j, query, c): each group's members outside its leader's component (the queries, in blocks i)
    against its other members (blocks j >= 0) and against each other (block -1 - j for j > i; a block itself in tile (i, 0))."""
    home = groups.where("doc = leader").select("leader", F.col("c").alias("c0"))
    rows = groups.join(home, "leader").join(sizes.toDF("doc", "n"), "doc").withColumn("query", F.col("c") != F.col("c0"))
    blocks = lambda q: F.greatest(F.ceil(F.count_if(F.col("query") == q) / BLOCK), F.ceil(F.sum(F.when(F.col("query") == q, F.col("n")).otherwise(0)) / BLOCK_SHINGLES)).cast("int")
    count = rows.groupBy("leader").agg(blocks(True).alias("nq"), blocks(False).alias("nh")).where("nq > 0")
    rows = rows.join(count, "leader").withColumn("i", F.pmod(F.xxhash64("doc"), F.when(F.col("query"), F.col("nq")).otherwise(F.col("nh"))).cast("int"))
    none = F.array().cast("array<struct<i:int,j:int,query:boolean>>")
    upto = lambda a, b, f: F.when(a < b, F.transform(F.sequence(a, b - 1), f)).otherwise(none)
    at = lambda i, j, q: F.struct(i.cast("int").alias("i"), j.cast("int").alias("j"), F.lit(q).alias("query"))
    i, zero, nq = F.col("i"), F.lit(0), F.col("nq")
    asks = F.concat(upto(zero, F.col("nh"), lambda j: at(i, j, True)), upto(i + 1, nq, lambda k: at(i, -1 - k, True)), upto(zero, i, lambda k: at(k, -1 - i, False)))
    told = upto(zero, nq, lambda k: at(k, i, False))
    return rows.select(F.col("doc").alias("doc_id"), "leader", "c", F.explode(F.when(F.col("query"), asks).otherwise(told)).alias("t")).select("doc_id", "leader", "t.i", "t.j", "t.query", "c")


def drop_near_duplicates(docs: DataFrame, width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each class of :func:`near_duplicates`, that of the smallest doc_id; of repeated
    rows of one doc_id all stay or go together, and rows without a doc_id stay."""
    gone = near_duplicates(docs, width, num, den).where("not kept").select(F.col("doc_id").alias("__gone_id")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["__gone_id"], "left_anti")
