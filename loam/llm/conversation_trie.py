"""Trie of the turns that conversations share from their start."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import Scratch, numbered

#: Turns of a conversation that one window runs over; longer ones carry their blocks' totals.
RUN = 1_024
#: Neighbouring ids whose texts are put together before a node's hash is computed: 2 to the power of this.
SHARE = 12
_SEED = 0x7E1E


def digests(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, a, b, n_bytes): each turn with 120 bits of the SHA-256 of its role and text and the text's bytes.
    Null role or text: empty. Null conv_id: left out. No text goes further than this."""
    text, role = F.coalesce(F.col("text").cast("string"), F.lit("")), F.coalesce(F.col("role").cast("string"), F.lit(""))
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text), 256).alias("sha"))
    piece = lambda at: F.conv(F.substring("sha", at, 15), 16, 10).cast("long")
    return rows.select("conv_id", "turn", piece(1).alias("a"), piece(16).alias("b"), "n_bytes")


def placed(scratch: Scratch, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, place, a, b, n_bytes) with their place from 0 by turn (null first, ties by digest), and the
    conversations (conv_id, n_turns). Places are differences of global row numbers: a conversation is never one task's."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("a"), F.col("b"), F.col("salt")]
    laid = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order).drop("salt")
    turns = numbered(scratch, "sorted", laid)
    convs = scratch.put("starts", turns.groupBy("conv_id").agg(F.min("row").alias("start"), F.count("*").alias("n_turns")))
    out = turns.join(convs.drop("n_turns"), "conv_id").select("conv_id", (F.col("row") - F.col("start")).alias("place"), "a", "b", "n_bytes")
    return out, convs.drop("start")


def regrouped(turns: DataFrame, convs: DataFrame, span: int = 5, heads: int = 9) -> tuple[DataFrame, DataFrame]:
    """Every conversation c anew: the first h turns of c - c % ``span``, then its own after its first h, with h =
    crc32(decimal c) % ``heads``; and (conv_id, n_turns) of all, turnless ones too."""
    convs = convs.withColumn("h", F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads).withColumn("base", F.col("conv_id") - F.col("conv_id") % span)
    bases = convs.where("conv_id = base").select("base", F.col("n_turns").alias("n_base"))
    convs = convs.join(bases, "base", "left").withColumn("m", F.least("h", F.coalesce("n_base", F.lit(0))))
    own = turns.join(convs.select("conv_id", "h", "m"), "conv_id").where("place >= h").withColumn("place", F.col("place") - F.col("h") + F.col("m")).drop("h", "m")
    first = turns.where((F.col("place") < heads - 1) & (F.col("conv_id") % span == 0)).withColumnRenamed("conv_id", "base")
    head = first.join(convs.select("base", "conv_id", "h"), "base").where("place < h").drop("base", "h")
    return own.unionByName(head), convs.select("conv_id", (F.col("m") + F.greatest(F.col("n_turns") - F.col("h"), F.lit(0))).alias("n_turns"))


def _running(rows: DataFrame, sums: dict[str, Column], back: bool = False) -> DataFrame:
    """Adds running values of aggregates ``sums`` (named after the columns, which they replace) over a conversation's
    rows by depth, or from its end with ``back``: one window a block of ``RUN`` depths, and one over the blocks' totals."""
    block = F.floor(F.col("depth") / RUN)
    rows = rows.withColumn("block", block)
    totals = rows.where(F.col("n_turns") >= RUN).groupBy("conv_id", "block").agg(*[c.alias(k) for k, c in sums.items()])
    along = lambda key: F.desc(key) if back else F.asc(key)
    before = Window.partitionBy("conv_id").orderBy(along("block")).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select("conv_id", "block", *[c.over(before).alias(f"{k}_before") for k, c in sums.items()])
    inside = Window.partitionBy("conv_id", "block").orderBy(along("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({k: c.over(inside) for k, c in sums.items()})
    return rows.join(carry, ["conv_id", "block"], "left").drop("block")


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, depth, a, b, n_bytes, n_turns): the digest of each conversation's first ``depth`` turns. A turn's digest
    is hashed with its place and the hashes are combined by xor, so that parts of a conversation add up anywhere."""
    rows = turns.join(convs, "conv_id").withColumn("depth", F.col("place") + 1).drop("place")
    mixed = rows.withColumns({k: F.xxhash64(F.lit(_SEED + s), "depth", "a", "b") for s, k in enumerate("ab")})
    run = _running(mixed, {k: F.bit_xor(k) for k in "ab"})
    whole = lambda k: F.col(k).bitwiseXOR(F.coalesce(f"{k}_before", F.lit(0))).alias(k)
    return run.select("conv_id", "depth", whole("a"), whole("b"), "n_bytes", "n_turns")


def first_owned(scratch: Scratch, marks: DataFrame, minima: DataFrame, convs: DataFrame) -> DataFrame:
    """(conv_id, n_turns, first): the least depth at which a conversation is the smallest of those with its prefix;
    n_turns + 1 where there is none. Owned depths are the last ones of a conversation, so a binary search finds their
    start: each round joins all open conversations' middle prefixes with the minima of shared prefixes at once."""
    open_ = convs.select("conv_id", "n_turns", F.lit(1).cast("long").alias("low"), (F.col("n_turns") + 1).alias("high"))
    done, step = None, 0
    while True:
        ready = open_.where("low = high").select("conv_id", "n_turns", F.col("low").alias("first"))
        done = ready if done is None else done.unionAll(ready)
        left = open_.where("low < high").withColumn("depth", F.floor((F.col("low") + F.col("high")) / 2))
        probe = left.join(marks.drop("n_turns", "n_bytes"), ["conv_id", "depth"]).join(minima.drop("n_convs"), ["depth", "a", "b"], "left")
        owned = F.coalesce(F.col("owner") == F.col("conv_id"), F.lit(True))
        step += 1
        open_ = scratch.put(f"search-{step}", probe.select("conv_id", "n_turns", F.when(owned, F.col("low")).otherwise(F.col("depth") + 1).alias("low"), F.when(owned, F.col("depth")).otherwise(F.col("high")).alias("high")))
        if open_.isEmpty():
            return done


def chain_totals(scratch: Scratch, chains: DataFrame) -> DataFrame:
    """(conv_id, leaves, saved) of chains (conv_id, up, leaves, saved) with all chains below them. Bottom-up by doubling:
    in a round each chain adds what its ancestor 2^k steps up has not got yet, so a tree of any height needs a
    logarithm of rounds."""
    now, step = chains, 0
    while True:
        step += 1
        gain = now.where("up is not null").groupBy(F.col("up").alias("conv_id")).agg(F.sum("leaves").alias("more"), F.sum("saved").alias("more_saved"))
        jump = now.where("up is not null").select(F.col("conv_id").alias("up"), F.col("up").alias("next"))
        now = now.join(gain, "conv_id", "left").join(jump, "up", "left")
        now = scratch.put(f"totals-{step}", now.select("conv_id", F.col("next").alias("up"), (F.col("leaves") + F.coalesce("more", F.lit(0))).alias("leaves"), (F.col("saved") + F.coalesce("more_saved", F.lit(0))).alias("saved")))
        if now.where("up is not null").isEmpty():
            return now.drop("up")


def _hashes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in order of (conv_id, depth, chunk): one hash a node, of its chunks' texts joined by commas."""
    now, state, out = None, None, []
    for batch in batches:
        for conv, depth, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "depth", "text")), strict=True):
            if (conv, depth) != now:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = (conv, depth), hashlib.sha256(text.encode())
            else:
                state.update(b"," + text.encode())
        yield _rows(out)
        out = []
    yield _rows([(*now, state.hexdigest())] if now is not None else [])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 3
    return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string())], ["conv_id", "depth", "ends_sha256"])


def end_hashes(scratch: Scratch, ends: DataFrame) -> DataFrame:
    """(conv_id, depth, ends_sha256) of ends (conv_id, depth, member): the members, ascending and comma-joined. Up to
    2^``SHARE`` neighbouring ids become one text; a node with several texts has them streamed in order."""
    text = F.array_join(F.transform(F.sort_array(F.collect_list("member")), lambda x: x.cast("string")), ",")
    chunks = scratch.put("ends", ends.groupBy("conv_id", "depth", F.shiftright("member", SHARE).alias("chunk")).agg(text.alias("text")))
    nodes = chunks.groupBy("conv_id", "depth").agg(F.count("*").alias("m"), F.first("text").alias("text"))
    one = nodes.where("m = 1").select("conv_id", "depth", F.sha2("text", 256).alias("ends_sha256"))
    many = chunks.join(nodes.where("m > 1").select("conv_id", "depth"), ["conv_id", "depth"], "left_semi")
    return one.unionAll(many.repartition("conv_id", "depth").sortWithinPartitions("conv_id", "depth", "chunk").mapInArrow(_hashes, "conv_id long, depth long, ends_sha256 string"))


def trie(turns: DataFrame, span: int = 0, heads: int = 9) -> DataFrame:
    """One row a node: (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256) of the
    trie of conversations (conv_id, turn, role, text), ordered by turn; with ``span`` of those that :func:`regrouped`
    makes of them.

    Nodes are prefixes by 128 bits of hash and belong to their smallest member. A conversation owns its prefixes from
    some depth on, found by binary search; what it owns is a chain that hangs from another one's node. Chains are added up
    bottom-up, and each node gets what its chain has from there on. Rows are ids and numbers; no text is shuffled, and
    no conversation or node is gathered in one task.

    Null turn: first. Ties of a turn, and its repeated rows: several turns, in order of their digests. Null role or text:
    empty. Null conv_id: left out. Empty table: no rows, there being no member for the root. Other columns: ignored."""
    scratch = Scratch(turns.sparkSession, "trie")
    laid, convs = placed(scratch, digests(turns))
    if span:
        laid, convs = regrouped(laid, convs, span, heads)
    convs = scratch.put("convs", convs)
    total, root = convs.agg(F.count("*"), F.min("conv_id")).first()
    marks = scratch.put("marks", prefixes(laid, convs))
    scratch.drop("sorted")
    minima = scratch.put("minima", marks.groupBy("depth", "a", "b").agg(F.min("conv_id").alias("owner"), F.count("*").alias("n_convs")).where("n_convs > 1"))
    firsts = first_owned(scratch, marks, minima, convs.where(F.col("conv_id") != F.lit(root)))
    up = firsts.withColumn("depth", F.col("first") - 1).join(marks.select("conv_id", "depth", "a", "b"), ["conv_id", "depth"], "left").join(minima.drop("n_convs"), ["depth", "a", "b"], "left")
    up = up.select("conv_id", "n_turns", "first", F.when(F.col("depth") > 0, F.col("owner")).otherwise(F.lit(root)).alias("up"))
    top = convs.where(F.col("conv_id") == F.lit(root)).select("conv_id", "n_turns", F.lit(0).cast("long").alias("first"), F.lit(None).cast("long").alias("up"))
    all_ = scratch.put("chains", up.unionAll(top))
    chains = all_.where("first <= n_turns")

    # nodes with what is theirs alone; the root is the first of the smallest conversation's chain
    own = marks.drop("n_turns").join(chains, "conv_id").where("depth >= first").join(minima.drop("owner"), ["depth", "a", "b"], "left")
    own = own.select("conv_id", "depth", "n_turns", "first", "up", F.coalesce("n_convs", F.lit(1)).alias("n_convs"), "n_bytes")
    own = own.unionAll(top.select("conv_id", F.lit(0).cast("long"), "n_turns", "first", "up", F.lit(total).cast("long"), F.lit(0).cast("long")))
    nodes = scratch.put("nodes", own.withColumn("saved", (F.col("n_convs") - 1) * F.col("n_bytes")).drop("n_bytes"))
    hung = chains.where("up is not null").select("conv_id", F.col("up").alias("to"), (F.col("first") - 1).alias("depth"))
    tips = chains.join(hung.select(F.col("to").alias("conv_id"), F.col("depth").alias("n_turns")).distinct().withColumn("on", F.lit(0).cast("long")), ["conv_id", "n_turns"], "left")
    weight = tips.select("conv_id", "up", F.coalesce("on", F.lit(1)).alias("leaves")).join(nodes.groupBy("conv_id").agg(F.sum("saved").alias("saved")), "conv_id")
    totals = chain_totals(scratch, scratch.put("weights", weight))

    below = hung.join(totals, "conv_id").groupBy(F.col("to").alias("conv_id"), "depth").agg(F.count("*").alias("kids"), F.sum("leaves").alias("hung_leaves"), F.sum("saved").alias("hung_saved"))
    zero = lambda c: F.coalesce(c, F.lit(0))
    both = nodes.join(below, ["conv_id", "depth"], "left").withColumn("saved", F.col("saved") + zero("hung_saved")).withColumn("n_children", zero("kids") + (F.col("depth") < F.col("n_turns")).cast("long"))
    both = both.withColumn("leaves", zero("hung_leaves") + (F.col("n_children") == 0).cast("long"))
    run = _running(both, {"saved": F.sum("saved"), "leaves": F.sum("leaves")}, back=True)
    ends = end_hashes(scratch, all_.select(F.when(F.col("first") <= F.col("n_turns"), F.col("conv_id")).otherwise(F.col("up")).alias("conv_id"), F.col("n_turns").alias("depth"), F.col("conv_id").alias("member")))
    parent = F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("first"), F.col("up")).otherwise(F.col("conv_id"))
    return run.join(ends, ["conv_id", "depth"], "left").select("conv_id", "depth", parent.cast("long").alias("parent_conv_id"), "n_convs", "n_children", (F.col("leaves") + zero("leaves_before")).alias("n_leaves"), (F.col("saved") + zero("saved_before")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


ORACLE = """
with t as (select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as p, coalesce(role, '') as r, coalesce(text, '') as t from conversations where conv_id is not null),
o as (select conv_id, list({'r': r, 't': t} order by p) as x,
             xor(4294967295::ubigint, list_reduce(list_concat([4294967295::ubigint], list_transform(string_split(conv_id::varchar, ''), lambda c: ascii(c)::ubigint)),
                 lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda i: 0::ubigint)), lambda y, z: xor(y >> 1, (y & 1) * 3988292384)))) % 9 as h
      from t group by conv_id),
b as (select a.conv_id, list_concat(coalesce(list_slice(c.x, 1, a.h), []), list_slice(a.x, a.h + 1, len(a.x))) as x from o a left join o c on c.conv_id = a.conv_id - a.conv_id % 5),
p as (select conv_id, len(x) as n, x, unnest(range(len(x) + 1)) as d from b),
v as (select d, list_slice(x, 1, d) as k, min(conv_id) as conv_id, count(*) as n_convs, sha256(coalesce(string_agg(case when n = d then conv_id::varchar end, ',' order by conv_id), '')) as ends_sha256 from p group by all),
c as (select d - 1 as d, list_slice(k, 1, d - 1) as k, count(*) as m from v where d > 0 group by all),
u as (select v.*, coalesce(c.m, 0) as n_children, case when v.d = 0 then 0 else (v.n_convs - 1) * strlen(v.k[v.d].t) end as saved from v left join c on c.d = v.d and c.k = v.k),
s as (select d, k, count(*) filter (where n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens
      from (select j as d, list_slice(k, 1, j) as k, n_children, saved from (select *, unnest(range(d + 1)) as j from u)) group by all)
select u.conv_id, u.d as depth, q.conv_id as parent_conv_id, u.n_convs, u.n_children, s.n_leaves, s.saved_tokens, u.ends_sha256
from u join s on s.d = u.d and s.k = u.k left join v q on u.d > 0 and q.d = u.d - 1 and q.k = list_slice(u.k, 1, u.d - 1)"""
