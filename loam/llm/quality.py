"""Quality by the perplexity of an interpolated modified Kneser-Ney model of trusted text."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import kneser_ney
from loam.llm import textvec as tv
from loam.llm.common import Scratch, flat, if_small, slices, stash, texts_of
from loam.llm.kneser_ney import START, discounts

#: Trusted rows of all languages whose n-grams are counted: no bound. ``classify`` takes one for a caller who wants it.
TRUSTED = math.inf
#: Shares of the trusted texts of a language and length beyond which thresholds begin, and by how much of their
#: distance from the middle they are widened: a clean text that is a little less usual than all trusted ones stays.
TAIL, WIDER = 0.01, 0.8
#: Trusted texts that a group has at least; smaller ones use their language's, then all, thresholds.
LEAST = 60
#: Of the trusted rows of a language, one in so many is not counted, however few there are.
ASIDE = 2
_GRAMS = "a long, b long, c long, n long"


@dataclass(frozen=True)
class Table:
    """Values by hash: the hashes in ascending order, and for each of their leading bits where such hashes begin."""

    keys: np.ndarray
    values: np.ndarray
    first: np.ndarray
    shift: np.uint64

    @classmethod
    def of(cls, keys: np.ndarray, values: np.ndarray) -> Table:
        order = np.argsort(keys)
        keys, bits = keys[order], max(1, len(keys).bit_length())
        shift = np.uint64(64 - bits)
        first = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << shift)
        return cls(keys, values[order], np.minimum(first, max(0, len(keys) - 1)).astype(np.int32), shift)

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        """The keys' values; hashes are even, so a step or two from where their leading bits begin finds them."""
        out = np.full(len(keys), default)
        if not len(self.keys):
            return out
        at = self.first[keys >> self.shift]
        here = self.keys[at]
        hit = here == keys
        out[hit] = self.values[at[hit]]
        left = np.flatnonzero((here < keys) & (at < len(self.keys) - 1))
        at, keys = at[left], keys[left]
        while len(left):
            at = at + 1
            here = self.keys[at]
            hit = here == keys
            out[left[hit]] = self.values[at[hit]]
            on = (here < keys) & (at < len(self.keys) - 1)
            left, at, keys = left[on], at[on], keys[on]
        return out


@dataclass(frozen=True)
class Model:
    """Tables by n-gram: discounted shares of trigrams and bigrams, the weights that contexts leave to shorter
    n-grams, and the lowest order's probabilities."""

    tri: Table
    tri_left: Table
    bi: Table
    bi_left: Table
    uni: Table
    unseen: float


def grams(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each word the one before it and the one before that; START beyond a text's beginning."""
    one, two = np.full(len(h), START), np.full(len(h), START)
    one[1:] = np.where(doc[1:] == doc[:-1], h[:-1], START)
    two[2:] = np.where(doc[2:] == doc[:-2], h[:-2], START)
    return two, one


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        buf, offs = flat(batch.column("text"))
        for _, _, b, o in slices(buf, offs):
            h, _, _, doc = tv.words(b, o, lower=False)
            two, one = grams(h, doc)
            yield pa.RecordBatch.from_arrays([*(pa.array(x.view(np.int64)) for x in (two, one, h)), pa.array(np.ones(len(h), np.int64))], ["a", "b", "c", "n"])


def _perplexities(batches: Iterable[pa.RecordBatch], m: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, (buf, offs) = batch.column("doc_id"), flat(batch.column("text"))
        for lo, hi, b, o in slices(buf, offs):
            h, _, _, doc = tv.words(b, o, lower=False)
            two, one = grams(h, doc)
            pair, before = tv.join2(one, h), tv.join2(two, one)
            p = m.uni.get(h, m.unseen)
            p = m.bi.get(pair, 0.0) + m.bi_left.get(one, 1.0) * p
            p = m.tri.get(tv.join2(two, pair), 0.0) + m.tri_left.get(before, 1.0) * p
            n = np.bincount(doc, minlength=hi - lo)
            total = np.bincount(doc, weights=np.log10(p), minlength=hi - lo)
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(n), pa.array(-total / np.maximum(n, 1), mask=n == 0)], ["doc_id", "n_words", "log_ppl"])


SCORED = "doc_id long, n_words long, log_ppl double"


def _order(counts: DataFrame, context: list[str], word: str) -> tuple[DataFrame, DataFrame]:
    """(context, word, share) and (context, left) of one order: counts less the three discounts, over the context's
    total; the discounts, which depend on counts of counts, are what the context leaves to the order below."""
    of = {r[0]: r[1] for r in counts.where("n <= 4").groupBy("n").agg(F.count("*")).collect()}
    d = discounts(*(of.get(k, 0) for k in (1, 2, 3, 4)))
    less = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
    totals = counts.groupBy(*context).agg(F.sum("n").alias("total"), F.sum(less).alias("less"))
    shares = counts.join(totals.select(*context, "total"), context).select(*context, word, ((F.col("n") - less) / F.col("total")).alias("share"))
    return shares, totals.select(*context, (F.col("less") / F.col("total")).alias("left"))


def _hashed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        cols = [c.to_numpy().view(np.uint64) for c in batch.columns[:-1]]
        h = cols[-1]
        for c in cols[-2::-1]:
            h = tv.join2(c, h)
        yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.columns[-1].cast(pa.float32())], ["h", "v"])


def _table(rows: DataFrame, keys: list[str], value: str, plus: float = 0.0) -> Table:
    got = rows.select(*keys, value).mapInArrow(_hashed, "h long, v float").toArrow()  # a model for small tables
    return Table.of(got.column("h").to_numpy().view(np.uint64), got.column("v").to_numpy() + np.float32(plus))


def fit_model(texts: DataFrame) -> Model:
    """A trigram model of few ``texts`` (text), which :func:`score` sends to all tasks; :func:`classify` uses
    :mod:`kneser_ney`, where the same model has no such bound. Counts of the highest order, and below it in how many contexts a word
    stands, are sums sharded by n-gram, joined with their contexts' totals."""
    tri = stash(texts.mapInArrow(_counts, _GRAMS).groupBy("a", "b", "c").agg(F.sum("n").alias("n")), "trigrams")
    bi = stash(tri.groupBy("b", "c").agg(F.count("*").alias("n")), "bigrams")
    uni = stash(bi.groupBy("c").agg(F.count("*").alias("n")), "unigrams")
    words = uni.count() + 1
    if words == 1:
        none = Table.of(np.zeros(0, np.uint64), np.zeros(0, np.float32))
        return Model(none, none, none, none, none, 1.0)
    t, t_left = _order(tri, ["a", "b"], "c")
    b, b_left = _order(bi, ["b"], "c")
    u, u_left = _order(uni.withColumn("all", F.lit(0)), ["all"], "c")
    left = u_left.first()[1]
    return Model(_table(t, ["a", "b", "c"], "share"), _table(t_left, ["a", "b"], "left"), _table(b, ["b", "c"], "share"), _table(b_left, ["b"], "left"), _table(u, ["c"], "share", left / words), left / words)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, n_words, log_ppl): the mean of -log10 of the words' probabilities; null without words."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return texts_of(docs).mapInArrow(lambda it: _perplexities(it, sent.value), SCORED)


def _grouped(rows: DataFrame) -> DataFrame:
    return rows.withColumn("size", F.floor(F.log2(F.greatest(F.col("n_words"), F.lit(1)))).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, most: float = TRUSTED) -> DataFrame:
    """(doc_id, lang, n_words, log_ppl, low, high, kept) for each row of ``docs`` (doc_id, text, lang).

    Trusted are the texts with ``labels.quality`` 1. The n-grams of half of them are counted, by the hash of doc_id (of
    ``most`` at most, as many of each language, if that is given); every text of ``docs`` is then scored once. The scores
    of the other half, which are those of unseen text, give the thresholds: quantiles by language and binary order of length, as a short text's perplexity
    varies more; groups with few trusted texts use their language's, then all texts'. A text is kept between the two:
    junk is too surprising (symbols, shouting) or not surprising enough (one word over and over).

    Null, empty or wordless text: rejected. Null lang: a language of its own for counting, and the thresholds of all
    languages. Null doc_id: judged alike. Repeated rows: each judged; one label row is enough, and an id with several
    labels is trusted if one of them is 1. Very long texts: whole. No trusted texts: every text with words is kept.
    Empty table: no rows. Other columns: ignored."""
    trusted = labels.where("doc_id is not null and quality = 1").select(F.col("doc_id").cast("long").alias("id")).distinct()
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"), F.col("lang").cast("string").alias("lang"))
    scratch = Scratch(docs.sparkSession, "quality")
    known = stash(base.where("text is not null").select("doc_id", "lang").join(trusted, F.col("doc_id") == F.col("id"), "left_semi").distinct(), "trusted")
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    langs = max(1, sizes.count())
    rate = F.least(F.lit(1 - 1 / ASIDE), F.lit(float(most)) / langs / F.col("n"))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 20)) < F.floor(rate * (1 << 20))
    counted = stash(known.join(F.broadcast(sizes), known["lang"].eqNullSafe(sizes["lang"])).where(draw).select(F.col("doc_id").alias("id")).distinct(), "counted")
    scored = _grouped(kneser_ney.score(base, counted, scratch))
    rest = known.join(if_small(counted), F.col("doc_id") == F.col("id"), "left_anti").select(F.col("doc_id").alias("id")).distinct()
    seen = scored.where("log_ppl is not null").join(if_small(stash(rest, "unseen")), F.col("doc_id") == F.col("id"), "left_semi").select("lang", "size", "log_ppl")

    def bounds(by: list[str], name: str) -> DataFrame:
        q = F.percentile_approx("log_ppl", F.array(F.lit(TAIL), F.lit(0.5), F.lit(1 - TAIL)), 10_000)
        got = seen.groupBy(*by).agg(F.count("*").alias("m"), q.alias("q")).where(F.col("m") >= (LEAST if by else 1))
        wide = lambda k: F.col("q")[k] + WIDER * (F.col("q")[k] - F.col("q")[1])
        return got.select(*by, F.struct(wide(0).alias("low"), wide(2).alias("high")).alias(name))

    out = scored.join(F.broadcast(bounds(["lang", "size"], "t1")), ["lang", "size"], "left").join(F.broadcast(bounds(["lang"], "t2")), "lang", "left").crossJoin(F.broadcast(bounds([], "t3").unionAll(_no_bounds(docs)).orderBy(F.col("t3").isNull()).limit(1)))
    t = F.coalesce("t1", "t2", "t3")
    kept = (F.col("n_words") > 0) & (t.isNull() | F.col("log_ppl").between(t["low"], t["high"]))
    return out.select("doc_id", "lang", "n_words", "log_ppl", t["low"].alias("low"), t["high"].alias("high"), kept.alias("kept"))


def _no_bounds(docs: DataFrame) -> DataFrame:
    return docs.sparkSession.range(1).select(F.lit(None).cast("struct<low:double,high:double>").alias("t3"))


def drop_low_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``docs`` without the rows that :func:`classify` rejects; rows of one doc_id go if any of them is rejected, and
    rows without a doc_id stay."""
    bad = stash(classify(docs, labels).where("not kept and doc_id is not null").select(F.col("doc_id").alias("__bad_id")).distinct(), "rejected")
    return docs.join(bad, docs["doc_id"] == bad["__bad_id"], "left_anti")
