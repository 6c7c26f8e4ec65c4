"""An interpolated modified Kneser-Ney trigram model of any number of texts, held by shards of hashes, and all texts' scores."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import common
from loam.llm import textvec as tv
from loam.llm.common import Scratch, flat, if_small, shuffles_freed, slices, trim
from loam.llm.word_model import pack, unpack

#: Bytes of text that are asked for together, and of text whose n-grams a shard counts.
CHUNK_BYTES, SHARD_BYTES = 16 << 20, 16 << 20
#: In how many parts, by their shards, pairs of words are learned (a power of two, 8 at most, as there are no fewer
#: shards), and in how many, by a hash of their rows, texts are scored: chunks and questions of one part are on disk at a time.
PAIR_PARTS, TEXT_PARTS = 4, 4
#: What stands before a text's first word, twice.
START = np.uint64(0x1D8E4E27C47D124F)
_START = np.array([START])
_BOTH = tv.join2(_START, _START)
#: A trigram's leading bits are those of its first two words, so that both are in one shard.
_TOP, _LOW = np.uint64(0xFFFF << 48), np.uint64(16)
_STATS = "n1 long, n2 long, n3 long, n4 long, kinds long, total long"
_STRUCT = f"struct<{_STATS.replace(' long', ': long')}>"
_CHUNK = "chunk long, doc_id array<long>, lang array<string>, sizes array<int>, places binary, words binary"
_LEARNED = "chunk long, shard int, pairs binary, n_next binary, next binary, times binary, n_prev binary, prev binary"
_PAIRS = f"chunk long, shard int, first binary, pairs binary, here binary, total binary, k1 binary, k2 binary, k3 binary, trigrams binary, n_trigrams binary, tri {_STRUCT}, bi {_STRUCT}"
_LEARNED_WORDS = "shard int, words binary, here binary, total binary, k1 binary, k2 binary, k3 binary"
_WORDS = f"shard int, words binary, w_here binary, w_total binary, w_k1 binary, w_k2 binary, w_k3 binary, uni {_STRUCT}"
_ASKED = "chunk long, shard int, pairs binary, words binary"
_TOLD = "chunk long, shard int, here binary, total binary, k1 binary, k2 binary, k3 binary, w_here binary, w_total binary, w_k1 binary, w_k2 binary, w_k3 binary"
_ASKED_TRIGRAMS, _TOLD_TRIGRAMS = "chunk long, shard int, trigrams binary", "chunk long, shard int, n_trigrams binary"
SCORED = "doc_id long, n_words long, log_ppl double, lang string"


def discounts(n1: int, n2: int, n3: int, n4: int) -> list[float]:
    """What is taken off the counts 1, 2 and from 3 on, by how many n-grams have the counts 1 to 4."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    return [max(0.05, min(k - 0.05, k - (k + 1) * y * up / down if down else 0.5 * k)) for k, down, up in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]


@dataclass(frozen=True)
class Order:
    """The discounts of one order, how many n-grams it has, the sum of their counts and of what is taken off them."""

    d: np.ndarray
    kinds: int
    total: int
    off: float

    @classmethod
    def of(cls, rows: DataFrame, name: str) -> Order:
        n1, n2, n3, n4, kinds, total = (x or 0 for x in rows.agg(*(F.sum(f"{name}.{c}") for c in _names(_STATS))).first())
        d = discounts(n1, n2, n3, n4)
        return cls(np.array([0.0, *d]), kinds, total, d[0] * n1 + d[1] * n2 + d[2] * (kinds - n1 - n2))

    def less(self, n: np.ndarray) -> np.ndarray:
        return self.d[np.minimum(n, 3).astype(np.int64)]

    def share(self, n: np.ndarray, total: np.ndarray) -> np.ndarray:
        return (n - self.less(n)) / np.maximum(total, 1)

    def left(self, total: np.ndarray, k1: np.ndarray, k2: np.ndarray, k3: np.ndarray) -> np.ndarray:
        return np.where(total > 0, (self.d[1] * k1 + self.d[2] * k2 + self.d[3] * k3) / np.maximum(total, 1), 1.0)


def _tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash and the text of each word, a slice at a time, as ``tv.words`` makes several arrays of 8 bytes for each byte."""
    h, doc = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for lo, _, b, o in slices(buf, offs):
        x, _, _, d = tv.words(b, o, lower=False)
        h.append(x)
        doc.append(d + lo)
    return np.concatenate(h), np.concatenate(doc)


def _chunks(batches: Iterable[pa.RecordBatch], part: int = 0) -> Iterator[pa.RecordBatch]:
    """A row for some ``CHUNK_BYTES`` of whole texts: their distinct words and each token's place among them."""
    from pyspark import TaskContext

    chunk = (part << 56) + (TaskContext.get().partitionId() << 32)
    for batch in batches:
        buf, offs = flat(batch.column("text"))
        for lo, hi, b, o in slices(buf, offs, CHUNK_BYTES):
            h, doc = _tokens(b, o)
            words, places, n = np.unique(h, return_inverse=True, return_counts=True)
            order = np.lexsort((words, -n))  # small places for frequent words are stored in fewer bytes
            places = np.argsort(order)[places]
            sizes = np.bincount(doc, minlength=hi - lo).astype(np.int32)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), one(batch.column("doc_id").slice(lo, hi - lo)), one(batch.column("lang").slice(lo, hi - lo)), one(pa.array(sizes)), pa.array([pack(places)], pa.binary()), pa.array([pack(words[order], True)], pa.binary())], _names(_CHUNK))
            chunk += 1


def _names(schema: str) -> list[str]:
    return [x.split()[0] for x in schema.split(", ")]


class _Chunk:
    """A chunk's tokens: ``words`` its distinct words and START, ``word`` and ``prev`` each token's place there and that
    of the token before; ``both`` the hash of a token and the word before it, ``ahead`` that of the two words before it;
    ``text`` its text."""

    def __init__(self, row: dict):
        own, places = unpack(row["words"], True), unpack(row["places"]).astype(np.int64)
        self.sizes = np.array(row["sizes"], np.int64)
        self.text = np.repeat(np.arange(len(self.sizes)), self.sizes)
        first = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        self.words = np.union1d(own, _START)
        self.word = np.searchsorted(self.words, own)[places]
        self.prev = np.concatenate([[0], self.word[:-1]])[: len(self.word)]
        self.prev[first] = np.searchsorted(self.words, START)
        self.both = tv.join2(self.words[self.prev], self.words[self.word])
        self.ahead = np.concatenate([_BOTH, self.both[:-1]])[: len(self.both)]
        self.ahead[first] = _BOTH

    def index(self) -> None:
        """``pairs``, the distinct pairs of words and that of two STARTs; ``pair`` and ``before``, the places there of
        ``both`` and ``ahead``."""
        self.pairs, at = np.unique(np.concatenate([_BOTH, self.both]), return_inverse=True)
        self.pair = at[1:]
        self.before = np.where(self.ahead == _BOTH, at[0], np.concatenate([[0], self.pair[:-1]])[: len(self.pair)])

    def trigrams(self, at: np.ndarray) -> np.ndarray:
        a, b = self.ahead[at], self.both[at]
        return (a & _TOP) | (tv.join2(a, b) >> _LOW)


def _edges(keys: np.ndarray, bits: int) -> np.ndarray:
    """Where each shard's keys begin in ascending ``keys``, and where the last one's end."""
    return np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)), len(keys))


def _ends(lengths: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(lengths)])


def _within(keys: np.ndarray, part: int, parts: int) -> np.ndarray:
    """Which keys are in shards of a part."""
    return (keys >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32) == np.uint64(part)


def _learned(batches: Iterable[pa.RecordBatch], bits: int, part: int, parts: int) -> Iterator[pa.RecordBatch]:
    """For each shard of a part a chunk's pairs of words in it; of its trigrams, by their first two words, which and how
    often, and by their last two words, after which."""
    for batch in batches:
        for row in batch.to_pylist():
            yield from _learned_of(row, bits, part, parts).to_batches()
            trim()


def _learned_of(row: dict, bits: int, part: int, parts: int) -> pa.Table:
    c = _Chunk(row)
    ahead, both = _within(c.ahead, part, parts), _within(c.both, part, parts)
    pairs = np.unique(np.concatenate([c.both[both], _BOTH[_within(_BOTH, part, parts)]]))

    def distinct(where: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, ...]:
        """The distinct trigrams' tokens in the order of their pairs, their counts, and how many a pair has."""
        at = np.flatnonzero(where)
        _, first, n = np.unique(c.trigrams(at), return_index=True, return_counts=True)
        of = np.searchsorted(pairs, by[at[first]])
        order = np.argsort(of, kind="stable")
        return at[first][order], n[order], np.bincount(of, minlength=len(pairs))

    at, times, n_next = distinct(ahead, c.ahead)
    following = (c.trigrams(at) << _LOW) >> _LOW
    at, _, n_prev = distinct(both, c.both)
    previous = c.ahead[at] >> _LOW
    cuts, nexts, prevs = _edges(pairs, bits), _ends(n_next), _ends(n_prev)
    out = []
    for s in np.flatnonzero(np.diff(cuts)):
        k = slice(cuts[s], cuts[s + 1])
        x, p = (slice(y[k.start], y[k.stop]) for y in (nexts, prevs))
        out.append((row["chunk"], s, pack(pairs[k], True), pack(n_next[k]), pack(following[x]), pack(times[x]), pack(n_prev[k]), pack(previous[p])))
    return _rows(out, _LEARNED)


_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "stats": pa.struct([(x.split()[0], pa.int64()) for x in _STATS.split(", ")])}


def _rows(rows: list[tuple], schema: str) -> pa.Table:
    trim()
    plain = schema.replace(_STRUCT, "stats")
    kinds = [x.split() for x in plain.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.table([pa.array(list(x), _TYPES[kind]) for x, (_, kind) in zip(cols, kinds, strict=True)], [name for name, _ in kinds])


def _stats(n: np.ndarray) -> dict:
    return {f"n{k}": int((n == k).sum()) for k in (1, 2, 3, 4)} | {"kinds": int((n > 0).sum()), "total": int(n.sum())}


def _kinds(groups: np.ndarray, n: np.ndarray, size: int) -> list[np.ndarray]:
    """By group: the sum of ``n``, and how many are 1, 2 and more."""
    return [np.bincount(groups, weights=n, minlength=size).astype(np.int64), *(np.bincount(groups[w], minlength=size) for w in (n == 1, n == 2, n >= 3))]


def _pairs(rows: pa.Table) -> pa.Table:
    """A shard's pairs of words and trigrams, in the first row, and for each chunk of learned texts, in its order, the
    pairs that it alone is to hand on to the counts of words: after how many words the second stands behind the first, 0
    for others. Of pairs the shard keeps that and how often and with how many words once, twice and more often they are
    gone on."""
    get = lambda name, rising=False: [unpack(x, rising) for x in rows.column(name).to_pylist()]
    keys = get("pairs", True)
    found, first, back = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    context = np.repeat(back, np.concatenate(get("n_next")).astype(np.int64))
    trigrams, at, of = np.unique((found[context] & _TOP) | np.concatenate(get("next")), return_index=True, return_inverse=True)
    n = np.bincount(of, weights=np.concatenate(get("times")), minlength=len(trigrams)).astype(np.int64)
    after = _kinds(context[at], n, len(found))
    pair = np.repeat(back, np.concatenate(get("n_prev")).astype(np.int64))
    _, at = np.unique(tv.join2(found[pair], np.concatenate(get("prev"))), return_index=True)
    here = np.bincount(pair[at], minlength=len(found))
    hands = np.zeros(len(back), np.int64)
    hands[first] = here
    hands = [pack(x) for x in np.split(hands, np.cumsum([len(k) for k in keys])[:-1])]
    held = (pack(found, True), *(pack(x) for x in (here, *after)), pack(trigrams, True), pack(n), _stats(n), _stats(here))
    extra = [held] + [(None,) * len(held)] * (rows.num_rows - 1)
    return _rows([(c, s, h, *x) for c, s, h, x in zip(rows.column("chunk").to_pylist(), rows.column("shard").to_pylist(), hands, extra, strict=True)], _PAIRS)


def _joined(told: pa.Table, names: tuple[str, ...]) -> list[np.ndarray]:
    """The shards' answers to a chunk, one after the other as its keys are."""
    told = told.sort_by("shard")
    return [np.concatenate([np.zeros(0, np.uint64), *(unpack(x) for x in told.column(c).to_pylist())]).astype(np.int64) for c in names]


_PARTS = ("here", "total", "k1", "k2", "k3")
_W_PARTS = tuple(f"w_{c}" for c in _PARTS)


def _wanted(c: _Chunk, here: np.ndarray, total: np.ndarray) -> np.ndarray:
    """The tokens that trigrams end at which may have been learned, as both of their pairs of words were."""
    return np.flatnonzero((total[c.before] > 0) & (here[c.pair] > 0))


def _learned_words(chunk: pa.Table, told: pa.Table, bits: int) -> pa.Table:
    """For each shard a learned chunk's words in it, with what the pairs that the chunk is to hand on add to their
    counts."""
    c, (hands,) = _Chunk(chunk.to_pylist()[0]), _joined(told, ("first",))
    c.index()
    first = np.full(len(c.pairs), -1)
    first[c.pair] = np.arange(len(c.pair))  # a token of each pair
    first = first[(hands > 0) & (first >= 0)]
    n, size = hands[c.pair[first]], len(c.words)
    told = [np.bincount(c.word[first], minlength=size), *_kinds(c.prev[first], n, size)]
    cuts = _edges(c.words, bits)
    used = [(s, slice(cuts[s], cuts[s + 1])) for s in np.flatnonzero(np.diff(cuts))]
    return _rows([(s, pack(c.words[w], True), *(pack(x[w]) for x in told)) for s, w in used], _LEARNED_WORDS)


def _words(rows: pa.Table) -> pa.Table:
    """A shard's words: after how many words each stands, and how it is gone on."""
    words = [unpack(x, True) for x in rows.column("words").to_pylist()]
    found, back = np.unique(np.concatenate(words), return_inverse=True)
    sums = [np.bincount(back, weights=np.concatenate([unpack(x) for x in rows.column(c).to_pylist()]), minlength=len(found)).astype(np.int64) for c in _PARTS]
    return _rows([(rows.column("shard")[0].as_py(), pack(found, True), *(pack(x) for x in sums), _stats(sums[0]))], _WORDS)


def _asked(batches: Iterable[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """For each shard a chunk's pairs of words and words in it."""
    for batch in batches:
        for row in batch.to_pylist():
            c = _Chunk(row)
            c.index()
            cuts, w_cuts = _edges(c.pairs, bits), _edges(c.words, bits)
            used = np.flatnonzero((np.diff(cuts) > 0) | (np.diff(w_cuts) > 0))
            yield from _rows([(row["chunk"], s, pack(c.pairs[cuts[s] : cuts[s + 1]], True), pack(c.words[w_cuts[s] : w_cuts[s + 1]], True)) for s in used], _ASKED).to_batches()


def _held(model: pa.Table, keys: str, values: Iterable[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """What a shard has of some kind, nothing if it learned none: the keys in ascending order, and their values."""
    raw = [(model.column(c)[0].as_py() if model.num_rows else None) or pack(np.zeros(0)) for c in (keys, *values)]
    return unpack(raw[0], True), [unpack(x) for x in raw[1:]]


def _looked_up(x: np.ndarray, keys: np.ndarray, values: list[np.ndarray]) -> list[bytes]:
    """The values of ``x``, packed, 0 where there is none."""
    at = np.minimum(np.searchsorted(keys, x), max(0, len(keys) - 1))
    hit = keys[at] == x if len(keys) else np.zeros(len(x), bool)
    return [pack(np.where(hit, v[at], 0) if len(keys) else np.zeros(len(x))) for v in values]


def _told(asked: pa.Table, model: pa.Table) -> pa.Table:
    """A shard's answers for the pairs of words and the words of chunks, in their order."""
    pairs, words = _held(model, "pairs", _PARTS), _held(model, "words", _W_PARTS)
    return _rows([(chunk, shard, *_looked_up(unpack(p, True), *pairs), *_looked_up(unpack(w, True), *words)) for chunk, shard, p, w in zip(*(c.to_pylist() for c in asked.columns), strict=True)], _TOLD)


def _asked_trigrams(chunk: pa.Table, told: pa.Table, bits: int) -> pa.Table:
    """For each shard a chunk's trigrams in it that may have been learned."""
    row = chunk.to_pylist()[0]
    c = _Chunk(row)
    c.index()
    keys = np.unique(c.trigrams(_wanted(c, *_joined(told, _PARTS[:2]))))
    cuts = _edges(keys, bits)
    return _rows([(row["chunk"], s, pack(keys[cuts[s] : cuts[s + 1]], True)) for s in np.flatnonzero(np.diff(cuts))], _ASKED_TRIGRAMS)


def _told_trigrams(asked: pa.Table, model: pa.Table) -> pa.Table:
    """A shard's answers for trigrams: their counts."""
    held = _held(model, "trigrams", ["n_trigrams"])
    return _rows([(chunk, shard, *_looked_up(unpack(x, True), *held)) for chunk, shard, x in zip(*(c.to_pylist() for c in asked.columns), strict=True)], _TOLD_TRIGRAMS)


def _scored(chunk: pa.Table, told: pa.Table, tri: Order, bi: Order, uni: Order) -> pa.Table:
    row = chunk.to_pylist()[0]
    c = _Chunk(row)
    c.index()
    answers, of_trigrams = (told.filter(pc.equal(told.column("step"), x)) for x in range(2))
    here, total, *kinds = _joined(answers, _PARTS)
    w_here, w_total, *w_kinds = _joined(answers, _W_PARTS)
    (counts,) = _joined(of_trigrams, ("n_trigrams",))
    at = _wanted(c, here, total)
    _, places = np.unique(c.trigrams(at), return_inverse=True)
    n = np.zeros(len(c.word), np.int64)
    n[at] = counts[places]
    unseen = uni.off / uni.total / (uni.kinds + 1) if uni.kinds else 1.0
    p = uni.share(w_here, uni.total)[c.word] + unseen
    p = bi.share(here[c.pair], w_total[c.prev]) + bi.left(w_total, *w_kinds)[c.prev] * p
    p = tri.share(n, total[c.before]) + tri.left(total, *kinds)[c.before] * p
    sums = np.bincount(c.text, weights=np.log10(p), minlength=len(c.sizes))
    return pa.table([pa.array(row["doc_id"], pa.int64()), pa.array(c.sizes), pa.array(-sums / np.maximum(c.sizes, 1), mask=c.sizes == 0), pa.array(row["lang"], pa.string())], _names(SCORED))


def _parts(docs: DataFrame, parts: int) -> list[DataFrame]:
    """Rows by a hash of all that they hold, so that rows without an id or of one id aren't in one part."""
    return [docs.where(F.pmod(F.xxhash64(*docs.columns), F.lit(parts)) == k) for k in range(parts)] if parts > 1 else [docs]


def score(docs: DataFrame, learned: DataFrame, scratch: Scratch) -> DataFrame:
    """(doc_id, n_words, log_ppl, lang) of each row of ``docs`` (doc_id, text, lang): the mean of -log10 of its words'
    probabilities, null without words, by a model of the texts of the ids in ``learned`` (id, each once).

    All n-grams of all those texts are counted, and no table of them is gathered or broadcast: texts lie in chunks, which
    deal with shards of hashes. First the learned texts alone are learned from: a chunk says which pairs of words and
    trigrams it has; a shard adds these up, under their first two words and under their last two, and one chunk hands
    each pair on to the counts of its words. Then all texts are scored, one part after the other: a chunk asks for its
    words and pairs, and then for those trigrams alone of which both pairs were learned, as no other can have been. What
    is shuffled grows with the texts, while a chunk and a shard stay as large as they are. Steps are dropped from disk
    when they are read: while texts are scored, the shards' tables and one part's chunks, questions and answers are there.

    Learned texts are picked where they lie if ids are few (:func:`common.if_small`); else texts meet ids part by part."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = min(16, max(3, int(np.ceil(np.log2(max(1, size / SHARD_BYTES))))))
    buckets, shards = max(12, 2 * size // CHUNK_BYTES), 1 << bits
    by_shard = lambda rows: rows.repartition(shards, "shard").groupBy("shard")
    with shuffles_freed(spark):
        for k, own in enumerate(_parts(docs, 1 if learned.count() <= common.BROADCAST_ROWS else TEXT_PARTS)):
            texts = own.join(if_small(learned), F.col("doc_id") == F.col("id"), "left_semi")
            chunks = scratch.add("learned", texts.mapInArrow(lambda it, k=k: _chunks(it, k), _CHUNK), buckets, "chunk")
        for k in range(PAIR_PARTS):
            asked = chunks.mapInArrow(lambda it, k=k: _learned(it, bits, k, PAIR_PARTS), _LEARNED)
            pairs = scratch.add("pairs", by_shard(asked).applyInArrow(_pairs, _PAIRS), shards, "shard")
        asked = chunks.groupBy("chunk").cogroup(pairs.select("chunk", "shard", "first").groupBy("chunk")).applyInArrow(lambda a, b: _learned_words(a, b, bits), _LEARNED_WORDS)
        words = scratch.add("words", by_shard(asked).applyInArrow(_words, _WORDS), shards, "shard")
        tri, bi, uni = Order.of(pairs, "tri"), Order.of(pairs, "bi"), Order.of(words, "uni")
        scratch.drop("learned")
        model = scratch.add("model", pairs.where("pairs is not null").drop("chunk", "first", "tri", "bi").join(words.drop("uni"), "shard", "full"), shards, "shard")
        scratch.drop("pairs", "words")
        looked, counted, scored = model.drop("trigrams", "n_trigrams").groupBy("shard"), model.select("shard", "trigrams", "n_trigrams").groupBy("shard"), []
        for k, own in enumerate(_parts(docs, TEXT_PARTS)):
            chunks = scratch.add(f"chunks{k}", own.mapInArrow(lambda it, k=k: _chunks(it, k), _CHUNK), buckets, "chunk")
            asked = chunks.mapInArrow(lambda it: _asked(it, bits), _ASKED)
            answers = scratch.put(f"answers{k}", by_shard(asked).cogroup(looked).applyInArrow(_told, _TOLD))
            asked = chunks.groupBy("chunk").cogroup(answers.select("chunk", "shard", *_PARTS[:2]).groupBy("chunk")).applyInArrow(lambda a, b: _asked_trigrams(a, b, bits), _ASKED_TRIGRAMS)
            counts = scratch.put(f"trigrams{k}", by_shard(asked).cogroup(counted).applyInArrow(_told_trigrams, _TOLD_TRIGRAMS))
            told = answers.withColumn("step", F.lit(0)).unionByName(counts.withColumn("step", F.lit(1)), allowMissingColumns=True)
            scored.append(scratch.put(f"scores{k}", chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(lambda a, b: _scored(a, b, tri, bi, uni), SCORED)))
            scratch.drop(f"chunks{k}", f"answers{k}", f"trigrams{k}")
    scratch.drop("model")
    return reduce(DataFrame.unionAll, scored)
