"""Counts of words and runs of words over all learning texts, held by shards of hashes, and the texts' probabilities."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import textvec as tv
from loam.llm.common import flat, shuffles_freed, slices, stash, trim

#: Bytes of text whose distinct words or runs are asked for together, and of text whose words or runs a shard counts.
CHUNK_BYTES, SHARD_BYTES = 16 << 20, 16 << 20
#: What stands before a text's first word, and the end that each text has.
START, END = np.uint64(0x1D8E4E27C47D124F), np.uint64(0x5B2C9F3A8D64E117)
#: How often a word must have been seen before for what followed it to weigh as much as the words' own frequencies.
PRIOR = 100.0
#: The same for contexts of two words and of three: of the weights tried with PRIOR on check_s (README) the best on held-out texts.
LONGER = (300.0, 1.0)
_CHUNK = "chunk long, doc_id array<long>, learn array<boolean>, sizes array<int>, places binary, words binary"
_ASKED = "chunk long, shard int, keys binary, n binary"
_TOLD = "chunk long, shard int, n binary, distinct long, once long"
SCORED = "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def pack(x: np.ndarray, rising: bool = False) -> bytes:
    """Whole numbers as compressed planes of bytes; of rising ones, what each adds to the one before."""
    x = x.astype(np.uint64)
    if rising:
        x = np.diff(x, prepend=np.uint64(0))
    planes = np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8).T)
    return np.int64(len(x)).tobytes() + (pa.compress(planes.tobytes(), codec="zstd", asbytes=True) if len(x) else b"")


def unpack(raw: bytes, rising: bool = False) -> np.ndarray:
    n = int(np.frombuffer(raw[:8], np.int64)[0])
    if not n:
        return np.zeros(0, np.uint64)
    planes = np.frombuffer(pa.decompress(raw[8:], decompressed_size=8 * n, codec="zstd", asbytes=True), np.uint8)
    x = np.ascontiguousarray(planes.reshape(8, n).T).view(np.uint64).ravel()
    return np.cumsum(x, dtype=np.uint64) if rising else x


def _chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for some ``CHUNK_BYTES`` of whole texts: their distinct words and each token's place among them."""
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 32
    for batch in batches:
        buf, offs = flat(batch.column("text"))
        for lo, hi, b, o in slices(buf, offs, CHUNK_BYTES):
            h, _, _, doc = tv.words(b, o)
            sizes = np.bincount(doc, minlength=hi - lo) + 1
            tokens = np.full(len(h) + hi - lo, END)
            tokens[np.arange(len(h)) + doc] = h
            words, places = np.unique(tokens, return_inverse=True)
            one = lambda x: pa.ListArray.from_arrays(pa.array([0, hi - lo], pa.int32()), x)
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), one(batch.column("doc_id").slice(lo, hi - lo)), one(batch.column("learn").slice(lo, hi - lo)), one(pa.array(sizes.astype(np.int32))), pa.array([pack(places)], pa.binary()), pa.array([pack(words, True)], pa.binary())], ["chunk", "doc_id", "learn", "sizes", "places", "words"])
            chunk += 1


def _tokens(row: dict) -> tuple[np.ndarray, ...]:
    """(words, places, first, text) of a chunk: its distinct words, its tokens' places among them, the tokens that begin
    a text, and each token's text."""
    words, places, sizes = unpack(row["words"], True), unpack(row["places"]).astype(np.int64), np.array(row["sizes"], np.int64)
    return words, places, np.cumsum(sizes) - sizes, np.repeat(np.arange(len(sizes)), sizes)


def _grams(words: np.ndarray, places: np.ndarray, first: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, at): the distinct runs of ``order`` tokens, ascending, and the place there of the run that ends at each
    token; START stands before a text as often as needed."""
    if order == 1:
        return words, places
    key = own = words[places]
    pad = np.array([START])
    for _ in range(order - 1):
        key = np.concatenate([pad, key[:-1]])
        key[first] = pad
        key, pad = tv.join2(key, own), tv.join2(pad, np.array([START]))
    return np.unique(key, return_inverse=True)


def _asked(batches: Iterable[pa.RecordBatch], bits: int, order: int) -> Iterator[pa.RecordBatch]:
    """For each chunk and shard the chunk's runs of ``order`` tokens of that shard, with their counts in its learning texts."""
    edges = np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits)
    for batch in batches:
        for row in batch.to_pylist():
            words, places, first, text = _tokens(row)
            keys, at = _grams(words, places, first, order)
            n = np.bincount(at[np.array(row["learn"], bool)[text]], minlength=len(keys))
            cuts = np.append(np.searchsorted(keys, edges), len(keys))
            used = np.flatnonzero(np.diff(cuts) > 0)
            parts = [[pack(x[cuts[s] : cuts[s + 1]], k == 0) for s in used] for k, x in enumerate((keys, n))]
            yield pa.RecordBatch.from_arrays([pa.array([row["chunk"]] * len(used), pa.int64()), pa.array(used.astype(np.int32)), *(pa.array(p, pa.binary()) for p in parts)], ["chunk", "shard", "keys", "n"])
            del words, places, first, text, keys, at, n, parts
            trim()


def _told(rows: pa.Table) -> pa.Table:
    """A shard's answers: the counts over all learning texts of what each chunk asked for, in its order; on the first
    row also how many distinct ones of the shard were learned, and how many of them once."""
    keys = [unpack(x, True) for x in rows.column("keys").to_pylist()]
    seen = np.concatenate([unpack(x) for x in rows.column("n").to_pylist()]).astype(np.float64)
    found, back = np.unique(np.concatenate(keys), return_inverse=True)
    sums = np.bincount(back, weights=seen, minlength=len(found)).astype(np.uint64)
    told = [pack(x) for x in np.split(sums[back], np.cumsum([len(k) for k in keys])[:-1])]
    first = lambda x: pa.array([int(x)] + [0] * (rows.num_rows - 1), pa.int64())
    return pa.table([rows.column("chunk"), rows.column("shard"), pa.array(told, pa.binary()), first((sums > 0).sum()), first((sums == 1).sum())], ["chunk", "shard", "n", "distinct", "once"])


def _scored(chunk: pa.Table, told: pa.Table, total: int, texts: int, distinct: int, once: int, weights: tuple[float, ...]) -> pa.Table:
    row, told = chunk.to_pylist()[0], told.sort_by([("order", "ascending"), ("shard", "ascending")])
    words, places, first, text = _tokens(row)
    orders, answers = told.column("order").to_pylist(), told.column("n").to_pylist()

    def counts(order: int) -> np.ndarray:
        """How often the run of ``order`` tokens that ends at each token was learned."""
        got = np.concatenate([unpack(x) for x, k in zip(answers, orders, strict=True) if k == order]).astype(np.float64)
        return got[_grams(words, places, first, order)[1]]

    n, unseen, each = len(row["sizes"]), max(1, once), counts(1)
    base = np.log10((each + 1) / (total + distinct + 1))
    chance, last = np.where(each > 0, each, unseen) / (total + unseen), each
    for order, weight in enumerate(weights, 2):
        before = np.concatenate([[0], last[:-1]])
        before[first] = texts
        last = counts(order)
        chance = (last + weight * chance) / (before + weight)
    by_text = lambda x: np.bincount(text, weights=x, minlength=n)
    out = pa.table([
        pa.array(row["doc_id"], pa.int64()), pa.array(row["sizes"], pa.int64()), pa.array(by_text(each > 0).astype(np.int64)), pa.array([total] * n, pa.int64()),
        pa.array(by_text(base)), pa.array(by_text(np.log10(chance)))], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])
    trim()
    return out


def score(docs: DataFrame, learn, weight: float = PRIOR, longer: tuple[float, ...] = ()) -> DataFrame:
    """(doc_id, n_tokens, n_known, train_tokens, base_score, score) of each text, learning from ``docs.where(learn)``.

    Tokens are words, A-Z lower-cased, and one end. base_score is their add-one unigram log10 probability. score is the
    log10 probability of a model of runs of words: a token w after v (or after nothing, at a text's start) has the chance
    (c(vw) + weight p(w)) / (c(v) + weight), with p(w) = c(w) / (N + U), and U / (N + U) for all words without a count
    together, U being the words learned once (1 at least). ``longer`` has the weights for contexts of two words, three
    and so on: after uv the chance is (c(uvw) + weight p(w after v)) / (c(uv) + weight), and so forth. Chances after each
    context add up to 1.

    All counts are over all learning texts, every word and run of them. Neither is held whole anywhere: texts ask, in
    chunks, for the counts of their distinct words, then of their pairs, and so on; a shard of hashes adds up what the
    chunks of learning texts hold of each and answers in the order of the question. What is shuffled grows with the
    texts, the questions of one length at a time, and a shard and a chunk stay as large as they are; there are more of
    both.

    Null or empty text: an end alone. Null doc_id: scored; learned from only if ``learn`` says so. Repeated rows: each
    scored and counted. No learning texts: train_tokens 0, and all is unseen. Very long text: whole. Other columns:
    ignored."""
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    chunks = stash(base.mapInArrow(_chunks, _CHUNK), "chunks")
    size = base.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = max(3, int(np.ceil(np.log2(max(1, size / SHARD_BYTES)))))
    weights, answers = (weight, *longer), []
    with shuffles_freed(docs.sparkSession):
        for order in range(1, len(weights) + 2):
            asked = chunks.mapInArrow(lambda it, k=order: _asked(it, bits, k), _ASKED).repartition(1 << bits, "shard")
            answers.append(stash(asked.groupBy("shard").applyInArrow(_told, _TOLD), "counts"))
    distinct, once = (x or 0 for x in answers[0].agg(F.sum("distinct"), F.sum("once")).first())
    told = reduce(DataFrame.unionAll, [x.select("chunk", "shard", F.lit(k).alias("order"), "n") for k, x in enumerate(answers, 1)])
    each = chunks.select("chunk", F.explode(F.arrays_zip("learn", "sizes")).alias("x"))
    n, total, texts = chunks.count(), *(x or 0 for x in each.where("x.learn").agg(F.sum("x.sizes"), F.count("*")).first())
    both = [x.repartition(max(1, n), "chunk").groupBy("chunk") for x in (chunks, told)]
    return both[0].cogroup(both[1]).applyInArrow(lambda a, b: _scored(a, b, total, texts, distinct, once, weights), SCORED)
