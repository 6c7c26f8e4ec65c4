"""Toxicity by maximum-scoring segments of token log-odds."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import textvec as tv
from loam.llm.common import Scratch, flat, slices, texts_of

#: Labelled rows that the model is fitted on at most; more are thinned by the hash of doc_id.
LABELLED = 200_000
#: Tokens of the log-odds table that tasks are sent at a time. A larger table goes over the texts part by part.
TOKENS = 500_000
#: Units of a word: the whole, and its first so many bytes where it is longer, as languages compound.
PREFIXES = (5, 6, 7, 8)
#: The score of a word without sure units: long clean stretches part passages.
UNSEEN = -0.1
#: Standard deviations by which log-odds must differ from 0 to count.
SURE = 3.0
#: Total weight of the Dirichlet prior, in tokens, beside half a token for each.
PRIOR = 1_000.0
#: A passage is significant below this chance of its score in as long a text.
SIGNIFICANT = 0.01
FEATURES = 3


def letters(buf: np.ndarray) -> np.ndarray:
    """The bytes with what is neither a letter, a digit nor beyond ASCII as spaces: words without their punctuation."""
    keep = np.zeros(256, np.uint8)
    keep[128:] = np.arange(128, 256)
    for lo, hi in ((48, 58), (65, 91), (97, 123)):
        keep[lo:hi] = np.arange(lo, hi)
    keep[keep == 0] = 32
    return keep[buf]


@dataclass(frozen=True)
class Model:
    tokens: np.ndarray
    odds: np.ndarray
    sure: np.ndarray
    unseen: float
    lam: float
    k: float
    weights: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    #: A table of more than ``TOKENS`` rows (token, odds, sure, part) and its number of parts; ``tokens`` is empty then.
    large: DataFrame | None = None
    parts: int = 0


def segments(x: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) of a sequence, in linear time: each newly positive stretch
    is merged with earlier ones as long as that raises their score."""
    out: list[tuple[int, int, float, float]] = []  # first, stop, sum before it, sum at its end
    total = 0.0
    for i, v in enumerate(x.tolist()):
        before = total
        total += v
        if v <= 0:
            continue
        first, left, right = i, before, total
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= left:
                j -= 1
            if j < 0 or out[j][3] >= right:
                break
            first, left = out[j][0], out[j][2]
            del out[j:]
        out.append((first, i + 1, left, right))
    return [(a, b, r - lo) for a, b, lo, r in out]


def stretches(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, starts) of runs of one sign: maximal segments never end within one."""
    if not len(x):
        return x, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate([[True], (x[1:] > 0) != (x[:-1] > 0)]))
    return np.add.reduceat(x, starts), starts


def evidence(x: np.ndarray, lam: float, k: float) -> tuple[np.ndarray, list[tuple[int, int, float]]]:
    """Features of one text and its significant passages. A score s in a text of n tokens is reached by chance with
    1 - exp(-k n exp(-lam s)), the extreme-value law of maximal segments; passages count as lam s - ln(k n)."""
    n = max(1, len(x))
    sums, starts = stretches(x)
    ends = np.append(starts[1:], len(x))
    floor = np.log(k * n)
    found = [(int(starts[a]), int(ends[b - 1]), lam * s - floor) for a, b, s in segments(sums)]
    strong = [f for f in found if -np.expm1(-np.exp(-f[2])) < SIGNIFICANT]
    best = max((f[2] for f in found), default=-floor)
    return np.array([best, sum(f[2] for f in strong), len(strong)]), strong


def law(odds: np.ndarray, share: np.ndarray) -> tuple[float, float]:
    """lam and k of the extreme-value law: the positive root of sum(share * exp(lam * odds)) = 1 and, for scores with no
    common step, k = lam * (mean score under the tilted shares) as its usual bound."""
    lo, hi = 1e-6, 1.0
    total = lambda v: float((share * np.exp(np.minimum(v * odds, 500))).sum())
    while total(hi) < 1 and hi < 1e3:
        hi *= 2
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if total(mid) < 1 else (lo, mid)
    tilted = share * np.exp(np.minimum(lo * odds, 500))
    return lo, min(1.0, max(1e-4, lo * float((tilted * odds).sum()) / max(tilted.sum(), 1e-12)))


def units(buf: np.ndarray, offs: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """For each unit of every word its hash (0 where the word is too short for it), and the words' texts."""
    buf = letters(buf)
    h, start, end, doc = tv.words(buf, offs)
    up, down = tv.powers(len(buf) + 1)
    out = [h]
    with np.errstate(over="ignore"):
        acc = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(tv.BYTE_LOWER[buf] * up[: len(buf)], dtype=np.uint64, out=acc[1:])
        for k in PREFIXES:
            stop = np.minimum(start + k, end)
            out.append(np.where(end - start > k, tv.mix((acc[stop] - acc[start]) * down[start] + np.uint64(1000 + k)), np.uint64(0)))
    return out, doc


def _odds(buf: np.ndarray, offs: np.ndarray, model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The score of each word, that of its surest unit (of equally sure ones the higher), how sure it is (0: no unit is
    in the table), and where each text's words begin."""
    found, doc = units(buf, offs)
    x, sure = np.full(len(doc), model.unseen), np.zeros(len(doc))
    for h in found if len(model.tokens) else ():
        at = np.minimum(np.searchsorted(model.tokens, h), len(model.tokens) - 1)
        x, sure = _surer(x, sure, model.odds[at], np.where(model.tokens[at] == h, model.sure[at], 0.0))
    return x, sure, np.searchsorted(doc, np.arange(len(offs)))


def _surer(x: np.ndarray, sure: np.ndarray, other: np.ndarray, by: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    better = (by > sure) | ((by == sure) & (by > 0) & (other > x))
    return np.where(better, other, x), np.where(better, by, sure)


def _words(batch: pa.RecordBatch, model: Model) -> Iterator[tuple[int, int, list[np.ndarray]]]:
    """(first, last + 1, word scores of each text) of a batch's rows: by the table, or as ``_placed`` has found them."""
    if "x" in batch.schema.names:
        x, offs = batch.column("x").flatten().to_numpy(), batch.column("x").offsets.to_numpy()
        offs = offs - offs[0] if len(offs) else offs
        yield 0, batch.num_rows, [x[offs[i] : offs[i + 1]] for i in range(batch.num_rows)]
        return
    buf, offs = flat(batch.column("text"))
    for lo, hi, b, o in slices(buf, offs):
        x, _, ends = _odds(b, o, model)
        yield lo, hi, [x[ends[i] : ends[i + 1]] for i in range(len(o) - 1)]


def _update(batches: Iterable[pa.RecordBatch], part: Model) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, text, x, sure) with the words' scores by one part of the table more; null x: no part yet."""
    doubles = pa.list_(pa.float64())
    for batch in batches:
        buf, offs = flat(batch.column("text"))
        old = [batch.column(c) for c in ("x", "sure")]
        for lo, hi, b, o in slices(buf, offs):
            x, sure, ends = _odds(b, o, part)
            if old[0].null_count == 0:
                x, sure = _surer(*(c.slice(lo, hi - lo).flatten().to_numpy() for c in old), x, sure)
            lists = [pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(v)).cast(doubles) for v in (x, sure)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(lo, hi - lo), batch.column("text").slice(lo, hi - lo), *lists], ["doc_id", "text", "x", "sure"])


def _placed(docs: DataFrame, model: Model) -> tuple[DataFrame, Model]:
    """``docs`` (doc_id, text) ready for ``_words``, and the model without its large table. Parts of that go over the texts
    one after the other, each on what the former wrote, so a task holds one part only and no unit is left out."""
    if model.large is None:
        return docs, model
    bare = replace(model, large=None)
    rows = docs.select("doc_id", "text", F.lit(None).cast("array<double>").alias("x"), F.lit(None).cast("array<double>").alias("sure"))
    scratch = Scratch(docs.sparkSession, "toxic-words")
    for i in range(model.parts):
        part = replace(bare, **_arrays(model.large.where(F.col("part") == i)))
        rows = scratch.put(str(i), rows.mapInArrow(lambda it, part=part: _update(it, part), "doc_id long, text string, x array<double>, sure array<double>"))
        if i:
            scratch.drop(str(i - 1))
    return rows.select("doc_id", "x"), bare


def _arrays(rows: DataFrame) -> dict[str, np.ndarray]:
    """A table or a part of it, by token; some ``TOKENS`` rows."""
    found = rows.select("token", "odds", "sure").toPandas()
    tokens = found.token.to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(tokens)
    return {"tokens": tokens[order], "odds": found.odds.to_numpy(np.float64)[order], "sure": found.sure.to_numpy(np.float64)[order]}


def _features(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column("doc_id")
        for lo, hi, texts in _words(batch, model):
            rows, spans = [], []
            for x in texts:
                f, strong = evidence(x, model.lam, model.k)
                rows.append(f)
                spans.append([{"first": s, "stop": e, "score": v} for s, e, v in strong])
            z = (np.array(rows).reshape(-1, FEATURES) - model.mean) / model.scale
            p = 1 / (1 + np.exp(-np.clip(z @ model.weights[:-1] + model.weights[-1], -50, 50)))
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo), pa.array(p), pa.array([r.tolist() for r in rows], pa.list_(pa.float64())), pa.array(spans, pa.list_(pa.struct([("first", pa.int64()), ("stop", pa.int64()), ("score", pa.float64())])))],
                ["doc_id", "score", "features", "passages"])


SCORED = "doc_id long, score double, features array<double>, passages array<struct<first:long,stop:long,score:double>>"


def _counts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Token counts by label, added up within each batch."""
    for batch in batches:
        label = batch.column("label").to_numpy()
        buf, offs = flat(batch.column("text"))
        got = []
        for lo, _, b, o in slices(buf, offs):
            found, doc = units(b, o)
            for h in found:
                for y in (0, 1):
                    t, c = np.unique(h[(label[lo + doc] == y) & (h != 0)], return_counts=True)
                    got.append((t, np.full(len(t), y), c))
        t, y, c = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.uint64), np.zeros(0, int), np.zeros(0, int))
        yield pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(np.where(y == 0, c, 0).astype(np.int64)), pa.array(np.where(y == 1, c, 0).astype(np.int64))], ["token", "c0", "c1"])


def _scores(batches: Iterable[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """How many words have each score."""
    for batch in batches:
        for _, _, texts in _words(batch, model):
            x, n = np.unique(np.concatenate([np.zeros(0), *texts]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(x), pa.array(n.astype(np.int64))], ["x", "n"])


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Newton's steps for a logistic regression with an intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * len(x) * np.eye(len(w)) * 1e-3 + 1e-9 * np.eye(len(w)), x.T @ (y - p) - ridge * 1e-3 * len(x) * w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-9:
            break
    return w


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """A model of ``docs`` (doc_id, text) with ``labels`` (doc_id, toxic). At most ``most`` labelled rows are used; the
    two classes need not be of one size. Token log-odds have a Dirichlet prior in proportion to the token's share of
    all labelled text and are shrunk by their own uncertainty; the weights of the passages' features are fitted on
    half of the labelled rows whose tokens weren't counted, so that they hold for texts not seen.
    Labels that are null or neither 0 nor 1, null doc_ids and labels without a document: ignored. No labels, or one
    class only: scores near 0, or the share of that class."""
    known = labels.where("doc_id is not null and toxic in (0, 1)").groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.max("toxic").cast("int").alias("label"))
    n = known.count()
    if n > most:
        known = known.where(F.pmod(F.xxhash64("id"), F.lit(1_000_000)) < int(1_000_000 * most / n))
    blank, steps = (np.zeros(FEATURES + 1), np.zeros(FEATURES), np.ones(FEATURES)), Scratch(docs.sparkSession, "toxic")
    known = steps.put("labels", known)
    pick = F.broadcast(known)  # ``most`` rows of two numbers at most
    train = steps.put("train", texts_of(docs.where("doc_id is not null")).join(pick, F.col("doc_id") == F.col("id")).select("doc_id", "text", "label", (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(2)) == 0).alias("counted")))

    def table(rows: DataFrame, tag: str) -> Model:
        counts = rows.select("text", "label").mapInArrow(_counts, "token long, c0 long, c1 long").groupBy("token").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
        counts = steps.put(tag, counts)
        n0, n1 = (int(v or 0) for v in counts.agg(F.sum("c0"), F.sum("c1")).first())
        none = Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), UNSEEN, 1.0, 0.1, *blank)
        if not n0 or not n1:
            return none
        prior = 0.5 + F.lit(PRIOR) * (F.col("c0") + F.col("c1")) / (n0 + n1)
        odds = F.log((F.col("c1") + prior) / (n1 + PRIOR)) - F.log((F.col("c0") + prior) / (n0 + PRIOR))
        sure = odds / F.sqrt(1 / (F.col("c1") + prior) + 1 / (F.col("c0") + prior))
        # a token that is rarer than its doubt tells nothing; the odds shrink by their own doubt, and all other units are
        # one small loss
        rows = counts.withColumn("odds", odds).withColumn("sure", F.abs(sure)).where(F.col("sure") > SURE).withColumn("odds", F.col("odds") * (1 - F.lit(SURE**2) / (F.col("sure") * F.col("sure"))) + UNSEEN)
        n = rows.count()
        if n <= TOKENS:
            return replace(none, **_arrays(rows))
        parts = -(-n // TOKENS)
        return replace(none, large=steps.put(tag + "-parts", rows.select("token", "odds", "sure", F.pmod(F.xxhash64("token"), F.lit(parts)).alias("part"))), parts=parts)

    draft = table(train.where("counted"), "tokens")
    clean, bare = _placed(train.where("counted and label = 0").select("doc_id", "text"), draft)
    shares = clean.mapInArrow(lambda it: _scores(it, bare), "x double, n long").groupBy("x").agg(F.sum("n").alias("n")).toPandas()
    if len(shares):  # as many rows as the table has values at most
        draft = replace(draft, **dict(zip(("lam", "k"), law(shares.x.to_numpy(), shares.n.to_numpy() / shares.n.sum()), strict=True)))
    others, bare = _placed(train.where("not counted").select("doc_id", "text"), draft)
    rest = others.mapInArrow(lambda it: _features(it, bare), SCORED).select("doc_id", "features").join(pick, F.col("doc_id") == F.col("id"))
    seen = rest.select("features", "label").toPandas()  # FEATURES numbers for each of at most ``most`` rows
    if not len(seen):
        return replace(table(train, "all-tokens"), weights=np.array([0.0] * FEATURES + [-10.0]))
    x, y = np.array(seen.features.tolist()), seen.label.to_numpy().astype(float)
    mean, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-9)
    return replace(draft, weights=_logistic((x - mean) / scale, y), mean=mean, scale=scale)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, score, features, passages): the chance that a text is toxic, and its significant passages by token.

    A linear-time scan finds every maximal segment of the tokens' log-odds; an extreme-value law gives each its
    significance in a text of that length, and a logistic of the best and of all significant ones the score.
    Null, empty or wordless text: the score of no evidence, no passages. Null doc_id: scored. Repeated rows: each
    scored. Empty table: no rows. Very long text: whole."""
    rows, bare = _placed(texts_of(docs), model)
    return rows.mapInArrow(lambda it: _features(it, bare), SCORED)


def held_out(doc_id: str = "doc_id", parts: int = 5, part: int = 0):
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts == part


def report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of all texts, by a model of the labelled rows that aren't held out.

    Nulls, repeated rows, empty and long texts, empty tables: as in ``fit`` and ``score``; a null doc_id has a null
    held_out."""
    model = fit(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
