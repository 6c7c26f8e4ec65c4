"""Spelling variants: words one edit apart, found by automata over their halves."""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import BROADCAST_ROWS, Scratch, texts_of

#: What a word is made of, and the letters that are lowered.
LETTERS = "A-Za-z\u00c0-\u00ff"
UPPER, LOWER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"
#: Distinct words that a task counts before it passes them on.
HELD = 200_000
#: Words whose segments an automaton shard holds, and pairs that are compared at a time.
SHARD, TILE = 50_000, 1 << 20
#: Up to so many pairs of a segment are compared as strings.
FEW = 24
_NEAR = "word string, n_near long, best_n long, best string"


def _count(batches: Iterable[pa.RecordBatch], least: int, every: int) -> Iterator[pa.RecordBatch]:
    run, lower = re.compile(f"[{LETTERS}]{{{least},}}"), bytes.maketrans(UPPER, LOWER)
    counts: dict[str, int] = defaultdict(int)

    def given() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])

    for batch in batches:
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
            start = zlib.crc32(f"{'' if doc is None else doc}:".encode())
            for word in run.findall(text.as_buffer().to_pybytes().translate(lower).decode()):
                h = zlib.crc32(word.encode(), start)
                if h % every == 0:
                    at = h % len(word)
                    word = word[:at] + word[at + 1 :]
                    if len(word) < least:
                        continue
                counts[word] += 1
            if len(counts) > HELD:
                yield given()
                counts.clear()
    yield given()


def words_of(docs: DataFrame, least: int, every: int) -> DataFrame:
    """(word, n): how often each word of ``least`` or more code points stands in the texts. A word is a maximal run of
    letters, A-Z lowered; with h = crc32 of ``<doc_id>:<run>``, it loses the code point h % length if ``every`` divides h.
    Tasks count up to ``HELD`` distinct words before they give them on to be summed."""
    part = texts_of(docs).mapInArrow(lambda it: _count(it, least, every), "word string, n long")
    return part.groupBy("word").agg(F.sum("n").alias("n"))


def _affix(kind: int, word: Column, length: Column) -> Column:
    """What a word and all words of one edit less, as many or one more code points have in common at least, if their
    first (kind 0) or second (kind 1) segment is untouched: ``length`` is the scanned word's."""
    return F.substring(word, F.lit(1), F.floor((length - 1) / 2).cast("int")) if kind == 0 else F.substring(word, -F.floor(length / 2).cast("int"), F.floor(length / 2).cast("int"))


def _keys(words: DataFrame, lengths: Column) -> DataFrame:
    each = words.withColumn("length", F.explode(lengths))
    both = [each.withColumn("kind", F.lit(k)).withColumn("key", F.xxhash64(F.lit(k), "length", _affix(k, F.col("word"), F.col("length")))) for k in (0, 1)]
    return both[0].unionAll(both[1])


class Shard:
    """The segments of some words in one automaton: ``scan`` gives, for each scanned word, its near words among them."""

    def __init__(self, patterns: Iterable[tuple[int, int, str, int]]):
        self.owners: dict[tuple[int, str, int], list[tuple[str, int]]] = defaultdict(list)
        self.coded: dict[tuple[int, str, int, int], np.ndarray] = {}
        self.found = ahocorasick.Automaton()
        for kind, length, word, n in patterns:
            half = len(word) // 2
            segment = word[half:] if kind else word[:half]
            self.owners[kind, segment, length].append((word, n))
            self.found.add_word(segment, segment)
        if len(self.found):
            self.found.make_automaton()

    def scan(self, words: Iterable[tuple[int, str]]) -> Iterator[tuple[str, str, int]]:
        """(word, near word, its n) for scanned (kind, word): each pair by its first segment, or else by its second."""
        asked: dict[tuple[int, str, int], list[str]] = defaultdict(list)
        for kind, word in words if len(self.found) else ():
            for end, segment in self.found.iter(word):
                # a first segment stands at the start, a second one at the end
                if (end + 1 == len(word)) if kind else (end + 1 == len(segment)):
                    if (kind, segment, len(word)) in self.owners:
                        asked[kind, segment, len(word)].append(word)
        for key, probes in asked.items():
            kind, segment, _ = key
            by_length = defaultdict(list)
            for word, n in self.owners[key]:
                by_length[len(word)].append((word, n))
            for owners in by_length.values():
                for p, (word, n) in self._near(kind, len(segment), probes, owners):
                    if not kind or word[: len(word) // 2] != p[: len(word) // 2]:
                        yield p, word, n

    def _near(self, kind: int, cut: int, probes: list[str], owners: list[tuple[str, int]]) -> Iterator[tuple[str, tuple[str, int]]]:
        rest = (lambda x: x[:-cut]) if kind else (lambda x: x[cut:])
        if len(probes) * len(owners) <= FEW:
            for p in probes:
                a = rest(p)
                yield from ((p, o) for o in owners if one_edit(a, rest(o[0])))
            return
        a, b = _coded([rest(p) for p in probes]), _coded([rest(o[0]) for o in owners])
        step = max(1, TILE // len(b))
        for lo in range(0, len(a), step):
            hit = edits(a[lo : lo + step], b)
            for i, j in zip(*np.nonzero(hit), strict=True):
                yield probes[lo + i], owners[j]


def _coded(texts: list[str]) -> np.ndarray:
    """Texts of one length as a matrix of their code points, which fit in a byte."""
    return np.frombuffer("".join(texts).encode("latin-1"), np.uint8).reshape(len(texts), -1)


def one_edit(a: str, b: str) -> bool:
    """Whether ``a`` and ``b`` differ by exactly one inserted, deleted or replaced code point."""
    if a == b:
        return False
    if len(a) > len(b):
        a, b = b, a
    k = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), len(a))
    return a[k + 1 :] == b[k + 1 :] if len(a) == len(b) else len(a) + 1 == len(b) and a[k:] == b[k + 1 :]


def edits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """:func:`one_edit` of all rows of ``a`` with all of ``b``; the rows of each have one length."""
    n, m = a.shape[1], b.shape[1]
    if n == m:
        off = np.zeros((len(a), len(b)), np.uint8)
        for k in range(n):
            off += a[:, k, None] != b[None, :, k]
        return off == 1
    if n < m:
        return edits(b, a).T
    ahead, same = np.zeros((len(a), len(b)), np.uint8), np.ones((len(a), len(b)), bool)
    for k in range(m):
        same &= a[:, k, None] == b[None, :, k]
        ahead += same
    behind, same = np.zeros_like(ahead), np.ones_like(same)
    for k in range(m):
        same &= a[:, n - 1 - k, None] == b[None, :, m - 1 - k]
        behind += same
    return ahead.astype(np.int16) + behind >= m


def _match(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a shard, its words (n > 0) first, then the scanned ones: (word, n_near, best_n, best) of those."""
    held, shard, now, asked = [], None, None, []
    for batch in batches:
        for number, kind, length, word, n in zip(*(batch.column(c).to_pylist() for c in ("shard", "kind", "length", "word", "n")), strict=True):
            if number != now or len(asked) >= SHARD:
                if asked:
                    yield _best(shard.scan(asked))
                    asked = []
            if number != now:
                held, shard, now = [], None, number
            if n > 0:
                held.append((kind, length, word, n))
                continue
            if shard is None:
                shard, held = Shard(held), []
            asked.append((kind, word))
    if asked:
        yield _best(shard.scan(asked))


def _best(pairs: Iterable[tuple[str, str, int]]) -> pa.RecordBatch:
    count: dict[str, int] = defaultdict(int)
    best: dict[str, tuple[int, str]] = {}
    for word, near, n in pairs:
        count[word] += 1
        best[word] = min(best.get(word, (1, "")), (-n, near))
    return pa.RecordBatch.from_arrays(
        [pa.array(list(count), pa.string()), pa.array(list(count.values()), pa.int64()), pa.array([-best[w][0] for w in count], pa.int64()), pa.array([best[w][1] for w in count], pa.string())], ["word", "n_near", "best_n", "best"]
    )


def near_words(scratch: Scratch, words: DataFrame, least: int) -> DataFrame:
    """(word, n_near, best_n, best): of each word (word, n) with a near one, how many it has and that of the largest n
    (ties: the smallest in code-point order).

    Of two words one edit apart, one has its first or its second segment untouched in the other, at its start or its end.
    Both segments of every word go to automaton shards, and every word is scanned by the shards that can hold a segment
    at its start and at its end: those of the ends that all words of its length, one less or one more share with it. Ends
    that more than ``SHARD`` words share are split over several shards, and words with such an end are scanned by each."""
    size = F.length("word")
    patterns = _keys(words, F.filter(F.array(size - 1, size, size + 1), lambda x: x >= least))
    scanned = _keys(words.select("word", F.lit(0).cast("long").alias("n")), F.array(size))
    counts = scratch.put("ends", patterns.groupBy("key").agg(F.count("*").alias("m")))
    total = counts.agg(F.coalesce(F.sum("m"), F.lit(0))).first()[0]
    shards = max(1, -(-total // SHARD))
    # at most one in SHARD / 2 pattern rows, but counted all the same
    hot = counts.where(F.col("m") > SHARD).select("key", F.ceil(F.col("m") / SHARD).cast("int").alias("parts"))
    hot = F.broadcast(hot) if total // SHARD <= BROADCAST_ROWS else hot
    parts = F.coalesce("parts", F.lit(1))
    held = patterns.join(hot, "key", "left").withColumn("part", F.pmod(F.xxhash64("word"), parts).cast("int"))
    asks = scanned.join(hot, "key", "left").withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1)))
    both = held.unionByName(asks).select(F.pmod(F.xxhash64("key", "part"), F.lit(shards)).cast("int").alias("shard"), "kind", "length", "word", "n")
    found = both.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", F.col("n") == 0).mapInArrow(_match, _NEAR)
    best = F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best").alias("word"))).alias("b")
    return found.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", (-F.col("b.minus")).alias("best_n"), F.col("b.word").alias("best"))


def variants(docs: DataFrame, least: int = 7, often: int = 2, times: int = 10, every: int = 31) -> DataFrame:
    """(word, form, root, n, n_near, form_n): the distinct words of ``least`` or more code points that occur ``often`` or
    more times in all texts, each with the near word that it is a variant of, if that one occurs ``times`` as often,
    and the word at which following the forms ends (itself without a form).

    Words and their counts: :func:`words_of`. Forms grow tenfold at each step, so that doubling the steps ends
    after very few rounds. Null or empty text: no words. Null doc_id: hashed as empty. Repeated rows: counted each. Very
    long texts: whole. Empty table: no rows. Other columns: ignored."""
    scratch = Scratch(docs.sparkSession, "spelling")
    words = scratch.put("words", words_of(docs, least, every).where(F.col("n") >= often))
    near = near_words(scratch, words, least)
    form = F.when(F.col("best_n") >= times * F.col("n"), F.col("best"))
    told = scratch.put("forms", words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), form.alias("form"), F.when(form.isNotNull(), F.col("best_n")).alias("form_n")))
    scratch.drop("ends")
    roots, step = told.where("form is not null").select("word", F.col("form").alias("root")), 0
    while True:
        step += 1
        ahead = roots.join(roots.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        ahead = scratch.put(f"roots-{step}", ahead.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        roots = ahead.drop("moved")
        if ahead.where("moved").isEmpty():
            break
    return told.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


ORACLE = f"""
with recursive r as (select doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{UPPER.decode()}', '{LOWER.decode()}') as run from documents where text is not null),
b as (select run, flatten(list_transform(string_split(coalesce(doc_id::varchar, '') || ':' || run, ''), lambda c: case when unicode(c) < 128 then [unicode(c)] else [192 + (unicode(c) >> 6), 128 + (unicode(c) & 63)] end)) as bytes from r where length(run) >= 7),
h as (select run, xor(4294967295::ubigint, list_reduce(list_concat([4294967295::ubigint], list_transform(bytes, lambda x: x::ubigint)),
             lambda a, b: list_reduce(list_concat([xor(a, b)], list_transform(range(8), lambda i: 0::ubigint)), lambda y, z: xor(y >> 1, (y & 1) * 3988292384)))) as h from b),
t as (select case when h % 31 = 0 then substr(run, 1, (h % length(run))::bigint) || substr(run, (h % length(run))::bigint + 2) else run end as word from h),
w as (select word, count(*) as n from t where length(word) >= 7 group by word having count(*) >= 2),
d as (select word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) as less from (select *, unnest(range(1, length(word) + 1)) as i from w)),
e as (select distinct a.word, b.word as near, b.n as near_n from d a join d b on a.less = b.less and a.i = b.i and a.word <> b.word
      union select distinct d.word, w.word, w.n from d join w on w.word = d.less union select distinct w.word, d.word, d.n from d join w on w.word = d.less),
g as (select word, count(*) as n_near, max(near_n) as best_n from e group by word),
f as (select w.word, w.n, coalesce(g.n_near, 0) as n_near, case when g.best_n >= 10 * w.n then (select min(e.near) from e where e.word = w.word and e.near_n = g.best_n) end as form, case when g.best_n >= 10 * w.n then g.best_n end as form_n from w left join g on g.word = w.word),
s as (select word, word as root, 0 as k from f union all select s.word, f.form, s.k + 1 from s join f on f.word = s.root where f.form is not null)
select f.word, f.form, (select arg_max(s.root, s.k) from s where s.word = f.word) as root, f.n, f.n_near, f.form_n from f"""
