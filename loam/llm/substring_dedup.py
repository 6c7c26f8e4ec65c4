"""Removal of repeated byte strings by longest-previous-factor arrays over suffixes in order."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm import textvec as tv
from loam.llm.common import flat, if_small, slices, stash, texts_of

LENGTH = 100
#: Bytes of an anchor: each string of LENGTH bytes is keyed by the least hash of its substrings of this length.
ANCHOR = 20
#: Segments that are put in suffix order together.
CHUNK_ROWS = 20_000
U = np.uint64
#: Low bits that hold a place in a slice (4 GB at most).
PLACE = U(0xFFFFFFFF)
_ROW = ["h", "doc", "a", "n"]


def anchors(buf: np.ndarray, offs: np.ndarray, length: int, width: int) -> tuple[np.ndarray, ...]:
    """(text, hash, context, a, n) of each anchor: the hash of its bytes; a hash of all bytes of the strings that it
    keys; the first of these strings' start in the text and their number."""
    reach = length - width + 1
    h = tv.windows(buf, width)
    bits = PLACE
    # the place fills the low 32 bits whatever the slice's length, and the leftmost of equal leading bits wins: which
    # substring of a string is its anchor depends on the string alone
    low = tv.sliding_min((h & ~bits) | np.arange(len(h), dtype=U), reach)
    size = np.diff(offs)
    stop = np.repeat(offs[1:], size)[: len(low)]
    s = np.flatnonzero(np.arange(length, length + len(low)) <= stop)
    if not len(s):
        return tuple(np.zeros(0, np.int64) for _ in range(5))
    p = (low[s] & bits).astype(np.int64)
    cut = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (s[1:] != s[:-1] + 1)]))
    first, count, p = s[cut], np.diff(np.append(cut, len(s))), p[cut]
    text = np.searchsorted(offs, first, side="right") - 1
    up, down = tv.powers(len(buf) + 1)
    with np.errstate(over="ignore"):
        acc = np.zeros(len(buf) + 1, U)
        np.cumsum(tv.BYTE[buf] * up[: len(buf)], dtype=U, out=acc[1:])
        ctx = tv.mix((acc[first + count + length - 1] - acc[first]) * down[first] + (count * 4096 + p - first).astype(U))
    return text, h[p], ctx, first - offs[text], count


def _anchors(batches: Iterable[pa.RecordBatch], length: int, width: int) -> Iterator[pa.RecordBatch]:
    """The anchors of the texts of each batch. Of those with one hash and one context, all but the first are known to
    be repeats and travel under keys of their own, so a hot anchor reaches its task about once per batch."""
    for batch in batches:
        ids, (buf, offs) = batch.column("doc_id").to_numpy(), flat(batch.column("text"))
        parts = []
        for lo, _, b, o in slices(buf, offs):
            if len(b) >= length:
                text, *rest = anchors(b, o, length, width)
                parts.append((ids[lo + text], *rest))
        if not parts:
            continue
        doc, h, ctx, a, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((a, doc, ctx, h))
        doc, h, ctx, a, n = (x[order] for x in (doc, h, ctx, a, n))
        again = np.zeros(len(h), bool)  # a row of the same doc_id and place: the row was there twice
        twin = np.zeros(len(h), bool)
        twin[1:] = (h[1:] == h[:-1]) & (ctx[1:] == ctx[:-1])
        again[1:] = twin[1:] & (doc[1:] == doc[:-1]) & (a[1:] == a[:-1])
        doc, h, ctx, a, n, twin = (x[~again] for x in (doc, h, ctx, a, n, twin))
        with np.errstate(over="ignore"):
            h = np.where(twin, tv.mix(doc.astype(U) * U(0x9E3779B97F4A7C15) + a.astype(U)), h.astype(U))
        cols = [pa.array(h.view(np.int64)), pa.array(ctx.astype(U).view(np.int64)), pa.array(doc.astype(np.int64)), pa.array(a.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(twin)]
        yield pa.RecordBatch.from_arrays(cols, ["h", "ctx", "doc", "a", "n", "twin"])


def _classes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows in order of (twin, h, ctx, doc, a): repeats (``whole``: all n strings stand earlier) and, for anchors
    with several contexts, the first place of each context, to be compared. A group has no bound: of what came before
    only its last row, and the group's first one while it has one context, are kept."""
    last, waits = None, None
    for batch in batches:
        tw = batch.column("twin")
        known = batch.filter(tw)
        if known.num_rows:
            yield pa.RecordBatch.from_arrays([*(known.column(c) for c in _ROW), pa.array(np.ones(known.num_rows, bool))], [*_ROW, "whole"])
        batch = batch.filter(pa.compute.invert(tw))
        if not batch.num_rows:
            continue
        h, ctx, doc, a = (batch.column(c).to_numpy() for c in ("h", "ctx", "doc", "a"))
        before = [np.append(x[:1] if last is None else [last[k]], x[:-1]) for k, x in enumerate((h, ctx, doc, a))]
        starts = h != before[0]
        fresh = starts | (ctx != before[1])
        again = ~fresh & (doc == before[2]) & (a == before[3])
        if last is None:
            starts[0], fresh[0], again[0] = True, True, False
        last = (h[-1], ctx[-1], doc[-1], a[-1])
        group = np.cumsum(starts)  # 0: the group that the last batch ended with
        several = np.zeros(group[-1] + 1, bool)
        several[group[fresh & ~starts]] = True
        keep = (~fresh & ~again) | (fresh & (~starts | several[group]))
        if waits is not None and several[0]:
            yield pa.RecordBatch.from_arrays([*(waits.column(c) for c in _ROW), pa.array([False])], [*_ROW, "whole"])
            waits = None
        if starts.any():
            waits = None if several[-1] else batch.slice(int(np.flatnonzero(starts)[-1]), 1)
        rows = batch.filter(pa.array(keep))
        yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in _ROW), pa.array(~fresh[keep])], [*_ROW, "whole"])


def _segments(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        docs, texts = batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()
        out: tuple[list, ...] = ([], [], [], [], [])
        for doc, text, spots in zip(docs, texts, batch.column("spots").to_pylist(), strict=True):
            raw = text.encode()
            for x in spots:
                for col, v in zip(out, (x["h"], doc, x["a"], x["n"], raw[x["a"] : x["a"] + x["n"] + length - 1]), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], [*_ROW, "raw"])


def previous_factors(pos: np.ndarray, lcp: np.ndarray) -> np.ndarray:
    """The longest previous factor of each suffix, in suffix order: the longer of what it shares with the previous and
    with the next suffix in that order whose position is smaller. ``lcp[i]``: what suffixes i-1 and i share."""
    out = np.zeros(len(pos), np.int64)
    stack: list[tuple[int, int, int]] = []  # ascending positions: (index, position, shared with the one below)
    for i, (p, common) in enumerate(zip([*pos.tolist(), -1], [*lcp.tolist(), 0], strict=True)):
        while stack and stack[-1][1] > p:
            j, _, below = stack.pop()
            out[j] = max(below, common)
            common = min(below, common)
        stack.append((i, p, common))
    return out


def repeated(doc: np.ndarray, a: np.ndarray, n: np.ndarray, raw: list[bytes], length: int, seen: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, first, count) of runs of starts whose string has an earlier occurrence in these segments or is among the
    hashes ``seen``; and the hashes of all their strings. Rows of one anchor come in order of (doc, a)."""
    buf = np.frombuffer(b"".join(raw), np.uint8)
    base = np.concatenate([[0], np.cumsum(n.astype(np.int64) + length - 1)])[:-1]
    row = np.repeat(np.arange(len(n)), n)
    k = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    at = base[row] + k
    h = tv.windows(buf, length)[at]
    order = np.argsort(h, kind="stable")
    eq = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][eq]] = True
    twice[order[:-1][eq]] = True
    hit = np.zeros(len(h), bool) if seen is None else np.isin(h, seen)
    # only these can share all their bytes with another one: their suffixes in order, cut to the length asked for
    some = np.flatnonzero(twice)
    if len(some):
        strings = np.lib.stride_tricks.sliding_window_view(buf, length)[at[some]]
        sa = np.argsort(np.ascontiguousarray(strings).view(f"S{length}").ravel(), kind="stable")
        rank = np.empty(len(some), np.int64)
        rank[np.lexsort((a[row[some]] + k[some], doc[row[some]]))] = np.arange(len(some))
        lcp = np.zeros(len(some), np.int64)
        for lo in range(1, len(some), 1 << 16):
            hi = min(len(some), lo + (1 << 16))
            differ = strings[sa[lo:hi]] != strings[sa[lo - 1 : hi - 1]]
            lcp[lo:hi] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
        hit[some[sa[previous_factors(rank[sa], lcp) >= length]]] = True
    s = np.flatnonzero(hit)
    cut = np.flatnonzero(np.concatenate([[True], (row[s][1:] != row[s][:-1]) | (s[1:] != s[:-1] + 1)])) if len(s) else s
    return row[s][cut], k[s][cut], np.diff(np.append(cut, len(s))), h


def _once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From segments in order of (h, doc, a) each one once: it comes for every row of its doc_id."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in ("h", "doc", "a")]
        again = np.ones(batch.num_rows, bool)
        for k, x in enumerate(keys):
            again[1:] &= x[1:] == x[:-1]
            again[0] &= last is not None and x[0] == last[k]
        last = [x[-1] for x in keys]
        yield batch.filter(pa.array(~again)) if again.any() else batch


def _marks(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Segments in order of (h, doc, a), each once, whole anchors at a time. Of an anchor with more than ``CHUNK_ROWS`` segments,
    each chunk is also held against the string hashes of the chunks before it."""
    rest: pa.Table | None = None
    seen, seen_h = None, None

    def done(t: pa.Table, whole: bool) -> pa.RecordBatch:
        nonlocal seen, seen_h
        h, doc, a, n = (t.column(c).to_numpy() for c in _ROW)
        own = seen if seen_h is not None and h[0] == seen_h else None
        row, k, count, hashes = repeated(doc, a, n, t.column("raw").to_pylist(), length, own)
        if whole:
            seen, seen_h = None, None
        else:
            seen, seen_h = np.unique(hashes if own is None else np.concatenate([own, hashes])), h[0]
        return pa.RecordBatch.from_arrays([pa.array(doc[row]), pa.array((a[row] + k).astype(np.int32)), pa.array(count.astype(np.int32))], ["doc", "a", "n"])

    for batch in _once(batches):
        rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if rest.num_rows >= CHUNK_ROWS:
            h = rest.column("h").to_numpy()
            cut = int(np.searchsorted(h, h[-1]))
            if cut:  # ends with the last whole anchor
                yield done(rest.slice(0, cut), True)
                rest = rest.slice(cut)
            if rest.num_rows >= CHUNK_ROWS:
                yield done(rest, False)
                rest = None
    if rest is not None and rest.num_rows:
        yield done(rest, True)


def _digest(batches: Iterable[pa.RecordBatch], length: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: tuple[list, ...] = ([], [], [], [], [])
        for text, spots in zip(batch.column("text").to_pylist(), batch.column("spots").to_pylist(), strict=True):
            raw, gone, runs = text.encode(), 0, 0
            size = len(raw)
            if spots:
                step = np.zeros(size + 1, np.int32)
                for x in spots:
                    step[min(x["a"], size)] += 1
                    step[min(x["a"] + x["n"] + length - 1, size)] -= 1
                cover = np.cumsum(step[:size]) > 0
                gone, runs = int(cover.sum()), int(np.count_nonzero(cover[1:] & ~cover[:-1]) + cover[0])
                raw = np.frombuffer(raw, np.uint8)[~cover].tobytes()
            for col, v in zip(out, (size, gone, runs, hashlib.sha256(raw).hexdigest(), raw if with_text else None), strict=True):
                col.append(v)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = True) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept): each text's UTF-8 bytes without those covered by a
    string of ``length`` bytes that also starts earlier, in a smaller doc_id or earlier in the same text. ``kept`` holds
    the bytes left (null without ``with_text``).

    Every string of ``length`` bytes is keyed by an anchor, its substring of least hash, so equal strings meet at one
    anchor; about one place in 41 is an anchor. Anchors are brought together by one shuffle of small rows: an anchor
    whose whole context stands earlier marks all its strings, one that is alone needs nothing, and the first place of
    each different context sends its bytes to the anchor's task. There the suffixes are put in order, and their
    longest-previous-factor array (previous and next smaller position) tells which strings stand earlier.

    Null or empty text: no bytes, nothing removed. Shorter than ``length``: unchanged. Null doc_id: not returned.
    Repeated rows of a doc_id with the same text: one document, each row returned. With different texts: the text of
    least hash is the document; the others are returned whole and are no earlier occurrence of anything. Empty table:
    no rows. Other columns: ignored."""
    texts = texts_of(docs.where("doc_id is not null"))
    h = F.xxhash64("text")
    several = stash(texts.groupBy("doc_id").agg(F.min(h).alias("lo"), F.max(h).alias("hi")).where("lo <> hi").select("doc_id", "lo"), "several")
    rest = None
    if several.limit(1).count():
        both = texts.join(if_small(several), "doc_id", "left").withColumn("own", F.coalesce(F.col("lo") == h, F.lit(True)))
        texts, rest = both.where("own").select("doc_id", "text"), both.where("not own").select("doc_id", "text")
    rows = texts.mapInArrow(lambda it: _anchors(it, length, ANCHOR), "h long, ctx long, doc long, a int, n int, twin boolean")
    rows = rows.repartition("h").sortWithinPartitions("twin", "h", "ctx", "doc", "a")
    marks = stash(rows.mapInArrow(_classes, "h long, doc long, a int, n int, whole boolean"), "anchors")
    open_spots = marks.where("not whole").groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("h", "a", "n")).alias("spots"))
    segments = texts.join(open_spots, texts["doc_id"] == open_spots["of"]).select("doc_id", "text", "spots").mapInArrow(lambda it: _segments(it, length), "h long, doc long, a int, n int, raw binary")
    compared = segments.repartition("h").sortWithinPartitions("h", "doc", "a").mapInArrow(lambda it: _marks(it, length), "doc long, a int, n int")
    cover = compared.unionAll(marks.where("whole").select("doc", "a", "n")).groupBy(F.col("doc").alias("of")).agg(F.collect_list(F.struct("a", "n")).alias("spots"))
    both = texts.join(cover, texts["doc_id"] == cover["of"], "left").select("doc_id", "text", "spots")
    if rest is not None:
        both = both.unionByName(rest.withColumn("spots", F.lit(None).cast(both.schema["spots"].dataType)))
    return both.mapInArrow(lambda it: _digest(it, length, with_text), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
