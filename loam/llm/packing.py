"""Best-fit packing of token pieces into fixed-length sequences."""

from __future__ import annotations

import base64
import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from loam.llm.common import flat, slices, texts_of

#: The id that ends a document.
END_ID = 2
CAPACITY = 1024
#: Sequences that a task keeps open.
OPEN_BINS = 4096
#: The split pattern of the 50k byte-level vocabulary, with possessive runs: the same splits, less backtracking.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"""
#: Runs of white space (as the vocabulary's pattern has it); in texts of over MANY characters they may be so long that
#: they overflow the pattern's stack.
MANY = 200_000
LONG_GAP = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{1000,}")
_ENCODERS: dict[str, object] = {}


def encoder(ranks_path: str):
    """The byte-level BPE encoder of a ranks file, once per worker, with the added tokens of the ``tokenizers`` file
    beside it. :func:`encode` gives that file's ids (tests hold the two against each other) in a fifth of the time."""
    if ranks_path not in _ENCODERS:
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        beside, added = os.path.splitext(ranks_path)[0] + ".json", {}
        if os.path.exists(beside):
            with open(beside, encoding="utf-8") as f:
                added = {t["content"]: t["id"] for t in json.load(f)["added_tokens"]}
        _ENCODERS[ranks_path] = tiktoken.Encoding("bytes50k", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return _ENCODERS[ranks_path]


def encode(enc, text: str) -> list[int]:
    """The ids of a text. An added token within it is its own id, and what stands between such is split alone.

    A run of white space is one piece up to its last character, which goes with what follows; at the end of a part it
    is one piece as a whole. Very long runs are cut by that rule beforehand."""
    if len(text) < MANY or LONG_GAP.search(text) is None:
        return enc.encode(text, allowed_special="all") if any(t in text for t in enc.special_tokens_set) else enc.encode_ordinary(text)
    out: list[int] = []
    for part in re.split(f"({'|'.join(map(re.escape, sorted(enc.special_tokens_set)))})", text) if enc.special_tokens_set else [text]:
        if part in enc.special_tokens_set:
            out.append(enc.encode_single_token(part))
            continue
        at = 0
        for gap in LONG_GAP.finditer(part):
            last = gap.end() if gap.end() == len(part) else gap.end() - 1
            out += enc.encode_ordinary(part[at : gap.start()]) + enc.encode_ordinary(part[gap.start() : last])
            at = last
        out += enc.encode_ordinary(part[at:])
    return out


def default_ranks() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class OpenBins:
    """A fixed number of open bins. Bit f of ``free`` is set while an open bin has f free places, so the tightest
    bin that holds a piece is the lowest set bit at or above the piece's length. When all are open and none fits,
    the fullest closes."""

    def __init__(self, capacity: int, most: int):
        self.capacity, self.most, self.n_open, self.n_made, self.free = capacity, most, 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, length: int) -> tuple[int, int]:
        """(bin number, offset in it) for a piece of 1..capacity tokens."""
        fit = self.free >> length
        if fit:
            room = (fit & -fit).bit_length() - 1 + length
            number = self.by_free[room].pop()
            if not self.by_free[room]:
                self.free ^= 1 << room
        else:
            if length == self.capacity:
                self.n_made += 1
                return self.n_made - 1, 0
            if self.n_open == self.most:
                fullest = (self.free & -self.free).bit_length() - 1
                self.by_free[fullest].pop()
                if not self.by_free[fullest]:
                    self.free ^= 1 << fullest
                self.n_open -= 1
            number, room = self.n_made, self.capacity
            self.n_made += 1
            self.n_open += 1
        left = room - length
        if left:
            self.by_free[left].append(number)
            self.free |= 1 << left
        else:
            self.n_open -= 1
        return number, self.capacity - room


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: the first takes the remainder, the others are full."""
    first = (n - 1) % capacity + 1
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def _pack(batches: Iterable[pa.RecordBatch], ranks: str, capacity: int, most: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    enc, bins, part = encoder(ranks), OpenBins(capacity, most), TaskContext.get().partitionId() << 36
    for batch in batches:
        buf, offs = flat(batch.column("text"))
        ids = batch.column("doc_id").to_pylist()
        for lo, hi, b, o in slices(buf, offs, 4 << 20):
            out: list[tuple] = []
            for k in range(lo, hi):
                toks = encode(enc, bytes(b[o[k - lo] : o[k - lo + 1]]).decode("utf-8", "replace"))
                toks.append(END_ID)
                arr = np.array(toks, "<u4")
                for i, (s, n) in enumerate(cuts(len(arr), capacity)):
                    raw = arr[s : s + n]
                    out.append((ids[k], i, s, n, zlib.crc32(raw), raw.astype("<i4").tobytes() if with_ids else None))
            # the longest of the slice first: the open bins then fill like best fit decreasing
            order = sorted(range(len(out)), key=lambda i: -out[i][3])
            at = {i: bins.put(out[i][3]) for i in order}
            cols = list(zip(*out, strict=True))
            arrays = [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int32()), *(pa.array(cols[j], pa.int64()) for j in (2, 3, 4)), pa.array([part + at[i][0] for i in range(len(out))], pa.int64()), pa.array([at[i][1] for i in range(len(out))], pa.int64())]
            names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
            if with_ids:
                arrays.append(pa.array(cols[5], pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names)


def pack(docs: DataFrame, capacity: int = CAPACITY, open_bins: int = OPEN_BINS, ranks: str | None = None, with_ids: bool = True) -> DataFrame:
    """Tokenise ``docs`` (doc_id, text) and pack every token into sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset and, with ``with_ids``, the
    piece's token ids (little-endian int32). A document is its ids and then ``END_ID``; only one longer than
    ``capacity`` is cut, its first piece taking the remainder. Packing runs where the text is read: no shuffle, and
    a task keeps ``open_bins`` bins, so its memory is fixed; sequence numbers carry the task's number.

    Null text: an empty document, one token. Null doc_id: packed, its id null. Repeated rows: each is packed.
    Empty table: no rows. Very long text: cut like any other. Other columns: ignored."""
    ranks = ranks or default_ranks()
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    return texts_of(docs).mapInArrow(lambda it: _pack(it, ranks, capacity, open_bins, with_ids), schema)
