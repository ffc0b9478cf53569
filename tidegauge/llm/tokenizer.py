"""Encoding of a corpus with a public byte-level BPE vocabulary.

Method: the text of a whole Arrow batch is one array of code points, and a class array (letter, number, white space, other,
end of document) replaces the regular expression. Locating borders is a scan of the splitting automaton's transition functions.
For this pattern each function depends on at most two neighbours on either side and forgets all before, so functions compose to the
last one and the scan needs no sequential part: borders are elementwise conditions on shifted class arrays, and prefix sums turn them
into slices, counts per document and byte offsets. Arrow dictionary-encodes the slices, only slices not met before pass through the
pair merges (cached for the worker's life), and ``take`` lays out the ids per document. Offsets are kept, so ids map back to the text.

The split has the meaning of ``public_tokenizers.PATTERN``; nulls and empty texts have no tokens: both give an empty list.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Where the vocabularies lie; a parameter of every function that reads one.
VOCABULARIES = "/opt/tokenizers"
LETTER, NUMBER, SPACE, OTHER, END = 0, 1, 2, 3, 4
_END_CP = 0x110000


@lru_cache(maxsize=1)
def class_table() -> np.ndarray:
    """The class of every code point, and of the mark at the end of a document."""
    import regex

    out = np.full(_END_CP + 1, OTHER, dtype=np.int8)
    every = "".join(map(chr, (c for c in range(_END_CP) if not 0xD800 <= c < 0xE000)))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, every):
            cps = np.frombuffer(m.group().encode("utf-32-le"), dtype=np.uint32)
            out[cps] = kind
    out[_END_CP] = END
    return out


def borders(cps: np.ndarray) -> np.ndarray:
    """True where a token starts, for code points of documents that each end with ``_END_CP`` (itself a token of its own)."""
    n = len(cps)
    if not n:
        return np.zeros(0, dtype=bool)
    cls = class_table()[cps]
    prev = np.r_[np.int8(END), cls[:-1]]
    nxt = np.r_[cls[1:], np.int8(END)]
    run = (cls != prev) | (cls == END)  # a run of one class starts
    blank = cps == 32
    start = run.copy()
    # white space: the last of a run before a token stands alone or, if a blank, goes with the token
    last_space = (cls == SPACE) & (nxt != SPACE) & (nxt != END)
    start |= last_space
    after_blank = np.r_[False, (last_space & blank)[:-1]]
    start &= ~after_blank
    # contractions: an apostrophe that starts a token, with the letters of one of the endings
    c1, c2 = np.r_[cps[1:], _END_CP][:n], np.r_[cps[2:], _END_CP, _END_CP][:n]
    heads = (cps == 39) & start
    if heads.any():
        one = np.isin(c1, [ord(c) for c in "stmd"])
        two = ((c1 == 114) & (c2 == 101)) | ((c1 == 118) & (c2 == 101)) | ((c1 == 108) & (c2 == 108))
        length = np.where(heads & one, 2, np.where(heads & two, 3, 0))
        at = np.flatnonzero(length)
        start[at + 1] = False
        end = at + length[at]
        inside = cls[end] == LETTER
        start[end[inside]] = True
        # what follows the ending starts a token unless it belongs to a run that did so already
        start[end[~inside]] |= run[end[~inside]]
    return start


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    """Byte sequences and ranks of a rank file (base64 and number a line)."""
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in Path(path).read_bytes().splitlines() if line.strip())}


def merge_pairs(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one slice: the adjacent pair of the lowest rank is joined until none is known."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    if len(parts) > 200:
        return _merge_long(parts, ranks)
    big = 1 << 62
    pair = [ranks.get(parts[i] + parts[i + 1], big) for i in range(len(parts) - 1)]
    while pair:
        low = min(pair)
        if low == big:
            break
        i = pair.index(low)
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
        del pair[i]
        if i:
            pair[i - 1] = ranks.get(parts[i - 1] + parts[i], big)
        if i < len(pair):
            pair[i] = ranks.get(parts[i] + parts[i + 1], big)
    return [ranks[p] for p in parts]


def _merge_long(parts: list[bytes], ranks: dict[bytes, int]) -> list[int]:
    """The same with a heap and links: long slices take n log n steps."""
    import heapq

    n = len(parts)
    left, right, alive = list(range(-1, n - 1)), list(range(1, n + 1)), [True] * n
    heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = right[i]
        if not alive[i] or j >= n or parts[i] is not a or parts[j] is not b:
            continue
        parts[i], alive[j], right[i] = a + b, False, right[j]
        if right[i] < n:
            left[right[i]] = i
        for k in (left[i], i):
            if k >= 0 and right[k] < n and (r := ranks.get(parts[k] + parts[right[k]])) is not None:
                heapq.heappush(heap, (r, k, parts[k], parts[right[k]]))
    return [ranks[p] for p, ok in zip(parts, alive) if ok]


class Encoder:
    """Batch encoder with a cache of the slices met so far (at most ``held``; then it starts anew)."""

    def __init__(self, ranks: dict[bytes, int], held: int = 400_000):
        self.ranks, self.held = ranks, held
        self.cache: dict[bytes, int] = {}
        self.ids: list[list[int]] = []

    def slot(self, piece: bytes) -> int:
        at = self.cache.get(piece)
        if at is None:
            at = self.cache[piece] = len(self.ids)
            self.ids.append(merge_pairs(piece, self.ranks))
        return at

    def slices(self, texts: list[str | None]) -> tuple[pa.Array, np.ndarray]:
        """Token slices of all texts in order and, for each text, the number of its slices."""
        live = [t or "" for t in texts]
        marked = np.frombuffer("".join(live).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        length = np.fromiter(map(len, live), dtype=np.int64, count=len(live))
        end_at = np.cumsum(length)
        cps = np.insert(marked, end_at, _END_CP) if len(live) else marked
        start = borders(cps)
        is_end = cps == _END_CP
        width = np.where(cps < 0x80, 1, np.where(cps < 0x800, 2, np.where(cps < 0x10000, 3, 4)))
        width[is_end] = 0
        byte_at = np.r_[0, np.cumsum(width)]
        token = start & ~is_end
        at = np.flatnonzero(token)
        counts = np.diff(np.r_[0, np.cumsum(token)[is_end]])
        data = "".join(live).encode("utf-8", "surrogatepass")
        offsets = np.r_[byte_at[at], len(data)].astype(np.int64)
        return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(data)]), counts

    def encode(self, texts: list[str | None]) -> pa.ListArray:
        """The ids of each text; an empty list for null and empty texts."""
        pieces, counts = self.slices(texts)
        d = pieces.dictionary_encode()
        if len(self.ids) > self.held:
            self.cache, self.ids = {}, []
        own = [self.ids[self.slot(p)] for p in d.dictionary.to_pylist()]
        size = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
        flat = np.fromiter((i for ids in own for i in ids), dtype=np.int32, count=int(size.sum()))
        begin = np.r_[0, np.cumsum(size)]
        code = d.indices.to_numpy().astype(np.int64)
        n_ids = size[code]
        to = np.cumsum(n_ids)
        # position of each id: the start of its slice's ids in ``flat`` plus its number within the slice
        src = np.repeat(begin[code] - (to - n_ids), n_ids) + np.arange(int(n_ids.sum()))
        per_text = np.r_[0, to][np.r_[0, np.cumsum(counts)]]
        return pa.ListArray.from_arrays(pa.array(per_text, pa.int32()), pa.array(flat[src], pa.int32()))


_encoders: dict[str, Encoder] = {}


def _encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(load_ranks(path))
    return _encoders[path]


def encode(documents: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken", folder: str = VOCABULARIES, batch_chars: int = 2_000_000) -> DataFrame:
    """(doc_id, ids): the token ids of every text, special tokens excepted (their strings are ordinary text).

    Null and empty texts: an empty list. Texts of any length are encoded whole; batches are cut at ``batch_chars``. Repeated
    rows stay repeated; extra columns are ignored. No shuffle.
    """
    path = str(Path(folder) / vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            done, a = 0, 0
            for i, t in enumerate(texts):
                done += len(t) if t else 0
                if done >= batch_chars or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(a, i + 1 - a), enc.encode(texts[a : i + 1])], names=["doc_id", "ids"])
                    done, a = 0, i + 1

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, ids array<int>")


def offsets(documents: DataFrame, folder: str = VOCABULARIES, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """(doc_id, n_tokens, starts): the byte offsets in the UTF-8 text at which the slices before merging start."""
    path = str(Path(folder) / vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(path)
        for b in batches:
            texts = b.column("text").to_pylist()
            pieces, counts = enc.slices(texts)
            begin = np.frombuffer(pieces.buffers()[1], dtype=np.int64)[: len(pieces)]
            to = np.r_[0, np.cumsum(counts)]
            size = np.array([len((t or "").encode("utf-8", "surrogatepass")) for t in texts], dtype=np.int64)
            base = np.repeat(np.r_[0, np.cumsum(size)][:-1], counts)
            n = pa.array([len(x) for x in enc.encode(texts).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), n, pa.ListArray.from_arrays(pa.array(to, pa.int32()), pa.array(begin - base, pa.int64()))], names=["doc_id", "n_tokens", "starts"])

    return documents.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, starts array<long>")


def decode(ids: list[int], path: str) -> str:
    """The text of ids."""
    table = {v: k for k, v in load_ranks(path).items()}
    return b"".join(table[i] for i in ids).decode("utf-8", "replace")
