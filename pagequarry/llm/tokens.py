"""Encoding with the tokenizers library, a batch of whole texts at a time.

Texts are cut into parts where the tokenizer always cuts, distinct parts are
encoded once and the ids are put together again with numpy.  Parts already seen
by a worker come from a cache of bounded size, which never changes a result.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts a worker keeps; later new parts are encoded each time they come.
CACHE_PARTS = 250_000
#: Bytes of text encoded at a time, so that memory does not follow the row count.
SLICE_BYTES = 4 << 20


def _table(chars: bytes) -> np.ndarray:
    marks = np.zeros(256, dtype=bool)
    marks[list(chars)] = True
    return marks


_SPACE = _table(b" \n")
_OTHER_SPACE = _table(b"\t\r\x0b\x0c\x1c\x1d\x1e\x1f\xc2\xe1\xe2\xe3")
_LETTER = _table(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
# punctuation that is in no special token and starts no contraction
_POINT = _table(b".,!?#$%&*;:")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _odd_spaces(data: np.ndarray) -> np.ndarray:
    """Positions of white space other than single blanks and line ends."""
    at = np.flatnonzero(_OTHER_SPACE[data])
    lead, follow = data[at], data[np.minimum(at + 1, len(data) - 1)]
    odd = (lead < 0x80) | ((lead == 0xC2) & ((follow == 0x85) | (follow == 0xA0))) | ((lead == 0xE1) & (follow == 0x9A))
    odd |= ((lead == 0xE2) & ((follow == 0x80) | (follow == 0x81))) | ((lead == 0xE3) & (follow == 0x80))
    return at[odd]


class PartEncoder:
    """Ids of whole texts; equal to encoding each text by itself.

    ``drops_space``: the tokenizer ignores white space and case, as
    ``word_bpe_49k.json`` does; otherwise it is byte-level and takes a blank
    with the word behind it, so texts with runs of white space are not cut.
    Texts that may hold a special token, whose case counts, are not cut either.
    """

    def __init__(self, path: str, drops_space: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.drops_space = Tokenizer.from_file(path), drops_space
        self.known: dict[str, int] = {}
        self.ids = np.zeros(1 << 20, dtype=np.int32)
        self.starts = np.zeros(CACHE_PARTS + 1, dtype=np.int64)

    def _encoded(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in one array, and the number of ids of each part."""
        ids, lengths = [], []
        for lo in range(0, len(parts), 20_000):
            lists = [e.ids for e in self.tokenizer.encode_batch_fast(parts[lo : lo + 20_000], add_special_tokens=False)]
            lengths.append(np.fromiter(map(len, lists), dtype=np.int64, count=len(lists)))
            ids.append(np.fromiter((i for x in lists for i in x), dtype=np.int32, count=int(lengths[-1].sum())))
        return (np.concatenate(ids), np.concatenate(lengths)) if ids else (np.zeros(0, np.int32), np.zeros(0, np.int64))

    def _keep(self, parts: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, room = len(self.known), CACHE_PARTS - len(self.known)
        parts, lengths = parts[:room], lengths[:room]
        used = self.starts[n]
        need = used + int(lengths.sum())
        while need > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[used:need] = ids[: need - used]
        self.starts[n + 1 : n + 1 + len(parts)] = used + np.cumsum(lengths)
        self.known.update(zip(parts, range(n, n + len(parts))))

    def _parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The parts, the first part of each text (and the end), the texts that must not be cut."""
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        data = np.frombuffer(texts.buffers()[2] or b"", dtype=np.uint8)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        uncut = np.zeros(len(texts), dtype=bool)
        text_of = lambda at: np.searchsorted(offsets, at, side="right") - 1
        if self.drops_space:
            # the case of special tokens counts
            uncut[text_of(np.flatnonzero((data[:-2] == ord("<")) & (data[1:-1] == ord("|")) & _LETTER[data[2:]]))] = True
            data = _LOWER[data]
        cut = _SPACE[data]
        if not self.drops_space and len(data):
            pairs = np.flatnonzero(cut[1:] & cut[:-1]) + 1
            pairs = pairs[text_of(pairs) == text_of(pairs - 1)]
            uncut[text_of(np.r_[pairs, _odd_spaces(data)])] = True
        cut[1:] |= _POINT[data[1:]] & _LETTER[data[:-1]]
        cut[offsets[:-1][np.diff(offsets) > 0]] = True
        starts = np.flatnonzero(cut)
        parts = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(np.r_[starts, len(data)].astype(np.int64)), pa.py_buffer(data))
        return parts, np.searchsorted(starts, offsets), uncut

    def encode(self, texts: pa.Array) -> list[np.ndarray]:
        """One int32 array for each text; a null text is empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return []
        parts, bounds, uncut = self._parts(texts)
        coded = parts.dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        number = np.fromiter(map(self.known.get, distinct, [-1] * len(distinct)), dtype=np.int64, count=len(distinct))
        unknown = np.flatnonzero(number < 0)
        fresh = [distinct[i] for i in unknown]
        own, lengths = self._encoded(fresh)
        # the ids of this slice's parts: cached ones, then the fresh ones
        first, size = self.starts[number], self.starts[number + 1] - self.starts[number]
        first[unknown], size[unknown] = len(self.ids) + np.cumsum(lengths) - lengths, lengths
        source = np.concatenate([self.ids, own])
        at = coded.indices.to_numpy(zero_copy_only=False)
        first, size = first[at], size[at]
        ends = np.cumsum(size)
        flat = source[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - size), size)]
        self._keep(fresh, own, lengths)
        cuts = np.r_[0, ends][bounds]
        out = [flat[a:b] for a, b in zip(cuts[:-1], cuts[1:])]
        for i in np.flatnonzero(uncut):
            out[i] = self._encoded([texts[int(i)].as_py()])[0]
        return out


_ENCODERS: dict[str, PartEncoder] = {}


def encoder(path: str, drops_space: bool) -> PartEncoder:
    """The worker's encoder for a tokenizer file; workers live for many tasks."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PartEncoder(path, drops_space)
    return _ENCODERS[path]


def crc32_of(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, dtype="<u4").tobytes())


def sliced(batches: Iterator[pa.RecordBatch], text: str, n_bytes: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches cut so that a slice holds about ``n_bytes`` of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        group = np.cumsum(sizes) // n_bytes
        cuts = np.r_[0, np.flatnonzero(np.diff(group)) + 1, batch.num_rows]
        for lo, hi in zip(cuts[:-1], cuts[1:]):
            yield batch.slice(lo, hi - lo)
