"""Words of whole Arrow text batches as arrays: no Python string is made per word."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from .pretokens import mix, span_hashes

#: Bytes worked on at once: small enough for the processor's caches.
CHUNK = 1 << 17


def byte_table(is_word: np.ndarray) -> np.ndarray:
    """Byte -> itself with A-Z lower-cased, or 0 where it separates words (0 always separates)."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    table[~is_word] = 0
    return table


def _class(*ranges: tuple[int, int]) -> np.ndarray:
    out = np.zeros(256, dtype=bool)
    for a, b in ranges:
        out[a : b + 1] = True
    return out


#: Anything between white space (the separators are 0x20 and 0x09 to 0x0D); 0 stands for itself below.
BLANK_SEPARATED = byte_table(~_class((0x20, 0x20), (0x09, 0x0D)))
#: Letters, digits and all bytes above ASCII.
ALPHANUMERIC = byte_table(_class((0x30, 0x39), (0x41, 0x5A), (0x61, 0x7A), (0x80, 0xFF)))
_NUL = np.uint8(255)  # never part of UTF-8: the stand-in for a NUL that belongs to a word


@dataclass
class Words:
    """Words of a run of texts: their fingerprints, byte spans, and the words' range of every text."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray  # text i has words bounds[i]:bounds[i + 1]
    bytes: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    if not len(texts):
        return np.zeros(1, np.int64), np.empty(0, np.uint8)
    ends = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return ends, raw


def text_chunks(texts: pa.Array, size: int = 0):
    """``(first, last, bytes, ends)`` of runs of texts of about ``size`` bytes; nulls must be filled."""
    ends, raw = _buffers(texts)
    at, size = 0, size or CHUNK
    while at < len(ends) - 1:
        to = max(at + 1, int(np.searchsorted(ends, ends[at] + size, side="right")) - 1)
        yield at, to, raw[ends[at] : ends[to]], ends[at : to + 1] - ends[at]
        at = to


def words_of(raw: np.ndarray, ends: np.ndarray, table: np.ndarray) -> Words:
    """Words of texts that lie end to end in ``raw``; text ``i`` is ``raw[ends[i]:ends[i + 1]]``."""
    low = table[raw]
    if table is BLANK_SEPARATED:
        low[raw == 0] = _NUL
    word = np.zeros(len(raw) + 2, dtype=bool)
    word[1:-1] = low != 0
    cuts = np.zeros(len(raw) + 1, dtype=bool)  # a text's first byte never continues a word
    cuts[ends] = True
    starts = np.flatnonzero(word[1:] & (~word[:-1] | cuts))
    stops = np.flatnonzero(word[:-1] & (~word[1:] | cuts))
    return Words(span_hashes(low, starts, stops), starts, stops, np.searchsorted(starts, ends), low)


_STEPS = mix(np.arange(101, 101 + 64, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingles(hashes: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all runs of ``size`` words, by their first word (runs across texts included)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, dtype=np.uint64)
    for j in range(size):
        out += hashes[j : j + n] * _STEPS[j]
    return mix(out + np.uint64(size))


def shingle_sets(words: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of every text, sorted inside each: values end to end, and bounds by text.

    A text of fewer words (but not none) has its whole sequence as its one shingle.
    """
    all_shingles = shingles(words.hashes, size)
    values, bounds = [], [0]
    for a, b in zip(words.bounds[:-1].tolist(), words.bounds[1:].tolist(), strict=True):
        n = b - a
        if n >= size:
            v = np.sort(all_shingles[a : b - size + 1])
            v = v[np.append(True, v[1:] != v[:-1])]
            values.append(v)
            bounds.append(bounds[-1] + len(v))
        elif n:
            values.append(shingles(words.hashes[a:b], n))
            bounds.append(bounds[-1] + 1)
        else:
            bounds.append(bounds[-1])
    return np.concatenate(values) if values else np.empty(0, np.uint64), np.array(bounds, dtype=np.int64)
