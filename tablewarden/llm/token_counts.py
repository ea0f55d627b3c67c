"""Token counts of whole texts by rank-synchronous merging over ragged arrays.

The byte-pair merges of a tokenizer file are applied to all new pre-tokens of a batch at once: symbols
lie end to end in one array, every round finds each pre-token's lowest-ranked adjacent pair, merges all
its occurrences there, and closes the gaps; what is left is the count. Pre-tokens met before are looked
up in a memo of fixed size (see ``pretokens``).
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pretokens import BYTE_LETTERS, Encoder, mix

_NONE = np.int32(2**31 - 1)
_BITS = 19


class MergeTable:
    """Ranks of adjacent symbol pairs: a hash table of single slots and a short sorted overflow."""

    def __init__(self, spec: dict) -> None:
        vocab = spec["model"]["vocab"]
        self.byte_ids = np.array([vocab[BYTE_LETTERS[b]] for b in range(256)], dtype=np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in pairs], dtype=np.uint64)
        self.made = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        ranks = np.arange(len(keys), dtype=np.int32)
        slot = self._slot(keys)
        order = np.argsort(slot, kind="stable")
        lone = np.ones(len(keys), dtype=bool)
        lone[order[1:]] = slot[order[1:]] != slot[order[:-1]]
        self.keys = np.full(1 << _BITS, 2**64 - 1, dtype=np.uint64)
        self.ranks = np.full(1 << _BITS, _NONE, dtype=np.int32)
        self.keys[slot[lone]], self.ranks[slot[lone]] = keys[lone], ranks[lone]
        rest = np.flatnonzero(~lone)
        rest = rest[np.argsort(keys[rest])]
        self.more_keys, self.more_ranks = np.append(keys[rest], np.uint64(2**64 - 1)), np.append(ranks[rest], _NONE)

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (mix(keys) >> np.uint64(64 - _BITS)).astype(np.int64)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.uint64) << np.uint64(32) | right.astype(np.uint64)
        slot = self._slot(keys)
        there, out = self.keys[slot], self.ranks[slot]
        other = np.flatnonzero(there != keys)
        out[other] = _NONE
        other = other[there[other] != np.uint64(2**64 - 1)]
        if len(other):
            at = np.searchsorted(self.more_keys, keys[other])
            out[other] = np.where(self.more_keys[at] == keys[other], self.more_ranks[at], _NONE)
        return out

    def count(self, words: list[str]) -> np.ndarray:
        """Number of symbols that each pre-token ends with."""
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        size = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
        out = size.copy()
        symbols = self.byte_ids[np.frombuffer(b"".join(raw), dtype=np.uint8)]
        owner = np.repeat(np.arange(len(raw)), size)
        while len(symbols) > 1:
            rank = self.rank(symbols[:-1], symbols[1:])
            rank[owner[:-1] != owner[1:]] = _NONE
            rank = np.append(rank, _NONE)
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
            best = np.minimum.reduceat(rank, starts)
            live = best != _NONE
            length = np.diff(np.append(starts, len(symbols)))
            out[owner[starts]] = length
            if not live.any():
                break
            hit = (rank == np.repeat(best, length)) & (rank != _NONE)
            # a run of equal symbols offers overlapping pairs; every second one counts, from its left end
            at = np.flatnonzero(hit)
            run = np.cumsum(np.append(True, np.diff(at) != 1))
            begin = at[np.searchsorted(run, run, side="left")]
            at = at[(at - begin) % 2 == 0]
            symbols[at] = self.made[rank[at]]
            keep = np.repeat(live, length)  # finished pre-tokens leave the arrays
            gone = at + 1
            out[owner[starts]] -= np.bincount(np.searchsorted(starts, at, side="right") - 1, minlength=len(starts))
            keep[gone] = False
            symbols, owner = symbols[keep], owner[keep]
        return out


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Encoder:
    """One counter per worker process and file."""
    encoder = Encoder(path, ids=False)
    encoder.memo.solve = MergeTable(encoder.splitter.spec).count
    return encoder


def token_counts(documents: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """Bytes and tokens of every text.

    ``documents``: ``doc_id`` and ``text``, other columns are ignored. Returns ``doc_id, n_bytes,
    n_tokens, over_limit``, one row per input row: repeated rows stay, a null ``doc_id`` stays null, a
    null or empty text has 0 bytes and 0 tokens, an empty table gives an empty result. Added tokens'
    strings inside a text count as the library's default has them. ``tokenizer``: a byte-level
    byte-pair file of the tokenizers library, readable on every executor.
    """
    def count(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = counter(tokenizer)
        for part in parts:
            text = pc.fill_null(part.column(1), "")
            n, _ = encoder(text.to_pylist())
            yield pa.RecordBatch.from_arrays([part.column(0), pc.cast(pc.binary_length(text), pa.int64()), pa.array(n)], names=["doc_id", "n_bytes", "n_tokens"])

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
