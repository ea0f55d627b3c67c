"""Concatenate and cut: all documents end to end, cut into windows of one length.

Pass one encodes every text once and writes its ids with their place inside the input partition. The
partitions' totals give global offsets by a prefix sum over one small row per partition. Pass two cuts at
multiples of the window and emits one boundary record per piece.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .pretokens import encoder
from .shared import stored


def _documents(counts: np.ndarray, ids: np.ndarray, end_id: int) -> list[np.ndarray]:
    """Every document's ids with the end id."""
    ends = np.cumsum(counts)
    spread = np.full(len(ids) + len(counts), end_id, dtype=np.int64)
    spread[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
    return np.split(spread, (ends + np.arange(1, len(counts) + 1))[:-1]) if len(counts) else []


def encoded(documents: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """``doc_id, part, place, n_tokens, ids``: ids as little-endian unsigned 16-bit or 32-bit integers
    (``wide``), and the number of ids before them in their input partition."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode_texts, part, place = encoder(tokenizer), TaskContext.get().partitionId(), 0
        kind = "<u2" if encode_texts.splitter.library.get_vocab_size() <= 65536 and end_id < 65536 else "<u4"
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                counts, ids = encode_texts([t or "" for t in some.column(1).to_pylist()])
                docs = _documents(counts, ids, end_id)
                sizes = counts + 1
                places = place + np.cumsum(sizes) - sizes
                place += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [some.column(0), pa.array(np.full(len(docs), part, np.int64)), pa.array(places), pa.array(sizes), pa.array([kind == "<u4"] * len(docs)), pa.array([d.astype(kind).tobytes() for d in docs], pa.binary())],
                    names=["doc_id", "part", "place", "n_tokens", "wide", "ids"],
                )

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    return rows.mapInArrow(encode, "doc_id long, part long, place long, n_tokens long, wide boolean, ids binary")


def pack(documents: DataFrame, tokenizer: str, end_id: int = 1, window: int = 2048, with_ids: bool = False) -> DataFrame:
    """Pack all documents into sequences of ``window`` ids; only the last one can be shorter.

    Returns one row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` and,
    if asked for, the piece's ``ids`` (little-endian unsigned 32-bit). A null or empty text is its end id
    alone. Repeated rows are packed each by itself, a null ``doc_id`` is kept, other columns are ignored,
    and an empty table gives no pieces.
    """
    ids = stored(encoded(documents, tokenizer, end_id), "packing-ids")
    totals = ids.groupBy("part").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))  # one row per input partition
    # written first: its known size lets the planner send it to the ids, and not the ids to it
    offsets = stored(totals.select("part", F.coalesce(before, F.lit(0)).alias("before")), "packing-offsets")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            doc_id, start, length, crc, whole, sequence, offset, pieces = ([] for _ in range(8))
            for d, g, wide, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                tokens = np.frombuffer(raw, "<u4" if wide else "<u2").astype("<u4")
                at, n = 0, len(tokens)
                while at < n:
                    size = min(n - at, window - (g + at) % window)
                    piece = tokens[at : at + size].tobytes()
                    doc_id.append(d), start.append(at), length.append(size), crc.append(zlib.crc32(piece)), whole.append(n)
                    sequence.append((g + at) // window), offset.append((g + at) % window)
                    if with_ids:
                        pieces.append(piece)
                    at += size
            arrays = [pa.array(x, pa.int64()) for x in (doc_id, start, length, crc, whole, sequence, offset)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            yield pa.RecordBatch.from_arrays([*arrays, *([pa.array(pieces, pa.binary())] if with_ids else [])], names=[*names, *(["ids"] if with_ids else [])])

    placed = ids.join(offsets, "part").select("doc_id", (F.col("before") + F.col("place")).alias("at"), "wide", "ids")
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long" + (", ids binary" if with_ids else "")
    return placed.mapInArrow(cut, schema)
