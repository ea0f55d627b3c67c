"""Token ids as Arrow files of fixed-size lists.

Documents are dealt by ranges of ``doc_id``; each range becomes one Arrow IPC file in which every row is a
sequence of equal length with its mask, so that a reader can map the file and address sequence ``i``
without decoding anything else. A document index (shard, place, length) is written beside the files.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .pretokens import encoder
from .shared import filesystem, fresh_path, looked_up, stored

_ROWS = 256


def _schema(kind: pa.DataType, length: int) -> pa.Schema:
    return pa.schema([("ids", pa.list_(kind, length)), ("mask", pa.list_(pa.bool_(), length))])


class ShardWriter:
    """Writes a stream of ids as sequences of equal length; the last one is padded and masked.

    The file appears under its name only when it is complete, so a task that is run again replaces it.
    """

    def __init__(self, folder: str, shard: int, length: int, wide: bool, pad: int) -> None:
        self.fs, base = filesystem(folder)
        self.path = f"{base}/shard-{shard:08d}.arrow"
        self.temporary = f"{base}/.shard-{shard:08d}-{uuid.uuid4().hex}"
        self.length, self.pad, self.kind = length, pad, pa.uint32() if wide else pa.uint16()
        self.held, self.n = [], 0
        self.fs.create_dir(base, recursive=True)
        self.out = self.fs.open_output_stream(self.temporary)
        self.file = pa.ipc.new_file(self.out, _schema(self.kind, length))

    def write(self, ids: np.ndarray) -> None:
        self.held.append(ids)
        self.n += len(ids)
        if self.n >= self.length * _ROWS:
            flat = np.concatenate(self.held)
            full = len(flat) // (self.length * _ROWS) * self.length * _ROWS
            for at in range(0, full, self.length * _ROWS):
                self._batch(flat[at : at + self.length * _ROWS], self.length * _ROWS)
            self.held, self.n = [flat[full:]], len(flat) - full

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        arrays = [pa.FixedSizeListArray.from_arrays(pa.array(flat.astype(self.kind.to_pandas_dtype())), self.length), pa.FixedSizeListArray.from_arrays(pa.array(mask), self.length)]
        self.file.write_batch(pa.RecordBatch.from_arrays(arrays, names=["ids", "mask"]))

    def close(self) -> None:
        if self.n:
            flat = np.concatenate(self.held)
            self._batch(np.append(flat, np.full(-len(flat) % self.length, self.pad, flat.dtype)), len(flat))
        self.file.close()
        self.out.close()
        self.fs.move(self.temporary, self.path)


class ShardReader:
    """Random access to the sequences of one file. A local file is mapped, not read."""

    def __init__(self, folder: str, shard: int) -> None:
        where, base = filesystem(folder)
        path = f"{base}/shard-{shard:08d}.arrow"
        self.source = pa.memory_map(path) if isinstance(where, fs.LocalFileSystem) else where.open_input_file(path)
        self.file = pa.ipc.open_file(self.source)
        self.length = self.file.schema.field("ids").type.list_size
        self.per_batch = _ROWS * self.length

    def sequence(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Ids (a view of the mapped file) and mask of one sequence."""
        batch, row = self.file.get_batch(i // _ROWS), i % _ROWS
        view = slice(row * self.length, (row + 1) * self.length)
        return batch.column(0).flatten().to_numpy()[view], batch.column(1).flatten().slice(view.start, self.length).to_numpy(zero_copy_only=False)

    def ids(self, at: int, n: int) -> np.ndarray:
        """``n`` ids from place ``at`` of the file's stream."""
        parts = []
        while n > 0:
            flat = self.file.get_batch(at // self.per_batch).column(0).flatten().to_numpy()
            part = flat[at % self.per_batch : at % self.per_batch + n]
            parts.append(part)
            at, n = at + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate(parts) if parts else np.empty(0, np.uint16)

    def close(self) -> None:
        self.source.close()


def write_token_files(documents: DataFrame, folder: str, tokenizer: str, end_id: int = 0, length: int = 2048) -> DataFrame:
    """Write every text's ids and the end id, in ascending ``doc_id`` order (null first; repeated ids by
    a hash of their text), and return the document index ``doc_id, shard, place, n_tokens``.

    A null or empty text is its end id alone. Other columns are ignored; an empty table writes nothing.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, shard, writer, place = encoder(tokenizer), TaskContext.get().partitionId(), None, 0
        wide = encode.splitter.library.get_vocab_size() > 65536 or end_id >= 65536
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                counts, ids = encode([t or "" for t in some.column(1).to_pylist()])
                flat = np.full(len(ids) + len(counts), end_id, dtype=np.uint32 if wide else np.uint16)
                flat[np.arange(len(ids)) + np.repeat(np.arange(len(counts)), counts)] = ids
                writer = writer or ShardWriter(folder, shard, length, wide, end_id)
                writer.write(flat)
                sizes = counts + 1
                places = place + np.cumsum(sizes) - sizes
                place += int(sizes.sum())
                yield pa.RecordBatch.from_arrays([some.column(0), pa.array(np.full(len(sizes), shard, np.int64)), pa.array(places), pa.array(sizes)], names=["doc_id", "shard", "place", "n_tokens"])
        if writer:
            writer.close()

    rows = documents.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.xxhash64("text").alias("tie"))
    dealt = rows.repartitionByRange("doc_id", "tie").sortWithinPartitions("doc_id", "tie").select("doc_id", "text")
    return dealt.mapInArrow(write, "doc_id long, shard long, place long, n_tokens long")


def read_token_files(index: DataFrame, folder: str) -> DataFrame:
    """Read the files back: ``doc_id, start, n_tokens, ids_crc32`` of every document in the index."""
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("total"))
    before = F.sum("total").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))  # one row per file
    # written first: it is small and goes to the index
    offsets = stored(totals.select("shard", F.coalesce(before, F.lit(0)).alias("before")), "token-offsets")
    files = max(offsets.count(), 1)

    def read(key: tuple, table: pa.Table) -> pa.Table:
        reader = ShardReader(folder, key[0].as_py())
        crc = [zlib.crc32(reader.ids(p, n).astype("<u4").tobytes()) for p, n in zip(table["place"].to_pylist(), table["n_tokens"].to_pylist(), strict=True)]
        reader.close()
        return pa.table({"doc_id": table["doc_id"], "start": pa.compute.add(table["before"], table["place"]), "n_tokens": table["n_tokens"], "ids_crc32": pa.array(crc, pa.int64())})

    # as many tasks as files: what tells how much a task reads is the file, not the index rows that ask for it
    return looked_up(index, offsets, ["shard"]).repartition(files, "shard").groupBy("shard").applyInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(documents: DataFrame, tokenizer: str, end_id: int = 0, length: int = 2048, folder: str | None = None) -> DataFrame:
    """Write the files (into the shared folder unless ``folder`` names another) and read them back: ``doc_id,
    start, n_tokens, ids_crc32`` of every row.

    A null or empty text is its end id alone; repeated rows and a null ``doc_id`` each have their place (see
    ``write_token_files``); an empty table gives an empty result and no file; other columns are ignored.
    """
    spark: SparkSession = documents.sparkSession
    folder = folder or fresh_path(spark, "token-files")
    index = stored(write_token_files(documents, folder, tokenizer, end_id, length), "token-index")
    return read_token_files(index, folder)
