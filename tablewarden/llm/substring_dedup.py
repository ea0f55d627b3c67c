"""Repeated passages: runs of words that stand in several places, found exactly, and near copies of lines.

Every run of enough words (a window) has an anchor that its content decides, and neighbours with one anchor
form a stretch. Stretches meet whole by their fingerprint; where different stretches share an anchor, at the ends of
a passage, their windows meet one by one. So a repeated passage is found to its full length wherever it
begins and ends. Lines meet by their shingle sets too: by min-hash bands tuned for high recall, verified by
exact Jaccard similarity (see ``signature_tree``), and connected lines form one class. Of each class the first
occurrence stays; the others are merged into spans to remove.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .near_join import BUCKET_POSTINGS, Postings, _meet, _tree_links, band_keys, set_ids
from .pretokens import mix
from .shared import BROADCAST_BYTES, bytes_of, done_with, looked_up_counted, stored
from .words import BLANK_SEPARATED, Words, shingles, text_chunks, words_of

SHINGLE = 5
#: A line pair at similarity 0.8 misses all bands with probability 2e-3, one at 0.9 with 3e-6.
BANDS, ROWS = 12, 4
#: Words that a passage has at least.
LEAST_WORDS = 30
#: Shingles of the lines that a task compares.
TASK_SHINGLES = 25_000

_ODD = mix(np.arange(1, 3, dtype=np.uint64)) | np.uint64(1)
_LOW = np.uint64(0xFFFFFFFF)


def _owners(words: Words) -> np.ndarray:
    return np.repeat(np.arange(len(words.bounds) - 1), words.counts)


def lines_of(words: Words, raw: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text, first word and end word of every line with enough words."""
    n = len(words.hashes)
    if not n:
        return tuple(np.empty(0, np.int64) for _ in range(3))
    owner = _owners(words)
    place = np.concatenate([[0], np.cumsum(raw == 10)])[words.starts]
    first = np.flatnonzero(np.append(True, (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])))
    last = np.append(first[1:], n)
    long = last - first >= least
    return owner[first[long]], first[long], last[long]


def runs(hashes: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all runs of ``size`` words, by their first word (runs across texts included)."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    step = 1
    while 2 * step <= size:
        hashes, step = mix(hashes[:-step] + hashes[step:] * _ODD[0]), 2 * step
    return mix(hashes[:n] + hashes[size - step : size - step + n] * _ODD[1] + np.uint64(size))


def _sliding_least(keys: np.ndarray, width: int) -> np.ndarray:
    n, step = len(keys) - width + 1, 1
    while 2 * step <= width:
        keys, step = np.minimum(keys[:-step], keys[step:]), 2 * step
    return np.minimum(keys[:n], keys[width - step : width - step + n])


def stretches(words: Words, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, first window, last window, fingerprint and anchor of every stretch, and all windows' fingerprints.

    A window is a run of ``least`` words. Its anchor is the least of its short runs, the leftmost if several are:
    its content alone decides. Neighbours with one and the same anchor are a stretch, so all windows of a text
    are in stretches, each in one, and no window stands twice in a stretch.
    """
    n = len(words.hashes) - least + 1
    none = np.empty(0, np.int64)
    if n <= 0:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none.view(np.uint64)
    short = max(least // 3, 1)
    grams, windows, owner = runs(words.hashes, short), runs(words.hashes, least), _owners(words)
    anchors = (_sliding_least((grams & ~_LOW) | np.arange(len(grams), dtype=np.uint64), least - short + 1) & _LOW).astype(np.int64)
    at = np.flatnonzero(owner[:n] == owner[least - 1 :])
    anchor = anchors[at]
    new = np.append(True, (anchor[1:] != anchor[:-1]) | (at[1:] != at[:-1] + 1))[: len(at)]
    first, last = at[new], at[np.append(new[1:], True)[: len(at)]]
    # the first and the last window cover a stretch: it has fewer than twice their words
    node = mix(windows[first] + mix(windows[last]) * _ODD[0] + (last - first).astype(np.uint64))
    return owner[first], first, last, node, grams[anchor[new]], windows


def _paragraph_sets(words: Words, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles, sorted, of the given word ranges (each of at least ``SHINGLE`` words)."""
    everything = shingles(words.hashes, SHINGLE)
    size = b - a - SHINGLE + 1
    at = np.repeat(a - (np.cumsum(size) - size), size) + np.arange(size.sum())
    values, cuts = everything[at], np.concatenate([[0], np.cumsum(size)])
    for i, j in pairwise(cuts.tolist()):
        values[i:j].sort()
    keep = np.append(True, values[1:] != values[:-1])[: len(values)]
    keep[cuts[:-1]] = True
    return values[keep], np.concatenate([[0], np.cumsum(keep)])[cuts]


def _code_points(raw: np.ndarray) -> np.ndarray:
    """Code points before each byte."""
    return np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])


_UNITS = "doc_id long, start long, end long, node long, anchor long, bucket long, blob binary, u long, v long"


def _scan(least: int, buckets: int):
    names = [x.split()[0] for x in _UNITS.split(", ")]
    kinds = [*(pa.int64(),) * 6, pa.binary(), pa.int64(), pa.int64()]

    def batch_of(n: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, t)) for k, t in zip(names, kinds, strict=True)], names=names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        postings, seen = Postings(buckets), set()

        def flushed() -> Iterator[pa.RecordBatch]:
            bucket, blobs, edges = postings.flush()
            if bucket:
                yield batch_of(len(bucket), bucket=pa.array(bucket, pa.int64()), blob=pa.array(blobs, pa.binary()))
            if len(edges):
                yield batch_of(len(edges), **{k: pa.array(np.ascontiguousarray(edges[:, i]).view(np.int64)) for i, k in enumerate("uv")})

        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            for first, last, raw, ends in text_chunks(text):
                words = words_of(raw, ends, BLANK_SEPARATED)
                points = _code_points(raw)

                def units_of(owner, a, b, node, **more) -> pa.RecordBatch:
                    base = points[ends[owner]]
                    doc = batch.column(0).slice(first, last - first).take(pa.array(owner))
                    return batch_of(len(a), doc_id=doc, start=pa.array(points[words.starts[a]] - base), end=pa.array(points[words.ends[b - 1]] - base), node=pa.array(node.view(np.int64)), **more)

                owner, head, tail, node, anchor, _ = stretches(words, least)
                if not len(owner):
                    continue
                yield units_of(owner, head, tail + least, node, anchor=pa.array(anchor.view(np.int64)))
                owner, a, b = lines_of(words, raw, least)
                if not len(a):
                    continue
                values, bounds = _paragraph_sets(words, a, b)
                s1, _ = set_ids(values, bounds)
                yield units_of(owner, a, b, s1)
                new = [i for i, x in enumerate(s1.tolist()) if x not in seen and not seen.add(x)]
                if new:
                    some = np.concatenate([values[bounds[i] : bounds[i + 1]] for i in new])
                    postings.add(band_keys(some, np.concatenate([[0], np.cumsum(np.diff(bounds)[new])]), BANDS, ROWS), s1[new])
                if postings.n >= 400_000:
                    yield from flushed()
                if len(seen) > 1_000_000:  # a paragraph that is posted twice does no harm
                    seen.clear()
        yield from flushed()

    return scan


def _line_sets(least: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = pc.fill_null(batch.column(0), "")
            wanted = [dict(zip(x.values.field("node").to_pylist(), x.values.field("component").to_pylist(), strict=True)) for x in batch.column(1)]
            for first, _, raw, ends in text_chunks(text):
                words = words_of(raw, ends, BLANK_SEPARATED)
                owner, a, b = lines_of(words, raw, least)
                if not len(a):
                    continue
                values, bounds = _paragraph_sets(words, a, b)
                s1 = set_ids(values, bounds)[0].view(np.int64).tolist()
                rows = []
                for i, (x, row) in enumerate(zip(s1, owner.tolist(), strict=True)):
                    component = wanted[first + row].get(x)
                    if component is not None:
                        rows.append((component, x, int(bounds[i + 1] - bounds[i]), values[bounds[i] : bounds[i + 1]].tobytes()))
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], names=["component", "node", "n", "values"])

    return scan


def _windows(least: int):
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text, wanted = pc.fill_null(batch.column(1), ""), batch.column(2)
            for first, last, raw, ends in text_chunks(text):
                words = words_of(raw, ends, BLANK_SEPARATED)
                owner, head, tail, node, _, windows = stretches(words, least)
                node, cuts = node.view(np.int64), np.searchsorted(owner, np.arange(last - first + 1))
                asked = np.zeros(len(owner), bool)
                for i in range(last - first):
                    asked[cuts[i] : cuts[i + 1]] = np.isin(node[cuts[i] : cuts[i + 1]], np.asarray(wanted[first + i].values))
                if not asked.any():
                    continue
                head, size = head[asked], (tail - head)[asked] + 1
                at = np.repeat(head - (np.cumsum(size) - size), size) + np.arange(size.sum())
                owner = np.repeat(owner[asked], size)
                points = _code_points(raw)
                base = points[ends[owner]]
                doc = batch.column(0).slice(first, last - first).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([doc, pa.array(points[words.starts[at]] - base), pa.array(points[words.ends[at + least - 1]] - base), pa.array(windows[at].view(np.int64))], names=["doc_id", "start", "end", "node"])

    return scan


_SPANS = "doc_id long, start long, end long, class_id long, keep_doc_id long, links array<struct<class_id:long,keep_doc_id:long>>"


def _islands(rows: np.ndarray) -> pa.RecordBatch:
    """Overlapping spans merged; the columns are document, start, end, class and keeper, sorted by the first three."""
    doc, start, end, kind, keep = rows
    new = np.append(True, doc[1:] != doc[:-1])
    # the furthest end so far in the document: places have 31 bits
    reach = np.maximum.accumulate((np.cumsum(new) << 32) + end) & 0xFFFFFFFF
    new[1:] |= start[1:] > reach[:-1]
    first, island = np.flatnonzero(new), np.cumsum(new)
    order = np.lexsort((keep, kind, island))
    of, k, d = island[order], kind[order], keep[order]
    own = np.append(True, (of[1:] != of[:-1]) | (k[1:] != k[:-1]) | (d[1:] != d[:-1]))
    links = pa.StructArray.from_arrays([pa.array(k[own]), pa.array(d[own])], names=["class_id", "keep_doc_id"])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(of[own] - 1, minlength=len(first)))]).astype(np.int32)
    columns = (doc[first], start[first], np.maximum.reduceat(end, first), np.minimum.reduceat(kind, first), np.minimum.reduceat(keep, first))
    return pa.RecordBatch.from_arrays([*map(pa.array, columns), pa.ListArray.from_arrays(pa.array(offsets), links)], names=["doc_id", "start", "end", "class_id", "keep_doc_id", "links"])


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []  # spans of the last document, which may go on
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = np.stack([np.asarray(c) for c in batch.columns])
        last = int(np.searchsorted(rows[0], rows[0, -1]))
        if held and (last or held[0][0, 0] != rows[0, 0]):
            whole = np.concatenate([*held, rows[:, :last]], axis=1)
            yield _islands(whole)
            held = []
        elif last:
            yield _islands(rows[:, :last])
        held.append(rows[:, last:])
    if held:
        yield _islands(np.concatenate(held, axis=1))


def _asked(rows: DataFrame, asked: DataFrame) -> DataFrame:
    """The documents that are to be read again, with what is asked of each."""
    return rows.join(F.broadcast(asked) if bytes_of(asked) <= BROADCAST_BYTES else asked, "doc_id")


def repeated_passages(documents: DataFrame, least_words: int = LEAST_WORDS, percent: int = 80) -> DataFrame:
    """``doc_id, start, end, class_id, keep_doc_id, links``: spans (code points, end exclusive) that repeat an
    earlier passage, and the document that keeps it.

    Every run of ``least_words`` words that stands earlier is in a span, wherever it begins, and so is a line
    whose near copy stands earlier. A class's first occurrence, by ``doc_id`` and place, stays. Overlapping spans of
    a document are merged; ``links`` lists each class in the merged span with its keeping document, and
    ``class_id`` and ``keep_doc_id`` are the least of these. Rows that share a ``doc_id`` are one document: repeated
    rows give their spans once, and places in different texts of one id are not told apart. Texts without a
    paragraph of ``least_words`` words, null and empty texts and rows without ``doc_id`` give no rows; an empty
    table gives an empty result; texts of any length are read whole; other columns play no part.
    """
    rows = documents.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    buckets = max(documents.count() * BANDS * 8 // BUCKET_POSTINGS, int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    scanned = stored(rows.mapInArrow(_scan(least_words, buckets), _UNITS), "passages")
    units = scanned.where("node is not null").select("doc_id", "start", "end", "node", "anchor")
    met = scanned.where("bucket is not null").select("bucket", "blob").groupBy("bucket").applyInArrow(_meet, "u long, v long")
    groups = components(scanned.where("u is not null").select("u", "v").union(met))
    # a count by unit first, with a document that has it: what asks for documents joins these, not the units
    counts = stored(units.groupBy("node", "anchor").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("doc_id")), "passage-counts")
    # lines that collided: their sets are read again from the one document that stands for each
    source = counts.where("anchor is null").join(groups, "node").select("component", "node", "doc_id")
    wanted = stored(source.groupBy("doc_id").agg(F.collect_list(F.struct("component", "node")).alias("wanted")), "passage-lines")  # at most a document's lines
    sets = _asked(rows, wanted).select("text", "wanted").mapInArrow(_line_sets(least_words), "component long, node long, n long, values binary")
    sets = stored(sets.dropDuplicates(["component", "node"]), "passage-sets")
    near = components(_tree_links(sets, percent, TASK_SHINGLES))
    done_with(sets, wanted)
    # different stretches with one anchor: their windows are compared one by one, in the document that stands for each
    shared = counts.where("anchor is not null").groupBy("anchor").agg(F.count(F.lit(1)).alias("m")).where("m > 1")
    mixed = looked_up_counted(counts.where("anchor is not null").select("anchor", "node", "doc_id"), stored(shared, "passage-anchors"), ["anchor"], "m")
    asked = stored(mixed.groupBy("doc_id").agg(F.collect_list("node").alias("asked")), "passage-stretches")  # at most a document's stretches
    windows = stored(_asked(rows, asked).select("doc_id", "text", "asked").mapInArrow(_windows(least_words), "doc_id long, start long, end long, node long"), "passage-windows")
    again = stored(windows.groupBy("node").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "passage-windows-again")
    # units that can have a double leave the others behind before anything is dealt out
    several = counts.where("n > 1").select("node", "n").unionByName(near.select("node", F.lit(1).cast("long").alias("n"))).groupBy("node").agg(F.sum("n").alias("n"))
    own = looked_up_counted(units.select("doc_id", "start", "end", "node"), stored(several, "passage-nodes"), ["node"], "n").drop("n")
    found = stored(own.unionByName(looked_up_counted(windows, again, ["node"], "n").drop("n")), "passages-several")
    done_with(scanned, counts, windows, asked, again)
    place = F.struct("doc_id", "start")
    named = found.groupBy("node").agg(F.min(place).alias("least"), F.max(place).alias("most"), F.count(F.lit(1)).alias("n"))
    named = stored(named.join(near, "node", "left").withColumn("class_id", F.coalesce("component", "node")).drop("component"), "passage-named")
    keepers = named.groupBy("class_id").agg(F.min("least").alias("keep"), F.max("most").alias("most"), F.count(F.lit(1)).alias("members")).where("keep <> most").drop("most")
    repeated = stored(looked_up_counted(named, stored(keepers, "passage-keepers"), ["class_id"], "members").select("node", "class_id", "keep", "n"), "passage-classes")
    done_with(named)
    spans = looked_up_counted(found, repeated, ["node"], "n").where(place != F.col("keep")).select("doc_id", "start", "end", "class_id", F.col("keep.doc_id").alias("keep_doc_id"))
    # a document's spans meet in order of place, whatever the number of its units
    return spans.repartition("doc_id").sortWithinPartitions("doc_id", "start", "end").mapInArrow(_merged, _SPANS)
